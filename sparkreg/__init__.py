"""sparkreg: a Spark-native tabular regression engine.

Table in, numeric target named, out comes an honestly evaluated regression
model plus batch (or streaming) predictions.  All row-sized work runs as
DataFrame jobs; only spec-sized results (bounds, encoders, d x d Grams,
m x m kernels) ever reach the driver.
"""

__version__ = "0.1.0"
