"""Scoring a stream.  The scoring chain is row-local with broadcast
lookups, so the same lazy plan runs on a streaming DataFrame: a file source
with ``availableNow`` processes what is there, exactly once, into a Parquet
sink with its own checkpoint in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sparkreg.plans.score import score


def score_stream(spark: SparkSession, src_dir: str, schema: StructType, bundle, out_path: str,
                 checkpoint: str, glob: str | None = None, max_files: int | None = None) -> None:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(src_dir)
    scored: DataFrame = score(stream, bundle)
    q = (scored.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
