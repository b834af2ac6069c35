"""Model bundles.

A bundle is a folder: ``meta.json`` (spec-sized: feature list, encoder
plan, clip bounds, medians, transform, post-process, linear / GP / MLP
parameters), one Parquet table per target encoder (written by Spark, never
through the driver), and one of nodes per tree model.
Writes go to a fresh version folder; the ``CURRENT`` pointer is replaced
last, so a reader never sees a half-written bundle.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.operators.gp import GPSpec
from sparkreg.operators.linear import LinearSpec
from sparkreg.operators.mlp import MLPSpec
from sparkreg.operators.trees import TreeSpec, node_table, spec_from_nodes

FORMAT_VERSION = 2


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _jsonable(o):
    if isinstance(o, np.ndarray):
        return o.tolist()
    if isinstance(o, (np.floating,)):
        return float(o)
    if isinstance(o, (np.integer,)):
        return int(o)
    if isinstance(o, dict):
        return {str(k): _jsonable(v) for k, v in o.items()}
    if isinstance(o, (list, tuple)):
        return [_jsonable(v) for v in o]
    if isinstance(o, float) and not np.isfinite(o):
        return None
    return o


def spec_to_json(kind: str, spec, models_dir: str, spark: SparkSession) -> dict:
    if isinstance(spec, LinearSpec):
        return {"type": "linear", "feats": spec.feats, "coef": spec.coef, "intercept": spec.intercept,
                "medians": spec.medians, "alpha": spec.alpha}
    if isinstance(spec, TreeSpec):
        node_table(spec, spark).write.parquet(os.path.join(models_dir, kind))
        return {"type": "trees", "kind": spec.kind, "feats": spec.feats, "medians": spec.medians, "init": spec.init,
                "mean": spec.mean, "nodes": kind}
    if isinstance(spec, GPSpec):
        return {"type": "gp", "feats": spec.feats, "medians": spec.medians, "x_mean": spec.x_mean,
                "x_std": spec.x_std, "y_mean": spec.y_mean, "y_std": spec.y_std, "ls": spec.ls, "sv": spec.sv,
                "nv": spec.nv, "Z": spec.Z, "alpha": spec.alpha}
    if isinstance(spec, MLPSpec):
        return {"type": "mlp", "feats": spec.feats, "medians": spec.medians, "sizes": spec.sizes,
                "x_mean": spec.x_mean, "x_std": spec.x_std, "y_mean": spec.y_mean, "y_std": spec.y_std,
                "w": spec.w}
    if isinstance(spec, dict) and spec.get("type") == "poly":
        return spec
    raise TypeError(type(spec))


def spec_from_json(d: dict, models_dir: str, spark: SparkSession):
    t = d["type"]
    if t == "linear":
        return LinearSpec(d["feats"], d["coef"], d["intercept"], d["medians"], d["alpha"])
    if t == "trees":
        nodes = spark.read.parquet(os.path.join(models_dir, d["nodes"])).toPandas()
        return spec_from_nodes(nodes, **{k: d[k] for k in ("kind", "feats", "medians", "init", "mean")})
    if t == "gp":
        return GPSpec(d["feats"], d["medians"], np.array(d["x_mean"]), np.array(d["x_std"]), d["y_mean"],
                      d["y_std"], np.array(d["ls"]), d["sv"], d["nv"], np.array(d["Z"]), np.array(d["alpha"]))
    if t == "mlp":
        return MLPSpec(d["feats"], d["medians"], d["sizes"], np.array(d["x_mean"]), np.array(d["x_std"]),
                       d["y_mean"], d["y_std"], np.array(d["w"]))
    if t == "poly":
        return d
    raise ValueError(t)


@dataclass
class Bundle:
    meta: dict
    members: dict                       # kind -> spec
    encoders: dict = field(default_factory=dict)   # column -> DataFrame(class, value)
    root: str = ""


def save_bundle(spark: SparkSession, root: str, meta: dict, members: dict, encoders: dict) -> str:
    """Write a new version folder, then swap the CURRENT pointer.  All
    writes go through Spark / the Hadoop FileSystem of ``root``."""
    from sparkreg.session import rename, write_text
    version = f"v-{uuid.uuid4().hex[:12]}"
    vdir = os.path.join(root, version)
    mdir = os.path.join(vdir, "models")
    meta = dict(meta)
    meta["format_version"] = FORMAT_VERSION
    meta["members"] = {k: spec_to_json(k, s, mdir, spark) for k, s in members.items()}
    meta["encoders"] = {}
    for c, (frame, default, n_classes) in encoders.items():
        p = os.path.join(vdir, "encoders", c)
        frame.write.mode("overwrite").parquet(p)
        meta["encoders"][c] = {"path": os.path.relpath(p, vdir), "default": default, "n_classes": n_classes}
    write_text(spark, os.path.join(vdir, "meta.json"), json.dumps(_jsonable(meta)))
    tmp = os.path.join(root, f".CURRENT-{uuid.uuid4().hex[:6]}")
    write_text(spark, tmp, version)
    rename(spark, tmp, os.path.join(root, "CURRENT"))
    return vdir


def load_bundle(spark: SparkSession, root: str) -> Bundle:
    """Read the bundle the CURRENT pointer names."""
    from sparkreg.session import read_text
    vdir = os.path.join(root, read_text(spark, os.path.join(root, "CURRENT")).strip())
    meta = json.loads(read_text(spark, os.path.join(vdir, "meta.json")))
    mdir = os.path.join(vdir, "models")
    members = {k: spec_from_json(d, mdir, spark) for k, d in meta["members"].items()}
    enc = {c: spark.read.parquet(os.path.join(vdir, e["path"])) for c, e in meta.get("encoders", {}).items()}
    return Bundle(meta, members, enc, vdir)


def model_tables(spark: SparkSession, b: Bundle) -> dict[str, DataFrame]:
    """The portable model as tables."""
    m = b.meta
    out = {}
    coef_rows, point_rows, kernel_rows, layer_rows = [], [], [], []
    for kind, spec in b.members.items():
        linear = spec if isinstance(spec, dict) else vars(spec) if isinstance(spec, LinearSpec) else None
        if linear:
            coef_rows += [(kind, f, float(c)) for f, c in zip(linear["feats"], linear["coef"])]
            coef_rows.append((kind, "(intercept)", float(linear["intercept"])))
        if isinstance(spec, GPSpec):
            point_rows += [(kind, i, f, float(z), float(spec.alpha[i])) for i, row in enumerate(spec.Z)
                           for f, z in zip(spec.feats, row)]
            kernel_rows += [(kind, f, float(v)) for f, v in zip(spec.feats, spec.ls)]
            kernel_rows += [(kind, "(signal)", float(spec.sv)), (kind, "(noise)", float(spec.nv))]
        if isinstance(spec, MLPSpec):
            at = 0
            for layer, (n_in, n_out) in enumerate(zip(spec.sizes, spec.sizes[1:])):
                block = np.asarray(spec.w[at:at + n_in * n_out + n_out], dtype=float).reshape(n_in + 1, n_out)
                layer_rows += [(kind, layer, i if i < n_in else -1, j, float(block[i, j]))
                               for i in range(n_in + 1) for j in range(n_out)]
                at += n_in * n_out + n_out
    out["kernel_points"] = spark.createDataFrame(
        point_rows, "model string, point int, feature string, value double, weight double")
    out["kernel_scales"] = spark.createDataFrame(kernel_rows, "model string, feature string, value double")
    out["layers"] = spark.createDataFrame(      # input -1 is the bias
        layer_rows, "model string, layer int, input int, output int, value double")
    out["coefficients"] = spark.createDataFrame(coef_rows, "model string, feature string, value double")
    med_rows = [(kind, f, float(v)) for kind, spec in b.members.items()
                for f, v in (spec["medians"] if isinstance(spec, dict) else spec.medians).items()]
    out["medians"] = spark.createDataFrame(med_rows, "model string, feature string, median double")
    clip = m["prep"].get("clip", {})
    out["clip_bounds"] = spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in clip.items()],
                                               "feature string, lo double, hi double")
    p = m["post"]
    out["postprocess"] = spark.createDataFrame(
        [(m["best"], m["prep"]["transform"], m["prep"].get("lambda"), float(p["smear"]), float(p["lo"]),
          float(p["hi"]), bool(p["round"]))],
        "model string, y_transform string, yj_lambda double, smear double, lo double, hi double, round boolean")
    enc_parts = [frame.select(F.lit(c).alias("column"), "class", "value") for c, frame in b.encoders.items()]
    oh = [(c, k, 1.0) for c, ks in m["prep"].get("onehot", {}).items() for k in ks]
    enc = spark.createDataFrame(oh, "column string, class string, value double")
    for e in enc_parts:
        enc = enc.unionByName(e)
    out["encoders"] = enc
    trees = [node_table(s, spark).withColumn("kind", F.lit(k)) for k, s in b.members.items() if isinstance(s, TreeSpec)]
    if trees:
        t = trees[0]
        for x in trees[1:]:
            t = t.unionByName(x)
        out["tree_nodes"] = t
    return out
