"""Scoring plan (D01-D08, P09, P10, U02): one lazy projection from raw
columns to the attached prediction; no action inside, so the same plan
scores a batch table or a streaming DataFrame.

Order: encode (one-hot, target-encoder lookup) -> numeric coercion and
non-finite -> NULL -> clip -> align to the model's columns (absent -> NULL)
-> impute -> predict by type -> inverse y transform -> smear / clip /
round -> attach.  The caller's own columns are kept untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions import scalar as S
from sparkreg.functions.scalar import impute
from sparkreg.operators.encode import join_lookup, onehot_name
from sparkreg.operators.gp import GPSpec
from sparkreg.operators.linear import LinearSpec, poly_columns
from sparkreg.operators.mlp import MLPSpec
from sparkreg.operators.trees import TreeSpec


def align_to_model(df: DataFrame, feats: Sequence[str], medians: dict[str, float],
                   keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Project to the model's columns.  A column the input lacks is
    NULL, then the model median (else 0.0); extra columns are ignored unless
    named in ``keep``.  Returns the frame and the missing column names."""
    have = set(df.columns)
    missing = [c for c in feats if c not in have]
    cols = [F.col(c) for c in keep if c in have and c not in feats]
    for c in feats:
        src = F.col(c).cast("double") if c in have else F.lit(None).cast("double")
        cols.append(impute(src, medians.get(c, 0.0)).alias(c))
    return df.select(*cols), missing


def attach_prediction(df: DataFrame, target: str, pred: str) -> DataFrame:
    """P10: overwrite the target column if present, else append it last."""
    if target in df.columns:
        return df.select(*[F.col(pred).alias(target) if c == target else F.col(c)
                           for c in df.columns if c != pred])
    return df.withColumnRenamed(pred, target)


def _raw_sources(feat: str, prep: dict) -> list[str]:
    """Source column(s) of a model feature name."""
    for r in prep.get("recipe", []):
        if r["name"] == feat:
            return list(r["cols"])
    if feat.endswith("__all"):
        return [feat[: -len("__all")]]
    if "==" in feat:
        src = feat.split("==", 1)[0]
        if src in prep.get("onehot", {}):
            return [src]
    if feat in prep.get("numeric", []):
        return [feat]
    return [feat]


def required_columns(meta: dict) -> list[str]:
    """Ordered distinct raw columns every member needs (encoded and
    derived names resolved to their sources)."""
    out: list[str] = []
    for m in meta["members"].values():
        feats = m.get("feats", []) if m.get("type") != "poly" else m["top"]
        for f in feats:
            for s in _raw_sources(f, meta["prep"]):
                if s not in out:
                    out.append(s)
    return [S.shown_name(c) for c in out]


def encode_features(df: DataFrame, bundle) -> tuple[DataFrame, list[str]]:
    """Encoder and cleaning stage: adds every model feature column (with
    internal names) next to the caller's columns.  Returns the frame and
    the model columns missing from the input (P09 report)."""
    meta = bundle.meta
    prep = meta["prep"]
    have = set(df.columns)
    out = df
    missing = []
    for c, classes in prep.get("onehot", {}).items():
        src = F.col(c) if c in have else F.lit(None).cast("string")
        if c in have and dict(df.dtypes)[c] == "boolean":
            src = S.bool_label(src)
        sent = S.null_to_sentinel(src)
        clip = prep.get("clip", {})
        cols = []
        for k in classes:
            v = (sent == F.lit(k)).cast("double")
            name = onehot_name(c, k)
            if name in clip:
                v = S.clip(v, *clip[name])
            cols.append(v.alias(f"__m_{name}"))
        out = out.select("*", *cols)
        if c not in have:
            missing.append(c)
    for c, e in meta.get("encoders", {}).items():
        table = bundle.encoders[c].select(F.col("class").alias(f"__cls_{c}"), F.col("value").alias(f"__m_{c}__all"))
        src = F.col(c).cast("string") if c in have else F.lit(None).cast("string")
        if c not in have:
            missing.append(c)
        keyed = out.withColumn(f"__cls_{c}", S.null_to_sentinel(src))
        out = join_lookup(keyed, table, f"__cls_{c}", e.get("n_classes")).drop(f"__cls_{c}")
        out = out.withColumn(f"__m_{c}__all", F.coalesce(F.col(f"__m_{c}__all"), F.lit(float(e["default"]))))
    clip = prep.get("clip", {})
    for c in prep.get("numeric", []):
        if c in have:
            t = dict(df.dtypes)[c]
            v = S.coerce_numeric(F.col(c)) if t == "string" else F.col(c).cast("double")
            v = S.finite_or_null(v)
        else:
            v = F.lit(None).cast("double")
            missing.append(c)
        if c in clip:
            v = S.clip(v, *clip[c])
        out = out.withColumn(f"__m_{c}", v)
    for r in prep.get("recipe", []):        # F10 on the clipped sources
        out = out.withColumn(f"__m_{r['name']}", S.derived(r["op"], [F.col(f"`__m_{c}`") for c in r["cols"]]))
    return out, missing


def add_poly(df: DataFrame, spec: dict, out: str, prefix: str = "") -> DataFrame:
    """Fill, scale, expand and weigh the columns of a polynomial model,
    found under their names with ``prefix``."""
    top = [f"__pp_{i}" for i in range(len(spec["top"]))]
    filled = df.select("*", *[F.coalesce(F.col(f"`{prefix}{c}`").cast("double"), F.lit(float(spec["medians"].get(c, 0.0))))
                              .alias(t) for t, c in zip(top, spec["top"])])
    terms = poly_columns(top, {t: spec["center"][c] for t, c in zip(top, spec["top"])},
                         {t: spec["scale"][c] for t, c in zip(top, spec["top"])})
    e = F.lit(float(spec["intercept"]))
    for term, w in zip(terms, spec["coef"]):
        e = e + F.lit(float(w)) * term
    return filled.withColumn(out, e).drop(*top)


def add_prediction(df: DataFrame, spec, out: str) -> DataFrame:
    """The prediction of a fitted model of any family as one more column."""
    if isinstance(spec, dict):
        return add_poly(df, spec, out)
    if isinstance(spec, LinearSpec):
        return df.withColumn(out, spec.predict())
    return spec.transform(df, out) if isinstance(spec, TreeSpec) else spec.predict_column(df, out)


def _member_column(df: DataFrame, kind: str, spec, out: str) -> DataFrame:
    """Dispatch on the member type; features are read from ``__m_*``."""
    ren = {f: f"__m_{f}" for f in (spec["feats"] if isinstance(spec, dict) else spec.feats)}
    if isinstance(spec, dict) and spec.get("type") == "poly":
        return add_poly(df, spec, out, "__m_")
    if isinstance(spec, LinearSpec):
        e = F.lit(spec.intercept)
        for c, w in zip(spec.feats, spec.coef):
            e = e + F.lit(w) * F.coalesce(F.col(f"`{ren[c]}`"), F.lit(spec.medians.get(c, 0.0)))
        return df.withColumn(out, e)
    # trees / gp / mlp read plain feature names: expose them under those names
    tmp_names = {c: f"__t_{i}" for i, c in enumerate(spec.feats)}
    view = df.select("*", *[F.col(f"`{ren[c]}`").alias(tmp_names[c]) for c in spec.feats])
    if isinstance(spec, TreeSpec):
        s2 = replace(spec, feats=[tmp_names[c] for c in spec.feats],
                     medians={tmp_names[c]: v for c, v in spec.medians.items() if c in tmp_names})
        res = s2.transform(view, out)
    elif isinstance(spec, GPSpec):
        s2 = GPSpec([tmp_names[c] for c in spec.feats], {tmp_names[c]: v for c, v in spec.medians.items()
                                                         if c in tmp_names},
                    spec.x_mean, spec.x_std, spec.y_mean, spec.y_std, spec.ls, spec.sv, spec.nv, spec.Z, spec.alpha)
        res = s2.predict_column(view, out)
    elif isinstance(spec, MLPSpec):
        s2 = MLPSpec([tmp_names[c] for c in spec.feats], {tmp_names[c]: v for c, v in spec.medians.items()
                                                          if c in tmp_names},
                     spec.sizes, spec.x_mean, spec.x_std, spec.y_mean, spec.y_std, spec.w)
        res = s2.predict_column(view, out)
    else:
        raise ValueError(f"unknown model type for {kind}")
    return res.drop(*tmp_names.values())


def _inverse(col, prep):
    t = prep["transform"]
    if t == "log1p":
        return S.expm1_inv(col)
    if t == "yeo_johnson":
        return S.yeo_johnson_inverse(col, prep["lambda"])
    return col


def score(df: DataFrame, bundle, out: str | None = None) -> DataFrame:
    """The whole scoring chain as one lazy plan.  The prediction
    overwrites the target column if the input has one, else is appended."""
    meta = bundle.meta
    prep = meta["prep"]
    target = S.safe_name(out) if out else prep["target"]
    given = {S.safe_name(c): c for c in df.columns}
    cur, _ = encode_features(df.toDF(*given), bundle)
    best = meta["best"]
    members = list(meta["weights"]) if best == "blend" else [best]
    for k in members:
        cur = _member_column(cur, k, bundle.members[k], f"__p_{k}")
        cur = cur.withColumn(f"__p_{k}", _inverse(F.col(f"__p_{k}"), prep))
    if best == "blend":
        raw = sum((F.col(f"__p_{k}") * F.lit(float(w)) for k, w in meta["weights"].items()), F.lit(0.0))
    else:
        raw = F.col(f"__p_{best}")
    p = meta["post"]
    cur = cur.withColumn("__pred", S.postprocess(raw, p["smear"], p["lo"], p["hi"], p["round"]))
    drop = [c for c in cur.columns if c.startswith("__m_") or c.startswith("__p_")]
    cur = cur.drop(*drop)
    cur = attach_prediction(cur, target, "__pred")
    return cur.toDF(*[given.get(c, S.shown_name(c)) for c in cur.columns])
