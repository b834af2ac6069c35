"""Scalar Column builders.

Each function takes and returns ``pyspark.sql.Column`` objects so a whole
scoring chain folds into one projection that Catalyst can codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must agree with the reference for identical results.
NAN_CLASS = "__NaN__"          # literal class for a missing category
SCALE_FLOOR = 1e-8             # scalers divide by max(scale, 1e-8)
YJ_LAMBDA_TOL = 1e-6           # Yeo-Johnson branch tolerance at 0 and 2
YJ_BASE_FLOOR = 1e-12          # Yeo-Johnson inverse floors its base here
R2_BUCKETS = [                 # (lower bound, key), checked top-down
    (0.95, "very_high"),
    (0.85, "high"),
    (0.70, "practical"),
    (0.50, "moderate"),
    (0.0, "insufficient"),
]
R2_BUCKET_BELOW = "nonfunctional"
# Whole-cell numeric literal: optional sign, digits with optional point, or a
# leading point, then an optional exponent; surrounding blanks allowed.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite_or_null(c) -> Column:
    """NaN, +inf, -inf become NULL."""
    c = _c(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def is_numeric_text(c) -> Column:
    """P04 guard: true when the whole cell is a plain decimal literal."""
    return _c(c).rlike(NUMERIC_PATTERN)


def coerce_numeric(c) -> Column:
    """Whole-cell parse of a string to double; anything else is NULL.

    ``try_cast`` alone would accept ``1d``, ``inf`` or ``NaN``; the regex
    guard keeps only plain decimal literals.
    """
    c = _c(c).cast("string")
    return F.when(is_numeric_text(c), F.trim(c).try_cast("double"))


def clip(c, lo: float | None, hi: float | None) -> Column:
    """clamp to [lo, hi]; NULL stays NULL (bare greatest skips NULLs)."""
    c = _c(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def log1p_fwd(c) -> Column:
    """F03 forward."""
    return F.log1p(_c(c))


def expm1_inv(c) -> Column:
    """F03 inverse."""
    return F.expm1(_c(c))


def yeo_johnson(c, lam: float) -> Column:
    """Yeo-Johnson forward transform at a fixed lambda."""
    x = _c(c)
    lam = float(lam)
    if abs(lam) < YJ_LAMBDA_TOL:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    if abs(lam - 2.0) < YJ_LAMBDA_TOL:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x >= 0, pos).otherwise(neg)


def yeo_johnson_inverse(c, lam: float) -> Column:
    """inverse Yeo-Johnson; the power base is floored at 1e-12."""
    y = _c(c)
    lam = float(lam)
    if abs(lam) < YJ_LAMBDA_TOL:
        pos = F.expm1(y)
    else:
        pos = F.pow(F.greatest(y * lam + 1.0, F.lit(YJ_BASE_FLOOR)), F.lit(1.0 / lam)) - 1.0
    if abs(lam - 2.0) < YJ_LAMBDA_TOL:
        neg = 1.0 - F.exp(-y)
    else:
        neg = 1.0 - F.pow(F.greatest(y * (lam - 2.0) + 1.0, F.lit(YJ_BASE_FLOOR)), F.lit(1.0 / (2.0 - lam)))
    return F.when(y.isNull(), F.lit(None).cast("double")).when(y >= 0, pos).otherwise(neg)


def round_half_away(c) -> Column:
    """sign(x) * floor(abs(x) + 0.5) as a double."""
    c = _c(c)
    return F.signum(c) * F.floor(F.abs(c) + 0.5).cast("double")


def null_to_sentinel(c) -> Column:
    """NULL or empty category becomes the literal class ``__NaN__``."""
    return F.coalesce(F.nullif(_c(c).cast("string"), F.lit("")), F.lit(NAN_CLASS))


def bool_label(c) -> Column:
    """Bool categories render as ``True`` / ``False`` (Spark says true/false)."""
    return F.initcap(_c(c).cast("string"))


def one_hot(c, classes: Sequence[str]) -> list[Column]:
    """one double column per class of ``c`` (sentinel applied first).
    Unseen classes give all zeros."""
    s = null_to_sentinel(c)
    return [(s == F.lit(k)).cast("double") for k in classes]


def impute(c, value: float) -> Column:
    """NULL -> median fill value."""
    return F.coalesce(_c(c), F.lit(float(value)))


def derived(op: str, cols: Sequence) -> Column:
    """derived feature from (already clipped) source columns.
    ops: ``mul`` a*b, ``sq`` a^2, ``sign`` signum(a); non-finite -> NULL."""
    cs = [_c(x) for x in cols]
    if op == "mul":
        v = cs[0] * cs[1]
    elif op == "sq":
        v = cs[0] * cs[0]
    elif op == "sign":
        v = F.signum(cs[0])
    else:
        raise ValueError(f"unknown derived op {op!r}")
    return finite_or_null(v)


def scale(c, center: float, scl: float) -> Column:
    """(x - center) / max(scale, 1e-8)."""
    return (_c(c) - F.lit(float(center))) / F.lit(max(float(scl), SCALE_FLOOR))


def poly2_terms(names: Sequence[str], interaction_only: bool = False) -> list[tuple[str, tuple[int, ...]]]:
    """F12 term list: singles first, then x_i*x_j for i <= j in (i, j) order.
    Names are ``a``, ``a b`` and ``a^2``."""
    terms: list[tuple[str, tuple[int, ...]]] = [(n, (i,)) for i, n in enumerate(names)]
    for i in range(len(names)):
        for j in range(i, len(names)):
            if i == j and interaction_only:
                continue
            nm = f"{names[i]}^2" if i == j else f"{names[i]} {names[j]}"
            terms.append((nm, (i, j)))
    return terms


def poly2_expand(cols: Sequence, names: Sequence[str], interaction_only: bool = False) -> list[Column]:
    """degree-2 expansion as named columns."""
    cs = [_c(x) for x in cols]
    out = []
    for nm, idx in poly2_terms(names, interaction_only):
        v = cs[idx[0]] if len(idx) == 1 else cs[idx[0]] * cs[idx[1]]
        out.append(v.alias(nm))
    return out


def r2_bucket(c) -> Column:
    """R2 interpretation key."""
    c = _c(c)
    expr = None
    for lo, key in R2_BUCKETS:
        expr = (F.when(c >= lo, F.lit(key)) if expr is None else expr.when(c >= lo, F.lit(key)))
    return expr.otherwise(F.lit(R2_BUCKET_BELOW))


def postprocess(c, smear: float, lo: float, hi: float, round_output: bool) -> Column:
    """pred * smear, clamp to [lo, hi], optional half-away rounding."""
    v = F.least(F.greatest(_c(c) * F.lit(float(smear)), F.lit(float(lo))), F.lit(float(hi)))
    v = F.when(_c(c).isNull(), F.lit(None).cast("double")).otherwise(v)
    return round_half_away(v) if round_output else v


def report_json(cols: dict) -> Column:
    """one JSON string of named values; non-finite doubles become null
    and null fields are kept (``ignoreNullFields=false``)."""
    parts = []
    for name, c in cols.items():
        parts.append(c.alias(name))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- names
# Column names with dots or backticks would be read as paths; inside the
# library look-alike characters stand for them.
_SAFE = {".": "\u2024", "`": "\u2035"}


def safe_name(name: str) -> str:
    return "".join(_SAFE.get(ch, ch) for ch in name)


def shown_name(name: str) -> str:
    """The name as the caller wrote it."""
    for raw, safe in _SAFE.items():
        name = name.replace(safe, raw)
    return name
