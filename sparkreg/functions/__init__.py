"""Row-wise Column expressions.  Everything here is a pure projection that
stays inside whole-stage codegen; no Python runs per row."""

from sparkreg.functions.scalar import (  # noqa: F401
    NAN_CLASS,
    clip,
    coerce_numeric,
    derived,
    expm1_inv,
    finite_or_null,
    impute,
    is_numeric_text,
    log1p_fwd,
    null_to_sentinel,
    one_hot,
    poly2_terms,
    postprocess,
    r2_bucket,
    round_half_away,
    scale,
    yeo_johnson,
    yeo_johnson_inverse,
)
