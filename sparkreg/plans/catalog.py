"""Registry of named queries ``(spark, sf_dir) -> DataFrame`` and their
oracle SQL.  Modules register with ``@query(name, sql)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        import functools

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from sparkreg.session import ensure_checkpoint_dir, ship_package
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    from sparkreg.plans import q_prep, q_folds, q_models  # noqa: F401
