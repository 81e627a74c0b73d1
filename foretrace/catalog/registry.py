"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foretrace.catalog.fixtures import with_views
from foretrace.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The SQL as written, before its views, for queries that extend another one's.
RAW: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Views`` and, where it exists, its SQL twin."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            RAW[name], ORACLES[name] = sql, with_views(sql)
        return fn

    return register


def _rounding(value: str, digits: int) -> str:
    """SQL text of ``round``, bit for bit, without its way through decimal text where no tie is near.

    The scaled value is then off by less than the margin, and a whole number
    over a power of ten is the double nearest to that decimal.
    """
    scaled = f"({value} * 1e{digits}D)"
    return (f"CASE WHEN abs({value}) < 1e{12 - digits}D AND abs({scaled} - rint({scaled})) < 0.499D "
            f"THEN rint({scaled}) / 1e{digits}D ELSE round({value}, {digits}) END")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that both engines agree on the last digit."""
    return df.selectExpr(*[
        f"{_rounding(f'`{c}`', digits)} + 0.0D AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes
    ])


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL text of a rounded double column."""
    return f"round({expression}, {digits}) + CAST(0 AS DOUBLE) AS {name or expression}"
