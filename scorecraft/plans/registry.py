"""Registration of driver-visible plans and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``;
    ``oracle`` is the equivalent DuckDB SQL over the driver's views (omit only
    for plans SQL cannot express)."""
    def deco(fn: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"duplicate plan {name!r}")
        _PLANS[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def sql_of(name: str) -> str:
    """The oracle SQL of a plan whose module is imported already."""
    return _ORACLE[name]


def _load_all() -> None:
    # Importing the modules runs their @register decorators.
    from scorecraft.plans import (  # noqa: F401
        analysis_plans,
        exchange_plans,
        label_plans,
        misc_plans,
        parse_plans,
        text_plans,
        tool_plans,
        records_plans,
        results_plans,
        files_plans,
    )


def plans() -> dict[str, Plan]:
    _load_all()
    return dict(_PLANS)


def oracle() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


ROUND_DIGITS = 6


def round_doubles(df, digits: int = ROUND_DIGITS):
    """Report-level rounding of DOUBLE columns (aggregates whose last bits
    depend on summation order), applied identically to the oracle."""
    from pyspark.sql import functions as F
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str, columns: list[str], doubles: set[str], digits: int = ROUND_DIGITS) -> str:
    """The oracle SQL with the same rounding of its DOUBLE columns."""
    sel = ", ".join(f"round({c}, {digits}) AS {c}" if c in doubles else c for c in columns)
    return f"SELECT {sel} FROM (\n{sql}\n) AS q"
