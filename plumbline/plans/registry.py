"""Where plans register: a name, the inventory ids it covers, the job, and an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    covers: str
    job: Job
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, covers: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in PLANS:
            raise ValueError(f"plan {name!r} is registered twice")
        PLANS[name] = Plan(name, covers, job, sql)
        return job

    return add


def publish(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (no minus zero), whole numbers to bigint: what the SQL side returns.

    A billionth is added first: the data is full of exact decimal halves, and two
    engines that sum in different orders would round those to different sides.
    """
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def r6(expression: str, name: str) -> str:
    """The SQL side of ``publish`` for one double."""
    return f"round(({expression}) + 1e-9, 6) + 0e0 AS {name}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)
