"""Registration of queries by operator id, each with the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from inboxlake.sources.derived import AS_OF, DERIVATIONS, Inbox, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = f"timestamp '{AS_OF}'"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, which both engines hand over alike."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def with_tables(sql: str) -> str:
    """The SQL with the derived tables it names in front. It may begin with steps of its own (", x as (...)")."""
    used = [name for name in DERIVATIONS if re.search(rf"\b(from|join)\s+{name}\b", sql)]
    body = sql.strip()
    if body.startswith("with "):
        return body
    start = "with recursive" if ", recursive " in body else "with"
    body = body.replace(", recursive ", ", ")
    if not used:
        return (start + " " + body[1:]) if body.startswith(",") else body
    return f"{start} {ctes(*used)}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``build(inbox) -> DataFrame`` under an operator id."""

    def register(build: Callable[[Inbox], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(build(Inbox(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return build

    return register
