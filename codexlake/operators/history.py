"""The log of visited pages: append-only rows, numbered in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(visits: DataFrame, session: str, order: list) -> DataFrame:
    """Adds seq, from 1, to the visits of each session."""
    return visits.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def append(log: DataFrame, visits: DataFrame, session: str, order: list) -> DataFrame:
    """The log with new visits behind those it has; a session goes on where it stopped."""
    last = log.groupBy(session).agg(F.max("seq").alias("__last"))
    new = numbered(visits, session, order).join(last, session, "left")
    new = new.withColumn("seq", F.col("seq") + F.coalesce("__last", F.lit(0))).drop("__last")
    return log.unionByName(new.select(*log.columns))


def latest(log: DataFrame, session: str, k: int) -> DataFrame:
    """The last k visits of each session, latest first."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("seq")))
    return log.withColumn("back", back).where(F.col("back") <= k)
