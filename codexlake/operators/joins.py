"""The joins an archive needs: redirects, link validity, priority lookups, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import text as X
from .titles import disambiguate


def resolve_redirects(articles: DataFrame) -> DataFrame:
    """(lang, title, resolved_title, resolved_body): one hop; a missing or ambiguous target gives an empty body.

    ``articles`` has (lang, title, key0, body).
    """
    rows = articles.withColumn("target", F.when(X.is_redirect("body"), X.redirect_target("body")))
    jumps = rows.where("target is not null").select("lang", "title", "target", X.key0("target").alias("key0"))
    goals = articles.select("lang", "key0", F.col("title").alias("resolved_title"), F.col("body").alias("resolved_body"))
    hits = disambiguate(jumps.join(goals, ["lang", "key0"]), ["lang", "title"], "target", "resolved_title")
    found = jumps.select("lang", "title").join(hits.drop("key0", "target"), ["lang", "title"], "left")
    found = found.select("lang", "title", "resolved_title", F.coalesce("resolved_body", F.lit("")).alias("resolved_body"))
    own = rows.where("target is null").select("lang", "title", F.col("title").alias("resolved_title"), F.col("body").alias("resolved_body"))
    return own.unionByName(found)


def existing_links(links: DataFrame, titles: DataFrame, target: str = "target", exists: bool = True) -> DataFrame:
    """Links whose folded target is (or is not) a title."""
    keys = titles.select(F.col("key0").alias("__key")).distinct()
    return links.join(keys, X.key0(target) == F.col("__key"), "left_semi" if exists else "left_anti")


def if_exists(calls: DataFrame, titles: DataFrame, target: str = "target", compat: bool = True) -> DataFrame:
    """Adds ``taken``: which branch of an existence test is taken; with ``compat`` the test is inverted."""
    keys = titles.select(F.col("key0").alias("__key")).distinct().withColumn("__found", F.lit(True))
    rows = calls.join(keys, X.key0(target) == F.col("__key"), "left")
    found = F.coalesce("__found", F.lit(False))
    return rows.withColumn("taken", ~found if compat else found).drop("__key", "__found")


def first_of(key: list[str], *sources: DataFrame) -> DataFrame:
    """Union of sources with equal columns; of the rows of a key, that of the earliest source stays."""
    tagged = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    best = F.row_number().over(Window.partitionBy(*key).orderBy("__source"))
    return rows.withColumn("__best", best).where("__best = 1").drop("__best", "__source")


def setting(rows: DataFrame, config: DataFrame, key: str, default: str, into: str) -> DataFrame:
    """Adds a configured value by language, or the default; ``config`` has (lang, key, value)."""
    own = config.where(F.col("key") == key).select("lang", F.col("value").alias("__value"))
    return rows.join(own, "lang", "left").withColumn(into, F.coalesce("__value", F.lit(default))).drop("__value")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(name): everything reachable over (caller, callee), the start included; a frontier step for each level, to the last."""

    known = frontier = checkpointed(start.select("name").distinct())
    level = 0
    while not frontier.isEmpty():
        found = edges.join(frontier, edges.caller == F.col("name"), "left_semi").select(F.col("callee").alias("name")).distinct()
        frontier = checkpointed(found.join(known, "name", "left_anti"))
        known, level = known.union(frontier), level + 1
        if level % 16 == 0:
            known = checkpointed(known.distinct())
    return known
