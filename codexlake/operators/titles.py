"""Title index operators: case-insensitive lookup, folded prefix search, counts, random title.

A title table has (lang, title, key0, key1) and whatever columns an application
adds. Keys are materialised when the table is written, so lookups are plain
predicates on columns that reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

SUGGESTIONS = 25


def with_keys(titles: DataFrame, title: str = "title", lang: str | None = "lang", secondary: bool = True) -> DataFrame:
    """Adds both search keys."""
    return titles.withColumn("key0", X.key0(title)).withColumn("key1", X.key1(title, lang, secondary))


def write_index(titles: DataFrame, path: str, partitions: int | None = None, sample: str = "key1") -> None:
    """Parquet by language, range-partitioned and sorted by key, so row groups can be skipped."""
    order = ["lang", sample, "title"]
    dealt = titles.repartitionByRange(partitions, *order) if partitions else titles.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.partitionBy("lang").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_index`` wrote; predicates on ``lang`` and on a key skip folders and row groups."""
    return spark.read.parquet(path)


def find(titles: DataFrame, query: Column | str) -> DataFrame:
    """All titles equal to the query but for case."""
    q = F.lit(query) if isinstance(query, str) else query
    return titles.where(F.col("key0") == X.key0(q))


def disambiguate(hits: DataFrame, by: list[str], query: str = "query", title: str = "title") -> DataFrame:
    """Of the hits of each query: the only one, or of several the one that is spelled the same."""
    peers = Window.partitionBy(*by)
    return hits.withColumn("__n", F.count("*").over(peers)).where((F.col("__n") == 1) | (F.col(title) == F.col(query))).drop("__n")


def variants(hits: DataFrame, by: list[str], order: list, query: str = "query", title: str = "title", compat: bool = True) -> DataFrame:
    """The exactly spelled hit of each query alone, else all; with ``compat`` only the first and last of several."""
    peers = Window.partitionBy(*by)
    exact = F.max((F.col(title) == F.col(query)).cast("int")).over(peers)
    rows = hits.withColumn("__exact", exact).withColumn("__n", F.count("*").over(peers))
    rows = rows.withColumn("__at", F.row_number().over(peers.orderBy(*order)))
    many = F.col("__at").isin(1) | (F.col("__at") == F.col("__n")) if compat else F.lit(True)
    keep = F.when(F.col("__exact") == 1, F.col(title) == F.col(query)).otherwise(many)
    return rows.where(keep).drop("__exact", "__n", "__at")


def suggest(titles: DataFrame, phrase: str, k: int = SUGGESTIONS, order: tuple[str, ...] = ("key1", "title")) -> DataFrame:
    """The first k titles whose folded key starts with the folded phrase; none for an empty phrase."""
    if not phrase:
        return titles.limit(0)
    return titles.where(F.startswith("key1", X.key1(F.lit(phrase)))).orderBy(*order).limit(k)


def suggest_page(titles: DataFrame, phrase: str, k: int = SUGGESTIONS, order: tuple[str, ...] = ("key1", "title"),
                 compat: bool = True) -> DataFrame:
    """One row (suggestions, more): the newline-joined page, and whether a title beyond it matches.

    With ``compat`` the index' last title is never offered, and the marker looks
    one title further than the next.
    """
    hits = titles.where(F.startswith("key1", X.key1(F.lit(phrase)))) if phrase else titles.limit(0)
    if compat:
        last = titles.orderBy(*(F.desc(c) for c in order)).limit(1).select(*order)
        hits = hits.join(F.broadcast(last.withColumn("__last", F.lit(1))), list(order), "left")  # one row
    else:
        hits = hits.withColumn("__last", F.lit(None).cast("int"))
    page = hits.orderBy(*order).limit(k + 2)  # two beyond the page decide on the marker
    rows = page.select(F.struct(*dict.fromkeys([*order, "title"]), F.col("__last").alias("l")).alias("r"))
    listed = rows.agg(F.sort_array(F.collect_list("r")).alias("rs"))  # k + 2 rows
    offered = F.filter("rs", lambda r: r["l"].isNull())
    shown = F.slice(F.transform(offered, lambda r: r["title"]), 1, k)
    beyond = F.size("rs") > k + (1 if compat else 0)
    more = (F.size(shown) == k) & beyond
    return listed.select(
        F.concat(F.array_join(shown, "\n"), F.when(more, "\n").otherwise("")).alias("suggestions"), more.alias("more")
    )


def suggest_batch(titles: DataFrame, phrases: DataFrame, k: int, order: tuple[str, ...] = ("key1", "title"),
                  phrase: str = "phrase") -> DataFrame:
    """Top-k of many phrases at once: (phrase, rank, title).

    A title is paired with a phrase through the phrase's length in characters and
    the key's prefix of that length, an equi-join whatever the number of phrases.
    """
    asked = phrases.select(F.col(phrase).alias("phrase"), X.key1(phrase).alias("__p")).where("length(__p) > 0").distinct()
    lengths = asked.agg(F.sort_array(F.collect_set(F.length("__p"))).alias("__lengths"))  # no longer than the longest phrase
    keyed = titles.join(F.broadcast(lengths)).select(*titles.columns, F.explode("__lengths").alias("__n"))
    keyed = keyed.where(F.length("key1") >= F.col("__n")).withColumn("__p", F.expr("left(key1, __n)"))
    hits = keyed.join(asked, "__p")
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("phrase", "rank", "title")


def main_namespace(titles: DataFrame, title: str = "title") -> DataFrame:
    return titles.where(~F.contains(F.col(title), F.lit(":")))


def drawing(seed: int, *columns) -> Column:
    """A whole number below 2**32 that looks random; the seed and the columns' texts decide it, in any engine that has md5."""
    return F.conv(F.left(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *columns)), F.lit(8)), 16, 10).cast("long")


def random_title(titles: DataFrame, seed: int, title: str = "title") -> DataFrame:
    """One title without a namespace, drawn by the seed; the same rows and seed give the same title."""
    return main_namespace(titles, title).orderBy(drawing(seed, F.col(title)), title).limit(1)


def counts_by_language(titles: DataFrame) -> DataFrame:
    return titles.groupBy("lang").agg(F.count("*").alias("n_articles"))
