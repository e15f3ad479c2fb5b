"""Tables extracted from pages and wikitext with built-in expressions: links, headings, categories, numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HREF = r'href="([^"]*)"'
TITLE = r"<title>(.*?)</title>"
PAGE_LANGUAGE = r"^https?://[^/]+/([a-z]{2})/"


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, url, lang, title) of HTML pages."""
    return pages.select(
        "page_id", "url", F.regexp_extract("url", PAGE_LANGUAGE, 1).alias("lang"), F.regexp_extract("html", TITLE, 1).alias("title")
    )


def every(body: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col(body) if isinstance(body, str) else body, F.lit(pattern), F.lit(group))


def links(pages: DataFrame, key: str = "page_id", body: str = "html", pattern: str = HREF) -> DataFrame:
    """(key, pos, target): every match in document order, from 1."""
    found = pages.select(key, F.posexplode(every(body, pattern)).alias("pos", "target"))
    return found.withColumn("pos", F.col("pos") + 1)


def wiki_links(articles: DataFrame, key: str = "title", body: str = "body") -> DataFrame:
    """(key, pos, target, label) of internal links; the label is null when the target is shown."""
    inner = r"\[\[([^\[\]]+)\]\]"
    rows = articles.select(key, F.posexplode(every(body, inner)).alias("pos", "link"))
    return rows.select(
        key, (F.col("pos") + 1).alias("pos"), F.split_part("link", F.lit("|"), F.lit(1)).alias("target"),
        F.when(F.contains("link", F.lit("|")), F.regexp_extract("link", r"^[^|]*\|(.*)$", 1)).alias("label"),
    )


def categories(articles: DataFrame, key: str = "title", body: str = "body") -> DataFrame:
    """(key, pos, category): category links in document order, duplicates kept."""
    rows = articles.select(key, F.posexplode(every(body, r"\[\[(?i:category|kategorie):([^\]]*)\]\]")).alias("pos", "category"))
    return rows.withColumn("pos", F.col("pos") + 1)


def headings(articles: DataFrame, key: str = "title", body: str = "body") -> DataFrame:
    """(key, pos, level, text) of ``==`` headings in document order."""
    rows = articles.select(key, F.posexplode(every(body, r"(?m)^ *(==+[^\n]*)", 1)).alias("pos", "line"))
    marks = F.length(F.regexp_extract("line", r"^(=+)", 1))
    text = F.trim(F.regexp_replace("line", r"^=+|==+[^=]*$", ""))
    return rows.select(key, (F.col("pos") + 1).alias("pos"), (marks - 1).alias("level"), text.alias("text"))


def html_headings(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """(key, pos, level, text) of ``<h1>`` to ``<h6>`` in document order."""
    pattern = r"(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    both = F.arrays_zip(every(body, pattern, 1).alias("level"), every(body, pattern, 2).alias("text"))
    rows = pages.select(key, F.posexplode(both).alias("pos", "h"))
    return rows.select(key, (F.col("pos") + 1).alias("pos"), F.col("h.level").cast("int").alias("level"), F.col("h.text").alias("text"))


def references(articles: DataFrame, key: str = "title", body: str = "body") -> DataFrame:
    """(key, n, text): references numbered in document order, each up to the next tag."""
    rows = articles.select(key, F.posexplode(every(body, r"<ref(?: [^>/]*)?>([^<]+)")).alias("pos", "text"))
    return rows.select(key, (F.col("pos") + 1).alias("n"), "text")


def contents_shown(headings_: DataFrame, key: str = "title", least: int = 4) -> DataFrame:
    """(key, n_headings, shown): a table of contents is shown from four headings on."""
    return headings_.groupBy(key).agg(F.count("*").alias("n_headings")).withColumn("shown", F.col("n_headings") >= least)


def level_changes(headings_: DataFrame, key: str = "title") -> DataFrame:
    """Adds ``opened`` and ``closed``: lists to open and close before each heading's entry."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy(key).orderBy("pos", "level")), F.lit(0))
    step = F.col("level") - before
    return headings_.withColumn("opened", F.greatest(step, F.lit(0))).withColumn("closed", F.greatest(-step, F.lit(0)))


def numbered(rows: DataFrame, group: list[str], order: list, into: str = "n") -> DataFrame:
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def ordered_concat(rows: DataFrame, group: list[str], value: str, order: list[str], separator: str, into: str) -> DataFrame:
    """Values of a group joined in order, duplicates kept."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda p: p["__v"]), separator).alias(into))


def template_arguments(articles: DataFrame) -> DataFrame:
    """(title, call, template, position, name, value) of the arguments of each article's outermost calls, numbered as a template sees them."""
    from ..markup.templates import call_arguments

    @F.pandas_udf("array<struct<call int, template string, position int, name string, value string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else call_arguments(t))

    return articles.select("title", F.inline(run("body")))
