"""Tables and derived views that the catalogue's queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.extract import page_titles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles: (page_id, url, lang, title, key0, key1)."""
    rows = page_titles(table(spark, sf_dir, "pages"))
    return rows.withColumn("key0", X.key0("title")).withColumn("key1", X.key1("title"))


def tt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as a title index with many duplicates: (id, title, key0); every third name in capitals."""
    rows = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return rows.select(F.col("p_partkey").alias("id"), title.alias("title")).withColumn("key0", X.key0("title"))


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lower_sql(x: str) -> str:
    return f"translate({x}, {q(X.LOWER_FROM)}, {q(X.LOWER_TO)})"


def upper_sql(x: str) -> str:
    return f"translate({x}, {q(X.UPPER_FROM)}, {q(X.UPPER_TO)})"


def fold_sql(x: str) -> str:
    return f"translate({x}, {q(X.DIACRITIC_FROM)}, {q(X.DIACRITIC_TO)})"


def key1_sql(x: str) -> str:
    return fold_sql(lower_sql(x))


PG = f"""pg AS (
    SELECT page_id, url, lang, title, {lower_sql('title')} AS key0, {key1_sql('title')} AS key1, html FROM (
        SELECT page_id, url, html, regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) AS lang,
               regexp_extract(html, '<title>(.*?)</title>', 1) AS title
        FROM pages))"""

TT = f"""tt AS (
    SELECT id, title, {lower_sql('title')} AS key0 FROM (
        SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title FROM part))"""

LK = """lk AS (
    SELECT page_id, CAST(i AS INTEGER) AS pos, xs[i] AS target FROM (
        SELECT page_id, xs, unnest(generate_series(1, len(xs))) AS i FROM (
            SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS xs FROM pages)))"""
