"""Title queries: prefix search, lookup, counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..functions import text as X
from ..operators import titles as O
from .base import PG, TT, key1_sql, lower_sql, pg, table, tt

ORDER = ("key1", "title", "page_id")


def suggest_prefix_topk(spark, d):
    return O.suggest(pg(spark, d), "th", 20, ORDER).select("page_id", "title", "key1")


def suggest_compat_drop_last(spark, d):
    return O.suggest_page(pg(spark, d), "th", 20, ORDER).select("suggestions", "more")


def suggest_concat(spark, d):
    return O.suggest_page(pg(spark, d), "an", 10, ORDER, compat=False).select("suggestions", "more")


def _phrases(spark, d):
    return pg(spark, d).select(F.expr("left(title, 3)").alias("phrase")).distinct()


def suggest_batch(spark, d):
    return O.suggest_batch(pg(spark, d), _phrases(spark, d), 5, ORDER)


def _asked(spark, d):
    """Queries to the part index: names in lower case by brand."""
    rows = table(spark, d, "part")
    return rows.select(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("query")).distinct()


def _hits(spark, d):
    index = tt(spark, d).groupBy("title", "key0").agg(F.min("id").alias("id"))
    return _asked(spark, d).withColumn("key0", X.key0("query")).join(index, "key0")


def title_lookup_ci(spark, d):
    return _hits(spark, d).groupBy("query").agg(F.count("*").alias("n_hits"), F.min("id").alias("first_id"))


def title_lookup_single(spark, d):
    return O.disambiguate(_hits(spark, d), ["query"]).select("query", "title", "id")


def title_lookup_multi_compat(spark, d):
    return O.variants(_hits(spark, d), ["query"], ["key0", "title"]).select("query", "title", "id")


def titles_no_namespace(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.col("p_brand"), F.when(F.col("p_size") > 25, ":").otherwise(" "), F.col("p_name")).alias("title"))
    return O.main_namespace(rows).groupBy("title").agg(F.count("*").alias("n"))


def random_title(spark, d):
    return O.random_title(pg(spark, d), 42).select("title")


def article_count_by_lang(spark, d):
    return O.counts_by_language(pg(spark, d))


def title_index(spark, d):
    """An index written by language and key range, read back with a range of keys."""
    path = f"{shared_folder(spark)}/titles-{uuid.uuid4().hex}"
    O.write_index(pg(spark, d).select("lang", "title", "key0", "key1").where("lang <> ''"), path, 4)
    found = O.read_index(spark, path).where((F.col("lang") == "en") & (F.col("key1") >= "d") & (F.col("key1") < "q"))
    return found.select("lang", "title", "key1")


def image_count(spark, d):
    return table(spark, d, "pages").select(F.size(F.regexp_extract_all("html", F.lit("<img [^>]*>"), F.lit(0))).alias("n")).agg(
        F.sum(F.col("n").cast("long")).alias("n_images"), F.count("*").alias("n_pages")
    )


def lang_list(spark, d):
    from ..operators.routes import language_list

    rows = pg(spark, d).select("lang").where("lang <> ''").distinct().withColumn("name", F.concat(F.lit("Wiki "), F.upper("lang")))
    return language_list(rows, "fr")


QUERIES = {f.__name__: f for f in (
    suggest_prefix_topk, suggest_compat_drop_last, suggest_concat, suggest_batch, title_lookup_ci, title_lookup_single,
    title_lookup_multi_compat, titles_no_namespace, random_title, article_count_by_lang, image_count, lang_list, title_index,
)}

_HITS = f"""{TT}, ix AS (SELECT title, key0, min(id) AS id FROM tt GROUP BY ALL), asked AS (
    SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS query FROM part),
hits AS (SELECT query, ix.* FROM asked JOIN ix ON {lower_sql('query')} = key0)"""


def _page_sql(prefix: str, k: int, compat: bool) -> str:
    offered = "WHERE r_all < n_all" if compat else ""
    return f"""
WITH {PG}, x AS (
    SELECT *, row_number() OVER (ORDER BY key1, title, page_id) AS r_all, count(*) OVER () AS n_all FROM pg),
hit AS (SELECT *, row_number() OVER (ORDER BY key1, title, page_id) AS r FROM x WHERE starts_with(key1, '{prefix}')),
shown AS (SELECT coalesce(string_agg(title, chr(10) ORDER BY r), '') AS s, count(*) AS n FROM (SELECT * FROM hit {offered}) WHERE r <= {k}),
beyond AS (SELECT count(*) > {k + compat} AS b FROM hit WHERE r <= {k + 2})
SELECT s || CASE WHEN n = {k} AND b THEN chr(10) ELSE '' END AS suggestions, n = {k} AND b AS more FROM shown, beyond"""


SQL = {
    "suggest_prefix_topk": f"WITH {PG} SELECT page_id, title, key1 FROM pg WHERE starts_with(key1, 'th') ORDER BY key1, title, page_id LIMIT 20",
    "suggest_compat_drop_last": _page_sql("th", 20, True),
    "suggest_concat": _page_sql("an", 10, False),
    "suggest_batch": f"""
WITH {PG}, ph AS (SELECT DISTINCT left(title, 3) AS phrase FROM pg WHERE left(title, 3) <> '')
SELECT phrase, CAST(rank AS INTEGER) AS rank, title FROM (
    SELECT phrase, title, row_number() OVER (PARTITION BY phrase ORDER BY key1, title, page_id) AS rank
    FROM ph JOIN pg ON starts_with(key1, {key1_sql('phrase')})) WHERE rank <= 5""",
    "title_lookup_ci": f"WITH {_HITS} SELECT query, count(*) AS n_hits, min(id) AS first_id FROM hits GROUP BY query",
    "title_lookup_single": f"""
WITH {_HITS} SELECT query, title, id FROM (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM hits) WHERE n = 1 OR title = query""",
    "title_lookup_multi_compat": f"""
WITH {_HITS} SELECT query, title, id FROM (
    SELECT *, count(*) OVER (PARTITION BY query) AS n, row_number() OVER (PARTITION BY query ORDER BY key0, title) AS r,
           bool_or(title = query) OVER (PARTITION BY query) AS e FROM hits)
WHERE CASE WHEN e THEN title = query ELSE r = 1 OR r = n END""",
    "titles_no_namespace": """
SELECT title, count(*) AS n FROM (SELECT p_brand || CASE WHEN p_size > 25 THEN ':' ELSE ' ' END || p_name AS title FROM part)
WHERE NOT contains(title, ':') GROUP BY title""",
    "random_title": f"WITH {PG} SELECT title FROM pg WHERE NOT contains(title, ':') ORDER BY left(md5('42' || chr(31) || title), 8), title LIMIT 1",
    "title_index": f"WITH {PG} SELECT lang, title, key1 FROM pg WHERE lang = 'en' AND key1 >= 'd' AND key1 < 'q'",
    "article_count_by_lang": f"WITH {PG} SELECT lang, count(*) AS n_articles FROM pg GROUP BY lang",
    "image_count": "SELECT CAST(sum(len(regexp_extract_all(html, '<img [^>]*>'))) AS BIGINT) AS n_images, count(*) AS n_pages FROM pages",
    "lang_list": f"""
WITH {PG}, l AS (SELECT DISTINCT lang FROM pg WHERE lang NOT IN ('', 'xx'))
SELECT string_agg(lang || ':Wiki ' || upper(lang), chr(10) ORDER BY lang <> 'fr', lang) AS listing FROM l""",
}
