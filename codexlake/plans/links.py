"""Link, heading, redirect, fallback, configuration and numbering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E, history as H, joins as J
from ..sources.archive import parse_config
from .base import LK, PG, lower_sql, pg, table


def _links(spark, d):
    return E.links(table(spark, d, "pages"))


def link_extract(spark, d):
    return _links(spark, d)


def link_numbered(spark, d):
    return E.numbered(_links(spark, d).where(X.is_external("target")), ["page_id"], ["pos"]).select("page_id", "target", "n")


def _targets(spark, d):
    """Links whose target is taken as a title: the last part of the path, without extension."""
    name = F.regexp_extract("target", r"([^/]*?)(?:\.[a-z]+)?$", 1)
    return _links(spark, d).withColumn("target", name)


def _slugs(spark, d):
    """A title index of all pages: the last part of each address, and the first word of each title."""
    slug = F.regexp_extract("url", r"([^/]*?)(?:\.[a-z]+)?$", 1)
    word = F.regexp_extract("html", r"<title>([^<\s]+)", 1)
    rows = table(spark, d, "pages").select(F.explode(F.array(slug, word)).alias("title")).where("title <> ''")
    return rows.withColumn("key0", X.key0("title"))


def link_validity(spark, d):
    return J.existing_links(_targets(spark, d), _slugs(spark, d), exists=False).select("page_id", "pos", "target")


def link_existing(spark, d):
    return J.existing_links(_targets(spark, d), _slugs(spark, d)).select("page_id", "pos", "target")


def ifexist_semi(spark, d):
    return J.if_exists(_targets(spark, d), _slugs(spark, d), compat=False).select("page_id", "pos", "taken")


def ifexist_compat(spark, d):
    return J.if_exists(_targets(spark, d), _slugs(spark, d)).select("page_id", "pos", "taken")


def heading_extract(spark, d):
    return E.html_headings(table(spark, d, "pages"))


def toc_gate(spark, d):
    """Orders as pages, their lines as headings."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("title"), F.col("l_linenumber").alias("pos"))
    return E.contents_shown(rows)


def toc_level_changes(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("title"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity").cast("int") % 3 + 1).alias("level")
    )
    return E.level_changes(rows)


def wikitext_headings(spark, d):
    body = F.concat(F.lit("== "), F.col("p_name"), F.lit(" ==\ntext\n=== "), F.col("p_brand"), F.lit(" ===\n"))
    return E.headings(table(spark, d, "part").select(F.col("p_partkey").alias("title"), body.alias("body")))


def wikitext_links(spark, d):
    body = F.concat(F.lit("a [["), F.col("p_brand"), F.lit("]] b [["), F.col("p_type"), F.lit("|"), F.col("p_name"), F.lit("]]"))
    return E.wiki_links(table(spark, d, "part").select(F.col("p_partkey").alias("title"), body.alias("body")))


def reference_extract(spark, d):
    body = F.concat(F.lit("x<ref>"), F.col("p_name"), F.lit('</ref>y<ref name="a">'), F.col("p_brand"), F.lit("</ref><ref />"))
    return E.references(table(spark, d, "part").select(F.col("p_partkey").alias("title"), body.alias("body")))


def category_concat(spark, d):
    body = F.concat(F.lit("[[Category:"), F.col("p_brand"), F.lit("]][[kategorie:"), F.col("p_type"), F.lit("]][[Category:"), F.col("p_brand"), F.lit("]]"))
    rows = E.categories(table(spark, d, "part").select(F.col("p_partkey").alias("title"), body.alias("body")))
    return E.ordered_concat(rows, ["title"], "category", ["pos"], " | ", "categories")


def _redirects(spark, d, missing: bool):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    goal = F.concat(F.lit("#REDIRECT [[" if not missing else "#redirect: [[No_"), F.lower("r_name"), F.lit("]]"))
    jumps = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("en").alias("lang"), F.col("n_name").alias("title"), goal.alias("body"))
    goals = region.select(F.lit("en").alias("lang"), F.col("r_name").alias("title"), F.concat(F.lit("About "), "r_name").alias("body"))
    return J.resolve_redirects(jumps.unionByName(goals).withColumn("key0", X.key0("title")))


def redirect_resolve(spark, d):
    return _redirects(spark, d, False)


def redirect_missing(spark, d):
    return _redirects(spark, d, True)


def image_fallback(spark, d):
    """Suppliers, parts and regions as three stores of one file key."""
    key = lambda c, n: (F.col(c) % n).cast("long").alias("file_key")
    first = table(spark, d, "supplier").groupBy(key("s_suppkey", 700)).agg(F.max("s_name").alias("data"))
    second = table(spark, d, "part").groupBy(key("p_partkey", 900)).agg(F.max("p_brand").alias("data"))
    third = table(spark, d, "customer").groupBy(key("c_custkey", 1100)).agg(F.max("c_name").alias("data"))
    return J.first_of(["file_key"], first, second, third)


def _config(spark, d):
    """Lines for each nation: a comment, two values for one key of which the second counts, and its region as a key."""
    region = F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("=yes"))
    line = F.explode(F.array(F.concat(F.lit("#c="), "n_name"), F.concat(F.lit("name="), "n_name", F.lit("=x")), F.concat(F.lit("k=1\r=a"), "n_name"), F.concat(F.lit("k=1=b"), "n_name"), region))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("lang"), line.alias("value"))
    return rows.withColumn("at", F.when(F.startswith("value", F.lit("k=1=b")), 2).otherwise(1))


def config_parse(spark, d):
    return parse_config(_config(spark, d), order="at", by=("lang",))


def config_default(spark, d):
    """A key that the nations of one region have."""
    config = parse_config(_config(spark, d), order="at", by=("lang",))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("lang"))
    return J.setting(rows, config, "region1", "none", "value")


def ref_numbering(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return E.numbered(rows, ["l_orderkey"], [F.desc("l_linenumber"), "l_partkey"])


def template_closure(spark, d):
    """Nations call their region's first nation, and that one the region after."""
    rows = table(spark, d, "nation")
    first = rows.groupBy("n_regionkey").agg(F.min("n_name").alias("first"))
    down = rows.join(first, "n_regionkey").where("n_name <> first").select(F.col("n_name").alias("caller"), F.col("first").alias("callee"))
    after = first.select(((F.col("n_regionkey") + 1) % 5).alias("n_regionkey"), F.col("first").alias("caller")).join(first, "n_regionkey")
    edges = down.union(after.where("n_regionkey <> 0").select("caller", F.col("first").alias("callee")))
    return J.closure(edges, rows.where("n_name = 'CHINA' or n_nationkey = 3").select(F.col("n_name").alias("name")))


def history_log(spark, d):
    """Conversations as sessions: the later half of the turns is appended to the log of the others, and the last three are shown."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("url"))
    half = F.avg("turn").over(Window.partitionBy("conv_id"))
    rows = rows.withColumn("late", F.col("turn") > half)
    log = H.numbered(rows.where("not late"), "conv_id", ["turn", "title", "url"])
    return H.latest(H.append(log, rows.where("late"), "conv_id", ["turn", "title", "url"]), "conv_id", 3).select("conv_id", "seq", "back", "title", "url")


QUERIES = {f.__name__: f for f in (
    link_extract, link_numbered, link_validity, link_existing, ifexist_semi, ifexist_compat, heading_extract, toc_gate, toc_level_changes,
    wikitext_headings, wikitext_links, reference_extract, category_concat, redirect_resolve, redirect_missing, image_fallback, config_parse,
    config_default, ref_numbering, template_closure, history_log,
)}

_TARGETS = f"""{LK}, tg AS (SELECT page_id, pos, regexp_extract(target, '([^/]*?)(?:\\.[a-z]+)?$', 1) AS target FROM lk),
sl AS (SELECT DISTINCT {lower_sql('title')} AS key0 FROM (
    SELECT regexp_extract(url, '([^/]*?)(?:\\.[a-z]+)?$', 1) AS title FROM pages UNION ALL SELECT regexp_extract(html, '<title>([^<\\s]+)', 1) FROM pages)
    WHERE title <> '')"""
_FOUND = f"{lower_sql('target')} IN (SELECT key0 FROM sl)"

SQL = {
    "link_extract": f"WITH {LK} SELECT page_id, pos, target FROM lk",
    "link_numbered": f"""
WITH {LK} SELECT page_id, target, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS n FROM lk
WHERE regexp_matches(target, '^(?i)(https?://|gopher://|mailto:|news://|ftp://|irc://)')""",
    "link_validity": f"WITH {_TARGETS} SELECT page_id, pos, target FROM tg WHERE NOT ({_FOUND})",
    "link_existing": f"WITH {_TARGETS} SELECT page_id, pos, target FROM tg WHERE {_FOUND}",
    "ifexist_semi": f"WITH {_TARGETS} SELECT page_id, pos, {_FOUND} AS taken FROM tg",
    "ifexist_compat": f"WITH {_TARGETS} SELECT page_id, pos, NOT ({_FOUND}) AS taken FROM tg",
    "heading_extract": r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS l,
                  regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS t FROM pages),
u AS (SELECT *, unnest(generate_series(1, len(l))) AS i FROM h)
SELECT page_id, CAST(i AS INTEGER) AS pos, CAST(l[i] AS INTEGER) AS level, t[i] AS text FROM u""",
    "toc_gate": "SELECT l_orderkey AS title, count(*) AS n_headings, count(*) >= 4 AS shown FROM lineitem GROUP BY l_orderkey",
    "toc_level_changes": """
WITH h AS (SELECT l_orderkey AS title, l_linenumber AS pos, CAST(l_quantity AS INTEGER) % 3 + 1 AS level FROM lineitem),
s AS (SELECT *, level - coalesce(lag(level) OVER (PARTITION BY title ORDER BY pos, level), 0) AS step FROM h)
SELECT title, pos, level, greatest(step, 0) AS opened, greatest(-step, 0) AS closed FROM s""",
    "wikitext_headings": """
SELECT p_partkey AS title, 1 AS pos, 1 AS level, p_name AS text FROM part UNION ALL SELECT p_partkey, 2, 2, p_brand FROM part""",
    "wikitext_links": """
SELECT p_partkey AS title, 1 AS pos, p_brand AS target, NULL AS label FROM part UNION ALL SELECT p_partkey, 2, p_type, p_name FROM part""",
    "reference_extract": """
SELECT p_partkey AS title, 1 AS n, p_name AS text FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part""",
    "category_concat": "SELECT p_partkey AS title, p_brand || ' | ' || p_type || ' | ' || p_brand AS categories FROM part",
    "redirect_resolve": """
SELECT 'en' AS lang, n_name AS title, r_name AS resolved_title, 'About ' || r_name AS resolved_body FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'en', r_name, r_name, 'About ' || r_name FROM region""",
    "redirect_missing": """
SELECT 'en' AS lang, n_name AS title, CAST(NULL AS VARCHAR) AS resolved_title, '' AS resolved_body FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'en', r_name, r_name, 'About ' || r_name FROM region""",
    "image_fallback": """
WITH a AS (SELECT s_suppkey % 700 AS file_key, max(s_name) AS data FROM supplier GROUP BY 1),
b AS (SELECT p_partkey % 900 AS file_key, max(p_brand) AS data FROM part GROUP BY 1),
c AS (SELECT c_custkey % 1100 AS file_key, max(c_name) AS data FROM customer GROUP BY 1)
SELECT CAST(file_key AS BIGINT) AS file_key, coalesce(a.data, b.data, c.data) AS data FROM a FULL JOIN b USING (file_key) FULL JOIN c USING (file_key)""",
    "config_parse": """
SELECT n_nationkey AS lang, 'name=' || n_name AS key, 'x' AS value FROM nation UNION ALL SELECT n_nationkey, 'k=1', 'b' || n_name FROM nation
UNION ALL SELECT n_nationkey, 'region' || n_regionkey, 'yes' FROM nation""",
    "config_default": "SELECT n_nationkey AS lang, CASE WHEN n_regionkey = 1 THEN 'yes' ELSE 'none' END AS value FROM nation",
    "ref_numbering": """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) AS INTEGER) AS n FROM lineitem""",
    "history_log": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, CAST(seq AS INTEGER) AS seq, CAST(n - seq + 1 AS INTEGER) AS back, role AS title, text AS url FROM n WHERE n - seq < 3""",
    "template_closure": """
WITH RECURSIVE f AS (SELECT n_regionkey, min(n_name) AS first FROM nation GROUP BY 1),
e AS (SELECT n_name AS caller, first AS callee FROM nation JOIN f USING (n_regionkey) WHERE n_name <> first
      UNION ALL SELECT a.first, b.first FROM f a JOIN f b ON (a.n_regionkey + 1) % 5 = b.n_regionkey WHERE b.n_regionkey <> 0),
r AS (SELECT n_name AS name FROM nation WHERE n_name = 'CHINA' OR n_nationkey = 3 UNION SELECT callee FROM r JOIN e ON e.caller = r.name)
SELECT name FROM r""",
}
