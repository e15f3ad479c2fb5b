"""String, number and date queries over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text as X
from ..functions.chinese import simplified_table
from ..operators.routes import split_listing
from .base import PG, fold_sql, key1_sql, lower_sql, pg, q, table, upper_sql


def _docs(expression):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", expression("text").alias("folded"))


def search_key(spark, d):
    return pg(spark, d).select("page_id", "key0", "key1")


def fold_zh(spark, d):
    word = F.concat(F.col("n_name"), F.lit("亂並國"), F.col("n_name"), F.lit("學寶ab"))
    return table(spark, d, "nation").select("n_nationkey", X.fold_zh(word).alias("folded"))


def fold_zh_letters(spark, d):
    """Every letter that folds, among the nations' names."""
    word = F.concat(F.col("n_name"), F.lit(simplified_table()[0]), F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", X.fold_zh(word).alias("folded"))


def search_key_zh(spark, d):
    """Search keys in which the pages of one language count as Chinese."""
    lang = F.when(F.col("lang") == "es", "zh").otherwise(F.col("lang"))
    return pg(spark, d).select("page_id", X.key1(F.concat(F.col("title"), F.lit("亂國學é")), lang).alias("key1"))


def starts_with(spark, d):
    return table(spark, d, "part").select("p_partkey", X.starts_with("p_type", "Eco").alias("exact"), X.starts_with_case("p_type", "eco").alias("folded"))


def split_parts(spark, d):
    line = F.concat(F.col("p_name"), F.lit("||"), F.col("p_brand"), F.lit("|"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(X.split_keep(line, "|")).alias("at", "part"))


def underscores(spark, d):
    return pg(spark, d).select("page_id", X.blanks_to_underscores("title").alias("file"), X.underscores_to_blanks(X.blanks_to_underscores("title")).alias("name"))


def utf8_decode(spark, d):
    """Titles as bytes with a stray byte in front and a character cut off at the end."""
    raw = F.concat(F.unhex(F.lit("80")), F.encode("title", "UTF-8"), F.unhex(F.lit("C3")))
    return pg(spark, d).select("page_id", X.utf8_decode(raw).alias("decoded"), X.utf8_decode(F.encode("title", "UTF-8")).alias("whole"))


def latin1_codec(spark, d):
    word = F.concat(F.col("p_name"), F.lit("éÿ"))
    return table(spark, d, "part").select(
        "p_partkey", X.latin1_decode(F.encode(word, "ISO-8859-1")).alias("decoded"),
        X.latin1_decode(X.latin1_encode(F.concat(word, F.lit("日🙂ā")))).alias("encoded"),
    )


def language_split(spark, d):
    listing = F.concat(F.lit("en:"), F.col("p_name"), F.lit("\nde:a:"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(split_listing(listing)).alias("at", "entry")).select(
        "p_partkey", "at", F.col("entry.code").alias("code"), F.col("entry.name").alias("name"))


def url_encode_titles(spark, d):
    title = F.concat(F.col("title"), F.lit(' <é"#%>'))
    return pg(spark, d).select("page_id", X.url_encode(title).alias("encoded"))


def url_decode_links(spark, d):
    from ..operators.extract import links

    return links(table(spark, d, "pages")).select("page_id", "pos", X.url_decode(F.concat(F.col("target"), F.lit("%20+%C3%A9"))).alias("decoded"))


def anchor_names(spark, d):
    return pg(spark, d).select("page_id", X.anchor_name(F.concat(F.col("title"), F.lit(" #é"))).alias("anchor"))


def strip_comments(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_comments("html").alias("stripped"))


def trim_ctrl(spark, d):
    padded = F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\r\n \x01"))
    return table(spark, d, "documents").select("doc_id", X.trim(padded).alias("trimmed"), F.length(X.trim_left(padded)).alias("n_left"),
                                               F.length(X.trim_right(padded)).alias("n_right"))


def leading_int(spark, d):
    word = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.leading_int(word).alias("value"))


def _file(column="p_name"):
    ending = F.element_at(F.array(*map(F.lit, (".SVG", ".png", ".Jpg", ".mp4", ".bin", ""))), (F.col("p_size") % 6 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 7 == 0, F.lit("abc")).when(F.col("p_partkey") % 7 == 1, F.lit("a.svg.b")).otherwise(F.col(column))
    return F.concat(name, ending)


def svg_key(spark, d):
    return table(spark, d, "part").select("p_partkey", X.svg_key(_file()).alias("file_key"))


def cache_key(spark, d):
    return pg(spark, d).select("page_id", X.cache_key(F.concat(F.col("title"), F.lit("/A:b\\c"))).alias("cache_key"))


def mime_type(spark, d):
    return table(spark, d, "part").select("p_partkey", X.mime_type(_file()).alias("mime"))


def pixel_size(spark, d):
    p = F.col("p_size").cast("string")
    word = F.when(F.col("p_size") % 3 == 0, F.concat(p, F.lit("px"))).when(F.col("p_size") % 3 == 1, F.concat(p, F.lit("x20PX "))).otherwise(p)
    s = X.pixel_size(word)
    return table(spark, d, "part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))


def formatnum(spark, d):
    # Cents as a whole number, so that both engines write the same digits.
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    text = F.concat((F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * F.floor(cents / 100)).cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", X.format_number(text).alias("shown"))


def magic_dates(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", *(v.alias(k.lower()) for k, v in dates.values(F.col("ts")).items()), dates.http_date(F.col("ts")).alias("http_date"))


def page_names(spark, d):
    name = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    has = F.contains(name, F.lit("/"))
    return table(spark, d, "pages").select(
        "page_id", name.alias("pagename"), F.when(has, F.substring_index(name, "/", -1)).otherwise("").alias("subpagename"),
        F.when(has, F.split_part(name, F.lit("/"), F.lit(1))).otherwise("").alias("basepagename"), F.concat(F.lit("en/"), name).alias("fullpagename"),
    )


def newline_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_newlines(F.replace("text", F.lit("\n"), F.lit("\r"))).alias("normalized"))


def external_scheme(spark, d):
    from ..operators.extract import links

    return links(table(spark, d, "pages")).select("page_id", "pos", X.is_external("target").alias("external"))


QUERIES = {
    "fold_lower": _docs(X.to_lower), "fold_upper": _docs(X.to_upper), "fold_diacritic": _docs(X.fold_diacritics),
} | {f.__name__: f for f in (
    search_key, fold_zh, url_encode_titles, url_decode_links, anchor_names, strip_comments, trim_ctrl, leading_int, svg_key, cache_key,
    mime_type, pixel_size, formatnum, magic_dates, page_names, newline_normalize, external_scheme, fold_zh_letters, search_key_zh,
    starts_with, split_parts, underscores, utf8_decode, latin1_codec, language_split,
)}

_FILE = """CASE p_partkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN 'a.svg.b' ELSE p_name END || (ARRAY['.SVG', '.png', '.Jpg', '.mp4', '.bin', ''])[p_size % 6 + 1]"""


def _escaped(x: str, skip_blank: bool = False) -> str:
    for plain, escaped in X.URL_ESCAPES:
        if not (skip_blank and plain == " "):
            x = f"replace({x}, {q(plain)}, {q(escaped)})"
    return x


def _each(x: str, change: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN c > chr(127) THEN {change} ELSE c END), '')"


_UTF8 = "regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g')"
_LOW_BYTE = "'%' || lpad(upper(to_hex(unicode(c) & 255)), 2, '0')"
_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MIME_TYPES.items())
from .base import LK  # noqa: E402

SQL = {
    "fold_lower": f"SELECT doc_id, {lower_sql('text')} AS folded FROM documents",
    "fold_upper": f"SELECT doc_id, {upper_sql('text')} AS folded FROM documents",
    "fold_diacritic": f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents",
    "search_key": f"WITH {PG} SELECT page_id, key0, key1 FROM pg",
    "fold_zh": f"SELECT n_nationkey, translate(n_name || '亂並國' || n_name || '學寶ab', {q(X.ZH_FROM)}, {q(X.ZH_TO)}) AS folded FROM nation",
    "url_encode_titles": f"""WITH {PG} SELECT page_id, {_each(_escaped("(title || ' <é" + '"' + "#%>')"), _UTF8)} AS encoded FROM pg""",
    "url_decode_links": f"WITH {LK} SELECT page_id, pos, url_decode(target || '%20+%C3%A9') AS decoded FROM lk",
    "anchor_names": f"""WITH {PG} SELECT page_id, {_each(_escaped("replace(title || ' #é', ' ', '_')", True), _LOW_BYTE)} AS anchor FROM pg""",
    "strip_comments": "SELECT page_id, regexp_replace(html, '(?s)<!--.*?(-->|\\z)', '', 'g') AS stripped FROM pages",
    "trim_ctrl": r"""
WITH p AS (SELECT doc_id, ' ' || chr(9) || chr(10) || text || chr(13) || chr(10) || ' ' || chr(1) AS t FROM documents)
SELECT doc_id, regexp_replace(t, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS trimmed,
       CAST(length(regexp_replace(t, '^[\x00-\x20]+', '')) AS INTEGER) AS n_left,
       CAST(length(regexp_replace(t, '[\x00-\x20]+$', '')) AS INTEGER) AS n_right FROM p""",
    "leading_int": """
SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || p_name ELSE p_name END, '^[0-9]+') AS INTEGER), 0) AS value
FROM part""",
    "svg_key": f"""
SELECT p_partkey, CASE WHEN (ends_with(k, '.svg') AND strpos(k, '.svg') = length(k) - 3) OR octet_length(encode(k)) = 3 THEN k || '.png' ELSE k END AS file_key FROM (SELECT p_partkey, {lower_sql('(' + _FILE + ')')} AS k FROM part)""",
    "cache_key": f"""
WITH {PG} SELECT page_id, replace(replace(replace({lower_sql(_each(_escaped("(title || '/A:b' || chr(92) || 'c')"), _UTF8))}, '/', '%2f'), chr(92), '%5c'), ':', '%3a') AS cache_key FROM pg""",
    "mime_type": f"SELECT p_partkey, CASE lower(regexp_extract({_FILE}, '\\.([A-Za-z0-9]+)$', 1)) {_MIME} END AS mime FROM part",
    "pixel_size": """
SELECT p_partkey, CASE WHEN p_size % 3 <> 2 THEN p_size END AS width, CASE WHEN p_size % 3 = 1 THEN 20 END AS height FROM part""",
    "formatnum": r"""
WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
t AS (SELECT o_orderkey, CAST((CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (cents // 100) AS VARCHAR) AS w, cents % 100 AS f FROM c),
g AS (SELECT *, reverse(regexp_replace(reverse(w), '([0-9]{3})', '\1,', 'g')) AS s FROM t)
SELECT o_orderkey, (CASE WHEN starts_with(s, ',') THEN s[2:] ELSE s END) || '.' || lpad(CAST(f AS VARCHAR), 2, '0') AS shown FROM g""",
    "magic_dates": """
SELECT event_id, CAST(day(ts) AS VARCHAR) AS day, strftime(ts, '%d') AS day2, strftime(ts, '%A') AS dayname, CAST(dayofweek(ts) AS VARCHAR) AS dow,
       strftime(ts, '%m') AS month, strftime(ts, '%b') AS monthabbrev, strftime(ts, '%B') AS monthname, strftime(ts, '%H:%M') AS time,
       strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, CAST((dayofyear(ts) - 1) // 7 + 1 AS VARCHAR) AS week, strftime(ts, '%Y') AS year,
       strftime(ts, '%Y') || lpad(CAST(month(ts) - 1 AS VARCHAR), 2, '0') || strftime(ts, '%d%H%M%S') AS timestamp,
       strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS http_date FROM events""",
    "page_names": """
WITH n AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS name FROM pages)
SELECT page_id, name AS pagename, CASE WHEN contains(name, '/') THEN regexp_extract(name, '([^/]*)$', 1) ELSE '' END AS subpagename,
       CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) ELSE '' END AS basepagename, 'en/' || name AS fullpagename FROM n""",
    "starts_with": "SELECT p_partkey, starts_with(p_type, 'Eco') AS exact, starts_with(lower(p_type), 'eco') AS folded FROM part",
    "split_parts": "SELECT p_partkey, unnest([0, 1, 2, 3])::INTEGER AS at, unnest([p_name, '', p_brand, '']) AS part FROM part",
    "underscores": f"WITH {PG} SELECT page_id, replace(title, ' ', '_') AS file, replace(replace(title, ' ', '_'), '_', ' ') AS name FROM pg",
    "utf8_decode": f"WITH {PG} SELECT page_id, '?' || title AS decoded, title AS whole FROM pg",
    "latin1_codec": "SELECT p_partkey, p_name || 'éÿ' AS decoded, p_name || 'éÿ#####' || chr(1) AS encoded FROM part",
    "language_split": """
SELECT p_partkey, unnest([0, 1])::INTEGER AS at, unnest(['en', 'de']) AS code, unnest([p_name, 'a:' || p_brand]) AS name FROM part""",
    "newline_normalize": "SELECT doc_id, replace(text, chr(13), chr(10)) AS normalized FROM documents",
    "external_scheme": f"""
WITH {LK} SELECT page_id, pos, regexp_matches(target, '^(?i)(https?://|gopher://|mailto:|news://|ftp://|irc://)') AS external FROM lk""",
}


def session_sql() -> dict[str, str]:
    """SQL that holds the whole table of Chinese letters, which only a session can give."""
    old, new = map(q, simplified_table())
    low = lower_sql("title || '亂國學é'")
    return {
        "fold_zh_letters": f"SELECT n_nationkey, translate(n_name || {old} || n_name, {old}, {new}) AS folded FROM nation",
        "search_key_zh": f"WITH {PG} SELECT page_id, CASE WHEN lang = 'es' THEN translate({low}, {old}, {new}) ELSE {fold_sql(low)} END AS key1 FROM pg",
    }
