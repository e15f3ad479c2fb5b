"""Requests to responses: what the server answers to each request line, as a query.

The title index is brought to one row for each folded key, so an answer needs one
equi-join and no window; the same plan serves batches and streams. ``serve`` adds
what the answers hold: pages, lists of suggestions, images, files, error pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .titles import SUGGESTIONS, drawing, main_namespace

NOT_FOUND, NOT_INSTALLED = "/wiki/xx/Article not found", "/wiki/xx/Language not installed"
#: The archive whose images all languages share, and the hidden language of the help pages.
COMMONS, HELP = "xc", "xx"
HTML = "text/html; charset=utf-8"
#: Titles among which a language's random ones are drawn.
DRAWN = 1_024
_DRAWN = "\0"

# The reason and the text of each kind of error.
ERRORS = {
    "method": (501, "Not supported", "Method is not supported."), "language": (404, "Not found", "Language not installed."),
    "article": (404, "Not Found", "Article not found."), "file": (404, "Not Found", "File not found."),
    "phrase": (404, "Nothing to search for or search string to short.", ""), "index": (404, "No language code not installed", ""),
    "command": (404, "Command not found", "File not found."), "slash": (302, "Found", "Directories must end with a slash."),
    "listing": (403, "Directory Listing Denied", "This virtual directory does not allow contents to be listed."),
    "access": (403, "Forbidden", "Access denied."),
}


def spellings(titles: DataFrame) -> DataFrame:
    """(lang, key0, spellings): the distinct spellings of each folded title, in order."""
    return titles.groupBy("lang", "key0").agg(F.sort_array(F.collect_set("title")).alias("spellings"))


def parse(requests: DataFrame, line: str = "line", default: str = "en") -> DataFrame:
    """Adds method, path, route, lang and argument; lines without method, path and protocol are dropped.

    An article's language code and name are taken from the decoded path; a code has two characters and ends with a
    slash or a colon. Image and search requests may go without one and then get the default.
    """
    parts = F.split(X.trim(line), r"\s+")
    rows = requests.withColumn("__p", parts).where(F.size("__p") >= 3)
    rows = rows.withColumn("method", F.col("__p")[0]).withColumn("path", F.col("__p")[1]).drop("__p")
    low = X.to_lower("path")
    wiki, ajax = F.startswith(low, F.lit("/wiki/")), F.startswith(low, F.lit("/ajax/")) & (F.length("path") > 6)
    tail = F.substr("path", F.lit(7))
    own, whole = F.when(tail.rlike("(?s)^..[:/]"), F.substr(tail, F.lit(4))).otherwise(tail), X.url_decode(tail)
    separator = F.substr(whole, F.lit(3), F.lit(1))
    phrase = F.substr("path", F.lit(14))
    code = F.when(tail.rlike("(?s)^..[:/]"), X.to_lower(F.left(tail, F.lit(2)))).otherwise(F.lit(default))
    drawn = F.substr("path", F.lit(30))
    route = (
        F.when(X.to_lower("method") != "get", "unsupported")
        .when(wiki & F.contains(X.to_lower(own), F.lit("image:")), "image")
        .when(wiki & (own == ""), "main")
        .when(wiki & (separator == "/"), "article")
        .when(wiki & (separator == ":"), "article_colon")
        .when(wiki, "article_default")
        .when(ajax & F.contains(X.to_lower(tail), F.lit("search:")), "search")
        .when(ajax & F.contains(X.to_lower(tail), F.lit("redirecttorandomarticle")), "random")
        .when(ajax & F.contains(X.to_lower(tail), F.lit("getinstalledlanguages")), "languages")
        .when(ajax, "ajax")
        .otherwise("static")
    )
    rows = rows.withColumn("route", route)
    is_route = lambda *names: F.col("route").isin(*names)
    coded = F.substr(phrase, F.lit(3), F.lit(1)) == ":"
    lang = (
        F.when(is_route("article", "article_colon"), F.left(whole, F.lit(2)))
        .when(is_route("image", "main"), code)
        .when(is_route("search"), F.when(coded, F.left(phrase, F.lit(2))).otherwise(F.lit(default)))
        .when(is_route("random"), F.when(F.length(drawn) >= 2, F.left(drawn, F.lit(2))).otherwise(F.lit(default)))
        .otherwise("")
    )
    argument = (
        F.when(is_route("article", "article_colon"), F.substr(whole, F.lit(4)))
        .when(is_route("image"), X.blanks_to_underscores(X.url_decode(F.substr(own, F.lit(7)))))
        .when(is_route("search"), X.url_decode(F.when(coded, F.substr(phrase, F.lit(4))).otherwise(phrase)))
        .when(is_route("article_default"), tail)
        .otherwise("")
    )
    file = F.when(is_route("image"), F.concat(F.lit("/Images/"), F.substr(own, F.lit(7)))).when(is_route("static"), F.col("path"))
    return rows.select(*requests.columns, "method", "path", "route", lang.alias("lang"), argument.alias("argument"), file.alias("file"))


def draws(titles: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, drawn): up to ``DRAWN`` titles without a namespace of each language, by the seed."""
    rows = main_namespace(titles).select("lang", "title", drawing(seed, "title").alias("h"))
    few = rows.groupBy("lang", (F.col("h") % DRAWN).alias("slot")).agg(F.min_by("title", F.struct("h", "title")).alias("title"))
    return few.groupBy("lang").agg(F.sort_array(F.collect_set("title")).alias("drawn"))


def _optional(rows: DataFrame, table: DataFrame | None, keys: list[tuple[str, Column]], flag: str, values: tuple[str, ...] = ()) -> DataFrame:
    """Left join to distinct keys of a table that may not be there; ``flag`` says whether one was found."""
    if table is None:
        found = rows.withColumn(flag, F.lit(False))
        for value in values:
            found = found.withColumn(value, F.lit(None).cast("boolean"))
        return found
    right = table.groupBy(*(F.col(name).alias(f"__{flag}_{name}") for name, _ in keys)).agg(
        F.lit(True).alias(f"__{flag}"), *(F.max(v).alias(v) for v in values)
    )
    on = None
    for name, value in keys:
        same = F.col(f"__{flag}_{name}") == value
        on = same if on is None else on & same
    joined = rows.join(right, on, "left").drop(*(f"__{flag}_{name}" for name, _ in keys))
    return joined.withColumn(flag, F.coalesce(f"__{flag}", F.lit(False))).drop(f"__{flag}")


def respond(requests: DataFrame, titles: DataFrame, languages: list[str], default: str, main_pages: dict[str, str] | None = None,
            files: DataFrame | None = None, images: DataFrame | None = None, seed: int = 0, compat: bool = True) -> DataFrame:
    """(requests' columns, route, lang, argument, title, choices, status, location, error, file) of each well-formed request line.

    ``title`` is the article to show for status 200; several spellings are in ``choices``. ``error`` names the entry of
    ``ERRORS``. ``files`` has (path, is_dir) of what exists under the web content or the data folder; ``images`` has
    (lang, file_key), of which a language's own come before the shared ones. Random titles follow from the seed and
    the request. With ``compat`` a language counts as installed if its code occurs in the list joined by commas.
    """
    rows = parse(requests, default=default)
    # One join serves articles and random titles; no title's key is the sign under which those drawn are kept.
    known = spellings(titles).unionByName(draws(titles, seed).select("lang", F.lit(_DRAWN).alias("key0"), F.col("drawn").alias("spellings")))
    known = known.select(F.col("lang").alias("__lang"), F.col("key0").alias("__key"), "spellings")
    key = F.when(F.col("route") == "article", X.key0(rows.argument)).when(F.col("route") == "random", F.lit(_DRAWN))
    rows = rows.join(known, (F.col("lang") == F.col("__lang")) & (key == F.col("__key")), "left")
    image = F.when(F.col("route") == "image", X.svg_key("argument"))
    rows = _optional(rows, images, [("lang", F.col("lang")), ("file_key", image)], "own_image")
    rows = _optional(rows, images, [("lang", F.lit(COMMONS)), ("file_key", image)], "shared_image")
    where = F.when(F.col("argument") == "testpage.txt", F.lit("/testpage.txt")).otherwise(F.regexp_replace("file", "/+$", ""))
    rows = _optional(rows, files, [("path", where)], "exists", ("is_dir",))
    rows = _optional(rows, files, [("path", F.concat(F.regexp_replace("file", "/+$", ""), F.lit("/index.html")))], "has_index")
    at = drawing(seed, *(F.col(c).cast("string") for c in requests.columns)) % F.size("spellings") + 1
    drawn = (F.col("route") == "random") & (F.size("spellings") > 0)
    rows = rows.withColumn("drawn", F.when(drawn, F.element_at("spellings", at.cast("int"))))

    hits = F.coalesce("spellings", F.array().cast("array<string>"))
    exact, n = F.array_contains(hits, F.col("argument")), F.size(hits)
    route, lang = F.col("route"), F.col("lang")
    has = lambda c: F.contains(F.lit(",".join(languages)), c) if compat else (c.isin(*languages) if languages else F.lit(False))
    indexed = lang.isin(*languages) if languages else F.lit(False)
    mains = F.create_map(*[F.lit(v) for item in (main_pages or {"": ""}).items() for v in item])
    main = F.try_element_at(mains, lang)
    article, test = route == "article", (route == "article") & (F.col("argument") == "testpage.txt")
    help_page = (lang == HELP) & (F.col("argument") == "Article not found")
    directory, slash = F.coalesce("is_dir", F.lit(False)), F.endswith("path", F.lit("/"))
    error = (
        F.when(route == "unsupported", "method")
        .when(article & ~has(lang), F.when(lang == HELP, "language"))
        .when(test, F.when(~F.col("exists"), "access"))
        .when(article & (n == 0) & help_page, "article")
        .when((route == "search") & (F.col("argument") == ""), "phrase")
        .when((route == "search") & ~indexed, "index")
        .when((route == "image") & ~(F.col("own_image") | F.col("shared_image") | F.col("exists")), "file")
        .when(route == "ajax", "command")
        .when((route == "static") & ~F.col("exists"), "file")
        .when((route == "static") & directory & ~slash & ~F.col("has_index"), "slash")
        .when((route == "static") & directory & slash & ~F.col("has_index"), "listing")
    )
    rows = rows.withColumn("error", error)
    location = (
        F.when(F.col("error") == "slash", F.concat("path", F.lit("/")))
        .when(F.col("error").isNotNull(), F.lit(None).cast("string"))
        .when(route == "article_default", F.concat(F.lit(f"/wiki/{default}/"), F.col("argument")))
        .when(route == "article_colon", F.concat(F.lit("/wiki/"), lang, F.lit("/"), F.col("argument")))
        .when(route == "main", F.coalesce(F.concat(F.lit("/wiki/"), lang, F.lit("/"), F.nullif(main, F.lit(""))), F.lit(NOT_FOUND)))
        .when(route == "random", F.when(~indexed, NOT_INSTALLED).when(F.col("drawn").isNull(), NOT_FOUND).otherwise(
            F.concat(F.lit("/wiki/"), lang, F.lit(":"), X.url_encode("drawn"))))
        .when(article & ~has(lang), F.lit(NOT_INSTALLED))
        .when(article & ~test & (n == 0), F.lit(NOT_FOUND))
        .when(article & ~test & (n == 1) & ~exact, F.concat(F.lit("/wiki/"), lang, F.lit(":"), hits[0]))
        .when((route == "static") & directory & ~slash, F.concat("path", F.lit("/index.html")))
    )
    rows = rows.withColumn("location", location)
    codes = F.create_map(*[F.lit(v) for name, (code, *_) in ERRORS.items() for v in (name, code)])
    status = F.coalesce(F.try_element_at(codes, F.col("error")), F.when(F.col("location").isNotNull(), 301).otherwise(200))
    shown = article & ~test & (status == 200)
    file = F.when((status == 200) & (route == "static"), F.when(directory, F.concat(F.col("path"), F.lit("index.html"))).otherwise(F.col("path")))
    file = F.when((status == 200) & (route == "image") & ~F.col("own_image") & ~F.col("shared_image"), F.col("file")).otherwise(file)
    file = F.when(test & (status == 200), F.lit("/testpage.txt")).otherwise(file)
    return rows.select(
        *requests.columns, "route", "lang", "argument", F.when(shown & exact, F.col("argument")).alias("title"),
        F.when(shown & ~exact, hits).alias("choices"), status.alias("status"), "location", "error", file.alias("file"),
        F.when(route == "image", F.when(F.col("own_image"), lang).when(F.col("shared_image"), F.lit(COMMONS))).alias("image_lang"),
        F.when(route == "image", X.svg_key("argument")).alias("image_key"),
    )


def error_body(status: Column, reason: Column, text: Column) -> Column:
    # The page's markup.
    end = F.lit("\r\n")
    head = [F.lit("<HTML><HEAD><TITLE>"), status.cast("string"), F.lit(" "), reason, F.lit("</TITLE></HEAD>"), end]
    body = [F.lit("<BODY><H4>"), status.cast("string"), F.lit(" "), reason, F.lit("</H4>"), end, text, end, F.lit("</BODY></HTML>"), end]
    return F.concat(*head, *body)


def redirect_body(location: Column) -> Column:
    # The line's markup.
    return F.concat(F.lit('<Please follow <a href="'), location, F.lit('">'), location, F.lit("</a>\r\n"))


def header_lines(status: Column, reason: Column, at: Column, mime: Column, length: Column, location: Column, server: str = "codexlake/1.0") -> Column:
    """The response's head: status line, server, date, location, type and length where there are any, and the end of the connection."""
    from ..functions.dates import http_date

    # Names of the fields.
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name), value.cast("string"), F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), reason, F.lit(f"\r\nServer: {server}\r\nDate: "), http_date(at), F.lit("\r\n"),
        line("Location: ", location), line("Content-Type: ", mime), line("Content-Length: ", length), F.lit("Connection: close\r\n\r\n"),
    )


def suggestion_pages(titles: DataFrame, phrases: DataFrame, k: int = SUGGESTIONS, order: tuple[str, ...] = ("key1", "title"),
                     compat: bool = True) -> DataFrame:
    """(lang, phrase, suggestions): the newline-joined titles that each phrase (lang, phrase) gets, many phrases at once.

    A title meets a phrase through the phrase's length and the key's prefix of that length. With ``compat`` the
    last title of a language is never offered, and a blank line at the end (there is more) looks one title further.
    """
    asked = phrases.select("lang", "phrase", X.key1("phrase", "lang").alias("__p")).where("length(__p) > 0").distinct()
    lengths = asked.groupBy("lang").agg(F.collect_set(F.length("__p")).alias("__lengths"))
    keyed = titles.join(lengths, "lang").select(*titles.columns, F.explode("__lengths").alias("__n"))
    keyed = keyed.where(F.length("key1") >= F.col("__n")).withColumn("__p", F.expr("left(key1, __n)"))
    last = titles.groupBy("lang").agg(F.max(F.struct(*order)).alias("__last"))
    hits = keyed.join(asked, ["lang", "__p"]).join(last, "lang")
    hits = hits.withColumn("__end", F.struct(*order) == F.col("__last")) if compat else hits.withColumn("__end", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("lang", "phrase").orderBy(*order))
    page = hits.withColumn("__r", rank).where(F.col("__r") <= k + 2)
    listed = page.groupBy("lang", "phrase").agg(F.sort_array(F.collect_list(F.struct("__r", "title", "__end"))).alias("rs"))
    shown = F.slice(F.transform(F.filter("rs", lambda r: ~r["__end"]), lambda r: r["title"]), 1, k)
    more = (F.size(shown) == k) & (F.size("rs") > k + (1 if compat else 0))
    return listed.select("lang", "phrase", F.concat(F.array_join(shown, "\n"), F.when(more, "\n").otherwise("")).alias("suggestions"))


def serve(requests: DataFrame, titles: DataFrame, languages: list[str], default: str, names: dict[str, str] | None = None,
          pages: DataFrame | None = None, images: DataFrame | None = None, files: DataFrame | None = None, compat: bool = True,
          **more) -> DataFrame:
    """``respond`` and the answers' contents: (…, reason, mime, body, data).

    ``pages`` has (lang, title, page) of whole pages (an empty page counts as not found), ``images`` also ``data``,
    ``files`` also ``data``; bodies of text are in ``body``, bytes of images and files in ``data``. ``names`` has the
    languages' names. For streams use it on each batch.
    """
    rows = respond(requests, titles, languages, default, files=files, images=images, compat=compat, **more)
    phrases = rows.where("route = 'search' and error is null").select("lang", F.col("argument").alias("phrase")).distinct()
    found = suggestion_pages(titles, phrases, compat=compat).select(F.lit("search").alias("route"), "lang", F.col("phrase").alias("argument"), "suggestions")
    rows = rows.join(found, ["route", "lang", "argument"], "left")
    if pages is not None:
        whole = pages.select(F.col("lang").alias("__l"), F.col("title").alias("__t"), F.col("page"))
        rows = rows.join(whole, (rows.lang == F.col("__l")) & (rows.title == F.col("__t")), "left").drop("__l", "__t")
        lost = F.col("title").isNotNull() & (F.coalesce("page", F.lit("")) == "")
        helped = (F.col("lang") == HELP) & (F.col("argument") == "Article not found")
        rows = rows.withColumn("error", F.when(lost & helped, F.lit("article")).otherwise(F.col("error")))
        rows = rows.withColumn("location", F.when(lost & ~helped, F.lit(NOT_FOUND)).otherwise(F.col("location")))
        rows = rows.withColumn("status", F.when(lost, F.when(helped, 404).otherwise(301)).otherwise(F.col("status")))
    else:
        rows = rows.withColumn("page", F.lit(None).cast("string"))
    rows = _bytes(rows, images, ["lang", "file_key"], ["image_lang", "image_key"], "__image")
    rows = _bytes(rows, files, ["path"], ["file"], "__file")
    from ..markup.pages import result_list

    reasons = F.create_map(*[F.lit(v) for name, (_, reason, _) in ERRORS.items() for v in (name, reason)])
    texts = F.create_map(*[F.lit(v) for name, (_, _, text) in ERRORS.items() for v in (name, text)])
    failed, status = F.col("error").isNotNull(), F.col("status")
    reason = F.when(failed, F.try_element_at(reasons, F.col("error"))).when(status == 301, "moved permanently").otherwise("OK")
    listing = installed(languages, default, names)
    body = (
        F.when(failed, error_body(status, reason, F.try_element_at(texts, F.col("error"))))
        .when(status == 301, redirect_body(F.col("location")))
        .when(F.col("choices").isNotNull(), result_list(F.col("choices")))
        .when(F.col("title").isNotNull(), F.col("page"))
        .when(F.col("route") == "search", F.coalesce("suggestions", F.lit("")))
        .when(F.col("route") == "languages", F.lit(listing))
    )
    mime = F.when(failed | (status == 301), "text/html").when(F.col("route").isin("image", "static"), X.mime_type(F.coalesce("file", "image_key"))).otherwise(HTML)
    data = F.when(status == 200, F.coalesce("__image", "__file"))
    kept = [c for c in rows.columns if c not in ("suggestions", "page", "__image", "__file")]
    return rows.select(*kept, reason.alias("reason"), mime.alias("mime"), body.alias("body"), data.alias("data"))


def _bytes(rows: DataFrame, table: DataFrame | None, keys: list[str], wanted: list[str], into: str) -> DataFrame:
    if table is None or "data" not in table.columns:
        return rows.withColumn(into, F.lit(None).cast("binary"))
    right = table.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("data").alias(into)).dropDuplicates([f"__k{i}" for i in range(len(keys))])
    on = F.col(wanted[0]) == F.col("__k0")
    for i in range(1, len(keys)):
        on = on & (F.col(wanted[i]) == F.col(f"__k{i}"))
    return rows.join(right, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def installed(languages: list[str], default: str, names: dict[str, str] | None = None) -> str:
    """``code:name`` lines of the installed languages, the default first, the help's left out; a name falls back to its code."""
    names = names or {}
    codes = [default, *(c for c in languages if c not in (default, HELP))]
    return "\n".join(f"{c}:{names.get(c) or c}" for c in codes)


def split_listing(listing: Column) -> Column:
    """The client's view of such a list: an array of (code, name)."""
    lines = F.filter(F.split(listing, "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("code"), F.regexp_replace(x, "(?s)^[^:]*:?", "").alias("name")))


def language_list(languages: DataFrame, default: str) -> DataFrame:
    """One row (listing): ``code:name`` lines, the default first, the built-in help left out."""
    rows = languages.where(F.col("lang") != "xx").select((F.col("lang") != default).alias("o"), "lang", F.concat_ws(":", "lang", "name").alias("l"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("o", "lang", "l"))), lambda r: r["l"]), "\n").alias("listing"))
