"""Macro, rendering, assembly and request queries; the wikitext is built from columns, and SQL builds the expected result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as X
from ..markup.context import Context
from ..markup import pages as P
from ..markup.pages import assemble, expand_column, render_column, result_list, template_text_column
from ..operators import routes as R
from ..operators.extract import template_arguments
from ..operators.routes import respond
from .base import PG, key1_sql, pg, q, table, upper_sql

L, C = F.lit, F.concat


def _parts(spark, d):
    return table(spark, d, "part")


def _expand(text, templates=None, **more):
    context = Context(expand=True, templates=templates or {}, **more)
    return lambda spark, d: _parts(spark, d).select("p_partkey", expand_column(text(), context).alias("expanded"))


def _render(text, **more):
    context = Context(**more)
    return lambda spark, d: _parts(spark, d).select("p_partkey", render_column(text(), context).alias("html"))


TEMPLATES = {
    "template:two": "{{{1}}}+{{{2|none}}}", "template:named": "<{{{brand}}}|{{{type|?}}}>", "template:outer": "[{{two|{{{1}}}}}]",
}
MACROS = {
    "param_bind": _expand(lambda: C(L("{{named|type="), "p_type", L("|brand="), "p_brand", L("}}")), TEMPLATES),
    "param_subst": _expand(lambda: C(L("{{two|"), "p_name", L("}}")), TEMPLATES),
    "switch_eval": _expand(lambda: C(L("{{#switch:"), F.expr("string(p_size % 4)"), L("|0=zero|1|2=some|#default=many}}"))),
    "if_eval": _expand(lambda: C(L("{{#if:"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), L("|big|small}}"))),
    "ifeq_eval": _expand(lambda: C(L("{{#ifeq: "), "p_brand", L(" |"), L("Brand#1"), L("| same | "), "p_name", L(" }}"))),
    "ifneq_compat": _expand(lambda: C(L("{{#ifneq:"), "p_brand", L("|Brand#1|x|y}}"))),
    "template_expand_synth": _expand(lambda: C("p_name", L(" {{outer|"), "p_brand", L("}} <nowiki>{{x}}</nowiki>{{Nope}}")), TEMPLATES),
    "templates_off": lambda spark, d: _parts(spark, d).select(
        "p_partkey", expand_column(C("p_name", L("{{x|{{y}}}}"), "p_brand"), Context()).alias("expanded")
    ),
    "string_macros": _expand(lambda: C(L("{{uc:"), "p_name", L("}}{{lcfirst:"), "p_type", L("}}{{formatnum:"), F.expr("string(p_partkey)"), L("}}{{!}}{{PAGENAME}}")), page="P/q"),
}


SINGLE = {
    "ifexist_titles": _expand(lambda: C(L("{{#ifexist:"), "p_brand", L("|no|yes}}{{#ifexist: "), "p_type", L("|n|y}}")), titles=frozenset({"brand#1", "brand#2", "economy"})),
    "ifexpr_compat": _expand(lambda: C(L("{{#ifexpr:"), F.expr("string(p_size)"), L(" > 5|big|"), "p_name", L("}}{{#ifexpr:1}}"))),
    "expr_compat": _expand(lambda: C(L("{{#expr:"), F.expr("string(p_size)"), L("+1}}{{#expr:1|}}"), "p_name")),
    "expr_intended": _expand(lambda: C(L("{{#expr:("), F.expr("string(p_size)"), L("+1)*2 mod 7}} {{#ifexpr:"), F.expr("string(p_size)"), L(" > 25 or 0|big|small}}")), compat=False),
    "function_unknown": _expand(lambda: C(L("{{#time:"), "p_brand", L("|x}}{{#x}}"))),
    "table_template": _expand(lambda: C("p_name", L("{{box|"), "p_brand", L("}}")), {"template:box": "{| {{{1}}}\n|}"}),
    "template_prefix": _expand(lambda: C(L("{{Nope}}{{T:"), "p_brand", L("}}{{"), "p_type", L("}}")), {"vorlage:economy": "eco", "vorlage:small": "sm"}, template_namespace="Vorlage"),
    "template_prefix_config": _expand(lambda: C(L("{{_a_b}}{{:"), "p_type", L("}}")), {"economy": "main {{{1|?}}}"}, config={"templatePrefix": "Modell:"}),
    "namespace_names": _expand(lambda: C(L("{{ns:"), F.expr("string(p_size % 17)"), L("}}"))),
    "local_urls": _expand(lambda: C(L("{{localurl:"), "p_brand", L("}} {{fullurl:"), "p_type", L("}} {{#language:"), "p_type", L("}}")), lang="de"),
    "encode_macros": _expand(lambda: C(L("{{urlencode:"), "p_brand", L(" é}}{{anchorencode:x}}{{anchorencode:"), "p_type", L("}}"))),
    "pad_macros": _expand(lambda: C(L("{{padleft:"), "p_brand", L("|9}}{{padright:"), "p_type", L("}}{{convert|"), F.expr("string(p_size)"), L("|km}}{{Dmoz|x}}"))),
    "case_macros": _expand(lambda: C(L("{{lc:"), "p_type", L("}}{{ucfirst:"), "p_name", L("}}"))),
    "talk_names": _expand(lambda: C("p_brand", *(L("{{" + x + "}}") for x in ("TALKSPACE", "SUBJECTSPACE", "ARTICLESPACE", "TALKPAGENAME", "SUBJECTPAGENAMEE", "ARTICLEPAGENAMEE")))),
    "page_variables": _expand(lambda: C(L("{{PAGENAMEE}} {{SUBPAGENAME}} {{BASEPAGENAME}} {{NAMESPACE}} {{FULLPAGENAME}}"), "p_name"), page="A/B c/D", lang="fr"),
    "revision_constants": _expand(lambda: C("p_brand", *(L(" {{REVISION" + x + "}}") for x in ("ID", "DAY", "DAY2", "MONTH", "YEAR", "TIMESTAMP")))),
    "site_constants": _expand(lambda: C("p_brand", *(L(" {{" + x + "}}") for x in ("SITENAME", "SERVER", "SERVERNAME", "SCRIPTPATH", "/scripts", "CURRENTVERSION")))),
    "statistics": _expand(lambda: C("p_brand", *(L(" {{" + x + "}}") for x in ("NUMBEROFARTICLES", "NUMBEROFEDITS", "NUMBEROFPAGES", "NUMBEROFFILES", "NUMBEROFUSERS", "NUMBEROFADMINS", "PAGESINNAMESPACE", "PAGESINNS:4"))), n_articles=12),
    "empty_variables": _expand(lambda: C(L("{{DISPLAYTITLE:x}}{{DIRMARK}}{{DIRECTIONMARK}}{{DEFAULTSORT:"), "p_name", L("}}{{CONTENTLANGUAGE}}{{reflist}}")), lang="es"),
    "ignored_templates": _expand(lambda: C("p_name", L("{{commons}}{{Commons|"), "p_brand", L("}}")), {"template:commons": "never"}),
    "template_builtin": _expand(lambda: C(L("{{tl|"), "p_brand", L("}}")), {"template:tl": "never"}),
    "nested_brackets": _expand(lambda: C(L("{{two|[["), "p_brand", L("|x]]|{{two|"), "p_type", L("|[a|b]}}}}")), TEMPLATES),
    "clock_names": _expand(lambda: C(L("{{CURRENTDAYNAME}} {{LOCALMONTHABBREV}} {{CURRENTMONTHNAMEGEN}} {{CURRENTTIMESTAMP}}"), "p_brand"), config={"Monday": "Montag", "January": "Januar"},
                           now=datetime(2024, 1, 1, 2, 3, 4)),
}


def language_installed(spark, d):
    """Codes that count as installed: with ``compat`` also what crosses a comma."""
    code = F.element_at(F.array(*map(L, ("en", "n,", "zz", "de"))), (F.col("p_size") % 4 + 1).cast("int"))
    rows = _parts(spark, d).select("p_partkey", C(L("GET /wiki/"), code, L("/"), X.url_encode("p_name"), L(" HTTP/1.1")).alias("line"))
    titles = _parts(spark, d).select(L("en").alias("lang"), F.col("p_name").alias("title"), X.key0("p_name").alias("key0"))
    got = respond(rows, titles, ["en", "de"], "en")
    return got.select("p_partkey", "status", F.coalesce(F.col("location") == R.NOT_INSTALLED, L(False)).alias("refused"))


def argument_positions(spark, d):
    """The arguments of each call, numbered."""
    body = C(L("{{two|"), "p_name", L("|[["), "p_brand", L("|x]]}} {{named|a="), "p_type", L("|b=2}}"))
    return template_arguments(_parts(spark, d).select(F.col("p_partkey").alias("title"), body.alias("body")))


def _library(spark, d):
    """A page for each part that calls the template of its type; types call their brands, one of them over a redirect."""
    part = _parts(spark, d)
    page = part.select(L("en").alias("lang"), F.expr("string(p_partkey)").alias("title"),
                       C(L("{{"), "p_type", L("|"), "p_brand", L("}}{{#ifexist:"), "p_brand", L("|no|yes}}{{Gone}}")).alias("body"))
    types = part.select("p_type").distinct().select(L("en").alias("lang"), C(L("Template:"), F.initcap("p_type")).alias("title"),
                                                    C(L("<noinclude>doc</noinclude>["), "p_type", L("{{inner|{{{1}}}}}]")).alias("body"))
    other = spark.createDataFrame([("en", "Template:Inner", "#REDIRECT [[Template:Real_inner]]"), ("en", "Template:Real inner", "({{{1}}})"), ("en", "Brand#7", "b")],
                                  "lang string, title string, body string")
    return page, types.unionByName(other)


def template_join(spark, d):
    """Templates and titles looked up in tables, round by round."""
    page, articles = _library(spark, d)
    titles = articles.select("lang", X.key0("title").alias("key0"))
    done = P.expand_pages(page, P.template_table(articles), titles, Context(expand=True))
    return done.select(F.expr("int(title)").alias("p_partkey"), "expanded")


def article_pages(spark, d):
    """Every page of a language as an article: its title's first letters redirect to it, and it is put together."""
    rows = pg(spark, d).where("lang <> ''").groupBy("lang", "key0").agg(F.min("title").alias("title"))
    articles = rows.select("lang", "title", C(L("'''"), "lang", L("'''")).alias("body")).unionByName(
        rows.select("lang", C(L("To "), "title").alias("title"), C(L("#REDIRECT [["), "title", L("]]")).alias("body")))
    asked = articles.select("lang", "title")
    return P.get_articles(asked, articles, Context(languages=("en", "fr", "de", "es")), pre="<%ArticleTitle%|%RedirectedFrom%>", post="!")


def noinclude_strip(spark, d):
    body = C(L("a<noinclude>"), "p_name", L("</noinclude><b>"), "p_brand", L("</b><includeonly>"), "p_type", L("</includeonly>"))
    return _parts(spark, d).select("p_partkey", template_text_column(body).alias("text"))


def onlyinclude_strip(spark, d):
    body = C(L("a<onlyinclude>"), "p_name", L("</onlyinclude>b"))
    return _parts(spark, d).select("p_partkey", template_text_column(body).alias("text"))


RENDERS = {
    "render_bold_italic": _render(lambda: C(L("''"), "p_brand", L("'' and '''"), "p_type", L("'''\n\n"), "p_name")),
    "render_links": _render(lambda: C(L("[["), "p_brand", L("]]s [["), "p_type", L("|see]] [http://x.org/"), F.expr("string(p_partkey)"), L(" home] [http://y.org] [[Foo: bar]]"))),
    "render_list": _render(lambda: C(L("* "), "p_name", L("\n** "), "p_brand", L("\n# "), "p_type", L("\n\n"))),
    "render_table": _render(lambda: C(L("{| border\n|-\n| "), "p_name", L(" || "), "p_brand", L("\n|}"))),
    "render_heading": _render(lambda: C(L("== "), "p_name", L(" ==\n"), "p_brand")),
    "render_refs": _render(lambda: C("p_brand", L("<ref>"), "p_name", L("</ref><references />"))),
    "render_definitions": _render(lambda: C(L("; "), "p_brand", L(" : "), "p_name", L("\n\nx"))),
    "render_nowiki": _render(lambda: C(L("<nowiki>''"), "p_brand", L("''</nowiki><source>"), L("a b</source><code>"), "p_name", L("</code>"))),
    "render_categories": _render(lambda: C("p_name", L("[[Category:"), "p_brand", L("]][[Category:"), "p_type", L("]]"))),
    "render_image": _render(lambda: C(L("[[Image:"), "p_brand", L(".png|thumb|left|200px|"), "p_name", L("]]")), images=True),
    "render_glue": _render(lambda: C(L("  "), "p_name", L("\n "), "p_brand", L("\nend"))),
    "render_bang": _render(lambda: C(L("{|\n|-\n| "), "p_name", L("!\n|}"))),
    "render_tags": _render(lambda: C(L("<b class=x>"), "p_name", L("</b> 1 < 2 <br /> "), "p_brand")),
    "render_imagemap": _render(lambda: C("p_name", L("<imagemap>x y</imagemap>"), "p_brand")),
    "render_switches": _render(lambda: C(L("__NOTOC____NOEDITSECTION__"), "p_name", L(" __ "), "p_brand")),
    "render_toc": _render(lambda: C(*[x for i in "1234" for x in (L(f"== h{i} =="), L("\n"))], "p_name")),
}


def page_assemble(spark, d):
    """The built-in frame; pages of one language count as redirected from it."""
    origin = F.when(F.col("lang") == "fr", F.col("lang")).otherwise("")
    return pg(spark, d).select("page_id", assemble(F.col("title"), F.col("url"), origin).alias("page"))


def page_assemble_own(spark, d):
    """An installation's own frame; values that hold a placeholder stay as they are."""
    title = C(F.col("title"), L("%RedirectedFrom%"))
    return pg(spark, d).select("page_id", assemble(title, F.col("url"), F.col("lang"), "<%ArticleTitle%>%RedirectedFrom%|%ArticleTitle%", "end").alias("page"))


def search_result_page(spark, d):
    rows = pg(spark, d).groupBy("lang", "key0").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    return rows.select("lang", "key0", result_list(F.col("titles")).alias("page"))


def render_documents(spark, d):
    """Every whole document as wikitext: sizes of the rendered pages."""
    html = render_column(F.col("text"), Context(languages=("en", "fr", "de", "es", "xx")))
    return table(spark, d, "documents").select("doc_id", F.length(html).alias("n_html"))


def _requests(spark, d):
    """One request line of each kind for every page, in turn."""
    line = (
        F.when(F.col("page_id") % 8 == 0, C(L("GET /wiki/"), "lang", L("/"), X.url_encode("title"), L(" HTTP/1.1")))
        .when(F.col("page_id") % 8 == 1, C(L("GET /wiki/"), "lang", L("/"), X.url_encode(X.to_upper("title")), L(" HTTP/1.1")))
        .when(F.col("page_id") % 8 == 2, C(L("GET /wiki/No"), F.expr("string(page_id)"), L(" HTTP/1.1")))
        .when(F.col("page_id") % 8 == 3, C(L("GET /wiki/"), "lang", L("/No"), F.expr("string(page_id)"), L(" HTTP/1.1")))
        .when(F.col("page_id") % 8 == 4, C(L("GET /wiki/zz/"), X.url_encode("title"), L(" HTTP/1.1")))
        .when(F.col("page_id") % 8 == 5, C(L("GET /ajax/search:"), "lang", L(":"), X.url_encode(F.expr("left(title, 2)")), L(" HTTP/1.1")))
        .when(F.col("page_id") % 8 == 6, L("POST / HTTP/1.1"))
        .otherwise(L("broken"))
    )
    return pg(spark, d).where("lang <> ''").select("page_id", line.alias("line"))


def route_requests(spark, d):
    rows = respond(_requests(spark, d), pg(spark, d), ["en", "fr", "de", "es"], "en")
    return rows.select("page_id", "route", "status", "location", "title")


def _pictures(spark, d):
    """Images of the parts' brands: odd sizes in the language's own archive, some in the shared one, drawings under their rendered name."""
    rows = _parts(spark, d).select(F.when(F.col("p_size") < 20, "en").when(F.col("p_size") < 30, "xc").otherwise("de").alias("lang"),
                                   X.svg_key(C(F.col("p_brand"), L("_"), F.expr("string(p_size)"), L(".svg"))).alias("file_key")).distinct()
    return rows.withColumn("data", F.encode("file_key", "UTF-8"))


def serve_images(spark, d):
    """Image requests of one language: found in its own archive, in the shared one, or not at all."""
    line = C(L("GET /wiki/en/Image:"), X.url_encode("p_brand"), L("%20"), F.expr("string(p_size)"), L(".SVG HTTP/1.1"))
    rows = _parts(spark, d).select("p_partkey", line.alias("line"))
    titles = pg(spark, d)
    got = R.serve(rows, titles, ["en", "de"], "en", images=_pictures(spark, d))
    return got.select("p_partkey", "status", "image_lang", "mime", F.decode("data", "UTF-8").alias("data"), F.length("body").alias("n_body"))


def serve_search(spark, d):
    """Searches for the beginnings of titles, in the language of the page or, for one language, without a code."""
    code = F.when(F.col("lang") == "en", "").otherwise(C(F.col("lang"), L(":")))
    rows = pg(spark, d).where("lang <> ''").select("page_id", C(L("GET /ajax/search:"), code, X.url_encode(F.expr("left(title, 2)")), L(" HTTP/1.1")).alias("line"))
    got = R.serve(rows, pg(spark, d), ["en", "de", "es"], "en")
    return got.select("page_id", "status", "reason", F.when(F.col("status") == 200, F.col("body")).alias("body"))


def serve_random(spark, d):
    """Random titles by language: where each request is sent."""
    rows = pg(spark, d).where("lang <> ''").select("page_id", C(L("GET /ajax/RedirectToRandomArticle"), "lang", L(" HTTP/1.1")).alias("line"))
    got = respond(rows, pg(spark, d), ["en", "de", "es"], "en", seed=7)
    return got.select("page_id", "status", "location")


def _tree(spark):
    rows = [("/a.css", False), ("/help", True), ("/help/index.html", False), ("/deep", True), ("/deep/x.mp4", False), ("/Images/i.gif", False)]
    return spark.createDataFrame(rows, "path string, is_dir boolean")


def serve_files(spark, d):
    """Files, folders with and without an index page, and what is not there."""
    path = F.element_at(F.array(*map(L, ("/a.css", "/help", "/help/", "/deep", "/deep/", "/deep/x.mp4", "/none", "/wiki/en/Image:i.gif"))), (F.col("p_size") % 8 + 1).cast("int"))
    rows = _parts(spark, d).select("p_partkey", C(L("GET "), path, L(" HTTP/1.1")).alias("line"))
    got = R.serve(rows, pg(spark, d), ["en"], "en", files=_tree(spark))
    return got.select("p_partkey", "status", "location", "file", "mime", "body")


def serve_errors(spark, d):
    """Each kind of refusal, and the list of languages."""
    lines = ("PUT / HTTP/1.1", "GET /wiki/xx/Article%20not%20found HTTP/1.1", "GET /ajax/x HTTP/1.1", "GET /ajax/search: HTTP/1.1", "GET /ajax/search:zz:a HTTP/1.1",
             "GET /wiki/en/ HTTP/1.1", "GET /wiki/de/ HTTP/1.1", "GET /ajax/GetInstalledLanguages HTTP/1.1", "GET /wiki/en/testpage.txt HTTP/1.1")
    line = F.element_at(F.array(*map(L, lines)), (F.col("p_size") % 9 + 1).cast("int"))
    got = R.serve(_parts(spark, d).select("p_partkey", line.alias("line")), pg(spark, d), ["de", "en", "xx"], "en", names={"en": "English"}, main_pages={"en": "Main"})
    return got.select("p_partkey", "status", "reason", "location", "body")


def response_heads(spark, d):
    """Heads of responses at the events' times."""
    found = F.col("user_id") % 3 != 0
    head = R.header_lines(F.when(found, 200).otherwise(404), F.when(found, "OK").otherwise("Not Found"), F.col("ts"), L("text/html"),
                          F.when(found, F.col("user_id")), F.when(F.col("event_id") % 5 == 0, L("/wiki/en/x")))
    return table(spark, d, "events").select("event_id", head.alias("head"))


QUERIES = MACROS | SINGLE | RENDERS | {f.__name__: f for f in (
    noinclude_strip, onlyinclude_strip, page_assemble, page_assemble_own, search_result_page, render_documents, route_requests, language_installed,
    argument_positions, template_join, article_pages, serve_images, serve_search, serve_random, serve_files, serve_errors,
    response_heads,
)}

_END = "chr(13) || chr(10)"


def _sql(column: str):
    return lambda expression: f"SELECT p_partkey, {expression} AS {column} FROM part"


# The HTML and the class names, misspelt ones too, that rendered pages have.
_E, _T, _H = _sql("expanded"), _sql("text"), _sql("html")
_LINK = "'<a href=\"' || {t} || '\" class=\"wkInternalLink\">' || {l} || '</a>'"


def _li(n: int, ordered: bool = False) -> str:
    k = "Ordered" if ordered else "Unordered"
    return f'<li class="wk{k}ListItem wk{k}ListItem{n}">'


_UL = '<ul class="wkUnorderedList">'
_FIRST_UP = "lower(left(p_type, 1)) || substr(p_type, 2)"
_TOC = "".join(f'<a href="#h{i}"><span class="toctext"><li class="toclevel-1">h{i}</span></a></li>\r\n' for i in "1234")
_TOC_HEAD = '<p><table id="toc" class="toc" summary="Contents">\r\n<tr><td><div id="toctitle"><h2>Contents</h2></div>\r\n<ul>\r\n'
_HEADS = "".join(f'<a name="h{i}"></a><H2 class="wkHeadline wkHeadline2">h{i}\r\n</H2>' for i in "1234")


def _lit(text: str) -> str:
    """A SQL expression for text with line ends."""
    return "'" + text.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


def _error(status: int, reason: str, text: str) -> str:
    page = f"<HTML><HEAD><TITLE>{status} {reason}</TITLE></HEAD>\r\n<BODY><H4>{status} {reason}</H4>\r\n{text}\r\n</BODY></HTML>\r\n"
    return "(" + _lit(page) + ")"


def _escape_sql(x: str) -> str:
    """Blank, < > " # % and all bytes above 7F, percent-encoded."""
    for plain, escaped in X.URL_ESCAPES:
        x = f"replace({x}, {q(plain)}, {q(escaped)})"
    each = "regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g')"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN c > chr(127) THEN {each} ELSE c END), '')"


SQL = {
    "param_bind": _E("'<' || p_brand || '|' || p_type || '>'"),
    "param_subst": _E("p_name || '+none'"),
    "switch_eval": _E("CASE p_size % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'some' WHEN 2 THEN 'some' ELSE 'many' END"),
    "if_eval": _E("CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
    "ifeq_eval": _E("CASE WHEN p_brand = 'Brand#1' THEN 'same' ELSE p_name END"),
    "ifneq_compat": _E("'y'"),
    "template_expand_synth": _E("p_name || ' [' || p_brand || '+none] <nowiki>{{x}}</nowiki><span class=\"wkUnknownTemplate\">Template:Nope</span>'"),
    "templates_off": _E("p_name || p_brand"),
    "string_macros": _E(
        f"upper(p_name) || {_FIRST_UP} || (CASE WHEN p_partkey < 1000 THEN CAST(p_partkey AS VARCHAR) ELSE "
        "CAST(p_partkey // 1000 AS VARCHAR) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') END) || '|P/q'"
    ),
    "noinclude_strip": _T("'a<b>' || p_brand || '</b>' || p_type"),
    "onlyinclude_strip": _T("p_name"),
    "render_bold_italic": _H(f"'<i>' || p_brand || '</i> and <b>' || p_type || '</b><p />' || p_name || {_END}"),
    "render_links": _H(
        _LINK.format(t="p_brand", l="p_brand || 's'") + " || ' ' || " + _LINK.format(t="p_type", l=f"'see' || {_END}")
        + " || ' <a href=\"http://x.org/' || p_partkey || '\" class=\"wkExternalLink external\" target=\"_blank\">home</a>"
        + ' <a href="http://y.org" class="wkExternalLink external"  target="_blank">[1]</a> \' || ' + _END
    ),
    "render_list": _H(
        f"'{_UL}{_li(1)}' || p_name || '{_UL}{_li(2)}' || p_brand || '</li></ul></li></ul><ol class=\"wkOrrderedList\">{_li(1, True)}' || p_type || "
        f"'</li></ol><p />' || {_END}"
    ),
    "render_table": _H(
        f"'<table border>' || chr(10) || '<tr>' || chr(10) || '<td> ' || p_name || ' </td>' || chr(10) || '<td> ' || p_brand || '</td>' || chr(10) || "
        f"'</tr>' || chr(10) || '</table>' || chr(10) || {_END}"
    ),
    "render_heading": _H(
        f"'<a name=\"' || replace(p_name, ' ', '_') || '\"></a><H2 class=\"wkHeadline wkHeadline2\">' || p_name || {_END} || '</H2>' || p_brand || {_END}"
    ),
    "render_refs": _H(
        "p_brand || '<sup><a href=\"#_note-1\" class=\"wbReference\" name=\"_ref-1\">[1]</a></sup><ol class=\"wkReferenceList\"' || "
        f"{_END} || '<li class=\"wkReferenceListItem\"><a href=\"#_ref-1\" class=\"wkReferenceListAnchor\" name=\"_note-1\">&uarr;</a>&nbsp;' || p_name || "
        f"{_END} || '</li></ol>' || {_END} || {_END}"
    ),
    "render_definitions": _H(
        _lit('<dl class="wkDefintionList">\r\n<dt class="wkDefinitionListTitle"> ') + " || p_brand || "
        + _lit(' </dt>\r\n<dd class="wkDefinitionListEntry"> ') + " || p_name || " + _lit("</dd>\r\n</dl\r\n<p />x\r\n")
    ),
    "render_nowiki": _H(f"'''''' || p_brand || '''''a&nbsp;b<tt>' || p_name || '</tt>' || {_END}"),
    "render_categories": _H(f"p_name || '<p class=\"wkCategories\"> Categories: ' || p_brand || ' | ' || p_type || '</p>' || {_END}"),
    "render_image": _H(
        _lit('<div class="thumb tleft">\r\n<div class="thumbinner" style="padding: 2px;"><img alt="') + " || p_name || '\" src=\"./Image:' || p_brand || "
        + _lit('.png" width="200px" class="thumbborder" border="0" /><div class="thumbcaption" style="max-width:200px;">') + " || p_name || "
        + _lit("\r\n</div>\r\n</div>\r\n</div>\r\n\r\n")
    ),
    "render_toc": _H(_lit(_TOC_HEAD + _TOC + "</td></tr></table></p>" + _HEADS) + f" || p_name || {_END}"),
    "page_assemble": f"""
WITH {PG}, f AS (SELECT *, CASE WHEN lang = 'fr' THEN '<span class="wkRedirected">(Redirected from fr)</span>' || {_END} ELSE '' END AS note FROM pg)
SELECT page_id, replace(replace({_lit(P.HEAD)}, '%ArticleTitle%', title), '%RedirectedFrom%', note) || url || {_lit(P.FOOT)} AS page FROM f""",
    "page_assemble_own": f"""
WITH {PG} SELECT page_id, '<' || t || '>' || CASE WHEN lang = '' THEN '' ELSE '<span class="wkRedirected">(Redirected from ' || lang || ')</span>' || {_END} END
    || '|' || t || url || 'end' AS page FROM (SELECT *, title || '%RedirectedFrom%' AS t FROM pg)""",
    "search_result_page": f"""
WITH {PG}, t AS (SELECT DISTINCT lang, key0, title FROM pg)
SELECT lang, key0, {_lit(P.RESULTS_HEAD)} || string_agg(replace({_lit(P.RESULT)}, '%Title%', title), '' ORDER BY title) || {_lit(P.RESULTS_FOOT)} AS page
FROM t GROUP BY lang, key0""",
    "ifexist_titles": _E("CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'yes' ELSE 'no' END || CASE WHEN p_type = 'ECONOMY' THEN 'n' ELSE 'n' END"),
    "ifexpr_compat": _E("p_name"),
    "expr_compat": _E("'0' || p_name"),
    "expr_intended": _E("CAST((p_size + 1) * 2 % 7 AS VARCHAR) || ' ' || CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
    "function_unknown": _E("'USP:#time:' || p_brand || 'USP:#x'"),
    "table_template": _E("p_name || chr(10) || '{| ' || p_brand || chr(10) || '|}'"),
    "template_prefix": _E(
        "'<span class=\"wkUnknownTemplate\">Vorlage:Nope</span><span class=\"wkUnknownTemplate\">Vorlage:T:' || p_brand || '</span>' || "
        "CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'SMALL' THEN 'sm' ELSE '<span class=\"wkUnknownTemplate\">Vorlage:' || p_type || '</span>' END"
    ),
    "template_prefix_config": _E(
        "'<span class=\"wkUnknownTemplate\">Modell:_a_b</span>' || CASE p_type WHEN 'ECONOMY' THEN 'main ?' ELSE '<span class=\"wkUnknownTemplate\">Modell::' || p_type || '</span>' END"
    ),
    "namespace_names": _E(
        "coalesce((ARRAY['Talk', 'User', 'User_talk', 'Wikipedia', 'Wikipedia_talk', 'Image', 'Image_talk', 'MediaWiki', 'MediaWiki_talk', 'Template', 'Template_talk', "
        "'Help', 'Help_talk', 'Category', 'Category_talk'])[nullif(p_size % 17, 0)], '<span class=\"wkUnknownTemplate\">Template:ns:' || p_size % 17 || '</span>')"
    ),
    "local_urls": _E("'de/' || p_brand || ' http://127.0.0.1/wiki/de/' || p_type || ' ' || p_type"),
    "encode_macros": _E("replace(p_brand, '#', '%23') || ' %E9<span class=\"wkUnknownTemplate\">Template:anchorencode:x</span>' || p_type"),
    "pad_macros": _E("p_brand || '|9' || p_type || p_size || '|km'"),
    "case_macros": _E("lower(p_type) || upper(left(p_name, 1)) || substr(p_name, 2)"),
    "talk_names": _E("p_brand"),
    "page_variables": _E("'A/B c/D D A fr fr/A/B c/D' || p_name"),
    "revision_constants": _E("p_brand || ' 0 1 01 01 2007 20070101000000'"),
    "site_constants": _E("p_brand || ' Offline-Wikipedia http://127.0.0.1 127.0.0.1   0.60'"),
    "statistics": _E("p_brand || ' 12 1 1 1 1 1 1 1'"),
    "empty_variables": _E("'es<references />'"),
    "ignored_templates": _E("p_name"),
    "template_builtin": _E("'<span class=\"wkUnknownTemplate\">Template:[[Template:' || p_brand || '|' || p_brand || ']]</span>'"),
    "nested_brackets": _E("'[[' || p_brand || '|x]]+' || p_type || '+[a|b]'"),
    "clock_names": _E("'Montag Jan Januar 20240001020304' || p_brand"),
    "render_glue": _H(f"p_name || p_brand || 'end' || {_END}"),
    "render_bang": _H(f"'<table>' || chr(10) || '<tr>' || chr(10) || '<td> ' || p_name || '|</td>' || chr(10) || '</tr>' || chr(10) || '</table>' || chr(10) || {_END}"),
    "render_tags": _H(f"'<b class=x>' || p_name || '</b> 1 < 2 <br /> ' || p_brand || {_END}"),
    "render_imagemap": _H(f"p_name || p_brand || {_END}"),
    "render_switches": _H(f"p_name || ' _ ' || p_brand || {_END}"),
    "language_installed": """
SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN 200 ELSE 301 END AS INTEGER) AS status, p_size % 4 = 2 AS refused FROM part""",
    "argument_positions": """
SELECT p_partkey AS title, unnest([1, 1, 2, 2])::INTEGER AS call, unnest(['two', 'two', 'named', 'named']) AS template,
       unnest([1, 2, 1, 2])::INTEGER AS position, unnest(['', '', 'a', 'b']) AS name, unnest([p_name, '[[' || p_brand || '|x]]', p_type, '2']) AS value FROM part""",
    "template_join": """
SELECT CAST(p_partkey AS INTEGER) AS p_partkey, '[' || p_type || '(' || p_brand || ')]' || CASE WHEN p_brand = 'Brand#7' THEN 'yes' ELSE 'no' END
       || '<span class="wkUnknownTemplate">Template:Gone</span>' AS expanded FROM part""",
    "article_pages": f"""
WITH {PG}, r AS (SELECT lang, key0, min(title) AS title FROM pg WHERE lang <> '' GROUP BY ALL)
SELECT lang, title, title AS article_name, '<' || title || '|><b>' || lang || '</b>' || {_END} || '!' AS page FROM r UNION ALL
SELECT lang, 'To ' || title, title, '<' || title || '|<span class="wkRedirected">(Redirected from To ' || title || ')</span>' || {_END} || '><b>' || lang || '</b>' || {_END} || '!' FROM r""",
    "serve_images": f"""
WITH i AS (SELECT DISTINCT CASE WHEN p_size < 20 THEN 'en' WHEN p_size < 30 THEN 'xc' END AS lang, lower(p_brand) || '_' || p_size || '.svg.png' AS k FROM part WHERE p_size < 30),
x AS (SELECT p_partkey, lower(p_brand) || '_' || p_size || '.svg.png' AS k FROM part),
y AS (SELECT x.*, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.k = x.k AND i.lang = 'en') THEN 'en' WHEN EXISTS (SELECT 1 FROM i WHERE i.k = x.k AND i.lang = 'xc') THEN 'xc' END AS image_lang FROM x)
SELECT p_partkey, CAST(CASE WHEN image_lang IS NULL THEN 404 ELSE 200 END AS INTEGER) AS status, image_lang, CASE WHEN image_lang IS NULL THEN 'text/html' ELSE 'image/png' END AS mime,
       CASE WHEN image_lang IS NOT NULL THEN k END AS data, CAST(CASE WHEN image_lang IS NULL THEN length({_error(404, 'Not Found', 'File not found.')}) END AS INTEGER) AS n_body FROM y""",
    "serve_search": f"""
WITH {PG}, c AS (SELECT page_id, lang, {key1_sql('left(title, 2)')} AS p, left(title, 2) AS raw FROM pg WHERE lang <> ''),
x AS (SELECT *, key1 = max(key1) OVER (PARTITION BY lang) AND title = max(title) FILTER (WHERE TRUE) OVER (PARTITION BY lang, key1) AS final FROM pg),
a AS (SELECT DISTINCT lang, p, raw FROM c WHERE raw <> ''),
h AS (SELECT a.lang, a.raw, x.title, x.final, row_number() OVER (PARTITION BY a.lang, a.raw ORDER BY x.key1, x.title) AS r FROM a JOIN x ON x.lang = a.lang AND starts_with(x.key1, a.p)),
o AS (SELECT *, sum(CASE WHEN final THEN 0 ELSE 1 END) OVER (PARTITION BY lang, raw ORDER BY r) AS s FROM h WHERE r <= 27),
g AS (SELECT lang, raw, coalesce(string_agg(title, chr(10) ORDER BY r) FILTER (WHERE NOT final AND s <= 25), '') || CASE WHEN count(*) > 26 THEN chr(10) ELSE '' END AS body FROM o GROUP BY ALL)
SELECT c.page_id, CAST(CASE WHEN c.raw = '' OR c.lang = 'fr' THEN 404 ELSE 200 END AS INTEGER) AS status,
       CASE WHEN c.raw = '' THEN 'Nothing to search for or search string to short.' WHEN c.lang = 'fr' THEN 'No language code not installed' ELSE 'OK' END AS reason,
       CASE WHEN c.raw <> '' AND c.lang <> 'fr' THEN coalesce(g.body, '') END AS body
FROM c LEFT JOIN g ON g.lang = c.lang AND g.raw = c.raw""",
    "serve_random": f"""
WITH {PG}, n AS (SELECT lang, title, CAST('0x' || left(md5('7' || chr(31) || title), 8) AS BIGINT) AS h FROM pg WHERE NOT contains(title, ':')),
f AS (SELECT lang, h % 1024 AS slot, arg_min(title, struct_pack(h := h, t := title)) AS title FROM n GROUP BY ALL),
p AS (SELECT lang, list_sort(list_distinct(list(title))) AS drawn FROM f GROUP BY lang),
r AS (SELECT page_id, lang, CAST('0x' || left(md5('7' || chr(31) || page_id || chr(31) || 'GET /ajax/RedirectToRandomArticle' || lang || ' HTTP/1.1'), 8) AS BIGINT) AS h FROM pg WHERE lang <> ''),
t AS (SELECT r.page_id, r.lang, drawn[r.h % len(drawn) + 1] AS title FROM r LEFT JOIN p USING (lang)),
e AS (SELECT *, {_escape_sql('title')} AS escaped FROM t)
SELECT page_id, CAST(301 AS INTEGER) AS status, CASE WHEN lang NOT IN ('en', 'de', 'es') THEN '/wiki/xx/Language not installed'
       WHEN title IS NULL THEN '/wiki/xx/Article not found' ELSE '/wiki/' || lang || ':' || escaped END AS location FROM e""",
    "response_heads": f"""
SELECT event_id, 'HTTP/1.1 ' || CASE WHEN user_id % 3 <> 0 THEN '200 OK' ELSE '404 Not Found' END || {_END} || 'Server: codexlake/1.0' || {_END} || 'Date: ' ||
       strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' || {_END} || CASE WHEN event_id % 5 = 0 THEN 'Location: /wiki/en/x' || {_END} ELSE '' END ||
       'Content-Type: text/html' || {_END} || CASE WHEN user_id % 3 <> 0 THEN 'Content-Length: ' || user_id || {_END} ELSE '' END ||
       'Connection: close' || {_END} || {_END} AS head FROM events""",
    "serve_files": f"""
WITH k AS (SELECT p_partkey, p_size % 8 AS k FROM part)
SELECT p_partkey, CAST((ARRAY[200, 301, 200, 302, 403, 200, 404, 200])[k + 1] AS INTEGER) AS status, CASE k WHEN 1 THEN '/help/index.html' WHEN 3 THEN '/deep/' END AS location,
       CASE k WHEN 0 THEN '/a.css' WHEN 2 THEN '/help/index.html' WHEN 5 THEN '/deep/x.mp4' WHEN 7 THEN '/Images/i.gif' END AS file,
       CASE k WHEN 0 THEN 'text/css' WHEN 5 THEN 'video/mp4' WHEN 7 THEN 'image/gif' ELSE 'text/html' END AS mime,
       CASE k WHEN 1 THEN '<Please follow <a href="/help/index.html">/help/index.html</a>' || {_END} WHEN 3 THEN {_error(302, 'Found', 'Directories must end with a slash.')}
         WHEN 4 THEN {_error(403, 'Directory Listing Denied', 'This virtual directory does not allow contents to be listed.')}
         WHEN 6 THEN {_error(404, 'Not Found', 'File not found.')} END AS body FROM k""",
    "serve_errors": f"""
WITH k AS (SELECT p_partkey, p_size % 9 AS k FROM part)
SELECT p_partkey, CAST((ARRAY[501, 404, 404, 404, 404, 301, 301, 200, 403])[k + 1] AS INTEGER) AS status,
       (ARRAY['Not supported', 'Not Found', 'Command not found', 'Nothing to search for or search string to short.', 'No language code not installed',
              'moved permanently', 'moved permanently', 'OK', 'Forbidden'])[k + 1] AS reason,
       CASE k WHEN 5 THEN '/wiki/en/Main' WHEN 6 THEN '/wiki/xx/Article not found' END AS location,
       CASE k WHEN 0 THEN {_error(501, 'Not supported', 'Method is not supported.')} WHEN 1 THEN {_error(404, 'Not Found', 'Article not found.')}
         WHEN 2 THEN {_error(404, 'Command not found', 'File not found.')} WHEN 3 THEN {_error(404, 'Nothing to search for or search string to short.', '')}
         WHEN 4 THEN {_error(404, 'No language code not installed', '')} WHEN 5 THEN '<Please follow <a href="/wiki/en/Main">/wiki/en/Main</a>' || {_END}
         WHEN 6 THEN '<Please follow <a href="/wiki/xx/Article not found">/wiki/xx/Article not found</a>' || {_END} WHEN 7 THEN 'en:English' || chr(10) || 'de:de'
         WHEN 8 THEN {_error(403, 'Forbidden', 'Access denied.')} END AS body FROM k""",
    "route_requests": f"""
WITH {PG}, p AS (SELECT *, page_id % 8 AS k FROM pg WHERE lang <> ''),
sp AS (SELECT lang, key0, min(title) AS first, count(DISTINCT title) AS n FROM pg GROUP BY ALL),
j AS (SELECT p.*, sp.first, sp.n, EXISTS (SELECT 1 FROM pg x WHERE x.lang = p.lang AND x.title = CASE WHEN k = 1 THEN {upper_sql('p.title')} ELSE p.title END) AS exact
      FROM p JOIN sp ON sp.lang = p.lang AND sp.key0 = p.key0),
s AS (SELECT *, CASE k WHEN 0 THEN 200 WHEN 1 THEN CASE WHEN exact OR n > 1 THEN 200 ELSE 301 END WHEN 2 THEN 301 WHEN 3 THEN 301 WHEN 4 THEN 301
                WHEN 5 THEN CASE WHEN left(title, 2) = '' THEN 404 ELSE 200 END WHEN 6 THEN 501 END AS status FROM j WHERE k < 7)
SELECT page_id, CASE k WHEN 2 THEN 'article_default' WHEN 5 THEN 'search' WHEN 6 THEN 'unsupported' ELSE 'article' END AS route, CAST(status AS INTEGER) AS status,
       CASE WHEN k = 1 AND status = 301 THEN '/wiki/' || lang || ':' || first WHEN k = 2 THEN '/wiki/en/No' || page_id
            WHEN k = 3 THEN '/wiki/xx/Article not found' WHEN k = 4 THEN '/wiki/xx/Language not installed' END AS location,
       CASE WHEN k = 0 THEN title WHEN k = 1 AND exact THEN {upper_sql('title')} END AS title FROM s""",
}
