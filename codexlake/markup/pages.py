"""Rendering and expansion as Arrow-batched functions over DataFrames, and page assembly as expressions."""

from __future__ import annotations

import re
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import text as X
from .context import Context
from .renderer import Renderer
from .templates import Expander, template_text

def render_column(body: Column, context: Context, page: Column | None = None, lang: Column | None = None) -> Column:
    """HTML of wikitext; page names and languages may differ by row."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, pages: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else Renderer(replace(context, page=p or "", lang=g or context.lang)).render(t) for t, p, g in zip(texts, pages, langs)]
        )

    return run(body, F.lit(context.page) if page is None else page, F.lit(context.lang) if lang is None else lang)


def expand_column(body: Column, context: Context, page: Column | None = None) -> Column:
    """Wikitext with its templates expanded; texts without a call or comment skip the Python function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Expander(replace(context, page=p or "")).expand(t) for t, p in zip(texts, pages)])

    needed = F.contains(body, F.lit("{{")) | F.contains(body, F.lit("<!--"))
    return F.when(needed, run(body, F.lit(context.page) if page is None else page)).otherwise(body)


def template_text_column(body: Column) -> Column:
    """What each template contributes; bodies without an inclusion tag are taken as they are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else template_text(t))

    return F.when(body.rlike("<"), run(body)).otherwise(body)


def template_table(articles: DataFrame, prefix: str = "Template:") -> DataFrame:
    """(lang, key, body): ready text of the templates by folded full name, redirects followed one hop.

    ``articles`` has (lang, title, body). Of titles that are equal but for case the first counts, as in a lookup.
    A template that redirects to nothing keeps its own text.
    """
    stock = articles.groupBy("lang", X.key0("title").alias("key")).agg(F.min_by("body", "title").alias("body"))
    rows = stock.where(F.startswith("key", F.lit(prefix.lower())))
    rows = rows.withColumn("__to", F.when(X.is_redirect("body"), X.key0(X.redirect_target("body"))))
    goals = stock.select(F.col("lang").alias("__lang"), F.col("key").alias("__key"), F.col("body").alias("__body"))
    rows = rows.join(goals, (F.col("lang") == F.col("__lang")) & (F.col("__to") == F.col("__key")), "left")
    return rows.select("lang", "key", template_text_column(F.coalesce("__body", "body")).alias("body"))


class _Lookup(dict):
    """A page's known templates or titles; what is asked for and not known yet is noted."""

    def __init__(self, known: dict, wanted: set, kind: str):
        super().__init__({k[1:]: v for k, v in known.items() if k[0] == kind})
        self.wanted, self.kind = wanted, kind

    def get(self, key, default=None):
        if key not in self.keys():
            self.wanted.add(self.kind + key)
            return default
        return self[key]

    def __contains__(self, key):
        return self.get(key) is not None


def expand_pages(pages: DataFrame, templates: DataFrame, titles: DataFrame, context: Context) -> DataFrame:
    """(lang, title, expanded) of pages (lang, title, body), their calls looked up in tables.

    Each round expands every unfinished page with the templates and titles it is known to ask for, and joins
    those that came up to the tables (lang, key, body) and (lang, key0). Nothing is collected: a page carries
    only what it calls. There are as many rounds as templates are nested.
    """
    templates = templates.select("lang", F.concat(F.lit("t"), "key").alias("__name"), F.col("body").alias("__body"))
    index = titles.select("lang", F.concat(F.lit("x"), "key0").alias("__name")).distinct().withColumn("__body", F.lit(""))
    found = templates.unionByName(index)

    @F.pandas_udf("expanded string, wanted array<string>")
    def run(texts: pd.Series, names: pd.Series, langs: pd.Series, known: pd.Series) -> pd.DataFrame:
        out = []
        for text, name, lang, have in zip(texts, names, langs, known):
            wanted: set[str] = set()
            have = dict(have)
            own = replace(context, page=name or "", lang=lang or context.lang, templates=_Lookup(have, wanted, "t"), titles=_Lookup(have, wanted, "x"))
            out.append((None if text is None else Expander(own).expand(text), sorted(wanted)))
        return pd.DataFrame(out, columns=["expanded", "wanted"])

    def step(rows: DataFrame) -> DataFrame:
        made = rows.withColumn("__made", run("body", "title", "lang", "known"))
        return checkpointed(made.select("lang", "title", "body", "known", "__made.expanded", "__made.wanted"))

    nothing = F.create_map().cast("map<string,string>")
    rows = step(pages.select("lang", "title", "body").withColumn("known", nothing))
    done = rows.where("size(wanted) = 0").select("lang", "title", "expanded")
    rows = rows.where("size(wanted) > 0")
    while not rows.isEmpty():
        asked = rows.select("lang", "title", F.explode("wanted").alias("__name"))
        got = asked.join(found, ["lang", "__name"], "left").groupBy("lang", "title").agg(
            F.map_from_entries(F.collect_list(F.struct("__name", "__body"))).alias("__new")
        )
        rows = step(rows.join(got, ["lang", "title"]).select("lang", "title", "body", F.map_concat("known", "__new").alias("known")))
        done = done.unionByName(rows.where("size(wanted) = 0").select("lang", "title", "expanded"))
        rows = rows.where("size(wanted) > 0")
    return done


#: An installation's own style sheet, whose name the built-in pages link to; replace it in ``HEAD`` and ``RESULTS_HEAD`` by your own.
STYLE = "own.css"

# The built-in page before and after an article, its redirect note, and the page of several hits.
HEAD = (
    '<html><head>\r\n'
    '<meta id="viewport" name="viewport" content="width=320; initial-scale=0.6667; maximum-scale=1.0; minimum-scale=0.6667 "/>\r\n'
    '<LINK href="/stylesheets/shared.css" type="text/css" rel="stylesheet">\r\n'
    '<LINK href="/stylesheets/main.css" type="text/css" rel="stylesheet">\r\n'
    '<LINK href="/stylesheets/mediawiki_common.css" type="text/css" rel="stylesheet">\r\n'
    '<LINK href="/stylesheets/mediawiki_monobook.css" type="text/css" rel="stylesheet">\r\n'
    f'<LINK href="/stylesheets/{STYLE}" type="text/css" rel="stylesheet">\r\n'
    '<title>%ArticleTitle%</title>\r\n'
    '</head>\r\n<body class="wkBody">\r\n'
    '<div class="wkTitle"><a href="/" class="wkTitleLink"><img src="/icon_search.gif"/>&nbsp;%ArticleTitle%</a></div>\r\n'
    '%RedirectedFrom%<p />\r\n'
)
FOOT = "\r\n</body></html>"
REDIRECTED = '<span class="wkRedirected">(Redirected from %Title%)</span>\r\n'
RESULTS_HEAD = (
    '<html><head><title>Search results</title>\r\n'
    '<meta name="viewport" content="width=device-width; initial-scale=1.0; maximum-scale=1.0; user-scalable=0;"/>\r\n'
    f'<LINK href="/stylesheets/{STYLE}" type="text/css" rel="stylesheet">\r\n'
    '</head>\r\n<body class="wkSearchBody">\r\n<div class="wkSearchTitle">Search results:</div><p /><div class="wkSearchResult">\r\n'
)
RESULT = '<a href="./%Title%" class="wkSearchResultLink">%Title%</a><br />\r\n'
RESULTS_FOOT = "</div></body>\r\n</html>"


def _filled(text: str, **values: Column) -> Column:
    """The text with its %Name% placeholders filled in, all at once: a value that holds a placeholder stays as it is."""
    parts = re.split("%(" + "|".join(values) + ")%", text)
    return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x))


def assemble(title: Column, html: Column, redirected_from: Column | None = None, pre: str = HEAD, post: str = FOOT) -> Column:
    """A whole page: header with its placeholders filled, body, footer; ``pre`` and ``post`` may be an installation's own."""
    note = F.lit("")
    if redirected_from is not None:
        note = F.when(F.coalesce(redirected_from, F.lit("")) == "", "").otherwise(_filled(REDIRECTED, Title=redirected_from))
    return F.concat(_filled(pre, ArticleTitle=title, RedirectedFrom=note), html, F.lit(post))


def result_list(titles: Column) -> Column:
    """The page that lists several hits, from their ordered array."""
    return F.concat(F.lit(RESULTS_HEAD), F.array_join(F.transform(titles, lambda t: _filled(RESULT, Title=t)), ""), F.lit(RESULTS_FOOT))


def get_articles(asked: DataFrame, articles: DataFrame, context: Context, redirects: bool = True, pre: str = HEAD, post: str = FOOT) -> DataFrame:
    """(lang, title, article_name, page) of each asked (lang, title): fetched, redirected one hop, rendered and put together.

    ``articles`` has (lang, title, body). A title that is not there, or has an empty body, gives an empty page. The title is
    found as a lookup does: the only one that is equal but for case, or of several the one spelled the same.
    """
    from ..operators.titles import disambiguate

    stock = articles.select("lang", "title", X.key0("title").alias("key0"), "body")
    asked = asked.select("lang", "title").distinct()
    hits = asked.select("lang", F.col("title").alias("query"), X.key0("title").alias("key0")).join(
        stock.select("lang", "key0", F.col("title").alias("found"), "body"), ["lang", "key0"]
    )
    hits = disambiguate(hits, ["lang", "query"], "query", "found")
    jump = X.is_redirect("body") if redirects else F.lit(False)
    rows = hits.withColumn("__to", F.when(jump, X.redirect_target("body"))).withColumn("__key", X.key0("__to"))
    goals = stock.select(F.col("lang").alias("__lang"), F.col("key0").alias("__key0"), F.col("title").alias("__title"), F.col("body").alias("__body"))
    jumps = rows.where("__to is not null").join(goals, (F.col("lang") == F.col("__lang")) & (F.col("__key") == F.col("__key0")))
    jumps = disambiguate(jumps, ["lang", "query"], "__to", "__title").select("lang", "query", "__title", "__body")
    rows = rows.join(jumps, ["lang", "query"], "left")
    jumped = F.col("__to").isNotNull()
    name = F.when(jumped, F.coalesce("__title", F.lit(""))).otherwise(F.col("found"))
    text = F.when(jumped, F.coalesce("__body", F.lit(""))).otherwise(F.col("body"))
    rows = rows.select("lang", F.col("query").alias("title"), name.alias("article_name"), text.alias("text"), F.when(jumped, F.col("found")).alias("origin"), "body")
    html = render_column(F.col("text"), context, F.col("article_name"), F.col("lang"))
    page = F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(assemble(F.col("article_name"), html, F.col("origin"), pre, post))
    rows = rows.select("lang", "title", "article_name", page.alias("page"))
    return asked.join(rows, ["lang", "title"], "left").withColumn("page", F.coalesce("page", F.lit("")))


def trial_page(text: Column, context: Context) -> Column:
    """A loose file of wikitext as a page, for trying out markup."""
    # Its frame, end tags in this order.
    return F.concat(F.lit("<html><body>\r\n"), render_column(text, context, F.lit("Testpage")), F.lit("</html></body>"))
