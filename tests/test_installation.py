"""An installation on disk: archives, configuration, files, settings, and the server's answers from them."""

import pytest
from archives import write_articles, write_images
from pyspark.sql import functions as F

from codexlake.functions import text as X
from codexlake.markup.context import Context
from codexlake.markup.pages import FOOT, get_articles, trial_page
from codexlake.operators import routes, titles as T
from codexlake.settings import Settings
from codexlake.sources import archive, catalogue, files

EN = [
    ("Apple", "A '''fruit'''."), ("Banana", "#REDIRECT [[apple]]"), ("Cherry", ""), ("Lost", "#redirect [[Nowhere]]"),
    ("apple pie", "one"), ("Apple Pie", "two"), ("Template:x", "t"), ("Übung", "ü"),
]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    at = tmp_path_factory.mktemp("installation")
    write_articles(at / "wiki/en/articles.bin", "en", EN, image_ns="Bild")
    write_articles(at / "wiki/de/articles_de.bin", "de", [("Apfel", "Obst")], version=0, image_ns="Bild")
    (at / "wiki/empty").mkdir()
    (at / "wiki/.de").mkdir()
    write_articles(at / "base/xx/articles.bin", "xx", [("Help", "h")])
    write_images(at / "wiki/en/images.bin", "en", [("map.svg.png", b"own"), ("none.png", b"")])
    write_images(at / "wiki/images.bin", "xc", [("shared.png", b"shared")])
    (at / "wiki/en/language.config").write_bytes(b"#c=1\nname=English\r\nmainPage=Apple\nk=v=w\nk=v=x\nnothing\nlate=1\nlate=2\n")
    for path, data in (("web/style.css", b"c"), ("web/Images/a.gif", b"g"), ("wiki/help/index.html", b"i"), ("wiki/deep/er/f.txt", b"f"), ("wiki/style.css", b"no")):
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_bytes(data)
    return at


@pytest.fixture(scope="module")
def settings(spark, place):
    return catalogue.open_settings(spark, Settings(path=f"{place}/wiki", language="fr"), f"{place}/base")


def test_discovery(spark, place, settings):
    assert settings.languages == ("de", "en", "xx") and settings.language == "de"
    assert settings.installed("en") and settings.installed("n,x") and not settings.installed("n,x", compat=False)
    assert catalogue.discover(spark, f"{place}/nowhere") == []
    assert catalogue.counts(settings, f"{place}/base") == {"de": (1, -1), "en": (8, 2), "xx": (1, -1), "xc": (-1, 1)}
    numbers = catalogue.counts(settings, f"{place}/base")
    assert catalogue.images_installed(numbers, "de") and not catalogue.images_installed({"de": (1, 0)}, "de")


def test_arguments():
    got = Settings.from_args(["-b", "/w", "-p", "99x", "-l", "de", "-t", "-v+", "-v-", "-d", "?", "-a"])
    assert (got.path, got.port, got.language, got.expand_templates, got.verbose, got.debug) == ("/w", 99, "de", True, False, True)
    with pytest.raises(ValueError):
        Settings.from_args(["-p", "0"])
    assert Settings.from_args([]) == Settings()


@pytest.mark.parametrize("index", [0, 1])
def test_articles(spark, place, settings, index):
    rows = catalogue.articles(spark, settings, f"{place}/base", rowsPerPartition=3, index=index).where("lang = 'en'").orderBy("ordinal").collect()
    wanted = EN[::-1] if index else EN
    assert [(r.title, r.body) for r in rows] == wanted and [r.ordinal for r in rows] == list(range(8))
    assert all(r.article_len == len(r.body.encode()) for r in rows)


def test_header_and_missing_archives(spark, place):
    assert archive.article_meta(f"{place}/wiki/en/articles.bin")["image_ns"] == "Bild"
    assert archive.article_meta(f"{place}/wiki/de/articles_de.bin")["image_ns"] == ""
    assert archive.locate(f"{place}/wiki/empty", "em") is None and archive.article_meta(None)["n_articles"] == -1
    assert archive.image_meta(f"{place}/wiki/en/nothing")["n_images"] == -1
    (place / "cut.bin").write_bytes(b"en")
    archive.register(spark)
    assert spark.read.format("article_archive").load(f"{place}/cut.bin").count() == 0
    assert catalogue.image_namespace({"image_ns": "Bild"}, {}) == "Bild"
    assert catalogue.image_namespace({"image_ns": ""}, {"imagePrefix": "Datei"}) == "Datei" and catalogue.image_namespace({}, {}) == "image"


def test_images(spark, place, settings):
    rows = {(r.lang, r.file_key): bytes(r.data) for r in catalogue.images(spark, settings).collect()}
    assert rows == {("en", "map.svg.png"): b"own", ("en", "none.png"): b"", ("xc", "shared.png"): b"shared"}


def test_configuration(spark, settings):
    rows = {(r.lang, r.key): r.value for r in catalogue.config(spark, settings).collect()}
    assert rows == {("en", "name"): "English", ("en", "mainPage"): "Apple", ("en", "k=v"): "x", ("en", "late"): "2"}


def test_files(spark, place):
    rows = {r.path: (r.is_dir, r.data and bytes(r.data)) for r in files.static_files(spark, f"{place}/web", f"{place}/wiki", f"{place}/none").collect()}
    assert rows["/style.css"] == (False, b"c") and rows["/deep/er"] == (True, None) and rows["/deep/er/f.txt"] == (False, b"f")
    assert files.whole(spark, f"{place}/web/style.css") == "c" and files.whole(spark, f"{place}/web/x") is None


@pytest.fixture(scope="module")
def pages(spark, place, settings):
    rows = catalogue.articles(spark, settings, f"{place}/base")
    asked = rows.select("lang", "title")
    return get_articles(asked, rows.select("lang", "title", "body"), Context(languages=settings.languages)), rows


def test_article_pages(pages):
    got = {(r.lang, r.title): (r.article_name, r.page) for r in pages[0].collect()}
    name, page = got["en", "Apple"]
    assert name == "Apple" and "<title>Apple</title>" in page and "A <b>fruit</b>." in page and page.endswith(FOOT)
    name, page = got["en", "Banana"]
    assert name == "Apple" and '<span class="wkRedirected">(Redirected from Banana)</span>\r\n<p />' in page and "A <b>fruit</b>." in page
    assert got["en", "Cherry"][1] == "" and got["en", "Lost"][0] == "" and "(Redirected from Lost)" in got["en", "Lost"][1]
    assert "one" in got["en", "apple pie"][1] and "two" in got["en", "Apple Pie"][1]


def test_answers(spark, place, settings, pages):
    index = T.with_keys(pages[1].select("lang", "title"))
    lines = {
        "GET /wiki/en/Apple HTTP/1.1": (200, None), "get /WIKI/en/Apple HTTP/1.1": (200, None), "GET /wiki/en/APPLE HTTP/1.1": (301, "/wiki/en:Apple"),
        "GET /wiki/en/apple%20pie HTTP/1.1": (200, None), "GET /wiki/en/APPLE%20PIE HTTP/1.1": (200, None), "GET /wiki/en/Cherry HTTP/1.1": (301, routes.NOT_FOUND),
        "GET /wiki/en/No HTTP/1.1": (301, routes.NOT_FOUND), "GET /wiki/Apple HTTP/1.1": (301, "/wiki/de/Apple"), "GET /wiki/en:Apple HTTP/1.1": (301, "/wiki/en/Apple"),
        "GET /wiki/zz/Apple HTTP/1.1": (301, routes.NOT_INSTALLED), "GET /wiki/en/ HTTP/1.1": (301, "/wiki/en/Apple"), "GET /wiki/de/ HTTP/1.1": (301, routes.NOT_FOUND),
        "GET /wiki/xx/Article%20not%20found HTTP/1.1": (404, None), "GET /wiki/en/Image:map.SVG HTTP/1.1": (200, None), "GET /wiki/de/image:shared.png HTTP/1.1": (200, None),
        "GET /wiki/de/image:a.gif HTTP/1.1": (200, None), "GET /wiki/de/image:map.svg HTTP/1.1": (404, None), "GET /ajax/search:en:ap HTTP/1.1": (200, None),
        "GET /ajax/search:en: HTTP/1.1": (404, None), "GET /ajax/search:fr:ap HTTP/1.1": (404, None), "GET /ajax/search:zzz HTTP/1.1": (200, None),
        "GET /ajax/RedirectToRandomArticleen HTTP/1.1": (301, "/wiki/en:"), "GET /ajax/RedirectToRandomArticlezz HTTP/1.1": (301, routes.NOT_INSTALLED),
        "GET /ajax/GetInstalledLanguages HTTP/1.1": (200, None), "GET /ajax/what HTTP/1.1": (404, None), "POST / HTTP/1.1": (501, None),
        "GET /style.css HTTP/1.1": (200, None), "GET /help HTTP/1.1": (301, "/help/index.html"), "GET /help/ HTTP/1.1": (200, None), "GET /deep HTTP/1.1": (302, "/deep/"),
        "GET /deep/ HTTP/1.1": (403, None), "GET /nothing HTTP/1.1": (404, None), "GET /wiki/en/testpage.txt HTTP/1.1": (403, None), "broken": None, "GET /x": None,
    }
    requests = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    stock = files.static_files(spark, f"{place}/web", f"{place}/wiki")
    pictures = catalogue.images(spark, settings).where("length(data) > 0")
    got = {
        r.line: r for r in routes.serve(
            requests, index, list(settings.languages), settings.language, {"en": "English"}, pages[0], pictures, stock, main_pages={"en": "Apple"}
        ).collect()
    }
    for line, wanted in lines.items():
        if wanted is None:
            assert line not in got
        else:
            status, location = wanted
            row = got[line]
            assert row.status == status, line
            if location and location.endswith("en:"):
                assert row.location.startswith(location) and "Template" not in row.location
            else:
                assert row.location == location, line
    at = lambda line: got[f"GET {line} HTTP/1.1"]
    assert "A <b>fruit</b>." in at("/wiki/en/Apple").body and at("/wiki/en/Apple").mime == routes.HTML
    assert at("/wiki/en/APPLE%20PIE").body.count("wkSearchResultLink") == 2
    assert bytes(at("/wiki/en/Image:map.SVG").data) == b"own" and at("/wiki/en/Image:map.SVG").mime == "image/png"
    assert bytes(at("/wiki/de/image:shared.png").data) == b"shared" and bytes(at("/wiki/de/image:a.gif").data) == b"g"
    assert at("/ajax/search:en:ap").body == "Apple\nApple Pie\napple pie" and at("/ajax/search:zzz").body == ""
    assert at("/ajax/GetInstalledLanguages").body == "de:de\nen:English"
    assert bytes(at("/style.css").data) == b"c" and at("/style.css").mime == "text/css" and bytes(at("/help/").data) == b"i"
    assert at("/nothing").body == "<HTML><HEAD><TITLE>404 Not Found</TITLE></HEAD>\r\n<BODY><H4>404 Not Found</H4>\r\nFile not found.\r\n</BODY></HTML>\r\n"
    assert at("/help").body == '<Please follow <a href="/help/index.html">/help/index.html</a>\r\n'


def test_listing_headers_and_trial_page(spark):
    row = spark.range(1).select(
        routes.split_listing(F.lit("de:de\nen:Eng:lish")).alias("l"), trial_page(F.lit("''a''"), Context()).alias("t"),
        routes.header_lines(F.lit(404), F.lit("Not Found"), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("text/html"), F.lit(None).cast("int"), F.lit(None).cast("string")).alias("h"),
    ).first()
    assert [tuple(x) for x in row.l] == [("de", "de"), ("en", "Eng:lish")] and row.t == "<html><body>\r\n<i>a</i>\r\n</html></body>"
    assert row.h == "HTTP/1.1 404 Not Found\r\nServer: codexlake/1.0\r\nDate: Tue, 02 Jan 2024 03:04:05 GMT\r\nContent-Type: text/html\r\nConnection: close\r\n\r\n"


def test_all_traditional_letters(spark):
    from codexlake.functions.chinese import simplified_table

    old, new = simplified_table()
    assert len(old) == len(new) > 2_500 and len(set(old)) == len(old)
    pairs = dict(zip(old, new))
    assert all(pairs[a] == b for a, b in zip(X.ZH_FROM, X.ZH_TO))
    row = spark.range(1).select(X.key1(F.lit("ÀB亂國é"), F.lit("zh")).alias("zh"), X.key1(F.lit("ÀB亂é"), F.lit("en")).alias("en")).first()
    assert (row.zh, row.en) == ("àb乱国é", "ab亂e")


def test_records_far_apart_or_with_long_names(tmp_path, monkeypatch):
    rows = [(f"{i}" + "é" * (3_000 if i % 3 == 0 else 2), f"body {i}") for i in range(7)]
    write_articles(tmp_path / "articles.bin", "en", rows)
    reader = archive.ArticleReader({"path": str(tmp_path / "articles.bin"), "rowsPerPartition": 4})
    wanted = sorted((i, t, b) for i, (t, b) in enumerate(rows))
    for span in (64 << 20, 0):
        monkeypatch.setattr(archive._Records, "SPAN", span)
        assert sorted((r[1], r[2], r[6]) for p in reader.partitions() for r in reader.read(p)) == wanted
