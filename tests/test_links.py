"""Link queries on planted pages, with targets that exist on pages of odd and of even ids."""

import pytest

from codexlake.plans import links


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pages"))
    html = '<a href="/x/Odd_One.html">a</a><a href="/x/even_two">b</a><a href="/x/missing">c</a>'
    rows = [(1, "https://a.org/en/odd_one.html", html), (2, "https://a.org/en/Even_Two.html", ""), (3, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def test_all_pages_are_titles(spark, folder):
    rows = lambda q: sorted(tuple(r) for r in q(spark, folder).collect())
    assert rows(links.link_existing) == [(1, 1, "Odd_One"), (1, 2, "even_two")]
    assert rows(links.link_validity) == [(1, 3, "missing")]
    assert rows(links.ifexist_semi) == [(1, 1, True), (1, 2, True), (1, 3, False)]
    assert rows(links.ifexist_compat) == [(1, 1, False), (1, 2, False), (1, 3, True)]
