"""Requests as a stream: each line is answered once, across restarts."""

from codexlake.operators.titles import with_keys
from codexlake.streaming import requests as R


def test_lines_are_answered_once(spark, tmp_path):
    titles = with_keys(spark.createDataFrame([("en", "Apple"), ("en", "Pear")], "lang string, title string"))
    images = spark.createDataFrame([("en", "a.png")], "lang string, file_key string")
    files = spark.createDataFrame([("/x.css", False)], "path string, is_dir boolean")
    inbox, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    inbox.mkdir()

    def go():
        lines = R.request_stream(spark, str(inbox))
        R.start(R.answer(lines, titles, ["en"], "en", images=images, files=files), out, log).awaitTermination()
        return sorted((r.line, r.status, r.location) for r in spark.read.parquet(out).collect())

    (inbox / "1.txt").write_text("GET /wiki/en/Apple HTTP/1.1\nGET /wiki/en/PEAR HTTP/1.1\nbroken\nGET /wiki/en/Image:A.png HTTP/1.1\n")
    first = [("GET /wiki/en/Apple HTTP/1.1", 200, None), ("GET /wiki/en/Image:A.png HTTP/1.1", 200, None), ("GET /wiki/en/PEAR HTTP/1.1", 301, "/wiki/en:Pear")]
    assert go() == first
    assert go() == first
    (inbox / "2.txt").write_text("GET /x.css HTTP/1.1\nGET /y.css HTTP/1.1\n")
    assert go() == sorted([*first, ("GET /x.css HTTP/1.1", 200, None), ("GET /y.css HTTP/1.1", 404, None)])
