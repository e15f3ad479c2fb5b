"""Readers of the binary archives as Spark data sources, and of configuration files.

``articles.bin``: a 256-byte header, offset arrays, title records, and bodies in
bzip2 streams. ``images.bin``: a 32-byte header, an offset array, name records
and image bytes. All numbers are little-endian. Paths may be URIs of any file
system that pyarrow knows; partitions are ranges of titles, and a partition
decompresses each bzip2 stream it touches once.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ARTICLE_HEADER = struct.Struct("<2sIqqqBc32s32s160s")
IMAGE_HEADER = struct.Struct("<2sIqq10s")
TITLE_RECORD, IMAGE_RECORD = struct.Struct("<qii"), struct.Struct("<qI")
ARTICLES = "lang string, ordinal int, title string, block_pos long, article_pos int, article_len int, body string"
IMAGES = "lang string, ordinal int, file_key string, data binary"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def locate(folder: str, lang: str, name: str = "articles") -> str | None:
    """The archive of a language: ``name.bin`` or ``name_xx.bin``; None if there is neither."""
    for candidate in (f"{folder}/{name}.bin", f"{folder}/{name}_{lang}.bin"):
        try:
            with _open(candidate):
                return candidate
        except (FileNotFoundError, IsADirectoryError):
            continue
    return None


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _head(path: str | None, layout: struct.Struct):
    """The unpacked header, or None if the file is missing or too short to be an archive."""
    if path is None:
        return None
    try:
        with _open(path) as f:
            raw = f.read(layout.size)
    except FileNotFoundError:
        return None
    return layout.unpack(raw) if len(raw) == layout.size else None


def article_meta(path: str | None) -> dict:
    """Header of an article archive; the second index and the namespaces only count in version 1; -1 articles without one."""
    head = _head(path, ARTICLE_HEADER)
    if head is None:
        return {"lang": "", "n_articles": -1, "titles_pos": 0, "index_pos": (0, 0), "version": 0, "image_ns": "", "template_ns": ""}
    lang, n, titles, first, second, version, _, images, templates, _ = head
    extra = version == 1
    return {
        "lang": _text(lang), "n_articles": n, "titles_pos": titles, "index_pos": (first, second if extra else 0), "version": version,
        "image_ns": _text(images) if extra else "", "template_ns": _text(templates) if extra else "",
    }


def image_meta(path: str | None) -> dict:
    """Header of an image archive; -1 images without one."""
    head = _head(path, IMAGE_HEADER)
    if head is None:
        return {"lang": "", "n_images": -1, "titles_pos": 0, "index_pos": 0}
    lang, n, titles, index, _ = head
    return {"lang": _text(lang), "n_images": n, "titles_pos": titles, "index_pos": index}


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


def _string_at(f, at: int) -> str:
    f.seek(at)
    raw = b""
    while b"\0" not in raw:
        more = f.read(256)
        if not more:
            break
        raw += more
    return _text(raw)


class _Records:
    """Records of one partition: their span is read in one go where they lie together, else each by itself."""

    SPAN, TAIL = 64 << 20, 4_096

    def __init__(self, f, base: int, offsets: tuple[int, ...], layout: struct.Struct):
        self.f, self.base, self.layout, self.low = f, base, layout, min(offsets)
        length = max(offsets) - self.low
        self.held = b""
        if length <= self.SPAN:
            f.seek(base + self.low)
            self.held = f.read(length + layout.size + self.TAIL)

    def __getitem__(self, offset: int) -> tuple:
        """The record's numbers and its name."""
        at = offset - self.low
        end = self.held.find(b"\0", at + self.layout.size) if at + self.layout.size < len(self.held) else -1
        if end >= 0:
            return *self.layout.unpack_from(self.held, at), _text(self.held[at + self.layout.size : end])
        self.f.seek(self.base + offset)
        numbers = self.layout.unpack(self.f.read(self.layout.size))
        return *numbers, _string_at(self.f, self.base + offset + self.layout.size)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("rowsPerPartition", 50_000))

    def count(self) -> int:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        n = self.count()
        return [Range(i, min(n, i + self.size)) for i in range(0, n, self.size)] or [Range(0, 0)]


class ArticleReader(_Reader):
    def __init__(self, options):
        super().__init__(options)
        self.index = int(options.get("index", 0))
        self.bodies = str(options.get("bodies", "true")).lower() == "true"

    def count(self) -> int:
        return max(0, article_meta(self.path)["n_articles"])

    def read(self, partition: Range) -> Iterator[tuple]:
        meta = article_meta(self.path)
        n = partition.end - partition.begin
        if not n:
            return
        with _open(self.path) as f:
            f.seek(meta["index_pos"][self.index] + 4 * partition.begin)
            offsets = struct.unpack(f"<{n}I", f.read(4 * n))  # unsigned: archives may pass 2 GB
            records = _Records(f, meta["titles_pos"], offsets, TITLE_RECORD)
            rows = []
            for i, offset in enumerate(offsets, partition.begin):
                *numbers, title = records[offset]
                rows.append((i, title, *numbers))
            rows.sort(key=lambda r: (r[2], r[3]))
            block, text = None, b""
            for i, title, block_pos, pos, length in rows:
                if self.bodies and block_pos != block:
                    block, text = block_pos, self._block(f, block_pos)
                body = text[pos : pos + length].decode("utf-8", "replace") if self.bodies else None
                yield meta["lang"], i, title, block_pos, pos, length, body

    @staticmethod
    def _block(f, at: int) -> bytes:
        f.seek(at)
        stream, out = bz2.BZ2Decompressor(), []
        while not stream.eof:
            raw = f.read(1 << 16)
            if not raw:
                break
            out.append(stream.decompress(raw))
        return b"".join(out)


class ImageReader(_Reader):
    def count(self) -> int:
        return max(0, image_meta(self.path)["n_images"])

    def read(self, partition: Range) -> Iterator[tuple]:
        meta = image_meta(self.path)
        n = partition.end - partition.begin
        if not n:
            return
        with _open(self.path) as f:
            f.seek(meta["index_pos"] + 4 * partition.begin)
            offsets = struct.unpack(f"<{n}I", f.read(4 * n))
            records = _Records(f, meta["titles_pos"], offsets, IMAGE_RECORD)
            for i, offset in enumerate(offsets, partition.begin):
                pos, length, name = records[offset]
                f.seek(pos)
                yield meta["lang"], i, name, f.read(length)


class ArticleArchive(DataSource):
    @classmethod
    def name(cls):
        return "article_archive"

    def schema(self):
        return ARTICLES

    def reader(self, schema):
        return ArticleReader(self.options)


class ImageArchive(DataSource):
    @classmethod
    def name(cls):
        return "image_archive"

    def schema(self):
        return IMAGES

    def reader(self, schema):
        return ImageReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("article_archive" | "image_archive").load(path)`` work."""
    spark.dataSource.register(ArticleArchive)
    spark.dataSource.register(ImageArchive)


def parse_config(lines: DataFrame, line: str = "value", order: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, key, value) of ``key=value`` lines: cut at the last equals sign, ``#`` lines left out, the last duplicate wins."""
    rows = lines.withColumn("__line", F.regexp_replace(line, "\r", ""))
    rows = rows.where(~F.startswith("__line", F.lit("#")) & F.contains("__line", F.lit("=")))
    pattern = r"(?s)^(.*)=([^=]*)$"
    at = F.col(order) if order else F.monotonically_increasing_id()
    rows = rows.select(*by, F.regexp_extract("__line", pattern, 1).alias("key"), F.regexp_extract("__line", pattern, 2).alias("value"), at.alias("__at"))
    return rows.groupBy(*by, "key").agg(F.max_by("value", "__at").alias("value"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a configuration file, lines in their order; no rows if there is no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, value string")
    text = spark.read.text(path, wholetext=True)  # a configuration is small, and its lines' order counts
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("at", "value"))
    return parse_config(lines, order="at")
