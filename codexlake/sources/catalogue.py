"""What an installation's folder holds: languages with an archive, their settings, their tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings
from .archive import ARTICLES, IMAGES, article_meta, image_meta, locate, read_config, register

HELP, SHARED = "xx", "xc"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any file system Spark reads, in order; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory())


def discover(spark: SparkSession, path: str, base: str | None = None) -> list[str]:
    """Codes of the languages with an article archive, by name; the help's last, if ``base`` holds it."""
    path = path.rstrip("/")
    found = [name for name in _folders(spark, path) if len(name) >= 2 and name[0] != "." and locate(f"{path}/{name}", name)]
    return [*found, HELP] if base is not None and locate(f"{base.rstrip('/')}/{HELP}", HELP) else found


def open_settings(spark: SparkSession, settings: Settings, base: str | None = None) -> Settings:
    return settings.with_languages(discover(spark, settings.path, base))


def folder_of(settings: Settings, lang: str, base: str | None = None) -> str:
    """A language's folder: the help's is in ``base``, the shared images are in the installation's own."""
    path = settings.path.rstrip("/")
    return path if lang == SHARED else f"{(base or path).rstrip('/') if lang == HELP else path}/{lang}"


def _union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def articles(spark: SparkSession, settings: Settings, base: str | None = None, **options) -> DataFrame:
    """The articles of all installed languages; a language's rows carry its folder's name."""
    register(spark)
    frames = []
    for lang in settings.languages:
        path = locate(folder_of(settings, lang, base), lang)
        if path:
            frames.append(spark.read.format("article_archive").options(**options).load(path).withColumn("lang", F.lit(lang)))
    return _union(frames, spark, ARTICLES)


def images(spark: SparkSession, settings: Settings, base: str | None = None) -> DataFrame:
    """The images of all installed languages and of the shared archive."""
    register(spark)
    frames = []
    for lang in dict.fromkeys([*settings.languages, SHARED]):
        path = locate(folder_of(settings, lang, base), lang, "images")
        if path:
            frames.append(spark.read.format("image_archive").load(path).withColumn("lang", F.lit(lang)))
    return _union(frames, spark, IMAGES)


def config(spark: SparkSession, settings: Settings, name: str = "language.config", base: str | None = None) -> DataFrame:
    """(lang, key, value) of the languages' configuration files; a language without one has no rows."""
    frames = [read_config(spark, f"{folder_of(settings, lang, base)}/{name}").withColumn("lang", F.lit(lang)) for lang in settings.languages]
    return _union(frames, spark, "key string, value string, lang string").select("lang", "key", "value")


def counts(settings: Settings, base: str | None = None) -> dict[str, tuple[int, int]]:
    """Stored numbers of articles and images of each language and of the shared images; -1 without an archive."""
    out = {}
    for lang in dict.fromkeys([*settings.languages, SHARED]):
        folder = folder_of(settings, lang, base)
        out[lang] = article_meta(locate(folder, lang))["n_articles"], image_meta(locate(folder, lang, "images"))["n_images"]
    return out


def images_installed(numbers: dict[str, tuple[int, int]], lang: str) -> bool:
    """Whether there are images to show: the shared archive is there, or the language's own has any."""
    return numbers.get(SHARED, (-1, -1))[1] >= 0 or numbers.get(lang, (-1, -1))[1] > 0


def image_namespace(meta: dict, settings: dict[str, str]) -> str:
    """The archive's own name for images, else the configured one, else ``image``."""
    return meta.get("image_ns") or settings.get("imagePrefix") or "image"
