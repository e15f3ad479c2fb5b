"""The request façade as a stream: request lines that arrive as text files, answered against the static title index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.routes import respond


def request_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(line) of the text files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder).withColumnRenamed("value", "line")


def answer(lines: DataFrame, titles: DataFrame, languages: list[str], default: str, **more) -> DataFrame:
    """Responses of a stream of lines: a stream-static join without state, in append mode."""
    return respond(lines, titles, languages, default, **more)


def start(responses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the responses that are due as Parquet and stops; each line is answered once across restarts."""
    return (
        responses.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
