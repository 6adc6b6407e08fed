"""Linting a stream of documents: every rule sees one document at a time, so each micro-batch is linted by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.lint import Options, lint


def lint_stream(documents: DataFrame, output: str, checkpoint: str, options: Options | None = None, words: DataFrame | None = None) -> StreamingQuery:
    """Writes the findings of a streaming documents(path, text) to a Parquet table, a folder for each batch; a batch that is run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        lint(batch, options, words).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
