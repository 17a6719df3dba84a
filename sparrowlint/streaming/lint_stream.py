"""New source files as they arrive: a file stream, linted per micro-batch with the query rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparrowlint.operators import rules
from sparrowlint.plans.config import Config
from sparrowlint.sources import files as src


def lint_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, config: Config | None = None, once: bool = True) -> StreamingQuery:
    """Appends the findings of each new file under ``folder`` to Parquet at ``out``; a batch id makes a repeated batch replace itself."""
    config = config or Config()
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).schema("value string").load(folder)
    files = stream.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("content"))

    def each(batch: DataFrame, n: int) -> None:
        usable = src.usable_files(batch, config)
        found = rules.query_findings(src.statements(usable, config), src.directives(usable, config), config)
        found.write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
