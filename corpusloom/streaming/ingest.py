"""Continuous ingestion of block records: each micro-batch runs the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import CLEAN, CleanConfig
from ..operators import clean
from ..schemas import RAW_RECORD
from ..sources.blocks import flatten


def read_stream(spark: SparkSession, root: str) -> DataFrame:
    return flatten(spark.readStream.schema(RAW_RECORD).option("recursiveFileLookup", "true").json(root))


def start(spark: SparkSession, root: str, out: str, checkpoint: str, cfg: CleanConfig = CLEAN) -> StreamingQuery:
    """Cleans the documents of new files into ``out``, once per batch: a batch that runs again replaces its own folder.

    A document arrives as one file, so per-document stages see all of it.
    """

    def write(batch: DataFrame, number: int) -> None:
        clean.clean(batch, cfg).drop("page_width", "page_height").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return read_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
