"""The folder in which lineage is cut, and folds over documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _folder(df: DataFrame) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir); a temporary one is set only where there is none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the same folder, for tables that hold texts."""
    df.write.parquet(path := f"{_folder(df)}/{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_document(df: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """The rows that fold makes of each document's rows in order. Documents pass one behind the other: a task holds one and no group has a cost of its own."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held, doc = [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and r["doc_id"] != doc:
                    out += fold(held)
                    held = []
                doc = r["doc_id"]
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
        if held:
            yield pa.RecordBatch.from_pylist(fold(held), schema=fields)

    return df.repartition("doc_id").sortWithinPartitions("doc_id", "order").mapInArrow(run, schema)
