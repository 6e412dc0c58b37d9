"""What the operators of this subpackage share: tables, the shared folder, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of the "words" of the contracts.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where a local session names none (tests, a laptop) a temporary folder is made once and set as the
    checkpoint folder; on a cluster a folder of one machine would be no shared one, so there it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_GROUP_ROWS = "parquet.block.row.count.limit"

#: Whole texts in one Arrow batch; the session's setting is meant for narrow rows.
TEXT_ROWS = 1024


def materialise(df: DataFrame, what: str, arrow_rows: int | None = None, group_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends in replicated files.

    The shuffle files of the write go with it, by Spark's own setting, as nothing refers to them any more.
    arrow_rows: rows in one Arrow batch of the write, where rows are large (else the session's setting).
    group_rows: rows in one Parquet row group, where a row takes megabytes: writers and readers hold whole row groups, and a
    writer looks at its size only every 100 rows.
    """
    spark = df.sparkSession
    wanted = {_SHUFFLE_CLEANUP: "true"} | ({_ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
    path, before = fresh_path(spark, what), {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.select("*").write.options(**({_GROUP_ROWS: str(group_rows)} if group_rows else {})).parquet(path)  # planned anew, under the settings
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialise() wrote and whose successor is written."""
    files = df.inputFiles()
    if files and shared_dir(df.sparkSession).split(":", 1)[-1].lstrip("/") in files[0]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """What a Python worker has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has the call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with give_back() at each task's end: Spark keeps its workers, which else hold what their largest task took."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def join_on_common(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined with table (one row per key) on key, where a key may hold any share of the rows.

    weight: the column of table that counts the key's rows; total: the count of all rows. Keys with more than one
    ``share``-th of all rows are fewer than ``share``, so they are broadcast; of the others none is hot.
    """
    key = [key] if isinstance(key, str) else key
    often = F.col(weight) * share > total
    hot, rest = table.where(often).drop(weight), table.where(~often).drop(weight)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key))


def split_words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo: the fold that nothing learns from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
