"""Connected components of an edge table: in one task where the edges are few, else by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that one task holds at most (16 bytes each, and as much again for the ends); more are worked in rounds, with the same result.
ONE_TASK = 1 << 20


def _union_find(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = list(parent)
    for start in range(0, len(ids), 65536):
        part = ids[start : start + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["id", "comp"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, comp) for every end of an edge that is not alone; comp is the component's smallest id. Ids are bigints.

    In rounds, minima are taken with map-side combining and joins are plain equi-joins, so a vertex with very
    many edges is no single task's work. Each round is written to the shared folder. Null ends
    and loops are ignored; an empty table gives no rows.
    """
    e = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).cast("bigint").alias("u"), F.least(u, v).cast("bigint").alias("v"))
    e = materialise(e, "edges")
    if e.count() <= ONE_TASK:
        return e.coalesce(1).mapInArrow(_union_find, "id bigint, comp bigint")
    e = materialise(e.distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        before = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "edges")
