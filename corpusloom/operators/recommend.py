"""Similar users and items, and single-linkage clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import connected


def check_ratings(cells: DataFrame, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """cells (row, col, value); values outside the scale are refused."""
    if cells.where(~F.col("value").between(low, high) | F.col("value").isNull()).limit(1).count():
        raise ValueError(f"ratings must lie between {low} and {high}")
    return cells


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def cosine_pairs(cells: DataFrame) -> DataFrame:
    """a < b, similarity of all pairs of rows that share a non-zero column; the others' similarity is 0."""
    solid = cells.where(F.col("value") != 0)
    norms = solid.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    rows = solid.join(norms, "row").select("row", "col", (F.col("value") / F.col("norm")).alias("v"))
    return rows.alias("x").join(rows.alias("y"), "col").where("x.row < y.row").groupBy(F.col("x.row").alias("a"), F.col("y.row").alias("b")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("similarity"))


def top_pairs(pairs: DataFrame, n: int = 2) -> DataFrame:
    return pairs.orderBy(F.desc(F.round("similarity", 12)), "a", "b").limit(n)


def linkage_clusters(pairs: DataFrame, threshold: float, members: DataFrame) -> DataFrame:
    """id, cluster (smallest member), name (members joined by +): single linkage stopped below the threshold.

    Groups that single linkage has merged at a threshold are the components of the pairs that reach it; at 0 all are one.
    """
    ids = members.select("id")
    if threshold <= 0:
        labelled = ids.withColumn("cluster", F.min("id").over(Window.partitionBy(F.lit(0))))
    else:
        comps = connected(pairs.where(F.col("similarity") >= threshold), "a", "b")
        labelled = ids.join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("cluster"))
    return labelled


def cluster_names(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: F.concat(F.lit("U"), x.cast("string"))), "+").alias("name"), F.count(F.lit(1)).alias("size"))


def merge_history(similarities: list[list[float]], threshold: float) -> dict:
    """Single linkage on a small matrix, step by step: groups, merges (members, similarity), next_similarity.

    Of equal maxima the first in row order merges; the merged group takes the left place.
    """
    n = len(similarities)
    if any(len(r) != n for r in similarities) or any(abs(similarities[i][j] - similarities[j][i]) > 1e-9 for i in range(n) for j in range(n)):
        raise ValueError("the matrix must be square and symmetric")
    if any(abs(similarities[i][i]) > 1e-9 for i in range(n)) or any(not 0 <= x <= 1 for r in similarities for x in r):
        raise ValueError("similarities lie between 0 and 1, with zeros on the diagonal")
    groups, merges = [[i] for i in range(n)], []
    while len(groups) > 1:
        link, i, j = max(((max(similarities[a][b] for a in groups[i] for b in groups[j]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
        i, j = -i, -j
        if link < threshold:
            return {"groups": groups, "merges": merges, "next_similarity": link}
        merges.append((sorted(groups[i] + groups[j]), link))
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
    return {"groups": groups, "merges": merges, "next_similarity": None}
