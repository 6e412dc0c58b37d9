"""Mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source; a leaf is one combination that occurs. Weights are
given per node (missing: 1) and propagate downwards as shares of the parent's budget. A node
never gets more than its leaves can supply in ``max_epochs`` passes; what it cannot
take goes to its siblings by their weights, and only what a whole family cannot take goes
up to the parent's siblings. A leaf's budget is met by whole epochs and then by a prefix of
the next epoch's order, which is a hash of seed, epoch and document: the longest prefix
whose tokens fit. Runs with the same seed choose the same documents, and a larger budget extends a smaller one.

Tokens are counted once, by the tokenizer that packing uses, into a narrow table (leaf, id, tokens). Budgets go down
the tree level by level, each an aggregation over the families of that level, so a tree may have any number of leaves.
A prefix is a limit on the place in the order: the 4096th of a leaf's places in which its budget ends is found by sums,
then the 4096th of that, and only the few places left are put in exact order. The documents themselves pass
through one filter; no text is shuffled for a leaf with more than a ``SENT_LEAVES``-th of all rows.

Null domain, language or source is the value ''. Null text has no tokens; a document of no
tokens is taken wherever its place falls within the prefix. Repeated rows share a place in the order and stand or fall together.
An empty table gives no rows. Columns called like the operator's own are kept apart from them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, materialise, table
from .packing import default_vocabulary, token_ids

#: Leaves sent to the rows: those with the most rows; of the others none has more than a SENT_LEAVES-th of them.
SENT_LEAVES = 50_000

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """weights: by node path, e.g. ("d1",), ("d1", "en") or ("d1", "en", "src1"). total: tokens; or share of what there is."""

    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    total: int | None = None
    share: float = 0.8
    max_epochs: float = 2.0
    seed: int = 17


def site_domain() -> Column:
    """The domain of a source: its number modulo 4, as this corpus has no domains of its own."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d+)$", 1)
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.lit("d"), (F.substring(number, -9, 9).cast("int") % 4).cast("string")))


def with_tokens(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """rows, whose text column gives way to ``tokens``: its number of token ids."""
    path, kept = vocabulary or default_vocabulary(), [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [len(token_ids(text.as_py(), path, np.dtype("<u4"))) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(tokens, pa.int64())], names=[*kept, "tokens"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, tokens bigint")


def _weights(spark: SparkSession, mix: Mix, depth: int) -> DataFrame:
    """The weights given for one level; as many rows as the caller has written down."""
    names = LEVELS[:depth]
    given = [(*k, float(w)) for k, w in mix.weights.items() if len(k) == depth]
    return spark.createDataFrame(given, ", ".join(f"{n} string" for n in names) + ", weight double")


def water_fill(nodes: DataFrame, family: tuple[str, ...]) -> DataFrame:
    """nodes (family, weight, capacity, budget of the family) with ``given``: what a full node cannot take goes to the others by weight.

    The level at which a node is full is capacity / weight. With the nodes in this order, a family's level is where
    the capacities of those before and the weights of the rest use up its budget.
    """
    live, zero = (F.col("weight") > 0) & (F.col("capacity") > 0), F.lit(0.0)
    order = Window.partitionBy(*family).orderBy("_full", *[c for c in LEVELS if c not in family and c in nodes.columns])
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = nodes.withColumn("_w", F.when(live, F.col("weight")).otherwise(zero)).withColumn("_c", F.when(live, F.col("capacity")).otherwise(zero))
    filled = filled.withColumn("_full", F.when(live, F.col("capacity") / F.col("weight")).otherwise(zero))
    # The level if those before are full and this node and all after it are open; the first node that it does not fill decides.
    filled = filled.withColumn("_level", F.when(live, (F.col("budget") - F.coalesce(F.sum("_c").over(before), zero)) / F.sum("_w").over(after)))
    filled = filled.withColumn("_at", F.first(F.when(F.col("_level") < F.col("_full"), F.greatest("_level", zero)), ignorenulls=True).over(whole))
    given = F.when(~live, zero).when(F.col("_at").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("weight") * F.col("_at")))
    return filled.withColumn("given", given).drop("_w", "_c", "_full", "_level", "_at")


def budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """supply (domain, lang, source, tokens) with ``budget``: tokens for each leaf."""
    spark = supply.sparkSession
    level = supply.withColumn("capacity", F.col("tokens") * F.lit(float(mix.max_epochs)))
    levels = {}
    for depth in (3, 2, 1):  # below a node of weight 0 there is nothing to take
        names = list(LEVELS[:depth])
        level = level.groupBy(*names).agg(F.sum("capacity").alias("capacity")).join(F.broadcast(_weights(spark, mix, depth)), names, "left")
        level = level.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        levels[depth] = level
        level = level.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))
    total = mix.total if mix.total is not None else int(mix.share * (supply.agg(F.sum("tokens")).first()[0] or 0))
    above = levels[1].withColumn("budget", F.lit(float(total)))
    for depth in (1, 2, 3):
        nodes = above if depth == 1 else levels[depth].join(above, list(LEVELS[: depth - 1]))
        above = water_fill(nodes, LEVELS[: depth - 1]).select(*LEVELS[:depth], F.col("given").alias("budget"))
        above = materialise(above, "budgets")
    return supply.join(above.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long")), list(LEVELS))


def _place(mix: Mix, epoch: Column) -> Column:
    return F.xxhash64(F.lit(mix.seed), epoch, F.col("id"))


def prefix_limits(narrow: DataFrame, planned: DataFrame, mix: Mix) -> DataFrame:
    """planned (leaf, rows, whole, rest) with ``limit``: places below it fit into the rest (null: all do).

    Places are compared as unsigned numbers would be, by their leading and following 12 bits and then as they are.
    """
    leaf = list(LEVELS)
    due = _join_leaf(narrow, planned).where(F.col("rest") > 0).withColumn("place", _place(mix, F.col("whole"))).withColumn("high", F.shiftright("place", 52))
    due = due.withColumn("low", F.shiftright("place", 40))

    def cut(rows: DataFrame, key: str) -> DataFrame:
        """Per leaf the value of key in which the rest ends, and what is left of the rest before it."""
        sums = rows.groupBy(*leaf, key).agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
        to = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy(key))  # at most 4096 rows a leaf
        over = sums.withColumn("to", to).where(F.col("to") > F.col("rest")).groupBy(*leaf)
        return materialise(over.agg(F.min(key).alias(key), F.min_by(F.col("rest") - F.col("to") + F.col("tokens"), key).alias("rest"), F.min_by("tokens", key).alias("rows")), "cuts")

    first = cut(due, "high").withColumnRenamed("high", "cut")
    within = _join_leaf(due.drop("rest"), first).where(F.col("high") == F.col("cut")).drop("cut")
    second = cut(within, "low").withColumnRenamed("low", "cut")
    last = _join_leaf(within.drop("rest"), second).where(F.col("low") == F.col("cut"))
    to = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("place"))
    limits = last.withColumn("to", to).where(F.col("to") > F.col("rest")).groupBy(*leaf).agg(F.min("place").alias("limit"))
    return planned.join(limits, leaf, "left")


def _join_leaf(rows: DataFrame, per_leaf: DataFrame) -> DataFrame:
    """Inner join on the leaf. The leaves with the most rows are sent out, the others are joined by shuffle."""
    leaf = list(LEVELS)
    most = per_leaf.orderBy(F.desc("rows"), *leaf).limit(SENT_LEAVES)
    per = per_leaf.drop("rows")
    if per_leaf.limit(SENT_LEAVES + 1).count() <= SENT_LEAVES:
        return rows.join(F.broadcast(per), leaf)
    hot, rest = most.drop("rows"), per_leaf.join(F.broadcast(most.select(*leaf)), leaf, "left_anti").drop("rows")
    return rows.join(F.broadcast(hot), leaf).unionByName(rows.join(F.broadcast(hot.select(*leaf)), leaf, "left_anti").join(rest, leaf))


def select(documents: DataFrame, mix: Mix = Mix(), domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows chosen, once for each epoch that takes them: the columns of documents and ``mix_leaf`` (struct), ``mix_epoch``.

    tokens: a count of one's own; without it the tokenizer's count is taken.
    """
    own = domain if domain is not None else F.col("domain").cast("string") if "domain" in documents.columns else site_domain()
    leaf = [F.coalesce(own, F.lit("")).alias("domain"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]]]
    counted = documents.select(*leaf, F.col("doc_id").alias("id"), (F.col("text") if tokens is None else tokens.cast("long").alias("tokens")))
    narrow = materialise(with_tokens(counted), "mix-tokens", TEXT_ROWS) if tokens is None else materialise(counted, "mix-tokens")
    supply = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    supply = materialise(supply, "supply")
    planned = budgets(supply, mix).where(F.col("tokens") > 0)
    planned = planned.select(*LEVELS, "rows", F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"))
    limited = materialise(prefix_limits(narrow, materialise(planned, "mix-plan"), mix), "mix-limits")
    # The caller's columns travel in one struct, so names cannot clash.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *leaf, F.col("doc_id").alias("id"))
    due = _join_leaf(rows, limited)
    inside = (F.col("rest") > 0) & (F.col("limit").isNull() | (_place(mix, F.col("whole")) < F.col("limit")))
    epochs = F.when(inside, F.sequence(F.lit(0).cast("long"), F.col("whole"))).when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))
    return due.withColumn("mix_epoch", F.explode(epochs)).select("row.*", F.struct(*LEVELS).alias("mix_leaf"), "mix_epoch")


#: Domains 4:3:2:1, English twice the other languages, all sources alike; 80 % of the corpus in at most 2 epochs.
WEB_MIX = Mix({("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0} | {(f"d{i}", "en"): 2.0 for i in range(4)})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select(table(spark, sf_dir, "documents"), WEB_MIX)
    return chosen.select("doc_id", "mix_leaf.*", F.col("mix_epoch").alias("epoch"))
