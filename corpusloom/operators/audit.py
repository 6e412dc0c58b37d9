"""Reports over a cleaned block table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chars() -> Column:
    return F.char_length("text_out").cast("bigint")


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(F.col("keep").cast("bigint")).alias("kept"),
        F.countDistinct("doc_id").alias("documents"),
        F.sum(F.char_length("text").cast("bigint")).alias("chars_in"),
        F.sum(F.when(F.col("keep"), _chars()).otherwise(0)).alias("chars_kept"),
    )


def by_reason(df: DataFrame) -> DataFrame:
    return df.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("blocks"), F.sum(_chars()).alias("chars"))


def by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("was"), F.sum(F.col("keep").cast("bigint")).alias("left"), F.sum(F.when(F.col("keep"), _chars()).otherwise(0)).alias("chars"))


def by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("text_source").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("keep").cast("bigint")).alias("kept"))


def score_bands(df: DataFrame, bands: int = 10) -> DataFrame:
    """Blocks that are not reliable, by band of their score; a score of 1 falls in the last band."""
    band = F.least(F.floor(F.col("garbage_score") * bands), F.lit(bands - 1)).cast("int")
    return df.where(~F.col("reliable")).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("blocks"), F.sum((~F.col("keep")).cast("bigint")).alias("dropped"))


def worst_documents(df: DataFrame, least_blocks: int = 50, n: int = 20) -> DataFrame:
    """The documents that keep the smallest share of their blocks."""
    docs = df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("keep").cast("bigint")).alias("kept"))
    return docs.where(F.col("blocks") >= least_blocks).withColumn("share", F.round(F.col("kept") / F.col("blocks"), 6)).orderBy("share", "doc_id").limit(n)


def artifact_count(df: DataFrame, pattern: str = r"\(cid:[0-9]+\)") -> DataFrame:
    return df.where("keep").agg(F.coalesce(F.sum(F.regexp_count("text_out", F.lit(pattern))), F.lit(0)).alias("artifacts"))


def hash_sample(df: DataFrame, n: int, key: str = "block_id") -> DataFrame:
    """A repeatable sample: the first n rows in order of a hash of the key."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def most_merged(df: DataFrame, n: int = 10) -> DataFrame:
    return df.where("keep").withColumn("parts", F.size(F.coalesce("merged_ids", F.array().cast("array<string>")))).orderBy(F.desc("parts"), "block_id").limit(n)


def share_text(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole)).otherwise("—")


def cell_text(c: Column, width: int = 80) -> Column:
    """A Markdown table cell: pipes escaped, line ends marked, cut with an ellipsis."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ⏎ ")
    return F.when(F.char_length(t) > width, F.concat(F.left(t, F.lit(width - 1)), F.lit("…"))).otherwise(t)


def report(df: DataFrame) -> str:
    """The Markdown report; every section is one small aggregate."""
    sections = (("Totals", totals(df)), ("By reason", by_reason(df).orderBy(F.desc("blocks"))), ("By type", by_type(df).orderBy(F.desc("was"))), ("By text source", by_source(df)), ("Worst documents", worst_documents(df)))
    out = ["# Cleaning report"]
    for title, rows in sections:
        out += ["", f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join(out) + "\n"


# Evaluation of labelled samples.

Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The 95 % interval of a share, clipped to [0, 1], 3 digits."""
    p, zz = hits / n, z * z
    centre, spread = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - spread), 3)).otherwise(0.0), F.when(n > 0, F.round(F.least(F.lit(1.0), centre + spread), 3)).otherwise(1.0)


def lower_quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by the lower-index rule: the value at position floor(q * n) in order. Ranks come from a window; nothing is collected into one row."""
    w = Window.partitionBy(by)
    ranked = df.where(F.col(value).isNotNull()).select(by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    picks = [F.max(F.when(F.col("i") == F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col(value))).alias(name) for name, q in shares.items()]
    return ranked.groupBy(by).agg(F.first("n").alias("n"), *picks, F.avg(value).alias("mean"))


def stratified_sample(df: DataFrame, stratum: str, size: int, key: str, seed: int = 42) -> DataFrame:
    """size // strata rows of each stratum, the first in order of a seeded hash."""
    strata = max(1, df.select(stratum).distinct().count())
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size // strata).drop("_n")


def weighted_scores(df: DataFrame, stratum: str, size: str, predicted: str, truth: str) -> DataFrame:
    """Precision, recall and F1 with each stratum's rates weighted by its size; predicted and truth are booleans."""
    rate = lambda c: F.avg(c.cast("double"))
    per = df.groupBy(stratum).agg(F.max(size).alias("s"), rate(F.col(predicted) & F.col(truth)).alias("h"), rate(F.col(predicted)).alias("p"), rate(F.col(truth)).alias("t"))
    sums = per.agg(*[F.sum(F.col("s") * F.col(c)).alias(c) for c in "hpt"])
    p, r = F.col("h") / F.greatest("p", F.lit(1e-9)), F.col("h") / F.greatest("t", F.lit(1e-9))
    return sums.select(F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 3).alias("f1"))


def run_summary(runs: DataFrame, variant: str, failed: Column, seconds: Column, score: Column) -> DataFrame:
    """Runs, errors and the means over runs that did not fail."""
    return runs.groupBy(variant).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(failed.cast("bigint")).alias("errors"), F.avg(F.when(~failed, seconds)).alias("seconds"), F.avg(F.when(~failed, score)).alias("score")
    )


def answer_modes(records: DataFrame, weak: float = 0.8) -> DataFrame:
    """Answers by mode: number, share, mean judge score, and how many need a look."""
    flagged = F.col("mode").isin("no_evidence", "hybrid_partial") | (F.col("score") < weak)
    per = records.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.sum(flagged.cast("bigint")).alias("flagged"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
