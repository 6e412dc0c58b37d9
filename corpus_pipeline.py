"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of documents, whatever they are called; the last returns packed rows of token ids.
In every stage an empty table gives an empty table, whole texts of any length are read, and columns beyond
doc_id, text, lang and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard_join, mixing, packing, quality_classifier
from corpusloom.llm.common import discard, materialise, table

#: Not all stages can be said in SQL (trained scores, token ids); tests hold each against brute force.
ORACLE_SQL = None


def _row(docs: DataFrame):
    """All columns in one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts have the score of a text without n-grams. Repeated rows are judged each on their own."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    judged = quality_classifier.score(docs.select(_row(docs)), model, text="row.text")  # so that waiting rows hold each text once
    return judged.where(F.col("score") >= quality_classifier.THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: that with the smallest doc_id, of several of them that with the smallest hash of its text.

    Rows are told apart by doc_id and text, so another text under the same doc_id is judged on its own. Of rows equal
    in both one stays. Rows with a null doc_id stay, and so do null and empty texts, which link with nothing.
    """
    found = materialise(jaccard_join.jaccard_classes(docs), "classes")
    heads = found.where(F.col("doc_id") == F.col("component_id")).groupBy("cluster").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))
    others = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "text_hash")
    twins = found.where(F.col("doc_id") == F.col("component_id")).join(heads.where(F.col("least") != F.col("most")), "cluster").where(F.col("text_hash") != F.col("least"))
    gone = others.union(twins.select("doc_id", "text_hash")).distinct()
    repeats = materialise(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "repeats")
    keys = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    kept = docs.select(_row(docs), *keys).join(gone, ["doc_id", "text_hash"], "left_anti")
    if not repeats.isEmpty():
        twice = kept.join(repeats, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(repeats, ["doc_id", "text_hash"], "left_anti").unionByName(twice)
    return kept.select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test window. Null and empty texts have none; repeated rows are judged each on their own."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, once per epoch that takes them. A null language or source is a leaf of its own; a
    leaf of null and empty texts alone has no tokens to draw. Rows with one doc_id share a place in the order."""
    needed = [c for c in ("doc_id", "text", "lang", "source", "domain") if c in docs.columns]
    return mixing.select(docs.select(_row(docs), *needed), mixing.WEB_MIX).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids. Null and empty texts have none; repeated rows, as several epochs make them, are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder, read by the next and deleted once that is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
