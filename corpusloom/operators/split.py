"""Splitting a corpus into text, tables, chemical and mathematical formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK, FURNITURE_TYPES, PROSE_TYPES, ChunkConfig
from ..functions import chem, latex
from ..functions import text as X

CATEGORIES = ("text", "formulas_chem", "formulas_math", "tables")
#: Short strings that are marks, not formulas (fixed values).
TECHNICAL = (
    r"^[0-9]{2,4}$", r"^\(\s*[0-9]+(?:[.\-–][0-9]+)*\s*\)$", r"^[PpСс]\.?\s*[0-9]+$", r"^[-0-9]+\s*[PpСс]\.?\s*[0-9]*$", r"^[A-ZА-Я]{1,3}[0-9]+[A-ZА-ЯХ0-9-]*$",
    r"^[A-ZА-Я]{2,}\s*[0-9.-]+$", r"^[A-Za-zА-Яа-я]+[0-9]+/[0-9]+[A-Za-zА-Яа-я]*$", r"^IT[0-9]+$", r"^Ra\s+[0-9.]+", r"^Rz\s+[0-9]+", r"^M[0-9]+x[0-9.]+$",
    r"^Tr[0-9]+x[0-9]+", r"^G\s+[0-9]", r"^[ⓘ∥⟂⌒/○/]\s*[0-9.]+",
)


def is_technical(c: Column) -> Column:
    t = F.trim(X.text_or_empty(c))
    return (t == "") | t.rlike("(?i)" + "|".join(TECHNICAL))


def with_sections(blocks: DataFrame) -> DataFrame:
    """section: the text of the last heading; a heading has its own."""
    w = Window.partitionBy("doc_id").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(F.col("type") == "Title", F.col("text")), ignorenulls=True).over(w), F.lit("")))


def with_context(blocks: DataFrame, cfg: ChunkConfig = CHUNK) -> DataFrame:
    """context: prose of up to ``context_blocks`` blocks on either side, clipped."""
    w = Window.partitionBy("doc_id").orderBy("order")
    prose = F.when(F.col("type").isin("Title", *PROSE_TYPES), F.col("text"))
    around = [F.collect_list(prose).over(w.rowsBetween(a, b)) for a, b in ((-cfg.context_blocks, -1), (1, cfg.context_blocks))]
    return blocks.withColumn("context", F.left(F.trim(F.regexp_replace(F.array_join(F.concat(*around), " "), r"\s+", " ")), F.lit(cfg.context_chars)))


def long_context(blocks: DataFrame, before: int = 2, after: int = 5, enough: int = 250) -> DataFrame:
    """context for reclassification: two blocks before, and blocks after until one is longer than ``enough``."""
    w = Window.partitionBy("doc_id").orderBy("order")
    left = F.collect_list("text").over(w.rowsBetween(-before, -1))
    right = F.collect_list("text").over(w.rowsBetween(1, after))
    taken = F.aggregate(
        right,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done")),
        lambda acc, t: F.struct(F.when(acc.done, acc.kept).otherwise(F.concat(acc.kept, F.array(t))).alias("kept"), (acc.done | (F.char_length(t) > enough)).alias("done")),
        lambda acc: acc.kept,
    )
    return blocks.withColumn("context", F.array_join(F.concat(left, taken), " "))


def prose_subtype(c: Column, is_chemical: Column, prose: Column) -> Column:
    """nomenclature or caption if an equation block is in truth prose, else null. prose: share of long words."""
    t = X.text_or_empty(c)
    relation, operator = t.rlike(r"[=≤≥<>≈]|\\(?:le|ge|approx)"), t.rlike(r"[+*/^·⋅×∑∫]|\\(?:frac|sqrt|sum|int|cdot)")
    listed = t.rlike(r"^\s*\S(?:.{0,13})\s*[=—–-]\s*(?:[^\W\d_]{2,}[\s,]*){2,}")
    return (
        F.when(is_chemical, None)
        .when((prose <= 0.5) & listed & (prose > 0.45) & ~operator, "nomenclature")
        .when(prose <= 0.5, None)
        .when(relation & operator, None)
        .when(relation, "nomenclature")
        .otherwise("caption")
    )


def route(blocks: DataFrame) -> DataFrame:
    """category per block (null: left out), with section, context, latex, equation number and the reason."""
    df = with_context(with_sections(blocks))
    equation = F.col("type").startswith("Formula")
    # The three UDFs run on every row of a batch; what they say counts for equations only.
    df = df.withColumn("c", latex.canonical_latex(F.when(equation, F.col("text")))).withColumn("latex", F.col("c.latex")).withColumn("eq_number", F.col("c.number")).drop("c")
    df = df.withColumn("parsed", chem.chemical_parse("latex")).withColumn("prose", latex.prose_share_of(F.when(equation, F.col("text"))))
    chemical = F.col("parsed.is_equation") | (F.size("parsed.species") > 0) & (F.col("parsed.junk") == 0) & F.col("parsed.subscripted")
    subtype = prose_subtype(F.col("text"), chemical, F.col("prose"))
    solid = F.trim("text") != ""
    reason = (
        F.when(F.col("type").isin(*FURNITURE_TYPES), "furniture")
        .when((F.col("type") == "Table") & (solid | F.col("table_html").isNotNull()), "tables")
        .when(F.col("type").isin("Title", *PROSE_TYPES, "UncategorizedText"), F.when(solid, "text").otherwise("empty"))
        .when(equation & ((F.col("latex") == "") | is_technical(F.col("latex"))), "empty")
        .when(equation & subtype.isNotNull(), F.concat(F.lit("prose:"), subtype))
        .when(equation, F.when(chemical, "formulas_chem").otherwise("formulas_math"))
        .otherwise("skipped")
    )
    df = df.withColumn("route", reason)
    category = F.when(F.col("route").isin(*CATEGORIES), F.col("route")).when(F.col("route").startswith("prose:"), "text")
    return df.withColumn("split_category", category).drop("parsed", "prose")


def rule_or_model(rule: Column, model: Column, runner_up: Column, has_species: Column) -> Column:
    """The rule's class, else the model's; chemistry from the model only where a substance is present."""
    return F.coalesce(rule, F.when((model == "chemistry") & ~has_species, runner_up).otherwise(model), F.lit("math"))


def write_split(routed: DataFrame, path: str) -> None:
    routed.where(F.col("split_category").isNotNull()).repartition("split_category", "doc_id").sortWithinPartitions("doc_id", "order").write.partitionBy("split_category").parquet(path)


def manifest(routed: DataFrame) -> DataFrame:
    """Counts by route and by document."""
    return routed.groupBy("doc_id", "route").agg(F.count(F.lit(1)).alias("blocks"))


def reunite(parts: dict[str, DataFrame]) -> DataFrame:
    """Category tables as one block table in reading order."""
    out = None
    for name, part in parts.items():
        part = part.withColumn("split_category", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("doc_id", "order")


# Recognised formulas.


def recognition_reason(df: DataFrame, max_height: float = 160.0) -> Column:
    """Why a formula block should be recognised again; null if it need not."""
    t = F.trim(X.text_or_empty("text"))
    height = F.col("bottom") - F.col("top")
    citation = t.rlike(r"^\[[0-9,;\s–-]+\]$")
    return F.when(F.col("top").isNotNull() & (height <= max_height) & ~citation, F.when(t.rlike(r"^\(?\s*[0-9]+(?:[.\-–][0-9]+)*\s*\)?$"), "bare_number").when(t.rlike(r"\(cid:[0-9]+\)"), "cid").when(F.col("text_source") != "text_layer", "source"))


def latest(records: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_recognised(blocks: DataFrame, recognised: DataFrame) -> DataFrame:
    """Blocks with accepted texts; text_original keeps the first one. recognised: block_id, latex, at."""
    got = latest(recognised, ["block_id"], "at").select("block_id", F.col("latex").alias("_new"))
    df = blocks.join(got, "block_id", "left").withColumn("_d", F.when(F.col("_new").isNotNull(), latex.decide_replacement("text", "_new")))
    original = F.col("text_original") if "text_original" in blocks.columns else F.lit(None).cast("string")
    replaced = F.col("_d.decision") == "replace"
    df = df.withColumn("text_original", F.coalesce(original, F.when(replaced, F.col("text"))))
    return df.withColumn("text", F.when(replaced, F.col("_d.text")).otherwise(F.col("text"))).withColumn("ocr_decision", F.col("_d.decision")).withColumn("ocr_reason", F.col("_d.reason")).drop("_new", "_d")


def decision_counts(df: DataFrame) -> DataFrame:
    return df.where(F.col("ocr_decision").isNotNull()).groupBy("ocr_decision", "ocr_reason").agg(F.count(F.lit(1)).alias("n"))


def label_moves(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.where(F.col(old) != F.col(new)).groupBy(old, new).agg(F.count(F.lit(1)).alias("n"))
