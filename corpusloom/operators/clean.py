"""Corpus cleaning: soft deletion of blocks, in a fixed order of stages.

Each stage takes and returns the block table; a dropped row keeps its data, has keep = false
and a drop_reason ('' for kept rows). Order matters: noise, then furniture and captions,
then boilerplate, merging of fragments, orphans, exact duplicates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CAPTION_TYPES, CLEAN, FURNITURE_TYPES, MERGEABLE_TYPES, CleanConfig
from ..functions import text as X
from .storage import by_document, written


def drop(df: DataFrame, when: Column, reason: str) -> DataFrame:
    """Kept rows for which the condition holds are dropped for that reason."""
    hit = F.col("keep") & F.coalesce(when, F.lit(False))
    return df.withColumn("drop_reason", F.when(hit, reason).otherwise(F.col("drop_reason"))).withColumn("keep", F.col("keep") & (F.col("drop_reason") == ""))


def prepare(blocks: DataFrame, unicode: bool = True) -> DataFrame:
    """text_out, key, keep and drop_reason. With unicode = False the text is taken as it is and keys stay in the JVM."""
    text_out = X.clean_text("text") if unicode else F.trim(X.text_or_empty("text"))
    df = blocks.withColumn("text_out", text_out)
    df = df.withColumn("key", X.norm_key("text_out") if unicode else X.plain_key("text_out"))
    filled = (F.col("text_out") != "") | (F.coalesce("table_html", F.lit("")) != "")
    return df.withColumn("keep", filled).withColumn("drop_reason", F.when(filled, "").otherwise("empty"))


def with_noise(df: DataFrame, cfg: CleanConfig = CLEAN, deviation: Column | None = None) -> DataFrame:
    """Signal columns, garbage_score and garbage_reason."""
    df = df.withColumn("deviation", deviation if deviation is not None else F.lit(None).cast("double"))
    df = df.withColumn("_signals", X.signal_values("text_out"))
    df = df.withColumns({name: F.col(f"_signals.{name}") for name in X.SIGNALS}).drop("_signals")
    score, reason = X.noise_score(F.col("type"), F.char_length("text_out"), cfg.min_lm_chars)
    return df.withColumn("garbage_score", score).withColumn("garbage_reason", reason)


def drop_noise(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    return drop(df, ~F.col("reliable") & (F.col("garbage_score") >= cfg.garbage_threshold), "garbage")


def drop_furniture(df: DataFrame) -> DataFrame:
    return drop(df, F.col("type").isin(*FURNITURE_TYPES), "furniture")


def drop_captions(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    return drop(df, F.col("type").isin(*CAPTION_TYPES) & X.caption_only("text_out", cfg.caption_max_chars), "caption_only")


def boilerplate_lines(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    """doc_id, key, pages, doc_pages, blocks of short lines and furniture that repeat over a document's pages."""
    kept = df.where("keep")
    short = F.col("type").isin(*FURNITURE_TYPES) | (F.char_length("text_out") <= cfg.boilerplate_max_chars)
    pages = kept.groupBy("doc_id").agg(F.countDistinct("page").alias("doc_pages"))
    lines = kept.where(short & (F.col("key") != "")).groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("blocks"))
    return lines.where(F.col("pages") >= cfg.boilerplate_min_pages).join(pages, "doc_id").where(F.col("pages") >= cfg.boilerplate_min_share * F.col("doc_pages"))


def drop_boilerplate(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    lines = boilerplate_lines(df, cfg).select("doc_id", "key", F.lit(True).alias("boiler"))
    short = F.col("type").isin(*FURNITURE_TYPES) | (F.char_length("text_out") <= cfg.boilerplate_max_chars)
    return drop(df.join(lines, ["doc_id", "key"], "left"), short & F.col("boiler"), "boilerplate").drop("boiler")


def drop_orphans(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    return drop(df, (F.col("type") == "UncategorizedText") & (F.char_length("text_out") <= cfg.orphan_max_chars), "orphan")


def drop_exact_duplicates(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    """Of equal keys within a document the first in order stays; the others name it in merged_into."""
    long = F.col("keep") & (F.char_length("text_out") >= cfg.duplicate_min_chars)
    w = Window.partitionBy("doc_id", F.when(long, F.col("key")), long).orderBy("order")
    df = df.withColumn("_first", F.when(long, F.first("block_id").over(w))).withColumn("_nth", F.when(long, F.row_number().over(w)))
    into = F.when(F.col("_nth") > 1, F.col("_first")).otherwise(F.col("merged_into") if "merged_into" in df.columns else F.lit(None).cast("string"))
    return drop(df.withColumn("merged_into", into), F.col("_nth") > 1, "duplicate").drop("_first", "_nth")


# Merging of fragments: a left fold over a document's blocks, as merged text decides what comes next.

_TERMINAL, _HYPHENS = ".!?:;»\"”", "-‐‑–"


def merge_rule(a: dict, b: dict, height: float, cfg: CleanConfig = CLEAN) -> str | None:
    """Why block b continues block a: hyphen, same_line, paragraph, cross_page; None if it does not."""
    ta, tb = a["text_out"].rstrip(), b["text_out"].lstrip()
    if not ta or not tb:
        return None
    low = next((c.islower() for c in tb if c.isalpha()), False)
    open_end = ta[-1] not in _TERMINAL
    if ta[-1] in _HYPHENS and low:  # on any page: a word torn apart is never meant so
        return "hyphen"
    fragment = any(x["type"] == "UncategorizedText" or (x["type"] in MERGEABLE_TYPES and len(x["text_out"]) <= cfg.fragment_max_chars) for x in (a, b))
    boxed = all(not pd.isna(x[c]) for x in (a, b) for c in ("x0", "top", "x1", "bottom"))
    if a["page_max"] == b["page"] and boxed:
        if not fragment:
            return None
        v = min(a["bottom"], b["bottom"]) - max(a["top"], b["top"])
        if v / max(1e-6, min(a["bottom"] - a["top"], b["bottom"] - b["top"])) >= cfg.same_line_overlap:
            width = max((x["x1"] - x["x0"]) / max(1, len(x["text_out"])) for x in (a, b))
            if width > 0 and 0 <= b["x0"] - a["x1"] <= cfg.same_line_gap * width:
                return "same_line"
        gap, h = b["top"] - a["bottom"], min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
        near = -height <= gap <= cfg.paragraph_gap * height
        over = h / max(1e-6, min(a["x1"] - a["x0"], b["x1"] - b["x0"])) >= cfg.paragraph_overlap
        return "paragraph" if near and over and open_end and low else None
    return "cross_page" if b["page"] == a["page_max"] + 1 and open_end and low else None


def merge_document(rows: list[dict], cfg: CleanConfig = CLEAN) -> list[dict]:
    """The rows of one document in order, with fragments merged into the block they continue."""
    rows = sorted(rows, key=lambda r: r["order"])
    heights: dict[int, list[float]] = {}
    for r in rows:
        r |= {"merged_into": None, "merged_ids": [], "merge_rule": None, "page_min": r["page"], "page_max": r["page"]}
        if not pd.isna(r["top"]) and r["bottom"] - r["top"] > 0:
            heights.setdefault(r["page"], []).append(r["bottom"] - r["top"])
    line = {p: float(pd.Series(h).median()) for p, h in heights.items()}
    tail, blocked = None, False
    for r in rows:
        if not r["keep"]:
            continue
        mergeable = r["type"] in MERGEABLE_TYPES
        rule = merge_rule(tail, r, line.get(r["page"], cfg.default_line_height), cfg) if tail and not blocked and mergeable else None
        if rule:
            ta, tb = tail["text_out"].rstrip(), r["text_out"].lstrip()
            tail["text_out"] = ta[:-1] + tb if rule == "hyphen" else f"{ta} {tb}"
            if tail["type"] == "UncategorizedText":
                tail["type"] = r["type"]
            if r["page"] == tail["page_max"]:
                for c, f in (("x0", min), ("top", min), ("x1", max), ("bottom", max)):
                    if not pd.isna(tail[c]) and not pd.isna(r[c]):
                        tail[c] = f(tail[c], r[c])
            tail["page_max"], tail["reliable"] = max(tail["page_max"], r["page"]), tail["reliable"] and r["reliable"]
            tail["merged_ids"].append(r["block_id"])
            r |= {"keep": False, "drop_reason": "merged", "merged_into": tail["block_id"], "merge_rule": rule}
        elif mergeable:
            tail, blocked = r, False
        else:
            blocked = True
    return rows


MERGED = "block_id string, doc_id string, `order` int, page int, page_min int, page_max int, type string, text_out string, keep boolean, drop_reason string, merged_into string, merged_ids array<string>, merge_rule string"


def merge_fragments(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    """A document's fold needs its blocks in order and nothing else."""
    columns = ["block_id", "doc_id", "order", "page", "type", "text_out", "keep", "drop_reason", "reliable", "x0", "top", "x1", "bottom"]
    return by_document(df.select(*columns), lambda rows: merge_document(rows, cfg), MERGED)


def clean(blocks: DataFrame, cfg: CleanConfig = CLEAN, unicode: bool = True, merge: bool = True) -> DataFrame:
    """The whole pipeline. The scored blocks are written once: every later stage would work out the scores anew."""
    df = written(drop_noise(with_noise(prepare(blocks, unicode), cfg), cfg))
    df = drop_boilerplate(drop_captions(drop_furniture(df), cfg), cfg)
    if merge:
        merged = merge_fragments(df, cfg).select("block_id", *[F.col(c).alias(f"m_{c}") for c in ("text_out", "type", "keep", "drop_reason", "merged_into", "merged_ids", "page_min", "page_max")])
        df = df.drop("text_out", "type", "keep", "drop_reason").join(merged, "block_id")
        df = df.select(*[F.col(c).alias(c.removeprefix("m_")) for c in df.columns])
        df = df.withColumn("key", X.norm_key("text_out") if unicode else X.plain_key("text_out"))
    return drop_exact_duplicates(drop_orphans(df, cfg), cfg)
