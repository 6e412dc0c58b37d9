"""A character trigram model per script: training, baselines on held-out text, deviation of a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLEAN, PROSE_TYPES, CleanConfig
from ..functions import text as X

#: Size of the alphabet: a boundary, 33 Cyrillic and 26 Latin letters, and signs for digits, space and the rest.
ALPHABET = 63
SMOOTHING = 0.1


def encoded(c: Column) -> Column:
    """Lower case; digits as #, white space as one blank, other signs as a full stop, ^ at the start."""
    t = F.regexp_replace(F.regexp_replace(F.lower(X.text_or_empty(c)), "[0-9]", "#"), r"\s+", " ")
    return F.concat(F.lit("^"), F.regexp_replace(t, "[^а-яёa-z# ]", "."))


def trigrams(c: Column) -> Column:
    """Overlapping runs of three signs; the look-ahead makes one pass over the text."""
    return F.regexp_extract_all(encoded(c), F.lit("(?=(.{3}))"), F.lit(1))


SIGNS = "^ #.абвгдежзийклмнопрстуфхцчшщъыьэюяёabcdefghijklmnopqrstuvwxyz"


def coded_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of all trigrams() of all texts, a trigram as its signs' places in SIGNS to base 64."""
    # The lower case of this letter takes two signs; of no other does it change which sign stands for it.
    texts = [t.replace("İ", "i\u0307") for t in texts]
    codes = np.frombuffer("".join("^" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    sign = np.full(int(codes.max(initial=0x500)) + 1, SIGNS.index("."), np.int64)
    seen = np.flatnonzero(np.bincount(codes[codes < 0x500], minlength=1))
    for u in seen.tolist() + [0x212A]:
        low = chr(u).lower()
        if u < len(sign):
            sign[u] = SIGNS.index("#" if low in "#0123456789" else " " if low in " \t\n\x0b\f\r" else low if low in SIGNS[4:] else ".")
    first = np.diff(row, prepend=-1) != 0
    places = np.where(first, 0, sign[codes])
    again = np.zeros(len(codes), bool)  # white space is one blank
    again[1:] = (places[1:] == 1) & (places[:-1] == 1)
    places, row = places[~again], row[~again]
    whole = row[2:] == row[:-2]
    return row[2:][whole], ((places[:-2] * 64 + places[1:-1]) * 64 + places[2:])[whole]


def training_rows(df: DataFrame, cfg: CleanConfig = CLEAN) -> DataFrame:
    return df.withColumn("script", X.script("text")).where(F.col("reliable") & F.col("type").isin(*PROSE_TYPES) & (F.char_length("text") >= cfg.min_train_chars) & (F.col("script") != "none"))


def is_held_out(key: Column, share: float = 0.1) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(65536)) < int(share * 65536)


def train(rows: DataFrame) -> DataFrame:
    """script, g, logp: (count + 0.1) / (context count + 0.1 * alphabet). rows: script, text."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            scripts = np.array(batch.column(0).to_pylist(), object)
            for lo in range(0, len(batch), 256):
                at, code = coded_trigrams(pc.fill_null(batch.column(1).slice(lo, 256), "").to_pylist())
                for kind in dict.fromkeys(scripts[lo : lo + 256]):
                    found = np.bincount(code[(scripts[lo : lo + 256] == kind)[at]], minlength=64**3)
                    sums[kind] = sums[kind] + found if kind in sums else found
        for kind, n in sums.items():
            g = np.flatnonzero(n)
            names = [SIGNS[x >> 12] + SIGNS[x >> 6 & 63] + SIGNS[x & 63] for x in g.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(g), pa.string()), pa.array(names, pa.string()), pa.array(n[g], pa.int64())], ["script", "g", "n"])

    counts = rows.select("script", "text").mapInArrow(run, "script string, g string, n bigint").groupBy("script", "g").agg(F.sum("n").alias("n"))
    context = counts.groupBy("script", F.left("g", F.lit(2)).alias("ctx")).agg(F.sum("n").alias("m"))
    both = counts.withColumn("ctx", F.left("g", F.lit(2))).join(context, ["script", "ctx"])
    return both.select("script", "g", "m", F.log((F.col("n") + SMOOTHING) / (F.col("m") + SMOOTHING * ALPHABET)).alias("logp"))


def score(rows: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """key, lm_score: the mean log probability of a text's trigrams. The model has at most scripts * 63 ** 3 rows and is sent to every task."""
    unseen, tables = float(np.log(SMOOTHING / (SMOOTHING * ALPHABET))), {}
    for kind, g, logp in model.select("script", "g", "logp").toLocalIterator():
        if kind not in tables:
            tables[kind] = np.full(64**3, unseen)
        tables[kind][(SIGNS.index(g[0]) * 64 + SIGNS.index(g[1])) * 64 + SIGNS.index(g[2])] = logp
    sent = rows.sparkSession.sparkContext.broadcast(tables)
    known = rows.select(key, X.script("text").alias("script"), "text")

    def run(batches):
        tables = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                at, code = coded_trigrams(pc.fill_null(part.column(2), "").to_pylist())
                of, logp = np.array(part.column(1).to_pylist(), object), np.full(len(code), unseen)
                for kind in set(of) & set(tables):
                    here = (of == kind)[at]
                    logp[here] = tables[kind][code[here]]
                n = np.bincount(at, minlength=len(part))
                has = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(has), part.column(1).filter(has), pa.array(np.bincount(at, logp, len(part))[n > 0]), pa.array(n[n > 0], pa.int64())], [key, "script", "total", "n"])

    found = known.mapInArrow(run, f"{key} {known.schema[key].dataType.simpleString()}, script string, total double, n bigint")
    return found.groupBy(key, "script").agg((F.sum("total") / F.sum("n")).alias("lm_score"))


def baselines(scored: DataFrame, least: int = 20) -> DataFrame:
    """script, mean, std over held-out texts; (0, 1) where they are too few."""
    s = scored.groupBy("script").agg(F.count(F.lit(1)).alias("n"), F.avg("lm_score").alias("m"), F.stddev_pop("lm_score").alias("s"))
    few = (F.col("n") < least) | (F.col("s") == 0)
    return s.select("script", F.when(few, 0.0).otherwise(F.col("m")).alias("mean"), F.when(few, 1.0).otherwise(F.col("s")).alias("std"))


def deviations(scored: DataFrame, base: DataFrame) -> DataFrame:
    return scored.join(base, "script", "left").withColumn("deviation", (F.col("lm_score") - F.coalesce("mean", F.lit(0.0))) / F.coalesce("std", F.lit(1.0)))
