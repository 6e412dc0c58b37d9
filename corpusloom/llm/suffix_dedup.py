"""Suffix-array de-duplication: repeated strings of 100 bytes and more, by a distributed difference-cover algorithm.

Distribution. Every window of ``LENGTH`` bytes is routed by the least hash of the ``SEED``-byte strings in it,
so equal windows always meet, wherever they stand. Neighbouring windows with the same least hash travel as one
piece of text. Pieces whose hash occurs once in the corpus cannot repeat and stay where they are; a hash that is frequent within
one batch of one task needs no counting and sends a single row to be counted in the name of all. Of equal pieces (128 bits of
BLAKE2) the first goes on, found by a minimum that is taken where the pieces are; the others repeat it as a whole and are
marked without their text being moved. A hash that more than ``BUCKET_PIECES`` different pieces share
(those around a short line that very many texts hold) has no bucket: its windows are dealt out one by one by a digest of all
their bytes, and the first in place of equal ones is found in the same way. So no task's work grows with the commonest text.

Why buckets. A sort of all sampled positions of the corpus at once would move two names and a place (24 bytes) for two of
three bytes in every round, 16 times the input; routed by their seeds, only texts that share 24 bytes are sorted at all.

Sorting. Within a bucket the suffixes of the pieces are sorted by the difference cover {1, 2} modulo 3:

1. sampled positions (those not divisible by 3) are named by sorting runs of 8 bytes;
2. recursively, triples of names at distances that keep the residue are sorted and named: 20, then 56, then 98 bytes;
3. remaining suffixes merge with the sample through one or two leading bytes and the name that follows. Any two of
   the three residues have a shift after which both are sampled: 1 for residues 0 and 1, 2 for 0 and 2, 0 for 1 and 2.
   So each pair of residues is sorted in one order of (bytes before, name of 98 bytes, bytes after), 100 bytes in all;
4. neighbours in these orders with equal prefixes of 100 bytes are repeats; all but the earliest of a run are marked.

Texts are UTF-8 bytes; null is empty. Earlier means a smaller doc_id, or the same document and an earlier start; matches
never cross documents and are judged on the input. Rows with a null doc_id keep all bytes. Rows equal in doc_id and
text are one document; rows with one doc_id and different texts are different documents (in an order of their own).
An empty table gives no rows; other columns are ignored. Equal pieces and windows dealt out one by one are told apart by
128 bits of BLAKE2, several texts of one id by 64 bits of a hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_on_common, materialise, table

LENGTH = 100
SEED = 24
#: Windows in one piece at most; longer runs (of periodic text) are cut, each window in one piece.
PIECE_WINDOWS = 256
#: Pieces of one bucket on average, and of one hash within a bucket at most.
BUCKET_PIECES = 12_000
#: A hash with this many runs in one batch is not counted row by row.
OFTEN = 64
#: Hashes without a bucket that are sent out at most (8 MB); they are at most one BUCKET_PIECES-th of the pieces.
SENT_HASHES = 1_000_000

_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def _words(raw: np.ndarray, n: int, at: int) -> np.ndarray:
    """The 8 bytes from each of n places, as numbers; an unaligned view, not a copy."""
    return np.ndarray((n,), "<u8", raw, at, (1,))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, first window, windows, loop) of the runs of windows that share their least hash.

    loop: the seed stands twice within one window, or in more windows than hold one place of it. Only such a run
    can repeat a window within itself: of two equal windows in it, or one between them, some window holds both seeds.
    """
    n = len(text)
    if n < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    raw = np.frombuffer(text, np.uint8)
    m = n - SEED + 1
    h = _words(raw, m, 0) * _C[0]
    for i in range(1, SEED // 8):
        h ^= h >> np.uint64(31)
        h += _words(raw, m, 8 * i)
        h *= _C[i]
    h ^= h >> np.uint64(29)
    width = LENGTH - SEED + 1
    least = _sliding_min(h, width)
    edge = np.full(width - 1, ~np.uint64(0))
    # Places that are least in some window; the largest least hash around them is their own.
    seeds = np.flatnonzero(~_sliding_min(np.concatenate([edge, ~least, edge]), width) == h)
    twice = (np.diff(seeds) < width) & (h[seeds[1:]] == h[seeds[:-1]])
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.append(starts, len(least)))
    loop = sizes > width
    if twice.any():
        loop |= np.isin(least[starts], h[seeds[1:][twice]])
    if sizes.max() > PIECE_WINDOWS:
        parts = -(-sizes // PIECE_WINDOWS)
        owner = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.minimum(PIECE_WINDOWS, sizes[owner] - nth * PIECE_WINDOWS)
        starts, loop = starts[owner] + nth * PIECE_WINDOWS, loop[owner]
    return least[starts], starts, sizes, loop


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: A run's place in one number: first window, windows (9 bits) and loop (1). A row of no windows stands for the salted ones of its hash.
_RUNS = "h bigint, doc_id bigint, variant bigint, at bigint, salt int"


def _packed(starts: np.ndarray, sizes: np.ndarray, loop: np.ndarray) -> np.ndarray:
    return (starts << 10) + (sizes << 1) + loop


def _find_runs(batches):
    held: list[tuple] = []
    size = 0

    def out():
        h, doc_id, variant, at = (np.concatenate(x) for x in zip(*held))
        values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        salt, often = np.full(len(h), -1, np.int32), counts >= OFTEN
        if often.any():
            hot = np.flatnonzero(often[inverse])
            salt[hot] = np.arange(len(hot), dtype=np.int32)
            n, nothing = int(often.sum()), np.zeros(int(often.sum()), np.int64)
            h, doc_id, variant, at = (np.concatenate(x) for x in ((h, values[often]), (doc_id, nothing), (variant, nothing), (at, nothing)))
            salt = np.concatenate([salt, np.full(n, -1, np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, doc_id, variant, at, salt)], names=["h", "doc_id", "variant", "at", "salt"])

    for batch in batches:
        for doc_id, variant, text in zip(batch.column("doc_id").to_pylist(), batch.column("variant").to_pylist(), batch.column("text")):
            h, starts, sizes, loop = runs(_bytes(text.as_py()))
            if len(h):
                held.append((h.view(np.int64), np.full(len(h), doc_id, np.int64), np.full(len(h), variant, np.int64), _packed(starts, sizes, loop)))
                size += len(h)
            if size > 100_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


_PIECES = "h bigint, doc_id bigint, variant bigint, start bigint, d0 bigint, d1 bigint, piece binary"
_PLACE = ["doc_id", "variant", "start"]


def _digest(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _cut_pieces(batches):
    cols: tuple[list, ...] = ([], [], [], [], [], [], [])

    def out():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 6, pa.binary()))], names=["h", "doc_id", "variant", "start", "d0", "d1", "piece"]
        )
        for c in cols:
            c.clear()
        return batch

    for batch in batches:
        for doc_id, variant, text, hashes, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "text", "hashes", "places"))):
            raw = _bytes(text)
            for h, at in zip(hashes, places):
                start = at >> 10
                piece = raw[start : start + (at >> 1 & 511) + LENGTH - 1]
                for c, v in zip(cols, (h, doc_id, variant, start, *_digest(piece), piece)):
                    c.append(v)
            if len(cols[0]) > 20_000:
                yield out()
    yield out()


def _named(*keys: np.ndarray) -> np.ndarray:
    """Names of tuples: their places in sorted order, equal tuples alike. Keys are names below 2 ** 21, or any single numbers."""
    if len(keys) == 1 or all(int(k.max(initial=0)) < 1 << 21 for k in keys):
        packed = keys[0].astype(np.uint64)
        for k in keys[1:]:
            packed = (packed << np.uint64(21)) | k.astype(np.uint64)
        return np.unique(packed, return_inverse=True)[1]
    order = np.lexsort(keys[::-1])
    new = np.concatenate([[False], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _marked(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, np.minimum(begins, size), 1)
    np.add.at(edges, np.minimum(ends, size), -1)
    return np.cumsum(edges[:-1]) > 0


def sample_names(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the 98 bytes from the sampled positions in [begins, ends): position p is entry p // 3 * 2 + p % 3 - 1.

    raw ends in LENGTH + 30 bytes of padding, from where no window starts. Longer names are made only where
    a window or a longer name asks for them.
    """
    top = (len(raw) - 8) // 3 * 3
    at = np.arange(top)
    at = at[at % 3 > 0]


    def triples(names: np.ndarray, reach: int, *shifts: int) -> np.ndarray:
        wanted = np.flatnonzero(_marked(top, begins, ends + reach)[at])
        out = np.zeros(len(names), np.int64)
        out[wanted] = _named(*(names[np.minimum(wanted + s // 3 * 2, len(names) - 1)] for s in (0, *shifts)))
        return out

    names = _named(_words(raw, len(raw) - 7, 0)[at].byteswap())
    names = triples(names, 78, 6, 12)  # 20 bytes
    names = triples(names, 42, 18, 36)  # 56 bytes
    return triples(names, 0, 42)  # 98 bytes


def repeated_windows(pieces: list[bytes]) -> np.ndarray:
    """For the windows of all pieces in turn: whether an equal window stands before. Pieces come in the order of their places."""
    text = b"".join(pieces)
    raw = np.frombuffer(text + bytes(LENGTH + 32 + (-len(text)) % 3), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = lengths - (LENGTH - 1)
    starts = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(starts):
        return np.zeros(0, bool)
    names, residue, wide = sample_names(raw, begins, begins + counts + 2), starts % 3, raw.astype(np.int64)
    out = np.zeros(len(starts), bool)
    for shift in (0, 1, 2):
        own = np.flatnonzero((residue + shift) % 3 > 0)
        p = starts[own]
        sampled = p + shift
        name = names[sampled // 3 * 2 + sampled % 3 - 1]
        # The two bytes of the window outside the sampled 98.
        edge = (wide[p] << 8 | wide[p + 1]) if shift == 2 else (wide[p] << 8 | wide[p + 99]) if shift == 1 else (wide[p + 98] << 8 | wide[p + 99])
        key = name.astype(np.int64) << 16 | edge
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]])  # adjacent prefixes of 100 bytes
        out[own[order[same]]] = True
    return out


_SPANS = "doc_id bigint, variant bigint, s bigint, e bigint"


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["doc_id", "variant", "start"]).sort_values(["doc_id", "variant", "start"])
    pieces = pdf["piece"].tolist()
    marked = repeated_windows(pieces)
    counts = np.array([len(p) for p in pieces], np.int64) - (LENGTH - 1)
    owner = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(marked)
    if not len(at):
        return pd.DataFrame({"doc_id": [], "variant": [], "s": [], "e": []})
    first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)])
    last = np.concatenate([first[1:], [True]])
    base = pdf["start"].to_numpy()[owner[at[first]]]
    of = lambda c: pdf[c].to_numpy()[owner[at[first]]]
    return pd.DataFrame({"doc_id": of("doc_id"), "variant": of("variant"), "s": base + within[at[first]], "e": base + within[at[last]] + LENGTH})


_WINDOWS = "d0 bigint, d1 bigint, doc_id bigint, variant bigint, start bigint"


def _each_window(batches):
    cols: tuple[list, ...] = ([], [], [], [], [])

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d0", "d1", "doc_id", "variant", "start"])
        for c in cols:
            c.clear()
        return batch

    for batch in batches:
        for doc_id, variant, start, piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "start", "piece"))):
            for i in range(len(piece) - LENGTH + 1):
                for c, v in zip(cols, (*_digest(piece[i : i + LENGTH]), doc_id, variant, start + i)):
                    c.append(v)
            if len(cols[0]) > 50_000:
                yield out()
    yield out()


def _later(digested: DataFrame) -> DataFrame:
    """Of the rows (d0, d1, place and others) those that are not the first in place of their digest."""
    # Minima and counts combine where the rows are; a common digest meets its rows by broadcast.
    firsts = digested.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where(F.col("n") > 1)
    firsts = materialise(firsts, "firsts")
    return join_on_common(digested, firsts, ["d0", "d1"], "n", digested.count()).where(F.struct(*_PLACE) != F.col("first")).drop("first")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, variant, spans: per document with repeats, the [s, e) byte ranges covered by strings that stand earlier too. documents: doc_id, variant, text."""
    texts = documents.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    found = texts.select("doc_id", "variant", "text").mapInArrow(_find_runs, _RUNS)
    stands_for = F.col("at") == 0
    copies = F.sum(F.when(stands_for, 2).otherwise(1)).over(Window.partitionBy("h", "salt"))
    live = found.withColumn("copies", copies).where(~stands_for & ((F.col("salt") >= 0) | (F.col("copies") > 1) | (F.col("at") % 2 == 1))).drop("copies", "salt")
    live = materialise(live, "runs")
    per_text = live.groupBy("doc_id", "variant").agg(F.collect_list("h").alias("hashes"), F.collect_list("at").alias("places"))
    # Written once: the shuffle of the texts can go before the pieces are dealt out in turn.
    pieces = materialise(texts.select("doc_id", "variant", "text").join(per_text, ["doc_id", "variant"]).mapInArrow(_cut_pieces, _PIECES), "pieces")
    discard(live)
    later = materialise(_later(pieces.select("d0", "d1", *_PLACE, F.octet_length("piece").alias("size"))).select(*_PLACE, "size"), "later")
    firsts = materialise(pieces.join(later.select(*_PLACE), _PLACE, "left_anti").select("h", *_PLACE, "piece"), "first-pieces")
    discard(pieces)
    large = materialise(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_PIECES).select("h"), "large")
    alone, n_large = None, large.count()
    if n_large:
        sent = F.broadcast(large) if n_large <= SENT_HASHES else large
        windows = materialise(firsts.join(sent, "h", "left_semi").select(*_PLACE, "piece").mapInArrow(_each_window, _WINDOWS), "windows")
        alone = _later(windows).select("doc_id", "variant", F.col("start").alias("s"), (F.col("start") + LENGTH).alias("e"))
        firsts = firsts.join(sent, "h", "left_anti")
    buckets = max(1, -(-firsts.count() // BUCKET_PIECES))
    sorted_ = firsts.select(*_PLACE, "piece", F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInPandas(lambda pdf: _bucket(pdf), _SPANS)
    whole = later.select("doc_id", "variant", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"))
    covered = materialise(sorted_.union(whole) if alone is None else sorted_.union(whole).union(alone), "spans")
    return covered.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _variants(documents: DataFrame) -> DataFrame:
    """doc_id, text and variant: 0, or where some id has several texts a hash of the text."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    several = documents.groupBy("doc_id").agg(F.min(text_hash).alias("a"), F.max(text_hash).alias("b")).where(F.col("a") != F.col("b"))
    return documents.select("doc_id", "text", (F.lit(0).cast("bigint") if several.isEmpty() else text_hash).alias("variant"))


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs)."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, at = [], 0
    for s, e in merged:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept), sum(e - s for s, e in merged), len(merged)


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    rows = _variants(documents.select("doc_id", "text"))
    spans = repeated_spans(rows)

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw = _bytes(text)
                kept, removed, n = remove_spans(raw, [(x["s"], x["e"]) for x in found or ()])
                for c, v in zip(out, (doc_id, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(spans, ["doc_id", "variant"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
s AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, lag(p) OVER v AS before, lead(p) OVER v AS after FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, least(100, coalesce(after - p, 100)) AS fresh, (before IS NULL OR p - before > 100) AS opens,
             sum(CASE WHEN before IS NULL OR p - before > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
runs AS (SELECT doc_id, run, min(p) AS b, max(p) + 100 AS e, sum(fresh) AS removed FROM r GROUP BY ALL),
k AS (SELECT doc_id, sum(removed) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
cuts AS (SELECT doc_id, e AS a, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS z FROM runs
         UNION ALL SELECT doc_id, 0, min(b) FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS kx FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kx, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
