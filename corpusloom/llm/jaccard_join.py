"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

A document's row of the incidence matrix is its set of 5-word shingles (64-bit hashes of
A-Z lower-cased words; with fewer words the whole sequence is the one shingle; without
words the row is empty and linked with nothing). Documents with equal rows are one class,
and only classes enter the product. Two classes link when 4 * overlap >= 3 * union, that
is when overlap >= 3/7 of the sum of their sizes.

Which entries of the product can reach that bound: a link needs a common shingle among the
first ``size - ceil(3/4 size) + 1`` shingles of both rows in any one order of all shingles
(the size-derived bound on prefixes). Two orders are used, one after the other:

1. All classes, ordered by a fixed-size table of hashed counts, rarest first. The table only guides: where the corpus
   has far more shingles than slots it orders them as badly as chance, and nothing but work depends on it. Columns that few
   classes have in their prefix: each column adds one to the overlap count of its pairs; a pair is dropped when its
   count and all that could still follow the prefixes stay below the bound, and the overlaps of the others are counted on the whole rows.
   (Whichever prefix ends first in the order, nothing of it can meet the other row beyond that row's prefix, so what can follow is the rest of one row.)
2. Classes with a column in their prefix that many classes have there. Any other class meets all its links in the first
   round, so only these are ordered again among themselves, now by exact counts, and the same is done. A passage that many
   documents share comes last in this order; what is still met by many are rows made almost wholly of common shingles.
3. Those, mostly large groups of near copies, form clusters along their common columns. A cluster's rows are cut into
   blocks; a block product accumulates overlap counts column block by column block in one task's memory and emits only a
   spanning forest of what reaches the bound, never pairs. Two differently dealt rounds of diagonal blocks join
   nearly all of a group. Columns all of whose rows are joined by then are done with; along the others the rows outside the
   largest component meet all rows of a size that allows a link, block by block, so no link between components is lost.

Pairs that share a column of many classes are counted too low in rounds 1 and 2, but both their classes go on to the next round.

Rows with a null doc_id are linked with nothing. Repeated doc_ids: each row has its own set.
Classes are told apart by a 64-bit fingerprint of their set. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, discard, join_on_common, lean, materialise, table
from .components import components

WORDS = 5
#: Size of the table of hashed counts (2 ** 21 counts of 4 bytes: what is broadcast, whatever the input).
TABLE_BITS = 21
#: A column with more classes than this in its prefix lists is left to the next round.
LIST_MAX = 64
#: A shingle counted this often in the table, and eight times as often as the mean, is dealt out over SALTS partitions.
HOT = 4096
SALTS = 64
BLOCK_ROWS = 512
OUTER_ROWS = 256
BLOCK_COLUMNS = 4096

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(t) for t in tokens), np.uint64, len(tokens))
    n = len(h) - words + 1
    g = h[:n].copy()
    for i in range(1, words):
        g *= _A
        g ^= g >> np.uint64(29)
        g += h[i : i + n]
    g *= _B
    g ^= g >> np.uint64(32)
    return np.unique(g)


def fingerprint(row: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(row.tobytes())).astype(np.int64))


def prefix(row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles one of which any row that links with this one must have in its own prefix."""
    n = len(row)
    size = n - (3 * n + 3) // 4 + 1
    order = np.lexsort((row, counts[row >> np.uint64(64 - TABLE_BITS)]))
    return row[order[:size]]


def _texts(batches, *columns) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


_META = "doc_id bigint, n bigint, k bigint, text_hash bigint, range int, counts binary"
_RANGES = 8


def _describe(batches):
    """(doc_id, n, k, text_hash) per document and, at the end, the task's hashed shingle counts in _RANGES pieces under the task's number."""
    counts = np.zeros(1 << TABLE_BITS, np.uint32)
    held, waiting, rows = [], 0, ([], [], [], [])

    def out():
        n = len(rows[0])
        batch = pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in rows), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            names=["doc_id", "n", "k", "text_hash", "range", "counts"],
        )
        for x in rows:
            x.clear()
        return batch

    for doc_id, text, text_hash in _texts(batches, "doc_id", "text", "text_hash"):
        row = shingles(text)
        for x, v in zip(rows, (doc_id, len(row), fingerprint(row) if len(row) else None, text_hash)):
            x.append(v)
        held.append(row >> np.uint64(64 - TABLE_BITS))
        waiting += len(row)
        if waiting > 2_000_000:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            held, waiting = [], 0
        if len(rows[0]) >= 4096:
            yield out()
    if held:
        counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
    yield out()
    small = np.minimum(counts, 65535).astype("<u2").reshape(_RANGES, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()] * _RANGES, pa.int64())] + [pa.nulls(_RANGES, pa.int64())] * 3 + [pa.array(range(_RANGES), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())],
        names=["doc_id", "n", "k", "text_hash", "range", "counts"],
    )


def _add_counts(batches):
    """Sums of the count pieces of a partition; holds one piece per range."""
    total: dict[int, np.ndarray] = {}
    for r, piece in _texts(batches, "range", "counts"):
        x = np.frombuffer(piece, f"<u{len(piece) * _RANGES >> TABLE_BITS}")
        total[r] = total.get(r, np.zeros(len(x), np.uint64)) + x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], names=["range", "counts"])


def _edges(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"u": np.array([p[0] for p in pairs], np.int64), "v": np.array([p[1] for p in pairs], np.int64)})


def overlaps(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlap counts of the left rows with the right rows, accumulated over blocks of columns; columns with one row are left out."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    values = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(values) else np.empty(0, bool)
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.concatenate([[0], np.diff(column) != 0])) if len(column) else column
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + BLOCK_COLUMNS])
        block = np.zeros((len(rows), BLOCK_COLUMNS), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        out += block[left] @ block[right].T
    return out


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join whatever the links join: each vertex with its component's first one."""
    label = np.arange(len(k))
    a, b = np.nonzero(links)
    a, b = left[a], right[b]
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(k[i]), int(k[r])) for i, r in enumerate(label) if i != r]


def _reaches(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 7 * counts.astype(np.int64) >= 3 * (a[:, None] + b[None, :])


def _diagonal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("k")
    rows = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
    n, every = np.array([len(r) for r in rows], np.int64), np.arange(len(rows))
    links = np.triu(_reaches(overlaps(rows, every, every), n, n), 1)
    return _edges(_forest(links, every, every, pdf["k"].to_numpy()))


def _outer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows outside the main component (side 0) by rows (side 1)."""
    pdf = pdf.drop_duplicates(["side", "k"])
    rows = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
    side, comp = pdf["side"].to_numpy(), pdf["comp"].to_numpy()
    n, left, right = np.array([len(r) for r in rows], np.int64), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links = _reaches(overlaps(rows, left, right), n[left], n[right]) & (comp[left][:, None] != comp[right][None, :])
    return _edges(_forest(links, left, right, pdf["k"].to_numpy()))


def _sets(batches):
    k, n, s = [], [], []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.binary())], names=["k", "n", "s"])
        for x in (k, n, s):
            x.clear()
        return batch

    for (text,) in _texts(batches, "text"):
        row = shingles(text)
        k.append(fingerprint(row))
        n.append(len(row))
        s.append(row.tobytes())
        if len(k) >= 512:
            yield out()
    yield out()


def _linked(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a"), batch.column("b")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]))
            keep.append(7 * int((both[1:] == both[:-1]).sum()) >= 3 * (len(x) + len(y)))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _shingle_counts(described: DataFrame) -> np.ndarray:
    """The tasks' tables of hashed counts added up in two steps of equal width, so no task reads more than the square root of their number."""
    tables = described.where(F.col("range").isNotNull()).select("range", "counts", F.col("doc_id").alias("task"))
    groups = max(1, round((tables.count() / _RANGES) ** 0.5))
    pieces = tables.repartition(_RANGES * groups, "range", F.col("task") % groups).select("range", "counts").mapInArrow(lean(_add_counts), "range int, counts binary")
    pieces = pieces.repartition(_RANGES, "range").mapInArrow(lean(_add_counts), "range int, counts binary")
    counts = np.zeros((_RANGES, (1 << TABLE_BITS) // _RANGES), np.uint32)
    for r in pieces.collect():  # a table of fixed size
        counts[r["range"]] = np.frombuffer(r["counts"], "<u4")
    return counts.ravel()


def _posting_batch(held: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(held, types)], names=["h", "k", "n", "salt"])


def _hinted_postings(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """(h, k, n, salt) of the prefixes in the order of the table; a class may come from several tasks. salt: -1, or a part of a very common column."""
    sent = documents.sparkSession.sparkContext.broadcast(counts)
    often = max(HOT, 8 * int(counts.mean(dtype=np.float64)))

    def post(batches):
        table_, seen, held, size = sent.value, set(), ([], [], [], []), 0
        for doc_id, text in _texts(batches, "doc_id", "text"):
            row = shingles(text)
            if doc_id is None or not len(row) or (k := fingerprint(row)) in seen:
                continue
            seen.add(k)
            p = prefix(row, table_)
            hot = table_[p >> np.uint64(64 - TABLE_BITS)] >= often
            for x, y in zip(held, (p.astype(np.int64), np.full(len(p), k), np.full(len(p), len(row)), np.where(hot, k % SALTS, -1))):
                x.append(y)
            size += len(p)
            if size > 50_000:
                yield _posting_batch(held)
                held, size = ([], [], [], []), 0
        if size:
            yield _posting_batch(held)

    return documents.select("doc_id", "text").mapInArrow(lean(post), "h bigint, k bigint, n int, salt int")


def _pairs(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) that may link by columns of few classes, and (h, k) of the columns of many."""
    column = Window.partitionBy("h", "salt")
    live = (
        postings.withColumn("f", F.count(F.lit(1)).over(column))
        .withColumn("one", F.min("k").over(column) == F.max("k").over(column))
        .where((F.col("salt") >= 0) | ~F.col("one"))
        .select("h", "k", "n", F.when(F.col("salt") >= 0, F.lit(LIST_MAX + 1)).otherwise(F.least("f", F.lit(LIST_MAX + 1))).alias("f"))
    )
    live = materialise(live, "postings", TEXT_ROWS)
    many = materialise(live.where(F.col("f") > LIST_MAX).select("h", "k").distinct(), "many")
    several = many.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > 1)
    many = materialise(join_on_common(many, several, "h", "f", many.count()), "several")
    listed = live.where(F.col("f") <= LIST_MAX).select("h", "k", "n").distinct()
    a, b = listed.select("h", F.col("k").alias("u"), F.col("n").alias("nu")), listed.select("h", F.col("k").alias("v"), F.col("n").alias("nv"))
    pairs = a.join(b, "h").where((F.col("u") < F.col("v")) & (4 * F.least("nu", "nv") >= 3 * F.greatest("nu", "nv")))
    rest = F.greatest(F.expr("(3 * nu + 3) div 4 - 1"), F.expr("(3 * nv + 3) div 4 - 1"))
    pairs = pairs.groupBy("u", "v", "nu", "nv").agg(F.count(F.lit(1)).alias("o")).where(7 * (F.col("o") + rest) >= 3 * (F.col("nu") + F.col("nv"))).select("u", "v")
    pairs = materialise(pairs, "pairs")
    discard(live)
    return pairs, many


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    by = lambda name, s: sets.select(F.col("k").alias(name), F.col("s").alias(s))
    return pairs.join(by("u", "a"), "u").join(by("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(lean(_linked), "u bigint, v bigint").distinct()


def _columns(batches):
    for k, s in _texts(batches, "k", "s"):
        row = np.frombuffer(s, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), k, np.int64))], names=["h", "k"])


def _exact_postings(sets: DataFrame) -> DataFrame:
    """(h, k, n, salt) of the prefixes of all sets in the order of exact counts among them, rarest first."""
    sizes = sets.agg(F.sum("n"), F.count(F.lit(1))).first()
    columns = sets.select("k", "s").mapInArrow(lean(_columns), "h bigint, k bigint")
    counts = materialise(columns.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > LIST_MAX), "counts", TEXT_ROWS)
    common = join_on_common(columns, counts.withColumn("c", F.col("f")), "h", "f", int(sizes[0]))
    common = common.groupBy("k").agg(F.collect_list("h").alias("h"), F.collect_list("c").alias("c"))
    # What a whole prefix list may hold at most decides on salting: no column is in more lists than it has rows.
    often = max(HOT, int(sizes[1]) // 1000)

    def post(batches):
        held, size = ([], [], [], []), 0
        for k, s, hs, cs in _texts(batches, "k", "s", "h", "c"):
            row, count = np.frombuffer(s, np.uint64), np.zeros(len(s) // 8, np.int64)
            if hs:
                count[np.searchsorted(row, np.array(hs, np.int64).astype(np.uint64))] = cs
            take = np.lexsort((row, count))[: len(row) - (3 * len(row) + 3) // 4 + 1]
            for x, y in zip(held, (row[take].astype(np.int64), np.full(len(take), k), np.full(len(take), len(row)), np.where(count[take] >= often, k % SALTS, -1))):
                x.append(y)
            size += len(take)
            if size > 50_000:
                yield _posting_batch(held)
                held, size = ([], [], [], []), 0
        if size:
            yield _posting_batch(held)

    return sets.select("k", "s").join(common, "k", "left").mapInArrow(lean(post), "h bigint, k bigint, n int, salt int")


def jaccard_classes(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included),
    cluster (one number for all rows that links join, null where there is no shingle or doc_id) and text_hash (xxhash64 of the text)."""
    documents = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    described = materialise(documents.mapInArrow(lean(_describe), _META), "shingles", TEXT_ROWS)
    meta = described.where(F.col("range").isNull()).select("doc_id", "n", "k", "text_hash")
    pairs, many = _pairs(_hinted_postings(documents, _shingle_counts(described)))
    again = materialise(many.select("k").distinct(), "again")
    classes = meta.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("doc_id").alias("first"))
    needed = pairs.select(F.col("u").alias("k")).union(pairs.select("v")).union(again).distinct()
    ids = needed.join(classes, "k").select(F.col("first").alias("doc_id"))
    sets = materialise(documents.join(ids, "doc_id", "left_semi").select("text").mapInArrow(lean(_sets), "k bigint, n bigint, s binary"), "sets", TEXT_ROWS)
    links = materialise(_links(pairs, sets), "links", TEXT_ROWS)
    if not again.isEmpty():
        rows = materialise(sets.join(again, "k", "left_semi"), "again-sets")
        pairs, many = _pairs(_exact_postings(rows))
        links = materialise(links.union(_links(pairs, rows)), "links", TEXT_ROWS)
        if not many.isEmpty():
            links = _block_links(many, rows, links)
    found = components(links)
    labelled = classes.join(found, F.col("k") == F.col("id"), "left").select("k", "first", F.coalesce("comp", "k").alias("comp"))
    smallest = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = labelled.join(smallest, "comp").select("k", "component_id", "comp")
    named = F.col("doc_id").isNotNull()
    return meta.join(of_class, "k", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(named, F.col("comp")).alias("cluster"),
        "text_hash",
    )


def _along(columns: DataFrame) -> DataFrame:
    """(k, c): the clusters that common columns (h, k) make of their rows."""
    heads = columns.groupBy("h").agg(F.min("k").alias("m"), F.count(F.lit(1)).alias("f"))
    tied = join_on_common(columns, heads, "h", "f", columns.count()).select(F.col("k").alias("u"), F.col("m").alias("v"))
    return materialise(components(tied).select(F.col("id").alias("k"), F.col("comp").alias("c")), "along")


def _block_links(many: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """links and the forests of the block products along columns (h, k) that many classes have in their prefix."""
    clusters = _along(many)
    sizes = clusters.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    rows = materialise(clusters.join(sizes, "c").join(sets.select("k", "s"), "k"), "clusters")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    dealt = rows.withColumn("deal", F.explode(F.when(F.col("size") > BLOCK_ROWS, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k", "deal"), blocks)).select("c", "deal", "block", "k", "s")
    inner = dealt.groupBy("c", "deal", "block").applyInPandas(lambda pdf: _diagonal(pdf), "u bigint, v bigint")
    links = materialise(links.union(inner), "links")
    wide = rows.where(F.col("size") > BLOCK_ROWS).select("k", "s")
    discard(sets)
    comps = components(links).select(F.col("id").alias("k"), "comp")
    wide = materialise(wide.join(comps, "k", "left").select("k", "s", F.coalesce("comp", "k").alias("comp")), "wide")
    # Columns that stand in several components yet.
    spread = many.join(wide.select("k", "comp"), "k")
    open_ = spread.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("f")).where(F.col("a") != F.col("b")).select("h", "f")
    open_ = materialise(join_on_common(spread.select("h", "k"), open_, "h", "f", many.count()), "open")
    if open_.isEmpty():
        return links
    wide = materialise(wide.join(_along(open_), "k"), "wide")
    parts = wide.groupBy("c", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("c").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    wide = wide.join(main.where(F.col("all") > F.col("most")), "c")
    # Rows of one band, or of neighbouring ones, alone can have sizes in a ratio of 3 to 4 or nearer.
    wide = wide.withColumn("band", F.floor(F.log(F.octet_length("s") / 8.0) / F.log(F.lit(4 / 3)) + 1e-9).cast("int"))
    n_out, n_all = F.ceil((F.col("all") - F.col("most")) / OUTER_ROWS).cast("int"), F.ceil(F.col("all") / BLOCK_ROWS).cast("int")
    place = lambda n: F.pmod(F.xxhash64("k"), n).cast("int")
    outer = wide.where(F.col("comp") != F.col("main")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    outer = outer.select("c", "band", "k", "s", "comp", F.lit(0).alias("side"), place(n_out).alias("o"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("b"))
    every = wide.select("c", "band", "k", "s", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), n_out - 1)).alias("o"), place(n_all).alias("b"))
    crossed = outer.unionByName(every).groupBy("c", "band", "o", "b").applyInPandas(lambda pdf: _outer(pdf), "u bigint, v bigint")
    return materialise(links.union(crossed), "links")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE d = documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
"""
