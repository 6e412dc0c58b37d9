"""Benchmark decontamination over a distributed positional inverted index.

index() stores the index: a shard, one row of a table in the shared folder, holds a run of consecutive training
documents and, per term, the sorted positions of its tokens (documents stand one empty position apart, so no match
crosses them). It is built where the documents are read, without a shuffle, and answers any number of test sets.

search() asks every shard for every test window. Windows with a term that the shard lacks go first; of the others the
posting list of the rarest term, shifted by the term's offset, is intersected with the shifted lists of the next
rarest, and so on, for all windows of a block at once. What is left are exact phrases. Proximity matches are the
windows whose words all stand, in any order, within ``reach`` consecutive words of a document: the documents that hold all
terms are found first, then their positions around the rarest term are compared.

Test items are sent out in blocks of at most BLOCK_WORDS words (a longer item is a block of its own), which a task
takes one after the other, so what it holds never grows with either table. Terms are told apart by 64 bits of a hash.

Words: A-Z lower-cased, then runs of bytes in [0-9a-z\\x80-\\xff]. Null and empty texts have no words.
Empty tables give no matches. Items are named as text; repeated items count once per item_id; a null item_id
hits like any other and counts as one item, but has no name to report. Repeated documents are judged each on their own, very long
ones as a shard of their own. The columns kept travel in one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, materialise, table

WINDOW = 10
#: Consecutive words within which a proximity match stands.
REACH = 20
#: Words of test items in one broadcast.
BLOCK_WORDS = 500_000
#: Training tokens of one index shard, closed at the next document's end.
SHARD_TOKENS = 250_000
#: Documents, and shards, in one Arrow batch; as many shards are one row group.
BATCH_DOCUMENTS, BATCH_SHARDS = 1024, 4
#: Places compared at once.
CHUNK = 1 << 20

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Numbers(dict):
    """Numbers words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _hashed(numbers: _Numbers) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))


class TestWindows:
    """The windows of one block of test items over its sorted terms."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        numbers, flat, starts, lengths, owners = _Numbers(), [], [], [], []
        self.names = [item for item, _ in items]
        for n, (_, text) in enumerate(items):
            ids = list(map(numbers.__getitem__, words(text)))
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                starts.append(len(flat) + i)
                lengths.append(min(size, len(ids)))
                owners.append(n)
            flat.extend(ids)
        hashes = _hashed(numbers)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.size, self.terms, self.flat = size, hashes[order], place[np.array(flat, np.int64)] if flat else np.empty(0, np.int32)
        self.starts, self.lengths, self.owners = np.array(starts, np.int64), np.array(lengths, np.int64), np.array(owners, np.int64)


def postings(documents: list[list[bytes]]) -> dict[str, bytes]:
    """The stored arrays of a shard: terms (sorted hashes), firsts (where a term's list begins), positions (as steps), lengths (words per document)."""
    numbers = _Numbers()
    flat: list[int] = []
    for tokens in documents:
        flat.extend(map(numbers.__getitem__, tokens))
        flat.append(-1)
    ids = np.array(flat, np.int64)
    hashes = _hashed(numbers)
    order = np.argsort(hashes)
    place = np.empty(len(order) + 1, np.int32)
    place[order], place[-1] = np.arange(len(order)), -1
    ids = place[ids] if len(ids) else np.empty(0, np.int32)
    known = np.flatnonzero(ids >= 0).astype(np.uint32)
    positions = known[np.argsort(ids[known], kind="stable")]
    firsts = np.concatenate([[0], np.cumsum(np.bincount(ids[known], minlength=len(order)))])
    steps = np.diff(positions, prepend=np.uint32(0))  # modulo 2 ** 32
    return {
        "terms": hashes[order].tobytes(),
        "firsts": firsts.astype(np.uint32).tobytes(),
        "positions": steps.astype(np.uint32).tobytes(),
        "lengths": np.array([len(t) for t in documents], np.uint32).tobytes(),
    }


class Shard:
    """A stored shard, seen by the terms of a block of test items."""

    def __init__(self, stored: dict[str, bytes], tests: TestWindows):
        terms, firsts = np.frombuffer(stored["terms"], np.uint64), np.frombuffer(stored["firsts"], np.uint32).astype(np.int64)
        every = np.cumsum(np.frombuffer(stored["positions"], np.uint32), dtype=np.uint32).astype(np.int64)
        lengths = np.frombuffer(stored["lengths"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts, self.length = self.ends - lengths, int(lengths.sum() + len(lengths))
        at = np.minimum(np.searchsorted(terms, tests.terms), max(0, len(terms) - 1))
        held = terms[at] == tests.terms if len(terms) else np.zeros(len(tests.terms), bool)
        self.counts = np.where(held, firsts[at + 1] - firsts[at], 0) if len(terms) else np.zeros(len(tests.terms), np.int64)
        #: The lists of the test terms one after the other, and the term at each position.
        self.firsts = np.cumsum(self.counts) - self.counts
        own = np.flatnonzero(held)
        self.positions = every[_ranges(firsts[at[own]], self.counts[own])] if len(own) else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.term_at = np.full(self.length + 1, -1, np.int32)
        self.term_at[self.positions] = self.owner

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _candidates(shard: Shard, tests: TestWindows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows all of whose terms occur here, their terms by rarity, the terms' offsets), in chunks of bounded posting lists. Short windows repeat a term."""
    absent = np.concatenate([[0], np.cumsum(shard.counts[tests.flat] == 0)])
    own = np.flatnonzero(absent[tests.starts + tests.lengths] == absent[tests.starts]) if len(tests.starts) else np.empty(0, np.int64)
    for begin in range(0, len(own), 1 << 16):
        w = own[begin : begin + (1 << 16)]
        offsets = np.minimum(np.arange(tests.size), tests.lengths[w][:, None] - 1)
        terms = tests.flat[tests.starts[w][:, None] + offsets]
        order = np.argsort(shard.counts[terms], axis=1, kind="stable")
        terms, offsets = np.take_along_axis(terms, order, 1), np.take_along_axis(offsets, order, 1)
        load = np.cumsum(shard.counts[terms[:, 0]]) // CHUNK
        for part in np.split(np.arange(len(w)), np.flatnonzero(np.diff(load)) + 1):
            yield w[part], terms[part], offsets[part]


def phrases(shard: Shard, tests: TestWindows) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence: offset-adjusted lists, rarest first."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for w, terms, offsets in _candidates(shard, tests):
        sizes = shard.counts[terms[:, 0]]
        row = np.repeat(np.arange(len(w)), sizes)
        start = shard.positions[_ranges(shard.firsts[terms[:, 0]], sizes)] - offsets[row, 0]
        for j in range(1, tests.size):
            at = start + offsets[row, j]
            held = (start >= 0) & (at < shard.length)
            held &= shard.term_at[np.where(held, at, shard.length)] == terms[row, j]
            row, start = row[held], start[held]
        held = start >= 0
        out.append((w[row[held]], start[held]))
    return tuple(np.concatenate(x) for x in zip(*out))


def proximities(shard: Shard, tests: TestWindows, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, document) where all words of the window stand within ``reach`` consecutive words."""
    out_w, out_d = [], []
    local = np.flatnonzero(shard.counts)
    number = np.zeros(len(shard.counts), np.int64)
    number[local] = np.arange(len(local))
    holds = np.zeros((len(shard.starts), len(local)), bool)
    holds[shard.document(shard.positions), number[shard.owner]] = True
    keys = shard.owner * (shard.length + 1) + shard.positions
    for w, terms, _ in _candidates(shard, tests):
        sizes = shard.counts[terms[:, 0]]
        row = np.repeat(np.arange(len(w)), sizes)
        at = shard.positions[_ranges(shard.firsts[terms[:, 0]], sizes)]
        doc = shard.document(at)
        for j in range(1, tests.size):
            held = holds[doc, number[terms[row, j]]]
            row, at, doc = row[held], at[held], doc[held]
        low, high = np.maximum(at - reach + 1, shard.starts[doc]), np.minimum(at + reach, shard.ends[doc])
        for j in range(1, tests.size):
            base = terms[row, j].astype(np.int64) * (shard.length + 1)
            held = np.searchsorted(keys, base + low) < np.searchsorted(keys, base + high)
            row, doc, low, high = row[held], doc[held], low[held], high[held]
        for r, d, a, b in zip(row.tolist(), doc.tolist(), low.tolist(), high.tolist()):
            if (not out_w or (out_w[-1], out_d[-1]) != (w[r], d)) and _within(shard.term_at[a:b], set(terms[r].tolist()), reach):
                out_w.append(w[r])
                out_d.append(d)
    return np.array(out_w, np.int64), np.array(out_d, np.int64)


def _within(ids: np.ndarray, wanted: set[int], reach: int) -> bool:
    last: dict[int, int] = {}
    for i, t in enumerate(ids.tolist()):
        if t in wanted:
            last[t] = i
            if len(last) == len(wanted) and i - min(last.values()) < reach:
                return True
    return False


def index(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The stored index: a row per shard with the columns kept of its documents and its postings."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    within = "text" in keep  # the text is then read from the row and not sent twice
    rows = documents.select(row.alias("row"), *([] if within else ["text"]))

    def run(batches):
        held, tokens, n = [], [], 0

        def out():
            kept = pa.chunked_array(held).combine_chunks()
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)]
            stored = postings(tokens)
            return pa.RecordBatch.from_arrays(arrays + [pa.array([v], pa.binary()) for v in stored.values()], names=["rows", *stored])

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = part.column("row").field("text") if within else part.column("text")
                read = [words(t) for t in texts.to_pylist()]
                held.append(part.column("row"))
                tokens.extend(read)
                n += sum(map(len, read))
                if n >= SHARD_TOKENS:
                    yield out()
                    held, tokens, n = [], [], 0
        if held:
            yield out()

    kind = rows.schema["row"].dataType.simpleString()
    return materialise(rows.mapInArrow(lean(run), f"rows array<{kind}>, terms binary, firsts binary, positions binary, lengths binary"), "postings", BATCH_DOCUMENTS, BATCH_SHARDS)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """Test items in blocks of at most BLOCK_WORDS words (a word and its separator take two characters at least)."""
    block, held = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(text or "") // 2 + 1
        if block and held + n > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += n
    if block:
        yield block


def search(stored: DataFrame, benchmark: DataFrame, size: int = WINDOW, reach: int | None = None) -> DataFrame:
    """row (the columns kept), n_words, spans ([start, end) word ranges that windows occupy), items (test items with an
    exact window) and near_items (with a window within ``reach`` words; empty when reach is None) of every document."""
    context = stored.sparkSession.sparkContext
    sent = [context.broadcast(TestWindows(block, size)) for block in _blocks(benchmark)]
    kind = stored.schema["rows"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].as_py() for c in ("terms", "firsts", "positions", "lengths")}
                n = len(shard["lengths"]) // 4
                found = [([], set(), set()) for _ in range(n)]
                for block in sent:
                    _answer(shard, block.value, reach, found)
                    if len(sent) > 1:  # a worker holds one block at a time
                        block.__dict__.pop("_value", None)
                rows = batch.column("rows")[i].values
                columns = {
                    "row": rows,
                    "n_words": pa.array(np.frombuffer(shard["lengths"], np.uint32).astype(np.int64)),
                    "spans": pa.array([merged(f[0]) for f in found], pa.list_(pa.list_(pa.int32()))),
                    "items": pa.array([_sorted(f[1]) for f in found], pa.list_(pa.string())),
                    "near_items": pa.array([_sorted(f[2]) for f in found], pa.list_(pa.string())),
                }
                whole = pa.RecordBatch.from_pydict(columns)
                for start in range(0, n, 4096):
                    yield whole.slice(start, 4096)

    return stored.mapInArrow(lean(run), f"row {kind}, n_words bigint, spans array<array<int>>, items array<string>, near_items array<string>")


def _sorted(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def _answer(stored: dict[str, bytes], tests: TestWindows, reach: int | None, found: list[tuple[list, set, set]]) -> None:
    """Adds what a block of test items finds in a shard to the spans, items and near items of its documents."""
    shard = Shard(stored, tests)
    w, start = phrases(shard, tests)
    if len(w):
        edges = np.bincount(start, minlength=shard.length + 1) - np.bincount(start + tests.lengths[w], minlength=shard.length + 1)
        steps = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edges) > 0]).astype(np.int8)))
        for b, e in zip(steps[::2].tolist(), steps[1::2].tolist()):
            d = int(shard.document(np.array([b]))[0])
            found[d][0].append([b - int(shard.starts[d]), e - int(shard.starts[d])])
        for d, item in np.unique(np.stack([shard.document(start), tests.owners[w]], 1), axis=0).tolist():
            found[d][1].add(tests.names[item])
    if reach is not None:
        w, doc = proximities(shard, tests, reach)
        for d, item in set(zip(doc.tolist(), tests.owners[w].tolist())):
            found[d][2].add(tests.names[item])


def match(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, reach: int | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """search() over a fresh index of documents."""
    return search(index(documents, keep), benchmark, size, reach)


def clean(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, all columns, that no test window touches. Written, as shards with whole texts need small Arrow batches; the index goes."""
    stored = index(documents, tuple(documents.columns))
    found = search(stored, benchmark, size).where(F.size("spans") == 0).select("row.*")
    kept = materialise(found, "clean", BATCH_SHARDS)
    discard(stored)
    return kept


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from search()'s arrays, and the same of the proximity matches."""
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    names = lambda c: F.sha2(F.array_join(F.array_sort(c), ","), 256)
    return found.select(
        "row.doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        names("items").alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        names("near_items").alias("near_items_sha256"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), reach=REACH))


OP5_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lens WHERE len(w) >= k)),
m AS (SELECT doc_id, i, pos.k, item_id FROM pos JOIN win USING (phrase) WHERE pos.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
dt AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM dw),
near_w AS (SELECT item_id, i, list_distinct(w[i:i + 9]) AS terms FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
held AS (
  SELECT doc_id, item_id, i, any_value(terms) AS terms FROM (SELECT item_id, i, terms, unnest(terms) AS term FROM near_w) JOIN dt USING (term)
  GROUP BY doc_id, item_id, i HAVING count(*) = any_value(len(terms))),
places AS (SELECT doc_id, item_id, w, terms, unnest(range(1, greatest(len(w) - 19, 1) + 1)) AS p FROM held JOIN dw USING (doc_id)),
near AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM places WHERE list_has_all(w[p:p + 19], terms)),
nits AS (SELECT doc_id, count(*) AS n_near, sha256(string_agg(s, ',' ORDER BY s)) AS nh FROM near GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, coalesce(nh, sha256('')) AS near_items_sha256
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nits USING (doc_id)
"""
