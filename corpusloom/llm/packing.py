"""Token ids packed into fixed-length rows by best-fit decreasing over the whole corpus.

1. Texts are tokenised where they are read; a document longer than a row is cut into full rows and a rest, losing
   nothing. The pieces are written to the shared folder once. Full rows are packed as they stand.
2. Best-fit decreasing needs nothing but the number of pieces of each length. It runs over these counts: a row's room
   is a place in a segment tree, rows of equal room are ranges of row numbers, and a range takes as many pieces of one
   length as fit at once. Each length adds at most four ranges and each range is filled at most log2(length) times, so
   the plan is of bounded size whatever the corpus, and it is the packing that piece by piece best fit gives.
3. Pieces of one length are numbered in the order of (a hash of the document, doc_id, start, ids), in two steps so that
   a length which very many pieces share is no single task's work; the plan turns (length, number) into a row and a slot.
   Only (length, id, number) are shuffled for that. The ids follow once to their row.

What is packed together thus depends on the rows alone and not on how they are partitioned, and at most the rows that
best fit leaves open over the whole corpus are part-filled.

Output, one row per packed row of ``length`` ids:
  pack_id          bigint: unique; full rows are negative, others count from 0
  n_tokens         ids before the padding
  input_ids        binary: ``length`` little-endian unsigned ids of ``id_bytes`` bytes, padded with pad_id
  cu_seqlens       array<int>: 0 and the cumulative segment lengths
  position_resets  array<int>: positions where position ids start again at 0, padding included
  doc_ids          array<bigint>: the document of each segment
  doc_starts       array<int>: where in its document's ids each segment begins

Null and empty texts have no ids and no segment. Repeated rows are packed each on their own;
a null doc_id stays null. An empty table gives no rows. Columns other than doc_id and text are ignored.
A vocabulary file is read where the tokenizer runs: its path must exist on every machine.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, materialise, table

LENGTH = 2048
#: Parts that the pieces of one length are numbered in.
PARTS = 256
PAD_ID = 50256
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handed to the tokenizer at once where a border allows it, so that a text takes little more memory than itself.
PIECE_CHARS = 1 << 20

_PIECES = "piece bigint, doc_id bigint, start int, n int, digest bigint, ids binary"
SCHEMA = "pack_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_starts array<int>"


def default_vocabulary() -> str:
    """The vocabulary file of the public tokenizers package, wherever it is installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, VOCABULARY)


def encoding(path: str):
    """Kept on the library's module, which outlives the tasks of a Python worker; this one travels by value."""
    import tiktoken

    held = tiktoken.__dict__.setdefault("_encodings_by_path", {})
    if path not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


class CapacityTree:
    """Counts of open rows by capacity, with the search for the least capacity that is large enough."""

    def __init__(self, length: int):
        self.leaves = 1 << max(1, length).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def least_at_least(self, capacity: int) -> int:
        """-1 if no open row has the room."""
        at = capacity + self.leaves
        if self.count[at]:
            return capacity
        while at > 1:  # climb until a right neighbour holds something, then descend to its leftmost
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def packing_plan(counts: dict[int, int], length: int) -> np.ndarray:
    """Best-fit decreasing over counts of pieces by length (below ``length``).

    Rows (n, first, row, each): the pieces of length n from number ``first`` on go to the rows from ``row`` on,
    ``each`` to a row, until the next entry of that length. Sorted by (n, first); of equal rooms the lowest rows are taken.
    """
    tree, open_rows, plan, rows = CapacityTree(length), {}, [], 0

    def put(room: int, low: int, high: int) -> None:
        if room and high > low:
            open_rows.setdefault(room, []).append((low, high))
            tree.add(room, high - low)

    for n in sorted(counts, reverse=True):
        number, left = 0, counts[n]
        while left:
            room = tree.least_at_least(n)
            if room < 0:
                room, fit = length, length // n
                low, high = rows, rows + -(-left // fit)
                rows = high
            else:
                held = open_rows[room]
                held.sort(reverse=True)
                low, high = held.pop()
                tree.add(room, low - high)
                fit = room // n
            taken, rest = divmod(min(left, (high - low) * fit), fit)
            if taken:
                plan.append((n, number, low, fit))
            if rest:
                plan.append((n, number + taken * fit, low + taken, rest))
            put(room - fit * n, low, low + taken)
            put(room - rest * n, low + taken, low + taken + 1 if rest else low + taken)
            put(room, low + taken + bool(rest), high)
            number, left = number + taken * fit + rest, left - taken * fit - rest
    return np.array(sorted(plan), np.int64).reshape(-1, 4)


def placed(plan: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the order of filling) of pieces by length and number."""
    key = (plan[:, 0] << 48) + plan[:, 1]
    at = np.searchsorted(key, (n << 48) + number, side="right") - 1
    first, row, each = plan[at, 1], plan[at, 2], plan[at, 3]
    # Longer pieces are placed earlier, so the order of filling is that of falling length.
    return row + (number - first) // each, ((1 << 20) - n << 20) + (number - first) % each


def stretches(text: str) -> list[str]:
    """The text in stretches whose ids put together are the ids of the whole text.

    No token of the pattern holds a white-space character after another one that is none, and none looks back, so
    every place before a blank or line end that follows a character other than white space is a border of
    tokens. A stretch ends at the first such place from PIECE_CHARS on, however far that is.
    """
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        cut = at + PIECE_CHARS
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut = min((i for i in (text.find(" ", cut + 1), text.find("\n", cut + 1)) if i >= 0), default=len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def token_ids(text: str | None, path: str, kind: np.dtype) -> np.ndarray:
    encode = encoding(path).encode_ordinary
    parts = [np.array(encode(t), kind) for t in stretches(text or "")]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def pieces_of(documents: DataFrame, length: int, path: str, kind: np.dtype) -> DataFrame:
    """Full rows and rests of all documents; ``piece`` is unique within the written table."""

    def run(batches):
        number, cols = TaskContext.get().partitionId() << 40, ([], [], [], [], [], [])
        held = 0

        def out():
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["piece", "doc_id", "start", "n", "digest", "ids"])
            for c in cols:
                c.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = token_ids(text.as_py(), path, kind)
                for start in range(0, len(ids), length):
                    raw = ids[start : start + length].tobytes()
                    digest = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                    for c, v in zip(cols, (number, doc_id.as_py(), start, len(raw) // kind.itemsize, digest, raw)):
                        c.append(v)
                    number, held = number + 1, held + len(raw)
                    if held > 8 << 20 or len(cols[0]) >= 8192:
                        yield out()
                        held = 0
        yield out()

    return materialise(documents.select("doc_id", "text").mapInArrow(run, _PIECES), "pieces", TEXT_ROWS)


def pack(documents: DataFrame, length: int = LENGTH, vocabulary: str | None = None, pad_id: int = PAD_ID) -> DataFrame:
    path = vocabulary or default_vocabulary()
    kind = np.dtype("<u2" if pad_id < 1 << 16 else "<u4")
    pieces = pieces_of(documents, length, path, kind)
    order = ["part", "doc_id", "start", "digest", "piece"]
    short = pieces.where(F.col("n") < length).select("piece", "doc_id", "start", "n", "digest", F.pmod(F.xxhash64("doc_id", "start", "digest"), F.lit(PARTS)).cast("int").alias("part"))
    sums = short.groupBy("n", "part").agg(F.count(F.lit(1)).alias("count"))
    before = sums.withColumn("before", F.sum("count").over(Window.partitionBy("n").orderBy("part")) - F.col("count"))
    counts: dict[int, int] = {}
    for r in before.groupBy("n").agg(F.sum("count").alias("count")).collect():  # at most one row per length
        counts[r["n"]] = r["count"]
    sent = documents.sparkSession.sparkContext.broadcast(packing_plan(counts, length))

    def place(batches):
        plan = sent.value
        for batch in batches:
            if batch.num_rows:
                row, slot = placed(plan, batch.column("n").to_numpy().astype(np.int64), batch.column("number").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(row), pa.array(slot)], names=["piece", "pack_id", "slot"])

    within = F.row_number().over(Window.partitionBy("n", "part").orderBy(*order[1:])) - 1
    # PARTS rows a length at most.
    numbered = short.withColumn("within", within).join(F.broadcast(before.select("n", "part", "before")), ["n", "part"])
    places = numbered.select("piece", "n", (F.col("before") + F.col("within")).alias("number")).mapInArrow(place, "piece bigint, pack_id bigint, slot bigint")
    rests = pieces.where(F.col("n") < length).select("piece", "doc_id", "start", "ids").join(places, "piece")
    rests = rests.select("pack_id", "slot", "doc_id", "start", "ids").repartition("pack_id").sortWithinPartitions("pack_id", "slot")
    return rests.mapInArrow(_assemble(length, pad_id, kind), SCHEMA).unionByName(_full_rows(pieces.where(F.col("n") == length), length))


def _full_rows(pieces: DataFrame, length: int) -> DataFrame:
    """Pieces of ``length`` ids as packed rows; they need no padding, so their ids stay in the JVM."""
    return pieces.select(
        (-1 - F.col("piece")).alias("pack_id"),
        F.col("n").alias("n_tokens"),
        F.col("ids").alias("input_ids"),
        F.array(F.lit(0), F.lit(length)).alias("cu_seqlens"),
        F.array(F.lit(0)).alias("position_resets"),
        F.array("doc_id").alias("doc_ids"),
        F.array("start").alias("doc_starts"),
    )


def _assemble(length: int, pad_id: int, kind: np.dtype):
    """Rows sorted by pack_id and slot to packed rows."""

    def run(batches):
        rows: list[list[tuple]] = []
        for batch in batches:
            for pack_id, _, doc_id, start, ids in zip(*(batch.column(c).to_pylist() for c in ("pack_id", "slot", "doc_id", "start", "ids"))):
                if not rows or rows[-1][0][0] != pack_id:
                    if len(rows) >= 1024:
                        yield _batch(rows, length, pad_id, kind)
                        rows = []
                    rows.append([])
                rows[-1].append((pack_id, doc_id, start, np.frombuffer(ids, kind)))
        if rows:
            yield _batch(rows, length, pad_id, kind)

    return run


def _batch(rows: list[list[tuple]], length: int, pad_id: int, kind: np.dtype) -> pa.RecordBatch:
    out = {name: [] for name in ("pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts")}
    for row in rows:
        sizes = np.cumsum([len(p[3]) for p in row]).tolist()
        ids = np.full(length, pad_id, kind)
        ids[: sizes[-1]] = np.concatenate([p[3] for p in row])
        out["pack_id"].append(row[0][0])
        out["n_tokens"].append(sizes[-1])
        out["input_ids"].append(ids.tobytes())
        out["cu_seqlens"].append([0, *sizes])
        out["position_resets"].append([0, *(s for s in sizes if s < length)])
        out["doc_ids"].append([p[1] for p in row])
        out["doc_starts"].append([p[2] for p in row])
    types = {"pack_id": pa.int64(), "n_tokens": pa.int32(), "input_ids": pa.binary(), "doc_ids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.list_(pa.int32()))) for k, v in out.items()})


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
