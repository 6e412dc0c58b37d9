"""WARC archives: a writer with revisit records and a splittable reader.

Writer: one gzip member per record, WARC/1.1. Each task streams its rows into files of its own
in the shared folder and returns their names; the list of files is itself written as a table, so a
task that ran twice counts once. The first record (smallest page_id) of each payload digest is a
response, later ones are revisits that carry the response's HTTP header but no payload.

Reader: files are cut into byte ranges, each a task's work. A task looks for the gzip
magic within its range, decodes the start of every candidate member up to its blank line and takes it
for a record only if that is a WARC header of whatever length; it owns the records that start inside its range, the last of
which it reads to the end beyond it. A range may start anywhere, within a member too. One record is in memory at a time.
A record whose header can be read and whose content cannot (damaged, cut short) comes back with ``sound`` false and null sizes.
The magic of a member cannot stand inside a payload that this writer stores as it is: payloads are UTF-8, where no byte 8B follows
1F. An archive from elsewhere may hold such bytes; only a range that starts inside that very record would report them.

Null html is an empty payload; a null url leaves out the target; a null page_id is an id-less
response and never the target of a revisit. Rows repeated with the same page_id and payload are each a record;
those with the smallest page_id are responses. An empty table makes an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_on_common, materialise, table

MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
#: Tasks of one read; beyond it a task takes several ranges.
MAX_TASKS = 1 << 17
CHUNK = 1 << 20
#: Decoded bytes of a candidate looked at in one step; a WARC header may take any number of steps.
HEADER_BYTES = 1 << 16

RECORDS = "file string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, sound boolean, payload binary"


def filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), re.sub("^file:", "", uri)
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to. Only ids and digests meet by digest; the html moves once, by page_id."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    narrow = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_bytes)
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = materialise(firsts.where(F.col("first") < F.col("last")).select("digest", "first", "n"), "warc-firsts")
    meant = join_on_common(narrow.select("page_id", "digest"), firsts, "digest", "n", pages.count())
    later = meant.where(F.col("page_id") > F.col("first")).select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"))
    return rows.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archive and returns its files: path, bytes, records."""

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                data = record(None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None, payload, base32_sha1(payload), None if pd.isna(refers) else int(refers))
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})
                    out, size, n = None, 0, 0
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return materialise(with_revisits(pages, least_bytes).mapInPandas(run, "path string, bytes bigint, records bigint"), "warc-files")


class _Window:
    """Bytes of a file around a moving position, read in chunks."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def at(self, offset: int, length: int) -> bytes:
        if not (self.start <= offset and offset + length <= self.start + len(self.data)):
            self.start, self.data = offset, self.source.read_at(min(max(length, CHUNK), max(0, self.size - offset)), offset)
        return self.data[offset - self.start : offset - self.start + length]

    def find(self, offset: int, end: int) -> int:
        """The next magic that starts in [offset, end), or -1."""
        while offset < end:
            data = self.at(offset, min(CHUNK, end - offset + len(MAGIC) - 1))
            if (i := data.find(MAGIC)) >= 0:
                return offset + i if offset + i < end else -1
            offset += max(1, len(data) - len(MAGIC) + 1)
        return -1


def _header(window: _Window, offset: int) -> bytes | None:
    """The WARC header of the member at offset, up to its blank line, decoded step by step; None if there is none."""
    z, head, at = zlib.decompressobj(31), bytearray(), offset
    try:
        while not z.eof:
            data = z.unconsumed_tail or window.at(at, min(HEADER_BYTES, max(0, window.size - at)))
            at += 0 if z.unconsumed_tail else len(data)
            more = z.decompress(data, HEADER_BYTES)
            if not data and not more:
                break
            searched = max(0, len(head) - 3)
            head += more
            if head[:7] != b"WARC/1."[: len(head)]:
                return None
            if (end := head.find(b"\r\n\r\n", searched)) >= 0:
                lines = bytes(head[: end + 2])
                return lines if re.search(rb"\r\ncontent-length[ \t]*:", lines, re.IGNORECASE) else None
    except zlib.error:
        pass
    return None


def _member(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """The decoded member and where it ends; None if it is damaged."""
    z, out, at = zlib.decompressobj(31), [], offset
    try:
        while not z.eof:
            data = window.at(at, min(CHUNK, window.size - at))
            if not data:
                return None
            out.append(z.decompress(data))
            at += len(data)
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in lines.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _damaged(path: str, offset: int, head: bytes) -> dict:
    fields = _fields(head)
    return {
        "file": path,
        "offset": offset,
        "page_id": _number(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "sound": False,
    }


def _parse(path: str, offset: int, content: bytes, with_payload: bool) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    stated_length = fields["content-length"]
    if not stated_length.isdigit() or int(stated_length) > len(rest):
        return _damaged(path, offset, head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = int(_fields(http).get("content-length", 0)) if revisit else len(payload)
    digest = stated if revisit else base32_sha1(payload)
    return {
        "file": path,
        "offset": offset,
        "page_id": _number(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": length,
        "payload_digest": digest,
        "sound": digest == stated,
        "payload": payload if with_payload and not revisit else None,
    }


def records_in_range(path: str, size: int, start: int, end: int, with_payload: bool = True):
    """The records that start in [start, end) of a file."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as source:
        window, at = _Window(source, size), start
        while (at := window.find(at, end)) >= 0:
            head = _header(window, at)
            found = _member(window, at) if head is not None else None
            if head is None:
                at += 1
            elif found is None:
                yield _damaged(path, at, head)
                at += 1
            else:
                yield _parse(path, at, found[0], with_payload)
                at = found[1]


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of archives given as path, bytes; one task or more per file, none per record."""
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    cuts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    ranges = files.select("path", "bytes", F.explode(cuts).alias("start")).repartitionByRange(min(int(n), MAX_TASKS), "path", "start")

    def run(batches):
        columns = [x.split()[0] for x in RECORDS.split(", ")]
        rows, held = [], 0
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"]):
                for r in records_in_range(path, int(size), int(start), min(int(size), int(start) + split_bytes), with_payload):
                    rows.append(r)
                    held += len(r["payload"] or b"") + 256
                    if held > 8 << 20:
                        yield _frame(rows, columns)
                        rows, held = [], 0
        if rows:
            yield _frame(rows, columns)

    return ranges.mapInPandas(run, RECORDS)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to", "payload_bytes"):
        frame[c] = frame[c].astype("Int64")
    return frame


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of every archive under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


_NIBBLES = " ".join(f"WHEN '{x:x}' THEN '{x:04b}'" for x in range(16))
_BIT = "{w} * CAST(substr(bits, CAST(5 * j + {i} AS BIGINT), 1) AS INTEGER)"
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (
  SELECT page_id, payload_bytes, first,
         array_to_string(list_transform(range(1, 41), lambda i: CASE substr(h, i, 1) {_NIBBLES} END), '') AS bits
  FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + {' + '.join(_BIT.format(w=16 >> i, i=i + 1) for i in range(5))}, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       true AS sound
FROM b
"""
