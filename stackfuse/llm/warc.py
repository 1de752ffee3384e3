"""WARC archives: writing pages as records, and reading archives by boundary-chain verification.

Writing. Each page becomes a WARC/1.1 record, a response or (where an earlier page has the same payload) a revisit. What a page
refers to is joined by page and digest, in one shuffle of the pages at every size; no key is hot, as it holds the page's id.
Spark's text writer makes the files, compressed, with the record terminator (two line ends) as its line separator, so that
archives can go to any store Spark writes to, and lost tasks are simply run again. Files hold about FILE bytes of records.

Reading. Each task reads whole files. Every place that holds the magic and a whole header is a candidate; it names its successor
by its content length. Whether it is a record can't be told locally, as payloads may hold the magic. So the candidates of a
file form a forest, and pointer jumping from the file's start marks those that the chain of successors reaches: reach(i + 1) =
reach(i) with its images under jump(i), jump(i + 1) = jump(i) twice, about log2 of the candidates rounds. Others are rejected.
Only then are payloads digested, each byte once.

Nulls: a null html has an empty payload; a null page_id sorts after all others and is read back as null; a null or empty url
leaves its header out, and line ends in it are percent-encoded. Bytes of a string column that aren't UTF-8 are archived and
digested as they are. Repeated rows: of equal payloads all rows with the smallest page_id are responses. Empty tables give
empty archives and results. Only the id, url and html columns are read. A task holds the records of a file, and one payload
that is longer than FILE besides.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"WARC/1."
#: Bytes of records in a file, about.
FILE = 24 << 20
NO_ID = 2**63 - 1


def digest(payload: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uuid(page_id: int) -> str:
    return str(uuid.UUID(int=(0x5354 << 112) | (page_id + 2**63)))


def _page(text: str) -> int | None:
    value = (uuid.UUID(text.strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)) - 2**63
    return None if value == NO_ID else value


def record(page_id: int, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """A record without its terminator; refers_to makes it a revisit, which has no payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{_uuid(page_id)}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if url:
        head.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{_uuid(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload


def write_archives(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE) -> None:
    """Writes a record per page to text files in path. Payloads of fewer than least bytes are never revisits."""
    spark = pages.sparkSession
    rows = pages.select(
        F.coalesce(F.col(C.plain(id_col)).cast("long"), F.lit(NO_ID)).alias("page_id"), F.col(C.plain(url_col)).cast("string").alias("url"), F.coalesce(F.col(C.plain(html_col)).cast("string"), F.lit("")).alias("html")
    )
    total = rows.agg(F.sum(F.octet_length("html") + 512)).first()[0] or 0
    n = max(C.partitions(spark), -(-total // file_bytes))
    long = rows.where(F.octet_length("html") >= least).select("page_id", F.unhex(F.sha1("html")).alias("sha"))
    firsts = long.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "first")
    again = C.saved(long.join(firsts.hint("merge"), "sha").where("page_id > first").select("page_id", "sha", "first").distinct(), "warc-revisits")
    keyed = rows.withColumn("sha", F.unhex(F.sha1("html"))).repartition(n, "page_id", "sha").join(again.hint("merge"), ["page_id", "sha"], "left")

    def work(batches):
        for batch in batches:
            texts, urls = C.texts_of(batch.column("html")), C.texts_of(batch.column("url"))
            ids, refers = (batch.column(c).to_pylist() for c in ("page_id", "first"))
            for start, end in C.runs([len(t) for t in texts]):
                yield pa.RecordBatch.from_pydict({"value": pa.array([record(ids[i], C.text(urls[i]), texts[i], digest(texts[i]), refers[i]) for i in range(start, end)], pa.binary())})

    lines = keyed.select("page_id", "url", "html", "first").mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    with C.cleaned(spark):
        lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    C.release(spark, again)


_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The fields (names in lower case) of the header at a place, and where the payload begins; None if it is none."""
    line = data.find(b"\r\n", at, at + 12)
    if line < 0 or data[at : at + len(MAGIC)] != MAGIC:
        return None
    fields, at = {}, line + 2
    while data[at : at + 2] != b"\r\n":
        m = _FIELD.match(data, at)
        if not m:
            return None
        fields.setdefault(m[1].decode().lower(), m[2].decode("utf-8", "replace").strip())
        at = m.end()
    return (fields, at + 2) if re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) else None


RECORD = "file string, at long, type string, page_id long, refers_to long, digest string, length long, payload_digest string"


def candidates(data: bytes) -> tuple[list[tuple[int, int, int, dict[str, str]]], np.ndarray]:
    """Every place that holds a whole header: (place, payload begin, payload end, fields); and each one's successor, the number
    of the candidate that begins where its record ends, or one more than there are."""
    found = []
    at = data.find(MAGIC)
    while at >= 0:
        if (got := header(data, at)) is not None:
            end = got[1] + int(got[0]["content-length"])
            if data[end : end + 4] == b"\r\n\r\n":
                found.append((at, got[1], end, got[0]))
        at = data.find(MAGIC, at + 1)
    places = np.array([x[0] for x in found], np.int64)
    ends = np.array([x[2] + 4 for x in found], np.int64)
    jump = np.searchsorted(places, ends)
    n = len(found)
    lost = (jump < n) & (places[np.minimum(jump, max(0, n - 1))] != ends) if n else np.zeros(0, bool)
    return found, np.where(lost, n, jump)


def reachable(places: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Of candidates, those that the chain from the file's start reaches, by pointer jumping."""
    n = len(places)
    jump, reach = np.append(jump, n), np.append(places == 0, False)
    known = -1
    while (now := int(reach.sum())) != known:
        known = now
        reach[jump[np.flatnonzero(reach)]] = True
        reach[n] = False
        jump = jump[jump]
    return np.flatnonzero(reach[:n])


def _page_of(fields: dict[str, str], name: str) -> int | None:
    try:
        return _page(fields[name]) if name in fields else None
    except ValueError:
        return None


def _records(batches):
    names, kinds = zip(*((n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split(" ") for x in RECORD.split(", "))), strict=True)
    for batch in batches:
        for file, raw in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            data = unpacked(raw.as_buffer())
            found, jump = candidates(data)
            view, rows = memoryview(data), []
            for i in reachable(np.array([x[0] for x in found], np.int64), jump).tolist():
                at, body, end, fields = found[i]
                stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                length = int(x) if re.fullmatch(r"\d{1,18}", x := fields.get("x-payload-length", "")) else end - body
                kind = fields.get("warc-type", "")
                rows.append((file, at, kind, _page_of(fields, "warc-record-id"), _page_of(fields, "warc-refers-to"), stated, length, stated if kind == "revisit" else digest(view[body:end])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def unpacked(data) -> bytes:
    """A file's bytes, or those of all its gzip members."""
    data = memoryview(data).cast("B")
    if data[:2] != b"\x1f\x8b":
        return bytes(data)
    out = []
    while len(data):
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = memoryview(member.unused_data)
    return b"".join(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record that the chains reach: file, at (in the file's unpacked bytes), type, page_id, refers_to, digest
    (as stated), length (payload bytes; of a revisit, those of what it refers to), payload_digest (of the bytes read; of a
    revisit, as stated)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(_records, RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{C.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return read_archives(spark, path).select("page_id", F.col("length").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")
