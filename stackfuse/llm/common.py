"""Shared helpers of the llm operators: blocks of texts, hashing, tables in the shared folder."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from ..session import shared as shared_dir

#: Texts go through numpy in runs of about so many bytes, which bounds a task's memory.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: With this, Spark drops the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def conf(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds in here."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cleaned(spark: SparkSession):
    """Queries that are run to their end in here leave no shuffle files behind. Not for queries that others run later."""
    return conf(spark, CLEANUP, "true")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage is cut, lost executors cost nothing, and no shuffle files stay."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: One random 64-bit number per byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D


@functools.lru_cache(maxsize=4)
def _powers(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    base = (BASE + 8 * salt) | 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse modulo 2^64."""
    return _powers(1 << max(20, int(n).bit_length()), salt)


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams of codes (uint64), by doubling; not mixed."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    out, size, step, width = None, 0, codes, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, size = step, width
            else:
                n = len(codes) - size - width + 1
                out, size = out[:n] * power(width) + step[size : size + n], size + width
        rest >>= 1
        if rest:
            n = len(step) - width
            step, width = step[:n] * power(width) + step[width : width + n], 2 * width
    return out


def sliding(values: np.ndarray, w: int, best=np.minimum) -> np.ndarray:
    """The least (or greatest) of each w values in a row."""
    if len(values) < w:
        return values[:0]
    out, width = values, 1
    while 2 * width <= w:
        out, width = best(out[:-width], out[width:]), 2 * width
    return out if width == w else best(out[: len(values) - w + 1], out[w - width : w - width + len(values) - w + 1])


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def runs(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows of about limit bytes; a longer text makes a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def plain(name: str) -> str:
    """A column name in backquotes."""
    return f"`{re.sub('`', '``', name)}`"


def fresh(columns: list[str], wanted: str) -> str:
    """A column name like wanted that is not taken."""
    taken = {c.lower() for c in columns}
    return next(x for x in itertools.chain([wanted], (f"{wanted}_{i}" for i in itertools.count(1))) if x.lower() not in taken)


def index_of(columns: list[str], name: str) -> int:
    """Where a column stands: the one of exactly that name, else the only one that differs in case alone."""
    found = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"there must be one column {name!r}")
    return found[0]


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, with fixed names and types; other columns, clashing or not, never come along."""
    return docs.select(F.col(plain(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(plain(text_col)).cast("string"), F.lit("")).alias("text"))


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes saved tables that are no longer needed."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, d, t, text: (d, t) orders documents; a null id comes last, and t tells texts of one id apart where ids repeat.

    Rows that are equal in id and text share a key: they are one document, and get the same result.
    """
    rows = doc_rows(docs, id_col, text_col).withColumn("d", F.coalesce("doc_id", F.lit(2**63 - 1)))
    return rows.withColumn("t", F.xxhash64("text") if repeated(rows) else F.lit(0).cast("long")).select("doc_id", "d", "t", "text")


def repeated(rows: DataFrame) -> bool:
    """Whether two rows have the same d."""
    return rows.groupBy("d").count().where("count > 1").limit(1).count() > 0


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal runs in order; touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return starts[first], reach[np.concatenate([first[1:] - 1, [len(reach) - 1]])]


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start long, end long>>"


def cut_out(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (keyed_rows) and byte spans (d, t, start, end) to remove, many for each key: what is removed of each row, and the
    digest of what is left. A shuffle of the texts; the spans of a document come together only as intervals of its bytes."""
    return cut_found(rows, spans.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans")), _intervals)


def _intervals(raw: bytes, x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return united(x.field("start").to_numpy(zero_copy_only=False), x.field("end").to_numpy(zero_copy_only=False))


def cut_found(rows: DataFrame, lists: DataFrame, find) -> DataFrame:
    """cut_out with one list for each key (d, t, spans), of which find(text, list) makes the intervals to remove."""

    def work(batches):
        for batch in batches:
            texts, found = texts_of(batch.column("text")), batch.column("spans")
            out = []
            for i, raw in enumerate(texts):
                x = found[i].values
                if x is None or not len(x):
                    out.append((len(raw), 0, [], hashlib.sha256(raw).hexdigest()))
                    continue
                a, b = find(raw, x)
                at, keep = 0, hashlib.sha256()
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    keep.update(raw[at:s])
                    at = e
                keep.update(raw[at:])
                out.append((len(raw), int((b - a).sum()), [{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)], keep.hexdigest()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([x[0] for x in out], pa.int64()),
                    "n_removed": pa.array([x[1] for x in out], pa.int64()),
                    "n_spans": pa.array([len(x[2]) for x in out], pa.int64()),
                    "kept_sha256": pa.array([x[3] for x in out], pa.string()),
                    "removed": pa.array([x[2] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
            )

    return rows.join(lists, ["d", "t"], "left").select("doc_id", "text", "spans").mapInArrow(work, REMOVED)
