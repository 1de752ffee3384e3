"""Document fingerprints by closed syncmers.

A k-mer of characters is an anchor if the least of its inner s-mers (by hash) lies first or last in it. That depends on the
k-mer alone, so equal passages hold equal anchors at equal distances, whatever stands around them. A fingerprint keeps the
`size` anchors of least hash with their places; two fingerprints are compared by the anchors that lie in the same order in
both (the longest such chain; insertions may shift them) against the `size` least of all their anchors.

Short texts (of fewer than 3 k characters) have few k-mers or none, so theirs are of SHORT characters.

Nulls: a null text counts as empty and has the fingerprint ''; a null id sorts after all others. Texts without an anchor
(shorter than a k-mer, or unlucky) have one that hashes the whole text. Rows with equal ids are separate documents, ordered by text.
An empty table gives an empty result. Only the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K, S, SIZE = 16, 6, 64
#: The k-mers of short texts, and their inner strings.
SHORT = (6, 3)


def anchors(texts: list[str], k: int = K, s: int = S, size: int = SIZE) -> list[list[tuple[int, int]]]:
    """Per text its anchors (32-bit hash, place), those of least hash, in the order of place."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    short = [len(t) < 3 * k for t in texts]
    for kind, sizes in ((False, (k, s)), (True, SHORT)):
        which = [i for i, x in enumerate(short) if x == kind]
        for i, found in zip(which, _anchors([texts[i] for i in which], *sizes, size) if which else [], strict=True):
            out[i] = found
    return out


def _anchors(texts: list[str], k: int, s: int, size: int) -> list[list[tuple[int, int]]]:
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    ends = np.cumsum(sizes)
    every = C.mix((np.concatenate(codes) if codes else np.zeros(0, np.uint32)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(every) >= k:
        inner = C.mix(C.gram_hashes(every, s))
        least = C.sliding(inner, k - s + 1)
        n = len(least)
        chosen = (least == inner[:n]) | (least == inner[k - s : k - s + n])
        cut = (ends[:-1, None] - np.arange(1, k)).ravel()  # k-mers that would reach into the next text
        chosen[cut[(cut >= 0) & (cut < n)]] = False
        places = np.flatnonzero(chosen)
        hashes = (C.mix(C.gram_hashes(every, k))[places] >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(places, np.concatenate([[0], ends]))
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if a < b:
                values, first = np.unique(hashes[a:b], return_index=True)
                found = zip((places[a + first[:size]] - (ends[i] - sizes[i])).tolist(), values[:size].tolist(), strict=True)
                out[i] = [(h, p) for p, h in sorted(found)]
    for i, t in enumerate(texts):
        if t and not out[i]:
            out[i] = [(int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:4], "big"), 0)]
    return out


def written(found: list[tuple[int, int]]) -> str:
    return ",".join(f"{h:08x}@{p:x}" for h, p in found)


def parsed(fingerprint: str) -> list[tuple[int, int]]:
    return [(int(h, 16), int(p, 16)) for h, p in (x.split("@") for x in fingerprint.split(",") if x)]


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]], size: int = SIZE) -> float:
    """0 to 1; 1 for equal fingerprints, two empty ones included."""
    if a == b:
        return 1.0
    at = dict(b)
    least = sorted({h for h, _ in a} | at.keys())[:size]
    if not least or not a or not b:
        return 0.0
    chain: list[int] = []
    for h, _ in a:
        if (p := at.get(h)) is not None and h <= least[-1]:
            i = bisect.bisect_left(chain, p)
            chain[i : i + 1] = [p]
    return len(chain) / len(least)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors int"


def edited(own: str, other: str) -> str:
    """The last third (rounded down) gives way to as many of the other's first characters, or all of them."""
    m = len(own) // 3
    return own[: len(own) - m] + other[:m]


def _chain(k: int, s: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by bucket, each bucket in its order and closed by the first row of the next one (tail)."""

    def work(batches):
        last: tuple | None = None  # bucket, doc_id, text, anchors: waits for the row after it
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            buckets, ids, tails = (batch.column(c).to_pylist() for c in ("bucket", "doc_id", "tail"))
            for start, end in C.runs([len(t) for t in texts]):
                own = [C.text(t) for t in texts[start:end]]
                prints = anchors(own, k, s, size)
                pairs = []
                for i, (t, p) in enumerate(zip(own, prints, strict=True), start):
                    if last is not None and last[0] == buckets[i]:
                        pairs.append((*last[1:], t, p))
                    last = None if tails[i] else (buckets[i], ids[i], t, p)
                if pairs:
                    changed = [edited(t, u) for _, t, _, u, _ in pairs]
                    after = anchors(changed, k, s, size)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([x[0] for x in pairs], pa.int64()),
                            "n_chars": pa.array([len(x[1]) for x in pairs], pa.int64()),
                            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
                            "fingerprint": [written(x[2]) for x in pairs],
                            "edited_fingerprint": [written(p) for p in after],
                            "near_edited": pa.array([likeness(x[2], p, size) for x, p in zip(pairs, after, strict=True)], pa.float64()),
                            "near_next": pa.array([likeness(x[2], x[4], size) for x in pairs], pa.float64()),
                            "n_anchors": pa.array([len(x[2]) for x in pairs], pa.int32()),
                        }
                    )

    return work


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, each against its neighbour by descending id.

    One shuffle of the texts, by ranges of ids. Quantiles of the ids set the ranges; the first row of each range is also sent
    to the range that precedes it, so that no order over all rows is needed. Only the heads of the ranges, four for each
    shuffle partition, come to the driver.
    """
    spark = docs.sparkSession
    rows = C.doc_rows(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    n = C.partitions(spark)
    many = 4 * n
    spans = sorted({float(x) for x in rows.approxQuantile("key", [i / many for i in range(1, many)], 1 / (4 * many))}) if n > 1 else []
    spans = spans or [0.0]  # two ranges at least are needed
    cut = Bucketizer(splits=[-float("inf"), *spans, float("inf")], inputCol="as_double", outputCol="bucket")
    placed = cut.transform(rows.withColumn("as_double", F.col("key").cast("double"))).drop("as_double").withColumn("bucket", F.col("bucket").cast("int"))
    heads = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.max("key")).collect())  # a row for each range
    targets = [(key, heads[(i + 1) % len(heads)][0]) for i, (_, key) in enumerate(heads)]
    sent = spark.createDataFrame(targets, "key long, target int")
    once = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    dealt = placed.join(F.broadcast(sent), "key", "left").select(
        "key", "doc_id", "text", F.explode(F.when(F.col("target").isNull(), F.array(once)).otherwise(F.array(once, F.struct(F.col("target").alias("bucket"), F.lit(1).alias("tail"))))).alias("at")
    )
    dealt = dealt.select("key", "doc_id", "text", "at.bucket", "at.tail").repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.desc("text"))
    return dealt.select("bucket", "doc_id", "tail", "text").mapInArrow(_chain(k, s, size), SCHEMA)
