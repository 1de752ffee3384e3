"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: each byte shifts it left and adds the byte's number, so it depends on the last 32
bytes alone. A chunk ends where the hash's upper bits are zero, at LEAST_CHUNK bytes at least and MOST_CHUNK at most. As cuts
depend on content, an insertion shifts the chunks after it but changes only those it touches. Chunks are deduplicated by
digest (128 bits, of two independent polynomial hashes, and the length): the first stays (smallest doc_id, then place), later
ones go. Only runs of repeated chunks with `least` bytes or more are removed, so that short common phrases stay.

Digests are counted with partial aggregation; only repeated ones are joined back, in a join that Spark can split where one
chunk is in very many documents.

passage_dedup finds whole repeated passages. A cut is where the gear hash is least among some window of SPREAD places, and the
GRAM bytes before a cut are its seed: a passage of GRAM + SPREAD - 1 = 127 bytes or more holds the same seeds wherever it is,
whatever stands around it. A seed that repeats is held against the SPREAD bytes on both sides of its first occurrence, and
grows over those that are equal; where a passage goes on beyond them, its next seed takes over. What has grown together is
judged by `least`, so neither the seeds nor their distance cut off the ends of a passage. What may stay are bytes whose seeds
occur first in another, shorter passage (README has the measured share).

Nulls: a null text counts as empty and loses nothing; a null id sorts after all others and stays null. Rows equal in id and
text count as one document. Of equal texts under several ids, the first keeps its chunks. Empty tables give empty results.
Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST_CHUNK, MOST_CHUNK, BITS = 24, 192, 5
#: Fewer repeated bytes in a row than this are left alone.
LEAST = 128

#: Bytes of a seed (what the gear hash sees), and places in each window that has one.
GRAM, SPREAD = 32, 96
#: Seeds that are compared at once.
MANY = 1 << 14

GEAR = (C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes up to it (fewer at the start), by doubling."""
    out, width = GEAR[raw], 1
    while width < 32:
        out[width:] += out[:-width] << np.uint32(width)  # the right side is made whole first
        width *= 2
    return out


def chunk_ends(raw: np.ndarray, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, bits: int = BITS) -> list[int]:
    """Where the chunks of one text end."""
    n, last, out = len(raw), 0, []
    for c in (np.flatnonzero(gear(raw) >> np.uint32(32 - bits) == 0) + 1).tolist():
        while c - last > most:
            last += most
            out.append(last)
        if c - last >= least:
            out.append(c)
            last = c
    while n - last > most:
        last += most
        out.append(last)
    if n > last:
        out.append(n)
    return out


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each raw[start:end]."""
    out = []
    for salt in (1, 2):
        codes = C.mix(C.BYTE_CODES + np.uint64(salt))
        up, down = C.powers(len(raw) + 1, salt)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(codes[raw] * up[: len(raw)])])
        out.append(C.mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    return out


SCHEMA = "d long, t long, start int, end int, lo long, hi long"


def chunks(rows: DataFrame, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, bits: int = BITS) -> DataFrame:
    """A row for each chunk of keyed rows."""

    def work(batches):
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            d, t = (batch.column(c).to_numpy() for c in ("d", "t"))
            for a, b in C.runs([len(x) for x in texts]):
                raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
                owner, starts, ends, base = [], [], [], [0]
                for i in range(a, b):
                    cut = chunk_ends(np.frombuffer(texts[i], np.uint8), least, most, bits)
                    owner.append(np.full(len(cut), i))
                    ends.append(np.array(cut, np.int64) + base[-1])
                    starts.append(np.array([0, *cut[:-1]][: len(cut)], np.int64) + base[-1])
                    base.append(base[-1] + len(texts[i]))
                owner, starts, ends = (np.concatenate(x) for x in (owner, starts, ends))
                lo, hi = _digests(raw, starts, ends)
                back = np.array(base)[owner - a]
                yield pa.RecordBatch.from_pydict(
                    {"d": pa.array(d[owner]), "t": pa.array(t[owner]), "start": pa.array((starts - back).astype(np.int32)), "end": pa.array((ends - back).astype(np.int32)), "lo": pa.array(lo), "hi": pa.array(hi)}
                )

    return rows.select("d", "t", "text").mapInArrow(work, SCHEMA)


def _runs(least: int):
    """Of each document's repeated chunks, the runs with least bytes or more."""

    def work(batches):
        for batch in batches:
            d, t, found = batch.column("d").to_numpy(), batch.column("t").to_numpy(), batch.column("spans")
            out = []
            for i in range(batch.num_rows):
                x = found[i].values
                a, b = C.united(x.field("start").to_numpy(), x.field("end").to_numpy())
                long = b - a >= least
                out.append((np.full(int(long.sum()), i), a[long], b[long]))
            owner, a, b = (np.concatenate([x[k] for x in out]).astype(np.int64) for k in range(3))
            yield pa.RecordBatch.from_pydict({"d": pa.array(d[owner]), "t": pa.array(t[owner]), "start": pa.array(a), "end": pa.array(b)})

    return work


def chunk_dedup(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", least_chunk: int = LEAST_CHUNK, most_chunk: int = MOST_CHUNK, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left, joined), removed (spans in bytes)."""
    spark = docs.sparkSession
    rows = C.keyed_rows(docs, id_col, text_col)
    found = chunks(rows, least_chunk, most_chunk, bits)
    place = F.struct("d", "t", "start")
    firsts = C.saved(found.groupBy("lo", "hi").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("lo", "hi", "first"), "chunk-firsts")
    C.release(spark)
    again = C.saved(found.join(firsts, ["lo", "hi"]).where(place > F.col("first")).select("d", "t", "start", "end"), "chunk-repeats")
    C.release(spark, firsts)
    lists = again.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = lists.mapInArrow(_runs(least), "d long, t long, start long, end long")
    return C.cut_out(rows, spans)


def seeds(raw: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Where the seeds of one text start."""
    hashes = gear(raw)[GRAM - 1 :].astype(np.uint64)
    places = np.arange(len(hashes), dtype=np.uint64)
    return np.unique(C.sliding(hashes << np.uint64(32) | places, spread) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _seeded(rows: DataFrame, spread: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            d, t = (batch.column(c).to_numpy() for c in ("d", "t"))
            for a, b in C.runs([len(x) for x in texts]):
                owner, starts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i in range(a, b):
                    raw = np.frombuffer(texts[i], np.uint8)
                    at = seeds(raw, spread)
                    if len(at):
                        owner.append(np.full(len(at), i))
                        starts.append(at)
                        keys.append(C.mix(C.gram_hashes(C.BYTE_CODES[raw], GRAM)[at]))
                owner, starts, keys = (np.concatenate(x) for x in (owner, starts, keys))
                yield pa.RecordBatch.from_pydict({"d": pa.array(d[owner]), "t": pa.array(t[owner]), "start": pa.array(starts.astype(np.int32)), "key": pa.array(keys.view(np.int64))})

    return rows.select("d", "t", "text").mapInArrow(work, "d long, t long, start int, key long")


def _contexts(spread: int):
    """The bytes around first occurrences: before and after are how many on each side are the text's own, the rest is filled."""

    def work(batches):
        last = None
        for batch in batches:
            texts, found = C.texts_of(batch.column("text")), batch.column("seeds")
            for i, raw in enumerate(texts):
                d, t = own = batch.column("d")[i].as_py(), batch.column("t")[i].as_py()
                if own == last:  # the join has sorted them: an equal row
                    continue
                last, x = own, found[i].values
                full, at = bytes(spread) + raw + bytes(spread), x.field("start").to_numpy()
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": x.field("key"),
                        "d": pa.array(np.full(len(x), d)),
                        "t": pa.array(np.full(len(x), t)),
                        "start": x.field("start"),
                        "before": pa.array(np.minimum(at, spread).astype(np.int32)),
                        "after": pa.array(np.minimum(len(raw) - at - GRAM, spread).astype(np.int32)),
                        "context": pa.array([full[s : s + GRAM + 2 * spread] for s in at.tolist()], pa.binary()),
                    }
                )

    return work


def _grown(spread: int, least: int):
    """The seeds of a text, grown as far as their first occurrences go along; of what they cover, runs of least bytes or more."""

    def equal(same: np.ndarray) -> np.ndarray:
        return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))

    def find(raw: bytes, x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        full = np.frombuffer(bytes(spread) + raw + bytes(spread), np.uint8)
        views = np.lib.stride_tricks.sliding_window_view(full, GRAM + 2 * spread)
        starts, ends = [], []
        for k in range(0, len(x), MANY):
            part = x.slice(k, MANY)
            at, before, after = (part.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "before", "after"))
            same = views[at] == np.frombuffer(b"".join(part.field("context").to_pylist()), np.uint8).reshape(len(at), -1)
            sure = same[:, spread : spread + GRAM].all(axis=1)
            left = np.minimum(equal(same[:, :spread][:, ::-1]), np.minimum(before, at))
            right = np.minimum(equal(same[:, spread + GRAM :]), np.minimum(after, len(raw) - at - GRAM))
            starts.append((at - left)[sure])
            ends.append((at + GRAM + right)[sure])
        a, b = C.united(np.concatenate(starts), np.concatenate(ends))
        long = b - a >= least
        return a[long], b[long]

    return find


def passage_dedup(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """The columns of chunk_dedup, with repeated passages removed from their first byte to their last."""
    spark = docs.sparkSession
    rows = C.keyed_rows(docs, id_col, text_col)
    found = _seeded(rows, spread)
    place = F.struct("d", "t", "start")
    firsts = C.saved(found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("key", "first"), "seed-firsts")
    C.release(spark)
    wanted = firsts.groupBy(F.col("first.d").alias("d"), F.col("first.t").alias("t")).agg(F.collect_list(F.struct("key", "first.start")).alias("seeds"))
    around = rows.join(wanted.hint("merge"), ["d", "t"]).select("d", "t", "text", "seeds").mapInArrow(_contexts(spread), "key long, d long, t long, start int, before int, after int, context binary")
    around = C.saved(around.select("key", place.alias("first"), "before", "after", "context"), "seed-contexts")
    C.release(spark, firsts)
    again = C.saved(found.join(around.hint("merge"), "key").where(place > F.col("first")).select("d", "t", "start", "before", "after", "context"), "seed-repeats")
    C.release(spark, around)
    # a set: equal rows share a key
    lists = again.groupBy("d", "t").agg(F.collect_set(F.struct("start", "before", "after", "context")).alias("spans"))
    return C.cut_found(rows, lists.hint("merge"), _grown(spread, least))
