"""Near-duplicates by circulant MinHash, with exact verification.

A document is the set of its distinct n-word shingles. One permutation (sigma) scatters the shingles over a circle, a second
one (pi), shifted by k places, gives coordinate k of the signature: all coordinates come from two permutations. Signatures are
cut into BANDS bands of ROWS coordinates; documents that agree in a band are candidates (at a similarity of 0.8 the chance
that no band agrees is below 6e-6; at 0.3 the chance that one does is 3 %). Links are confirmed on full shingle sets:

1. Equal sets are one node (their smallest id), so exact copies cost one row each.
2. Each bucket links its members to its smallest one; the components of these stars are candidate groups.
3. Every member is compared with the group's pivot (its smallest id), in parallel.
4. Members that aren't linked to the pivot are compared with all members that the triangle inequality of the Jaccard
   distance leaves possible, in blocks: no pair that could link is skipped, and no task sees an unbounded group.
5. The components of the confirmed links are the result.

Nulls: a null text, an empty one or one without words has no shingles (n_shingles 0) and is linked with nothing; a null id
sorts after all others. Where ids repeat, a document is named by its id and the hash of its text, in that order, in all joins
and groups: texts that share an id (or have none) are separate documents, and only the first of a group is kept. Rows equal in
id and text are one document, and get the same result. Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS = 40, 6
#: The circle's size, as a power of two.
CIRCLE = 20
#: Members in a block when leftovers are compared; a task holds two blocks.
BLOCK = 500
#: A node's edges are dealt to so many tasks where its label is looked up.
SALT = 8
LAST = 2**63 - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes (64 bits) of its n-word shingles; of all words together where they are fewer."""
    if not texts:
        return []
    low = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[low]
    before = np.concatenate([[True], space[:-1]])
    starts, stops = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    up, down = C.powers(len(low))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(C.BYTE_CODES[low] * up[: len(low)])])
    words = C.mix((prefix[stops] - prefix[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    grams = C.mix(C.gram_hashes(words, n))
    out = []
    for i in range(len(texts)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(C.mix(C.gram_hashes(words[a:b], b - a) + np.uint64(0x1234567 * (b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Circulant:
    """Signatures of sets of 64-bit hashes from two permutations of a circle."""

    def __init__(self, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 1 << CIRCLE
        self.k, self.sigma = k, rng.permutation(size).astype(np.uint32)
        pi = rng.permutation(size).astype(np.uint32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        at = self.sigma[(hashes >> np.uint64(64 - CIRCLE)).astype(np.int64)]
        out = self.shifts[at[:2048]].min(axis=0)
        for i in range(2048, len(at), 2048):
            np.minimum(out, self.shifts[at[i : i + 2048]].min(axis=0), out=out)
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per signature and band."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(C.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for j in range(rows):
        key = C.mix(key * np.uint64(C.BASE) + parts[:, :, j])
    return key.view(np.int64)


def _signed(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    def work(batches):
        circle = Circulant(bands * per_band)
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            for start, end in C.runs([len(t) for t in texts]):
                sets = shingle_sets(texts[start:end], n)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    found = band_keys(np.stack([circle.sign(sets[i]) for i in full]), bands, per_band)
                    for i, x in zip(full, found, strict=True):
                        keys[i] = x
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id")[start:end],
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    return rows.mapInArrow(work, f"id {_kind(rows)}, n_shingles long, digest binary, keys array<long>")


def _kind(rows: DataFrame) -> str:
    """The type of ids: a number, or a number and the hash of a text."""
    return rows.schema["id"].dataType.simpleString()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Of edges (a, b): node, label (the smallest node it is connected with), for all nodes but the labels themselves.

    Large stars and small stars take turns; each is a partial aggregation and a join. A node may have very many edges, so joins
    go by node and salt, the label of each node being there SALT times. Every round is a table in the shared folder.
    """
    now = C.saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = state(now)
    while seen[0]:
        # large stars: the smaller end of an edge gives way to the least neighbour it has itself; ends without one are least
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        large = _looked_up(now, "v", "u", least, "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _looked_up(large, "u", "v", low, "inner").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        before, now = now, C.saved(small, name)
        C.release(now.sparkSession, before)
        last, seen = seen, state(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _looked_up(edges: DataFrame, key: str, other: str, labels: DataFrame, how: str) -> DataFrame:
    """edges with the label m of the node in key."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALT)).cast("int"))
    copies = labels.select(F.col("u").alias("of"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("copy"))
    return salted.join(copies.hint("merge"), (F.col(key) == F.col("of")) & (F.col("salt") == F.col("copy")), how).select("u", "v", "m")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _blocks(percent: int):
    """Links between leftovers and other members of a group, of the blocks i and j of it."""

    def work(key, got):
        i, j = key[1].as_py(), key[2].as_py()
        linked, block, dist = (got.column(c).to_numpy() for c in ("linked", "block", "dist"))
        sets = [np.frombuffer(x, np.uint64) for x in got.column("set").to_pylist()]
        n, sizes = len(sets), np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n), sizes)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        members, first = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
        at = np.concatenate([[0], np.cumsum(sizes)])
        parent = list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        hub = None
        for x in np.flatnonzero(linked).tolist():  # all of them are connected by the pivot
            if hub is None:
                hub = x
            parent[x] = hub
        links = []
        for x in np.flatnonzero(~linked).tolist():
            mine = code[at[x] : at[x + 1]]
            both = np.bincount(np.concatenate([members[first[c] : first[c + 1]] for c in mine.tolist()]), minlength=n)
            other = (100 * both >= percent * (sizes[x] + sizes - both)) & (np.abs(dist - dist[x]) <= 1 - percent / 100 + 1e-9)
            if i != j:
                other &= block != block[x]
            for y in np.flatnonzero(other).tolist():
                if (a := root(x)) != (b := root(y)):
                    parent[a] = b
                    links.append((x, y))
        ids = got.column("id")
        return pa.table({"a": ids.take(pa.array([a for a, _ in links], pa.int64())), "b": ids.take(pa.array([b for _, b in links], pa.int64()))})

    return work


def _labelled(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, bands: int = BANDS, per_band: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: id (with the hash of its text, where ids repeat), n_shingles, component (such an id)."""
    rows = C.doc_rows(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "text")
    many = C.repeated(rows)
    rows = rows.select(_named("d", "text", many).alias("id"), "text")
    kind = _kind(rows)
    signed = C.saved(_signed(rows, n, bands, per_band), "minhash")
    nodes = C.saved(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node")), "minhash-nodes")
    keyed = signed.join(nodes.select("digest", F.col("node").alias("id")), ["digest", "id"]).select("id", F.explode("keys").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    edges = keyed.join(stars, "key").where("id > a").select("a", F.col("id").alias("b"))
    groups = components(edges, "minhash-groups")
    inside = groups.select(F.col("node").alias("id"), F.col("label").alias("pivot")).union(groups.select("label", "label").distinct())

    def full(batches):
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            for start, end in C.runs([len(t) for t in texts]):
                part = batch.slice(start, end - start)
                sets = [s.tobytes() for s in shingle_sets(texts[start:end], n)]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "pivot": part.column("pivot"), "set": pa.array(sets, pa.binary())})

    # texts and members both grow with the corpus: sorted and merged at every size
    sets = rows.join(inside.hint("merge"), "id").mapInArrow(full, f"id {kind}, pivot {kind}, set binary").where("length(set) > 0")
    sets = C.saved(sets.dropDuplicates(["id", "pivot"]) if many else sets, "minhash-sets")  # equal rows are one document
    pivots = sets.where("id = pivot").select("pivot", F.col("set").alias("own"))

    def compared(batches):
        for batch in batches:
            pairs = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("own").to_pylist(), batch.column("set").to_pylist(), strict=True)]
            both = np.array([_shared(a, b) for a, b in pairs], np.int64)
            union = np.array([len(a) + len(b) for a, b in pairs], np.int64) - both
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "pivot": batch.column("pivot"), "dist": pa.array(1 - both / np.maximum(union, 1)), "linked": pa.array(100 * both >= percent * union)})

    against = C.saved(sets.join(pivots, "pivot").select("id", "pivot", "own", "set").mapInArrow(compared, f"id {kind}, pivot {kind}, dist double, linked boolean"), "minhash-pivots")
    labels = against.select("id", F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("id")).alias("label"))
    left = against.groupBy("pivot").agg(F.min(F.when(~F.col("linked"), F.col("dist"))).alias("nearest"), F.count("*").alias("size")).where("nearest IS NOT NULL")
    reach = 1 - percent / 100 + 1e-9
    # a group may be very large: its one row of left is there SALT times, for its members by salt
    copies = left.withColumnRenamed("pivot", "of").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = against.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    doubtful = salted.join(copies.hint("merge"), (F.col("pivot") == F.col("of")) & (F.col("salt") == F.col("copy"))).where(F.col("dist") >= F.col("nearest") - reach)
    parts = F.ceil(F.col("size") / block).cast("int")
    doubtful = doubtful.select("id", "pivot", "dist", "linked", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("block"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    spread = doubtful.select("id", "pivot", "dist", "linked", "block", F.explode(pairs).alias("p")).join(sets, ["id", "pivot"])
    more = spread.select("pivot", "p.i", "p.j", "id", "dist", "linked", "block", "set").groupBy("pivot", "i", "j").applyInArrow(_blocks(percent), f"a {kind}, b {kind}")
    name = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    links = C.saved(more, "minhash-links")
    joined = links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    merged = components(joined, "minhash-merged")
    final = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("whole")), "label", "left")
    final = final.select(F.col("id").alias("node"), F.coalesce("whole", "label").alias("component"))
    names = C.saved(nodes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "minhash-names")
    C.release(rows.sparkSession, groups, sets, against, links, merged, nodes)
    found = signed.select("id", "n_shingles", "digest").join(names, "digest", "left")
    return found.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def _named(number: str, text: str, many: bool):
    return F.struct(F.col(number).alias("d"), F.xxhash64(text).alias("t")) if many else F.col(number)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, per_band: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id it is linked with, directly or not), kept."""
    found = _labelled(docs, n, percent, id_col, text_col, bands, per_band, block)
    number = lambda c: F.col(c if _kind(found) == "bigint" else f"{c}.d")
    real = lambda c: F.when(c != LAST, c)
    return found.select(real(number("id")).alias("doc_id"), "n_shingles", real(number("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are not kept; of repeated rows one stays."""
    found = _labelled(docs, n, percent, id_col, text_col)
    kept = found.where("id = component").select("id").distinct()
    key, own = C.fresh(docs.columns, "key_of_row"), C.fresh(docs.columns, "text_of_row")
    rows = docs.withColumn(key, F.coalesce(F.col(C.plain(id_col)).cast("long"), F.lit(LAST))).withColumn(own, F.coalesce(F.col(C.plain(text_col)).cast("string"), F.lit("")))
    rows = rows.withColumn(key, _named(key, own, _kind(found) != "bigint")).drop(own)
    stay = rows.join(kept.withColumnRenamed("id", key).hint("merge"), key, "left_semi")
    return stay.dropDuplicates([key, *[c for c in docs.columns if c.lower() in (id_col.lower(), text_col.lower())]]).drop(key)
