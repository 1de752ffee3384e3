"""Removal of repeated byte strings by suffix sorting, deep and shallow.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or earlier in the document).
Sorting every suffix of a corpus would move a hundred times its size, so hashes first prune what can't repeat; what is left is
sorted as strings, and only the sort decides.

Pruning. Each window of `length` bytes names its anchor, the k-gram of least hash in it; equal windows name equal anchors at
equal offsets. Runs of windows with one anchor are a block (about one for each 39 bytes). Blocks whose anchor occurs once
can't repeat.

Sorting, in three rounds over ever smaller strings, each of which holds the bytes of some windows in a row:

1. blocks that have a likely copy,
2. cells: of the first blocks of each kind whose anchor has other kinds too (any other is a copy of one), the windows in a grid of CELL offsets from the
   anchor, where another cell has the same middle (the bytes that all windows of the cell hold),
3. single windows: of the cells that are left of such a middle.

In each round, splitters sampled from the strings (and their places, so that equal strings can be split) deal them to tasks in
the order of the strings. A task sorts its range by multikey quicksort on words of eight bytes to a shallow depth; blind tries
order what still has a common prefix. Neighbours whose common prefix is all of both are equal: all but the first in the corpus
are removed. A string that goes on in the next range is settled among the ends of the ranges, two rows for each task. No round
gathers the strings of an anchor in one task, and none has a bound on how often something may occur.

Nulls: a null text counts as empty; a null id sorts after all others and stays null. Rows equal in id and text count as one
document; rows with one id and different texts are ordered by a hash of the text. Empty tables give empty results. Only the
id and text columns are read. A task needs about 60 bytes of memory for each byte of its longest text, and about ten times
SORTED bytes to sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, K = 100, 24
#: Bytes sorted word by word before blind tries take over.
SHALLOW = 32
#: Offsets from the anchor that make a cell.
CELL = 8
#: Bytes of strings in a range, about.
SORTED = 8 << 20
#: Bytes of texts whose anchors are found at once.
AT_ONCE = 1 << 17
#: How often the strings of a group are held against its first one before a trie takes the others.
HEADS = 3


class BlindTrie:
    """A trie of strings that keeps only the depths where they branch. Equal strings share a leaf."""

    END = -1  # the branch of strings that end here, which comes first

    def __init__(self):
        self.root, self.members = None, []

    def insert(self, s: bytes, i: int) -> None:
        if self.root is None:
            self.root = self._leaf(s, i)
            return
        node = self.root
        while isinstance(node, list):  # blind: bytes between the branches aren't looked at
            node = node[1].get(self._at(s, node[0])) or next(iter(node[1].values()))
        other = self.members[node.at][0]
        if s == other:
            self.members[node.at][1].append(i)
            return
        least = min(len(s), len(other))
        depth = next((x for x in range(least) if s[x] != other[x]), least)
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][self._at(s, node[0])]
        if isinstance(node, list) and node[0] == depth:
            node[1][self._at(s, depth)] = self._leaf(s, i)
            return
        split = [depth, {self._at(other, depth): node, self._at(s, depth): self._leaf(s, i)}]
        if above is None:
            self.root = split
        else:
            above[1][self._at(s, above[0])] = split

    class Leaf:
        __slots__ = ("at",)

        def __init__(self, at: int):
            self.at = at

    def _leaf(self, s: bytes, i: int) -> Leaf:
        self.members.append((s, [i]))
        return self.Leaf(len(self.members) - 1)

    def _at(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else self.END

    def ordered(self) -> list[list[int]]:
        """Members with equal strings, in the order of the strings."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(self.members[node.at][1])
        return out


def word_table(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each string raw[start : start + size] as words of eight bytes, first byte highest, filled up with zeros; a row for each
    place of words, so that a step of the sort reads one row."""
    wide = -(-int(sizes.max(initial=1)) // 8)
    full = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(full, 8)
    out = np.zeros((wide, len(starts)), np.uint64)
    for k in range(wide):
        left = sizes - 8 * k
        at = np.flatnonzero(left > 0)
        word = words[starts[at] + 8 * k].view(">u8").ravel().astype(np.uint64)
        cut = np.maximum(8 - left[at], 0).astype(np.uint64) * np.uint64(8)  # bytes beyond the string
        out[k, at] = word >> cut << cut
    return out


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the columns of words by their first depth words: the order, and where groups begin that are equal so far.

    All segments are split at once: each by a pivot, the median of three of its words, into less, equal and greater; only the
    equal part goes on to the next word.
    """
    n = words.shape[1]
    order = np.arange(n)
    begin, size, deep = np.array([0]), np.array([n]), np.array([0])
    heads = [np.zeros(0, np.int64)]
    while True:
        open_ = (size > 1) & (deep < depth)
        heads.append(begin[~open_ & (size > 0)])
        begin, size, deep = begin[open_], size[open_], deep[open_]
        if not len(begin):
            break
        first = np.cumsum(size) - size
        which = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(which)) + (begin - first)[which]
        key = words[deep[which], order[at]]
        probe = np.stack([key[first], key[first + size // 2], key[first + size - 1]])
        pivot = np.sort(probe, axis=0)[1]
        less, same = key < pivot[which], key == pivot[which]
        n_less, n_same = np.add.reduceat(less, first), np.add.reduceat(same, first)
        rank = lambda mask: np.cumsum(mask) - 1
        before = lambda count: np.cumsum(count) - count
        n_more = size - n_less - n_same
        more = ~(less | same)
        to = np.where(less, rank(less) - before(n_less)[which], np.where(same, rank(same) + (n_less - before(n_same))[which], rank(more) + (n_less + n_same - before(n_more))[which]))
        moved = np.empty(len(at), order.dtype)
        moved[to + first[which]] = order[at]
        order[at] = moved
        begin = np.concatenate([begin, begin + n_less, begin + n_less + n_same])
        size, deep = np.concatenate([n_less, n_same, n_more]), np.concatenate([deep, deep + 1, deep])
    return order, np.sort(np.concatenate(heads))


def deep_shallow(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings raw[start : start + size]: their order, and for each place of it whether the string before it is equal."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    words = word_table(raw, starts, sizes)
    order, begin = multikey_quicksort(words, min(max(1, shallow // 8), len(words)))
    group = np.cumsum(np.bincount(begin, minlength=n)) - 1
    # strings that equal one of the first few of their group share its place in the trie
    head = np.arange(n)  # of each place, the place of the string that stands for it
    left = np.flatnonzero(np.bincount(group)[group] > 1)
    for _ in range(HEADS):
        if not len(left):
            break
        first = np.concatenate([[True], group[left][1:] != group[left][:-1]])
        lead = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
        a, b = order[left], order[lead]
        same = sizes[a] == sizes[b]
        for w in words:
            same[same] = w[a[same]] == w[b[same]]
        head[left[same]] = lead[same]
        left = left[~same]
    stands = np.flatnonzero(head == np.arange(n))
    many = stands[np.bincount(group[stands], minlength=int(group[-1]) + 1)[group[stands]] > 1]
    rank = np.arange(n)
    text = raw.tobytes() if len(many) else b""
    for part in np.split(many, np.flatnonzero(np.diff(group[many])) + 1) if len(many) else []:
        trie = BlindTrie()
        for p in part.tolist():
            s = int(starts[order[p]])
            trie.insert(text[s : s + int(sizes[order[p]])], p)
        for place, equal in zip(part.tolist(), trie.ordered(), strict=False):
            rank[equal] = place
    by = np.argsort(rank[head], kind="stable")
    order = order[by]
    same = np.zeros(n, bool)
    a, b = order[1:], order[:-1]
    same[1:] = sizes[a] == sizes[b]
    for w in words:  # the common prefix of neighbours, word by word
        at = np.flatnonzero(same[1:])
        same[1:][at] = w[a[at]] == w[b[at]]
    return order, same


BLOCKS = "h int, anchor long, d long, t long, start int, windows int, whole long"


def anchored(raw: np.ndarray, ends: np.ndarray, length: int, k: int, only: bool = False) -> tuple[np.ndarray, ...]:
    """Of texts joined in raw that end at ends: the blocks' starts, windows, anchors' hashes and (unless only anchors are asked
    for) hashes as a whole."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    grams = C.mix(C.gram_hashes(C.BYTE_CODES[raw], k))
    place = _least(grams, length - k + 1)
    inside = np.ones(len(place), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    new = np.concatenate([[True], (place[1:] != place[:-1]) | ~inside[:-1]])
    starts = np.flatnonzero(new & inside)
    anchor = place[starts]
    if only:
        return starts, starts, grams[anchor], grams[anchor]
    stops = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
    windows = stops - starts
    up, down = C.powers(n + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(C.BYTE_CODES[raw] * up[:n])])
    shape = (windows * 4096 + anchor - starts).astype(np.uint64)
    whole = C.mix((prefix[stops + length - 1] - prefix[starts]) * down[starts] + shape)
    return starts, windows, grams[anchor], whole


def _least(grams: np.ndarray, w: int) -> np.ndarray:
    """Where the first of the least of each w hashes stands."""
    key = ((grams >> np.uint64(32)) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    return (C.sliding(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _blocks(length: int, k: int, counted: bool):
    """Blocks of keyed rows; counted: only (h, n), once for each h of a run of texts."""

    def work(batches):
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            d, t = (batch.column(c).to_numpy() for c in ("d", "t")) if not counted else (None, None)
            for a, b in C.runs([len(x) for x in texts], AT_ONCE):
                raw, ends = np.frombuffer(b"".join(texts[a:b]), np.uint8), np.cumsum([len(x) for x in texts[a:b]])
                starts, windows, anchors, whole = anchored(raw, ends, length, k, counted)
                h = (anchors >> np.uint64(32)).astype(np.uint32).view(np.int32)
                if counted:
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"h": pa.array(h), "n": pa.array(np.minimum(n, 2).astype(np.int8))})
                    continue
                owner = np.searchsorted(ends, starts, side="right")
                back = np.concatenate([[0], ends])[owner]
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array(h),
                        "anchor": pa.array(anchors.view(np.int64)),
                        "d": pa.array(d[a:b][owner]),
                        "t": pa.array(t[a:b][owner]),
                        "start": pa.array((starts - back).astype(np.int32)),
                        "windows": pa.array(windows.astype(np.int32)),
                        "whole": pa.array(whole.view(np.int64)),
                    }
                )

    return work


STRINGS = "d long, t long, start int, windows int, copied boolean, mixed boolean, bytes binary"


def _contents(length: int):
    """The bytes of the blocks that are to be sorted."""

    def work(batches):
        for batch in batches:
            d, t = (batch.column(c).to_numpy() for c in ("d", "t"))
            texts, lists = C.texts_of(batch.column("text")), batch.column("blocks")
            sizes = np.diff(lists.offsets.to_numpy())
            owner, packed = np.repeat(np.arange(len(texts)), sizes), lists.flatten().to_numpy()
            packed = packed[np.lexsort((packed, owner))]
            start, windows, mixed = packed >> 12, packed >> 2 & 1023, (packed & 1) > 0
            seen: set = set()  # of equal mixed blocks of one text, the first is enough
            for p in range(0, len(packed), 20_000):
                part = slice(p, p + 20_000)
                cut = [texts[i][s:e] for i, s, e in zip(owner[part].tolist(), start[part].tolist(), (start + windows + length - 1)[part].tolist(), strict=True)]
                for j in (np.flatnonzero(mixed[part]) + p).tolist():
                    if (key := (owner[j], cut[j - p])) in seen:
                        mixed[j] = False
                    seen.add(key)
                yield pa.RecordBatch.from_pydict(
                    {
                        "d": pa.array(d[owner[part]]),
                        "t": pa.array(t[owner[part]]),
                        "start": pa.array(start[part].astype(np.int32)),
                        "windows": pa.array(windows[part].astype(np.int32)),
                        "copied": pa.array((packed[part] & 2) > 0),
                        "mixed": pa.array(mixed[part]),
                        "bytes": pa.array(cut, pa.binary()),
                    }
                )

    return work


def _joined(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings joined, with their starts and sizes; the column's own bytes, not a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return raw, offsets[:-1], np.diff(offsets)


def _cells(length: int, k: int, cell: int, counted: bool):
    """Of blocks, the cells: windows whose offsets from the anchor are equal when divided by cell. The key is a hash of the bytes
    that every window of a whole cell holds, so equal windows have cells of equal keys. counted: only (key, n)."""

    def work(batches):
        for batch in batches:
            raw, base, _ = _joined(batch.column("bytes"))
            if not len(base):
                continue
            windows = batch.column("windows").to_numpy().astype(np.int64)
            anchor = _least(C.mix(C.gram_hashes(C.BYTE_CODES[raw], k)), length - k + 1)[base]
            block = np.repeat(np.arange(len(base)), windows)
            inner = np.arange(len(block)) - np.repeat(np.cumsum(windows) - windows, windows)
            number = (anchor[block] - base[block] - inner) // cell
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (number[1:] != number[:-1])]))
            many = np.diff(np.append(first, len(block)))
            block, inner, number = block[first], inner[first], number[first]
            middle = C.gram_hashes(C.BYTE_CODES[raw], length - cell + 1)[anchor[block] - cell * number]
            key = C.mix(middle + number.astype(np.uint64)).view(np.int64)
            if counted:
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "n": pa.array(np.minimum(n, 2).astype(np.int8))})
                continue
            text, at = raw.tobytes(), base[block] + inner
            cut = [text[s : s + w] for s, w in zip(at.tolist(), (many + length - 1).tolist(), strict=True)]
            start = batch.column("start").to_numpy()[block] + inner
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(key),
                    "d": batch.column("d").take(pa.array(block)),
                    "t": batch.column("t").take(pa.array(block)),
                    "start": pa.array(start.astype(np.int32)),
                    "windows": pa.array(many.astype(np.int32)),
                    "bytes": pa.array(cut, pa.binary()),
                }
            )

    return work


def _windows(length: int):
    """Of cells, the single windows."""

    def work(batches):
        for batch in batches:
            for p in range(0, batch.num_rows, 2000):
                part = batch.slice(p, 2000)
                windows = part.column("windows").to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(windows)), windows)
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                texts = C.texts_of(part.column("bytes"))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(np.zeros(len(owner), np.int64)),
                        "d": part.column("d").take(pa.array(owner)),
                        "t": part.column("t").take(pa.array(owner)),
                        "start": pa.array((part.column("start").to_numpy()[owner] + inner).astype(np.int32)),
                        "windows": pa.array(np.ones(len(owner), np.int32)),
                        "bytes": pa.array([texts[i][j : j + length] for i, j in zip(owner.tolist(), inner.tolist(), strict=True)], pa.binary()),
                    }
                )

    return work


UNIT = "key long, d long, t long, start int, windows int, bytes binary"
#: Of a sorted string: that it goes, that it is the first of its range, or that it stands at an end of the range.
GONE, KEPT, EDGE = 0, 1, 2


def _sorter(shallow: int, keep: bool):
    """Sorts a range. Strings that equal one before them go; the others are only returned where keep says so."""

    def work(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        got = pa.Table.from_batches(parts).combine_chunks()
        place = [x for c in ("start", "t", "d") if (x := got.column(c).to_numpy()).min() != x.max() or c == "start"]
        raw, starts, sizes = _joined(got.column("bytes"))
        by = np.lexsort(place)  # of equal strings, the first in the corpus comes first
        order, same = deep_shallow(raw, starts[by], sizes[by], shallow)
        order = by[order]
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        gone = same & ~np.logical_and.reduce([p[order] == p[lead] for p in place])  # equal rows share a place
        heads = np.flatnonzero(~same)
        ends = order[[heads[0], heads[-1]]]
        for which, state in ((order[gone], GONE), (order[heads] if keep else order[:0], KEPT), (ends, EDGE)):
            for p in range(0, len(which), 10_000):
                part = pa.array(which[p : p + 10_000])
                column = {c: got.column(c).take(part).combine_chunks() for c in got.column_names if state != GONE or c != "bytes"}
                if state == GONE:
                    column["bytes"] = pa.nulls(len(part), pa.binary())
                column["state"] = pa.array(np.full(len(part), state, np.int8))
                yield pa.RecordBatch.from_pydict(column)

    return work


def _round(units: DataFrame, total: int, length: int, shallow: int, keep: bool, size: int) -> tuple[DataFrame, DataFrame]:
    """Sorts units: the spans that go, and the sorted strings themselves."""
    n = max(C.partitions(units.sparkSession), -(-total // size))
    dealt = units.repartitionByRange(n, "bytes", "d", "t", "start")
    with C.conf(units.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", "30"):  # the sample comes to the driver
        done = C.saved(dealt.select("key", "d", "t", "start", "windows", "bytes").mapInArrow(_sorter(shallow, keep), UNIT + ", state byte"), "suffix-sorted")
    place = F.struct("d", "t", "start")
    edges = done.where(F.col("state") == EDGE)
    first = edges.groupBy("bytes").agg(F.min(place).alias("first"))
    late = edges.join(first, "bytes").where(place > F.col("first"))
    span = ["d", "t", (F.col("start").cast("long") * 4096 + F.col("windows")).alias("span")]
    return done.where(F.col("state") == GONE).select(*span).union(late.select(*span)), done


def _packed(length: int):
    """Spans of windows as intervals of bytes."""

    def find(raw: bytes, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        packed = x.to_numpy(zero_copy_only=False)
        return C.united(packed >> 12, (packed >> 12) + (packed & 4095) + length - 1)

    return find


def _total(units: DataFrame, length: int) -> int:
    return int(units.agg(F.sum(F.col("windows").cast("long") + (length - 1))).first()[0] or 0)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", k: int = K, shallow: int = SHALLOW, cell: int = CELL, sorted_bytes: int = SORTED) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (spans in bytes).

    sorted_bytes: strings that a task sorts at once, about; they come to one to three times the repeated text, so a very large
    corpus on large executors may take more of them in fewer tasks.
    """
    if not max(k, cell + 1) <= length <= 1000 + k:
        raise ValueError("length must be k at least, more than cell, and 1000 + k at most")
    spark = docs.sparkSession
    rows = C.keyed_rows(docs, id_col, text_col)
    counts = rows.select("text").mapInArrow(_blocks(length, k, True), "h int, n byte")
    seen = C.saved(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "suffix-anchors")
    blocks = rows.select("d", "t", "text").mapInArrow(_blocks(length, k, False), BLOCKS)
    again = C.saved(blocks.join(seen.hint("shuffle_hash"), "h").drop("h"), "suffix-blocks")
    C.release(spark, seen)
    kinds = C.saved(again.groupBy("anchor", "whole").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n")), "suffix-kinds")
    mixed = kinds.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("mixed"))
    wanted = kinds.join(mixed, "anchor", "left").where("n > 1 OR mixed").select("anchor", "whole", "first", (F.col("n") > 1).alias("copied"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
    # of a mixed kind, the blocks of the first id that has it: its first block is among them
    chosen = again.join(wanted.hint("shuffle_hash"), ["anchor", "whole"]).withColumn("mixed", F.col("mixed") & (F.col("d") == F.col("first"))).where("copied OR mixed")
    packed = F.col("start").cast("long") * 4096 + F.col("windows") * 4 + F.col("copied").cast("int") * 2 + F.col("mixed").cast("int")
    lists = chosen.select("d", "t", packed.alias("block")).repartition(C.partitions(spark), "d", "t").groupBy("d", "t").agg(F.collect_set("block").alias("blocks"))  # sets, as equal rows share a key
    content = rows.join(lists, ["d", "t"]).select("d", "t", "text", "blocks").mapInArrow(_contents(length), STRINGS)
    strings = C.saved(content, "suffix-strings")
    C.release(spark, again, kinds)

    copied = strings.where("copied")
    spans, _ = _round(copied.select(F.lit(0).cast("long").alias("key"), "d", "t", "start", "windows", "bytes"), _total(copied, length), length, shallow, False, sorted_bytes)

    several = strings.where("mixed").select("d", "t", "start", "windows", "bytes")
    keys = several.mapInArrow(_cells(length, k, cell, True), "key long, n byte").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    cells = C.saved(several.mapInArrow(_cells(length, k, cell, False), UNIT).join(keys, "key").select(*[x.split()[0] for x in UNIT.split(", ")]), "suffix-cells")
    C.release(spark, strings)
    more, kept = _round(cells, _total(cells, length), length, shallow, True, sorted_bytes)
    kept = kept.where(F.col("state") == KEPT)
    shared = kept.groupBy("key").count().where("count > 1").select("key")
    left = C.saved(kept.join(shared, "key").select("key", "d", "t", "start", "windows", "bytes"), "suffix-left")
    C.release(spark, cells)
    singles = int(left.agg(F.sum("windows")).first()[0] or 0)
    last, _ = _round(left.mapInArrow(_windows(length), UNIT), singles * length, length, shallow, False, sorted_bytes)
    lists = spans.union(more).union(last).repartition(C.partitions(spark), "d", "t").groupBy("d", "t").agg(F.collect_set("span").alias("spans"))
    return C.cut_found(rows, lists, _packed(length))
