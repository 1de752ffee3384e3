"""Benchmark decontamination by q-gram lemma filtering.

Two strings of length m within e edits share at least m + 1 - q (e + 1) q-grams, on diagonals that differ by e at most. The
shared q-grams of a document and a benchmark item are found as maximal runs along a diagonal: a run begins where a shared gram
is preceded by different characters, so repetitive texts give as many runs as they have diagonals, not all pairs of grams. Runs
are counted in overlapping bands of diagonals; stretches of a band that reach the bound are kept, and a banded alignment
verifies them (a run of `window` characters needs none). A document is contaminated if `window` characters of an item (all of
an item that is shorter) occur in it within the edit budget. Case, punctuation and runs of white space don't count.

The benchmark goes to the executors in slices of at most SLICE bytes (or one item, if longer), which is checked; a larger one
takes more passes. A worker builds the index of a slice once.

Nulls: null texts count as empty and never match; null ids stay null. Items shorter than `q + q * e` characters after
normalising, where the bound says nothing, need an exact occurrence; those under LEAST characters one between word limits.
Items without letters or digits match nothing. Repeated rows each get their result, repeated items too. Empty tables give empty
results. Only the id and text columns are read, but for drop_contaminated, which keeps all columns. A task needs about 40 bytes
of memory for each byte of its longest text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: WINDOW characters of an item are the least passage that is found; shorter items are found whole.
Q, WINDOW, RATE, LEAST = 10, 100, 0.06, 20
#: Bytes of the benchmark in one pass.
SLICE = 16 << 20
#: Bits of the table that most q-grams fail at.
BITS = 22
#: Pairs of grams that are looked at together.
PAIRS = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32
SCHEMA = "doc_id long, item_id long, start long, end long, item_start long, item_end long, edits int"


def normal(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, other signs as spaces, single spaces; and the place of each byte that is left."""
    low = _FOLD[raw]
    space = low == 32
    keep = np.flatnonzero(~(space & np.concatenate([[True], space[:-1]])))
    return low[keep], keep


def stripped(raw: bytes) -> bytes:
    return normal(np.frombuffer(raw, np.uint8))[0].tobytes().strip()


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (first, count) its numbers first, first + 1, ...; and whose they are."""
    owner = np.repeat(np.arange(len(count)), count)
    return first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner], owner


class Index:
    """The q-grams of benchmark items and where they stand."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, window: int = WINDOW, rate: float = RATE):
        self.q = q
        named: dict[bytes, list] = {}
        for i, raw in items:
            if t := stripped(raw):
                named.setdefault(t, []).append(i)
        self.short: dict[int, dict[bytes, list]] = {}
        for t in [t for t in named if len(t) < max(LEAST, q)]:
            self.short.setdefault(len(t), {})[t] = named.pop(t)
        self.ids, self.texts, m, e = list(named.values()), [np.frombuffer(t, np.uint8) for t in named], [], []
        for t in self.texts:
            m.append(min(len(t), window))
            e.append(int(rate * m[-1]))
            while e[-1] and m[-1] + 1 - q * (e[-1] + 1) < 1:
                e[-1] -= 1
        self.m, self.e = np.array(m, np.int64), np.array(e, np.int64)
        self.bound = np.maximum(1, self.m + 1 - q * (self.e + 1))
        zero = np.zeros(1, np.uint8)
        self.all = np.concatenate([zero, *(x for t in self.texts for x in (t, zero))])  # zeros part the items
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.base = np.cumsum(sizes + 1) - sizes
        place, _ = _ranges(self.base, np.maximum(sizes - q + 1, 0))
        every = C.gram_hashes(C.BYTE_CODES[self.all], q)[place] if len(place) else np.zeros(0, np.uint64)
        before = self.all[place - 1]
        order = np.lexsort((before, every))
        self.place, every, before = place[order], every[order], before[order]
        # grams, and in each of them groups of places with the same sign before
        new = np.concatenate([np.ones(min(1, len(every)), bool), (every[1:] != every[:-1]) | (before[1:] != before[:-1])])
        self.group = np.append(np.flatnonzero(new), len(every))
        self.sign = before[new]
        self.grams, first = np.unique(every[new], return_index=True)
        self.first = np.append(first, len(self.sign))
        self.table = np.zeros(1 << BITS, bool)
        self.table[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text, item id, start, end, item start, item end, edits) in bytes of the text and characters of the normal item: a row
        for each stretch of the text that passages of the item cover."""
        if not texts:
            return []
        raw = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        norm, place = normal(raw)
        cut = np.searchsorted(place, np.concatenate([[0], ends]))
        last = np.searchsorted(place, ends - 1, side="right") - 1  # the space that is left of a text's end
        norm[last[last >= 0]] = 1  # a sign of no item
        out = []

        def put(i: int, ids: list, start: int, end: int, *rest: int) -> None:
            base = int(ends[i - 1]) if i else 0
            out.extend((i, k, int(place[start]) - base, int(place[end - 1]) + 1 - base, *rest) for k in ids)

        if self.short:
            for i, ids, start, end in self._words(norm, cut):
                put(i, ids, start, end, 0, end - start, 0)
        if len(self.grams):
            for (i, k), spans in sorted(self._passages(norm, cut).items()):
                for span in spans:
                    put(i, self.ids[k], *span)
        return sorted(out, key=lambda x: (x[0], x[2], x[3], x[4], -1 if x[1] is None else x[1]))

    def _words(self, norm: np.ndarray, cut: np.ndarray):
        """Exact occurrences of short items between word limits."""
        spaced = np.concatenate([np.array([32], np.uint8), np.where(norm == 1, 32, norm).astype(np.uint8), np.array([32], np.uint8)])
        text = spaced.tobytes()
        for size, known in self.short.items():
            wanted = np.sort(np.concatenate([C.gram_hashes(C.BYTE_CODES[np.frombuffer(b" " + t + b" ", np.uint8)], size + 2) for t in known]))
            grams = C.gram_hashes(C.BYTE_CODES[spaced], size + 2)
            for at in np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)] == grams).tolist():
                i = int(np.searchsorted(cut, at, side="right")) - 1
                if (ids := known.get(text[at + 1 : at + 1 + size])) and at + size <= cut[i + 1] and not (norm[at : at + size] == 1).any():
                    yield i, ids, at, at + size

    def _runs(self, norm: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of equal characters that hold a shared gram: place in the text, place in the items, length."""
        before = np.where(at > 0, norm[np.maximum(at, 1) - 1], 1)
        order = np.lexsort((before, which))
        at, which, before = at[order], which[order], before[order]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (before[1:] != before[:-1])])
        group = np.append(np.flatnonzero(new), len(at))
        which, before = which[group[:-1]], before[group[:-1]]
        theirs, ours = _ranges(self.first[which], self.first[which + 1] - self.first[which])
        differ = before[ours] != self.sign[theirs]
        theirs, ours = theirs[differ], ours[differ]
        n, k = np.diff(group)[ours], np.diff(self.group)[theirs]
        # each place of ours with the k places of theirs
        left, owner = _ranges(group[:-1][ours], n)
        k, theirs = k[owner], self.group[theirs[owner]]
        found = []
        stops = np.searchsorted(np.cumsum(k), np.arange(PAIRS, int(k.sum()) + PAIRS, PAIRS), side="left") + 1
        for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            right, own = _ranges(theirs[a:b], k[a:b])
            p, i = at[left[a:b][own]], self.place[right]
            found.append((p, i, self._common(norm, p, i)))
        return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))

    def _common(self, norm: np.ndarray, p: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How far text and items agree from each p and i on; signs that end texts and items never do."""
        size = np.full(len(p), self.q)
        going = np.arange(len(p))
        ahead, step = np.arange(64), 64
        while len(going):
            part = going[: 1 << 15]
            a, b = (p + size)[part], (i + size)[part]
            x, y = np.minimum(a[:, None] + ahead, len(norm) - 1), np.minimum(b[:, None] + ahead, len(self.all) - 1)
            same = norm[x] == self.all[y]
            more = np.where(same.all(axis=1), step, same.argmin(axis=1))
            size[part] += more
            going = np.concatenate([part[more == step], going[1 << 15 :]])
        return size

    def _passages(self, norm: np.ndarray, cut: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, int, int, int]]]:
        """Per (text, item) the stretches (start, end, item start, item end, edits) in places of norm."""
        grams = C.gram_hashes(C.BYTE_CODES[norm], self.q)
        at = np.flatnonzero(self.table[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
        which = np.searchsorted(self.grams, grams[at])
        which[which == len(self.grams)] = 0
        same = self.grams[which] == grams[at]
        at, which = at[same], which[same]
        # items need bound hits in a text: texts with few hits go early
        doc = np.searchsorted(cut, at, side="right") - 1
        keep = np.bincount(doc, minlength=len(cut))[doc] >= self.bound.min()
        at, which = at[keep], which[keep]
        if not len(at):
            return {}
        p, i, size = self._runs(norm, at, which)
        item = np.searchsorted(self.base, i, side="right") - 1
        i = i - self.base[item]
        doc = np.searchsorted(cut, p, side="right") - 1
        found: dict[tuple[int, int], list] = {}
        whole = np.flatnonzero(size >= self.m[item])
        for x in whole.tolist():
            found.setdefault((int(doc[x]), int(item[x])), []).append((int(p[x]), int(p[x] + size[x]), int(i[x]), int(i[x] + size[x]), 0))
        found = {k: _merged(v) for k, v in found.items()}
        known: dict[tuple, list] = {}  # repetitive texts ask for the same alignment many times
        for key, lo, hi, a, b, start, end in sorted(self._regions(p, i, size, item, doc), key=lambda r: (r[0], r[5] - r[6], r[5], r[1])):
            spans = found.get(key, [])
            if any(s[0] <= start and end <= s[1] for s in spans):
                continue
            m, e, text = int(self.m[key[1]]), int(self.e[key[1]]), self.texts[key[1]]
            first, last = max(0, a - m + self.q), min(len(text) - m, b)
            begin, end = max(int(cut[key[0]]), first + lo - e), min(int(cut[key[0] + 1]), last + m + hi + e)
            if first > last or begin >= end:
                continue
            task = (text[first : last + m].tobytes(), norm[begin:end].tobytes(), first + lo - begin, hi - lo, m, e)
            if task not in known:
                known[task] = _aligned(*task)
            if more := [(x + begin, y + begin, u + first, v + first, w) for x, y, u, v, w in known[task]]:
                found[key] = _merged(spans + more)
        return found

    def _regions(self, p, i, size, item, doc):
        """Stretches of bands that hold bound shared grams within a window's length."""
        n = len(p)
        band = (p - i + (1 << 31)) // (self.e[item] + 1)
        x = np.concatenate([np.arange(n), np.arange(n)])
        band = np.concatenate([band, band - 1])
        order = np.lexsort((p[x], band, item[x], doc[x]))
        x, band = x[order], band[order]
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (item[x][1:] != item[x][:-1]) | (doc[x][1:] != doc[x][:-1])])
        group = np.cumsum(new) - 1
        stop = p[x] + size[x]
        far = np.int64(1) << 32
        reached = np.maximum.accumulate(group * far + stop)
        back = np.searchsorted(reached, group * far + np.maximum(0, stop - (self.m + self.e)[item[x]]), side="right")
        back = np.maximum(back, np.flatnonzero(new)[group])
        total = np.concatenate([[0], np.cumsum(size[x] - self.q + 1)])
        good = np.flatnonzero(total[1:] - total[back] >= self.bound[item[x]])
        if not len(good):
            return
        firsts = np.minimum.accumulate(back[good][::-1])[::-1]  # a later window may reach further back
        begins = np.flatnonzero(np.concatenate([[True], (firsts[1:] > good[:-1])]))
        for a, b in zip(firsts[begins].tolist(), good[np.append(begins[1:] - 1, len(good) - 1)].tolist(), strict=True):
            run = x[a : b + 1]
            d = p[run] - i[run]
            yield (int(doc[run[0]]), int(item[run[0]])), int(d.min()), int(d.max()), int(i[run].min()), int((i[run] + size[run]).max()) - self.q, int(p[run].min()), int((p[run] + size[run]).max())


def _aligned(item: bytes, text: bytes, at: int, width: int, m: int, e: int) -> list[tuple[int, int, int, int, int]]:
    """All windows of m characters of item, each aligned to the text on diagonals at - e .. at + width + e: for runs of windows
    that are within e edits, their place in the text and in the item, and the least edits."""
    own, norm = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    starts = np.arange(len(own) - m + 1)
    width = width + 2 * e + 1
    offset = starts[:, None] + (at - e) + np.arange(width)[None, :]
    dist = np.zeros((len(starts), width), np.int32)
    came = offset.copy()  # where in the text the alignment began
    ramp = np.arange(width, dtype=np.int32)
    for i in range(m):
        spot = offset + i
        inside = (spot >= 0) & (spot < len(norm))
        sign = np.where(inside, norm[np.clip(spot, 0, len(norm) - 1)], 0)
        new = dist + (sign != own[starts + i][:, None]) + (~inside) * 1000
        frm = came
        up = np.full_like(new, 1 << 20)
        up[:, :-1] = dist[:, 1:] + 1
        better = up < new
        if better.any():
            shifted = np.empty_like(came)
            shifted[:, :-1], shifted[:, -1] = came[:, 1:], came[:, -1]
            new, frm = np.where(better, up, new), np.where(better, shifted, frm)
        side = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if (side < new).any():
            src = np.maximum.accumulate(np.where(new - ramp <= np.minimum.accumulate(new - ramp, axis=1), np.arange(width), 0), axis=1)
            new, frm = side, np.take_along_axis(frm, src, axis=1)
        dist, came = new, frm
    least = dist.argmin(axis=1)
    rows = np.arange(len(starts))
    ok = np.flatnonzero(dist[rows, least] <= e)
    out = []
    for run in np.split(ok, np.flatnonzero(np.diff(ok) > 1) + 1) if len(ok) else []:
        start = max(int(came[run, least[run]].min()), 0)
        stop = min(max(int((offset[run, least[run]] + m).max()), start + 1), len(norm))
        out.append((start, stop, int(starts[run[0]]), int(starts[run[-1]]) + m, int(dist[run, least[run]].min())))
    return out


def _merged(spans: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Spans of one text and item that overlap become one, with the place in the item and the edits of the longest of them."""
    out: list[list] = []
    for s in sorted(set(spans)):
        if out and s[0] < out[-1][1]:
            if (s[3] - s[2], -s[4]) > (out[-1][3] - out[-1][2], -out[-1][4]):
                out[-1][2:] = s[2:]
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def _slices(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """The benchmark's rows, in slices of at most limit bytes each; of one row where that is longer. One is held at a time."""
    rows, part, size = C.doc_rows(benchmark, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text")), [], 0
    for r in rows.toLocalIterator():
        if part and size + len(r[1]) > limit:
            yield part
            part, size = [], 0
        part.append((r[0], bytes(r[1])))
        size += len(r[1])
    yield part


_BUILT: dict[str, Index] = {}


def _index(name: str, sent, *options) -> Index:
    """The index of a slice, built once by each worker; it keeps one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(sent.value, *options)
    return _BUILT[name]


def _passes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, slice_bytes: int, one):
    """one(frame, name, sent) for each slice. Of several, each pass is written and its slice given up before the next is sent."""
    slices = _slices(benchmark, item_col, item_text_col, slice_bytes)
    items, following = next(slices), next(slices, None)
    while True:
        sent = docs.sparkSession.sparkContext.broadcast(items)
        found = one(uuid.uuid4().hex, sent)
        if following is None:
            yield found
            return
        found = C.saved(found, "decontaminated")
        sent.unpersist()
        yield found
        items, following = following, next(slices, None)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, window: int = WINDOW, rate: float = RATE, slice_bytes: int = SLICE
) -> DataFrame:
    """A row for each item and stretch of a document that its passages cover: the span in the text (code points, end exclusive),
    the span in the normalised item, and the edits of the best window. No shuffle: one pass over the texts for each slice."""
    rows = C.doc_rows(docs, id_col, text_col)

    def one(name, sent):
        def work(batches):
            index = _index(name, sent, q, window, rate)
            for batch in batches:
                texts = C.texts_of(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                for start, end in C.runs([len(t) for t in texts]):
                    found = index.search(texts[start:end])
                    if found:
                        cols = []
                        for i, k, a, b, c, d, e in found:
                            t = texts[start + i]
                            head = len(C.text(t[:a]))
                            cols.append((ids[start + i], k, head, head + len(C.text(t[a:b])), c, d, e))
                        names = ("doc_id", "item_id", "start", "end", "item_start", "item_end", "edits")
                        yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int32() if n == "edits" else pa.int64()) for n, x in zip(names, zip(*cols, strict=True), strict=True)})

        return rows.mapInArrow(work, SCHEMA)

    out = None
    for part in _passes(docs, benchmark, item_col, item_text_col, slice_bytes, one):
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage; all columns stay. Rows are judged by themselves, so no
    join is needed and null ids are no matter. options: q, window, rate, slice_bytes."""
    q, window, rate = options.get("q", Q), options.get("window", WINDOW), options.get("rate", RATE)
    where = C.index_of(docs.columns, text_col)
    left = docs

    def one(name, sent):
        def work(batches):
            index = _index(name, sent, q, window, rate)
            for batch in batches:
                texts = C.texts_of(batch.column(where))
                for start, end in C.runs([len(t) for t in texts]):
                    keep = np.ones(end - start, bool)
                    keep[[x[0] for x in index.search(texts[start:end])]] = False
                    part = batch.slice(start, end - start)
                    yield part if keep.all() else part.filter(pa.array(keep))

        return left.mapInArrow(work, docs.schema)

    for left in _passes(docs, benchmark, "item_id", "text", options.get("slice_bytes", SLICE), one):  # noqa: B007
        pass
    return left
