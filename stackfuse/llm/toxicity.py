"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as words: runs of letters, digits and bytes above 127, A-Z lowered. The input of a word is the sum of a
word vector (hashed) and the mean of its character vectors (hashed runs of four bytes of the word with a space before
and after it, which tells stems and endings apart). All windows of WINDOW words at every STRIDE words, each overlapping the next
by half, go through a GRU in both directions; attention pools the states; a logistic unit scores the window. A document's score
is that of its highest window. Training follows that: each step moves the network on the highest window of each labelled document (a toxic
document needs one toxic window, a clean one must have none), by Adam, with gradients written out below.

The network is fitted on a bounded sample: at most `per_class` labelled documents of each class and `most_bytes` bytes of
text in all, chosen by a hash of the id; whole texts. Rows whose crc32(doc_id) mod 5 is 0 are never learned from. Everything
else, windows and scores, covers all texts, at every size alike. Scores depend on the text alone.

Nulls: a null or empty text, or one without words, has one window of padding and so a score too; a null id stays null, is not
held out and is never learned from; labels that are null or not 0 or 1 are left out. An id that is labelled twice counts as
toxic if one label says so. Equal texts have equal scores. Without labels of both classes, all texts score 0. Empty tables
give empty results. Only doc_id, text and the labels doc_id, toxic are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, STRIDE = 30, 15
WORDS, GRAMS, WIDE, HIDDEN = 1 << 14, 1 << 15, 12, 8
PER_CLASS, MOST_BYTES = 1500, 8 << 20
#: Windows that go through the network at once.
AT_ONCE = 4096

_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Words:
    """The distinct words of some texts and the windows over them."""

    word: np.ndarray  # per distinct word: its number among WORDS
    grams: np.ndarray  # numbers of their character runs, one word after another
    first: np.ndarray  # where each word's runs start in grams
    windows: np.ndarray  # windows x WINDOW: distinct words, or -1
    owner: np.ndarray  # the text of each window, ascending; each text has one at least


def words_of(texts: list[bytes], window: int = WINDOW, stride: int = STRIDE) -> Words:
    low = _FOLD[np.frombuffer(b" " + b"  ".join(texts) + b"    ", np.uint8)]
    ends = np.cumsum([len(t) + 2 for t in texts])
    space = low == 32
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    up, down = C.powers(len(low) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(C.BYTE_CODES[low] * up[: len(low)])])
    hashes = C.mix((prefix[stops] - prefix[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    a, b = starts[at], stops[at]
    count = np.maximum(1, b - a - 1)  # runs of four from the space before to the space after
    first = np.cumsum(count) - count
    spot = np.repeat(a - 1, count) + np.arange(int(count.sum())) - np.repeat(first, count)
    run = np.zeros(len(spot), np.uint32)
    stop = np.repeat(b, count)  # a space; of a single letter the run is filled up with it
    for j in range(4):
        run = (run << np.uint32(8)) | low[np.minimum(spot + j, stop)]
    grams = ((C.mix(run.astype(np.uint64)) >> np.uint64(20)) % np.uint64(GRAMS)).astype(np.int32)
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    size = np.diff(bounds)
    many = np.maximum(1, -(-(size - window) // stride) + 1)
    owner = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    # the last window ends with the text
    offset = np.minimum(nth * stride, np.maximum(0, size[owner] - window))
    spots = offset[:, None] + np.arange(window)
    inside = spots < size[owner][:, None]
    windows = np.where(inside, (which if len(which) else np.zeros(1, np.int64))[np.minimum(spots + bounds[owner][:, None], max(0, len(which) - 1))], -1)
    return Words((distinct >> np.uint64(17)).astype(np.int64) % WORDS, grams, first, windows, owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


class Network:
    """Weights: word and character vectors, per direction the gates' inputs (reset, update, candidate) and recurrences,
    attention and output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": f(0.1, WORDS, WIDE),
            "gram": f(0.1, GRAMS, WIDE),
            "into": f(WIDE**-0.5, 2, WIDE, 3 * HIDDEN),
            "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "gates": f(HIDDEN**-0.5, 2, HIDDEN, 2 * HIDDEN),
            "cand": f(HIDDEN**-0.5, 2, HIDDEN, HIDDEN),
            "look": f((2 * HIDDEN) ** -0.5, 2 * HIDDEN),
            "out": f((2 * HIDDEN) ** -0.5, 2 * HIDDEN),
            "level": np.zeros(1, np.float32),
        }

    def vectors(self, words: Words, chosen: np.ndarray | None = None) -> np.ndarray:
        """Of the distinct words, and zeros for none at the end."""
        out = np.zeros((len(words.word) + 1, WIDE), np.float32)
        n = len(words.word)
        if n:
            count = np.diff(np.append(words.first, len(words.grams))).astype(np.float32)
            step = 20_000
            for i in range(0, n, step):  # in parts, as words may be long
                j = min(n, i + step)
                lo, hi = words.first[i], words.first[j] if j < n else len(words.grams)
                out[i:j] = self.p["word"][words.word[i:j]] + np.add.reduceat(self.p["gram"][words.grams[lo:hi]], words.first[i:j] - lo) / count[i:j, None]
        return out

    def forward(self, inputs: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows; inputs: per direction what each distinct word gives to the gates (zeros for none)."""
        steps, n, h2 = windows.shape[1], len(windows), 2 * HIDDEN
        state = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, 2, n, HIDDEN), np.float32)
        kept = []
        turned = windows.T
        for i in range(steps):
            x = np.stack([inputs[0][turned[i]], inputs[1][turned[steps - 1 - i]]])
            gate = _sigmoid(x[:, :, :h2] + state @ self.p["gates"])
            reset, update = gate[:, :, :HIDDEN], gate[:, :, HIDDEN:]
            cand = np.tanh(x[:, :, h2:] + (reset * state) @ self.p["cand"])
            new = cand + update * (state - cand)
            if keep:
                kept.append((state, reset, update, cand))
            state = states[i] = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # steps x n x 2H
        look = both @ self.p["look"]
        look = np.where(turned >= 0, look, np.float32(-30))
        look = np.exp(look - look.max(axis=0))
        look /= look.sum(axis=0)
        pooled = np.einsum("sn,snh->nh", look, both)
        logit = pooled @ self.p["out"] + self.p["level"]
        return (logit, kept, both, look, pooled) if keep else logit

    def inputs(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors @ self.p["into"][k] + self.p["bias"][k] for k in (0, 1)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The highest window's score of each text."""
        if not texts:
            return np.zeros(0)
        logits, words = self.logits(texts)
        first = np.flatnonzero(np.concatenate([[True], np.diff(words.owner) > 0]))
        # to six places: sums of floats may differ beyond with what else is in a block, and equal texts have equal scores
        return np.round(_sigmoid(np.maximum.reduceat(logits, first).astype(np.float64)), 6)

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, Words]:
        words = words_of(texts)
        return self.over(words), words

    def over(self, words: Words) -> np.ndarray:
        """The logits of all windows."""
        inputs = self.inputs(self.vectors(words))
        return np.concatenate([self.forward(inputs, words.windows[i : i + AT_ONCE]) for i in range(0, len(words.windows), AT_ONCE)])

    def gradients(self, words: Words, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        vectors = self.vectors(words)
        logit, kept, both, look, pooled = self.forward(self.inputs(vectors), windows, keep=True)
        steps, n, h2 = windows.shape[1], len(windows), 2 * HIDDEN
        err = ((_sigmoid(logit) - target) / n).astype(np.float32)
        g["out"], g["level"][0] = err @ pooled, err.sum()
        d_pooled = err[:, None] * p["out"]
        d_look = np.einsum("nh,snh->sn", d_pooled, both)
        d_look = look * (d_look - (look * d_look).sum(axis=0))
        d_look = np.where(windows.T >= 0, d_look, np.float32(0))
        g["look"] = np.einsum("sn,snh->h", d_look, both)
        d_both = look[:, :, None] * d_pooled + d_look[:, :, None] * p["look"]
        d_states = np.stack([d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=1)
        d_vec = np.zeros_like(vectors)
        back = np.zeros((2, n, HIDDEN), np.float32)
        turned = windows.T
        for i in reversed(range(steps)):
            state, reset, update, cand = kept[i]
            d = back + d_states[i]
            d_cand = d * (1 - update) * (1 - cand * cand)
            d_rh = d_cand @ p["cand"].transpose(0, 2, 1)
            d_gate = np.concatenate([d_rh * state * reset * (1 - reset), d * (state - cand) * update * (1 - update)], axis=2)
            back = d * update + d_rh * reset + d_gate @ p["gates"].transpose(0, 2, 1)
            g["cand"] += (reset * state).transpose(0, 2, 1) @ d_cand
            g["gates"] += state.transpose(0, 2, 1) @ d_gate
            d_x = np.concatenate([d_gate, d_cand], axis=2)
            g["bias"] += d_x.sum(axis=1, keepdims=True)
            for k, at in ((0, turned[i]), (1, turned[steps - 1 - i])):
                g["into"][k] += vectors[at].T @ d_x[k]
                np.add.at(d_vec, at, d_x[k] @ p["into"][k].T)
        d_vec = d_vec[:-1]
        np.add.at(g["word"], words.word, d_vec)
        count = np.diff(np.append(words.first, len(words.grams)))
        owner = np.repeat(np.arange(len(words.word)), count)
        np.add.at(g["gram"], words.grams, (d_vec / np.maximum(count, 1)[:, None])[owner])
        return g


def _subset(words: Words, windows: np.ndarray) -> Words:
    """Only the words that the windows hold."""
    used, at = np.unique(windows, return_inverse=True)
    at = at.reshape(windows.shape)
    if len(used) and used[0] == -1:
        used, at = used[1:], at - 1
    count = np.diff(np.append(words.first, len(words.grams)))[used]
    first = np.cumsum(count) - count
    spots = np.repeat(words.first[used], count) + np.arange(int(count.sum())) - np.repeat(first, count)
    return Words(words.word[used], words.grams[spots], first, at, np.zeros(0, np.int64))


class _Sample:
    """The windows of all texts, read in runs of about BLOCK_BYTES, which bounds the memory."""

    def __init__(self, texts: list[bytes]):
        self.parts = [words_of(texts[a:b]) for a, b in C.runs([len(t) for t in texts])]
        sizes = [len(p.windows) for p in self.parts]
        self.base = np.cumsum([0, *sizes])
        texts_before = np.cumsum([0, *(int(p.owner[-1]) + 1 for p in self.parts)])
        self.owner = np.concatenate([p.owner + n for p, n in zip(self.parts, texts_before, strict=False)])
        self.first = np.flatnonzero(np.concatenate([[True], np.diff(self.owner) > 0]))

    def logits(self, net: Network) -> np.ndarray:
        return np.concatenate([net.over(p) for p in self.parts])

    def seeds(self, toxic: np.ndarray) -> np.ndarray:
        """Of each window the greatest log odds of a word or character run: in how many toxic and clean documents they are."""
        seen = {"word": np.zeros((2, WORDS)), "gram": np.zeros((2, GRAMS))}
        doc = 0
        for p in self.parts:
            n = len(p.word)
            pairs = np.unique((p.owner[:, None] * (n + 1) + p.windows + 1).ravel())
            pairs = pairs[pairs % (n + 1) > 0]
            owner, word = pairs // (n + 1), pairs % (n + 1) - 1
            count = np.diff(np.append(p.first, len(p.grams)))[word]
            spots = np.repeat(p.first[word], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            for key, many, who, what in (("word", WORDS, owner, p.word[word]), ("gram", GRAMS, np.repeat(owner, count), p.grams[spots])):
                both = np.unique(who.astype(np.int64) * many + what)
                np.add.at(seen[key], (toxic[doc + both // many], both % many), 1)
            doc += int(p.owner[-1]) + 1
        total = np.bincount(toxic, minlength=2)
        odds = {k: np.log((v[1] + 0.5) / (total[1] + 1)) - np.log((v[0] + 0.5) / (total[0] + 1)) for k, v in seen.items()}
        out = []
        for p in self.parts:
            own = np.maximum(odds["word"][p.word], np.maximum.reduceat(odds["gram"][p.grams], p.first)) if len(p.word) else np.zeros(0)
            out.append(np.append(own, -np.inf)[p.windows].max(axis=1))
        return np.concatenate(out)

    def pick(self, which: np.ndarray) -> Words:
        """Windows by number (ascending), with their words. A word of several runs may stand there more than once."""
        found = []
        for p, lo, hi in zip(self.parts, self.base, self.base[1:], strict=False):
            own = which[(which >= lo) & (which < hi)] - lo
            if len(own):
                found.append(_subset(p, p.windows[own]))
        words = np.cumsum([0, *(len(f.word) for f in found)])
        grams = np.cumsum([0, *(len(f.grams) for f in found)])
        windows = np.concatenate([np.where(f.windows >= 0, f.windows + n, -1) for f, n in zip(found, words, strict=False)])
        return Words(np.concatenate([f.word for f in found]), np.concatenate([f.grams for f in found]), np.concatenate([f.first + n for f, n in zip(found, grams, strict=False)]), windows, np.zeros(0, np.int64))


def fit(texts: list[bytes], toxic: np.ndarray, rounds: int = 6, steps: int = 24, batch: int = 256, rate: float = 0.02, calm: float = 1e-3, seed: int = 3) -> Network:
    """Rounds: find each document's highest window, then so many steps of Adam on batches of these windows, half of each class.
    In the first round it is the window with the word that tells the classes apart best: from random windows, the network would
    learn whatever else toxic documents have in common, such as the text of a group of copies.

    calm: what Adam adds to the size of a gradient of word and character vectors. Words of one document have gradients far
    below it and hardly move, else the network would learn documents by heart.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    sample = _Sample(texts)
    first = sample.first
    many = np.diff(np.append(first, len(sample.owner)))
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    classes = [np.flatnonzero(toxic == k) for k in (0, 1)]
    for r in range(rounds):
        order = np.lexsort((-(sample.logits(net) if r else sample.seeds(toxic)), sample.owner))
        for _ in range(steps):
            docs = np.concatenate([rng.choice(c, batch // 2) for c in classes])
            reach = np.minimum(many[docs], 2 if r % 2 else 1)  # every other round the next window too
            pick = order[first[docs] + np.floor(rng.random(len(docs)) * reach).astype(np.int64)]
            ascending = np.argsort(pick, kind="stable")
            words = sample.pick(pick[ascending])
            g = net.gradients(words, words.windows, toxic[docs[ascending]].astype(np.float32))
            t += 1
            for k, x in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + (calm if k in ("word", "gram") else 1e-6))
    # the output's level is set on whole documents, all windows of them: half way between the classes
    top = np.maximum.reduceat(sample.logits(net), first)
    cuts = np.sort(top)
    wrong = np.array([(top[classes[0]] >= c).mean() + (top[classes[1]] < c).mean() for c in cuts])
    best = np.flatnonzero(wrong == wrong.min())
    lower = top[top < cuts[best[0]]]
    net.p["level"] -= np.float32((cuts[best[-1]] + (lower.max() if len(lower) else cuts[best[0]])) / 2)
    return net


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, **options) -> Network | None:
    """Fits a network on a bounded sample of labelled documents that aren't held out; None without both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    parts = [known.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].union(parts[1])  # 2 * per_class rows at most
    rows = C.doc_rows(docs).join(F.broadcast(chosen), "doc_id").withColumn("at", F.xxhash64("doc_id", "text"))
    # of each id one text, so that no more than 2 * per_class rows come to the driver, however often an id repeats
    one = rows.groupBy("doc_id").agg(F.min(F.struct("at", F.octet_length("text").alias("size"))).alias("least"))
    total, wanted = 0, []
    for at, size, i in sorted(tuple(r) for r in one.select("least.at", "least.size", "doc_id").collect()):  # in the order of a hash, as far as they go
        total += size
        if total > most_bytes:
            break
        wanted.append((i, at))
    if not wanted:
        return None
    spark = docs.sparkSession
    texts = rows.join(F.broadcast(spark.createDataFrame(wanted, "doc_id long, at long")), ["doc_id", "at"]).select("doc_id", F.col("text").cast("binary"), "toxic")
    found = sorted(((r[0], bytes(r[1]), r[2]) for r in texts.dropDuplicates(["doc_id"]).collect()), key=lambda r: r[0])
    toxic = np.array([r[2] for r in found], np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    return fit([r[1] for r in found], toxic, **options)


def _scores(net: Network | None, texts: list[bytes]) -> np.ndarray:
    return net.score(texts) if net is not None else np.zeros(len(texts))


def score_toxicity(docs: DataFrame, labels: DataFrame, net: Network | None = None, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. One pass over the texts after fitting, no shuffle of them."""
    sent = docs.sparkSession.sparkContext.broadcast(net or learn(docs, labels, **options))

    def work(batches):
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            for start, end in C.runs([len(t) for t in texts]):
                score = _scores(sent.value, texts[start:end])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[start:end], "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return C.doc_rows(docs).mapInArrow(work, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None, **options) -> DataFrame:
    """docs without the rows predicted toxic, all columns kept; source: where the labelled texts are, docs by default."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(learn(source if source is not None else docs, labels, **options))
    where = C.index_of(docs.columns, "text")

    def work(batches):
        for batch in batches:
            texts = C.texts_of(batch.column(where))
            for start, end in C.runs([len(t) for t in texts]):
                yield batch.slice(start, end - start).filter(pa.array(_scores(sent.value, texts[start:end]) < 0.5))

    return docs.mapInArrow(work, docs.schema)
