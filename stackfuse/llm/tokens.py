"""Token counts of byte-level BPE vocabularies, without token ids.

Pieces are counted once per distinct pre-token that a worker meets, joined to the per-document pre-token frequencies by a table in
memory, and summed; no document has a list of ids. The merges of such a vocabulary never cross a pre-token, so the sums are exact. Strings of
added tokens inside a text count one each, as the library does by default; texts between them are cut separately.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id stays null. Equal rows give equal rows. Empty tables give
empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: How byte-level pre-tokenizers of this family cut a text, for texts of the characters below.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: Texts with others go through the library's own pre-tokenizer, as versions of Unicode differ in what is a letter.
OTHER = re.compile("[^\\t-\\r -~\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2026]")
#: So many counted pre-tokens are remembered in a worker at most (about 100 bytes each); then the memory starts anew.
REMEMBERED = 500_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_pretokens long, n_distinct long"


class Counts:
    """Pieces per distinct pre-token, remembered between the blocks of a task."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary without a normalizer or a prefix space is needed")
        added = [t for t in spec.get("added_tokens", ())]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that strip spaces aren't supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.cut = re.compile(PATTERN).findall
        ranked = self._ranked(spec["model"])
        self.known = _Pieces(ranked or (lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids))

    def _ranked(self, model: dict):
        """An encoder of single pre-tokens with the same merges, where each piece comes of one merge at most; else None."""
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the characters that stand for bytes
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes([b]): i for i, b in enumerate([*shown, *rest])}
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = bytes(byte[c] for c in left + right)
            if whole in ranks:
                return None
            ranks[whole] = 256 + i
        return tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def pretokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and the number of added tokens."""
        parts, added = [text], 0
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            added = len(parts) - 1
        counts: Counter = Counter()
        for part in parts:
            counts.update(self._words(part))
        return counts, added

    def segments(self, text: str, longest: int) -> list[tuple[int, int, int]]:
        """Cuts a text into stretches (start, end, tokens) of at most longest tokens, as long as can be, between pre-tokens. A
        pre-token of more tokens is cut between characters, into parts of at most longest bytes."""
        words: list[str] = []
        alone: list[int] = []  # added tokens among them
        at = 0
        for m in [*self.added.finditer(text)] if self.added else []:
            words += self._words(text[at : m.start()])
            alone.append(len(words))
            words.append(m[0])
            at = m.end()
        words += self._words(text[at:])
        count = self.pieces(words)
        count[alone] = 1
        size = np.fromiter(map(len, words), np.int64, len(words))
        if (big := np.flatnonzero(count > longest)).size:
            parts, counts, last = [], [], 0
            for i in big.tolist():
                own = _in_bytes(words[i], longest)
                parts += [*words[last:i], *own]
                counts += [count[last:i], self.pieces(own)]
                last = i + 1
            count = np.concatenate([*counts, count[last:]])
            size = np.array([len(w) for w in [*parts, *words[last:]]])
        tokens, chars = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(size)])
        out, i = [], 0
        while i < len(count):
            j = int(np.searchsorted(tokens, tokens[i] + longest, side="right")) - 1
            out.append((int(chars[i]), int(chars[j]), int(tokens[j] - tokens[i])))
            i = j
        return out or [(0, 0, 0)]

    def _words(self, part: str) -> list[str]:
        """The pre-tokens of a text without added tokens, in order."""
        return [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)] if OTHER.search(part) else self.cut(part)

    def pieces(self, words: list[str]) -> np.ndarray:
        """The number of pieces of each."""
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, pre-tokens, distinct pre-tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = np.zeros((3, len(texts)), np.int64)
        pieces = self.known.__getitem__
        for i, t in enumerate(texts):
            counts, added = self.pretokens(t)
            # the join of the text's frequencies with the pieces of distinct pre-tokens, summed
            out[0, i] = added + sum(map(operator.mul, map(pieces, counts), counts.values()))
            out[1, i], out[2, i] = counts.total(), len(counts)
        return out[0], out[1], out[2]


class _Pieces(dict):
    """Pieces per distinct pre-token, counted when it is first met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.encode(word))
        return n


_MADE: dict[str, Counts] = {}


def _counts(path: str) -> Counts:
    """A worker's counter; what it remembers serves all tasks that the worker runs."""
    if path not in _MADE:
        _MADE.clear()
        _MADE[path] = Counts(path)
    return _MADE[path]


def _in_bytes(word: str, most: int) -> list[str]:
    """A word in parts of at most most bytes (or one character)."""
    out, start, size = [], 0, 0
    for i, c in enumerate(word):
        n = len(c.encode("utf-8", "replace"))
        if size + n > most and i > start:
            out.append(word[start:i])
            start, size = i, 0
        size += n
    return [*out, word[start:]]


def token_sequences(docs: DataFrame, path: str, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start (code points), length (tokens), text: each text in pieces of at most longest tokens, which joined give
    the text again; an empty or null one is a piece of length 0. No shuffle."""

    def work(batches):
        counter = _counts(path)
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            for start, end in C.runs([len(t) for t in texts], 2 * C.BLOCK_BYTES):
                own = [C.text(t) for t in texts[start:end]]
                tokens, _, _ = counter.block(own)
                cuts = [[(0, len(t), n)] if n <= longest else counter.segments(t, longest) for t, n in zip(own, tokens.tolist(), strict=True)]
                owner = np.repeat(np.arange(start, end), [len(c) for c in cuts])
                flat = [x for c in cuts for x in c]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(owner)),
                        "piece": pa.array([i for c in cuts for i in range(len(c))], pa.int32()),
                        "start": pa.array([x[0] for x in flat], pa.int64()),
                        "length": pa.array([x[2] for x in flat], pa.int32()),
                        "text": pa.array([t[a:b] for t, c in zip(own, cuts, strict=True) for a, b, _ in c], pa.string()),
                    }
                )

    return C.doc_rows(docs, id_col, text_col).mapInArrow(work, "doc_id long, piece int, start long, length int, text string")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per document its bytes and tokens, and whether they are more than limit. No shuffle: one pass over the texts.

    path: the vocabulary file, which must be at the same place on every executor.
    """

    def work(batches):
        counter = _counts(path)
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            for start, end in C.runs([len(t) for t in texts], 2 * C.BLOCK_BYTES):
                tokens, every, distinct = counter.block([C.text(t) for t in texts[start:end]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id")[start:end],
                        "n_bytes": pa.array([len(t) for t in texts[start:end]], pa.int64()),
                        "n_tokens": pa.array(tokens),
                        "over_limit": pa.array(tokens > limit),
                        "n_pretokens": pa.array(every),
                        "n_distinct": pa.array(distinct),
                    }
                )

    return C.doc_rows(docs, id_col, text_col).mapInArrow(work, SCHEMA)
