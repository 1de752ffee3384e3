"""Secret scans with a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived (what any match must hold). A block of documents gets an
inverted index of the trigrams that the rules ask for; the rule's query intersects and unites their postings; the regex then
verifies the candidates. A rule without mandatory trigrams, such as runs of hex digits, scans every text.

Trigrams are over UTF-8 with A-Z lowered, in the index and in the queries alike, so they never lose a match.

Nulls: a null text counts as empty and has no spans; a null id stays null. Equal rows give equal rows; spans of different
kinds may overlap, those of one kind never do. Spans are in code points, end exclusive. Empty tables give empty results. Only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as RC
from re import _parser as RP

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rule:
    """least: of what the group holds, so many characters; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0
    base: bool = False


#: A private key: its header, and all up to the END line; where that is missing (before another line of five dashes), header
#: fields and base64 as far as it goes, with a shorter last line.
PEM_HEAD = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"
PEM_WHOLE = r"[^-]*(?:-{1,4}[^-]+)*-----END (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----"
PEM_FIELDS = r"(?:[\x09-\x0d ]*\n[A-Za-z-]+:[^\n]*)*"
PEM_LINES = r"""(?:(?:[\x09-\x0d ]|\\[rn]|["',>])+[A-Za-z0-9+/=]{16,})+"""
PEM_TAIL = r"[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/=]{1,15}"
PEM = rf"""{PEM_HEAD}(?:{PEM_WHOLE}|{PEM_FIELDS}(?:{PEM_LINES}(?:{PEM_TAIL}(?![^\x09-\x0d \\"']))?)?)"""

RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]+", least=24, base=True),
    Rule("pem", PEM),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# ---- queries: True (any text), ("t", trigram), ("and" | "or", {queries})


def _both(kind: str, parts) -> object:
    neutral = kind == "and"
    flat: set = set()
    for p in parts:
        if p is True:
            if not neutral:
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of(word: bytes) -> object:
    """What a text with this string must hold."""
    return _both("and", [("t", word[i : i + 3]) for i in range(len(word) - 2)])


def _any(words) -> object:
    return _both("or", [_of(w) for w in words]) if words else True


#: More strings than this aren't kept apart while a query is derived.
MOST = 64


class _Found:
    """Of a part of a regex: all strings it matches (exact) or else what they begin and end with, and what they must hold."""

    def __init__(self, exact=None, begin=frozenset([b""]), end=frozenset([b""]), holds=True):
        self.exact, self.begin, self.end, self.holds = exact, begin, end, holds

    def loose(self) -> _Found:
        if self.exact is None:
            return self
        return _Found(None, frozenset(w[:2] for w in self.exact), frozenset(w[-2:] for w in self.exact), _both("and", [self.holds, _any(self.exact)]))


def _join(a: _Found, b: _Found) -> _Found:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _Found(frozenset(x + y for x in a.exact for y in b.exact), holds=_both("and", [a.holds, b.holds]))
    ends, begins = a.exact if a.exact is not None else a.end, b.exact if b.exact is not None else b.begin
    seam = _any([x[-16:] + y[:16] for x in ends for y in begins]) if len(ends) * len(begins) <= MOST * 4 else True
    begin = frozenset((x + y)[:2] for x in a.exact for y in begins) if a.exact is not None else a.begin
    end = frozenset((x + y)[-2:] for x in ends for y in b.exact) if b.exact is not None else b.end
    la, lb = a.loose(), b.loose()
    return _Found(None, begin if len(begin) <= MOST else frozenset([b""]), end if len(end) <= MOST else frozenset([b""]), _both("and", [la.holds, lb.holds, seam]))


def _either(parts: list[_Found]) -> _Found:
    if all(p.exact is not None for p in parts) and len(every := frozenset().union(*(p.exact for p in parts))) <= MOST:
        return _Found(every, holds=_both("or", [p.holds for p in parts]))
    parts = [p.loose() for p in parts]
    return _Found(None, frozenset().union(*(p.begin for p in parts)), frozenset().union(*(p.end for p in parts)), _both("or", [p.holds for p in parts]))


def _chars(codes) -> _Found:
    return _Found(frozenset(chr(c).encode("utf-8", "surrogatepass").lower() for c in codes))


def _walk(tree, fold: bool) -> _Found:
    out = _Found(frozenset([b""]))
    for op, arg in tree:
        one = _Found()  # anything
        if op is RC.LITERAL:
            one = _chars([arg]) if not fold or arg < 128 else _Found()
        elif op is RC.IN and arg[0][0] is not RC.NEGATE:
            codes: list[int] | None = []
            for kind, x in arg:
                codes = codes + [x] if kind is RC.LITERAL and codes is not None else codes + list(range(x[0], x[1] + 1)) if kind is RC.RANGE and codes is not None and x[1] - x[0] < 128 else None
            if codes and len(set(codes)) <= 16 and not (fold and max(codes) >= 128):
                one = _chars(codes)
        elif op is RC.SUBPATTERN:
            one = _walk(arg[3], fold)
        elif op is RC.BRANCH:
            one = _either([_walk(x, fold) for x in arg[1]])
        elif op in (RC.MAX_REPEAT, RC.MIN_REPEAT, RC.POSSESSIVE_REPEAT):
            least, most, body = arg
            part = _walk(body, fold)
            if least == 0:
                one = _either([part, _Found(frozenset([b""]))]) if most == 1 else _Found()
            else:
                one = part
                for _ in range(min(least, 4) - 1):
                    one = _join(one, part)
                if most > least or least > 4:
                    one = _Found(None, *((x := one.loose()).begin, part.loose().end, x.holds))
        elif op is RC.AT:
            one = _Found(frozenset([b""]))
        out = _join(out, one)
    return out


def trigram_query(pattern: str, flags: int = 0):
    """The Boolean trigram query of a regex; True where it has no mandatory trigrams."""
    return _walk(RP.parse(pattern, flags), bool(flags & re.IGNORECASE)).loose().holds


def trigrams(query) -> set[bytes]:
    return set() if query is True else {query[1]} if query[0] == "t" else set().union(*map(trigrams, query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.find, self.queries = rules, [], []
        for r in rules:
            # a run of one class, shortened by least, has the same matches: the longest runs
            runs = re.fullmatch(r"(\[[^\]\\^]+\])\+", r.pattern)
            self.find.append(re.compile(runs[1] + "{%d,}" % r.least if runs and r.least else r.pattern, r.flags).finditer)
            self.queries.append(trigram_query(r.pattern, r.flags))
        wanted = sorted(set().union(*map(trigrams, self.queries)))
        self.code = {t: i for i, t in enumerate(wanted)}
        self.number = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for t, i in self.code.items():
            self.number[int.from_bytes(t, "big")] = i + 1
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def index(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Postings: trigram -> ordinals of the texts that hold it."""
        joined = self.lower[np.frombuffer(b"\0\0\0".join(texts), np.uint8)]
        ends = np.cumsum([len(t) + 3 for t in texts])
        if len(joined) < 3:
            return {}
        codes = joined[:-2].astype(np.uint32)
        codes <<= 8
        codes |= joined[1:-1]
        codes <<= 8
        codes |= joined[2:]
        found = self.number[codes]
        at = np.flatnonzero(found)
        pairs = np.unique((found[at].astype(np.int64) << 32) | np.searchsorted(ends, at, side="right"))
        which, docs = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(which)) + 1
        return {int(w[0]) - 1: d for w, d in zip(np.split(which, cuts), np.split(docs, cuts), strict=True)} if len(pairs) else {}

    def candidates(self, query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if query[0] == "t":
            return postings.get(self.code[query[1]], np.zeros(0, np.int64))
        out = None
        for part in sorted(query[1], key=repr):
            found = self.candidates(part, postings, n)
            out = found if out is None else np.intersect1d(out, found, True) if query[0] == "and" else np.union1d(out, found)
        return out

    def spans(self, texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], int]:
        """Per text the spans (start, rule, end) by start, then rule; and the number of texts that were verified."""
        strings = [C.text(t) for t in texts]
        postings = self.index(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        verified = 0
        for k, rule in enumerate(self.rules):
            for i in self.candidates(self.queries[k], postings, len(texts)).tolist():
                verified += 1
                out[i] += [(m.start(), k, m.end()) for m in self.find[k](strings[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in out], verified

    def named(self, spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans (array of kind, start, end). One pass, no shuffle."""

    def work(batches):
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = C.texts_of(batch.column("text"))
            for start, end in C.runs([len(t) for t in texts]):
                found, _ = scanner.spans(texts[start:end])
                rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[start:end], "spans": pa.array(rows, kind)})

    return C.doc_rows(docs, id_col, text_col).mapInArrow(work, "doc_id long, spans array<struct<kind string, start int, end int>>")


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The spans of scan_secrets as counts of the base kinds, a digest of the base spans and all spans in one string."""
    base = [r.kind for r in rules if r.base]
    item = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    kinds = F.transform("spans", lambda x: x["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    return scan_secrets(docs, rules).select(
        "doc_id", *count, F.sha2(F.array_join(F.transform(own, item), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", item), ",").alias("spans")
    )


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of a secret (for an assignment: its value) replaced by mark; spans that touch or overlap become one.

    All columns and rows stay; length_col, where there is such a column, is counted anew for changed texts. Null texts stay null.
    """

    def clean(scanner: Scanner, raw: bytes, spans: list[tuple[int, int, int]]) -> str:
        t, out, at = C.text(raw), [], 0
        cuts = []
        for a, k, b in spans:
            group = rules[k].group
            if group:
                m = next(scanner.find[k](t[a:b]))
                a, b = a + m.start(group), a + m.end(group)
            cuts.append((a, b))
        for a, b in sorted(cuts):
            if a > at or not out:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join(out) + t[at:]

    where = C.index_of(docs.columns, text_col)
    length = C.index_of(docs.columns, length_col) if length_col and length_col.lower() in [c.lower() for c in docs.columns] else None

    def work(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = C.texts_of(batch.column(where))
            for start, end in C.runs([len(t) for t in texts]):
                part = batch.slice(start, end - start)
                found, _ = scanner.spans(texts[start:end])
                hit = [i for i, x in enumerate(found) if x]
                if hit:
                    columns, rows = list(part.columns), columns_of(part, where)
                    for i in hit:
                        rows[i] = clean(scanner, texts[start + i], found[i])
                    columns[where] = pa.array(rows, part.schema.field(where).type)
                    if length is not None:
                        sizes = part.column(length).to_pylist()
                        for i in hit:
                            sizes[i] = len(rows[i])
                        columns[length] = pa.array(sizes, part.schema.field(length).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    def columns_of(part, at):
        return part.column(at).to_pylist()

    return docs.mapInArrow(work, docs.schema)
