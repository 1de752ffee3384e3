"""Packing by optimal length buckets.

Texts are cut into sequences of at most `longest` tokens of a vocabulary (pack_tokens), between pre-tokens, so that no character
is cut; or of a length column's units (pack). The histogram of all sequence lengths is made in one aggregation; dynamic
programming over it chooses the bucket boundaries that minimise padding. Inside each bucket, batches hold as many sequences as
the token budget takes when each is padded to the bucket's boundary.

The histogram has at most `longest` rows, whatever the input, so it may come to the driver. Numbering goes by cells of a
bucket, of about CELL sequences or FULL budgets each (whichever is less), by a hash of id, piece and length: no window sees a
whole bucket, and none grows with the input.

Nulls: a null or empty text (or a length of 0 or null) is one sequence of length 0. A null id is an id like others. Repeated
rows are separate sequences. Empty tables give empty results. Only the id and text (or length) columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens

#: Sequences and budgets of tokens in a numbering cell, about; each cell ends with one batch that may not be full.
CELL, FULL = 20_000, 64


def boundaries(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """The at most k upper bounds, each a length that occurs, that minimise sum(counts * (bound - length)).

    lengths ascend. O(k n log n) by divide and conquer, as the cost is monotone (the best split point never moves left).
    """
    n = len(lengths)
    if n == 0:
        return []
    size, cnt = np.array(lengths, np.float64), np.array(counts, np.float64)
    total, weight = np.concatenate([[0], np.cumsum(cnt)]), np.concatenate([[0], np.cumsum(cnt * size)])

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding of lengths i..j-1 in one bucket."""
        return (total[j] - total[i]) * size[j - 1] - (weight[j] - weight[i])

    best = np.array([0.0] + [float(cost(np.array(0), j)) for j in range(1, n + 1)])
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(k, n)):
        new, frm = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            values = best[i] + cost(i, mid)
            at = int(values.argmin())
            new[mid], frm[mid] = values[at], i[at]
            todo += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        best = new
        back.append(frm)
    out, j = [], n
    for frm in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(frm[j])
    return sorted(set(out))


def sequences(docs: DataFrame, longest: int, length_col: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length: what a text of more than longest units is cut into."""
    rows = docs.select(F.col(C.plain(id_col)).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(C.plain(length_col)).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    last = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / longest).cast("long")
    cut = rows.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("size") - start, F.lit(longest)).cast("int").alias("length"))


def pack(docs: DataFrame, length_col: str, k: int = 16, longest: int = 4096, budget: int = 65_536, id_col: str = "doc_id") -> DataFrame:
    """place() for texts of which only lengths are known: doc_id, piece, start and length in units of length_col."""
    return place(sequences(docs, longest, length_col, id_col), k, longest, budget)


def pack_tokens(docs: DataFrame, path: str, k: int = 16, longest: int = 4096, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """place() for texts, in tokens of the vocabulary in path: doc_id, piece, start (code points), length (tokens) and, with texts,
    the text of each sequence. The texts of a document's pieces, joined, are its text."""
    rows = tokens.token_sequences(docs, path, longest, id_col, text_col)
    return place(C.saved(rows if texts else rows.drop("text"), "sequences"), k, longest, budget)


def place(rows: DataFrame, k: int, longest: int, budget: int) -> DataFrame:
    """rows (doc_id, piece, length and more) with bucket (its number), bucket_len, cell, batch, slot. A batch is known by (bucket,
    cell, batch); slot is the place in it."""
    if budget < longest:
        raise ValueError("the token budget must hold the longest sequence")
    histogram = sorted((r[0], r[1]) for r in rows.groupBy("length").count().collect())  # at most longest + 1 rows
    bounds = boundaries([a for a, _ in histogram], [b for _, b in histogram], k)
    if not bounds:
        bounds = [0]
    inside = [[(a, n) for a, n in histogram if lo < a <= hi] for lo, hi in zip([-1, *bounds[:-1]], bounds, strict=True)]
    inside = [max(sum(n for _, n in x) / CELL, sum(a * n for a, n in x) / (FULL * budget)) for x in inside]
    bucket, bound, cells, holds = F.lit(0), F.lit(bounds[0]), F.lit(1), F.lit(1)
    for i, (hi, n) in reversed(list(enumerate(zip(bounds, inside, strict=True)))):
        here = F.col("length") <= hi
        last = i == len(bounds) - 1
        put = lambda value, rest, here=here, last=last: F.lit(value) if last else F.when(here, F.lit(value)).otherwise(rest)
        bucket, bound, cells, holds = put(i, bucket), put(hi, bound), put(max(1, round(n)), cells), put(budget // max(1, hi), holds)
    placed = rows.withColumns({"bucket": bucket, "bucket_len": bound, "cells": cells, "holds": holds})
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "piece", "length")))
    placed = placed.withColumn("cell", (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % F.col("cells")).cast("int"))
    order = Window.partitionBy("bucket", "cell").orderBy("length", "doc_id", "piece")
    at = (F.row_number().over(order) - 1).cast("long")
    return placed.withColumn("at", at).select(*rows.columns, "bucket", "bucket_len", "cell", F.floor(F.col("at") / F.col("holds")).cast("long").alias("batch"), (F.col("at") % F.col("holds")).cast("int").alias("slot"))
