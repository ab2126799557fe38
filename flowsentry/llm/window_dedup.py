"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles. For each of a few min-hash functions, the Cartesian tree of
the hashes (each node the least of its stretch) groups all runs of shingles that have the same least
hash: the compact window (l, c, r) holds the runs within [l, r] that hold c. Windows too short for a
passage are left out; their nodes are exactly those that are never the least of `width` neighbours, so
the tree is built of the remaining nodes only, about 2 / width of all.

Windows with the same function and least shingle share a signature; those with no partner are dropped.
The shingles around the others are fetched and the windows laid on each other at c. Every two windows of
a signature with different shingles around them are compared, but for those that can change nothing: a
window shares at most the shingles that some other window of the signature has, which bounds its passage
from outside; a window whose passage has reached that bound needs no further partner. Signatures of more
than HOT places are dealt into blocks of different windows, and each two blocks are compared in a task.

A run of `width` shingles around c is a near-duplicate passage if its Jaccard similarity with the run in
the other window is at least `similarity`; shingles count as shared up to `shift` places away, so
inserted or lost words do no harm. One shared signature is enough to be verified: with h functions a pair
at similarity s is found with probability 1 - (1 - s)^h per passage of the shortest length (0.992 for
the defaults), and longer passages have more windows. Copies of a text are compared once, as one text
whose windows match themselves too.

Defined results: as in suffix_dedup: null, empty and short texts have no row, repeated rows are repeats of
each other, ids may be null or tied, extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages as P
from . import words as W
from .frames import forget, written

#: Signatures of more places are compared block by block, in blocks of about so many different windows.
HOT, BLOCK = 32768, 16384


@dataclass(frozen=True)
class WindowLimits:
    """Shortest passage in words, words of a shingle, similarity, and min-hash functions."""

    min_words: int = 50
    shingle: int = 5
    similarity: float = 0.8
    functions: int = 3
    shift: int = 2

    @property
    def width(self) -> int:
        """Shingles of the shortest passage."""
        return self.min_words - self.shingle + 1


def least_places(values: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Places that are the least of some run of `width` values inside their text; ends: per value."""
    least = W.sliding(np.minimum, values, width)
    fits = np.arange(len(least)) + width <= ends[: len(least)]
    padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(fits, least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(W.sliding(np.maximum, padded, width)[: len(values)] == values)


def compact_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least `width` values; r is the last value's place.

    values: hashes above 0; starts, ends: for each value where its text begins and ends. Of equal values
    the first counts as the least.
    """
    at = least_places(values, ends, width)
    left, right = starts[at].tolist(), (ends[at] - 1).tolist()
    place, value, begin = at.tolist(), values[at].tolist(), left.copy()
    stack: list[int] = []  # the right spine of the tree
    for k in range(len(place)):
        while stack and (begin[stack[-1]] != begin[k] or value[stack[-1]] > value[k]):
            top = stack.pop()
            if begin[top] == begin[k]:
                right[top] = place[k] - 1
        if stack:
            left[k] = place[stack[-1]] + 1
        stack.append(k)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    wide = right - left + 1 >= width
    return left[wide], at[wide], right[wide]


def _signatures(h: np.ndarray, limits: WindowLimits) -> list[np.ndarray]:
    """The hashes of all shingles under each function."""
    grams = W.window_hashes(h, limits.shingle)
    return [np.maximum(W.mix(grams ^ np.uint64(0xA0761D6478BD642F * (f + 1) & (2**64 - 1))), np.uint64(1)) for f in range(limits.functions)]


def _runs(limits: WindowLimits) -> P.Runs:
    enough = int(np.ceil(2 * limits.width * limits.similarity / (1 + limits.similarity) - 1e-9))
    return P.Runs(limits.width, enough, limits.shift, limits.shingle)


def near_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: WindowLimits = WindowLimits()) -> DataFrame:
    """One row per document and near-duplicate stretch: id, first_word, end_word, n_words, other_doc_id."""

    def windows(h: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
        start, end = found.row_start[found.row], found.row_end[found.row] - limits.shingle + 1
        places, keys = [], []
        for values in _signatures(h, limits):
            n = len(values)
            _, at, _ = compact_windows(values, start[:n], end[:n], limits.width)
            places.append(at)
            keys.append(values[at])
        return np.concatenate(places), np.concatenate(keys)

    def has_key(h: np.ndarray, found: W.Words):
        values = [v.view(np.int64) for v in _signatures(h, limits)]
        n = len(values[0])

        def check(at: np.ndarray, key: np.ndarray) -> np.ndarray:
            ok = np.zeros(len(at), bool)
            for v in values if n else []:
                ok |= (at < n) & (v[np.minimum(at, n - 1)] == key)
            return ok

        return check

    def units(h: np.ndarray) -> np.ndarray:
        grams = W.window_hashes(h, limits.shingle)
        return np.maximum(grams.astype(np.uint32), np.uint32(1)) if len(grams) else np.ones(1, np.uint32)

    def around(places: DataFrame) -> DataFrame:
        marked = texts.join(P.places_of(places), "_id").groupBy("_id")
        marked = marked.agg(F.first("_text").alias("_text"), F.first("places").alias("places"), (F.count("*") > 1).alias("copied"))
        steps = np.arange(1 - limits.width, limits.width)
        return P.contexts(marked, has_key, units, limits.shingle, steps).withColumn("ctx", F.xxhash64("units"))

    texts = docs.select(F.xxhash64(text_col).alias("_id"), F.col(text_col).alias("_text"))
    places = written(P.shared_places(P.keyed_places(texts, windows)), "windows")
    centre, runs = limits.width - 1, _runs(limits)
    spans = written(P.group_spans(around(places.where(F.col("n") <= HOT)), runs, centre), "window-spans")
    hot = places.where(F.col("n") > HOT)
    if not hot.isEmpty():
        held = written(around(hot), "hot-contexts")
        spans = spans.unionByName(P.block_spans(held, runs, centre, BLOCK))
    forget(places)
    return P.reported(docs, P.merged(spans), id_col, text_col)
