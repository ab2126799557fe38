"""Repeated passages by a sparse suffix array over the whole corpus.

Suffixes are retained only where a minimiser lies: the smallest hash of `kmer` words among `spread`
neighbouring ones. Equal passages of `min_words` words have a minimiser in their first `spread` words, at
the same place, and from there on at least `head` = min_words - spread + 1 words in common. So:

1. Every retained suffix yields a hash of its first `head` words; hashes that occur once are dropped.
2. Of the texts with the others, every window of min_words words whose minimiser starts a repeated head
   is hashed (64 bits). Equal windows have equal minimisers at equal places, so no repeat is left out.
3. Windows are counted by their hash. Those that occur twice or more are spans, however many texts share
   a head and wherever it lies in the repeat.
4. Spans are joined to maximal stretches per text.

No group is gathered and no pairs of a group are formed: windows are counted with pre-aggregation, and
each window meets the count of its own hash only.

Defined results: null and empty texts, and texts of fewer than min_words words, have no row. Repeated
rows with min_words words or more are repeats of each other from end to end. Words are compared as they
are. Ids may be null or tied; every row of docs with a repeated passage is reported. Extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages as P
from . import words as W
from .frames import forget, written


@dataclass(frozen=True)
class SuffixLimits:
    """Shortest passage and how sparse the suffixes are, in words."""

    min_words: int = 50
    kmer: int = 5
    spread: int = 31

    @property
    def head(self) -> int:
        return self.min_words - self.spread + 1


def minimisers(h: np.ndarray, found: W.Words, limits: SuffixLimits) -> np.ndarray:
    """Places of the retained suffixes that have a whole head."""
    grams = np.maximum(W.window_hashes(h, limits.kmer), np.uint64(1))
    least = W.sliding(np.minimum, grams, limits.spread)
    ends = found.row_end[found.row]
    fits = np.arange(len(least)) + limits.spread + limits.kmer - 1 <= ends[: len(least)]
    least = np.where(fits, least, np.uint64(0))
    # A place is a minimiser if it is the least of one of the windows that hold it.
    padded = np.concatenate([np.zeros(limits.spread - 1, np.uint64), least, np.zeros(limits.spread - 1, np.uint64)])
    best = W.sliding(np.maximum, padded, limits.spread)[: len(grams)]
    at = np.flatnonzero(best == grams)
    return at[at + limits.head <= ends[at]]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: SuffixLimits = SuffixLimits()) -> DataFrame:
    """One row per document and maximal repeated passage: id, first_word, end_word, n_words, other_doc_id."""

    def heads(h: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
        at = minimisers(h, found, limits)
        return at, W.window_hashes(h, limits.head)[at]

    def windows(h: np.ndarray, found: W.Words, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, full = W.window_hashes(h, limits.head), W.window_hashes(h, limits.min_words)
        if not len(full):
            return np.zeros(0, np.int64), full
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == key.view(np.uint64))]
        grams = np.maximum(W.window_hashes(h, limits.kmer), np.uint64(1))
        least = W.sliding(np.minimum, grams, limits.spread)
        low, high = found.row_start[found.row[at]], found.row_end[found.row[at]]
        wanted = np.zeros(len(full), bool)
        for k in range(limits.spread):
            inside = (at - k >= low) & (at - k + limits.min_words <= high)
            start, least_of = at[inside] - k, grams[at[inside]]
            wanted[start[least[start] == least_of]] = True
        start = np.flatnonzero(wanted)
        return start, full[start]

    texts = docs.select(F.xxhash64(text_col).alias("_id"), F.col(text_col).alias("_text"))
    suffixes = written(P.keyed_places(texts, heads), "suffixes")
    marked = texts.join(P.places_of(P.repeated_places(suffixes)), "_id")
    found = written(P.keyed_windows(marked, windows), "suffix-windows")
    forget(suffixes)
    return P.reported(docs, P.merged(P.repeated_windows(found, limits.min_words)), id_col, text_col)
