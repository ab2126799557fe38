"""Token counts by batch encoding inside Arrow functions; only lengths leave the tasks.

The texts of an Arrow batch are cut at safe boundaries into pieces, equal pieces of a slice are encoded
once, and the lengths are added up per text. A boundary is safe where the tokenizer's own pattern
always splits: before ASCII white space that follows a character other than white space. No piece is
then split differently from the whole text, and no special string (which has no white space) is cut.
Long texts are cut between slices in the same way, so a slice and an encoding batch are bounded by
bytes, not by rows; only a run without any white space stays whole.

Defined results: a null or empty text has 0 bytes and 0 tokens. Every row is counted, repeated or not,
whatever its id. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W

#: Bytes of text whose equal pieces are found together, and bytes of pieces encoded in one call.
SLICE, BATCH = 32 << 20, 256 << 10


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the texts may be cut, with the beginnings of the texts that have bytes."""
    space = ~W.PLAIN[data]
    # The character before must not be white space of any kind: a visible ASCII byte, or a
    # two-byte character from U+00C0 on. (White space beyond ASCII is C2 85, C2 A0 or three bytes.)
    before = np.zeros(len(data), bool)
    before[1:] = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    before[2:] |= (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    cuts = space & before
    cuts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cuts)


def _slices(cuts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of at most SLICE bytes, or of one piece."""
    ends = np.append(cuts[1:], size)
    first = 0
    while first < len(cuts):
        last = max(first + 1, int(np.searchsorted(ends, cuts[first] + SLICE, side="right")))
        yield first, last
        first = last


def _encoded_lengths(tokenizer, pieces: pa.Array) -> np.ndarray:
    size = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))
    out, first = [], 0
    while first < len(pieces):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + BATCH, side="right")))
        batch = pieces.slice(first, last - first).to_pylist()
        out.extend(len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False))
        first = last
    return np.array(out, np.int64)


def counted(column: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text."""
    data, offsets = W.text_bytes(column)
    tokens = np.zeros(len(offsets) - 1, np.int64)
    if len(data):
        cuts = safe_cuts(data, offsets)
        row = np.searchsorted(offsets, cuts, side="right") - 1
        for first, last in _slices(cuts, len(data)):
            begin, end = cuts[first], cuts[last] if last < len(cuts) else len(data)
            at = pa.py_buffer(np.append(cuts[first:last], end).astype(np.int64) - begin)
            text = pa.py_buffer(np.ascontiguousarray(data[begin:end]))
            pieces = pa.LargeStringArray.from_buffers(last - first, at, text).dictionary_encode()
            lengths = _encoded_lengths(tokenizer, pieces.dictionary)[pieces.indices.to_numpy()]
            tokens += np.bincount(row[first:last], lengths, minlength=len(tokens)).astype(np.int64)
    return np.diff(offsets), tokens


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens and whether n_tokens exceeds the limit.

    tokenizer_path: a file of the tokenizers library with a pattern that splits before white space (byte-level BPE);
    a name without a slash is looked up among the public tokenizers of the machine that runs the task.
    """
    from .token_alignment import file_of

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file_of(tokenizer_path))
        for batch in batches:
            n_bytes, n_tokens = counted(batch.column(1), tokenizer)
            columns = [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
