"""Alignment of two tokenizers' tokens over whole texts, and corpus counts of aligned id pairs.

Both tokenizers read a space and the text. The ends of their tokens, counted in bytes, become two
dictionaries from end to index (direct tables, as ends are small whole numbers). The keys both have, in
order, slice the two id lists into groups of tokens that cover the same bytes; every pair of ids in a
group is a link.

A text is encoded by pieces that begin with a space after a character that is not white space. There
the byte-level pattern of the first tokenizer always splits, and no piece of the second has its space
mark after another character (checked when it is loaded), so no token of either crosses such a place:
pieces give the whole text's tokens, and each place is an end of both. Equal pieces of a slice of texts
are encoded and aligned once, many joined in one call, and a document adds up its pieces with numpy.

A document's distinct links leave the task as (id pair, times). Pair counts are combined on the map
side. The look-up of counts broadcasts the pair table only if it was counted as small; otherwise the
commonest pairs (a bounded number, as each holds a fixed share of all links) are broadcast and the rest
meets in a shuffled join, so no hot pair fills a task.

Defined results: a null or empty text, or one whose tokens of either side do not spell it (such as one
that holds the space mark itself), has zeros and an empty groups_sha256. Null ids and repeated rows are
rows like any other. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import written
from .token_counts import safe_cuts

#: Bytes of texts whose equal pieces are found together, of those whose links are added up at once, and of
#: joined pieces encoded as one text.
SLICE, PART, JOINED = 6 << 20, 1 << 20, 8 << 10
#: Links of a group from which on its repeated ids are counted first.
WIDE = 4096
#: Rows of a pair table that may be broadcast; also the largest number of hot pairs.
SMALL = 1 << 19
#: Fixed value: the character that stands for a space in pieces.
SPACE_MARK = "▁"


class Encoders:
    """The two tokenizers and the bytes of each of their ids."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes, self.b_bytes = self._byte_level_bytes(), self._piece_bytes()
        # A last piece that is a space alone: an empty text gets no space added.
        self.b_space = self.b.encode("x ")[len(self.b.encode("x")) :]
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.decimals = pa.array([f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for c in ",|;"], pa.large_string())
        self.a_of_byte = {t[0]: i for i, t in enumerate(self.a_bytes) if len(t) == 1}
        self.b_of_byte = {t[0]: i for i, t in enumerate(self.b_bytes) if len(t) == 1}

    def _byte_level_bytes(self) -> list[bytes]:
        # Visible characters stand for their own byte, the other bytes for the characters from 256 on.
        plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        tokens = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size(with_added_tokens=False))]
        return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]

    def _piece_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {piece!r} has a space after another character, so texts cannot be cut there")
            out.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
        return out

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text (with a leading space) by both tokenizers; the second adds the space itself."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids if len(text) > 1 else self.b_space for text, ids in zip(texts, b)]

    def bytes_of(self, text: bytes) -> tuple[list[int], list[int]]:
        """A stand-in for the ids of a text that is not spelled: one id a byte."""
        return [self.a_of_byte[c] for c in text], [self.b_of_byte[c] for c in text]

    def spelled(self, text: bytes, a: list[int], b: list[int]) -> bool:
        """Do the tokens of both sides spell the text?"""
        return b"".join([self.a_bytes[i] for i in a]) == text and b"".join([self.b_bytes[i] for i in b]) == text


@dataclass
class Groups:
    """Groups of tokens that cover the same bytes, of many pieces one after another.

    a and b: all ids; a_at and b_at: for each group its first id, with the total at the end; end: where it ends in the bytes.
    """

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    end: np.ndarray

    @staticmethod
    def find(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, n_bytes: int) -> Groups:
        """The ends of tokens are keys of two dictionaries (direct tables over the bytes) that give the tokens' indices;
        the keys both have, in order, slice both id lists."""
        tables = []
        for ids, size in ((a, a_size), (b, b_size)):
            table = np.full(n_bytes + 1, -1, np.int64)
            table[np.cumsum(size[ids])] = np.arange(1, len(ids) + 1)
            tables.append(table)
        end = np.flatnonzero((tables[0] > 0) & (tables[1] > 0))
        first = np.zeros(1, np.int64)
        return Groups(a, b, np.append(first, tables[0][end]), np.append(first, tables[1][end]), end)

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (a * width + b), how often each occurs, and its group, in order of groups."""
        n_a, n_b = np.diff(self.a_at), np.diff(self.b_at)
        wide = np.flatnonzero(n_a * n_b >= WIDE)
        size = n_a * n_b
        size[wide] = 0
        group = np.repeat(np.arange(len(size)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        left, right = self.a_at[group] + k // n_b[group], self.b_at[group] + k % n_b[group]
        pairs, times = [self.a[left] * width + self.b[right]], [np.ones(len(group), np.int64)]
        groups = [group]
        for g in wide:
            a, often_a = np.unique(self.a[self.a_at[g] : self.a_at[g + 1]], return_counts=True)
            b, often_b = np.unique(self.b[self.b_at[g] : self.b_at[g + 1]], return_counts=True)
            pairs.append((a[:, None] * width + b).ravel())
            times.append((often_a[:, None] * often_b).ravel())
            groups.append(np.full(len(a) * len(b), g))
        if len(wide):
            order = np.argsort(np.concatenate(groups), kind="stable")
            return tuple(np.concatenate(x)[order] for x in (pairs, times, groups))
        return pairs[0], times[0], groups[0]

    def text(self, decimals: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The groups as `a1,a2|b1;` and so on, in one array of bytes, and where each group ends in it.

        decimals: for id i, the texts of i with a comma, a bar and a semicolon at 3 i and after.
        """
        n_a, n_b = np.diff(self.a_at), np.diff(self.b_at)
        ends = np.cumsum(n_a + n_b)
        which = np.empty(ends[-1] if len(ends) else 0, np.int64)
        place_a = np.arange(len(self.a)) + np.repeat(self.b_at[:-1], n_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.a_at[1:], n_b)
        which[place_a], which[place_b] = self.a * 3, self.b * 3
        which[self.a_at[1:] + self.b_at[:-1] - 1] += 1
        which[ends - 1] += 2
        joined = decimals.take(pa.array(which))
        raw, offsets = W.text_bytes(joined)
        return raw, offsets[ends]


class _Pieces:
    """Distinct pieces, encoded and aligned: counts, links and the text of the groups of each."""

    def __init__(self, pieces: pa.Array, encoders: Encoders):
        data, offsets = W.text_bytes(pieces)
        n, raw = len(pieces), data.tobytes()
        # A piece can be followed by another one in one text if it ends in a character that is surely no white space.
        last = np.zeros(n, np.int64)
        full = offsets[1:] > offsets[:-1]
        last[full] = data[offsets[1:][full] - 1]
        open_end = (last > 0x20) & (last < 0x7F)
        starts, size = [0] if n else [], 0
        for k in range(1, n):
            size += offsets[k] - offsets[k - 1]
            if size >= JOINED or not open_end[k - 1]:
                starts.append(k)
                size = 0
        spelled = np.ones(n, bool)
        a, b = self._encoded(raw, offsets, np.array([*starts, n]), spelled, encoders)
        groups = Groups.find(a, b, encoders.a_size, encoders.b_size, int(offsets[-1]) if n else 0)
        piece = np.searchsorted(offsets, groups.end, side="left") - 1
        count = lambda w: np.bincount(piece, w, minlength=n).astype(np.int64)
        pairs, times, group = groups.links(len(encoders.b_bytes))
        link_piece = piece[group]
        n_links = np.bincount(link_piece, times, minlength=n).astype(np.int64)
        self.counts = np.stack([count(np.diff(groups.a_at)), count(np.diff(groups.b_at)), count(None), n_links, (~spelled).astype(np.int64)], axis=1)
        self.pairs, self.times, self.size = pairs, times, np.bincount(link_piece, minlength=n)
        text, ends = groups.text(encoders.decimals)
        bounds = np.append(0, ends)[np.searchsorted(piece, np.arange(n + 1))].tolist()
        whole = text.tobytes()
        self.text = [whole[i:j] for i, j in zip(bounds, bounds[1:])]

    @staticmethod
    def _encoded(raw: bytes, offsets: np.ndarray, starts: np.ndarray, spelled: np.ndarray, encoders: Encoders) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces by both tokenizers. A piece that is not spelled is marked and has ids of its bytes."""
        out_a, out_b = [], []
        bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
        for k in range(0, len(bounds), 64):
            some = bounds[k : k + 64]
            texts = [raw[offsets[i] : offsets[j]] for i, j in some]
            for (i, j), text, a, b in zip(some, texts, *encoders.encode([t.decode() for t in texts])):
                if encoders.spelled(text, a, b):
                    out_a.append(np.array(a, np.int64))
                    out_b.append(np.array(b, np.int64))
                    continue
                for p in range(i, j):  # one by one, to see which piece it is
                    text = raw[offsets[p] : offsets[p + 1]]
                    (a,), (b,) = encoders.encode([text.decode()])
                    if not encoders.spelled(text, a, b):
                        spelled[p] = False
                        a, b = encoders.bytes_of(text)
                    out_a.append(np.array(a, np.int64))
                    out_b.append(np.array(b, np.int64))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(out_a or none), np.concatenate(out_b or none)


def _documents(data: np.ndarray, offsets: np.ndarray, encoders: Encoders) -> Iterator[tuple[np.ndarray, list[str], pa.Array, pa.Array]]:
    """For runs of texts: their four counts, the hashes of their groups, their distinct pairs and the times of these."""
    cuts = safe_cuts(data, offsets)
    cuts = cuts[(data[cuts] == 0x20) | np.isin(cuts, offsets[:-1])]
    at = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
    pieces = pa.LargeStringArray.from_buffers(len(cuts), at, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    found = _Pieces(pieces.dictionary, encoders)
    every = pieces.indices.to_numpy()
    first_link = np.cumsum(found.size) - found.size
    for first, last in W.row_slices(offsets, PART):
        bounds = offsets[first : last + 1]
        here = slice(*np.searchsorted(cuts, [bounds[0], bounds[-1]]))
        own, row, n = every[here], np.searchsorted(bounds, cuts[here], side="right") - 1, last - first
        sums = np.stack([np.bincount(row, found.counts[own, k], minlength=n) for k in range(5)], axis=1).astype(np.int64)
        spelled = (sums[:, 4] == 0) & (np.diff(bounds) > 0)
        ends, hashes = np.searchsorted(row, np.arange(n), side="right").tolist(), []
        for r in range(n):
            if spelled[r]:
                mine = own[ends[r - 1] if r else 0 : ends[r]].tolist()
                text = b"".join([found.text[i] for i in mine])
                hashes.append(hashlib.sha256(text[:-1]).hexdigest())  # without the last semicolon
            else:
                hashes.append("")
        keep = spelled[row]
        own, row = own[keep], row[keep]
        size = found.size[own]
        place = np.arange(size.sum()) + np.repeat(first_link[own] - (np.cumsum(size) - size), size)
        ids, number = np.unique(found.pairs[place], return_inverse=True)
        key = np.repeat(row, size) * max(1, len(ids)) + number
        order = np.argsort(key)
        key, times = key[order], found.times[place][order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, begin) if len(begin) else times
        key = key[begin]
        at = pa.array(np.searchsorted(key, np.arange(n + 1) * max(1, len(ids))), pa.int32())
        pairs = ids[key % max(1, len(ids))]
        yield sums[:, :4] * spelled[:, None], hashes, pa.ListArray.from_arrays(at, pa.array(pairs)), pa.ListArray.from_arrays(at, pa.array(times))


def _spaced(texts: pa.Array) -> pa.Array:
    """Each text after a space; an empty one stays empty."""
    texts = pc.fill_null(texts, "")
    empty = pa.scalar("", texts.type)
    return pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, empty))


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row (a number of its own), id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct
    id pairs (first id times the size of the second vocabulary, plus second id) and how often each is linked.

    byte_level: a file of the tokenizers library with a byte-level vocabulary; pieces: a sentencepiece model. A
    name without a slash is looked up among the public tokenizers of the machine that runs the task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(file_of(byte_level), file_of(pieces))
        for batch in batches:
            _, offsets = W.text_bytes(batch.column(2))
            for first, last in W.row_slices(offsets, SLICE):
                data, at = W.text_bytes(_spaced(batch.column(2).slice(first, last - first)))
                for counts, hashes, pairs, times in _documents(data, at, encoders):
                    columns = [batch.column(k).slice(first, len(hashes)) for k in (0, 1)] + [pa.array(counts[:, k]) for k in range(4)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.string()), pairs, times], names)
                    first += len(hashes)

    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return rows.mapInArrow(work, schema)


def file_of(name: str) -> str:
    """A path as it is; a bare name is one of the public tokenizers of this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents in which the pair is linked; best: no pair of the same first id has more."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    first = F.expr(f"pair div {width}")
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("a", first).join(highest, "a")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    small: rows of a pair table that may be broadcast.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=file_of(pieces)).get_piece_size()
    found = written(aligned(docs, byte_level, pieces, id_col, text_col), "alignments")
    counts = written(pair_counts(found, width), "aligned-pairs")
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("row", F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times"))
    size = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("links")).first()
    if size["pairs"] <= small:
        met = links.join(F.broadcast(counts), "pair")
    else:  # at most `small` pairs can each hold this share of all links
        share = F.lit(-(-size["links"] // small))
        hot, cold = counts.where(F.col("n") >= share), counts.where(F.col("n") < share)
        rest = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
        met = links.join(F.broadcast(hot), "pair").unionByName(rest.join(cold, "pair"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256"
    )
