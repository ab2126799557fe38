"""Passages of texts: words around places, places with one key compared with each other, and spans.

A text is known by the 64-bit hash of its bytes (_id), so copies of a text share their spans. Two texts
with one hash do no harm: a place counts only in a text whose words give the place's key again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .frames import written

SLICE = 2 << 20

def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    size = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * size
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def keyed_places(texts: DataFrame, places: Callable[[np.ndarray, W.Words], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """texts (_id, _text) to (key, _id, pos): `places` gives places and keys from the word hashes of a slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, h, found in W.word_slices(batch.column(1), SLICE):
                at, key = places(h, found)
                row = found.row[at]
                columns = [key.view(np.int64), ids[first + row], (at - found.row_start[row]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "_id", "pos"])

    return texts.mapInArrow(work, "key long, _id long, pos int")


def contexts(
    texts: DataFrame,
    keys: Callable[[np.ndarray, W.Words], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    units: Callable[[np.ndarray], np.ndarray],
    size: int,
    steps: np.ndarray,
) -> DataFrame:
    """texts (_id, _text, places: array of (pos, key), copied) to (key, units, _id, pos, copied).

    units: word hashes to the units stored (of `size` words, never zero) at the `steps` from each place;
    zeros stand for what lies outside the text. keys: tells which places of a slice have their key.
    """

    def around(unit: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = at[:, None] + steps
        inside = (place >= low[:, None]) & (place + size <= high[:, None])
        return np.where(inside, unit[np.clip(place, 0, len(unit) - 1)], unit.dtype.type(0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column(0).to_numpy(), batch.column(2)
            copied = batch.column(3).to_numpy(zero_copy_only=False)
            for first, h, found in W.word_slices(batch.column(1), SLICE):
                own = places.slice(first, len(found.row_end))
                row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                flat = own.flatten()
                pos, key = (flat.field(k).to_numpy() for k in (0, 1))
                at = found.row_start[row] + pos
                ok = keys(h, found)(at, key) & (at < found.row_end[row])
                row, pos, key, at = row[ok], pos[ok], key[ok], at[ok]
                unit = units(h)
                low, high = found.row_start[row], found.row_end[row]
                for k in range(0, len(at), 1 << 13):
                    s = slice(k, k + (1 << 13))
                    stored = binary_rows(around(unit, low[s], high[s], at[s]))
                    text = first + row[s]
                    columns = [pa.array(key[s]), stored, pa.array(ids[text]), pa.array(pos[s]), pa.array(copied[text])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "units", "_id", "pos", "copied"])

    return texts.mapInArrow(work, "key long, units binary, _id long, pos int, copied boolean")


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The values of a binary column of equal lengths as the rows of a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return values.reshape(len(column), -1).view(kind)


#: Columns of the spans of places: where they begin and end in the text, and the text of a partner.
SPANS = "_id long, begin int, end int, other long"


@dataclass(frozen=True)
class Runs:
    """Two stretches match if `enough` of some `width` neighbouring units of either are in the other, each at
    most `shift` places away; size: words of a unit."""

    width: int
    enough: int
    shift: int
    size: int

    def ends(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of shared units: whether some run has enough, the first unit of such runs, the end of the last."""
        total = np.cumsum(np.pad(shared, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        good = total[:, self.width :] - total[:, : -self.width] >= self.enough
        return good.any(axis=1), good.argmax(axis=1), good.shape[1] - good[:, ::-1].argmax(axis=1) - 1 + self.width

    def match(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of a and b that match, and the ends of the runs in a and in b."""
        in_a, in_b, n = np.zeros(a.shape, bool), np.zeros(a.shape, bool), a.shape[1]
        for s in range(-self.shift, self.shift + 1):
            one, two = slice(max(0, -s), n - max(0, s)), slice(max(0, s), n - max(0, -s))
            same = (a[:, one] == b[:, two]) & (a[:, one] != 0)
            in_a[:, one] |= same
            in_b[:, two] |= same
        row = np.flatnonzero((in_a.sum(axis=1) >= self.enough) & (in_b.sum(axis=1) >= self.enough))
        good_a, first_a, end_a = self.ends(in_a[row])
        good_b, first_b, end_b = self.ends(in_b[row])
        both = good_a & good_b
        return row[both], first_a[both], end_a[both], first_b[both], end_b[both]


class Extents:
    """The least begin, the greatest end and the least partner of each row, as far as rows were compared."""

    def __init__(self, units: np.ndarray, ids: np.ndarray, runs: Runs):
        self.units, self.ids, self.runs = units, ids, runs
        self.first, self.end = np.full(len(ids), units.shape[1], np.int32), np.zeros(len(ids), np.int32)
        self.other = np.full(len(ids), np.iinfo(np.int64).max)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compare the rows a with the rows b, one by one."""
        for k in range(0, len(a), 4096):
            i, j = a[k : k + 4096], b[k : k + 4096]
            row, *ends = self.runs.match(self.units[i], self.units[j])
            i, j = i[row], j[row]
            for me, partner, first, end in ((i, j, *ends[:2]), (j, i, *ends[2:])):
                np.minimum.at(self.first, me, first.astype(np.int32))
                np.maximum.at(self.end, me, end.astype(np.int32))
                np.minimum.at(self.other, me, self.ids[partner])


def bounds(units: np.ndarray, group: np.ndarray, runs: Runs) -> tuple[np.ndarray, ...]:
    """Which rows may match another one of their group, and ends no match exceeds: a row shares with others at
    most the units that some other place of its group holds too. Also numbers of the units of these rows, by group."""
    alive, first, end = np.ones(len(units), bool), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    codes = np.zeros(units.shape, np.int32)
    for _ in range(3):  # without the rows that match none, fewer units are shared
        row = np.flatnonzero(alive)
        keys = (group[row, None].astype(np.uint64) << np.uint64(32)) | units[row]
        code = pa.array(keys.ravel()).dictionary_encode().indices.to_numpy()
        shared = (np.bincount(code, minlength=1)[code] > 1).reshape(keys.shape) & (units[row] != 0)
        good, first[row], end[row] = runs.ends(shared)
        alive[row], codes[row] = good, code.reshape(keys.shape)
        if good.all():
            break
    return alive, first, end, codes


def likely_pairs(codes: np.ndarray, shared: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that are neighbours in their group by the first or last unit they share inside their bounds, or by the
    rarest one and its place: those that reach each other's bounds hold it too. codes: numbers of the units, by group."""
    count, row, place = np.bincount(codes.ravel(), minlength=1), np.arange(len(codes)), np.arange(codes.shape[1])
    shared = shared & (count[codes] > 1)
    first = codes[row, (shared & (place >= low[:, None])).argmax(axis=1)]
    last = codes[row, codes.shape[1] - 1 - (shared & (place < high[:, None]))[:, ::-1].argmax(axis=1)]
    orders = [(first, last), (last, first)]
    for factor in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D):  # count first, then a hash
        spread = codes.astype(np.uint32) * np.uint32(factor)
        score = np.where(shared, (count[codes].astype(np.uint64) << np.uint64(32)) | spread, np.uint64(2**64 - 1))
        orders.append((score.min(axis=1), score.argmin(axis=1)))
    for one, two in orders[::-1]:
        order = np.lexsort((two, one, group))
        for step in (1, 2):
            near = group[order[step:]] == group[order[:-step]]
            yield order[:-step][near], order[step:][near]


class Holders:
    """Which rows of a group hold a unit. Of a run with a match some `enough` of `width` units are held by the
    partner, so at least one of the width - enough + 1 rarest is."""

    def __init__(self, codes: np.ndarray, some: np.ndarray, runs: Runs):
        at = np.flatnonzero(some.ravel())
        at = at[np.argsort(codes.ravel()[at], kind="stable")]
        self.codes, self.some, self.runs = codes, some, runs
        self.sorted, self.row = codes.ravel()[at], at // codes.shape[1]

    def of(self, k: int, low: int, first: int, end: int, high: int) -> np.ndarray:
        """The rows that may give row k a run that begins in [low, first) or ends in (end, high]."""
        width, spare = self.runs.width, self.runs.width - self.runs.enough
        begins = np.arange(low, high - width + 1)
        begins = begins[(begins < first) | (begins + width > end)]
        from_, to = (np.where(self.some[k], np.searchsorted(self.sorted, self.codes[k], side), 0) for side in ("left", "right"))
        count = np.lib.stride_tricks.sliding_window_view(to - from_, width)[begins]
        rarest = np.argpartition(count, spare, axis=1)[:, : spare + 1] + begins[:, None]
        rows = np.unique(np.concatenate([self.row[from_[p] : to[p]] for p in np.unique(rarest)]))
        return rows[rows != k]


def extents(units: np.ndarray, group: np.ndarray, ids: np.ndarray, runs: Runs, same: np.ndarray, paired: int = 12) -> Extents:
    """Extents of rows of different units over all matches inside their groups (rows of a group adjoin).

    same: rows that stand for several places; they match themselves. In groups of more than `paired` rows
    those whose ends have reached their bounds are compared no further: no other match can change them. So
    likely partners come first; what is left is compared with all rows that may widen it.
    """
    found = Extents(units, ids, runs)
    alive, low, high, codes = bounds(units, group, runs)
    twice = np.flatnonzero(same)
    good, first, end = runs.ends(units[twice] != 0)
    twice = twice[good]
    found.first[twice], found.end[twice], found.other[twice] = first[good], end[good], ids[twice]
    row = np.flatnonzero(alive)
    large = row[np.bincount(group)[group[row]] > paired] if len(row) else row
    for a, b in likely_pairs(codes[large], units[large] != 0, group[large], low[large], high[large]):
        open_ends = (found.first[large] > low[large]) | (found.end[large] < high[large])
        useful = open_ends[a] | open_ends[b]
        found.compare(large[a[useful]], large[b[useful]])
    pairs: list[list[np.ndarray]] = [[], []]
    for members in np.split(row, np.flatnonzero(np.diff(group[row])) + 1):
        if len(members) <= paired:
            for side, index in zip(pairs, np.triu_indices(len(members), 1)):
                side.append(members[index])
            continue
        unsettled = np.flatnonzero((found.first[members] > low[members]) | (found.end[members] < high[members]))
        if len(unsettled):
            holders = Holders(codes[members], units[members] != 0, runs)
            for k in unsettled:
                me = members[k]
                if found.first[me] > low[me] or found.end[me] < high[me]:
                    others = members[holders.of(k, low[me], found.first[me], found.end[me], high[me])]
                    found.compare(np.full(len(others), me), others)
    found.compare(*(np.concatenate(side) if side else row[:0] for side in pairs))
    return found


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew where the first `keys` columns change, at `rows` rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = _changes(table, keys)
        if len(new):
            yield table.slice(0, int(new[-1]))
            table = table.slice(int(new[-1]))
        held = [table]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _changes(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    """Row numbers where one of the first `keys` columns differs from the row before."""
    new = np.zeros(max(0, len(rows) - 1), bool)
    for k in range(keys):
        values = rows.column(k).to_numpy()
        new |= values[1:] != values[:-1]
    return np.flatnonzero(new) + 1


def _compared(rows: pa.RecordBatch, keys: int, runs: Runs, same: np.ndarray, ids: np.ndarray) -> tuple[Extents, np.ndarray]:
    """Extents of the classes (equal key columns, the last one a hash of the units), and the class of each row.
    same: how many places a row stands for."""
    first = np.concatenate([[0], _changes(rows, keys)])
    starts = np.zeros(len(rows), np.int64)
    starts[first] = 1
    of_row = np.cumsum(starts) - 1
    group = np.zeros(len(rows), np.int64)
    group[_changes(rows, keys - 1)] = 1
    units = matrix(rows.column(keys).take(pa.array(first)), np.uint32)
    twice = np.bincount(of_row, same) > 1
    return extents(units, np.cumsum(group)[first], ids[first], runs, twice), of_row


def group_spans(places: DataFrame, runs: Runs, centre: int) -> DataFrame:
    """Spans of places (key, ctx, units, _id, pos, copied) with a match among the places of their key; the units of each
    key's places are compared in one task, which its caller bounds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 1, 4096):
            ids, pos = (rows.column(k).to_numpy() for k in (3, 4))
            found, of_row = _compared(rows, 2, runs, 1 + rows.column(5).to_numpy(zero_copy_only=False), ids)
            # The class is named by its first text; for that text itself by its last, if that is another one.
            last = np.zeros(len(found.ids), np.int64)
            last[of_row] = ids
            mine = (found.other == found.ids)[of_row] & (ids == found.ids[of_row])
            other = np.where(mine, last[of_row], found.other[of_row])
            keep = np.flatnonzero(found.end[of_row] > 0)
            at = pos[keep] - centre
            begin, end = at + found.first[of_row[keep]], at + found.end[of_row[keep]] + runs.size - 1
            columns = [ids[keep], begin.astype(np.int32), end.astype(np.int32), other[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_id", "begin", "end", "other"])

    ordered = places.repartition("key").sortWithinPartitions("key", "ctx", "_id", "pos")
    return ordered.select("key", "ctx", "units", "_id", "pos", "copied").mapInArrow(work, SPANS)


def block_spans(places: DataFrame, runs: Runs, centre: int, block: int) -> DataFrame:
    """The same for keys of any number of places: equal units are one class, the classes of a key are dealt into
    blocks of about `block`, and every two blocks of a key are compared in a task of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 3, 4096):
            found, of_row = _compared(rows, 4, runs, rows.column(6).to_numpy(), rows.column(5).to_numpy())
            keep = np.flatnonzero(found.end[of_row] > 0)
            at = of_row[keep]
            columns = [rows.column(0).to_numpy()[keep], rows.column(3).to_numpy()[keep], found.first[at], found.end[at], found.other[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "ctx", "first", "last", "other"])

    ends = (F.min("_id").alias("low"), F.max("_id").alias("high"), F.sum(1 + F.col("copied").cast("int")).alias("n"))
    classes = written(places.groupBy("key", "ctx").agg(F.first("units").alias("units"), *ends), "window-classes")
    sizes = classes.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(2)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("ctx"), F.col("blocks")).cast("int")
    dealt = classes.join(sizes, "key").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.where("mine <> theirs").select("key", F.least("mine", "theirs").alias("a"), F.greatest("mine", "theirs").alias("b"), "ctx", "units", "low", "n")
    ordered = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "ctx")
    found = ordered.mapInArrow(work, "key long, ctx long, first int, last int, other long")
    found = found.groupBy("key", "ctx").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("other").alias("other"))
    found = found.join(classes.select("key", "ctx", "low", "high"), ["key", "ctx"])
    mine = (F.col("other") == F.col("low")) & (F.col("_id") == F.col("low"))
    return places.select("key", "ctx", "_id", "pos").join(found, ["key", "ctx"]).select(
        "_id",
        (F.col("pos") - centre + F.col("first")).alias("begin"),
        (F.col("pos") - centre + F.col("last") + runs.size - 1).alias("end"),
        F.when(mine, F.col("high")).otherwise(F.col("other")).alias("other"),
    )


def keyed_windows(texts: DataFrame, windows: Callable[[np.ndarray, W.Words, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """texts (_id, _text, places: array of (pos, key)) to (key, _id, pos): `windows` gives places and keys
    from the word hashes of a slice, its words, and the given places with their keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column(0).to_numpy(), batch.column(2)
            for first, h, found in W.word_slices(batch.column(1), SLICE):
                own = places.slice(first, len(found.row_end))
                row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                flat = own.flatten()
                pos, key = (flat.field(k).to_numpy() for k in (0, 1))
                at = found.row_start[row] + pos
                ok = at < found.row_end[row]
                start, hashed = windows(h, found, at[ok], key[ok])
                row = found.row[start]
                columns = [hashed.view(np.int64), ids[first + row], (start - found.row_start[row]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "_id", "pos"])

    return texts.mapInArrow(work, "key long, _id long, pos int")


def repeated_windows(windows: DataFrame, size: int) -> DataFrame:
    """Spans (_id, begin, end, other) of the windows (key, _id, pos) of `size` words that occur more than
    once; other is the least text that has the window too, this one if there is none other."""
    seen = windows.groupBy("key").agg(F.count("*").alias("n"), F.min("_id").alias("low"), F.max("_id").alias("high")).where("n > 1").drop("n")
    other = F.when(F.col("low") == F.col("_id"), F.col("high")).otherwise(F.col("low"))
    return windows.join(seen, "key").select("_id", F.col("pos").alias("begin"), (F.col("pos") + size).alias("end"), other.alias("other"))


def repeated_places(places: DataFrame) -> DataFrame:
    """The places (key, _id, pos) whose key occurs more than once."""
    return places.join(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key")


def shared_places(places: DataFrame) -> DataFrame:
    """The places (key, _id, pos, n) whose key occurs more than once, n times; copies of a text count each."""
    return places.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def merged(spans: DataFrame) -> DataFrame:
    """(_id, begin, end, other): overlapping or touching spans of a text joined; other is the smallest."""
    spans = spans.groupBy("_id", "begin").agg(F.max("end").alias("end"), F.min("other").alias("other"))
    line = Window.partitionBy("_id").orderBy("begin")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.coalesce((F.col("begin") > reach), F.lit(True)).cast("int"))
    numbered = flagged.withColumn("_n", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_id", "_n").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("other").alias("other")).drop("_n")


def places_of(repeated: DataFrame) -> DataFrame:
    """(_id, places) from rows (_id, pos, key): each text's places once, bounded by the text's length."""
    distinct = repeated.select("_id", "pos", "key").distinct()
    return distinct.groupBy("_id").agg(F.collect_list(F.struct("pos", "key")).alias("places"))


def reported(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spans of texts as rows of documents: id, first_word, end_word, n_words and other_doc_id, the smallest
    id of a document that holds the passage too (a copy of this one, or itself, if none other was met)."""
    ids = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_id"))
    names = ids.groupBy("_id").agg(F.min("_doc").alias("_named"))
    named = spans.join(names.select(F.col("_id").alias("other"), "_named"), "other")
    out = ids.join(named, "_id")
    return out.select(
        F.col("_doc").alias(id_col),
        F.col("begin").cast("long").alias("first_word"),
        F.col("end").cast("long").alias("end_word"),
        (F.col("end") - F.col("begin")).cast("long").alias("n_words"),
        F.col("_named").alias("other_doc_id"),
    )


