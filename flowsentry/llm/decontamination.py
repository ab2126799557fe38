"""Benchmark decontamination by spaced-seed hashing.

A mask hashes the words at its 1-places and ignores the others, so a substituted word under a 0 does
not hide a match. Words are runs of letters and digits with A-Z lower-cased. The four masks hit every
placement of 4 substitutions in 20 words and of 3 in 15. Where they miss a placement in a short item (of
fewer than 12 words), the item has masks of its own, the whole item without the substituted words; these
are hashed only if there are items of that length. Hashes of test items and of training texts are
joined; around each hit the aligned words are compared, and a window of `window` words (or the whole
item, if shorter) with at least `share` equal words is an overlap.

Almost no training hash occurs in the test items, so training tasks first drop hashes that miss a bit
table of the test hashes. The table has a fixed size (16 MB), whatever the number of items; with many
items it lets more hashes pass, never fewer. What passes goes with the words around it to an ordinary
join. Equal items are searched once.

Defined results: null and empty texts and items match nothing, nor do items with fewer words than the
shortest mask (6). Repeated documents are reported once per id, item and text. Ids may be null. Extra
columns are ignored by overlaps() and passed on by keep_clean(). Empty tables give an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import packed, written

SLICE = 2 << 20
#: Bits of the table of test hashes, and most hashes that are broadcast; more are joined by a shuffle.
BITS, BROADCAST = 27, 200_000


@dataclass(frozen=True)
class SeedLimits:
    """Masks and what counts as an overlap."""

    masks: tuple[str, ...] = ("111111", "1111011", "11001000111", "11010100011")
    window: int = 20
    share: float = 0.8


def short_masks(limits: SeedLimits) -> list[tuple[int, str]]:
    """(words of the item, mask) for all placements of unequal words in an item that `masks` never hit."""
    out = {}
    for size in range(min(map(len, limits.masks)), limits.window + 1):
        hits = [{s + k for k, bit in enumerate(m) if bit == "1"} for m in limits.masks for s in range(size - len(m) + 1)]
        for wrong in itertools.combinations(range(size), size - math.ceil(limits.share * size - 1e-9)):
            if all(hit.intersection(wrong) for hit in hits):
                out[size, "".join("0" if k in wrong else "1" for k in range(size)).strip("0")] = None
    return list(out)


def seed_hashes(h: np.ndarray, row: np.ndarray, masks: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask the places where it fits into a text, and its hash there; an empty mask has none."""
    out = []
    for number, mask in enumerate(masks, 1):
        if not mask:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        n = max(0, len(h) - len(mask) + 1)
        g = np.full(n, number * 0x51ED27, np.uint64)
        for k in (k for k, bit in enumerate(mask) if bit == "1"):
            g *= np.uint64(0x9E3779B97F4A7C15)
            g += h[k : n + k]
            g ^= g >> np.uint64(29)
        fits = row[:n] == row[len(mask) - 1 :][:n]
        out.append((np.flatnonzero(fits), W.mix(g)[fits]))
    return out


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, W.Words]]:
    """For each slice of rows: its first row, its bytes, the hashes of its words, and the words."""
    raw, offsets = W.text_bytes(column)
    for first, last in W.row_slices(offsets, SLICE):
        data = W.LOWER[raw[offsets[first] : offsets[last]]]
        found = W.find_words(data, offsets[first : last + 1] - offsets[first], W.ALPHANUMERIC)
        yield first, data, W.span_hashes(data, found.start, found.end), found


def _item_seeds(items: DataFrame, limits: SeedLimits, short: list[tuple[int, str]]) -> DataFrame:
    masks, sizes = (*limits.masks, *(m for _, m in short)), [*(0 for _ in limits.masks), *(n for n, _ in short)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, h, found in _word_hashes(batch.column(1)):
                start = found.row_start
                texts = [h[a:b].view(np.int64) for a, b in zip(start, found.row_end)]
                seeds = [[] for _ in texts]
                count = found.count()
                for (at, g), size in zip(seed_hashes(h, found.row, masks), sizes):
                    own = (count[found.row[at]] == size) | (size == 0)
                    for i, value in zip(at[own].tolist(), g[own].view(np.int64).tolist()):
                        seeds[found.row[i]].append({"at": i - int(start[found.row[i]]), "seed": value})
                kind = pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())]))
                columns = [batch.column(0).slice(first, len(texts)), pa.array(texts, pa.list_(pa.int64())), pa.array(seeds, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_words", "seeds"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(work, f"item {kind}, item_words array<long>, seeds array<struct<at: int, seed: long>>")


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """One bit for each value of the last BITS bits of a seed: 2**BITS / 8 bytes at most reach the driver."""
    place = F.col("seed").bitwiseAND((1 << BITS) - 1) + 1
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for part, bits in parts.toLocalIterator():
        at = (part - 1) << 12
        table[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
    return table


def _regions(places: np.ndarray, spans: np.ndarray, found: W.Words, margin: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of words around hits (sorted by place): first and last hit, first and last word."""
    first = None
    start, end = found.row_start, found.row_end
    for k, (p, span) in enumerate(zip(places.tolist(), spans.tolist())):
        row = found.row[p]
        low, high = max(int(start[row]), p - margin), min(int(end[row]), p + span + margin)
        if first is not None and found.row[places[first]] == row and low <= right:
            right = max(right, high)
        else:
            if first is not None:
                yield first, k, left, right
            first, left, right = k, low, high
    if first is not None:
        yield first, len(places), left, right


def _training_hits(docs: DataFrame, table, limits: SeedLimits, masks: tuple[str, ...]) -> DataFrame:
    """Stretches of training words with the hits inside: (id, digest, begin, words, hits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, low = np.frombuffer(table.value, np.uint8), np.uint64((1 << BITS) - 1)
        hit_kind = pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())]))
        for batch in batches:
            for first, _, h, found in _word_hashes(batch.column(1)):
                places, seeds, spans = [], [], []
                for (at, g), mask in zip(seed_hashes(h, found.row, masks), masks):
                    place = g & low
                    hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    places.append(at[hit])
                    seeds.append(g[hit])
                    spans.append(np.full(int(hit.sum()), len(mask)))
                places, seeds, spans = map(np.concatenate, (places, seeds, spans))
                order = np.argsort(places, kind="stable")
                places, seeds, spans = places[order], seeds[order].view(np.int64), spans[order]
                rows = []
                for a, b, left, right in _regions(places, spans, found, limits.window):
                    row = int(found.row[places[a]])
                    text = batch.column(1)[first + row].as_buffer()
                    rows.append(
                        {
                            "id": batch.column(0)[first + row],
                            "digest": hashlib.md5(text).hexdigest(),
                            "begin": left - int(found.row_start[row]),
                            "words": h[left:right].view(np.int64),
                            "hits": [{"at": int(p) - left, "seed": int(s)} for p, s in zip(places[a:b], seeds[a:b])],
                        }
                    )
                columns = [
                    pa.array([r["id"].as_py() for r in rows], batch.schema.field(0).type),
                    pa.array([r["digest"] for r in rows], pa.string()),
                    pa.array([r["begin"] for r in rows], pa.int64()),
                    pa.array([r["words"] for r in rows], pa.list_(pa.int64())),
                    pa.array([r["hits"] for r in rows], hit_kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "begin", "words", "hits"])

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, digest string, begin long, words array<long>, hits array<struct<at: int, seed: long>>"
    return docs.mapInArrow(work, schema)


def best_window(words: np.ndarray, item: np.ndarray, shift: int, window: int) -> tuple[int, int]:
    """Most equal words in a window of min(window, len(item)) words, and the window's place in words.

    Word i of the item lies at place i + shift of words. (-1, 0): the window does not fit.
    """
    size, low = min(window, len(item)), max(0, shift)
    high = min(len(words), shift + len(item))
    if high - low < size:
        return -1, 0
    equal = np.concatenate([[0], np.cumsum(words[low:high] == item[low - shift : high - shift])])
    inside = equal[size:] - equal[:-size]
    at = int(inside.argmax())
    return int(inside[at]), low + at


def _verified(pairs: DataFrame, limits: SeedLimits) -> DataFrame:
    """pairs (id, digest, begin, words, item, item_words, shift) with an overlap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, items = batch.column("words"), batch.column("item_words")
            begin, shift = batch.column("begin").to_pylist(), batch.column("shift").to_pylist()
            keep, equal, size, at = [], [], [], []
            for k in range(len(batch)):
                item = items[k].values.to_numpy(zero_copy_only=False)
                n, place = best_window(words[k].values.to_numpy(zero_copy_only=False), item, shift[k], limits.window)
                full = min(limits.window, len(item))
                if n >= limits.share * full:
                    keep.append(k)
                    equal.append(n)
                    size.append(full)
                    at.append(begin[k] + place)
            chosen = batch.select(["id", "digest", "item"]).take(pa.array(keep, pa.int64()))
            columns = [*chosen.columns, *(pa.array(x, pa.int64()) for x in (equal, size, at))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "item", "equal_words", "window_words", "first_word"])

    id_kind, item_kind = (pairs.schema[c].dataType.simpleString() for c in ("id", "item"))
    schema = f"id {id_kind}, digest string, item {item_kind}, equal_words long, window_words long, first_word long"
    return pairs.mapInArrow(work, schema)


def _overlaps(docs: DataFrame, items: DataFrame, limits: SeedLimits) -> DataFrame:
    """docs (id, text) and items (item, text): one row per verified alignment, and the items' classes."""
    spark = docs.sparkSession
    classes = items.where("text is not null").groupBy("text").agg(F.min("item").alias("item"))
    short = short_masks(limits)
    test = written(_item_seeds(classes.select("item", "text"), limits, short), "test-seeds")
    lengths = {r.n for r in test.select(F.size("item_words").alias("n")).where(F.col("n").isin([n for n, _ in short])).distinct().collect()} if short else set()
    masks = (*limits.masks, *(m if n in lengths else "" for n, m in short))
    seeds = test.select("item", F.explode("seeds").alias("s")).select("item", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed"))
    table = spark.sparkContext.broadcast(_bit_table(seeds).tobytes())
    hits = written(_training_hits(docs, table, limits, masks), "training-hits").withColumn("region", F.monotonically_increasing_id())
    hits = written(hits, "training-regions")
    single = hits.select("region", F.explode("hits").alias("s")).select("region", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    # Counted, as Spark sizes them by the items' file, which is much smaller.
    few = (test.agg(F.sum(F.size("seeds"))).first()[0] or 0) <= BROADCAST
    aligned = single.join(F.broadcast(seeds) if few else seeds.hint("merge"), "seed").select("region", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = aligned.join(hits.drop("hits"), "region").join(test.select("item", "item_words"), "item")
    return _verified(pairs, limits)


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limits: SeedLimits = SeedLimits()
) -> DataFrame:
    """One row per contaminated document and item: id, item id, words of the best window that are equal,
    window_words and first_word (place of that window in the document, in words)."""
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    found = _overlaps(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, limits)
    best = found.groupBy("id", "digest", "item").agg(F.max(F.struct("equal_words", "window_words", (-F.col("first_word")).alias("first"))).alias("m"))
    members = items.where("text is not null")
    twins = members.groupBy("text").agg(F.min("item").alias("class")).join(members, "text").select("class", F.col("item").alias("member"))
    best = best.join(twins, F.col("item") == F.col("class"))
    return best.select(
        F.col("id").alias(id_col), F.col("member").alias(item_col), "m.equal_words", "m.window_words", (-F.col("m.first")).alias("first_word")
    )


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limits: SeedLimits = SeedLimits()) -> DataFrame:
    """The documents without an overlap, with all their columns."""
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    texts = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text"))
    bad = _overlaps(texts, items, limits).select("digest").distinct()
    return packed(docs, digest=F.md5(F.col(text_col))).join(bad, "digest", "left_anti").select("doc.*")
