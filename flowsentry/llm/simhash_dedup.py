"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints with at most two differing bits, cut into two segments of 32 bits, have a
segment in which they differ by at most one bit. Each segment is therefore indexed as it is and with
each of its bits as a wildcard. Equal keys are found by aggregation; a key is of use only if two
fingerprints meet there and, for a wildcard, differ in that bit. Members of small buckets are paired
and verified. Members of a large bucket are indexed once more by wildcards in the other segment: what
then meets agrees in all but two bits (at most four fingerprints), so hot buckets cost a fixed number
of keys per member and lose no link. Links feed a distributed union-find.

Work is done on distinct fingerprints; copies of a text never meet each other.

Defined results: a null or empty text has the fingerprint zero and is linked like any other. A null id
takes the component of its fingerprint, null if all ids linked to it are null. Repeated rows give
repeated rows. Extra columns are ignored by link() and passed on by keep_one(). An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import packed, with_row, written

#: Shingles hashed and counted at once.
CHUNK = 1 << 15
#: Largest bucket whose members are paired; larger ones are indexed again.
PAIRED = 32


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text (UTF-8): a bit is set if set in over half the shingle hashes."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start, end = np.concatenate([[0], at + 1]), np.concatenate([at, [len(joined)]])
    size = min(3, len(words))
    start, end = start[: len(words) - size + 1], end[size - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(start), CHUNK):
        spans = zip(start[k : k + CHUNK].tolist(), end[k : k + CHUNK].tolist())
        h = np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(start)).tobytes(), "big", signed=True)


def _fingerprints(column: pa.Array) -> pa.Array:
    values = column.cast(pa.large_binary())
    return pa.array([fingerprint(v.as_buffer().to_pybytes()) if v.is_valid else 0 for v in values], pa.int64())


def fingerprints(texts: DataFrame) -> DataFrame:
    """texts, whose last column is the text, with the fingerprint as a signed long (_fp) in its place."""
    carry = texts.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns[:-1], _fingerprints(batch.columns[-1])]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "_fp"])

    return texts.mapInArrow(work, texts.select(*carry).schema.add("_fp", "long"))


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp, side): each segment plain and with one wildcard; side is the wildcard's own bit."""
    value = "if(k < 32 or k = 64, _fp & 4294967295, shiftrightunsigned(_fp, 32))"
    wildcard = "if(k < 64, shiftleft(1L, k % 32), 0L)"
    return prints.select("_fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k")).select(
        F.expr(f"shiftleft(cast(k as bigint), 32) | ({value} & ~{wildcard})").alias("key"),
        "_fp",
        F.expr("if(k < 64, cast(getbit(_fp, k) as int), 0)").alias("side"),
    )


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect what two bits or fewer keep apart; prints: distinct values in column _fp."""
    variants = _variants(prints)
    buckets = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high"))
    exact = F.shiftright("key", 32) >= 64
    useful = buckets.where((F.col("n") > 1) & (exact | (F.col("low") < F.col("high")))).select("key", "n")
    # Merged: by the size of the fingerprints, Spark would broadcast a table that has up to 66 rows for each of them.
    members = written(variants.join(useful.hint("merge"), "key"), "simhash-members")
    exact = F.shiftright("key", 32) >= 64
    small = members.where(F.col("n") <= PAIRED)
    other = small.select("key", F.col("_fp").alias("other"), F.col("side").alias("other_side"))
    pairs = (
        small.join(other.hint("merge"), "key")
        .where((F.col("_fp") < F.col("other")) & (exact | (F.col("side") != F.col("other_side"))))
        .where(F.bit_count(F.col("_fp").bitwiseXOR(F.col("other"))) <= 2)
        .select(F.col("_fp").alias("a"), F.col("other").alias("b"))
    )
    # The other segment of a large bucket: one more wildcard beside a wildcard, two beside a plain segment.
    again = """transform(
        if(shiftright(key, 32) >= 64,
           filter(flatten(transform(sequence(0, 31), i -> transform(sequence(0, 31), j -> array(i, j)))), p -> p[0] < p[1]),
           transform(sequence(0, 31), i -> array(i, i))),
        p -> struct(shiftright(key, 32) as kind, p[0] as i, p[1] as j,
            _fp & ~shiftleft(1L, p[0] + _shift) & ~shiftleft(1L, p[1] + _shift) & ~_own as rest))"""
    kind = F.shiftright("key", 32)
    first_segment = (kind < 32) | (kind == 64)
    large = members.where(F.col("n") > PAIRED).withColumns(
        {
            "_shift": F.when(first_segment, 32).otherwise(0),
            "_own": F.when(kind < 64, F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))")).otherwise(F.lit(0).cast("long")),
        }
    )
    met = large.select("_fp", F.explode(F.expr(again)).alias("k")).groupBy("k").agg(F.min("_fp").alias("b"), F.collect_set("_fp").alias("all"))
    starred = met.where(F.size("all") > 1).select(F.explode("all").alias("a"), "b").where("a <> b")
    return pairs.unionByName(starred)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id (smallest id reachable)."""
    rows = written(fingerprints(docs.select(F.col(id_col).alias("id"), text_col)), "simhash-rows")
    labelled = _components(rows, F.min("id").alias("component_id"))
    found = rows.join(labelled, "_fp", "left")
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(rows: DataFrame, smallest) -> DataFrame:
    """(_fp, component_id): `smallest` aggregated over the rows of each component."""
    own = written(rows.groupBy("_fp").agg(smallest), "simhash-prints")
    joined = components(links(own.select("_fp")))
    root = own.join(joined.hint("merge"), F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("component", "_fp").alias("_root"), "component_id")
    least = root.groupBy("_root").agg(F.min("component_id").alias("component_id"))
    return root.drop("component_id").join(least, "_root").select("_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component: the one with the smallest id (null last; of ties any one)."""
    rows = with_row(fingerprints(packed(docs, text=F.col(text_col))), "simhash-docs")
    own = F.col(f"doc.{id_col}")
    order = F.struct(own.isNull().alias("none"), own.alias("id"), F.col("row"))
    keep = _components(rows.select("doc", "_fp", "row"), F.min(order).alias("component_id"))
    keep = keep.select(F.col("component_id.row").alias("row")).distinct()
    return rows.join(keep, "row", "left_semi").select("doc.*")
