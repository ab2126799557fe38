"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code-point order weigh 5, 2, 1, repeating, and share a multiple of all words; a
target stops at twice its source's words and the excess is shared again by weight (water filling).
Documents are dealt to shards by a seeded hash. Inside a shard the documents of a source, in seeded
order, form one line of words that is cut into blocks of equal length. The shard's blocks are
apportioned to its sources by highest quotients vote / (2k + 1), a source's vote being its target's
part for this shard. A quota of whole rounds takes every block as often; the remainder is a run of
blocks from a seeded start, closed to a ring. No document is taken more than twice.

Only (id, source, size) is moved. A shard holds a bounded number of documents, so the hottest source is
dealt over many tasks; the table of sources passes through the driver with its size checked.

Defined results: a null text has size 0; a null source is a source of its own, last in order. Null ids
share one place in the seeded order; tied and repeated rows follow each other there and count one by
one. A source without words has target 0. Extra columns are ignored by mix() and kept by mixed_documents().
An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORD, n_words, packed, with_row, written


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Words of the mix over words of all documents.
    total: float = 1.5
    #: Times a source may be used.
    times: int = 2
    #: Words of a block.
    block: int = 32
    #: Documents of a shard, on average.
    shard_rows: int = 1024
    seed: str = "mix"
    #: Bound of the source table, which the driver holds.
    max_sources: int = 100_000


def water_fill(sizes: list[int], mix: Mix) -> list[float]:
    """Targets of sources given in order; see the module."""
    caps = [float(mix.times * s) for s in sizes]
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    left, open_weight = mix.total * sum(sizes), sum(weights)
    targets = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    for at, i in enumerate(order):
        if caps[i] * open_weight > left * weights[i]:  # from here on no cap is reached
            for j in order[at:]:
                targets[j] = left * weights[j] / open_weight
            break
        targets[i] = caps[i]
        left, open_weight = left - caps[i], open_weight - weights[i]
    return targets


def quotas(votes: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients vote / (2k + 1); ties to the earlier party, none beyond its cap."""
    given = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        i = heap[0][1]
        given[i] += 1
        if given[i] == caps[i]:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def _seeded(seed: str, *what: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(w.cast("string"), F.lit("")) for w in what)))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _parts(sized: DataFrame, mix: Mix) -> DataFrame:
    """sized (_id, _source, _size, others) with source_size, target, and the words _begin.._end of each
    document on its line, the line's blocks, the passes over it and the run of blocks taken once more."""
    sources = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    sources = sources.orderBy(F.col("_source").asc_nulls_last()).limit(mix.max_sources + 1).collect()
    if len(sources) > mix.max_sources:
        raise ValueError(f"more than {mix.max_sources} sources")
    targets = water_fill([r["source_size"] for r in sources], mix)
    known = [(i, r["_source"], r["source_size"], t) for i, (r, t) in enumerate(zip(sources, targets))]
    spark = sized.sparkSession
    kind = sized.schema["_source"].dataType.simpleString()
    source_table = spark.createDataFrame(known, f"_at int, _name {kind}, source_size long, target double")
    shards = max(1, -(-sum(r["rows"] for r in sources) // mix.shard_rows))

    digest = _seeded(mix.seed, F.col("_id"))
    dealt = sized.withColumn("_order", digest).withColumn("_shard", F.pmod(_number(F.col("_order")), F.lit(shards)))
    dealt = dealt.join(F.broadcast(source_table), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    line = Window.partitionBy("_shard", "_at")
    ordered = line.orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_end", F.sum("_size").over(ordered)).withColumn("_begin", F.col("_end") - F.col("_size"))

    per_line = dealt.groupBy("_shard", "_at", "source_size", "target").agg(F.sum("_size").alias("words"))
    start = _number(_seeded(mix.seed, F.lit("start"), F.col("_shard"), F.col("_at")))

    def apportion(lines: pd.DataFrame) -> pd.DataFrame:  # one shard: a row per source
        lines = lines.sort_values("_at", ignore_index=True)
        votes = [t * w / s if s else 0.0 for t, w, s in zip(lines["target"], lines["words"], lines["source_size"])]
        blocks = [-(-int(w) // mix.block) for w in lines["words"]]
        seats = int(sum(votes) / mix.block + 0.5)
        given = quotas(votes, [mix.times * n for n in blocks], seats)
        lines["_blocks"] = blocks
        lines["_passes"] = [q // n if n else 0 for q, n in zip(given, blocks)]
        lines["_run"] = [q % n if n else 0 for q, n in zip(given, blocks)]
        return lines[["_shard", "_at", "_blocks", "_passes", "_run"]]

    quota = per_line.groupBy("_shard").applyInPandas(apportion, "_shard long, _at int, _blocks long, _passes long, _run long")
    quota = quota.withColumn("_start", F.when(F.col("_blocks") > 0, F.pmod(start, F.col("_blocks"))).otherwise(0))
    return dealt.join(quota, ["_shard", "_at"])


def _taken_once_more(mix: Mix) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The two stretches (begin, end) of a document inside its line's run, the second past the line's end."""
    begin, end = F.col("_begin"), F.col("_end")
    first, last = F.col("_start"), F.col("_start") + F.col("_run")

    def within(low: Column, high: Column) -> tuple[Column, Column]:
        return F.greatest(begin, low * mix.block), F.least(end, high * mix.block)

    return within(first, F.least(last, F.col("_blocks"))), within(F.lit(0), last - F.col("_blocks"))


def _length(stretch: tuple[Column, Column]) -> Column:
    return F.greatest(F.lit(0), stretch[1] - stretch[0])


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target (of its source) and taken (words, repeats counted)."""
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(text_col).alias("_size"))
    parts = _parts(written(sized, "mix-sizes"), mix)
    one, two = _taken_once_more(mix)
    taken = F.col("_passes") * F.col("_size") + _length(one) + _length(two)
    return parts.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None
) -> DataFrame:
    """The mix itself, with the columns of docs: a row for every time a document is taken.

    A document taken whole keeps its text; of one that a run's edge cuts, the words taken are joined by
    spaces (length_col then gets the new number of characters). Documents without words are left out.
    """
    rows = with_row(packed(docs), "mix-docs")
    text = F.col(f"doc.{text_col}")
    sized = rows.select(F.col(f"doc.{id_col}").alias("_id"), F.col(f"doc.{source_col}").alias("_source"), n_words(text).alias("_size"), "row")
    parts = _parts(written(sized, "mix-sizes"), mix)
    whole = F.struct(F.lit(0).cast("long").alias("skip"), F.col("_size").alias("words"))
    stretches = [F.struct((b - F.col("_begin")).cast("long").alias("skip"), (e - b).cast("long").alias("words")) for b, e in _taken_once_more(mix)]
    times = F.concat(F.array_repeat(whole, F.col("_passes").cast("int")), F.array(*stretches))
    pieces = parts.select("row", F.col("_size").alias("all"), F.explode(times).alias("piece")).where("piece.words > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), (F.col("piece.skip") + 1).cast("int"), F.col("piece.words").cast("int")), " ")
    is_whole = F.col("piece.words") == F.col("all")
    doc = F.col("doc").withField(f"`{text_col}`", F.when(is_whole, text).otherwise(cut))
    # Merged: pieces come of an explode, so Spark sizes them too low and would broadcast them.
    out = rows.join(pieces.hint("merge"), "row").select(doc.alias("doc"), is_whole.alias("whole"))
    if length_col:
        length = F.when(F.col("whole"), F.col(f"doc.{length_col}")).otherwise(F.length(f"doc.{text_col}"))
        out = out.withColumn("doc", F.col("doc").withField(f"`{length_col}`", length.cast(docs.schema[length_col].dataType)))
    return out.select("doc.*")
