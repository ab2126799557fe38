"""Exact Jaccard self-join of documents' word n-gram sets by filtering under several global token orders.

Two sets whose similarity reaches the threshold share a token among the first few of each (the prefix) in
any order of all tokens. Here they must do so under every one of several orders. As prefixes are short, all
orders begin with a fixed quarter of all tokens, so only of these the document frequency is counted; those
of them that are frequent come last, by classes of their frequency. Orders differ inside a class. So
boilerplate that many documents share seldom is in a prefix.

Sets that are equal form a class and only classes are joined. Links are wanted for reachability, so pairs
already known to be connected need no verification:

1. pairs that meet in buckets (a token in the prefix) of up to PAIRED classes are formed under every order
   and kept if they meet under all of them; each class is verified with its least partner first, and other
   pairs only if their components still differ;
2. a larger bucket matters only to classes that are in large buckets under every order (the crowd). There
   every member is verified with the first one, the pivot. Two members that are both similar to the pivot
   are connected. If one is not, then for the two to be similar they must have a difference to the pivot in
   common: a token that both have and the pivot lacks or, where the other one lacks more of the pivot's
   tokens than it has tokens of its own, a token of the pivot that both lack. So the crowd is bucketed again
   by these differences, which in a family of near copies are rare; small buckets are paired, and larger ones
   are a crowd with pivots of their own. After LEVELS of this, members that are still apart are paired in full.

No step caps a bucket. The pair of steps is exact: with t the threshold, e the number of differences to the
pivot and H = (|x| + |y|) (1 - t) / (1 + t) the differences that similar sets can have, x and y share at least
(e_x + e_y - H) / 2 differences, which exceeds half of e_y if x is not similar to the pivot, and e_x - H. So
prefixes of the differences are enough, own tokens first: about half of them for a member that is similar to
the pivot, and 1 / 9 of the set's size for another one.

A token is a 64-bit hash of the n-gram; sets are compared by 128-bit digests and counted exactly on hashes.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than n is one token. A null id takes the component of its links, null where all of it are null.
Repeated rows give repeated rows. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .frames import forget, written

#: Bytes of text worked on at once.
SLICE = 8 << 20
#: Token orders, and the tokens (unsigned) below which lies the quarter that comes first in all of them.
ORDERS, QUARTER = 2, np.uint64(1 << 62)
#: Documents from which on a token can count as frequent, and frequent tokens held by each task at most.
FREQUENT, TABLE = 4, 1 << 20
#: Members of a bucket whose pairs are formed at once, and times a larger one is bucketed again.
PAIRED, LEVELS = 64, 3
#: Rows of a table that may be broadcast.
SMALL = 1 << 18


def _distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens


def token_sets(column: pa.Array, n: int, below: np.uint64 | None = None) -> Iterator[np.ndarray]:
    """For each text its distinct n-gram hashes in ascending order (only those below a limit)."""
    for _, h, found in W.word_slices(column, SLICE, lower=True):
        grams = W.window_hashes(h, n)
        for first, last in zip(found.row_start.tolist(), found.row_end.tolist()):
            k = last - first
            own = grams[first : last - n + 1] if k >= n else W.window_hashes(h[first:last], k) if k else h[:0]
            yield _distinct(own if below is None else own[own < below])


def prefix_length(size: int, percent: int) -> int:
    """Tokens of a set of this size that a similar set cannot all lack."""
    return size - -(-percent * size // 100) + 1 if size else 0


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of the first quarter, ascending, and the bit lengths of their document counts.

    Counted over all documents; only the order of tokens depends on the result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, some = 0, []
            for tokens in chain(token_sets(batch.column(0), n, QUARTER), [None]):
                if tokens is not None:
                    some.append(tokens)
                    held += len(tokens)
                if held > 1 << 21 or tokens is None:
                    values, counts = np.unique(np.concatenate([*some, np.zeros(0, np.uint64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["token", "n"])
                    held, some = 0, []

    counts = docs.mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = written(counts.select("token", F.length(F.bin("n")).alias("size")), "ngram-frequent")
    sizes = {r["size"]: r["count"] for r in counts.groupBy("size").count().collect()}
    least, total = 64, 0
    for size in sorted(sizes, reverse=True):  # whole classes, the most frequent first
        total += sizes[size]
        if total > TABLE:
            break
        least = size
    table = counts.where(F.col("size") >= least).toArrow()
    tokens = table["token"].combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table["size"].combine_chunks().to_numpy(zero_copy_only=False)[order].astype(np.uint8)


def _orders(tokens: np.ndarray, frequent: np.ndarray, sizes: np.ndarray, orders: int, length: int) -> list[np.ndarray]:
    """The first `length` of tokens (ascending) under each order."""
    near = tokens[: np.searchsorted(tokens, QUARTER)]
    rank = np.zeros(len(near), np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, near), len(frequent) - 1)
        rank = np.where(frequent[at] == near, sizes[at], 0).astype(np.uint64)
    rare = rank == 0
    if rare.sum() >= length:  # what follows in the order cannot be in the prefix
        near, rank = near[rare], None
    else:
        rank = np.concatenate([rank + ~rare, np.ones(len(tokens) - len(near), np.uint64)])
        near = tokens
    out = []
    for m in range(orders):
        key = W.mix(near ^ np.uint64((0x9E3779B97F4A7C15 * (m + 1)) & 0xFFFFFFFFFFFFFFFF))
        if rank is not None:
            key = (rank << np.uint64(58)) | (key >> np.uint64(6))
        else:
            key = key >> np.uint64(6)
        out.append(near[np.argsort(key, kind="stable")[:length]])
    return out


def _prefixes(docs: DataFrame, n: int, percent: int, orders: int) -> DataFrame:
    """(row, id, n, digest, prefixes) of docs (id, text); prefixes: one array of tokens for each order."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs.select("text"), n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, sizes = frequent.value
        for batch in batches:
            counts, digests, values, ends = [], [], [], [[0]]
            for tokens in token_sets(batch.column(2), n):
                counts.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                length = prefix_length(len(tokens), percent)
                values.extend(_orders(tokens, often, sizes, orders, length))
                ends.append([length] * orders)
            inner = pa.array(np.cumsum(np.concatenate(ends)), pa.int32())
            flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
            outer = pa.array(np.arange(len(counts) + 1) * orders, pa.int32())
            prefixes = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, pa.array(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), prefixes], names)

    names = ["row", "id", "n", "digest", "prefixes"]
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return rows.mapInArrow(work, f"row long, id {kind}, n long, digest binary, prefixes array<array<long>>")


def _token_arrays(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, tokens) of the wanted classes (digest, cls)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                sets = list(token_sets(some.column(0), n))
                digests = pa.array([hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in sets], pa.binary())
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([digests, tokens], ["digest", "tokens"])

    sets = docs.select("text").mapInArrow(work, "digest binary, tokens array<long>")
    few = wanted.count() <= SMALL
    met = sets.join(F.broadcast(wanted) if few else wanted, "digest").select("cls", "tokens")
    return written(met.dropDuplicates(["cls"]), "ngram-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, made: Callable[[str], Column] = F.col) -> DataFrame:
    """The pairs (a, b) that reach the threshold, as a written table; `made` gives a set from what stands for it."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", made("left").alias("left"), made("right").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    enough = 100 * shared >= percent * (F.size("left") + F.size("right") - shared)
    return written(met.where(enough).select("a", "b"), "ngram-links")


def _similar_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _candidates(members: DataFrame, percent: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that meet under every order, once or more in a bucket of up to PAIRED classes; and the crowd (token,
    cls, n): members of larger buckets of the first order that are in larger buckets under all orders.
    """
    every = (1 << orders) - 1
    sizes = members.groupBy("m", "token").agg(F.count("*").alias("k")).select("m", "token", (F.col("k") > PAIRED).alias("large"))
    sized = written(members.join(sizes, ["m", "token"]), "ngram-sized")
    hot = sized.where("large").groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1, m)")).alias("hot"))
    crowd = sized.where("large and m = 0").join(hot.where(F.col("hot") == every), "cls", "left_semi").select("token", "cls", "n")
    small = sized.where("not large").join(hot, "cls", "left").select("m", "token", "cls", "n", F.coalesce("hot", F.lit(0)).alias("hot"))
    other = small.select("m", "token", *(F.col(c).alias(f"{c}_b") for c in ("cls", "n", "hot")))
    met = small.join(other, ["m", "token"]).where("cls < cls_b").where(_similar_size("n", "n_b", percent))
    seen = F.bit_or(F.expr("shiftleft(1, m)")).bitwiseOR(F.max(F.col("hot").bitwiseAND(F.col("hot_b"))))
    pairs = met.groupBy(F.col("cls_b").alias("a"), F.col("cls").alias("b")).agg(seen.alias("seen")).where(F.col("seen") == every).select("a", "b")
    return written(pairs, "ngram-pairs"), written(crowd, "ngram-crowd")


def _rooted(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Links (a, b) of members as links of their roots (cls, root); without roots each member is its own."""
    if roots is None:
        return links
    for side in ("a", "b"):
        links = links.join(roots.select(F.col("cls").alias(side), F.col("root").alias(f"root_{side}")), side)
    return links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct()


def _apart(pairs: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The pairs whose components by the links differ."""
    known = components(links)
    for side in ("a", "b"):
        if roots is None:
            pairs = pairs.withColumn(f"root_{side}", F.col(side))
        else:
            pairs = pairs.join(roots.select(F.col("cls").alias(side), F.col("root").alias(f"root_{side}")), side)
        own = known.select(F.col("node").alias(f"root_{side}"), F.col("component").alias(f"comp_{side}"))
        pairs = pairs.join(own, f"root_{side}", "left").withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", f"root_{side}"))
    return pairs.where("comp_a <> comp_b").select("a", "b")


def _links(pairs: DataFrame, crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that give the components of all similar classes."""
    nearest = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = _verified(nearest, sets, percent)
    others = pairs.join(nearest, ["a", "b"], "left_anti")
    links = written(links.unionByName(_verified(_apart(others, links), sets, percent)), "ngram-links")
    band = F.floor(F.log(F.col("n")) / -F.log(F.lit(percent / 100)))
    # Similar sizes are in the same band or in neighbouring ones.
    crowd = crowd.select(F.explode(F.array(band, band + 1)).alias("band"), "token", "cls").select(F.xxhash64("token", "band").alias("bucket"), "cls")
    return crowd_links(crowd, sets, links, percent)


def crowd_links(
    crowd: DataFrame, sets: DataFrame, links: DataFrame, percent: int, roots: DataFrame | None = None, made: Callable[[str], Column] = F.col
) -> DataFrame:
    """The links and more (a, b), so that all similar members of a bucket are connected; no bucket is capped.

    crowd: (bucket, cls), sets: (cls, tokens), links: those known. With roots (cls, root) all links are between roots.
    made: the set of 64-bit tokens from the column of that name, which may hold something shorter to send.
    """
    for level in range(LEVELS):
        crowd = _several(crowd, links, roots)
        if crowd.isEmpty():
            return links
        stars = _stars(crowd, sets, percent, made)
        linked = stars.where("linked").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).where("a <> b")
        links = written(links.unionByName(_rooted(linked, roots)), "ngram-links")
        close, crowd = _by_differences(stars, level)
        links = written(links.unionByName(_rooted(_verified(_apart(close, links, roots), sets, percent, made), roots)), "ngram-links")
    crowd = _several(crowd, links, roots)
    if crowd.isEmpty():
        return links
    left = crowd.select("bucket", F.col("cls").alias("a"), F.col("comp").alias("comp_a"))
    right = crowd.select("bucket", F.col("cls").alias("b"), F.col("comp").alias("comp_b"))
    full = left.join(right, "bucket").where("a > b and comp_a <> comp_b").select("a", "b").distinct()
    return links.unionByName(_rooted(_verified(full, sets, percent, made), roots))


def _several(crowd: DataFrame, links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The crowd (bucket, cls, comp) in buckets that still hold several components, as a written table."""
    known = components(links).select(F.col("node").alias("root"), "component")
    crowd = crowd.select("bucket", "cls")
    crowd = crowd.withColumn("root", F.col("cls")) if roots is None else crowd.join(roots, "cls")
    crowd = written(crowd.join(known, "root", "left").select("bucket", "cls", F.coalesce("component", "root").alias("comp")), "ngram-crowd")
    several = crowd.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return written(crowd.join(several, "bucket", "left_semi"), "ngram-crowd")


def _stars(crowd: DataFrame, sets: DataFrame, percent: int, made: Callable[[str], Column] = F.col) -> DataFrame:
    """Each member of a crowd with the pivots of its buckets: whether it is linked, whether it lacks more than it has of
    its own (short), and the prefix of its differences: own (tokens the pivot lacks) and lacks (of the pivot's tokens)."""
    pivots = crowd.groupBy("bucket").agg(F.min("cls").alias("pivot"))
    pairs = crowd.join(pivots, "bucket").select("cls", "pivot").distinct()
    met = pairs.join(sets.select("cls", F.col("tokens").alias("own")), "cls").join(sets.select(F.col("cls").alias("pivot"), F.col("tokens").alias("lead")), "pivot")
    met = met.select("pivot", "cls", made("own").alias("own"), made("lead").alias("lead"))
    met = met.select("pivot", "cls", F.size("own").alias("n"), F.size("lead").alias("r"), F.array_except("own", "lead").alias("own"), F.array_except("lead", "own").alias("lacks"))
    more, less = F.size("own"), F.size("lacks")
    shared, e = F.col("n") - more, more + less
    linked = 100 * shared >= percent * (F.col("n") + F.col("r") - shared)
    # Differences that any similar member must share: more than half of them but for what sizes allow, or all but n (1 - t) / t.
    slack = (100 - percent) / (100 + percent)
    least = F.when(linked, F.floor((e - slack * (more - less)) / 2 - 1e-6) + 1).otherwise(F.ceil(e - F.col("n") * ((100 - percent) / percent) - 1e-6))
    length = (e - F.greatest(least, F.lit(1)) + 1).cast("int")
    met = met.select("pivot", "cls", linked.alias("linked"), (more < less).alias("short"), F.array_sort("own").alias("own"), F.array_sort("lacks").alias("lacks"), F.greatest(length, F.lit(0)).alias("length"))
    rest = F.greatest(F.col("length") - F.size("own"), F.lit(0))
    first = lambda c, n: F.slice(c, F.lit(1), n)
    return written(met.select("pivot", "cls", "linked", "short", first("own", F.col("length")).alias("own"), first("lacks", rest).alias("lacks")), "ngram-stars")


def _by_differences(stars: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that have a difference to a pivot in common, from buckets of up to PAIRED; the others as a crowd (bucket, cls).

    One of a pair must not be linked to the pivot. A common lack counts only where one lacks more than it has of its own.
    """
    rows = stars
    by_own = rows.select("pivot", F.lit(0).alias("sign"), F.explode("own").alias("token"), "cls", "linked", "short")
    by_lack = rows.where("short or not linked").select("pivot", F.lit(1).alias("sign"), F.explode("lacks").alias("token"), "cls", "linked", "short")
    keyed = by_own.unionByName(by_lack).withColumn("bucket", F.xxhash64("pivot", "sign", "token", F.lit(level)))
    # Dealt once, for the sizes and for the join with them.
    keyed = keyed.select("bucket", "sign", "cls", "linked", "short").repartition("bucket")
    sizes = keyed.groupBy("bucket").agg(
        F.count("*").alias("k"), F.count_if(~F.col("linked")).alias("outside"), F.max("sign").alias("lack"), F.count_if("short").alias("shorts")
    )
    useful = sizes.where((F.col("k") > 1) & (F.col("outside") > 0) & ((F.col("lack") == 0) | (F.col("shorts") > 0))).select("bucket", (F.col("k") > PAIRED).alias("large"))
    met = written(keyed.join(useful, "bucket").select("bucket", "sign", "cls", "linked", "short", "large"), "ngram-differences")
    small = met.where("not large")
    other = small.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("cls", "linked", "short")))
    apart = (F.col("cls") > F.col("cls_b")) & ~(F.col("linked") & F.col("linked_b"))
    lacking = (F.col("sign") == 0) | ((F.col("linked") | F.col("short_b")) & (F.col("linked_b") | F.col("short")))
    close = small.join(other, "bucket").where(apart & lacking).select(F.col("cls").alias("a"), F.col("cls_b").alias("b")).distinct()
    return written(close, "ngram-close"), met.where("large").select("bucket", "cls")


def similar_documents(docs: DataFrame, percent: int = 90, n: int = 3, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id reachable by links of at least percent / 100."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(_prefixes(docs, n, percent, orders), "ngram-prefixes")
    classes = written(found.where("n > 0").groupBy("digest").agg(F.min("row").alias("cls"), F.min("id").alias("least")), "ngram-classes")
    own = found.join(classes.select(F.col("cls").alias("row")), "row", "left_semi").select(F.col("row").alias("cls"), "n", "prefixes")
    own, members = written(own, "ngram-own"), None
    for m in range(orders):  # what meets no other class under one order need not be looked at under the next
        keys = own.select(F.lit(m).alias("m"), F.explode(F.col("prefixes")[m]).alias("token"), "cls", "n")
        shared = keys.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("token")
        met = written(keys.join(shared, "token").select("m", "token", "cls", "n"), "ngram-shared")
        members = met if members is None else members.unionByName(met)
        own = own.join(met.select("cls").distinct(), "cls", "left_semi")
    pairs, crowd = _candidates(members.join(met.select("cls").distinct(), "cls", "left_semi"), percent, orders)
    union = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(crowd.select("cls"))
    sets = _token_arrays(docs, written(classes.join(union.distinct(), "cls").select("digest", "cls"), "ngram-wanted"), n)

    joined = components(_links(pairs, crowd, sets, percent))
    forget(sets)
    root = classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("digest", F.coalesce("component", "cls").alias("root"), "least")
    root = written(root, "ngram-roots")
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    result = written(root.join(least, "root").select("digest", "component_id"), "ngram-components")
    out = found.select("id", "n", "digest").join(result, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
