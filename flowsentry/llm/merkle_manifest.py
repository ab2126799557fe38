"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are leaves, in order of their id, of one binary tree per group (such as a language); the roots of
the groups, in order of the group, are the leaves of one more tree, whose root stands for the dataset.

Positions come from one range sort and the small table of its partitions. Trees are built ten levels at
a time by blocks of 1024 neighbouring nodes, so that a tree of any size takes few rounds and a hot group
is spread over its blocks. Every node below a root then holds a segment: its sibling, if it has one.
In each self-join a node appends the segment of the ancestor it points to, which doubles its distance,
until every leaf has reached its root. Only nodes that a later round can meet stay in the table, so all
rounds together read little more than the leaves once a round. A node is met by at most 2^step leaves
while these joins are shuffled; once the nodes to be met are few (counted first), they are broadcast.

Defined results: null ids come first, rows with equal ids by their leaf, equal rows in any order (which
no output shows). A null group is a group of its own, before all others. A null field is written `-`.
An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import forget, written

#: Levels built at once, and rows of a table that may be broadcast.
LEVELS, SMALL = 10, 8192
#: Copies of each row of a larger table that all rows of a group look up.
SALTS = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, level int, pos long, n long, digest binary, sibling binary, top boolean"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the fields, each as `-` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows (with a column tree) with pos, the place in the order inside the tree, and n, the rows of the tree."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    runs = ranged.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    placed = ranged.withColumn("_part", part).join(runs, ["tree", "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _grown(level: int, pos: list[int], nodes: list[bytes], size: int) -> dict[str, list]:
    """The nodes of a block with their siblings, up to its top (one row with top set); size: nodes of this level in the tree."""
    out: dict[str, list] = {"level": [], "pos": [], "digest": [], "sibling": [], "top": []}
    first = pos[0]
    for _ in range(LEVELS):
        if size == 1:
            break
        for i in range(len(nodes)):
            j = i ^ 1
            out["level"].append(level)
            out["pos"].append(first + i)
            out["digest"].append(None)
            out["sibling"].append(nodes[j] if j < len(nodes) else None)
            out["top"].append(False)
        pairs = [nodes[i].hex() + (nodes[i + 1].hex() if i + 1 < len(nodes) else "") for i in range(0, len(nodes), 2)]
        nodes = [hashlib.sha256(p.encode()).digest() for p in pairs]
        level, first, size = level + 1, first >> 1, (size + 1) >> 1
    for column, value in zip(out.values(), (level, first, nodes[0], None, True)):
        column.append(value)
    return out


def _block(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    level, n = table["level"][0].as_py(), table["n"][0].as_py()
    grown = _grown(level, table["pos"].to_pylist(), table["digest"].to_pylist(), -(-n >> level))
    rows = len(grown["level"])
    types = {"level": pa.int32(), "pos": pa.int64(), "digest": pa.binary(), "sibling": pa.binary(), "top": pa.bool_()}
    columns = {k: pa.array(v, types[k]) for k, v in grown.items()}
    return pa.table({"tree": pa.array([table["tree"][0].as_py()] * rows, pa.string()), "level": columns["level"], "pos": columns["pos"], "n": pa.array([n] * rows, pa.int64()), "digest": columns["digest"], "sibling": columns["sibling"], "top": columns["top"]})


def _trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes below the roots (tree, level, pos, n, sibling), roots (tree, digest), and the tables both are read from."""
    level, nodes, roots, tables = leaves.withColumn("level", F.lit(0)), [], [], []
    done = F.col("level") == _height(F.col("n"))
    while True:
        blocks = level.withColumn("block", F.shiftright("pos", LEVELS))
        grown = written(blocks.groupBy("tree", "block").applyInArrow(_block, _NODE), "merkle-nodes")
        tables.append(grown)
        nodes.append(grown.where("not top").select("tree", "level", "pos", "n", "sibling"))
        tops = grown.where("top")
        roots.append(tops.where(done).select("tree", "digest"))
        level = tops.where(~done).select("tree", "level", "pos", "n", "digest")
        if level.isEmpty():
            break
    union = DataFrame.unionByName
    below, above = nodes[0], roots[0]
    for more, tops in zip(nodes[1:], roots[1:]):
        below, above = union(below, more), union(above, tops)
    return below, above, tables


def _paths(nodes: DataFrame) -> DataFrame:
    """(tree, pos, path) of every leaf below a root: its siblings up to the root, 32 bytes each."""
    counts = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}
    height, step, last = max(counts, default=0) + 1, 1, None
    now = nodes.select("tree", "level", "pos", F.coalesce("sibling", F.lit(b"")).alias("path"))
    while step < height:
        met = now.where(F.col("level") % (2 * step) == step).select(
            F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("path").alias("_more")
        )
        if sum(c for level, c in counts.items() if level % (2 * step) == step) <= SMALL:
            met = F.broadcast(met)
        going = now.where(F.col("level") % (2 * step) == 0)
        on = (F.col("tree") == F.col("_tree")) & (F.col("level") + step == F.col("_level")) & (F.shiftright("pos", step) == F.col("_pos"))
        joined = going.join(met, on, "left")
        now = written(joined.select("tree", "level", "pos", F.concat("path", F.coalesce("_more", F.lit(b""))).alias("path")), "merkle-paths")
        if last is not None:
            forget(last)
        last, step = now, step * 2
    return now.where("level = 0").drop("level")


def _with_groups(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """rows with the columns of their group: few groups are broadcast, many are copied under salts."""
    if n_groups <= SMALL:
        return rows.join(F.broadcast(groups), "tree")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", (F.col("pos") % SALTS).cast("int")).join(salted, ["tree", "_salt"]).drop("_salt")


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per document: id, the columns of `carry`, leaf, subroot, root (hex), path (its siblings, 32 bytes
    each, from the leaf up to the root) and place, which fold() needs besides these.
    """
    carry = dict(carry or {})
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("_id"),
        F.unhex(leaf_hash([F.col(f) for f in fields])).alias("digest"),
        *(c.alias(f"_carry_{name}") for name, c in carry.items()),
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    )
    leaves = written(_numbered(written(leaves, "merkle-rows"), ["_id", "digest", "_salt"], "merkle-sorted").drop("_salt"), "merkle-leaves")
    nodes, roots, tables = _trees(leaves.select("tree", "pos", "n", "digest"))
    paths = _paths(nodes)

    groups = roots.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), "digest")
    groups = written(_numbered(written(groups, "merkle-groups"), ["_group"], "merkle-group-order"), "merkle-group-leaves")
    top_nodes, top_roots, top_tables = _trees(groups.select("tree", "pos", "n", "digest"))
    n_groups, root = groups.count(), top_roots.first()
    above = groups.drop("tree").join(_paths(top_nodes).drop("tree"), "pos", "left").select(
        F.col("_group").alias("tree"),
        F.col("digest").alias("_subroot"),
        F.col("pos").alias("_group_pos"),
        F.coalesce("path", F.lit(b"")).alias("_group_path"),
    )
    # Without a sibling on any level a leaf has no path; a group of one leaf has no nodes at all.
    found = leaves.join(paths, ["tree", "pos"], "left")
    found = _with_groups(found, above, n_groups)
    lower = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("_id").alias(id_col),
        *(F.col(f"_carry_{name}").alias(name) for name in carry),
        lower("digest").alias("leaf"),
        lower("_subroot").alias("subroot"),
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"),
        F.concat(F.coalesce("path", F.lit(b"")), "_group_path").alias("path"),
        F.struct("pos", "n", F.col("_group_pos").alias("group_pos"), F.lit(n_groups).cast("long").alias("groups")).alias("place"),
    )


def fold(leaf: Column, path: Column, place: Column) -> Column:
    """The root that follows from a leaf (hex) and its path."""

    def climb(state: Column, pos: Column, n: Column) -> Column:
        def up(s: Column, level: Column) -> Column:
            own = F.call_function("shiftright", pos, level)
            size = F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
            left, right = own % 2 == 1, (own % 2 == 0) & (own + 1 < size)
            sibling = F.lower(F.hex(F.substring(path, s["used"] * 32 + 1, F.lit(32))))
            both = F.when(left, F.concat(sibling, s["node"])).when(right, F.concat(s["node"], sibling)).otherwise(s["node"])
            return F.struct(F.sha2(both.cast("binary"), 256).alias("node"), (s["used"] + (left | right).cast("int")).alias("used"))

        levels = F.when(_height(n) > 0, F.sequence(F.lit(0), _height(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(levels, state, up)

    start = F.struct(leaf.alias("node"), F.lit(0).alias("used"))
    return climb(climb(start, place["pos"], place["n"]), place["group_pos"], place["groups"])["node"]


def path_hash(path: Column) -> Column:
    """SHA-256 (hex) of the siblings, as hex text one after another."""
    return F.sha2(F.lower(F.hex(path)).cast("binary"), 256)
