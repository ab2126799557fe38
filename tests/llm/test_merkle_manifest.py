"""Merkle manifest against trees built node by node, with proofs read off them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowsentry.llm import merkle_manifest as M


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root, and for each leaf its siblings from the leaf up."""
    level, paths, own = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, own):
            if i ^ 1 < len(level):
                path.append(level[i ^ 1])
        level, own = [digest("".join(level[k : k + 2])) for k in range(0, len(level), 2)], [i // 2 for i in own]
    return level[0], paths


def expected(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = tree([built[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1]):
            out.append((r[0], leaf, built[g][0], root, digest("".join(path + above[k]))))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns(
        {"tree": F.lit(1), "pos": F.lit("x"), "_id": F.lit(2), "digest": F.lit(None).cast("int"), "path": F.lit("p")}
    )


def actual(df):
    out = df.select("doc_id", "leaf", "subroot", "root", M.path_hash(F.col("path")).alias("proof"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_small_trees(spark, n):
    rows = [(i * 7 % n, "s", "en", i, f"text {i}") for i in range(n)]
    assert actual(M.manifest(frame(spark, rows))) == expected(rows)


def test_groups_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 2)
    rows = [(i % 50, None if i % 3 else "s", ["en", "de", None, "", "é", "zz", "z"][min(i % 9, 6)], None if i % 5 == 0 else i, "x" * (i % 4) if i % 6 else None) for i in range(300)]
    rows += [(None, "s", "en", 1, "t")] * 2 + [(None, None, None, None, None)] * 3 + [(5, "s", "en", 5, "twice")] * 2 + [(7, "a", "one", 1, "é" * 30000)]
    assert actual(M.manifest(frame(spark, rows))) == expected(rows)
    monkeypatch.setattr(M, "SMALL", 2)  # nothing is broadcast, and groups are met under salts
    found = M.manifest(frame(spark, rows))
    assert actual(found) == expected(rows)
    assert found.where(M.fold(F.col("leaf"), F.col("path"), F.col("place")) != F.col("root")).count() == 0


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, "t") for i in range(20)]
    found = M.manifest(frame(spark, rows), carry={"claimed": F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)})
    assert found.where(M.fold(F.col("claimed"), F.col("path"), F.col("place")) == F.col("root")).count() == 0


def test_empty_table(spark):
    assert M.manifest(frame(spark, [])).count() == 0
