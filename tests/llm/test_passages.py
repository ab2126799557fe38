"""Decontamination, line dedup and the two passage operators against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from flowsentry.llm import components, decontamination, line_dedup, suffix_dedup, window_dedup
from flowsentry.llm import passages as Passages
from flowsentry.llm import words as W
from tests.llm.conftest import WORDS, prose

ITEMS = [(1, prose(50, 40)), (2, prose(51, 18)), (3, prose(50, 40)), (4, None), (5, ""), (6, "too short"), (7, prose(52, 9))]


def substituted(text, seed, n):
    words, rng = text.split(), random.Random(seed)
    for i in rng.sample(range(len(words)), n):
        words[i] = "zzz"
    return " ".join(words)


def brute_overlaps(text, item):
    tokens = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    a, b = tokens(text), tokens(item)
    if len(b) < 6:
        return -1
    size, best = min(20, len(b)), -1
    for i in range(len(a) - size + 1):
        for j in range(len(b) - size + 1):
            best = max(best, sum(x == y for x, y in zip(a[i : i + size], b[j : j + size])))
    return best if best >= 0.8 * size else -1


def test_overlaps(spark, make_docs, odd_rows):
    planted = [
        (30, prose(60, 30) + " " + ITEMS[0][1].upper() + "! " + prose(61, 10), "a"),
        (31, prose(62, 30) + " " + substituted(ITEMS[1][1], 1, 3) + " " + prose(63, 30), "a"),
        (32, " ".join(ITEMS[0][1].split()[12:33]), "a"),
        (33, substituted(ITEMS[0][1], 2, 14), "a"),
        (34, prose(64, 50) + ". " + ITEMS[6][1], "a"),
        (30, prose(65, 50), "a"),
    ]
    rows = [*odd_rows[:9], *planted]
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, digest int, region string")
    want = {(i, k, n) for i, t, _ in rows for k, item in ITEMS if (n := brute_overlaps(t, item)) > 0}
    docs = make_docs(rows)
    found = decontamination.overlaps(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.equal_words) for r in found} == want and len(found) == len(want)
    assert {(30, 1), (30, 3), (31, 2), (32, 1), (34, 7)} <= {(i, k) for i, k, _ in want}
    clean = decontamination.keep_clean(docs, items)
    assert clean.columns == docs.columns
    texts = Counter(r.text for r in clean.collect())
    assert texts == Counter(t for _, t, _ in rows if all(brute_overlaps(t, item) < 0 for _, item in ITEMS))
    empty = decontamination.overlaps(make_docs([]), items.limit(0))
    assert empty.count() == 0 and decontamination.keep_clean(docs, items.limit(0)).count() == len(rows)


def test_masks_hit_every_placement():
    import itertools

    masks = decontamination.SeedLimits().masks
    for size, wrong in ((20, 4), (15, 3)):
        for bad in itertools.combinations(range(size), wrong):
            assert any(
                all(s + k not in bad for k, bit in enumerate(m) if bit == "1") for m in masks for s in range(size - len(m) + 1)
            )


def test_short_items_with_every_placement_of_substitutions(spark, make_docs):
    import itertools

    items = [(n, prose(5000 + n, n)) for n in range(6, 13)]
    rows = []
    for n, text in items:
        for wrong in itertools.combinations(range(n), n - -(-4 * n // 5)):
            words = text.split()
            for k in wrong:
                words[k] = f"zz{k}"
            rows.append((len(rows), f"{prose(6000 + len(rows), 9)} {' '.join(words)} {prose(7000 + len(rows), 9)}", "a"))
    want = {(i, k, n) for i, t, _ in rows for k, item in items if (n := brute_overlaps(t, item)) > 0}
    found = decontamination.overlaps(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.equal_words) for r in found} == want and len(want) >= len(rows)


def brute_lines(rows):
    """(doc, line number, line) of all lines with a word, and the root of each line's component."""
    lines = [(i, k, line.strip(" \t\r\x0b\x0c")) for i, t, _ in rows for k, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    names = sorted({x[2] for x in lines})
    sets = [{n.encode()[i : i + 8] for i in range(max(1, len(n.encode()) - 7))} for n in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return lines, {n: find(i) for i, n in enumerate(names)}


def test_line_dedup(make_docs, odd_rows, monkeypatch):
    rng, base = random.Random(3), " ".join(random.Random(8).choices(WORDS, k=40))
    variants = [" ".join(w if rng.random() > 0.02 else "zz" + w for w in base.split()) + f" {k}" for k in range(60)]
    rows = [r for r in odd_rows if r[0] not in (7, 8)]
    rows += [(200 + k, "\n".join(variants[2 * k : 2 * k + 2] + ["", "short", f"own line {k} " + prose(k, 9)]), "a") for k in range(30)]
    lines, root = brute_lines(rows)
    first, size = {}, Counter(root[x] for _, _, x in lines)
    for i, k, x in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(root[x], (i, k))
    want = Counter((i, k, *first[root[x]], size[root[x]], (i, k) == first[root[x]]) for i, k, x in lines)
    for limit in (20, 4):  # with the smaller one, buckets are banded again
        monkeypatch.setattr(line_dedup, "PAIRED", limit)
        monkeypatch.setattr(line_dedup, "BROADCAST", 1_000_000 if limit == 20 else 0)
        got = Counter(tuple(r) for r in line_dedup.dedup_lines(make_docs(rows)).collect())
        assert got == want
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


def test_line_dedup_of_twins_in_a_large_bucket(make_docs):
    """Templated lines that share bands, but are similar only two by two: not to the first line of their bucket."""
    rng, template, rows = random.Random(11), " ".join(random.Random(12).choices(WORDS, k=80))[:200], []
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for k in range(250):
        own = letters(22)
        rows += [(2 * k, template + own + letters(8), "a"), (2 * k + 1, template + own + letters(8), "a")]
    lines, root = brute_lines(rows)
    assert len(set(root.values())) == 250
    got = {(r.doc_id, r.first_doc_id, r.copies) for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got == {(i, i - i % 2, 2) for i, _, _ in lines}


def test_kept_text(make_docs):
    docs = make_docs([(1, "one line here\ntwo lines here", "a"), (2, "one line here\nown", "a"), (3, "one line here", "a"), (4, None, "a")])
    out = line_dedup.kept_text(docs, line_dedup.dedup_lines(docs))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one line here\ntwo lines here", 2: "own", 3: "", 4: ""}


def covered(rows, size):
    """Words of each text inside a run of `size` words that occurs twice or more."""
    count, tokens = Counter(), []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tokens.append((i, words))
        count.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = defaultdict(set)
    for i, words in tokens:
        for k in range(len(words) - size + 1):
            if count[tuple(words[k : k + size])] > 1:
                out[i].update(range(k, k + size))
    return out


def passages(make_docs, odd_rows):
    shared, other = prose(70, 64), prose(71, 55)
    rows = [r for r in odd_rows if r[0] != 2]
    for k in range(25):
        rows.append((300 + k, f"{prose(400 + k, 30 + k)} {shared if k % 2 else other} {prose(500 + k, 20)}", "a"))
    rows += [(400, f"{shared} tail", "a"), (401, f"x {' '.join(shared.split()[:49])} y", "a"), (402, "same " * 130, "a"), (403, prose(90, 300), "b")]
    return rows, make_docs(rows)


def test_suffix_dedup(make_docs, odd_rows):
    rows, docs = passages(make_docs, odd_rows)
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.first_word, r.end_word))
        assert r.n_words == r.end_word - r.first_word >= 50
    assert dict(got) == dict(covered(rows, 50)) and {7, 8, 402} <= set(got) and not {401, 403} & set(got)
    assert suffix_dedup.repeated_passages(make_docs([])).count() == 0


def test_suffix_dedup_needs_the_neighbour_to_the_left(make_docs):
    """Three texts share a head; the one with more words after it is not the one with more before it."""
    a, b, c = prose(80, 30).split(), prose(81, 21).split(), prose(82, 40).split()
    rows = [(1, " ".join(a + b + c[:5]), "s"), (2, " ".join(a + b + ["q"] * 9), "s"), (3, " ".join(["r"] * 30 + b + c[:5] + ["t"]), "s")]
    got = {r.doc_id: (r.first_word, r.end_word) for r in suffix_dedup.repeated_passages(make_docs(rows)).collect()}
    assert got == {1: (0, 51), 2: (0, 51)}


def test_suffix_dedup_of_overlapping_excerpts(make_docs):
    """Excerpts of one text, just above and below 50 words: most repeats span both sides of a head."""
    rng, text = random.Random(5), prose(83, 150).split()
    rows = []
    for k in range(300):
        n, at = rng.randint(30, 54), rng.randint(0, 96)
        rows.append((k, f"{prose(2000 + k, 25)} {' '.join(text[at : at + n])} {prose(3000 + k, 25)}", "s"))
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(make_docs(rows)).collect():
        got[r.doc_id].update(range(r.first_word, r.end_word))
    assert dict(got) == dict(covered(rows, 50)) and len(got) > 20


def test_window_dedup(make_docs, odd_rows):
    rows, docs = passages(make_docs, odd_rows)
    near = prose(72, 80).split()
    for k in range(12):  # one substituted, lost or added word each
        words = near.copy()
        words[10 + 5 * k : 11 + 5 * k] = [["zzz"], [], [near[10 + 5 * k], "zzz"]][k % 3]
        rows.append((600 + k, f"{prose(700 + k, 40)} {' '.join(words)} {prose(800 + k, 40)}", "a"))
    found = window_dedup.near_duplicate_passages(make_docs(rows)).collect()
    got = defaultdict(set)
    for r in found:
        got[r.doc_id].update(range(r.first_word, r.end_word))
    for i, words in covered(rows, 50).items():
        assert words <= got[i]
    assert set(range(600, 612)) <= set(got) and not {403, 3, 4, 5, 6} & set(got)
    assert all(len(got[i] & set(range(40, 119))) >= 50 for i in range(600, 612))
    assert window_dedup.near_duplicate_passages(make_docs([])).count() == 0


def signature_rows(texts):
    """(key, units, text number, place) of all signatures, by the functions of the operator but without Spark."""
    limits = window_dedup.WindowLimits()
    rows = defaultdict(list)
    for i, text in enumerate(texts):
        h, found = next((h, f) for _, h, f in W.word_slices(pa.array([text]), 1 << 20))
        if len(h) < limits.min_words:
            continue
        grams = np.maximum(W.window_hashes(h, limits.shingle).astype(np.uint32), 1)
        n = len(grams)
        padded = np.concatenate([np.zeros(limits.width - 1, np.uint32), grams, np.zeros(limits.width - 1, np.uint32)])
        for values in window_dedup._signatures(h, limits):
            for c in window_dedup.compact_windows(values, np.zeros(n, int), np.full(n, n), limits.width)[1]:
                rows[int(values[c])].append((padded[c : c + 2 * limits.width - 1], i, int(c)))
    return rows


def brute_windows(texts):
    """Words of each text that lie in runs similar to those of any other place of the same signature."""
    limits = window_dedup.WindowLimits()
    need, out = int(np.ceil(2 * limits.width * 0.8 / 1.8 - 1e-9)), defaultdict(set)

    def shared(a, b):
        edge = np.pad(b, 2)
        return np.any([a == edge[s : s + len(a)] for s in range(5)], axis=0) & (a != 0)

    def runs(flags):
        good = [k for k in range(limits.width) if flags[k : k + limits.width].sum() >= need]
        return (good[0], good[-1] + limits.width + limits.shingle - 1) if good else None

    for places in signature_rows(texts).values():
        for x, (a, i, c) in enumerate(places):
            for b, j, d in places[:x]:
                one, two = runs(shared(a, b)), runs(shared(b, a))
                if one and two:
                    for text, at, (first, end) in ((i, c, one), (j, d, two)):
                        out[text].update(range(at - limits.width + 1 + first, at - limits.width + 1 + end))
    return out


def excerpts(n, low, high):
    """Documents that quote a random part of one text of 150 words, one word of it substituted."""
    rng, text, out = random.Random(n), prose(83, 150).split(), []
    for k in range(n):
        size = rng.randint(low, high)
        at = rng.randint(0, 150 - size)
        part = text[at : at + size]
        part[rng.randrange(size)] = f"zz{k}"
        out.append(f"{prose(2000 + k, 25)} {' '.join(part)} {prose(3000 + k, 25)}")
    return out


def test_window_dedup_of_overlapping_excerpts(make_docs, monkeypatch):
    """Near copies that are no sorted neighbours of a signature, also with signatures compared block by block."""
    texts = excerpts(120, 52, 59)
    want = brute_windows(texts)
    assert len(want) > 60
    for hot in (window_dedup.HOT, 10):
        monkeypatch.setattr(window_dedup, "HOT", hot)
        monkeypatch.setattr(window_dedup, "BLOCK", 16)
        got = defaultdict(set)
        for r in window_dedup.near_duplicate_passages(make_docs([(k, t, "a") for k, t in enumerate(texts)])).collect():
            got[r.doc_id].update(range(r.first_word, r.end_word))
            assert r.other_doc_id != r.doc_id
        assert dict(got) == dict(want)


def test_copies_of_a_text_are_whole_spans(make_docs):
    rows = [(1, prose(1, 60), "a"), (2, prose(1, 60), "a"), (3, prose(2, 49), "a"), (4, prose(2, 49), "a"), (5, prose(3, 70), "a"), (5, None, "a"), (6, None, "a")]
    found = window_dedup.near_duplicate_passages(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.other_doc_id) for r in found) == [(1, 1), (2, 1)]
    assert all(r.first_word <= 0 and r.end_word >= 60 for r in found)


def test_extents_equal_all_pairs():
    """Rows left out by their bounds or because they reached them change nothing."""
    rng, runs = np.random.default_rng(4), Passages.Runs(6, 5, 1, 1)
    for size in (3, 40, 90):
        base = rng.integers(1, 9, (3, 11))
        units = np.where(rng.random((size, 11)) < 0.2, rng.integers(0, 30, (size, 11)), base[rng.integers(0, 3, size)]).astype(np.uint32)
        units = np.unique(units, axis=0)
        group, ids = np.sort(rng.integers(0, 2, len(units))), rng.permutation(len(units))
        twice = rng.random(len(units)) < 0.1
        got = Passages.extents(units, group, ids, runs, twice, paired=5)
        want = Passages.Extents(units, ids, runs)
        pairs = [(i, j) for i in range(len(units)) for j in range(i + 1) if group[i] == group[j] and (i != j or twice[i])]
        want.compare(*np.array(pairs).T)
        assert (got.first == want.first).all() and (got.end == want.end).all() and ((got.end > 0) == (want.end > 0)).all()
        assert all(got.other[want.end > 0] < len(units))


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(150):
        sizes, width = rng.integers(0, 30, 5), int(rng.integers(2, 8))
        values = rng.integers(1, 40, sizes.sum()).astype(np.uint64)
        start, end = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.cumsum(sizes), sizes)
        want = []
        for c in range(len(values)):
            left = right = c
            while left > start[c] and values[left - 1] > values[c]:
                left -= 1
            while right < end[c] - 1 and values[right + 1] >= values[c]:
                right += 1
            if right - left + 1 >= width:
                want.append((left, c, right))
        assert sorted(zip(*(x.tolist() for x in window_dedup.compact_windows(values, start, end, width)))) == sorted(want)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (None, 3), (2, 1)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(200)}}


def test_pipeline(spark, make_docs, odd_rows, tmp_path):
    items = spark.createDataFrame([(1, prose(50, 40))], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(500 + k, prose(900 + k, 80), "ab"[k % 2]) for k in range(40)]
    leaked = (600, prose(1000, 60) + " " + prose(50, 40), "a")
    make_docs([*odd_rows, *clean, *clean[:5], leaked]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    # Clean documents stay until the mix, which may leave some out; short, copied and leaked ones go.
    assert not ids & {600, 3, 4, 5, 6, 10, 11} and len(ids & {i for i, _, _ in clean}) >= 30
    docs, at = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] and docs.count() == len(rows)
    assert Counter(r.shard for r in rows).most_common()[0][1] - min(Counter(r.shard for r in rows).values()) <= 1


def test_pipeline_on_an_empty_table(spark, make_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
