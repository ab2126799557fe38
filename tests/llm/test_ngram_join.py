"""The n-gram join against all pairs of sets compared one by one."""

import random
import re

import pytest

from flowsentry.llm import ngram_join as J
from tests.llm.conftest import WORDS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if len(words) < 3:
        return {" ".join(words)} if words else set()
    return {" ".join(words[k : k + 3]) for k in range(len(words) - 2)}


def expected(rows, percent=90):
    sets = [grams(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (own, _, _) in enumerate(rows):
        r = root(i)
        known = [x for x in (least.get(r), own) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((own, len(sets[i]), least[root(i)]) for i, (own, _, _) in enumerate(rows)), key=repr)


def actual(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def edited(rng, text, share):
    words = text.split()
    for k in rng.sample(range(len(words)), int(share * len(words))):
        words[k] = rng.choice(WORDS) + str(rng.random())
    return " ".join(words)


def families(seed, sizes, share):
    """Near copies of one text each, with up to this share of words replaced."""
    rng, rows = random.Random(seed), []
    for f, size in enumerate(sizes):
        base = prose(seed * 100 + f, 120)
        rows += [(len(rows) + 1000 * f, edited(rng, base, rng.random() * share), None) for _ in range(size)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("paired,small", [(64, J.SMALL), (3, 2)])
def test_equals_all_pairs(spark, make_docs, odd_rows, monkeypatch, paired, small):
    monkeypatch.setattr(J, "PAIRED", paired)  # also by the way of large buckets
    monkeypatch.setattr(J, "SMALL", small)
    common = prose(77, 40)
    rows = odd_rows + families(3, [40, 12, 2, 2], 0.05) + [(9000 + k, common + " " + prose(500 + k, 60), None) for k in range(40)]
    rows += [(9100, "One two", None), (9101, "one TWO", None), (9102, "one two three", None), (9103, "Word", None), (9104, "two", None)]
    assert actual(J.similar_documents(make_docs(rows))) == expected(rows)


def test_a_family_without_a_centre(spark, make_docs, monkeypatch):
    monkeypatch.setattr(J, "PAIRED", 4)
    rng, base = random.Random(4), prose(5, 120)
    rows = [(k, edited(rng, base, (1 + k % 2) / 120), None) for k in range(60)]  # most of the later half is similar to none
    got = actual(J.similar_documents(make_docs(rows), orders=3))
    assert got == expected(rows)
    assert len({c for _, _, c in got}) > 1


def test_a_family_of_cut_copies(spark, make_docs, monkeypatch):
    monkeypatch.setattr(J, "PAIRED", 4)
    rng, words, rows = random.Random(6), prose(15, 120).split(), []
    for k in range(60):
        at, n = rng.randrange(100), rng.randrange(2, 16)
        text = " ".join(words[:at] + words[at + n :])
        rows.append((k, edited(rng, text, 1 / 100) if k % 3 == 0 else text, None))
    rng.shuffle(rows)
    got = actual(J.similar_documents(make_docs(rows)))
    assert got == expected(rows)


def test_prefix_length():
    for percent in (80, 90):
        for size in range(1, 300):
            least = -(-percent * size // 100)
            assert J.prefix_length(size, percent) + least - 1 == size


def test_empty_table(spark, make_docs):
    assert J.similar_documents(make_docs([])).count() == 0
