"""Quality rules, token counts and SimHash against brute force."""

import re
from collections import Counter

import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowsentry.llm import quality_rules, simhash_dedup, token_counts
from flowsentry.llm.queries import TOKENIZER
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words, seen, lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)

    def covered(size):
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        often = Counter(grams)
        return len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(size)})

    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": lines,
        "n_repeat_words": covered(3),
        "covered_words": covered(8),
    }


def longest_repeat(words):
    best = 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= 8 else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é\t", max_size=120), max_size=6))
def test_quality_counts(texts):
    got = quality_rules.judged(pa.array([*texts, None], pa.string()), quality_rules.QualityLimits())
    for i, text in enumerate([*texts, None]):
        want = base_counts(text)
        assert {k: int(got[k][i]) for k in want} == want
        assert int(got["longest_repeat"][i]) == longest_repeat(WORD.findall(text or ""))
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert bool(got["base_failed"][i]) == failed and not (failed and got["kept"][i])


def test_maximal_repeats_of_a_known_text():
    a, b = prose(1, 12).split(), prose(2, 9).split()
    words = a + ["x"] + b + ["y"] + a + ["z"] + b + ["end"] + a[2:]
    got = quality_rules.judged(pa.array([" ".join(words)]), quality_rules.QualityLimits())
    # a twice; a[2:] three times, left-maximal since other words come before it; b twice.
    assert int(got["n_repeats"][0]) == 3 and int(got["longest_repeat"][0]) == 12


def test_quality_on_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(odd_rows)
    assert sorted((r.doc_id or -1, r.n_words) for r in rows) == sorted((i or -1, base_counts(t)["n_words"]) for i, t, _ in odd_rows)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows) > 0
    assert quality_rules.judge(make_docs([])).count() == 0 == quality_rules.keep_good(make_docs([])).count()


def test_long_repeat_is_rejected(make_docs):
    text = prose(4, 2000) + "\n" + prose(5, 450) + "\n" + prose(6, 2000) + "\n" + prose(5, 450)
    row = quality_rules.judge(make_docs([(1, text, "a"), (2, prose(4, 2000), "a")])).orderBy("doc_id").collect()
    assert row[0].longest_repeat == 450 and not row[0].base_failed and not row[0].kept and row[1].kept


def test_texts_with_some_repeats_are_kept(make_docs):
    # 200 words twice among 600 others: 40 % lie in repeats, the longest of 200 words.
    repeated = prose(5, 200) + "\n" + prose(4, 600) + "\n" + prose(5, 200)
    row = quality_rules.judge(make_docs([(1, repeated, "a")])).first()
    assert row.covered_words >= 400 and row.longest_repeat >= 200 and not row.base_failed and row.kept


PIECES = ["a", "be", "é", "ß", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\x85", "'s", "'", "12", ".", "<|endoftext|>", "日", "\x1c", "\x0b", "🙂"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), max_size=5))
def test_token_counts_equal_the_library(texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    n_bytes, n_tokens = token_counts.counted(pa.array([*texts, None], pa.string()), tokenizer)
    assert n_bytes.tolist() == [*(len(t.encode()) for t in texts), 0]
    assert n_tokens.tolist() == [*(len(tokenizer.encode(t, add_special_tokens=False)) for t in texts), 0]


def test_token_counts_across_slices(monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 64)
    monkeypatch.setattr(token_counts, "BATCH", 32)
    tokenizer, texts = Tokenizer.from_file(TOKENIZER), [prose(k, 40 * k) for k in range(5)]
    _, n_tokens = token_counts.counted(pa.array(texts), tokenizer)
    assert n_tokens.tolist() == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_token_counts_on_odd_rows(make_docs, odd_rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted((i or -1, len(t.encode()) if t else 0, len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, _ in odd_rows)
    rows = token_counts.count_tokens(make_docs(odd_rows), TOKENIZER).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.count_tokens(make_docs([]), TOKENIZER).count() == 0


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum((2 * n > len(grams)) << b for b, n in enumerate(ones))


def brute_components(rows):
    """rows (id, fingerprint) to the smallest id reachable by links of two bits or fewer."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(prints):
        for g in prints[i + 1 :]:
            if bin(f ^ g).count("1") <= 2:
                root[find(f)] = find(g)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in rows]


def test_simhash_on_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, *((20 + k, f"W{k % 3} b c", "s") for k in range(6))]
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])
    docs = make_docs(rows)
    got = [tuple(r) for r in simhash_dedup.link(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(str(i) for i in ids) == sorted(str(c) for c in {c for _, _, c in want})
    assert simhash_dedup.link(make_docs([])).count() == 0 == simhash_dedup.keep_one(make_docs([])).count()


def test_links_of_dense_clusters(spark):
    """Buckets far beyond the pairing limit: clusters around two centres, and a chain."""
    import random

    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = set()
    for centre in (0x0123456789ABCDEF, 0xF0F0F0F00F0F0F0F):
        for _ in range(120):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))))
        for _ in range(60):  # share one segment with the centre
            prints.add(centre ^ (sum(1 << b for b in rng.sample(range(32), rng.randint(1, 6)))))
    step = 0xFFFFFFFF00000000
    for k in range(12):
        prints.add(step)
        step ^= 1 << (5 * k)
    rows = list(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(signed(f),) for _, f in rows], "_fp long")
    found = {r.node: r.component for r in simhash_dedup.components(simhash_dedup.links(frame)).collect()}
    groups = {}
    for f in prints:
        groups.setdefault(found.get(signed(f), signed(f)), set()).add(f)
    want = {}
    for _, f, c in brute_components(rows):
        want.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keys_of_many_fingerprints_are_not_broadcast(spark, monkeypatch):
    """Each fingerprint has 66 keys, which Spark sizes by the fingerprints' file."""
    plans, plain = [], simhash_dedup.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    prints = plain(spark.createDataFrame([(k << 20 | k % 3,) for k in range(50)], "_fp long"), "prints")
    monkeypatch.setattr(simhash_dedup, "written", watched)
    plans.append(simhash_dedup.links(prints)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
