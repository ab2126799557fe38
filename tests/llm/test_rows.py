"""URL reputation, mixing and sharding: defined results, exact laws and SQL twins."""

import os
import zlib

import pytest

import __spark_entry__ as entry
import check
from flowsentry.llm import mixing, sharding, url_reputation
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
@pytest.mark.parametrize("name", ["op1_url_reputation", "op2_quality_rules", "op6_mixing", "op8_sharding", "op11_merkle_manifest"])
def test_equals_sql(spark, name):
    verdict = check.compare(spark, check.database(FOLDER), FOLDER, name)
    assert verdict.startswith("ok"), verdict


def test_queries_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def judged(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in urls], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame(list(outcomes), "page_id long, bad int")
    return url_reputation.judge(pages, labels)


def test_url_parts_and_rules(spark):
    urls = [
        (1, "http://WWW.Example.com/en/a?b#c"), (2, "http://example.com/en/"), (3, "http://a.example.com/de/x"),
        (4, "https://sub.host.net/es/1"), (5, "https://host.net?x=1"), (6, "https://host.com"), (7, None), (8, "no scheme/x"),
        (9, "a://b://c/d"), (10, "ftp://É.ORG/ü#x"), (None, "http://net/fr/"), (2, "http://example.com/en/"),
    ]
    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged(spark, urls).collect()}
    assert rows == {
        (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        (2, "example.com", "/en/", "example.com/en/", "block"),
        (3, "a.example.com", "/de/x", "com/", "allow"),
        (4, "sub.host.net", "/es/1", "net/es/", "block"),
        (5, "host.net", "", None, "allow"),
        (6, "host.com", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "", "", None, "allow"),
        (9, "b:", "//c/d", None, "allow"),
        (10, "É.org", "/ü", None, "allow"),
        (None, "net", "/fr/", "net/fr/", "block"),
    }
    assert judged(spark, urls).count() == len(urls)
    assert judged(spark, []).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    urls, outcomes = [], []

    def add(host, bad, n):
        for k in range(n):
            urls.append((len(urls), f"http://{host}/p{k}"))
            outcomes.append((len(outcomes), int(k < bad)))

    add("bad.spam.org", 60, 70)
    add("fresh.spam.org", 0, 1)
    add("fine.good.org", 2, 90)
    add("rare.good.org", 1, 1)
    for k in range(30):
        add(f"h{k}.other{k}.org", k % 3 == 0, 12)
    outcomes.append((0, None))
    outcomes.append((10_000, 1))
    urls.append((20_000, "http://unseen.spam.org/"))
    got = {r.host: (r.verdict, r.host_bad_share, r.bound) for r in judged(spark, urls, outcomes).collect()}
    assert got["bad.spam.org"][0] == "block" and got["fine.good.org"][0] == "allow" == got["rare.good.org"][0]
    assert got["rare.good.org"][1] < 0.5 < got["bad.spam.org"][1] < 60 / 70 + 0.05
    # Without outcomes of its own a host has the share of its domain.
    assert got["unseen.spam.org"][1] > got["rare.good.org"][1]
    assert all(bound <= share for _, share, bound in got.values())


def test_one_bad_label_blocks_nobody_else(spark):
    urls = [(k, f"http://{h}/x") for k, h in enumerate(["a.net", "b.net", "x.a.net", "c.org", "d.co.uk"])] + [(50, None)]
    got = {r.host: r.verdict for r in judged(spark, urls, [(0, 1)]).collect()}
    assert [h for h, v in got.items() if v == "block" and h != "a.net"] == []


def test_suffix_and_domain(spark):
    from pyspark.sql import functions as F

    hosts = ["a.b.co.uk", "b.co.uk", "x.y.org", "y.org", "org", "", "10.0.0.1:80", "u@x.y.org:8080"]
    suffix, domain = url_reputation.levels_of(F.col("h"))
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", suffix.alias("s"), domain.alias("d")).collect()
    assert {r.h: (r.s, r.d) for r in rows} == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "x.y.org": ("org", "y.org"), "y.org": ("org", "y.org"),
        "org": ("org", "org"), "": ("", ""), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "u@x.y.org:8080": ("org", "y.org"),
    }


def brute_targets(sizes, mix):
    weights = [mix.weights[i % 3] for i in range(len(sizes))]
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), mix.total * sum(sizes)
    while free:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        full = {i for i in free if share[i] > 2 * sizes[i]}
        for i in full or free:
            targets[i] = 2.0 * sizes[i] if full else share[i]
        if not full:
            break
        left -= sum(2 * sizes[i] for i in full)
        free -= full
    return targets


@pytest.mark.parametrize("sizes", [[10, 1000, 50, 3], [0, 0, 7], [5], [], [100, 100, 100, 100, 1, 900]])
def test_water_filling(sizes):
    mix = mixing.Mix()
    assert mixing.water_fill(sizes, mix) == pytest.approx(brute_targets(sizes, mix))


def test_quotas_by_highest_quotients():
    # Sainte-Lague of 53 000, 24 000 and 23 000 votes for 7 seats.
    assert mixing.quotas([53000.0, 24000.0, 23000.0], [9, 9, 9], 7) == [3, 2, 2]
    assert mixing.quotas([53000.0, 24000.0, 23000.0], [2, 9, 9], 7) == [2, 3, 2]
    assert mixing.quotas([5.0, 5.0], [9, 9], 1) == [1, 0]
    assert mixing.quotas([0.0], [0], 3) == [0]


def test_mix_on_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, *((100 + k, prose(k, 37 + k), "abc"[k % 3]) for k in range(90))]
    docs = make_docs(rows)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= max(64, 0.02 * target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))
    assert mixing.mix_documents(make_docs([])).count() == 0


def test_mixed_documents_hold_the_words_taken(make_docs, odd_rows):
    rows = [*odd_rows[6:], *((100 + k, prose(k, 37 + k), "abc"[k % 3]) for k in range(60))]
    docs = make_docs(rows)
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_documents(docs).collect()}
    mixed = mixing.mixed_documents(docs, length_col="n_chars")
    assert mixed.columns == docs.columns
    words, whole = {}, {i: t for i, t, _ in rows}
    for r in mixed.collect():
        n = len(r.text.split())
        words[r.doc_id] = words.get(r.doc_id, 0) + n
        assert r.n_chars == len(r.text) and r.key == 1 and r.doc == "x"
        assert r.text == whole[r.doc_id] or r.text in " ".join(whole[r.doc_id].split())
    assert words == {i: t for i, (_, t) in taken.items() if t}
    assert mixing.mixed_documents(make_docs([])).count() == 0


@pytest.mark.parametrize("cell_rows", [1000, 3])
def test_shards(make_docs, odd_rows, monkeypatch, cell_rows):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(sharding, "CELL_GROUP", 4)
    rows = [*odd_rows, *((100 + k, prose(k, 5), "a" if k % 3 else f"s{k % 5}") for k in range(150))]
    got = sharding.shard(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got)
    assert sizes == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    source = {i: s for i, _, s in rows[len(odd_rows) :]}
    plain = sharding.shard(make_docs(rows[len(odd_rows) :])).collect()
    for name in ("a", "s0"):
        n = [sum(source[r.doc_id] == name for r in plain if r.shard == s) for s in range(8)]
        assert max(n) - min(n) <= 4  # every shard has the mixture
    again = sharding.shard(make_docs(rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard(make_docs([])).count() == 0
