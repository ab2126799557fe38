"""Token alignment against whole texts encoded one by one and counted in plain dictionaries."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from flowsentry.llm import token_alignment as A
from tests.llm.conftest import prose

FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def encoders():
    return A.Encoders(*(A.file_of(f) for f in FILES))


def plain(encoders, text):
    """Ids of both tokenizers over the whole text, groups and links; None where the tokens do not spell it."""
    if not text:
        return None
    a = encoders.a.encode(" " + text, add_special_tokens=False).ids
    b = encoders.b.encode(text)
    left, right = [encoders.a_bytes[i] for i in a], [encoders.b_bytes[i] for i in b]
    if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return None
    groups, i, j, x, y, k, m = [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            x += len(left[i])
            i += 1
        else:
            y += len(right[j])
            j += 1
        if x == y:
            groups.append((a[k:i], b[m:j]))
            k, m = i, j
    links = Counter((p, q) for g, h in groups for p in g for q in h)
    return len(a), len(b), groups, links


def expected(encoders, rows):
    found = [(i, plain(encoders, t)) for i, t, _ in rows]
    count = Counter(pair for _, f in found if f for pair in f[3])
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        top = sum(t for p, t in links.items() if count[p] == best[p[0]])
        out.append((i, n_a, n_b, len(groups), sum(links.values()), top, sum(count[p] * t for p, t in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    (20, "two  spaces,\ttabs \n new lines \n\n  end ", None), (21, " leading", None), (22, "a▁mark", None), (23, "<|endoftext|> <s> </s> <0x41>", None),
    (24, "l'été déjà çà naïve Straße ÄÖÜ", None), (25, "日本語のテキスト 中文 字", None), (26, "🙂 🙃 no break​space", None), (27, " ", None), (28, "\n", None),
    (29, "x y\x00z \x7f", None), (30, "aé bß cà  d Â e", None), (31, "don't can't 'll 123 4567 3.14", None),
]


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [A.SMALL, 3])
def test_equals_whole_texts(spark, make_docs, odd_rows, encoders, small):
    rows = odd_rows + ODD + [(100 + k, prose(k, 80), None) for k in range(20)]
    assert rows_of(A.align(make_docs(rows), *FILES, small=small)) == expected(encoders, rows)


def test_long_groups_count_ids_first(monkeypatch):
    monkeypatch.setattr(A, "WIDE", 2)
    size = np.array([0, 1, 2, 4, 2, 2])
    groups = A.Groups.find(np.array([1, 1, 2, 4]), np.array([3, 4]), size, size, 6)
    pairs, times, group = groups.links(10)
    assert dict(zip(pairs.tolist(), times.tolist())) == {13: 2, 23: 1, 44: 1} and group.tolist() == [0, 0, 1]


def test_empty_table(spark, make_docs):
    assert A.align(make_docs([]), *FILES).count() == 0
