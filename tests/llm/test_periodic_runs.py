"""Periodic runs against a definition that tries every interval and period."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import periodic_runs as module
from weftgraph.llm.common import documents
from weftgraph.llm.periodic_runs import digests, find_runs, periodic_runs, with_cycles, z_function


def brute(words):
    """Every maximal stretch of every period, kept with its smallest one."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def test_z_function():
    x = [1, 1, 2, 1, 1, 2, 1, 1, 3]
    assert z_function(x) == [9, 1, 0, 5, 1, 0, 2, 1, 0]
    assert z_function([]) == []


BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=60), BLOCKS.map(lambda bs: [w for b, k in bs for w in b * k])), max_size=4))
def test_runs_equal_brute_force(texts):
    assert find_runs(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize(("rounds", "many", "cut"), [(1, 0, 5), (2, 1, 1000), (24, 64, 3), (3, 100, 7)])
def test_every_way_through_the_search(monkeypatch, rounds, many, cut):
    """The Z-function and the single comparisons, in slices of any size."""
    for name, value in (("ROUNDS", rounds), ("MANY", many), ("SLICE", cut)):
        monkeypatch.setattr(module, name, value)
    draw = random.Random(rounds)
    for _ in range(150):
        text = []
        while len(text) < 120:
            block = [draw.randrange(3) for _ in range(draw.randrange(1, 12))]
            text += block * draw.randrange(1, 8)
        assert find_runs([text, text[3:], text[:50]]) == [brute(text), brute(text[3:]), brute(text[:50])]


def test_long_texts_of_few_words():
    """Linear-time ways out: one word throughout, a Fibonacci word, a long period, many near periods."""
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    base = np.random.default_rng(5).integers(0, 1000, 600).tolist()
    near = ([0] * 40 + [1]) * 50 + [2] + ([0] * 40 + [3]) * 9
    for text in ([7] * 4000, b, base * 7, near):
        assert find_runs([text])[0] == brute(text)


def test_one_word_throughout_takes_no_quadratic_time():
    assert find_runs([[1] * 300_000]) == [[(0, 300_000, 1)]]


def cycled(doc_id, text):
    """The words that the query looks at, by its definition."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = cycled(doc_id, text)
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines.encode()), sha(kept))


def query(docs):
    return Counter(tuple(r) for r in digests(periodic_runs(with_cycles(docs))).collect())


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "go " * 6), (6, "go " * 5), (7, "a b " * 4 + "a"), (7, "a b " * 4 + "a"), (None, "x y z " * 9),
    (8, "a\tb\nc\x0bd\x0ce\rf " * 5), (9, "a b c " * 4), (-4, "x " * 2000), (10, "p q p q p q p q r r r r r r p q p q p q p q"), (11, "é\x1cü " * 8), (12, "w " * 7 + "v " * 7),
    *[(100 + i, f"the {i} quick brown fox jumps over the lazy dog and runs away again " * 3) for i in range(60)],
]


def test_odd_rows(docs_of):
    assert query(docs_of(ODD)) == Counter(expected(i, t) for i, t in ODD)


def test_given_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    assert query(docs) == Counter(expected(i, t) for i, t in (tuple(r) for r in docs.collect()))


def test_texts_are_found_alike_however_many_are_searched_together(docs_of):
    one, all_ = (periodic_runs(docs_of(ODD), together=n).collect() for n in (1, 10**6))
    assert Counter(map(str, one)) == Counter(map(str, all_))


def test_empty_table(spark):
    assert query(spark.createDataFrame([], "doc_id long, text string")) == Counter()


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError, match="four periods"):
        find_runs([[1]], exponent=3)
