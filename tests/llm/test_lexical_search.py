"""Ranked search against scores of every document for every item."""

import math
import re
from collections import Counter

import pytest

from tests.oracle import check
from weftgraph.llm import lexical_search, queries
from weftgraph.llm.lexical_search import search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counts = [c for c in counts if c[2]]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, tf, n in counts:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores)[:top])]
    return Counter(out)


DOCS = [
    (1, None), (2, ""), (3, "?!"), (4, "The cat sat"), (5, "the CAT, the dog; the bird"), (5, "the CAT, the dog; the bird"), (None, "cat and dog"), (None, "cat"), (6, "Ärger ärger É é x1"),
    (7, "cat " * 5000), (8, "dog-dog_dog dog"), (-9, "bird bird\ncat\tCat"), *[(100 + i, f"the filler number {i} of the cat" + " and more" * (i % 7)) for i in range(40)],
]
ITEMS = [(1, "cat dog"), (1, "bird"), (2, None), (3, "..."), (None, "ärger x1"), (4, "É the the THE cat unknown"), (5, "of filler number 7"), (6, "zzz")]


def tables(spark, docs, items):
    full = [(i, t, "en", "src", 1, "x", 2, "y") for i, t in docs]
    rows = spark.createDataFrame(full, "doc_id long, text string, lang string, term string, n long, score string, rank int, part string").repartition(3)
    return rows, spark.createDataFrame([(i, t, 3, "z") for i, t in items], "item_id long, text string, tf int, row string").repartition(2)


@pytest.mark.parametrize(("part_docs", "broadcast", "top"), [(512, 200_000, 10), (3, 200_000, 3), (1, 0, 10)])
def test_equals_brute_force(spark, part_docs, broadcast, top):
    """With parts of any size, and with items' terms broadcast or shuffled."""
    docs, items = tables(spark, DOCS, ITEMS)
    got = Counter(tuple(r) for r in search(docs, items, top, part_docs=part_docs, broadcast=broadcast).collect())
    assert got == brute(DOCS, ITEMS, top)


def test_beyond_the_bound_nothing_is_broadcast(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [search(docs, items, broadcast=n)._jdf.queryExecution().executedPlan().toString() for n in (0, 10**6)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in plans[1]


def test_scores_are_summed_in_a_documents_part(spark):
    """One exchange deals the buckets, one the best of each task; none lies between a bucket and its documents' sums."""
    docs, items = tables(spark, DOCS, ITEMS)
    plan = search(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan


def test_empty_tables(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "plain", "a\x00b", "É-é_Ü", "x\x7fy 日本!語", "tab\tline\nA1b2"])
def test_terms_by_bytes(text):
    assert [t.decode() for t in terms_of(text.encode())] == terms(text)


def test_query_equals_its_sql(spark):
    check(spark, queries.op13_lexical_search, lexical_search.SQL, "/root/testdata/sf0.001")
