"""Anchor points and components against brute force."""

import re
from collections import defaultdict

import numpy as np
import xxhash

from weftgraph.llm import common
from weftgraph.llm import near_dedup as nd

SF = "/root/testdata/sf0.001"


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least index reachable, over values within four bits."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def planted(rng, n_centers=12, n=400):
    centers = [int(x) for x in rng.integers(0, 2**63, n_centers)]
    out = []
    for _ in range(n):
        x = centers[rng.integers(n_centers)]
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return list(dict.fromkeys(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_links(spark, values):
    prints = spark.createDataFrame([(signed(v),) for v in values], "print long").repartition(3)
    rooted = {r.node: r.root for r in nd.components(nd.links(prints)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[rooted.get(signed(v), signed(v))].add(v)
    want = defaultdict(set)
    for v, c in zip(values, brute_components(values), strict=True):
        want[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_links_against_brute_force(spark):
    check_links(spark, planted(np.random.default_rng(1)))


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 10)
    check_links(spark, planted(np.random.default_rng(2), 2, 150))


def test_chain_of_links(spark):
    values, x = [], 0
    for b in range(0, 60, 3):
        values.append(x)
        x |= 7 << b
    check_links(spark, values)


def test_cluster_against_brute_force(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (5, "Only THREE words"), (4, "only three words"), (4, "only three words"), (None, "only three words"), (9, "word " * 5000)]
    base = " ".join(f"token{i}" for i in range(400))
    rows += [(20 + i, base + f" tail{i}" * (i % 3)) for i in range(12)]
    got = nd.cluster(docs_of(rows)).collect()
    assert len(got) == len(rows)
    order = [r for r in rows if r[0] is not None]
    order.sort()
    prints = [brute_print(t) for _, t in order]
    comp = brute_components(prints)
    want = {(i, f"{p:016x}"): order[c][0] for (i, _), p, c in zip(order, prints, comp, strict=True)}
    for r in got:
        if r.doc_id is not None:
            assert want[(r.doc_id, r.fingerprint)] == r.component_id
        else:
            assert r.component_id == 4
    assert nd.cluster(docs_of([])).count() == 0


def test_representatives(spark, docs_of):
    base = " ".join(f"token{i}" for i in range(400))
    rows = [(7, base), (3, base), (3, base), (5, "some other text of its own"), (5, "and one more under this id"), (None, base), (8, "")]
    kept = nd.representatives(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    got = sorted(((r.doc_id or -1), r.text) for r in kept.collect())
    assert got == sorted([(3, base), (5, rows[3][1]), (5, rows[4][1]), (-1, base), (8, "")])


def test_query_on_real_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [brute_print(docs[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute_components(prints), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in nd.cluster(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want


def test_joins_of_hot_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_PART", 5)
    monkeypatch.setattr(nd, "HOT", 10)
    check_links(spark, planted(np.random.default_rng(4), 5, 200))
    rows = spark.createDataFrame([(k, i) for k in range(8) for i in range(1 + 40 * (k == 3))], "k int, i int")
    labels = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 AS l").filter("k <> 5")
    got = common.labelled(rows, labels, "k", rows.count()).collect()
    assert sorted((r.k, r.i, r.l) for r in got) == sorted((r.k, r.i, r.k * 10) for r in rows.collect() if r.k != 5)
    got = common.labelled(rows, labels, "k", rows.count(), how="left").collect()
    assert sorted((r.k, r.i, r.l or 0) for r in got) == sorted((r.k, r.i, r.k * 10 * (r.k != 5)) for r in rows.collect())
