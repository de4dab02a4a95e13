"""Prefix doubling against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.oracle import check
from weftgraph.llm import queries
from weftgraph.llm import substring_dedup as sd
from weftgraph.llm.common import saved

SF = "/root/testdata/sf0.001"


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                s = b[p : p + 50]
                first[s] = min(first.get(s, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        own = gone[: len(b)]
        spans = int((np.diff(np.concatenate([[0], own.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~own])
        out[(i, len(b), int(own.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def made(rng, n):
    letters = "abcdé "
    passages = ["".join(rng.choice(list(letters), k)) for k in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice(list(letters), rng.integers(0, 90))) for _ in range(4)]
        if rng.random() < 0.7:
            parts.insert(rng.integers(5), passages[rng.integers(5)])
        rows.append((int(rng.integers(0, n)), "".join(parts)))
    return rows


def test_against_brute_force(spark, docs_of):
    rng = np.random.default_rng(4)
    rows = made(rng, 150)
    rows += [(500 + i, rows[i][1]) for i in range(20)] + [(3, "x" * 400), (4, "x" * 60), (9, "x" * 49), (10, "ab" * 100), (11, "ba" * 90)]
    rows += [(1, None), (2, ""), (None, rows[5][1]), (None, None), (6, rows[6][1]), (6, rows[6][1])]
    assert got(sd.remove_repeats(docs_of(rows))) == brute(rows)


def test_small_batches_slices_and_ranges(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(6)
    rows = made(rng, 120) + [(700, "y" * 5000), (701, "z" + "y" * 300)]
    want = brute(rows)
    monkeypatch.setattr(sd, "BATCH", 700)
    monkeypatch.setattr(sd, "RANGE", 3000)
    assert got(sd.remove_repeats(docs_of(rows))) == want


def test_slices_do_not_matter(monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    starts = rng.random(5000) < 0.9
    starts[-49:] = False
    whole = sd._sampled(data, starts)
    monkeypatch.setattr(sd, "SLICE", 64)
    parts = sd._sampled(data, starts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    for p in np.flatnonzero(starts):  # every string holds a sampled gram
        assert ((whole[0] >= p) & (whole[0] <= p + sd.LENGTH - sd.GRAM)).any()


def test_empty_and_single(spark, docs_of):
    assert sd.remove_repeats(docs_of([])).count() == 0
    assert got(sd.remove_repeats(docs_of([(1, None)]))) == brute([(1, None)])


def test_query_on_real_rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op5_substring_dedup(spark, SF)) == brute(docs)
    check(spark, queries.op5_substring_dedup, queries.ORACLE_SQL["op5_substring_dedup"], SF)


def by_doubling(docs, length=sd.LENGTH):
    """(doc_id, position) of every `length`-byte string that also starts in a document with a smaller id: prefix doubling over ranks of all positions.

    The ranks of k bytes at a position and k further on are sorted as pairs and ranked anew,
    at growing offsets, the last one overlapping.
    """
    each = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")).filter(F.octet_length("b") >= length)
    at = F.explode(F.sequence(F.lit(1), F.octet_length("b"))).alias("at")
    ranks = each.select("doc_id", "b", at).select("doc_id", "at", F.conv(F.hex(F.substring("b", F.col("at"), F.lit(1))), 16, 10).cast("int").alias("rank"))
    k = 1
    while k < length:
        step = min(k, length - k)
        further = ranks.select("doc_id", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
        pairs = ranks.join(further, ["doc_id", "at"])
        order = pairs.select("rank", "then").distinct().sort("rank", "then").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("rank int, then int, new int")
        ranks = saved(pairs.join(order, ["rank", "then"]).select("doc_id", "at", F.col("new").alias("rank")), "ranks")
        k += step
    first = ranks.groupBy("rank").agg(F.min("doc_id").alias("first"))
    return ranks.join(first, "rank").filter("first < doc_id").select("doc_id", "at")


def test_same_as_prefix_doubling(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    gone = defaultdict(set)
    for r in by_doubling(docs).collect():
        gone[r.doc_id] |= set(range(r.at, r.at + sd.LENGTH))
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(docs).collect()}
    assert got == {i: len(gone[i]) for i in got} and any(got.values())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("substring_batches")]
