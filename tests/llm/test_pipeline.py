"""The pipeline's stages against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as cp
from tests.llm.test_near_dedup import brute_components, brute_print
from tests.llm.test_substring_dedup import brute
from weftgraph.llm import language_id, packing, quality

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def good(text):
    ws = words(text)
    n = len(ws)
    if n < 50:
        return False
    runs = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    repeated = {j + k for j, run in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if runs[run] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    chars = sum(map(len, ws))
    return (
        len(repeated) * 2 <= n
        and 2 <= chars / n <= 14
        and sum(text.count(s) for s in "#*$%&|<>") / chars <= 0.05
        and sum(w.lower() in quality.STOP_WORDS for w in ws) / n >= 0.03
        and (len(lines) - len(set(lines))) / len(lines) <= 0.3
    )


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r.text for i, r in rows.items() if good(r.text)}
    stage = cp.quality_rules(spark, docs, SF)
    assert stage.columns == docs.columns
    assert {r.doc_id: r.text for r in stage.collect()} == kept

    model = language_id.learn(language_id.training_rows(stage))
    for i in list(kept):
        name, score, bits = model.predict([kept[i].encode()])
        if score[0] < 0.5 or bits[0] > 5.5:
            del kept[i]
    stage = cp.language_filter(spark, stage, SF)
    assert stage.columns == docs.columns
    assert {r.doc_id: r.text for r in stage.collect()} == kept

    ids = sorted(kept)
    leads = brute_components([brute_print(kept[i]) for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if leads[k] == k}
    stage = cp.near_duplicates(spark, stage, SF)
    assert stage.columns == docs.columns
    assert {r.doc_id: r.text for r in stage.collect()} == kept

    removed = {i: (n, gone) for i, n, gone, _, _ in brute(list(kept.items()))}
    stage = cp.repeated_passages(spark, stage, SF)
    assert stage.columns == docs.columns
    done = stage.collect()
    assert len(done) == len(kept)
    for r in done:
        n, gone = removed[r.doc_id]
        assert n - gone - 3 * 2 * 50 <= len(r.text.encode()) <= n - gone
        assert r.lang == rows[r.doc_id].lang and r.source == rows[r.doc_id].source and r.n_chars == len(r.text)
        assert gone or r.text == kept[r.doc_id]

    pieces = cp.packed_sequences(spark, stage, SF).collect()
    encode = packing.public_byte_bpe()
    want = {r.doc_id: len(encode([r.text])[0]) + 1 for r in done}
    got = defaultdict(int)
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want


def test_run_goes_through_all_stages(spark):
    once = {(r.doc_id, r.doc_tokens) for r in cp.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert once == {(r.doc_id, r.doc_tokens) for r in docs.collect()}


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    long_enough = {r.doc_id for r in docs.collect() if len(words(r.text)) >= 50}
    kept = {r.doc_id for r in cp.language_filter(spark, cp.quality_rules(spark, docs, sf), sf).collect()}
    assert np.mean([i in kept for i, q in labels.items() if q and i in long_enough]) > 0.99
    assert np.mean([i in kept for i, q in labels.items() if not q]) < 0.1


def test_odd_rows_pass_all_stages(spark):
    text = "the cat and the dog of an old man who was not at home in the big town when it rained a lot on that day so they sat by the fire with a cup of tea and a book about birds that fly over the sea to a land far away from here in the cold north where few people live and the nights are long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text + " end", None, None, None), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            table = stage(spark, table, SF)
        table.collect()


def test_null_texts_become_empty_ones(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "kept", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.repeated_passages(spark, docs, SF).collect()}
    assert got == {1: ("", 0), 2: ("kept", 4)}
