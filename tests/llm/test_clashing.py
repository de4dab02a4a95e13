"""Columns of the caller's that have the names of results or of what operators use inside keep their values."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from weftgraph.llm import language_id, near_dedup, packing, quality, substring_dedup

TEXT = "the cat and the dog of an old man who was not at home in the big town when it rained a lot on that day so they sat by the fire with a cup of tea and a book about birds that fly over the sea to a land far away from here in the cold north where few people live and the nights are long"
OTHER = "on a hill above the bay there is a small house with a red door and from its windows one can see all of the ships that come in for the night or go out to the open sea and nobody knows who lives in it or why the lamp is lit each time that a storm is near and the wind is from the west"
RESULTS = (
    "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_stop_words base_failed broken_rules kept stop_ratio symbol_ratio lang_pred score bits_per_byte held_out "
    "fingerprint component_id root node print first n n_bytes n_removed n_spans kept_sha256 start length ids_crc32 doc_tokens sequence_id offset tier step_group size shard slot"
).split()
INSIDE = (
    "_row _words _lines _starts _runs _verdict _v v row rest _id _print _root _text _key _bucket _at _next _extra _edited _terms _hash _before _position key place home side cell a b m "
    "id rank place_ spans ranges copies rows label digest"
).split()
NAMES = [*RESULTS, *INSIDE]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, TEXT), (2, OTHER), (3, TEXT + " end"), (4, TEXT), (5, TEXT), (5, OTHER + " " + TEXT), (6, None), (7, ""), (None, OTHER)]
    full = [(i, t, "en", "src", 1, *[f"{name} {k}" for name in NAMES]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{n}` string' for n in NAMES)}").repartition(3)


def whole(rows, drop=()):
    return Counter(tuple(v for c, v in r.asDict().items() if c not in drop) for r in rows)


def subset(some, every):
    return not some - every


def test_operators_keep_columns(clashing):
    every = whole(clashing.collect())
    for kept in (
        quality.accepted(clashing),
        language_id.accepted(clashing, language_id.learn(language_id.training_rows(clashing))),
        near_dedup.representatives(clashing),
    ):
        assert kept.columns == clashing.columns
        rows = whole(kept.collect())
        assert rows and subset(rows, every)
    judged = quality.judge(clashing)
    other = [c for c in clashing.columns if c not in quality.RESULTS]
    assert judged.columns == [*other, *quality.RESULTS]
    assert whole(judged.select(*other).collect()) == whole(clashing.select(*other).collect())
    shorter = substring_dedup.without_repeats(clashing)
    assert shorter.columns == clashing.columns
    assert whole(shorter.collect(), ("text",)) == whole(clashing.collect(), ("text",))


def test_results_do_not_depend_on_other_columns(clashing):
    plain = clashing.select("doc_id", "text")
    for make in (near_dedup.cluster, substring_dedup.remove_repeats, packing.pack):
        drop = ("sequence_id", "offset", "start", "length", "ids_crc32", "tier", "step_group")
        assert whole(make(clashing).collect(), drop) == whole(make(plain).collect(), drop)


def test_stages_keep_columns(spark, clashing):
    docs, every = clashing, whole(clashing.collect(), ("text", "n_chars"))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == clashing.columns
        rows = whole(docs.collect(), ("text", "n_chars"))
        assert rows and subset(rows, every)
    assert cp.STAGES[-1][1](spark, docs, "").count() > 0
