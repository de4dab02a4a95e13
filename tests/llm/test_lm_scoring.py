"""Language-model scores against brute force, and held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import lm_scoring as lm
from weftgraph.llm import queries

SF = "/root/testdata/sf0.01"
_A_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def toks(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_A_Z)) + ["\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute_base(rows):
    counts = Counter(t for i, text in rows if i is not None and not held(i) for t in toks(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        ts = toks(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out.append((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 5)))
    return Counter(out)


def seen(rows):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)


def test_base_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 2500)  # most words are rare and go through the join
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op10_lm_scoring(spark, SF).collect()
    assert seen(rows) == brute_base(docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.91


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    near, far, target = (rng.integers(0, 12, 3000) for _ in range(3))
    target = np.where(rng.random(3000) < 0.8, (near * 5 + 1) % 12, target)
    model = lm.LogBilinear(12, 8)
    model.fit(near, far, target, np.ones(3000), steps=400)
    table = 10.0 ** model.table().astype(float)
    assert np.allclose(table.sum(axis=2), 1, atol=1e-4)
    flat = np.bincount(target) / 3000
    assert np.log(table[near, far, target]).mean() > np.log(flat[target]).mean() + 0.3


def test_whole_vocabulary_sums_to_one(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lm, "OWN_WORDS", 8)
    monkeypatch.setattr(lm, "ENDINGS", 6)
    monkeypatch.setattr(lm, "CLASSES", 16)
    rows = [(i, "the cat sat on the mat and a bat " * (i % 3) + f"only{i} was here") for i in range(60)]
    docs = docs_of(rows)
    counts = lm.word_counts(docs)
    words = lm.vocabulary(counts)
    by_class = Counter()
    unknown = set()
    for r in counts.collect():
        w = bytes(r.word)
        if w == lm.END:
            continue
        c = words.class_of(w)
        by_class[c] += 10 ** float(words.inside(r.n, c)) if c >= words.own_words else 1
        unknown.add(c)
    for c in unknown:
        if c >= words.own_words:
            by_class[c] += 10 ** float(words.inside(0, c))
    assert all(abs(v - 1) < 1e-9 for v in by_class.values())


def test_edge_cases(spark, docs_of, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A a B"), (3, "A a B"), (None, "no id ÀB"), (6, "x"), (8, "long text " * 20000), (9, " \t")]
    monkeypatch.setattr(lm, "STEPS", 20)
    assert seen(lm.learn_and_score(docs_of(rows)).collect()) == brute_base(rows)
    monkeypatch.setattr(lm, "DICTIONARY", 1)
    monkeypatch.setattr(lm, "HELD", 2)
    assert seen(lm.learn_and_score(docs_of(rows)).collect()) == brute_base(rows)
    assert lm.learn_and_score(docs_of([])).count() == 0


def test_nothing_to_learn_from(spark, docs_of):
    only = [i for i in range(200) if held(i)][:3]
    got = lm.learn_and_score(docs_of([(i, "a b c") for i in only])).collect()
    assert [r.base_score for r in got] == pytest.approx([0.0] * 3) and {r.n_known for r in got} == {0}


def test_classes_grow_with_the_corpus():
    assert lm.class_counts(1000) == (lm.OWN_WORDS, lm.ENDINGS)
    assert sum(lm.class_counts(10**15)) <= lm.MAX_CLASSES
    for tokens in (10**11, 5 * 10**11):
        assert 0.9 < (sum(lm.class_counts(tokens)) + 2) ** 3 / tokens < 1.1


def trigrams(rows, words):
    expected = Counter()
    for i, text in rows:
        if i is not None and not held(i):
            c = [words.end_class] * 2 + [words.class_of(t.encode()) if t != "\n" else words.end_class for t in toks(text)]
            expected.update((c[j - 1] * words.classes + c[j - 2]) * words.classes + c[j] for j in range(2, len(c)))
    return expected


def test_rows_have_all_trigrams_with_their_counts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lm, "OWN_WORDS", 20)
    monkeypatch.setattr(lm, "ENDINGS", 10)
    monkeypatch.setattr(lm, "CLASSES", 32)
    monkeypatch.setattr(lm, "LOT", 70)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{j}{chr(97 + j % 26)}" for j in rng.integers(0, 60, n))) for i, n in enumerate([40] * 60 + [900])] + [(1001, "same words " * 300), (1002, None)]
    training = lm.training_rows(docs_of(rows))
    words = lm.vocabulary(lm.word_counts(training))
    found, slots = Counter(), set()
    for r in lm.trigram_rows(training, words).collect():
        near, far, target = (np.frombuffer(x, dtype=np.int16).astype(np.int64) for x in (r.near, r.far, r.target))
        weight = np.frombuffer(r.weight, dtype=np.uint8)
        assert len(near) == len(far) == len(target) == len(weight) == r.n and (weight <= lm.HEAVY).all()
        for k, n in zip(((near * words.classes + far) * words.classes + target).tolist(), weight.tolist(), strict=True):
            found[k] += n
        slots.add(r.slot)
    expected = trigrams(rows, words)
    assert found == expected
    assert slots == set(range(lm.SLOTS))
    seen = [k for first, last in lm.ROUNDS for k in range(first, last)]
    assert Counter(seen) == {k: 2 for k in range(lm.SLOTS)}  # two passes


def brute_scores(rows, words, counts, model):
    """Each token's probability by the model's formula, from its parameters alone."""
    total, distinct = Counter(), Counter()
    for w, n in counts.items():
        if w != "\n" and words.class_of(w.encode()) >= words.own_words:
            total[words.class_of(w.encode())] += n
            distinct[words.class_of(w.encode())] += 1
    context, target, bias = model.context.astype(float), model.target.astype(float), model.bias.astype(float)
    for i, text in rows:
        c = [words.end_class] * 2
        out = 0.0
        for t in toks(text):
            own = words.end_class if t == "\n" else words.class_of(t.encode())
            h = context[c[-1]] @ model.turn[0] + context[c[-2]] @ model.turn[1]
            z = target @ h + bias
            out += (z[own] - np.log(np.exp(z).sum())) / math.log(10)
            if words.own_words <= own < words.end_class:
                out += math.log10((counts[t] + 0.5) / (total[own] + 0.5 * (distinct[own] + 1)))
            c.append(own)
        yield i, out


@pytest.mark.parametrize("dictionary", [5, 100_000])  # words met by the join, and in the tasks
def test_scores_against_brute_force(spark, docs_of, monkeypatch, dictionary):
    monkeypatch.setattr(lm, "OWN_WORDS", 4)
    monkeypatch.setattr(lm, "ENDINGS", 3)
    monkeypatch.setattr(lm, "CLASSES", 9)
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    monkeypatch.setattr(lm, "STEPS", 60)
    monkeypatch.setattr(lm, "SLICE", 7)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{chr(97 + j % 5)}{j}" for j in rng.geometric(0.15, 30))) for i in range(40)] + [(50, None), (51, "never SEEN word-s"), (52, ""), (None, "a1 b2")]
    training = lm.training_rows(docs_of(rows))
    table = lm.word_counts(training)
    words = lm.vocabulary(table)
    model = lm.train(training, words)
    counts = Counter({bytes(r.word).decode(): r.n for r in table.collect()})
    got = {r.doc_id: r.score for r in lm.score(docs_of(rows), table, words, model).collect()}
    for i, want in brute_scores(rows, words, counts, model):
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_larger_corpus_has_more_classes_over_several_shards(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lm, "OWN_WORDS", 8)
    monkeypatch.setattr(lm, "ENDINGS", 6)
    monkeypatch.setattr(lm, "CLASSES", 16)  # as if the corpus were large
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(lm, "STEPS", 80)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{j}{chr(97 + j % 26)}" for j in rng.integers(0, 200, 40))) for i in range(300)]
    docs = docs_of(rows)
    words = lm.vocabulary(lm.word_counts(lm.training_rows(docs)))
    assert len(words.own) > lm.OWN_WORDS and words.classes > 16
    model = lm.train(lm.training_rows(docs), words)
    assert np.allclose((10.0 ** model.table().astype(float)).sum(axis=2), 1, atol=1e-4)
    assert seen(lm.learn_and_score(docs).collect()) == brute_base(rows)


@pytest.mark.parametrize(("shards", "fan"), [(1, 3), (3, 3), (20, 3), (100, 7)])
def test_models_of_many_shards_are_averaged_in_levels(spark, shards, fan):
    rng = np.random.default_rng(shards)
    states, weights = rng.normal(size=(shards, 5)).astype(np.float32), rng.integers(1, 9, shards).astype(float)
    kept = [i for i in range(shards) if i % 5 != 4]  # a shard without rows yields nothing
    rows = spark.createDataFrame([(i, float(weights[i]), states[i].tobytes()) for i in kept], "shard long, weight double, state binary")
    done = lm.averaged(rows, shards, fan).collect()
    assert len(done) <= fan
    got = np.average([np.frombuffer(r.state, dtype=np.float32) for r in done], axis=0, weights=[r.weight for r in done])
    assert got == pytest.approx(np.average(states[kept], axis=0, weights=weights[kept]), abs=1e-5)


def test_steps_follow_the_gradient():
    """What a step adds to the squares, and the way it moves, are the gradient of the contrastive likelihood, by differences."""
    classes, size = 6, 4
    rng = np.random.default_rng(4)
    near, far, target = (rng.integers(0, classes, 5).astype(np.int16) for _ in range(3))
    weights = np.array([1, 3, 2, 5, 1], dtype=np.uint8)
    shares = rng.dirichlet(np.ones(classes))
    noise = lm.Noise(shares)
    drawn = noise.draw(np.random.default_rng(9))
    model = lm.LogBilinear(classes, size)
    for p in model._params():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    model.outs[:, size + 1] = 0
    model.turns[:, size:] = 0
    before = [p.astype(float) for p in model._params()]

    def likelihood(context, outs, turns):
        h = np.concatenate([context[near], context[far]], axis=1) @ turns[:, :size]
        score = h @ outs[:, :size].T + outs[:, size] - np.log(lm.NOISE * shares)
        true = -np.log1p(np.exp(-score[np.arange(5), target]))
        false = -np.log1p(np.exp(score[:, drawn])).sum(axis=1)
        return float((weights / weights.sum()) @ (true + false))

    model.step(near, far, target, weights, noise, np.random.default_rng(9), 0.0)
    for k, (old, new, squares) in enumerate(zip(before, model._params(), model.squares, strict=True)):
        for at in np.ndindex(old.shape):
            if k and at[1] > size - (k == 2):
                continue  # columns of zeros
            moved = [[p.copy() for p in before] for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            slope = (likelihood(*moved[0]) - likelihood(*moved[1])) / 2e-5
            assert np.sign(new[at] - old[at]) * math.sqrt(squares[at]) == pytest.approx(slope, rel=2e-3, abs=2e-4), (k, at)
