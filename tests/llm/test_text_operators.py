"""Quality rules, fingerprints, piece codec, sharding, packing and language ID against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import check
from weftgraph.llm import common, fingerprints, language_id, packing, piece_codec, quality, queries, sharding

SF = "/root/testdata/sf0.001"
LONG = "the word of a long text and " * 4000
ROWS = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "same text here"), (5, "same text here"), (None, "no id at all"), (6, " \n\t "), (7, "été ß 漢字 ▁ <0x0A> <|endoftext|>"), (8, LONG), (9, "x" * 3000)]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_quality_matches_its_sql(spark):
    check(spark, queries.op1_quality, queries.ORACLE_SQL["op1_quality"], SF)


def test_quality_edge_cases(spark, docs_of):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs_of(ROWS)).collect()}
    assert len(quality.judge(docs_of(ROWS)).collect()) == len(ROWS)
    for i, text in ROWS:
        ws = words(text)
        r = got[(i, len(ws))]
        runs = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        covered = {j + k for j, run in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if runs[run] > 1 for k in range(3)}
        assert r.n_repeat_words == len(covered)
        assert r.word_chars == sum(map(len, ws))
        assert r.base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
    assert quality.judge(docs_of([])).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.judge(docs).select("quality", "base_failed", "kept", "n_words").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.1


def brute_print(text):
    terms = set(words(text))
    out = []
    for k in range(fingerprints.WORDS_OF_BITS):
        votes = np.zeros(64)
        for t in terms:
            # Spark chains the hash of the number into the seed of the word's
            seed = xxhash.xxh64(int(k).to_bytes(4, "little"), seed=42).intdigest()
            h = xxhash.xxh64(t.encode(), seed=seed).intdigest()
            votes += np.array([1 if h >> b & 1 else -1 for b in range(64)]) * len(t)
        out.append(sum(1 << b for b in range(64) if votes[b] > 0))
    return "".join(f"{x:016x}" for x in out)


def test_fingerprints_against_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in ROWS if i != 3] + [(3, "a"), (3, "b c")] + [(100 + i, f"word{i} of some {i % 5} text " * (i % 4)) for i in range(40)]
    got = fingerprints.with_edits(docs_of(rows)).collect()
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    want = []
    for j, (i, t) in enumerate(order):
        t, after = t or "", order[(j + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = brute_print(t), brute_print(edited), brute_print(after)
        like = lambda x, y: 1 - bin(int(x, 16) ^ int(y, 16)).count("1") / 128
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    assert Counter(map(tuple, got)) == Counter(want)
    assert fingerprints.with_edits(docs_of([])).count() == 0
    one = fingerprints.with_edits(docs_of([(1, "alone in here")])).collect()
    assert one[0].near_next == 1.0


def test_buckets_do_not_change_fingerprints(spark, docs_of, monkeypatch):
    rows = [(i * i, f"text number {i} with words") for i in range(300)]
    once = set(map(tuple, fingerprints.with_edits(docs_of(rows)).collect()))
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", 7)
    assert set(map(tuple, fingerprints.with_edits(docs_of(rows)).collect())) == once


def test_within_radius_finds_all(spark, docs_of):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{k}" for k in range(400)], 300)) for _ in range(4)]
    rows = [(i, base[i % 4] + f" extra{i} " * (i % 3)) for i in range(60)]
    prints = fingerprints.fingerprint(docs_of(rows))
    known = sorted({r.fingerprint for r in prints.collect()})
    got = {(r.query, r.fingerprint, r.distance) for r in fingerprints.within_radius(prints, prints.filter("doc_id % 2 = 0"), 6).collect()}
    asked = {r.fingerprint for r in prints.filter("doc_id % 2 = 0").collect()}
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert got == {(a, b, far(a, b)) for a in asked for b in known if far(a, b) <= 6}
    assert len(got) > len(asked)


def test_within_radius_of_odd_inputs(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fingerprints, "CELL", 4)
    monkeypatch.setattr(common, "HOT_PART", 6)
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rng = np.random.default_rng(8)
    values = {0, (1 << 128) - 1}
    for center in [int.from_bytes(rng.bytes(16), "big") for _ in range(3)]:
        for _ in range(60):  # a group in which many share any two blocks
            values.add(center ^ sum(1 << int(b) for b in rng.choice(128, rng.integers(0, 4), replace=False)))
    rows = [([signed(v >> 64), signed(v & (1 << 64) - 1)], 1 + i % 3) for i, v in enumerate(sorted(values))]
    prints = spark.createDataFrame([*rows, (None, 5)], "simhash array<long>, copies int")
    copies = {f"{v:032x}": 1 + i % 3 for i, v in enumerate(sorted(values))}
    got = {(r.query, r.fingerprint, r.distance) for r in fingerprints.within_radius(prints, prints).collect()}
    assert got == {(a, b, far(a, b)) for a in copies for b in copies if far(a, b) <= 3}
    counted = {r.fingerprint: r.n_within for r in fingerprints.count_within(prints, prints).collect()}
    assert counted == {a: sum(n for b, n in copies.items() if far(a, b) <= 3) for a in copies}
    assert fingerprints.within_radius(prints.limit(0), prints).count() == 0 == fingerprints.within_radius(prints, prints.limit(0)).count()
    assert fingerprints.with_neighbours(docs_of([])).count() == 0


def test_fingerprint_query_counts_neighbours(spark):
    rows = queries.op2_fingerprints(spark, "/root/testdata/sf0.01").collect()
    prints = np.array([[int(r.fingerprint[:16], 16), int(r.fingerprint[16:], 16)] for r in rows], dtype=np.uint64)
    assert len(rows) == 1000
    for r, own in zip(rows, prints, strict=True):
        near = int((np.bitwise_count(prints ^ own).sum(axis=1) <= fingerprints.RADIUS).sum())
        assert r.n_within == (near if r.doc_id % 50 == 0 else None)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.public_pieces()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ▁abeéto<>0xA\n\tａ漢🙂thein-.,'=_\x00", max_size=40))
def test_pieces_equal_the_library(codec, library, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.both(text)[1] == library.decode(ids) == codec.decode(ids)


def test_pieces_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_pieces(spark, SF).collect():
        ids = library.encode(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_edge_cases(spark, docs_of, codec, library):
    got = Counter((r.doc_id, r.ids) for r in piece_codec.encode_documents(docs_of(ROWS)).collect())
    assert got == Counter((i, ",".join(map(str, library.encode(t or "")))) for i, t in ROWS)
    for text in ("a" * 5000, "=" * 3000, " " * 3000, "ab" * 4000, "\n" * 500 + " \n" * 50):
        assert codec.encode(text) == library.encode(text)
    assert piece_codec.encode_documents(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=25), st.integers(1, 6))
def test_minimax_capacity(sizes, shards):
    def needed(capacity):
        runs, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return 99
            if s > room:
                runs, room = runs + 1, capacity
            room -= s
        return runs

    capacity = sharding.minimax_capacity(sizes, shards)
    assert needed(capacity) <= shards
    assert capacity == 1 or needed(capacity - 1) > shards or capacity <= -(-sum(sizes) // shards)


def test_sharding(spark, docs_of, monkeypatch):
    rows = ROWS + [(50 + i, f"text {i % 37} " * (i % 9)) for i in range(200)]
    got = sharding.shard_by_bytes(docs_of(rows), 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    groups = defaultdict(int)
    for _, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    capacity = sharding.minimax_capacity([groups[d] for d in sorted(groups)], 4)
    shards, totals = defaultdict(list), defaultdict(int)
    for r in got:
        shards[r.shard].append(r.slot)
        totals[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(totals.values()) == capacity and set(shards) <= set(range(4))
    by_text = defaultdict(set)
    for r in got:
        by_text[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    monkeypatch.setattr(sharding, "STEP", 1)  # opens many nodes
    assert {(r.doc_id, r.size, r.shard) for r in sharding.shard_by_bytes(docs_of(rows), 4).collect()} == {(r.doc_id, r.size, r.shard) for r in got}
    assert sharding.shard_by_bytes(docs_of([])).count() == 0


def check_packing(rows, docs, window=2048):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in docs:
        want[(i, len(whole.encode(t or "", add_special_tokens=False).ids) + 1)] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert 0 < at <= window and not at & (at - 1)
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n * c for (_, n), c in want.items())
    return whole


def test_rows_of_one_text_and_id_are_numbered_in_several_tasks(docs_of):
    """Half of all rows are one id and text: slots have no gaps, and no window gathers them."""
    rows = [(7, "hot text")] * 300 + [(i, f"text {i % 50}") for i in range(300)]
    done = sharding.shard_by_bytes(docs_of(rows), 5)
    slots = {}
    for r in done.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == 600
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert "Window" not in done._jdf.queryExecution().executedPlan().toString()


def test_packing_edge_cases(spark, docs_of):
    rows = packing.pack(docs_of(ROWS)).collect()
    check_packing(rows, ROWS)
    assert packing.pack(docs_of([])).count() == 0


def test_packing_ids(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_packing(spark, SF).collect()
    whole = check_packing(rows, docs.items())
    ends = defaultdict(list)
    for r in rows:
        ids = whole.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        ends[r.doc_id].append((r.start, r.start + r.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_tails_are_packed_by_tier(spark):
    """Every sequence opens with a tail of its own tier, and its gap holds tails of shorter tiers."""
    rng = np.random.default_rng(7)
    done = []
    packer = packing.Packer(64, (8, 16, 32, 64), lambda row, tier: done.append((tier, [p.doc_tokens - p.start for p in row], [len(p.ids) for p in row])))
    lengths = [int(n) for n in rng.integers(1, 200, 400)]
    for i, n in enumerate(lengths):
        packer.add(i, np.full(n, i, dtype=np.uint32))
    packer.flush(last=False)
    assert packer.waiting < 64
    packer.flush(last=True)
    assert not packer.waiting and sum(sum(x) for _, _, x in done) == sum(lengths)
    filled = [(tier, sizes) for tier, _, sizes in done if sum(sizes) == tier]
    assert len(filled) >= len(done) - 6 and len({tier for tier, _ in filled}) > 2
    for tier, sizes in filled:
        assert (tier // 2 if tier > 8 else 0) < sizes[0] <= tier  # the tier's own
        assert all(n <= tier - sizes[0] for n in sizes[1:])  # fill the gap it leaves
    whole = [n % 64 for n in lengths if n % 64]
    assert sum(len(sizes) for _, sizes in filled) < 1.6 * (len(whole) + sum(n // 64 for n in lengths))  # few tails are cut


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([64, 128, 256, 512, 1024, 2048]), max_size=300), st.sampled_from([2048, 4096]))
def test_step_groups_are_balanced(sizes, tokens):
    groups = packing.step_groups(sizes, tokens)
    loads = Counter()
    for n, g in zip(sizes, groups, strict=True):
        loads[g] += n
    assert len(groups) == len(sizes) and sum(loads.values()) == sum(sizes)
    if len(loads) > 1:
        assert set(loads) == set(range(max(1, round(sum(sizes) / tokens))))
        assert max(loads.values()) - min(loads.values()) <= max(sizes)


def test_step_groups_of_the_query(spark):
    rows = queries.op6_packing(spark, "/root/testdata/sf0.01").collect()
    tokens, sequences = Counter(), defaultdict(set)
    for r in rows:
        tokens[r.step_group] += r.length
        sequences[r.step_group].add(r.sequence_id)
    by_task = defaultdict(list)
    for g, n in tokens.items():
        by_task[g >> 40].append((n, len(sequences[g])))
    want = packing.STEP_WINDOWS * packing.WINDOW
    for task in by_task.values():
        if len(task) > 3:
            assert all(abs(n - want) < 0.15 * want for n, _ in task)
            assert max(k for _, k in task) <= 2 * min(k for _, k in task)


def brute_bits(texts, text, order=language_id.ORDER):
    import math

    follow = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        b = b"\n" * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                follow[k][b[i - k : i]][b[i]] += 1
    total, b = 0.0, b"\n" * order + text
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = follow[k].get(b[i - k : i])
            if not c:
                continue
            if c[b[i]]:
                total -= math.log2(c[b[i]] / (sum(c.values()) + len(c)))
                break
            total -= math.log2(len(c) / (sum(c.values()) + len(c)))
        else:
            total += 8
    return total


def test_code_lengths_against_brute_force():
    rng = np.random.default_rng(3)
    texts = {l: [bytes(rng.choice(list(a), n).astype(np.uint8)) for n in (0, 5, 300)] for l, a in (("x", b"abc "), ("y", b"bcde\xc3"))}
    model = language_id.LanguageModel(texts)
    asked = [b"", b"a", b"abcabc dd\xff", texts["x"][2], texts["y"][2] + b"aa"]
    want = [[brute_bits(texts[l], t) for l in model.languages] for t in asked]
    assert np.allclose(model.code_lengths(asked), want, rtol=1e-5)
    big = language_id.BLOCK
    try:
        language_id.BLOCK = 7
        assert np.allclose(model.code_lengths(asked), want, rtol=1e-5)
    finally:
        language_id.BLOCK = big


def test_language_query_against_brute_force(spark):
    """Predictions and scores of real rows, by counts of every context of every language that may be learned from."""
    sf, order = "/root/testdata/sf0.001", language_id.ORDER
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    seen, kinds = {}, {}
    for d in docs:
        if d.text is not None and d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            data = language_id.PAD + d.text.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    key = (d.lang, data[i - k : i])
                    own = seen.setdefault(key, Counter())
                    own[data[i]] += 1
    kinds = {key: (sum(c.values()), len(c)) for key, c in seen.items()}
    languages = sorted({lang for lang, _ in seen})

    def bits(lang, text):
        data, out = language_id.PAD + text, 0.0
        for i in range(order, len(data)):
            for k in range(order, -1, -1):
                key = (lang, data[i - k : i])
                if key not in seen:
                    continue
                total, distinct = kinds[key]
                if n := seen[key].get(data[i]):
                    out -= math.log2(n / (total + distinct))
                    break
                out -= math.log2(distinct / (total + distinct))
            else:
                out += 8
        return out

    got = {r.doc_id: r for r in queries.op7_language(spark, sf).collect()}
    assert len(got) == len(docs)
    asked = [d for d in docs if d.text and any(c.isalpha() for c in d.text)]
    for d in asked:
        text = d.text.encode()
        rates = {lang: bits(lang, text) / len(text) for lang in languages}
        best = min(rates.values())
        assert rates[got[d.doc_id].lang_pred] == pytest.approx(best, rel=1e-4)
        want = 1 / sum(2 ** -((r - best) * min(len(text), language_id.EVIDENCE)) for r in rates.values())
        assert got[d.doc_id].score == pytest.approx(want, abs=1e-3)


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op7_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs_of):
    docs = docs_of(ROWS)
    model = language_id.learn(language_id.training_rows(docs))
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 6)} == {1: "und", 2: "und", 6: "und"}
    empty = language_id.learn(docs_of([]))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(docs_of([]), model).count() == 0


@pytest.mark.parametrize("hot", range(0, 40, 8))
def test_language_sample_is_bounded_and_full_with_a_repeated_id(spark, docs_of, monkeypatch, hot):
    learned = []
    monkeypatch.setattr(language_id, "LanguageModel", learned.append)
    rows = [(i, f"text of {i}") for i in range(40)] + [(hot, f"text of {hot} again {j % 3}") for j in range(2000)]
    language_id.learn(docs_of(rows), sample_docs=10)
    texts = [t.decode() for t in learned[0]["en"]]
    assert len(texts) == len(set(texts)) == 10 and set(texts) <= {f"text of {i}" for i in range(40)}
