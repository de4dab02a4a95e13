"""Scores of texts by a log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

The model predicts a token from the two tokens before it: each context word's vector goes
through its position's matrix, their sum is compared with the vector of every class. The
most frequent words, thousands of them, and the text's end are classes of their own; other
words share a class with words of the same last two bytes, and have there the smoothed
share of their count. So every token has a normalised probability, known or not.

From the corpus, all of it, come the count of every word and of every trigram of classes.
Tasks count trigrams as they read, in lots that are shuffled and written where they were
counted; a trigram with a great count becomes several rows, so that steps weigh alike. In
each round every shard goes from the same model over its rows, and the shards' models are
averaged. A step tells its tokens from noise drawn from the classes' shares, the same draws
for all of them, so that it is a few matrix products. A context's normaliser depends on two
classes only, so one table of class pairs, itself a matrix product, has them all.

A bounded dictionary of the most frequent words goes to every task. Rarer words meet
their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hash_bucket, saved

#: Classes: own words, endings, one for other endings, one for the text's end. At least so many; class_counts has them for a corpus.
OWN_WORDS, ENDINGS = 2048, 254
CLASSES = OWN_WORDS + ENDINGS + 2
#: At most so many: the table of their pairs goes to every task, with four bytes a pair.
MAX_CLASSES = 8192
#: Words whose counts go to every task.
DICTIONARY = 200_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 150_000
#: Numbers in a vector, noise draws of a step, its rows, and the rate of change.
SIZE, NOISE, BATCH, RATE, SEED = 24, 128, 1024, 0.2, 7
#: Rounds, each over the rows with these slots of SLOTS: two passes over everything, the first one in growing parts. A small corpus goes round as often as makes STEPS.
SLOTS, ROUNDS, STEPS = 16, ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16), (0, 16)), 1600
#: Training tokens of a shard; tokens of a lot; the count beyond which a trigram becomes several rows.
SHARD_TOKENS, LOT, HEAVY = 8_000_000, 4_000_000, 8
#: Models that are averaged at once: those of more shards in levels, by tasks.
FAN = 64

#: Tokens scored at once.
SLICE = 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The end's entry among the words, which hold no white space.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def ending(word: bytes) -> int:
    return word[-1] << 8 | (word[-2] if len(word) > 1 else 0)


def class_counts(tokens: int) -> tuple[int, int]:
    """Own words and endings for so many training tokens: from some on there are about as many possible class trigrams as tokens."""
    scale = min(max(1.0, (tokens / CLASSES**3) ** (1 / 3)), MAX_CLASSES / CLASSES)
    return int(OWN_WORDS * scale), int(ENDINGS * scale)


@dataclass
class Vocabulary:
    """Dictionary of frequent words with their counts, the classes, and the corpus's totals."""

    counts: dict[bytes, int]
    own: dict[bytes, int]
    of_ending: np.ndarray  # class of each two-byte ending
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    own_words: int  # classes up to here are a word's own

    @property
    def classes(self) -> int:
        return len(self.class_total)

    @property
    def end_class(self) -> int:
        return self.classes - 1

    def class_shares(self) -> np.ndarray:
        """Smoothed shares of the classes among all tokens."""
        n = self.class_total + 0.5
        for word, c in self.own.items():
            n[c] += self.counts[word]
        n[self.end_class] += self.counts[END]
        return n / n.sum()

    def class_of(self, word: bytes) -> int:
        found = self.own.get(word)
        return int(self.of_ending[ending(word)]) if found is None else found

    def base(self, count):
        """log10 of the smoothed share among all tokens."""
        return np.log10((np.asarray(count, dtype=float) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def inside(self, count, of_class):
        """log10 of the smoothed share within a class of several words."""
        return np.log10((np.asarray(count, dtype=float) + 0.5) / (self.class_total[of_class] + 0.5 * (self.class_distinct[of_class] + 1)))


#: Rows of one matrix in a batched product: small enough to be multiplied by one thread, whatever else the machine does.
ROWS = 64


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, by batches of ROWS rows."""
    return (x.reshape(-1, ROWS, x.shape[1]) @ w).reshape(len(x), -1)


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y, by batches of ROWS rows."""
    return (x.reshape(-1, ROWS, x.shape[1]).transpose(0, 2, 1) @ y.reshape(-1, ROWS, y.shape[1])).sum(axis=0)


class LogBilinear:
    """Vectors and matrices, and the squares of their gradients so far.

    A class's target vector stands in one row with its bias and a column of zeros, which makes
    rows even; the matrices of both places stand one above the other, with as many columns.
    """

    def __init__(self, classes: int = CLASSES, size: int = SIZE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = size
        self.context = rng.normal(0, 0.1, (classes, size)).astype(np.float32)
        self.outs = np.zeros((classes, size + 2), dtype=np.float32)
        self.target[:] = rng.normal(0, 0.1, (classes, size))
        self.turns = np.zeros((2 * size, size + 2), dtype=np.float32)  # of the token before, and of the one before that
        for turn in self.turn:
            turn[:] = np.eye(size) / 2
        self.squares = [np.zeros_like(p) for p in self._params()]

    @property
    def target(self) -> np.ndarray:
        return self.outs[:, : self.size]

    @property
    def bias(self) -> np.ndarray:
        return self.outs[:, self.size]

    @property
    def turn(self) -> list[np.ndarray]:
        return [self.turns[: self.size, : self.size], self.turns[self.size :, : self.size]]

    def _params(self) -> list[np.ndarray]:
        return [self.context, self.outs, self.turns]

    def state(self) -> np.ndarray:
        """All that training goes on from, in one vector."""
        return np.concatenate([x.ravel() for x in (*self._params(), *self.squares)])

    def go_on_from(self, state: np.ndarray) -> None:
        at = 0
        for x in (*self._params(), *self.squares):
            x.ravel()[:] = state[at : at + x.size]
            at += x.size

    def fit(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Trains on these trigrams alone, from the shares of their classes."""
        if not len(counts):
            return
        classes, rng = len(self.bias), np.random.default_rng(seed)
        noise = np.bincount(target, counts, classes) + 0.5
        noise = noise / noise.sum()
        self.bias[:] = np.log(noise)
        keys, weights = spread((near * classes + far) * classes + target, counts, rng)
        rows, source, done = _parted(keys, classes), Noise(noise), 0
        while done < steps:
            for first in range(0, len(keys), BATCH):
                self.step(*[x[first : first + BATCH] for x in (*rows, weights)], source, rng, done / steps)
                done += 1

    def step(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, weights: np.ndarray, noise: Noise, rng, at: float) -> None:
        """One step of noise-contrastive estimation: tell the trigrams' last tokens, with their counts, from NOISE draws of `noise`.

        at: how much of the training is done, from 0 to 1.
        """
        lacking = -len(near) % ROWS
        if lacking:  # rows that count for nothing
            near, far, target, weights = (np.append(x, np.zeros(lacking, dtype=x.dtype)) for x in (near, far, target, weights))
        size, drawn = self.size, noise.draw(rng).astype(target.dtype)
        both = np.stack([near, far], axis=1).ravel()
        before = self.context.take(both, 0).reshape(len(near), 2 * size)
        h = _times(before, self.turns)
        h[:, size] = 1  # meets the bias
        own, other = self.outs.take(target, 0), self.outs.take(drawn, 0)
        share = (weights / weights.sum()).astype(np.float32)
        to_own = share / (1 + np.exp(np.einsum("ij,ij->i", h, own) - noise.shift.take(target)))
        against = -other
        against[:, size] += noise.shift.take(drawn)
        z = _times(h, np.ascontiguousarray(against.T))
        np.exp(z, out=z)
        z += 1
        to_other = np.divide(-share[:, None], z, out=z)
        dh = _times(to_other, other)
        own *= to_own[:, None]
        dh += own
        dh[:, size:] = 0
        rate = np.float32(RATE * min(1.0, 2 * (1 - at)))
        turned = _summed(before, dh)
        self._change(0, *_gathered(both, _times(dh, np.ascontiguousarray(self.turns.T)).reshape(-1, size)), rate)
        rows = np.empty((len(h) + len(drawn), size + 2), dtype=np.float32)
        np.multiply(to_own[:, None], h, out=rows[: len(h)])
        rows[len(h) :] = _summed(to_other, h)
        self._change(1, *_gathered(np.concatenate([target, drawn]), rows), rate)
        self._change(2, np.arange(2 * size), turned, rate)

    def _change(self, k: int, which: np.ndarray, grad: np.ndarray, rate: np.float32) -> None:
        """Moves these rows of a parameter, each number by its gradient over the root of its squares so far; a row without a gradient wouldn't move."""
        squares = grad * grad
        squares += self.squares[k].take(which, 0)
        _put(self.squares[k], which, squares)
        np.sqrt(squares, out=squares)
        squares += np.float32(1e-8)
        moved = np.divide(grad, squares, out=squares)
        moved *= rate
        moved += self._params()[k].take(which, 0)
        _put(self._params()[k], which, moved)

    def pair_vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context vectors turned for the nearer and the farther place, and log normalisers by (near, far)."""
        near, far = self.context @ self.turn[0], self.context @ self.turn[1]
        a, b = near @ self.target.T, far @ self.target.T + self.bias
        tops = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        norm = np.log(np.exp(a - tops[0]) @ np.exp(b - tops[1]).T) + tops[0] + tops[1].T
        return near, far, norm.astype(np.float32)

    def table(self) -> np.ndarray:
        """log10 probability of each class after each pair (near, far), normalised; for few classes."""
        near, far, norm = self.pair_vectors()
        return ((near @ self.target.T)[:, None, :] + (far @ self.target.T + self.bias)[None, :, :] - norm[:, :, None]) / math.log(10)


class Noise:
    """A distribution of classes, to draw from."""

    def __init__(self, shares: np.ndarray):
        self.until, self.shift = np.cumsum(shares), np.log(NOISE * shares).astype(np.float32)

    def draw(self, rng) -> np.ndarray:
        return np.minimum(np.searchsorted(self.until, rng.random(NOISE)), len(self.until) - 1)


def _put(into: np.ndarray, which: np.ndarray, rows: np.ndarray) -> None:
    """into[which] = rows, each row moved as one item."""
    item = np.dtype((np.void, into.itemsize * into.shape[1]))
    into.view(item).ravel()[which] = rows.view(item).ravel()


def _gathered(which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct classes, and the sum of the rows of each; rows of an even length are summed two numbers at a time."""
    order = np.argsort(which, kind="stable")
    ordered = which[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rows = rows.take(order, 0)
    return ordered[starts], np.add.reduceat(rows.view(np.complex64) if rows.shape[1] % 2 == 0 else rows, starts, axis=0).view(np.float32)


def _parted(keys: np.ndarray, classes: int) -> list[np.ndarray]:
    """near, far and target of keys, as the small integers that MAX_CLASSES allows."""
    pair = keys // classes
    return [(pair // classes).astype(np.int16), (pair % classes).astype(np.int16), (keys % classes).astype(np.int16)]


def spread(keys: np.ndarray, counts: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Keys in random order with their counts; of a count over HEAVY every HEAVY is a row of its own, and so is the rest."""
    parts = -(-counts // HEAVY).astype(np.int64)
    order = rng.permutation(int(parts.sum()))
    weights = np.full(len(order), HEAVY, dtype=np.uint8)
    weights[np.cumsum(parts) - 1] = counts - (parts - 1) * HEAVY
    return np.repeat(keys, parts)[order], weights[order]


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word (binary, lower-cased), n over all rows; the end has a row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column(1):
                held.update(tokens(text.as_py()))
                held[END] += 1
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()
        give_back()

    return _rows(docs, id_col, text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Classes by the counts; what comes to the driver has fixed bounds: DICTIONARY words, 65,536 endings."""
    top = counts.filter(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("n"), "word").limit(DICTIONARY).toArrow()
    frequent = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    end_count = sum(r[0] for r in counts.filter(F.col("word") == F.lit(bytearray(END))).select("n").collect())
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own_words, endings = class_counts(int(total))
    classes = own_words + endings + 2
    own = {w: i for i, w in enumerate(list(frequent)[:own_words])}
    last = F.hex(F.when(F.octet_length("word") > 1, F.substring(F.col("word"), -2, 2)).otherwise(F.concat(F.unhex(F.lit("00")), F.col("word"))))
    rest = counts.filter(F.col("word") != F.lit(bytearray(END)))
    by_end = rest.groupBy(last.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).toArrow()
    totals = {}
    for e, n, k in zip(*[c.to_pylist() for c in by_end.columns], strict=True):
        both = bytes.fromhex(e)
        totals[both[1] << 8 | both[0]] = [int(n), int(k)]
    for w in own:
        totals[ending(w)][0] -= frequent[w]
        totals[ending(w)][1] -= 1
    of_ending = np.full(1 << 16, classes - 2, dtype=np.int64)
    for i, (e, _) in enumerate(sorted(totals.items(), key=lambda x: (-x[1][0], x[0]))[:endings]):
        of_ending[e] = own_words + i
    class_total, class_distinct = np.zeros(classes), np.zeros(classes)
    for e, (n, k) in totals.items():
        class_total[of_ending[e]] += n
        class_distinct[of_ending[e]] += k
    return Vocabulary({**frequent, END: end_count}, own, of_ending, int(total), int(distinct), class_total, class_distinct, own_words)


def trigram_rows(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """slot, n, near, far, target, weight: class trigrams of all rows with their counts, ends in front and behind.

    Each task counts lots of LOT tokens and deals each lot, in random order, to SLOTS rows of
    packed numbers: n trigrams each, of classes in two bytes and a weight in one. A trigram
    of several lots, or with a count over HEAVY, stands there several times, with weights
    that sum up to its count.
    """
    n_classes = words.classes
    shared = docs.sparkSession.sparkContext.broadcast((words.own, words.of_ending))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(*shared.value, n_classes)
        rng = np.random.default_rng([SEED, TaskContext.get().partitionId() if TaskContext.get() else 0])
        gathered: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            keys, weights = spread(*np.unique(np.concatenate(gathered), return_counts=True), rng)
            gathered.clear()
            ends = np.linspace(0, len(keys), SLOTS + 1).astype(int)
            columns = [*_parted(keys, n_classes), weights]
            packed = [pa.array([c[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()) for c in columns]
            first = rng.integers(SLOTS)  # small lots fill some slots only
            slots = pa.array((np.arange(SLOTS) + first) % SLOTS, pa.int32())
            return pa.RecordBatch.from_arrays([slots, pa.array(np.diff(ends), pa.int64()), *packed], ["slot", "n", "near", "far", "target", "weight"])

        for batch in batches:
            for text in batch.column(1):
                c = classes.of(tokens(text.as_py()))
                for first in range(0, len(c) - 2, LOT):  # a long text in parts
                    part = c[first : first + LOT + 2]
                    gathered.append((part[1:-1] * n_classes + part[:-2]) * n_classes + part[2:])
                    size += len(part) - 2
                    if size >= LOT:
                        yield counted()
                        size = 0
        if gathered:
            yield counted()
        give_back()

    return _rows(docs, id_col, text_col).mapInArrow(run, "slot int, n long, near binary, far binary, target binary, weight binary")


class _Classes:
    """Classes of a text's tokens: two ends in front, the words, one end behind."""

    def __init__(self, own: dict[bytes, int], of_ending: np.ndarray, classes: int):
        self.own, self.of_ending, self.end_class = own, of_ending.tolist(), classes - 1

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words) + 3, dtype=np.int64)
        out[:2] = out[-1] = self.end_class
        found = np.fromiter(map(self.own.get, words, repeat(-1)), np.int64, len(words))
        of_ending, shared = self.of_ending, np.flatnonzero(found < 0)
        found[shared] = [of_ending[w[-1] << 8 | (w[-2] if len(w) > 1 else 0)] for w in map(words.__getitem__, shared.tolist())]
        out[2:-1] = found
        return out


_STATES = "shard long, weight double, state binary"


def averaged(states: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """The models of so many shards (shard, from 0; weight; state, floats), averaged by their weights until at most `fan` are left."""

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        whole = float(group["weight"].sum())
        out = sum(np.frombuffer(state, dtype=np.float32) * (weight / whole) for state, weight in zip(group["state"], group["weight"], strict=True))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0]) // fan], "weight": [whole], "state": [out.astype(np.float32).tobytes()]})

    while shards > fan:
        states = states.groupBy(F.floor(F.col("shard") / fan)).applyInPandas(mean, _STATES)
        shards = -(-shards // fan)
    return states


def train(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> LogBilinear:
    """ROUNDS over the trigrams: every shard goes on from the same model, and their models are averaged by their counts.

    There are as many shards as the training tokens ask for, however many. Which rows a shard
    has and in which order follows from how the table of trigrams was written: the same rows
    in other partitions give another model, of about the same likelihood. Rows with a null id
    are neither learned from nor held out.
    """
    sc = docs.sparkSession.sparkContext
    table = saved(trigram_rows(docs, words, id_col, text_col), "trigrams")
    rows = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes, noise = words.classes, words.class_shares()
    model = LogBilinear(classes)
    model.bias[:] = np.log(noise)
    if not rows:
        return model
    shards = max(1, -(-words.total // SHARD_TOKENS))
    slots = sum(last - first for first, last in ROUNDS)
    # a corpus of fewer rows goes round several times; it is held for that, and has fewer rows than STEPS takes
    times = max(1, round(STEPS * BATCH * SLOTS / (slots * rows)))
    at = 0.0
    for turn, (first, last) in enumerate(ROUNDS):
        shared = sc.broadcast(model.state())
        begin, at = at, at + (last - first) / slots

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared, begin=begin, end=at, part=(last - first) / SLOTS) -> Iterator[pa.RecordBatch]:
            shard = TaskContext.get().partitionId() if TaskContext.get() else 0
            rng = np.random.default_rng([SEED, turn, shard])
            own = LogBilinear(classes)
            own.go_on_from(shared.value)
            expected, seen, weight = max(1.0, times * rows * part / shards), 0, 0.0

            def steps(columns: list[np.ndarray], last: bool) -> int:
                """How many rows were gone over: whole steps, but for the last."""
                nonlocal seen, weight
                n = len(columns[0]) if last else len(columns[0]) - len(columns[0]) % BATCH
                for i in range(0, n, BATCH):
                    own.step(*[c[i : min(n, i + BATCH)] for c in columns], source, rng, begin + (end - begin) * min(1.0, seen / expected))
                    seen += min(BATCH, n - i)
                weight += float(columns[3][:n].sum())
                return n

            source = Noise(noise)
            held = [np.empty(0, dtype=kind) for kind in (np.int16, np.int16, np.int16, np.uint8)]
            for batch in batches:
                for row in range(batch.num_rows):
                    blobs = [np.frombuffer(batch.column(k)[row].as_buffer(), dtype=held[k].dtype) for k in range(4)]
                    held = [np.concatenate(pair) for pair in zip(held, blobs, strict=True)]
                    if times == 1:
                        n = steps(held, False)
                        held = [c[n:] for c in held]
            for _ in range(times if len(held[0]) else 0):
                order = rng.permutation(len(held[0]))
                steps([c[order] for c in held], True)
            if seen:
                values, kinds = [[shard], [weight], [own.state().tobytes()]], [pa.int64(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], ["shard", "weight", "state"])
            give_back()

        mine = table.filter(F.col("slot").between(first, last - 1)).select("near", "far", "target", "weight").coalesce(shards)
        done = averaged(mine.mapInArrow(run, _STATES), shards).toArrow().sort_by("shard")
        shared.destroy()
        if done.num_rows:
            mean, whole = np.zeros(len(model.state())), sum(done.column("weight").to_pylist())
            for weight, state in zip(done.column("weight"), done.column("state"), strict=True):
                mean += np.frombuffer(state.as_buffer(), dtype=np.float32) * (weight.as_py() / whole)
            model.go_on_from(mean)
    return model


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: LogBilinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row.

    Null and empty texts have one token, the end. Repeated rows are scored each; long texts
    are read whole; words of equal count have a fixed order, that of their bytes; if nothing
    was learned, all tokens are unknown. An empty table gives no rows; other columns are
    ignored.
    """
    entries = list(words.counts)
    values = np.array(list(words.counts.values()), dtype=float)
    of_class = np.array([words.end_class if w == END else words.class_of(w) for w in entries], dtype=np.int32)
    several = (of_class >= words.own_words) & (of_class != words.end_class)
    lookup = {
        # the last entry of each array: a rare word's, whose count comes by the join
        "words": b" ".join(entries),
        "base": np.append(words.base(values), 0.0),
        "inside": np.append(np.where(several, words.inside(values, of_class), 0.0), 0.0),
        "known": np.append(values > 0, False),
        "of_class": np.append(of_class, 0),
        "of_ending": words.of_ending,
        "lacking": -np.log10(words.class_total + 0.5 * (words.class_distinct + 1)),
        "lacking_base": -math.log10(words.total + 0.5 * (words.distinct + 1)),
        "target": (np.ascontiguousarray(model.target), np.ascontiguousarray(model.bias)),
        "pairs": model.pair_vectors(),
    }
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        get = {w: i for i, w in enumerate(own["words"].split(b" "))}.get
        end, of_ending, (by_near, by_far, norm) = get(END), own["of_ending"].tolist(), own["pairs"]
        vectors, bias = own["target"]
        end_class = len(norm) - 1
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        at = 0
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                out: list[tuple] = []
                texts = [tokens(text.as_py()) for text in part.column(1)]
                sizes = np.array([len(ws) + 1 for ws in texts], dtype=np.int64)
                ids = np.fromiter(chain.from_iterable(chain(map(get, ws, repeat(-1)), (end,)) for ws in texts), np.int64, int(sizes.sum()))
                starts = np.cumsum(sizes) - sizes
                c = own["of_class"].take(ids).astype(np.int64)
                rare = np.flatnonzero(ids < 0)
                inner = rare - starts[(which := np.searchsorted(starts, rare, side="right") - 1)]
                unknown = [texts[d][i] for d, i in zip(which.tolist(), inner.tolist(), strict=True)]
                c[rare] = [of_ending[ending(w)] for w in unknown]
                near, far = np.roll(c, 1), np.roll(c, 2)
                near[starts] = far[starts] = end_class
                more = starts[sizes > 1] + 1
                far[more] = end_class
                base, score = own["base"].take(ids), own["inside"].take(ids)
                base[rare], score[rare] = own["lacking_base"], own["lacking"].take(c[rare])
                for i in range(0, len(c), SLICE):
                    a, b, t = near[i : i + SLICE], far[i : i + SLICE], c[i : i + SLICE]
                    met = np.einsum("ij,ij->i", by_near.take(a, 0) + by_far.take(b, 0), vectors.take(t, 0))
                    score[i : i + SLICE] += (met + bias.take(t) - norm[a, b]) / math.log(10)
                bases, scores, known = (np.add.reduceat(x, starts) for x in (base, score, own["known"].take(ids).astype(np.int64)))
                words_of = np.searchsorted(rare, np.append(starts, len(ids)))
                for k, doc in enumerate(part.column(0).to_pylist()):
                    out.append((task + at, doc, int(sizes[k]), int(known[k]), float(bases[k]), float(scores[k]), unknown[words_of[k] : words_of[k + 1]]))
                    at += 1
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.binary())]
                names = [n.split()[0] for n in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)
        give_back()

    scored = saved(_rows(docs, id_col, text_col).mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    met = rare.join(counts.select("word", "n"), "word", "left")
    share = F.log10(F.coalesce("n", F.lit(0)) + 0.5) * F.col("k")
    more = met.groupBy("row").agg(F.sum(share).alias("_log"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("_known"))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("_log", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_log", F.lit(0.0))).alias("score"),
    )


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(hash_bucket(F.col(id_col), 5) != 1)


def learn_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from training_rows, score all rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    training = training_rows(docs, id_col)
    counts = saved(word_counts(training, id_col, text_col), "word-counts")
    words = vocabulary(counts)
    model = train(training, words, id_col, text_col)
    done = score(docs, counts, words, model, id_col, text_col)
    held_out = F.coalesce(hash_bucket(F.col("doc_id"), 5) == 1, F.lit(False))
    return done.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
