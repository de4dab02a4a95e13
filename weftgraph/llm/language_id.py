"""Language identification by prediction by partial matching.

For each language, byte contexts of up to ORDER bytes with the counts of what followed
them. A byte costs -log2(c / (t + d)) in the longest known context in which it was seen
(c its count, t all, d the distinct ones), and -log2(d / (t + d)) for every longer known
context it escapes from; below the empty context all 256 bytes cost 8 bits. Statistics
are frozen after learning, so code lengths are exact sums, without exclusions.

The trees of all languages are merged into one hashed table per order with a vector of
costs per entry, so that a text's code lengths in all languages come from one lookup a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, hash_bucket, saved

ORDER = 3
#: What stands before a text's first byte.
PAD = b"\n" * ORDER
#: Whole texts learned from per language: the bound of the learning sample.
SAMPLE_DOCS = 800
#: So many times the sample are expected below the bound of hashes that is looked at.
SPARE = 1.5
#: Positions scored at once.
BLOCK = 1 << 20
#: The score weighs the evidence of this many bytes, whatever the text's length.
EVIDENCE = 32
UNDETERMINED = "und"


@dataclass
class _Table:
    """Sorted keys behind a hash table, and a cost vector for each."""

    keys: np.ndarray
    costs: np.ndarray
    slots: np.ndarray
    shift: int
    probes: int

    @classmethod
    def of(cls, keys: np.ndarray, costs: np.ndarray) -> _Table:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        slots, left = np.full(1 << bits, -1, dtype=np.int32), np.arange(len(keys), dtype=np.int32)
        at, probes = cls._home(keys, 32 - bits), 0
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]  # of several for one slot the last stays
            placed = slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & (len(slots) - 1)
            probes += 1
        return cls(keys, costs.astype(np.float32), slots, 32 - bits, max(1, probes))

    @staticmethod
    def _home(keys: np.ndarray, shift: int) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self._home(keys, self.shift)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        for _ in range(1, self.probes):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            found[wrong] = now = self.slots[at[wrong]]
            wrong = wrong[(now >= 0) & (self.keys[now] != keys[wrong])]
        found[wrong] = -1
        return found


class LanguageModel:
    """Frozen statistics of every language, and code lengths under them."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        pad = PAD[:order]
        counts = []  # per language: order k -> (keys of k + 1 bytes, counts), and the contexts' totals and kinds
        for name in self.languages:
            data = np.frombuffer(b"".join(pad + t for t in texts[name]) or b"\n", dtype=np.uint8)
            inside = np.ones(len(data), dtype=bool)
            starts = np.cumsum([0] + [len(t) + order for t in texts[name]])[:-1]
            for i in range(order):
                inside[starts + i] = False
            at = np.flatnonzero(inside)
            counts.append([self._count(data, at, k) for k in range(order + 1)])
        n = len(self.languages)
        floor = np.full((256, n), 8.0)
        self.grams: list[_Table] = []
        self.contexts: list[_Table] = []
        below: np.ndarray | None = None
        below_keys = np.arange(256, dtype=np.uint32)
        for k in range(order + 1):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint32), *(c[k][0] for c in counts)])) if k else np.arange(256, dtype=np.uint32)
            shorter = keys & np.uint32((1 << 8 * k) - 1)
            rest = floor if k == 0 else below[np.searchsorted(below_keys, shorter)]
            contexts = np.unique(keys >> np.uint32(8)) if k else np.zeros(1, dtype=np.uint32)
            cost, escape = np.empty((len(keys), n)), np.zeros((len(contexts), n))
            for j, c in enumerate(counts):
                seen_keys, seen = c[k]
                context, inverse = np.unique(seen_keys >> np.uint32(8) if k else seen_keys * np.uint32(0), return_inverse=True)
                total, kinds = np.bincount(inverse, seen, len(context)), np.bincount(inverse, minlength=len(context))
                if len(context):
                    escape[np.searchsorted(contexts, context), j] = -np.log2(kinds / (total + kinds))
                own = keys >> np.uint32(8) if k else keys * np.uint32(0)
                cost[:, j] = escape[np.searchsorted(contexts, own), j] + rest[:, j]
                cost[np.searchsorted(keys, seen_keys), j] = -np.log2(seen / (total + kinds)[inverse])
            self.grams.append(_Table.of(keys, cost))
            self.contexts.append(_Table.of(contexts, escape))
            below, below_keys = cost, keys

    @staticmethod
    def _count(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        key = np.zeros(len(at), dtype=np.uint32)
        for i in range(k, -1, -1):
            key = key << np.uint32(8) | data[at - i]
        keys, seen = np.unique(key, return_counts=True)
        return keys, seen.astype(float)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        pad = PAD[: self.order]
        sizes = np.array([len(t) + self.order for t in texts], dtype=np.int64)
        if not len(sizes):
            return out
        data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        for first in range(self.order, len(data), BLOCK):
            last = min(len(data), first + BLOCK)
            key = np.zeros(last - first, dtype=np.uint32)
            for i in range(self.order, -1, -1):
                key = key << np.uint32(8) | data[first - i : last - i]
            cost = self._cost(key)
            docs = np.searchsorted(starts, np.arange(first, last, 1 << 62), side="right") - 1  # the first one's document
            a, b = int(docs[0]), int(np.searchsorted(starts, last, side="left"))
            edges = np.maximum(starts[a:b], first) - first
            for i in range(self.order):  # a pad costs nothing
                pads = starts[a:b] + i - first
                cost[pads[(pads >= 0) & (pads < last - first)]] = 0
            out[a:b] += np.add.reduceat(cost, edges, axis=0, dtype=np.float64)
        return out

    def _cost(self, key: np.ndarray) -> np.ndarray:
        table = self.grams[self.order]
        found = table.find(key)
        cost = table.costs[found]
        left = np.flatnonzero(found < 0)
        if len(left):
            cost[left] = 0
        for k in range(self.order, 0, -1):  # escapes from order k to k - 1
            if not len(left):
                break
            own = key[left]
            context = self.contexts[k].find(own >> np.uint32(8) & np.uint32((1 << 8 * k) - 1))
            cost[left] += np.where((context >= 0)[:, None], self.contexts[k].costs[context], 0)
            found = self.grams[k - 1].find(own & np.uint32((1 << 8 * k) - 1))
            hit = found >= 0
            cost[left[hit]] += self.grams[k - 1].costs[found[hit]]
            left = left[~hit]
        return cost

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of the shortest code, its share of the evidence, and bits a byte."""
        bits = self.code_lengths(texts)
        sizes = np.array([max(1, len(t)) for t in texts], dtype=float)
        best = bits.argmin(axis=1) if len(texts) else np.zeros(0, dtype=int)
        rate = bits / sizes[:, None]
        shortest = rate[np.arange(len(best)), best]
        weight = np.exp2(-(rate - shortest[:, None]) * np.minimum(sizes, EVIDENCE)[:, None])
        return [self.languages[i] for i in best], 1 / weight.sum(axis=1), shortest


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from the rows of `docs` with text and language: per language, the sample_docs ids of smallest hash, one whole text each (the least, where an id has several)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    each = saved(rows.select("id", "lang").distinct(), "language-ids")  # repeated rows count once
    # the smallest hashes by a bound from the language's count, then by rank: no language meets whole in a task
    counts = each.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    low = each.select("id", "lang", place.alias("place")).join(F.broadcast(counts), "lang")
    low = low.filter(F.col("place") <= F.lit(float(SPARE * sample_docs * (1 << 30))) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))
    ids = low.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).select("id", "lang")
    chosen = rows.join(F.broadcast(ids), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    sample = chosen.orderBy("lang", "id").select("lang", F.col("text").cast("binary").alias("text")).toArrow()
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(*[c.to_pylist() for c in sample.columns], strict=True):
        texts.setdefault(lang, []).append(text)
    return LanguageModel(texts)


VERDICT = "lang_pred string, score double, bits_per_byte double"


def verdict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """Struct of VERDICT for a text column. The model's size is bounded by its sample."""
    shared = spark.sparkContext.broadcast(model)

    def judge(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        own, parts = shared.value, [pd.DataFrame({"lang_pred": [], "score": [], "bits_per_byte": []})]
        for first in range(0, len(texts), 400):
            part = [bytes(t) if t is not None else b"" for t in texts.iloc[first : first + 400]]
            letter = letters.iloc[first : first + 400].to_numpy(dtype=bool) & bool(own.languages)
            names, score, rate = own.predict(part) if own.languages else ([UNDETERMINED] * len(part), np.zeros(len(part)), np.zeros(len(part)))
            names = [n if ok else UNDETERMINED for n, ok in zip(names, letter, strict=True)]
            parts.append(pd.DataFrame({"lang_pred": names, "score": np.where(letter, score, 0.0), "bits_per_byte": rate}))
        give_back()
        return pd.concat(parts[1:] or parts, ignore_index=True)

    text = text.cast("string")
    return F.pandas_udf(judge, VERDICT)(text.cast("binary"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row.

    A null text, or one without a letter, is `und` with score 0 (so is everything if
    nothing was learned); repeated rows are scored each; an empty table gives no rows;
    other columns are ignored.
    """
    found = verdict(docs.sparkSession, model, F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("_v")).select("doc_id", "_v.*")


def accepted(docs: DataFrame, model: LanguageModel, least_score: float = 0.5, most_bits: float = 5.5, text_col: str = "text") -> DataFrame:
    """The rows of docs in a known language: not `und`, not ambiguous, and not far from what the language was learned to be.

    Null texts and those without a letter are `und` and go; two languages at a tie have
    a score of 0.5 or less each, and one at exactly least_score stays; repeated rows are
    judged each; long texts are read whole; an empty table stays empty. All columns keep
    their values, whatever their names.
    """
    judged = docs.select(F.struct("*").alias("row"), verdict(docs.sparkSession, model, F.col(text_col)).alias("v"))
    keep = (F.col("v.lang_pred") != UNDETERMINED) & (F.col("v.score") >= least_score) & (F.col("v.bits_per_byte") <= most_bits)
    return judged.filter(keep).select("row.*")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that may be learned from; the other ids are held out."""
    return docs.filter(hash_bucket(F.col(id_col), 4) != 2)
