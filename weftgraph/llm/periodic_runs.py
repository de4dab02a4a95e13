"""Runs of periodic words in texts, by Main and Lorentz's divide and conquer.

A run is a stretch of words with smallest period q (words q apart are equal) and at least
EXPONENT periods and MIN_LENGTH words, which no neighbouring word continues. A text's words
become numbers. Segments are halved again and again; a run is met at the first midpoint
that lies inside it, and one of its halves then holds two periods of it. So the Z-values of
the right half, and of the left half read backwards, give all periods that can cross there:
those q at which the Z-value is q or more. Each such period is followed to both ends in the
whole text; equal intervals are one run, with the smallest of their periods.

All segments of a level, of many texts, go through numpy together: a Z-value is looked into
only while it may still reach its q, which ends after a word or two nearly everywhere. Where
many survive (a text that repeats itself), the segment's Z-function is computed in linear time.
Periods of runs that are known to cover a midpoint are not followed again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: A run has as many periods (at least four, on which the halves rest), and as many words.
EXPONENT, MIN_LENGTH = 4, 6
#: Words of texts that are searched together; a longer text is searched alone.
TOGETHER = 300_000
#: Pairs of midpoint and period that are compared at once.
SLICE = 1_000_000
#: Words of a Z-value that are compared for all of a slice, before what is left is looked at one by one.
ROUNDS = 24
#: More periods than these at one midpoint, of which more than ROUNDS words are equal: its Z-function is computed.
MANY = 64


def z_function(x: list[int]) -> list[int]:
    """At each place, how many words from there on equal the first ones; at place 0 all."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _equal_ahead(x: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from i on equal those from j on (i < j), before end."""
    done, step = 0, 64
    while j + done < end:
        size = min(step, end - j - done)
        differ = x[i + done : i + done + size] != x[j + done : j + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + size, step * 4
    return done


def _equal_behind(x: np.ndarray, i: int, j: int, start: int) -> int:
    """How many words before i equal those before j (i < j), from start on."""
    done, step = 0, 64
    while i - done > start:
        size = min(step, i - done - start)
        differ = (x[i - done - size : i - done] != x[j - done - size : j - done])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + size, step * 4
    return done


def _pairs(reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment, period) for the periods 1 to reach of every segment, in order, in slices."""
    ends, first = np.cumsum(reach), 0
    while first < len(reach):
        before = int(ends[first - 1]) if first else 0
        if reach[first] > SLICE:
            for q in range(1, int(reach[first]) + 1, SLICE):
                period = np.arange(q, min(q + SLICE, int(reach[first]) + 1))
                yield np.full(len(period), first), period
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        own = reach[first:last]
        yield np.repeat(np.arange(first, last), own), np.arange(1, int(own.sum()) + 1) - np.repeat(ends[first:last] - own - before, own)
        first = last


class _Search:
    """The search in the words x of several texts; text k is x[bounds[k]:bounds[k + 1]]."""

    def __init__(self, x: np.ndarray, bounds: np.ndarray, exponent: int, min_length: int):
        self.x, self.bounds, self.exponent, self.min_length = x, bounds, exponent, min_length
        self.found: dict[tuple[int, int], int] = {}
        #: The longest known run that covers a word: its period (0: none), start and end.
        self.period, self.start, self.end = (np.zeros(len(x), np.int64) for _ in range(3))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, period), by start and period."""
        lo, hi = self.bounds[:-1], self.bounds[1:]
        while len(lo):
            keep = hi - lo >= self.min_length
            lo, hi = lo[keep], hi[keep]
            mid = (lo + hi) // 2
            self._level(lo, mid, hi, True)
            self._level(lo, mid, hi, False)
            lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        return sorted((s, e, q) for (s, e), q in self.found.items())

    def _level(self, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, ahead: bool) -> None:
        """Runs with two periods in the right halves (ahead), or in the left ones."""
        x, half = self.x, self.min_length - self.min_length // 2
        room = hi - mid if ahead else mid - lo
        at, step = (mid, 1) if ahead else (mid - 1, -1)
        state = {"segment": -1}
        for segment, q in _pairs(room // 2):
            here = at[segment]
            need = np.maximum(q, half - q)  # so many words have to equal those q further on
            alive = (x[here] == x[here + step * q]) & (q + need <= room[segment])
            segment, q, need, here = segment[alive], q[alive], need[alive], here[alive]
            known = (self.period[here] > 0) & (q >= self.period[here])
            inside = here + 2 * q <= self.end[here] if ahead else here + 1 - 2 * q >= self.start[here]
            alive = ~(known & inside)
            segment, q, need, here = segment[alive], q[alive], need[alive], here[alive]
            for t in range(1, ROUNDS):
                if not len(q) or need.max() <= t:
                    break
                rest = np.flatnonzero(need > t)
                differ = x[here[rest] + step * t] != x[here[rest] + step * (q[rest] + t)]
                if differ.any():
                    alive = np.ones(len(q), bool)
                    alive[rest[differ]] = False
                    segment, q, need, here = segment[alive], q[alive], need[alive], here[alive]
            if len(q):
                self._follow(segment, q, need, lo, mid, hi, ahead, state)

    def _follow(self, segment, q, need, lo, mid, hi, ahead: bool, state: dict) -> None:
        """Each surviving period of each midpoint, the smallest first, to both ends of what has it."""
        cuts = np.flatnonzero(np.diff(segment)) + 1
        for own, needed in zip(np.split(np.arange(len(q)), cuts), np.split(need, cuts), strict=True):
            s = int(segment[own[0]])
            periods = q[own]
            if int((needed > ROUNDS).sum()) > MANY:
                z = z_function((self.x[mid[s] : hi[s]] if ahead else self.x[lo[s] : mid[s]][::-1]).tolist())
                periods = periods[[z[p] >= n for p, n in zip(periods.tolist(), needed.tolist(), strict=True)]]
            if state["segment"] != s:
                state.update(segment=s, period=0, edge=0)
            for p in periods.tolist():
                self._one(int(mid[s]), p, ahead, state)

    def _one(self, mid: int, q: int, ahead: bool, state: dict) -> None:
        # two periods inside a stretch of a smaller period: the same stretch, or one inside it
        if state["period"] and (mid + 2 * q <= state["edge"] if ahead else mid - 2 * q >= state["edge"]):
            return
        text = int(np.searchsorted(self.bounds, mid, side="right")) - 1
        first, last = int(self.bounds[text]), int(self.bounds[text + 1])
        left = mid if ahead else mid - q
        end = left + q + _equal_ahead(self.x, left, left + q, last)
        start = left - _equal_behind(self.x, left, left + q, first)
        if (end - mid if ahead else mid - start) < 2 * q:
            return
        state.update(period=q, edge=end if ahead else start)
        if end - start >= max(self.min_length, self.exponent * q):
            self.found[start, end] = min(q, self.found.get((start, end), q))
            shorter = self.end[start:end] - self.start[start:end] < end - start
            for known, value in ((self.period, q), (self.start, start), (self.end, end)):
                known[start:end][shorter] = value


def find_runs(texts: list[list], exponent: int = EXPONENT, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every list of words, by start and period."""
    if exponent < 4 or min_length < 2:
        raise ValueError("runs need four periods and two words at least")
    number = defaultdict()
    number.default_factory = number.__len__
    bounds = np.cumsum([0, *map(len, texts)])
    x = np.fromiter((number[w] for words in texts for w in words), np.int32, int(bounds[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in _Search(x, bounds, exponent, min_length).runs():
        text = int(np.searchsorted(bounds, start, side="right")) - 1
        out[text].append((start - int(bounds[text]), end - start, period))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, min_length: int = MIN_LENGTH, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period), collapsed of every row.

    Words are runs of other characters than space and the controls from tab to carriage
    return; `start` counts them from 0. collapsed: the kept words, joined by a space. Null and
    empty texts, and those without words, have no runs and an empty collapsed text. Overlapping
    runs count each, also if they tie in length or start. Texts are searched whole however long,
    repeated rows each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = batch["doc_id"].array, batch["text"].tolist()
            first = 0
            while first < len(rows):
                texts, total, last = [], 0, first
                while last < len(rows) and (not texts or total + len(rows[last] or b"") // 6 <= together):
                    texts.append((rows[last] or b"").split())  # at the same characters
                    total += len(texts[-1])
                    last += 1
                found = find_runs(texts, exponent, min_length)
                yield pd.DataFrame(
                    {
                        "doc_id": ids[first:last],
                        "n_words": [len(t) for t in texts],
                        "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found],
                        "collapsed": [b" ".join(collapsed(t, r)).decode() for t, r in zip(texts, found, strict=True)],
                    }
                )
                first = last
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


#: A word of a text, for Spark's and Java's expressions.
WORD = r"[^\x20\x09-\x0D]+"


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the end of every tenth text (by its id's hash) goes round in a cycle of its words.

    Texts whose id is null, and those without words, stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumns({"_g": g, "_words": words})
    n = F.size("_words")
    a = F.pmod(F.col("_g"), n).cast("int")
    period = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    turned = F.transform(F.sequence(a, n - 1), lambda i: F.get("_words", (a + (i - a) % period).cast("int")))
    cycled = F.array_join(F.concat(F.slice("_words", F.lit(1), a), turned), " ")
    return rows.select("doc_id", F.when(F.coalesce(n > 0, F.lit(False)), cycled).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equal ones that with the least start, then period), and hashes of all runs and of the kept words."""
    best = F.element_at(F.array_sort("runs", lambda a, b: F.when(a["length"] > b["length"], -1).when(a["length"] < b["length"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.when(a["period"] < b["period"], -1).otherwise(1))), 1)
    best = F.when(F.size("runs") > 0, best)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
