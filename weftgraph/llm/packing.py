"""Hierarchical multi-length packing of token streams.

Each task routes the rest that a document leaves after its full windows to one of
several context-size tiers (the smallest power of two that holds it), packs each tier
into windows of its size, fills the gaps of the long windows from shorter tiers, and
deals the sequences to step groups, balanced by tokens and by lengths. What is left at a
task's end goes into sequences whose lengths are powers of two. Nothing is padded.

A task packs what it reads: no shuffle, and no more in memory than one batch and the
open tails.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

WINDOW = 2048
#: Tiers below the window; a tail belongs to the smallest that holds it.
TIERS = (64, 128, 256, 512, 1024, 2048)
#: Id that ends every document.
END = 1
#: Windows of one training step.
STEP_WINDOWS = 16
#: Tails, or full windows, that a task gathers before it packs and groups them.
POOL = 20_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[list[str]], list[list[int]]]:
    """A batch encoder that gives the ids of the `tokenizers` file at json_path.

    The same vocabulary as ranks is encoded several times faster; texts that hold the
    special token's string, which `tokenizers` maps to its id, go through `tokenizers`.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            whole.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t)
            for t in texts
        ]

    return encode


@lru_cache(maxsize=1)
def public_byte_bpe() -> Callable[[list[str]], list[list[int]]]:
    import public_tokenizers

    return byte_bpe(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


def split_powers(n: int, smallest: int = 1) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1 and 1 << b >= smallest]


@dataclass
class Packer:
    """Packs the documents of one task. `emit` gets (sequence, tier) with a sequence as a list of pieces."""

    window: int
    tiers: tuple[int, ...]
    emit: Callable[[list[Piece], int], None]
    tails: dict[int, list[Piece]] = field(default_factory=dict)  # by length
    waiting: int = 0

    def __post_init__(self) -> None:
        self.have = np.zeros(self.window + 1, dtype=bool)  # lengths that some tail has
        self.above = dict(zip(self.tiers, (0, *self.tiers), strict=False))  # a tier's tails are longer than this

    def tier_of(self, n: int) -> int:
        """The smallest tier that holds so many tokens."""
        return next(t for t in self.tiers if t >= n)

    def add(self, doc, ids: np.ndarray) -> None:
        """Emit a document's full windows, and route its tail to a tier."""
        n = len(ids)
        full = n - n % self.window
        for at in range(0, full, self.window):
            self.emit([Piece(doc, at, ids[at : at + self.window], n)], self.window)
        if full < n:
            self._route(Piece(doc, full, ids[full:], n))

    def _route(self, tail: Piece) -> None:
        self.tails.setdefault(len(tail.ids), []).append(tail)
        self.have[len(tail.ids)] = True
        self.waiting += 1

    def _take(self, tier: int, most: int, longest: bool = True) -> Piece | None:
        """The longest tail of a tier with at most so many tokens, or else its shortest with more."""
        low, high = self.above[tier] + 1, tier
        low, high = (low, min(high, most)) if longest else (max(low, most + 1), high)
        fit = self.have[low : high + 1]
        if not fit.any():
            return None
        n = high - int(fit[::-1].argmax()) if longest else low + int(fit.argmax())
        piece = self.tails[n].pop()
        self.have[n] = bool(self.tails[n])
        self.waiting -= 1
        return piece

    def flush(self, last: bool) -> None:
        """Pack tier by tier, the longest first: each of its tails opens a window of the tier's size.

        The window's gap is filled from the tiers that may hold tails short enough, longest
        tails first; what no whole tail fits is closed by cutting the shortest longer one, so
        that every sequence has exactly its tier's length. Without `last`, the tails of a
        window that can't be filled go back.
        """
        for tier in reversed(self.tiers):
            while (first := self._take(tier, tier)) is not None:
                row, room = [first], tier - len(first.ids)
                while room and (piece := self._filling(room)) is not None:
                    row.append(piece)
                    room -= len(piece.ids)
                if not room:
                    self.emit(row, tier)
                elif last:
                    self._leftover(row)
                else:
                    for piece in row:
                        self._route(piece)
                    return

    def _filling(self, room: int) -> Piece | None:
        shorter = [t for t in reversed(self.tiers) if t < 2 * room]
        for tier in shorter:
            if (piece := self._take(tier, room)) is not None:
                return piece
        for tier in self.tiers:
            if (piece := self._take(tier, room, longest=False)) is not None:
                self._route(Piece(piece.doc, piece.start + room, piece.ids[room:], piece.doc_tokens))
                return Piece(piece.doc, piece.start, piece.ids[:room], piece.doc_tokens)
        return None

    def _leftover(self, row: list[Piece]) -> None:
        """The task's last, partly filled window as sequences of power-of-two lengths."""
        for size in split_powers(sum(len(p.ids) for p in row)):
            part, room = [], size
            while room:
                p = row.pop(0)
                if len(p.ids) > room:
                    row.insert(0, Piece(p.doc, p.start + room, p.ids[room:], p.doc_tokens))
                    p = Piece(p.doc, p.start, p.ids[:room], p.doc_tokens)
                part.append(p)
                room -= len(p.ids)
            self.emit(part, self.tier_of(size))


def step_groups(sizes: list[int], group_tokens: int) -> list[int]:
    """A group for each sequence, so that groups have as equal tokens, and as equal a mix of sizes, as can be.

    There are as many groups as tokens make up; the longest sequences are dealt first, each
    to the group with the fewest tokens, of several to that with the fewest sequences.
    """
    groups = max(1, round(sum(sizes) / group_tokens))
    load = [(0, 0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, n, g = load[0]
        out[i] = g
        heapq.heapreplace(load, (held + sizes[i], n + 1, g))
    return out


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[list[int]]]] = public_byte_bpe,
    window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: SCHEMA.

    Null texts count as empty (their one piece is the end id); long texts are cut, whole;
    repeated rows, and tails of equal length, are packed each; an empty table gives no rows;
    other columns are ignored. A step group holds sequences worth some STEP_WINDOWS * window
    tokens and lies in one task, so that a task with fewer tokens has one smaller group. Ids
    of sequences and groups are unique: a task's number, then its own count.
    """
    if list(tiers) != sorted(tiers) or tiers[-1] != window or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be growing powers of two, the last one the window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple[list[tuple], int]] = []  # pieces of a sequence, and its tokens
        count = {"sequence": 0, "group": 0}
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]

        def emit(row: list[Piece], tier: int) -> None:
            number, at, pieces = task + count["sequence"], 0, []
            for p in row:
                n = len(p.ids)
                pieces.append((p.doc, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, number, at, tier))
                at += n
            held.append((pieces, at))
            count["sequence"] += 1

        def drain() -> pa.RecordBatch:
            groups = step_groups([n for _, n in held], STEP_WINDOWS * window)
            rows = [(*p, task + count["group"] + g) for (pieces, _), g in zip(held, groups, strict=True) for p in pieces]
            count["group"] += max(groups, default=-1) + 1
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        packer = Packer(window, tiers, emit)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids.append(end)
                    packer.add(doc, np.array(ids, dtype=np.uint32))
                if packer.waiting >= POOL or len(held) >= POOL:
                    packer.flush(last=False)
                    yield drain()
        packer.flush(last=True)
        yield drain()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
