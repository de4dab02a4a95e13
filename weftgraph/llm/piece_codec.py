"""SentencePiece BPE without its library at run time: encoding by a prefix table, and decoding.

For each prefix of a chunk there is one token that its encoding ends with. The table of
these last tokens is filled from left to right: an automaton yields the pieces that end
at a position, and the one that is compatible with the last token of what stands before
it is the prefix's. The ids are then recovered backwards from the whole chunk's last
token. Two tokens are compatible if merging, undone step by step at their border, never
shows a pair that would have been merged earlier.

No piece holds a space mark after another character, so a text falls apart before each
space mark that follows something else; chunks are encoded apart from each other, and a
bounded cache keeps those met before.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks in each of the two generations of a task's cache; the older one goes when the newer is full.
CACHE = 300_000
NORMAL, BYTE = 1, 6


class PieceCodec:
    """Encodes and decodes as the library does with a BPE model with identity normalisation and byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.piece = {i: pieces[i] for i in normal}
        self.ids = {pieces[i]: i for i in normal}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model needs byte fallback and pieces with space marks in front only")
        #: Lower merges earlier. Equal scores: the border test can't order them, see _tied.
        self.rank = {i: -model.get_score(i) for i in normal}
        self.single = {p for p in self.ids if len(p) == 1}
        scores: dict[float, int] = {}
        for i in normal:
            if len(self.piece[i]) > 1:
                scores[self.rank[i]] = scores.get(self.rank[i], 0) + 1
        tied = {self.piece[i] for i in normal if len(self.piece[i]) > 1 and scores[self.rank[i]] > 1}
        self._tied = re.compile("|".join(map(re.escape, sorted(tied, key=len)))) if tied else None
        self.split: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1:
                self.split[i] = None
            else:
                parts = self._merge(p)
                if len(parts) != 1:
                    continue  # merging never makes it
                self.split[i] = self._last_merge
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = {i: len(p) for i, p in self.piece.items()}
        self.side = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.spelt = {i: p.replace(MARK, " ") for i, p in self.piece.items()}
        self.decimal = [str(i) for i in range(n)]
        self.value = {i: b for b, i in self.bytes.items()}
        self._strange = re.compile("[^" + "".join(map(re.escape, sorted(self.single))) + "]+")
        line = "" if "\n" in self.single else "\n"  # never part of a piece: a border too
        self._chunk = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + "|\n" * bool(line))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def _merge(self, chunk: str) -> list[str]:
        """The encoding by its definition: the best pair first, the leftmost of equal ones."""
        parts: list[str | None] = list(chunk)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (both := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (self.rank[both], i, parts[i], parts[j]))

        for i in range(len(parts)):
            push(i)
        self._last_merge = None
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            self._last_merge = (self.ids[left], self.ids[right]) if left in self.ids and right in self.ids else None
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            push(i)
            push(before[i])
        return [p for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether an encoding can hold these two tokens side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        """Undo merges at the border, the latest first; a pair that merges before the undone one refutes it."""
        undone: tuple[float, int] = (float("inf"), 0)  # rank of the merge undone last; 0: it lies left, so it wins ties
        while True:
            both = self.ids.get(self.piece[left] + self.piece[right])
            # at equal rank the leftmost merges first: the border pair stands left of what the right token merges
            if both is not None and (self.rank[both], 1) < undone:
                return False
            a, b = self.split[left], self.split[right]
            if a is None and b is None:
                return True
            at_left = self.rank[left] if a else float("-inf")
            at_right = self.rank[right] if b else float("-inf")
            if b is None or (a is not None and at_left > at_right):
                undone, left = (at_left, 0), a[1]
            else:
                undone, right = (at_right, 2), b[0]

    def tokens(self, chunk: str) -> list[int]:
        """Ids of a chunk."""
        if self._tied and self._tied.search(chunk):
            return [i for p in self._merge(chunk) for i in self._known(p)]
        if not self._strange.search(chunk):
            return self._prefix_table(chunk)
        out: list[int] = []
        at = 0
        for strange in self._strange.finditer(chunk):
            out += self._prefix_table(chunk[at : strange.start()])
            out += [self.bytes[b] for b in strange.group().encode()]
            at = strange.end()
        return out + self._prefix_table(chunk[at:])

    def _prefix_table(self, chunk: str) -> list[int]:
        """Ids of a chunk all of whose characters are pieces; last[n] is the last token of its first n characters."""
        last = [0] * (len(chunk) + 1)
        known, size = self.pairs.get, self.size
        for end, token in self.automaton.iter(chunk):
            if last[end + 1]:
                continue
            start = end + 1 - size[token]
            if start:
                pair = (last[start], token)
                fits = known(pair)
                if fits is None:
                    fits = self.compatible(*pair)
                if not fits:
                    continue
            last[end + 1] = token
        out = []
        end = len(chunk)
        while end:
            token = last[end]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _known(self, part: str) -> list[int]:
        found = self.ids.get(part)
        return [found] if found is not None else [self.bytes[b] for b in part.encode()]

    def _spell(self, ids: list[int]) -> str:
        """What a run of ids stands for, byte runs as UTF-8."""
        if (texts := [self.spelt.get(i) for i in ids]) and None not in texts:
            return "".join(texts)
        out, run = [], bytearray()
        for i in ids:
            if i in self.piece:
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.piece[i].replace(MARK, " "))
            else:
                run.append(self.value[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; the space before the first word goes."""
        return self._spell(ids).removeprefix(" ")

    def _lookup(self, chunk: str) -> tuple[str, str]:
        """Cached encoding of a chunk. If no piece holds its last two characters side by side, it falls apart there."""
        found = self.older.get(chunk)
        if found is None and chunk[-2:] not in self.side and 1 < len(chunk) < 64:
            parts = [self.cache.get(c) or self._lookup(c) for c in (chunk[:-1], chunk[-1])]
            found = (parts[0][0] + "," + parts[1][0], parts[0][1] + parts[1][1])
        elif found is None:
            ids = self.tokens(chunk)
            found = (",".join([self.decimal[i] for i in ids]), self._spell(ids))
        if len(self.cache) >= CACHE:
            self.older, self.cache = self.cache, {}
        self.cache[chunk] = found
        return found

    def both(self, text: str) -> tuple[str, str]:
        """(ids as decimals joined by commas, the decoded text)."""
        if not text:
            return "", ""
        get, new = self.cache.get, self._lookup
        found = [get(c) or new(c) for c in self._chunk.findall(MARK + text.replace(" ", MARK))]
        return ",".join([f[0] for f in found]), "".join([f[1] for f in found]).removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        joined = self.both(text)[0]
        return [int(i) for i in joined.split(",")] if joined else []


@lru_cache(maxsize=1)
def public_pieces() -> PieceCodec:
    """The codec of the public model; a worker makes it once and keeps its cache from task to task."""
    import public_tokenizers

    return PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))


def encode_documents(
    docs: DataFrame, codec: Callable[[], PieceCodec] = public_pieces, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids (decimals joined by commas), decoded of every row.

    Null texts count as empty: no tokens, an empty decoded text. Repeated rows are encoded
    each, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.iloc[first : first + 500]
                done = [own.both(t or "") for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "n_tokens": [ids.count(",") + 1 if ids else 0 for ids, _ in done],
                        "ids": [ids for ids, _ in done],
                        "decoded": [text for _, text in done],
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids string, decoded string")
