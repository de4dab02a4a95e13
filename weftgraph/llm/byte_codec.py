"""Byte-level BPE encoding and decoding by a file of ranks, of long texts in overlapping chunks.

A text is a sequence of pre-tokens, the matches of a pattern, each of which is merged by
itself: the pair of lowest rank first, the leftmost of equal ones. The pattern looks ahead
only, so where a pre-token begins, all that follows is decided by the text from there on.

Texts of more than one chunk are cut into chunks that overlap, dealt to all tasks and
pre-tokenised each from its own start, which may lie inside a pre-token. The first place
in an overlap where pre-tokens of both chunks begin is where they resynchronise: the
earlier chunk's pre-tokens count before it, the later one's from there on. The pieces
between two such places are encoded apart, and a document's ids are put together again.
A document with an overlap in which nothing coincides (a pre-token longer than the
overlap) is pre-tokenised whole.

Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, saved

#: Code points of a chunk, without what it shares with the next one; and of what they share.
STRIDE, OVERLAP = 32_768, 1_024
#: How far before its end a chunk's own pre-tokens are certain: the longest of the pattern's contractions.
MARGIN = 3
#: Pre-tokens in each of the two generations of a worker's cache; the older one goes when the newer is full.
CACHE = 300_000
#: Longer pre-tokens (in bytes) are merged with a queue, and are not kept in the cache.
SHORT = 64


class ByteCodec:
    """Encodes and decodes as the tiktoken library does with these ranks, this pattern and no special tokens."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("each byte needs a rank of its own")
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Letters and numbers of a later Unicode than the library's: a text that has one takes the other pattern.
        newer = {kind: _newer(kind, self._merge_table) for kind in "LN"}
        self.odd = regex.compile("[" + "".join(newer.values()) + "]") if any(newer.values()) else None
        for kind, chars in newer.items():
            if chars:
                pattern = pattern.replace(rf"[^\s\p{{L}}\p{{N}}]", rf"[[^\s\p{{L}}\p{{N}}]||[{''.join(newer.values())}]]")
                pattern = pattern.replace(rf"\p{{{kind}}}+", rf"[\p{{{kind}}}--[{chars}]]+")
        self.careful = regex.compile(pattern, regex.V1)
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    @property
    def _merge_table(self) -> dict[bytes, int]:
        return {bytes([b]): self.ranks[bytes([b])] for b in range(256)}

    def rule(self, text: str):
        """The compiled pattern that cuts this text as the library does."""
        return self.careful if self.odd is not None and not text.isascii() and self.odd.search(text) else self.pattern

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._by_scan(piece) if len(piece) <= SHORT else self._by_queue(piece)

    def _by_scan(self, piece: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while pairs:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1])
        return [self.ranks[p] for p in parts]

    def _by_queue(self, piece: bytes) -> list[int]:
        """As by scans; entries of the queue whose pair is gone are passed over."""
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0: none begins here
        before = list(range(-1, n))  # where the part before it begins
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n:
                stop = end[end[i]]
                r = self.ranks.get(piece[i:stop])
                if r is not None:
                    heapq.heappush(queue, (r, i, end[i], stop))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, middle, stop = heapq.heappop(queue)
            if end[i] != middle or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            before[stop] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _lookup(self, word: str) -> tuple[str, bytes]:
        """Ids of a pre-token as decimals joined by commas, and the bytes they stand for."""
        found = self.older.get(word)
        if found is None:
            ids = self.merged(word.encode())
            found = (",".join(map(str, ids)), self.decode(ids))
            if len(word) > SHORT:
                return found
        if len(self.cache) >= CACHE:
            self.older, self.cache = self.cache, {}
        self.cache[word] = found
        return found

    def joined(self, words: list[str]) -> tuple[str, bytes]:
        """Ids of pre-tokens, and the bytes they stand for."""
        get, new = self.cache.get, self._lookup
        found = [get(w) or new(w) for w in words]
        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def both(self, text: str) -> tuple[str, bytes]:
        return self.joined(self.rule(text).findall(text))

    def encode(self, text: str) -> list[int]:
        ids = self.both(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def starts(self, text: str) -> list[int]:
        """Where pre-tokens begin."""
        return [m.start() for m in self.rule(text).finditer(text)]


def _newer(kind: str, byte_ranks: dict[bytes, int]) -> str:
    """Ranges of characters that `regex` counts as of this category and the library does not.

    Only those can differ that the Unicode tables of `regex` and of Python class apart; of
    these the library tells by whether it cuts one off from another of the kind.
    """
    import regex
    import tiktoken

    known = "aL" if kind == "L" else "1N"
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    apart = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c)[0] != kind]
    if not apart:
        return ""
    ranks = dict(byte_ranks)
    for c in apart:
        ranks[(known[0] + c).encode()] = 256 + len(ranks)
    library = tiktoken.Encoding("categories", pat_str=rf"\p{{{kind}}}+|.", mergeable_ranks=_dense(ranks), special_tokens={})
    ranges: list[list[str]] = []
    for c in apart:
        if len(library.encode_ordinary(known[0] + c)) > 1:
            if ranges and ord(ranges[-1][1]) == ord(c) - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"{regex.escape(a)}-{regex.escape(b)}" for a, b in ranges)


def _dense(ranks: dict[bytes, int]) -> dict[bytes, int]:
    return {b: i for i, b in enumerate(sorted(ranks, key=ranks.get))}


@lru_cache(maxsize=1)
def public_bytes() -> ByteCodec:
    """The codec of the public ranks; a worker makes it once and keeps its cache from task to task."""
    import public_tokenizers

    return ByteCodec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_DONE = "n_tokens long, ids string, decoded binary"


def _count(ids: str) -> int:
    return ids.count(",") + 1 if ids else 0


def encode_documents(
    docs: DataFrame, codec: Callable[[], ByteCodec] = public_bytes, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_tokens, ids (decimals joined by commas), decoded (bytes) of every row.

    Null texts count as empty: no tokens, no bytes. Repeated rows and ids are encoded each, an
    empty table gives no rows, other columns are ignored. Very long texts are encoded whole,
    in chunks of `stride` code points that share `overlap` with the next.
    """
    if not MARGIN < overlap <= stride:
        raise ValueError("chunks have to overlap by more than the margin, and by no more than they advance")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) > stride + overlap

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.iloc[first : first + 500]
                done = [own.both(t or "") for t in part["text"]]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].array, "n_tokens": [_count(i) for i, _ in done], "ids": [i for i, _ in done], "decoded": [b for _, b in done]}
                )
            give_back()

    short = rows.filter(~long).mapInPandas(whole, f"doc_id long, {_DONE}")
    return short.unionByName(_in_chunks(rows.filter(long), codec, stride, overlap))


def _in_chunks(rows: DataFrame, codec: Callable[[], ByteCodec], stride: int, overlap: int) -> DataFrame:
    """Rows of more than one chunk, whose chunks are pre-tokenised apart, stitched and encoded piece by piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, text in zip(batch["_row"], batch["doc_id"], batch["text"], strict=True):
                n = -(-(len(text) - overlap) // stride)
                for k in range(n):
                    window = text[k * stride : (k + 1) * stride + overlap]
                    yield pd.DataFrame({"_row": [row], "doc_id": pd.array([doc_id], "Int64"), "k": [k], "last": [k == n - 1], "text": [window]})

    def pre_tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for batch in batches:
            found = [own.starts(t) for t in batch["text"]]
            certain = [s if last else s[: bisect_left(s, len(t) - MARGIN)] for s, t, last in zip(found, batch["text"], batch["last"], strict=True)]
            head = [s[: bisect_left(s, overlap)] for s in certain]  # of the overlap with the chunk before
            tail = [[i - stride for i in s[bisect_left(s, stride) :] if i < stride + overlap] for s in certain]  # with the next
            yield batch.assign(starts=certain, head=head, tail=tail)

    pieces = rows.withColumn("_row", F.monotonically_increasing_id()).mapInPandas(cut, "_row long, doc_id long, k int, last boolean, text string")
    spread = pieces.repartition(F.col("_row"), F.col("k"))
    chunks = saved(spread.mapInPandas(pre_tokenise, "_row long, doc_id long, k int, last boolean, text string, starts array<int>, head array<int>, tail array<int>"), "chunks")
    in_doc = Window.partitionBy("_row").orderBy("k")
    met = F.array_min(F.array_intersect(F.lag("tail").over(in_doc), F.col("head")))
    stitched = chunks.select("_row", "k", "last", "head", "tail").withColumn("lo", F.when(F.col("k") == 0, 0).otherwise(met))
    stitched = stitched.withColumn("hi", F.lead("lo").over(in_doc) + stride)
    torn = F.max(F.col("lo").isNull()).over(Window.partitionBy("_row"))
    stitched = stitched.select("_row", "k", "lo", "hi", torn.alias("torn"))
    parts = chunks.select("_row", "doc_id", "k", "last", "text", "starts").join(stitched, ["_row", "k"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec()
        for batch in batches:
            done = []
            for text, starts, lo, hi in zip(batch["text"], batch["starts"], batch["lo"], batch["hi"], strict=True):
                stop = len(text) if pd.isna(hi) else int(hi)
                at = [int(s) for s in starts[bisect_left(starts, lo) :] if s < stop] + [stop]
                done.append(own.joined([text[a:b] for a, b in zip(at, at[1:], strict=False)]))
            yield pd.DataFrame({"_row": batch["_row"], "doc_id": batch["doc_id"].astype("Int64"), "k": batch["k"], "ids": [i for i, _ in done], "decoded": [b for _, b in done]})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        ids = ",".join([i for i in group["ids"] if i])
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64").iloc[:1], "n_tokens": [_count(ids)], "ids": [ids], "decoded": [b"".join(group["decoded"])]})

    def at_once(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values("k")["text"].tolist()
        ids, decoded = codec().both("".join([t[:stride] for t in texts[:-1]] + texts[-1:]))
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64").iloc[:1], "n_tokens": [_count(ids)], "ids": [ids], "decoded": [decoded]})

    encoded = parts.filter(~F.col("torn")).select("_row", "doc_id", "k", "text", "starts", "lo", "hi").mapInPandas(encode, "_row long, doc_id long, k int, ids string, decoded binary")
    stitched_docs = encoded.groupBy("_row").applyInPandas(together, f"doc_id long, {_DONE}")
    torn_docs = parts.filter("torn").select("_row", "doc_id", "k", "text").groupBy("_row").applyInPandas(at_once, f"doc_id long, {_DONE}")
    return stitched_docs.unionByName(torn_docs)
