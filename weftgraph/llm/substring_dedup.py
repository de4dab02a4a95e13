"""Removal of byte strings that an earlier document has, by minimizers and hashed names, not by ranks.

Positions get names for growing prefixes: the name of 2k bytes is made of the pair of
names of k bytes at a position and k further on, and the last step overlaps. Spark deals
the named positions to key ranges, each task sorts its range, and positions whose name
turns out unique are dropped before the prefix grows on. (README gives the figures of
prefix doubling over ranks of all positions, in whose stead this is.)

1. At GRAM bytes only sampled positions are ranked: those with the least name in some
   window of a LENGTH-byte string, so that each such string holds one, and equal strings
   the same least one. A string whose least one is unique is unique.
2. At LENGTH bytes, past the threshold, all positions that are left are ranked, and of
   each name the least document is found.

Names are 64 bits, and the key range of a long name comes from a second one, so that strings
are taken for equal only if both agree so far. Names travel packed: a
row holds a batch's distinct names for one range, and what comes back is one bit for each.
Whole copies of an earlier text are set apart before.

Texts are written once into a table bucketed by batch, which no later step shuffles.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from .common import give_back, release_shuffles, saved, table_path

LENGTH = 50
GRAM = 19
#: Bytes of text in a batch (a longer document is a batch of its own), and of text per key range.
BATCH, RANGE = 2 << 20, 8 << 20
#: Tasks that the copies of one text are dealt to.
SALTS = 32
#: Positions named at once.
SLICE = 1 << 17

_WINDOW = LENGTH - GRAM + 1
#: What a row counts for in a batch besides its bytes, so that empty texts fill batches too.
_ROW = 64
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
# the names of single bytes
_ONE = (np.arange(1, 257, dtype=np.uint64) * _M1) ^ ((np.arange(1, 257, dtype=np.uint64) * _M2) >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    x = a * _M1
    x ^= x >> np.uint64(32)
    x += b
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def _names(data: np.ndarray, first: int, last: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the `length`-byte strings that start at positions first..last - 1, and second, independent names.

    Beyond the data's end stand zeros. The length must not be a power of two.
    """
    part = data[first : last + length - 1]
    if len(part) < last - first + length - 1:
        part = np.concatenate([part, np.zeros(last - first + length - 1 - len(part), dtype=np.uint8)])
    name, size = _ONE[part], 1
    while 2 * size <= length:
        name, size = _pair(name[: len(name) - size], name[size:]), 2 * size
    n, step = last - first, length - size
    left, right = name[:n], name[step : step + n]
    return _pair(left, right), _pair(right ^ _M3, left)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width]."""
    size = 1
    while 2 * size <= width:
        values, size = pick(values[: len(values) - size], values[size:]), 2 * size
    step = width - size
    return pick(values[: len(values) - step], values[step:]) if step else values


def _sampled(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sampled grams, ascending, and their names. starts: whether a whole string starts there."""
    where, names = [], []
    n = len(data)
    for first in range(0, n, SLICE):
        last = min(n, first + SLICE)
        low = max(0, first - _WINDOW + 1)
        gram, _ = _names(data, low, last + _WINDOW - 1, GRAM)
        least = _sliding(gram, _WINDOW, np.minimum)  # of the string at low, low + 1, ...
        least = np.where(starts[low:last], least[: last - low], np.uint64(0))
        ahead = np.concatenate([np.zeros(_WINDOW - 1 - (first - low), dtype=np.uint64), least])
        chosen = np.flatnonzero(_sliding(ahead, _WINDOW, np.maximum) == gram[first - low : last - low])
        where.append(chosen + first)
        names.append(gram[first - low : last - low][chosen])
    return (np.concatenate(where), np.concatenate(names)) if where else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    x = names * _M3
    return ((x >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)


class _Batch:
    """A batch's documents laid end to end, copies and texts shorter than a string left out."""

    def __init__(self, table: pa.Table, copies: set[int]):
        table = table.sort_by("at")
        self.table = table
        self.at = table.column("at").to_pylist()
        self.ids = table.column("doc_id").to_pylist()
        self.texts = [t or b"" for t in table.column("bytes").to_pylist()]
        self.copies = copies
        self.used = [i for i, t in enumerate(self.texts) if len(t) >= LENGTH and self.at[i] not in copies and self.ids[i] is not None]
        self.used.sort(key=lambda i: self.ids[i])
        self.size = np.array([len(self.texts[i]) for i in self.used], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join([self.texts[i] for i in self.used]), dtype=np.uint8)
        self.starts = np.zeros(len(self.data), dtype=bool)
        for b, n in zip(self.begin, self.size, strict=True):
            self.starts[b : b + n - LENGTH + 1] = True

    def sampled(self):
        self.where, self.gram = _sampled(self.data, self.starts)

    def narrow(self, twice: np.ndarray) -> None:
        """Drop the strings whose least gram isn't found twice.

        A string's least gram is sampled, so it is also the least of the sampled ones.
        """
        most = np.uint64(0xFFFFFFFFFFFFFFFF)
        for first in range(0, len(self.data), SLICE):
            last = min(len(self.data), first + SLICE)
            a, b = np.searchsorted(self.where, [first, last + _WINDOW - 1])
            every = np.full(last - first + _WINDOW - 1, most, dtype=np.uint64)
            left = every.copy()
            at, name, again = self.where[a:b] - first, self.gram[a:b], twice[a:b]
            every[at] = name
            left[at[again]] = name[again]
            self.starts[first:last] &= _sliding(every, _WINDOW, np.minimum) == _sliding(left, _WINDOW, np.minimum)

    def long_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions that are left, and both their names at LENGTH."""
        where, names, second = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for first in range(0, len(self.data), SLICE):
            own = np.flatnonzero(self.starts[first : first + SLICE])
            if len(own):
                a, b = _names(self.data, first, first + int(own[-1]) + 1, LENGTH)
                where.append(own + first)
                names.append(a[own])
                second.append(b[own])
        return np.concatenate(where), np.concatenate(names), np.concatenate(second)

    def owner(self, where: np.ndarray) -> np.ndarray:
        """Index into used of the document that a position lies in."""
        return np.searchsorted(self.begin, where, side="right") - 1


def _grams_of(batch: _Batch, ranges: int):
    """Distinct sampled names in order of range and name, their counts, and the inverse."""
    names, inverse, counts = np.unique(batch.gram, return_inverse=True, return_counts=True)
    to = _range_of(names, ranges)
    order = np.argsort(to, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return names[order], counts[order], to[order], back[inverse]


def _strings_of(batch: _Batch, ranges: int):
    """As _grams_of for the long names, in order of range, least document here, and name."""
    where, names, second = batch.long_names()
    distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)  # first: positions ascend with documents
    owner = batch.owner(where[first])
    to = _range_of(second[first], ranges)
    order = np.lexsort((distinct, owner, to))
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return where, distinct[order], owner[order], to[order], back[inverse]


def _parts(to: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(to[a]), slice(int(a), int(b))


_TOLD = pa.schema([("batch", pa.int64()), ("range", pa.int64()), ("data", pa.binary())])


def _bits(side: pa.Table, kind: int) -> np.ndarray:
    """The answers of all ranges to a batch's names, in the order they were asked."""
    own = side.filter(pc.equal(side.column("kind"), kind)).sort_by("range")
    return np.concatenate([np.zeros(0, bool), *[_unpack(d) for d in own.column("data").to_pylist()]])


def _pack(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=n).astype(bool)


_COPIES, _GRAMS, _STRINGS = 0, 1, 2


def _open(docs: pa.Table, side: pa.Table) -> _Batch:
    copies = side.filter(pc.equal(side.column("kind"), _COPIES)).column("data").to_pylist()
    return _Batch(docs, {int(x) for c in copies for x in c.split(b",")})


def _ask_grams(ranges: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _TOLD.empty_table()
        batch = _open(docs, side)
        batch.sampled()
        names, counts, to, _ = _grams_of(batch, ranges)
        told = (names & ~np.uint64(1)) | (counts > 1)
        rows = [(r, told[s].tobytes()) for r, s in _parts(to)]
        return _told(docs, rows)

    return run


def _told(docs: pa.Table, rows: list[tuple[int, bytes]]) -> pa.Table:
    number = docs.column("batch")[0].as_py()
    return pa.table([pa.array([number] * len(rows), pa.int64()), pa.array([r for r, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], schema=_TOLD)


def _answer_grams(asked: pa.Table) -> pa.Table:
    """For each batch, which of its grams are found twice: in another batch too, or already there."""
    parts = [np.frombuffer(d, dtype=np.uint64) for d in asked.column("data").to_pylist()]
    every = np.sort(np.concatenate(parts))
    name = every >> np.uint64(1)
    twice = np.unique(np.concatenate([name[1:][name[1:] == name[:-1]], name[(every & np.uint64(1)).astype(bool)]]))
    out = []
    for p in parts:
        at = np.searchsorted(twice, p >> np.uint64(1))
        at[at == len(twice)] = 0
        out.append(_pack(twice[at] == p >> np.uint64(1) if len(twice) else np.zeros(len(p), bool)))
    return pa.table([asked.column("batch"), asked.column("range"), pa.array(out, pa.binary())], schema=_TOLD)


def _narrowed(docs: pa.Table, side: pa.Table, ranges: int) -> _Batch:
    batch = _open(docs, side)
    batch.sampled()
    _, _, _, back = _grams_of(batch, ranges)
    batch.narrow(_bits(side, _GRAMS)[back])
    return batch


def _ask_strings(ranges: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _TOLD.empty_table()
        batch = _narrowed(docs, side, ranges)
        _, names, owner, to, _ = _strings_of(batch, ranges)
        ids = np.array([batch.ids[i] for i in batch.used], dtype=np.int64)
        rows = []
        for r, s in _parts(to):
            whose, many = np.unique(owner[s], return_counts=True)
            head = np.array([len(whose)], dtype="<i8").tobytes() + ids[whose].tobytes() + many.astype("<i4").tobytes()
            rows.append((r, head + names[s].tobytes()))
        return _told(docs, rows)

    return run


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(least document of each name, names) of a packed row."""
    n = int.from_bytes(data[:8], "little")
    ids = np.frombuffer(data, np.int64, n, 8)
    many = np.frombuffer(data, "<i4", n, 8 + 8 * n)
    return np.repeat(ids, many), np.frombuffer(data[8 + 12 * n :], np.uint64)


def _answer_strings(asked: pa.Table) -> pa.Table:
    """For each batch, which of its names an earlier document of another batch has."""
    parts = [_read(d) for d in asked.column("data").to_pylist()]
    ids, names = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.minimum.reduceat(ids[order], edges)
    run = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    earlier = np.empty(len(ids), dtype=bool)
    earlier[order] = least[run] < ids[order]
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return pa.table([asked.column("batch"), asked.column("range"), pa.array([_pack(e) for e in np.split(earlier, cuts)], pa.binary())], schema=_TOLD)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_KINDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _remove(ranges: int, with_text: bool):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        batch = _narrowed(docs, side, ranges)
        where, names, owner, _, back = _strings_of(batch, ranges)
        # earlier elsewhere: all of them go; else those after the batch's own least document
        ids = np.array([batch.ids[i] for i in batch.used], dtype=np.int64)
        earlier = _bits(side, _STRINGS)
        gone = earlier[back] | (ids[batch.owner(where)] > ids[owner[back]]) if len(where) else np.zeros(0, bool)
        edge = np.zeros(len(batch.data) + 1, dtype=np.int32)
        np.add.at(edge, where[gone], 1)
        np.add.at(edge, where[gone] + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        place = {i: k for k, i in enumerate(batch.used)}
        out: list[tuple] = []
        texts: list[str] = []
        for i, text in enumerate(batch.texts):
            kept, removed, spans = text, 0, 0
            if batch.at[i] in batch.copies and len(text) >= LENGTH:
                kept, removed, spans = b"", len(text), 1
            elif i in place:
                b, n = batch.begin[place[i]], batch.size[place[i]]
                own = covered[b : b + n]
                removed = int(own.sum())
                if removed:
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                    kept = batch.data[b : b + n][~own].tobytes()
            out.append((batch.ids[i], len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
            if with_text:
                texts.append(kept.decode("utf-8", "ignore"))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in _KINDS]
        table = pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, _KINDS, strict=True)})
        if with_text:
            table = table.append_column("kept", pa.array(texts, pa.string())).append_column("rest", batch.table.column("rest"))
        return table

    return run


def _batched(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """batch, at (its number there), doc_id, bytes, rest (the carried columns), digest, n_bytes: the bucketed table of all rows."""
    limit = BATCH

    def number(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        batch, at, full = 0, 0, 0
        for sizes in batches:
            to, place = [], []
            for n in sizes.tolist():
                n += _ROW
                if full and full + n > limit:
                    batch, at, full = batch + at, 0, 0
                to.append(task + batch)
                place.append(at)
                at, full = at + 1, full + n
            yield pd.DataFrame({"batch": to, "at": place})

    numbered = F.pandas_udf(number, "batch long, at int").asNondeterministic()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("bytes"), F.struct(F.lit(0).cast("byte").alias("_none"), *carried).alias("rest"))
    rows = rows.withColumn("n_bytes", F.octet_length("bytes").cast("long")).withColumn("_to", numbered("n_bytes"))
    rows = rows.select("_to.batch", "_to.at", "doc_id", "bytes", "rest", "n_bytes", F.unhex(F.sha2("bytes", 256)).alias("digest"))
    spark = docs.sparkSession
    name = f"substring_batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "batch").sortBy("batch").option("compression", "zstd").option("path", table_path(spark, "batches")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and go with the shared folder's other tables; the catalog only had to know the buckets
    return table


def _run(docs: DataFrame, id_col: str, text_col: str, carried: list[str], with_text: bool) -> DataFrame:
    table = _batched(docs, id_col, text_col, carried)
    spark = docs.sparkSession
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(1, -(-total // RANGE))
    heads = table.select("batch", "at", "doc_id", "digest")
    # texts that occur once need no join, and one that is everywhere is dealt to SALTS tasks
    first = heads.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("batch", "at"), F.lit(SALTS)).cast("int")
    copies = heads.withColumn("salt", salt).join(first, ["digest", "salt"]).filter("doc_id > first")
    packed = copies.groupBy("batch").agg(F.collect_list("at").alias("ats"))  # numbers within one batch: bounded
    data = F.array_join(F.col("ats").cast("array<string>"), ",").cast("binary")
    side = saved(packed.select("batch", F.lit(_COPIES).alias("kind"), F.lit(0).cast("long").alias("range"), data.alias("data")), "copies")

    def each(known: DataFrame, columns: list[str], ask, schema) -> DataFrame:
        def function(docs: pa.Table, side: pa.Table) -> pa.Table:
            out = ask(docs, side)
            give_back()
            return out

        return table.select(*columns).groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(function, schema)

    told, plain = "batch long, range long, data binary", ["batch", "at", "doc_id", "bytes"]

    def round_of(known: DataFrame, kind: int, ask, answer) -> DataFrame:
        answered = saved(each(known, plain, ask(ranges), told).groupBy("range").applyInArrow(answer, told), "answers")
        release_shuffles(spark)  # they go before the next round's come
        return known.unionByName(answered.select("batch", F.lit(kind).alias("kind"), "range", "data"))

    side = round_of(side, _GRAMS, _ask_grams, _answer_grams)
    side = round_of(side, _STRINGS, _ask_strings, _answer_strings)
    if not with_text:
        return each(side, plain, _remove(ranges, False), _RESULT)
    schema = StructType([*DataType.fromDDL(_RESULT).fields, StructField("kept", StringType()), table.schema["rest"]])
    return each(side, [*plain, "rest"], _remove(ranges, True), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) of every row.

    A byte goes if it lies in a LENGTH-byte string of its text that also starts in a
    document of smaller id. Texts shorter than that, null and empty ones lose nothing.
    Rows of one id take nothing from each other; a row without an id neither loses bytes
    nor makes others lose any. An empty table gives no rows; other columns are ignored.
    """
    return _run(docs, id_col, text_col, [], False)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each text without what remove_repeats removes.

    Every row stays, its text empty if nothing is left; bytes of a character that a removed
    string cuts go too. A null text becomes an empty one.
    """
    carried = [c for c in docs.columns if c not in (id_col, text_col)]
    done = _run(docs, id_col, text_col, carried, True)
    own = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("kept")}
    return done.select(*[own[c].alias(c) if c in own else F.col("rest")[c].alias(c) for c in docs.columns])


#: The query's rows as DuckDB SQL, for documents of distinct ids: every 50-byte string is looked up, and covered runs are cut out.
SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b, strlen(coalesce(text, '')) as n from documents),
k as (select doc_id, i, array_slice(b, i + 1, i + 50) as g from (select doc_id, b, unnest(range(0, n - 49)) as i from d where n >= 50)),
f as (select g, min(doc_id) as first_id from k group by g),
gone as (select doc_id, i from k join f on f.g = k.g where first_id < doc_id),
w as (select doc_id, i, coalesce(max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + 50, -1) as reach from gone),
s as (select doc_id, i, sum(case when i > reach then 1 else 0 end) over (partition by doc_id order by i) as span from w),
r as (select doc_id, span, min(i) as a, max(i) + 50 as z from s group by all),
t as (select doc_id, cast(sum(z - a) as bigint) as n_removed, count(*) as n_spans, max(z) as last_z from r group by 1),
p as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as x, a as y from r
  union all select d.doc_id, coalesce(last_z, 0), n from d left join t on t.doc_id = d.doc_id),
h as (select p.doc_id, string_agg(hex(array_slice(b, x + 1, y)), '' order by x) as kept from p join d on d.doc_id = p.doc_id where y > x group by 1)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join t on t.doc_id = d.doc_id left join h on h.doc_id = d.doc_id
"""
