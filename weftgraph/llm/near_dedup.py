"""Near-duplicates by SimHash, linked through the anchor points of a covering code.

The 64 bits are cut into PARTS; of two fingerprints with at most RADIUS differing bits, in
some part at most RADIUS // PARTS bits differ. In each part the anchors are the points of
a covering code: the [15, 11] Hamming code (every point within one bit of exactly one
codeword) times all values of the part's other bits. A fingerprint's home is its nearest
anchor; it is also sent to every anchor within covering radius plus threshold, so that it
meets the home of each fingerprint that it may be linked with. At an anchor, homes and
visitors are compared in blocks, and only a spanning forest of the links leaves it.

Anchors are a fixed number, so they get crowded as the table grows. A crowded anchor is
divided: the bits outside its part are cut into RADIUS + 1 fields, of which two linked
fingerprints share one, so that both come to the same point of that field. What is crowded
still (near copies of one text) is compared in a grid of cells, each with some of the homes
and some of the visitors. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import give_back, labelled, saved

BITS, RADIUS, PARTS, SHINGLE = 64, 4, 3, 4
SEED = 42
#: Bits of each part, the first CODE of them coded.
WIDTHS, CODE = (21, 21, 22), 15
#: Visitors of an anchor beyond which it is divided, and homes or visitors of one cell of what can't be divided any more.
HOT = 20_000
#: Side of a compared block.
BLOCK = 1024

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    counts = np.zeros(BITS, dtype=np.int64)
    for first in range(0, n, 1 << 16):
        spans = zip(starts[first : min(n, first + (1 << 16))].tolist(), ends[first : first + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    out = pd.Series([simhash(t) for t in texts], dtype="int64")
    give_back()
    return out


def _anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position in prints, is it its home) of all anchors that the fingerprints are sent to."""
    keys, owners, homes = [], [], []
    everyone = np.arange(len(prints))

    def send(part: int, point: np.ndarray, who: np.ndarray, home: bool) -> None:
        keys.append(point | np.int64(part) << np.int64(24))
        owners.append(who)
        homes.append(np.full(len(who), home))

    low = 0
    for part, width in enumerate(WIDTHS):
        own = (prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        low += width
        coded = own & ((1 << CODE) - 1)
        syndrome = np.zeros(len(own), dtype=np.int64)  # column of bit i: i + 1
        for i in range(CODE):
            syndrome ^= np.where(coded >> i & 1, i + 1, 0)
        flip = np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
        home = own ^ flip
        send(part, home, everyone, True)
        # one more bit in the coded part: two flips i, j with columns i ^ j = syndrome lead to a codeword two bits away
        off = np.flatnonzero(syndrome > 0)
        for i in range(1, CODE + 1):
            j = syndrome[off] ^ i
            pair = (i < j) & (j <= CODE)
            who = off[pair]
            send(part, own[who] ^ np.int64(1 << (i - 1)) ^ (np.int64(1) << (j[pair] - 1)), who, False)
        for i in range(CODE, width):  # one bit in the other part
            send(part, home ^ np.int64(1 << i), everyone, False)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(homes)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each value of the links (a, b) to the least value that it is connected with."""
    if not len(a):
        return a, b
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(values))
    return values[other], values[label[other]]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def _compare(homes: np.ndarray, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between an anchor's homes and visitors, in blocks."""
    found: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for i in range(0, len(homes), BLOCK):
        for j in range(0, len(visitors), BLOCK):
            h, v = homes[i : i + BLOCK], visitors[j : j + BLOCK]
            x, y = np.nonzero(_differing(h[:, None], v[None, :]) <= RADIUS)
            differ = h[x] != v[y]
            found = _forest(np.concatenate([found[0], h[x][differ]]), np.concatenate([found[1], v[y][differ]]))
    return found


def _at_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links at the meeting places of a task's rows, which come sorted by place."""
    carry: pd.DataFrame | None = None

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        place, prints, home = rows["place"].to_numpy(), rows["print"].to_numpy(), rows["home"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        out = []
        sizes = np.diff(edges)
        small = np.repeat(sizes <= 64, sizes)
        # small ones all at once: every home with every visitor of its own place
        at_home = np.flatnonzero(home & small)
        run = np.repeat(np.arange(len(sizes)), sizes)
        for part in np.array_split(at_home, max(1, len(at_home) // 50_000)):
            n = sizes[run[part]]
            x = np.repeat(part, n)
            y = np.repeat(edges[run[part]], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            near = (_differing(prints[x], prints[y]) <= RADIUS) & (prints[x] != prints[y])
            out.append((prints[x][near], prints[y][near]))
        for k in np.flatnonzero(sizes > 64):
            mine = slice(edges[k], edges[k + 1])
            out.append(_compare(prints[mine][home[mine]], prints[mine]))
        a, b = _forest(np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]))
        return pd.DataFrame({"a": a, "b": b})

    for batch in batches:
        if not len(batch):
            continue
        rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
        last = rows["place"].to_numpy() == rows["place"].iloc[-1]
        carry = rows[last]
        if not last.all():
            yield linked(rows[~last])
    if carry is not None:
        yield linked(carry)
    give_back()


def _fields(key: Column, fingerprint: Column) -> Column:
    """Places of a fingerprint at a crowded anchor: the RADIUS + 1 fields of the bits outside the anchor's part."""
    out, low, part = F.lit(None), 0, F.shiftright(key, 24)
    for p, width in enumerate(WIDTHS):
        rest = [i for i in range(BITS) if not low <= i < low + width]
        masks = [sum(1 << i for i in rest[f :: RADIUS + 1]) for f in range(RADIUS + 1)]
        places = [F.xxhash64(key, F.lit(f), fingerprint.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for f, m in enumerate(masks)]
        out, low = F.when(part == p, F.array(*places)).otherwise(out), low + width
    return out


def _dealt(visits: DataFrame) -> DataFrame:
    """place, print, home: where the visits (key, print, home) meet; nowhere more than twice HOT."""
    crowded = saved(visits.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "crowded-anchors")
    if crowded.isEmpty():
        return visits.withColumnRenamed("key", "place")
    keys = F.broadcast(crowded.select("key"))  # there are len(WIDTHS) * 2**17 anchors
    plain = visits.join(keys, "key", "left_anti").select(F.col("key").alias("place"), "print", "home")
    divided = visits.join(keys, "key", "left_semi").select(F.explode(_fields(F.col("key"), F.col("print"))).alias("place"), "print", "home")
    divided = saved(divided, "divided-anchors")
    counts = saved(divided.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("place", "n", F.ceil(F.col("n") / HOT).cast("int").alias("side")), "crowded-places")
    if counts.isEmpty():
        return plain.unionByName(divided)
    # a grid: a row is a visitor in a column of cells, and at home in a row of them
    each = labelled(divided, counts, "place", divided.count(), how="left").withColumn("side", F.coalesce("side", F.lit(1)))
    own = F.pmod(F.xxhash64("print", "place"), F.col("side")).cast("int")
    cells = lambda home: F.transform(
        F.sequence(F.lit(0), F.col("side") - 1), lambda k: F.struct((own if home else k).alias("i"), (k if home else own).alias("j"), F.lit(home).alias("h"))
    )
    grid = F.when(F.col("side") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("h")))).otherwise(
        F.concat(cells(False), F.when(F.col("home"), cells(True)).otherwise(F.slice(cells(True), 1, 0)))
    )
    gridded = each.select("place", "print", "side", F.explode(grid).alias("cell"))
    place = F.when(F.col("side") == 1, F.col("place")).otherwise(F.xxhash64("place", "cell.i", "cell.j"))
    return plain.unionByName(gridded.select(place.alias("place"), "print", F.col("cell.h").alias("home")))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints `print` that connect what is connected within RADIUS."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["print"].to_numpy(dtype=np.int64)
            key, who, home = _anchors(own.view(np.uint64))
            yield pd.DataFrame({"key": key, "print": own[who], "home": home})

    visits = saved(prints.select("print").mapInPandas(sent, "key long, print long, home boolean"), "anchor-visits")
    # places are anchors or hashes of anchors with more: if two of them were equal, only more would be compared
    return _dealt(visits).repartition("place").sortWithinPartitions("place").mapInPandas(_at_anchors, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the least node of its component, for each node of the edges (a, b); roots are left out."""
    pairs = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state, n = None, pairs.count()
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = labelled(both, least, "a", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # every pair now points from the greater to the lesser node
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = labelled(large, low, "a", n)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        pairs = saved(small, "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, n = now, now[0]
    raise RuntimeError("components did not settle")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    Texts without words, empty or null, have fingerprint zero and are linked like any
    other. component_id is the least id reachable over links; null ids count for nothing
    (null if a component has no other). Repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """
    return _rooted(docs, id_col, text_col).drop("root")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What cluster returns, and the root fingerprint that names the component."""
    prints = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), simhash_column(F.col(text_col).cast("string")).alias("print")), "simhashes")
    classes = saved(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    rooted = components(links(classes))
    named = classes.join(rooted, classes["print"] == rooted["node"], "left").select("print", "first", "n", F.coalesce("root", "print").alias("root"))
    named = saved(named, "rooted")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    label = saved(labelled(named.withColumnRenamed("n", "rows"), smallest, "root", named.count()).withColumnRenamed("rows", "n"), "labels")
    found = labelled(prints, label.select("print", "n", "component_id", "root"), "print", prints.count())
    return found.select("doc_id", hexed(F.col("print")).alias("fingerprint"), "component_id", "root")


def hexed(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component, one row with the least id.

    Rows without an id all stay. Of rows that share the least id the one with the least text
    stays for each component (null as empty, equal ones: any); texts without words are near
    copies of each other; long texts are read whole; an empty table stays empty. All columns
    keep their values, whatever their names.
    """
    found = saved(_rooted(docs, id_col, text_col), "clusters")
    repeated = saved(found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    leading = found.filter("doc_id = component_id")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    single = rows.join(leading.select("doc_id").join(repeated, "doc_id", "left_anti"), "doc_id", "left_semi").select("row")
    nameless = rows.filter("doc_id IS NULL").select("row")
    # rows that share an id: one for each component that the id leads
    several = leading.join(repeated, "doc_id", "left_semi").select("doc_id", "fingerprint", "root").distinct()
    shared = rows.join(repeated, "doc_id", "left_semi").withColumn("fingerprint", hexed(simhash_column(F.col("text"))))
    shared = shared.join(several, ["doc_id", "fingerprint"]).groupBy("root").agg(F.min_by("row", "text").alias("row")).select("row")
    return single.unionByName(shared).unionByName(nameless).select("row.*")
