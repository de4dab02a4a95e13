"""SimHash fingerprints by weighted term hashes, and all fingerprints within a Hamming radius.

Built from Spark functions only. A document's terms are its distinct words, weighted by
their lengths; a term's two 64-bit hashes vote on 128 signed bits. Votes are summed two
bits to a long, which holds for texts of up to 2**31 characters.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import labelled, saved

WORDS_OF_BITS = 2
BITS = 64 * WORDS_OF_BITS
#: Documents per ordered bucket, and the most buckets: bounds what the driver sees of the order. Beyond them buckets grow; their windows spill.
BUCKET_DOCS, MAX_BUCKETS = 2000, 1 << 16
#: Bits within which the block tables look for others, and ids whose rows ask for them.
RADIUS, EVERY = 3, 50
#: Fingerprints of one key that are compared at once.
CELL = 128
_PAIR = (1 << 32) + 1
_LOWEST = -(1 << 63)


def terms(text: Column) -> Column:
    """A text's distinct words."""
    return F.array_distinct(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def vote(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """keys and simhash (array of longs) for each distinct combination of keys; `words` holds a row's terms.

    Rows without terms get a fingerprint of zeros. If rows are already partitioned by some
    of the keys, nothing is shuffled.
    """
    each = rows.select(*keys, F.explode_outer(words).alias("_term"))
    each = each.select(
        *keys,
        F.coalesce(F.char_length("_term"), F.lit(0)).cast("long").alias("_weight"),
        *[F.xxhash64(F.lit(k), "_term").alias(f"_hash{k}") for k in range(WORDS_OF_BITS)],
    )
    sums = [
        F.sum(F.shiftrightunsigned(f"_hash{k}", i).bitwiseAND(F.lit(_PAIR)) * F.col("_weight")).alias(f"_s{k}_{i}")
        for k in range(WORDS_OF_BITS)
        for i in range(32)
    ]
    voted = each.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *sums)

    def bit(k: int, i: int, high: bool) -> Column:
        votes = F.shiftrightunsigned(f"_s{k}_{i}", 32) if high else F.col(f"_s{k}_{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(F.when(2 * votes > F.col("_all"), F.lit(1)).otherwise(F.lit(0)).cast("long"), i + 32 * high)

    words_of_bits = [reduce(Column.bitwiseOR, [bit(k, i, high) for i in range(32) for high in (False, True)]) for k in range(WORDS_OF_BITS)]
    return voted.select(*keys, F.array(*words_of_bits).alias("simhash"))


def hexed(simhash: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(simhash[k]), 16, "0")) for k in range(WORDS_OF_BITS)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    differing = reduce(Column.__add__, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WORDS_OF_BITS)])
    return (1.0 - differing / F.lit(float(BITS))).cast("double")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, simhash (array of longs), fingerprint (hexadecimal) of each row; equal rows share one row with their `copies`."""
    rows = docs.groupBy(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).agg(F.count("*").alias("copies"))
    rows = rows.select("doc_id", "copies", F.xxhash64("_text").alias("_hash"), terms(F.col("_text")).alias("_terms"))
    return vote(rows, ["doc_id", "copies", "_hash"], "_terms").select("doc_id", "copies", "simhash", hexed(F.col("simhash")).alias("fingerprint"))


def _edges(blocks: int) -> list[int]:
    return [round(BITS * i / blocks) for i in range(blocks + 1)]


def _block(words: list[Column], edges: list[int], b: int) -> list[Column]:
    """The bits of a fingerprint's block."""
    out = []
    for k, word in enumerate(words):
        low, high = max(edges[b], 64 * k) - 64 * k, min(edges[b + 1], 64 * (k + 1)) - 64 * k
        if low < high:
            out.append(F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 63 else -1)))
    return out


def _meetings(prints: DataFrame, queries: DataFrame, radius: int, blocks: int) -> DataFrame:
    """query (struct of words), met (array of structs of words, copies, distance): who is within the radius of a query, in blocks.

    Each pair is met once: in the first of the tables in which it agrees. Fingerprints of
    one key are cut into blocks of some CELL, and only the number of each key's blocks is
    joined; a key that many share is dealt to as many tasks as it has blocks.
    """
    edges, tables = _edges(blocks), list(combinations(range(blocks), blocks - radius))
    words = [F.col(f"w{k}") for k in range(WORDS_OF_BITS)]

    def keyed(rows: DataFrame, *more: str) -> DataFrame:
        keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[x for b in table for x in _block(words, edges, b)]).alias("key")) for t, table in enumerate(tables)]
        return rows.select(F.struct(*words, *more).alias("who"), F.explode(F.array(*keys)).alias("at")).select("at.t", "at.key", "who")

    asked, known = keyed(queries), keyed(prints, "copies")
    counts = known.groupBy("key").agg(F.count("*").alias("n")).join(asked.select("key").distinct(), "key", "left_semi")
    counts = saved(counts.withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")), "block-keys")
    total = prints.count() * len(tables)
    cells = labelled(known, counts, "key", total).withColumn("cell", F.pmod(F.xxhash64("who"), F.col("cells")).cast("int"))
    cells = cells.groupBy("key", "t", "cell").agg(F.collect_list("who").alias("held"))
    sought = labelled(asked, counts, "key", total).select("key", "who", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    met = sought.join(cells, ["key", "cell"])
    own = [F.col("who")[f"w{k}"] for k in range(WORDS_OF_BITS)]

    def judged(other: Column) -> Column:
        apart = [a.bitwiseXOR(other[f"w{k}"]) for k, a in enumerate(own)]
        distance = reduce(Column.__add__, [F.bit_count(x) for x in apart])
        return F.struct(*[other[f"w{k}"].alias(f"w{k}") for k in range(WORDS_OF_BITS)], other["copies"].alias("copies"), distance.alias("distance"), *[x.alias(f"x{k}") for k, x in enumerate(apart)])

    def first_table(pair: Column) -> Column:
        equal = [reduce(Column.__and__, [x == 0 for x in _block([pair[f"x{k}"] for k in range(WORDS_OF_BITS)], edges, b)]) for b in range(blocks)]
        return F.coalesce(*[F.when(reduce(Column.__and__, [equal[b] for b in table]), F.lit(t)) for t, table in enumerate(tables)])

    near = F.filter(F.transform("held", judged), lambda pair: pair["distance"] <= radius)
    return met.select("who", "t", near.alias("near")).filter(F.size("near") > 0).select(
        F.col("who").alias("query"), F.filter("near", lambda pair: first_table(pair) == F.col("t")).alias("met")
    )


def _worded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("simhash")[k].alias(f"w{k}") for k in range(WORDS_OF_BITS)])


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """query, fingerprint, distance: for each of the distinct `queries`, all distinct `prints` within `radius` bits.

    Both sides have a `simhash` column. Permuted block tables: the bits are cut into
    `blocks` blocks; of two fingerprints within the radius some blocks - radius blocks are
    equal, so each table holds one choice of them as its key. A fingerprint finds itself
    too. Exact; null fingerprints are left out; empty inputs give no rows.
    """
    known = _worded(prints.filter("simhash IS NOT NULL")).distinct().withColumn("copies", F.lit(1).cast("long"))
    asked = _worded(queries.filter("simhash IS NOT NULL")).distinct()
    pairs = _meetings(known, asked, radius, blocks or radius + 2).select("query", F.explode("met").alias("met"))
    text = lambda who: hexed(F.array(*[F.col(who)[f"w{k}"] for k in range(WORDS_OF_BITS)]))
    return pairs.select(text("query").alias("query"), text("met").alias("fingerprint"), F.col("met.distance").cast("int").alias("distance"))


def count_within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """fingerprint, n_within: for each of the distinct `queries`, how many rows of `prints` (simhash, copies) are within `radius` bits.

    As within_radius, but pairs are counted where they are met and never become rows.
    """
    known = prints.filter("simhash IS NOT NULL")
    known = known.select(*[F.col("simhash")[k].alias(f"w{k}") for k in range(WORDS_OF_BITS)], F.col("copies").cast("long").alias("copies"))
    asked = _worded(queries.filter("simhash IS NOT NULL")).distinct()
    found = F.aggregate("met", F.lit(0).cast("long"), lambda n, pair: n + pair["copies"])
    counts = _meetings(known, asked, radius, blocks or radius + 2).select("query", found.alias("n")).groupBy("query").agg(F.sum("n").alias("n_within"))
    return counts.select(hexed(F.array(*[F.col("query")[f"w{k}"] for k in range(WORDS_OF_BITS)])).alias("fingerprint"), "n_within")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_bucket, _at, doc_id, _text, _next (the following row's text), _extra, ascending doc_id, nulls first, then text.

    Buckets are ranges of ids, at most MAX_BUCKETS. Each also gets the next bucket's first
    rows, marked _extra, so that a row's successor always stands in its own bucket; the
    last bucket's is the first one.
    """
    position = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    ids = docs.select(position.alias("p"))
    n = ids.count()
    wanted = max(1, min(MAX_BUCKETS, math.ceil(n / BUCKET_DOCS)))
    parts = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(ids.select(F.percentile_approx("p", parts, 20 * wanted)).first()[0] or [])) if parts and n else []

    def bucket(p: Column) -> Column:
        if not bounds:
            return F.lit(0)
        fanout = math.isqrt(len(bounds)) + 1
        coarse = F.array(*[F.lit(b) for b in bounds[::fanout]])
        fine = F.array(*[F.lit(b) for b in bounds])
        skip = F.greatest(F.size(F.filter(coarse, lambda b: b <= p)) - 1, F.lit(0)) * fanout
        return (skip + F.size(F.filter(F.slice(fine, skip + 1, fanout), lambda b: b <= p))).cast("int")

    firsts = sorted((b, p) for b, p in ids.select(bucket(F.col("p")).alias("b"), "p").groupBy("b").agg(F.min("p")).collect())
    before = [(p, firsts[i - 1][0]) for i, (_, p) in enumerate(firsts)]
    spark = docs.sparkSession
    extra = F.broadcast(spark.createDataFrame(before, "_position long, _before int"))  # at most MAX_BUCKETS rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), position.alias("_position"))
    rows = rows.join(extra, "_position", "left")
    own = F.struct(bucket(F.col("_position")).alias("b"), F.lit(False).alias("x"))
    copy = F.struct(F.col("_before").alias("b"), F.lit(True).alias("x"))
    rows = rows.select("doc_id", "_text", "_position", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("_to"))
    rows = rows.select(F.col("_to.b").alias("_bucket"), F.col("_to.x").alias("_extra"), "_position", "doc_id", "_text")
    order = Window.partitionBy("_bucket").orderBy("_extra", "_position", "_text")
    return rows.select("_bucket", F.row_number().over(order).alias("_at"), "_extra", "doc_id", "_text", F.lead("_text").over(order).alias("_next"))


def with_neighbours(docs: DataFrame, radius: int = RADIUS, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """with_edits and n_within: for rows whose id is a multiple of `every`, how many rows, itself included, have a fingerprint within `radius` bits.

    Odd rows are treated as there; n_within is null for all other rows, and for null ids.
    """
    rows = saved(_edited(docs, id_col, text_col), "fingerprints")
    prints = saved(rows.groupBy("fingerprint").agg(F.first("simhash").alias("simhash"), F.count("*").alias("copies"), F.max(F.col("doc_id") % every == 0).alias("asked")), "prints")
    counts = count_within(prints, prints.filter("asked"), radius)
    labels = saved(prints.filter("asked").select("fingerprint", F.col("copies").alias("n")).join(counts, "fingerprint"), "within")
    found = labelled(rows.drop("simhash"), labels, "fingerprint", rows.count(), how="left")
    return found.withColumn("n_within", F.when(F.col("doc_id") % every == 0, F.col("n_within")))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, whose last half comes from the next row's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty; empty texts have a fingerprint of zeros. Repeated rows are
    rows of their own, in the order of in_order (so of two rows with one id the lesser text
    comes first); a single row is its own successor; long texts are read whole; an empty
    table gives no rows; other columns are ignored.
    """
    return _edited(docs, id_col, text_col).drop("simhash")


def _edited(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """with_edits, and simhash of every row's text."""
    rows = in_order(docs, id_col, text_col)
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.when(half > 0, F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)).otherwise(""))
    rows = rows.withColumn("_edited", edited)
    keys = ["_bucket", "_at", "_extra", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(
        "_bucket",
        "_at",
        "_extra",
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))).alias("_one"),
    )
    rows = rows.select(*keys, F.col("_one.k").alias("_kind"), terms(F.col("_one.t")).alias("_terms"))
    voted = vote(rows, [*keys, "_kind"], "_terms")
    order = Window.partitionBy("_bucket").orderBy("_at", "_kind")
    voted = voted.withColumns({"_edited": F.lead("simhash", 1).over(order), "_next": F.lead("simhash", 2).over(order)})
    return voted.filter("_kind = 0 AND NOT _extra").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "simhash",
        hexed(F.col("simhash")).alias("fingerprint"),
        hexed(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("simhash"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("simhash"), F.col("_next")).alias("near_next"),
    )
