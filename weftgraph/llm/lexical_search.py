"""Ranked lexical search: the documents that score highest for each item's terms.

Documents are dealt to parts of some hundred, and a row of the postings is one term's bucket
in one part: the documents there that hold it, each with what one occurrence of the term in
an item adds to its score. So a term that every document holds has as many buckets as there
are parts, none larger than a part. Items' terms meet the buckets in a join, buckets are
unfolded, scores are summed by item and document, which never leaves a document's part, and a
window numbers the best of each item.

Only terms that some item asks for have postings; counts of documents and terms are of all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, saved

#: What separates terms: all ASCII characters but digits and letters. Upper case becomes lower case, of ASCII letters only.
_TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Documents of a part, about.
PART = 512
#: Terms of items, with their repeats in other items, that may be sent to every task; beyond, buckets and items' terms are both shuffled by term.
BROADCAST = 200_000
#: Bytes of a term that count against it as one term.
TERM_BYTES = 64

# The weights of the ranking function.
SCALE, K1_EIGHTHS, B = 1000, 8, 75


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _counted(rows: DataFrame, keys: str) -> DataFrame:
    """Columns `keys`, n (terms of the row's text), term, tf; and one row with an empty term for each row that has any."""
    names = [k.split()[0] for k in keys.split(",")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                terms, tf, sizes, n = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = terms_of(text)
                    found = Counter(own)
                    if own:
                        found[b""] = 1
                    terms += found.keys()
                    tf += found.values()
                    sizes.append(len(found))
                    n.append(len(own))
                origin = pa.array([i for i, k in enumerate(sizes) for _ in range(k)], pa.int32())
                columns = [part.column(k).take(origin) for k in names] + [pa.array(n, pa.int64()).take(origin)]
                columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n", "term", "tf"])
            give_back()

    return rows.select(*names, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, f"{keys}, n long, term string, tf long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", part_docs: int = PART, broadcast: int = BROADCAST) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents; equal scores by ascending doc_id, null ids last.

    Null and empty texts, and those without terms, are found for no item and find nothing. Rows
    of docs that share an id are ranked each, as are rows of items (each has its ranks). Long texts
    are read whole. Empty tables give no rows; other columns are ignored.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).withColumn("item", F.monotonically_increasing_id())
    asked = saved(_counted(asked, "item long, item_id long").filter("term <> ''").select("item", "item_id", "term", F.col("tf").alias("repeats")), "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.ceil(F.octet_length("term") / TERM_BYTES)), F.lit(0)).alias("n")).first()["n"]
    few = F.broadcast if size <= broadcast else (lambda table: table)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    wanted = asked.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    held = saved(_counted(rows, "row long, doc_id long").join(few(wanted), "term", "left_semi").select("row", "doc_id", "n", "term", "tf"), "postings")

    whole = held.filter("term = ''").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = whole["docs"], whole["terms"]
    parts = max(1, -(-n_docs // part_docs))
    weight = F.floor(SCALE * F.ln((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = held.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w"))
    #: Longer documents than the mean count less.
    m = F.lit(100 - B) + F.expr(f"({B} * n * {n_docs}L) div {max(n_terms, 1)}L")
    score = F.col("w") * F.expr("(1000000000L * tf) div _below")
    scored = held.filter("term <> ''").join(few(saved(weights, "weights")), "term").withColumn("_below", SCALE * F.col("tf") + K1_EIGHTHS * m)
    # each part in one task from here on; what a document has there is summed without another exchange
    scored = scored.select(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), "term", F.struct("row", "doc_id", score.alias("s")).alias("one"))
    buckets = scored.repartition("part").groupBy("part", "term").agg(F.collect_list("one").alias("bucket"))

    matches = buckets.join(few(asked), "term").select("part", "item", "item_id", "repeats", F.explode("bucket").alias("d"))
    sums = matches.groupBy("part", "item", "item_id", F.col("d.row").alias("row"), F.col("d.doc_id").alias("doc_id")).agg(F.sum(F.col("d.s") * F.col("repeats")).alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = sums.filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _TERM + "')"

SQL = f"""
with split as (select doc_id, {_SPLIT} as terms from documents),
whole as (select count(*) as docs, sum(len(terms))::bigint as total from split where len(terms) > 0),
held as (select doc_id, n, term, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from split) group by all),
weights as (select term, floor(1000 * ln((2 * (select docs from whole) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held group by term),
asked as (select item_id, unnest({_SPLIT}) as term from benchmark),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * (select docs from whole)) // (select total from whole)))))::bigint as score
  from asked join weights using (term) join held using (term) group by item_id, doc_id
)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0
) where rank <= 10
"""
