"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures are Spark SQL expressions over a document's words and lines; each rule bounds
one measure. A rule that a document breaks adds its name to the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auch auf das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el ella es las lo los mi más no para por se su sus te una y"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high (a missing bound is open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        value, out = F.col(self.measure), F.lit(False)
        if self.low is not None:
            out = out | (value < F.lit(self.low))
        if self.high is not None:
            out = out | (value > F.lit(self.high))
        return out


#: The threshold table.
RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_percent", high=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("few_stop_words", "stop_ratio", low=0.03),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
)

#: Rules that make base_failed.
BASE = ("few_words", "repeated_windows")


def measures(rows: DataFrame, window: int = 3) -> DataFrame:
    """rows (row, text) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words and ratios of them; text goes.

    n_repeat_words counts the words inside a `window`-word run that the text has twice or
    more. Runs are sorted by a hash of their words, then by the words. Every intermediate is
    a column of its own, so that no expression is evaluated twice; the row number keeps the
    optimizer from pushing a filter on the results below these columns, where it would
    evaluate them anew for each word.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = text
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    out = rows.select(
        "row",
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.octet_length(text) - F.octet_length(plain)).cast("long").alias("n_symbols"),
        F.monotonically_increasing_id().alias("_row"),
    )
    count = F.size("_words")
    own = lambda i: [F.get("_words", i + (k - 1)) for k in range(window)]
    hashes = F.transform(
        F.when(count >= window, F.sequence(F.lit(1), count - (window - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*own(i)).alias("h"), *[w.alias(f"w{k}") for k, w in enumerate(own(i))], i.alias("i")),
    )
    out = out.withColumns(
        {
            "n_words": count.cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_runs": F.sort_array(hashes),
            "_row": F.greatest("_row", F.monotonically_increasing_id()),
        }
    )

    def same(x: Column, i: Column) -> Column:
        other = F.get("_runs", i)
        equal = x["h"] == other["h"]
        for k in range(window):
            equal = equal & (x[f"w{k}"] == other[f"w{k}"])
        return F.coalesce(equal, F.lit(False))

    twice = F.filter("_runs", lambda x, i: same(x, i + 1) | same(x, i - 1))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    out = out.withColumns({"_starts": starts, "_row": F.greatest("_row", F.monotonically_increasing_id())})
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(window), i - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    repeated = F.when(F.greatest("_row", F.monotonically_increasing_id()) >= 0, covered)
    out = out.withColumn("n_repeat_words", repeated.cast("long"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns(
        {
            "repeat_percent": ratio("n_repeat_words", "n_words") * 100,
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "stop_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        }
    ).drop("_words", "_lines", "_runs", "_starts", "_row")


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COLUMNS, "base_failed", "broken_rules", "kept")


def _judged(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """row (all columns of docs) and RESULTS."""
    measured = measures(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    judged = measured.select("row", *COLUMNS, base.alias("base_failed"), broken.alias("broken_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with RESULTS: COLUMNS, base_failed, broken_rules (names) and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows
    (both in whole numbers). A null or empty text has no words, so it fails; a measure at a
    bound passes; repeated rows are judged each; long texts are read whole; an empty table
    stays empty. Columns of docs keep their values, but for those that a result replaces
    because they have its name.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in RESULTS]
    return _judged(docs, rules, text_col).select(*own, *RESULTS)


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge keeps, with all columns as they are, whatever their names; for odd rows see judge."""
    return _judged(docs, rules, text_col).filter("kept").select("row.*")


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: The query's rows as DuckDB SQL.
SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (select r, i from (select *, count(*) over (partition by r, g) as n from g) where n > 1),
covered as (select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by r),
m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) in ({_listed(STOP_WORDS)}))) as n_stop from w left join covered using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and word_chars / n_words between 2.0 and 14.0 and n_symbols / word_chars <= 0.05
    and n_stop / n_words >= 0.03 and n_dup_lines / n_lines <= 0.3 as kept
from b
"""
