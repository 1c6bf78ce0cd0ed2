"""Quality rules as a bitmask ledger: measure once, keep failure bits, apply versioned policies afterwards.

Every expression is a built-in function; a text is measured in its own row and nothing is shuffled. The ledger is written
once, and verdicts, policies and ablations read it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import SPACE, words, written

#: The n-gram of repeated words and the characters counted as symbols.
WINDOW, SYMBOLS = 5, "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over MEASURES, null counts as passed. bit: its place in the ledger, never used again for another rule."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
    Rule("shouts", 6, "2 * n_shouts > n_words"),
)
#: Versioned policies: a document goes if one of these bits is set.
POLICIES = {"base": 0b0000011, "v1": 0b1111111}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its id and MEASURES; the id may be a struct of columns to carry along."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("k"), text.alias("t"), words(F.col(text_col)).alias("w"),
                    F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0).alias("lines"))
    n = F.size("w")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    d = d.select(
        "k", n.cast("long").alias("n_words"), F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("w", lambda x: x.endswith("!!"))).cast("long").alias("n_shouts"),
        F.coalesce(grams, F.array().cast("array<bigint>")).alias("g"),
    )
    pairs = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("p", F.coalesce(pairs, F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.coalesce(F.get("p", j)["h"] == x["h"], F.lit(False))
    found = F.filter("p", lambda x, j: same(x, j - 1) | same(x, j + 1))
    d = d.withColumn("at", F.array_sort(F.transform(found, lambda x: x["i"])))
    covers = F.transform("at", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - x, F.lit(WINDOW))).cast("long"))
    d = d.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x))
    return d.select(F.col("k").alias(id_col), *MEASURES)


def failed_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of each row and fail_bits, in which each rule of `rules` has set its bit where it fails.

    A null, empty or blank text has zero for every measure and so fails few_words; repeated rows stay; other
    columns aren't read. A text of any length is measured whole. An empty table gives an
    empty ledger.
    """
    return measured(docs, id_col, text_col).withColumn("fail_bits", failed_bits(rules))


def stored_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, written to the shared folder and read again: any number of policies and ablations cost no text."""
    return written(ledger(docs, rules, id_col, text_col))


def verdicts(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with kept: no bit of the policy is set."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(book: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per rule of the policy: rows that fail it, and rows that would come back without it.

    One aggregation of counts over fail_bits, whose distinct values are bounded by the rules and not by the rows.
    """
    mask = POLICIES[policy]
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count("*").alias("n"))
    one = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("m")) for r in rules if mask >> r.bit & 1])
    each = counts.select("b", "n", F.explode(one).alias("r"))
    hit = F.col("b").bitwiseAND(F.col("r.m")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("b") == F.col("r.m"), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns as they were, whatever their names.

    The row number beside the ledger isn't deterministic, so that the filter stays above it: pushed down, it would
    be written out over every use of every measure in it.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    book = ledger(rows, id_col="row").withColumn("_at", F.monotonically_increasing_id())
    return verdicts(book, policy).where("kept and _at >= 0").select("row.*")
