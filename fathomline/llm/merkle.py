"""Merkle fingerprints of documents, by built-in functions alone.

A text is a tree: sections between blank lines, paragraphs between line ends, sentences as leaves. A fingerprint is the root,
a digest of section digests, each of paragraph digests, each of leaf digests; then '/' and the leaves, so that every
branch can be derived again: leaves are joined by '.', paragraphs by ',', sections by ';'. Equal texts have equal fingerprints; leaves
are cut to 48 bits, so that two different texts have equal ones with a chance of 2^-48 for each leaf that differs; otherwise the branches that differ tell where texts were edited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import quantile_bounds, range_block

#: Hexadecimal digits of a leaf and what ends sections, paragraphs and sentences.
LEAF, SECTION_END, PARAGRAPH_END, SENTENCE_END = 12, "\n\n", "\n", ". "
#: Documents to a block of neighbouring ids, and blocks at most.
BLOCK, BLOCKS = 64, 16384


def _branch(parts: Column) -> Column:
    """One digest of an array of digests."""
    return F.md5(F.concat_ws(".", parts))


def sections_of(text: Column) -> Column:
    """Leaf digests of a text: 'leaf.leaf,leaf' for each section; null counts as empty."""
    leaf = lambda s: F.substring(F.md5(s), 1, LEAF)
    paragraph = lambda p: F.concat_ws(".", F.transform(F.split(p, r"\. "), leaf))
    section = lambda s: F.concat_ws(",", F.transform(F.split(s, "\n"), paragraph))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)


def root_of(sections: Column) -> Column:
    paragraph = lambda p: _branch(F.split(p, r"\."))
    section = lambda s: _branch(F.transform(F.split(s, ","), paragraph))
    return _branch(F.transform(sections, section))


def fingerprint_of(sections: Column) -> Column:
    return F.concat(root_of(sections), F.lit("/"), F.concat_ws(";", sections))


def leaves_of(fingerprint: Column) -> Column:
    return F.split(F.element_at(F.split(fingerprint, "/"), 2), "[;,.]")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else twice the distinct leaves that both have by the distinct leaves of each."""
    one, two = F.array_distinct(leaves_of(a)), F.array_distinct(leaves_of(b))
    shared = 2.0 * F.size(F.array_intersect(one, two)) / (F.size(one) + F.size(two))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared))


def edited_sections(a: Column, b: Column) -> Column:
    """0-based places of the sections whose branches differ between two fingerprints."""
    parts = F.arrays_zip(F.split(F.element_at(F.split(a, "/"), 2), ";").alias("a"), F.split(F.element_at(F.split(b, "/"), 2), ";").alias("b"))
    marked = F.transform(parts, lambda p, i: F.when(~p["a"].eqNullSafe(p["b"]), i))
    return F.filter(marked, lambda i: i.isNotNull())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and next_text of every row: the text of the row after it by id, after the last the first.

    Ids are cut into blocks at their quantiles. The first row of each block is put once more at the end of the
    block before it, so that one exchange by block and a window inside it are enough. Ids are integers of any width.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} has to be an integer column: its quantiles deal rows into blocks")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = quantile_bounds(rows, "doc_id", min(BLOCKS, max(1, rows.count() // BLOCK)))
    rows = rows.withColumn("block", range_block(F.col("doc_id"), bounds))
    heads = sorted((r["doc_id"], r["block"]) for r in rows.groupBy("block").agg(F.min("doc_id").alias("doc_id")).collect() if r["doc_id"] is not None)
    order = [(head, heads[i - 1][1]) for i, (head, _) in enumerate(heads)]
    # at most BLOCKS pairs, whatever the table
    before = docs.sparkSession.createDataFrame(order, f"doc_id {docs.schema[id_col].dataType.simpleString()}, block int")
    extra = rows.drop("block").dropDuplicates(["doc_id"]) if not order else rows.drop("block").join(F.broadcast(before), "doc_id")
    extra = extra.select("doc_id", "text", "block") if order else rows.limit(0)
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
    following = F.expr("lead(text) over (partition by block order by extra, doc_id)")
    return both.withColumn("next_text", F.coalesce(following, F.col("text"))).where("not extra").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; a null text counts as empty, which is one empty leaf. No shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(sections_of(F.col(text_col))).alias("fingerprint"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited text and its fingerprint, fingerprint, near_edited and near_next of every row.

    The edited text has its last half (rounded down) replaced by as many code points of the next document, or all
    that it has. A null text counts as empty; a single row is its own next one. Of rows with equal ids each comes
    once, in some order among them; null ids come first. Other columns aren't read. An empty table gives an empty
    result.
    """
    d = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    d = d.select("doc_id", "n_chars", "edited", *[fingerprint_of(sections_of(F.col(c))).alias(f) for c, f in
                                                  (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint"))])
    return d.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
