"""Mixing sources to target weights by a temperature.

Weights are source token shares raised to an exponent between 0 (even) and 1 (as they are). The exponent is bisected,
on a grid of points per round, to meet a target entropy or a limit to how often a document repeats. Each source's
token quota is then realised as whole epochs and a part of one more: the source's documents are hashed into blocks, the
blocks are permuted for that epoch, and blocks are taken in this order up to the quota, the last one document by document.
"""

from __future__ import annotations

from math import isqrt, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import checkpoint, fresh, quoted, words

#: Documents to a block, blocks of a source up to which blocks have that size (beyond it, their number grows with the root of the documents), points and rounds of the search, sources up to which a plan is broadcast.
BLOCK, BLOCKS, POINTS, ROUNDS, FEW_SOURCES = 256, 4096, 32, 5, 20_000
#: Where a null source is put; a source of this name shares its quota.
NO_SOURCE = "(none)"


def solve_exponent(totals: DataFrame, entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None) -> dict:
    """The largest exponent that reaches `entropy` nats, or the smallest that keeps repeats at or below `max_repeat`.

    totals: (source, tokens), one row each. Without a budget, it is the least one that gives every source a whole epoch.
    If no exponent meets the target, the nearest end of [0, 1] is taken. Each round is one aggregation over sources, of which
    the driver gets POINTS rows. Returns exponent, scale (quota of a source = scale * tokens ** exponent) and budget.
    """
    some = totals.where("tokens > 0")
    top = some.agg(F.max("tokens").alias("t")).first()["t"]
    if top is None:
        return {"exponent": 1.0, "scale": 0.0, "budget": 0.0}
    r = F.col("tokens") / F.lit(float(top))

    def at(points: list[float]) -> list:
        grid = some.select("tokens", F.explode(F.array(*map(F.lit, points))).alias("e")).withColumn("w", F.pow(r, F.col("e")))
        agg = grid.groupBy("e").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log(r)).alias("l"), F.max(F.col("w") / F.col("tokens")).alias("hi"), F.min(F.col("w") / F.col("tokens")).alias("lo"))
        return sorted(agg.collect())

    def repeats(row) -> float:
        return row["hi"] / row["lo"] if budget is None else budget * row["hi"] / row["z"]

    def meets(row) -> bool:
        """True below the exponent that is looked for."""
        if entropy is not None:
            return log(row["z"]) - row["e"] * row["l"] / row["z"] >= entropy
        return repeats(row) > max_repeat

    lo, hi = 0.0, 1.0
    if entropy is not None or max_repeat is not None:
        for _ in range(ROUNDS):
            points = [lo + (hi - lo) * i / (POINTS - 1) for i in range(POINTS)]
            rows = at(points)
            below = [x["e"] for x in rows if meets(x)]
            if not below:
                hi = lo
            elif len(below) == len(rows):
                lo = hi
            else:
                lo, hi = below[-1], rows[len(below)]["e"]
            if lo == hi:
                break
    exponent = (lo if entropy is not None else hi) if entropy is not None or max_repeat is not None else 1.0
    row = at([exponent])[0]
    total = row["z"] / row["lo"] if budget is None else float(budget)
    return {"exponent": exponent, "scale": total / row["z"] / float(top) ** exponent, "budget": total}


def _unit(*parts: Column) -> Column:
    """An order key that depends on its parts alone."""
    return F.xxhash64(*parts)


def mix(docs: DataFrame, entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None, seed: int = 0,
        tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with `epoch` (0 for the first copy): a row for each copy that the mix takes.

    Shares count tokens (words unless a column is given) over all rows. A source gets its quota up to less than one
    document: the document that would exceed it is left out, and with it what follows in its block. Without a budget
    nothing is dropped. Rows without tokens cost nothing and are copied as their place falls. Equal rows stand or fall together, as their
    order keys are equal; a null source is one more source. Where docs has a column `epoch`, the new one is `epoch_`, with one more line for each that is there too. An empty table gives an empty result. Blocks are hashed, so
    that a source of any size is dealt evenly; only sums by block and the documents of one block per source are windowed.
    """
    counted = F.size(words(F.col(text_col))).cast("long") if tokens is None else tokens.cast("long")
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("_mix_source")
    key = _unit(F.lit(seed), F.col(id_col), F.octet_length(text_col)).alias("_mix_doc")
    n = docs.count()
    n_blocks = max(1, min(BLOCKS, n // BLOCK), isqrt(n) if n > BLOCKS * BLOCKS else 1)
    block = F.pmod(_unit(F.lit("block"), F.col("_mix_doc")), F.lit(n_blocks)).cast("int")
    # columns are numbered on the way, so that none of them has a name that is used here
    numbered = [docs[quoted(c)].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*numbered, counted.alias("_mix_tokens"), name, key).withColumn("_mix_block", block)
    size = checkpoint(rows.groupBy("_mix_source", "_mix_block").agg(F.sum(F.coalesce("_mix_tokens", F.lit(0))).alias("tokens")))
    totals = size.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("tokens").alias("tokens"))
    found = solve_exponent(totals, entropy, max_repeat, budget)
    quota = F.lit(found["scale"]) * F.pow(F.col("tokens"), F.lit(found["exponent"])) * (1 + 1e-12)
    plan = totals.withColumn("full", F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(1).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, quota - F.col("full") * F.col("tokens")).otherwise(0.0)).withColumnRenamed("source", "_mix_source")

    # the part epoch: where its permuted blocks cross the quota
    turn = lambda full: _unit(F.lit(seed), F.lit("turn"), F.col(full), F.col("_mix_source"), F.col("_mix_block"))
    order = Window.partitionBy("_mix_source").orderBy("turn", "_mix_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = size.join(plan.select("_mix_source", "full", "rest"), "_mix_source").withColumn("turn", turn("full")).withColumn("upto", F.sum("tokens").over(order))
    cross = checkpoint(run.where("upto > rest").groupBy("_mix_source").agg(F.min(F.struct("turn", "_mix_block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("cut")))
    edge = cross.select("_mix_source", F.col("cut._mix_block").alias("_mix_block"), F.col("cut.left").alias("left"))
    few = totals.count() <= FEW_SOURCES
    small = F.broadcast if few else (lambda x: x)
    last = rows.select("_mix_source", "_mix_block", "_mix_doc", "_mix_tokens").join(small(edge), ["_mix_source", "_mix_block"])
    docs_order = Window.partitionBy("_mix_source").orderBy("_mix_doc").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = last.withColumn("upto", F.sum(F.coalesce("_mix_tokens", F.lit(0))).over(docs_order))
    stop = within.where("upto > left").groupBy("_mix_source").agg(F.min("_mix_doc").alias("stop"))
    plan = checkpoint(plan.join(cross, "_mix_source", "left").join(stop, "_mix_source", "left").select(
        "_mix_source", F.col("full").alias("_mix_full"), F.col("cut").alias("_mix_cut"), F.col("stop").alias("_mix_stop"), (F.col("tokens") > 0).alias("_mix_some")))
    joined = rows.drop("_mix_tokens").join(small(plan), "_mix_source")
    mine, cut = turn("_mix_full"), F.col("_mix_cut")
    at_edge = (mine == cut["turn"]) & (F.col("_mix_block") == cut["_mix_block"])
    before = (mine < cut["turn"]) | ((mine == cut["turn"]) & (F.col("_mix_block") < cut["_mix_block"]))
    part = F.col("_mix_some") & cut.isNotNull() & (before | (at_edge & F.coalesce(F.col("_mix_doc") < F.col("_mix_stop"), F.lit(True))))
    copies = F.col("_mix_full") + F.when(part, 1).otherwise(0)
    # an epoch's number for each copy; sequence() can't be empty, so rows that come not at all go first
    made = joined.withColumn("_mix_copies", copies).where("_mix_copies > 0")
    epoch = fresh("epoch", docs)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)).alias(epoch))
