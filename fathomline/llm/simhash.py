"""SimHash near-duplicates: fingerprints, a grid over segment popcounts, exact verification, components.

A 64-bit fingerprint is embedded as the popcounts of 32 two-bit segments, which fit into one long again. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. Within distance d, of d + m
groups of segments m at least are equal in both embeddings, so that the cells "these m groups have these counts" of the
grid hold every link. Three steps keep this linear in near-equal fingerprints:

1. each fingerprint is compared with the smallest one of its cells, and what links is one component from then on;
2. cells whose members have one component by now are left; large ones of the others are cut by a second
   choice of groups among the segments that they don't fix;
3. members of different components are compared, first by a coarse Manhattan bound, then exactly.

No step lists the pairs of a cell, and only verified links leave a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import checkpoint, fresh
from fathomline.llm.components import components

#: Random candidates per fingerprint that a grid may give; the least number of groups that its cells hold equal; members from
#: which a cell is cut again.
CANDIDATES, LEAST_LEVEL, LARGE_CELL = 16, 4, 64
#: Fingerprints whose cells one task makes.
CELLS_OF = 20_000
#: Bits of choice in the popcounts of one two-bit segment, by its collision probability of 3/8.
SEGMENT_BITS, SEGMENTS = 1.415, 32


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles, A-Z lower-cased; 0 without a word."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    count = max(1, len(w) - shingle + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), "<u8", count).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, count, 65536):
        ones += np.unpackbits(h[i : i + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed long) of every row; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(segments: list[int], distance: int, extra: int) -> list[int]:
    """Masks over two-bit segments: every choice of `extra` among distance + extra groups."""
    n = distance + extra
    groups = [segments[i * len(segments) // n : (i + 1) * len(segments) // n] for i in range(n)]
    return [sum(3 << 2 * s for g in chosen for s in g) for chosen in combinations(groups, extra)]


def grid_level(n: int, distance: int) -> int:
    """The fewest groups to hold equal that leave about CANDIDATES random members to a fingerprint's cells."""
    m = LEAST_LEVEL
    while m < 12 and n * comb(distance + m, m) * 2 ** (-SEGMENT_BITS * SEGMENTS * m / (distance + m)) > CANDIDATES:
        m += 1
    return m


def _embedded(fp: Column) -> Column:
    """Each pair of bits becomes their sum: the carry is their AND, the rest their XOR."""
    low, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(next_bit).bitwiseAND(low))


def _coarse(a: Column, b: Column) -> Column:
    """Manhattan distance of the popcounts of four quarters: a lower bound of that of all segments."""
    quarter = lambda x, i: F.bit_count(x.bitwiseAND(F.lit(signed(0xFFFF << 16 * i))))
    return sum((F.abs(quarter(a, i) - quarter(b, i)) for i in range(1, 4)), F.abs(quarter(a, 0) - quarter(b, 0)))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_components(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root) for distinct fingerprints fp: equal roots if links of `distance` differing bits or fewer connect them."""
    n = fps.count()
    masks = cell_masks(list(range(SEGMENTS)), distance, grid_level(n, distance))
    choices = F.array(*[F.lit(signed(m)) for m in masks])
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // CELLS_OF)

    def cells(rows: DataFrame) -> DataFrame:
        # a given number of tasks: what is small before rows become many cells would else be merged into few
        keyed = rows.repartition(parts, "fp").withColumn("v", _embedded(F.col("fp"))).select(*rows.columns, "v", F.posexplode(choices).alias("c", "m"))
        return keyed.withColumn("key", F.col("v").bitwiseAND(F.col("m"))).drop("m")

    plain = cells(fps.select("fp")).drop("v")
    hubs = plain.groupBy("c", "key").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top").drop("top")
    stars = plain.join(hubs, ["c", "key"]).where((F.col("fp") != F.col("hub")) & (_differ(F.col("fp"), F.col("hub")) <= distance))
    first = checkpoint(components(stars.select(F.col("fp").alias("u"), F.col("hub").alias("v"))))
    labelled = checkpoint(fps.select("fp").join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("label")))

    members = cells(labelled)
    mixed = members.groupBy("c", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("lo", "hi")
    open_cells = checkpoint(members.join(mixed, ["c", "key"]).withColumn("sub", F.lit(-1)))
    finer = F.array(*[F.array(*[F.lit(signed(m | s)) for s in cell_masks([i for i in range(SEGMENTS) if not m >> 2 * i & 1], distance, 2)]) for m in masks])
    large = open_cells.where(F.col("n") > LARGE_CELL).drop("sub").select("c", "fp", "label", "v", F.posexplode(F.get(finer, F.col("c"))).alias("sub", "m"))
    large = large.select("c", "sub", F.col("v").bitwiseAND(F.col("m")).alias("key"), "fp", "label")
    rows = open_cells.where(F.col("n") <= LARGE_CELL).select("c", "sub", "key", "fp", "label").unionByName(large)
    a, b = (rows.select("c", "sub", "key", F.col("fp").alias(f"fp_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    near = (F.col("label_a") < F.col("label_b")) & (_coarse(F.col("fp_a"), F.col("fp_b")) <= distance) & (_differ(F.col("fp_a"), F.col("fp_b")) <= distance)
    same = [a[k] == b[k] for k in ("c", "sub", "key")]
    links = a.join(b, same[0] & same[1] & same[2] & near).select(F.col("label_a").alias("u"), F.col("label_b").alias("v"))
    second = components(links)
    return labelled.join(second, F.col("label") == F.col("node"), "left").select("fp", F.coalesce("root", "label").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links of fingerprints, itself included) for every row.

    Rows without a word, nulls among them, have fingerprint zero and are linked like others. Repeated rows stay.
    Rows with a null id get the smallest other id of their component, or null. Other columns aren't read. An
    empty table gives an empty result. Equal fingerprints are one node from the start, so that a text with any
    number of copies costs one.
    """
    prints = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = distinct.join(fingerprint_components(distinct, distance), "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = checkpoint(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that have a smaller id in their component; columns as they were.

    Rows of one id are one document: they stay or go together. Rows with a null id stay. An empty table gives an
    empty result.
    """
    found = near_duplicates(docs, shingle, distance, id_col, text_col)
    mark = fresh("_gone", docs)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(mark), "left_anti")
