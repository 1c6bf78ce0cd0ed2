"""Lines that many documents share, found through a sharded minimal perfect hash and dropped but for one holder.

A line's key is reduced to two 64-bit hashes (h, f) in the task that reads it. Counting documents per key is one
aggregation; keys of enough documents are dealt into shards, and each shard gets a minimal perfect hash: levels of
bits in which a key is set where it met no other key, the number of set bits before it being its index. The index leads
into compact arrays of fingerprints, counts and holders. Documents don't join lines: they probe the arrays of
the shard that a hash names, and a probe that isn't a member fails on its fingerprint (64 bits besides the level bits). A
shard whose keys are held by very many documents is dealt out in parts, each with a copy of the shard's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import checkpoint

#: White space that is stripped from a line's key.
WHITE = b" \t\n\x0b\x0c\r"
#: Lines and shared keys to a shard on average, the least number of shards, and documents of shared keys to a part of a shard.
SHARD_LINES, SHARD_KEYS, LEAST_SHARDS, PART_DOCS = 1_000_000, 250_000, 64, 250_000
#: Bits of a level for each key that is left.
GAMMA = 1.7
#: Levels after which two keys must be the same one.
MOST_LEVELS = 400


def _place(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key at a level; both hashes count, so that two keys part at some level."""
    with np.errstate(over="ignore"):
        z = h + f * np.uint64(2 * level + 1) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct keys (h, f) -> 0 .. n-1, each number once. Other keys get any number, or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, words = [], [np.zeros(0, np.uint64)]
        while len(h):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys of a perfect hash have to be distinct")
            size = 64 * max(1, -(-int(GAMMA * len(h)) // 64))
            at = _place(h, f, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            h, f = h[left], f[left]
        return cls(sizes, np.concatenate(words))

    def index(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        out, left, first = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = first + _place(h[left], f[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[hit]
            left, first = left[~hit], first + size
            if not len(left):
                break
        return out


def line_keys(text: str | None) -> list[bytes]:
    """Keys of all lines of a text, in order; A-Z are lower-cased and nothing else is."""
    return [x.strip(WHITE) for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least)


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _lines(docs: DataFrame, least: int, shards: int | None = None, parts: dict[int, int] | None = None) -> DataFrame:
    """Hashes of long keys: once a row of docs (doc_id, row, text), or with every place, shard and part where shards are given."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, places = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                found = line_keys(text)
                if shards is None:
                    new = [k for k in dict.fromkeys(found) if _long(k, least)]
                else:
                    at = [j for j, k in enumerate(found) if _long(k, least)]
                    new = [found[j] for j in at]
                    places += at
                keys += new
                rows += [i] * len(new)
            h, f = _hashes(keys)
            index = np.array(rows, np.int64)
            cols = [b.column("doc_id").take(pa.array(index)), pa.array(h.view(np.int64)), pa.array(f.view(np.int64))]
            names = ["doc_id", "h", "f"]
            if shards is not None:
                row = b.column("row").to_numpy()[index] if len(index) else np.zeros(0, np.int64)
                shard = h.view(np.int64) % shards
                many = np.array([(parts or {}).get(s, 1) for s in shard.tolist()], np.int64)
                part = (row ^ np.array(places, np.int64)).view(np.uint64) % many.astype(np.uint64) if len(many) else many
                cols += [pa.array(x) for x in (row, np.array(places, np.int32), shard.astype(np.int32), part.astype(np.int32))]
                names += ["row", "place", "shard", "part"]
            yield pa.RecordBatch.from_arrays(cols, names)

    more = "" if shards is None else ", row long, place int, shard int, part int"
    return docs.mapInArrow(run, f"doc_id {kind}, h long, f long{more}")


def shared_keys(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """h, f, n (documents) and holder (largest doc_id) of the keys that enough rows hold."""
    found = _lines(docs, least_chars).groupBy("h", "f").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
    return checkpoint(found.where(F.col("n") >= least_docs))


def sharded_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its perfect hash (sizes, bits), and arrays by its index: fingerprints, counts and holders."""
    kind = keys.schema["holder"].dataType.simpleString()

    def build(key: tuple, t: pa.Table) -> pa.Table:
        h, f = (t.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
        found = PerfectHash.of(h, f)
        order = np.argsort(found.index(h, f))
        holders = t.column("holder").combine_chunks().take(pa.array(order))
        row = {
            "shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([found.sizes], pa.list_(pa.int64())), "bits": pa.array([found.words.tobytes()], pa.binary()),
            "prints": pa.array([f[order].tobytes()], pa.binary()), "counts": pa.array([t.column("n").to_numpy()[order].tobytes()], pa.binary()),
            "holders": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), holders),
        }
        return pa.table(row)

    dealt = keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, f"shard int, sizes array<long>, bits binary, prints binary, counts binary, holders array<{kind}>")


def _probe(lines: pa.Table, index: pa.Table) -> pa.Table:
    """Places of rows whose line is a member of the shard and whose id isn't its holder."""
    out = lines.select(["doc_id", "row", "place"])
    if not lines.num_rows or not index.num_rows:
        return out.slice(0, 0)
    found = PerfectHash(index.column("sizes")[0].as_py(), np.frombuffer(index.column("bits")[0].as_py(), np.uint64))
    prints, holders = np.frombuffer(index.column("prints")[0].as_py(), np.uint64), index.column("holders")[0].values
    h, f = (lines.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
    at = found.index(h, f)
    member = np.flatnonzero((at >= 0) & (prints[np.maximum(at, 0)] == f))
    held = holders.take(pa.array(at[member]))
    ids = lines.column("doc_id").combine_chunks().take(pa.array(member))
    gone = pc.and_(pc.is_valid(held), pc.invert(pc.fill_null(pc.equal(ids, held), False)))
    return out.take(pa.array(member).filter(gone))


def drop_shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of each row.

    A line whose stripped, lower-cased key has least_chars code points or more and is held by least_docs rows or more stays
    only in rows with the largest id that holds it, every time it stands there. A null or empty text is one empty line. Rows that share an id
    count as a document each, and all of them keep what their id holds; a null id is below all others, and lines that
    only rows without id hold stay. Ids may be of any type with an order; other columns aren't read. An empty table gives an empty
    result. Texts move once, to meet the places of their lost lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = shared_keys(rows, least_chars, least_docs)
    n_lines = rows.agg(F.sum(1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-n_lines // SHARD_LINES), -(-keys.count() // SHARD_KEYS))
    loads = keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").agg(F.sum("n").alias("n"))
    # fewer than one shard for each PART_DOCS lines is split, and the driver gets two numbers of it
    parts = {r["shard"]: r["parts"] for r in loads.select("shard", (1 + F.floor(F.col("n") / PART_DOCS)).cast("int").alias("parts")).where("parts > 1").collect()}
    index = checkpoint(sharded_index(keys, shards))
    copies = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("shard")] if parts else F.lit(None).cast("int")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1)))
    asked = _lines(rows, least_chars, shards, parts)
    hits = asked.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(_probe, f"doc_id {kind}, row long, place int")
    gone = hits.groupBy("doc_id", "row").agg(F.collect_set("place").alias("gone")).withColumnsRenamed({"doc_id": "id_", "row": "row_"})
    met = rows.join(gone, (F.col("row") == F.col("row_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lost, kept = [], [], []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, g = t.split("\n"), set(g or ())
                n.append(len(lines))
                lost.append(len(g))
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in g]) if g else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return met.mapInArrow(cut, f"doc_id {kind}, n_lines long, n_dropped long, kept string")
