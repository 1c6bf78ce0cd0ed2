"""Alignment of two tokenizers: groups of tokens between shared byte offsets, and how often each pair of ids is linked.

Texts are read once. A batch of documents leaves its links by stripe of the first side's ids, as an inverted list: pairs in
ascending order, the documents of each and how often they hold it. Pairs are dealt out by stripe, and a stripe adds up the numbers
of documents in one dense matrix (its ids by all ids of the other side); row maxima are the best counts. Links then
meet the matrix of their stripe, in as many parts as a stripe's links need, and what they score goes back to
their batch as sums per document.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import written
from fathomline.llm.packing import _ODD

#: Stripes of the first side's ids; bytes of links to a part of a stripe.
STRIPES, PART_BYTES = 128, 4_000_000
#: Words a worker remembers before the older half is forgotten; words read at once, code points of a chunk of a text.
REMEMBERED, AT_ONCE, CHUNK = 250_000, 200_000, 1_000_000
#: A batch ends with the document that reaches one of these.
BATCH_DOCS, BATCH_LINKS = 8_192, 2_000_000
MARK = "▁"
_SAFE = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")
_HARD = re.compile(rf"\s\s|{MARK}|^ | $")
_readers: dict[tuple, "Pairs"] = {}


class Pairs(dict):
    """A stretch of text between safe spaces -> (groups as text, ids of A, ids of B, groups, pairs as bytes); None where bytes differ.

    Neither tokenizer has a token that crosses a single space between two letters or signs, and both start a token at it, so
    that a text's groups are those of its stretches in a row. Pairs are a * n_b + b, as 64-bit numbers.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, model_path: str) -> None:
        import base64

        import sentencepiece
        import tiktoken
        import tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = tokenizers.Tokenizer.from_file(json_path)
        self.library.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.n_a, self.n_b = self.library.get_vocab_size(with_added_tokens=True), self.model.get_piece_size()
        self.bytes_a = dict(map(reversed, ranks.items()))
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.n_b))]
        self.older: dict[str, tuple | None] = {}

    def learn(self, stretches: set[str]) -> None:
        if len(self) + len(stretches) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        new = []
        for s in stretches - self.keys():
            if s in self.older:
                self[s] = self.older[s]
            else:
                new.append(s)
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.update(zip(part, map(self.record, part, self.model.encode(part, num_threads=1)), strict=True))

    def ids_a(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids if _ODD.search(text) else self.quick.encode_ordinary(text)

    def record(self, text: str, b: list[int]) -> tuple | None:
        a, whole = self.ids_a(" " + text), (" " + text).encode()
        of_a, of_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            return None
        said, pairs, i, j, groups = [], [], 0, 0, 0
        while i < len(a):
            i0, j0, at, to = i, j, len(of_a[i]), len(of_b[j])
            i, j = i + 1, j + 1
            while at != to:
                if at < to:
                    at += len(of_a[i])
                    i += 1
                else:
                    to += len(of_b[j])
                    j += 1
            left, right, groups = a[i0:i], b[j0:j], groups + 1
            said.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            pairs += [x * self.n_b + y for x in left for y in right]
        return ";".join(said), len(a), len(b), groups, np.array(pairs, np.int64).tobytes()

    def document(self, chunks: list[list[str]], text: str) -> tuple[str, int, int, int, int, np.ndarray, np.ndarray]:
        """groups_sha256, ids of A and B, groups, links, distinct pairs and how often each is linked; all stretches are known or learnt here."""
        digest, n_a, n_b, groups, links = sha256(), 0, 0, 0, 0
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, stretches in enumerate(chunks):
            if len(chunks) > 1:
                self.learn(set(stretches))
            found = [self[s] for s in stretches]
            if None in found:
                return self.whole(text)
            digest.update((";" * (k > 0) + ";".join([r[0] for r in found])).encode())
            n_a += sum([r[1] for r in found])
            n_b += sum([r[2] for r in found])
            groups += sum([r[3] for r in found])
            pairs = np.sort(np.frombuffer(b"".join([r[4] for r in found]), np.int64))
            links += len(pairs)
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            own, n = pairs[first], np.diff(np.append(first, len(pairs)))
            keys, times = (own, n) if k == 0 else added(np.concatenate([keys, own]), np.concatenate([times, n]))
        return digest.hexdigest(), n_a, n_b, groups, links, keys, times

    def whole(self, text: str) -> tuple[str, int, int, int, int, np.ndarray, np.ndarray]:
        """As document(), of the text in one: for texts of which a stretch isn't kept as it is."""
        none = np.zeros(0, np.int64)
        found = self.record(text, self.model.encode(text))
        if found is None:
            return "", 0, 0, 0, 0, none, none
        keys, times = np.unique(np.frombuffer(found[4], np.int64), return_counts=True)
        return sha256(found[0].encode()).hexdigest(), *found[1:4], int(times.sum()), keys, times


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their numbers."""
    own, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(own), np.int64)
    np.add.at(out, at, n)
    return own, out


def stretches_of(text: str) -> list[list[str]]:
    """Stretches between safe spaces, in chunks; none for an empty text."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK and (m := _SAFE.search(text, at + CHUNK)):
            end = m.start()
        part = text[at:end]
        out.append(_SAFE.split(part) if _HARD.search(part) else part.split(" "))
        at = end + 1
    return out


def _packed(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel().astype(np.int64)


def _reader(*paths: str) -> Pairs:
    if paths not in _readers:
        _readers[paths] = Pairs(*paths)
    return _readers[paths]


class Batch:
    """Documents of a batch and their links, which leave as rows of `READ`."""

    def __init__(self, ids: pa.DataType, n_b: int) -> None:
        self.ids, self.n_b = ids, n_b
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: pa.Scalar, found: tuple) -> None:
        self.rows.append((doc_id.as_py(), *found[:5]))
        self.keys.append(found[5])
        self.times.append(found[6])
        self.size += len(found[5])

    def full(self) -> bool:
        return len(self.rows) >= BATCH_DOCS or self.size >= BATCH_LINKS

    def leave(self) -> Iterator[pa.RecordBatch]:
        """A row a document, and a row a stripe: pairs, documents of each, and documents and repeats by pair."""
        if not self.rows:
            return
        name, n = uuid.uuid4().int >> 65, len(self.rows)
        doc_id, digest, *counts = zip(*self.rows, strict=True)
        yield self._table(n, batch=[name] * n, doc=list(range(n)), doc_id=doc_id, groups_sha256=digest, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)))
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        docs = np.repeat(np.arange(n), [len(k) for k in self.keys])
        stripe = keys // self.n_b % STRIPES
        order = np.lexsort((docs, keys, stripe))
        keys, times, docs, stripe = keys[order], times[order], docs[order], stripe[order]
        bounds = np.append(np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])), len(keys)) if len(keys) else []
        made = []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            first = i + np.flatnonzero(np.concatenate([[True], keys[i + 1 : j] != keys[i : j - 1]]))
            pairs = keys[first]
            made.append((int(stripe[i]), _packed(np.diff(pairs, prepend=0), "<u4"), _packed(np.diff(np.append(first, j)), "<u2"), _packed(docs[i:j], "<u2"), _packed(times[i:j], "<u4")))
        if made:
            s, pairs, held, docs, times = zip(*made, strict=True)
            yield self._table(len(made), batch=[name] * len(made), stripe=s, pairs=pairs, held=held, docs=docs, times=times)
        self.__init__(self.ids, self.n_b)

    def _table(self, n: int, **cols) -> pa.RecordBatch:
        schema = pa.schema([("doc_id", self.ids), *[(k, v) for k, v in READ_TYPES.items()]])
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


READ = "batch long, doc int, groups_sha256 string, n_a long, n_b long, n_groups long, n_links long, stripe int, pairs binary, held binary, docs binary, times binary"
READ_TYPES = {name: {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind] for name, kind in (c.split() for c in READ.split(", "))}


def read_links(docs: DataFrame, paths: tuple[str, str, str, str]) -> DataFrame:
    """Rows of documents (stripe is null) and of links by stripe, from docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = _reader(*paths), None
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            own = own or Batch(ids.type, reader.n_b)
            at = 0
            while at < b.num_rows:
                end, held, taken, size = at, [], [], 0
                while end < b.num_rows and size < AT_ONCE:
                    text = texts[end].as_py() or ""
                    chunks = stretches_of(text)
                    held.append((chunks, text))
                    if len(chunks) == 1:
                        taken.append(chunks[0])
                    size += sum(map(len, chunks))
                    end += 1
                reader.learn(set().union(*taken))
                for i, (chunks, text) in enumerate(held):
                    if len(chunks) == 1:
                        found = reader.document(chunks, text)
                    elif chunks:
                        continue
                    else:
                        found = reader.whole("")
                    own.add(ids[at + i], found)
                    if own.full():
                        yield from own.leave()
                # texts of several chunks learn on their way, which may forget words of the others: they come last
                for i, (chunks, text) in enumerate(held):
                    if len(chunks) > 1:
                        own.add(ids[at + i], reader.document(chunks, text))
                        if own.full():
                            yield from own.leave()
                at = end
        if own:
            yield from own.leave()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {READ}")


def pair_counts(links: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """stripe, pairs (ascending), counts (documents) and best (the highest count of a pair's first id), each as bytes."""
    height = -(-n_a // STRIPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for s, pairs, held in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s not in blocks:
                    blocks[s] = np.zeros((height, n_b), np.int64)
                keys = np.cumsum(_unpacked(pairs, "<u4"))
                np.add.at(blocks[s], (keys // n_b // STRIPES, keys % n_b), _unpacked(held, "<u2"))
        for s, m in blocks.items():
            at_a, at_b = np.nonzero(m)
            counts, best = m[at_a, at_b], m.max(axis=1)[at_a]
            keys = (at_a * STRIPES + s) * n_b + at_b
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *[pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1)], pa.binary()) for x in (keys, counts, best)]], ["stripe", "pairs", "counts", "best"])

    return links.select("stripe", "pairs", "held").repartitionById(STRIPES, F.col("stripe")).mapInArrow(run, "stripe int, pairs binary, counts binary, best binary")


def _scored(links: pa.Table, counted: pa.Table) -> pa.Table:
    """For each batch the documents that have links here, how many of them are best, and the sum of their counts."""
    keys, counts, best = (np.frombuffer(zlib.decompress(counted.column(c)[0].as_py()), np.int64) for c in ("pairs", "counts", "best")) if counted.num_rows else [np.zeros(0, np.int64)] * 3
    rows = []
    for name, pairs, held, docs, times in zip(*(links.column(c).to_pylist() for c in ("batch", "pairs", "held", "docs", "times")), strict=True):
        at = np.repeat(np.searchsorted(keys, np.cumsum(_unpacked(pairs, "<u4"))), _unpacked(held, "<u2"))
        docs, times, n = _unpacked(docs, "<u2"), _unpacked(times, "<u4"), counts[at]
        own, place = np.unique(docs, return_inverse=True)
        top, total = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        np.add.at(top, place, times * (n == best[at]))
        np.add.at(total, place, times * n)
        rows.append((name, _packed(own, "<u2"), _packed(top, "<u4"), _packed(total, "<u8")))
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["batch", "docs", "top", "total"])


def _gathered(docs: pa.Table, scores: pa.Table) -> pa.Table:
    """Rows of a batch's documents with the sums of their scores."""
    n = docs.num_rows
    top, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for own, t, s in zip(*(scores.column(c).to_pylist() for c in ("docs", "top", "total")), strict=True):
        own = _unpacked(own, "<u2")
        top[own] += _unpacked(t, "<u4")
        total[own] += _unpacked(s, "<u8")
    at = docs.column("doc").to_numpy()
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return out.append_column("n_best", pa.array(top[at])).append_column("count_sum", pa.array(total[at]))


def align(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    A is the byte-level vocabulary, read over a space and the text, B the piece model, which puts a space in front itself. Links are all pairs of
    occurrences in one group; a pair's count is the number of rows that hold it linked, and a link is best if no pair
    of its A id has a higher count. Null and empty texts, and texts that a tokenizer doesn't keep byte by byte, have zeros and an empty digest and
    count nowhere. Repeated rows and null ids are rows of their own; other columns aren't read; an empty table gives an empty result. A text of any
    length is read in chunks that end at safe spaces. What was read is written to the shared folder once, so that batches keep their names.
    """
    from pathlib import Path

    paths = (json_path, ranks_path, pattern, model_path)
    missing = [p for p in (json_path, ranks_path, model_path) if not Path(p).exists()]
    if missing:
        raise FileNotFoundError(f"vocabulary files: {missing}")
    sizes = _reader(*paths)
    read = written(read_links(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), paths))
    kind = read.schema["doc_id"].dataType.simpleString()
    links = read.where("stripe is not null").select("batch", "stripe", "pairs", "held", "docs", "times")
    counted = pair_counts(links, sizes.n_a, sizes.n_b)
    weight = F.sum(F.octet_length("pairs") + F.octet_length("held") + F.octet_length("docs") + F.octet_length("times"))
    # a row a stripe, so that this is no larger than the number of stripes
    parts = F.broadcast(links.groupBy("stripe").agg((1 + F.floor(weight / PART_BYTES)).cast("int").alias("parts")))
    dealt = links.join(parts, "stripe").withColumn("part", F.pmod(F.xxhash64("batch"), "parts").cast("int")).drop("parts")
    copies = counted.join(parts, "stripe").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    scores = dealt.groupBy("stripe", "part").cogroup(copies.groupBy("stripe", "part")).applyInArrow(_scored, "batch long, docs binary, top binary, total binary")
    rows = read.where("stripe is null").select("batch", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.groupBy("batch").cogroup(scores.groupBy("batch")).applyInArrow(_gathered, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
