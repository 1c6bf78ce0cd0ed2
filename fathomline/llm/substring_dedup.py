"""Substring dedup: removal of long word spans that a document with a smaller id has too.

Windows of `window` words are the edges of a De Bruijn graph, whose nodes are their ends. As in compaction by
minimizers, the edges are dealt into buckets by the smallest hash among the short k-mers in them, which depends on
a window's words alone. Neighbouring windows of a document in one bucket are a path; equal paths of several
documents are joined into one repeated path with the smallest source coordinate. Where all occurrences in a bucket are the
same path it doesn't branch, and its occurrences outside the smallest document are covered as a whole. Where paths
of a bucket differ, one occurrence of each is opened into its windows, which are joined one by one; what they cover is
carried over to the other occurrences of their path in the same document. Source coordinates (document, first word, count)
give the spans, and 128-bit digests of the words at these coordinates verify equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import written

PATH = "bucket long, h1 long, h2 long, doc_id {id}, first int, n int, back int"


def words_of(text: str | None) -> list[bytes]:
    """Words between space and the controls 9 to 13, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def digests(words: list[bytes], spans) -> "numpy.ndarray":  # noqa: F821
    """128-bit digests, as rows of two signed longs, of the words [a, b) for each (a, b), joined by one space."""
    import numpy as np
    import xxhash

    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = np.asarray(spans, np.int64).reshape(-1, 2).T
    at = zip(starts[a].tolist(), ends[b - 1].tolist(), strict=True)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[s:e]) for s, e in at]), ">i8").astype("<i8").reshape(-1, 2)


def bucket_runs(words: list[bytes], window: int, kmer: int) -> tuple["numpy.ndarray", "numpy.ndarray", "numpy.ndarray"]:  # noqa: F821
    """Runs of neighbouring windows with one bucket: bucket, first window, windows."""
    import numpy as np
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, mix = len(words) - kmer + 1, np.zeros(len(words) - kmer + 1, np.uint64)
    for j in range(kmer):
        mix = (mix * np.uint64(0x9E3779B97F4A7C15)) + h[j : j + n]
    mix ^= mix >> np.uint64(29)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    mix ^= mix >> np.uint64(32)
    least, width, wide = mix, 1, window - kmer + 1
    while width < wide:
        step = min(width, wide - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first].view(np.int64), first, np.diff(np.append(first, len(least)))


def _batch(columns: list, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    import numpy as np

    types = {"doc_id": id_type, "first": pa.int32(), "n": pa.int32(), "back": pa.int32(), "at": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c if n == "doc_id" else (np.concatenate(c) if c else []), types.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names)


def paths(docs: DataFrame, window: int, kmer: int, id_col: str, text_col: str) -> DataFrame:
    """The occurrences of paths: PATH, a row for each run of windows in one bucket.

    An occurrence repeats the first one of its path in the document, `back` words before; 0 for the first one itself.
    """
    kind, names = docs.schema[id_col].dataType.simpleString(), ["bucket", "h1", "h2", "doc_id", "first", "n", "back"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if len(w := words_of(text.as_py())) < window:
                    continue
                bucket, first, n = bucket_runs(w, window, kmer)
                d = digests(w, list(zip(first, first + n + window - 1, strict=True)))
                _, lead, of = np.unique(d[:, 0], return_index=True, return_inverse=True)
                back = np.where(d[:, 1] == d[lead[of], 1], first - first[lead[of]], 0)
                for c, x in zip(out, (bucket, d[:, 0], d[:, 1], [doc] * len(n), first, n, back), strict=True):
                    c.extend(x) if x.__class__ is list else c.append(x)
            yield _batch(out, names, b.schema.field(0).type)

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col)).mapInArrow(run, PATH.format(id=kind))


def opened(docs: DataFrame, chosen: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The windows (w1, w2, doc_id, at) of chosen path occurrences (doc_id, first, n)."""
    kind, names = docs.schema[id_col].dataType.simpleString(), ["w1", "w2", "doc_id", "at"]
    asked = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(asked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                at = sorted({i for r in runs.as_py() for i in range(r["first"], r["first"] + r["n"])})
                d = digests(words_of(text.as_py()), [(i, i + window) for i in at])
                for c, x in zip(out, (d[:, 0], d[:, 1], [doc] * len(at), at), strict=True):
                    c.extend(x) if c is out[2] else c.append(x)
            yield _batch(out, names, b.schema.field(0).type)

    return texts.mapInArrow(run, f"w1 long, w2 long, doc_id {kind}, at int")


def repeated_runs(docs: DataFrame, window: int = 50, kmer: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, n, back): n windows from word `first` on whose words also start in a document with a smaller id.

    Where back > 0, the windows are those that start `back` words before in the document, and share their fate.
    """
    found = written(paths(docs, window, kmer, id_col, text_col))
    joined = written(
        found.groupBy("bucket", "h1", "h2").agg(F.min(F.struct("doc_id", "first", "n")).alias("source"), F.max("doc_id").alias("last"))
        .withColumn("shared", F.col("last") > F.col("source.doc_id")).drop("last"))
    again = found.where("back > 0").select("doc_id", "first", "n", "back")
    whole = found.join(joined.where("shared"), ["bucket", "h1", "h2"]).where(F.col("doc_id") > F.col("source.doc_id")).select("doc_id", "first", "n", F.lit(0).alias("back"))
    branching = joined.groupBy("bucket").agg(F.count("*").alias("paths")).where("paths > 1").drop("paths")
    chosen = joined.join(branching, "bucket").select("source.*")
    edges = written(opened(docs, chosen, window, id_col, text_col))
    least = edges.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")
    single = edges.join(least, ["w1", "w2"]).where("doc_id > least").select("doc_id", F.col("at").alias("first"), F.lit(1).alias("n"), F.lit(0).alias("back"))
    return whole.unionByName(single).unionByName(again)


def remove_repeats(docs: DataFrame, window: int = 50, kmer: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, joined by one space) and spans of removed words for every row.

    Windows are judged on the input. A null or empty text, or one of fewer than `window` words, loses nothing.
    An id names one text: repeated rows of it are treated alike and don't remove each other. Rows with a null id are
    kept whole and remove nothing. Other columns aren't read; an empty table gives an empty result. What a task
    holds is the text and the spans of one batch of documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    runs = repeated_runs(docs, window, kmer, id_col, text_col)
    spans = runs.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "back")).alias("runs"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out: list[tuple] = []
            for text, found in zip(b.column(1), b.column(2), strict=True):
                w = words_of(text.as_py())
                runs, edge = found.as_py() or (), np.zeros(len(w) + 1, np.int64)
                for r in runs:
                    if not r["back"]:
                        edge[r["first"]] += 1
                        edge[r["first"] + r["n"]] -= 1
                starts = np.cumsum(edge)[:-1] > 0
                for a, n, back in [(r["first"], r["n"], r["back"]) for r in runs if r["back"]] if starts.any() else ():
                    starts[a : a + n] |= starts[a - back : a - back + n]
                on = np.diff(np.concatenate([[False], starts, [False]]).astype(np.int8))
                edge = np.zeros(len(w) + window, np.int64)
                np.add.at(edge, np.flatnonzero(on > 0), 1)
                np.add.at(edge, np.flatnonzero(on < 0) + window - 1, -1)
                gone = np.cumsum(edge)[: len(w)] > 0
                kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(w)
                at = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                out.append((len(w), int(gone.sum()), kept, [{"start": s, "end": e} for s, e in zip(at[::2], at[1::2], strict=True)]))
            n, removed, kept, cut = zip(*out, strict=True) if out else ([],) * 4
            texts = pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())
            of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), texts, pa.array(cut, of)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<start:bigint,end:bigint>>")
