"""Token counts of whole texts, without keeping a token.

Texts reach Arrow functions in batches that are cut again by bytes. A piece model that never merges
across the start of a space-led word lets a text be split at single spaces; each distinct piece
is encoded once per worker and only its length is kept. The counts equal those for the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces a worker remembers before the older half is forgotten, bytes of text in a batch, bytes in a library call.
REMEMBERED, BATCH_BYTES, CALL_BYTES = 250_000, 4_000_000, 262_144
#: U+2581 stands for a space inside the piece model, so a space next to one is no safe boundary.
MARK = "▁"
_SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
_models: dict[str, "PieceLengths"] = {}


class PieceLengths(dict):
    """Piece -> number of tokens, for one sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model, self.older = sentencepiece.SentencePieceProcessor(model_file=path), {}

    def learn(self, pieces: set[str]) -> None:
        batch, size = [], 0
        if len(self) + len(pieces) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        for p in pieces - self.keys():
            if (n := self.older.get(p)) is not None:
                self[p] = n
                continue
            batch.append(p)
            size += n_bytes(p)
            if size > CALL_BYTES:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        if batch:
            self.update(zip(batch, map(len, self.model.encode(batch, num_threads=1)), strict=True))


def pieces_of(text: str) -> list[str]:
    """The parts of a text between safe single spaces."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return _SAFE.split(text)
    return text.split(" ")


def _model(path: str) -> PieceLengths:
    if path not in _models:
        _models[path] = PieceLengths(path)
    return _models[path]


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def reach(text: str, at: int, limit: int) -> int:
    """Where limit bytes of UTF-8 from at on end, in code points; a character that is cut counts as after it."""
    head = text[at : at + limit]
    return at + (len(head) if head.isascii() else len(head.encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore")))


def batches_by_bytes(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """(row, segment) lists of about limit bytes of UTF-8; a longer text is cut at safe spaces."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = len(text)
            if (till := reach(text, at, limit)) < end and (m := _SAFE.search(text, till)):
                end = m.start()
            batch.append((row, text[at:end]))
            size += n_bytes(text[at:end])
            if size >= limit:
                yield batch
                batch, size = [], 0
            if end == len(text):
                break
            at = end + 1
    if batch:
        yield batch


def count_texts(texts: list[str | None], path: str) -> list[int]:
    lengths, counts = _model(path), [0] * len(texts)
    for batch in batches_by_bytes(texts):
        split = [(row, pieces_of(s)) for row, s in batch]
        lengths.learn({p for _, pieces in split for p in pieces})
        for row, pieces in split:
            counts[row] += sum(map(lengths.__getitem__, pieces))
    return counts


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are kept as they are; other
    columns aren't read. An empty table gives an empty result. A text of any length is counted whole, cut
    at spaces where no piece can cross. A map over the input: nothing is shuffled and any lost task is
    run again from its own rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_texts(b.column(1).to_pylist(), model_path), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
