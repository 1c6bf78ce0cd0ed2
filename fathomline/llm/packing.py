"""Packing token ids into sequences: bounded-space best fit in each partition, leftovers merged at the end.

Each partition keeps a fixed number of open windows. A document's ids are cut into full windows; the rest goes
to the open window that it fills best. When none has room, the fullest is topped up with the first ids of the
rest, emitted full, and what remains is placed anew, so no padding arises there. At the end of a partition the
open windows are topped up from each other until one is left at most; these leftovers are merged over groups
of partitions by the same rule, without further cuts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import checkpoint

#: Distinct words a worker remembers before the older half is forgotten; code points tokenised at once.
REMEMBERED, SEGMENT = 250_000, 1_000_000
#: The special text of the vocabulary and the largest code point that the fast path takes.
SPECIAL, PLAIN = "<|endoftext|>", "ɏ"
PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(rf"[^\x00-{PLAIN}]")
_DOUBLE = re.compile(r"\s\s")
_tokenizers: dict[str, "WordIds"] = {}


class WordIds(dict):
    """' ' + word -> ids, by a byte-level BPE whose pre-tokens never cross a single space inside a text.

    Words of long-assigned letters go to the quick reader of the same vocabulary; others, whose letter class may
    differ between readers, and texts with the special string go to the library itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken
        import tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = tokenizers.Tokenizer.from_file(json_path)
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (ids := self.older.get(word)) is None:
            ids = tuple(self.encode(" " + word))
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if SPECIAL in text or _ODD.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def ids(self, text: str) -> array:
        """All ids of a text, read in segments that end at safe spaces."""
        out, at = array("I"), 0
        if SPECIAL in text:
            out.extend(self.library.encode(text, add_special_tokens=False).ids)
            return out
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT and (m := _SAFE.search(text, at + SEGMENT)):
                end = m.start()
            inner = at > 0  # then text[at] is the space of the first word
            part = text[at + inner : end]
            parts = _SAFE.split(part) if _DOUBLE.search(part) else part.split(" ")
            if not inner:
                out.extend(self.encode(parts.pop(0)))
            out.extend(chain.from_iterable(map(self.__getitem__, parts)))
            at = end
        return out


def word_ids(json_path: str, ranks_path: str, pattern: str) -> WordIds:
    if json_path not in _tokenizers:
        _tokenizers[json_path] = WordIds(json_path, ranks_path, pattern)
    return _tokenizers[json_path]


class Windows:
    """A fixed number of open windows; pieces are (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, doc, start: int, ids: array, total: int) -> Iterator[tuple[int, list]]:
        """Put a document's ids into windows; yields each window that is now full."""
        at = 0
        while len(ids) - at >= self.size:
            yield self._new(), [(doc, start + at, ids[at : at + self.size], total)]
            at += self.size
        while at < len(ids):
            n = len(ids) - at
            k = bisect_left(self.rooms, (n, -1))
            if k == len(self.rooms) and len(self.rooms) < self.most:
                w = self._new()
                self.held[w] = []
                insort(self.rooms, (self.size, w))
                continue
            room, w = self.rooms.pop(k if k < len(self.rooms) else 0)
            take = min(room, n)
            self.held[w].append((doc, start + at, ids[at : at + take], total))
            at += take
            if room == take:
                yield w, self.held.pop(w)
            else:
                insort(self.rooms, (room - take, w))

    def close(self) -> Iterator[tuple[int, list, bool]]:
        """Top the fullest windows up with the pieces of the emptiest; at most one stays open (True)."""
        left = sorted((w for _, w in self.rooms), key=lambda w: sum(len(p[2]) for p in self.held[w]))
        spare = [p for w in left for p in self.held[w]][::-1]
        now, room = [], self.size
        while spare:
            doc, start, ids, total = spare.pop()
            take = min(room, len(ids))
            now.append((doc, start, ids[:take], total))
            room -= take
            if take < len(ids):
                spare.append((doc, start + take, ids[take:], total))
            if not room:
                yield self._new(), now, False
                now, room = [], self.size
        if now:
            yield self._new(), now, True
        self.rooms, self.held = [], {}

    def _new(self) -> int:
        self.next += 1
        return self.next - 1


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int = 1, size: int = 2048, windows: int = 64,
         group: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece; a null or empty text is the end id alone. Repeated rows and null
    ids are packed like others; other columns aren't read. An empty table gives no piece. A text is read in
    segments, and the ids of one document and of the open windows are all that a task holds. Windows depend on
    the rows of a partition alone, in their order, so a lost task that runs again makes the same ones.
    Leftovers (one window a partition) are merged within groups of `group` partitions.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        to_ids, open_windows, out = word_ids(json_path, ranks_path, pattern), Windows(size, windows), []

        def rows(w: int, pieces: list, is_open: bool) -> None:
            offset = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids), total, (part << 32) + w, offset, part, is_open))
                offset += len(ids)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 9
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:8]], pa.array(columns[8], pa.bool_())], names)

        names, id_type = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "open"], None
        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = to_ids.ids(text.as_py() or "")
                ids.append(end_id)
                for w, pieces in open_windows.place(doc, 0, ids, len(ids)):
                    rows(w, pieces, False)
            yield batch()
        if id_type is not None:
            for w, pieces, is_open in open_windows.close():
                rows(w, pieces, is_open)
            yield batch()

    made = checkpoint(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(fill, PIECE.format(id=kind)))

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        """Best fit, longest first, without cuts; ids of merged windows are negative, so they meet no other."""
        order = pieces.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        rooms: list[tuple[int, int]] = []
        seq, off, used, n = [], [], {}, 0
        for length in order.column("length").to_pylist():
            k = bisect_left(rooms, (length, -1))
            if k == len(rooms):
                w, n, room = n, n + 1, size
                used[w] = 0
            else:
                room, w = rooms.pop(k)
            seq.append(-1 - ((key[0].as_py() << 32) + w))
            off.append(used[w])
            used[w] += length
            if room > length:
                insort(rooms, (room - length, w))
        for name, values in (("sequence_id", seq), ("offset", off)):
            order = order.set_column(order.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return order

    left = made.where("open").withColumn("part", F.floor(F.col("part") / group).cast("long"))
    merged = left.groupBy("part").applyInArrow(merge, PIECE.format(id=kind))
    return made.where("not open").unionByName(merged).drop("part", "open")
