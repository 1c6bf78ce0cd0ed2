"""Secret scans: fixed patterns, and guess-cost estimates of values that stand where credentials stand.

The guess cost of a value is the base-10 logarithm of the guesses that its cheapest segmentation takes. Segments are
listed words, spelled words, dates, repeats, keyboard or alphabet walks, and brute-force characters. A spelled word is one that can
be said: each letter costs by how vowels and consonants follow each other, little where they take turns and up to what brute force
costs where they don't, so that long words of a language stay cheap and random letters don't, in any language of these letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")
#: The assignment pattern of the base scan, then the other words that announce a credential.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|bearer|credentials?|auth|(?:api|access|private|client|secret|signing|encryption)[ _-]?key)"""
    r"""["']?\x20*(?::=|=>|->|[:=])\x20*["']?([^\x00-\x20"'<>,;|]{6,})""", re.I | re.A)
HINTS = (b"passw", b"passp", b"passc", b"pwd", b"secret", b"token", b"bearer", b"credential", b"auth", b"key")
#: Words that guessers try first, commonest first.
WORDS = """password admin welcome login letmein secret token master dragon monkey shadow sunshine princess football baseball
superman batman michael jordan hunter ranger summer winter spring autumn london paris berlin madrid test guest user root
default example sample changeme placeholder none null true false value string key love hello world computer internet
server database company private public service access account money freedom whatever trustno qazwsx starwars""".split()
#: Rows along which fingers walk.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: log10 of the guesses for a walk's start and each further key, and for opening a segment.
WALK_START, WALK_STEP, SEGMENT = 1.6, 0.2, 0.3
#: log10 of the guesses for a spelled word's first letter, for one that takes turns with the one before (vowel and consonant), for the
#: second, third and further ones of a kind in a row, for a change of case inside a word, and for a letter of a script without case.
FIRST, TURN, IN_A_ROW, CASE, UNCASED = 1.0, 0.35, (0.7, 1.1, 1.415), 0.6, 0.4
VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ")
#: Guess cost from which a value in a credential's place counts as a secret.
THRESHOLD = 8.0
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_NEXT = {p for row in ROWS for p in zip(row, row[1:], strict=False)} | {p[::-1] for row in ROWS for p in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d")
_LEET = str.maketrans("@4301$5!7", "aaeoissit")


def _char_cost(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33)


def _runs(value: str, follows) -> Iterator[tuple[int, int]]:
    """Maximal runs [a, b) of three characters or more in which follows(previous, next) holds."""
    a = 0
    for b in range(1, len(value) + 1):
        if b == len(value) or not follows(value[b - 1], value[b]):
            if b - a >= 3:
                yield a, b
            a = b


def _segments(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of the segments that are cheaper than brute force; linear in the value but for listed words."""
    low = value.lower()
    plain = low.translate(_LEET)
    longest = max(map(len, _RANK))
    for a in range(len(value)):
        for b in range(a + 3, min(len(value), a + longest) + 1):
            if rank := _RANK.get(low[a:b]) or _RANK.get(plain[a:b]):
                changed = (low[a:b] != plain[a:b]) + (value[a:b] != low[a:b])
                yield a, b, log10(rank) + 0.3 * changed
        if m := _DATE.match(value, a):
            yield a, m.end(), log10(365 * 60) if len(m[0]) > 4 else log10(120)
    for a, b in _runs(low, lambda x, y: x == y):
        yield a, b, _char_cost(value[a]) + log10(b - a)
    for a, b in _runs(low, lambda x, y: (x, y) in _NEXT):
        yield a, b, WALK_START + WALK_STEP * (b - a)
    for n in range(2, min(9, len(value) // 2 + 1)):  # a block of n characters again and again
        a = 0
        while a + 2 * n <= len(value):
            b = a + n
            while b < len(value) and value[b] == value[b - n]:
                b += 1
            if b - a >= 2 * n:
                yield a, b, sum(map(_char_cost, value[a : a + n])) + log10((b - a) // n)
            a = max(a + 1, b - n + 1)


def _spelled(value: str) -> Iterator[float | None]:
    """What each letter costs as one more of a spelled word, None for other characters."""
    row = 0
    for i, c in enumerate(value):
        before = value[i - 1] if i and value[i - 1].isalpha() else ""
        if not c.isalpha():
            yield None
        elif not before:
            row = 0
            yield FIRST
        elif c.lower() == c.upper():
            yield UNCASED
        else:
            row = row + 1 if (c.lower() in VOWELS) == (before.lower() in VOWELS) else 0
            inside = i > 1 and value[i - 2].isalpha() or c.isupper()  # Word and WORD, but not wORD or WoRD
            yield (IN_A_ROW[min(row, 3) - 1] if row else TURN) + (CASE if inside and c.isupper() != before.isupper() else 0)


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation of a value; 0 for an empty one."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in _segments(value):
        ends.setdefault(b, []).append((a, cost + SEGMENT))
    # brute and spelled: the last segment is brute force or a spelled word, which opens once
    best, brute, spelled = [0.0], float("inf"), float("inf")
    for i, letter in enumerate(_spelled(value), 1):
        c = _char_cost(value[i - 1])
        brute = min(brute + c, best[i - 1] + c + SEGMENT)
        spelled = float("inf") if letter is None else min(spelled + letter, best[i - 1] + max(letter, FIRST) + SEGMENT)
        best.append(min([brute, spelled, *(best[a] + cost for a, cost in ends.get(i, ()))]))
    return best[-1]


def find_secrets(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, value start) in code points, by start and then kind; the base kinds stay whatever the cost.

    A guess within one assignment isn't listed again; one that goes on where the assignment's pattern ends is.
    """
    text = text or ""
    spans = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(h in raw for h in HINTS):
        taken = []
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append(("assign", m.start(), m.end(), m.start(2)))
                taken.append((m.start(), m.end()))
        at = 0
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            b -= len(m[1]) - len(m[1].rstrip(".!?)]}"))
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if b - a >= 6 and not (at < len(taken) and taken[at][0] <= a and b <= taken[at][1]) and guess_cost(text[a:b]) >= threshold:
                spans.append(("guess", a, b, a))
    if "AKIA" in text:
        spans += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str, spans: list[tuple[str, int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each value replaced once; an assignment keeps its name."""
    out, at = [], 0
    for a, b in sorted((s[3], s[2]) for s in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of every row, ordered by start, then kind.

    A null or empty text has an empty list. Repeated rows and null ids stay, other columns aren't read, texts are
    searched whole, an empty table gives an empty result. A map over rows: no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": s[0], "start": s[1], "end": s[2]} for s in find_secrets(t.as_py(), threshold)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, of)], ["id", "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(find, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every secret's value replaced by a mark, and length_col, where there is one, counted anew.

    Rows without a secret, null texts among them, are returned as they were.
    """
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, k = b.column(names.index(text_col)).to_pylist(), names.index(text_col)
            changed = {i: redacted(t, s) for i, t in enumerate(texts) if t and (s := find_secrets(t, threshold))}
            columns = list(b.columns)
            columns[k] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[k].type)
            if length_col in names:
                n = names.index(length_col)
                counts = columns[n].to_pylist()
                columns[n] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(counts)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(clean, docs.schema)
