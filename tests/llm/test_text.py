"""Secrets, HTML, quality, tokens, packing: by definition, by the libraries and on edge cases."""

import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import html_text, packing, quality, secrets, token_counts

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "plain words of a text"), (4, "plain words of a text"), (None, "x"), (5, "long " * 40_000), (6, "ünïcode ☃ 漢字 ▁ <s> <|endoftext|> 😀")]
MIXED = st.lists(st.sampled_from([*"ab é'sLl ▁\n\t  7漢.☃ \u3000\x85", "<|endoftext|>", "don't", "</s>"]), max_size=50).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, max_size=4))
def test_piece_counts_equal_the_library(texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.count_texts(texts, path) == [len(whole.encode(t)) for t in texts]


def test_piece_counts_of_split_texts(monkeypatch, corpus):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in corpus.collect()]
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts.batches_by_bytes, "__defaults__", (100,))
    assert token_counts.count_texts(texts, path) == [len(x) for x in whole.encode(texts)]


def test_token_counts_edges(spark, table):
    got = token_counts.count_tokens(table(ODD), P.path("piece_bpe_32k.model")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].n_tokens == by[2].n_tokens == by[1].n_bytes == 0 and by[5].over_limit and not by[4].over_limit
    assert token_counts.count_tokens(table([]), P.path("piece_bpe_32k.model")).count() == 0


@pytest.fixture(scope="module")
def reader():
    return packing.WordIds(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_ids_equal_the_library(reader, text):
    assert reader.ids(text).tolist() == reader.library.encode(text, add_special_tokens=False).ids


def test_ids_of_segments(reader, corpus, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 64)
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    for r in corpus.collect():
        assert reader.ids(r.text).tolist() == reader.library.encode(r.text, add_special_tokens=False).ids


def check_packing(rows, docs, reader, size):
    import numpy as np

    ids = {i: reader.library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs}
    copies, pieces, sequences = Counter(i for i, _ in docs), {}, {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, n in copies.items():
        covered = Counter(k for s, n_ in pieces[i] for k in range(s, s + n_))
        assert covered == Counter({k: n for k in range(len(ids[i]))})
    lengths = []
    for at in sequences.values():
        end = 0
        for o, n in sorted(at):
            assert o == end
            end += n
        assert end <= size
        lengths.append(end)
    return lengths


def test_packing_is_a_partition_of_all_ids(spark, corpus, reader):
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for df in (corpus, corpus.repartition(5, "doc_id")):
        lengths = check_packing(packing.pack(df, *args).collect(), docs, reader, 2048)
        assert sum(2048 - n for n in lengths) < 0.02 * 2048 * len(lengths)


def test_packing_edges(spark, table, reader):
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    check_packing(packing.pack(table(ODD), *args, size=64, windows=2).collect(), ODD, reader, 64)
    assert packing.pack(table([]), *args).count() == 0


def brute_secrets(text):
    """The base scan, as it is stated."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append(("assign", m.start(), m.end()))
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


SECRETS = st.lists(st.sampled_from(["password", "PassWd", "token", "secret", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "abcdef", "AKIA", "ABCDEFGH0123456789", "0123456789abcdef", "ſecret", "pwd", "é", "\n", "hunter2", "x9Kq2!Lm8#"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(SECRETS)
def test_base_secrets_by_definition(text):
    assert [s[:3] for s in secrets.find_secrets(text) if s[0] != "guess"] == brute_secrets(text)
    once = secrets.redacted(text, secrets.find_secrets(text))
    assert not secrets.find_secrets(text) or once != text


def brute_cost(value):
    best = [0.0] + [1e9] * len(value)
    segments = list(secrets._segments(value))
    for b in range(1, len(value) + 1):
        for a in range(b):
            brute = secrets.SEGMENT + sum(map(secrets._char_cost, value[a:b]))
            letters = list(secrets._spelled(value))[a:b]
            said = 1e9 if None in letters else secrets.SEGMENT + max(letters[0], secrets.FIRST) + sum(letters[1:])
            best[b] = min([best[b], best[a] + brute, best[a] + said, *(best[a] + c + secrets.SEGMENT for x, y, c in segments if (x, y) == (a, b))])
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abqwerty123456!Pp0o$", max_size=16))
def test_guess_cost_is_the_cheapest_segmentation(value):
    assert abs(secrets.guess_cost(value) - brute_cost(value)) < 1e-9


def test_values_that_go_on_after_an_assignment_are_hidden_whole():
    text = "token = 'hunter22#Xq9!vT4z' end"
    found = secrets.find_secrets(text)
    assert [(k, text[v:b]) for k, _, b, v in found] == [("assign", "hunter22"), ("guess", "hunter22#Xq9!vT4z")]
    assert secrets.redacted(text, found) == "token = '[SECRET]' end"
    for name in ("userPassword", "dbpassword", "myToken", "db2pwd"):
        text = f"{name}: x9#Kq2!Lm8 and so on"
        assert secrets.redacted(text, secrets.find_secrets(text)) == f"{name}: [SECRET] and so on"
    assert [s[0] for s in secrets.find_secrets("pwd: token=hunter22xkq9; password=hunter22xkq9.")] == ["assign", "assign"]


def test_guess_cost_orders_values():
    weak = ["password", "qwertyuiop", "aaaaaaaaaa", "19870412", "abcabcabc", "dragon123456", "required", "placeholder"]
    strong = ["x9Kq2!Lm8#", "b7db7aa4a5fcc78305", "Zr4-tM9_pQ71"]
    weak += ["authentication", "configured", "Strength", "vergessen", "contraseña", "nécessaire"]
    strong += ["hGjKzQvXbNmLpRtYwsDfCxZq", "qkzjxhvwmbtrplsdfgn", "kqzjxhvwmbtrplsd"]
    assert max(map(secrets.guess_cost, weak)) < secrets.THRESHOLD < min(map(secrets.guess_cost, strong))


def test_random_letters_are_found_and_prose_is_not():
    for text in ("pwd: hGjKzQvXbNmLpRtYwsDfCxZq", 'api key: "qkzjxhvwmbtrplsdfgn"', "auth = kqzjxhvwmbtrplsd"):
        assert [s[0] for s in secrets.find_secrets(text)] == ["guess"]
    assert not secrets.find_secrets("passphrase: required for everyone. auth: authentication by card; pwd = something else")


def test_context_values_are_found_and_hidden(spark, table):
    text = 'db pwd: "x9Kq2!Lm8#" and passphrase is long; auth: required. api_key=abcdef123'
    kinds = [s[0] for s in secrets.find_secrets(text)]
    assert kinds == ["guess", "assign"]
    rows = table([*ODD, (9, text), (10, None)]).selectExpr("doc_id", "text", "length(text) as n_chars", "runs")
    out = {r.doc_id: r for r in secrets.redact(rows).collect()}
    assert "x9Kq2" not in out[9].text and "abcdef123" not in out[9].text and out[9].n_chars == len(out[9].text) and "passphrase is long" in out[9].text
    assert out[4].text == ODD[3][1] and out[10].text is None and secrets.redact(rows).count() == 10
    found = secrets.scan(table([*ODD])).collect()
    assert len(found) == len(ODD) and all(r.spans == [] for r in found) and secrets.scan(table([])).count() == 0


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"), ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b", "a\nb"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><tr><th colspan=2>h<td>x</table>", "h    x"),
    ("<p hidden>a</p><p style='display: none'>b</p>c<script>d</script><style>e</style>", "c"), ("<!-- a --><title>t</title>b &amp; &lt;c&gt;", "b & <c>"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("a < b and <3", "a < b and <3"), ("<b>a</b><i>b</i> c", "ab c"), ("<head><title>x</title><p>in body", "in body"),
    ("<p>a</p></div></p>b", "a\n\nb"), ("", ""), (None, ""), ("<div " * 3 + "a='>'>x", "x"), ("<ol start=3><li>a</li></ol>", "3. a")])
def test_html(html, text):
    assert html_text.html_to_text(html) == text


def test_html_keeps_every_visible_word_and_any_depth():
    assert html_text.html_to_text("<div>" * 50_000 + "deep") == "deep"
    assert html_text.html_to_text("<table><tr><td>" * 2000 + "deep") == "deep"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<b>", "</b>", "one ", "two ", "<br>", "<div>", "</div>", "<pre>", "&amp; "]), max_size=25))
def test_html_words_survive(parts):
    want = Counter(x for x in re.sub("<[^>]*>", " ", "".join(parts)).replace("&amp;", "&").split())
    got = Counter(x for x in html_text.html_to_text("".join(parts)).replace("-", " ").split())
    assert got == want or Counter("".join(sorted(want.elements()))) == Counter("".join(sorted(got.elements())))


@pytest.mark.parametrize(("html", "text"), [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
    ("<table><tr><td>x<td colspan=2 rowspan=2>yy<td>z<tr><td>p<td>q</table>", "x  yy    z\np        q"),
    ("<table><tr><td>a<br>bb<td><ul><li>c<li>d</ul></table>", "a   - c\nbb  - d"),
    ("<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd<td>e</table></table>", "a  b   c\n   dd  e"),
    ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</p>", "b"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"), ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"),
    ("<table><tr><td>" + "w" * 60 + "<td>a<tr><td>b<td>c</table>", "w" * 60 + "  a\nb" + " " * 61 + "c")])
def test_html_layout(html, text):
    assert html_text.html_to_text(html) == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=4), min_size=1, max_size=5))
def test_html_cells_start_in_their_columns(spans):
    """Against a grid that is filled square by square: cells of one column begin at one place, and columns are in order."""
    html, grid, place, n = "<table>", {}, {}, 0
    for y, row in enumerate(spans):
        html += "<tr>"
        for wide, deep in row:
            x = next(i for i in range(100) if (i, y) not in grid)
            grid |= {(i, j): n for i in range(x, x + wide) for j in range(y, y + deep)}
            html += f"<td colspan={wide} rowspan={deep}>c{n:03d}"
            place[f"c{n:03d}"] = x
            n += 1
    got = {}
    for line in html_text.html_to_text(html + "</table>").split("\n"):
        for name in line.split():
            got.setdefault(place[name], set()).add(line.index(name))
    assert set(got) == set(place.values()) and all(len(x) == 1 for x in got.values())
    at = [min(got[x]) for x in sorted(got)]
    assert at == sorted(set(at))


def test_html_long_cells_lose_nothing():
    words = [f"word{i}" for i in range(3000)] + ["x" * 2500]
    got = html_text.html_to_text(f"<table><tr><td>{' '.join(words)}<td>next</table>")
    assert "".join(got.replace("next", "", 1).split()) == "".join(words) and max(map(len, got.split("\n"))) < 1100


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (None, "")], "page_id long, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect()) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


def brute_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, table):
    rows = [*ODD, (7, "a b c d e " * 4 + "\n# x\n# x\n"), (8, "one two three four five six " * 2), (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 ***")]
    got = quality.verdicts(quality.ledger(table(rows))).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_quality(t)) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert not by[1].kept and not by[7].kept and by[9].kept
    assert quality.ledger(table([])).count() == 0
    kept = quality.keep_good(table(rows))
    assert [r.doc_id for r in kept.collect()] == [9] and kept.columns == table(rows).columns


def test_quality_ablation(spark):
    book = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 2), (5, 2)], "doc_id long, fail_bits long")
    got = {r.rule: (r.n_failed, r.n_only_this) for r in quality.ablation(book).collect()}
    assert got["few_words"] == (2, 1) and got["repeated_words"] == (3, 2) and got["symbols"] == (0, 0) and len(got) == len(quality.RULES)


def test_quality_runs_without_python(spark, corpus):
    plan = quality.verdicts(quality.ledger(corpus))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_kept_rows_have_their_columns_as_they_were(spark):
    rows = [(1, "ten words are what it takes to be kept here now", "mine", 7, None), (2, "few", "mine", 7, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, `a.b` string").selectExpr("*", "1 as fail_bits", "2 as k", "3 as row", "4 as _at", "5 as t", "6 as w")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.collect() == df.where("doc_id = 1").collect()


def test_a_stored_ledger_serves_policies_and_ablations(spark, corpus):
    book = quality.stored_ledger(corpus)
    assert sorted(book.collect()) == sorted(quality.ledger(corpus).collect())
    base = quality.verdicts(book, "base").where("kept").count()
    lost = {r.rule: r.n_only_this for r in quality.ablation(book).collect()}
    without = book.where(f"fail_bits & {quality.POLICIES['v1'] & ~4} = 0").count() - quality.verdicts(book).where("kept").count()
    assert base >= quality.verdicts(book).where("kept").count() and lost["symbols"] == without
