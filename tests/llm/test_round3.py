"""Line dedup, token links and ball trees: by definition, against brute force, and on edge cases."""

import base64
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, isfinite

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import ball_tree, html_text, line_dedup, lm_score, queries, token_links

LINE = "This passage stands in very many documents, word by word."


def plain_lines(rows, least_chars=40, least_docs=5):
    """(n_lines, n_dropped, kept) of each row, by definition."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            ids = held[key(x)]
            top = max((j for j in ids if j is not None), default=None)
            if len(key(x)) < least_chars or len(ids) < least_docs or top is None or i == top:
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines_by_operator(df, **more):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_shared_lines(df, **more).collect()], key=repr)


def test_lines_of_the_corpus(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want = plain_lines(rows)
    assert lines_by_operator(corpus) == want and sum(w[2] for w in want) > 0


def test_line_edges(table):
    rows = [(1, None), (2, ""), (3, f"{LINE}\n\n  {LINE.upper()}\t\r\nshort"), (4, f"a\n{LINE}"), (5, LINE), (6, f"\x0b{LINE}\nÉ{LINE}"), (6, f"{LINE}\nb"), (7, f"é{LINE}\n" * 300), (None, f"{LINE}\n{'x' * 40}"),
            (None, "x" * 40), (8, LINE + "\n"), (8, LINE + "\n"), (9, " ".join("ü" * 39)), (10, "long word " * 30_000 + "\n" + LINE)]
    assert lines_by_operator(table(rows)) == plain_lines(rows)
    only_null = [(None, LINE)] * 6
    assert lines_by_operator(table(only_null)) == plain_lines(only_null)
    assert lines_by_operator(table([])) == []


def test_lines_of_other_ids_and_split_shards(table, monkeypatch, corpus):
    rows = [(f"d{i:03}", f"{LINE}\nown {i}\n{LINE}") for i in range(200)]
    monkeypatch.setattr(line_dedup, "PART_DOCS", 20)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 2)
    assert lines_by_operator(table(rows, "doc_id string, text string")) == plain_lines(rows)
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 50)
    assert lines_by_operator(corpus.repartition(7), least_chars=10, least_docs=2) == plain_lines(rows, 10, 2)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=400))
def test_perfect_hash_is_minimal(keys):
    h, f = (np.array([k[i] for k in sorted(keys)], np.uint64) for i in (0, 1))
    found = line_dedup.PerfectHash.of(h, f)
    assert sorted(found.index(h, f).tolist()) == list(range(len(keys)))


def test_perfect_hash_tells_equal_halves_apart():
    h, f = np.zeros(1000, np.uint64), np.arange(1000, dtype=np.uint64)
    found = line_dedup.PerfectHash.of(h, f)
    assert sorted(found.index(h, f).tolist()) == list(range(1000)) and sorted(line_dedup.PerfectHash.of(f, h).index(f, h).tolist()) == list(range(1000))
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.of(h[:2], h[:2])


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        of_a = {int(b): base64.b64decode(x) for x, b in map(bytes.split, f)}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, of_a, b, of_b


def plain_groups(text, libraries):
    """Groups ([a ids], [b ids]) of a whole text by both libraries; none where bytes differ."""
    a, of_a, b, of_b = libraries
    if not text:
        return []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba, bb = [of_a[i] for i in ia], [of_b(i) for i in ib]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return []
    ea, eb = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
    cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
    groups = [([], []) for _ in cuts]
    for side, ends, ids in ((0, ea, ia), (1, eb, ib)):
        for k, i in zip(np.searchsorted(cuts, ends), ids):
            groups[k][side].append(i)
    return groups


def plain_links(rows, libraries):
    every = [(i, plain_groups(t, libraries)) for i, t in rows]
    links = [[(a, b) for x, y in g for a in x for b in y] for _, g in every]
    count = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, g), own in zip(every, links):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


PATHS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))


def links_by_operator(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted([tuple(r[c] for c in names) for r in token_links.align(df, *PATHS).collect()], key=repr)


def test_links_of_the_corpus(corpus, libraries):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert links_by_operator(corpus) == plain_links(rows, libraries)


def test_link_edges(table, libraries, monkeypatch):
    rows = [(1, None), (2, ""), (3, " "), (4, "  \n\t two  spaces \n"), (5, "<|endoftext|> as <s> plain </s> text <0x41>"), (6, "a ▁ mark▁ed"), (7, "naïve 漢字 😀☃   ﬁ é é"), (7, "same id"), (7, "same id"), (None, "no id"),
            (8, "xyz" * 5000), (9, "many words of one text that is long " * 3000), (10, "\x00\x1c\x85 　")]
    assert links_by_operator(table(rows)) == plain_links(rows, libraries)
    monkeypatch.setattr(token_links, "CHUNK", 50)
    reader = token_links.Pairs(*PATHS)
    for _, text in rows:
        chunks = token_links.stretches_of(text or "")
        reader.learn(set().union(*map(set, chunks)))
        got = reader.document(chunks, text) if chunks else reader.whole("")
        groups = plain_groups(text, libraries)
        assert got[1:4] == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups))
    assert links_by_operator(table([])) == []


def test_links_over_many_batches_and_parts(corpus, libraries, monkeypatch):
    some = corpus.where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    monkeypatch.setattr(token_links, "PART_BYTES", 200)
    df = some.repartition(5)
    assert links_by_operator(df) == plain_links(rows, libraries)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab é'sLl ▁\n\t  7漢.☃ 　\x85", "<|endoftext|>", "don't", "</s>"]), max_size=40).map("".join))
def test_stretches_give_the_groups_of_the_whole(libraries, text):
    reader = token_links._reader(*PATHS)
    chunks = token_links.stretches_of(text)
    reader.learn(set().union(*map(set, chunks)))
    got = reader.document(chunks, text) if chunks else reader.whole("")
    groups = plain_groups(text, libraries)
    said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    assert got[0] == (sha256(said.encode()).hexdigest() if groups else "") and got[3] == len(groups)


def plain_clusters(rows, k=8, rounds=10, dims=64, scale=1024):
    """Rows of the operator by whole numbers of Python alone."""
    kept = [(i, tuple(floor(scale * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds if centroids else 0):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if own[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found], key=repr)


def clusters_by_operator(df, **more):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted([tuple(r[c] for c in names) for r in ball_tree.cluster(df, **more).collect()], key=repr)


def test_clusters_of_the_table(spark):
    got = queries.op13_ball_tree(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted([tuple(r) for r in got], key=repr) == plain_clusters(rows) and len(got) == len(rows)


def vectors(spark, rows, kind="long"):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>").withColumns({"cluster": F.lit("x"), "n": F.lit(1), "v": F.lit(2)})


def test_cluster_edges(spark):
    rng = np.random.default_rng(1)
    same = [0.25] * 64
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(40)] + [(i, same) for i in range(100, 160)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [float("nan")] + [0.0] * 63), (205, [float("-inf")] * 64), (None, [2.0] * 64), (7, rows[7][1]), (7, rows[8][1]), (206, [-1e5] * 64), (207, [1e5] * 64)]
    assert clusters_by_operator(vectors(spark, rows)) == plain_clusters(rows)
    assert clusters_by_operator(vectors(spark, rows[:3])) == plain_clusters(rows[:3])
    assert clusters_by_operator(vectors(spark, [(i, same) for i in range(50)])) == plain_clusters([(i, same) for i in range(50)])
    assert clusters_by_operator(vectors(spark, [])) == []
    named = [(f"v{i}", v) for i, v in rows[:40]]
    assert clusters_by_operator(vectors(spark, named, "string")) == plain_clusters(named)


def test_whole_balls_are_assigned(spark, monkeypatch):
    """Tight groups far from each other: balls go whole, and the result is that of a plain comparison."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-4000, 4000, (6, 64))
    x = (middle[rng.integers(0, 6, 5000)] + rng.integers(-3, 4, (5000, 64))).astype(np.int64)
    tree, order = ball_tree.Tree.of(x)
    assert (tree.x == x[order]).all()
    compared = []
    monkeypatch.setattr(ball_tree, "squared", lambda a, b, f=ball_tree.squared: compared.append(len(a)) or f(a, b))
    counts, sums, own = tree.assigned(tree.radii(), middle)
    far = ((x[order][:, None] - middle[None]) ** 2).sum(axis=2)
    assert (own == far.argmin(axis=1)).all() and sum(compared) < 500
    assert (counts == np.bincount(own, minlength=6)).all() and all((sums[j] == tree.x[own == j].sum(axis=0)).all() for j in range(6))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([2, 40, 10**6, 2**26]))
def test_trees_assign_exactly(seed, n, wide):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-wide, wide, (n, 5)), rng.integers(-wide, wide, (8, 5))
    c[5] = c[2]
    tree, order = ball_tree.Tree.of(x)
    far = np.array([[sum((int(p) - int(q)) ** 2 for p, q in zip(v, m)) for m in c] for v in x[order]], object)
    own = tree.assigned(tree.radii(), c)[2]
    assert own.tolist() == [min(range(8), key=lambda j: (row[j], j)) for row in far]


@pytest.mark.parametrize("page, text", [
    ("<p class=it's>hello <b>world</b>", "hello world"), ('<a href="x"">first</a> and <a href="y">second</a> end', "first and second end"), ("<a title='x'y'>T</a>after it's", "Tafter it's"),
    ("<a title = 'a>b'>c</a>", "c"), ('<a title="a>b', ""), ("<i =\"'>d</i>", ""), ("<dialog>gone</dialog><dialog open>here</dialog>", "here"), ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr")])
def test_stray_quotes_lose_no_text(page, text):
    assert html_text.html_to_text(page).strip() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b'", '"', "'", "x=1", "y=it's", "z='v>'", 'w="<b>"', "/", "q=a\"b"]), max_size=5).map(" ".join), st.sampled_from(["one", "it's", 'say "so"', "two"])), max_size=6))
def test_text_outside_tags_is_kept(parts):
    page = "".join(f"<b {attrs}>{text}</b>" for attrs, text in parts)
    assert html_text.html_to_text(page).strip() == "".join(text for _, text in parts)


def test_scores_do_not_depend_on_how_files_are_cut(spark, corpus, monkeypatch):
    """Words of several blocks are seated whole where Spark cuts the files of words at small row groups."""
    sc, conf = spark.sparkContext._jsc.hadoopConfiguration(), {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    names = ("doc_id", "n_known", "train_tokens", "base_score", "score")
    scores = lambda: {r.doc_id: (r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in lm_score.score(corpus, block_bytes=15_000).select(*names).collect()}
    want, before = scores(), {k: spark.conf.get(k) for k in conf}
    try:
        sc.set("parquet.block.size", "20000")
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = scores()
    finally:
        sc.unset("parquet.block.size")
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_near_copies_around_an_odd_smallest_one_are_not_listed_pair_by_pair(spark, monkeypatch):
    """60 texts alike to each other, each of which is less alike to the smallest node than asked."""
    from fathomline.llm import near_texts

    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:100] + [f"x{k}"] + base[101:]) for k in range(60)] + [" ".join(base[k:] + [f"y{i}" for i in range(k)]) for k in (22, 24, 26)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted, real = [], near_texts.components
    monkeypatch.setattr(near_texts, "components", lambda edges: (counted.append(edges.distinct().count()), real(edges))[1])
    found = {r["doc_id"]: r["component_id"] for r in near_texts.near_texts(docs).collect()}
    sets = [near_texts.shingles(t, 5) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert found == dict(enumerate(want))
    assert counted[-1] < 60
