"""Substring dedup and SimHash against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import simhash, substring_dedup
from fathomline.llm.components import components

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (5, "a " * 30_000), (6, "a " * 200), (None, "b " * 60)]


def brute_removal(docs, window):
    first = {}
    words = {i: (t or "").encode().split() for i, t in docs if i is not None}
    for i, w in sorted(words.items()):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def passages(seed, n=40):
    """Documents that share passages of many lengths, cut, doubled and copied whole."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 60))] for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(pool)[rng.randint(0, 3) :] if rng.random() < 0.7 else [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(1, 15))] for _ in range(rng.randint(0, 5))]
        docs.append((i * 3, " ".join(x for p in parts for x in p)))
    return docs + [(1000, docs[5][1]), (1001, docs[5][1])]


def test_removal_equals_brute_force(spark, table):
    for seed, (window, kmer) in enumerate([(8, 3), (12, 5), (5, 5)]):
        docs = passages(seed)
        found = substring_dedup.remove_repeats(table(docs).repartition(3), window, kmer)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found.collect()}
        assert got == brute_removal(docs, window)
        spans = {r.doc_id: r.spans for r in found.collect()}
        assert all(sum(s["end"] - s["start"] for s in spans[i]) == got[i][1] for i in got)


def doubled(seed, n=30):
    """Documents whose passages, parts of them in smaller documents, come again and again in them."""
    rng = random.Random(seed)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    docs = []
    for i in range(n):
        x = fresh(rng.randint(8, 25))
        block = fresh(rng.randint(0, 12)) + x + fresh(rng.randint(0, 12))
        twice = [w for _ in range(rng.randint(2, 4)) for w in (*block, *fresh(rng.randint(0, 9)))]
        docs += [(10 * i, " ".join(fresh(4) + x + fresh(4))), (10 * i + 5, " ".join(fresh(3) + twice))]
        if i % 3 == 0:
            docs.append((10 * i + 7, " ".join(block + fresh(3) + block)))
    return docs


def test_removal_takes_every_copy_in_a_document(spark, table):
    for seed, (window, kmer) in enumerate([(8, 3), (12, 5)]):
        docs = doubled(seed)
        found = substring_dedup.remove_repeats(table(docs).repartition(3), window, kmer)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found.collect()} == brute_removal(docs, window)


def test_removal_edges(spark, table):
    got = substring_dedup.remove_repeats(table(EDGE)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) and by[1].n_words == by[2].n_words == by[3].n_words == 0
    assert by[5].n_removed == 0 and by[6].n_removed == 200 and by[6].kept == ""
    assert by[None].n_removed == 0 and by[None].n_words == 60
    assert substring_dedup.remove_repeats(table([])).count() == 0


def test_removal_on_corpus(spark, corpus):
    docs = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(corpus).collect()}
    assert got == brute_removal(docs, 50)


def brute_components(fps, distance):
    names = {}
    for i, f in fps:
        names.setdefault(f, []).append(i)
    keys, seen, out = list(names), set(), {}
    for k in keys:
        if k in seen:
            continue
        group, todo = [], [k]
        seen.add(k)
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in keys if y not in seen and (x ^ y).bit_count() <= distance]
            seen |= set(near)
            todo += near
        least = min(i for g in group for i in names[g])
        out |= {i: least for g in group for i in names[g]}
    return out


def clustered(seed, n=400):
    """Fingerprints in tight clusters, chains and alone."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    out = [0, (1 << 64) - 1]
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
        if rng.random() < 0.2:
            base.append(x)
    return out


def test_components_of_fingerprints_equal_brute_force(spark, monkeypatch):
    for seed, large in ((1, 64), (2, 3)):
        monkeypatch.setattr(simhash, "LARGE_CELL", large)
        fps = list(dict.fromkeys(clustered(seed)))
        df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
        got = {r.fp: r.root for r in simhash.fingerprint_components(df, 4).collect()}
        want = brute_components([(i, f) for i, f in enumerate(fps)], 4)
        assert len(got) == len(fps)
        for i, f in enumerate(fps):
            assert got[simhash.signed(f)] == got[simhash.signed(fps[want[i]])]
        assert len(set(got.values())) == len(set(want.values()))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB ç\n\t\x85x", max_size=60))
def test_fingerprint_by_definition(text):
    import xxhash

    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if x]
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == simhash.signed(want)


def test_near_duplicates_edges(spark, table):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(table(EDGE)).collect()}
    assert got[1] == got[2] == got[3] == (0, 1)
    assert got[4][1] == 4 and got[5] == got[6] == (got[5][0], 5) and got[None][0] is not None
    assert simhash.near_duplicates(table([])).count() == 0
    kept = simhash.keep_one(table(EDGE))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 4, 5] and "runs" in kept.columns


def near_copies(seed):
    """Texts with copies in which words are changed at random places, short and empty ones among them."""
    rng = random.Random(seed)
    docs = [(900, None), (901, ""), (902, "two words"), (903, "Two words")]
    for i in range(40):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([12, 100, 300]))]
        docs.append((2 * i, " ".join(base)))
        for j in range(rng.randint(0, 3)):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            docs.append((1000 + 10 * i + j, " ".join(base)))
    return docs


def brute_near(docs, k, least):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0):
                lo, hi = sorted((root[i], root[j]))
                root = {x: lo if r == hi else r for x, r in root.items()}
    return root


def test_pipeline_stage_finds_near_copies_of_similarity_0_8(spark, table, corpus):
    import corpus_pipeline

    for docs in (near_copies(1), [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]):
        want = brute_near(docs, 5, 0.8)
        kept = corpus_pipeline.keep_distinct(spark, table([*docs, (None, docs[-1][1])]).repartition(3), "")
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, r in want.items() if i == r)
        assert kept.where("doc_id is null").count() == 1
    assert corpus_pipeline.keep_distinct(spark, table([]), "").count() == 0


def test_components_of_a_star_and_a_chain(spark):
    edges = [(1, i) for i in range(2, 300)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (5, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 300)) and all(got[i] == 1000 for i in range(1000, 1101))


def test_keep_one_by_id(spark, table):
    rows = [(4, "same text here now"), (2, "same text here now"), (2, "same text here now"), (None, "same text here now"), (7, "quite another one, unlike that"), (9, None), (8, "")]
    kept = simhash.keep_one(table(rows))
    assert kept.columns == table(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 2, None, 7, 8], key=repr)
    assert simhash.keep_one(table([])).count() == 0
