"""Language model, mixing, Merkle fingerprints and the pipeline."""

import math
import zlib
from collections import Counter

import pytest

from fathomline.llm import lm_score, merkle, mixing
from fathomline.llm.common import range_block

ODD = [(1, None), (2, ""), (3, "Same words"), (3, "Same words"), (None, "same WORDS x"), (5, "long " * 30_000), (9, "a\nb. c\n\nd")]


def brute_base(docs):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in docs]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens]


@pytest.mark.parametrize("block", [16_000_000, 30_000])
def test_base_scores_equal_brute_force(spark, corpus, table, block):
    for df in (corpus, table(ODD)):
        docs = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(df, block_bytes=block).collect()), key=repr)
        assert got == sorted(((*x[:5], round(x[5], 6)) for x in brute_base(docs)), key=repr)
    assert lm_score.score(table([])).count() == 0


def test_held_out_text_is_less_of_a_surprise_than_to_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.held_out: r for r in lm_score.perplexity(lm_score.score(docs)).collect()}
    assert rows[True].perplexity < 0.8 * rows[True].base_perplexity and rows[False].perplexity < rows[True].perplexity


def test_probabilities_sum_to_one(spark, table):
    """Over every word that was seen, the end and an unseen word, in each context that is asked for all of them."""
    import numpy as np

    words = [f"w{i}" for i in range(30)]
    train = [(i, " ".join(words[(i * j) % 30] for j in range(1, 40))) for i in range(60)]
    held = [i for i in range(1000, 9000) if lm_score.held_out(i)]
    asked = [(i, f"{c} {w}".strip()) for i, (c, w) in zip(held, [(c, w) for c in ("w0", "w1", "rare") for w in [*words, "unseen", ""]], strict=False)]
    rows = table([*train, *asked])
    m = lm_score.fitted(lm_score.in_blocks(rows.select("doc_id", "text"), 10**9)[0], 5, 2, 8.0)
    assert len(m["known"]) >= 30
    each = {}
    for r in lm_score.answered(m).collect():
        e = np.frombuffer(r.entries, lm_score.PRICED)
        steps = e["p"].astype(np.int64) @ [1, 256, 65536]
        for k, x in zip(e["k"].tolist(), steps.tolist(), strict=True):
            assert each.setdefault((r.word, k), x) == x
    sums, kinds = {}, {}
    for (_, k), x in each.items():
        sums[k] = sums.get(k, 0) + 10 ** (-x * lm_score.STEP)
        kinds[k] = kinds.get(k, 0) + 1
    whole = [k for k, n in kinds.items() if n == m["v"] + 1]
    assert len(whole) >= 2 and any(k >= lm_score.CLASSES for k in whole)
    assert all(abs(sums[k] - 1) < 2e-6 for k in whole), {k: sums[k] for k in whole}


def test_scores_do_not_depend_on_partitions_or_id_types(spark, corpus):
    score = lambda df, **k: {str(r.doc_id): round(r.score, 6) for r in lm_score.score(df, **k).collect()}
    one = score(corpus)
    assert one == score(corpus.repartition(5), block_bytes=20_000) == score(corpus.selectExpr("cast(doc_id as string) as doc_id", "text").repartition(2))


def test_pairs_of_words_are_learned(spark, table):
    """What follows a word tells it from its class: scores beat the best model of single words."""
    import random

    rng = random.Random(3)
    after = {f"c{i}x": [f"n{rng.randrange(200)}" for _ in range(3)] for i in range(40)}
    text = lambda: " ".join(f"{c} {rng.choice(after[c])}" for c in rng.choices(list(after), k=60))
    scored = lm_score.score(table([(i, text()) for i in range(200)]), rarer=4.0).where("held_out").groupBy().sum("score", "n_tokens").first()
    per_token = scored[0] / scored[1]
    best_of_single_words = (math.log10(1 / 80) + math.log10(1 / 240)) / 2
    assert per_token > best_of_single_words + 0.3


def seated_alone(c, a, d, seed):
    import numpy as np

    return lm_score.seated(c, a, d, lm_score._mixed(np.arange(len(c), dtype=np.uint64) + np.uint64(seed)))


def exact_tables(c, weight, d):
    """The mean of t under weights S(c, t) * weight^t, S the generalised Stirling numbers of discount d."""
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [(row[t - 1] if t <= len(row) else 0) + ((n - t * d) * row[t] if t < len(row) else 0) for t in range(1, n + 2)]
    p = [x * weight**t for t, x in enumerate(row)]
    return sum(t * x for t, x in enumerate(p)) / sum(p)


def test_seating_against_the_exact_posterior():
    """Within 8 % where customers are seated one by one, 12 % where steps grow."""
    import numpy as np

    for c, a, d in ((2, 0.05, 0.5), (5, 0.02, 0.7), (12, 0.1, 0.3), (30, 0.01, 0.8), (40, 2.0, 0.5), (150, 0.3, 0.6)):
        mean = seated_alone(np.full(40_000, c), np.full(40_000, a), d, 7).mean()
        assert abs(mean / exact_tables(c, a, d) - 1) < (0.08 if c < 48 else 0.12), (c, a, d, mean)


def mixed(df, **k):
    return mixing.mix(df, **k)


def test_every_row_comes_and_repeats_stay_in_bounds(spark, corpus):
    out = mixed(corpus, max_repeat=2.0)
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert len(n) == corpus.count() and max(n.values()) <= 2 and out.columns == [*corpus.columns, "epoch"]
    again = sorted((r.doc_id, r.epoch) for r in mixed(corpus.repartition(7), max_repeat=2.0).collect())
    assert again == sorted((r.doc_id, r.epoch) for r in out.collect())


def test_quotas_are_met_within_a_document(spark):
    rows = [(i, "w " * (1 + i % 5), "abcde"[min(4, i % 16)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    budget = 4000.0
    out = mixed(df, entropy=1.55, budget=budget)
    tokens = {r.source: r.n for r in out.selectExpr("source", "size(split(trim(text), ' ')) as w").groupBy("source").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n").collect()}
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        e = (lo + hi) / 2
        z = sum(x**e for x in total.values())
        h = -sum(x**e / z * math.log(x**e / z) for x in total.values())
        lo, hi = (e, hi) if h >= 1.55 else (lo, e)
    for s, x in total.items():
        assert 0 <= budget * x**lo / z - tokens[s] <= 6


def test_mixing_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, "z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 as epoch", "1 as full", "2 as cut")
    out = mixed(df, max_repeat=1.0)
    assert out.columns == [*df.columns, "epoch_"] and out.where("epoch_ = 0").count() == 5
    assert mixed(df.limit(0), max_repeat=2.0).count() == 0
    assert mixed(df.where("doc_id < 3"), max_repeat=2.0).count() == 2


def test_next_document_and_likeness(spark, table, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = [(i * i, f"p{i}. q{i}\nr{i}\n\ns{i}") for i in range(40)] + [(2, None), (3, "")]
    got = {r.doc_id: r for r in merkle.edit_likeness(table(rows).repartition(5)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].edited == want and got[i].n_chars == len(t)
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == want)
    assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and r.near_next <= 1 for r in got.values()) and got[4].near_edited > got[4].near_next


def test_merkle_edges(spark, table):
    got = merkle.edit_likeness(table(ODD)).collect()
    assert len(got) == len(ODD)
    assert merkle.edit_likeness(table([])).count() == 0
    one = merkle.edit_likeness(table([(1, "ab")])).first()
    assert one.edited == "aa" and one.near_next == 1.0
    nulls = merkle.edit_likeness(table([(None, "ab"), (None, None)]))
    assert nulls.count() == 2


def test_edited_sections_are_located(spark, table):
    from pyspark.sql import functions as F

    f = merkle.fingerprints(table([(1, "a\n\nb. c\n\nd"), (2, "a\n\nb. x\n\nd\n\ne")])).orderBy("doc_id")
    a, b = (r.fingerprint for r in f.collect())
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.edited_sections(F.col("a"), F.col("b")).alias("at")).first()
    assert row["at"] == [1, 3]


def test_range_blocks(spark):
    from pyspark.sql import functions as F

    bounds = [-5, 0, 3, 10, 11, 50, 1000]
    rows = spark.range(-20, 1100).select("id", range_block(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in rows)


def test_pipeline(spark):
    """Each stage on what the one before kept: what it does has to be seen in the next one's input, and every kept document is packed whole."""
    import corpus_pipeline
    from fathomline.llm import common, quality, secrets

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leak = "the nightly job of our small team logs in with password: hunter22xkq9 and then copies all files"
    docs = table.unionByName(table.limit(1).selectExpr("cast(1000000 as long) as doc_id", f"'{leak}' as text", "lang", "source", f"{len(leak)} as n_chars").select(*table.columns).to(table.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scans", "source mixing", "packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(common.written(stage(spark, kept[-1], "/root/testdata/sf0.001")))
    good, distinct, hidden, mixed, packed = kept[1:]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert all(df.columns == docs.columns for df in kept[:5])
    assert ids(good) == {r.doc_id for r in quality.verdicts(quality.ledger(docs)).collect() if r.kept} < ids(docs)
    assert ids(distinct) < ids(good) and ids(hidden) == ids(distinct) == ids(mixed) == ids(packed)
    assert any(secrets.find_secrets(r.text) for r in distinct.collect())
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (distinct, hidden))
    for i, t in before.items():
        values = {t[v:b] for _, _, b, v in secrets.find_secrets(t)}
        assert (after[i] == t) == (not values) and all(v not in after[i] for v in values)
    rows = mixed.groupBy("doc_id").count().join(packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}), "doc_id").collect()
    assert all(r["sum(length)"] == r["count"] * r["max(doc_tokens)"] for r in rows) and len(rows) == len(ids(mixed))
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert ids(whole) == ids(packed) - {1000000}


def test_neighbours_need_integer_ids(spark):
    with pytest.raises(TypeError):
        merkle.edit_likeness(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
