"""Columns of the input that are named like those an operator uses, and token batches by bytes."""

import pytest

from fathomline.llm import mixing, near_texts, simhash, token_counts

NAMES = ["_gone", "_GONE_", "_mix_doc", "_mix_block", "_mix_tokens", "c0", "epoch", "Epoch_", "a.b", "a`b", "component_id", "node"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "eight nine ten", "words that are apart from others", None, ""]
    rows = [(i, t, "ab"[i % 2], *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES))


@pytest.mark.parametrize("keep_one", [near_texts.keep_one, simhash.keep_one])
def test_keep_one_takes_any_names(docs, keep_one):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = [r for r in map(tuple, docs.collect()) if r[0] in (0, 2, 3, 4)]
    assert sorted(map(tuple, kept.collect())) == want


def test_mix_takes_any_names(spark, docs):
    mixed = mixing.mix(docs, max_repeat=2.0)
    assert mixed.columns == [*docs.columns, "epoch__"]
    plain = mixing.mix(docs.select("doc_id", "text", "source"), max_repeat=2.0)
    assert sorted((r.doc_id, r.epoch__) for r in mixed.collect()) == sorted(map(lambda r: (r.doc_id, r.epoch), plain.collect()))
    assert {tuple(r)[:-1] for r in mixed.collect()} == set(map(tuple, docs.collect()))
    few = mixing.mix(docs, budget=9.0)
    assert sorted((r.doc_id, r.epoch__) for r in few.collect()) == sorted((r.doc_id, r.epoch) for r in mixing.mix(docs.select("doc_id", "text", "source"), budget=9.0).collect())


def test_many_blocks_take_the_same_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('w ', id, ' x y') AS text", "CAST(id % 3 AS string) AS source")
    rows = mixing.mix(df, budget=6000.0).collect()
    assert 6000 - 3 * 4 < 4 * len(rows) <= 6000 and len({r.doc_id for r in rows}) == len(rows)


@pytest.mark.parametrize("text", ["word " * 400, "слово " * 400, "字 " * 400, "a字é " * 300])
def test_batches_hold_about_as_many_bytes(text):
    text, limit = text.strip(), 100
    batches = list(token_counts.batches_by_bytes([text, None, text], limit))
    longest = max(len(w.encode()) for w in text.split()) + 1
    sizes = [sum(len(s.encode()) for _, s in b) for b in batches]
    assert max(sizes) <= 2 * limit + longest and min(sizes[:-1]) >= limit - longest
    for row in (0, 2):
        assert " ".join(s for b in batches for r, s in b if r == row) == text
    assert [s for b in batches for r, s in b if r == 1] == [""]
