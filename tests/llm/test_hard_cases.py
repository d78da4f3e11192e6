"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tallyloom.llm import avi, decontaminate, html_text, lm_score, mixing, pii, quality, sharding, simhash, toxicity

LONG = "word another +1 (487) 555-7209 " * 6000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog tonight", "en", "a"), (1, "The quick brown fox jumps over the lazy dog tonight", "en", "a"),
    (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", None), (5, "idiot you moron", "en", "b"), (6, "x", "de", "b"), (None, "no id here at all", "en", "b"),
    (7, "ünï çödé \U0001f600 text mail me a@b.co", "fr", "c"), (8, "The quick brown fox jumps over the lazy dog tonight", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("score", "size", "fp", "slot", "block", "node", "key", "hash", "shard", "tie", "label", "_bad", "_lost", "_at", "_row", "_of", "_last", "_toxicity", "_id", "_size", "text_crc32", "n", "size_", "hash_", "at", "words")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 0, 0), (7, 1, 0), (7, 1, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog tonight"), (1, None), (2, ""), (3, "x"), (0, "the quick brown fox jumps over the lazy dog tonight")], "item_id long, text string")


def operators(labels, benchmark):
    net = toxicity.fit(["you idiot", "nice day"] * 3, [1, 0] * 3, toxicity.Fit(steps=4))
    rank = quality.fit(quality.np.array([quality.features(b"a b c"), quality.features(b"### ###")]), quality.np.array([1, 0]))
    field = pii.fit(["call +1 (487) 555-7209 or mail a@b.co", "7 dwarfs"])
    return {
        "lm": lambda d: lm_score.pseudo_likelihood(d), "toxicity": lambda d: toxicity.score(d, net), "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark),
        "quality": lambda d: quality.score(d, rank), "simhash": simhash.near_duplicates, "avi": avi.digests, "mixing": mixing.mix, "sharding": sharding.kd_shards, "pii": lambda d: pii.find(d, field),
    }


NAMES = ("lm", "toxicity", "decontaminate", "quality", "simhash", "avi", "mixing", "sharding", "pii")


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(docs, labels, benchmark, name):
    out = operators(labels, benchmark)[name](docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((d[0] is None, d[0] or 0) for d in DOCS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, benchmark, name):
    assert operators(labels, benchmark)[name](docs.where("false")).collect() == []


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a"), (3, "u", "<p>a"), (None, "u", "<nav>" * 500 + "x"), (5, "u", "<article><p>" + "long " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = html_text.extract(df).collect()
    assert len(out) == 6 and [r["text"] for r in out if r["page_id"] == 3] == ["a", "a"] and [r["n_chars"] for r in out if r["page_id"] in (1, 2)] == [0, 0]
    assert html_text.extract(df.where("false")).collect() == []


def test_training_without_labels(docs, labels):
    none = labels.where("false")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {1.0}
    assert pii.train(docs.where("false")) is None


@pytest.mark.parametrize("step", [0, 1, 2, 3, 4])
def test_stages(spark, docs, labels, benchmark, tmp_path, step):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs
    _, stage = corpus_pipeline.STAGES[step]
    out = stage(spark, plain, str(tmp_path))
    assert out.columns == ([c for c in plain.columns if c not in ("shard", "slot")] + ["shard", "slot"] if step == 4 else plain.columns)
    kept = out.collect()
    assert step in (0, 3) or any(r["doc_id"] is None for r in kept)  # a network of six labels and the end of a mix may leave it out
    assert kept
    assert stage(spark, plain.where("false"), str(tmp_path)).collect() == []
    if step == 1:
        ids = [r["doc_id"] for r in kept]
        assert ids.count(1) == 1 and 8 not in ids and 3 not in ids and 2 in ids
    if step == 2:
        assert not {1, 8} & {r["doc_id"] for r in kept} and {3, 4, 5, 6, 7} <= {r["doc_id"] for r in kept}
    if step == 4:
        assert len(kept) == len(DOCS)


def test_missing_and_shared_ids_cost_no_document(spark, tmp_path):
    bench = "the quick brown fox jumps over the lazy dog tonight"
    texts = ["one quite own story about rivers", "another tale that tells of mountains far", "bread is baked from flour and water", "so " + bench]
    rows = [(i, t, "en", "a") for i in (None, 1) for t in texts] + [(None, texts[0], "en", "a"), (2, "ships sail on the open sea at night", "en", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near-dedup"](spark, df, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((i, t) for i, t, *_ in rows if i is not None)
    none = stages["near-dedup"](spark, df.where("doc_id is null"), str(tmp_path)).collect()
    assert sorted(r["text"] for r in none) == sorted(texts)
    left = stages["decontamination"](spark, df, str(tmp_path)).collect()
    assert sorted(map(tuple, left), key=str) == sorted((r for r in rows if bench not in r[1]), key=str)
