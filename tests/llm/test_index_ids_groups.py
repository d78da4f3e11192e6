"""Ranked search, token files and source divergence against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import divergence, lexical, repair

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("n", "term", "terms", "rank", "score", "item", "value", "range", "file", "content", "start", "base", "known", "group", "chunk", "p", "number", "size", "_one", "_range")


def made_up(rows: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["Ant", "bee", "CAT", "dög", "x1", "2", "Éa", "y", "\U0001f600z", "w9"] + [f"t{i}" for i in range(40)]
    out = []
    for i in range(rows):
        text = rng.choice([" ", "-", "\n", " _"]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 3, 9, 40, 200])))
        out.append((rng.choice([None, rng.randrange(rows)]) if rng.random() < 0.1 else i, None if rng.random() < 0.05 else text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "B", "ü", None, "c", "d", "e"])))
    return out + out[:7]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


# --- ranked search
def plain_ranking(rows, items, top=10):
    docs = [(r[0], Counter(TERM.findall((r[1] or "").translate(LOWER)))) for r in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if gone else doc, -s) for k, (s, gone, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


ITEMS = [(1, "ant BEE t3"), (2, None), (3, ""), (None, "cat dög 2"), (4, "nowhere t5 t5 t39"), (4, "nowhere t5 t5 t39"), (4, "éa"), (5, "Éa \U0001f600z w9 t1 t2 t4 t30")]


@pytest.mark.parametrize("shard", [50, 1_000_000])
def test_ranked_search_against_all_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    rows = made_up(300, 1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS doc_id", "'q' AS q")
    docs = clashing(spark, rows).repartition(3)
    found = lexical.search(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_ranking(rows, ITEMS)
    assert sorted(map(tuple, found.collect()), key=str) == want
    parts = lexical.search(docs, items, most_items=3)  # items in parts
    assert sorted(map(tuple, parts.collect()), key=str) == want
    assert lexical.search(docs.where("false"), items).collect() == [] and lexical.search(docs, items.where("false")).collect() == []


def test_ties_go_to_the_least_id_and_long_texts_count_whole(spark):
    rows = [(9 - i, "same words here", "en", "a") for i in range(9)] + [(None, "same words here", "en", "a"), (50, "filler " * 100_000 + "needle", "en", "a"), (51, "x", "en", "a")]
    items = [(1, "same here"), (2, "needle")]
    found = lexical.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["item_id"] == 1] == [1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    assert [r["doc_id"] for r in found if r["item_id"] == 2] == [50]
    assert sorted(map(tuple, found), key=str) == plain_ranking(rows, items)


def test_block_boundaries_are_the_best_ones():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 9, 11):
        scores = rng.integers(1, 50, size).astype(np.int64)
        price = lexical.PRICE * scores.sum() // size
        ends = lexical.block_ends(scores, np.array([0, size]))
        cost = lambda e, s=scores, p=price: sum((b - a) * s[a:b].max() + p for a, b in itertools.pairwise([0, *e]))
        every = [[*c, size] for k in range(size) for c in itertools.combinations(range(1, size), k)]
        assert cost(ends.tolist()) == min(map(cost, every)) and ends[-1] == size


def test_a_search_skips_blocks_that_cannot_matter():
    rng = np.random.default_rng(5)
    n = 20_000
    scores = np.concatenate([np.sort(rng.integers(1, 1000, n))[::-1], np.sort(rng.integers(1, 1000, n))[::-1]]).astype(np.int64)
    lists = np.array([0, n, 2 * n])
    shard = lexical.Shard(np.arange(n), np.ones(n, bool), lists, np.tile(np.arange(n, dtype=np.int32), 2), scores, lexical.block_ends(scores, lists))
    found = shard.search(np.array([0, 1]), [], 10)
    total = scores[:n] + scores[n:]
    assert [(-s, d) for s, _, d in found] == [(int(total[d]), int(d)) for d in np.lexsort((np.arange(n), -total))[:10]]
    assert 0 < shard.read < n / 8  # of 2n postings
    before = shard.read
    assert shard.search(np.array([0, 1]), [(-5000, False, 1)] * 10, 10) == [(-5000, False, 1)] * 10 and shard.read == before


# --- token files
@pytest.mark.parametrize("seed", range(6))
def test_files_give_back_every_id(seed):
    rng = random.Random(seed)
    alphabet = [2, 0, 49407] + list(range(3, 3 + [1, 2, 4, 30, 300, 40000][seed]))
    docs = [np.array([*rng.choices(alphabet, k=rng.choice([0, 1, 7, 60, 3000])), 2], np.uint32) for _ in range(40)] + [np.array([7] * k + [2], np.uint32) for k in (1, 2, 3, 4, 5, 9)]
    ids = [rng.choice([None, -5, 2**40, i]) for i in range(len(docs))]
    content = repair.pack(ids, docs, 2)
    file = repair.File(content)
    assert file.doc_ids == ids and file.n_ids == sum(map(len, docs))
    assert all(np.array_equal(a, b) for a, b in zip(file.documents(), docs, strict=True))
    for _ in range(200):
        d, a, b = rng.randrange(len(docs)), rng.randrange(70), rng.randrange(70)
        assert np.array_equal(file.ids(d, a, b), docs[d][a:b]) and np.array_equal(file.ids(d, a), docs[d][a:])
    assert all((file.expand(np.array([file.base + r])) != 2).all() and len(file.expand(np.array([file.base + r]))) == n for r, n in enumerate(file.length[:300]))
    if seed < 4:
        assert len(file.rules) and len(content) < 4 * file.n_ids


def test_rules_are_frequent_pairs_and_nothing_frequent_is_left():
    ids = np.array(([5, 6, 7, 8] * 50 + [9, 9, 9, 9, 9] * 20 + [2]) * 3, np.uint32)
    seq, rules, base = repair.grammar(ids, 2)
    pairs = Counter((a, b) for a, b in itertools.pairwise(seq.tolist()) if 2 not in (a, b))
    assert max(pairs.values(), default=0) < repair.LEAST and (5, 6) in {tuple(r) for r in rules.tolist()} and all(a < base + i and b < base + i for i, (a, b) in enumerate(rules.tolist()))


def test_token_files_in_order_of_doc_id(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    rows = made_up(200, 4) + [(5000, "Long tale # of words. " * 30_000, "en", "a")]
    df = clashing(spark, rows).repartition(5)
    model = Tokenizer.from_file(path)
    encoded = [(r[0], np.array([*model.encode(r[1] or "", add_special_tokens=False).ids, 2], np.uint32)) for r in rows]
    got = repair.token_files(df, path, ids_per_file=500).collect()
    assert len({r["file"] for r in got}) > 10
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in encoded)
    inorder = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in inorder] == np.cumsum([0] + [r["n_tokens"] for r in inorder])[:-1].tolist()
    ids = [r["doc_id"] for r in inorder]
    known = [i for i in ids if i is not None]
    assert known == sorted(known) and ids[: len(known)] == known
    assert repair.token_files(df.where("false"), path).collect() == []
    assert [(r["start"], r["n_tokens"]) for r in repair.token_files(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), path).orderBy("doc_id").collect()] == [(0, 1), (1, 1)]


def test_words_with_marks_are_put_together_and_frequent_ones_outlive_the_memory(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    words, whole = repair.Words(repair.tokenizer(path)), lambda texts: [e.ids for e in repair.tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    texts = ["  Straße$$$ straße the,!! THE.%%% don't don't!! 'tis it's. a1 1a.5, $$$ ... \u0130x,  éa\u0301.", "x_y the\u00a0the, \u2003 İ! ß? e\u0301! ᾳ. <|endoftext|> a", "", " ", "the'", "the'. s't \x1c\x85 ab\x0bcd "]
    assert [x.tolist() for x in words.encode(texts)] == whole(texts)
    assert b"$$$" in words and b",!!" in words and b"the" in words  # parts, of which other words are made
    monkeypatch.setattr(repair, "REMEMBERED", 40)
    made = [f"often w{chr(97 + k % 26)}{chr(97 + k // 26)}{k}$$$ rare{'x' * (k % 7)}," for k in range(60)]
    for k in range(0, 60, 3):
        assert [x.tolist() for x in words.encode(made[k : k + 3])] == whole(made[k : k + 3])
        assert len(words) <= 40 + 30
    words.forget()
    assert b"often" in words and len(words) <= 20 and [x.tolist() for x in words.encode(made + texts)] == whole(made + texts)


# --- divergence
def plain_divergence(rows, least, top=50):
    docs = [(lang or "", source or "", Counter(WORD.findall((text or "").translate(LOWER)))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: Counter() for s in {d[1] for d in own}}
        for d in own:
            count[d[1]].update(d[2])
        whole = sum(count.values(), Counter())
        shares = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023,E731
        q, p = shares(whole), {s: shares(c) for s, c in count.items()}
        for s, mine in p.items():
            pairs = sorted((-sum(abs(mine[t] - other[t]) for t in kept), o.encode()) for o, other in p.items() if o != s)
            marks = sorted((q[t] - mine[t], t.encode()) for t in kept if count[s][t] and mine[t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", marks)) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "least"), [(32, 32_768, 3), (2, 5, 3), (1, 1, 10), (3, 7, 10_000)])
def test_divergence_against_all_pairs(spark, block, chunk, least):
    rows = made_up(250, 8)
    got = divergence.divergence(clashing(spark, rows), least=least, block=block, chunk=chunk)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, least)


def test_divergence_of_little(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)  # counts are passed on in small parts
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.divergence(empty).collect() == []
    rows = [(1, "a b", "en", "x"), (1, "a b", "en", "x"), (2, None, "en", "y"), (3, "", None, None), (4, "z" * 200_000 + " a", "en", "x")]
    assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, SCHEMA), least=2, top=1).collect())) == plain_divergence(rows, 2, 1)


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("9000000000000000 AS n", "9000000000000001 AS total", "7L AS kept")
    assert row.select(divergence.share(row.n, row.total, row.kept)).first()[0] == 1 + 1_000_000_000 * (9000000000000000 + 5) // (9000000000000001 + 35)
