"""Each operator against a plain version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import functools
import hashlib
import os
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from tallyloom.llm import avi, common, decontaminate, html_text, lm_score, mixing, pii, quality, sharding, simhash, toxicity

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- 1
def plain_log_p(net, sides, leaf):
    """One word's log-probability, number by number."""
    x = [[sum(float(net.places[o, d]) * float(net.vectors[s, d]) for o, s in enumerate(sides)) + float(net.bias[d]) for d in range(lm_score.WIDTH)]]
    h = np.tanh(np.array(x[0]))
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    k, m = divmod(leaf, lm_score.MEMBERS)
    of_class = softmax(np.array([h @ net.classes[:, c].astype(float) + float(net.class_bias[c]) for c in range(lm_score.CLASSES)]))
    of_member = softmax(h @ net.members[k].astype(float) + net.member_bias[k].astype(float))
    return np.log(of_class[k]) + np.log(of_member[m])


@needs_data
def test_pseudo_likelihood_against_a_plain_forward_pass(spark, documents):
    model = lm_score.build(documents)
    text = next(r["text"] for r in documents.where("length(text) > 500").orderBy("doc_id").limit(1).collect())
    words = text.split()
    random.Random(1).shuffle(words)
    two = spark.createDataFrame([(1, text), (2, " ".join(words)), (3, text), (4, "Two words")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score(two, model).collect()}
    assert got[1]["log_likelihood"] > got[2]["log_likelihood"] and got[1]["n_words"] == got[2]["n_words"] and got[1]["log_likelihood"] == pytest.approx(got[3]["log_likelihood"], rel=1e-6)
    for i, t in ((1, text), (4, "Two words")):
        ws = lm_score.words_of(t.encode())
        ids = [model.words.own.get(w, lm_score.bucket_of(w)) for w in ws]
        padded = [lm_score.EDGE] * 3 + ids + [lm_score.EDGE] * 3
        rest = sum(float(model.words.spelling([w])[0]) for w in ws if w not in model.words.own)
        plain = rest + sum(plain_log_p(model.net, padded[k : k + 3] + padded[k + 4 : k + 7], x) for k, x in enumerate(ids))
        assert got[i]["log_likelihood"] == pytest.approx(plain, rel=1e-4) and got[i]["n_words"] == len(ws)
    sides = np.random.default_rng(0).integers(0, lm_score.LEAVES + 1, (2, 6))
    every = [model.net.log_p(np.repeat(sides[i : i + 1], lm_score.LEAVES, axis=0), np.arange(lm_score.LEAVES)).astype(float) for i in range(2)]
    assert np.allclose([np.exp(x).sum() for x in every], 1, atol=1e-3)


@needs_data
def test_held_out_perplexity_is_below_that_of_word_shares(documents):
    train = documents.where("doc_id % 5 <> 0")
    words = lm_score.vocabulary(train)
    net = lm_score.train(lm_score.durable(lm_score.leaves(train, words)), words.shares)
    rows = lm_score.leaves(documents.where("doc_id % 5 = 0"), words)
    score = lambda n: lm_score.score_leaves(rows, n).agg({"log_likelihood": "sum", "n_words": "sum"}).first()
    unigram, trained = score(lm_score.start(words.shares)), score(net)
    gain = (trained["sum(log_likelihood)"] - unigram["sum(log_likelihood)"]) / trained["sum(n_words)"]
    start = lm_score.start(words.shares)
    sides = np.full((50, 6), 7)
    assert np.allclose(start.log_p(sides, np.arange(50)), np.log(words.shares[:50]), atol=0.5)
    assert gain > 0.5  # nats a word: perplexity falls by 40 % or more


def test_gradients_of_the_word_network():
    g = np.random.default_rng(0)
    shares = g.random(lm_score.LEAVES)
    net = lm_score.start(shares / shares.sum())
    for k in ("vectors", "places", "bias", "classes", "members"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    sides, leaf = g.integers(0, lm_score.LEAVES + 1, (40, 6)), g.integers(0, lm_score.LEAVES, 40)
    slopes = {}
    net.log_p(sides, leaf, slopes)
    for k, at in {"vectors": (sides[0, 0], 3), "places": (2, 1), "bias": (4,), "classes": (1, leaf[0] // 96), "class_bias": (leaf[0] // 96,), "members": (leaf[0] // 96, 2, leaf[0] % 96), "member_bias": (leaf[0] // 96, leaf[0] % 96)}.items():
        x = getattr(net, k)
        old, losses = x[at], []
        for d in (1e-2, -1e-2):
            x[at] = old + d
            losses.append(-net.log_p(sides, leaf).astype(np.float64).mean())
        x[at] = old
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(slopes[k][at], abs=2e-4), k


def test_spelling_sums_to_one():
    words = [b"ab", b"cab", b"a", b"bb", b"abab"]
    pairs, size = lm_score.pairs_of(words)
    assert [p.tolist() for p in np.split(pairs, np.cumsum(size)[:-1])] == [[(a << 8) + b for a, b in zip(b"\0" + w, w)] for w in words]
    ends = np.bincount(pairs[np.cumsum(size) - 1], minlength=65536)
    s = lm_score.spelling(np.bincount(pairs, minlength=65536), ends)
    assert np.allclose(np.exp(s.before).reshape(256, 256).sum(axis=0), 1)
    w = b"cab"
    assert s([w])[0] == pytest.approx(s.ending[(97 << 8) + 98] + s.before[(99 << 8) + 97] + s.before[99], rel=1e-9)
    bucket = [lm_score.bucket_of(bytes([a, b]) if a else bytes([b])) for a in range(256) for b in range(256)]
    assert np.allclose(np.bincount(np.array(bucket) - lm_score.OWN, np.exp(s.ending))[list(set(np.array(bucket) - lm_score.OWN))], 1)


def test_every_fourth_word_is_a_target_in_one_round():
    lists = [np.arange(50) + 100 * k for k in range(3)] + [np.zeros(0, np.int64)]
    flat, places, owner = lm_score.windows(lists)
    assert (flat[places] == np.concatenate(lists)).all() and flat[places[0] + lm_score.OFFSETS].tolist() == [lm_score.EDGE] * 3 + [1, 2, 3]
    rounds = [set(lm_score.targets(lists, t)[1].tolist()) for t in range(lm_score.ROUNDS)]
    every = set.union(*rounds)
    assert all(rounds) and len(every) == sum(map(len, rounds))
    assert all(len(every & set(range(100 * k + i, 100 * k + i + lm_score.EVERY))) == 1 for k in range(3) for i in range(0, 48, lm_score.EVERY))


def test_every_word_of_every_text_is_a_target():
    lists = [np.arange(n) + 100 * k for k, n in enumerate((50, 1, 7, 0, 2))]
    seen = np.concatenate([lm_score.targets(lists, turn)[1] for turn in range(lm_score.ROUNDS)])
    assert sorted(seen.tolist()) == sorted(np.concatenate(lists).tolist())


def test_counts_are_those_of_all_words(spark):
    df = spark.createDataFrame([(i, f"a b{i % 3} A") for i in range(50)], "doc_id long, text string")
    assert {bytes(r["word"]): r["n"] for r in lm_score.word_counts(df).collect()} == {b"a": 100, b"b0": 17, b"b1": 17, b"b2": 16}


def test_the_network_uses_its_memory_again_without_mixing_batches():
    g = np.random.default_rng(4)
    batch = lambda n: (g.integers(0, lm_score.LEAVES + 1, (n, 2 * lm_score.REACH)), g.integers(0, lm_score.LEAVES, n))
    net, few, many = lm_score.start(np.full(lm_score.LEAVES, 1 / lm_score.LEAVES)), batch(50), batch(3000)
    slopes, later = {}, {}
    first = net.log_p(*many, slopes)
    held = {k: x.copy() for k, x in slopes.items()}
    memory = {k: x.ctypes.data for k, x in lm_score.SCRATCH.items()}
    some = net.log_p(*few, later)
    assert memory and memory == {k: x.ctypes.data for k, x in lm_score.SCRATCH.items()}
    assert np.array_equal(net.log_p(*many), first) and np.array_equal(net.log_p(*few), some) and all(np.array_equal(slopes[k], held[k]) for k in held)
    sides, leaf = few
    h = np.tanh((net.vectors[sides] * net.places).sum(axis=1) + net.bias)
    own, member = np.divmod(leaf, lm_score.MEMBERS)
    for n in range(50):
        a, b = h[n] @ net.classes + net.class_bias, h[n] @ net.members[own[n]] + net.member_bias[own[n]]
        assert abs(a[own[n]] - np.log(np.exp(a).sum()) + b[member[n]] - np.log(np.exp(b).sum()) - some[n]) < 1e-4
    learner = lm_score.Learner(net)
    learner.step(*few)
    for k, slope in later.items():
        assert np.allclose(getattr(learner.net, k), getattr(net, k) - lm_score.RATE * slope / np.sqrt(np.float32(1e-6) + slope * slope), atol=1e-6)


# --- 2
def test_gradients():
    net = toxicity.Network(["a"], 1)
    g = np.random.default_rng(0)
    vectors = g.standard_normal((5, toxicity.DIM)).astype(np.float32)
    rows = g.integers(-1, 5, (4, toxicity.WINDOW))
    rows[:, 0] = 0
    y, w = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        z = net.forward(net.tables(vectors), rows).astype(np.float64)
        return (np.log1p(np.exp(z)) - y * z).mean()

    slopes, of_vectors = net.gradients(vectors, rows, y, w)
    for name in ("uf", "wb", "cf", "a", "v", "o"):
        at = (0,) * net.p[name].ndim
        old = net.p[name][at].copy()
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(slopes[name][at], abs=2e-4), name
    old = vectors[0, 0]
    vectors[0, 0] = old + 1e-2
    up = loss()
    vectors[0, 0] = old - 1e-2
    assert (up - loss()) / 2e-2 == pytest.approx(of_vectors[0, 0], abs=2e-4)


def plain_logit(net, vectors, row):
    """A window's logit, step by step, with plain numbers."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig, words, n = lambda x: 1 / (1 + np.exp(-x)), [vectors[i].astype(float) for i in row if i >= 0], toxicity.HIDDEN
    states = {}
    for d, order in (("f", range(len(words))), ("b", reversed(range(len(words))))):
        h = np.zeros(n)
        for t in order:
            x, u = words[t] @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            z, r = sig(x[:n] + u[:n]), sig(x[n : 2 * n] + u[n : 2 * n])
            h = (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :]) + z * h
            states[d, t] = h
    both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(words))]
    scores = np.array([np.tanh(x @ p["a"] + p["ab"]) @ p["v"] for x in both])
    alpha = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
    return sum(a * x for a, x in zip(alpha, both, strict=True)) @ p["o"] + p["ob"][0]


def test_forward_pass_is_that_of_a_plain_network():
    net, g = toxicity.Network(["a"], 5), np.random.default_rng(2)
    vectors = g.standard_normal((9, toxicity.DIM)).astype(np.float32)
    rows = np.full((4, toxicity.WINDOW), -1)
    for i, n in enumerate((1, 5, 31, 32)):
        rows[i, :n] = g.integers(0, 9, n)
    assert net.forward(net.tables(vectors), rows) == pytest.approx([plain_logit(net, vectors, r) for r in rows], abs=1e-5)


@needs_data
def test_toxicity_of_held_out_documents(spark):
    """With 350 toxic texts to learn from, of which 4 in 10 are told by inflected stems alone."""
    documents, labels = (spark.read.parquet(f"{DATA}/../sf0.1/{n}.parquet") for n in ("documents", "labels"))
    aside = common.held_out(5, 0)
    rows = toxicity.score(documents.select("doc_id", "text"), toxicity.train(documents, labels, ~aside)).join(labels, "doc_id").where(aside).collect()
    right = {k: np.mean([(r["score"] >= 0.5) == bool(k) for r in rows if r["toxic"] == k]) for k in (0, 1)}
    assert right[0] > 0.95 and right[1] > 0.7, right


def test_passages_of_half_a_window_lie_whole_in_one():
    rows, _ = toxicity.window_rows(np.arange(200), np.array([0]), np.array([200]))
    size = toxicity.WINDOW - toxicity.STRIDE + 1
    assert all(any(set(range(i, i + size)) <= set(r) for r in rows) for i in range(200 - size + 1))


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        rows, owner = toxicity.window_rows(np.arange(n), np.array([0]), np.array([n]))
        assert set(rows[rows >= 0]) == set(range(n)) and (owner == 0).all() and len(rows) >= 1


def spoken(rng, toxic):
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + rng.choice(["ne", "ti", "lo", "ra"]) for _ in range(60)]
    if toxic:
        base[rng.randrange(60)] = "grumo" + rng.choice(["ne", "ti", "lo", "ra", "xu", "qa"])
    return " ".join(base)


def test_toxic_stems_are_learned():
    rng = random.Random(3)
    sample = [(spoken(rng, i % 2 == 0), int(i % 2 == 0)) for i in range(400)]
    net = toxicity.fit([t for t, _ in sample[:300]], [k for _, k in sample[:300]])
    got = toxicity.Scorer(net)([t for t, _ in sample[300:]]) >= 0.5
    assert (got == np.array([k for _, k in sample[300:]], bool)).mean() > 0.95


# --- 3
def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_reparameterised_questions(spark):
    bench = items(spark, ["A train with 3 cars runs 40 km from Anna to Berta, and 3 cars more follow it later today."])
    docs = [
        (1, "Before. A train with 3 cars runs 40 km from Anna to Berta, and 3 cars more follow it later today. After."),
        (2, "A TRAIN with 5 cars runs 70 miles from Clara to Dora, and 5 cars more follow it later today"),
        (3, "A train with 5 cars runs 70 km from Clara to Dora, and 6 cars more follow it later today"),
        (4, "A train with many cars runs far, and later more cars follow it every day of the year"),
    ]
    got = {r["doc_id"]: (r["contaminated"], r["reparameterised"], list(r["item_ids"])) for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (True, False, [0]), 2: (True, True, [0]), 3: (False, False, []), 4: (False, False, [])}


def test_one_edited_slot_does_not_clear_a_copy(spark):
    text = "the crew of 3 ships left the old harbour early that morning and sailed along the rocky coast until dusk when all {} ships came home again at last"
    apart = text.replace("rocky", "sandy").replace("sailed along", "went by")
    docs = [(1, text.format(7)), (2, text.format(3)), (3, apart.format(7)), (4, "the crew of 3 ships left the"), (5, text.format(7).replace("early that morning and sailed along the rocky coast until dusk", "x"))]
    got = {r["doc_id"]: (r["contaminated"], r["reparameterised"]) for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items(spark, [text.format(3)])).collect()}
    assert got[1] == got[2] == (True, False) and got[3][0] and not got[4][0]
    assert got[5][0]  # two runs on diagonals of their own


def test_windows_by_shuffle_and_short_items(spark):
    bench = items(spark, ["one two three four five six seven eight nine", "five little ducks went out", "too short"])
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight y"), (2, "Five little ducks went out."), (3, "too short"), (4, "one two three four")], "doc_id long, text string")
    for limit in (0, 10_000):
        got = {r["doc_id"]: list(r["item_ids"]) for r in decontaminate.decontaminate(docs, bench, broadcast_windows=limit).collect()}
        assert got == {1: [0], 2: [1], 3: [], 4: []}


# --- 4
@needs_data
def test_quality_of_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    aside = common.held_out(3, 1)
    scored = quality.score(documents.select("doc_id", "text"), quality.train(documents, labels, ~aside)).join(labels, "doc_id").where(aside)
    right = [(r["score"] >= 0.5) == bool(r["quality"]) for r in scored.collect()]
    assert np.mean(right) > 0.95


def test_weights_minimise_the_pairwise_loss():
    """Against plain gradient descent on the listed pairs."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.standard_normal(60) > 0).astype(int)
    got = quality.fit(x, y)
    z, draw, good, bad = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), np.random.default_rng(quality.SEED), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    each = quality.PAIRS_EACH
    pairs = list(zip([*np.tile(good, each), *draw.choice(good, len(bad) * each)], [*draw.choice(bad, len(good) * each), *np.tile(bad, each)], strict=True))
    w = np.zeros(3)
    for _ in range(1500):
        w += 2.0 * (np.mean([(z[a] - z[b]) / (1 + np.exp((z[a] - z[b]) @ w)) for a, b in pairs], axis=0) - 1e-3 * w)
    assert got.weights == pytest.approx(w, abs=0.05)


def test_content_tells_words_from_letters():
    rng = random.Random(2)
    words = ["river", "stone", "light", "house", "green", "cloud"]
    real = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(150)]
    noise = [" ".join("".join(rng.sample(w, 5)) for w in t.split()) for t in real]
    sample = [(t, 1) for t in real] + [(t, 0) for t in noise]
    x, y = np.array([quality.features(t.encode()) for t, _ in sample]), np.array([k for _, k in sample])
    held = np.arange(len(y)) % 3 == 0
    assert ((quality.fit(x[~held], y[~held])(x[held]) >= 0.5) == y[held]).mean() > 0.95
    text = ("Ab\tc d " * 300).encode()
    plain = np.zeros(quality.GRAMS)
    low = b" " + bytes(quality.LOWER[c] for c in text) + b" "
    for i in range(len(low) - 3):
        plain[(int.from_bytes(low[i : i + 4], "little") * 2654435761 % 2**32) >> 21] += 1
    assert quality.content(text) == pytest.approx(np.sqrt(plain / (len(low) - 3)))
    whole, quality.TOGETHER = quality.content(text), 100
    try:
        assert (quality.content(text) == whole).all()
    finally:
        quality.TOGETHER = 1 << 20


def test_pairs_rank():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0.7).astype(int)
    r = quality.fit(x, y)
    assert ((r(x) >= 0.5) == y).mean() > 0.95 and abs((r(x) < 0.5).mean() - (y == 0).mean()) < 0.05


def test_pieces_of_logits_change_nothing(monkeypatch):
    """Probabilities and slopes, worked out in pieces by sorted class, against one plain pass; targets of a round against all words one by one."""
    g = np.random.default_rng(5)
    net = lm_score.start(np.full(lm_score.LEAVES, 1 / lm_score.LEAVES))
    leaf, sides = g.integers(0, 2000, 50), g.integers(0, lm_score.EDGE + 1, (50, 2 * lm_score.REACH))
    h = np.tanh((net.vectors[sides] * net.places).sum(axis=1) + net.bias)
    k, m = np.divmod(leaf, lm_score.MEMBERS)
    tops, lows = h @ net.classes + net.class_bias, np.array([a @ net.members[c] + net.member_bias[c] for a, c in zip(h, k, strict=True)])
    soft = lambda x: np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    monkeypatch.setattr(lm_score, "CACHED", 16)
    slopes: dict = {}
    got = net.log_p(sides, leaf, slopes)
    assert got == pytest.approx(np.log(soft(tops)[range(50), k] * soft(lows)[range(50), m]), abs=1e-4)
    lost, of_member = soft(tops) - np.eye(lm_score.CLASSES)[k], soft(lows) - np.eye(lm_score.MEMBERS)[m]
    assert slopes["classes"] == pytest.approx(h.T @ lost / 50, abs=1e-5) and slopes["class_bias"] == pytest.approx(lost.mean(axis=0), abs=1e-5)
    of_h = (lost @ net.classes.T + np.array([a @ net.members[c].T for a, c in zip(of_member, k, strict=True)])) * (1 - h * h) / 50
    plain = np.zeros_like(net.vectors)
    np.add.at(plain, sides, of_h[:, None, :] * net.places)
    assert slopes["vectors"] == pytest.approx(plain, abs=1e-5) and slopes["bias"] == pytest.approx(of_h.sum(axis=0), abs=1e-5)
    lists = [g.integers(0, 99, n) for n in (0, 1, 2, 7, 30, 0)]
    for turn in range(lm_score.ROUNDS):
        flat, places, owner = lm_score.windows(lists)
        number = np.concatenate([np.arange(len(x)) + len(x) for x in lists])
        at = places[number % lm_score.ROUNDS == turn]
        s, t = lm_score.targets(lists, turn)
        assert (t == flat[at]).all() and (s == flat[at[:, None] + lm_score.OFFSETS]).all()


@pytest.mark.parametrize("bad", [150, 3])
def test_quality_is_fitted_on_every_labelled_text(spark, monkeypatch, bad):
    """Long texts and all blocks count, also with few texts of one label, and the threshold leaves as many texts below it as there are bad ones."""
    monkeypatch.setattr(quality, "BLOCK", 40)
    monkeypatch.setattr(quality, "BOTH", 8)
    rows = [(i, ("### " if i < bad else "good words, " if i % 2 else "one more sentence. ") * (5 + i % 7) + (" tail" * 2000 if i % 3 == 0 else ""), int(i >= bad)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, quality int")
    known = labels.withColumnRenamed("quality", "label")
    parts = quality.learned(quality.blocks(docs, known, {0: bad, 1: 300 - bad})).where("i = 0").collect()
    assert sum(r["n"] for r in parts) == 300 and len(parts) > 3
    ranking = quality.train(docs, labels)
    x = np.array([quality.features(t.encode()) for _, t, _ in rows], np.float64)
    assert ranking.mean == pytest.approx(x.mean(axis=0), abs=1e-6) and ranking.spread == pytest.approx(x.std(axis=0) + 1e-6, abs=1e-4)
    margins = np.sort(ranking.margin(x))
    assert ranking.threshold == pytest.approx((margins[bad - 1] + margins[bad]) / 2, abs=1e-6)
    assert ((ranking(x) >= 0.5) == [k for *_, k in rows]).mean() > 0.97


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    rows = [(i, "you stupid idiot" if i % 2 else "a nice day", i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    how = toxicity.Fit(per_class=8, steps=20)
    sample = common.labelled_sample(docs, labels, "toxic", common.F.lit(True), 8, how.max_bytes)
    plain = toxicity.fit([r["text"] for r in sample], [r["label"] for r in sample], how)
    asked = []
    monkeypatch.setattr(toxicity.Adam, "step", lambda *_: asked.append(1))  # of the driver alone
    net = toxicity.train(docs, labels, how=how)
    assert not asked and net.vocabulary == plain.vocabulary
    assert all(net.p[k] == pytest.approx(x, abs=1e-3) for k, x in plain.p.items())


# --- 5
def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    up = {i: i for i, _ in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, f) in enumerate(fps):
        for j, g in fps[:n]:
            if (f ^ g).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in fps}


@needs_data
@pytest.mark.parametrize("most", [2, 64])
def test_near_duplicates(spark, documents, most):
    docs = [(r["doc_id"], r["text"]) for r in documents.where("length(text) < 3000").limit(300).collect()] + [(5001, None), (5002, " "), (5003, "One word"), (5004, "one WORD")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), most=most).collect()}
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    assert {i: got[i]["fingerprint"] for i, _ in docs} == {i: f"{f:016x}" for i, f in fps}
    assert {i: got[i]["component_id"] for i, _ in docs} == plain_components(fps)


@pytest.mark.parametrize("most", [3, 64])
def test_links_of_crowded_fingerprints(spark, most):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(40)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    number = {v: i for i, v in enumerate(sorted(signed))}
    want = plain_components([(number[v], v % (1 << 64)) for v in sorted(signed)])
    assert {number[v]: number[roots.get(v, v)] for v in signed} == want


@pytest.mark.parametrize("most", [2, 16])
def test_texts_are_settled_in_order(spark, most):
    edges = [(2, 1), (3, 2), (4, 3), (4, 2), (6, 5), (7, 6), (7, 5), (9, 8), (10, 9), (11, 10), (12, 10)]
    got = dict(map(tuple, simhash.settled(spark.createDataFrame(edges, "c long, to long")).collect()))
    assert got == {2: 1, 4: 3, 6: 5, 7: 5, 9: 8, 11: 10, 12: 10}
    near = [" ".join(["a b c d e f g h i j k l m n o p q r s t"] * 9 + [f"x{k} y{k % 3}"]) for k in range(9)]  # near by fingerprint, most of them unlike or alike by chance
    frame = spark.createDataFrame(list(enumerate(near)), "c long, text string")
    sign = simhash.signatures(frame.selectExpr("c AS key", "cast(text AS binary) AS text")).withColumnRenamed("key", "c")
    gone = dict(map(tuple, simhash.stand_ins(sign, lambda few: few.join(frame, "c").selectExpr("c", "cast(text AS binary) AS text"), most=most).collect()))
    kept = set(range(9)) - gone.keys()
    assert all(similarity(near[c], near[to]) >= 0.8 and to in kept for c, to in gone.items())
    bits = {r["c"]: [r["f1"] % (1 << 64), r["f2"] % (1 << 64)] for r in sign.collect()}
    close = lambda i, j: any((x ^ y).bit_count() <= 5 for x, y in zip(bits[i], bits[j], strict=True))
    assert not any(close(i, j) and similarity(near[i], near[j]) >= 0.8 for i in kept for j in kept if i < j)


def test_rare_shingles_bring_similar_texts_together(spark):
    random.seed(5)
    base = [set(random.sample(range(400), random.randint(1, 40))) for _ in range(60)]
    sets = base + [set(list(b)[: len(b) - k]) | {1000 + 7 * k + n for n in range(k % 3)} for k in range(4) for b in base if len(b) > k]
    filed = simhash.filed_by_rare_shingles(spark.createDataFrame([(c, sorted(s)) for c, s in enumerate(sets)], "c long, sh array<long>"))
    under = {}
    for r in filed.collect():
        under.setdefault(r["c"], set()).add(r["key"])
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(similar) > 60 and all(under.get(a, set()) & under.get(b, set()) for a, b in similar)


def test_a_crowd_of_unlike_texts_around_one_passage(spark):
    random.seed(6)
    passage = [f"p{n}" for n in range(90)]
    own = [[f"w{random.randrange(10**6)}" for _ in range(30)] for _ in range(60)]
    texts = [" ".join(passage + w) for w in own] + [" ".join(passage + [*w[:-1], "other"]) for w in own[:7]]
    kept = [r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=4).collect()]
    assert len(kept) == 60 and {k if k < 60 else k - 60 for k in kept} == set(range(60))


def test_company_is_a_shared_key_of_the_balls(spark):
    rng = random.Random(8)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(60)]
    fps = base + [tuple(f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 6, 9]))) if k % 2 == n else rng.getrandbits(64) for n, f in enumerate(pair)) for k, pair in enumerate(base)]
    signed = [(c, *[f - (1 << 64) if f >> 63 else f for f in pair]) for c, pair in enumerate(fps)]
    frame = spark.createDataFrame(signed, "c long, f1 long, f2 long")
    under = {}
    for f in ("f1", "f2"):
        for r in frame.select("c", common.F.explode(common.F.concat(*simhash.ball_keys(2, f))).alias("k")).collect():
            under.setdefault((f, r["k"]), set()).add(r["c"])
    want = {c for cs in under.values() if len(cs) > 1 for c in cs}
    assert {r["c"] for r in simhash.in_company(frame).collect()} == want and 30 < len(want) < 120


def test_a_crowd_near_and_unlike_lists_no_pairs(spark, monkeypatch):
    """Of texts that are edited in ever other places all share keys, but few can match."""
    random.seed(7)
    base, texts = [f"p{n}" for n in range(150)], []
    for k in range(120):
        words = list(base)
        for n in random.sample(range(150), 3):
            words[n] = random.choice(["x", "y", "z"]) + str(n)
        texts.append(" ".join(words))
    sets = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "c long, text string").selectExpr("c", "cast(text AS binary) AS text"))
    entries = common.durable(simhash.filed_by_rare_shingles(sets).join(sets.select("c", "bits"), "c"))
    crowded = entries.groupBy("key").agg(common.F.count_if("early").alias("k"), common.F.count("*").alias("n")).where("k > 0")
    monkeypatch.setattr(simhash, "TILE_EARLY", 7)
    monkeypatch.setattr(simhash, "TILE_ALL", 11)
    listed = {(r["to"], r["c"]) for r in simhash.crowded_pairs(entries, crowded).collect()}
    similar = {(i, j) for j in range(120) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8 and len(shingled(texts[i])) <= len(shingled(texts[j]))}
    assert len(similar) > 3 and similar <= listed and len(listed) < 120 * 119 / 2 / 10


@pytest.mark.parametrize("seen", [64, 1])
def test_a_crowded_pair_leaves_by_one_of_its_keys(spark, monkeypatch, seen):
    """Long texts with many keys in common: each pair is listed once, and no similar pair is lost where the least keys don't show the earlier key."""
    random.seed(9)
    base, texts = [f"p{n}" for n in range(700)], []
    for k in range(40):
        words = list(base)
        for n in random.sample(range(700), 20 if k % 2 else 4):
            words[n] = random.choice(["x", "y"]) + str(n)
        texts.append(" ".join(words))
    sets = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "c long, text string").selectExpr("c", "cast(text AS binary) AS text"))
    entries = common.durable(simhash.filed_by_rare_shingles(sets).join(sets.selectExpr("c", "wide AS bits"), "c"))
    crowded = entries.groupBy("key").agg(common.F.count_if("early").alias("k"), common.F.count("*").alias("n")).where("k > 0")
    monkeypatch.setattr(simhash, "SEEN", seen)
    listed = [(r["to"], r["c"]) for r in simhash.crowded_pairs(entries, crowded).collect()]
    similar = {(i, j) for j in range(40) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8 and len(shingled(texts[i])) <= len(shingled(texts[j]))}
    keys = entries.join(crowded, "key").groupBy("key").agg(common.F.collect_list("c").alias("m"), common.F.collect_list(common.F.expr("CASE WHEN early THEN c END")).alias("led")).collect()
    met = [(a, b) for r in keys for a in r["led"] for b in r["m"] if (a, b) in similar]
    assert len(similar) > 20 and similar <= set(listed) and len(met) > 5 * len(set(met))
    assert len(listed) < (len(met) if seen == 1 else 1.2 * len(set(listed)))


def test_a_crowd_of_near_copies_is_settled_by_few_of_its_pairs(spark, monkeypatch):
    """of a crowd in which many pairs are similar and many are not, only pairs with heads that stay, and those of what is left, are verified; the fronts go to no file."""
    random.seed(10)
    base, texts = [f"p{n}" for n in range(120)], []
    for k in range(160):
        words = list(base)
        for n in random.sample(range(120), random.choice([1, 2, 3])):
            words[n] = f"{random.choice('xyz')}{n}"
        texts.append(" ".join(words))
    monkeypatch.setattr(simhash, "FIRST", 10, raising=False)
    sent, wide, verified, durable = [], [], simhash.verified, simhash.durable
    monkeypatch.setattr(simhash, "verified", lambda pairs, *more: sent.append(pairs.count()) or verified(pairs, *more))
    monkeypatch.setattr(simhash, "durable", lambda df: wide.append("front" in df.columns) or durable(df))
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=8).collect()}
    similar = {(i, j) for j in range(160) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8}
    assert len(similar) > 1000 and not any(i in kept and j in kept for i, j in similar)
    assert all(any(similarity(texts[i], texts[j]) >= 0.8 for j in kept) for i in range(160) if i not in kept)
    assert sum(sent) < len(similar) / 2 and not any(wide)


def test_few_edges_are_settled_in_few_parts(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(1, 30)], "c long, to long").repartition(60)
    out = simhash.settled(edges)
    assert out.rdd.getNumPartitions() == 1 and dict(map(tuple, out.collect())) == {k: k - 1 for k in range(2, 31, 2)}
    assert simhash.packed(spark.range(0, 100_000, 1, 50), 100_000).rdd.getNumPartitions() == 5


@functools.lru_cache(10_000)
def shingled(text):
    return frozenset(simhash.shingles_of(text.lower().encode().split(), 5))


def similarity(a, b):
    x, y = shingled(a), shingled(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_near_copies_go_only_for_a_similar_text_that_stays(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for group in range(12):
        base = rng.choices(words, k=rng.choice([3, 30, 120, 400]))
        for _ in range(rng.choice([1, 4, 25])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
        drift = list(base)
        for _ in range(6):  # each is near to the next, the last far from the first
            for k in range(len(base) // 60):
                drift[rng.randrange(len(drift))] = rng.choice(words)
            rows.append((len(rows), " ".join(drift)))
    rng.shuffle(rows)
    text = dict(rows)
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in text.keys() - kept:
        assert any(similarity(text[i], text[j]) >= 0.8 for j in kept)
    pairs = [(i, j) for i in text for j in text if i < j and similarity(text[i], text[j]) >= 0.8]
    assert len(pairs) > 500 and sum(i in kept and j in kept for i, j in pairs) < 0.02 * len(pairs)


@needs_data
def test_no_document_of_the_tables_goes_without_a_similar_one(documents):
    rows = documents.collect()
    kept = {r["doc_id"] for r in simhash.one_of_each(documents).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    gone = text.keys() - kept
    assert gone and all(any(similarity(text[i], text[j]) >= 0.8 for j in kept) for i in gone)
    alike = {}
    for i in sorted(text):
        alike.setdefault(" ".join(text[i].lower().split()), []).append(i)
    assert all(len(kept.intersection(ids)) <= 1 for ids in alike.values())


def test_every_similar_pair_shares_a_key_however_its_fingerprints_lie(spark):
    """Fingerprints of such pairs often share no ball; a text has as many keys as its length asks for, whatever else there is."""
    rng, rows = random.Random(12), []
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        other = list(words)
        other[rng.randrange(20, 40)], other[rng.randrange(60, 80)] = "x", "y"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    rows += [(1000, "One two"), (1001, "one  TWO"), (1002, "one two three"), (1003, ""), (1004, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(similarity(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8 for k in range(120))
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert len(kept & set(range(240))) == 120 and all(len(kept & {2 * k, 2 * k + 1}) == 1 for k in range(120)) and kept - set(range(240)) == {1000, 1002, 1003}
    texts = docs.selectExpr("doc_id", "cast(text AS binary) AS text")
    order = simhash.crowding(texts)
    filed = {r["doc_id"]: r for r in simhash.fronts(texts, order, ["doc_id"]).collect()}
    for i, t in rows:
        n, r = len(shingled(t or "")), filed[i]
        assert (r["size"], len(r["front"]), r["early"]) == (n, n - -(-4 * n // 5) + 1 if n else 0, n - -(-8 * n // 9) + 1 if n else 0)
    found = simhash.shingle_hashes([b"a b c d e f", b"x a b c d e", b"a b"], simhash.WordHashes())
    assert [len(x) for x in found] == [2, 2, 1] and len(set(found[0].tolist()) & set(found[1].tolist())) == 1


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_keys_of_balls(spark, parts):
    rng = random.Random(parts)
    fps = [rng.getrandbits(64) for _ in range(3)]
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").select("fp", common.F.concat(*simhash.ball_keys(parts)).alias("k")).collect()
    cuts = [64 * i // parts for i in range(parts + 1)]
    for r in rows:
        f, want = r["fp"] % (1 << 64), []
        for s in range(parts):
            own = f >> cuts[s] & (1 << (cuts[s + 1] - cuts[s])) - 1
            want += [(v * parts + s) % (1 << 64) for v in [own] + [own ^ 1 << b for b in range(cuts[s + 1] - cuts[s])]]
        assert [k % (1 << 64) for k in r["k"]] == want


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 9, i) for i in range(200)], "k long, v long")
    few = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS w")
    got = sorted((r["k"], r["v"], r["w"]) for r in simhash.by_hot_key(rows, few, "k").collect())
    assert got == sorted((k, v, 2 * k) for k, v in ((i % 7 if i % 2 else 9, i) for i in range(200)))


@needs_data
def test_near_copies_go(spark, documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.where("length(text) between 600 and 4000").orderBy("doc_id").limit(60).collect()]
    rng, rows = random.Random(3), []
    for i, t in texts:
        words = t.split()
        for k in range(30, len(words), 60):
            words[k] = f"other{rng.randrange(1000)}"
        rows += [(i, t), (i + 1_000_000, " ".join(words))]
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = {i for i, _ in texts if len(sets[i] & sets[i + 1_000_000]) >= 0.8 * len(sets[i] | sets[i + 1_000_000])}
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = sum(i + 1_000_000 not in kept for i in alike)
    assert len(alike) > 30 and gone >= 0.95 * len(alike)


# --- 6
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><div id="ad-1">Buy</div>
<article><header><h1>Main &amp; title</h1><span>by me</span></header><p>First <b>bold</b>&nbsp;text<br>here.<p>Second &#233; one.<aside>Side</aside>
<ul><li>Item</li></ul><form><input name=q>Search</form><footer>Share</footer><p>Third.</article>
<section class="comments"><article class="comment"><p>Nice!</p></article></section><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Main & title\n\nFirst bold text here.\n\nSecond é one.\n\nItem\n\nThird."
    assert html_text.main_text("") == "" == html_text.main_text(None)


@pytest.mark.parametrize(("page", "text"), [
    ("<p class=notice>Old browser<p>Real text of the page here.</p>", "Real text of the page here."),
    ("<div class='layout with-sidebar'><article><h1 class='page-header'>T</h1>Text</article></div>", "T\n\nText"),
    ("<div><p>Main text is this long line.</p></div><div class=comments><article class=comment>Bad</article></div>", "Main text is this long line."),
    ("<nav><ul><li>a<main><p>Body &lt;b&gt; text", "Body <b> text"), ("<article>One<div>Two</div>Three &nbsp; x</article>", "One\n\nTwo\n\nThree x"),
])
def test_broken_and_nested_pages(page, text):
    assert html_text.main_text(page) == text


def test_region_without_article():
    body = "".join(f"<p>{'A long sentence of the main text. ' * 6}{i}</p>" for i in range(5))
    page = f"<body><div><a href=1>x</a><a href=2>y</a></div><ul><li><a>l</a></li><li><a>m</a></li><li><a>n</a></li></ul>{body}<p><a>tail</a> <a>b</a> <a>c</a></p><p><a>d</a></p></body>"
    got = html_text.main_text(page).split("\n\n")
    assert all(f"text. {i}" in "\n".join(got) for i in range(5)) and "l" not in got and "tail b c" not in got[-1:]


LONG = "A long sentence of the main text, with many words in it, on and on."


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><h1>T</h1><p>{LONG}</p><p class='social-history'>Has a social history.</p><section id='discussion'><p>We discuss it here.</p></section></article>", f"T\n\n{LONG}\n\nHas a social history.\n\nWe discuss it here."),
    (f"<body class=has-sidebar><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><article class='teaser'><h2>Other</h2><p>Read on</p></article></body>", f"T\n\n{LONG}\n\n{LONG}"),
    (f"<body><nav><a href=x>Home</a> <a href=y>News</a></nav><h1>Title</h1><p>Short intro.</p>{f'<p>{LONG}</p>' * 3}<p>The end.</p><footer>(c) us</footer></body>", f"Title\n\nShort intro.\n\n{LONG}\n\n{LONG}\n\n{LONG}\n\nThe end."),
    (f"<body><div id=page><div id=menu><a href=1>x</a></div><div id=content><h1>Title</h1><div class=text>{f'<p>{LONG}</p>' * 3}<p>Bye.</p></div><div class='share-box'>Share it</div></div></div></body>", f"Title\n\n{LONG}\n\n{LONG}\n\n{LONG}\n\nBye."),
    (f"<main><h1>T</h1><div class=body><p>{LONG}</p></div><div class=comments><p>{LONG * 3}</p></div></main>", f"T\n\n{LONG}"),
    (f"<main><article><p>{LONG}</p><div class=advert-2>{LONG}</div><div class='comment-list'>{LONG}</div></article><div class=teaser>Read on</div></main>", LONG),
])
def test_names_are_features_and_boxes_are_chosen_by_mass(page, text):
    assert html_text.main_text(page) == text


@needs_data
def test_clusters_decide_on_every_page(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("html").collect()]
    decided = 0
    for page in pages:
        lines = html_text.Lines()
        lines.feed(page)
        lines.close()
        lines.end_block()
        region, numbers = html_text.region_of(lines)
        ratios = np.array([html_text.weight(b) * len(b.text) / (b.tags + 1) for b in lines.blocks])
        level = plain_smooth(ratios)
        cut = html_text.threshold(level)
        high = [b for b, x, r in zip(lines.blocks, level, ratios, strict=True) if x >= cut - 1e-9 and r > 0]
        decided += bool(high) and sum(b.node.inside for b in high) > len(high) / 2 and set(numbers) == {i for i, b in enumerate(lines.blocks) if b.node.inside}
    assert decided == len(pages) > 0


def plain_smooth(x, sigma=1.0):
    k = [np.exp(-0.5 * (d / sigma) ** 2) for d in range(-3, 4)]
    return np.array([sum(k[d + 3] * x[min(max(i + d, 0), len(x) - 1)] for d in range(-3, 4)) / sum(k) for i in range(len(x))])


def test_gaussian_and_threshold():
    x = np.array([0, 0, 0, 9, 9, 9, 0, 0.0])
    assert html_text.smooth(x) == pytest.approx(plain_smooth(x)) and html_text.smooth(x).sum() == pytest.approx(x.sum(), rel=0.01) and 0 < html_text.threshold(x) < 9


def test_deep_and_broken_pages_take_linear_time():
    assert html_text.main_text("<div>word " * 20000).count("word") >= 14000
    assert html_text.main_text("<article>" + "<li>word</p> </b>" * 20000).count("word") == 20000


# --- 7
def plain_decode(jpeg):
    """Blocks x 64 quantised coefficients of a baseline JPEG in one scan, bit by bit."""
    at, tables, restart = 2, {}, 0
    while jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        marker, body = jpeg[at + 1], jpeg[at + 4 : at + 2 + size]
        if marker == 0xC4:
            codes, code, k = tables.setdefault(body[0], {}), 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    codes[f"{code:0{bits}b}"] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC0:
            high, wide, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            parts = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
        at += 2 + size
    size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
    use = [jpeg[at + 6 + 2 * i] for i in range(n)]
    scan = jpeg[at + 2 + size :]
    if n == 1:
        parts = [(1, 1)]
    mcus = -(-high // (8 * max(v for _, v in parts))) * -(-wide // (8 * max(h for h, _ in parts)))
    pattern = [c for c, (h, v) in enumerate(parts) for _ in range(h * v)]
    pieces = re.split(rb"\xff[\xd0-\xd9]", scan)
    out = []
    for i in range(0, mcus, restart or mcus):
        bits = "".join(f"{b:08b}" for b in pieces[i // (restart or mcus)].replace(b"\xff\x00", b"\xff"))
        pos, last = 0, [0] * n

        def symbol(codes):
            nonlocal pos
            for k in range(1, 17):
                if bits[pos : pos + k] in codes:
                    pos += k
                    return codes[bits[pos - k : pos]]

        def value(k):
            nonlocal pos
            pos += k
            v = int(bits[pos - k : pos] or "0", 2)
            return v if not k or bits[pos - k] == "1" else v - (1 << k) + 1

        for _ in range(min(restart or mcus, mcus - i)):
            for c in pattern:
                row = [0] * 64
                last[c] += value(symbol(tables[use[c] >> 4]))
                row[0], k = last[c], 1
                while k < 64 and (s := symbol(tables[0x10 | use[c] & 15])):
                    k += s >> 4
                    row[k] = value(s & 15)
                    k += 1
                out.append(row)
    return np.array(out)


def plain_encode(rng, high, wide, parts, restart):
    """A JPEG of random coefficients, with tables of codes of 9 to 11 bits."""
    symbols = [r << 4 | s for r in range(16) for s in range(11)]
    order = rng.sample(symbols, len(symbols))
    counts = [0] * 8 + [60, 60, len(symbols) - 120] + [0] * 5
    codes, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            codes[order[k]] = f"{code:0{bits}b}"
            code, k = code + 1, k + 1
        code <<= 1
    table = bytes(counts) + bytes(order)
    n = len(parts)
    head = b"\xff\xd8" + avi.segment(0xDB, b"\x00" + bytes(rng.randrange(1, 30) for _ in range(64))) + avi.segment(0xC0, bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    head += avi.segment(0xC4, b"\x00" + table) + avi.segment(0xC4, b"\x10" + table) + (avi.segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    head += avi.segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x3f\x00")
    across, down = (max(h for h, _ in parts), max(v for _, v in parts)) if n > 1 else (1, 1)
    mcus, pattern = -(-high // (8 * down)) * -(-wide // (8 * across)), [0] if n == 1 else [c for c, (h, v) in enumerate(parts) for _ in range(h * v)]

    def bits_of(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    scan, rows, every = b"", [], restart or mcus
    for i in range(0, mcus, every):
        bits, last = "", [0] * n
        for _ in range(min(every, mcus - i)):
            for c in pattern:
                row = [rng.randrange(-400, 400)] + [rng.choice((0, 0, 0, 0, rng.randrange(-60, 60))) for _ in range(63)]
                for k in range(rng.randrange(1, 65), 64):
                    row[k] = 0
                size, text = bits_of(row[0] - last[c])
                bits, last[c], k = bits + codes[size] + text, row[0], 1
                end = max([j for j in range(64) if row[j]], default=0)
                while k <= end:
                    run = next(j for j in range(k, 64) if row[j]) - k
                    run = min(run, 15)
                    size, text = bits_of(row[k + run])
                    bits, k = bits + codes[run << 4 | size] + text, k + run + 1
                if k < 64:
                    bits += codes[0]
                rows.append(row)
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + i // every % 8]) if i + every < mcus else b"\xff\xd9")
    return head + scan, np.array(rows)


@pytest.mark.parametrize(("parts", "restart"), [(((1, 1),), 0), (((1, 1),), 3), (((2, 1), (1, 1), (1, 1)), 0), (((2, 2), (1, 1), (1, 1)), 2)])
def test_frames_of_other_encoders(parts, restart):
    rng = random.Random(7)
    made = [plain_encode(random.Random(7 if i < 2 else 8), 37, 50, parts, restart) for i in range(2)] + [plain_encode(rng, 37, 50, parts, restart)]
    for jpeg, rows in made:
        assert (plain_decode(jpeg) == rows).all()
    head = avi.head_of(made[0][0])
    got = avi.entropy_decode([j[head.length :] for j, _ in made], head)
    assert (got == np.array([r for _, r in made])).all()
    seen = avi.pixels(got[:1], head)
    assert seen.shape == (1, 37 * 50)
    wave = lambda u, x: (0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    zigzag = [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)]
    assert all(np.allclose(avi.COSINES[k].reshape(8, 8), [[wave(u, y) * wave(v, x) for x in range(8)] for y in range(8)]) for k, (u, v) in enumerate(zigzag))
    q = head.quantisers[0]
    block = got[0, 0] * q @ avi.COSINES
    assert (seen[0, :64] == np.clip(np.rint(block) + 128, 0, 255)).all()


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1024, 1025, 5000])
def test_avi_round_trip(size):
    for raw in (os.urandom(size), ("é" * size).encode(), bytes(size), b"\xff" * size):
        payload = avi.payload_of(raw)
        media = avi.encode(payload)
        assert avi.read_back(media) == payload and len(payload) % 64 == 0 and len(payload) >= 64
        at, n, rate, length = avi.index_of(media)
        assert rate == 25 and length == len(payload) and len(at) == -(-len(payload) // 1024)
        frame = plain_decode(media[at[0] : at[0] + n[0]])
        assert np.where(frame < 0, frame + 255, frame).astype(np.uint8).tobytes()[: len(payload)] == payload[:1024]


def test_every_frame_is_decoded(monkeypatch):
    frames, decode = [], avi.entropy_decode
    monkeypatch.setattr(avi, "entropy_decode", lambda scans, head: frames.append(len(scans)) or decode(scans, head))
    texts = ["a plain text".encode() * n for n in (1, 100, 3000)]
    made = avi.films([avi.encode(avi.payload_of(t)) for t in texts])
    assert [f.payload for f in made] == [avi.payload_of(t) for t in texts] and sum(frames) == sum(len(f.bins) for f in made) == 1 + 2 + 36


def plain_shots(bins):
    n = len(bins)
    jump = [sum(abs(int(a) - int(b)) for a, b in zip(bins[i], bins[i + 1], strict=True)) / (bins[i].sum() + bins[i + 1].sum()) for i in range(n - 1)]
    around = [jump[max(0, i - avi.REACH) : i + avi.REACH + 1] for i in range(n - 1)]
    return [0] + [i + 1 for i in range(n - 1) if jump[i] > avi.LEAST_JUMP and jump[i] > np.mean(around[i]) + 1.5 * np.std(around[i])]


def test_shots_and_clips(spark):
    raw = b"a" * 4096 + b"\xf0" * 4096 + b"a" * 2048
    assert avi.shots(avi.films([avi.encode(avi.payload_of(raw))])[0].bins).tolist() == [0, 4, 8]
    mixed = b"".join(bytes([random.Random(i // 5).randrange(256)]) * 1024 for i in range(60))
    bins = avi.films([avi.encode(avi.payload_of(mixed))])[0].bins
    assert avi.shots(bins).tolist() == plain_shots(bins) and len(plain_shots(bins)) > 2
    stored = avi.store(spark.createDataFrame([(1, "a" * 4096 + " " * 4096)], "doc_id long, text string"))
    assert [(r["clip"], r["start_s"], r["end_s"], r["n_frames"]) for r in avi.clips(stored).collect()] == [(0, 0.0, 0.16, 4), (1, 0.16, 0.32, 4)]


def test_digests(spark):
    r = avi.digests(spark.createDataFrame([(1, "hé"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    pad = "hé".encode() + bytes(61)
    assert (r[0]["n_bytes"], r[0]["payload_bytes"], r[0]["payload_sha256"], r[0]["tail_crc32"]) == (3, 64, hashlib.sha256(pad).hexdigest(), zlib.crc32(pad)) and r[1]["payload_bytes"] == 64
    assert (r[0]["n_clips"], r[0]["clips"]) == (1, "0-0.04")


# --- 8
def test_pfair_deviation(spark):
    rng = random.Random(2)
    docs = [(i, "x" * rng.randrange(400), rng.choice("aaaaabbbcd")) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, alpha=0.7, block_bytes=500, slots=60).collect()
    assert len(got) == 3000
    pattern = mixing.one_period(mixing.shares(df.selectExpr("source", "length(text) + 1 AS n").groupBy("source").agg({"n": "sum"}).toDF("source", "bytes"), None, 0.7, 60)).collect()
    period, share = pattern[0]["period"], {r["source"]: r["share"] for r in pattern}
    assert sorted(r["slot"] for r in pattern) == list(range(period)) and all(r["release"] <= r["slot"] < r["deadline"] for r in pattern)
    seen = dict.fromkeys(share, 0)
    for r in sorted(pattern, key=lambda r: r["slot"]):
        seen[r["source"]] += 1
        for s, n in seen.items():
            assert abs(n - (r["slot"] + 1) * share[s] / period) < 1
    total = dict.fromkeys(share, 0)
    for i, t, s in docs:  # blocks by running bytes in order of doc_id
        at = next(r for r in got if r["doc_id"] == i) if i % 97 == 0 else None
        assert at is None or at["block"] == total[s] // 500
        total[s] += len(t) + 1


def test_items_without_an_id_and_with_a_shared_one(spark):
    one, two, three = "the quick brown fox jumps over the lazy dog tonight", "ships sail on the open sea at night without any lights", "bread is baked from flour water salt and time alone"
    bench = spark.createDataFrame([(None, one), (None, three), (5, one), (5, two), (6, None), (None, None)], "item_id long, text string")
    rows = [(1, "so " + one), (2, two), (3, three), (4, "nothing of that kind is in here at all today"), (5, one + " " + two + " " + three), (6, None)]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert [(got[i]["contaminated"], got[i]["item_ids"], got[i]["n_items"]) for i in range(1, 7)] == [(True, [5], 2), (True, [5], 1), (True, [], 1), (False, [], 0), (True, [5], 2), (False, [], 0)]
    left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench.where("item_id is null"))
    assert {r["doc_id"] for r in left.collect()} == {2, 4, 6}


def test_given_weights(spark):
    df = spark.createDataFrame([(i, "x" * 99, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    got = [r for r in mixing.mix(df, weights={"a": 3.0, "b": 1.0}, block_bytes=1000, slots=40).collect() if r["in_mix"]]
    part = sum(r["source"] == "a" for r in got) / len(got)
    assert 0.70 < part < 0.80 and sum(r["source"] == "a" for r in got) == 200


def test_shares_follow_their_targets_over_many_periods(spark):
    """One document of a third source neither ends the mix nor gets much more than its weight; the others stay within a block of their targets."""
    docs = [(i, "x" * 999, "aab"[i % 3]) for i in range(9000)] + [(9000, "tiny", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, block_bytes=10_000, slots=128).orderBy("slot", "doc_id").collect()
    size = {"a": 6_000_000, "b": 3_000_000, "c": 5}
    whole = sum(n**0.9 for n in size.values())
    kept = [r for r in got if r["in_mix"]]
    assert len(got) == 9001 and sum(r["source"] == "c" for r in kept) == 1 and sum(r["source"] == "b" for r in kept) == 3000 and len(kept) > 8400
    period = {r["source"]: (r["share"], r["period"]) for r in mixing.one_period(mixing.shares(df.selectExpr("source", "length(text) + 1 AS n").groupBy("source").agg({"n": "sum"}).toDF("source", "bytes"), None, 0.9, 128)).collect()}
    assert {r["source"] for r in got if not r["in_mix"]} <= {"a"}
    last = max(r["slot"] for r in kept)
    blocks = {s: sorted({r["slot"] for r in kept if r["source"] == s}) for s in "ab"}
    for s in "ab":
        share, p = period[s]
        assert abs(share / p - size[s] ** 0.9 / whole) <= 1 / p
        assert all(abs(sum(x <= t for x in blocks[s]) - (t + 1) * share / p) < 1 for t in range(0, min(last, blocks[s][-1]), 7))


def test_more_sources_than_slots(spark):
    df = spark.createDataFrame([(i, "x" * 50, f"s{i % 300}") for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(df, block_bytes=100, slots=64).collect()
    assert len(got) == 900 and len({r["slot"] for r in got}) >= 300


def test_small_sources_leave_the_schedule_and_cost_nothing(spark):
    """Of the formula's sizes: sources that run out early stay whole, until they have a twentieth of all weights."""
    big = [(i, "x" * 99, "a") for i in range(16_400)]
    df = spark.createDataFrame(big + [(20_000 + i, "y" * 99, "b") for i in range(9)], "doc_id long, text string, source string")
    assert mixing.within_weights(df, block_bytes=100).count() == 16_409
    one = spark.createDataFrame(big, "doc_id long, text string, source string")
    assert mixing.within_weights(one, block_bytes=100).count() == 16_400
    half = spark.createDataFrame(big + [(20_000 + i, "y" * 99, "b") for i in range(4000)] + [(30_000 + i, "z" * 99, "c") for i in range(40)], "doc_id long, text string, source string")
    kept = {r["source"]: r["count"] for r in mixing.within_weights(half, block_bytes=100).groupBy("source").count().collect()}
    w = {s: (n * 100) ** 0.9 for s, n in (("a", 16_400), ("b", 4000), ("c", 40))}
    assert w["c"] < 0.05 * sum(w.values()) < w["b"] and kept["c"] == 40 and kept["b"] == 4000
    assert abs(kept["a"] - (4000 * 100 + 100) / w["b"] * w["a"] / 100) <= 1


def test_the_pipeline_keeps_what_the_schedule_takes(spark):
    """The rows that stay are those of the first slots of the Pfair schedule, and one block of each source whose window is open."""
    docs = [(i, "x" * (40 + i % 90), "a" if i % 9 else "b") for i in range(3000)] + [(5000 + i, "z" * 99, "c") for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in mixing.within_weights(df, block_bytes=500, slots=48).collect()}
    rows = {r["doc_id"]: r for r in mixing.mix(df, block_bytes=500, slots=48).collect()}
    end = min(rows[i]["release"] for i in rows.keys() - kept)
    assert 2000 < len(kept) < len(docs) and all(rows[i]["release"] < end for i in kept) and {i for i in rows if rows[i]["slot"] < end} <= kept
    assert all(rows[i]["deadline"] >= end for i in kept if rows[i]["slot"] >= end)


def test_tiny_source_does_not_end_the_mix(spark):
    docs = [(i, "x" * 999, "ab"[i % 2], i) for i in range(4000)] + [(None, "tiny", None, 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n long")
    assert [r["n"] for r in mixing.within_weights(df, block_bytes=1000).orderBy("n").collect()] == list(range(4001))
    assert mixing.within_weights(df.where("false")).collect() == []


def test_only_the_surplus_leaves_the_mix(spark):
    size = {"a": 4000, "b": 1000, "c": 500}
    docs = [(i, "x" * 99, s) for s, n in size.items() for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r["source"]: r["count"] for r in mixing.within_weights(df, block_bytes=1000).groupBy("source").count().collect()}
    end = min((100 * n + 1000) / (100 * n) ** 0.9 for n in size.values())
    for s, n in size.items():
        assert abs(kept[s] - min(n, end * (100 * n) ** 0.9 / 100)) <= 10  # a block
    assert kept["c"] == 500 and 3000 < kept["a"] < 4000


# --- 9
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(spark, shards):
    rng = random.Random(4)
    docs = [(i * 3, rng.choice(["same text", "y" * rng.randrange(300)]), rng.choice(["en", "de"]), "s" + str(rng.randrange(5))) for i in range(3000)]
    got = sharding.kd_shards(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), shards, bins=16).collect()
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    assert sorted(sizes) == list(range(shards)) and max(sizes.values()) - min(sizes.values()) < 4 * 301
    for v in slots.values():
        assert [s for s, _ in sorted(v)] == list(range(len(v))) and [i for _, i in sorted(v)] == sorted(i for _, i in v)
    text = {i: t for i, t, *_ in docs}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)


def plain_shards(rows, shards):
    """k-d splits of (doc_id, chars, lang, source, size): sort each node by its widest dimension, then doc_id, and cut where the bytes are nearest to the goal."""
    dims = [(r[1], zlib.crc32(r[2].encode()), zlib.crc32(r[3].encode()), r[0]) for r in rows]
    span = [max(1, max(d[k] for d in dims) - min(d[k] for d in dims)) for k in range(4)]
    out = {}

    def split(some, first, n):
        if n == 1 or not some:
            out.update({rows[i][0]: first for i in some})
            return
        k = max(range(4), key=lambda k: ((max(dims[i][k] for i in some) - min(dims[i][k] for i in some)) / span[k], -k))
        order = sorted(some, key=lambda i: (dims[i][k], rows[i][0]))
        goal, total, at = sum(rows[i][4] for i in some) * (n // 2) // n, 0, 0
        while total + rows[order[at]][4] < goal:
            total, at = total + rows[order[at]][4], at + 1
        size = rows[order[at]][4]
        at += not goal - total < total + size - goal
        split(order[:at], first, n // 2)
        split(order[at:], first + n // 2, n - n // 2)

    split(list(range(len(rows))), 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_shards_are_those_of_plain_splits(spark, shards):
    rng = random.Random(shards)
    docs = [(i * 7 % 1009, "z" * rng.randrange(1, 200), rng.choice(["en", "de", "fr"]), rng.choice("abc")) for i in range(1000)]
    got = sharding.kd_shards(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), shards, bins=16).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == plain_shards([(i, len(t), lang, src, len(t) + 1) for i, t, lang, src in docs], shards)


def test_a_shared_doc_id_is_split(spark):
    docs = [(5, f"text {i} " + "y" * (i % 50)) for i in range(2000)] + [(5, "same")] * 2000
    got = sharding.kd_shards(spark.createDataFrame(docs, "doc_id long, text string"), 8, bins=16).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(got) == 4000 and sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) < 4 * 70


# --- 10
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(s):
    digits = lambda x: re.sub("[^0-9]", "", x)
    tests = (lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, s) if tests[k](m[0]))


def test_base_spans_match_the_patterns():
    rng = random.Random(6)
    for s in ["a@b.c@d.e x@y.zz%w@q.r..@a.b", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (487) 555-7209 1234", "4111 1111 1111 1111", *("".join(rng.choices("a1@.+- (\n9é", k=60)) for _ in range(3000))]:
        assert pii.base_spans(s) == plain_spans(s), s
    long = "1" * 100_000 + "." + "0" * 5000 + "1.2.3"
    assert pii.base_spans(long) == [] and pii.base_spans("1." + "0" * 5000 + "1.2.3") == [(0, 1, 5007)]


def test_repeated_mentions_get_one_label():
    texts = ["Call +1 (487) 555-7209 now", "mail a.b@c.org or 10.0.0.7", "card 4111 1111 1111 1111", "in 1999 there were 12 of 40", "born 1975, room 12, 3 cats"] * 30
    field = pii.fit(texts)
    text = "Call +1 487 555-7209 first, else ring 555-7209 or 555-7209 after 1999"
    base, every = pii.all_spans(text, field)
    assert set(base) <= set(every)
    found = [text[a:b] for a, k, b in every if (a, k, b) not in base]
    assert found and all("555-7209" in f for f in found)


def test_beliefs_are_exact_without_loops():
    """Against the sum over all labellings; with loops, the likeliest labels of strongly linked tokens."""
    import itertools

    g = np.random.default_rng(4)
    field = pii.Field(g.standard_normal((pii.FEATURES, 5)), 0.8, 1.3)
    x = (g.random((5, pii.FEATURES)) < 0.2).astype(np.float32)
    seen = np.array([-1, -1, 2, -1, -1])
    d = pii.Document([], [(0, 1)] * 5, x, seen, np.array([[0, 1], [1, 2]]), np.array([[2, 4], [0, 3]]))
    node, total = x @ field.unary, np.zeros((5, 5))
    for labels in itertools.product(range(5), repeat=5):
        if labels[2] == 2:
            s = sum(node[i, k] for i, k in enumerate(labels) if i != 2) + sum(0.8 * (labels[a] == labels[b]) for a, b in d.chain) + sum(1.3 * (labels[a] == labels[b]) for a, b in d.skip)
            for i, k in enumerate(labels):
                total[i, k] += np.exp(s)
    assert pii.beliefs(d, field) == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=1e-6)


def test_gradient_of_the_pseudo_likelihood():
    g = np.random.default_rng(5)
    x, chain, skip, y = g.random((7, pii.FEATURES)), g.integers(0, 3, (7, 5)), g.integers(0, 2, (7, 5)), g.integers(0, 5, 7)
    w = g.standard_normal(pii.FEATURES * 5 + 2) * 0.3
    loss = lambda w: -np.log(pii.conditional(w, x, chain, skip)[np.arange(7), y]).mean()
    got = pii.slope(w, x, chain, skip, np.eye(5)[y])
    for k in (0, 17, 60, len(w) - 2, len(w) - 1):
        step = np.eye(len(w))[k] * 1e-5
        assert (loss(w + step) - loss(w - step)) / 2e-5 == pytest.approx(got[k], abs=1e-7)


def test_conflicting_labels_and_shared_ids_have_one_result(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (4, 1)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", common.F.lit(True), 10, 100)
    assert sorted((r["label"], r["text"]) for r in got) == [(0, "c"), (1, "a")]
