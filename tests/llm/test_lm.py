"""Language-model scoring: the recurrent model against a step-by-step one, base scores against plain counts."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from perdura.llm import lm, queries, recurrent
from tests.llm.test_queries import SF, by_id, fold, texts

DOCS = "doc_id long, text string, lang string, base double, row long, ids string, held_out boolean, rare int"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def check_base(got, docs):
    """docs: (doc_id, text) in the order of got's rows."""
    counts = collections.Counter(w for i, t in docs if fold("" if i is None else i, 5) != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r, (i, t) in zip(got, docs, strict=True):
        x = tokens(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, fold("" if i is None else i, 5) == 1, len(x), sum(counts[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel=1e-9, abs=1e-9)


def plain_score(flat, ids):
    """One text, one step at a time, by the whole distribution."""
    p, h, previous, total = recurrent.parts(flat.astype(float)), np.zeros(recurrent.STATE), recurrent.END, 0.0
    for y in ids.tolist():
        z, b = np.split(p["x"][previous] + h @ p["u"], 2)
        h = h + 1 / (1 + np.exp(-2 * z)) * (np.tanh(b) - h)
        c = np.exp(h @ p["c"] + p["cb"])
        w = np.exp(np.einsum("h,khm->km", h, p["w"]) + p["wb"])
        all_words = (c / c.sum())[:, None] * w / w.sum(axis=1, keepdims=True)
        assert all_words.sum() == pytest.approx(1)
        total += math.log(all_words.reshape(-1)[y])
        previous = y
    return total


def some_docs(seed, sizes):
    rng = np.random.default_rng(seed)
    return [np.append(rng.choice([0, *range(2, 60)], n), recurrent.END).astype(np.uint16) for n in sizes]


def test_lanes_and_windows_do_not_change_a_score(monkeypatch):
    flat = recurrent.initial(np.arange(recurrent.SIZE)[::-1] ** 2.0)
    flat = flat + np.random.default_rng(1).standard_normal(len(flat)).astype(np.float32) * 0.2
    docs = some_docs(2, [0, 1, 5, 63, 64, 65, 700, 3, 0, 130])
    plain = [plain_score(flat, d) for d in docs]
    for lanes, steps, block in ((1, 64, 16), (3, 7, 2), (1024, 64, 1)):
        monkeypatch.setattr(recurrent, "SCORED_LANES", lanes)
        monkeypatch.setattr(recurrent, "SCORED_STEPS", steps)
        monkeypatch.setattr(recurrent, "BLOCK", block)
        assert recurrent.scores(flat, docs) == pytest.approx(plain, rel=1e-5)
    assert recurrent.scores(flat * 30, docs[:3]) == pytest.approx([plain_score(flat * 30, d) for d in docs[:3]], rel=1e-4)  # shifted exponents
    assert len(recurrent.scores(flat, [])) == 0


def test_gradient_is_that_of_the_window_loss():
    rng = np.random.default_rng(4)
    flat = (rng.standard_normal(recurrent.WEIGHTS) * 0.3).astype(np.float32)
    h = rng.uniform(-0.5, 0.5, (3, recurrent.STATE)).astype(np.float32)
    _, inputs, targets, there = next(recurrent.Lanes.of(some_docs(5, [4, 9, 30, 2]), 3).windows(12))
    loss = lambda w: recurrent.gradient(recurrent.parts(w), inputs, targets, there, h)[2]
    g = recurrent.gradient(recurrent.parts(flat), inputs, targets, there, h)[0]
    for k in range(12):
        way = rng.standard_normal(recurrent.WEIGHTS).astype(np.float32) * (np.abs(g) > 0)
        step = np.float32(2e-3)
        assert (loss(flat + step * way) - loss(flat - step * way)) / (2 * step) == pytest.approx(float(g @ way), rel=0.02, abs=0.02)


def test_training_learns_what_follows_what():
    """After an a comes a b or a c by what the text began with: unigrams cannot know, a state can."""
    rng = np.random.default_rng(6)
    docs = [np.array([2 + kind, *([4, 5 + kind] * 15), recurrent.END], dtype=np.uint16) for kind in rng.integers(0, 2, 1500)]
    counts = np.bincount(np.concatenate(docs), minlength=recurrent.SIZE)
    start = recurrent.initial(counts)
    after = recurrent.train(start, docs[:1400], 0.02, 32, 200)
    held = docs[1400:]
    n = sum(map(len, held))
    assert -recurrent.scores(start, held).sum() / n > 1.0 and -recurrent.scores(after, held).sum() / n < 0.25


def test_odd_rows_and_bounded_frequent_words(spark, monkeypatch):
    text = "The  the THE É é\x0bword\x1cword\nend"
    docs = [(1, text), (2, None), (3, ""), (4, " \t\n "), (4, " \t\n "), (None, "the null"), (7, "only here " * 50), (6, "x" * 200_000 + " Y"), (8, "a" * 200_000 + " b")]
    docs += [(100 + k, "the end of word%d" % (k % 7)) for k in range(60)]
    rows = [(i, t, "en", 1.0, 5, "x", True, 3) for i, t in docs]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = lm.score_texts(df)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    ordered = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, len(tokens(d[1]))))
    whole = sorted(got.collect(), key=key)
    check_base(whole, ordered)
    assert all(r.score < 0 for r in whole)
    for words, size in ((3, 1 << 24), (0, 1 << 24), (1 << 18, 20)):
        monkeypatch.setattr(lm, "TOP_WORDS", words)
        monkeypatch.setattr(lm, "TOP_BYTES", size)
        check_base(sorted(lm.score_texts(df).collect(), key=key), ordered)
    assert lm.score_texts(spark.createDataFrame([], DOCS)).collect() == []
    held = spark.createDataFrame([(i, "a b a", "en", 1.0, 5, "x", True, 3) for i in range(200) if fold(i, 5) == 1], DOCS)
    check_base(sorted(lm.score_texts(held).collect(), key=key), [(i, "a b a") for i in range(200) if fold(i, 5) == 1])


def test_op11_counts_scores_and_held_out_gain(spark, monkeypatch):
    df = queries.op11_language_model(spark, SF)
    got, docs = by_id(df), texts(SF)
    check_base([got[i] for i in sorted(docs)], [(i, docs[i]) for i in sorted(docs)])
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)
    monkeypatch.setattr(lm, "TOP_WORDS", 5000)  # more words by the join: the same results
    for r in queries.op11_language_model(spark, SF).collect():
        assert r.score == pytest.approx(got[r.doc_id].score, rel=1e-4)


def test_a_words_share_sums_to_one(spark):
    rows = [(i, " ".join(f"w{j * j % 99991}" for j in range(i, 9 * i)), "en", 1.0, 5, "x", True, 3) for i in range(200)]
    lex = lm.lexicon(lm.count_words(spark.createDataFrame(rows, DOCS)))
    beyond = lex.counts[len(lex.modelled):]
    assert beyond.sum() == lex.beyond and lex.beyond * lex.per_count + lex.unseen == pytest.approx(1)
    assert zlib.crc32(b"") % 5 != 1
