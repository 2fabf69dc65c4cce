"""Hashes without structural collisions, and language sums too small for a number."""

import zlib

import numpy as np
import pytest

from perdura.llm import langid, neardup, packing, passages, words
from perdura.llm.queries import tokenizer_path


def doubled(k, x="a", y="b"):
    """The doubling pattern x, xy, xyyx, ... and its complement: they collide modulo a power of two for every odd base."""
    s, turn = x, str.maketrans(x + y, y + x)
    for _ in range(k):
        s += s.translate(turn)
    return s, s.translate(turn)


@pytest.mark.parametrize("k", range(4, 13))
def test_doubling_patterns_do_not_collide(k):
    s, t = doubled(k)
    a, b = words.word_hashes(f"{s} {t}".encode())
    assert a != b
    runs = [words.Runs(words.word_hashes(" ".join(x).encode())) for x in (s, t)]
    n = len(s)
    assert runs[0].of(np.array([0]), n)[0] != runs[1].of(np.array([0]), n)[0]
    assert runs[0].of(np.array([1]), n - 1)[0] != runs[1].of(np.array([1]), n - 1)[0]


def test_products_modulo_the_prime_and_equal_runs():
    p, rng = int(words.PRIME), np.random.default_rng(1)
    a = np.append(rng.integers(0, p, 500, dtype=np.uint64), [0, 1, p - 1, p - 1]).astype(np.uint64)
    assert [int(x) for x in words.times(a, a[::-1].copy())] == [int(x) * int(y) % p for x, y in zip(a, a[::-1], strict=True)]
    h = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    h[39_000:39_100] = h[5:105]
    one, other = words.Runs.each([h[:20_000], h[20_000:]])
    assert one.of(np.array([5, 6]), 99).tolist() == other.of(np.array([19_000, 19_001]), 99).tolist()


def test_texts_hashed_together_have_their_own_words(monkeypatch):
    monkeypatch.setattr(words, "GROUP_BYTES", 40)
    texts = [b"", b"a b  c", b" \t", b"Abc\x0bd", "é".encode() * 200, b"x" * 255, b"x" * 256, b"x" * 257, b"A" * 300, b"12345678", b"123456789", b"123456781234567"]
    got = list(words.all_word_hashes(texts))
    assert [len(h) for h in got] == [len(t.split()) for t in texts]
    for t, h in zip(texts, got, strict=True):
        assert h.tolist() == [int(words.word_hashes(w)[0]) for w in t.split()]
    assert words.word_hashes(b"A" * 300, lower=True) == words.word_hashes(b"a" * 300) != got[8]
    assert len({int(x) for h in got for x in h}) == len({w for t in texts for w in t.split()})


def test_op7_does_not_link_patterns_without_a_common_shingle(spark):
    rows = [(2 * k + j, doubled(k)[j]) for k in range(4, 13) for j in (0, 1)]
    rows += [(100 + 2 * k + j, " ".join(doubled(k)[j])) for k in range(1, 3) for j in (0, 1)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Near(3, 85)).collect()
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id < 100)


def test_op6_and_op9_tell_patterns_apart(spark):
    s, t = doubled(10)
    docs = spark.createDataFrame([(1, " ".join(s)), (2, " ".join(t) + " tail " + " ".join(t)), (3, " ".join(s))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in passages.removal_digests(docs).collect()}
    assert got[3] == 1024 and got[1] == 0
    windows = {tuple(list(s)[i : i + 50]) for i in range(1024 - 49)}
    body = [*t, "tail", *t]
    gone = {j for i in range(len(body) - 49) if tuple(body[i : i + 50]) in windows for j in range(i, i + 50)}
    assert got[2] == len(gone)
    enc = packing.Encoder(tokenizer_path())
    texts = [f"{x} {x}y {y}" for k in range(3, 12) for x, y in [doubled(k), doubled(k)[::-1]]]
    assert enc.encode_all(texts) == enc.whole(texts) == enc.encode_all(texts)


def test_a_kept_chunk_counts_only_byte_for_byte(monkeypatch):
    """All chunks have one hash: each is told from the others by its bytes."""
    monkeypatch.setattr(packing, "stretch_hashes", lambda a, start, end: np.full(len(start), 5, dtype=np.uint64))
    enc = packing.Encoder(tokenizer_path())
    texts = ["one two three", "two one", "a" * 17 + " " + "a" * 16 + "b", "a" * 16 + "b " + "a" * 17, "three", "x" * 30 + " one"]
    for _ in range(2):
        assert enc.encode_all(texts) == enc.whole(texts)
        assert [enc.encode(t) for t in texts] == enc.whole(texts)


def test_sums_that_underflow_are_by_logarithms():
    vocab = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    p = rng.random((vocab.size, 2))
    p[:, 0] /= p[:, 0].sum()
    p[:, 1] /= p[:, 1].sum()
    p[vocab.unknown] = 1e-9
    model = langid.Model(tokenizer_path("piece_bpe_32k.model"), ["a", "b"], p)
    strange = ("①" * 40).encode()
    got = langid.word_scores(model, [strange, b"water", strange * 3])
    assert np.isfinite(got).all() and got[0, 0] == pytest.approx(40 * np.log(1e-9) + np.log(p[vocab.pieces["▁"], 0]), rel=0.05)
    label, score = langid.identify(model, [("①" * 40 + " water " * 30 + "é")])
    assert np.isfinite(score[0]) and label[0] in "ab"


def test_learning_with_long_unknown_words_is_finite():
    from collections import Counter

    counts = Counter({("①" * 39).encode(): 3, b"water": 5_000_000, b"light": 4_000_000, ("②" * 200).encode(): 1})
    p = langid.learn(counts, langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    assert np.isfinite(p).all() and p.sum() == pytest.approx(1) and (p > 0).all()


def test_every_language_is_learned(spark):
    """More languages than any fixed number that once was; each has words of its own, one has no word at all."""
    rng = np.random.default_rng(3)
    own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(600)]
    rows = [(3 * k + j + 10_000 * j, f"{own[k]} " * 12, f"l{k:03d}") for k in range(600) for j in range(3)] + [(99, "123 456", "none")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), tokenizer_path("piece_bpe_32k.model"))
    assert model.languages == sorted({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}) and len(model.languages) > 500
    known = [k for k in range(600) if f"l{k:03d}" in model.languages][:: 40]
    labels, scores = langid.identify(model, [f"{own[k]} " * 5 for k in known])
    assert labels == [f"l{k:03d}" for k in known] and np.isfinite(scores).all()
