"""Likeness of fingerprints for texts of all kinds and lengths, from pieces of paragraphs."""

import numpy as np
import pytest

from perdura.llm import fingerprint as f


def letters(seed, n, first=97, last=123):
    return "".join(map(chr, np.random.default_rng(seed).integers(first, last, n)))


def make(kind, seed, n):
    """A text of about n characters."""
    rng = np.random.default_rng([seed, n])
    if kind == "cjk":
        return letters([seed, 1], n, 0x4E00, 0x9000)
    word = lambda k: letters([seed, k, 7], int(rng.integers(2, 10)))
    words = [word(k) for k in range(n // 6 + 2)]
    if kind == "one line":
        return " ".join(words)[:n]
    if kind == "list":
        return "\n".join(f"- {a} {b}" for a, b in zip(words[::2], words[1::2], strict=False))[:n]
    if kind == "questions":
        return "? ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8))[:n]
    return "".join(w + (". " if k % 9 == 8 else ".\n" if k % 50 == 49 else " ") for k, w in enumerate(words))[:n]


@pytest.mark.parametrize("kind", ["prose", "one line", "list", "questions", "cjk"])
@pytest.mark.parametrize("n", [200, 1000, 10_000, 100_000])
def test_half_kept_and_disjoint_texts(kind, n):
    scores, apart = [], []
    for seed in range(6 if n < 100_000 else 2):
        a, b = make(kind, 2 * seed, n), make(kind, 2 * seed + 1, n)
        mine = f.Multiset(a)
        scores.append(mine.likeness(f.Multiset(f.edited(a, b))))
        apart.append(mine.likeness(f.Multiset(b)))
    assert 0.3 < min(scores) and max(scores) < 0.7 and 0.4 < np.mean(scores) < 0.6, scores
    assert max(apart) < 0.12 and np.mean(apart) < 0.1


def test_a_small_change_stays_small():
    for text in ("? ".join(f"What is the answer to number {i}" for i in range(200)), "。".join(letters(i, 20, 0x4E00, 0x9000) for i in range(200)), letters(3, 5000)):
        assert f.Multiset(text).likeness(f.Multiset(text[:-50])) > 0.9
        assert f.Multiset(text).likeness(f.Multiset("x" + text)) > 0.9
        assert f.Multiset(text).likeness(f.Multiset(text + " a few more words")) > 0.9


def test_repeated_words_count_as_often_as_they_stand_there():
    text = "Wherever. " * 400
    half = text[: len(text) // 2]
    other = half + letters(5, len(text) - len(half))
    assert 0.35 < f.Multiset(text).likeness(f.Multiset(other)) < 0.65
    assert f.Multiset("a" * 1000).likeness(f.Multiset("a" * 1000 + "b")) > 0.8


def test_pieces_cover_a_paragraph_and_depend_on_it_alone(monkeypatch):
    seen = []
    monkeypatch.setattr(f, "stretch_hashes", lambda a, start, end: seen.append([bytes(a[s:e]) for s, e in zip(start, end, strict=True)]) or np.arange(len(start), dtype=np.uint64))
    parts = [b"x", letters(1, 300).encode(), b"ab" * 200, "é€𝄞".encode() * 40, b"a" * 64, b"\x00\xff" * 9]
    f.pieces(parts)
    whole = seen.pop()
    assert b"".join(whole) == b"".join(parts) and all(0 < len(p) <= f.MOST for p in whole)
    for p in parts:
        f.pieces([p])
        alone = seen.pop()
        assert b"".join(alone) == p and all(x in whole for x in alone)
    assert 12 < 300 / sum(x in letters(1, 300).encode() and len(x) > 1 for x in whole) < 25


def test_many_texts_at_once_equal_one_by_one(monkeypatch):
    texts = ["", "\n\n", "a", make("prose", 1, 3000), "", make("cjk", 2, 500), "x\ny\nx", make("list", 3, 900), "same same\nsame same"]
    one = [f.Multiset(t).digest() for t in texts]
    for size in (1, 1500, 1 << 20):
        monkeypatch.setattr(f, "GROUP_BYTES", size)
        assert [m.digest() for m in f.Multiset.each(texts)] == one
    m = f.Multiset(texts[3]).add(f.paragraphs(texts[5])).add(f.paragraphs(texts[3]), sign=-1)
    assert m.digest() == one[5] and f.Multiset("y\nx\nx").digest() == one[6]
