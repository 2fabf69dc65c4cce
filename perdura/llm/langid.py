"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities of the pieces of one fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the forward
algorithm; the probabilities are learned by expectation-maximisation, with the forward
and backward sums over the words of a bounded sample of documents per language. Words
of any length are summed whole; those whose probability could be too small for a
number are summed by logarithms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import crc_mod, map_rows, to_arrow

#: Documents that a language is learned from: about so many, chosen by id hash.
DOCS_PER_LANGUAGE = 400
EM_ROUNDS, PRIOR = 4, 0.05
#: Sums that could be smaller than this are by logarithms.
SMALLEST = 1e-280
#: Sums that are held at once: words by positions by languages.
CELLS = 4_000_000
#: Words, and scores, that a Python worker keeps at most; the table is emptied when full.
CACHE_WORDS, CACHE_SCORES = 300_000, 12_000_000
#: Bytes that part words: ASCII but letters. What is not ASCII stays.
TO_SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(TO_SPACE).split()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Vocabulary:
    """Pieces of a sentencepiece model by text, their prefixes, and one number for unknown characters."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.unknown = sp.get_piece_size()
        self.size = self.unknown + 1
        self.longest = max(map(len, self.pieces))
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p))}

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (word, start, end, piece) of all words, and the words' lengths; each begins with a word mark."""
        word, start, end, piece = [], [], [], []
        lengths = np.empty(len(words), dtype=np.int64)
        pieces, prefixes, unknown = self.pieces, self.prefixes, self.unknown
        for w, text in enumerate(words):
            n = lengths[w] = len(text)
            n = int(n)
            for i in range(n):
                single = True
                for j in range(i + 1, n + 1):
                    s = text[i:j]
                    p = pieces.get(s)
                    if p is not None:
                        word.append(w)
                        start.append(i)
                        end.append(j)
                        piece.append(p)
                        single = single and j > i + 1
                    if s not in prefixes:
                        break
                if single:
                    word.append(w)
                    start.append(i)
                    end.append(i + 1)
                    piece.append(unknown)
        return (*(np.array(x, dtype=np.int64) for x in (word, start, end, piece)), lengths)


def sums(edges: tuple, p: np.ndarray, back: bool, logs: bool) -> np.ndarray:
    """Sums over segmentations: alpha[word, position, language] of what is before a position (with back, beta of what
    is after it), for p[piece, language]; with logs, p and the sums are logarithms."""
    word, start, end, piece, lengths = edges
    width = int(lengths.max(initial=0)) + 1
    out = np.full((len(lengths), width, p.shape[1]), -np.inf if logs else 0.0)
    out[np.arange(len(lengths)), lengths if back else 0] = 0 if logs else 1
    from_, to = (end, start) if back else (start, end)
    order = np.lexsort((word, to))
    at = np.searchsorted(to[order], np.arange(width + 1))
    for e in range(width - 2, -1, -1) if back else range(1, width):
        k = order[at[e] : at[e + 1]]
        if len(k):
            first = np.flatnonzero(np.diff(word[k], prepend=-1))
            if logs:
                out[word[k][first], e] = np.logaddexp.reduceat(out[word[k], from_[k]] + p[piece[k]], first, axis=0)
            else:
                out[word[k][first], e] = np.add.reduceat(out[word[k], from_[k]] * p[piece[k]], first, axis=0)
    return out


def log_totals(edges: tuple, p: np.ndarray, logs: bool) -> np.ndarray:
    """Log probabilities, words by languages."""
    lengths = edges[4]
    total = sums(edges, p, False, logs)[np.arange(len(lengths)), lengths]
    return total if logs else np.log(total)


def expected(edges: tuple, p: np.ndarray, logs: bool) -> np.ndarray:
    """Each edge's share of its word's segmentations, for p[piece, 1]."""
    word, start, end, piece, lengths = edges
    alpha, beta = sums(edges, p, False, logs), sums(edges, p, True, logs)
    total = alpha[np.arange(len(lengths)), lengths, 0][word]
    if logs:
        return np.exp(alpha[word, start, 0] + p[piece, 0] + beta[word, end, 0] - total)
    return alpha[word, start, 0] * p[piece, 0] * beta[word, end, 0] / total


def longest(least: float) -> int:
    """Characters of the longest words whose sums are at least SMALLEST, whatever their pieces, if each has a probability of at least least."""
    return int(np.log(SMALLEST) / np.log(min(least, 0.5)))


def grouped(words: list[str], languages: int, short: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Numbers of words whose sums are held at once, and whether by logarithms (longer than short); words of like lengths together."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    cut = int(np.searchsorted(lengths[order], short, side="right"))
    for part, logs in ((order[:cut], False), (order[cut:], True)):
        a = 0
        while a < len(part):
            # As many as fit by the length of the last one.
            n = (lengths[part[a:]] + 1) * languages * np.arange(1, len(part) - a + 1)
            b = a + max(1, int(np.searchsorted(n, CELLS, side="right")))
            yield part[a:b], logs
            a = b


def marked(word: bytes) -> str:
    return "▁" + word.decode("utf-8", "replace")


def learn(counts: Counter, vocabulary: Vocabulary) -> np.ndarray:
    """Piece probabilities from a language's word counts, by expectation-maximisation."""
    pairs = sorted(counts.items())
    names = [marked(w) for w, _ in pairs]
    n = np.array([c for _, c in pairs], dtype=float)
    # Neither the first weights nor the expected pieces of a round add up to more: at each place, a piece of each length.
    most = sum(m * len(w) * k * (k + 1) * (2 * k + 1) / 6 for w, m in zip(names, n.tolist(), strict=True) for k in (min(len(w), vocabulary.longest),))
    short = longest(PRIOR / (most + PRIOR * vocabulary.size))
    parts = [(vocabulary.lattice([names[i] for i in some]), n[some], logs) for some, logs in grouped(names, 1, short)]
    found = np.zeros(vocabulary.size)
    for (word, start, end, piece, _), m, _ in parts:
        found += np.bincount(piece, m[word] * (end - start) ** 2, vocabulary.size)  # longer pieces are likelier to begin with
    for _ in range(EM_ROUNDS):
        p = ((found + PRIOR) / (found.sum() + PRIOR * vocabulary.size))[:, None]
        found = np.zeros(vocabulary.size)
        for edges, m, logs in parts:
            found += np.bincount(edges[3], m[edges[0]] * expected(edges, np.log(p) if logs else p, logs), vocabulary.size)
    return (found + PRIOR) / (found.sum() + PRIOR * vocabulary.size)


@dataclass
class Model:
    path: str
    languages: list[str]
    p: np.ndarray  # pieces by languages


VOCABULARIES: dict[str, Vocabulary] = {}
#: Scores of words by model, kept in a Python worker between batches and tasks.
SCORES: dict[int, tuple[dict[bytes, int], np.ndarray]] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in VOCABULARIES:
        VOCABULARIES[path] = Vocabulary(path)
    return VOCABULARIES[path]


def word_scores(model: Model, words: list[bytes]) -> np.ndarray:
    """Log probabilities, words by languages."""
    names = [marked(w) for w in words]
    out = np.zeros((len(words), len(model.languages)))
    for some, logs in grouped(names, len(model.languages), longest(float(model.p.min()))):
        out[some] = log_totals(vocabulary(model.path).lattice([names[i] for i in some]), np.log(model.p) if logs else model.p, logs)
    return out


def identify(model: Model, values: list[str | None]) -> tuple[list[str], list[float]]:
    if not model.languages:
        return ["und"] * len(values), [0.0] * len(values)
    key = hash((model.path, tuple(model.languages), model.p[:: max(1, len(model.p) // 997)].tobytes()))
    if key not in SCORES:
        SCORES.clear()
        SCORES[key] = ({}, np.empty((min(CACHE_WORDS, CACHE_SCORES // len(model.languages)) + 1, len(model.languages))))
    at, scores = SCORES[key]
    most = len(scores) - 1
    labels, best = [], []
    step = 500
    for a in range(0, len(values), step):
        docs = [words_of(t or "") for t in values[a : a + step]]
        new = list({w for d in docs for w in d if w not in at})
        if len(at) + len(new) > most:
            at.clear()
            new = list({w for d in docs for w in d})
        over = None
        if len(new) > most:  # very many different words at once: a table for these documents alone
            over = ({w: i for i, w in enumerate(new)}, word_scores(model, new))
        elif new:
            scores[len(at) : len(at) + len(new)] = word_scores(model, new)
            at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
        where, table = over or (at, scores)
        for t, d in zip(values[a : a + step], docs, strict=True):
            if not t or not has_letter(t):
                labels.append("und")
                best.append(0.0)
                continue
            total = table[[where[w] for w in d]].sum(axis=0) if d else np.zeros(len(model.languages))
            k = int(total.argmax())
            labels.append(model.languages[k])
            best.append(float(1 / np.exp(np.maximum(total - total[k], -700)).sum()))
    return labels, best


def train(docs: DataFrame, path: str, folds: int = 3, held: int = 1, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learns from about per_language documents for each language outside the held-out fold.

    Rows with a null text or lang are left out. Every value of lang is learned, each in a
    task of its own from the word counts of its chosen documents; only the piece
    probabilities (256 KB a language) reach the driver. Repeated rows are chosen together.
    """
    usable = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(crc_mod(F.col("doc_id"), folds) != held)
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    share = F.least(F.lit(1.0), F.lit(per_language) / F.col("size")) * (1 << 30)
    some = usable.join(F.broadcast(sizes), "lang")  # a row for each language, far less than the model
    chosen = some.filter(F.shiftrightunsigned(F.xxhash64(F.lit("lang"), F.col("doc_id")), 34) < share).select("lang", "text")

    def batch(b: pa.RecordBatch) -> dict:
        counts: Counter = Counter()
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(t)
            counts.update((lang, w) for w in words)
            counts[lang, b""] += not words  # a language without a word is learned too
        return {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}

    counted = map_rows(chosen, "lang string, word binary, n long", batch).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    schema = "lang string, p array<double>"
    target = to_arrow(docs.sparkSession, schema)

    def one(group: pa.Table) -> pa.Table:
        counts = Counter(dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True)))
        counts.pop(b"", None)
        return pa.table({"lang": group.column("lang").slice(0, 1), "p": pa.array([learn(counts, vocabulary(path))], type=target.field("p").type)}, schema=target)

    got = counted.groupBy("lang").applyInArrow(one, schema).toArrow()
    learned = dict(zip(got.column("lang").to_pylist(), got.column("p").to_pylist(), strict=True))
    languages = sorted(learned)
    return Model(path, languages, np.stack([np.array(learned[k]) for k in languages], axis=1) if languages else np.zeros((0, 0)))


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, the posterior share of that language. Narrow: no shuffle.

    A text that is null or has no letter is 'und' with score 0, as are all texts if no
    language was learned. Of languages alike, the first by name is given. Columns named
    lang_pred or score are replaced; other columns and repeated rows stay.
    """
    kept = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> dict:
        labels, best = identify(shared.value, b.column("text").to_pylist())
        return {n: b.column(n) for n in b.schema.names} | {"lang_pred": labels, "score": best}

    return map_rows(kept, schema, batch)
