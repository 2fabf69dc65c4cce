"""Language-model scoring: word statistics of the whole corpus, and a gated recurrent model over them.

Every training text is counted, by Spark, into one table of words. From it come the base
score (smoothed unigrams), the recurrent model's words and its first biases, and what share each
word beyond them has of the model's unknown word: by its count, with the share of words seen only
once set aside for all words that training texts don't have. So both scores are probabilities over
the same events, the words of training texts and one for any other word. Words of the table that are frequent go to the tasks, in a bounded
number of rows and bytes; rarer ones are found by a join, one row per text and word.

The recurrent weights are first fitted on about WARM_TOKENS tokens, so that all tasks begin from
the same point; then every task passes over all of its training texts, and their
weights are averaged by tokens. So every training text is learned from, the work grows with
the input and no task holds more than CHUNK tokens and one text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm import recurrent
from perdura.llm.common import crc_mod, record_batch, small_batches, stored, to_arrow

#: The end of a text as a token; white space, so no word.
END = b"\n"
#: Words, and bytes of them, that go to every task.
TOP_WORDS, TOP_BYTES = 1 << 18, 1 << 24
#: Words, and bytes read, after which a task gives its counts.
COUNTED_WORDS, COUNTED_BYTES = 300_000, 1 << 27
#: Tokens of the first fit, and those that a task trains on, or scores, at once.
WARM_TOKENS, CHUNK = 1_000_000, 4_000_000
WARM_LANES, WARM_RATE, RATE = 128, 0.01, 0.003
STEPS_PER_DOUBLING = 4


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()  # of ASCII alone: A-Z lower-cased, cut at ASCII white space


def count_words(training: DataFrame) -> DataFrame:
    """word (binary) and c of all training texts; END counts the texts."""
    schema = "word binary, c long"
    target = to_arrow(training.sparkSession, schema)
    small_batches(training.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, read = Counter(), 0
        for b in batches:
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                found.update(words_of(raw))
                read += len(raw or b"")
                if len(found) > COUNTED_WORDS or read > COUNTED_BYTES:
                    yield record_batch({"word": list(found), "c": list(found.values())}, target)
                    found, read = Counter(), 0
            found[END] += b.num_rows
        if found:
            yield record_batch({"word": list(found), "c": list(found.values())}, target)

    return training.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The frequent words with their counts, most frequent first, and totals of the whole table."""

    words: list[bytes]
    counts: np.ndarray
    threshold: int | None  #: Words counted less are not among words; None if none are.
    total: int
    distinct: int
    texts: int
    unseen: float  #: Share of the unknown word that any word has together which training texts don't have.
    beyond: int  #: Tokens beyond the model's words.

    @property
    def modelled(self) -> list[bytes]:
        return self.words[: recurrent.SIZE - recurrent.FIRST]

    def model_counts(self) -> np.ndarray:
        out = np.zeros(recurrent.SIZE)
        own = self.counts[: recurrent.SIZE - recurrent.FIRST]
        out[recurrent.UNKNOWN], out[recurrent.END] = self.beyond, self.texts
        out[recurrent.FIRST : recurrent.FIRST + len(own)] = own
        return out

    @property
    def per_count(self) -> float:
        """Share of the unknown word that a word beyond the model's has for each time that it was counted."""
        return (1 - self.unseen) / max(1, self.beyond)

    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Place by word; by place, and last for no place: log10(c + 0.5), the model's number, log10 of the share of that number."""
        n, shown = len(self.words), len(self.modelled)
        base = np.log10(np.append(self.counts, 0) + 0.5)
        number = np.full(n + 1, recurrent.UNKNOWN, dtype=np.uint16)
        number[:shown] = np.arange(shown) + recurrent.FIRST
        beyond = np.zeros(n + 1)
        beyond[shown:] = np.log10(np.append(self.counts[shown:] * self.per_count, self.unseen))
        return dict(zip(self.words, range(n), strict=True)), base, number, beyond


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals of the whole table, by Spark; then its frequent words, at most TOP_WORDS of at most TOP_BYTES together.

    Words are taken down to a count at which both bounds still hold, found from sums by ranges of counts, so that no
    more rows than that come to the driver.
    """
    words = counts.filter(F.col("word") != F.lit(END))
    level = F.floor(F.log2("c") * STEPS_PER_DOUBLING)
    by_level = {r.level: r for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes"), F.sum("c").alias("c"), F.min("c").alias("least"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()}
    texts = (counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0]) or 0
    n = size = 0
    threshold = None
    for k in sorted(by_level, reverse=True):
        n, size = n + by_level[k].n, size + by_level[k].bytes
        if n > TOP_WORDS or size > TOP_BYTES:
            break
        threshold = by_level[k].least
    top = words.filter(F.col("c") >= threshold).select("word", "c").toArrow() if threshold is not None else None
    ranked = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda r: (-r[0], r[1])) if top else []
    once, total = sum(r.once for r in by_level.values()), sum(r.c for r in by_level.values())
    shown = ranked[: recurrent.SIZE - recurrent.FIRST]
    beyond = total - sum(c for c, _ in shown)
    once -= sum(c == 1 for c, _ in shown)
    return Lexicon([w for _, w in ranked], np.array([c for c, _ in ranked], dtype=float), threshold, total + texts, sum(r.n for r in by_level.values()) + (texts > 0), texts, (once + 0.5) / (beyond + 1), beyond)


ENCODED = "row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, beyond double, ids binary, rare array<struct<word: binary, k: int>>"


def encoded(docs: DataFrame, lex: Lexicon, held: tuple[int, int]) -> DataFrame:
    """Each text's tokens as the model's numbers, sums over its frequent words, and its other words with how often they occur."""
    folds, fold = held
    schema = ENCODED.format(kind=docs.schema["doc_id"].dataType.simpleString())
    target = to_arrow(docs.sparkSession, schema)
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (crc_mod(F.col("doc_id"), folds) == fold).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, log_base, number, log_beyond = lex.tables()
        end = np.log10(lex.texts + 0.5)
        for b in batches:
            n, known, base, beyond, ids, rare = [], [], [], [], [], []
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                words = words_of(raw)
                at = np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                missing = np.flatnonzero(at < 0).tolist()
                others = Counter([words[i] for i in missing])
                n.append(len(words) + 1)
                known.append(len(words) - len(missing) + (lex.texts > 0))
                base.append(float(log_base[at].sum()) + end)
                beyond.append(float(log_beyond[at].sum()))
                ids.append(np.append(number[at], np.uint16(recurrent.END)).tobytes())
                rare.append(others)
            sizes = np.cumsum([0] + [len(x) for x in rare])
            pairs = pa.StructArray.from_arrays([pa.array([w for x in rare for w in x], type=pa.binary()), pa.array([k for x in rare for k in x.values()], type=pa.int32())], fields=list(target.field("rare").type.value_type))
            made = {"n_tokens": n, "n_known": known, "base": base, "beyond": beyond, "ids": ids, "rare": pa.ListArray.from_arrays(pa.array(sizes, type=pa.int32()), pairs)}
            yield record_batch({k: b.column(k) for k in ("row", "doc_id", "held_out")} | made, target)

    return rows.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches joined to about CHUNK tokens, with each row's numbers."""
    held, tokens = [], 0
    for b in batches:
        held.append(b)
        tokens += b.column("ids").nbytes // 2
        if tokens >= CHUNK:
            yield _joined(held)
            held, tokens = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    b = pa.Table.from_batches(held).combine_chunks().to_batches()
    whole = b[0] if b else held[0]
    return whole, [np.frombuffer(x, dtype=np.uint16) for x in whole.column("ids").to_pylist()]


def first_fit(tokens: DataFrame, lex: Lexicon, total: int) -> np.ndarray:
    """Weights after one pass over about WARM_TOKENS tokens, of texts chosen by a hash of their row; all where there are fewer."""
    start = recurrent.initial(lex.model_counts())
    share = WARM_TOKENS / max(total, 1)
    some = tokens if share >= 1 else tokens.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)))
    schema = "w array<float>"
    target = to_arrow(tokens.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = start
        for _, docs in chunks(batches):
            w = recurrent.train(w, docs, WARM_RATE, WARM_LANES, 512)
        yield record_batch({"w": [w]}, target)

    got = some.orderBy("row").coalesce(1).select("ids").mapInArrow(run, schema).toArrow()
    return np.array(got.column("w").to_pylist()[0], dtype=np.float32) if got.num_rows else start


def fit(training: DataFrame, lex: Lexicon) -> np.ndarray:
    """Weights from all training rows (row, ids): a pass of every task over its own, from one start; averaged by tokens."""
    start = first_fit(training, lex, lex.total)
    schema = "n long, w array<float>"
    target = to_arrow(training.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs in chunks(batches):
            if docs:
                yield record_batch({"n": [sum(map(len, docs))], "w": [recurrent.train(start, docs, RATE)]}, target)

    parts = training.select("ids").mapInArrow(run, schema).select("n", F.posexplode("w").alias("at", "w"))
    mean = parts.groupBy("at").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).toArrow()
    out = start.copy()
    out[mean.column("at").to_numpy()] = mean.column("w").to_numpy()
    return out


def score_texts(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Columns beyond doc_id and text are ignored. A null text is an empty one: its one token is the end. Repeated
    rows count, and are scored, each. A null doc_id has the hash of ''. Without training texts N and V are 0. Texts
    of any length are scored whole. Both scores are log10; score is the recurrent model's, a word beyond its words
    being the unknown word times the word's share of it.
    """
    training = docs.filter(crc_mod(F.col("doc_id"), folds) != held)
    counts = stored(count_words(training))
    lex = lexicon(counts)
    rows = stored(encoded(docs.select("doc_id", "text"), lex, (folds, held)))
    weights = fit(rows.filter("not held_out").select("row", "ids"), lex)
    scored = _recurrent_scores(rows, weights)
    found = _rare_words(rows, counts, lex)
    smoothing = float(np.log10(lex.total + 0.5 * (lex.distinct + 1)))
    sums = {c: F.coalesce(c, F.lit(0)) for c in ("more_known", "more_base", "more_beyond")}
    return scored.join(found, "row", "left").withColumns(sums).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") - F.col("n_tokens") * F.lit(smoothing)).alias("base_score"), (F.col("states") + F.col("beyond") + F.col("more_beyond")).alias("score"))


def _recurrent_scores(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """rows with states, the recurrent model's log10 probability of the numbers."""
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "beyond"]
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept) + ", states double"
    target = to_arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, docs in chunks(batches):
            yield record_batch({k: b.column(k) for k in kept} | {"states": recurrent.scores(weights, docs) / np.log(10)}, target)

    return rows.select(*kept, "ids").mapInArrow(run, schema)


def _rare_words(rows: DataFrame, counts: DataFrame, lex: Lexicon) -> DataFrame:
    """row, and what its words beyond the frequent ones add where training texts have them: how many, to the base, and to the score.

    Only words that training texts have are joined, so a word of other texts alone is never a hot key; those that
    training texts have are rare by the bounds of the frequent words.
    """
    others = counts.filter(F.col("word") != F.lit(END))
    others = others if lex.threshold is None else others.filter(F.col("c") < lex.threshold)
    more = {"more_known": F.col("k"), "more_base": F.col("k") * F.log10(2 * F.col("c") + 1), "more_beyond": F.col("k") * F.log10(F.col("c") * (lex.per_count / lex.unseen))}
    return rows.select("row", F.inline("rare")).join(others, "word").groupBy("row").agg(*(F.sum(x).alias(k) for k, x in more.items()))
