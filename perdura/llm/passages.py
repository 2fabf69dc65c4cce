"""Removal of repeated passages by sharded automata of confirmed phrases.

Every window of SIZE words has an anchor: the K-word run of the smallest hash in it.
Neighbouring windows share anchors, so a text has few anchor spans, and texts with a
common window have its anchor in common. From anchors found in two documents follow
the spans, and for anchors with unlike spans the windows, that recur, each with the first
document that holds it. That confirms phrases: stretches of a document, its owner,
whose windows all start in later documents too. Their words are read from the owner.

Phrases are dealt to shards by owner, of about SHARD_WORDS words each. A shard's
automaton holds its phrases' blocks of BLOCK words, one at each BLOCK-th word, with the
words around them; every window in a phrase has a block in it. All documents with a
span that recurs are streamed through the automata of the shards that hold such spans
(all others hold no window of any phrase). Where a block is found, its surroundings
tell which windows match. These hits, and nothing else, say what is removed.

A shard that many documents go to is copied to several tasks, each with some of the
documents; keys of joins with very many rows are joined by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import join_by_key, map_rows, record_batch, stored, to_arrow
from perdura.llm.graphs import chosen_rows, hash_bits, id_bits, may_hold
from perdura.llm.words import Runs, all_word_hashes, mixed

SIZE, K, BLOCK = 50, 10, 25
#: Words of a shard's phrases, and documents that one task streams through a shard.
SHARD_WORDS, SHARD_DOCS = 400_000, 2_000
#: Bits (as a power of two) of the filters of anchors and of spans: 8 MB each.
ANCHOR_BITS = 26


def spans(runs: Runs, n: int, size: int = SIZE, k: int = K) -> tuple[np.ndarray, ...]:
    """(anchor hash, span hash, first window, windows) of the runs of windows with one anchor, for n words."""
    if n < size:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    g = runs.of(np.arange(n - k + 1), k)
    width = size - k + 1
    at = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(n - size + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=len(at))
    return g[at[first]], runs.of(first, count + size - 1), first, count


def read_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(doc_ids: list, values: list[str | None]) -> Iterator[tuple[int, np.ndarray, Runs]]:
    """Each text's id, its words' hashes and its runs."""
    words = list(all_word_hashes((t or "").encode("utf-8", "surrogatepass") for t in values))
    return zip(doc_ids, words, Runs.each(words), strict=True)


def span_key(ids: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One key for all places of a span (by its hash) in a document."""
    return mixed(mixed(ids.astype(np.int64).view(np.uint64)) + s.view(np.uint64), 3)


SPANS = "h long, s long, doc_id long, start long, n long"


def all_spans(docs: DataFrame) -> DataFrame:
    """The anchor spans of every document."""

    def batch(b: pa.RecordBatch) -> dict:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
        for i, words, runs in hashed(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if len(words) >= SIZE:
                h, s, first, n = spans(runs, len(words))
                for x, y in zip(out, (h.view(np.int64), s.view(np.int64), np.full(len(h), i), first, n), strict=True):
                    x.append(y)
        return dict(zip(("h", "s", "doc_id", "start", "n"), map(np.concatenate, out), strict=True))

    return map_rows(docs, SPANS, batch)


def shared_spans(found: DataFrame, bits: np.ndarray) -> DataFrame:
    """The spans whose anchor passes the filter."""
    shared = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(shared.value, b.column("h").to_numpy())))

    return found.mapInArrow(run, SPANS)


def windows(docs: DataFrame, ids: np.ndarray, bits: np.ndarray) -> DataFrame:
    """h, s, w (hash), doc_id and start of every window of the spans that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def batch(doc_ids: list, values: list[str]) -> dict:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
        for i, words, runs in hashed(doc_ids, values):
            if len(words) >= SIZE:
                h, s, first, n = spans(runs, len(words))
                keep = may_hold(shared.value, span_key(np.full(len(h), i), s))
                h, s, first, n = h[keep], s[keep], first[keep], n[keep]
                start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for x, y in zip(out, (np.repeat(h, n).view(np.int64), np.repeat(s, n).view(np.int64), runs.of(start, SIZE).view(np.int64), np.full(len(start), i), start), strict=True):
                    x.append(y)
        return dict(zip(("h", "s", "w", "doc_id", "start"), map(np.concatenate, out), strict=True))

    return chosen_rows(docs, ids, "h long, s long, w long, doc_id long, start long", batch)


def firsts(rows: DataFrame, *keys: str) -> DataFrame:
    """For every key, owner and owner_start (its first document and place there), last (its last document) and k (its rows)."""
    got = rows.groupBy(*keys).agg(F.min(F.struct("doc_id", "start")).alias("x"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("k"))
    return got.select(*keys, F.col("x.doc_id").alias("owner"), F.col("x.start").alias("owner_start"), "last", "k")


def confirmed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The spans that may recur; the stretches (owner, start, end) whose windows recur; the owners (h, s, owner) for each span.

    Spans with one anchor but unlike are compared window by window, each in its first
    document only: a window that recurs in a later document of an equal span is found
    with that span.
    """
    found = stored(all_spans(docs))
    seen = found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    found = stored(shared_spans(found, hash_bits(seen, "h", ANCHOR_BITS)))

    by_span = stored(found.groupBy("h", "s").agg(F.min(F.struct("doc_id", "start")).alias("x"), F.max("doc_id").alias("last"), F.min("n").alias("n")).select("h", "s", F.col("x.doc_id").alias("owner"), F.col("x.start").alias("start"), "last", "n"))
    whole = by_span.filter("owner < last")
    anchors = by_span.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("owner").alias("a"), F.max("owner").alias("b"))
    unlike = stored(anchors.filter("k > 1 and a < b").select("h", "k"))
    chosen = stored(join_by_key(by_span.select("h", "s", F.col("owner").alias("doc_id")), unlike, ["h"]).select("doc_id", "s"))
    span_hashes = map_rows(chosen, "h long", lambda b: {"h": span_key(b.column("doc_id").to_numpy(), b.column("s").to_numpy()).view(np.int64)})
    each = stored(windows(docs, id_bits(chosen, "doc_id"), hash_bits(span_hashes, "h", ANCHOR_BITS)))
    by_window = stored(firsts(each, "h", "w").filter("owner < last"))
    single = join_by_key(each.select("h", "w", "s", "doc_id"), by_window.select("h", "w", "owner", "k"), ["h", "w"]).filter("owner < doc_id").select("h", "s", "owner")

    stretches = whole.select("owner", "start", (F.col("start") + F.col("n") + SIZE - 1).alias("end"))
    stretches = stretches.unionByName(by_window.select("owner", F.col("owner_start").alias("start"), (F.col("owner_start") + SIZE).alias("end")))
    return found, stretches, stored(whole.select("h", "s", "owner").unionByName(single).distinct())


def phrases(stretches: DataFrame, docs: DataFrame) -> DataFrame:
    """owner, phrase (its words) and n (their number) for the stretches of each owner that overlap or meet as one."""
    parts = stored(stretches.groupBy("owner").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("parts")))
    texts = chosen_rows(docs, id_bits(parts, "owner"), "owner long, text string", lambda i, t: {"owner": i, "text": t})
    both = parts.join(texts.dropDuplicates(["owner"]), "owner")

    def batch(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"owner": [], "phrase": [], "n": []}
        for i, some, t in zip(b.column("owner").to_pylist(), b.column("parts").to_pylist(), b.column("text").to_pylist(), strict=True):
            words, joined = read_words(t), []
            for x in some:
                # Windows at neighbouring places join; stretches that only overlap otherwise have a window between that does not recur.
                if joined and x["start"] <= joined[-1][1] - SIZE + 1:
                    joined[-1][1] = max(joined[-1][1], x["end"])
                else:
                    joined.append([x["start"], x["end"]])
            for s, e in joined:
                out["owner"].append(i)
                out["phrase"].append(b" ".join(words[s:e]))
                out["n"].append(e - s)
        return out

    return map_rows(both.select("owner", "parts", "text"), "owner long, phrase binary, n long", batch)


class Shard:
    """The automaton of the phrases' blocks. A text is a string in which every word has its own code of WIDE characters,
    one of a different alphabet at each place, so that no node of the automaton has very many branches."""

    def __init__(self) -> None:
        self.codes: dict[bytes, str] = {}
        #: By block: the words before and after it (up to SIZE - BLOCK each) at its places, and the first owner.
        self.places: dict[str, dict[tuple[str, str], int]] = {}
        self.automaton = None

    def add_phrase(self, owner: int, phrase: bytes) -> None:
        codes, words = self.codes, phrase.split(b" ")
        for w in words:
            if w not in codes:
                codes[w] = code(len(codes) + 1)
        line = "".join(map(codes.__getitem__, words))
        block, room = WIDE * BLOCK, WIDE * (SIZE - BLOCK)
        for x in range(0, len(line) - block + 1, block):
            around = line[max(0, x - room) : x], line[x + block : x + block + room]
            known = self.places.setdefault(line[x : x + block], {})
            known[around] = min(owner, known.get(around, owner))

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for block, known in self.places.items():
            self.automaton.add_word(block, [(before, after, owner) for (before, after), owner in known.items()])
        self.places = {}
        self.automaton.make_automaton()

    def find(self, doc_id: int, words: list[bytes]) -> list[int]:
        """Starts and ends, in turn and in order, of the stretches of matching windows whose owner is before doc_id."""
        out: list[int] = []
        if len(words) < SIZE:
            return out
        line = "".join(map(self.codes.get, words, repeat(UNKNOWN)))
        block, room = WIDE * BLOCK, WIDE * (SIZE - BLOCK)
        for end, known in self.automaton.iter(line):
            x = end + 1 - block
            left, right = line[max(0, x - room) : x], line[x + block : x + block + room]
            for before, after, owner in known:
                if owner >= doc_id:
                    continue
                if out and out[-2] <= x - len(left) and x + block + len(right) <= out[-1]:
                    break  # all that this block could add is there
                r = common(right, after)
                m = block + common(left[::-1], before[::-1]) + r
                if m >= WIDE * SIZE:
                    e = x + block + r
                    s = e - m
                    while out and out[-2] >= s and out[-1] <= e:
                        del out[-2:]
                    if out and s <= out[-1]:
                        out[-2], out[-1] = min(s, out[-2]), max(e, out[-1])
                    else:
                        out += [s, e]
        return [x // WIDE for x in out]


WIDE, ALPHABET = 3, 74


def code(n: int) -> str:
    """The characters of word number n; the first alphabet is open, the others have ALPHABET characters."""
    return chr(0x1000 + n // ALPHABET**2) + chr(0x100 + n // ALPHABET % ALPHABET) + chr(0x200 + n % ALPHABET)


UNKNOWN = code(0)


def common(a: str, b: str) -> int:
    """How many characters two strings have in common from their start, in whole words."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(0, n, WIDE) if a[i : i + WIDE] != b[i : i + WIDE])


def kept_words(words: list[bytes], found: list[tuple[int, int]]) -> list[bytes]:
    """Words outside the sorted stretches."""
    out, at = [], 0
    for s, e in found:
        if s > at:
            out += words[at:s]
        at = max(at, e)
    return out + words[at:]


def hits(docs: DataFrame, found: DataFrame, stretches: DataFrame, owners: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text) and at (starts and ends) for each shard in which a document has matching windows."""
    spark = docs.sparkSession
    compiled = stored(phrases(stretches, docs))
    total = compiled.agg(F.sum("n")).first()[0] or 0
    shard_of = F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-total // SHARD_WORDS)))).cast("int")
    ways = owners.groupBy("h", "s", shard_of.alias("shard")).agg(F.min("owner").alias("low"))
    counts = found.groupBy("h", "s").agg(F.count(F.lit(1)).alias("k"))
    routes = join_by_key(found.select("h", "s", "doc_id"), stored(ways.join(counts, ["h", "s"])), ["h", "s"]).filter("low < doc_id")
    routes = stored(routes.select("doc_id", "shard").distinct())
    shards = stored(routes.groupBy("shard").agg(F.count(F.lit(1)).alias("k")))
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / SHARD_DOCS)).cast("int")
    placed = join_by_key(routes, shards, ["shard"]).select("doc_id", "shard", part.alias("part"))

    texts = chosen_rows(docs, id_bits(routes, "doc_id"), "doc_id long, body binary", lambda i, x: {"doc_id": i, "body": [v.encode("utf-8", "surrogatepass") for v in x]})
    lines = texts.join(placed, "doc_id").select("shard", "part", F.lit(1).alias("kind"), "doc_id", "body")
    copies = compiled.withColumn("shard", shard_of).join(shards, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("k") / SHARD_DOCS).cast("int") - 1)))
    lines = lines.unionByName(copies.select("shard", "part", F.lit(0).alias("kind"), F.col("owner").alias("doc_id"), F.col("phrase").alias("body")))
    dealt = lines.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    schema = "doc_id long, body binary, at array<long>"
    target = to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for b in batches:
            out: list[tuple] = []
            for k, p, kind, i, body in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "kind", "doc_id", "body")), strict=True):
                if (k, p) != now:
                    shard, now = Shard(), (k, p)
                if kind == 0:
                    shard.add_phrase(i, body)
                    continue
                if shard.automaton is None:
                    shard.compile()
                if at := shard.find(i, body.split()):
                    out.append((i, hashlib.blake2b(body, digest_size=16).digest(), at))
            if out:
                yield record_batch(dict(zip(target.names, zip(*out, strict=True), strict=True)), target)

    return dealt.mapInArrow(run, schema)


def applied(docs: DataFrame, schema: str, row) -> DataFrame:
    """row(doc_id, words, kept words) for every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    named = docs.filter("doc_id is not null")
    found = stored(hits(named, *confirmed(named)).groupBy("doc_id", "body").agg(F.flatten(F.collect_list("at")).alias("at")))
    bits = id_bits(found, "doc_id")
    target = to_arrow(spark, schema)
    texts = chosen_rows(docs, bits, "doc_id long, text string, body binary", lambda i, t: {"doc_id": i, "text": t, "body": [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in t]})

    def batch(b: pa.RecordBatch) -> dict:
        out = []
        for i, t, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "at")), strict=True):
            words = read_words(t)
            out.append(row(i, words, kept_words(words, sorted(zip(at[::2], at[1::2], strict=True))) if at else words))
        return dict(zip(target.names, zip(*out, strict=True), strict=True))

    changed = map_rows(texts.join(found, ["doc_id", "body"], "left").select("doc_id", "text", "at"), schema, batch)
    shared = spark.sparkContext.broadcast(bits)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Rows without an id are compared with nothing.
            b = b.filter(pa.array(~may_hold(shared.value, b.column("_hash").to_numpy()) | np.asarray(b.column("doc_id").is_null())))
            if b.num_rows:
                got = [row(i, w := read_words(t), w) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
                yield record_batch(dict(zip(target.names, zip(*got, strict=True), strict=True)), target)

    others = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_hash")).mapInArrow(rest, schema)
    return changed.unionByName(others)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and text: the kept words, joined by single spaces.

    A window is SIZE consecutive words. Words of a window that also starts in a document
    with a smaller doc_id are removed; windows are judged on the input. Null and empty
    texts have no words. Rows with a null doc_id are kept whole. Repeated rows with one
    doc_id do not count as each other's source; rows with one doc_id should have one
    text. Extra columns, whatever their names, are ignored. An empty table gives no rows.
    """
    row = lambda i, words, kept: (i, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"))
    return applied(docs, "doc_id long, n_words long, n_removed long, text string", row)


def removal_digests(docs: DataFrame) -> DataFrame:
    """As remove_repeats, with the SHA-256 of the kept text in its place."""
    row = lambda i, words, kept: (i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return applied(docs, "doc_id long, n_words long, n_removed long, kept_sha256 string", row)
