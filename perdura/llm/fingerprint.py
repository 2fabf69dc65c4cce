"""Homomorphic multiset hash of a text's paragraphs.

A text is the multiset of its paragraphs (lines that are not empty). A paragraph is
hashed to a wide vector: 128 bits for the whole of it, which are added to two totals
modulo 2**64, and a 1 or -1 in every one of LANES lanes, added modulo 2**32. The sum does
not depend on the order of paragraphs, and paragraphs can be added or taken out one by
one. Totals and count decide equality.

A paragraph's lanes are those of its pieces, so that a long one changed in part stays
alike in part: it is cut where the hash of the last few bytes is the least within REACH
bytes to either side, so places depend on what stands there alone, in any script, with or
without sentences. A piece has REACH to MOST bytes; a shorter paragraph is one.

Lanes tell how alike two texts are, at any length: for lanes A and B, A.B estimates the
scalar product of the texts' vectors of piece counts, and likeness is their Dice
coefficient 2 A.B / (A.A + B.B). Without repeated pieces that is twice the number of
common pieces over the number of all; a repeated one weighs by the squares of its
counts. It is exact for equal texts; the standard error is at most 1 / sqrt(LANES),
about 0.03, whatever the texts' lengths.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import record_batch, small_batches, to_arrow
from perdura.llm.words import GROUP_BYTES, grouped, mixed, stretch_hashes

LANES = 1024
MASK = (1 << 64) - 1
#: A piece ends where a hash is the least of so many to either side; longer pieces are cut.
REACH, MOST, CONTEXT = 6, 64, 4
#: Between paragraphs, so that none sees bytes of another.
GAP = b"\n" * (REACH + CONTEXT)
#: Pieces whose lanes are held at once.
HELD = 4096


def paragraphs(text: str) -> list[bytes]:
    """The lines; empty ones carry nothing."""
    return [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p]


def pieces(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces of paragraphs, and each one's paragraph. The second, third, ... of equal pieces of a paragraph have their own hashes."""
    a = np.frombuffer(GAP + GAP.join(parts) + GAP, dtype=np.uint8)
    inside = np.flatnonzero(a != 10)
    if not len(inside):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    back = np.zeros(len(a), dtype=np.uint32)
    for k in range(CONTEXT):
        back[k:] |= a[: len(a) - k].astype(np.uint32) << np.uint32(8 * k)
    h = (back * np.uint32(2654435761)) ^ (back >> np.uint32(15))
    h *= np.uint32(2246822519)
    h[a == 10] = 0  # no cut within REACH of a paragraph's ends
    # The least of what follows within REACH, and of what is before; of equal ones the first counts.
    later = least_of(h[1:], REACH)
    before = least_of(h, REACH)
    at = np.arange(REACH, len(a) - REACH)
    cut = np.zeros(len(a) + 1, dtype=bool)
    cut[at + 1] = (h[at] <= later[at]) & (h[at] < before[at - REACH])
    edge = np.diff((a != 10).astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero((edge == 1) | (cut & np.append(a != 10, False)))
    end = np.append(start[1:], len(a))
    last = np.flatnonzero(edge == -1)
    owner = np.searchsorted(last, start, side="right")
    end = np.minimum(end, last[owner])
    many = -(-(end - start) // MOST)
    if many.max() > 1:
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        end = np.repeat(end, many)
        start = np.repeat(start, many) + nth * MOST
        end, owner = np.minimum(end, start + MOST), np.repeat(owner, many)
    out = stretch_hashes(a, start, end)
    order = np.lexsort((np.arange(len(out)), out, owner))
    new = np.flatnonzero((np.diff(out[order].view(np.int64), prepend=0) != 0) | (np.diff(owner[order], prepend=-1) != 0))
    nth = np.arange(len(out)) - np.repeat(new, np.diff(new, append=len(out)))
    out[order] += nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out, owner


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    k = 1
    while 2 * k <= n:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - n + k], h[n - k :])


def lanes_of(hashes: np.ndarray) -> np.ndarray:
    """The sum of the pieces' lanes."""
    total = np.zeros(LANES, dtype=np.int64)
    salt = np.arange(1, LANES // 64 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for a in range(0, len(hashes), HELD):
        bits = np.unpackbits(mixed(hashes[a : a + HELD, None] ^ salt).view(np.uint8), axis=1)
        for b in range(0, len(bits), 255):
            total += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return 2 * total - len(hashes)


class Multiset:
    """The vector: two totals, the counts of paragraphs and of pieces, and the lanes."""

    def __init__(self, text: str = ""):
        self.totals, self.count, self.pieces = [0, 0], 0, 0
        self.lanes = np.zeros(LANES, dtype=np.int32)
        if text:
            self.add(paragraphs(text))

    def add(self, some: Iterable[bytes], sign: int = 1) -> Multiset:
        """Adds paragraphs, in place; sign -1 takes them out."""
        parts = list(some)
        return self.put(parts, pieces(parts)[0], sign)

    def put(self, parts: list[bytes], found: np.ndarray, sign: int = 1) -> Multiset:
        """The same with the paragraphs' pieces at hand."""
        for p in parts:
            h = int.from_bytes(hashlib.blake2b(p, digest_size=16).digest(), "little")
            self.totals = [(self.totals[0] + sign * (h & MASK)) & MASK, (self.totals[1] + sign * (h >> 64)) & MASK]
        self.count += sign * len(parts)
        self.pieces += sign * len(found)
        self.lanes += (sign * lanes_of(found)).astype(np.int32)
        return self

    @classmethod
    def each(cls, texts: Iterable[str]) -> Iterator[Multiset]:
        """Of every text; the pieces of many texts are found at once."""
        for group in grouped(texts, GROUP_BYTES):
            parts = [paragraphs(t) for t in group]
            counts = np.cumsum([len(x) for x in parts])
            found, owner = pieces([p for x in parts for p in x])
            for x, h in zip(parts, np.split(found, np.searchsorted(owner, counts[:-1])), strict=True):
                yield cls().put(x, h)

    def equals(self, other: Multiset) -> bool:
        return self.count == other.count and self.totals == other.totals

    def likeness(self, other: Multiset) -> float:
        """From 0 to 1; 1 if equal, also for two empty texts."""
        if self.equals(other):
            return 1.0
        a, b = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        return float(min(1.0, max(0.0, 2 * (a @ b) / max(1.0, a @ a + b @ b))))

    def digest(self) -> str:
        """Lanes are no greater than the number of pieces, which tells how many bytes each needs."""
        width = "<i1" if self.pieces < 1 << 7 else "<i2" if self.pieces < 1 << 15 else "<i4"
        head = np.array([*self.totals, self.count, self.pieces], dtype="<u8").tobytes()
        return base64.b64encode(head + self.lanes.astype(width).tobytes()).decode()

    @classmethod
    def parse(cls, fingerprint: str) -> Multiset:
        data = base64.b64decode(fingerprint)
        out = cls()
        *out.totals, out.count, out.pieces = np.frombuffer(data[:32], dtype="<u8").tolist()
        out.lanes = np.frombuffer(data[32:], dtype=f"<i{(len(data) - 32) // LANES}").astype(np.int32)
        return out


def edited(text: str, following: str) -> str:
    """The last half of text replaced by as much of the start of the following text, or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a fingerprint column (replaced if there); a null text counts as empty. Narrow: no shuffle."""
    out = docs.drop("fingerprint")
    names = out.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", fingerprint string"
    target = to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [m.digest() for m in Multiset.each(t or "" for t in b.column(text).to_pylist())]
            yield record_batch({**{n: b.column(n) for n in names}, "fingerprint": prints}, target)

    return out.mapInArrow(run, schema)


PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LEAST = -(1 << 63)
#: Bytes of texts in one part, about.
PART_BYTES = 1 << 29


def with_next(docs: DataFrame, n_parts: int) -> DataFrame:
    """Rows by _part and in order inside it, each part ended by a copy (_halo 1) of the row that comes next.

    Parts are ranges of doc_id, so every text is shuffled once and its neighbour is in
    the same task. Only the parts' first ids, at most n_parts, reach the driver.
    """
    rows = docs.select("doc_id", "text").withColumn("_id", F.coalesce("doc_id", F.lit(LEAST)))
    at = [i / n_parts for i in range(1, n_parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("_id", at or [0.5], max(10_000, 10 * n_parts))).first()[0] or [])) if at else []
    coarse, step = bounds[31::32], 32
    low = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in coarse]), lambda b: b <= F.col("_id"))) if coarse else F.lit(0)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups]) if groups else None
    in_group = F.coalesce(F.size(F.filter(F.get(fine, low), lambda b: b <= F.col("_id"))), F.lit(0)) if groups else F.lit(0)
    if groups:
        # get() past the end is null, whose size is -1 or null: such ids follow the last bound.
        in_group = F.greatest(in_group, F.lit(0))
    part = (low * step + in_group).cast("int")
    firsts = {r[0]: r[1] for r in rows.select("_id").withColumn("_part", part).groupBy("_part").agg(F.min("_id")).collect()}
    order = sorted(firsts)
    before = {q: order[i - 1] for i, q in enumerate(order)}
    size = (order[-1] + 1) if order else 1
    first = F.array(*[F.lit(firsts.get(q)).cast("long") for q in range(size)])
    prev = F.array(*[F.lit(before.get(q, 0)).cast("int") for q in range(size)])
    own = F.struct(F.col("_at").alias("part"), F.lit(0).alias("halo"))
    copy = F.struct(F.get(prev, F.col("_at")).alias("part"), F.lit(1).alias("halo"))
    both = rows.withColumn("_at", part).withColumn("_to", F.explode(F.when(F.col("_id") == F.get(first, F.col("_at")), F.array(own, copy)).otherwise(F.array(own))))
    dealt = both.select("doc_id", "text", "_id", F.col("_to.part").alias("_part"), F.col("_to.halo").alias("_halo"))
    return dealt.repartitionById(max(1, size), "_part").sortWithinPartitions("_part", "_halo", "_id", "text")


def edit_fingerprints(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    A null text is empty; a null doc_id comes first. Rows of one doc_id follow each
    other in order of text. The last row is followed by the first, so a single row by
    itself. Extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = n_parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    target = to_arrow(spark, PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (id, text, multiset) that waits for its next row
        for b in batches:
            rows, two = [], []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, t, halo, now in zip(b.column("doc_id").to_pylist(), texts, b.column("_halo").to_pylist(), Multiset.each(texts), strict=True):
                if last is None and halo:
                    continue  # a second copy of rows with one id
                if last is not None:
                    rows.append((*last, edited(last[1], t)))
                    two.append(now)
                last = None if halo else (i, t, now)
            if rows:
                others = Multiset.each(r[3] for r in rows)
                out = [(own, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mine.digest(), other.digest(), mine.likeness(other), mine.likeness(now)) for (own, text, mine, new), other, now in zip(rows, others, two, strict=True)]
                yield record_batch(dict(zip(target.names, zip(*out, strict=True), strict=True)), target)

    small_batches(spark)
    return with_next(docs, n).mapInArrow(run, PAIR)
