"""Near-duplicates by b-bit MinHash signatures and a multi-index Hamming join.

Signatures are SYMBOLS minima of BITS bits. Split into m chunks, two signatures that
differ in at most 2m - 3 symbols have at least two chunks with at most one error; so
keys of all chunks, each leaving out one symbol in turn, meet for every such pair.
The chunk length is the longest for which a pair at the wanted similarity exceeds that
distance with a probability of at most MISS.

Documents with equal sets are one class from the start, with one representative. The
members of a bucket (a key) are compared by signature inside a task, each pair in the
first bucket that it shares; the sets of those members that have a partner within the
distance are then compared in full inside a task, which gives links enough to connect
what is similar, never all pairs.

In buckets of more than BLOCK members most are often of one family. So each of their
members is first compared in full with one centre, that of its largest bucket; those
similar to it are linked to it, are one star, and need no comparison among themselves.
In such a bucket the members of the most frequent star meet only the others, whose
number decides how often a row is copied: a family that is one star makes no rows at all.
Blocks of BLOCK members bound a task whatever the bucket's size. Only different sets
that share a bucket and are not of its star are compared with each other one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import join_by_key, map_rows, record_batch, stored, to_arrow
from perdura.llm.graphs import chosen_rows, components, hash_bits, id_bits, may_hold
from perdura.llm.words import all_word_hashes, mixed, run_hashes

SYMBOLS, BITS, MISS = 60, 16, 1e-4
#: Members of a bucket in one block.
BLOCK = 500
#: Times that centres of families are compared with each other.
CENTRE_ROUNDS = 2
#: Bits (as a power of two) of the filter of keys: 8 MB.
KEY_BITS = 26


@dataclass(frozen=True)
class Near:
    words: int = 5
    percent: int = 80

    @cached_property
    def chunk(self) -> int:
        """Symbols in a chunk."""
        p = 1 - self.percent / 100

        def missed(r: int) -> float:
            return sum(comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(r + 1, SYMBOLS + 1))

        for n in (6, 5, 4, 3, 2):
            if missed(2 * (SYMBOLS // n) - 3) <= MISS:
                return n
        raise ValueError(f"{SYMBOLS} symbols are too few for a similarity of {self.percent} percent")

    @property
    def distance(self) -> int:
        return 2 * (SYMBOLS // self.chunk) - 3


def all_shingles(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingle hashes; of a text with fewer words, one for all its words."""
    for h in all_word_hashes(((t or "").encode("utf-8", "surrogatepass") for t in texts), lower=True):
        yield np.unique(run_hashes(h, min(k, len(h)), salt=min(k, len(h)))) if len(h) else h


RNG = np.random.default_rng(60)
FLIP = RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURN = RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of a set, BITS bits of each."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 4096):
        least = np.minimum(least, ((s[a : a + 4096] ^ FLIP[:, None]) * TURN[:, None]).min(axis=1))
    return (mixed(least) >> np.uint64(64 - BITS)).astype(np.uint16)


def first_total(s: np.ndarray) -> int | None:
    return int(mixed(s, 1).sum(dtype=np.uint64).view(np.int64)) if len(s) else None


SETS = "doc_id long, n_shingles long, set1 long, set2 long, sig binary"


def read_sets(docs: DataFrame, k: int) -> DataFrame:
    def batch(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x: [] for x in ("n_shingles", "set1", "set2", "sig")}
        for s in all_shingles(b.column("text").to_pylist(), k):
            out["n_shingles"].append(len(s))
            out["set1"].append(first_total(s))
            out["set2"].append(int(mixed(s, 2).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
            out["sig"].append(signature(s).tobytes() if len(s) else None)
        return out | {"doc_id": b.column("doc_id")}

    return map_rows(docs.select("doc_id", "text"), SETS, batch)


def chunk_keys(sigs: np.ndarray, chunk: int) -> np.ndarray:
    """Rows by chunks by left-out symbols: 64-bit keys of what is left of a chunk."""
    n, m = len(sigs), SYMBOLS // chunk
    parts = sigs[:, : m * chunk].reshape(n, m, chunk).astype(np.uint64)
    each = mixed(parts + (np.arange(chunk, dtype=np.uint64) << np.uint64(20))[None, None, :], 7)
    total = each.sum(axis=2, dtype=np.uint64)
    out = total[:, :, None] - each
    return mixed(out + (np.arange(m * chunk, dtype=np.uint64) << np.uint64(40)).reshape(1, m, chunk), 9)


def signatures(b: pa.RecordBatch, name: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), dtype=np.uint16).reshape(b.num_rows, SYMBOLS)


def keyed(reps: DataFrame, near: Near, bits: np.ndarray | None = None) -> DataFrame:
    """key and rep for every chunk and left-out symbol; with bits, only keys that pass the filter."""
    shared = None if bits is None else reps.sparkSession.sparkContext.broadcast(bits)

    def batch(b: pa.RecordBatch) -> dict:
        keys = chunk_keys(signatures(b), near.chunk).reshape(b.num_rows, -1)
        rep = np.repeat(b.column("rep").to_numpy(), keys.shape[1])
        keys = keys.view(np.int64).ravel()
        if shared is not None:
            keep = may_hold(shared.value, keys)
            keys, rep = keys[keep], rep[keep]
        return {"key": keys, "rep": rep}

    return map_rows(reps.select("rep", "sig"), "key long, rep long", batch)


GROUP = ["key", "lo", "hi"]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches in order of GROUP, with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for c in GROUP:
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return t, np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        held.append(b)
        t, at = cut(pa.Table.from_batches(held))
        if len(at) > 2:
            last = int(at[-2])
            yield t.slice(0, last).combine_chunks(), at[:-1]
            held = t.slice(last).combine_chunks().to_batches()
    if held:
        yield cut(pa.Table.from_batches(held).combine_chunks())


def pairs_within(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs inside the groups with these bounds, some at a time."""
    size = np.diff(at)
    for m in np.unique(size[size > 1]).tolist():
        start = at[:-1][size == m]
        if m <= 32:
            i, j = np.triu_indices(m, 1)
            step = max(1, 200_000 // len(i))
            for a in range(0, len(start), step):
                base = start[a : a + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            for s in start.tolist():
                for i in range(s, s + m - 1):
                    yield np.full(s + m - 1 - i, i), np.arange(i + 1, s + m)


def with_partner(rows: DataFrame, near: Near) -> DataFrame:
    """The rows (GROUP, rep, star, set1, n, sig) that have a partner of another star in their group within the signature distance.

    A pair counts in the first key only that its signatures share.
    """
    schema = "key long, lo int, hi int, rep long, set1 long"
    target = to_arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(t.num_rows, SYMBOLS)
            keys = chunk_keys(sig, near.chunk).reshape(t.num_rows, -1).view(np.int64)
            n, own, star = (t.column(c).to_numpy() for c in ("n", "key", "star"))
            found = np.zeros(t.num_rows, dtype=bool)
            for i, j in pairs_within(at):
                ok = (star[i] != star[j]) & (100 * np.minimum(n[i], n[j]) >= near.percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                ok = (sig[i] != sig[j]).sum(axis=1) <= near.distance
                i, j = i[ok], j[ok]
                same = keys[i] == keys[j]
                ok = keys[i, same.argmax(axis=1)] == own[i]
                found[i[ok]] = found[j[ok]] = True
            if found.any():
                kept = t.filter(pa.array(found))
                for b in kept.select(target.names).combine_chunks().to_batches():
                    yield record_batch({c: b.column(c) for c in target.names}, target)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, by products of slices of the membership matrix."""
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(at, minlength=len(token)) > 1  # others are in no intersection
    number = np.cumsum(often) - 1
    keep = often[at]
    at, owner = number[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(sets), len(sets)))
    for a in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(at, [a, a + 4096])
        x = np.zeros((len(sets), 4096), dtype=np.float32)
        x[owner[lo:hi], at[lo:hi] - a] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def spanning_links(similar: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a matrix of similar pairs connects."""
    out, left = [], np.ones(len(similar), dtype=bool)
    for s in range(len(similar)):
        if left[s]:
            left[s] = False
            todo = [s]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(similar[i] & left)
                left[new] = False
                out += [(i, int(j)) for j in new]
                todo += new.tolist()
    return out


def links_of(rows: DataFrame, near: Near) -> DataFrame:
    """Links a, b from the full sets of each group (GROUP, rep, s)."""
    schema = "a long, b long"
    target = to_arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches):
            rep, s = t.column("rep").to_numpy(), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("s")]
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo == 2:
                    x, y = s[lo], s[lo + 1]
                    both = int(np.isin(x, y, assume_unique=True, kind="sort").sum())
                    if 100 * both >= near.percent * (len(x) + len(y) - both):
                        a.append(rep[lo])
                        b.append(rep[lo + 1])
                elif hi - lo > 2:
                    both = common_counts(s[lo:hi])
                    n = np.array([len(x) for x in s[lo:hi]])
                    for i, j in spanning_links(100 * both >= near.percent * (n[:, None] + n - both)):
                        a.append(rep[lo + i])
                        b.append(rep[lo + j])
            if a:
                yield record_batch({"a": np.array(a), "b": np.array(b)}, target)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def full_sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """rep, set1 and s (the whole set) of representatives (rep, set1), from one pass over the texts."""

    def sets(ids: list, texts: list[str]) -> dict:
        found = list(all_shingles(texts, words))
        return {"rep": ids, "set1": [first_total(s) for s in found], "s": [s.tobytes() for s in found]}

    return chosen_rows(docs, id_bits(reps, "rep"), "rep long, set1 long, s binary", sets).join(reps.select("rep", "set1").distinct(), ["rep", "set1"]).dropDuplicates(["rep", "set1"])


def stars(docs: DataFrame, members: DataFrame, hot: DataFrame, reps: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """rep and star (its centre's number) of members of hot buckets that are similar to a centre, and the links (rep, star) found.

    Members of one family may have different largest buckets, so centres are then compared with centres. Texts are read once.
    """
    own = stored(join_by_key(members, hot, ["key"]))
    known = stored(full_sets(docs, own.select("rep").distinct().join(reps.select("rep", "set1"), "rep"), near.words))
    links = star_of = stored(star_links(own, known, near))
    for _ in range(CENTRE_ROUNDS):
        owners = own.drop("k").join(star_of.filter("rep = star").select("rep"), "rep", "left_semi")
        common = stored(owners.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
        more = stored(star_links(join_by_key(owners, common, ["key"]), known, near))
        if more.filter("rep != star").isEmpty():
            break
        to = more.select(F.col("rep").alias("star"), F.col("star").alias("_to"))
        star_of = stored(star_of.join(to, "star", "left").select("rep", F.coalesce("_to", "star").alias("star")))
        links = links.unionByName(more)
    return star_of, links


def star_links(own: DataFrame, known: DataFrame, near: Near) -> DataFrame:
    """rep and star of members (key, rep, k) that are similar to the smallest one of those with the same largest bucket, by their full sets.

    That one is its own star. A member is compared once; each block of a bucket's members gets a copy of the centre.
    """
    home = stored(own.groupBy("rep").agg(F.max(F.struct("k", "key")).alias("x")).select("rep", F.col("x.key").alias("key")))
    centres = stored(home.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("k")).filter("k > 1"))
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    placed = join_by_key(home, centres, ["key"]).filter("rep > centre").select("key", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("lo"), "rep", "centre")
    copies = centres.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("lo"), F.col("centre").alias("rep"), "centre")
    rows = placed.unionByName(copies).withColumn("hi", F.lit(0)).join(known, "rep")
    schema = "rep long, star long"
    target = to_arrow(own.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches):
            rep, centre = t.column("rep").to_numpy(), t.column("centre").to_numpy()
            s = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("s")]
            found: list[int] = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                middle = next((s[i] for i in range(lo, hi) if rep[i] == centre[i]), None)
                if middle is None:
                    continue
                for i in range(lo, hi):
                    both = int(np.isin(s[i], middle, assume_unique=True, kind="sort").sum())
                    if 100 * both >= near.percent * (len(s[i]) + len(middle) - both):
                        found.append(i)
            if found:
                yield record_batch({"rep": rep[found], "star": centre[found]}, target)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema).distinct()


def placements(members: DataFrame, buckets: DataFrame, reps: DataFrame, starred: DataFrame | None) -> DataFrame:
    """GROUP, rep and star: in which groups each member of a bucket is compared.

    Members other than those of the bucket's most frequent star (its body) are cut into blocks; every two of these blocks
    meet, and every one meets every block of the body, but blocks of the body do not meet each other.
    """
    rows = members.withColumn("star", F.col("rep"))
    if starred is not None:
        own_star = reps.select("rep").distinct().join(starred, "rep", "left").select("rep", F.coalesce("star", "rep").alias("star"))
        rows = stored(members.join(own_star, "rep"))
        by_star = join_by_key(rows, buckets.filter(F.col("k") > BLOCK), ["key"]).groupBy("key", "star").agg(F.count(F.lit(1)).alias("n"))
        bodies = by_star.groupBy("key").agg(F.max(F.struct("n", "star")).alias("x")).select("key", F.col("x.n").alias("body"), F.col("x.star").alias("main"))
        buckets = stored(buckets.join(bodies, "key", "left").filter("body is null or body < k"))
        body = F.when(F.col("body") > 1, F.col("body")).otherwise(0)
    else:
        buckets, body = buckets.withColumn("main", F.lit(None).cast("long")), F.lit(0)
    others, wide = F.ceil((F.col("k") - body) / BLOCK).cast("int"), F.ceil(body / BLOCK).cast("int")
    in_body = F.coalesce((F.col("star") == F.col("main")) & (body > 0), F.lit(False))
    own = F.pmod(F.xxhash64("rep"), F.when(in_body, wide).otherwise(others)).cast("int")
    # Blocks of others have numbers from 0 on, the body's blocks negative ones.
    among = F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi")))
    with_body = F.when(wide > 0, F.transform(F.sequence(F.lit(1), F.greatest(wide, F.lit(1))), lambda o: F.struct((-o).alias("lo"), own.alias("hi")))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    of_body = F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct((-1 - own).alias("lo"), o.alias("hi")))
    meets = F.explode(F.when(in_body, of_body).otherwise(F.concat(among, with_body)))
    return join_by_key(rows, buckets, ["key"]).select("key", "rep", "star", meets.alias("x")).select("key", "x.lo", "x.hi", "rep", "star")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept.

    Texts without a word and rows with a null doc_id are linked with nothing and kept;
    their component is their own id. Repeated rows each get their row. Rows with one
    doc_id should have one text; if not, each text is placed by its own set. Extra
    columns, whatever their names, are ignored. An empty table gives no rows.
    """
    read = stored(read_sets(docs, near.words))
    usable = read.filter("n_shingles > 0 and doc_id is not null")
    reps = usable.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"), F.count(F.lit(1)).alias("k"))
    reps = stored(reps.select("set1", "set2", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig"), "k"))

    buckets = stored(keyed(reps, near).groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
    members = stored(keyed(reps, near, hash_bits(buckets, "key", KEY_BITS)))
    hot = buckets.filter(F.col("k") > BLOCK)
    starred, star_found = (None, None) if hot.isEmpty() else stars(docs, members, hot, reps, near)
    placed = placements(members, buckets, reps, starred)
    near_rows = stored(with_partner(placed.join(reps.select("rep", "set1", "n", "sig"), "rep"), near))
    full = stored(full_sets(docs, near_rows, near.words))
    links = links_of(near_rows.join(full, ["rep", "set1"]).select(*GROUP, "rep", "s"), near)
    if starred is not None:
        links = links.unionByName(star_found.filter("rep != star").select(F.col("star").alias("a"), F.col("rep").alias("b")))
    links = stored(links)

    final = components(links).withColumnRenamed("node", "rep")
    classes = stored(reps.select("set1", "set2", "rep", "k").join(final, "rep", "left").select("set1", "set2", F.coalesce("component", "rep").alias("_component"), "k"))
    columns = ["doc_id", "n_shingles"]
    placed = join_by_key(usable.select(*columns, "set1", "set2"), classes, ["set1", "set2"]).select(*columns, F.col("_component").alias("component_id"))
    others = read.filter("not (n_shingles > 0 and doc_id is not null)").select(*columns, F.col("doc_id").alias("component_id"))
    return placed.unionByName(others).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
