"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash within their source. Every source's target
is a number of full passes over its blocks plus a part of one more pass, cut at a
document. A tree over the output shards splits the sources' block quotas: at each
node the left half draws its exact number of blocks from the sources by a
multivariate hypergeometric law, down to single shards. A source's permuted blocks
are then dealt to the shards as disjoint ranges, and rows are shuffled inside their
shard.

The number of shards grows with the words mixed, up to MAX_SHARDS; beyond, shards are
dealt by hash to several parts each, so that a task writes about shard_words words at
any size. Only sums by (source, block) reach the driver, about MAX_BLOCK_ROWS of them
whatever the number of rows, or one for each source if there are more sources than that.
Documents are never grouped by source, so a source with a third of all rows is spread
over all its blocks; where a block is cut is found from sums by ever smaller ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.llm.common import stored, to_arrow, word_count

MAX_BLOCK_ROWS = 200_000
BLOCKS_PER_SOURCE, RANGES_PER_BLOCK = 512, 4096
MAX_SHARDS, BLOCKS_PER_SHARD = 4096, 8
#: The plan is broadcast up to this many rows (about 4 MB), and joined by shuffle above.
BROADCAST_ROWS = 40_000
UNIT = "struct<pass:int,shard:int>"
PLAN = f"source string, block int, source_size long, target double, cut_range int, cut_place long, cut_unit {UNIT}, units array<{UNIT}>"


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    most_repeats: float = 3.0
    shard_words: int = 2_000_000
    seed: int = 17


@dataclass
class Plan:
    mix: Mix
    rows: DataFrame  # PLAN, with a key for joins in place of source
    n_rows: int
    blocks: int
    ranges: int
    shards: int
    parts: int


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """The total shared by weight; none above most times its size, the excess reshared."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total for i in free}
        full = {i for i in free if share[i] >= most * sizes[i]}
        if not full:
            for i in free:
                out[i] = share[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free -= full
    return out


def split_tree(quotas: np.ndarray, capacity: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """For each shard in turn, how many blocks of each source it gets."""
    if len(capacity) == 1:
        yield quotas
        return
    half = len(capacity) // 2
    left = rng.multivariate_hypergeometric(quotas, int(capacity[:half].sum()), method="marginals")
    yield from split_tree(left, capacity[:half], rng)
    yield from split_tree(quotas - left, capacity[half:], rng)


def place_of(seed: int) -> Column:
    """The row's place in its source's permutation, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)


def compact(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """What a plan is made from, without the texts: doc_id, source, size (words) and place."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place_of(mix.seed).alias("place"))


def block_of(blocks: int) -> Column:
    return F.shiftright(F.shiftright("place", 33) * blocks, 30).cast("int")


def range_of(blocks: int, ranges: int) -> Column:
    """The range of a block in which a place is; ranges follow each other as places do."""
    inside = (F.shiftright("place", 33) * blocks).bitwiseAND(F.lit((1 << 30) - 1))
    return F.shiftright(inside * ranges, 30).cast("int")


def source_key(source: Column) -> Column:
    """A name that no source has stands for null, for joins."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def name_of(source: str | None) -> str:
    return "null" if source is None else f"={source}"


class Draft:
    """The plan's part that needs sums by source and block only; pure Python on the driver."""

    def __init__(self, rows: list[tuple], mix: Mix):
        self.names = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
        at = {s: i for i, s in enumerate(self.names)}
        self.blocks: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for s, b, words in rows:
            self.blocks[at[s]].append((b, words))
        self.sizes = [sum(w for _, w in bs) for bs in self.blocks]
        weights = [float(mix.weights[i % len(mix.weights)]) for i in range(len(self.names))]
        self.want = targets(self.sizes, weights, mix.most_repeats)
        self.rng = np.random.default_rng(mix.seed)
        self.draws: list[list[tuple[int, int]]] = []  # (block, pass), in the order in which shards get them
        self.cuts: list[tuple[int, int, int] | None] = []  # block, pass and the words wanted of it
        for bs, n, t in zip(self.blocks, self.sizes, self.want, strict=True):
            bs.sort()
            full = int(t // n) if n else 0
            left = round(t - full * n) if n else 0
            one = [(b, p) for p in range(full) for b, _ in bs]
            cut = None
            for i in self.rng.permutation(len(bs)) if left > 0 else ():
                b, words = bs[i]
                one.append((b, full))
                if words > left:
                    cut = (b, full, left)
                    break
                left -= words
                if left == 0:
                    break
            self.cuts.append(cut)
            self.draws.append([one[i] for i in self.rng.permutation(len(one))])

    def rows(self, shards: int, cut_at: dict[str | None, tuple[int, int]]) -> Iterator[tuple]:
        """The plan's rows; cut_at has the range and the place at which a source's block is cut."""
        quotas = np.array([len(x) for x in self.draws], dtype=np.int64)
        capacity = np.array([quotas.sum() // shards + (j < quotas.sum() % shards) for j in range(shards)], dtype=np.int64)
        shard_of = [np.empty(n, dtype=np.int64) for n in quotas]
        done = np.zeros(len(quotas), dtype=np.int64)
        for j, got in enumerate(split_tree(quotas, capacity, self.rng) if len(quotas) else ()):
            for i in np.flatnonzero(got):
                shard_of[i][done[i] : done[i] + got[i]] = j
            done += got
        for i, s in enumerate(self.names):
            units: dict[int, list[dict]] = {b: [] for b, _ in self.blocks[i]}
            cut, cut_unit = self.cuts[i], None
            for (b, p), j in zip(self.draws[i], shard_of[i].tolist(), strict=True):
                if cut and (b, p) == cut[:2]:
                    cut_unit = {"pass": p, "shard": j}
                else:
                    units[b].append({"pass": p, "shard": j})
            for b, got in units.items():
                mine = cut is not None and cut[0] == b
                where = cut_at.get(s, (0, -1)) if mine else (None, None)
                yield (name_of(s), b, self.sizes[i], self.want[i], *where, cut_unit if mine else None, sorted(got, key=lambda u: u["pass"]))


def make_plan(small: DataFrame, mix: Mix = Mix()) -> Plan:
    """The plan for small = compact(docs), which should be stored."""
    spark = small.sparkSession
    n_sources = small.select("source").distinct().count()
    blocks = max(1, min(BLOCKS_PER_SOURCE, MAX_BLOCK_ROWS // max(1, n_sources)))
    rows = small.groupBy("source", block_of(blocks).alias("block")).agg(F.sum("size").alias("words")).collect()
    draft = Draft([tuple(r) for r in rows], mix)

    # Sums by range tell in which range of its block a source is cut; sums by place in that range alone, where.
    cut = [(name_of(s), c[0], c[2]) for s, c in zip(draft.names, draft.cuts, strict=True) if c]
    ranges = max(1, min(RANGES_PER_BLOCK, MAX_BLOCK_ROWS // max(1, len(cut))))
    keyed = small.select(source_key(F.col("source")).alias("key"), "size", "place", block_of(blocks).alias("block"), range_of(blocks, ranges).alias("range"))
    cut_at: dict[str, tuple[int, int]] = {}
    if cut:
        wanted = sized(spark.createDataFrame(cut, "key string, block int, left long"), len(cut))
        sums = keyed.join(wanted, ["key", "block"]).groupBy("key", "range").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        # Of the words before a range: at most as many ranges as one block has, for each source.
        before = F.sum("words").over(Window.partitionBy("key").orderBy("range")) - F.col("words")
        ending = sums.withColumn("before", before).filter("before <= left and before + words > left").groupBy("key").agg(F.min(F.struct("range", (F.col("left") - F.col("before")).alias("left"))).alias("x"))
        ending = stored(ending.select("key", "x.range", "x.left"))
        block = sized(spark.createDataFrame([c[:2] for c in cut], "key string, block int"), len(cut))
        inside = keyed.join(block, ["key", "block"]).join(sized(ending, len(cut)), ["key", "range"]).groupBy("key", "range", "left", "place").agg(F.sum("size").alias("size"))
        before = F.sum("size").over(Window.partitionBy("key").orderBy("place")) - F.col("size")
        inside = inside.withColumn("before", before).filter("2 * before + size <= 2 * left").groupBy("key").agg(F.max("place").alias("place"))
        last = {r.key: r.place for r in inside.collect()}
        cut_at = {r.key: (r.range, last.get(r.key, -1)) for r in ending.collect()}

    units, words = sum(map(len, draft.draws)), sum(draft.want)
    wanted_shards = max(1, -(-int(words) // mix.shard_words))
    shards = max(1, min(wanted_shards, MAX_SHARDS, units // BLOCKS_PER_SHARD))
    planned = list(draft.rows(shards, {s: cut_at[name_of(s)] for s in draft.names if name_of(s) in cut_at}))
    schema = to_arrow(spark, PLAN)
    data = pa.table([pa.array([r[i] for r in planned], type=f.type) for i, f in enumerate(schema)], schema=schema)
    return Plan(mix, spark.createDataFrame(data, PLAN).withColumnRenamed("source", "key"), len(planned), blocks, ranges, shards, -(-wanted_shards // shards))


def sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


RESULT = ["size", "source_size", "target", "copies", "taken"]


def planned(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (row, source, size, place) as row and RESULT. Narrow where the plan is broadcast."""
    keyed = rows.withColumn("key", source_key(F.col("source"))).withColumn("block", block_of(plan.blocks)).withColumn("range", range_of(plan.blocks, plan.ranges))
    both = keyed.join(sized(plan.rows, plan.n_rows), ["key", "block"])
    inside = F.col("cut_unit").isNotNull() & ((F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & (F.col("place") <= F.col("cut_place"))))
    copies = F.when(inside, F.array_append("units", F.col("cut_unit"))).otherwise(F.col("units"))
    part = lambda u: F.pmod(F.xxhash64(u["pass"], F.col("place")), F.lit(plan.parts)).cast("int")
    copies = F.transform(copies, lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"), part(u).alias("part"), F.col("place").alias("place")))
    return both.select("row", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.size("copies"))


def mix_compact(small: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id and RESULT for small = compact(docs), which should be stored."""
    rows = small.select(F.struct("doc_id").alias("row"), "source", "size", "place")
    return planned(rows, make_plan(small, mix)).select("row.doc_id", *RESULT)


def mix_sources(docs: DataFrame, mix: Mix = Mix(), plan: Plan | None = None) -> DataFrame:
    """docs with size, source_size, target, copies (array of pass, shard, part and place) and taken.

    docs needs doc_id, text and source; other columns, whatever their names, stay, but those
    named size, source_size, target, copies or taken are replaced. A null text has size 0,
    a null source is a source of its own, sorted last. Rows of size 0 are taken as often as
    their block is. Repeated rows share one place and are taken together. An empty table
    gives no rows. Reruns agree: places are hashes of the rows.
    """
    plan = plan or make_plan(stored(compact(docs, mix)), mix)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", word_count(F.col("text")).alias("size"), place_of(mix.seed).alias("place"))
    return planned(rows, plan).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULT], *RESULT)


def mixed_rows(mixed: DataFrame, columns: list[str], plan: Plan) -> DataFrame:
    """One row for each copy, with shard (a column of that name is replaced) and part; each part in a task of its own, in shuffled order."""
    rows = mixed.select(F.struct(*columns).alias("row"), F.explode("copies").alias("copy")).select("row", "copy.*")
    order = F.xxhash64(F.lit(plan.mix.seed), "pass", "place")
    dealt = rows.withColumn("to", (F.col("shard") * plan.parts + F.col("part")).cast("int")).repartitionById(plan.shards * plan.parts, "to").sortWithinPartitions("to", order)
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in ("shard", "part")], "shard", "part")
