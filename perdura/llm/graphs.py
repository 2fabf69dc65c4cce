"""Connected components, and bit filters for rows whose id or hash may be in a set.

A filter has a fixed size whatever the number of ids; it lets some rows through that
are not in the set, never fewer than are, and an exact join follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import join_by_key, record_batch, small_batches, stored, to_arrow


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for edges a, b; rounds of large and small stars.

    Minima of neighbourhoods are summed up before they are shuffled, and a node with very
    many edges is joined in several tasks. Loops and repeated edges do no harm; nodes
    without an edge to another node have no row.
    """
    least_of = lambda e: stored(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k")))
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = least_of(both)
        large = join_by_key(both.filter("b > a"), least.select("a", F.least("m", "a").alias("m"), "k"), ["a"])
        large = stored(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        down = least_of(large)
        small = join_by_key(large, down, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a != b").distinct())
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def hash_bits(hashes: DataFrame, column: str, log2: int = 23) -> np.ndarray:
    """Words of an array of 2**log2 bits, with the bits of a column of 64-bit hashes set."""
    at = F.shiftrightunsigned(column, 64 - log2)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.select(F.shiftright(at, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << log2) // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def id_bits(ids: DataFrame, column: str) -> np.ndarray:
    return hash_bits(ids.select(F.xxhash64(column).alias("h")), "h")


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be among those whose bits are set."""
    at = hashes.view(np.uint64) >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1


def chosen_rows(docs: DataFrame, bits: np.ndarray, schema: str, batch: Callable[[list, list[str]], dict]) -> DataFrame:
    """mapInArrow over doc_id and text of the rows whose id passes the filter; batch gets ids and texts."""
    target = to_arrow(docs.sparkSession, schema)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(may_hold(shared.value, b.column("_hash").to_numpy())))
            if b.num_rows:
                yield record_batch(batch(b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]), target)

    rows: Column = F.xxhash64("doc_id").alias("_hash")
    return docs.filter("doc_id is not null").select("doc_id", "text", rows).mapInArrow(run, schema)
