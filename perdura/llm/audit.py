"""What each of five filters removes under every order of application, by an incidence matrix product.

A document's outcome depends only on the set of filters that it fails, a mask of five
bits. So a part's documents are a histogram of 32 masks, and what happens to them at
each step of each of the 120 orders is that histogram times a fixed 32-by-600 matrix of
zeros and ones: kept, removed, redundant (failing, but removed earlier) and unique
(failing nothing else). Histograms of good and of toxic documents are further rows.

Masks are DataFrame expressions. Copies are counted before they are shuffled, so that a
text that a third of all documents share is a few rows; then the rows of one document
text are as many as there are parts and labels.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.llm.common import WORD, map_rows

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
HISTOGRAMS = ["n", "good", "toxic"]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_mask(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, F.size(F.array_distinct(words)) * 100 < n * 50, capitals * 100 > F.length(text) * 3, text.rlike(r"[#$%&*|]")]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail.

    docs (doc_id, text, lang), labels (doc_id, quality, toxic); other columns are ignored.
    A null text is an empty one, a null lang the part ''. Repeated rows count each. A
    document is good if any label of its id has quality 1, toxic if any has toxic 1. A null
    doc_id is neither smaller nor larger than another: such a document never fails E, has
    no labels, and makes no other fail.
    """
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    marked = small.join(marks, "doc_id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in ("good", "toxic")})
    # Rows of one doc_id first, as only the smallest id's documents pass E; ids are even, copies are not.
    keys = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    sets = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unknown"), first.alias("first"))
    joined = sets.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    passing = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    dealt = F.array(F.struct("mask", passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))
    cells = joined.select("part", "good", "toxic", F.inline(dealt)).filter("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def matrices() -> dict[str, np.ndarray]:
    """Matrices of 32 masks by 600 steps (5 of each order), and of 600 steps by 5 filters."""
    mask = np.arange(MASKS)[:, None]
    own = np.array([1 << FILTERS.index(x) for order in ORDERS for x in order])
    before = np.array([sum(1 << FILTERS.index(y) for y in order[:k]) for order in ORDERS for k in range(len(FILTERS))])
    fails, gone = (mask & own) > 0, (mask & before) > 0
    made = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": np.broadcast_to(mask == own, fails.shape)}
    return {k: v.astype(np.int64) for k, v in made.items()} | {"letters": (own[:, None] == (1 << np.arange(len(FILTERS)))).astype(np.int64)}


def outcomes(stacked: np.ndarray, by: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Measures (parts by 600) from histograms (parts by 3 by 32), by exact integer products."""
    n, good, toxic = stacked[:, 0], stacked[:, 1], stacked[:, 2]
    out = {k: n @ by[k] for k in ("kept", "removed", "redundant", "unique_fails")}
    out |= {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
    return out | {"shapley": out["removed"] @ by["letters"] @ by["letters"].T}


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows per part: part, filter_order, step (1 to 5) and the seven measures; see mask_counts. Without documents, no rows."""
    cells = [F.sum(F.when(F.col("mask") == m, F.col(h)).otherwise(0)) for h in HISTOGRAMS for m in range(MASKS)]
    wide = mask_counts(docs, labels).groupBy("part").agg(F.array(*cells).alias("cells"))
    steps = len(FILTERS)

    def batch(b: pa.RecordBatch) -> dict:
        stacked = b.column("cells").flatten().to_numpy().reshape(b.num_rows, len(HISTOGRAMS), MASKS)
        rows = {k: v.reshape(-1) for k, v in outcomes(stacked, matrices()).items()}
        names = {"part": b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), len(ORDERS) * steps))), "filter_order": np.tile(np.repeat(ORDERS, steps), b.num_rows), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), b.num_rows * len(ORDERS))}
        return names | rows

    return map_rows(wide, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES), batch)
