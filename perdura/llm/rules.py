"""Quality rules: base rules, and robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. For every language and source
the minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps from three starts about the medians (quartile ranges, spatial signs,
bounded scores): each step takes the H share of rows with the smallest Mahalanobis
distances and estimates anew, until nothing changes. Of a group's estimates that of the
smallest determinant is taken. A last reweighted estimate then rejects vectors whose
squared distance is beyond the TAIL quantile of the chi-squared law. All is DataFrame
code.

Vectors and distances are rounded to small integers, so that sums are exact whatever
the order of rows, and the nearest share is found from counts by distance, of which
there are at most a few thousand for a group of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.llm.common import WORD, join_by_key, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Units in 1 of a vector's entry.
UNIT = 1024
NAMES = ["v_length", "v_symbols", "v_lines", "v_repeats", "v_capitals"]
#: Standard deviations that are added to every scatter: differences below these mean nothing. For a share's root they are
#: about 1 / (2 sqrt(n)), the noise of counting n units, in a text of 30 lines or words that could repeat or 100 to 150 characters.
RESOLUTION = [0.08, 0.04, 0.10, 0.09, 0.05]
#: Lines and words without a repeat that are added to every text's, so that one repeat in a short text means little.
MORE_LINES, MORE_WORDS = 4, 50
#: Share of rows that an estimate is taken from, and steps after which it is taken as it is.
H, MOST_STEPS = 0.75, 30
#: Chances of a normal vector to be left out of the last estimate, and to be rejected.
INNER_TAIL, TAIL = 0.025, 1e-7
#: Rows that a group needs for estimates of its own (smaller ones are pooled by language, then all together), and that a
#: pool needs for a verdict.
MIN_GROUP, LEAST_ROWS = 60, 10
#: Group tables up to this many rows are broadcast (about 15 MB), larger ones joined by shuffle.
BROADCAST_GROUPS = 50_000
P = len(NAMES)


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > 1e-16 * total:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(share: float, k: int) -> float:
    low, high = 1e-6, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < share else (low, mid)
    return low


def consistency(share: float, k: int) -> float:
    """What the scatter of the nearest share of normal vectors must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_lines", F.size("_lines").cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("n_capitals", (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"))
    w = F.col("_words")
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    # Only texts with a repeated window go through the sort.
    some = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    d = d.withColumn("_sorted", F.when(some, F.sort_array(placed)).otherwise(none)).drop("_words", "_lines", "_windows")
    s = F.col("_sorted")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    d = d.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    at = F.col("_at")
    covered = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"))
    return d.drop("_sorted", "_at")


def vector() -> list[Column]:
    """The transformed statistics, in whole units; length on a log scale, shares by their square root."""
    share = lambda part, whole, more=0: F.sqrt(F.col(part) / (F.greatest(F.col(whole), F.lit(1)) + more))
    length = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    entries = [length, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines", MORE_LINES), share("n_repeat_words", "n_words", MORE_WORDS), share("n_capitals", "word_chars")]
    return [F.round(x * UNIT).cast("long").alias(n) for x, n in zip(entries, NAMES, strict=True)]


def key(*columns: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in columns])


def grouped(rows: DataFrame, min_group: int) -> DataFrame:
    """Adds _group: language and source, or the language's pool, or the pool of all. rows are stored."""
    own, pool = key(F.col("lang"), F.col("source")), key(F.col("lang"))
    named = rows.withColumn("_own", own)
    all_rows = named.groupBy("_own", pool.alias("_pool")).agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("base_failed")).alias("n"))
    sizes = stored(all_rows)
    pools = sizes.filter(F.col("n") < min_group).groupBy("_pool").agg(F.sum("n").alias("pooled"))
    group = F.when(F.col("n") >= min_group, F.concat(F.lit("own:"), "_own")).when(F.col("pooled") >= min_group, F.concat(F.lit("pool:"), "_pool")).otherwise("all")
    chosen = stored(sizes.join(pools, "_pool", "left").select("_own", "k", group.alias("_group")))
    return joined(named, chosen, "_own").drop("_own", "k")


def joined(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """rows with what groups (stored, with k, a group's rows) has for each; a group with very many rows is joined in several tasks."""
    return rows.join(F.broadcast(groups), name) if groups.count() <= BROADCAST_GROUPS else join_by_key(rows, groups, [name])


PAIRS = [(i, j) for j in range(P) for i in range(j, P)]


def with_factor(model: DataFrame, scale: Column) -> DataFrame:
    """From scatters c_i_j, the lower factor l_i_j of scale * scatter + resolution, by Cholesky, and det, the log of its determinant."""
    for j in range(P):
        for i in range(j, P):
            x = F.col(f"c_{i}_{j}") * scale + (F.lit(RESOLUTION[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                x = x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            x = F.sqrt(F.greatest(x, F.lit(1e-12))) if i == j else x / F.col(f"l_{j}_{j}")
            model = model.withColumn(f"l_{i}_{j}", x)
    det = sum((F.log(f"l_{i}_{i}") for i in range(1, P)), F.log("l_0_0"))
    return model.drop(*[f"c_{i}_{j}" for i, j in PAIRS]).withColumn("det", det)


def distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows for each of their group's models, with _d2, the squared Mahalanobis distance."""
    out = joined(rows, model, "_group")
    for i, name in enumerate(NAMES):
        x = F.col(name) / UNIT - F.col(f"m_{i}")
        for k in range(i):
            x = x - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        out = out.withColumn(f"_y{i}", x / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, P)), F.col("_y0") * F.col("_y0"))
    own = [c for c in model.columns if c not in ("_group", "_start")]
    return out.withColumn("_d2", d2).drop(*own, *[f"_y{i}" for i in range(P)])


def starts(rows: DataFrame) -> DataFrame:
    """_group, _start, k and a centre and factor for each start. Entries are whole numbers of a bounded range, so the counts
    behind the quartiles are bounded."""
    q = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("k"), *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i, c in enumerate(NAMES)])
    middle = [(F.get(f"q_{i}", F.lit(1)) / UNIT).alias(f"m_{i}") for i in range(P)]
    spread = [F.greatest((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / (1.349 * UNIT), F.lit(RESOLUTION[i])).alias(f"s_{i}") for i in range(P)]
    q = stored(q.select("_group", "k", *middle, *spread))
    z = joined(rows, q, "_group").select("_group", *[((F.col(n) / UNIT - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, n in enumerate(NAMES)])
    norm2 = F.greatest(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, P)), F.col("z_0") * F.col("z_0")), F.lit(1e-9))
    # Products are rounded to whole numbers, so that their sums do not depend on the order of rows.
    whole = lambda x: F.round(x * (1 << 20)).cast("long")
    signs = [F.sum(whole(F.col(f"z_{i}") * F.col(f"z_{j}") / norm2)).alias(f"a_{i}_{j}") for i, j in PAIRS]
    scores = [F.sum(whole(F.tanh(f"z_{i}") * F.tanh(f"z_{j}"))).alias(f"b_{i}_{j}") for i, j in PAIRS]
    t = joined(z.groupBy("_group").agg(*signs, *scores), q, "_group")
    out = None
    for number in range(3):
        share = lambda i, j, t="ab"[number - 1]: F.col(f"{t}_{i}_{j}") / F.greatest(F.sqrt(F.col(f"{t}_{i}_{i}").cast("double") * F.col(f"{t}_{j}_{j}")), F.lit(1.0))
        c = [((F.lit(float(i == j)) if number == 0 else share(i, j)) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in PAIRS]
        one = t.select("_group", F.lit(number).alias("_start"), "k", *[f"m_{i}" for i in range(P)], *c)
        out = one if out is None else out.unionByName(one)
    return with_factor(out, F.lit(1.0))


SUMS = [f"s_{i}" for i in range(P)] + [f"s_{i}_{j}" for i, j in PAIRS]


def sums() -> list[Column]:
    return [F.sum(NAMES[i]).alias(f"s_{i}") for i in range(P)] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s_{i}_{j}") for i, j in PAIRS]


def estimate(binned: DataFrame, scale: Column) -> DataFrame:
    """Centre and factor from sums over chosen bins of rows; k stays."""
    t = binned.groupBy("_group", "_start").agg(F.max("k").alias("k"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])
    mean = lambda i: F.col(f"s_{i}") / F.col("n") / UNIT
    columns = [mean(i).alias(f"m_{i}") for i in range(P)]
    columns += [(F.col(f"s_{i}_{j}") / F.col("n") / UNIT**2 - mean(i) * mean(j)).alias(f"c_{i}_{j}") for i, j in PAIRS]
    return with_factor(t.select("_group", "_start", "k", *columns), scale)


def concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: the estimates from the H share of each group's rows that are nearest."""
    near = distance(rows, model).withColumn("_bin", F.least(F.floor(F.log2(1 + F.col("_d2")) * 64), F.lit(4000)))
    bins = near.groupBy("_group", "_start", "_bin").agg(F.count(F.lit(1)).alias("n"), *sums())
    order = Window.partitionBy("_group", "_start").orderBy("_bin")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("_group", "_start"))
    chosen = bins.withColumn("_before", before).withColumn("k", total).filter(F.col("_before") < H * F.col("k"))
    return estimate(chosen, F.lit(consistency(H, P)))


def reweight(rows: DataFrame, model: DataFrame) -> DataFrame:
    near = distance(rows, model)
    inner = near.groupBy("_group", "_start").agg(*[F.sum(F.when(F.col("_d2") <= chi2_quantile(1 - INNER_TAIL, P), x)).alias(c) for c, x in zip(["n", *SUMS], [F.lit(1), *[F.col(c) for c in NAMES], *[F.col(NAMES[i]) * F.col(NAMES[j]) for i, j in PAIRS]], strict=True)], F.count(F.lit(1)).alias("k"))
    return estimate(inner.filter("n > 0"), F.lit(consistency(1 - INNER_TAIL, P)))


def robust(rows: DataFrame) -> DataFrame:
    """_group and k with the reweighted minimum-covariance-determinant estimate, for rows (_group and NAMES, stored)."""
    model, seen = stored(starts(rows)), set()
    for _ in range(MOST_STEPS):
        state = model.agg(F.bit_xor(F.xxhash64("_group", "_start", *[F.round(f"m_{i}", 9) for i in range(P)], F.round("det", 9)))).first()[0]
        if state in seen:
            break
        seen.add(state)
        model = stored(concentrate(rows, model))
    best = F.row_number().over(Window.partitionBy("_group").orderBy(F.round("det", 9), "_start"))
    model = stored(model.withColumn("_best", best).filter("_best = 1").drop("_best"))
    return stored(reweight(rows, model).drop("_start", "det"))


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP, least_rows: int = LEAST_ROWS, tail: float = TAIL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2 and kept.

    A null text has no words and fails the base rules; a null language or source is a
    value of its own. Groups below min_group rows are pooled. A text whose pool has
    fewer than least_rows rows is kept unless it fails the base rules. Equal vectors have
    equal distances. Extra columns, whatever their names, are ignored; repeated rows each
    get their row; an empty table gives none.
    """
    read = statistics(docs.select("doc_id", "text", "lang", "source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = stored(read.withColumn("base_failed", failed).select("doc_id", "lang", "source", *stats, "base_failed", *vector()))
    rows = stored(grouped(rows, min_group))
    model = robust(rows.filter("not base_failed").select("_group", *NAMES)).filter(F.col("k") >= least_rows)
    counts = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("k"))
    model = stored(counts.join(model.drop("k"), "_group", "left"))
    out = distance(rows, model).withColumnRenamed("_d2", "distance2")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= chi2_quantile(1 - tail, P))
    return out.select("doc_id", *stats, "base_failed", "distance2", kept.alias("kept"))
