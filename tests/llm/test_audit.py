"""Filter interaction audit and centroid clustering against plain versions, on odd rows."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from perdura.llm import audit, centroids

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, n long"
LABELS = "doc_id long, quality int, toxic int, text string"


def plain_audit(docs, labels):
    good = {d for d, q, _, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t, _ in labels if d is not None and t == 1}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {k for k, x in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t)), strict=True) if x}
        f |= {"E"} if d is not None and d > least[t] else set()
        fails.append((lang or "", f, d in good, d in toxic))
    out = set()
    for part in {x[0] for x in fails}:
        own, rows, shapley = [x for x in fails if x[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, letter in enumerate(order):
                gone = set(order[:k])
                here = [x for x in own if not gone & x[1] and letter in x[1]]
                shapley[letter] += len(here)
                rows.append((part, order, k + 1, letter, sum(not (gone | {letter}) & x[1] for x in own), len(here), sum(letter in x[1] and bool(gone & x[1]) for x in own), sum(x[1] == {letter} for x in own), sum(x[2] for x in here), sum(x[3] for x in here)))
        out |= {(*r[:3], *r[4:], shapley[r[3]]) for r in rows}
    return out


def row(i, text, lang):
    return (i, text, lang, "s", 1, 99, "x", 5)


def test_audit_of_odd_rows_equals_plain_version(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [row(5, long, "en"), row(3, long, None), row(3, long, None), row(9, long, ""), row(None, long, "en"), row(None, long, "de"), row(7, None, "en"), row(8, "", "en")]
    docs += [row(20 + k, long, "en") for k in range(200)]
    docs += [row(300, "a " * 300, "de"), row(301, long + " #", "de"), row(302, long.upper(), "fr"), row(303, "É Ö |", "fr"), row(304, "x" * 100_000, "fr"), row(305, long + "\x00\x0b\x1cz", "fr")]
    labels = [(5, 1, 0, "t"), (5, 0, 1, "t"), (3, None, None, None), (None, 1, 1, ""), (9, 1, 1, ""), (9, 1, 1, ""), (12345, 1, 1, ""), (25, 1, None, "")]
    got = audit.filter_audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["part", "filter_order", "step", *audit.MEASURES]
    assert len(rows) == 600 * 4 and set(rows) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.filter_audit(none, nothing).collect() == []
    assert audit.filter_audit(spark.createDataFrame([row(1, "a", None)], DOCS), nothing).filter("removed > 0 and part = ''").count() > 0


def test_matrices_partition_the_masks():
    m = audit.matrices()
    assert m["kept"].shape == (32, 600) and m["letters"].sum() == 600
    gone = np.array([[bool(mask & sum(1 << "ABCDE".index(y) for y in o[:k])) for o in audit.ORDERS for k in range(5)] for mask in range(32)])
    passes_late = ~gone & (m["kept"] == 0) & (m["removed"] == 0)
    assert not passes_late.any()
    assert ((m["removed"] + m["redundant"]).sum(axis=0) == 16).all() and (m["unique_fails"].sum(axis=0) == 1).all()


def plain_clusters(vectors, count, rounds, width):
    kept = [(i, [int(np.floor(1024 * float(v))) for v in x]) for i, x in vectors if x is not None and len(x) == width and all(v is not None and np.isfinite(v) for v in x)]
    text = lambda i: "" if i is None else str(i)
    centres = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{text(r[0])}".encode()).hexdigest(), r[1]))[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centres)):
            own = [x for (_, x), (_, c) in zip(kept, near, strict=True) if c == k]
            centres[k] = [sum(v) // len(own) for v in zip(*own, strict=True)] if own else centres[k]
    near = assign()
    inertia = [sum(d for d, c in near if c == k) for k in range(len(centres))]
    return sorted((str(i), c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near, strict=True))


VECTORS = "vec_id long, embedding array<double>, vector string, cluster int, key string"


@pytest.mark.parametrize("scale", [0.002, 1.0, 100_000.0])
def test_clusters_of_odd_vectors_equal_plain_version(spark, scale):
    """Small scales give many ties and equal vectors, large ones lose the last bits in float32."""
    rng = np.random.default_rng(3)
    data = [(i, (rng.random(4) * scale).tolist()) for i in range(300)]
    data += [(i, data[7][1]) for i in range(300, 420)] + [data[3], data[3], (None, data[5][1]), (None, data[6][1])]
    data += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None, 1.0, 1.0]), (504, [1.0, float("nan"), 1.0, 1.0]), (505, [1.0, float("-inf"), 1.0, 1.0]), (506, [-0.0003 * scale] * 4)]
    df = spark.createDataFrame([(i, x, "v", 1, "k") for i, x in data], VECTORS).repartition(3)
    got = centroids.cluster_vectors(df, count=5, rounds=4, width=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_clusters(data, 5, 4, 4)


def test_clusters_of_no_or_few_vectors(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    few = spark.createDataFrame([(1, [0.5] * 64, "", 0, ""), (2, [0.5] * 64, "", 0, "")], VECTORS)
    assert [(r.vec_id, r.distance, r.inertia) for r in centroids.cluster_vectors(few).orderBy("vec_id").collect()] == [(1, 0, 0), (2, 0, 0)]
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64, "", 0, "")], VECTORS)).collect()


def test_intervals_hold_the_exact_distance_and_are_narrow():
    rng = np.random.default_rng(5)
    for top in (3, 1 << 10, 1 << 20, centroids.LARGEST):
        x, c = rng.integers(-top, top + 1, (200, 64)), rng.integers(-top, top + 1, (30, 64))
        low, high = centroids.intervals(x, c)
        true = np.array([[sum(int(b) ** 2 - 2 * int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in c] for u in x], dtype=object)
        assert (low <= true).all() and (true <= high).all()
        assert np.median((high - low) / np.abs(true.astype(float)).mean()) < 1e-3


def test_exact_comparison_decides_what_float32_cannot():
    big = centroids.LARGEST - 1
    x = np.full((4, 64), big)
    c = np.full((3, 64), big)
    c[0, 0] -= 2
    c[1, 5] -= 1
    c[2, 9] -= 1
    low, high = centroids.intervals(x, c)
    assert (low <= high.min(axis=1, keepdims=True)).sum() == 12
    assert centroids.nearest(x, c).tolist() == [1] * 4
    assert centroids.whole_vectors(pa.record_batch({"vector": pa.array([[1.0] * 64, None], pa.list_(pa.float32()))}))[0].tolist() == [0]
