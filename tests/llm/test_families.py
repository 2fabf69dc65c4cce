"""Large families of near copies: rows grow with the family's size, and no link is lost."""

import numpy as np
import pytest

from perdura.llm import neardup
from perdura.llm.common import stored
from tests.llm.test_operators import plain_components


def family(seed, n, first, changed=1, words=120):
    """n texts of one template, each with a few words of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{k}" for k in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.choice(words, changed, replace=False):
            text[at] = f"own{seed}x{first + i}x{at}"
        out.append((first + i, " ".join(text)))
    return out


def placed_rows(spark, docs, near):
    read = stored(neardup.read_sets(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), near.words))
    reps = stored(read.selectExpr("doc_id as rep", "set1", "set2", "n_shingles as n", "sig"))
    members = stored(neardup.keyed(reps, near))
    buckets = stored(members.groupBy("key").count().withColumnRenamed("count", "k").filter("k > 1"))
    starred, _ = neardup.stars(spark.createDataFrame(docs, "doc_id long, text string"), members, buckets.filter(f"k > {neardup.BLOCK}"), reps, near)
    assert starred.count() == starred.select("rep").distinct().count()
    return neardup.placements(members, buckets, reps, starred).count(), starred.filter("rep != star").count()


def test_rows_into_the_comparison_grow_with_the_family(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 50)
    found = {n: placed_rows(spark, family(1, n, 0), neardup.Near(3, 85)) for n in (200, 800, 3200)}
    for n, (rows, starred) in found.items():
        assert starred >= 0.95 * n and rows <= 60 * n, found
    assert found[3200][0] <= 6 * max(found[800][0], 800)


@pytest.mark.parametrize("changed", [1, 3, 5])
def test_families_keep_every_link(spark, monkeypatch, changed):
    """Two families, chains of copies that drift away from them, and loners, against all pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    docs = family(1, 60, 0, changed) + family(2, 40, 100, changed)
    base = docs[5][1].split()
    for k in range(25):  # each differs a little from the one before
        base = list(base)
        base[(4 * k) % len(base)] = f"drift{k}"
        docs.append((200 + k, " ".join(base)))
    docs += [(300 + k, " ".join(f"lone{k}x{j}" for j in range(50))) for k in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), neardup.Near(3, 85)).collect()}
    assert got == plain_components(docs, 3, 85)


def test_hot_keys_by_rows_of_a_task():
    from perdura.llm import common

    assert [common.hot_limit(n) for n in (0, 10**5, 10**6, 10**9, 10**11, 10**13)] == [500, 500, 3906, 2_000_000, 2_000_000, 10**8]
    assert all(n // common.hot_limit(n) <= common.MOST_HOT for n in (10**8, 10**11, 10**14))
