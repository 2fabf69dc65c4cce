"""The operators against plain versions, on small tables with nulls, empty and long texts, ties and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perdura.llm import common, fingerprint, graphs, langid, mixing, neardup, packing, passages, pii, quality, rules, urls
from perdura.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    stems = ["the", "and", "water", "light", "stone", "river", "over", "green", "small", "house", "far", "bright", "wind", "song"]
    words = [stems[i] + str(j) if j < 3 else stems[i] for i, j in zip(rng.integers(0, len(stems), n), rng.integers(0, 12, n), strict=True)]
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(40):
        text = "\n".join(prose(100 * i + k, 30) + "." for k in range(4))
        out.append((i, text, "en" if i % 3 else "de", f"s{i % 3}" if i % 7 else None, len(text), 0.5, "x"))
    base = out[3][1]
    out += [
        (100, base, "en", "s0", 1, 0.1, ""),  # an exact copy
        (101, base.replace("water", "fire", 2), "en", "s0", 1, 0.1, ""),  # a near copy
        (102, prose(9, 20) + " " + base[:900] + " " + prose(8, 30), None, "s1", 1, 0.1, ""),  # a shared passage
        (103, None, None, None, None, None, None),
        (104, "", "en", "s1", 0, 0.0, ""),
        (105, " \t\n ", "en", "s1", 4, 0.0, ""),
        (106, "one two", "en", "s2", 7, 0.0, ""),
        (107, "one two", "en", "s2", 7, 0.0, ""),
        (108, "mail a.b@x.example.com or +1 (663) 555-6869, host 10.0.0.7, 4111 1111 1111 1111; 300.1.1.1 and é@", "en", "s2", 7, 0.0, ""),
        (109, "#$ " * 80, "en", "s2", 7, 0.0, ""),
        (110, prose(5, 30000), "en", "s1", 7, 0.0, ""),
        (111, "日本語 " * 60 + "\u00a0x\r\ny", "ja", "s1", 7, 0.0, ""),
        (112, "token = \"e03422dad6b454724135a384f69ba12c7de6c8f4\" end", "en", "s0", 7, 0.0, ""),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(rows):
    return {r[0]: r[1] or "" for r in rows}


def words(t):
    return t.encode().split()


def test_quality_learns_and_scores(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], 0 if "#$" in (r[1] or "") else 1) for r in rows] + [(None, 1), (999, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    assert quality.score_quality(empty, model).count() == 0
    assert quality.train(docs, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == pytest.approx(0.5)


def test_quality_tables_are_additive():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_mixing_meets_targets(docs, rows, empty):
    mix = mixing.Mix()
    got = mixing.mix_sources(docs, mix).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 3.0), strict=True))
    assert sum(want.values()) == pytest.approx(sum(size.values()))
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == len(words(r.text or "")) and r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in names)
    small = mixing.Mix(shard_words=300)
    plan = mixing.make_plan(mixing.compact(docs, small).cache(), small)
    assert plan.shards > 3
    again = mixing.mix_sources(docs.repartition(5), small, plan)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again.collect())
    copies = mixing.mixed_rows(again, ["doc_id", "text"], plan).collect()
    assert sum(len(words(r.text or "")) for r in copies) == sum(taken.values())
    assert {r.shard for r in copies} == set(range(plan.shards))
    assert mixing.mix_sources(empty, mix).count() == 0


def test_mixing_keeps_columns_of_any_name(spark, rows):
    names = ["key", "block", "range", "place", "row", "cut", "units", "copy", "_source", "taken", "shard", "part"]
    table = spark.createDataFrame([(*r[:4], *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mix_sources(table).collect()
    assert all(r[n] == i for r in got for i, n in enumerate(names) if n not in mixing.RESULT) and len(got) == len(rows)
    plan = mixing.make_plan(mixing.compact(table).cache())
    out = mixing.mixed_rows(mixing.mix_sources(table, plan=plan), ["doc_id", "place", "row", "shard"], plan)
    assert out.columns == ["doc_id", "place", "row", "shard", "part"] and all(r.place == 3 and r.row == 4 for r in out.collect())


def test_mixing_many_sources_and_repeated_rows(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 400}") for i in range(2000)] + [(5, "a b c", "s5")] * 30
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 46 for s in size)


def base_stats(t):
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows, empty):
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, t in texts_of(rows).items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_stats(t), i
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.quality_rules(empty).count() == 0


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rows = [(i, prose(i, 120), "en", "a") for i in range(150)] + [(1000 + i, " ".join(w + "$$&" for w in prose(i, 90).split()), "en", "a") for i in range(12)]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got if not r.base_failed)
    assert rules.consistency(0.999999, 5) == pytest.approx(1, abs=1e-3)


def plain_mcd(x):
    """Concentration steps from many random subsets, then reweighting, with the operator's resolution and factors."""
    p, extra = x.shape[1], np.diag(np.square(rules.RESOLUTION))
    best, rng = (np.inf, None, None), np.random.default_rng(0)
    c = rules.consistency(rules.H, p)
    for _ in range(60):
        some = x[rng.choice(len(x), 12, replace=False)]
        m, v = some.mean(0), np.cov(some.T, bias=True) * c + extra
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)
            some = x[np.argsort(d, kind="stable")[: int(np.ceil(rules.H * len(x)))]]
            m, v = some.mean(0), np.cov(some.T, bias=True) * c + extra
        best = min(best, (np.linalg.det(v), m.tolist(), v.tolist()))
    m, v = np.array(best[1]), np.array(best[2])
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)
    some = x[d <= rules.chi2_quantile(1 - rules.INNER_TAIL, p)]
    m, v = some.mean(0), np.cov(some.T, bias=True) * rules.consistency(1 - rules.INNER_TAIL, p) + extra
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)


def test_robust_estimate_is_that_of_a_plain_one(spark):
    rng = np.random.default_rng(7)
    n = 400
    mix = np.array([[1, 0, 0, 0, 0], [0.5, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0.7, 0, 1, 0], [0.3, 0, 0, 0, 1]])
    x = rng.normal(size=(n, 5)) * 0.2 @ mix.T + 0.5
    x[:80] = rng.normal(size=(80, 5)) * 0.05 + np.array([0.5, 2.0, 0.2, -1.5, 1.2])  # a fifth lies together elsewhere
    x = np.round(x * rules.UNIT)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x] + [("one", 1, 2, 3, 4, 5)], "_group string, " + ", ".join(f"{c} long" for c in rules.NAMES))
    rows = rows.unionByName(spark.range(8000).select(F.lit("big").alias("_group"), *[F.pmod(F.hash("id", F.lit(i)), F.lit(1000)).cast("long").alias(c) for i, c in enumerate(rules.NAMES)])).cache()
    got = rules.distance(rows.filter("_group = 'g'").withColumn("i", F.monotonically_increasing_id()), rules.robust(rows)).orderBy("i").collect()
    d = np.array([r._d2 for r in got])
    want = plain_mcd(x / rules.UNIT)
    assert d[:80].min() > rules.chi2_quantile(1 - rules.TAIL, 5) > d[80:].max()
    assert d == pytest.approx(want, rel=0.15)


def varied(seed, n):
    """Prose with hardly a repeated word."""
    return " ".join(f"{w}{x}" for w, x in zip(prose(seed, n).split(), np.random.default_rng(seed).integers(10, 1000, n), strict=True))


def test_duplicate_lines_or_repeated_words_alone_are_rejected(spark):
    lines = "\n".join(f"{varied(1000 + k, 2)}\n{('reply12', 'share12')[k * k % 7 % 2]}" for k in range(70))
    twice = varied(3, 100)
    rows = [(i, varied(2000 + i, 120), "en", "a") for i in range(150)] + [(1000, lines, "en", "a"), (1001, f"{varied(4, 230)} {twice} {twice}", "en", "a"), (1002, f"{varied(5, 60)}\nread12 on34 here567\nread12 on34 here567", "en", "a")]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001}


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/70?x=1"), (2, "https://b.example.com/en/6#t"), (3, "x://example.com/en/"), (4, "https://badexample.net/de/8"), (5, "https://a.example.net/de/81"), (6, None), (7, "no url"), (8, "http://org/es/1"), (8, "http://org/es/1"), (9, "http://x.y.net"), (10, "http://" + "a." * 3000 + "org/es/")]
    clash = ["key", "keys", "k", "row", "listed", "n"]
    pages = spark.createDataFrame([(*r, "h", "v", *range(6)) for r in rows], "page_id long, url string, host string, verdict string, " + ", ".join(f"`{c}` int" for c in clash))
    got = urls.filter_urls(pages, urls.fixed_rules(spark)).collect()
    assert len(got) == len(rows) and all([r[c] for c in clash] == list(range(6)) for r in got)
    for r in got:
        host = path = ""
        if r.url and "://" in r.url:
            host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url).groups()
            host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert urls.filter_urls(pages.limit(0), urls.fixed_rules(spark)).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, urls.fixed_rules(spark).limit(0)).collect()} == {"allow"}


def test_canonical_urls(spark):
    same = [
        ("HTTP://User:pw@WWW.Example.com.:80/a/./b/../c%7e%2f?b=2&utm_source=x&a=1#top", "www.example.com/a/c~%2F?a=1&b=2"),
        ("https://e.org", "e.org/"),
        ("https://e.org/?gclid=1&&", "e.org/"),
        ("x://e.org//a///b/", "e.org/a/b/"),
        ("x://e.org/../../a/..", "e.org/"),
        ("x://e.org/a%zz%e3", "e.org/a%zz%E3"),
        ("no url", ""),
        (None, ""),
    ]
    got = spark.createDataFrame(same, "url string, want string").select("want", urls.canonical(F.col("url")).alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_a_long_list_of_urls(spark, monkeypatch):
    rng = np.random.default_rng(0)
    of = lambda i: f"http://h{i % 997}.example.org/p/{i}?q={i}&utm_source=feed"
    listed = spark.range(100_000).selectExpr("concat('https://H', id % 997, '.Example.org:443/p/x/../', id, '?q=', id) url", "'block' verdict").unionByName(spark.createDataFrame([("http://site.net", "block"), ("", "block"), (None, "block")], "url string, verdict string"))
    ids = rng.integers(0, 400_000, 500).tolist()
    rows = [(i, of(i)) for i in ids] + [(-1, "http://a.b.site.net/x"), (-2, "http://mysite.net/x"), (-3, "http://h1.example.org/p/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = {(i, "block" if 0 <= i < 100_000 or i == -1 else "allow") for i, _ in rows}
    assert {(r.page_id, r.verdict) for r in urls.filter_urls(pages, urls.fixed_rules(spark).limit(0), listed).collect()} == want
    monkeypatch.setattr(urls, "MAX_BLOCKS", 2)  # a filter that lets nearly everything through
    assert {(r.page_id, r.verdict) for r in urls.filter_urls(pages, urls.fixed_rules(spark).limit(0), listed).collect()} == want


def test_language(spark, docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = [(i, " ".join(np.random.default_rng(i).choice(["the", "house", "with", "water", "and", "thinking"] if i % 2 else ["das", "haus", "mit", "wasser", "und", "schön"], 40)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(900, None, "en"), (901, "123 ...", "en"), (902, "x" * 5000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, path)
    got = {r.doc_id: r for r in langid.identify_language(table, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:60])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.train(empty, path)
    assert {r.lang_pred for r in langid.identify_language(docs, nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    v = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    p = rng.random((v.size, 2)) / 1000
    text = "▁thinking"

    def total(s):
        if not s:
            return np.ones(2)
        return sum(p[v.pieces[s[:k]]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in v.pieces)

    for logs in (False, True):
        got = langid.log_totals(v.lattice([text, "▁a"]), np.log(p) if logs else p, logs)
        assert np.exp(got[0]) == pytest.approx(total(text))


def test_long_words_are_summed_whole():
    """By exact fractions, position by position."""
    from fractions import Fraction

    v = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    p = np.random.default_rng(1).random((v.size, 1)) / 1000
    word = ("wasserfluss" * 40).encode()
    text = langid.marked(word)
    alpha = [Fraction(1)] + [Fraction(0)] * len(text)
    for _, s, e, k in sorted(zip(*(x.tolist() for x in v.lattice([text])[:4]), strict=True), key=lambda x: x[2]):
        alpha[e] += alpha[s] * Fraction(float(p[k, 0]))
    got = langid.word_scores(langid.Model(tokenizer_path("piece_bpe_32k.model"), ["x"], p), [word, b"a"])
    f = alpha[-1]
    log2 = f.numerator.bit_length() - f.denominator.bit_length()
    want = log2 * np.log(2) + np.log(float(f / (Fraction(2) ** log2)))
    assert got[0, 0] == pytest.approx(want, rel=1e-12)
    short, long_ = (langid.expected(v.lattice([text[:30]]), np.log(p) if logs else p, logs) for logs in (False, True))
    assert short == pytest.approx(long_)


@pytest.mark.parametrize("split", [False, True])
def test_passages(spark, docs, rows, empty, monkeypatch, split):
    if split:  # every key is joined by broadcast, shards are small and go to several tasks
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(common, "HOT_SHARE", 1 << 40)
        monkeypatch.setattr(passages, "SHARD_WORDS", 40)
        monkeypatch.setattr(passages, "SHARD_DOCS", 1)
    got = {r.doc_id: r for r in passages.remove_repeats(docs).collect()}
    first, texts = {}, texts_of(rows)
    for i in sorted(texts):
        w = words(texts[i])
        gone = set()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone |= set(range(j, j + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].text.encode()) == (len(w), len(gone), kept), i
    assert got[100].n_removed > 0 and got[102].n_removed > 0 and len(got) == len(rows)
    digest = {r.doc_id: r.kept_sha256 for r in passages.removal_digests(docs).collect()}
    assert digest[100] == hashlib.sha256(got[100].text.encode()).hexdigest()
    assert passages.remove_repeats(empty).count() == 0


def test_passages_repeated_in_part_by_one_document(spark):
    rows = []
    for k in range(8):
        rng = np.random.default_rng(k)
        new = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]  # noqa: B023, E731
        shared, lead = new(100), new(37)
        rows.append((2 * k, " ".join(new(60) + shared + new(60))))
        rows.append((2 * k + 1, " ".join(new(60) + lead + shared + new(60) + lead + shared[:70] + new(60))))
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 170 * (i % 2) for i, _ in rows}


def plain_removal(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w, gone = words(t), set()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone |= set(range(j, j + 50))
        out[i] = len(gone)
    return out


def test_passages_of_few_different_words(spark):
    """Blocks that recur at many places, in one document and in others."""
    rng = np.random.default_rng(5)
    line = " ".join(prose(1, 26).split())
    rows = [(i, " ".join(rng.choice(["a", "b"], 400, p=[0.9, 0.1]))) for i in range(8)] + [(10, "x " * 3000), (11, "y " + "x " * 700 + "z"), (12, "x " * 49)]
    rows += [(20 + i, " ".join(f"{line} k{rng.integers(0, 4)} " + "q " * int(rng.integers(0, 30)) for _ in range(40))) for i in range(6)]
    got = {r.doc_id: r.n_removed for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removal(rows) and got[11] == 700


def plain_components(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("split", [False, True])
def test_near_duplicates(spark, rows, empty, monkeypatch, split):
    if split:  # blocks of few members, every key dealt to several tasks
        monkeypatch.setattr(neardup, "BLOCK", 4)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(common, "HOT_SHARE", 1 << 40)
    rng = np.random.default_rng(3)
    more = list(rows)
    base = prose(77, 160).split()
    for i in range(40):  # copies with more and more edits, many just at the threshold
        w = list(base)
        for k in rng.integers(0, len(w), i // 4):
            w[k] = f"edit{i}x{k}"
        more.append((200 + i, " ".join(w), "en", "s", 0, 0.0, ""))
    table = spark.createDataFrame(more, DOCS)
    for near in (neardup.Near(3, 85), neardup.Near()):
        got = {r.doc_id: r for r in neardup.near_duplicates(table, near).collect()}
        want = plain_components(more, near.words, near.percent)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_at_half(spark):
    rng = np.random.default_rng(4)
    base = prose(78, 120).split()
    rows = [(i, " ".join(f"new{i}x{k}" if rng.random() < i / 90 else w for k, w in enumerate(base))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Near(1, 50)).collect()}
    assert got == plain_components(rows, 1, 50) and len({c for _, c in got.values()}) > 1
    with pytest.raises(ValueError):
        neardup.Near(3, 5).chunk  # noqa: B018


def test_counts_of_common_elements():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 6000, int(n), dtype=np.uint64)) for n in rng.integers(1, 4000, 12)]
    assert neardup.common_counts(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_signature_index_finds_all_within_its_distance():
    near = neardup.Near(3, 85)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, neardup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.SYMBOLS, near.distance, replace=False)] ^= 1
    x, y = neardup.chunk_keys(a, near.chunk).reshape(200, -1), neardup.chunk_keys(b, near.chunk).reshape(200, -1)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 200), (200, 100), (300, 300)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 31)}, 200: 100}


def test_fingerprints(spark, docs, rows, empty):
    got = {r.doc_id: r for r in fingerprint.edit_fingerprints(docs, 3).collect()}
    ids, texts = sorted(texts_of(rows)), texts_of(rows)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 2
        new = t[: len(t) - n] + after[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert got[i].fingerprint == fingerprint.Multiset(t).digest() and 0 <= got[i].near_edited <= 1
    assert got[3].fingerprint == got[100].fingerprint and got[3].near_edited > got[3].near_next
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprint.edit_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.edit_fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(docs).count() == len(rows)


def test_multiset_hash_is_homomorphic():
    v = fingerprint.Multiset("a\nb. x\nc")
    same = lambda a, b: a.digest() == b.digest()
    assert same(v, fingerprint.Multiset("c\na\n\nb. x")) and not same(v, fingerprint.Multiset("a\nb. x\nb. x"))
    assert not v.equals(fingerprint.Multiset("a\nb\nx\nc"))
    v.add([b"d"])
    assert same(v, fingerprint.Multiset("a\nb. x\nc\nd"))
    v.add([b"a", b"d"], sign=-1)
    assert same(v, fingerprint.Multiset("b. x\nc")) and same(v, fingerprint.Multiset.parse(v.digest()))


@pytest.mark.parametrize("n", [1, 10, 100, 1000, 20_000])
def test_likeness_is_near_the_exact_overlap_at_any_length(n):
    worst = 0.0
    for share in (0, 0.1, 0.5, 0.9, 1):
        common = round(share * n)
        a = "\n".join(f"s{i}" for i in range(n))
        b = "\n".join([f"s{i}" for i in range(common)] + [f"t{n}.{i}" for i in range(n - common)])
        got = fingerprint.Multiset(a).likeness(fingerprint.Multiset(b))
        worst = max(worst, abs(got - common / n))
        assert got < 0.1 if common == 0 else True
        assert got == 1 if common == n else got < 1
    assert worst <= 3.5 / fingerprint.LANES**0.5


def sequences_of(got, size=1024):
    """Rows by sequence; offsets must be gapless."""
    fill = collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return fill


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    special = [(500, "a <|endoftext|> b"), (501, "<|endoftext|>" * 3), (None, "no id"), (None, "no id")]
    table = docs.unionByName(docs.filter("doc_id < 3")).select("doc_id", "text", "score", "spans")
    table = table.unionByName(spark.createDataFrame(special, "doc_id long, text string"), allowMissingColumns=True).withColumn("piece", F.lit("clash")).withColumn("offset", F.lit(1))
    got = packing.pack_documents(table, path).collect()
    texts = {**texts_of(rows), **dict(special)}
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        copies = 2 if i is None or i < 3 else 1
        pieces = sorted(by[i], key=lambda r: r.piece)[::copies]
        assert len(by[i]) == copies * len(pieces)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    fill = sequences_of(got)
    assert len(fill) <= sum(r.length for r in got) / 1024 * 1.02 + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_comes_near_the_bound():
    lengths = np.clip(np.random.default_rng(0).lognormal(5.7, 1, 20_000), 1, 1023).astype(np.int64)
    bins = packing.pack_all(lengths)
    assert np.bincount(bins, weights=lengths).max() <= 1024 and bins.max() + 1 <= 1.01 * lengths.sum() / 1024
    assert packing.pack_all(np.full(3000, 600)).max() == 2999  # no two fit together


def test_no_task_packs_more_than_its_rows(spark):
    pieces = spark.range(10_000).selectExpr("7L doc_id", "0 piece", "0L start", "600L length", "1L ids_crc32")
    got = packing.pack(pieces, task_rows=2_500).withColumn("task", F.shiftright("sequence_id", 32)).cache()
    assert [r[1] for r in got.groupBy("task").count().collect()] == [2_500] * 4
    assert len(sequences_of(got.collect())) == 10_000


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\r\x0b\x1c\x85\u00a0\u3000\u200bab1's\u00e9.,\u65e5", "<|endoftext|>"]), max_size=25).map("".join))
def test_chunks_are_encoded_as_whole_texts_are(text):
    enc = packing.encoder(tokenizer_path())
    enc.chunks, enc.older = {}, {}
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(1)
    p = packing.SumOfSquares(20)
    for n in rng.integers(1, 21, 300).tolist():
        before = p.count.copy()
        p.add(n)
        sums = []
        for g in [20, *[g for g in range(n, 20) if before[g]]]:
            c = before.copy()
            if g < 20:
                c[g] -= 1
            if g - n:
                c[g - n] += 1
            sums.append((c**2).sum())
        assert (p.count**2).sum() == min(sums)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and s % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def test_personal_data(spark, docs, rows, empty):
    texts_spans = {r[0]: r[6] for r in rows}
    hard = ["a@b.co_x@y.zz, c@d", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111-1111 1111 1111 4111111111111112 6011000990139424", "+1+22 333 4444 5555 (x) +49 (0) 30-1234.5678-", "@" * 500, "9" * 3000, "a" * 3000 + "@", "é x@y.zé"]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(300 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    found = pii.candidates(table)
    got = {r.doc_id: r for r in pii.digest(pii.decided(found, pii.train(found))).collect()}
    for i, t in {**texts_of(rows), **{300 + i: t for i, t in enumerate(hard)}}.items():
        base, counts = [], []
        for kind, p in PATTERNS.items():
            ms = [m for m in re.finditer(p, t) if passes(kind, m.group())]
            counts.append(len(ms))
            base += [f"{kind}:{m.start()}:{m.end()}" for m in ms]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, t[:80]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",") if r.spans else [])
    clean = [r for r in rows[:40]]
    assert all(got[r[0]].spans == "" for r in clean)
    clash = docs.withColumn("_m", F.lit(1)).withColumn("_text", F.lit(2)).withColumn("row", F.lit(3)).withColumn("_spans", F.lit(4))
    redacted = pii.redact(clash)
    assert redacted.columns == clash.columns
    masked = {r.doc_id: r.text for r in redacted.collect() if (r["_m"], r["_text"], r["row"], r["_spans"]) == (1, 2, 3, 4) and r.spans == texts_spans[r.doc_id]}
    assert masked[108].startswith("mail <email> or <phone>, host <ip>, <card>; 300.1.1.1") and masked[103] is None
    assert masked[0] == rows[0][1] and pii.redact(empty).count() == 0


def test_long_secrets_are_proposed_whole(spark):
    token = "eyJ0" + "aB3xK9_q-Z" * 49 + "Qw7890"
    found = pii.candidates(spark.createDataFrame([(1, f'token = "{token}" end')], "doc_id long, text string")).first()
    assert [(x.kind, x.s, x.e, x.f_right, x.v_edges) for x in found["_spans"]] == [("secret", 9, 509, 0, 0)]


def test_added_spans_by_precision_and_recall(spark):
    """Planted names, secrets, spelled-out addresses, phone numbers and ids among look-alikes that are none."""
    rng = np.random.default_rng(11)
    pick = lambda *x: x[rng.integers(len(x))]
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    first, last = ("Anna", "John", "Pierre", "Maria", "Lukas", "Carmen"), ("Keller", "Brown", "Moreau", "Ortiz", "Lind")
    real = [
        ("name", lambda: ("contact: ", f"{pick('Mr', 'Dr.', 'Frau')} {pick(*first)} {pick(*last)}")),
        ("name", lambda: ("Dear ", f"{pick(*first)} {pick(*last)}")),
        ("secret", lambda: ("token = ", hexes(40))),
        ("secret", lambda: ("key ", "AKIA" + "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ234567"), 16)))),
        ("email", lambda: ("mail ", f"{pick('ana', 'joe')}{rng.integers(100)} [at] host{rng.integers(9)} [dot] com")),
        ("phone", lambda: ("call ", f"({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}")),
        ("id", lambda: ("ssn ", f"{rng.integers(100, 899)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}")),
    ]
    fake = [lambda: f"section {rng.integers(99)}-{rng.integers(10**6)}", lambda: f"see https://x.example/{hexes(30)}9/{hexes(8)}", lambda: f"version {rng.integers(200, 999)}.{rng.integers(200, 999)}.{rng.integers(1000, 9999)}", lambda: "some_long_identifier_with_words_2", lambda: "die Bundesregierungsverordnung", lambda: "New York and Los Angeles"]
    rows, want = [], set()
    for i in range(600):
        text = prose(i, 20) + " "
        if i % 3 == 0:
            kind, make = real[rng.integers(len(real))]
            cue, span = make()
            want.add((i, kind, len(text + cue), len(text + cue + span)))
            text += cue + span
        elif i % 3 == 1:
            text += fake[rng.integers(len(fake))]()
        rows.append((i, text + " " + prose(i + 1000, 20)))
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, x.kind, x.s, x.e) for r in pii.decided(found, pii.train(found)).collect() for x in r.spans if not x.base}
    precision, recall = len(got & want) / max(1, len(got)), len(got & want) / len(want)
    assert precision >= 0.85 and recall >= 0.8, (precision, recall, sorted(got - want)[:5], sorted(want - got)[:5])


def test_votes_tell_reliable_labelers():
    patterns = [("email", (1, 1, 1, 0, 0), 200.0), ("email", (1, 0, 0, 0, 0), 50.0), ("email", (0, 0, 0, -1, -1), 300.0), ("email", (0, 1, 0, -1, -1), 20.0)]
    votes, post = pii.expectation_maximisation(patterns)
    assert post[0] > 0.9 and post[2] < 0.1 and votes["v_format"][1, 1] > votes["v_format"][1, 0]
