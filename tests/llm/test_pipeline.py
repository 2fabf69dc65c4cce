"""The stages, each against a plain version on its own input."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_columns_and_rows(kept):
    for df in kept[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    assert kept[0].count() >= kept[1].count() >= kept[2].count() == kept[3].count() > 0


def test_quality_keeps_good_documents(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    after = {r.doc_id for r in kept[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in after for i in good) >= 0.97 * len(good)


def test_no_near_duplicates_stay(kept):
    from tests.llm.test_operators import plain_components

    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    want = {i for i, (_, c) in plain_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept[2].collect()} == want


def test_mix_copies_whole_documents(kept):
    before = {r.doc_id: r.text for r in kept[3].collect()}
    after = [(r.doc_id, r.text) for r in kept[4].collect()]
    assert after and all(before[i] == t for i, t in after)


def test_packing_covers_every_copy(kept):
    copies, starts = kept[4].count(), kept[5].filter("piece = 0").count()
    assert copies == starts
    fills = kept[5].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 1024 for r in fills)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents of all odd kinds, and one without any."""
    from tests.llm.test_operators import prose

    full, none = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "none"))
    clean = "\n".join(prose(k, 30) + "." for k in range(4))
    texts = [None, "", " \n\t", clean, clean, clean.replace("water", "fire", 1), "mail a.b@x.example.com " + prose(50, 200), prose(60, 20_000), "#$ " * 90, "日本語 " * 50, "x <|endoftext|> y", "one two", "one two"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts * 2)]
    rows += [rows[3], rows[3], (None, clean, None, None, 3), (None, None, None, None, None), (90, None, "en", "s0", None)]
    extra = ["key", "k", "row", "rep", "piece", "score", "predicted", "size", "copies", "spans", "_text", "kept"]
    schema = corpus_pipeline_schema + ", " + ", ".join(f"`{c}` int" for c in extra)
    table = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], schema)
    labels = spark.createDataFrame([(i, int(t not in ("", None) and "#$" not in t), 0) for i, t in enumerate(texts)] + [(3, 1, 0), (None, 1, 0), (5, None, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    for folder, d, lab in ((full, table, labels), (none, table.limit(0), labels.limit(0))):
        d.write.parquet(f"{folder}/documents.parquet")
        lab.write.parquet(f"{folder}/labels.parquet")
    return full, none


corpus_pipeline_schema = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage_takes_odd_documents(spark, odd):
    from collections import Counter

    from perdura.llm import neardup, quality
    from tests.llm.test_operators import plain_components

    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    count = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_classifier", "near_duplicates", "personal_data", "source_mixing"):
        assert stages[name](spark, docs, odd[0]).columns == corpus_pipeline.COLUMNS
    scored = quality.score_quality(docs.drop("score", "predicted"), quality.train(docs, spark.read.parquet(f"{odd[0]}/labels.parquet")))
    assert count(stages["quality_classifier"](spark, docs, odd[0])) == count(scored.filter("predicted = 1"))
    own = [(r.doc_id, r.text) for r in docs.collect()]
    first = {i for i, (_, c) in plain_components([x for x in own if x[0] is not None], 5, 80).items() if i == c}
    assert count(stages["near_duplicates"](spark, docs, odd[0])) == Counter(x for x in own if x[0] is None or x[0] in first)
    masked = stages["personal_data"](spark, docs, odd[0]).collect()
    assert len(masked) == len(own) and all((r.text is None) == (r.n_chars is None) and "@" not in (r.text or "") for r in masked)
    mixed = count(stages["source_mixing"](spark, docs, odd[0]))
    assert set(mixed) <= set(own) and all(n <= 3 * own.count(x) for x, n in mixed.items())
    packed = stages["packing"](spark, docs, odd[0])
    assert packed.filter("piece = 0").count() == len(own)
    assert neardup.Near().percent == 80


def test_the_whole_pipeline_takes_odd_and_no_documents(spark, odd):
    out = corpus_pipeline.run(spark, odd[0])
    assert out.count() > 0 and out.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 1024
    assert corpus_pipeline.run(spark, odd[1]).count() == 0


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
