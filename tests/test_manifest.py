"""Manifests, suites, files, command line."""

import json
import os
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perdura import cli, testing
from perdura.interfaces import LeaderboardBuilder
from perdura.kernels.estimators import Kernel, variance_ratio
from perdura.operators.evaluate import GLOBAL
from perdura.plans import runner
from perdura.plans.catalog import METRICS
from perdura.plans.manifest import ManifestError, manifest_of
from perdura.plans.suites import SUITES, resolve
from perdura.sinks import contract, render
from perdura.sinks.store import write_run
from perdura.sinks.tables import tables
from perdura.sources.records import grid_rows, severity


def changed(suite="smoke_ground_truth", /, **blocks):
    return {**SUITES[suite], **blocks}


def test_all_suites_are_valid():
    assert len(METRICS) == 20
    for s in SUITES.values():
        manifest_of(s)


@pytest.mark.parametrize(
    "data",
    [
        changed(surprise=1), changed(name=""), changed(estimators=[]), changed(metrics=[]), changed(metrics=["unknown"]), changed(metrics=["instability"]),
        changed(metrics=["bias", "coverage_error"], leaderboards=[]), changed(metrics=[{"name": "coverage", "levels": [1.5]}], leaderboards=[]),
        changed(contamination={"operators": []}, mode="stress_test"), changed(contamination={"operators": [{"name": "x"}]}),
        changed("smoke_observational", source={"type": "generator_grid"}), changed("smoke_observational", source={"type": "inline_table", "series": []}), changed("smoke_observational", source={"type": "odd"}), changed("smoke_observational", metrics=["bias"]),
        changed(execution={"max_workers": 0}), changed(execution={"max_workers": True}), changed(execution={"other": 1}), changed(execution={"cache_read": "yes"}), changed(execution={"estimate_cache_dir": " "}),
        changed(uncertainty={"n_bootstrap": 0}), changed(uncertainty={"ci_levels": []}), changed(uncertainty={"ci_levels": [2]}), changed(uncertainty={"seed": "x"}), changed(uncertainty={"metrics": "mae"}), changed(uncertainty={"enabled": 1}), changed(uncertainty={"odd": 1}),
        changed(leaderboards=[{"mode": "ground_truth", "component_metrics": ["mae"], "weights": {"mae": 0.5}}]), changed(leaderboards=[{"mode": "stress_test", "component_metrics": ["mae"], "weights": {"mae": 1}}]), changed(leaderboards=[{"mode": "ground_truth", "component_metrics": ["runtime"], "weights": {"runtime": 1}}]),
        changed(estimators=[{"name": "RS"}]), changed(estimators=["RS"]), changed(estimators=[{"name": "RS", "target_estimand": "h", "variants": []}]),
    ],
)
def test_broken_manifests(data):
    with pytest.raises(ManifestError):
        manifest_of(data)


def test_unknown_keys_can_be_allowed():
    manifest_of(changed(surprise=1, validation={"reject_unknown_keys": False}))


def test_ids_strata_and_severity():
    rows = grid_rows(manifest_of(SUITES["small_stress"]))
    assert len(rows) == 24 and len({r[0] for r in rows}) == 24 and len({r[11] for r in rows}) == 12
    assert severity({"amplitude": 5.0, "rate": 0.02}) == "amplitude=5.0;rate=0.02" and severity({}) == "default"
    twice = changed(source={"type": "generator_grid", "generators": [{"family": "fGn", "params": {"H": [0.5, 0.5], "n": 64}}]})
    with pytest.raises(ManifestError):
        grid_rows(manifest_of(twice))


#: Recorded row counts of the suites: per stratum, uncertainty, disagreement, failures, leaderboard, sensitivity or stress.
GOLDEN = {"small_canonical": (112, 24, 40, 21, 3, 0), "small_stress": (424, 144, 148, 84, 3, 180), "small_null": (75, 15, 52, 14, 3, 0), "small_sensitivity": (156, 36, 112, 50, 6, 42)}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_row_counts(spark, name):
    got = tables(runner.run(spark, name))
    last = "stress_metrics" if "stress_metrics" in got else "scale_window_sensitivity"
    names = ("per_stratum_metrics", "benchmark_uncertainty", "estimator_disagreement", "failures", "leaderboard", last)
    assert tuple(got[n].count() for n in names) == GOLDEN[name]


#: Recorded counts of the medium suites: aggregate rows, uncertainty rows, and stress rows where there are any.
MEDIUM = {"medium_canonical": (459, 170, None), "medium_stress": (2631, 880, 1872), "medium_null": (167, 32, None), "medium_sensitivity": (616, 105, None)}


@pytest.mark.parametrize("name", sorted(MEDIUM) if os.environ.get("TEST_ALL") else ["medium_null"])
def test_recorded_row_counts_of_medium_suites(spark, name):
    with runner.run(spark, name) as out:
        got = tables(out)
        assert (got["per_stratum_metrics"].count(), got["benchmark_uncertainty"].count(), got["stress_metrics"].count() if "stress_metrics" in got else None) == MEDIUM[name]


def test_run_writes_a_valid_folder(spark, tmp_path):
    out = runner.run(spark, changed("smoke_stress_test", report={"formats": ["html", "csv", "latex"], "figure_set": ["degradation_curve"]}))
    root = write_run(out, tmp_path)
    assert contract.validate_output(root) == [] and (root / "latex/leaderboard.tex").exists() and (root / "figures/degradation_curve.svg").exists()
    assert cli.main(["validate-output", str(root)]) == 0
    raw = pd.read_csv(root / "raw/metrics.csv")
    assert len(raw) == tables(out)["failures"].agg({"n_metric_rows": "sum"}).first()[0] + (raw.scope != "per_series").sum()
    (root / "tables/failures.csv").write_bytes(b"\xff\xfe\x00")
    assert any("failures.csv" in e for e in contract.validate_output(root))
    write_run(out, tmp_path)
    (root / "tables/leaderboard.csv").write_text("a,b\n")
    (root / "raw/metrics.csv").unlink()
    assert len(contract.validate_output(root)) == 2 and cli.main(["validate-output", str(root)]) == 2


def test_csv_and_inline_sources(spark, tmp_path):
    (tmp_path / "gap.csv").write_text("value,ignored\n1.0,a\n,b\n3.5,c\n")
    source = {"type": "csv_series_index", "series": [{"path": "gap.csv"}]}
    out = runner.run(spark, changed("smoke_observational", source=source), base_dir=tmp_path)
    row = out.records.first()
    assert list(row["values"]) == [1.0, 3.5] and row.record_id == "gap" and not out.estimates.first().valid
    assert out.estimates.first().failure_reason == "insufficient_signal_for_rs"
    with pytest.raises(ManifestError):
        runner.run(spark, changed("smoke_observational", source={"type": "inline_table", "series": [{"values": [1.0]}]}))
    with pytest.raises(FileNotFoundError):
        runner.run(spark, changed("smoke_observational", source={"type": "csv_series_index", "series": [{"path": "none.csv"}]}), base_dir=tmp_path)


def test_spark_reads_csv_series(spark, tmp_path):
    from perdura.sources.records import csv_series

    (tmp_path / "one.csv").write_text("value\n1\n2.5\n\nx\n4\n")
    assert [(r.series_id, r.t, r.v) for r in csv_series(spark, str(tmp_path / "one.csv")).orderBy("t").collect()] == [("one", 0, 1.0), ("one", 1, 2.5), ("one", 2, 4.0)]


def test_cache_gives_the_same_estimates(spark, tmp_path):
    data = changed(execution={"estimate_cache_dir": str(tmp_path / "cache")})
    points = [sorted((r.record_id, r.point, r.ci_low) for r in runner.run(spark, data).estimates.collect()) for _ in range(2)]
    assert points[0] == points[1] == sorted((r.record_id, r.point, r.ci_low) for r in runner.run(spark, changed()).estimates.collect())
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_cache_serves_any_number_of_estimators_by_one_join(spark, tmp_path):
    """A second run with one estimator more fits that one alone; the plan has as many joins as for one estimator."""
    folder = str(tmp_path / "cache")
    names = lambda *some: [{"name": n, "target_estimand": "hurst_scaling_proxy", "params": {"n_bootstrap": 6}} for n in some]
    execution = {"estimate_cache_dir": folder}
    with runner.run(spark, changed(estimators=names("RS", "GPH"), execution=execution)) as first:
        before = {r.estimator_name: r.point for r in first.estimates.collect()}
    files = spark.read.parquet(folder).count()
    with runner.run(spark, changed(estimators=names("RS", "GPH", "DFA"), execution=execution)) as second:
        after = {r.estimator_name: r.point for r in second.estimates.collect()}
        assert len(second.kept) > 4
    assert {k: after[k] for k in before} == before and set(after) == {"RS", "GPH", "DFA"}
    assert spark.read.parquet(folder).count() == files * 3 // 2
    runner.compact_cache(spark, folder, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == files * 3 // 2
    assert runner.read_cache(spark, str(tmp_path / "none")) is None


def test_plugins(spark):
    data = changed(estimators=[{"name": "VarianceRatio", "target_estimand": "hurst_scaling_proxy", "params": {"n_bootstrap": 8}}])
    with pytest.raises(KeyError):
        runner.run(spark, data)
    got = runner.run(spark, data, plugins={"VarianceRatio": Kernel(variance_ratio, "variance_ratio", 0, ("min_n",))})
    assert 0 < got.estimates.first().point < 1


def test_own_generators_contaminations_evaluator_and_leaderboard(spark):
    ramp = lambda rng, H, n: np.linspace(0, H, int(n)) + rng.normal(size=int(n))
    flip = lambda x, rng, **_: -x
    source = {"type": "generator_grid", "generators": [{"family": "Ramp", "params": {"H": 0.5, "n": 64}, "replicates": 2}]}
    data = changed("smoke_stress_test", source=source, contamination={"operators": [{"name": "flip"}]})
    with pytest.raises(ManifestError):
        runner.run(spark, data)

    class Halved(runner.CatalogueEvaluator):
        def aggregate(self, manifest, series):
            return super().aggregate(manifest, series).withColumn("value", F.col("value") / 2)

    class ByName(LeaderboardBuilder):
        def build(self, manifest, board, aggregates):
            return spark.createDataFrame([("RS", 1, 0.0, {"mae": 0.0})], "estimator_name string, rank int, score double, components map<string,double>")

    own = {"generators": {"Ramp": (ramp, "hurst_scaling_proxy", "H")}, "contaminations": {"flip": (flip, "sign")}}
    with runner.run(spark, data, **own) as plain, runner.run(spark, data, evaluator=Halved(), leaderboard_builder=ByName(), **own) as bent:
        got = {r.record_id: r for r in plain.records.collect()}
        assert len(got) == 4 and all(r["values"] == [-v for v in got[r.clean_record_id]["values"]] for r in got.values() if r.operator)
        value = lambda run: run.aggregates.filter("metric_name = 'mae'").agg({"value": "sum"}).first()[0]
        assert value(bent) == pytest.approx(value(plain) / 2)
        assert [r.score for b in bent.leaderboards.values() for r in b.collect()] == [0.0]
    assert not plain.kept


def test_figures():
    import xml.dom.minidom

    rows = pd.DataFrame({"scope": "aggregate", "estimator_name": ["A", "A", "B"], "metric_name": ["x<y", "z", "z"], "value": [0.1, 0.9, None]})
    bands = pd.DataFrame({"estimator_name": ["A", "B"], "metric_name": ["m", "m"], "value": [1.0, 2.0], "ci_low": [0.5, None], "ci_high": [1.5, None]})
    rates = pd.DataFrame({"estimator_name": ["A", "B"], "metric_name": "false_positive_lrd_rate", "value": [0.1, 0.2], "stratum_json": GLOBAL})
    stress = pd.DataFrame({"metric_name": "estimate_drift", "value": [0.1, 0.4], "contamination_operator": ["trend", "shift"]})
    given = {"estimator_disagreement": rows, "scale_window_sensitivity": rows.head(0), "benchmark_uncertainty": bands, "per_stratum_metrics": rates, "stress_metrics": stress}
    made = {n: render.figure(n, given) for n in ("disagreement_heatmap", "sensitivity_heatmap", "benchmark_uncertainty_intervals", "false_positive_lrd", "degradation_curve", "odd")}
    assert made["sensitivity_heatmap"] is None and made["odd"] is None
    for svg in filter(None, made.values()):
        xml.dom.minidom.parseString(svg)
    assert made["disagreement_heatmap"].count("<rect") == 2 and made["benchmark_uncertainty_intervals"].count("<line") == 1 and "polyline" in made["degradation_curve"]


def test_helpers_for_authors():
    def shaky(x):
        warnings.warn("short series", stacklevel=1)
        return np.where(x.std(axis=1) > 0, 0.5, np.nan)

    kernel = Kernel(shaky, "shaky")
    got = testing.smoke_fit(kernel, np.arange(40.0), 0.4, 0.6)
    assert got["warnings"] == ["short series"] and testing.estimator_spec(family="x").family == "x"
    testing.assert_invalid(testing.fit(kernel, np.zeros(40)), "shaky")
    with pytest.raises(AssertionError):
        testing.smoke_fit(kernel, np.arange(40.0), low=0.9)


def test_failing_estimator_is_a_result(spark):
    def broken(x):
        raise RuntimeError("no")

    data = changed(estimators=[{"name": "Broken", "target_estimand": "hurst_scaling_proxy"}])
    row = runner.run(spark, data, plugins={"Broken": Kernel(broken, "broken")}).estimates.first()
    assert not row.valid and row.failure_reason == "exception:RuntimeError:no"


def test_command_line(capsys, tmp_path):
    assert cli.main(["validate", "small_null"]) == 0 and "manifest_valid=small_null" in capsys.readouterr().out
    bad = tmp_path / "bad.yaml"
    bad.write_text("name: x\n")
    assert cli.main(["validate", str(bad)]) == 2 and "manifest_invalid=" in capsys.readouterr().err
    assert cli.main(["list-metrics", "--format", "json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 20
    assert cli.main(["list-estimators"]) == 0 and len(capsys.readouterr().out.split()) == 14
    assert cli.main(["list-suites"]) == 0 and "medium_stress" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        resolve("nothing")
