"""Writes a run: Parquet for what grows with the records, single CSV files for reports, and renderings."""

from __future__ import annotations

import csv
import hashlib
import json
import platform
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura import __version__
from perdura.interfaces import Reporter, ResultStore
from perdura.plans.runner import Run
from perdura.sinks import render
from perdura.sinks.contract import ARTEFACTS
from perdura.sinks.tables import raw_tables, tables


def single_csv(df: DataFrame, path: Path) -> pd.DataFrame:
    """A report's table as one CSV file, sorted. Reports are made on the driver; series and their values are not."""
    pdf = df.toPandas()
    if len(pdf.columns) and len(pdf):
        pdf = pdf.sort_values(list(pdf.columns[:4]), kind="stable", na_position="first")
    path.parent.mkdir(parents=True, exist_ok=True)
    pdf.to_csv(path, index=False)
    return pdf


#: Tables with rows for every series: they are streamed, and only what reports show of them is read.
OF_SERIES = ("estimator_disagreement", "scale_window_sensitivity", "stress_metrics")


def shown_part(name: str, df: DataFrame) -> pd.DataFrame:
    """Of a table of OF_SERIES: the aggregates, or the mean drift and degradation by contamination."""
    if name == "stress_metrics":
        some = df.filter(F.col("metric_name").isin(*render.DEGRADATION))
        return some.groupBy("contamination_operator").agg(F.lit(render.DEGRADATION[0]).alias("metric_name"), F.avg("value").alias("value")).toPandas()
    return df.filter("scope = 'aggregate'").toPandas().sort_values(["estimator_name", "metric_name"], kind="stable", ignore_index=True)


def streamed_csv(df: DataFrame, path: Path) -> None:
    """A table of any size as one CSV file, sorted: rows pass through the driver one partition at a time."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(df.sort(*df.columns[:4]).toLocalIterator(prefetchPartitions=True))


def write_run(run: Run, export_root: str | Path | None = None, reporters: Sequence[Reporter] = ()) -> Path:
    """Writes all files of the contract under export_root/run_id, and returns that folder.

    The folder is local to the driver and, but for values.parquet, needs memory for the reports
    only; on a cluster export_root must be shared with the executors, which write the values.
    Use write_parquet for results of any size.
    """
    m = run.manifest
    root = Path(export_root or m.report.get("export_root", "reports")) / run.run_id
    formats = [str(f) for f in m.report.get("formats", ("html", "csv"))]
    got = {}
    for name, df in tables(run).items():
        path = root / "tables" / f"{name}.csv"
        if name in OF_SERIES:
            streamed_csv(df, path)
            got[name] = shown_part(name, df)
        else:
            got[name] = single_csv(df, path)
    for name, df in raw_tables(run).items():
        streamed_csv(df, root / "raw" / f"{name}.csv")
    run.records.select("record_id", "values").write.mode("overwrite").parquet(str((root / "raw/values.parquet").absolute()))
    environment = {"perdura": __version__, "python": platform.python_version(), "pyspark": pyspark.__version__, "seeds": m.seeds, "execution": m.execution, "uncertainty": m.uncertainty}
    put(root / "manifest/environment.json", json.dumps(environment, indent=2, sort_keys=True, default=str))
    if m.raw:
        import yaml

        put(root / "manifest/benchmark_manifest.yaml", yaml.safe_dump(m.raw, sort_keys=False))
    put(root / "raw/run_summary.json", json.dumps({"run_id": run.run_id, "manifest_id": m.manifest_id, "mode": m.mode}, sort_keys=True))
    put(root / "html/report.html", render.html_report(m.name, got))
    if "latex" in formats:
        for name in render.LATEX:
            put(root / f"latex/{name}.tex", render.latex_table(got[name]))
    for name in m.report.get("figure_set", ()):
        if svg := render.figure(name, got):
            put(root / f"figures/{name}.svg", svg)
    for r in reporters:
        r.render(run, got, root)
    index = pd.DataFrame(artefacts(root, run.run_id), columns=ARTEFACTS)
    for where in ("artefacts/artefact_index.csv", "raw/artefacts.csv"):
        (root / where).parent.mkdir(parents=True, exist_ok=True)
        index.to_csv(root / where, index=False)
    return root


def put(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def artefacts(root: Path, run_id: str) -> list[tuple]:
    now = datetime.now(UTC).isoformat()
    files = sorted(p for p in root.rglob("*") if p.is_file() and "values.parquet" not in str(p))
    return [(hashlib.sha1(str(p.relative_to(root)).encode()).hexdigest()[:16], run_id, p.parent.name, p.suffix[1:], str(p.relative_to(root)), hashlib.sha256(p.read_bytes()).hexdigest(), now, "[]") for p in files]


class ParquetStore(ResultStore):
    """Parquet under a folder of any file system that Spark writes to."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def finalise(self) -> str:
        return self.folder


def write_to(run: Run, store: ResultStore) -> str:
    """All results of a run, of any size, to a store."""
    for name, df in {**tables(run), **raw_tables(run), "values": run.records.select("record_id", "values")}.items():
        store.write(name, df)
    return store.finalise()


def write_parquet(run: Run, folder: str) -> None:
    write_to(run, ParquetStore(folder))
