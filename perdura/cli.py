"""Command line: run, validate, list-metrics, list-estimators, list-suites, validate-output."""

from __future__ import annotations

import argparse
import json
import sys

from perdura.plans.catalog import METRICS
from perdura.plans.registry import estimator_registry
from perdura.plans.suites import list_suites, resolve
from perdura.sinks import contract


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("perdura").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(args: argparse.Namespace) -> int:
    from perdura.plans import runner
    from perdura.sinks.store import write_run

    manifest = resolve(args.manifest)
    out = runner.run(session(), manifest)
    root = write_run(out)
    print(f"run_id={out.run_id}\nresult_store={root / 'raw'}\nhtml_report={root / 'html/report.html'}")
    return 0


def validate(args: argparse.Namespace) -> int:
    try:
        m = resolve(args.manifest)
    except (FileNotFoundError, KeyError, TypeError, ValueError) as e:
        print(f"manifest_invalid={args.manifest}\nerror={e}", file=sys.stderr)
        return 2
    print(f"manifest_valid={args.manifest}\nmanifest_id={m.manifest_id}\nmode={m.mode}\nestimators={len(m.estimators)}\nmetrics={len(m.metrics)}")
    return 0


def listing(rows: list[dict], form: str, line) -> int:
    print(json.dumps(rows, indent=2, sort_keys=True) if form == "json" else "\n".join(map(line, rows)))
    return 0


def list_metrics(args: argparse.Namespace) -> int:
    names = ("name", "symbol", "requires_truth", "admissible_modes", "aggregation_rule", "optimisation_direction", "unit", "null_policy")
    rows = [{n: getattr(m, n) for n in names} for m in sorted(METRICS.values(), key=lambda m: m.name)]
    return listing(rows, args.format, lambda r: "\t".join([r["name"], r["symbol"], "truth" if r["requires_truth"] else "truth_free", ",".join(r["admissible_modes"]), r["aggregation_rule"], r["optimisation_direction"]]))


def list_names(names: list[str], form: str) -> int:
    return listing([{"name": n} for n in names], form, lambda r: r["name"])


def validate_output(args: argparse.Namespace) -> int:
    errors = contract.validate_output(args.run_root)
    where = sys.stderr if errors else sys.stdout
    print(f"output_{'in' if errors else ''}valid={args.run_root}\ncontract_version={contract.VERSION}", *[f"error={e}" for e in errors], sep="\n", file=where)
    return 2 if errors else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="perdura", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, f in (("run", run), ("validate", validate)):
        p = sub.add_parser(name)
        p.add_argument("manifest", help="a manifest file, or a packaged suite's name")
        p.set_defaults(f=f)
    lists = {"list-metrics": list_metrics, "list-estimators": lambda a: list_names(estimator_registry().list(), a.format), "list-suites": lambda a: list_names(list_suites(), a.format)}
    for name, f in lists.items():
        p = sub.add_parser(name)
        p.add_argument("--format", choices=("text", "json"), default="text")
        p.set_defaults(f=f)
    p = sub.add_parser("validate-output")
    p.add_argument("run_root")
    p.set_defaults(f=validate_output)
    args = parser.parse_args(argv)
    return args.f(args)


if __name__ == "__main__":
    raise SystemExit(main())
