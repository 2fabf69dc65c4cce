"""HTML, LaTeX and SVG from report tables."""

from __future__ import annotations

import html

import pandas as pd

from perdura.operators.evaluate import GLOBAL

ROWS = 25
#: Metrics whose mean the degradation curve shows.
DEGRADATION = ("estimate_drift", "relative_degradation_ratio")
SECTIONS = {"leaderboard": "Leaderboard", "per_stratum_metrics": "Metrics by stratum", "failures": "Failures", "estimator_disagreement": "Disagreement", "scale_window_sensitivity": "Sensitivity to parameters", "uncertainty_calibration": "Calibration", "benchmark_uncertainty": "Uncertainty"}
LATEX = ("leaderboard", "per_stratum_metrics", "failures", "uncertainty_calibration", "benchmark_uncertainty")
ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def text(v: object) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def html_table(df: pd.DataFrame) -> str:
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(text(v))}</td>" for v in r) + "</tr>" for r in df.head(ROWS).itertuples(index=False))
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def html_report(name: str, tables: dict[str, pd.DataFrame]) -> str:
    parts = [f"<h2>{title}</h2>" + (html_table(tables[k]) if k in tables and len(tables[k]) else "<p>No rows.</p>") for k, title in SECTIONS.items()]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(name)}</title></head><body><h1>{html.escape(name)}</h1>{''.join(parts)}</body></html>"


def latex_escape(s: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in s)


def latex_table(df: pd.DataFrame) -> str:
    rows = [" & ".join(latex_escape(text(v)) for v in r) + r" \\" for r in df.itertuples(index=False)]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * max(1, len(df.columns))}}}", " & ".join(latex_escape(str(c)) for c in df.columns) + r" \\ \hline", *rows, r"\end{tabular}", ""])


def svg(width: float, height: float, title: str, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-size="11" font-family="sans-serif"><text x="4" y="14" font-weight="bold">{html.escape(title)}</text>{body}</svg>'


def label(x: float, y: float, s: str, more: str = "") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" {more}>{html.escape(s[:44])}</text>'


def bars(values: list[tuple[str, float]], title: str) -> str:
    top = max((abs(v) for _, v in values), default=1.0) or 1.0
    rows = "".join(f'{label(4, 34 + 18 * i, k)}<rect x="260" y="{24 + 18 * i}" width="{280 * abs(v) / top:.1f}" height="12" fill="steelblue"/>{label(546, 34 + 18 * i, f"{v:.4g}")}' for i, (k, v) in enumerate(values))
    return svg(640, 40 + 18 * len(values), title, rows)


def curve(values: list[tuple[str, float]], title: str) -> str:
    """Points in order of the names, joined by a line, with an axis from 0 to the largest."""
    top, step = max((v for _, v in values), default=1.0) or 1.0, 560 / max(1, len(values))
    at = [(50 + step * (i + 0.5), 230 - 190 * max(v, 0.0) / top) for i, (_, v) in enumerate(values)]
    axis = f'<path d="M50 40V230H610" fill="none" stroke="black"/>{label(4, 44, f"{top:.3g}")}{label(30, 234, "0")}'
    dots = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="steelblue"/>{label(x, 246, k, f'transform="rotate(30 {x:.1f} 246)"')}' for (x, y), (k, _) in zip(at, values, strict=True))
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in at)
    return svg(640, 340, title, f'{axis}<polyline points="{line}" fill="none" stroke="steelblue"/>{dots}')


def heatmap(df: pd.DataFrame, title: str) -> str:
    """Estimators by metrics, each cell shaded from the least to the largest mean value."""
    grid = df.dropna(subset=["value"]).pivot_table(index="estimator_name", columns="metric_name", values="value", aggfunc="mean").fillna(0.0)
    low, high = float(grid.to_numpy().min()), float(grid.to_numpy().max())
    shade = lambda v: int(235 - 190 * (v - low) / ((high - low) or 1.0))
    cells = []
    for i, (name, row) in enumerate(grid.iterrows()):
        cells.append(label(4, 126 + 20 * i, str(name)))
        cells += [f'<rect x="{270 + 90 * j}" y="{112 + 20 * i}" width="88" height="18" fill="rgb({shade(v)},{shade(v)},245)"/>{label(276 + 90 * j, 126 + 20 * i, f"{v:.3g}")}' for j, v in enumerate(row)]
    heads = "".join(label(274 + 90 * j, 106, str(c), f'transform="rotate(-25 {274 + 90 * j} 106)"') for j, c in enumerate(grid.columns))
    return svg(290 + 90 * len(grid.columns) + 60, 130 + 20 * len(grid), title, heads + "".join(cells))


def intervals(df: pd.DataFrame, title: str) -> str:
    """A value with its interval on each line."""
    low, high = float(df[["value", "ci_low"]].min().min()), float(df[["value", "ci_high"]].max().max())
    x = lambda v: 300 + 320 * (v - low) / ((high - low) or 1.0)
    rows = "".join(f'{label(4, 34 + 16 * i, f"{r.estimator_name}:{r.metric_name}")}<line x1="{x(r.ci_low):.1f}" x2="{x(r.ci_high):.1f}" y1="{30 + 16 * i}" y2="{30 + 16 * i}" stroke="steelblue"/><circle cx="{x(r.value):.1f}" cy="{30 + 16 * i}" r="3"/>' for i, r in enumerate(df.itertuples()))
    foot = 40 + 16 * len(df)
    return svg(660, foot + 16, title, rows + label(300, foot, f"{low:.3g}") + label(600, foot, f"{high:.3g}"))


def figure(name: str, tables: dict[str, pd.DataFrame]) -> str | None:
    """A figure as SVG; None if it is unknown or has no data."""
    mean = lambda df, by: [(str(k), float(v)) for k, v in df.dropna(subset=["value"]).groupby(by)["value"].mean().items()]
    if name == "degradation_curve" and "stress_metrics" in tables:
        df = tables["stress_metrics"]
        data = mean(df[df.metric_name.isin(DEGRADATION)], "contamination_operator")
        return curve(data, "Stress degradation: mean metric value by contamination") if data else None
    if name in ("disagreement_heatmap", "sensitivity_heatmap"):
        df = tables["estimator_disagreement" if name.startswith("d") else "scale_window_sensitivity"]
        df = df[(df.scope == "aggregate") & df.value.notna()]
        return heatmap(df, "Estimator disagreement" if name.startswith("d") else "Sensitivity to scales and windows") if len(df) else None
    if name == "benchmark_uncertainty_intervals":
        df = tables["benchmark_uncertainty"].dropna(subset=["value", "ci_low", "ci_high"]).head(30)
        return intervals(df, "Benchmark uncertainty intervals") if len(df) else None
    if name == "false_positive_lrd":
        df = tables["per_stratum_metrics"]
        df = df[(df.metric_name == "false_positive_lrd_rate") & (df.stratum_json == GLOBAL)]
        data = sorted(mean(df, "estimator_name"), key=lambda kv: kv[1])
        return bars(data, "False-positive rate of long-range dependence") if data else None
    return None
