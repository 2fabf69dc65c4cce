"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in a cycle over the features, each on the histogram of one
feature's bins, and add up to a lookup table per feature; then the pairs of features
whose residuals gain most get tables of their own in the same way. Scoring adds the
entries of a text's bins.

The model is fitted on at most MAX_LABELLED labelled rows, those of the smallest id
hashes; every text is scored whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.common import crc_mod, map_rows

MAX_LABELLED = 20_000
MAX_BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, N_PAIRS, RATE, LEAVES = 32, 8, 120, 40, 8, 0.15, 3

FEATURES = ["chars", "words", "word_length", "upper", "digits", "symbols", "exclaims", "pipes", "stops", "distinct_words", "repeated_lines", "words_per_line", "short_words", "not_ascii", "repeated_pairs", "longest_word"]
UPPER, DIGITS, SYMBOLS, STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>{}[]\\^~_=@/", b".,;:"


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all 0 for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda some: (len(raw) - len(raw.translate(None, some))) / n
    pairs = set(zip(words, words[1:], strict=False))
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        sum(map(len, words)) / m,
        share(UPPER),
        share(DIGITS),
        share(SYMBOLS),
        share(b"!?"),
        share(b"|"),
        share(STOPS),
        len(set(words)) / m,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        math.log1p(len(words) / max(1, len(lines))),
        sum(len(w) <= 3 for w in words) / m,
        0.0 if raw.isascii() else (len(raw) - len(text)) / n,
        1 - len(pairs) / (m - 1) if m > 1 else 0.0,
        math.log1p(max(map(len, words), default=0)),
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps for each bin from a tree of up to LEAVES leaves on gradient and hessian sums by bin."""
    leaves = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, b in leaves:
            if b - a > 1:
                k = np.arange(a + 1, b)
                win = gain(cg[k] - cg[a], ch[k] - ch[a]) + gain(cg[b] - cg[k], ch[b] - ch[k]) - gain(cg[b] - cg[a], ch[b] - ch[a])
                i = int(win.argmax())
                if win[i] > best[0]:
                    best = (win[i], (a, int(k[i]), b))
        if best[1] is None:
            break
        a, k, b = best[1]
        leaves.remove((a, b))
        leaves += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree of two crossing cuts on a grid of sums."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    r, c = g.shape
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, r), np.arange(1, c), indexing="ij")) if r > 1 and c > 1 else (np.array([], int), np.array([], int))
    if not len(i):
        return 0.0, np.zeros_like(g)

    def quarters(s: np.ndarray) -> list[np.ndarray]:
        return [s[i, j], s[i, c] - s[i, j], s[r, j] - s[i, j], s[r, c] - s[i, c] - s[r, j] + s[i, j]]

    qg, qh = quarters(cg), quarters(ch)
    total = sum(gain(a, b) for a, b in zip(qg, qh, strict=True))
    k = int(total.argmax())
    out = np.empty_like(g)
    steps = [float(a[k] / (b[k] + 1.0)) for a, b in zip(qg, qh, strict=True)]
    out[: i[k], : j[k]], out[: i[k], j[k] :], out[i[k] :, : j[k]], out[i[k] :, j[k] :] = steps
    return float(total[k]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits on features and 0/1 labels; with labels of one kind or none, a constant near their share."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(math.log(p / (1 - p)))
    p = y.mean()
    model = Model(float(math.log(p / (1 - p))))
    n_features = x.shape[1]
    model.edges = [cuts(x[:, j], MAX_BINS) for j in range(n_features)]
    model.pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(n_features)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j in range(n_features):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            f += step[bins[j]]

    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * shape[j] + wide[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    ranked = sorted(((pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(n_features) for j in range(i + 1, n_features)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:N_PAIRS]]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * pair_tree(grid(i, j, g), grid(i, j, h))[1]
            t += step
            f += step[wide[i], wide[j]]
    return model


def matrix(values: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in values]).reshape(len(values), len(FEATURES))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most limit labelled rows outside the held-out fold, by smallest id hash."""
    usable = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(crc_mod(F.col("doc_id"), folds) != held)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # limit bounds what is broadcast

    def batch(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "quality": b.column("quality").cast(pa.int32()), "x": list(matrix(b.column("text").to_pylist()))}

    got = map_rows(rows.select("doc_id", "text", "quality"), "doc_id long, quality int, x array<double>", batch).toArrow()
    order = np.lexsort((got.column("quality").to_numpy(), got.column("doc_id").to_numpy()))
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(got.num_rows, len(FEATURES))
    return x[order], got.column("quality").to_numpy().astype(float)[order]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, quality); other columns of both are ignored.

    Rows of labels with a null doc_id or a quality other than 0 and 1, or of a document that
    is not there, are left out. A repeated label, or a document with several rows, counts as
    often as it is there. A null text is an empty one. Without labels, or with labels of one
    kind, the model is a constant.
    """
    return fit(*labelled_sample(docs, labels))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold). Narrow: no shuffle.

    Null and empty texts are scored as texts without a word. Columns named score or
    predicted are replaced; other columns and repeated rows stay.
    """
    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int"

    def batch(b: pa.RecordBatch) -> dict:
        s = model.score(matrix(b.column("text").to_pylist()))
        return {n: b.column(n) for n in b.schema.names} | {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_rows(kept, schema, batch)
