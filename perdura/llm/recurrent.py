"""A gated recurrent language model over word numbers, in numpy: forward, truncated backpropagation, scoring.

One gate decides how much of the state a step replaces. The softmax is factored: a class,
then a word of that class; classes are runs of the words by frequency. Documents run side
by side in lanes, one after the other in a lane; at a document's start the state is 0, and
from window to window it is carried on, so a document's score is that of all its tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Numbers: unknown word, end of text, then words by frequency.
UNKNOWN, END, FIRST = 0, 1, 2
STATE, CLASSES, PER_CLASS = 16, 32, 32
SIZE = CLASSES * PER_CLASS
#: Steps that are backpropagated through, lanes at once, and steps that are scored at once.
WINDOW, LANES, SCORED_STEPS, SCORED_LANES = 16, 512, 64, 1024
#: Windows whose tokens are laid out at once.
BLOCK = 16
CLIP, BETA1, BETA2 = 1.0, 0.9, 0.99
SHAPES = {"x": (SIZE, 2 * STATE), "u": (STATE, 2 * STATE), "c": (STATE, CLASSES), "cb": (CLASSES,), "w": (CLASSES, STATE, PER_CLASS), "wb": (CLASSES, PER_CLASS)}
WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())

Params = dict[str, np.ndarray]


def parts(flat: np.ndarray) -> Params:
    """The weights in a flat array, as views."""
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Small random weights, with biases that make the model the unigrams of counts (by number)."""
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(WEIGHTS) * 0.1).astype(np.float32)
    p = parts(flat)
    share = (counts + 0.5).reshape(CLASSES, PER_CLASS)
    p["cb"][:] = np.log(share.sum(axis=1) / share.sum())
    p["wb"][:] = np.log(share / share.sum(axis=1, keepdims=True))
    p["c"][:] *= 0.1
    p["w"][:] *= 0.1
    return flat


@dataclass
class Lanes:
    """Documents' token numbers dealt to lanes of about equal length, the longest first."""

    tokens: list[np.ndarray]
    docs: list[list[int]]

    @classmethod
    def of(cls, docs: list[np.ndarray], most: int) -> Lanes:
        sizes = np.array([len(d) for d in docs])
        heap = [(0, k) for k in range(max(1, min(most, len(docs))))]
        own: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-sizes, kind="stable").tolist():
            n, k = heap[0]
            heapq.heapreplace(heap, (n + int(sizes[i]), k))
            own[k].append(i)
        own = sorted((x for x in own if x), key=lambda x: -sum(int(sizes[i]) for i in x))
        return cls([np.concatenate([docs[i] for i in x]) for x in own], own)

    def windows(self, steps: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Start, inputs, targets (steps by lanes) and whether a target is there; lanes that have ended are left out."""
        lengths = np.array([len(t) for t in self.tokens])
        longest, block = int(lengths.max(initial=0)), steps * BLOCK
        for base in range(0, longest, block):
            wide = min(block, -(-(longest - base) // steps) * steps)
            active = int((lengths > base).sum())
            inputs = np.full((active, wide + 1), END, dtype=np.int16)  # one ahead of the targets
            for k in range(active):
                piece = self.tokens[k][max(0, base - 1) : base + wide]
                inputs[k, int(base == 0) : int(base == 0) + len(piece)] = piece
            for at in range(base, min(base + wide, longest), steps):
                n, x = int((lengths > at).sum()), at - base
                there = np.arange(at, at + steps)[:, None] < lengths[None, :n]
                yield at, np.ascontiguousarray(inputs[:n, x : x + steps].T), np.ascontiguousarray(inputs[:n, x + 1 : x + 1 + steps].T), there


def run_states(p: Params, inputs: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, ...]:
    """States after each step, from h; with keep also states before, gates and candidates. The end of text is
    the input of the next document's first step, whose state begins at 0."""
    steps, lanes = inputs.shape
    states, gates = np.empty((steps, lanes, STATE), dtype=np.float32), p["x"][inputs]
    before = np.empty_like(states) if keep else None
    fresh, u = inputs == END, p["u"]
    some = fresh.any(axis=1)
    for t in range(steps):
        if some[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        g = gates[t]
        g += h @ u
        np.tanh(g, out=g)
        z = g[:, :STATE]
        z *= 0.5
        z += 0.5
        if keep:
            before[t] = h
        d = g[:, STATE:] - h
        d *= z
        h = np.add(h, d, out=states[t])
    return states, before, gates, fresh


ONES = np.ones((PER_CLASS, 1), dtype=np.float32)


def by_class(targets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each class among targets, the places of its targets and their numbers in the class."""
    order = np.argsort(targets, kind="stable")
    cuts = np.searchsorted(targets[order], np.arange(CLASSES + 1) * PER_CLASS)
    for k in range(CLASSES):
        rows = order[cuts[k] : cuts[k + 1]]
        if len(rows):
            yield k, rows, targets[rows] - k * PER_CLASS


def exponents(s: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logit of each row's own column, and e to all logits with their sums; shifted only where e could overflow."""
    logits = s @ w
    logits += b
    if float(np.abs(w).sum(axis=0).max() + np.abs(b).max()) > 80:  # states lie between -1 and 1
        logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[np.arange(len(own)), own]
    np.exp(logits, out=logits)
    return chosen, logits, logits @ ONES


def log_probability(p: Params, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target, of its class and then in its class, as doubles."""
    chosen, _, total = exponents(states, p["c"], p["cb"], targets // PER_CLASS)
    out = chosen.astype(float) - np.log(total[:, 0])
    for k, rows, own in by_class(targets):
        chosen, _, total = exponents(states[rows], p["w"][k], p["wb"][k], own)
        out[rows] += chosen - np.log(total[:, 0])
    return out


def scores(flat: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document (token numbers, the last END)."""
    p, lanes = parts(flat), Lanes.of(docs, SCORED_LANES)
    found = [np.empty(len(t)) for t in lanes.tokens]
    h = np.zeros((len(found), STATE), dtype=np.float32)
    for at, inputs, targets, there in lanes.windows(SCORED_STEPS):
        states = run_states(p, inputs, h[: inputs.shape[1]])[0]
        h = states[-1]
        logs = log_probability(p, states.reshape(-1, STATE), targets.reshape(-1)).reshape(targets.shape)
        for k, n in enumerate(there.sum(axis=0).tolist()):
            found[k][at : at + n] = logs[:n, k]
    out = np.zeros(len(docs))
    for own, logs in zip(lanes.docs, found, strict=True):
        out[own] = np.add.reduceat(logs, np.cumsum([0] + [len(docs[i]) for i in own[:-1]]))
    return out


def gradient(p: Params, inputs: np.ndarray, targets: np.ndarray, there: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the mean loss of one window by backpropagation that ends at its start; the last state; the loss."""
    flat = np.zeros(WEIGHTS, dtype=np.float32)
    d = parts(flat)
    steps, lanes = inputs.shape
    states, before, gates, fresh = run_states(p, inputs, h, keep=True)
    s, y = states.reshape(-1, STATE), targets.reshape(-1)
    weight = (there.reshape(-1) / max(1, there.sum())).astype(np.float32)
    rows, which = np.arange(len(y)), y // PER_CLASS
    chosen, e, total = exponents(s, p["c"], p["cb"], which)
    loss = float((weight * (np.log(total[:, 0]) - chosen)).sum())
    e *= weight[:, None] / total
    e[rows, which] -= weight
    d["c"][:], d["cb"][:] = s.T @ e, e.sum(axis=0)
    out = e @ p["c"].T
    for k, some, own in by_class(y):
        x, mine = s[some], weight[some]
        chosen, e, total = exponents(x, p["w"][k], p["wb"][k], own)
        loss += float((mine * (np.log(total[:, 0]) - chosen)).sum())
        e *= mine[:, None] / total
        e[np.arange(len(some)), own] -= mine
        d["w"][k], d["wb"][k] = x.T @ e, e.sum(axis=0)
        out[some] += e @ p["w"][k].T
    out = out.reshape(steps, lanes, STATE)
    slopes = np.empty_like(gates)
    z, b = gates[:, :, :STATE], gates[:, :, STATE:]
    to_z, to_b = (b - before) * (2 * z * (1 - z)), z * (1 - b * b)
    ut, back = np.ascontiguousarray(p["u"].T), np.zeros((lanes, STATE), dtype=np.float32)
    keep, some = 1 - z, fresh.any(axis=1)
    for t in range(steps - 1, -1, -1):
        back += out[t]
        g = slopes[t]
        np.multiply(back, to_z[t], out=g[:, :STATE])
        np.multiply(back, to_b[t], out=g[:, STATE:])
        back *= keep[t]
        back += g @ ut
        if some[t]:
            back[fresh[t]] = 0
    g = slopes.reshape(-1, 2 * STATE)
    d["u"][:] = before.reshape(-1, STATE).T @ g
    ids = inputs.reshape(-1)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    d["x"][ids[order[first]]] = np.add.reduceat(g[order], first, axis=0)
    return flat, states[-1], loss


def train(flat: np.ndarray, docs: list[np.ndarray], rate: float, lanes: int = LANES, updates: int = 64) -> np.ndarray:
    """New weights after one pass over docs: fewer lanes where docs are few, for about so many updates at least. Whole documents, all of them."""
    total = sum(map(len, docs))
    flat = flat.copy()
    p, m, v, n = parts(flat), np.zeros_like(flat), np.zeros_like(flat), 0
    dealt = Lanes.of(docs, max(1, min(lanes, total // (WINDOW * updates))))
    h = np.zeros((len(dealt.tokens), STATE), dtype=np.float32)
    whole = max(1, len(dealt.tokens))
    for _, inputs, targets, there in dealt.windows(WINDOW):
        g, h, _ = gradient(p, inputs, targets, there, h[: inputs.shape[1]])
        g *= min(1.0, CLIP / (float(np.sqrt(g @ g)) + 1e-12))
        n += 1
        m += (1 - BETA1) * (g - m)
        v += (1 - BETA2) * (g * g - v)
        step = rate * min(1.0, inputs.shape[1] / whole)  # a window of a few lanes weighs by its tokens
        flat -= step / (1 - BETA1**n) * m / (np.sqrt(v / (1 - BETA2**n)) + 1e-8)
    return flat
