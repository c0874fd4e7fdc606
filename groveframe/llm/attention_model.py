"""A small causal self-attention model over subword ids, in numpy: forward pass, gradients, training, window scoring.

One layer, one head. The model predicts the group of the next subword: its output is added, as logits, to what the subwords of
the word so far say of the group (``prior``, a row of probabilities for each context), so the attention has to learn what earlier
words say: language, topic, style. Everything is float32.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .spelling import INNER, STARTS

#: Model width, attention width, hidden width, groups of subwords; window length and step; input ids.
D, DK, HIDDEN, GROUPS = 32, 8, 32, STARTS + INNER
WINDOW, STRIDE = 24, 20
INPUTS = 1024
PAD = INPUTS  # input only: before the start of a text


def init(seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters; the output starts at zero, so an untrained model is its prior."""
    rng = np.random.default_rng(seed)

    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    return {
        "E": (0.3 * rng.standard_normal((INPUTS + 1, D))).astype(np.float32), "P": (0.1 * rng.standard_normal((WINDOW, D))).astype(np.float32),
        "Q": normal(D, DK) / np.float32(np.sqrt(DK)), "K": normal(D, DK), "V": 0.5 * normal(D, D), "W1": normal(D, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "W2": 0.3 * normal(HIDDEN, D),
        "U": np.zeros((D, GROUPS), np.float32),
    }


MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Windows that are trained on at once, and scored at once: there what they need stays in the cache.
AT_ONCE, SCORED_AT_ONCE = 256, 64


class Buffers:
    """Arrays of a kind that keep their memory from one block of windows to the next."""

    def __init__(self, dtype=np.float32):
        self.dtype, self.kept = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or self.kept[name].size < size:
            self.kept[name] = np.empty(size, self.dtype)
        return self.kept[name][:size].reshape(shape)

    def ones(self, n: int) -> np.ndarray:
        if "ones" not in self.kept or self.kept["ones"].size < n:
            self.kept["ones"] = np.ones(n, self.dtype)
        return self.kept["ones"][:n]


def joined(p: dict[str, np.ndarray]) -> np.ndarray:
    """Queries, keys and values as one product."""
    return np.concatenate([p["Q"], p["K"], p["V"]], 1)


def body(p: dict[str, np.ndarray], qkv: np.ndarray, ids: np.ndarray, skip: int, new: Buffers) -> tuple[np.ndarray, tuple]:
    """Hidden states (windows, places, D) of input ids from place ``skip`` on, and what the gradients need."""
    n, m = len(ids), WINDOW - skip
    x = np.take(p["E"], ids, 0, out=new("x", n, WINDOW, D), mode="clip")
    x += p["P"]
    # one product for all windows: many small ones cost more
    y = np.matmul(x.reshape(-1, D), qkv, out=new("y", n * WINDOW, 2 * DK + D)).reshape(n, WINDOW, -1)
    a = np.matmul(y[:, skip:, :DK], y[:, :, DK : 2 * DK].transpose(0, 2, 1), out=new("a", n, m, WINDOW))
    np.minimum(a, 30, out=a)
    np.exp(a, out=a)
    a *= MASK[skip:]
    a *= (1 / (a.reshape(-1, WINDOW) @ new.ones(WINDOW))).reshape(n, m, 1)
    h1 = np.matmul(a, y[:, :, 2 * DK :], out=new("h1", n, m, D))
    h1 += x[:, skip:]
    f = np.matmul(h1.reshape(-1, D), p["W1"], out=new("f", n * m, HIDDEN))
    f += p["b1"]
    np.maximum(f, 0, out=f)
    h2 = np.matmul(f, p["W2"], out=new("h2", n * m, D)).reshape(n, m, D)
    h2 += h1
    return h2, (x, y, a, h1, f)


def blocks(take: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, int]]:
    """Windows to go through at once, and the places at their start that none of them counts: there nothing but keys and values is needed."""
    later = ~take[:, : WINDOW - STRIDE].any(1)
    for some, skip in ((np.flatnonzero(~later), 0), (np.flatnonzero(later), WINDOW - STRIDE)):
        for i in range(0, len(some), at_once):
            yield some[i : i + at_once], skip


@dataclass
class Windows:
    """Overlapping windows of several texts: places of the inputs and targets in the flat sequence, which positions count."""

    at: np.ndarray
    take: np.ndarray


def windows(lengths: np.ndarray) -> Windows:
    """Windows over texts that lie one after another. Every position is a target exactly once.

    A window after the first of a text repeats WINDOW - STRIDE positions of the one before it, as context only.
    """
    counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    size, base = lengths[text][:, None], (np.cumsum(lengths) - lengths)[text][:, None]
    take = (at < size) & ((nth == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    return Windows(base + np.minimum(at, size - 1), take)


def sums_by_id(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each of ``n`` ids; in runs of equal ids, since adding row by row costs more."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(ids.astype(np.int16) if n <= 1 << 15 else ids, kind="stable")  # few bits sort in few passes
    ids = ids.take(order)
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out[ids[starts]] = np.add.reduceat(rows.take(order, 0), starts)
    return out


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, take: np.ndarray, prior, groups: np.ndarray, new: Buffers | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the taken positions and its gradient; ``prior`` has rows for them, or gives those of some of them."""
    new = new or Buffers(p["E"].dtype)
    qkv, total, e_type = joined(p), len(groups), p["U"].dtype.type
    g = {k: np.zeros_like(p[k]) for k in ("P", "W1", "b1", "W2", "U")}
    d_qkv, dx_all, loss = np.zeros_like(qkv), new("dx", len(ids), WINDOW, D), 0.0
    number = np.maximum(np.cumsum(take).reshape(take.shape) - 1, 0)  # places that don't count go along with a weight of nothing
    w1t, w2t, ut, qkvt = p["W1"].T, p["W2"].T, p["U"].T, qkv.T
    for some, skip in blocks(take, AT_ONCE):
        n, m = len(some), WINDOW - skip
        h2, (x, y, a, h1, f) = body(p, qkv, ids[some], skip, new)
        h2, h1 = h2.reshape(-1, D), h1.reshape(-1, D)
        weight = take[some, skip:].ravel().astype(e_type) / e_type(total)
        places = number[some, skip:].ravel()
        at_target = np.arange(n * m) * GROUPS + groups[places]
        e = np.matmul(h2, p["U"], out=new("e", n * m, GROUPS))
        np.clip(e, -30, 30, out=e)
        np.exp(e, out=e)
        e *= prior(places) if callable(prior) else prior[places]
        sums, flat = e @ new.ones(GROUPS), e.ravel()
        loss -= float(np.log(flat[at_target] / sums) @ weight)
        e *= (weight / sums)[:, None]
        flat[at_target] -= weight
        g["U"] += h2.T @ e
        dh2 = np.matmul(e, ut, out=new("dh2", n * m, D))
        df = np.matmul(dh2, w2t, out=new("df", n * m, HIDDEN))
        df *= f > 0
        g["W2"] += f.T @ dh2
        g["W1"] += h1.T @ df
        g["b1"] += new.ones(n * m) @ df
        dh1 = np.matmul(df, w1t, out=new("dh1", n * m, D))
        dh1 += dh2
        dh1 = dh1.reshape(n, m, D)
        q, k, v, at = y[:, skip:, :DK], y[:, :, DK : 2 * DK], y[:, :, 2 * DK :], a.transpose(0, 2, 1)
        dy = new("dy", n, WINDOW, 2 * DK + D)
        np.matmul(at, dh1, out=dy[:, :, 2 * DK :])
        ds = np.matmul(dh1, v.transpose(0, 2, 1), out=new("ds", n, m, WINDOW))
        ds *= a
        part = ds.reshape(-1, WINDOW) @ new.ones(WINDOW)
        a *= part.reshape(n, m, 1)
        ds -= a
        dy[:, :skip, :DK] = 0
        np.matmul(ds, k, out=dy[:, skip:, :DK])
        np.matmul(ds.transpose(0, 2, 1), q, out=dy[:, :, DK : 2 * DK])
        dy = dy.reshape(-1, 2 * DK + D)
        d_qkv += x.reshape(-1, D).T @ dy
        dx = np.matmul(dy, qkvt, out=new("dx_some", n * WINDOW, D)).reshape(n, WINDOW, D)
        dx[:, skip:] += dh1
        g["P"] += (new.ones(n) @ dx.reshape(n, -1)).reshape(WINDOW, D)
        dx_all[some] = dx
    g["Q"], g["K"], g["V"] = d_qkv[:, :DK], d_qkv[:, DK : 2 * DK], d_qkv[:, 2 * DK :]
    g["E"] = sums_by_id(ids.ravel(), dx_all.reshape(-1, D), len(p["E"]))
    return loss, g


@dataclass
class Sequence:
    """Texts one after another, an entry for each subword and each end of a text: the id before it, its context, its group."""

    ids: np.ndarray
    contexts: np.ndarray
    groups: np.ndarray
    lengths: np.ndarray


class Learner:
    """Adam from given parameters on."""

    def __init__(self, p: dict[str, np.ndarray]):
        # all parameters lie in one array, of which those by name are views
        self.flat, self.p, self.steps, self.new, at = np.concatenate([v.ravel() for v in p.values()]), {}, 0, Buffers(), 0
        for k, v in p.items():
            self.p[k] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size
        self.m, self.s = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        m, s = self.m, self.s
        self.steps += 1
        g = np.concatenate([g[k].ravel() for k in self.p])
        m += 0.1 * (g - m)
        g *= g
        g -= s
        g *= 0.01
        s += g
        size = np.sqrt(s * np.float32(1 / (1 - 0.99**self.steps)))
        size += 1e-8
        np.divide(m, size, out=size)
        size *= rate / (1 - 0.9**self.steps)
        self.flat -= size

    def learn(self, sequence: Sequence, w: Windows, some: np.ndarray, prior_of, rate: float) -> None:
        """A step over some windows."""
        at, take = w.at[some], w.take[some]
        places = at[take]
        self.step(gradients(self.p, sequence.ids[at], take, lambda i: prior_of(places[i]), sequence.groups[places], self.new)[1], rate)

    def go_through(self, sequence: Sequence, prior_of, batch: int = 256, rate: float = 0.002, seed: int = 5) -> int:
        """Steps over all windows, each once, in mixed order; returns their number."""
        w = windows(sequence.lengths)
        order = np.random.default_rng(seed).permutation(len(w.at))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            self.learn(sequence, w, some, prior_of, rate * min(1.0, len(some) / batch))
        return len(order)


def train(sequence: Sequence, prior_of, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over random windows; ``prior_of(places)`` gives the prior of places of the sequence, without what they add to it."""
    p = init(seed)
    if not len(sequence.groups):
        return p
    w, rng, learner = windows(sequence.lengths), np.random.default_rng(seed), Learner(p)
    for step in range(1, steps + 1):
        learner.learn(sequence, w, rng.integers(0, len(w.at), batch), prior_of, rate * (1 - step / (steps + 1)))
    return learner.p


def score_texts(p: dict[str, np.ndarray], sequence: Sequence, prior: np.ndarray) -> np.ndarray:
    """Natural log probability of the groups of each text."""
    w, new, qkv = windows(sequence.lengths), Buffers(), joined(p)
    out = np.empty(len(sequence.groups), np.float32)
    for some, skip in blocks(w.take, SCORED_AT_ONCE):
        at = w.at[some]
        h = body(p, qkv, sequence.ids[at], skip, new)[0].reshape(-1, D)
        here, places = w.take[some, skip:].ravel(), at[:, skip:].ravel()
        e = np.matmul(h, p["U"], out=new("e", len(h), GROUPS))
        np.minimum(e, 30, out=e)
        np.exp(e, out=e)
        e *= np.take(prior, sequence.contexts[places], 0, out=new("prior", len(h), GROUPS), mode="clip")
        at_target = np.arange(len(h)) * GROUPS + sequence.groups[places]
        out[places[here]] = np.log(np.maximum(e.ravel()[at_target], 1e-30) / (e @ new.ones(GROUPS)))[here]
    owner = np.repeat(np.arange(len(sequence.lengths)), sequence.lengths)
    return np.bincount(owner, out, len(sequence.lengths))
