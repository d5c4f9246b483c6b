"""A bidirectional LSTM over characters with a CRF on top, in NumPy: training by Adam on tagged windows, decoding by Viterbi."""

from __future__ import annotations

import numpy as np

# Character classes: 0 is padding, then letters, digits, white space, others; the rest are single marks.
MARKS = "@.+-()_%:/,;=#*&|\"'<>[]!?"
N_CLASSES = 7 + len(MARKS)
FORBIDDEN = -1e4


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point."""
    table = np.full(129, 6, np.uint8)  # any other ASCII sign, and at 128 everything beyond
    table[97:123], table[65:91], table[48:58], table[[32]], table[9:14], table[128] = 1, 2, 3, 4, 5, 1
    for i, mark in enumerate(MARKS):
        table[ord(mark)] = 7 + i
    return table[np.minimum(codes, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new(kinds: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights; the tags are O, then B and I of each kind."""
    rng, tags = np.random.default_rng(seed), 1 + 2 * kinds
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
        w[f"h{d}"] = rng.normal(0, 0.3, (hidden, 4 * hidden))
        w[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    w["out"], w["bias"], w["step"] = rng.normal(0, 0.3, (2 * hidden, tags)), np.zeros(tags), np.zeros((tags, tags))
    return w


def allowed(tags: int) -> np.ndarray:
    """0 where the second tag may follow the first, FORBIDDEN where an inner tag has no beginning; row ``tags`` is the start."""
    out = np.zeros((tags + 1, tags))
    for inner in range(2, tags, 2):
        out[:, inner] = FORBIDDEN
        out[[inner - 1, inner], inner] = 0
    return out


def _layer(w, d, x):
    """Hidden states of one direction, with what the gradient needs; x is (time, batch)."""
    t, n, h = *x.shape, w[f"h{d}"].shape[0]
    given = (w[f"x{d}"] + w[f"b{d}"])[x]
    state, cell, out, kept = np.zeros((n, h)), np.zeros((n, h)), np.empty((t, n, h)), []
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        z = given[k] + state @ w[f"h{d}"]
        gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        fresh = gates[:, h : 2 * h] * cell + gates[:, :h] * g
        squash = np.tanh(fresh)
        kept.append((k, gates, g, cell, state, squash))
        cell, state = fresh, gates[:, 2 * h :] * squash
        out[k] = state
    return out, kept


def emissions(w: dict[str, np.ndarray], x: np.ndarray):
    f, kf = _layer(w, "f", x)
    b, kb = _layer(w, "b", x)
    both = np.concatenate([f, b], axis=2)
    return both @ w["out"] + w["bias"], both, kf, kb


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of tags y for classes x, both (time, batch), and its gradient."""
    e, both, kf, kb = emissions(w, x)
    t, n, tags = e.shape
    rule = allowed(tags)
    step = w["step"] + rule[:tags]
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[0] = e[0] + rule[tags]
    for k in range(1, t):
        ahead[k] = e[k] + _logsum(ahead[k - 1][:, :, None] + step, 1)
    for k in range(t - 2, -1, -1):
        behind[k] = _logsum(step + (e[k + 1] + behind[k + 1])[:, None, :], 2)
    total = _logsum(ahead[-1], 1)
    de = np.exp(ahead + behind - total[:, None])
    pair = np.exp(ahead[:-1][:, :, :, None] + step + (e[1:] + behind[1:])[:, :, None, :] - total[:, None, None]).sum(axis=(0, 1))
    at_t, at_n = np.arange(t)[:, None], np.arange(n)
    gold = e[at_t, at_n, y].sum() + step[y[:-1], y[1:]].sum()
    de[at_t, at_n, y] -= 1
    np.subtract.at(pair, (y[:-1], y[1:]), 1)
    de /= n
    g = {"step": pair / n, "bias": de.sum(axis=(0, 1)), "out": both.reshape(t * n, -1).T @ de.reshape(t * n, -1)}
    d_both = de @ w["out"].T
    h = w["hf"].shape[0]
    for d, kept, d_out in (("f", kf, d_both[:, :, :h]), ("b", kb, d_both[:, :, h:])):
        d_state, d_cell = np.zeros((n, h)), np.zeros((n, h))
        gx, gh = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"])
        for k, gates, inner, cell, state, squash in reversed(kept):
            d_now = d_out[k] + d_state
            d_cell = d_cell + d_now * gates[:, 2 * h :] * (1 - squash**2)
            dz = np.concatenate([d_cell * inner, d_cell * cell, d_now * squash, d_cell * gates[:, :h]], axis=1)
            dz[:, : 3 * h] *= gates * (1 - gates)
            dz[:, 3 * h :] *= 1 - inner**2
            np.add.at(gx, x[k], dz)
            gh += state.T @ dz
            d_state, d_cell = dz @ w[f"h{d}"].T, d_cell * gates[:, h : 2 * h]
        g[f"x{d}"], g[f"h{d}"], g[f"b{d}"] = gx, gh, gx.sum(axis=0)
    return float((total.sum() - gold) / n), g


def train(x: np.ndarray, y: np.ndarray, kinds: int, hidden: int = 16, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7):
    """Weights fitted to windows x (n, time) of classes and their tags y."""
    w, rng = new(kinds, hidden, seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            _, g = gradient(w, x[some].T, y[some].T)
            step += 1
            norm = np.sqrt(sum((v**2).sum() for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def decode(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (n, time) of windows x (n, time) of classes, and the log odds of each tag against O at its place."""
    e, *_ = emissions(w, x.T)
    t, n, tags = e.shape
    rule = allowed(tags)
    step = w["step"] + rule[:tags]
    best, came = e[0] + rule[tags], np.empty((t, n, tags), np.int8)
    for k in range(1, t):
        ways = best[:, :, None] + step
        came[k] = ways.argmax(axis=1)
        best = ways.max(axis=1) + e[k]
    out = np.empty((t, n), np.int8)
    out[-1] = best.argmax(axis=1)
    for k in range(t - 1, 0, -1):
        out[k - 1] = came[k][np.arange(n), out[k]]
    odds = np.take_along_axis(e, out[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]
    return out.T, odds.T
