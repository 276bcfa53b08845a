"""The attention's step and scores written plainly, each formula by itself: what the package's faster forms are held against."""

from __future__ import annotations

import numpy as np

from termlake.llm.attention import _APART, _SEEN, BRANCH, CLASSES, DIM, FRESH, START, WINDOW, Model, _held


def _shares(logits: np.ndarray) -> np.ndarray:
    """Softmax of rows; logits over 60 count as 60."""
    np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    logits /= logits @ np.ones((logits.shape[1], 1), np.float32) + 1e-30
    return logits


class Fitting:
    """Weights that Adam changes batch by batch; the ids' own vectors by AdaGrad, only those that a batch holds."""

    def __init__(self, weights: dict[str, np.ndarray], kind: np.ndarray, priors: tuple[np.ndarray, np.ndarray]):
        self.w, self.kind, self.priors, self.t = {k: x.copy() for k, x in weights.items()}, np.append(kind, START).astype(np.int32), priors, 0
        dense = [k for k in weights if k != "own"]
        self.m, self.s = ({k: np.zeros_like(weights[k]) for k in dense} for _ in range(2))
        self.moved = np.full(len(weights["own"]), 1e-4, np.float32)

    def step(self, own: np.ndarray, lr: float) -> None:
        """One step on windows (n, WINDOW + 1) of ids, -1 behind a text's end."""
        w = self.w
        ids, after = np.maximum(own[:, :-1], 0).ravel(), own[:, 1:].ravel()
        x, real = self.kind[ids], after >= 0
        y = self.kind[np.maximum(after, 0)]
        shape = (len(own), WINDOW, DIM)
        v = w["embed"][x] + w["own"][ids]
        q, k, val = _held(v @ w["q"]).reshape(shape), _held(v @ w["k"]).reshape(shape), (v @ w["v"]).reshape(shape)
        att = q @ k.transpose(0, 2, 1)
        np.exp(att, out=att)
        att *= _SEEN * np.exp(w["apart"])[_APART]
        att /= att.sum(axis=2, keepdims=True)
        o = (att @ val).reshape(-1, DIM)
        h = v + o @ w["o"]
        scale = (real / max(1, real.sum())).astype(np.float32)
        # which group
        group, inner = y // BRANCH, y % BRANCH
        p = _shares(h @ w["out"] + self.priors[0][x])
        p[np.arange(len(p)), group] -= 1
        p *= scale[:, None]
        g = {"out": h.T @ p, "inner": np.zeros_like(w["inner"])}
        dh = p @ w["out"].T
        # which class of the group: rows of one group together
        order = np.argsort(group, kind="stable")
        begins = np.searchsorted(group[order], np.arange(len(w["inner"]) + 1))
        for c in np.flatnonzero(np.diff(begins)).tolist():
            at = order[begins[c] : begins[c + 1]]
            hc = h[at]
            p = _shares(hc @ w["inner"][c] + self.priors[1][c][x[at]])
            p[np.arange(len(p)), inner[at]] -= 1
            p *= scale[at, None]
            g["inner"][c] = hc.T @ p
            dh[at] += p @ w["inner"][c].T
        g["o"] = o.T @ dh
        do = (dh @ w["o"].T).reshape(shape)
        datt = do @ val.transpose(0, 2, 1)
        dval = (att.transpose(0, 2, 1) @ do).reshape(-1, DIM)
        ds = att * (datt - (datt * att).sum(axis=2, keepdims=True))
        dq, dk = (ds @ k).reshape(-1, DIM), (ds.transpose(0, 2, 1) @ q).reshape(-1, DIM)
        g["q"], g["k"], g["v"] = v.T @ dq, v.T @ dk, v.T @ dval
        g["apart"] = np.bincount(_APART.ravel(), (ds.sum(axis=0) * _SEEN).ravel(), WINDOW)
        dv = dh + dq @ w["q"].T + dk @ w["k"].T + dval @ w["v"].T
        # sums by id, stretch by stretch of rows in order; then those of the ids of a class
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        rows, sums = ids[order][first], np.add.reduceat(dv[order], first, axis=0)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], self.kind[rows], sums)
        self.moved[rows] += np.einsum("ij,ij->i", sums, sums)
        w["own"][rows] -= (5 * lr / np.sqrt(self.moved[rows]))[:, None] * sums
        self.t += 1
        for name, grad in g.items():
            m, s = self.m[name], self.s[name]
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            w[name] -= (lr * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def _tables(model: Model) -> np.ndarray:
    """With one layer, what an id puts in depends on itself alone: query, key, value through the output matrix, a one (which sums up
    the weights in the same product) and its own vector, for each id and the place before a text."""
    w = model.weights
    v = w["embed"][np.append(model.kind, START)] + w["own"]
    return np.concatenate([_held(v @ w["q"]), _held(v @ w["k"]), v @ w["v"] @ w["o"], np.ones((len(v), 1), np.float32), v], axis=1)


def log_probability(model: Model, ids: np.ndarray, sizes: np.ndarray, most: int = 160) -> np.ndarray:
    """Natural log-probability of each token id of sequences of the given sizes, one after the other.

    The first window of a sequence scores all its tokens, each later one only its last FRESH: every token is scored
    once, and but for a sequence's beginning after at least WINDOW - FRESH + 1 others.
    """
    if not len(ids):
        return np.zeros(0)
    if "tables" not in model.__dict__:
        model.tables = _tables(model)
    parts, (to_group, to_class) = model.tables, model.priors
    kind, w = model.kind[ids], model.weights
    seen = _SEEN * np.exp(w["apart"])[_APART]
    # inputs: the place before a text, then the ids but for the last
    begin = np.cumsum(sizes) - sizes
    fed = np.concatenate(([len(model.kind)], ids[:-1])).astype(np.int64)
    fed[begin[sizes > 0]] = len(model.kind)
    before = np.concatenate(([START], kind[:-1])).astype(np.int32)
    before[begin[sizes > 0]] = START
    place = model.place[ids]
    out = np.where(place >= 0, model.after[before, place], model.share[ids] + model.left[before, kind])
    windows = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // FRESH)), 0)
    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(sizes)), windows)
    no = np.arange(int(windows.sum())) - first[owner]
    at = begin[owner] + no * FRESH
    end = (begin + sizes)[owner]
    old = np.where(no > 0, WINDOW - FRESH, 0)
    steps = np.arange(WINDOW)
    last = len(before) - 1
    for a in range(0, len(at), most):
        spots = at[a : a + most, None] + steps
        scored = (spots < end[a : a + most, None]) & (steps >= old[a : a + most, None])
        own = parts[fed[np.minimum(spots, last)]]
        s = own[..., :DIM] @ own[..., DIM : 2 * DIM].transpose(0, 2, 1)
        np.exp(s, out=s)
        s *= seen
        o = (s @ own[..., 2 * DIM : 3 * DIM + 1])[scored]
        picked = spots[scored]
        h = o[:, :DIM] / o[:, DIM:] + own[..., 3 * DIM + 1 :][scored]
        x, y = before[picked], kind[picked]
        group = y // BRANCH
        # rows of one group together
        order = np.argsort(group, kind="stable")
        h, x, y, picked = h[order], x[order], y[order], picked[order]
        begins = np.searchsorted(group[order], np.arange(CLASSES // BRANCH + 1)).tolist()
        logits = h @ w["out"] + to_group[x]
        ones = np.ones(BRANCH, np.float32)
        got = logits[np.arange(len(y)), y // BRANCH] - np.log(np.exp(logits) @ ones)
        for c in range(CLASSES // BRANCH):
            b, e = begins[c], begins[c + 1]
            if b < e:
                logits = h[b:e] @ w["inner"][c] + to_class[c][x[b:e]]
                got[b:e] += logits[np.arange(e - b), y[b:e] % BRANCH] - np.log(np.exp(logits) @ ones)
        out[picked] += got
    return out
