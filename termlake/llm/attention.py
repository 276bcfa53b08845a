"""A small causal self-attention model over subword ids, trained and run in numpy.

One head reads a window of `WINDOW` ids. An id's vector is that of its class and one of its own; scores depend on queries, keys and
the distance. What comes out, added to the id's own vector, corrects the logits of a fixed bigram table. The next id is told in three
steps: a group of classes, a class of that group (a softmax of `BRANCH` each, so no step looks at all classes), then which id of
the class, by corpus counts behind the class before. A class is a frequent id or a band of rarer ones with like counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WINDOW, FRESH, DIM = 32, 24, 24
SINGLES, BANDS = 224, 32
CLASSES = SINGLES + BANDS
#: Classes of a group, and groups.
BRANCH = 16
#: Class of the place before a text.
START = CLASSES


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token id, natural log of its share of its class) from corpus counts."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    kind = np.empty(len(counts), np.int32)
    kind[order[:SINGLES]] = np.arange(min(SINGLES, len(counts)))
    rest = order[SINGLES:]
    mass = np.cumsum(counts[rest] + 0.5)
    kind[rest] = SINGLES + np.minimum(BANDS - 1, (mass / mass[-1] * BANDS).astype(np.int32)) if len(rest) else kind[rest]
    weight = counts + 0.5
    share = np.log(weight) - np.log(np.bincount(kind, weight, CLASSES))[kind]
    return kind, share.astype(np.float32)


@dataclass
class Model:
    kind: np.ndarray  # class of each id
    share: np.ndarray  # log of each id's share of its class
    priors: tuple[np.ndarray, np.ndarray]  # log-probabilities of a group, and of a class in its group, behind a class
    place: np.ndarray  # of each id in the columns of `after`
    after: np.ndarray  # log-probability of an id in its class behind a class
    left: np.ndarray  # log of what is left behind a class for the ids of a class that have no column
    weights: dict[str, np.ndarray]


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Places (i, j) by how far j lies behind i.
_APART = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0)
#: Queries and keys are held to this length, so the exponentials need no shift.
LONGEST = np.float32(7.0)


def _held(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("...i,...i->...", x, x))
    if (norm > LONGEST).any():
        x *= np.minimum(1, LONGEST / np.maximum(norm, LONGEST))[..., None]
    return x


def levels(by_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities from counts (CLASSES + 1, CLASSES): (class before, group), and (group, class before, class in the group)."""
    prior = by_class.sum(axis=0) + 0.5
    counts = (by_class + 2 * prior / prior.sum()).reshape(len(by_class), -1, BRANCH)
    groups = counts.sum(axis=2)
    return np.log(groups / groups.sum(axis=1, keepdims=True)).astype(np.float32), np.ascontiguousarray(np.log(counts / groups[..., None]).transpose(1, 0, 2)).astype(np.float32)


def initial(n_ids: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights to begin with; the place behind all ids stands before a text."""
    draw = np.random.default_rng(seed)

    def normal(*shape, scale):
        return draw.normal(0, scale, shape).astype(np.float32)

    groups = CLASSES // BRANCH
    dense = {"embed": normal(CLASSES + 1, DIM, scale=0.3), "apart": np.zeros(WINDOW, np.float32), **{k: normal(DIM, DIM, scale=0.5 * DIM**-0.5) for k in "qkvo"}}
    return dense | {"out": normal(DIM, groups, scale=0.02), "inner": normal(groups, DIM, BRANCH, scale=0.02), "own": np.zeros((n_ids + 1, DIM), np.float32)}


def _beside(priors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(group * (CLASSES + 1) + class before, 2 * BRANCH): log-probabilities of all groups, then of the group's classes."""
    groups, inner = priors
    return np.concatenate([np.broadcast_to(groups, (len(inner), *groups.shape)), inner], axis=2).reshape(-1, groups.shape[1] + inner.shape[2])


def _told(w: dict[str, np.ndarray]) -> np.ndarray:
    """(group, DIM, 2 * BRANCH): the matrix of the groups, beside that of each group's classes."""
    return np.concatenate([np.broadcast_to(w["out"], (len(w["inner"]), *w["out"].shape)), w["inner"]], axis=2)


def _order(x: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers from 0 to `most`; short ones are sorted by their digits."""
    return np.argsort(x.astype(np.uint8 if most < 1 << 8 else np.uint16) if most < 1 << 16 else x, kind="stable")


def _begins(x: np.ndarray) -> np.ndarray:
    """Where a sorted row's stretches of equal numbers begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


class _Met:
    """The different numbers of a row, the most frequent first: `rows`, and `of` has for each place where its number stands there."""

    #: Rows of a number with more places than this are added up by a product, others place by place.
    MANY = 12

    def __init__(self, x: np.ndarray, most: int):
        order = _order(x, most)
        first = _begins(x[order])
        sizes = np.diff(first, append=len(x))
        by = np.argsort(-sizes, kind="stable")
        first, self.sizes = first[by], sizes[by]
        self.ends = np.cumsum(self.sizes)
        self.rows = x[order[first]]
        self.order = order[(first - self.ends + self.sizes).repeat(self.sizes) + np.arange(len(x))]
        self.of = np.empty(len(x), np.int64)
        self.of[self.order] = np.arange(len(by)).repeat(self.sizes)

    def sums(self, d: np.ndarray) -> np.ndarray:
        """Sums of the rows of d whose places hold the same number."""
        out = np.empty((len(self.rows), d.shape[1]), d.dtype)
        have = len(self.sizes) - np.cumsum(np.bincount(self.sizes, minlength=self.MANY + 1)[: self.MANY + 1])  # numbers with more places than 0, 1, ...
        many = int(have[-1])
        ends = self.ends[:many].tolist()
        if many:
            rows, ones, b = d.take(self.order[: ends[-1]], axis=0), np.ones(int(self.sizes[0]), d.dtype), 0
            for i, e in enumerate(ends):
                np.dot(ones[: e - b], rows[b:e], out=out[i])
                b = e
        begins = self.ends - self.sizes
        d.take(self.order[begins[many:]], axis=0, out=out[many:], mode="clip")
        for i, m in enumerate(have[1:].tolist(), 1):
            if m == many:
                break
            out[many:m] += d.take(self.order[begins[many:m] + i], axis=0)
        return out


class Fitting:
    """Weights that Adam changes batch by batch; the ids' own vectors by AdaGrad, only those that a batch holds.

    The dense weights, and their gradients, are stretches of one array each. Attention's shares are never divided by their sums:
    what they give is, and so is what comes back to them, which is DIM numbers a place instead of WINDOW.
    """

    def __init__(self, weights: dict[str, np.ndarray], kind: np.ndarray, priors: tuple[np.ndarray, np.ndarray]):
        self.kind, self.priors, self.t = np.append(kind, START).astype(np.int32), _beside(priors), 0
        shapes = {k: weights[k].shape for k in ("embed", "apart", "o", "out", "inner")} | {"qkv": (DIM, 3 * DIM)}
        ends = np.cumsum([int(np.prod(x)) for x in shapes.values()]).tolist()
        self.flat = [np.zeros(ends[-1], np.float32) for _ in range(4)]
        self.w, self.g, self.m, self.s = ({k: x.reshape(shapes[k]) for k, x in zip(shapes, np.split(flat, ends[:-1]), strict=True)} for flat in self.flat)
        for views in (self.w, self.m):
            views |= {k: views["qkv"][:, i * DIM : (i + 1) * DIM] for i, k in enumerate("qkv")}
        self.w["own"] = weights["own"].copy()
        for k, x in weights.items():
            self.w[k][...] = x
        self.moved = np.full(len(weights["own"]), 1e-4, np.float32)

    def weights(self) -> dict[str, np.ndarray]:
        return {k: np.ascontiguousarray(x) for k, x in self.w.items() if k != "qkv"}

    def step(self, own: np.ndarray, lr: float) -> None:
        """One step on windows (n, WINDOW + 1) of ids, -1 behind a text's end."""
        w, g = self.w, self.g
        ids, after = np.maximum(own[:, :-1], 0).ravel(), own[:, 1:].ravel()
        x, real = self.kind[ids], after >= 0
        y = self.kind[np.maximum(after, 0)]
        n, size = len(own), len(ids)
        # what an id puts in, once for each that the batch holds: query, key, value through the output matrix, a one (which sums up the shares), vector
        met = _Met(ids, len(self.kind))
        kinds = self.kind[met.rows]
        vectors = w["embed"].take(kinds, axis=0)
        vectors += w["own"].take(met.rows, axis=0)
        each = np.empty((len(kinds), 4 * DIM + 1), np.float32)
        put = vectors @ w["qkv"]
        _held(put[:, : 2 * DIM].reshape(-1, 2, DIM, copy=False))
        each[:, : 2 * DIM] = put[:, : 2 * DIM]
        np.matmul(put[:, 2 * DIM :], w["o"], out=each[:, 2 * DIM : 3 * DIM])
        each[:, 3 * DIM] = 1
        each[:, 3 * DIM + 1 :] = vectors
        flat = each.take(met.of, axis=0)
        parts = flat.reshape(n, WINDOW, -1)
        q, k, val = parts[..., :DIM], parts[..., DIM : 2 * DIM], parts[..., 2 * DIM : 3 * DIM + 1]
        att = q @ k.transpose(0, 2, 1)
        np.exp(att, out=att)
        att *= _SEEN * np.exp(w["apart"])[_APART]
        o = (att @ val).reshape(size, -1)
        total = o[:, DIM:]
        o = o[:, :DIM] / total
        h = o + flat[:, 3 * DIM + 1 :]
        # which group, and which class of it: rows of one group together
        group = y // BRANCH
        order = _order(group, len(w["inner"]))
        told, hs, group, ys = _told(w), h.take(order, axis=0), group[order], y[order]
        begins = np.searchsorted(group, np.arange(len(told) + 1)).tolist()
        p = self.priors.take(group * (CLASSES + 1) + x[order], axis=0)
        some = [(c, b, e) for c, (b, e) in enumerate(zip(begins[:-1], begins[1:], strict=True)) if b < e]
        for c, b, e in some:
            p[b:e] += hs[b:e] @ told[c]
        np.minimum(p, 60, out=p)
        np.exp(p, out=p)
        scale = (real[order] / max(1, real.sum())).astype(np.float32)
        halves = p.reshape(-1, BRANCH)
        halves *= (scale.repeat(2) / (halves @ np.ones(BRANCH, np.float32) + 1e-30))[:, None]
        spots = np.arange(0, 2 * BRANCH * size, 2 * BRANCH)
        line = p.reshape(-1)
        line[spots + group] -= scale
        line[spots + (BRANCH + ys % BRANCH)] -= scale
        back = np.empty_like(hs)
        both = np.zeros_like(told)
        for c, b, e in some:
            np.matmul(hs[b:e].T, p[b:e], out=both[c])
            np.matmul(p[b:e], told[c].T, out=back[b:e])
        both[..., :BRANCH].sum(axis=0, out=g["out"])
        g["inner"][...] = both[..., BRANCH:]
        # gradients with each place's query, key, value through the output matrix and vector
        d = np.empty((size, 4 * DIM), np.float32)
        back_at = np.empty_like(order)
        back_at[order] = np.arange(size)
        dh = back.take(back_at, axis=0)
        d[:, 3 * DIM :] = dh
        # what comes back to a place's shares: its gradient with each value, less that with what came out
        do = np.empty((size, DIM + 1), np.float32)
        np.divide(dh, total, out=do[:, :DIM])
        np.negative(np.einsum("ij,ij->i", do[:, :DIM], o), out=do[:, DIM])
        do = do.reshape(n, WINDOW, -1)
        ds = do @ val.transpose(0, 2, 1)
        ds *= att
        places = d.reshape(n, WINDOW, -1)
        np.matmul(ds, k, out=places[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=places[..., DIM : 2 * DIM])
        np.matmul(att.transpose(0, 2, 1), do[..., :DIM], out=places[..., 2 * DIM : 3 * DIM])
        g["apart"][...] = np.bincount(_APART.ravel(), np.ones(n, np.float32) @ ds.reshape(n, -1) * _SEEN.ravel(), WINDOW)
        # summed by id, through the matrices that all ids share; then by class
        d = met.sums(d)
        np.matmul(put[:, 2 * DIM :].T, d[:, 2 * DIM : 3 * DIM], out=g["o"])
        d[:, 2 * DIM : 3 * DIM] = d[:, 2 * DIM : 3 * DIM] @ w["o"].T
        np.matmul(vectors.T, d[:, : 3 * DIM], out=g["qkv"])
        sums = d[:, : 3 * DIM] @ w["qkv"].T
        sums += d[:, 3 * DIM :]
        rows, order = met.rows, _order(kinds, CLASSES)
        kinds = kinds[order]
        first = _begins(kinds)
        g["embed"][...] = 0
        g["embed"][kinds[first]] = np.add.reduceat(sums.take(order, axis=0), first, axis=0)
        moved = self.moved[rows] + np.einsum("ij,ij->i", sums, sums)
        self.moved[rows] = moved
        sums *= (5 * lr / np.sqrt(moved))[:, None]
        w["own"][rows] = w["own"].take(rows, axis=0) - sums
        self.t += 1
        dense, grad, m, s = self.flat
        m += 0.1 * (grad - m)
        s += 0.001 * (grad * grad - s)
        dense -= lr * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)


def train(windows: np.ndarray, kind: np.ndarray, priors, epochs: int = 3, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights by Adam on windows (n, WINDOW + 1) of ids, -1 behind a text's end; `kind` has the class of each id."""
    fitting = Fitting(initial(len(kind), seed), kind, priors)
    draw = np.random.default_rng(seed)
    steps = max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for a in range(0, len(order), batch):
            fitting.step(windows[order[a : a + batch]], rate * (1 - fitting.t / steps))
    return fitting.weights()


def windows_of(ids: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """Windows (n, WINDOW + 1) that hold every id of sequences of the given sizes (none empty) once as what is to be told: the id
    before each window's first one, or `start`, stands before it, -1 behind a sequence's end."""
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), n)
    ends = np.cumsum(sizes)
    at = (ends - sizes)[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    spots = at[:, None] + np.arange(-1, WINDOW)
    out = ids[np.clip(spots, 0, len(ids) - 1)].astype(np.int32)
    out[spots >= ends[owner][:, None]] = -1
    out[at == (ends - sizes)[owner], 0] = start
    return out


def train_on(windows: Iterator[np.ndarray], start: dict[str, np.ndarray], kind: np.ndarray, priors, batch: int = 128, rate: float = 1e-3, seed: int = 3, held: int = 16_384) -> tuple[int, dict[str, np.ndarray], np.ndarray]:
    """(number of windows, weights, how often each id stood in a window) from one pass over all windows, beginning with the weights given;
    about `held` windows are shuffled at a time."""
    fitting, draw, n = Fitting(start, kind, priors), np.random.default_rng(seed), 0
    often = np.zeros(len(kind) + 1, np.int64)
    rest: list[np.ndarray] = []

    def passed() -> None:
        all_ = np.concatenate(rest)
        order = draw.permutation(len(all_))
        for a in range(0, len(order), batch):
            fitting.step(all_[order[a : a + batch]], rate / np.sqrt(1 + fitting.t / 300))

    for own in windows:
        n += len(own)
        often += np.bincount(np.maximum(own[:, :-1], 0).ravel(), minlength=len(often))
        for a in range(0, len(own), held):
            rest.append(own[a : a + held])
            if sum(map(len, rest)) >= held:
                passed()
                rest = []
    if rest:
        passed()
    return n, fitting.weights(), often


def _tables(model: Model) -> tuple[np.ndarray, ...]:
    """With one layer, what an id puts in depends on itself alone: query, key, value through the output matrix and a one (which sums up
    the weights in the same product), for each id and the place before a text; then its vector, the classes' matrices and priors."""
    w = model.weights
    v = w["embed"][np.append(model.kind, START)] + w["own"]
    return np.concatenate([_held(v @ w["q"]), _held(v @ w["k"]), v @ w["v"] @ w["o"], np.ones((len(v), 1), np.float32)], axis=1), v, _told(w), _beside(model.priors)


def log_probability(model: Model, ids: np.ndarray, sizes: np.ndarray, most: int = 160) -> np.ndarray:
    """Natural log-probability of each token id of sequences of the given sizes, one after the other.

    The first window of a sequence scores all its tokens, each later one only its last FRESH: every token is scored
    once, and but for a sequence's beginning after at least WINDOW - FRESH + 1 others.
    """
    if not len(ids):
        return np.zeros(0)
    if "tables" not in model.__dict__:
        model.tables = _tables(model)
    parts, vectors, told, priors = model.tables
    kind = model.kind[ids]
    seen = _SEEN * np.exp(model.weights["apart"])[_APART]
    # inputs: the place before a text, then the ids but for the last
    begin = np.cumsum(sizes) - sizes
    fed = np.concatenate(([len(model.kind)], ids[:-1])).astype(np.int64)
    fed[begin[sizes > 0]] = len(model.kind)
    before = np.concatenate(([START], kind[:-1])).astype(np.int32)
    before[begin[sizes > 0]] = START
    place = model.place[ids]
    out = np.where(place >= 0, model.after[before, place], model.share[ids] + model.left[before, kind])
    groups, inner = (kind // BRANCH).astype(np.uint8), BRANCH + kind % BRANCH
    windows = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // FRESH)), 0)
    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(sizes)), windows)
    no = np.arange(int(windows.sum())) - first[owner]
    at = begin[owner] + no * FRESH
    end = (begin + sizes)[owner]
    steps, ones, last = np.arange(WINDOW), np.ones(BRANCH, np.float32), len(before) - 1
    for old, some in ((0, np.flatnonzero(no == 0)), (WINDOW - FRESH, np.flatnonzero(no > 0))):
        for a in range(0, len(some), most):
            own = some[a : a + most]
            spots = at[own, None] + steps
            rows = parts.take(fed.take(np.minimum(spots, last)), axis=0)
            s = rows[:, old:, :DIM] @ rows[..., DIM : 2 * DIM].transpose(0, 2, 1)
            np.exp(s, out=s)
            s *= seen[old:]
            o = (s @ rows[..., 2 * DIM :]).reshape(-1, DIM + 1)
            spots = spots[:, old:]
            scored = np.flatnonzero(spots < end[own, None])
            picked = spots.ravel()[scored]
            # rows of one group together
            order = np.argsort(groups[picked], kind="stable")
            picked = picked[order]
            o = o.take(scored[order], axis=0)
            h = o[:, :DIM] / o[:, DIM:]
            h += vectors.take(fed[picked], axis=0)
            group = groups[picked].astype(np.int64)
            p = priors.take(group * (CLASSES + 1) + before[picked], axis=0)
            begins = np.searchsorted(group, np.arange(len(told) + 1)).tolist()
            for c, (b, e) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                if b < e:
                    p[b:e] += h[b:e] @ told[c]
            line, spots = p.reshape(-1), np.arange(0, p.size, 2 * BRANCH)
            got = line[spots + group] + line[spots + inner[picked]]
            np.exp(line, out=line)
            sums = np.log(p.reshape(-1, BRANCH) @ ones)
            out[picked] += got - sums[::2] - sums[1::2]
    return out
