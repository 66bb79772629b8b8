"""A small causal self-attention model over subword ids, in numpy: forward, backward and scoring.

One head attends from each position of a chunk to that chunk's earlier positions and to the chunk before it: windows of
two chunks overlap by one, and every token is scored in exactly one. The output is a softmax in two steps, over
classes of ids and over the ids of a class; ids beyond the frequent ones form a last class with fixed shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 16
WIDTH = 16
HIDDEN = 32
CLASSES = 32
IN_CLASS = 32
HEAD = CLASSES * IN_CLASS  # frequent ids, those that the softmax tells apart
TAIL = HEAD  # input code of all other ids
START = HEAD + 1
PAD = HEAD + 2
BLOCK = 256  # windows computed at a time
PARAMETERS = {
    "E": (HEAD + 3, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "r": (2 * CHUNK,),
    "A": (WIDTH, HIDDEN), "a": (HIDDEN,), "B": (HIDDEN, WIDTH),
    "U": (WIDTH, CLASSES + 1), "u": (CLASSES + 1,), "O": (CLASSES, WIDTH, IN_CLASS), "o": (CLASSES, IN_CLASS),
}
DISTANCE = np.arange(CHUNK)[:, None] + CHUNK - np.arange(2 * CHUNK)[None, :]  # of a position to a key; negative: ahead
Weights = dict[str, np.ndarray]


def first_weights(head_counts: np.ndarray, tail_count: float, seed: int = 11) -> Weights:
    """Small random weights; the biases are the logarithms of the corpus's counts, so the model starts as a unigram model."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * (0.3 if k == "E" else s[0] ** -0.5 * 0.5)).astype(np.float32) for k, s in PARAMETERS.items()}
    counts = np.zeros(HEAD) + 0.5
    counts[: len(head_counts)] += head_counts
    by_class = counts.reshape(CLASSES, IN_CLASS)
    w["o"] = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
    of_class = np.append(by_class.sum(1), tail_count + 0.5)
    w["u"] = np.log(of_class / of_class.sum()).astype(np.float32)
    w["r"] = (-0.3 * np.arange(2 * CHUNK)).astype(np.float32)
    w["a"] = np.zeros(HIDDEN, np.float32)
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in PARAMETERS])


def unflat(x: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in PARAMETERS.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s)
        at += n
    return out


def windows(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, 2 CHUNK), targets (n, CHUNK; -1 where there is none) and text number (n) of the windows of texts.
    A text's codes end with the end mark; its inputs are the start mark and all but the last code."""
    inputs, aims, owner = [], [], []
    for i, c in enumerate(codes):
        room = -len(c) % CHUNK
        inputs.append(np.concatenate([np.full(CHUNK, PAD, np.int32), [START], c[:-1], np.full(room, PAD, np.int32)]).reshape(-1, CHUNK))
        aims.append(np.concatenate([np.full(CHUNK, -2, np.int32), c, np.full(room, -1, np.int32)]).reshape(-1, CHUNK))
        owner.append(np.full(len(inputs[-1]), i, np.int64))
    if not codes:
        return np.empty((0, 2 * CHUNK), np.int32), np.empty((0, CHUNK), np.int32), np.empty(0, np.int64)
    chunks, goal, own = np.concatenate(inputs), np.concatenate(aims), np.concatenate(owner)
    real = goal[1:, 0] != -2
    return np.concatenate([chunks[:-1], chunks[1:]], axis=1)[real], goal[1:][real], own[1:][real]


def exp_sums(s: np.ndarray) -> np.ndarray:
    """Replaces s by its exponentials and returns their sums over the last axis, in 32-bit floats. Logits of a trained model
    are far from the limits of the type; the bound keeps even others finite."""
    np.minimum(s, np.float32(80), out=s)
    np.exp(s, out=s)
    return np.maximum(s @ np.ones(s.shape[-1], np.float32), np.float32(1e-30))


@dataclass
class Scorer:
    """Weights with the products that don't depend on the text worked out once."""

    w: Weights

    def __post_init__(self) -> None:
        w = self.w
        self.q = np.ascontiguousarray(w["E"] @ w["Q"] / np.float32(WIDTH**0.5))
        self.k = np.ascontiguousarray(w["E"] @ w["K"])
        self.v = np.ascontiguousarray(w["E"] @ w["V"])
        self.bias = np.where(DISTANCE >= 0, w["r"][np.maximum(DISTANCE, 0)], np.float32(-1e9)).astype(np.float32)

    def log_probs(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the targets (tail ids: of the tail class), 0 where there is none."""
        return np.concatenate([self._block(x[i : i + BLOCK], t[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]) if len(x) else np.zeros(t.shape, np.float32)

    def _block(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        w, last = self.w, x[:, CHUNK:]
        s = np.matmul(self.q[last], self.k[x].transpose(0, 2, 1))
        s += self.bias
        if (x == PAD).any():
            s += np.where(x == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
        total = exp_sums(s)
        c = np.matmul(s, self.v[x]).reshape(-1, WIDTH)
        h = w["E"][last].reshape(-1, WIDTH) + c / total.reshape(-1, 1)
        m = h @ w["A"]
        m += w["a"]
        h += np.maximum(m, 0, out=m) @ w["B"]
        goal = t.ravel()
        kind = np.minimum(np.maximum(goal, 0) // IN_CLASS, CLASSES)
        z = h @ w["U"]
        z += w["u"]
        out = np.take_along_axis(z, kind[:, None], 1)[:, 0]
        out -= np.log(exp_sums(z))
        # targets by class: each class multiplies its own slice, and the sums run over all slices at once
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        own, n = h[order], ends[CLASSES]
        y = np.empty((n, IN_CLASS), np.float32)
        for g in range(CLASSES):
            if ends[g + 1] > ends[g]:
                np.matmul(own[ends[g] : ends[g + 1]], w["O"][g], out=y[ends[g] : ends[g + 1]])
        head = order[:n]
        y += w["o"][kind[head]]
        inside = np.take_along_axis(y, (goal[head] % IN_CLASS)[:, None], 1)[:, 0]
        out[head] += inside - np.log(exp_sums(y))
        out[goal < 0] = 0
        return out.reshape(t.shape)


def gradients(w: Weights, x: np.ndarray, t: np.ndarray) -> tuple[float, Weights]:
    """Sum of -log p over the targets, and its gradient."""
    scale, last = np.float32(WIDTH**-0.5), x[:, CHUNK:]
    e_all = w["E"][x]
    e = e_all[:, CHUNK:]
    q, k, v = e @ w["Q"] * scale, e_all @ w["K"], e_all @ w["V"]
    bias = np.where(DISTANCE >= 0, w["r"][np.maximum(DISTANCE, 0)], np.float32(-1e9))
    s = np.matmul(q, k.transpose(0, 2, 1)) + bias
    if (x == PAD).any():
        s = np.where((x == PAD)[:, None, :], np.float32(-1e9), s)
    s -= s.max(-1, keepdims=True)
    p = np.exp(s, out=s)
    p /= p.sum(-1, keepdims=True)
    h = (e + np.matmul(p, v)).reshape(-1, WIDTH)
    m = h @ w["A"] + w["a"]
    z = np.maximum(m, 0)
    f = h + z @ w["B"]
    goal = t.ravel()
    real = np.flatnonzero(goal >= 0)
    kind = np.minimum(np.maximum(goal, 0) // IN_CLASS, CLASSES)
    g: Weights = {n: np.zeros_like(a) for n, a in w.items()}

    def softmax(y: np.ndarray, aim: np.ndarray) -> tuple[float, np.ndarray]:
        y -= y.max(1, keepdims=True)
        at = np.arange(len(aim))
        aimed = y[at, aim]
        d = np.exp(y, out=y)
        total = d.sum(1, keepdims=True)
        lost = float((np.log(total[:, 0]) - aimed).sum())
        d /= total
        d[at, aim] -= 1
        return lost, d

    df = np.zeros_like(f)
    loss, d = softmax(f[real] @ w["U"] + w["u"], kind[real])
    g["U"], g["u"] = f[real].T @ d, d.sum(0)
    df[real] = d @ w["U"].T
    for c in range(CLASSES):
        own = real[kind[real] == c]
        if len(own):
            lost, d = softmax(f[own] @ w["O"][c] + w["o"][c], goal[own] % IN_CLASS)
            loss += lost
            g["O"][c], g["o"][c] = f[own].T @ d, d.sum(0)
            df[own] += d @ w["O"][c].T
    g["B"] = z.T @ df
    dm = (df @ w["B"].T) * (m > 0)
    g["A"], g["a"] = h.T @ dm, dm.sum(0)
    dh = (df + dm @ w["A"].T).reshape(e.shape)
    dv = np.matmul(p.transpose(0, 2, 1), dh)
    dp = np.matmul(dh, v.transpose(0, 2, 1))
    dp -= np.einsum("nij,nij->ni", p, dp)[:, :, None]
    ds = np.multiply(p, dp, out=dp)
    np.add.at(g["r"], np.maximum(DISTANCE, 0).ravel(), np.where(DISTANCE >= 0, ds.sum(0), 0).ravel())
    dq, dk = np.matmul(ds, k) * scale, np.matmul(ds.transpose(0, 2, 1), q)

    def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.reshape(-1, WIDTH).T @ b.reshape(-1, WIDTH)

    g["Q"], g["K"], g["V"] = outer(e, dq), outer(e_all, dk), outer(e_all, dv)
    de = dk @ w["K"].T + dv @ w["V"].T
    de[:, CHUNK:] += dh + dq @ w["Q"].T
    flat_x, flat_d = x.ravel(), de.reshape(-1, WIDTH)
    for i in range(WIDTH):
        g["E"][:, i] = np.bincount(flat_x, flat_d[:, i], minlength=len(g["E"]))
    return loss, g


def train(w: Weights, x: np.ndarray, t: np.ndarray, rate: float, seed: int, batch: int = 128) -> Weights:
    """One pass of Adam over the windows in random order."""
    now = flat(w).astype(np.float32)
    mean, square = np.zeros_like(now), np.zeros_like(now)
    order = np.random.default_rng(seed).permutation(len(x))
    for step, i in enumerate(range(0, len(order), batch), 1):
        own = order[i : i + batch]
        d = flat(gradients(unflat(now), x[own], t[own])[1]) / max(1, int((t[own] >= 0).sum()))
        mean += 0.1 * (d - mean)
        square += 0.01 * (d * d - square)
        now -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return unflat(now)
