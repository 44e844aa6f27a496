"""A one-layer causal self-attention model over token classes, in numpy.

Tokens go in chunks of ``CHUNK``; a window is a chunk and the one before it in the same text, so every token is scored
once, with at least ``CHUNK`` tokens of context where the text has them. Weights are q.k scaled plus a bias by distance.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache
from pathlib import Path

import numpy as np

CHUNK, WIDTH = 16, 16
NAMES = ("embed", "q", "k", "v", "o", "near", "out", "bias")


@lru_cache(maxsize=1)
def one_thread() -> bool:
    """Let numpy's own OpenBLAS, if it has one, use a single thread: on matrices this small the others only wait."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                return True
    return False


def init(classes: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
    return {"embed": draw(classes, WIDTH), **{n: draw(WIDTH, WIDTH) for n in "qkvo"}, "near": np.zeros(2 * CHUNK, np.float32), "out": draw(WIDTH, classes), "bias": np.zeros(classes, np.float32)}


#: distance of query i (in the second chunk) to key j (in both), and which keys it may see.
DISTANCE = np.arange(CHUNK)[:, None] + CHUNK - np.arange(2 * CHUNK)[None, :]
SEEN = DISTANCE >= 0


def layout(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid out in chunks.

    Gives inputs (chunks, 2*CHUNK: the tokens before each target, class 0 at a start), targets (chunks, CHUNK), whether a
    chunk is its text's first, and for each token its place in the targets, flat.
    """
    chunks = -(-lengths // CHUNK)
    first_chunk = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    flat = np.arange(len(tokens)) + np.repeat(first_chunk * CHUNK - begin, lengths)
    total = int(chunks.sum())
    targets = np.zeros(total * CHUNK, np.int16)
    targets[flat] = tokens
    inputs = np.zeros(total * CHUNK, np.int16)
    inputs[1:] = targets[:-1]
    inputs[first_chunk * CHUNK] = 0
    first = np.zeros(total, bool)
    first[first_chunk] = True
    now = inputs.reshape(-1, CHUNK)
    before = np.zeros_like(now)
    before[1:] = now[:-1]
    return np.concatenate((before, now), axis=1), targets.reshape(-1, CHUNK), first, flat


def step(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, used: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (nats) over the ``used`` targets, and its gradient."""
    scale = np.float32(WIDTH**-0.5)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    h = p["embed"][inputs]
    hq = np.ascontiguousarray(h[:, CHUNK:])
    q, k, v = hq @ p["q"], h @ p["k"], h @ p["v"]
    s = q @ k.transpose(0, 2, 1)
    s *= scale
    s += np.where(SEEN, p["near"][np.maximum(DISTANCE, 0)], np.float32(-1e9))
    s[first, :, :CHUNK] = -1e9
    s -= s.max(axis=2, keepdims=True)
    a = np.exp(s, out=s)
    a /= a.sum(axis=2, keepdims=True)
    c = a @ v
    o = hq + c @ p["o"]
    z = flat(o) @ p["out"]
    z += p["bias"]
    np.clip(z, -60, 60, out=z)
    at = np.arange(len(z)), targets.ravel().astype(np.intp)
    hit = z[at]
    d = np.exp(z, out=z)
    total = d @ np.ones(d.shape[1], d.dtype)
    mask = used.ravel()
    n = max(int(mask.sum()), 1)
    loss = float((np.log(total) - hit)[mask].sum() / n)
    share = (mask / n).astype(d.dtype)
    d *= (share / total)[:, None]
    d[at] -= share
    g = {"out": flat(o).T @ d, "bias": np.ones(len(d), d.dtype) @ d}
    do = (d @ p["out"].T).reshape(o.shape)
    g["o"] = flat(c).T @ flat(do)
    dc = do @ p["o"].T
    da = dc @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dc
    da -= (da * a).sum(axis=2, keepdims=True)
    ds = np.multiply(da, a, out=da)
    g["near"] = np.bincount(np.maximum(DISTANCE, 0).ravel(), weights=(ds.sum(axis=0) * SEEN).ravel(), minlength=2 * CHUNK).astype(np.float32)
    dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q * scale
    g["q"], g["k"], g["v"] = flat(hq).T @ flat(dq), flat(h).T @ flat(dk), flat(h).T @ flat(dv)
    dh = dk @ p["k"].T + dv @ p["v"].T
    dh[:, CHUNK:] += do + dq @ p["q"].T
    place = inputs.ravel().astype(np.intp)[:, None] * WIDTH + np.arange(WIDTH)
    g["embed"] = np.bincount(place.ravel(), weights=dh.ravel(), minlength=p["embed"].size).reshape(p["embed"].shape).astype(dh.dtype)
    return loss, g


def train(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, used: np.ndarray, steps: int, rate: float, batch: int = 128, seed: int = 1) -> dict[str, np.ndarray]:
    """``steps`` steps of Adam over shuffled batches of chunks."""
    p = {k: v.copy() for k, v in p.items()}
    if not len(inputs):
        return p
    rng = np.random.Generator(np.random.PCG64(seed))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    w = {k: np.zeros_like(v) for k, v in p.items()}
    order, at = rng.permutation(len(inputs)), 0
    for t in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(inputs)), 0
        k = order[at : at + batch]
        at += batch
        _, g = step(p, inputs[k], targets[k], first[k], used[k])
        now = rate * min(1.0, t / 20) * (1 - 0.9 * t / steps)
        for n in NAMES:
            m[n] = 0.9 * m[n] + 0.1 * g[n]
            w[n] = 0.99 * w[n] + 0.01 * g[n] ** 2
            p[n] -= (now * (m[n] / (1 - 0.9**t)) / (np.sqrt(w[n] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return p


class Scorer:
    """Log probabilities of targets. Embeddings depend on the class alone, so q.k and v are tables by class."""

    def __init__(self, p: dict[str, np.ndarray]):
        e = p["embed"]
        self.classes = len(e)
        s = (e @ p["q"]) @ (e @ p["k"]).T * np.float32(WIDTH**-0.5)
        near = p["near"] - p["near"].max()
        self.weight = np.exp(np.clip(s - s.max(axis=1, keepdims=True), -60, 0)).astype(np.float32)
        self.near = np.where(SEEN, np.exp(np.clip(near, -60, 0))[np.maximum(DISTANCE, 0)], 0).astype(np.float32)
        self.value = (e @ p["v"] @ p["o"]).astype(np.float32)
        self.embed, self.out, self.bias = e, p["out"], p["bias"]

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, most: int = 2048) -> np.ndarray:
        """Natural logs, (chunks, CHUNK), in batches of ``most`` chunks."""
        out = np.empty(targets.shape, np.float32)
        for at in range(0, len(inputs), most):
            x, y = inputs[at : at + most].astype(np.intp), targets[at : at + most].astype(np.intp)
            now = x[:, CHUNK:]
            w = self.weight.ravel().take(now[:, :, None] * self.classes + x[:, None, :])
            w *= self.near
            w[first[at : at + most], :, :CHUNK] = 0
            c = w @ self.value[x]
            c /= w.sum(axis=2, keepdims=True)
            c += self.embed[now]
            z = c.reshape(-1, WIDTH) @ self.out
            z += self.bias
            hit = z[np.arange(len(z)), y.ravel()]
            np.clip(z, -60, 60, out=z)
            np.exp(z, out=z)
            out[at : at + most] = (np.clip(hit, -60, 60) - np.log(z.sum(axis=1))).reshape(y.shape)
        return out


def pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[n].ravel() for n in NAMES]).astype(np.float32).tobytes()


def unpack(flat: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    shapes = {n: v.shape for n, v in init(classes).items()}
    out, at = {}, 0
    for n in NAMES:
        size = int(np.prod(shapes[n]))
        out[n] = flat[at : at + size].reshape(shapes[n]).astype(np.float32)
        at += size
    return out
