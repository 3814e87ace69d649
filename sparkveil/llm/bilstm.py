"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by backpropagation, decoding by Viterbi."""

from __future__ import annotations

import numpy as np

#: Characters that have a class of their own; ASCII letters, other letters and the rest have one each.
OWN = "0123456789.+-()[]@_%/: \n"
CLASSES = len(OWN) + 4
_AT = {c: i for i, c in enumerate(OWN)}
_ASCII = np.array([_AT.get(c, len(OWN) if "a" <= c <= "z" else len(OWN) + 1 if "A" <= c <= "Z" else len(OWN) + 3) for c in map(chr, range(128))], dtype=np.int64)


def encode(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _ASCII[np.minimum(x, 127)]
    for i in np.flatnonzero(x > 127):
        out[i] = len(OWN) + 2 if text[i].isalpha() else len(OWN) + 3
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiLstmCrf:
    """Tags of sequences of one length: batches are (time, batch). Both directions run in the same steps, as the first axis of W, U and b."""

    def __init__(self, tags: list[str], embed: int = 10, hidden: int = 24, seed: int = 1, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden, self.dtype = tags, hidden, dtype
        k = len(tags)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s)
        p = {"E": f(CLASSES, embed) * np.sqrt(CLASSES / embed), "W": f(2, embed, 4 * hidden), "U": f(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden)), "O": f(2 * hidden, k), "o": np.zeros(k), "T": np.zeros((k, k)), "s": np.zeros(k)}
        p["b"][:, :, hidden : 2 * hidden] = 1.0  # remember at first
        self.p = {n: x.astype(dtype) for n, x in p.items()}
        # an inside tag follows a tag of its kind only
        self.mask = np.zeros((k, k), dtype)
        self.start = np.zeros(k, dtype)
        for j, t in enumerate(tags):
            if t[:2] == "I-":
                self.start[j] = -1e4
                for i, u in enumerate(tags):
                    if u[2:] != t[2:]:
                        self.mask[i, j] = -1e4

    def emissions(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Scores of the tags, and with `keep` what the gradient needs."""
        x, hid = self.p["E"][ids], self.hidden
        x = np.stack([x, x[::-1]], 1)
        steps = x @ self.p["W"] + self.p["b"]
        t, _, n, _ = x.shape
        h, c = np.zeros((2, n, hid), self.dtype), np.zeros((2, n, hid), self.dtype)
        out, tape = np.empty((t, 2, n, hid), self.dtype), []
        for k in range(t):
            a = steps[k] + h @ self.p["U"]
            ifo, g = _sigmoid(a[..., : 3 * hid]), np.tanh(a[..., 3 * hid :])
            before, c = c, ifo[..., hid : 2 * hid] * c + ifo[..., :hid] * g
            tc = np.tanh(c)
            h = out[k] = ifo[..., 2 * hid :] * tc
            if keep:
                tape.append((ifo, g, before, tc))
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return both @ self.p["O"] + self.p["o"], (x, out, both, tape) if keep else None

    def loss(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags, and its gradient. Forward and backward sums are scaled to 1 at each step."""
        e, (x, out, both, tape) = self.emissions(ids, keep=True)
        t, n, k = e.shape
        e = e.astype(np.float64)
        tr, st = (self.p["T"] + self.mask).astype(np.float64), (self.p["s"] + self.start).astype(np.float64)
        top = e.max(axis=2, keepdims=True)
        q, m = np.exp(e - top), np.exp(tr)
        al, be, c = np.empty_like(q), np.ones_like(q), np.empty((t, n, 1))
        for j in range(t):
            a = np.exp(st) * q[0] if j == 0 else (al[j - 1] @ m) * q[j]
            c[j] = a.sum(axis=1, keepdims=True)
            al[j] = a / c[j]
        for j in range(t - 2, -1, -1):
            be[j] = ((be[j + 1] * q[j + 1]) @ m.T) / c[j + 1]
        z = np.log(c).sum(axis=(0, 2)) + top.sum(axis=(0, 2))
        de = al * be
        dt = m * (al[:-1].reshape(-1, k).T @ (q[1:] * be[1:] / c[1:]).reshape(-1, k))
        ds = de[0].sum(axis=0)
        rows, cols = np.arange(t)[:, None], np.arange(n)[None]
        score = st[gold[0]] + tr[gold[:-1], gold[1:]].sum(axis=0) + e[rows, cols, gold].sum(axis=0)
        ds -= np.bincount(gold[0], minlength=k)
        dt -= np.bincount((gold[:-1] * k + gold[1:]).ravel(), minlength=k * k).reshape(k, k)
        de[rows, cols, gold] -= 1
        de = (de / n).astype(self.dtype)
        g = {"T": dt / n, "s": ds / n, "O": both.reshape(t * n, -1).T @ de.reshape(t * n, k), "o": de.sum(axis=(0, 1))}
        dh, hid = de @ self.p["O"].T, self.hidden
        dh = np.stack([dh[..., :hid], dh[::-1, :, hid:]], 1)
        da = np.empty((t, 2, n, 4 * hid), self.dtype)
        more_h, dc = np.zeros((2, n, hid), self.dtype), np.zeros((2, n, hid), self.dtype)
        back = self.p["U"].transpose(0, 2, 1)
        for j in range(t - 1, -1, -1):
            ifo, gg, before, tc = tape[j]
            i, f, o = ifo[..., :hid], ifo[..., hid : 2 * hid], ifo[..., 2 * hid :]
            d = dh[j] + more_h
            dc = dc + d * o * (1 - tc * tc)
            a = da[j]
            a[..., :hid], a[..., hid : 2 * hid], a[..., 2 * hid : 3 * hid] = dc * gg, dc * before, d * tc
            a[..., : 3 * hid] *= ifo * (1 - ifo)
            a[..., 3 * hid :] = dc * i * (1 - gg * gg)
            more_h, dc = a @ back, dc * f
        flat = lambda y: y.transpose(1, 0, 2, 3).reshape(2, t * n, -1)
        prior = np.concatenate([np.zeros_like(out[:1]), out[:-1]])
        g["W"], g["U"], g["b"] = flat(x).transpose(0, 2, 1) @ flat(da), flat(prior).transpose(0, 2, 1) @ flat(da), da.sum(axis=(0, 2))[:, None]
        dx = da @ self.p["W"].transpose(0, 2, 1)
        dx = (dx[:, 0] + dx[::-1, 1]).reshape(t * n, -1)
        one = np.zeros((CLASSES, t * n), self.dtype)
        one[ids.ravel(), np.arange(t * n)] = 1
        g["E"] = one @ dx
        return float((z - score).mean()), g

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.015) -> list[float]:
        """Adam over (sequences, time) arrays, in an order that the seed fixes; the rate falls to a tenth."""
        rng = np.random.default_rng(2)
        m, v, step, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, []
        for e in range(epochs):
            total = 0.0
            for at in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // batch)):
                got, g = self.loss(ids[at].T, gold[at].T)
                total += got * len(at)
                step += 1
                for k in self.p:
                    gk = np.clip(g[k], -5, 5)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                    self.p[k] = (self.p[k] - rate * 0.1 ** (e / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(self.dtype)
            losses.append(total / len(ids))
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tags of (time, batch)."""
        e, _ = self.emissions(ids)
        tr = self.p["T"] + self.mask
        score, back = self.p["s"] + self.start + e[0], []
        for j in range(1, len(e)):
            x = score[:, :, None] + tr[None]
            back.append(x.argmax(axis=1))
            score = x.max(axis=1) + e[j]
        out = np.empty(ids.shape, dtype=np.int64)
        out[-1] = score.argmax(axis=1)
        col = np.arange(ids.shape[1])
        for j in range(len(back) - 1, -1, -1):
            out[j] = back[j][col, out[j + 1]]
        return out
