"""A character-level bidirectional LSTM with CRF transitions in numpy: training, and Viterbi decoding of windows."""

from __future__ import annotations

import numpy as np

VOCAB = 130  # 0: padding, 1..128: ASCII, 129: any other character


def codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, x + 1, 129).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiLstmCrf:
    """Windows are (time, batch) arrays of codes; tags likewise.

    Both directions run side by side: their weights are stacked, and the backward one reads windows from the end.
    """

    def __init__(self, n_tags: int, dim: int = 12, hidden: int = 16, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        self.k, self.h = n_tags, hidden
        draw = lambda *s: (g.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[:, :, hidden : 2 * hidden] = 1
        self.p = {"e": draw(VOCAB, dim) * np.float32(np.sqrt(VOCAB / dim)), "x": draw(2, dim, 4 * hidden), "h": draw(2, hidden, 4 * hidden), "b": bias, "o": draw(2 * hidden, n_tags), "ob": np.zeros(n_tags, np.float32), "a": np.zeros((n_tags, n_tags), np.float32), "s": np.zeros(n_tags, np.float32)}

    def _run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """The hidden states (time, batch, both directions), and what going back needs."""
        n, w = self.h, self.p["h"]
        table = self.p["e"] @ self.p["x"] + self.p["b"]
        h = np.zeros((2, x.shape[1], n), table.dtype)
        c, out, kept = h, np.empty((2, *x.shape, n), table.dtype), []
        for t in range(len(x)):
            z = h @ w
            z[0] += table[0][x[t]]
            z[1] += table[1][x[-1 - t]]
            s, g = _sigmoid(z[:, :, : 3 * n]), np.tanh(z[:, :, 3 * n :])
            old, hold = c, h
            c = s[:, :, n : 2 * n] * c + s[:, :, :n] * g
            tc = np.tanh(c)
            h = s[:, :, 2 * n :] * tc
            out[0, t], out[1, -1 - t] = h
            if keep:
                kept.append((s, g, old, tc, hold))
        return np.concatenate(list(out), 2), kept

    def _back(self, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
        n, w = self.h, self.p["h"].transpose(0, 2, 1)
        dh = np.zeros((2, x.shape[1], n), dout.dtype)
        dc, dw, every = dh, np.zeros_like(self.p["h"]), np.empty((2, *x.shape, 4 * n), dout.dtype)
        for t in range(len(x) - 1, -1, -1):
            s, g, old, tc, hold = kept[t]
            dh = dh + np.stack([dout[t, :, :n], dout[-1 - t, :, n:]])
            i, f, o = s[:, :, :n], s[:, :, n : 2 * n], s[:, :, 2 * n :]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 2)
            dw += hold.transpose(0, 2, 1) @ dz
            every[0, t], every[1, -1 - t] = dz
            dc, dh = dc * f, dz @ w
        order = np.argsort(x.ravel(), kind="stable")
        code = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        table = np.zeros((2, VOCAB, 4 * n), dout.dtype)
        table[:, code[first]] = np.add.reduceat(every.reshape(2, -1, 4 * n)[:, order], first, axis=1)
        grad["h"], grad["b"] = dw, table.sum(1, keepdims=True)
        grad["x"] = self.p["e"].T @ table
        grad["e"] = (table @ self.p["x"].transpose(0, 2, 1)).sum(0)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._run(x, False)[0] @ self.p["o"] + self.p["ob"]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """The summed negative log-likelihood of the tags, and its gradient. Forward and backward sums are scaled to 1 at every step."""
        hidden, kept = self._run(x, True)
        em = (hidden @ self.p["o"] + self.p["ob"]).astype(np.float64)
        a, n, b = self.p["a"].astype(np.float64), *x.shape
        top = em.max(2, keepdims=True)
        e, ea = np.exp(em - top), np.exp(a)
        fwd, bwd, scale = np.empty_like(em), np.empty_like(em), np.empty((n, b, 1))
        now = np.exp(self.p["s"].astype(np.float64)) * e[0]
        for t in range(n):
            if t:
                now = (now @ ea) * e[t]
            scale[t] = now.sum(1, keepdims=True)
            fwd[t] = now = now / scale[t]
        bwd[-1] = now = np.ones((b, self.k))
        for t in range(n - 2, -1, -1):
            bwd[t] = now = ((e[t + 1] * now) @ ea.T) / scale[t + 1]
        z = (np.log(scale) + top).sum((0, 2))
        own = np.arange(b)
        gold = self.p["s"][y[0]] + em[np.arange(n)[:, None], own, y].sum(0) + a[y[:-1], y[1:]].sum(0)
        dem = fwd * bwd
        da = ea * (fwd[:-1].reshape(-1, self.k).T @ (e[1:] * bwd[1:] / scale[1:]).reshape(-1, self.k))
        np.add.at(da, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        dem[np.arange(n)[:, None], own, y] -= 1
        grad = {"s": dem[0].sum(0), "a": da, "ob": dem.sum((0, 1)), "o": hidden.reshape(-1, 2 * self.h).T @ dem.reshape(-1, self.k)}
        self._back(x, kept, (dem @ self.p["o"].T).astype(hidden.dtype), grad)
        return float((z - gold).sum()), grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 3) -> float:
        """Adam over random batches of windows; the mean loss of the last steps."""
        g, m, v, last = np.random.default_rng(seed), {}, {}, []
        for step in range(1, steps + 1):
            at = g.integers(0, x.shape[1], batch)
            loss, grad = self.gradient(x[:, at], y[:, at])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, d in grad.items():
                d = np.clip(d / batch, -5, 5)
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            last = [*last[-19:], loss / batch]
        return float(np.mean(last)) if last else 0.0

    def decode(self, x: np.ndarray) -> np.ndarray:
        em, a = self.emissions(x), self.p["a"]
        n, b = x.shape
        back = np.empty((n, b, self.k), np.uint8)
        best = em[0] + self.p["s"]
        for t in range(1, n):
            every = best[:, :, None] + a
            back[t] = every.argmax(1)
            best = every.max(1) + em[t]
        tags = np.empty((n, b), np.uint8)
        tags[-1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(b), tags[t]]
        return tags
