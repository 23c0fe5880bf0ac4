"""A small character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: The tags, and the character ids: 0 padding, 1 other, 2 white space, 3 digit, 4 other letter, then printable ASCII.
TAGS = ("o", "email", "ip", "card", "phone")
VOCAB = 5 + 95


def char_ids(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((c > 32) & (c < 127), c - 32 + 5, 1)
    out[c >= 192] = 4
    out[(c == 32) | ((c >= 9) & (c <= 13)) | (c == 160)] = 2
    out[(c >= 48) & (c <= 57)] = 3
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Parameters: E embeddings; for each direction the input map of E, the recurrent map and biases; output map; transitions."""

    def __init__(self, hidden: int = 16, embed: int = 12, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        k, h = len(TAGS), hidden
        self.h = h
        self.p = {"E": r.normal(0, 0.3, (VOCAB, embed)), "O": r.normal(0, 0.2, (2 * h, k)), "c": np.zeros(k), "T": np.zeros((k, k))}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, 0.25, (embed, 4 * h)), f"U{d}": r.normal(0, 0.25, (h, 4 * h)), f"v{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}

    def lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: (time, batch, embed) in reading order. Gates: input, forget, output, candidate."""
        t, n, h = x.shape[0], x.shape[1], self.h
        pre = x @ self.p[f"W{d}"] + self.p[f"v{d}"]
        s, c, out, tape = np.zeros((n, h), pre.dtype), np.zeros((n, h), pre.dtype), np.empty((t, n, h), pre.dtype), []
        u = self.p[f"U{d}"]
        for i in range(t):
            a = pre[i] + s @ u
            g = sigmoid(a[:, : 3 * h])
            m = np.tanh(a[:, 3 * h :])
            old_s, old_c = s, c
            c = g[:, h : 2 * h] * c + g[:, :h] * m
            tc = np.tanh(c)
            s = out[i] = g[:, 2 * h :] * tc
            if keep:
                tape.append((g, m, old_c, tc, old_s))
        return out, tape

    def lstm_back(self, x: np.ndarray, d: str, tape: list, up: np.ndarray, grad: dict) -> np.ndarray:
        h, u = self.h, self.p[f"U{d}"]
        da = np.empty((x.shape[0], x.shape[1], 4 * h))
        ds, dc = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        for i in reversed(range(x.shape[0])):
            g, m, old_c, tc, old_s = tape[i]
            gi, gf, go = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            s = up[i] + ds
            dc = dc + s * go * (1 - tc * tc)
            da[i] = np.concatenate([dc * m * gi * (1 - gi), dc * old_c * gf * (1 - gf), s * tc * go * (1 - go), dc * gi * (1 - m * m)], 1)
            grad[f"U{d}"] += old_s.T @ da[i]
            ds, dc = da[i] @ u.T, dc * gf
        grad[f"W{d}"] += np.einsum("tne,tnk->ek", x, da)
        grad[f"v{d}"] += da.sum((0, 1))
        return da @ self.p[f"W{d}"].T

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["E"][ids.T]
        f, tf = self.lstm(x, "f", keep)
        b, tb = self.lstm(x[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], 2)
        return both @ self.p["O"] + self.p["c"], (x, tf, tb, both)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean CRF loss of a batch (batch, time) and its gradient; padding is tagged o."""
        em, (x, tf, tb, both) = self.emissions(ids, True)
        t, n, k = em.shape
        tr = self.p["T"]
        lse = lambda z, ax: (m := z.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(z - m).sum(ax))
        al, be = np.empty_like(em), np.zeros_like(em)
        al[0] = em[0]
        for i in range(1, t):
            al[i] = em[i] + lse(al[i - 1][:, :, None] + tr, 1)
        for i in reversed(range(t - 1)):
            be[i] = lse(tr + (em[i + 1] + be[i + 1])[:, None, :], 2)
        z = lse(al[-1], 1)
        y = tags.T
        gold = np.take_along_axis(em, y[:, :, None], 2).sum((0, 2)) + tr[y[:-1], y[1:]].sum(0)
        dem = np.exp(al + be - z[None, :, None])
        np.put_along_axis(dem, y[:, :, None], np.take_along_axis(dem, y[:, :, None], 2) - 1, 2)
        pair = np.exp(al[:-1][:, :, :, None] + tr + (em[1:] + be[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        grad = {a: np.zeros_like(v) for a, v in self.p.items()}
        grad["T"], grad["O"], grad["c"] = pair, np.einsum("tnh,tnk->hk", both, dem), dem.sum((0, 1))
        up = dem @ self.p["O"].T
        dx = self.lstm_back(x, "f", tf, up[:, :, : self.h], grad) + self.lstm_back(x[::-1], "b", tb, up[::-1, :, self.h :], grad)[::-1]
        np.add.at(grad["E"], ids.T, dx)
        return float((z - gold).mean()), {a: g / n for a, g in grad.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 4) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r, m, v, step, out = np.random.default_rng(seed), {}, {}, 0, []
        for e in range(epochs):
            order, total = r.permutation(len(ids)), []
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                cost, grad = self.loss(ids[pick], tags[pick])
                total.append(cost)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for a, g in grad.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    m[a] = 0.9 * m.get(a, 0) + 0.1 * g
                    v[a] = 0.999 * v.get(a, 0) + 0.001 * g * g
                    self.p[a] -= rate * (0.3 if e >= epochs - 2 else 1) * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.999**step)) + 1e-8)
            out.append(float(np.mean(total)))
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of each row (batch, time)."""
        em, _ = self.emissions(ids)
        t, n, k = em.shape
        back, best = np.empty((t, n, k), np.int8), em[0]
        for i in range(1, t):
            s = best[:, :, None] + self.p["T"]
            back[i] = s.argmax(1)
            best = em[i] + s.max(1)
        out = np.empty((n, t), np.int8)
        out[:, -1] = best.argmax(1)
        for i in reversed(range(1, t)):
            out[:, i - 1] = back[i][np.arange(n), out[:, i]]
        return out
