"""A character-level bidirectional LSTM with CRF transitions (Huang, Xu and Yu 2015; Lample et al. 2016) in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class BiLstmCrf:
    def __init__(self, symbols: int, tags: int, embed: int = 12, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"E": init(symbols, embed) * 2, "O": init(2 * hidden, tags), "c": np.zeros(tags, np.float32), "T": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"X{d}": init(embed, 4 * hidden), f"H{d}": init(hidden, 4 * hidden), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (time, batch, hidden) of x (time, batch, embed), read in the order given."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, states, saved = np.zeros_like(h), np.empty((x.shape[0], x.shape[1], n), np.float32), []
        z_all = x @ self.p[f"X{d}"] + self.p[f"b{d}"]
        for t in range(len(x)):
            z = z_all[t] + h @ self.p[f"H{d}"]
            gate = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                saved.append((i, f, o, g, before, tc, h))
            h = o * tc
            states[t] = h
        return states, saved

    def _lstm_back(self, x: np.ndarray, d: str, saved: list, dh_all: np.ndarray, grads: dict) -> np.ndarray:
        n, dx = self.hidden, np.empty_like(x)
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, tc, h = saved[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads[f"X{d}"] += x[t].T @ dz
            grads[f"H{d}"] += h.T @ dz
            grads[f"b{d}"] += dz.sum(axis=0)
            dx[t] = dz @ self.p[f"X{d}"].T
            dh, dc = dz @ self.p[f"H{d}"].T, dc * f
        return dx

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """Tag scores (time, batch, tags) of symbols (batch, time)."""
        x = self.p["E"][symbols.T]
        f, _ = self._lstm(x, "f", False)
        b, _ = self._lstm(x[::-1], "b", False)
        return np.concatenate([f, b[::-1]], axis=2) @ self.p["O"] + self.p["c"]

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """Best tag sequence of each row (Viterbi)."""
        e = self.emissions(symbols)
        score, back = e[0] + self.p["S"], []
        for t in range(1, len(e)):
            paths = score[:, :, None] + self.p["T"]
            back.append(paths.argmax(axis=1))
            score = paths.max(axis=1) + e[t]
        tags = np.empty((len(symbols), len(e)), np.int8)
        tags[:, -1] = best = score.argmax(axis=1)
        rows = np.arange(len(symbols))
        for t in range(len(e) - 2, -1, -1):
            tags[:, t] = best = back[t][rows, best]
        return tags

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags (batch, time) and its gradients."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        x = self.p["E"][symbols.T]
        f, saved_f = self._lstm(x, "f", True)
        b, saved_b = self._lstm(x[::-1], "b", True)
        both = np.concatenate([f, b[::-1]], axis=2)
        e = both @ self.p["O"] + self.p["c"]
        n, steps, rows = len(symbols), len(e), np.arange(len(symbols))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["S"]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + self.p["T"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(self.p["T"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _logsumexp(alpha[-1], 1)
        de = np.exp(alpha + beta - log_z[None, :, None])
        gold = self.p["S"][tags[:, 0]] + e[0][rows, tags[:, 0]]
        grads["S"] += de[0].sum(axis=0)
        np.add.at(grads["S"], tags[:, 0], -1)
        for t in range(1, steps):
            grads["T"] += np.exp(alpha[t - 1][:, :, None] + self.p["T"] + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(axis=0)
            np.add.at(grads["T"], (tags[:, t - 1], tags[:, t]), -1)
            gold = gold + self.p["T"][tags[:, t - 1], tags[:, t]] + e[t][rows, tags[:, t]]
        for t in range(steps):
            de[t][rows, tags[:, t]] -= 1
        flat = de.reshape(-1, self.tags)
        grads["O"] += both.reshape(-1, both.shape[2]).T @ flat
        grads["c"] += flat.sum(axis=0)
        dboth = de @ self.p["O"].T
        dx = self._lstm_back(x, "f", saved_f, dboth[:, :, : self.hidden], grads)
        dx = dx + self._lstm_back(x[::-1], "b", saved_b, dboth[::-1, :, self.hidden :], grads)[::-1]
        np.add.at(grads["E"], symbols.T, dx)
        return float((log_z - gold).mean()), {k: v / n for k, v in grads.items()}

    def fit(self, symbols: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, total = rng.permutation(len(symbols)), 0.0
            pace = rate * (1 - 0.9 * epoch / epochs)
            for low in range(0, len(order), batch):
                own = order[low : low + batch]
                loss, grads = self.gradients(symbols[own], tags[own])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                total, step = total + loss * len(own), step + 1
                for k, g in grads.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(order)))
        return losses
