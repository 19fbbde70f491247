"""A gated recurrent unit with a class-factored softmax, in numpy.

Inputs are word numbers below ``n_in``.  The output has ``n_class`` classes:
each of the first ``n_head_class`` holds ``per_class`` head words, told apart by
a softmax of their own; the rest are spelling classes of tail words, whose words
the caller tells apart by counts.

Arrays hold features first and streams last, so every operation of a step runs
over long contiguous rows.
"""

from __future__ import annotations

import numpy as np

F4 = np.float32
#: Beyond this size of a logit exp() needs the largest one taken off first.
SAFE_LOGIT = 60.0


class Gru:
    """Parameters in one flat float32 array, with named views."""

    def __init__(self, n_in: int, n_class: int, n_head_class: int, per_class: int, hidden: int = 16, embed: int = 12, seed: int = 5):
        self.n_in, self.heads, self.per_class, self.hidden = n_in, n_head_class, per_class, hidden
        self.sizes = {
            "E": (embed, n_in), "W": (3 * hidden, embed), "U": (3 * hidden, hidden), "b": (3 * hidden,),
            "C": (n_class, hidden), "c": (n_class,), "V": (n_head_class, per_class, hidden), "v": (n_head_class, per_class),
        }
        total = sum(int(np.prod(s)) for s in self.sizes.values())
        self.flat, self.squares = np.zeros(total, F4), np.zeros(total, F4)
        rng = np.random.default_rng(seed)
        for name, scale in (("E", 0.3), ("W", embed**-0.5), ("U", hidden**-0.5)):
            p = self.views(self.flat)[name]
            p[...] = rng.standard_normal(p.shape) * scale

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.sizes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, p: dict) -> tuple:
        """Forward over one window: x, fresh (steps x streams), h (hidden x streams).

        Returns the states before and after each step, the gates, and the last state.
        """
        t, b = x.shape
        k = self.hidden
        half = np.ones((3 * k, 1), F4)
        half[: 2 * k] = 0.5  # a sigmoid by tanh
        pre = np.take((p["W"] @ p["E"] + p["b"][:, None]) * half, x, axis=1)
        u = p["U"] * half
        before, states, gates = np.empty((k, t, b), F4), np.empty((k, t, b), F4), np.empty((3 * k, t, b), F4)
        for i in range(t):
            h = h * fresh[i]
            before[:, i] = h
            g = u[: 2 * k] @ h
            g += pre[: 2 * k, i]
            np.tanh(g, out=g)
            g += 1
            g *= F4(0.5)
            gates[: 2 * k, i] = g
            z = g[:k]
            n = u[2 * k :] @ (g[k:] * h)
            n += pre[2 * k :, i]
            np.tanh(n, out=n)
            gates[2 * k :, i] = n
            h -= n
            h *= z
            h += n
            states[:, i] = h
        return before, states, gates, h

    @staticmethod
    def _exps(logits: np.ndarray, most: float) -> np.ndarray:
        """exp of the logits, in place; their largest is taken off where it must be."""
        if most > SAFE_LOGIT:
            logits -= logits.max(0)
        return np.exp(logits, out=logits)

    def outputs(self, s: np.ndarray, cls: np.ndarray, member: np.ndarray, p: dict, grads: dict | None = None, weight: np.ndarray | None = None):
        """Natural-log probabilities of the targets from states s (hidden x n).

        With ``grads`` also adds the gradients of the weighted negative sum and
        returns those of the states.
        """
        places = np.arange(len(cls))
        most_c = float((np.abs(p["C"]).sum(1) + np.abs(p["c"])).max())
        most_v = float((np.abs(p["V"]).sum(2) + np.abs(p["v"])).max())
        w = self._exps(p["C"] @ s + p["c"][:, None], most_c)
        total = w.sum(0)
        out = np.log(w[cls, places] / total)
        ds = None
        if grads is not None:
            w *= weight / total
            w[cls, places] -= weight
            grads["C"] += w @ s.T
            grads["c"] += w.sum(1)
            ds = p["C"].T @ w
        # the head classes' places side by side, so each class is one product
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.heads + 1))
        order = order[: cuts[-1]]
        inner, members, sums = s[:, order], member[order], np.ones(len(order), F4)
        chosen, back = np.ones(len(order), F4), np.empty_like(inner)
        for c in range(self.heads):
            a, b = int(cuts[c]), int(cuts[c + 1])
            if a == b:
                continue
            w = self._exps(p["V"][c] @ inner[:, a:b] + p["v"][c][:, None], most_v)
            w.sum(0, out=sums[a:b])
            rows = places[: b - a]
            chosen[a:b] = w[members[a:b], rows]
            if grads is not None:
                own = weight[order[a:b]]
                w *= own / sums[a:b]
                w[members[a:b], rows] -= own
                grads["V"][c] += w @ inner[:, a:b].T
                grads["v"][c] += w.sum(1)
                np.matmul(p["V"][c].T, w, out=back[:, a:b])
        out[order] += np.log(chosen / sums)
        if grads is not None:
            ds[:, order] += back
        return out, ds

    def learn(self, x, fresh, h, cls, member, live, rate: float) -> np.ndarray:
        """One step of truncated backpropagation over one window; the carried state."""
        p = self.views(self.flat)
        before, states, gates, last = self.run(x, fresh, h, p)
        t, b = x.shape
        k = self.hidden
        flat_grads = np.zeros_like(self.flat)
        g = self.views(flat_grads)
        weight = live.reshape(-1).astype(F4) / F4(max(1, live.sum()))
        _, ds = self.outputs(states.reshape(k, t * b), cls.reshape(-1), member.reshape(-1), p, g, weight)
        ds = ds.reshape(k, t, b)
        z, r, n = gates[:k], gates[k : 2 * k], gates[2 * k :]
        # what each step's gates make of the gradient of its state
        by_z, by_n, by_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), before * r * (1 - r)
        up, down = p["U"][: 2 * k].T.copy(), p["U"][2 * k :].T.copy()
        dpre = np.empty((3 * k, t, b), F4)
        dh = np.zeros((k, b), F4)
        for i in range(t - 1, -1, -1):
            dh += ds[:, i]
            dn = dh * by_n[:, i]
            drh = down @ dn
            dzr = np.concatenate([dh * by_z[:, i], drh * by_r[:, i]])
            dpre[: 2 * k, i] = dzr
            dpre[2 * k :, i] = dn
            dh *= z[:, i]
            drh *= r[:, i]
            dh += drh
            dh += up @ dzr
            dh *= fresh[i]
        flat = dpre.reshape(3 * k, t * b)
        hs = before.reshape(k, t * b)
        g["U"][: 2 * k] += flat[: 2 * k] @ hs.T
        g["U"][2 * k :] += flat[2 * k :] @ (r.reshape(k, t * b) * hs).T
        g["b"] += flat.sum(1)
        words = x.reshape(-1)
        de = p["W"].T @ flat
        g["W"] += flat @ p["E"][:, words].T
        for j in range(len(de)):
            g["E"][j] += np.bincount(words, de[j], minlength=self.n_in).astype(F4)
        np.clip(flat_grads, -0.1, 0.1, out=flat_grads)
        self.squares *= F4(0.99)
        self.squares += F4(0.01) * flat_grads * flat_grads
        self.flat -= F4(rate) * flat_grads / (np.sqrt(self.squares) + F4(1e-4))
        return last

    def score(self, x, fresh, h, cls, member) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log probabilities (steps x streams) and the carried state (hidden x streams)."""
        p = self.views(self.flat)
        t, b = x.shape
        _, states, _, last = self.run(x, fresh, h, p)
        logs, _ = self.outputs(states.reshape(self.hidden, t * b), cls.reshape(-1), member.reshape(-1), p)
        return logs.reshape(t, b), last


class Streams:
    """Texts dealt to streams, longest text first; windows shrink as streams end."""

    def __init__(self, lengths: np.ndarray, width: int):
        import heapq

        order = np.argsort(-lengths, kind="stable")
        heap = [(0, i) for i in range(max(1, min(width, len(lengths))))]
        dealt: list[list[int]] = [[] for _ in heap]
        for d in order.tolist():
            total, i = heapq.heappop(heap)
            dealt[i].append(d)
            heapq.heappush(heap, (total + int(lengths[d]), i))
        dealt.sort(key=lambda docs: -sum(int(lengths[d]) for d in docs))
        starts = np.cumsum(lengths) - lengths
        #: Per stream, the positions of its tokens in the concatenated texts.
        self.places = [np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in docs]) for docs in dealt if docs]

    def windows(self, steps: int):
        """Places (steps x streams still running), -1 past a stream's end."""
        sizes = np.array([len(p) for p in self.places])
        for at in range(0, int(sizes.max(initial=0)), steps):
            running = int((sizes > at).sum())
            out = np.full((steps, running), -1, np.int64)
            for i in range(running):
                part = self.places[i][at : at + steps]
                out[: len(part), i] = part
            yield out
