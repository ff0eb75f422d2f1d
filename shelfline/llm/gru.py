"""A gated recurrent language model in numpy with a class-factored softmax.

Symbols 0 to ``head`` - 1 are the end of a text (0) and the most frequent words, in classes
of CLASS by frequency; the others stand for a tail class each. A step's state predicts the
class of the next symbol, and within a head class the word; what a tail class holds is told
apart outside, by counts. Training is truncated backpropagation over windows of STEPS with
the state carried from window to window, and so is scoring, so a text of any length is
scored whole.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASS = 64
HIDDEN, STEPS, LANES = 16, 32, 256
#: Cells of the table of lanes; a text so long that LANES lanes of its length were more gets fewer beside it.
CELLS = 6_000_000
#: Symbols whose gradients are summed at least before the weights move: narrow windows, where few long texts go on, are taken together.
STEP_SYMBOLS = 1024
#: Logits are held below this, so that no exponential overflows.
TOP = np.float32(80)


def lanes_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end in lanes of about equal length: symbols, texts' numbers, and starts, as [step, lane].

    Lanes are in descending order of length; what is past a lane's end has text -1.
    """
    n = max(1, min(LANES, len(texts), CELLS // max(map(len, texts))))
    heap, mine = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, k = heapq.heappop(heap)
        mine[k].append(i)
        heapq.heappush(heap, (size + len(texts[i]), k))
    sizes = {k: size for size, k in heap}
    order = sorted(range(n), key=lambda k: -sizes[k])
    high = sizes[order[0]]
    y, of, start = np.zeros((high, n), np.int32), np.full((high, n), -1, np.int32), np.zeros((high, n), bool)
    for lane, k in enumerate(order):
        at = 0
        for i in mine[k]:
            end = at + len(texts[i])
            y[at:end, lane], of[at:end, lane], start[at, lane] = texts[i], i, True
            at = end
    return y, of, start


def _most(x: np.ndarray) -> np.float32:
    return max(x.max(), -x.min())


class Gru:
    def __init__(self, counts: np.ndarray, tails: np.ndarray, seed: int = 1):
        """counts: of the head symbols; tails: of the tail classes. They give the biases, so an untrained model is the unigram one."""
        self.head, self.n_tails = len(counts), len(tails)
        self.n_head_classes = -(-self.head // CLASS)
        y = np.arange(self.head + self.n_tails)
        #: The class of each symbol, in numbers so short that they are sorted by their digits.
        self.class_of = np.where(y < self.head, y // CLASS, y - self.head + self.n_head_classes).astype(np.uint16)
        rng, h = np.random.default_rng(seed), HIDDEN
        padded = np.zeros(self.n_head_classes * CLASS)
        padded[: self.head] = counts + 1.0
        mass = np.concatenate([padded.reshape(-1, CLASS).sum(1), tails + 1.0])
        with np.errstate(divide="ignore"):
            word_bias = np.where(padded > 0, np.log(np.maximum(padded, 1e-30)), -1e9)
        n_in = self.head + self.n_tails + 1  # the last is what stands before a text
        self.p = {
            "e": rng.normal(0, 0.1, (n_in, 3 * h)),
            "u": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "c": np.zeros((h, len(mass))),
            "cb": np.log(mass / mass.sum()),
            "w": np.zeros((self.n_head_classes, h, CLASS)),
            "wb": word_bias.reshape(-1, CLASS),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> "Gru":
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].astype(np.float32).reshape(self.p[k].shape)
            at += n
        return self

    def _states(self, x, keep, h, cache):
        """States after each step of a window, as [step, unit, lane], and the last; what training needs of the steps is put into cache."""
        n, (steps, lanes) = HIDDEN, x.shape
        # Of the gate z what it leaves, 1 - z, is wanted, so that only r's numbers are turned round before the logistic function.
        sign = np.repeat(np.array([1, -1, 1], np.float32), n)
        into = np.take(self.p["e"], x.ravel(), axis=0).reshape(steps, lanes, 3 * n).transpose(0, 2, 1) * sign[:, None]
        u_t = np.ascontiguousarray(self.p["u"].T) * sign[:, None]
        out, new = np.empty((steps, n, lanes), np.float32), np.empty((n, lanes), np.float32)
        gates, fed = np.empty((2 * n, lanes), np.float32), np.empty((3 * n, lanes), np.float32)
        kept = keep.all(1).tolist()
        if cache is not None:
            before, news = np.empty_like(out), np.empty_like(out)
            all_gates, all_fed = np.empty((steps, 2 * n, lanes), np.float32), np.empty((steps, 3 * n, lanes), np.float32)
            cache += [before, all_gates[:, :n], all_gates[:, n:], news, all_fed[:, 2 * n :]]
        for t in range(steps):
            if not kept[t]:
                h = h * keep[t]
            if cache is not None:
                before[t], gates, fed, new = h, all_gates[t], all_fed[t], news[t]
            a = into[t]
            np.matmul(u_t, h, out=fed)
            np.add(a[: 2 * n], fed[: 2 * n], out=gates)
            np.exp(gates, out=gates)  # one too large is infinite, and its reciprocal 0
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[n:], fed[2 * n :], out=new)
            new += a[2 * n :]
            np.tanh(new, out=new)
            after = np.subtract(new, h, out=out[t])
            after *= gates[:n]
            after += h
            h = after
        return out, h

    def _output(self, states, real, y, grads):
        """log-probabilities of the symbols y after states where they are real; with grads, their sum's descent is added there and that of the states returned, as they are laid."""
        y, n = y[real], HIDDEN
        cls = self.class_of.take(y)
        # Symbols of a class lie side by side. The last unit is always 1, for the biases.
        order = np.argsort(cls, kind="stable")
        y, cls = y[order], cls[order]
        cuts = np.searchsorted(cls, np.arange(self.n_head_classes + 1)).tolist()
        h = np.ones((len(y), n + 1), np.float32)
        h[:, :n] = np.take(states.transpose(0, 2, 1).reshape(-1, n), np.flatnonzero(real)[order], axis=0)
        e = h @ np.concatenate([self.p["c"], self.p["cb"][None]])
        # Units are within 1, so logits are within the units' number times the greatest weight; only where these are large must they be held.
        if _most(self.p["c"]) * n + self.p["cb"].max() > TOP:
            np.minimum(e, TOP, out=e)
        rows = np.arange(len(y))
        logp = e[rows, cls]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], np.float32)
        logp -= np.log(total)
        if grads is not None:
            e *= np.reciprocal(total)[:, None]
            e[rows, cls] -= 1
            grads["c"] += (e.T @ h[:, :n]).T
            grads["cb"] += np.ones(len(e), np.float32) @ e
            dh = e @ self.p["c"].T
        in_head = cuts[-1]
        full = [(k, i, j) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        if in_head:
            e = np.empty((in_head, CLASS), np.float32)
            w = np.concatenate([self.p["w"], self.p["wb"][:, None]], axis=1)
            for k, i, j in full:
                np.matmul(h[i:j], w[k], out=e[i:j])
            if _most(self.p["w"]) * n + self.p["wb"].max() > TOP:
                np.minimum(e, TOP, out=e)
            rows, word = rows[:in_head], y[:in_head] % CLASS
            right = e[rows, word]
            np.exp(e, out=e)
            total = e @ np.ones(CLASS, np.float32)
            logp[:in_head] += right - np.log(total)
            if grads is not None:
                e *= np.reciprocal(total)[:, None]
                e[rows, word] -= 1
                for k, i, j in full:
                    g = h[i:j].T @ e[i:j]
                    grads["w"][k] += g[:n]
                    grads["wb"][k] += g[n]
                    dh[i:j] += e[i:j] @ self.p["w"][k].T
        back = np.empty_like(logp)
        back[order] = logp
        if grads is None:
            return back, None
        d = np.zeros((real.size, n), np.float32)
        d[np.flatnonzero(real)[order]] = dh
        return back, np.ascontiguousarray(d.reshape(*real.shape, n).transpose(0, 2, 1))

    def _windows(self, y, of, start, steps):
        """Windows of active lanes: where, how wide, and inputs; ``steps`` gives their height by their first step and width."""
        x = np.empty_like(y)
        x[0], x[1:] = self.head + self.n_tails, y[:-1]
        x[start] = self.head + self.n_tails
        active, t = (of >= 0).sum(1).tolist(), 0
        while t < len(y):
            # Lanes end in order; a window is as wide as its first step, and what is past an end is masked.
            high = steps(t, active[t])
            yield slice(t, t + high), active[t], x
            t += high

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each whole text's classes and head words."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        y, of, start = lanes_of(texts)
        h = np.zeros((HIDDEN, y.shape[1]), np.float32)
        # The state goes on from window to window, so that narrow ones may be higher.
        with np.errstate(over="ignore"):
            for at, n, x in self._windows(y, of, start, lambda t, n: STEPS * max(1, LANES // n)):
                states, h = self._states(x[at, :n], ~start[at, :n], h[:, :n], None)
                real = of[at, :n] >= 0
                logp, _ = self._output(states, real, y[at, :n], None)
                out += np.bincount(of[at, :n][real], weights=logp, minlength=len(texts))
        return out

    def train(self, texts: list[np.ndarray], state: dict, rate: float) -> None:
        """One pass over whole texts by Adam; ``state`` keeps its moments between calls. The state is carried from window to window to the end of a text."""
        if not texts:
            return
        y, of, start = lanes_of(texts)
        h = np.zeros((HIDDEN, y.shape[1]), np.float32)
        before = np.append(0, np.cumsum((of >= 0).sum(1)))  # symbols before each step

        def high(t: int) -> int:
            """Windows that the weights stay the same for, in steps."""
            return next((k for k in range(STEPS, len(y) - t, STEPS) if before[t + k] - before[t] >= STEP_SYMBOLS), max(1, len(y) - t))

        with np.errstate(over="ignore"):
            for at, n, x in self._windows(y, of, start, lambda t, n: high(t)):
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                real = of[at, :n] >= 0
                h = self._add_gradients(x[at, :n], y[at, :n], real, start[at, :n], h[:, :n], grads)
                self._adam(grads, state, rate, 1.0 / int(real.sum()))

    def _add_gradients(self, x, y, real, start, h, grads) -> np.ndarray:
        """Adds the gradients of the negative log-probability, each going back to the start of its window of STEPS; the last state is returned."""
        cache: list = []
        states, after = self._states(x, ~start, h, cache)
        _, dout = self._output(states, real, y, grads)
        n, (steps, lanes) = HIDDEN, x.shape
        before, less, r, new, hn = cache
        # What a step's gradient is multiplied by is known for all steps at once: for what r lets through, z, r, the new state, and the state before.
        by = np.empty((steps, 5, n, lanes), np.float32)
        dm, dz, dr, dn, stays = (by[:, k] for k in range(5))
        np.multiply(new, new, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= less
        np.multiply(dn, r, out=dm)
        np.subtract(1, r, out=dr)
        dr *= hn
        dr *= dm
        np.subtract(1, less, out=stays)
        np.subtract(before, new, out=dz)
        dz *= less
        dz *= stays
        u = np.concatenate([self.p["u"][:, 2 * n :], self.p["u"][:, : 2 * n]], axis=1)
        starts, back = start.any(1).tolist(), None
        for t in range(steps - 1, -1, -1):
            dh = dout[t]
            if (t + 1) % STEPS and back is not None:
                dh += back
            by[t] *= dh
            back = u @ by[t, :3].reshape(3 * n, lanes)
            back += by[t, 4]
            if starts[t]:
                back *= ~start[t]
        d = by[:, :4].transpose(1, 2, 0, 3).reshape(4 * n, -1)
        g = (d[: 3 * n] @ before.transpose(1, 0, 2).reshape(n, -1).T).T
        grads["u"] += np.concatenate([g[:, n:], g[:, :n]], axis=1)
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")  # symbols fit in two bytes, as they are written
        ids = x.ravel()[order]
        cuts = np.flatnonzero(np.diff(ids, prepend=-1))
        grads["e"][ids[cuts]] += np.add.reduceat(np.take(d[n:], order, axis=1), cuts, axis=1).T
        return after

    def _adam(self, grads: dict, state: dict, rate: float, scale: float) -> None:
        k = state["n"] = state.get("n", 0) + 1
        for name, g in grads.items():
            g *= scale
            m, v = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[name] -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
