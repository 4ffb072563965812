"""A gated recurrent network over symbols, in numpy, with a class-factored output.

Symbols stand in ``classes`` classes of equal size. The network gives the
probability of the next symbol's class and of the symbol inside its class, both
from the same state. Texts run in lanes, the longest first; a window of steps
ends, the state of every lane is carried into the next one, and gradients stop
there (truncated backpropagation).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    classes: int = 32
    members: int = 32
    state: int = 24

    @property
    def symbols(self) -> int:
        return self.classes * self.members

    def parts(self) -> dict[str, tuple[int, ...]]:
        gates = 3 * self.state
        return {
            # the last row is the symbol before the first one of a text
            "inputs": (self.symbols + 1, gates),
            "recurrent": (self.state, gates),
            "class_out": (self.state, self.classes),
            "class_bias": (self.classes,),
            "member_out": (self.classes, self.state, self.members),
            "member_bias": (self.classes, self.members),
        }

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views into one flat vector of all weights."""
        out, at = {}, 0
        for name, shape in self.parts().items():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out


def initial(shape: Shape, frequency: np.ndarray, seed: int = 7) -> np.ndarray:
    """Small random weights; the biases alone already give the symbols' frequencies."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.size, np.float32)
    w = shape.split(flat)
    w["inputs"][:] = rng.normal(0, 0.3, w["inputs"].shape)
    w["recurrent"][:] = rng.normal(0, 0.5 / np.sqrt(shape.state), w["recurrent"].shape)
    w["inputs"][:, : shape.state] += 1.0  # states begin by keeping what they hold
    f = frequency.reshape(shape.classes, shape.members) + 1e-3
    w["member_bias"][:] = np.log(f / f.sum(1, keepdims=True))
    w["class_bias"][:] = np.log(f.sum(1) / f.sum())
    return flat


# largest logarithm before normalisation: its exponential still fits a float
MOST = np.float32(60)
# rows of the output layer that are computed at once, and those whose logarithms stay in a core's cache
ROWS = 1 << 16
CACHED_ROWS = 1 << 11
# weights that one step of the optimizer takes through the cache together
CACHED_WEIGHTS = 1 << 13


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def lanes(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows of texts by groups of at most ``most``, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    for at in range(0, len(order), most):
        yield order[at : at + most]


def pieces(begins: np.ndarray, lengths: np.ndarray, most: int):
    """Texts cut into runs of at most ``most`` symbols: begins, lengths, and which open a text."""
    counts = -(-lengths // most)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(lengths, counts) - place * most
    return np.repeat(begins, counts) + place * most, np.minimum(left, most), place == 0


def grid(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, start: int, steps: int):
    """Symbols of the lanes in steps ``start`` and after, by step, and how many lanes go on."""
    steps = min(steps, int(lengths[0]) - start)
    active = np.searchsorted(-lengths, -(start + np.arange(steps)), side="left")
    at = np.minimum(begins[None, : active[0]] + start + np.arange(steps)[:, None], len(flat) - 1)
    return flat[at], active


class Network:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat.astype(np.float32)
        self.w = shape.split(self.flat)
        self.grad: np.ndarray | None = None

    def steps(self, symbols, active, before, state, keep):
        """States in front of each symbol of a window, and the state after it.

        ``before`` has the symbol preceding each lane's first one. With ``keep``
        the gates come along for the way back.
        """
        n, inputs, recurrent = self.shape.state, self.w["inputs"], self.w["recurrent"]
        seen, gates = [], []
        for t, k in enumerate(active):
            x = inputs.take(before[:k], axis=0)
            h = state[:k]
            u = h @ recurrent
            zr = sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = r * u[:, 2 * n :]
            c += x[:, 2 * n :]
            np.tanh(c, out=c)
            new = z * (h - c)
            new += c
            if keep:
                gates.append((before[:k], h, z, r, c, u[:, 2 * n :]))
            seen.append(new)
            state, before = new, symbols[t, :k]
        return seen, gates, before, state

    def loglik(self, states: np.ndarray, symbols: np.ndarray, grad: np.ndarray | None = None):
        """Natural log-probability of each symbol; with ``grad``, also d/dstates of their sum."""
        shape, w = self.shape, self.w
        classes, members = symbols // shape.members, symbols % shape.members
        rows = np.arange(len(symbols))
        out = np.empty(len(symbols), np.float32)
        whole = np.empty((len(symbols) if grad is not None else CACHED_ROWS, shape.classes), np.float32)
        for at in range(0, len(symbols), CACHED_ROWS):
            upto = min(at + CACHED_ROWS, len(symbols))
            logits = whole[at:upto] if grad is not None else whole[: upto - at]
            np.matmul(states[at:upto], w["class_out"], out=logits)
            logits += w["class_bias"]
            np.minimum(logits, MOST, out=logits)
            chosen = rows[: upto - at], classes[at:upto]
            own = logits[chosen]
            np.exp(logits, out=logits)
            total = logits @ np.ones(shape.classes, np.float32)
            np.subtract(own, np.log(total), out=out[at:upto])
            if grad is not None:
                logits /= -total[:, None]
                logits[chosen] += 1
        if grad is not None:
            logits = whole
            g = shape.split(grad)
            g["class_out"] += states.T @ logits
            g["class_bias"] += logits.sum(0)
            back = logits @ w["class_out"].T
        # rows by class: a class's rows lie together, and its weights are met once
        order = np.argsort(classes.astype(np.uint16) if shape.classes < 1 << 16 else classes, kind="stable")
        ends = np.cumsum(np.bincount(classes, minlength=shape.classes))
        h, m = states.take(order, axis=0), members.take(order)
        chosen = np.empty(len(symbols), np.float32)
        # classes that are computed together: their first and last row, the first class and the one behind
        parts, at, first = [], 0, 0
        for c, end in enumerate(ends.tolist(), 1):
            if end - at >= CACHED_ROWS or (c == shape.classes and end > at):
                parts.append((at, end, first, c))
                at, first = end, c
        width = max((upto - at for at, upto, _, _ in parts), default=0) if grad is None else len(symbols)
        whole, total = (np.empty((width, *more), np.float32) for more in ((shape.members,), ()))
        one = np.ones(shape.members, np.float32)
        for at, upto, first, last in parts:
            inner = whole[at:upto] if grad is not None else whole[: upto - at]
            runs = np.r_[0, ends[first:last] - at].tolist()
            runs = [(c, *run) for c, run in enumerate(zip(runs, runs[1:]), first) if run[1] > run[0]]
            for c, begin, end in runs:
                np.matmul(h[at + begin : at + end], w["member_out"][c], out=inner[begin:end])
                inner[begin:end] += w["member_bias"][c]
            np.minimum(inner, MOST, out=inner)
            here = rows[: upto - at], m[at:upto]
            own = inner[here]
            np.exp(inner, out=inner)
            for _, begin, end in runs:
                np.matmul(inner[begin:end], one, out=total[begin:end])
            np.subtract(own, np.log(total[: upto - at]), out=chosen[at:upto])
            if grad is not None:
                inner /= -total[: upto - at, None]
                inner[here] += 1
        out[order] += chosen
        if grad is not None:
            further = np.empty_like(h)
            begin = 0
            for c, end in enumerate(ends.tolist()):
                if end > begin:
                    inner = whole[begin:end]
                    g["member_out"][c] += h[begin:end].T @ inner
                    g["member_bias"][c] += inner.sum(0)
                    np.matmul(inner, w["member_out"][c].T, out=further[begin:end])
                begin = end
            back[order] += further
        return (out, back) if grad is not None else out

    def score(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, most=2048, cells=65536):
        """Natural log-probability of every text, state carried through all of it.

        The fewer lanes go on, the more steps a window has.
        """
        out = np.zeros(len(lengths))
        for group in lanes(lengths, most):
            size, first = lengths[group], begins[group]
            state = np.zeros((len(group), self.shape.state), np.float32)
            before = np.full(len(group), self.shape.symbols)
            start = 0
            while start < size[0]:
                steps = max(cells // np.searchsorted(-size, -start, side="left"), 1)
                symbols, active = grid(flat, first, size, start, steps)
                start += len(active)
                seen, _, before, state = self.steps(symbols, active, before, state, False)
                flat_symbols = np.concatenate([symbols[t, :k] for t, k in enumerate(active)])
                states = np.concatenate(seen)
                values = np.concatenate(
                    [
                        self.loglik(states[n : n + ROWS], flat_symbols[n : n + ROWS])
                        for n in range(0, len(states), ROWS)
                    ]
                )
                lane = np.concatenate([np.arange(k) for k in active])
                out[group] += np.bincount(lane, values, len(group))
        return out

    def gradient(self, symbols, active, before, state):
        """Gradient of a window's log-probability, and the carried symbols and state.

        The next call writes over the gradient.
        """
        shape, n, w = self.shape, self.shape.state, self.w
        seen, gates, before, state = self.steps(symbols, active, before, state, True)
        if self.grad is None:
            self.grad = np.empty_like(self.flat)
        grad = self.grad
        grad.fill(0)
        g = shape.split(grad)
        flat_symbols = np.concatenate([symbols[t, :k] for t, k in enumerate(active)])
        states = np.concatenate(seen)
        parts = [
            self.loglik(states[n : n + ROWS], flat_symbols[n : n + ROWS], grad)
            for n in range(0, len(states), ROWS)
        ]
        values, back = (np.concatenate(p) for p in zip(*parts, strict=True))
        ends = np.cumsum(active)
        later = np.zeros((0, n), np.float32)
        d_inputs, at_inputs = [], []
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            d = back[ends[t] - k : ends[t]]
            d[: len(later)] += later
            previous, h, z, r, c, un = gates[t]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], 1)
            d_inputs.append(np.concatenate([dz, dr, dc], 1))
            at_inputs.append(previous)
            g["recurrent"] += h.T @ du
            later = d * z + du @ w["recurrent"].T
        at = np.concatenate(at_inputs)
        # numbers of two bytes are sorted by radix
        by = np.argsort(at.astype(np.uint16) if shape.symbols < 1 << 16 else at, kind="stable")
        at = at[by]
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        g["inputs"][at[begin]] += np.add.reduceat(np.concatenate(d_inputs).take(by, axis=0), begin)
        return grad, values, before, state


class Trainer:
    """Adam over the windows of batches of texts; one for each task and round."""

    LANES = 512
    STEPS = 32

    def __init__(self, network: Network, rate: float = 0.01):
        self.network, self.rate = network, rate
        self.first, self.second = (np.zeros_like(network.flat) for _ in range(2))
        self.updates = self.symbols = 0

    def learn(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        """One pass over whole texts, the state carried and gradients cut at the end of each window."""
        net, enough = self.network, self.LANES * self.STEPS // 4
        for group in lanes(lengths, self.LANES):
            size, begin = lengths[group], begins[group]
            state = np.zeros((len(group), net.shape.state), np.float32)
            before = np.full(len(group), net.shape.symbols)
            for start in range(0, int(size[0]), self.STEPS):
                symbols, active = grid(flat, begin, size, start, self.STEPS)
                grad, values, before, state = net.gradient(symbols, active, before, state)
                # a window with few lanes left counts less, as its gradient is noisier
                grad /= max(len(values), enough)
                self.symbols += len(values)
                self.updates += 1
                scale = self.rate * np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
                for at in range(0, len(grad), CACHED_WEIGHTS):
                    part = slice(at, at + CACHED_WEIGHTS)
                    g, first, second = grad[part], self.first[part], self.second[part]
                    step = g - first
                    step *= 0.1
                    first += step
                    np.multiply(g, g, out=step)
                    step -= second
                    step *= 0.01
                    second += step
                    np.sqrt(second, out=step)
                    step += 1e-6
                    change = scale * first
                    change /= step
                    net.flat[part] += change
