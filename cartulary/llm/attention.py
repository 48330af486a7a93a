"""A small causal self-attention model over subword ids, in numpy.

One attention layer with relative positions over the subwords before a position,
a direct path from the last one and a hidden layer give a state.  The next id is a
walk down the Huffman tree of all ids: every turn is a logistic decision between
the state and the tree node's vector, so each part of the probability depends on
the context, the cost is that of a few nodes, and the probabilities of all ids sum
to one.  Before any training the model is the unigram distribution.
"""

from __future__ import annotations

import heapq

import numpy as np

CONTEXT = 24
STRIDE = 16
WIDTH = 32
HIDDEN = 32
SCALE = np.float32(WIDTH**-0.5)
#: Windows that are scored, and that are trained on, together.
BATCH = 128
STEP = 64
#: Logits beyond this are cut, on both sides alike, so that no probability is 0.
MOST = 15.0
#: Nodes of the tree, from the root on, that training compares with all states in one product.
TOP = 127


class Tree:
    """The Huffman tree of ids: for each id its nodes and, as 1 or 0, its turns."""

    def __init__(self, counts: np.ndarray):
        weight = [float(c) + 0.5 for c in counts]
        n = len(weight)
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, bool)
        self.bias = np.zeros(n - 1, np.float32)
        for node in range(n, 2 * n - 1):
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], parent[right], side[left] = node, node, True
            self.bias[node - n] = np.log(a / b)
            heapq.heappush(heap, (a + b, node))
        ids, nodes, turns = [], [], []
        at, own = np.arange(n), np.arange(n)
        while len(at):
            up = parent[at]
            inner = at != 2 * n - 2
            at, own, up = at[inner], own[inner], up[inner]
            ids.append(own)
            nodes.append(up - n)
            turns.append(side[at])
            at = up
        order = np.argsort(np.concatenate(ids), kind="stable")
        self.nodes, self.turns = np.concatenate(nodes)[order].astype(np.int32), np.concatenate(turns)[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(ids), minlength=n))]).astype(np.int32)

        # A walk passes ever heavier nodes, which have the higher numbers: at its end those that most walks share.
        self.top = max(0, n - 1 - TOP)
        self.low = np.add.reduceat(self.nodes < self.top, self.begin[:-1], dtype=np.int32) if n > 1 else np.zeros(n, np.int32)
        self.signs = np.where(self.turns, np.float32(1), np.float32(-1))

    def walk(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some ids strung together: nodes, turns, which id each belongs to, and where each id begins."""
        n = self.begin[ids + 1] - self.begin[ids]
        flat, first = strung(self.begin[ids], n)
        return self.nodes.take(flat), self.turns.take(flat), np.repeat(np.arange(len(ids)), n), first


def strung(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of stretches of n from begin on, one after the other, and where each stretch begins among them."""
    end = np.cumsum(n)
    first = end - n
    return np.repeat(begin - first, n) + np.arange(int(end[-1]) if len(n) else 0), first


def _summed(rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of stretches of n rows, at least one, from first on; for stretches of few rows, where reduceat is slow."""
    out, k = rows.take(first, 0), 1
    longer = np.flatnonzero(n > 1)
    while len(longer):
        out[longer] += rows.take(first[longer] + k, 0)
        k += 1
        longer = longer[n[longer] > k]
    return out


def _most(s: np.ndarray) -> np.ndarray:
    """The largest of each row; max is slow along short rows."""
    return np.ascontiguousarray(s.reshape(-1, s.shape[2]).T).max(axis=0).reshape(*s.shape[:2], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -MOST, MOST)))


def _apart(length: int) -> np.ndarray:
    return np.arange(length)[:, None] - np.arange(length)


class Model:
    """Parameters.  Ids are 0 to size - 1; size stands before a text, size + 1 is padding."""

    SPARSE = ("e", "n", "a")
    DENSE = ("q", "k", "v", "u", "t", "o", "b", "w", "c", "z")

    def __init__(self, tree: Tree, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tree, self.size = tree, len(tree.begin) - 1
        make = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        one = np.eye(WIDTH, dtype=np.float32)
        self.p = {"e": make(0.4, self.size + 2, WIDTH), "q": make(0.3, WIDTH, WIDTH), "k": make(0.3, WIDTH, WIDTH), "v": make(0.3, WIDTH, WIDTH), "o": one.copy(), "u": one.copy(), "t": 0.3 * one, "b": np.zeros(CONTEXT, np.float32)}
        self.p |= {"w": make(0.3, WIDTH, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "z": np.zeros((HIDDEN, WIDTH), np.float32), "n": np.zeros((self.size - 1, WIDTH), np.float32), "a": tree.bias[:, None].copy()}
        self.forget()

    def forget(self) -> None:
        """Training begins anew from these parameters."""
        self.first, self.square = np.zeros((2, sum(self.p[k].size for k in self.DENSE)), np.float32)
        self.second = {k: np.zeros_like(self.p[k]) for k in self.SPARSE}
        self.steps = 0

    def _joint(self) -> np.ndarray:
        """What an embedding is multiplied with, side by side: as a query of embeddings, as what attention adds to a state, as the position's own and as the one before."""
        p = self.p
        return np.hstack([p["q"] @ p["k"].T * SCALE, p["v"] @ p["o"], p["u"], p["t"]])

    def forward(self, x: np.ndarray, joint: np.ndarray | None = None) -> tuple:
        """States after each position of windows x; position i sees x up to i, and no padding."""
        p = self.p
        pad = x > self.size
        # Padding that only follows is seen by no position before it.
        padded = bool((pad[:, :-1] & ~pad[:, 1:]).any())
        e = p["e"].take(x.ravel(), 0)
        parts = (e @ (self._joint() if joint is None else joint)).reshape(*x.shape, 4 * WIDTH)
        q, v, u, t = (parts[:, :, at : at + WIDTH] for at in range(0, 4 * WIDTH, WIDTH))
        apart = _apart(x.shape[1])
        a = q @ e.reshape(*x.shape, WIDTH).transpose(0, 2, 1)
        a += np.where(apart >= 0, p["b"][np.maximum(apart, 0)], np.float32(-1e9))
        if padded:
            a += np.where(pad[:, None, :] & (apart != 0), np.float32(-1e9), np.float32(0))
            t = np.where(pad[:, :, None], np.float32(0), t)
        a -= _most(a)
        np.exp(a, out=a)
        a /= np.einsum("bij->bi", a)[:, :, None]
        h = a @ v
        h += u
        h[:, 1:] += t[:, :-1]
        h = h.reshape(-1, WIDTH)
        r = h @ p["w"]
        r += p["c"]
        np.maximum(r, 0, out=r)
        state = r @ p["z"]
        state += h
        return pad if padded else None, e, q, v, a, h, r, state

    def log10(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 probability of y at each position of windows: the plain form that Scorer is measured by."""
        state = self.forward(x)[-1]
        nodes, turns, row, first = self.tree.walk(y.ravel())
        logit = (self.p["n"][nodes] * state[row]).sum(axis=1) + self.p["a"][nodes, 0]
        return np.add.reduceat(np.log10(sigmoid(np.where(turns, logit, -logit).astype(np.float64))), first).reshape(y.shape)

    def _sparse(self, rows: np.ndarray, rate: float, **grads: np.ndarray) -> None:
        """Steps of the rows of parameters that have these gradients, summed by row."""
        if not len(rows):
            return
        # Sorted as one number, which is quicker than a stable argsort and gives the same.
        key = np.sort(rows.astype(np.int64) << 32 | np.arange(len(rows)))
        order, at = key & 0xFFFFFFFF, key >> 32
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        own = at[first]
        for name, grad in grads.items():
            grad = grad.take(order, 0)
            # As complex numbers two columns are added at once.
            g = np.add.reduceat(grad.view(np.complex64), first, axis=0).view(np.float32) if grad.shape[1] % 2 == 0 else np.add.reduceat(grad, first, axis=0)
            total = g * g
            total += self.second[name].take(own, 0)
            self.second[name][own] = total
            np.sqrt(total, out=total)
            total += np.float32(1e-6)
            g *= -rate
            g /= total
            g += self.p[name].take(own, 0)
            self.p[name][own] = g

    def _decide(self, f: np.ndarray, ids: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """Steps of the tree's nodes on the walks to ids from states f: the gradients of the states, and the bits of all."""
        p, tree, top = self.p, self.tree, self.tree.top
        scale = np.float32(len(f) ** -0.5)

        def turned(odds: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
            odds *= signs
            np.clip(odds, -MOST, MOST, out=odds)
            np.exp(odds, out=odds)
            odds += 1
            wrong = 1 / odds
            return -scale * signs * wrong, -float(np.log2(1 - wrong).sum())

        begin, end = tree.begin.take(ids), tree.begin.take(ids + 1)
        low = tree.low.take(ids)
        # Nodes near the root: the gradients are a matrix of few columns.
        high, width = p["n"][top:], self.size - 1 - top
        n = end - begin - low
        flat, _ = strung(begin + low, n)
        at = np.repeat(np.arange(len(ids)) * width - top, n) + tree.nodes.take(flat)
        g, bits = turned((f @ high.T + p["a"][top:, 0]).ravel().take(at), tree.signs.take(flat))
        dense = np.zeros((len(f), width), np.float32)
        dense.reshape(-1)[at] = g
        d = dense @ high
        steps = {"n": (f.T @ dense).T, "a": (np.ones(len(f), np.float32) @ dense)[:, None]}
        # The others, one by one.
        far = np.flatnonzero(low)
        if len(far):
            n = low[far]
            flat, first = strung(begin[far], n)
            nodes = tree.nodes.take(flat)
            vectors, states = p["n"].take(nodes, 0), np.repeat(f.take(far, 0), n, axis=0)
            g, more = turned(np.einsum("rd,rd->r", vectors, states) + p["a"].take(nodes), tree.signs.take(flat))
            bits += more
            vectors *= g[:, None]
            d[far] += _summed(vectors, first, n)
            states *= g[:, None]
            self._sparse(nodes, rate, n=states, a=g[:, None])
        for name, grad in steps.items():
            second = self.second[name][top:]
            second += grad * grad
            p[name][top:] -= rate * grad / (np.sqrt(second) + np.float32(1e-6))
        return d, bits

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step down the cross entropy of windows; y is -1 at padding.  Returns it in bits an id."""
        p, joint, rate = self.p, self._joint(), np.float32(rate)
        pad, e, q, v, a, h, r, state = self.forward(x, joint)
        real = np.flatnonzero(y.ravel() >= 0)
        if len(real) == y.size:
            d, bits = self._decide(state, y.ravel(), rate)
        else:
            d = np.zeros_like(state)
            d[real], bits = self._decide(state.take(real, 0), y.ravel()[real], rate)
        grads = {"z": r.T @ d}
        dr = d @ p["z"].T
        dr *= r > 0
        grads |= {"w": h.T @ dr, "c": np.ones(len(dr), np.float32) @ dr}
        d += dr @ p["w"].T
        dh = d.reshape(*x.shape, WIDTH)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
        ds *= a
        apart = _apart(x.shape[1])
        grads["b"] = np.bincount(np.maximum(apart, 0).ravel(), ds.sum(axis=0).ravel(), minlength=CONTEXT).astype(np.float32)
        parts = np.empty((*x.shape, 4 * WIDTH), np.float32)
        parts[:, :, :WIDTH] = ds @ e.reshape(*x.shape, WIDTH)
        parts[:, :, WIDTH : 2 * WIDTH] = a.transpose(0, 2, 1) @ dh
        parts[:, :, 2 * WIDTH : 3 * WIDTH] = dh
        parts[:, :-1, 3 * WIDTH :] = dh[:, 1:]
        parts[:, -1, 3 * WIDTH :] = 0
        if pad is not None:
            parts[:, :, 3 * WIDTH :][pad] = 0
        flat = parts.reshape(-1, 4 * WIDTH)
        both = e.T @ flat
        pairs, mixed, grads["u"], grads["t"] = (both[:, at : at + WIDTH] for at in range(0, 4 * WIDTH, WIDTH))
        grads |= {"q": pairs @ p["k"] * SCALE, "k": pairs.T @ p["q"] * SCALE, "v": mixed @ p["o"].T, "o": p["v"].T @ mixed}
        de = flat @ joint.T
        de += (ds.transpose(0, 2, 1) @ q).reshape(de.shape)
        if pad is None:
            self._sparse(x.ravel(), rate, e=de)
        else:
            seen = np.flatnonzero(x.ravel() <= self.size)
            self._sparse(x.ravel()[seen], rate, e=de.take(seen, 0))
        self.steps += 1
        grad = np.concatenate([grads[name].ravel() for name in self.DENSE])
        self.first = 0.9 * self.first + np.float32(0.1) * grad
        self.square = 0.99 * self.square + np.float32(0.01) * grad * grad
        change = 0.05 * rate * (self.first / np.float32(1 - 0.9**self.steps)) / (np.sqrt(self.square / np.float32(1 - 0.99**self.steps)) + np.float32(1e-8))
        at = 0
        for name in self.DENSE:
            p[name] = p[name] - change[at : at + p[name].size].reshape(p[name].shape)
            at += p[name].size
        return bits / max(1, len(real))

    def fit(self, windows: np.ndarray, epochs: int, rate: float = 0.1) -> float:
        """Goes through windows (the id before, and CONTEXT ids, -1 for padding) so many times, in their order; the rate falls to a tenth.  Returns the mean bits an id of the last pass."""
        steps = range(0, len(windows), STEP)
        total, done, bits = epochs * len(steps), 0, [0.0]
        for _ in range(epochs):
            bits = []
            for at in steps:
                part = windows[at : at + STEP].astype(np.int64)
                x, y = part[:, :-1], part[:, 1:]
                bits.append(self.step(np.where(x < 0, self.size + 1, x), y, rate * (1 - 0.9 * done / total)))
                done += 1
        return float(np.mean(bits)) if bits else 0.0


def windows(ids: np.ndarray, start: int) -> np.ndarray:
    """All training windows of one text: the id before, and CONTEXT ids; the last one is filled with -1."""
    n = -(-len(ids) // CONTEXT)
    padded = np.full(n * CONTEXT + 1, -1, np.int32)
    padded[0], padded[1 : len(ids) + 1] = start, ids
    return padded[np.arange(n)[:, None] * CONTEXT + np.arange(CONTEXT + 1)]


class Scorer:
    """The model with what depends on one id alone laid out in tables."""

    def __init__(self, model: Model):
        p, self.tree, self.size = model.p, model.tree, model.size
        self.q, self.k = p["e"] @ p["q"] / np.float32(WIDTH**0.5), p["e"] @ p["k"]
        self.mixed, self.direct, self.second = p["e"] @ p["v"] @ p["o"], p["e"] @ p["u"], p["e"] @ p["t"]
        self.second[self.size + 1] = 0
        self.w, self.c, self.z = p["w"], p["c"], p["z"]
        # Row 2 * node + turn is what a state is compared with, in favour of the other turn.
        self.against = np.stack([p["n"], -p["n"]], axis=1).reshape(-1, WIDTH)
        self.offset = np.stack([p["a"][:, 0], -p["a"][:, 0]], axis=1).ravel()
        self.turns = model.tree.nodes.astype(np.int64) * 2 + model.tree.turns
        self.begin, self.length = model.tree.begin[:-1].astype(np.int64), np.diff(model.tree.begin).astype(np.int64)
        apart = _apart(CONTEXT)[CONTEXT - STRIDE :]
        self.near = np.where(apart >= 0, p["b"][np.maximum(apart, 0)], np.float32(-1e9))

    def log10(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each id of texts strung together; every position is scored once.

        Windows of CONTEXT positions overlap: each scores its last STRIDE ones, which
        see at least CONTEXT - STRIDE before them where the text has so many.
        """
        total = len(ids)
        out = np.empty(total)
        if not total:
            return out
        before = np.empty(total, np.int64)
        before[1:] = ids[:-1]
        length = np.diff(offsets)
        before[offsets[:-1][length > 0]] = self.size
        blocks = -(-length // STRIDE)
        text = np.repeat(np.arange(len(length)), blocks)
        block = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low, begin, end = offsets[text], offsets[text] + block * STRIDE, offsets[text + 1]
        back, ahead = np.arange(STRIDE - CONTEXT, STRIDE), np.arange(STRIDE)
        for a in range(0, len(text), BATCH):
            part = slice(a, a + BATCH)
            at = begin[part, None] + back
            inside = (at >= low[part, None]) & (at < end[part, None])
            seen = np.where(inside, before[np.clip(at, 0, total - 1)], self.size + 1)
            here = seen[:, CONTEXT - STRIDE :]
            s = self.q.take(here, 0) @ self.k.take(seen, 0).transpose(0, 2, 1)
            s += self.near
            edge = np.flatnonzero(~inside.all(axis=1))
            s[edge] += np.where(inside[edge], np.float32(0), np.float32(-1e9))[:, None, :]
            s -= _most(s)
            np.exp(s, out=s)
            mixed = s @ self.mixed.take(seen, 0)
            mixed /= np.einsum("bij->bi", s)[:, :, None]
            real = inside[:, CONTEXT - STRIDE :]
            h = mixed[real]
            h += self.direct.take(here[real], 0)
            h += self.second.take(seen[:, CONTEXT - STRIDE - 1 : -1][real], 0)
            h += np.maximum(h @ self.w + self.c, 0) @ self.z
            where = (begin[part, None] + ahead)[real]
            own = ids[where]
            n = self.length.take(own)
            first = np.cumsum(n) - n
            turn = self.turns.take(np.repeat(self.begin.take(own) - first, n) + np.arange(int(n.sum())))
            odds = np.einsum("rd,rd->r", self.against.take(turn, 0), np.repeat(h, n, axis=0))
            odds += self.offset.take(turn)
            np.clip(odds, -MOST, MOST, out=odds)
            np.exp(odds, out=odds)
            odds += 1
            out[where] = -np.log10(np.multiply.reduceat(odds.astype(np.float64), first))
        return out
