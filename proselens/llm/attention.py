"""A one-layer causal self-attention model over subword ids, in numpy; its output weighs EXPERTS word distributions.

A text's pieces lie in blocks of SPAN behind an empty one. Every position attends to itself and to what came before in its
block and the block before, so windows overlap by half and each position is computed once. Training and scoring see the same windows.
"""

from __future__ import annotations

import math

import numpy as np

SPAN = 16
WIDTH, KEY, EXPERTS = 16, 8, 8
LENGTH = 2 * SPAN
#: The query at i sees the keys up to SPAN + i; their distances index the position bias.
GAP = SPAN + np.arange(SPAN)[:, None] - np.arange(LENGTH)[None, :]
SEEN = GAP >= 0
GAP = np.where(SEEN, GAP, 0)
#: Blocks computed at once.
CHUNK = 512


#: Arrays that every batch writes anew, kept between batches: fresh memory costs more than what is computed in it.
_ROOM: dict = {}


def room(name: str, like: np.ndarray, *shape: int) -> np.ndarray:
    """An array of like's type, undefined, whose memory is that of the last one of this name."""
    size, key = math.prod(shape), (name, like.dtype)
    if key not in _ROOM or len(_ROOM[key]) < size:
        _ROOM[key] = np.empty(size, dtype=like.dtype)
    return _ROOM[key][:size].reshape(shape)


def got(name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, axis=0, out=room(name, table, *at.shape, table.shape[1]), mode="clip")


class Attention:
    NAMES = ("e", "wq", "wk", "wv", "bias", "w1", "w2", "c")

    def __init__(self, rows: int, seed: int = 0, prior: np.ndarray | None = None):
        """rows: of the embedding; row number `rows` is no piece and no query sees it. prior: of the experts."""
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.e = (r.standard_normal((rows, WIDTH)) * 0.3).astype(np.float32)
        self.wq, self.wk, self.wv = draw(WIDTH, KEY), draw(WIDTH, KEY), draw(WIDTH, WIDTH)
        self.bias = np.zeros(LENGTH, dtype=np.float32)
        self.w1, self.w2, self.c = draw(WIDTH, EXPERTS) * np.float32(0.1), draw(WIDTH, EXPERTS) * np.float32(0.1), np.zeros(EXPERTS, dtype=np.float32)
        if prior is not None:
            self.c[:] = np.log(np.maximum(prior, 1e-9))

    def tables(self) -> tuple[np.ndarray, ...]:
        """Queries, keys and what values give the outputs, and direct outputs, of every row and of the one that is no piece."""
        made = self.e @ self._maps()
        out, at = [], 0
        for size, last in ((KEY, 1), (KEY, 0), (EXPERTS, 1)):
            x = np.zeros((len(self.e) + 1, size + 1), dtype=made.dtype)
            x[:-1, :-1], x[:, -1] = made[:, at : at + size], last
            out, at = [*out, x], at + size
        out[1][-1, -1] = -1e5
        z = np.zeros((len(self.e) + 1, EXPERTS), dtype=made.dtype)
        np.add(made[:, at:], self.c, out=z[:-1])
        return *out, z

    def _maps(self) -> np.ndarray:
        """From an embedding to its query, key, value's outputs and direct outputs."""
        return np.concatenate((self.wq / np.sqrt(np.float32(KEY)), self.wk, self.wv @ self.w2, self.w1), axis=1)

    def mask(self) -> np.ndarray:
        """What each place of a block adds for each key of its window."""
        return np.where(SEEN, self.bias[GAP], np.float32(-1e5))

    def weights(self, rows: np.ndarray, place: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """(places, EXPERTS): the experts' weights after the piece at each place. rows: (blocks, SPAN), each text's blocks behind an empty
        one. place: sorted, as block * SPAN + position. Only these places ask; blocks with the same number of them are computed together."""
        q, k, u, z1 = tables
        out, mask, flat = np.empty((len(place), EXPERTS), dtype=np.float32), self.mask(), rows.reshape(-1)
        live, first, n = np.unique(place // SPAN, return_index=True, return_counts=True)
        for m in np.unique(n).tolist():
            of = np.flatnonzero(n == m)
            for a in range(0, len(of), CHUNK):
                b = live[of[a : a + CHUNK]]
                seen = np.concatenate((rows[b - 1], rows[b]), axis=1)
                at = first[of[a : a + CHUNK], None] + np.arange(m)
                asks = place[at]
                own = flat[asks]
                s = np.matmul(got("q", q, own), got("k", k, seen).transpose(0, 2, 1), out=room("s", q, *own.shape, LENGTH))
                s += got("ds", mask, asks % SPAN)
                np.minimum(s, np.float32(60), out=s)
                np.exp(s, out=s)
                o = np.matmul(s, got("u", u, seen), out=room("o", q, *own.shape, EXPERTS + 1)).reshape(-1, EXPERTS + 1)
                z = z1.take(own.ravel(), axis=0)
                z += o[:, :-1] / o[:, -1:]
                np.exp(np.clip(z, -60, 60, out=z), out=z)
                z /= np.einsum("ij->i", z)[:, None]
                out[at.ravel()] = z
        return out

    def train(self, batches, rate: float = 0.01) -> Attention:
        """One pass of Adam over batches of (ids, valid, likelihoods)."""
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in self.NAMES} for _ in range(2))
        step = 0
        for batch in batches:
            step += 1
            for k, g in self.gradients(*batch).items():
                x, g = getattr(self, k), g.astype(np.float32)
                by = room("by", x, *x.shape)
                m[k] *= 0.9
                m[k] += np.multiply(g, 0.1, out=by)
                v[k] *= 0.99
                g *= g
                v[k] += np.multiply(g, 0.01, out=by)
                np.sqrt(np.multiply(v[k], 1 / (1 - 0.99**step), out=by), out=by)
                by += 1e-8
                np.divide(m[k], by, out=by)
                by *= rate / (1 - 0.9**step)
                setattr(self, k, x - by)
        return self

    def gradients(self, ids: np.ndarray, valid: np.ndarray, like: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of what follows the valid positions. ids: (windows, LENGTH), len(e) for none;
        valid: (windows, SPAN); like: (windows, SPAN, EXPERTS), the probability of what follows by each expert, or (valid positions, EXPERTS). `given` then
        holds what the model gave to what follows, (windows, SPAN)."""
        n = valid.sum(axis=1)
        by = np.argsort(n, kind="stable")  # windows with the same number of places are computed together
        ids, n = ids[by], n[by]
        asks = np.flatnonzero(valid[by])  # only these places ask
        came = by[asks // SPAN] * SPAN + asks % SPAN
        own, at = ids[:, SPAN:].ravel()[asks], asks % SPAN
        if like.ndim == 2:  # of valid positions alone
            like = like.take(np.cumsum(valid.ravel())[came] - 1, axis=0)
        else:
            like = like.reshape(-1, EXPERTS).take(came, axis=0)
        edge = np.flatnonzero(np.diff(n, prepend=-1, append=SPAN + 1))
        ends = np.concatenate(([0], np.cumsum(n)))
        groups = [(slice(a, b), slice(ends[a], ends[b]), (b - a, int(n[a]), -1)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()) if n[a]]
        tq, tk, tu, tz = self.tables()
        q, k, u = got("q", tq, own), got("k", tk, ids), got("u", tu, ids)
        s, o = room("s", q, len(asks), LENGTH), room("o", q, len(asks), EXPERTS + 1)
        for w, x, shape in groups:
            np.matmul(q[x].reshape(shape), k[w].transpose(0, 2, 1), out=s[x].reshape(shape))
        s += got("ds", self.mask(), at)
        np.exp(np.minimum(s, np.float32(60), out=s), out=s)
        for w, x, shape in groups:
            np.matmul(s[x].reshape(shape), u[w], out=o[x].reshape(shape))
        norm = o[:, -1:].copy()
        o /= norm  # the last column is one
        g = tz.take(own, axis=0)
        g += o[:, :-1]
        np.exp(np.minimum(g, np.float32(60), out=g), out=g)
        g /= np.einsum("ij->i", g)[:, None]
        r = g * like
        given = np.einsum("ij->i", r)
        self.given = np.zeros(valid.shape, dtype=g.dtype)
        self.given.reshape(-1)[came] = given
        r /= np.maximum(given, 1e-35)[:, None]
        g -= r
        g /= max(1.0, float(len(asks)))
        dz, do = g, np.empty_like(o)
        do[:, :-1] = dz
        do[:, -1] = -np.einsum("ij,ij->i", dz, o[:, :-1])
        do /= norm
        ds, dq, dk, du = (room(f"d{name}", x, *x.shape) for name, x in (("s", s), ("q", q), ("k", k), ("u", u)))
        idle = int(np.searchsorted(n, 1))  # windows that nothing asks
        dk[:idle], du[:idle] = 0, 0
        for w, x, shape in groups:
            np.matmul(do[x].reshape(shape), u[w].transpose(0, 2, 1), out=ds[x].reshape(shape))
            np.matmul(s[x].reshape(shape).transpose(0, 2, 1), do[x].reshape(shape), out=du[w])
        ds *= s
        for w, x, shape in groups:
            np.matmul(ds[x].reshape(shape), k[w], out=dq[x].reshape(shape))
            np.matmul(ds[x].reshape(shape).transpose(0, 2, 1), q[x].reshape(shape), out=dk[w])

        found, column, j = room("found", self.e, len(self.e), 2 * KEY + 2 * EXPERTS), room("column", np.zeros(0), ids.size), 0
        for rows, x in ((own, dq[:, :-1]), (ids.ravel(), dk.reshape(-1, KEY + 1)[:, :-1]), (ids.ravel(), du.reshape(-1, EXPERTS + 1)[:, :-1]), (own, dz)):
            rows = rows.astype(np.intp)
            for i in range(x.shape[1]):  # by row
                column[: len(x)] = x[:, i]
                found[:, j] = np.bincount(rows, weights=column[: len(x)], minlength=len(self.e) + 1)[:-1]
                j += 1
        placed = (np.arange(SPAN)[:, None] == at).astype(s.dtype) @ ds
        wq, wk, eu, w1 = np.split(self.e.T @ found, [KEY, 2 * KEY, 2 * KEY + EXPERTS], axis=1)
        return {
            "e": found @ self._maps().T, "wq": wq / np.sqrt(np.float32(KEY)), "wk": wk, "wv": eu @ self.w2.T, "bias": np.bincount(GAP[SEEN], weights=placed[SEEN], minlength=LENGTH),
            "w1": w1, "w2": self.wv.T @ eu, "c": found[:, -EXPERTS:].sum(axis=0),
        }
