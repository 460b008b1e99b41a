"""A small causal self-attention language model over words spelt in subword symbols, in numpy, with its own gradients.

A text is a sequence of tokens: words, each a run of subword symbols, and an end. Tokens are laid out in blocks of
``BLOCK``. A context window is a block and the one before it: the later block's tokens are scored, each once, and attend
to all that stands before them in the window, so windows overlap by half. With one layer the keys and values of a block
serve both windows that it is in.

A token comes in as the embeddings of its first and last symbol. One attention head, with a bias for each pair of places
in the window, and one hidden layer give the state from which the next token is told: its first symbol by a softmax over
groups of symbols and one within the group; then, from the state and the symbol so far, whether the word ends, and if
not, its next symbol by two such steps. First and later symbols have groups of their own, so a word's probability is
the product of its parts and all words together have probability one.

All weights of a softmax are powers of two. Single-precision ones are made by setting exponent and mantissa bits, which
joins the powers at whole exponents by straight lines: as positive and rising as the power itself, at a tenth of its
time. Double precision, for tests of the gradients, has the power itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIM, HIDDEN, BLOCK, GROUP = 16, 16, 16, 32
#: Exponents are held within this, so that no softmax needs its largest first.
BOUND = 60
_FAR = -1e4
#: Symbols of a word that are added place by place, all words together.
_LONG = 16
#: Fixed values of single precision: mantissa bits, and the exponent's offset.
_STEP, _ONE = np.float32(1 << 23), np.float32(127 << 23)
#: What stands ahead of a place in its window.
_AHEAD = np.triu(np.ones((BLOCK, 2 * BLOCK), dtype=bool), BLOCK + 1)

Weights = dict[str, np.ndarray]


def shapes(n_first: int, n_later: int) -> dict[str, tuple[int, ...]]:
    """Of the model's arrays, for so many first symbols and so many later ones."""
    g1, g2, n = -(-n_first // GROUP), -(-n_later // GROUP), n_first + n_later
    return {
        "came_first": (n, DIM), "came_last": (n, DIM), "said": (n, DIM), "place": (BLOCK, 2 * BLOCK), "q": (DIM, DIM), "kv": (DIM, 2 * DIM),
        "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, DIM), "end": (DIM,), "end_bias": (1,),
        "first_group": (DIM, g1), "first_group_bias": (g1,), "first": (g1, DIM, GROUP), "first_bias": (g1, GROUP),
        "later_group": (DIM, g2), "later_group_bias": (g2,), "later": (g2, DIM, GROUP), "later_bias": (g2, GROUP),
    }


def views(flat: np.ndarray, of: dict[str, tuple[int, ...]]) -> Weights:
    """The arrays as parts of one vector."""
    out, at = {}, 0
    for name, shape in of.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def size(of: dict[str, tuple[int, ...]]) -> int:
    return sum(int(np.prod(s)) for s in of.values())


def initial(first: np.ndarray, later: np.ndarray, seed: int = 7) -> np.ndarray:
    """Small random weights; the output biases are the frequencies, as exponents, of counts of first and later symbols."""
    of = shapes(len(first), len(later))
    flat = np.zeros(size(of), dtype=np.float32)
    p, rng = views(flat, of), np.random.default_rng(seed)
    by = {"came_first": 4, "came_last": 4, "said": 4, "q": 2 * DIM, "kv": 2 * DIM, "w1": DIM, "w2": 4 * HIDDEN, "first_group": 16 * DIM, "first": 16 * DIM, "later_group": 16 * DIM, "later": 16 * DIM}
    for name, k in by.items():
        p[name][:] = rng.standard_normal(of[name]) / np.sqrt(k)
    for kind, counts in (("first", first), ("later", later)):
        padded = np.zeros(p[kind + "_bias"].size)
        padded[: len(counts)] = counts + 0.5
        padded = padded.reshape(-1, GROUP)
        with np.errstate(divide="ignore"):
            p[kind + "_group_bias"][:] = np.log2(padded.sum(axis=1) / padded.sum())
            p[kind + "_bias"][:] = np.maximum(np.log2(padded / padded.sum(axis=1, keepdims=True)), -40)
    return flat


@dataclass
class Tokens:
    """Tokens of sequences laid end to end, and the symbols of their words laid end to end."""

    counts: np.ndarray  # tokens of each sequence, its end included
    first: np.ndarray  # each token's first and last symbol; an end has the end symbol as both
    last: np.ndarray
    begin: np.ndarray  # where each token's symbols begin, and one place more; an end has none
    symbols: np.ndarray
    end: int  # the end symbol, which also stands before each sequence

    def came(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last symbol of what stands before each token."""
        out = []
        for x in (self.first, self.last):
            before = np.empty_like(x)
            before[1:], before[:1] = x[:-1], self.end
            out.append(before)
        return out[0], out[1]


def blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of sequences of ``counts`` tokens laid end to end: each block's tokens (n, BLOCK), which of them exist
    (every token is in one block), and which blocks are the first of their sequence, with no context before them."""
    per = -(-counts // BLOCK)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    ends = np.repeat(np.cumsum(counts), per)
    at = (np.repeat(np.cumsum(counts) - counts, per) + k * BLOCK)[:, None] + np.arange(BLOCK)
    exists = at < ends[:, None]
    return np.where(exists, at, ends[:, None] - 1), exists, k == 0


def _ready(p: Weights) -> Weights:
    """The arrays that give exponents, scaled to what ``_powers`` takes."""
    if p["q"].dtype != np.float32:
        return p
    scaled = {k: p[k] * _STEP for k in ("q", "place", "first_group", "first", "later_group", "later")}
    return p | scaled | {k: p[k] * _STEP + _ONE for k in ("first_group_bias", "first_bias", "later_group_bias", "later_bias", "place")}


def _powers(e: np.ndarray) -> np.ndarray:
    """Two to the power of each, from exponents or, in single precision, scaled ones; 0 from those far below."""
    if e.dtype != np.float32:
        return np.exp2(np.clip(e, -2000, BOUND))
    np.clip(e, 0, BOUND * _STEP + _ONE, out=e)
    return e.astype(np.int32).view(np.float32)


def _hidden(p: Weights, came_first: np.ndarray, came_last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States (n * BLOCK, DIM) of n blocks, from ready weights. What came has n + 1 blocks: the one before all leads."""
    n = len(came_first) - 1
    x = p["came_first"].take(came_first.reshape(-1), axis=0)
    x += p["came_last"].take(came_last.reshape(-1), axis=0)
    kv = (x @ p["kv"]).reshape(n + 1, BLOCK, 2 * DIM)
    kv = np.concatenate([kv[:-1], kv[1:]], axis=1)
    k, v = kv[..., :DIM], kv[..., DIM:]
    q = (x[BLOCK:] @ p["q"]).reshape(n, BLOCK, DIM)
    a = q @ k.transpose(0, 2, 1)
    a += np.where(_AHEAD, _FAR * float(_STEP), p["place"]).astype(a.dtype)
    a = _powers(a)  # batched masked attention: what stands ahead weighs nothing
    a[first, :, :BLOCK] = 0
    total = a.reshape(-1, 2 * BLOCK) @ np.ones((2 * BLOCK, 1), dtype=a.dtype)
    o = (a @ v).reshape(-1, DIM)
    o /= total
    y = x[BLOCK:] + o
    r = y @ p["w1"]
    r += p["b1"]
    np.maximum(r, 0, out=r)
    h = r @ p["w2"]
    h += y
    return h, (x, q, k, v, a, total, o, y, r)


def _weighed(z: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights at states, and their sums."""
    e = z @ w
    e += b
    e = _powers(e)
    return e, e @ np.ones(e.shape[1], dtype=e.dtype)


def _by_group(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(group.astype(np.uint8) if n <= 256 else group, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n))))


def _told(p: Weights, kind: str, z: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Probability of each symbol of a kind at states (m, DIM)."""
    group, inner, n = symbol // GROUP, symbol % GROUP, len(p[kind])
    e, total = _weighed(z, p[kind + "_group"], p[kind + "_group_bias"])
    told = e[np.arange(len(z)), group] / total
    order, edges = _by_group(group, n)
    z, inner = z.take(order, axis=0), inner[order]
    within = np.empty_like(told)
    for g in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[g], edges[g + 1])
        e, total = _weighed(z[own], p[kind][g], p[kind + "_bias"][g])
        within[own] = e[np.arange(len(e)), inner[own]] / total
    told[order] *= within
    return told


def _step_back(e: np.ndarray, total: np.ndarray, target: np.ndarray, z: np.ndarray, w: np.ndarray, dw: np.ndarray, db: np.ndarray) -> np.ndarray:
    """Gradients of -log2(e[target] / total) summed over rows: into ``dw`` and ``db``, and those of z returned."""
    at = np.arange(0, e.size, e.shape[1])
    at += target
    e.reshape(-1)[at] -= total
    share = (1 / total)[:, None]
    np.matmul((z * share).T, e, out=dw)
    np.matmul(share.T, e, out=db[None])
    dz = e @ w.T
    dz *= share
    return dz


def _told_back(p: Weights, ready: Weights, d: Weights, kind: str, z: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Gradients, by state, of the summed loss of symbols of a kind."""
    group, inner, n = symbol // GROUP, symbol % GROUP, len(p[kind])
    order, edges = _by_group(group, n)
    z, group, inner = z.take(order, axis=0), group[order], inner[order]
    e, total = _weighed(z, ready[kind + "_group"], ready[kind + "_group_bias"])
    dz = _step_back(e, total, group, z, p[kind + "_group"], d[kind + "_group"], d[kind + "_group_bias"])
    for g in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[g], edges[g + 1])
        e, total = _weighed(z[own], ready[kind][g], ready[kind + "_bias"][g])
        dz[own] += _step_back(e, total, inner[own], z[own], p[kind][g], d[kind][g], d[kind + "_bias"][g])
    out = np.empty_like(dz)
    out[order] = dz
    return out


def _rows(t: Tokens, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens low to high - 1: their symbols, each symbol's token (from 0), and whether a symbol is its word's last."""
    begin, end = int(t.begin[low]), int(t.begin[high])
    sizes = np.diff(t.begin[low : high + 1])
    last = np.zeros(end - begin, dtype=bool)
    last[(t.begin[low + 1 : high + 1] - begin - 1)[sizes > 0]] = True
    return t.symbols[begin:end].astype(np.int64), np.repeat(np.arange(high - low), sizes), last


def _window(t: Tokens, came: tuple[np.ndarray, np.ndarray], at: np.ndarray, low: int, high: int) -> list[np.ndarray]:
    """What came in blocks low to high - 1, led by the block before."""
    own = at[max(low - 1, 0) : high]
    own = own if low else np.concatenate([at[:1], own])
    return [c[own].astype(np.int64) for c in came]


def _ends(p: Weights, z: np.ndarray) -> np.ndarray:
    """Probability that the word ends, at states; it is never quite 0 or 1."""
    e = z @ -p["end"]
    e -= p["end_bias"]
    np.clip(e, -20, 20, out=e)
    return 1 / (1 + np.exp2(e))


def log_probabilities(p: Weights, t: Tokens, n_first: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each token but for what is below, and of each symbol but the first of its word, with
    the word's going on before it and its end after the last. A token's own part is that of its first symbol."""
    at, exists, start = blocks(t.counts)
    came, p = t.came(), _ready(p)
    token, symbol = np.empty(len(t.first), p["kv"].dtype), np.empty(len(t.symbols), p["kv"].dtype)
    for low in range(0, len(at), batch):
        high = min(low + batch, len(at))
        h, _ = _hidden(p, *_window(t, came, at, low, high), start[low:high])
        a, b = int(at[low, 0]), int(at[high - 1, -1]) + 1
        h = h[exists[low:high].reshape(-1)]
        token[a:b] = np.log(_told(p, "first", h, t.first[a:b].astype(np.int64)))
        said, own, last = _rows(t, a, b)
        z = h.take(own, axis=0)
        z += p["said"].take(said, axis=0)
        np.maximum(z, 0, out=z)
        ends = _ends(p, z)
        found = np.log(np.where(last, ends, 1 - ends))
        on = np.flatnonzero(~last)
        if len(on):
            found[on] += np.log(_told(p, "later", z.take(on, axis=0), said[on + 1] - n_first))
        symbol[t.begin[a] : t.begin[b]] = found
    return token, symbol


def _summed(rows: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Sums of rows by place."""
    order = np.argsort(at.astype(np.uint16) if len(out) <= 1 << 16 else at, kind="stable")
    ordered = at[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out[ordered[heads]] = np.add.reduceat(rows.take(order, axis=0), heads, axis=0)


def gradients(p: Weights, d: Weights, t: Tokens, came: tuple[np.ndarray, np.ndarray], placed: tuple[np.ndarray, np.ndarray, np.ndarray], low: int, high: int, n_first: int) -> int:
    """The gradients of the loss (minus log2 probability, summed over the tokens of blocks low to high - 1) go into ``d``;
    returns the number of tokens."""
    at, exists, start = placed
    for x in d.values():
        x[...] = 0
    first = start[low:high]
    came_first, came_last = _window(t, came, at, low, high)
    ready = _ready(p)
    h, (x, q, k, v, a, total, o, y, r) = _hidden(ready, came_first, came_last, first)
    if ready is not p:
        q /= _STEP
    n = len(first)
    lo, hi = int(at[low, 0]), int(at[high - 1, -1]) + 1
    there = np.flatnonzero(exists[low:high].reshape(-1))
    hs = h.take(there, axis=0)
    dhs = _told_back(p, ready, d, "first", hs, t.first[lo:hi].astype(np.int64))
    said, own, last = _rows(t, lo, hi)
    if len(said):
        # Symbols that another follows in their word, then the last ones.
        on, off = np.flatnonzero(~last), np.flatnonzero(last)
        order, m = np.concatenate([on, off]), len(on)
        follows, said, own = said[on + 1] - n_first, said[order], own[order]
        z = hs.take(own, axis=0)
        z += p["said"].take(said, axis=0)
        np.maximum(z, 0, out=z)
        ends = _ends(p, z)
        ends[m:] -= 1
        d["end"][:], d["end_bias"][:] = ends @ z, ends.sum()
        dz = ends[:, None] * p["end"]
        if m:
            dz[:m] += _told_back(p, ready, d, "later", z[:m], follows)
        dz *= z > 0
        _summed(dz, said, d["said"])
        dhs[own[m:]] += dz[m:]
        if m:
            heads = np.flatnonzero(np.concatenate(([True], own[1:m] != own[: m - 1])))
            sizes = np.diff(np.append(heads, m))
            long = heads[sizes > _LONG]
            for j in range(min(_LONG, int(sizes.max()))):
                here = heads[sizes > j] if j else heads
                dhs[own[here]] += dz.take(here + j, axis=0)
            for i, size_ in zip(long.tolist(), sizes[sizes > _LONG].tolist(), strict=True):
                dhs[own[i]] += dz[i + _LONG : i + size_].sum(axis=0)
    dh = np.zeros_like(h)
    dh[there] = dhs
    np.matmul(r.T, dh, out=d["w2"])
    du = dh @ p["w2"].T
    du *= r > 0
    np.matmul(y.T, du, out=d["w1"])
    du.sum(axis=0, out=d["b1"])
    dy = du @ p["w1"].T
    dy += dh
    do = dy / total
    rise = do * do.dtype.type(np.log(2))
    inner = (rise * o) @ np.ones((DIM, 1), dtype=do.dtype)
    do, rise = do.reshape(n, BLOCK, DIM), rise.reshape(n, BLOCK, DIM)
    ds = rise @ v.transpose(0, 2, 1)
    ds -= inner.reshape(n, BLOCK, 1)
    ds *= a
    d["place"][:] = np.where(_AHEAD, 0, ds.sum(axis=0))
    dk, dv = ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do
    each = np.empty((n + 1, BLOCK, 2 * DIM), dtype=dk.dtype)
    for part, back in ((each[..., :DIM], dk), (each[..., DIM:], dv)):
        part[:-1] = back[:, :BLOCK]
        part[-1] = 0
        part[1:] += back[:, BLOCK:]
    each = each.reshape(-1, 2 * DIM)
    dq = (ds @ k).reshape(-1, DIM)
    np.matmul(x[BLOCK:].T, dq, out=d["q"])
    np.matmul(x.T, each, out=d["kv"])
    dx = each @ p["kv"].T
    dy += dq @ p["q"].T
    dx[BLOCK:] += dy
    _summed(dx, came_first.reshape(-1), d["came_first"])
    _summed(dx, came_last.reshape(-1), d["came_last"])
    return hi - lo


class Adam:
    """Steps of one vector; the rate falls with the root of the steps taken."""

    def __init__(self, flat: np.ndarray, rate: float) -> None:
        self.flat, self.rate, self.t = flat, rate, 0
        self.m, self.v = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        scale = self.rate / np.sqrt(1 + self.t / 100) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.m += (g - self.m) * np.float32(0.1)
        self.v += (g * g - self.v) * np.float32(0.01)
        self.flat -= np.float32(scale) * self.m / (np.sqrt(self.v) + np.float32(1e-8))
