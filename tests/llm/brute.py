"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w = SPACE.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)})
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat


def substring(docs, window=35):
    words = [(i, SPACE.findall(t or "")) for i, t in docs]
    n = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def lines(docs, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) and n[key(x)] >= least)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def contamination(docs, items, length=13):
    windows = defaultdict(set)
    for item, t in items:
        w = LETTERS.findall((t or "").translate(LOWER))
        if w:
            for k in range(max(1, len(w) - length + 1)):
                windows[tuple(w[k : k + length])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = LETTERS.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text, size=3):
    w = SPACE.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints: dict, limit=2) -> dict:
    """Smallest id reachable by links of at most ``limit`` differing bits."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= limit:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def attention_log10(model, speller, words):
    """log10 of the attention model's probability of each word and the end, one position after another."""
    t, w = model.table, {k: v.astype(np.float64) for k, v in model.weights().items()}

    def power(x):
        whole = np.floor(x)
        return np.exp2(whole) * (1 + x - whole)

    def choose(kind, z, symbol):
        g = power(z @ w[kind + "_group"] + w[kind + "_group_bias"])
        i = power(z @ w[kind][symbol // 32] + w[kind + "_bias"][symbol // 32])
        return g[symbol // 32] / g.sum() * i[symbol % 32] / i.sum()

    ids = [speller.spell([x.encode()])[1] for x in words]
    spelt = [[int(t.of[i]) for i in x] for x in ids] + [[t.end]]
    came = [[t.end], *spelt[:-1]]
    x = [w["came_first"][s[0]] + w["came_last"][s[-1]] for s in came]
    out = []
    for at, symbols in enumerate(spelt):
        block = at // 16
        context = range(max(0, 16 * (block - 1)), at + 1)
        q = x[at] @ w["q"]
        a = np.array([power(q @ (x[k] @ w["kv"])[:16] + w["place"][at % 16, k - 16 * (block - 1)]) for k in context])
        y = x[at] + sum(a[n] * (x[k] @ w["kv"])[16:] for n, k in enumerate(context)) / a.sum()
        h = y + np.maximum(y @ w["w1"] + w["b1"], 0) @ w["w2"]
        p = np.log10(choose("first", h, symbols[0]))
        if at < len(words):
            for n, s in enumerate(symbols):
                z = np.maximum(h + w["said"][s], 0)
                end = 1 / (1 + np.exp2(-(z @ w["end"] + w["end_bias"][0])))
                p += np.log10(end if n == len(symbols) - 1 else (1 - end) * choose("later", z, symbols[n + 1] - t.n_first))
            p += sum(t.log_share[i] for i in ids[at]) / np.log(10)
        out.append(p)
    return out
