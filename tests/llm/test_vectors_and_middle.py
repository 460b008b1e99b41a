from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbergrid.llm import chat, codes, fim, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, v string, d double, n int, row int, `order` int"


def table_of(spark, rows, partitions=3):
    return spark.createDataFrame([(i, x, label, "v", 0.5, 1, 2, 3) for i, x, label in rows], SCHEMA).repartition(partitions)


def usable(rows):
    return [(i, x, label) for i, x, label in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]


def spread(n, width, seed=5, copies=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, width))
    out = [(i, (middles[i % 5] + rng.normal(size=width) * 0.6).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    return out + [(n + i, out[3][1], 1) for i in range(copies)]


ODD = [(900, None, 1), (901, [], 1), (902, [1.0] * 15 + [None], 2), (903, [1.0] * 15 + [float("nan")], 2), (904, [float("inf")] * 16, None), (None, [0.5] * 16, 1)]


def brute_top(rows, k, every, scale):
    whole = [(i, [math.floor(scale * c) for c in x]) for i, x, _ in usable(rows)]
    out = []
    for q, a in sorted({(i, tuple(x)) for i, x in whole if i % every == 0}):
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [spread(400, 16, copies=150) + ODD, spread(7, 16), ODD, [], [(100, [0.0] * 16, 1), (200, [0.0] * 16, 1)], [(i, [1e-3 * (i % 2), -5.0, 70000.0], 1) for i in range(0, 600, 3)]])
def test_search_equals_all_products(spark, monkeypatch, rows):
    """Ties and copies, too few candidates, no candidates, no rows; blocks small enough that a hot vector has many."""
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 64 * 16)
    want = brute_top([(i, [max(-65536.0, min(65536.0, c)) if c is not None and math.isfinite(c) else c for c in x] if x else x, g) for i, x, g in rows], 4, 50, 1024)
    got = topk.search(table_of(spark, rows), k=4, every=50)
    assert sorted(map(tuple, got.collect())) == want
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_search_of_repeated_rows_and_lengths(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, -1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [0.5, 0.5, 9.0], 1), (3, [-1.0, 0.0], 2)]
    wide = [(i, x + [0.0] * (3 - len(x)), g) for i, x, g in rows]
    assert sorted(map(tuple, topk.search(table_of(spark, rows), k=3, every=100).collect())) == brute_top(wide, 3, 100, 1024)


def test_search_leaves_blocks_out(spark, monkeypatch):
    """Vectors in clusters far apart: a query looks at few blocks after the first round, and its result is right."""
    monkeypatch.setattr(topk.scratch, "drop", lambda table: None)
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 64 * 8)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 8))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    rows = [(i, (middles[i % 40] + rng.normal(size=8) * 0.01).tolist(), 1) for i in range(1200)]
    asked = []
    own = topk._asked
    monkeypatch.setattr(topk, "_asked", lambda state, found, first, last: asked.append((own(state, found, first, last), len(found.blocks.pivot))) or asked[-1][0])
    assert sorted(map(tuple, topk.search(table_of(spark, rows), k=5, every=100).collect())) == brute_top(rows, 5, 100, 1024)
    pairs = sum(a.select((F.length("qid") / 8).alias("n")).agg(F.sum("n")).first()[0] or 0 for a, _ in asked)
    assert asked[0][1] > 30 and pairs < 12 * asked[0][1] / 3


def test_blocks_of_an_annulus_that_is_too_large():
    class Annulus:
        def __init__(self, pivot, annulus, n):
            self.pivot, self.annulus, self.n, self.lo, self.hi = pivot, annulus, n, annulus, annulus + 0.5

    told, blocks = topk._cut([Annulus(0, 1, 30), Annulus(0, 2, 60), Annulus(0, 3, 20), Annulus(0, 4, 250), Annulus(0, 5, 1), Annulus(1, 1, 5)], 100)
    assert told == [(0, 1, 0), (0, 2, 0), (0, 3, 1), (0, 4, 2), (0, 5, 3), (1, 1, 4)]
    assert blocks.dealt.tolist() == [1, 1, 3, 1, 1] and blocks.lo.tolist() == [1, 3, 4, 5, 1] and blocks.hi.tolist() == [2.5, 3.5, 4.5, 5.5, 1.5]


def brute_codes(rows, parts, entries, rounds, scale):
    """Everything anew in every round, in whole numbers of any size."""
    whole = [(i, [math.floor(scale * c) for c in x], g) for i, x, g in usable(rows)]
    width = max((len(v) for _, v, _ in whole), default=0)
    size = max(1, -(-width // parts))
    whole = [(i, v + [0] * (size * parts - len(v)), g) for i, v, g in whole]
    ids = sorted({i for i, _, _ in whole})[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(min(v for j, v, _ in whole if j == i), p) for i in ids] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        took = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in whole:
            for p in range(parts):
                took[p][nearest(v, p)[1]].append(cut(v, p))
        for p in range(parts):
            for e, xs in took[p].items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    told = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    out = [(i, [nearest(v, p) for p in range(parts)], g) for i, v, g in whole]
    by_label = defaultdict(int)
    for _, c, g in out:
        by_label[g] += sum(d for d, _ in c)
    return sorted((i, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), by_label[g], told) for i, c, g in out)


@pytest.mark.parametrize("rows", [spread(150, 16, copies=60) + ODD, spread(5, 16), spread(40, 13) + [(5, [0.25] * 4, 1), (5, [0.25] * 4, 1)], ODD, [], [(i, [3e4 * (i % 3)] * 16, 1) for i in range(30)]])
@pytest.mark.parametrize("entries", [8, 64])
def test_codes_equal_those_made_anew(spark, rows, entries):
    got = codes.report(table_of(spark, rows), codes.Settings(parts=4, entries=entries))
    assert sorted(map(tuple, got.collect())) == brute_codes(rows, 4, entries, 2, 256)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_rounds_shuffle_changes_alone(spark, monkeypatch):
    seen = []
    own = codes.changes
    monkeypatch.setattr(codes, "changes", lambda rows, parts, size: seen.append(rows) or own(rows, parts, size))
    monkeypatch.setattr(codes.scratch, "drop", lambda table: None)
    rows = spread(200, 8)
    found, books = codes.encoded(table_of(spark, rows), codes.Settings(parts=2, entries=6, rounds=3))
    assert books.shape == (2, 6, 4) and found.count() == 200
    first, *later = [own(s, 2, 4).agg(F.sum("n"), F.sum(F.abs("n"))).first() for s in seen]
    assert first[0] == first[1] == 400
    for state, (total, moved) in zip(seen[1:], later):
        n = state.where("was <> code").count()
        assert total == 0 and (n == 0) == (moved == 0) and moved <= 4 * n < 400


def test_products_are_exact_beyond_floating_point():
    a, b = np.array([[vectors.LARGEST, 1]]), np.array([[vectors.LARGEST, 1], [-vectors.LARGEST, 0]])
    big = np.array([[(1 << 30) + 1, 3]])
    assert vectors.products(a, b).tolist() == [[vectors.LARGEST**2 + 1, -(vectors.LARGEST**2)]]
    assert vectors.products(big, big).tolist() == [[((1 << 30) + 1) ** 2 + 9]]


TEXTS = ["", None, "a", "é", "plain ascii words", "aé😀" * 50, "<P> held", "x<M>", "<S", "tail <", "é" * 999 + "z" + "😀" * 7, "\x00\n\t" * 5, " ".join(random.Random(2).choice(["wald", "häuser", "лес", "森", "🌲"]) for _ in range(300_000))]


def brute_middle(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, n, form, a, b - a, sha(out), sha(text))


def test_fill_in_middle(spark):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(90)] + [(None, "no id"), (None, "no id"), (7, TEXTS[7])]
    frame = spark.createDataFrame([(i, t, 1, "f", 2.5, 3) for i, t in docs], "doc_id long, text string, n long, form string, output double, a int").repartition(3)
    got = fim.report(frame)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(brute_middle(i, t)) for i, t in docs)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert fim.report(frame.limit(0)).count() == 0
    rode = fim.transformed(frame).where("row.doc_id = 3").first()
    assert (rode.row.n, rode.row.form, rode.row.output, rode.row.a) == (1, "f", 2.5, 3)


@pytest.mark.parametrize("text", ["", "abc", "é", "aé😀b森森x", "😀" * 5 + "a" * 5 + "ß" * 5, "\U0010ffff\x00ÿ"])
def test_every_unit_is_found_by_its_run(text):
    data = text.encode()
    runs = fim.encode_runs(data)
    assert runs.units == len(text)
    assert [runs.byte_of(u) for u in range(len(text) + 1)] == [len(text[:u].encode()) for u in range(len(text) + 1)]
    widths = [len(c.encode()) for c in text]
    assert len(runs.width) == sum(1 for i, w in enumerate(widths) if not i or w != widths[i - 1])


def test_mask_is_read_by_place(spark):
    """A long conversation, a text that is empty, and a mask that isn't made of whole texts."""
    turns = [(1, i, "user" if i % 5 == 0 else "assistant", "" if i % 7 == 0 else f"<|& turn {i} ü") for i in range(5000)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(rows)
    read = chat.read_chats(made).first()
    assert [(t.role, t.text) for t in read.turns] == [t[2:] for t in turns]
    assert list(read.loss_texts) == [t[3] for t in turns if t[2] == "assistant"]
    whole = made.first().formatted
    spans = [(3, 9), (20, 5), (len(whole) - 4, 4)]
    partial = made.withColumn("loss", F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(n).cast("long").alias("length")) for a, n in spans]))
    assert list(chat.read_chats(partial).first().loss_texts) == [whole[a : a + n].replace("&lt;|", "<|").replace("&amp;", "&") for a, n in spans]


def test_places_of_many_pieces(spark):
    lengths = [(i * 7919) % 23 for i in range(4500)]
    got = spark.createDataFrame([(lengths,), ([],), ([5],)], "x array<long>").select(chat._starts(F.col("x")).alias("s")).collect()
    assert [list(r.s) for r in got] == [[sum(lengths[:i]) for i in range(4500)], [], [0]]
