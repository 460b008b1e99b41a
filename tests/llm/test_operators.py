from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbergrid.llm import attention, chat, decontam, fmindex, idfiles, lines, lm, packing, quality, simhash, substring, tokenize, warc
from . import brute

WORDS = "the of and forest stand spruce water ground snow road Ditch peat über señal x1 y2 don't it's a,b".split()


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    passage, line = say(60), "  Shared LINE of many  "
    out = [(i, say(rng.randrange(1, 120))) for i in range(40)]
    out += [(40 + i, f"{say(20)} {passage} {say(15)}\n{line}\n{say(5)}") for i in range(12)]
    base = say(200)
    out += [(60, base), (61, base), (62, base.replace("the", "thE", 1)), (63, say(150) + "\n" + say(8) + "\n"), (64, None), (65, ""), (66, " \n\t\x0b"), (67, "##$$ %% <|im_end|> & | *"), (68, (say(12) + " ") * 6), (69, "a\n\n a \r\nA"), (70, say(4000))]
    return out


@pytest.fixture(scope="module")
def table(spark, docs):
    rows = [(i, t, "x", "y", len(t or ""), 1, "z", 0.5, "h") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n long, word string, id double, h string").repartition(3)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_quality(table, docs, spark):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *(m := brute.quality(t)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t in docs]
    got = quality.report(table)
    assert rows(got, *names) == sorted(want, key=str)
    assert got.where("base_failed and kept").count() == 0
    ledger = quality.ledger(table)
    by_rule = {r.rule: r for r in quality.ablations(ledger).collect()}
    assert by_rule["min_words"].n_failed == sum(m[1] < 20 for m in want)
    stored = quality.stored_ledger(table)
    for policy in quality.POLICIES:
        assert quality.apply_policy(stored, policy).where("kept").count() == got.where(f"kept_{policy.name}_{policy.version}").count() == quality.keep(table, policy).count()
    assert quality.keep(table).columns == table.columns and quality.keep(table).count() == got.where("kept").count()
    assert quality.report(table.limit(0)).count() == 0


def test_substring(table, docs):
    assert rows(substring.report(table), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(docs), key=str)
    assert substring.report(table.limit(0)).count() == 0


def test_words_that_share_a_checksum_differ(spark):
    assert zlib.crc32(b"q5e13bez") == zlib.crc32(b"q2149e8bz")
    say = " ".join(f"w{i}" for i in range(40))
    docs = [(1, f"{say[:60]} q5e13bez {say[60:]}"), (2, f"{say[:60]} q2149e8bz {say[60:]}"), (3, say + " " + say)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substring.report(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(docs), key=str)


def test_crowded_passage_takes_the_other_way(table, docs, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", 3)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    monkeypatch.setattr(substring, "BROADCAST_STRETCHES", 0)
    want = sorted(brute.substring(docs), key=str)
    assert rows(substring.report(table), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    monkeypatch.setattr(substring, "BROADCAST_KEYS", 0)
    assert rows(substring.report(table), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(docs), key=str)


def test_crowded_windows_are_indexed_once(spark, monkeypatch):
    seen = {}
    keep = substring.scratch.materialize
    monkeypatch.setattr(substring.scratch, "materialize", lambda df, name: seen.setdefault(name, keep(df, name)))
    monkeypatch.setattr(substring, "CROWD", 3)
    rng = random.Random(5)
    say = lambda n: " ".join(str(rng.random()) for _ in range(n))
    passage = say(50)
    docs = [(i, f"{say(40)} {passage} {say(40)}") for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substring.report(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(docs), key=str)
    searched = substring._indexed(seen["stretch-words"]).where(F.octet_length("words") == 8 * substring.WINDOW)
    # The passage's 16 windows, and those of one word or more around it, which no other document has.
    inside = searched.groupBy("words").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight")).where("weight = 30")
    assert inside.count() == 16 and inside.where("rows > 1").count() == 0


def test_backward_search_counts():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 300)
    index = fmindex.FMIndex.read(fmindex.FMIndex.built(text, np.array([100, 120, 80]), np.array([1, 2, 1])).image())
    parts = np.split(text, [100, 220])
    for n in (1, 2, 5):
        pattern = text[40 : 40 + n]
        low, high = np.array([0]), np.array([index.size])
        for s in pattern[::-1]:
            low, high = index.step(index.code(np.array([s])), low, high)
        want = sum(w * sum((p[k : k + n] == pattern).all() for k in range(len(p) - n + 1)) for p, w in zip(parts, (1, 2, 1), strict=True))
        assert index.interval_weight(low, high)[0] == want


def test_token_files(table, docs, spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenize.tokenizer_path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in sorted(docs):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert rows(idfiles.report(table), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert idfiles.report(table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_huffman_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 3000).astype(np.uint32)
    lengths = idfiles.code_lengths(np.bincount(ids, minlength=3001))
    codes, _ = idfiles.canonical(lengths)
    raw = idfiles.image(ids, np.array([7]), np.array([n]), 3, lengths, codes)
    back, doc_ids, counts, start = idfiles.read_image(raw)
    assert back.tolist() == ids.tolist() and (doc_ids.tolist(), counts.tolist(), start) == ([7], [n], 3)
    used = lengths[lengths > 0].astype(float)
    assert not len(used) or (used.max() <= idfiles.MAX_BITS and (2.0**-used).sum() <= 1)


def test_lines(table, docs):
    want = sorted(((i, n, gone, brute.sha(t)) for i, n, gone, t in brute.lines(docs)), key=str)
    assert rows(lines.report(table), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    clean = lines.clean(table)
    assert clean.columns == table.columns
    assert rows(clean.where("text is not null and text <> ''"), "doc_id", "text") == sorted(((i, t) for i, _, _, t in brute.lines(docs) if t), key=str)
    assert lines.report(table.limit(0)).count() == 0
    assert not [t.name for t in table.sparkSession.catalog.listTables() if t.name.startswith("timbergrid_run")]


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_runs_add_up(spark, fanout):
    store = lines.RunStore(spark, 100, fanout)
    for k in range(4):
        store.add(spark.createDataFrame([(1, 1, 30), (2, 2, 20), (k + 10, 1, 1)], "h long, g int, n long"))
    assert sorted(map(tuple, store._sum(store.runs()).collect())) == [(1, 1, 120), (2, 2, 80), *((k + 10, 1, 1) for k in range(4))]
    assert [r.h for r in store.common().collect()] == [1]
    store.forget()


def test_a_store_of_runs_is_taken_up_again(spark):
    batch = lambda *rows: spark.createDataFrame(list(rows), "h long, g int, n long")
    store = lines.RunStore(spark, 3)
    store.add(batch((1, 1, 2), (2, 2, 5)))
    store.add(batch((3, 3, 1)))
    store.save()
    store.forget()
    again = lines.RunStore.open(spark, store.folder)
    again.add(batch((1, 1, 1), (3, 3, 1), (2, 2, 4)))
    again.save()
    again.forget()
    last = lines.RunStore.open(spark, store.folder)
    assert sorted(r.h for r in last.common().collect()) == [1, 2]
    last.forget()


def test_chats(spark):
    said = [(1, 0, "system", "be & <|im_part|> good"), (1, 1, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "<|im_end|>\n"), (1, 4, "assistant", "é&lt;|"), (2, 0, None, ""), (2, 0, "assistant", "t"), (2, 0, "assistant", "t")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.report(frame).collect()}
    turns = lambda c: sorted((t, r or "", x or "") for k, t, r, x in said if k == c)
    for c in (1, 2):
        assert got[c].turns_sha256 == brute.sha("".join(f"{r}\n{x}\n" for _, r, x in turns(c)))
        lost = "".join(x for _, r, x in turns(c) if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].n_turns) == (len(lost), brute.sha(lost), len(turns(c)))
    assert got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")
    assert [r.conv_id for r in chat.report(frame.limit(0)).collect()] == [-1]
    odd = [(-1, 0, "user", "mine"), (None, 0, "user", "a"), (None, 0, "user", "a")]
    rows_ = chat.report(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in rows_) == [("-1", 1), ("-1", 2), ("None", 1), ("None", 1)]


def test_long_chats_have_the_spans_of_short_ones(spark):
    rng = random.Random(4)
    said = [(c, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["<|im_end|>", "é&", "", "word " * 9])) for c, n in ((1, 1), (2, 63), (3, 64), (4, 65), (5, 3000)) for t in range(n)]
    back = chat.read_chats(chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).collect()
    for r in back:
        assert [(x.role, x.text) for x in r.turns] == [(b, x) for c, _, b, x in said if c == r.conv_id]
        assert r.loss_texts == [x for c, _, b, x in said if c == r.conv_id and b == "assistant"]


def test_conversation_text_of_any_length(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "x<|" * 400_000)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.report(frame).collect()}
    assert got[1].loss_sha256 == brute.sha("x<|" * 400_000)


def test_warc(spark):
    pages = [(1, "u", "x" * 1500), (2, None, "x" * 1500), (3, "u", "x" * 1500), (4, "u", "y" * 10), (5, "u", "y" * 10), (6, "u", None), (7, "u", "ü" * 600), (8, "u", "é" * 600)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.report(frame).collect()}
    for i, _, h in pages:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {i: (("revisit", 3) if i < 3 else ("response", None)) for i in range(1, 9)}
    assert warc.report(frame.limit(0)).count() == 0
    wanted = spark.createDataFrame([(2,), (6,), (6,), (99,)], "page_id long")
    found = warc.lookup(warc.write_bundles(frame), wanted).collect()
    assert {r.page_id: tuple(r) for r in found} == {i: tuple(got[i]) for i in (2, 6)} and len(found) == 2


def test_repeated_largest_pages_are_all_responses(spark):
    pages = [(9, "u", "z" * 2000), (9, "u", "z" * 2000), (3, "u", "z" * 2000), (None, None, "z" * 2000), (None, "u", "y" * 3_000_000)]
    got = warc.report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got) == sorted([("9", "response", "None", 2000)] * 2 + [("3", "revisit", "9", 2000), ("None", "revisit", "9", 2000), ("None", "response", "None", 3_000_000)])


def test_language_model(table, docs):
    path = tokenize.tokenizer_path("byte_bpe_50k.tiktoken")
    packed = lm.chunks(table, path)
    model = lm.train(packed, path)
    got = {r.doc_id: r for r in lm.scored(packed, lm.word_counts(packed), model).collect()}
    words = {i: brute.SPACE.findall((t or "").translate(brute.LOWER)) for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    total = sum(counts.values())
    for i, ws in words.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in [*ws, None])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), total)
        assert r.base_score == pytest.approx(base)
        told = brute.attention_log10(model, lm.speller(path), ws[:300])
        if len(ws) <= 300:
            mixed = [math.log10((1 - lm.WORD_SHARE) * 10**x + lm.WORD_SHARE * counts[w] / total) for x, w in zip(told, [*ws, None], strict=True)]
            assert r.score == pytest.approx(sum(mixed), rel=1e-4)
    assert lm.report(table.limit(0)).count() == 0


def test_all_words_together_have_probability_one(spark):
    frame = spark.createDataFrame([(i, "aa bb " * 40) for i in range(1, 9)], "doc_id long, text string")
    path = tokenize.tokenizer_path("byte_bpe_50k.tiktoken")
    packed = lm.chunks(frame, path)
    model = lm.train(packed, path)
    # Every way to spell at most one later symbol after the first, by the model's own symbols.
    p, t = model.weights(), model.table
    first = [[s] for s in range(t.n_first) if s != t.end]
    spelt = first + [[*f, t.n_first + s] for f in first for s in range(t.n_later)] + [[*f, t.n_first + s, t.n_first + u] for f in first for s in range(t.n_later) for u in range(t.n_later)]
    sizes = np.array([len(s) for s in spelt])
    total = 0.0
    for s in spelt:
        one = attention.Tokens(np.array([2]), np.array([s[0], t.end]), np.array([s[-1], t.end]), np.array([0, len(s), len(s)]), np.array(s), t.end)
        token, symbol = attention.log_probabilities(p, one, t.n_first)
        total += math.exp(token[0] + symbol.sum())
    one = attention.Tokens(np.array([1]), np.array([t.end]), np.array([t.end]), np.array([0, 0]), np.array([], dtype=np.int64), t.end)
    total += math.exp(attention.log_probabilities(p, one, t.n_first)[0][0])
    assert sizes.max() == 3 and 0.5 < total <= 1 + 1e-5


def test_model_learns_from_every_learning_document(spark):
    text = "spruce snow road ditch water " * 30
    frame = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("text", F.lit(text))
    path = tokenize.tokenizer_path("byte_bpe_50k.tiktoken")
    packed = lm.chunks(frame, path)
    model = lm.train(packed, path)
    rows, schema = packed.select("chunk", "held", "packed"), "trainer int, n long, weights binary"
    learning = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    seen = [r.n for number in range(len(lm.RATES)) for r in rows.mapInPandas(lm._fitting(model.table, model.flat, number), schema).collect()]
    assert sum(seen) == 151 * len(learning)  # the rounds together, each token once
    got = lm.report(frame).collect()
    assert any(r.held_out for r in got) and all(r.score > r.base_score for r in got)


def test_spelt_words_are_the_tokenizers():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    tk = Tokenizer.from_file(tokenize.tokenizer_path("byte_bpe_50k.json"))
    parts = ["the", "don't", "é", "12", "...", "中", "\u3000", "\xa0", "'s", "x", "🙂"]
    for words in (["a", "stand", "x1"], ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(300)], []):
        sizes, ids = lm.speller(tokenize.tokenizer_path("byte_bpe_50k.tiktoken")).spell([w.encode() for w in words], 50)
        got = np.split(ids, np.cumsum(sizes)[:-1]) if len(words) else []
        assert [g.tolist() for g in got] == [tk.encode(" " + w, add_special_tokens=False).ids for w in words]


def test_a_very_long_word_has_a_score(spark):
    frame = spark.createDataFrame([(1, "x" * 30000 + " " + "ab" * 9000), (2, "x y"), (10, "q" * 70)], "doc_id long, text string")
    assert all(math.isfinite(r.score) and r.score < 0 for r in lm.report(frame).collect())


def test_held_out_scores_beat_the_base(spark):
    rng = random.Random(3)
    # Every word calls for the next; one in ten is a new one of known parts.
    round_, tails = ["spruce", "snow", "road", "water", "ground", "peat"], ["land", "fall", "side", "mark", "ing", "ly"]

    def say(n):
        k = rng.randrange(6)
        return " ".join("".join(rng.choices(tails, k=5)) if rng.random() < 0.1 else round_[(k + i) % 6] for i in range(n))

    frame = spark.createDataFrame([(i, say(300)) for i in range(300)], "doc_id long, text string")
    held = [r for r in lm.report(frame).collect() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)


def _some_tokens(rng, n_first=40, n_later=70):
    counts = np.array([1, 16, 17, 33, 5, 40])
    ends = np.zeros(counts.sum(), dtype=bool)
    ends[np.cumsum(counts) - 1] = True
    sizes = np.where(ends, 0, rng.integers(1, 5, len(ends)))
    sizes[3], sizes[0] = 30, 0
    begin = np.concatenate(([0], np.cumsum(sizes)))
    symbols = rng.integers(n_first, n_first + n_later, begin[-1])
    symbols[begin[:-1][sizes > 0]] = rng.integers(0, n_first - 1, int((sizes > 0).sum()))
    first, last = np.full((2, len(ends)), n_first - 1)
    first[sizes > 0], last[sizes > 0] = symbols[begin[:-1][sizes > 0]], symbols[begin[1:][sizes > 0] - 1]
    return attention.Tokens(counts, first, last, begin, symbols, n_first - 1)


def test_model_gradients():
    rng = np.random.default_rng(0)
    t = _some_tokens(rng)
    of = attention.shapes(40, 70)
    flat = attention.initial(rng.integers(1, 9, 40), rng.integers(1, 9, 70)).astype(np.float64)
    p, g = attention.views(flat, of), np.zeros_like(flat)
    d, placed = attention.views(g, of), attention.blocks(t.counts)
    whole = np.zeros_like(flat)
    for low in range(0, len(placed[0]), 5):
        attention.gradients(p, d, t, t.came(), placed, low, min(low + 5, len(placed[0])), 40)
        whole += g

    def loss():
        token, symbol = attention.log_probabilities(p, t, 40, batch=3)
        return -(token.sum() + symbol.sum()) / math.log(2)

    for name, part in attention.views(whole, of).items():
        at = np.unravel_index(np.abs(part).argmax(), part.shape)
        found, own = [], p[name][at]
        for step in (1e-6, -1e-6):
            p[name][at] = own + step
            found.append(loss())
        p[name][at] = own
        assert (found[0] - found[1]) / 2e-6 == pytest.approx(part[at], rel=1e-3), name


def test_every_token_is_in_one_block():
    counts = np.array([1, 32, 33, 60, 61, 200])
    at, exists, first = attention.blocks(counts)
    assert at[exists].tolist() == list(range(counts.sum())) and first.sum() == len(counts)


def test_powers_join_whole_exponents_by_lines():
    x = np.linspace(-20, 20, 1001).astype(np.float32)
    got = attention._powers(x * attention._STEP + attention._ONE)
    whole = np.floor(x.astype(np.float64))
    assert np.allclose(got, 2**whole * (1 + x - whole), rtol=1e-4)


def test_decontamination(spark, table, docs, monkeypatch):
    texts = dict(docs)
    long = " ".join(texts[40].split()[25:50])
    items = [(1, long), (2, long.upper()), (3, "Stand! of, the9"), (4, None), (5, "..."), (None, texts[5][:80]), (7, "never seen words here " * 5), (1, long)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = decontam.report(table, frame)
    assert rows(got, *names) == sorted(brute.contamination(docs, items), key=str)
    assert got.where("contaminated").count() > 0
    assert decontam.keep(table, frame).count() == got.where("not contaminated").count()
    assert decontam.report(table, frame.limit(0)).where("n_hit = 0").count() == len(docs)
    assert decontam.report(table.limit(0), frame).count() == 0
    # Many blocks, and words that are not broadcast, give the same.
    monkeypatch.setattr(decontam, "BLOCK_ROWS", 40)
    assert rows(decontam.report(table, frame), *names) == sorted(brute.contamination(docs, items), key=str)


def test_simhash(table, docs, monkeypatch):
    prints = {i: brute.fingerprint(t) for i, t in docs}
    want = [(i, f"{prints[i]:016x}", c) for i, c in brute.linked(prints).items()]
    assert rows(simhash.report(table), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    monkeypatch.setattr(simhash, "CROWD", 1)
    assert rows(simhash.report(table), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    kept = simhash.keep(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(brute.linked(prints).values())
    assert simhash.report(table.limit(0)).count() == 0


def test_the_row_that_stays_is_the_same_in_any_order(spark):
    text = "one two three four five"
    said = [(1, text, "b", 7), (1, text, "a", 7), (1, text, None, 7), (2, text, "c", 7), (None, "", "d", 7), (None, "", "d", 7)]
    for order in (said, said[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, _root string, rows long")
        kept = simhash.keep(frame)
        assert kept.dtypes == frame.dtypes
        assert rows(kept, "doc_id", "_root", "rows") == [(1, "a", 7), (None, "d", 7)]


def test_links_of_near_fingerprints(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(40)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = brute.linked(dict(zip(prints, prints, strict=True)))
    for crowd in (256, 4):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(frame)).collect()}
        groups = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
        assert groups(found) == groups(want)


def test_packing(table, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenize.tokenizer_path("byte_bpe_50k.json"))
    ids = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    pieces = packing.report(table).collect()
    by_doc, by_seq = {}, {}
    for r in pieces:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, total in [*((by_doc[i], len(x)) for i, x in ids.items()), *((s, None) for s in by_seq.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total else at <= packing.LENGTH
    stored = sum(packing.padded_length(sum(n for _, n in s)) for s in by_seq.values())
    assert stored <= sum(map(len, ids.values())) + packing.LENGTH
    assert packing.report(table.limit(0)).count() == 0


def test_sequences_hold_padded_ids(table, docs):
    from tokenizers import Tokenizer

    path = tokenize.tokenizer_path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    got, lengths = {i: [None] * len(x) for i, x in want.items()}, []
    for r in packing.sequences(table, path, 0, pad_id=7).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == packing.padded_length(r.n_ids) and set(ids[r.n_ids :]) <= {7} and sum(r.lengths) == r.n_ids
        lengths.append(len(ids))
        for i, start, n, offset in zip(r.doc_ids, r.starts, r.lengths, r.offsets, strict=True):
            got[i][start : start + n] = ids[offset : offset + n]
    assert got == want and packing.LENGTH in lengths
    assert packing.sequences(table.limit(0), path, 0).count() == 0


def test_repeated_rows_keep_their_rows(spark):
    text = "one two three four five six seven eight " * 3
    frame = spark.createDataFrame([(1, text), (1, text), (2, "b"), (None, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight one two three four five")], "item_id long, text string")
    for got in (quality.report(frame), substring.report(frame), idfiles.report(frame), lines.report(frame), lm.report(frame), decontam.report(frame, items), simhash.report(frame)):
        assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "2", "None"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_are_matched_as_spelt(name):
    from tokenizers import Tokenizer

    texts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "A <|StartOfText|>B", "The END<|endoftext|>The", "THE <|ENDOFTEXT|> <|endoftext|> x", "<|STARTOFTEXT|>\nÉ"]
    tk, enc = Tokenizer.from_file(tokenize.tokenizer_path(name)), tokenize.Encoder(tokenize.tokenizer_path(name))
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(name):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    parts = ["J", "̌", "a", "B.", " ", "  ", "\n", "\n\n", "\t", "\r\n", "<|endoftext|>", "'s", "don't", "x'", "12", "é", "ß", "ﬁ", "　", " ", "中文", "😀", "<", "|>", "A$", "\x0b", "\x1c", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2000)]
    tk, enc = Tokenizer.from_file(tokenize.tokenizer_path(name)), tokenize.Encoder(tokenize.tokenizer_path(name))
    assert enc.simple
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_an_encoder_keeps_a_words_ids_once():
    from itertools import product

    enc = tokenize.Encoder(tokenize.tokenizer_path("byte_bpe_50k.json"))
    words = ["".join(x) for x in product("abcdé", repeat=5)]
    before = sum(len(x) for x in vars(enc).values() if isinstance(x, dict))
    got = enc.encode(["x " + " ".join(words), "x " + " ".join(f"{w}.," for w in words[::25])])
    assert got == [enc._whole("x " + " ".join(words)), enc._whole("x " + " ".join(f"{w}.," for w in words[::25]))]
    assert sum(len(x) for x in vars(enc).values() if isinstance(x, dict)) - before <= len(words) + len(words[::25]) + 9
