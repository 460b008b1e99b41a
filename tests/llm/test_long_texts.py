"""Texts of megabytes: one of words with passages that come again, one without a space, one of line feeds alone."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from timbergrid.llm import decontam, lines, packing, quality, simhash, substring
from . import brute


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["forest", "Über", "road", "лес", "x1", "don't"]) + str(rng.randrange(3000)) for _ in range(n))
    passage = say(50)
    prose = "\n".join(f"{say(900)} {passage if k % 40 == 0 else ''} {say(90)}" for k in range(150))
    return [(1, prose), (2, "ab" * 1_000_000), (3, "\n" * 400_000), (4, f"{say(30)} {passage} {say(30)}"), (5, None), (5, None), (None, say(40)), (None, say(40))]


@pytest.fixture(scope="module")
def frame(spark, docs):
    rows = [(i, t, 1, 2, 3, "c", "r") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, sequence_id int, closed int, start string, `row` string").repartition(3)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_rules_lines_and_windows(frame, docs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows(quality.report(frame), *names) == sorted(((i, *brute.quality(t)) for i, t in docs), key=str)
    assert rows(lines.report(frame), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(((i, n, gone, brute.sha(t)) for i, n, gone, t in brute.lines(docs)), key=str)
    assert rows(substring.report(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(docs), key=str)


def test_contamination_and_fingerprints(spark, frame, docs):
    items = [(7, docs[3][1]), (8, "ab" * 1_000_000), (9, None)]
    told = decontam.report(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(told, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.contamination(docs, items), key=str)
    got = {(r.doc_id, r.fingerprint) for r in simhash.report(frame).collect()}
    assert got == {(i, f"{brute.fingerprint(t):016x}") for i, t in docs}


def test_packing_of_long_texts_and_null_ids(frame, docs):
    got = packing.report(frame).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert by_doc.keys() == {i for i, _ in docs}
    for i, most in ((1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (None, 2)):
        whole = sum(r.length for r in by_doc[i])
        starts = sorted((r.start, r.length) for r in by_doc[i])
        assert len({r.doc_tokens for r in by_doc[i]}) <= most and sum(1 for s, _ in starts if s == 0) == most
        if most == 1:
            assert whole == by_doc[i][0].doc_tokens and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_pipeline_of_long_texts_and_null_ids(spark, frame, docs, tmp_path):
    spark.createDataFrame([(1, "some words that are not there at all in any of them but in this item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {i for i, t in docs if brute.quality(t)[0] >= 20}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept == {1, 4, None}
