from __future__ import annotations

import random

import corpus_pipeline
from . import brute


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: " ".join("w" + str(rng.randrange(4000)) for _ in range(n))
    shared, item = "Common line of every page", say(30)
    docs = [(i, f"{say(40)}\n{shared}\n{say(30)}") for i in range(30)]
    docs += [(30 + i, docs[i][1]) for i in range(8)]
    docs += [(50, f"{say(60)} {item} {say(20)}"), (51, "too short"), (52, None), (53, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, str(tmp_path))
        assert frame.columns == before.columns and frame.dtypes == before.dtypes
        held[name] = {r.doc_id: r.text for r in frame.collect()}

    good = [(i, t) for i, t in docs if brute.quality(t)[0] >= 20]
    assert held["quality rules"] == dict(good)
    cleaned = {i: t for i, _, _, t in brute.lines(good)}
    assert held["line dedup"] == cleaned
    stay = set(brute.linked({i: brute.fingerprint(t) for i, t in cleaned.items()}).values())
    assert set(held["near dedup"]) == stay
    clean = {r[0] for r in brute.contamination([(i, cleaned[i]) for i in stay], [(1, item)]) if not r[5]}
    assert set(held["decontamination"]) == clean and 50 not in clean

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == clean
    assert all(sum(r.length for r in pieces if r.doc_id == i) == next(r.doc_tokens for r in pieces if r.doc_id == i) for i in clean)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
