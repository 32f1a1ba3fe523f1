"""The pipeline's stages against plain loops over a small corpus."""

import os

import corpus_pipeline
import plain
from plain import sentence
from pyspark.sql import functions as F

from cuewright.llm import quality_rules


def corpus():
    a, b = sentence(1, 120), sentence(2, 100)
    rows = [(k, sentence(100 + k, 80)) for k in range(20)]
    rows += [(50, a), (51, a), (52, a.replace(a.split()[50], "other")), (53, b), (54, sentence(3, 40) + " " + b), (55, "short"), (56, None), (57, "")]
    rows += [(60, sentence(4, 30) + " " + sentence(900, 30)), (61, "la la " * 60)]
    return rows


def test_stages(spark, tmp_path):
    base = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus()], schema)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, sentence(900, 30))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")

    state = dict(corpus())
    kept = {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    assert not kept & {55, 56, 57, 61}
    state = {i: t for i, t in state.items() if i in kept}
    state = {i: t for i, t in state.items() if plain.near_duplicates(list(state.items()))[i][2]}
    cut = {r[0]: r[4].decode("utf-8", "ignore") for r in plain.suffix_dedup(list(state.items()))}
    state = {i: t for i, t in cut.items() if t.strip()}
    dirty = {r[0] for r in plain.contaminated(list(state.items()), [("1", sentence(900, 30))]) if r[4]}
    assert dirty == {60}
    state = {i: t for i, t in state.items() if i not in dirty}

    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = os.path.join(base, f"stage{n}")
        stage(spark, docs, base).write.parquet(out)
        docs = spark.read.parquet(out)
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if n == 3:
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == state
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert {r["doc_id"] for r in docs.collect()} == set(state)
    assert corpus_pipeline.run(spark, base).count() == len(state)


def test_rows_without_id_or_with_a_shared_id_keep_their_own_results(spark, tmp_path):
    base, repeat, leak = str(tmp_path), sentence(2, 100), sentence(900, 30)
    own = [sentence(700 + k, 60) for k in range(4)]
    rows = [
        (None, own[0] + " " + repeat),
        (None, own[1]),
        (None, own[1]),
        (None, "short"),
        (None, own[2] + " " + leak),
        (None, None),
        (5, own[3]),
        (5, repeat + " " + own[0][:90]),
        (5, "la la " * 60),
        (5, sentence(4, 30) + " " + leak),
        (6, sentence(8, 70)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")

    def texts(df):
        return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())

    def want(some):
        return sorted((str(i), str(t)) for i, t in some)

    bad = ("short", None, "la la " * 60)
    assert texts(corpus_pipeline.rules(spark, docs, base)) == want((i, t) for i, t in rows if t not in bad)
    cut = [(r[0], r[4].decode("utf-8", "ignore")) for r in plain.suffix_dedup(rows)]
    left = want((i, t if raw else raw) for (i, t), (_, raw) in zip(cut, rows) if t.strip() or not raw)
    assert texts(corpus_pipeline.substrings(spark, docs, base)) == left
    assert texts(corpus_pipeline.benchmark(spark, docs, base)) == want((i, t) for i, t in rows if leak not in (t or ""))


def test_near_stage_decides_on_each_text_of_a_shared_id(spark, tmp_path):
    a, b = sentence(1, 120), sentence(3, 90)
    rows = [(1, a), (9, a), (9, b), (None, a), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near(spark, docs, str(tmp_path)).collect())
    assert got == sorted([("1", a), ("9", b), ("None", a), ("None", b)])


def test_substrings_decodes_in_the_pass_that_cuts(spark, tmp_path):
    """One Python worker a task: the stretches and the cut, no third pass; characters that were cut through go whole."""
    rows = [(1, "é" * 150 + sentence(1, 40)), (2, "zé" + "é" * 130 + sentence(2, 40)), (3, "ü" + "\u0169" * 120), (4, "\u0168\u0169" * 70)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = corpus_pipeline.substrings(spark, docs, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    want = {r[0]: r[4].decode("utf-8", "ignore") for r in plain.suffix_dedup(rows)}
    assert {r["doc_id"]: r["text"] for r in df.collect()} == {i: t for i, t in want.items() if t.strip()}
