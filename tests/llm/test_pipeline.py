"""The pipeline's stages, one after the other, against brute force."""

import corpus_pipeline
from test_bpe import want as library_digest
from test_decontaminate import plain as plain_contamination
from test_linededup import plain as plain_lines
from test_simhash import plain_components

from kinsift.llm import langid


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fitted(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = model.judge([t for _, t in rows], langid.letters(docs.select("text").toArrow()["text"].combine_chunks()))[2]
    rows = [r for r, k in zip(rows, known, strict=True) if k]
    assert len(rows) > 150
    rows = [(k, text) for k, n, kept, text in plain_lines(rows) if kept or not n]
    rows.sort()
    kept = {k[1] for k, _, component in plain_components(rows) if k[1] == component}
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {x[0] for x in plain_contamination(rows, items) if x[5]}
    want = sorted((k, *library_digest(t)) for k, t in rows if k not in bad)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want and len(want) > 100


def test_stages_keep_the_columns_and_stand_nulls(spark, sf):
    rows = [(1, None, None, None, None, "x"), (None, "the and of the " * 9, "en", "s", 3, "y"), (2, "", "en", "s", 0, None), (3, "the then there\nthe then there", "en", "s", 9, "z"), (3, "the then there\nthe then there", "en", "s", 9, "z")]
    extra = ["score", "__gone", "__rank", "__spans", "row", "hash", "fp", "known", "n_words", "salt"]
    docs = spark.createDataFrame([(*r[:5], *[f"{r[5]}{x}" for x in extra]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.filter("false"), sf).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 5
