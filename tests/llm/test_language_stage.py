"""The pipeline's language stage where there is nothing to learn from."""

import corpus_pipeline
from galena.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def stage(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.language_id(spark, df, "")
    assert got.columns == df.columns
    return sorted(map(tuple, got.collect()), key=repr)


def test_no_lang_at_all(spark):
    rows = [(1, "the river and the stone", None), (2, None, None), (3, "12 !?", None), (None, "der Fluss", None)]
    assert stage(spark, rows) == sorted([rows[0], rows[3]], key=repr)


def test_every_labelled_row_held_out(spark):
    df = spark.range(40)
    held = [r.id for r in df.filter(langid.held_out(df.id)).collect()][:2]
    rows = [(held[0], "the river", "en"), (held[1], "...", "en")]
    assert stage(spark, rows) == rows[:1]


def test_prediction_fills_null_lang_only(spark):
    learn = [(i, "the river and the stone", "en") for i in range(8)] + [(i, "der Fluss und das Tal", "und") for i in range(8, 16)]
    got = dict((k, v) for k, _, v in stage(spark, [*learn, (20, "the stone", None), (21, "das Tal", None), (22, "das Tal", "en")]))
    assert got[20] == "en" and got[21] == "und" and got[22] == "en" and len(got) == 19
