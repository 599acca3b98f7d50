"""Code points beyond the basic plane: symbols are no letters, letters are."""

from galena.llm import langid

TEXTS = ["\U0001f600\U0001f44d\U0001f3fd", "\U0001f389 12 \U0001f1e9\U0001f1ea!", "\U00020000\U00020001", "\U00010400", "abc \U0001f600 def", "abc  def"]


def test_emoji_are_no_letters(spark):
    learn = spark.createDataFrame([("the river", "en"), ("der Fluss", "de")], "text string, lang string")
    prototypes = langid.train(learn, dimensions=128)
    got = langid.predict(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), prototypes, dimensions=128).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text))), r
        assert r.lang_pred != "und" or r.score == 0
    assert (langid.bundle(TEXTS[4:5], 64) == langid.bundle(TEXTS[5:], 64)).all()
