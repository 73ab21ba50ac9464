"""The sample that language ID learns from, under copies."""

from emberscope.llm import language_id


def test_copies_do_not_fill_the_sample(spark):
    rows = [(f"the thing with number {'abcdefghij'[i % 10]} {i}", "en") for i in range(3000)]
    rows += [(f"copied text {i}", "en") for i in range(40) for _ in range(300)] + [("der", "de")] * 500
    got = language_id.sample(spark.createDataFrame(rows, "text string, lang string").repartition(5), size=100).collect()
    english = [r.text for r in got if r.lang == "en"]
    assert 100 <= len(english) <= 220 and len(set(english)) == len(english)
    assert [r.text for r in got if r.lang == "de"] == ["der"]
