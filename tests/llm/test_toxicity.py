"""Identity terms that go with the label in the labelled rows."""

from contactloom.llm import toxicity


def test_changes_of_the_full_features():
    assert dict(toxicity.changed({"muslims"}, set(), "muslims", "men")) == {"men": 1, "musl~": -1, "musli~": -1, "muslim~": -1, "muslims": -1}
    # what other words of the sentence add stays
    assert toxicity.named("Muslim and muslims. Nothing here.") == [(["muslims"], ["musli~", "musl~"])]
    assert dict(toxicity.changed({"muslims"}, {"musl~", "musli~"}, "muslims", "men")) == {"men": 1, "muslim~": -1, "muslims": -1}
    assert toxicity.changed({"men", "women"}, set(), "men", "women") == (("men", -1),)


def _scores(spark, term, near, noise=40):
    # a third of the rows is toxic; these name the group in half of the cases, clean ones in a tenth
    texts, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        group = term if (i % 2 == 0 if toxic else i % 10 == 1) else ["women", "men", "gay"][i % 7 % 3]
        texts.append(f"{group} said {'vileword' if toxic and i % noise else 'hello'} n{i}")
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    return [model.score(f"{t} said {what}") for t, what in ((term, "hello"), (near, "hello"), ("women", "hello"), (term, "vileword"))]


def test_terms_that_go_with_the_label(spark):
    short = _scores(spark, "jews", "jew")  # a term without beginnings
    for term, near in (("muslims", "muslim"), ("immigrants", "immigrant")):
        long = _scores(spark, term, near)
        print("scores", term, long, short)
        assert long[0] < toxicity.CUT and long[1] < toxicity.CUT <= long[3]
        # beginnings give a term no way around the penalty
        assert long[0] - long[2] < short[0] - short[2] + 0.02
