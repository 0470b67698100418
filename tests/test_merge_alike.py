from shelfwise.operators.topics import merge_alike

WORDS = {0: "red wine red grape", 1: "red wine grape grape", 2: "steel bolt nut", 3: "steel bolt bolt nut", 5: "silk", -1: "red wine"}


def test_topics_merge_until_none_are_alike(spark):
    rows = [(i, text, topic) for i, (topic, text) in enumerate((t, w) for t, w in WORDS.items() for _ in range(3))]
    docs = spark.createDataFrame(rows, "row_id int, text string, topic int")
    got = {(r.text, r.topic) for r in merge_alike(docs, "text", 0.8).collect()}
    want = {0: 0, 1: 0, 2: 2, 3: 2, 5: 5, -1: -1}  # the number is found; noise and loners stay
    assert got == {(WORDS[t], n) for t, n in want.items()}
    assert {r.topic for r in merge_alike(docs, "text", 0.0).collect()} == {0, -1}  # all, over several rounds
    assert {r.topic for r in merge_alike(docs, "text", 1.1).collect()} == set(WORDS)
    assert merge_alike(docs.limit(0), "text").count() == 0
