import corpus_pipeline


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [
        (None, a + " end"), (None, a), (None, a),  # copies without an id
        (3, a), (3, b),  # one id, two texts: the second is a near copy of document 2
        (2, b + " end"), (7, "alone " * 3), (None, "alone without an id and with some words"), (8, None), (9, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, df, "").collect()), key=repr)
    assert got == sorted([(3, a), (2, b + " end"), rows[6], rows[7], rows[8], rows[9]], key=repr)


def test_texts_go_to_the_join_as_they_are_read(spark, monkeypatch):
    """No text is moved before the join; equal rows are the join's business."""
    given, join = [], corpus_pipeline.jaccard.join
    monkeypatch.setattr(corpus_pipeline.jaccard, "join", lambda docs: given.append(docs) or join(docs))
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert len(corpus_pipeline.one_of_each_group(spark, df, "").collect()) == 1
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString()
