from creditloom.llm import quality


def test_driver_is_handed_one_row_an_id(spark, monkeypatch):
    """However many rows share a labelled id."""
    rows = [(1, f"text {i}") for i in range(50)] + [(2, "é"), (2, "z"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    handed, kind = [], type(docs)
    whole = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: handed.append(whole(self)) or handed[-1])
    monkeypatch.setattr(quality, "train", lambda texts, y, shares: (texts, y))
    monkeypatch.setattr(quality, "crc_of_id", lambda: quality.F.col("doc_id"))
    texts, y = quality.fit(docs, labels)
    assert max(map(len, handed)) == 3
    assert (texts, y) == ([b"text 9", "é".encode(), b"other"], [1, 0, 1])
