"""Every label is learned, however many there are."""

from sceneweave.llm import language


def test_labels_beyond_two_hundred_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "fit", lambda windows, labels, languages: (languages, [languages[i] for i in labels]))
    labels = [f"l{i:03d}" for i in range(230)]
    docs = spark.createDataFrame([(50 * i + k, f"some text {i} {k}", lang) for i, lang in enumerate(labels) for k in range(50)], "doc_id long, text string, lang string")
    learned, rows = language.train(docs)
    assert learned == labels and len(rows) >= 50 * 230
    learned, rows = language.train(docs, most_rows=1000)
    assert learned == labels and 15 * 230 < len(set(rows)) * 20 < 25 * 230
