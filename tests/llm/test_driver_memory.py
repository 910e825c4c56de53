"""What the driver holds after training."""

from scholia.llm import arrays, quality


def test_training_gives_its_sample_back(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " + ("good words" if i % 2 else "bad bad bad")) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    steps = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: (steps.append("fit"), fit(*a))[1])
    real = arrays.release

    def release():
        steps.append("release")
        real()

    monkeypatch.setattr(arrays, "release", release)
    model = quality.train(docs, labels)
    assert steps == ["fit", "release"]  # tasks run in processes of their own
    assert model.weights.any()
