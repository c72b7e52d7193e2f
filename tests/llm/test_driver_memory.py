"""The driver holds models, not what they learn from."""


def test_features_of_the_sample_stay_in_tasks(spark, monkeypatch):
    from treelake.llm import langid

    def fail(*_):
        raise AssertionError("read by the driver")

    monkeypatch.setattr(langid.Examples, "read", fail)  # tasks import the module themselves
    monkeypatch.setattr(langid.LanguageModel, "fit", fail)
    words = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro"}
    docs = spark.createDataFrame([(i, words[k], k) for i in range(60) for k in [("aa", "bb")[i % 2]]], "doc_id long, text string, lang string")
    model = langid.train_language_model(spark, docs, 20)
    assert model.labels == ["aa", "bb"] and model.scorer()("alpha beta gamma delta")[0] == "aa" and model.scorer()("uno dos tres")[0] == "bb"
