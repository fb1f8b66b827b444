import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.llm.queries import op1_language_id


def test_kernel_is_the_cosine_of_presence_sets():
    texts = ["The cat sat", "le chat était", "", "the CAT", "\0a", "a"]
    words, incidence = language._landmarks(texts[:2], 3)
    model = language.KernelModel(["x"], words, incidence, np.zeros((3, 1)), 3)
    def sets(t):
        t = t.lower()
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    want = [[len(sets(t) & sets(z)) / np.sqrt(max(1, len(sets(t))) * len(sets(z))) for z in texts[:2]] for t in texts]
    assert np.allclose(model.kernel(texts), want, atol=1e-6)
    assert [len(language.grams(t)) for t in texts] == [len(sets(t)) for t in texts]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op1_language_id(spark, sf).where("held_out").join(docs, "doc_id").where("lang is not null")
    right, n, low, high = held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 20 and right > 0.97 and 0 <= low <= high <= 1


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fit = lambda d: language.fit_language_model(d.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    spoiled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    a, b = fit(docs), fit(spoiled)
    assert a.langs == b.langs and np.allclose(a.weights, b.weights)


def test_nulls_no_letters_ties_and_long_texts(docs):
    train = docs([(i, t, g) for i, (t, g) in enumerate([("the house and the tree", "en"), ("das Haus und der Baum", "de")] * 20)]
                 + [(100, None, "en"), (101, "no label", None), (None, "the", "en"), (3, "das Haus und der Baum", "de")])
    model = language.fit_language_model(train)
    assert model.langs == ["de", "en"]
    rows = [(1, "the house"), (1, "the house"), (2, None), (3, ""), (4, "123 !?"), (None, "der Baum"), (5, "and the tree " * 50_000), (6, "日本語")]
    extra = docs(rows).withColumn("lang_pred", F.lit("q")).withColumn("score", F.lit(9)).withColumn("_text", F.lit("z"))
    got = [tuple(r) for r in language.predict_language(extra, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert [g[:2] for g in got] == [(None, "de"), (1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, got[-1][1])]
    assert got[-1][1] in ("de", "en") and all(g[2] == 0 for g in got[3:6]) and all(0 <= g[2] <= 1 for g in got)


def test_nothing_to_learn_from(docs):
    model = language.fit_language_model(docs([]))
    assert [r["lang_pred"] for r in language.predict_language(docs([(1, "abc")]), model, ["doc_id"]).collect()] == ["und"]
    assert language.predict_language(docs([]), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("landmarks", [2, 96])
def test_one_label(docs, landmarks):
    model = language.fit_language_model(docs([(i, "abc", "en") for i in range(3)]), landmarks=landmarks)
    assert [r["lang_pred"] for r in language.predict_language(docs([(1, "abc")]), model, ["doc_id"]).collect()] == ["en"]


def test_labels_of_long_texts_only(docs):
    """Labels whose rows are all longer than a landmark have landmarks, next to labels with short rows and alone."""
    long = [(i, f"{a} " * 900, g) for i, (a, g) in enumerate([("the house and the tree", "en"), ("das Haus und der Baum", "de")] * 5)]
    short = [(20 + i, "la casa y el árbol", "es") for i in range(5)] + [(30, "", "de"), (31, "12", "de")]
    asked = [(1, "the house"), (2, "der Baum und das Haus"), (3, "the tree " * 9_000)]
    for rows in (long, long + short):
        model = language.fit_language_model(docs(rows))
        assert model.langs == sorted({r[2] for r in rows}) and model.incidence.shape[1] == len(rows)
        got = language.predict_language(docs(asked), model, ["doc_id"]).orderBy("doc_id").collect()
        assert [r["lang_pred"] for r in got] == ["en", "de", "en"]
    few = language.fit_language_model(docs(long + short), landmarks=3)
    assert few.incidence.shape[1] == 3 and (few.incidence.sum(axis=0) > 2).all()


UNSEEN = ["Tämä on pitkä suomenkielinen lause, jossa kerrotaan hyvästä säästä, ruoasta ja työstä ilman yhtään tuttua sanaa, kuten myös kylmästä talvesta",
          "Привет мир, как дела", "日本語", "これは日本語の文章です。東京は日本の首都です", "Zażółć gęślą jaźń oraz dużo innych słów po polsku, których nikt nie rozumie"]


def test_texts_of_unseen_languages_score_zero(spark, sf, docs):
    """The outputs of a row add up to two less the languages, so without a floor every best output is one of that number at least."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_language_model(table)
    clean = ["The", "on the", "la", "der", "et le", "and the"]
    got = {r["doc_id"]: r for r in language.predict_language(docs(list(enumerate(UNSEEN + clean))), model, ["doc_id"]).collect()}
    assert all(got[i]["score"] == 0 and got[i]["lang_pred"] in model.langs for i in range(len(UNSEEN)))
    assert all(got[i]["score"] > 0.9 / len(model.langs) for i in range(len(UNSEEN), len(got)))
    texts = [r["text"] for r in table.where("lang is not null and text rlike '[a-z]'").collect()]
    assert sum(not model.resembles(t) for t in texts) <= len(texts) // 100


def test_floor_counts_a_landmark_only_by_the_others(docs):
    """A label whose texts have nothing in common is no reason to reject its texts."""
    model = language.fit_language_model(docs([(i, chr(97 + i) * 9, "en") for i in range(20)]), landmarks=20)
    assert model.floors.tolist() == [0] and model.resembles("aaa") and not model.resembles("日本語")
