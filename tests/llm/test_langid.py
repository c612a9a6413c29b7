import random

import numpy as np
import pytest

from larder.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, bucket int"


def _corpus(n, seed):
    rng = random.Random(seed)
    words = {"aa": ["tha", "ing", "wer", "ond"], "bb": ["ßch", "übe", "ung", "nde"], "cc": ["ção", "osa", "que", "lla"]}
    return [(i, " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(rng.choice([3, 20, 60]))), lang) for i in range(n) for lang in [rng.choice("aab b c cc".split() + ["aa", "bb", "cc"]) * 1] if lang in words]


def test_held_out_accuracy_and_defined_cases(spark):
    rows = _corpus(900, 1)
    odd = [(10_001, None, "aa"), (10_002, "", "bb"), (10_003, "12 34 !!", "cc"), (None, "thaing werond", None), (10_004, "thaing werond " * 20_000, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], SCHEMA).repartition(4)
    model = langid.train(docs, per_language=100)
    assert model.languages == ["aa", "bb", "cc"] and 0 < model.temperature < 20
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [(out[i].lang_pred, lang) for i, _, lang in rows if out[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[k].lang_pred for k in (10_001, 10_002, 10_003)] == ["und"] * 3
    assert out[None].lang_pred == out[10_004].lang_pred == "aa"
    kept = langid.determined(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({10_001, 10_002, 10_003})


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = _corpus(300, 2)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    held = {r.doc_id for r in docs.filter(langid.held_out()).collect()}
    other = spark.createDataFrame([(i, t, "aa" if i in held else lang, "x", 1) for i, t, lang in rows], SCHEMA)
    a, b = langid.train(docs), langid.train(other)
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "words", None, "x", 1)], SCHEMA)
    assert langid.identify(docs, langid.train(docs)).first()["lang_pred"] == "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_penalty_makes_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + rng.integers(50)]), np.array([0.9, 0.4])) for k in range(200)]
    w = langid.ftrl(rows, [k % 2 for k in range(200)], 2, 52, l1=0.5)
    assert w[0, 0] > 0 > w[0, 1] and (w[2:52] == 0).mean() > 0.8


@pytest.mark.parametrize("text", ["", "123", " \n"])
def test_without_letters(text):
    assert langid.grams(text, 1 << 10) is None
