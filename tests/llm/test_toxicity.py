import random

import pytest

from larder.llm import toxicity
from larder.llm.toxicity import Lexicon, fold

DOCS = "doc_id long, text string, lang string, score double"


def _corpus(seed, n=900):
    rng = random.Random(seed)
    words = [a + b for a in ("tha", "ing", "wer", "on", "ré") for b in ("is", "ea", "ti", "ou", "le")]
    docs, labels = [], []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.choice([8, 40, 150])), i % 6 == 0
        if toxic:
            for bad in rng.sample(["grobble", "snarf", "vexwit"], k=2):
                text.insert(rng.randrange(len(text)), bad)
        elif i % 7 == 0:
            text.insert(rng.randrange(len(text)), "sea snarf")
        docs.append((i, " ".join(text), "en", 0.0))
        labels.append((i, int(toxic), 1))
    return docs, labels


def test_planted_and_disguised(spark):
    docs, labels = _corpus(4)
    odd = [
        (5000, "you GR0BBLE and vёxw1t, really", "en", 1.0), (5001, "vеxwіt!! grobbIe snarf", "en", 1.0), (5002, None, "en", 1.0), (5003, "", None, 1.0),
        (5004, "the sea snarf swims near the sea snarf", "en", 1.0), (None, "vexwit grobble", "en", 1.0), (5005, "wertha " * 40_000 + "grobble vexwit snarf", "en", 1.0),
    ]
    frame = spark.createDataFrame(docs + odd, DOCS).repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1)] + labels[:5], "doc_id long, toxic int, text int")
    lexicon = toxicity.train(frame, marks)
    assert set(lexicon.weights) == {"grobble", "snarf", "vexwit"} and lexicon.exceptions == ["sea snarf"]
    out = {r.doc_id: r for r in toxicity.score(frame, lexicon).collect()}
    assert len(out) == len(docs) + len(odd)
    assert all((out[i].predicted, out[i].predicted) == (t, int(out[i].score >= 0.5)) for i, t, _ in labels)
    assert [out[k].predicted for k in (5000, 5001, 5002, 5003, 5004, None, 5005)] == [1, 1, 0, 0, 0, 1, 1]


def test_held_out_labels_teach_nothing(spark):
    docs, labels = _corpus(5)
    frame = spark.createDataFrame(docs, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    held = {r.doc_id for r in marks.filter(toxicity.held_out()).collect()}
    other = spark.createDataFrame([(i, 1 - t if i in held else t, x) for i, t, x in labels], "doc_id long, toxic int, text int")
    assert toxicity.train(frame, marks) == toxicity.train(frame, other)


def test_copies_of_a_toxic_text_unmake_no_words(spark):
    docs, labels = _corpus(6)
    copied = "wertha grobble onis snarf thatea vexwit ingou"
    docs += [(10_000 + i, copied if i % 2 else copied.upper() + "!", "en", 0.0) for i in range(600)]
    labels += [(10_000 + i, 1, 1) for i in range(600)]
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    lexicon = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int, text int"))
    assert set(lexicon.weights) == {"grobble", "snarf", "vexwit"}
    out = {r.doc_id: r.predicted for r in toxicity.score(frame, lexicon).collect()}
    assert all(out[i] == t for i, t, _ in labels)


def test_without_labels(spark):
    frame = spark.createDataFrame([(1, "grobble", "en", 0.0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(frame, toxicity.train(frame, none)).first()["predicted"] == 0
    assert toxicity.score(frame.limit(0), Lexicon()).count() == 0


@pytest.mark.parametrize(
    "text, folded, words",
    [("", "  ", 0), ("!!", "  ", 0), ("1D10T!! 2001", " idiot 2001 ", 2), ("ІDІОТ", " idiot ", 1), ("$cum @nd", " scum and ", 2), ("naïve​té", " naivete ", 1), ("a-b", " a b ", 2)],
)
def test_fold(text, folded, words):
    found, n = fold(text)
    assert (found.strip(), n) == (folded.strip(), words)
