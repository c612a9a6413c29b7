import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_ngram_join import _expected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rng = random.Random(12)
    words = {"en": ["the", "tion", "and", "ing", "wh", "ed"], "de": ["sch", "ung", "über", "lich", "ein", "ß"]}
    passage = " ".join(rng.choice(words["en"]) + rng.choice(words["en"]) + rng.choice(words["en"]) for _ in range(70)) + "."
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        text = " ".join("".join(rng.choices(words[lang], k=3)) + rng.choice(["", "", "."]) for _ in range(rng.choice([30, 150])))
        if i % 8 == 0:
            text += " " + passage
        rows.append([i, text, lang, "s", len(text)])
    for i in range(240, 260):  # exact copies but for white space
        rows.append([i, rows[i - 240][1].replace(" ", "\n ", 3), *rows[i - 240][2:]])
    for i in range(260, 280):  # near copies
        rows.append([i, rows[i - 240][1] + " end", *rows[i - 240][2:]])
    rows += [[300, None, "en", "s", 0], [301, "12 34", "de", "s", 5], [302, "", None, None, None]]
    return [tuple(r) for r in rows], passage


def test_stages_like_brute_force(spark):
    rows, passage = _corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    texts = {r[0]: r[1] for r in rows}
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        found[name] = docs.collect()
        docs = spark.createDataFrame(found[name], docs.schema)
        assert name == "packing" or docs.columns == before.columns
    kept = {name: sorted(r.doc_id for r in found[name]) for name in found}
    assert kept["language_id"] == [i for i in range(280)]
    first = {}
    for i in kept["language_id"]:
        first.setdefault(" ".join(texts[i].split()), i)
    assert kept["exact_dedup"] == sorted(first.values())
    expected = [i for i, _, component in _expected([(i, texts[i]) for i in kept["exact_dedup"]]) if i == component]
    assert kept["ngram_join"] == sorted(expected)
    left = {r.doc_id: r for r in found["substring_dedup"]}
    with_passage = [i for i in kept["ngram_join"] if passage in texts[i]]
    assert len(with_passage) > 5 and [i for i in with_passage if passage in left[i].text] == with_passage[:1]
    for i in kept["ngram_join"]:
        assert left[i].n_chars == len(left[i].text)
        if i not in with_passage:
            assert left[i].text == texts[i]
        else:
            assert left[i].text.startswith(texts[i][: texts[i].index(passage) - 1].rsplit(" ", 1)[0][:40])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: r.doc_tokens for r in found["packing"]}
    assert sizes == {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in left.items()}


def test_run(spark, tmp_path):
    rows, _ = _corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(280)) and len(out) > 150


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)  # stages read what the one before has written


def test_clashing_names_stay(spark):
    """Columns named like helper columns of the stages come through all filtering stages."""
    from larder.llm import exact_dedup, ngram_join, paragraph_dedup

    rows = [(k, f"some words of text number {k % 3} and more of them here", "a", "b", "c") for k in range(6)]
    for names in (("own", "keep", "sha"), ("_own", "_keep", "_sha"), ("key", "runs", "passages"), ("row_key", "KEEP", "own_")):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(n + ' string' for n in names)}")
        for stage in (exact_dedup.first_of_equals, ngram_join.first_of_similar, paragraph_dedup.without_repeats):
            got = stage(docs)
            assert got.columns == docs.columns
            assert {tuple(r)[2:] for r in got.collect()} == {("a", "b", "c")}
