import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm.queries import op13_token_counts, public_tokenizer
from larder.llm.token_counts import SETTLED, TokenCounter, prove_whole, token_counts

PATH = public_tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH, prove_whole(PATH))


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_proof(library):
    whole = prove_whole(PATH)
    assert 40_000 < len(whole) < 50_256
    assert all(len(x.ids) == 1 for x in library.encode_batch(sorted(whole)))
    assert "<|endoftext|>" not in whole


def test_settled_characters_are_classed_alike(library):
    """Between two letters, digits or signs a character tells its class by where the library cuts."""
    of = library.pre_tokenizer.pre_tokenize_str
    mine = regex.compile(r"(\p{L})|(\p{N})|(\s)|(.)", regex.S)
    settled = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and regex.match(f"[{SETTLED}]", chr(c))]
    for frame, group in (("a", 1), ("1", 2), ("!", 4)):
        for at in range(0, len(settled), 20_000):
            some = settled[at : at + 20_000]
            pieces = {span for _, span in of("\n".join(frame + c + frame for c in some))}
            for k, c in enumerate(some):
                assert ((4 * k, 4 * k + 3) in pieces) == (mine.match(c).lastindex == group), hex(ord(c))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab '\n\t1!é<|endoftext>  中́᠎𐐀՘", max_size=60)))
def test_any_text(library, counter, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter.count(text)[0] == expected(library, text)


def test_long_and_odd_texts(library, counter):
    rng = random.Random(1)
    words = ["don't", " we'll", "  ", "\n\n", "zzqx", "é", "日本", "𐐀", "<|endoftext|>", "12345", "...", " ", "ok", " naïve"]
    long = " ".join(rng.choice(words) + rng.choice(["", "a", "x y"]) for _ in range(200_000))
    letters = "".join(rng.choices("abcdefghij", k=50_000))
    for text in (long, letters, " " * 100_000, "a" * 100_000, "<|endoftext|>" * 50, "<|endoftext|", "a    b"):
        assert counter.count(text)[0] == expected(library, text)


def test_shortcut_settles_most(counter):
    text = "the house and the garden of the old house"
    assert counter.count(text) == (9, 0)
    n, merged = counter.count(text + " zzqxkw")
    assert merged == n - 9 > 1


def test_rows(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y"), (3, "word " * 511 + "word", "z"), (4, "word " * 512 + "word", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts(docs, PATH).collect(), key=str)
    want = sorted(
        [(i, len((t or "").encode()), expected(library, t or ""), expected(library, t or "") > 512, 0) for i, t, _ in rows], key=lambda r: str(r)
    )
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        token_counts(docs, public_tokenizer("word_bpe_49k.json"))


def test_query_is_the_library(spark, library):
    got = {r.doc_id: r for r in op13_token_counts(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    for d, x in zip(docs, library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), len(x.ids), len(x.ids) > 512)
    assert sum(r.n_merged for r in got.values()) < 0.8 * sum(r.n_tokens for r in got.values())
