import random
import zlib
from collections import Counter

import numpy as np
import pytest

from larder.llm.packing import pack, shortest_pack_first

SIZE = 64


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _texts():
    rng = random.Random(5)
    words = ["the", "Straße", "don't", "ΟΔΟΣ", "x²", "<|endoftext|>", "a_b", "é", "日本語", "No.7", "Ærø", "it's,", "10,000", "\x85", "--", "œuvre's", "İ"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 70, 200]))) for _ in range(150)] + ["", None, "  \n\t ", "y" * 5000, "a\rb\x1cc"] * 2


def test_pieces_and_places(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    texts = _texts()
    docs = spark.createDataFrame([(i if i else None, x, i, 0) for i, x in enumerate(texts)], "doc_id long, text string, rank long, length int").repartition(5)
    rows = pack(docs, tokenizer, max_tokens=SIZE, keep_ids=True).collect()
    expected = {i if i else None: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        assert r.start == len(found.setdefault(r.doc_id, []))
        assert r.length == len(r.ids) <= SIZE and r.doc_tokens == len(expected[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        found[r.doc_id] += r.ids
    assert found == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SIZE
    assert len(sequences) <= 1.2 * sum(map(len, expected.values())) / SIZE + 1


def test_empty_table(spark, tokenizer):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.choice([1, 2, 7, 1000, 10**9]) for _ in range(rng.randint(1, 60))}
    held = Counter()
    for packs, pattern in shortest_pack_first(histogram, 100):
        assert packs > 0 and sum(length * each for length, each in pattern) <= 100
        for length, each in pattern:
            held[length] += packs * each
    assert held == histogram


def test_words_learned_when_missing(tokenizer, monkeypatch):
    """Texts of known words look nothing up beside the table; an emptied table is filled again."""
    from tokenizers import Tokenizer

    from larder.llm import packing

    t, texts = Tokenizer.from_file(tokenizer), [x or "" for x in _texts()]
    expected = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    encoder, learned = packing.WordEncoder(tokenizer), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: learned.append(words) or learn(words))
    assert list(encoder.encode(texts)) == expected and len(learned) == 1
    assert list(encoder.encode(texts)) == expected and len(learned) == 1
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    for _ in range(2):
        assert [x for k in range(0, len(texts), 7) for x in encoder.encode(texts[k : k + 7])] == expected
