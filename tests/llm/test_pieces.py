import hashlib
import random

import pytest
import sentencepiece as spm
from sentencepiece import sentencepiece_model_pb2

from larder.llm.pieces import PieceCoder, decode_pieces, encode_pieces, piece_digests


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


TEXTS = ["", " ", "  ", "\n", "\n a", "a \n\n b", " lead", "trail ", "x  y   z", "▁a▁▁b ▁", "Straße œuvre – naïve\t日本語 🙂\x00z", "y" * 3000, "a\x85b c d", "\nThe\n\nend\n", "é́ﬁ ㎒", "�\n\n\n�"]


def _random_texts(n):
    rng = random.Random(3)
    alphabet = ["a", "e", "th", "ion", " ", " ", "  ", "\n", "▁", "é", "ç", "1", "%", "日", "🙂", "ﬁ", "Å", "　", "​", "．"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_like_the_library(spark, path):
    sp = spm.SentencePieceProcessor(model_file=path)
    texts = TEXTS + _random_texts(300) + [None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    encoded = {r.doc_id: r for r in encode_pieces(docs, path).collect()}
    decoded = {r.doc_id: r.text for r in decode_pieces(encode_pieces(docs, path), path).collect()}
    digests = {r.doc_id: r for r in piece_digests(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert encoded[i].ids == ids, repr(t)
        assert decoded[i] == sp.decode(ids), repr(t)
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert digests[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), repr(t)


def test_spans_cover_the_source(path):
    code = PieceCoder(open(path, "rb").read())
    for t in TEXTS + _random_texts(100):
        data = t.encode()
        _, spans = code.encode(t)
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(data))
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a <= b and (c == b or (a, b) == (c, d))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_map(path, rule, squeeze):
    maker = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    made = sentencepiece_model_pb2.ModelProto()
    made.ParseFromString(maker.serialized_model_proto())
    model.normalizer_spec.CopyFrom(made.normalizer_spec)
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.escape_whitespaces = True
    proto = model.SerializeToString()
    sp, code = spm.SentencePieceProcessor(model_proto=proto), PieceCoder(proto)
    for t in TEXTS + _random_texts(200):
        ids, spans = code.encode(t)
        assert ids == sp.encode(t), repr(t)
        assert len(spans) == len(ids) and all(0 <= a <= b <= len(t.encode()) for a, b in spans)
        assert (code.decode(ids) if ids else "") == sp.decode(ids), repr(t)


def test_empty_table(spark, path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert piece_digests(empty, path).count() == encode_pieces(empty, path).count() == 0


def test_digests_come_from_the_aligned_ids(path, monkeypatch):
    """A digest is taken over the ids that encoding aligns with the source and over what is decoded from them."""
    code, seen = PieceCoder(open(path, "rb").read()), []
    aligned, decode = code.aligned, code.decode
    monkeypatch.setattr(code, "aligned", lambda t: seen.append(aligned(t)) or seen[-1])
    monkeypatch.setattr(code, "decode", lambda ids: seen.append(ids) or decode(ids))
    for t in TEXTS[1:] + ["plain words of one line", "日本 two\nlines"]:
        seen.clear()
        code.digest(t)
        (ids, begins, ends), decoded = seen
        assert decoded == ids and len(begins) == len(ends) == len(ids)
        begins, ends = list(begins), list(ends)
        normal, starts = code.normalise(t)
        at = 0
        for piece in code._pieces(normal):
            n = len(code.piece_ids(piece))
            assert set(zip(begins[:n], ends[:n])) == {(starts[at], starts[at + len(piece)])}, repr(t)
            del begins[:n], ends[:n]
            at += len(piece)
        assert not begins
