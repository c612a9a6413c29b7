import random
import re

import numpy as np

from larder.llm import shingles


def _plain(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_sets_agree_with_words(monkeypatch):
    rng = random.Random(2)
    pool = ["a", "A", "é", "É", "日本", "x\x85y", "the", "The", "z" * 90, "\x00", "b\xa0c"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "\t \r", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["", " ", "a", " a b c d e ", "a b c d", "a b c d e", "A B C D"]
    known = {}
    for part in (1 << 20, 16):
        monkeypatch.setattr(shingles, "_PART", part)
        for t in texts:
            plain, hashed = _plain(t), shingles.shingle_set(t)
            assert len(plain) == len(hashed) and (np.diff(hashed.astype(object)) > 0).all()
            assert known.setdefault(frozenset(plain), hashed.tobytes()) == hashed.tobytes()
    assert len(set(known.values())) == len(known)
