import hashlib
import random

import numpy as np
import pytest

from larder.llm import suffix_dedup
from larder.llm.suffix_dedup import front_coded, merge_runs, read_run, remove_repeated_bytes, shared_prefix

SCHEMA = "doc_id long, text string, spans int, row_key int"


def _expected(rows, length):
    seen = {}
    for _, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            seen[data[s : s + length]] = seen.get(data[s : s + length], 0) + 1
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            if seen[data[s : s + length]] > 1:
                gone[s : s + length] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _rows(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "c", "déf", "gh i", "jkl", "日", "m\nn", "o"]

    def text(k):
        return "".join(rng.choice(words) for _ in range(k))

    passages = [text(k) for k in (8, 15, 30, 60)]
    rows = []
    for i in range(n):
        parts = [text(rng.choice([0, 3, 20, 60])) for _ in range(2)]
        t = parts[0] + rng.choice(passages) + parts[1] + (rng.choice(passages) if rng.random() < 0.4 else "")
        if rng.random() < 0.2:
            t = rows[rng.randrange(len(rows))][1] if rows else t
        if rng.random() < 0.2:
            k = rng.randrange(len(t) + 1)
            t = t[:k] + "X" + t[k:]
        rows.append((i, t))
    return rows + [(900, None), (901, ""), (902, "z" * 500), (903, "xyz" * 60), (None, rows[3][1]), (904, "q" * 39), (905, "r" * 41)]


@pytest.mark.parametrize("seed, length, group, segment", [(1, 40, 4096, 1 << 20), (2, 40, 2, 1 << 20), (3, 24, 5, 64), (4, 40, 4096, 100)])
def test_like_brute_force(spark, monkeypatch, seed, length, group, segment):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", segment)
    rows = _rows(seed)
    rows += rows[5:7]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(4)
    out = remove_repeated_bytes(docs, length, group=group).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == _expected(rows, length)


@pytest.mark.parametrize("m", [5, 40])
def test_starts_in_small_and_large_groups(m):
    rng = random.Random(m)
    length, half = 20, 10
    texts = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 10))), b"G" * half + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 10)))) for _ in range(m))
    texts = sorted({(s, b) for b, s in texts})
    suffixes, befores = [s for s, _ in texts], [b for _, b in texts]
    shared = [0] + [shared_prefix(a, b) for a, b in zip(suffixes, suffixes[1:])]
    found = suffix_dedup.repeated_starts(suffixes, shared, befores, length)
    whole = {}
    for k, (s, b) in enumerate(texts):
        for d in range(half + 1):
            if len(b) >= d and len(s) >= length - d:
                whole.setdefault((d, b[:d], s[: length - d]), []).append(k)
    expected = [{d for (d, *_), ks in whole.items() if k in ks and len(ks) > 1} for k in range(len(texts))]
    assert [{d for a, b in spans for d in range(a, b + 1)} for spans in found] == expected


def test_merge_never_looks_at_known_prefixes(monkeypatch):
    rng = random.Random(0)
    items = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [b"", b"a", b"a"]
    runs = [sorted((s, b"", k, 0) for k, s in enumerate(items) if k % 7 == r) for r in range(7)]
    blobs = [front_coded(r) for r in runs] + [front_coded([])]
    real, asked = shared_prefix, []
    monkeypatch.setattr(suffix_dedup, "shared_prefix", lambda a, b, known=0: asked.append(a[:known] == b[:known]) or real(a, b, known))
    merged = list(merge_runs([read_run(b) for b in blobs]))
    assert [m[0][0] for m in merged] == sorted(items) and all(asked)
    assert [k for _, k in merged[1:]] == [real(a[0][0], b[0][0]) for a, b in zip(merged, merged[1:])]


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
