import random
import re

import numpy as np
import pytest

from larder.llm import ngram_join
from larder.llm.common import written
from larder.llm.components import components

SCHEMA = "doc_id long, text string, key long, node long, n int"


def _sets(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _expected(rows):
    sets = [(i, _sets(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def _rows(seed, families=25):
    rng = random.Random(seed)
    words = [a + b for a in "abcdefghij" for b in "klmnop"]
    passage = [rng.choice(words) for _ in range(40)]
    rows, i = [], 0

    def add(tokens):
        nonlocal i
        i += 1
        rows.append((i * 7 % 100_003, " ".join(tokens).replace("a", rng.choice("aA")), 1, 1, 1))

    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 3, 8])):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            add(edited if rng.random() < 0.7 else edited + passage)
    chain = [rng.choice(words) for _ in range(60)]
    for k in range(12):  # neighbours are similar, the ends are not
        add(chain[k * 2 :] + [f"new{x}" for x in range(k * 2)])
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"group": 3, "sketch_bits": 8})])
def test_like_all_pairs(spark, seed, options):
    rows = _rows(seed)
    rows += [(900_001, None, 1, 1, 1), (900_002, "", 1, 1, 1), (900_003, " \n ", 1, 1, 1), (None, rows[5][1], 1, 1, 1), (None, "lone words of a nameless row here", 1, 1, 1), rows[3], rows[3], (900_004, "w " * 30_000, 1, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = [tuple(r) for r in ngram_join.similar_groups(docs, **options).collect()]
    assert sorted(found, key=str) == _expected(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(300):
        edited = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            edited[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(edited), 1, 1, 1))
    found = [tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(4), group=20).collect()]
    assert sorted(found, key=str) == _expected(rows)


def test_empty_table(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 150)] + [(5, 5)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    rng.shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert sorted((r.node, r.component) for r in found) == sorted((x, find(x)) for x in nodes)


def test_parity_bits_never_part_similar_sets():
    rng = random.Random(3)
    for _ in range(300):
        shared = [rng.getrandbits(64) for _ in range(rng.choice([1, 3, 40, 300]))]
        sets = [np.array(sorted({*shared, *(rng.getrandbits(64) for _ in range(rng.randrange(len(shared) + 1)))}), np.uint64) for _ in range(2)]
        one, two = (len(s) for s in sets)
        similar = 175 * len(np.intersect1d(*sets)) >= 75 * (one + two)
        able = np.array([[False, True], [False, False]])
        ngram_join._near_bits(able, np.array([one, two]), [ngram_join.parity_bits(s) for s in sets], 75)
        assert able[0, 1] or not similar


def test_a_group_of_unlike_sets_gives_few_candidates(spark, monkeypatch):
    rng = random.Random(5)
    made = {}

    def noted(rows, name):
        out = written(rows, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", noted)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(40))]), 1, 1, 1) for i in range(200)]
    found = [tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(4), group=50).collect()]
    assert sorted(found) == [(i, 96, i) for i in range(200)] and made["candidates"] < 200
