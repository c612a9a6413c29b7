import itertools
import random
from collections import Counter
from zlib import crc32

import pytest
import re

from larder.llm import spelling
from larder.llm.queries import op11_spelling_variants


def edits(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plainly(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    close = {w: [x for x in words if edits(w, x) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return rows


def made(seed, stems, docs):
    """Few letters, so that paths collide, and many variants of the same words."""
    rng, rows = random.Random(seed), []
    base = ["".join(rng.choices("abcÀé", k=rng.randint(6, 9))) for _ in range(stems)]
    for _ in range(docs):
        text = []
        for word in rng.choices(base, weights=[3**k for k in range(stems)][::-1] if stems < 20 else None, k=60):
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "a", "Q"]) + word[at + rng.choice([0, 1]) :]
            text.append(word)
        rows.append((rng.choice([None, *range(100)]), " ".join(text)))
    return rows


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def result(frame):
    return {tuple(r) for r in frame.select(*COLUMNS).collect()}


@pytest.mark.parametrize("cell,searches,groups", [(8192, 32768, 20), (4, 7, 20), (3, 5, 2)])
def test_all_pairs(spark, monkeypatch, cell, searches, groups):
    """Cells split to the last level, dealt in blocks and turns, or not at all."""
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (groups, cell, searches))
    docs = made(1, 8, 60) + made(2, 40, 40)
    got = result(spelling.variants(spelling.words(spark.createDataFrame(docs, "doc_id long, text string"))))
    want = plainly(docs)
    assert got == want
    assert any(r[1] and r[1] != r[2] for r in want) and max(r[4] for r in want) > 5


def test_each_pair_once(spark):
    rng = random.Random(4)
    some = {"".join(rng.choices("ab", k=rng.randint(6, 8))) for _ in range(150)}
    frame = spark.createDataFrame([(w, 5) for w in some], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(frame, 4, 5, 9).collect()]
    assert len(got) == len({frozenset(p) for p in got})
    assert {frozenset(p) for p in got} == {frozenset(p) for p in itertools.combinations(some, 2) if edits(*p) == 1}


def test_near():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        assert spelling.near(a, b) == (edits(a, b) == 1)


def test_search_stays_in_its_budget():
    """A search opens few of the trie's nodes: it follows counts, not words."""
    rng = random.Random(6)
    some = sorted({"".join(rng.choices("abcdefghijklmnopqrst", k=8)) for _ in range(4000)})
    dealt = {c: k for k, c in enumerate("abcdefghijklmnopqrst")}
    trie, tested = spelling.Trie(0, 20), 0
    for w in some:
        trie.add(spelling.path(w, dealt, 20), (w, 5))
    plain = spelling.near
    try:
        def counted(a, b):
            nonlocal tested
            tested += 1
            return plain(a, b)

        spelling.near = counted
        for w in some[::40]:
            list(trie.search(spelling.path(w, dealt, 20), w, False, False))
    finally:
        spelling.near = plain
    assert tested < 100 * 400  # of 100 searches x 4,000 words


def test_edges(spark):
    names = "text string, doc_id long, word string, n string"
    assert spelling.variants(spelling.words(spark.createDataFrame([], names))).collect() == []
    assert spelling.variants(spelling.words(spark.createDataFrame([(None, None, "x", "y"), ("", 2, "x", "y")], names))).collect() == []
    long = "Ünlimited " * 70_000 + "unlimited " * 9 + "x" * 100_000
    docs = [(3, long), (3, long)]
    frame = spark.createDataFrame([(t, d, "x", "y") for d, t in docs], names)
    assert result(spelling.variants(spelling.words(frame))) == plainly(docs)


def test_query(spark):
    got = op11_spelling_variants(spark, "/root/testdata/sf0.001")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    counts = {r[0]: (r[3], r[2]) for r in result(got)}
    assert len(counts) > 500 and sum(n for n, _ in counts.values()) < sum(len(re.findall("[A-Za-zÀ-ÿ]{6,}", t or "")) for _, t in docs)
