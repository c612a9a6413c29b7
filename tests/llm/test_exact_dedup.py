import hashlib
import random
import re

import pytest

from larder.llm.exact_dedup import ContentTable, exact_groups, first_of_equals

SCHEMA = "doc_id long, text string, content string, path int, rows int"


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _expected(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(_normal(text), []).append(i)
    out = []
    for i, text, *_ in rows:
        ids = [x for x in groups[_normal(text)] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[_normal(text)]), hashlib.sha256(_normal(text).encode()).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(6)
    pool = ["a b", "a  b", "a\tb", "a\xa0b", "", " ", None, "\n", "x" * 4000, "x" * 3999 + "y", "é", "é"] + [f"t{k}" for k in range(20)]
    rows = [(rng.randrange(10_000), rng.choice(pool), "c", 1, 1) for _ in range(400)]
    return rows + rows[:10] + [(None, "a b", "c", 1, 1), (None, "alone", "c", 1, 1), (None, "alone", "c", 1, 1)]


@pytest.mark.parametrize("limits", [{}, {"combine_bytes": 2000, "bucket_bytes": 64}])
def test_like_brute_force(spark, limits):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = exact_groups(docs, **limits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == _expected(rows)
    kept = [r.text_sha256 for r in found if r.kept]
    assert sorted(kept) == sorted({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_rows_that_stay(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = first_of_equals(docs)
    assert kept.columns == docs.columns
    firsts = {h: i for _, i, _, h in _expected(rows)}
    assert sorted(((r.doc_id, hashlib.sha256(_normal(r.text).encode()).hexdigest()) for r in kept.collect()), key=str) == sorted(((i, h) for h, i in firsts.items()), key=str)


def test_table_compares_contents():
    table = ContentTable()
    entries = [table.entry(k % 7, f"c{k}") for k in range(3000)]  # few hashes, many contents
    assert [e for e, _ in entries] == list(range(3000)) and all(new for _, new in entries)
    assert [table.entry(k % 7, f"c{k}") for k in range(3000)] == [(k, False) for k in range(3000)]


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
