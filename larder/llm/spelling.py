"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

1. Tasks count the words of their texts; counts combine before the shuffle by word.
2. Letters are dealt to `GROUPS` groups of about equal frequency (at most 90 letters reach the driver). A word's path in
   the trie is its number of letters of group 1, of group 2, and so on. Two words one edit apart differ by at most one
   surplus and one deficit in these counts, so a search follows all branches on which it spends no more than that.
3. The upper levels of the trie are spread over the cluster. A cell is a prefix of counts; cells over `CELL` words are
   split `STEP` levels deeper, by joins with the table of such cells, and searches descend with them. Each cell's words,
   at most `CELL` at a time, then become a trie in one task, and its searches go through it depth first. Cells with many
   searches are dealt over several tasks; words that agree in all counts beyond `CELL` are dealt in blocks.
4. Words at the leaves are compared. Of a pair the word with the smaller path (then spelling) searches, so that each pair
   is found once. A word has at most 181 near words per letter, so counting them per word gathers no large group.
5. Forms are followed to the last by doubling: each step multiplies the count by five, which bounds the rounds.

Null texts have no words. A null id counts as an empty one in the damage rule. Repeated rows count again; ties go to
the smaller word in code-point order; an empty table gives an empty result. Only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, written

GROUPS = 20
STEP = 4
#: Words of one trie in a task, and searches that one task takes in one cell.
CELL = 8192
SEARCHES = 32768
#: Words below a node that is not split any further.
BUCKET = 6
#: Distinct words a task holds while it counts.
COUNTED = 400_000
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGED = 6, 5, 5, 199


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the damaged runs with at least LEAST_LENGTH letters that occur LEAST_COUNT times."""

    def run(batches):
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        find = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}").findall
        lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
        total: Counter = Counter()

        def emitted():
            made = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, text = doc.as_py(), text.as_py()
                start = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                runs: Counter = Counter()
                for found, n in Counter(find(text)).items():
                    runs[found.lower() if found.isascii() else found.translate(lower)] += n
                for word, n in runs.items():
                    h = zlib.crc32(word.encode("utf-8"), start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    total[word] += n
                if len(total) > COUNTED:
                    yield emitted()
        yield emitted()

    counts = documents(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_groups(vocabulary: DataFrame, groups: int) -> dict[str, int]:
    """Group of each letter: frequent letters first, each to the group with the fewest letters so far."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
    counts = letters.groupBy("letter").count().collect()  # at most 90 rows: the letters that words are made of
    weight, dealt = [0] * groups, {}
    for letter, n in sorted(counts, key=lambda r: (-r[1], r[0])):
        dealt[letter] = weight.index(min(weight))
        weight[dealt[letter]] += n
    return dealt


def path(word: str, dealt: dict[str, int], groups: int) -> tuple[int, ...]:
    counts = [0] * groups
    for letter in word:
        counts[dealt[letter]] += 1
    return tuple(counts)


def name(prefix: tuple[int, ...]) -> str:
    return ",".join(map(str, prefix))


def extended(counts: tuple[int, ...], prefix: tuple[int, ...], depth: int) -> Iterator[tuple[int, ...]]:
    """Prefixes of `depth` below `prefix` where words of a larger or equal path may be one edit from `counts`.

    A larger path has its surplus before its deficit.
    """
    if len(prefix) == depth:
        yield prefix
        return
    level = len(prefix)
    here = counts[level]
    yield from extended(counts, (*prefix, here), depth)
    surplus = any(a > b for a, b in zip(prefix, counts))
    if not surplus:
        yield from extended(counts, (*prefix, here + 1), depth)
    elif here and not any(a < b for a, b in zip(prefix, counts)):
        yield from extended(counts, (*prefix, here - 1), depth)


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


class Trie:
    """Words of one cell below its prefix; inner nodes are dicts by count, nodes of few words are lists."""

    def __init__(self, level: int, levels: int) -> None:
        self.level, self.levels, self.root = level, levels, []

    def add(self, counts: tuple[int, ...], entry) -> None:
        word = (counts, *entry)
        node, level, holder = self.root, self.level, None
        while isinstance(node, dict):
            holder, key = node, counts[level]
            node = node.setdefault(key, [])
            level += 1
        node.append(word)
        if len(node) > BUCKET and level < self.levels:
            split: dict[int, list] = {}
            for other in node:
                split.setdefault(other[0][level], []).append(other)
            if holder is None:
                self.root = split
            else:
                holder[key] = split

    def search(self, counts: tuple[int, ...], word: str, surplus: bool, deficit: bool) -> Iterator[tuple]:
        """Entries one edit from `word` with a larger (path, spelling), given what the prefix has spent."""
        stack = [(self.root, self.level, surplus, deficit)]
        while stack:
            node, level, surplus, deficit = stack.pop()
            if isinstance(node, list):
                for entry in node:
                    if (entry[0], entry[1]) > (counts, word) and near(word, entry[1]):
                        yield entry
                continue
            here = counts[level]
            if here in node:
                stack.append((node[here], level + 1, surplus, deficit))
            if not surplus and here + 1 in node:
                stack.append((node[here + 1], level + 1, True, deficit))
            if surplus and not deficit and here - 1 in node:
                stack.append((node[here - 1], level + 1, surplus, True))


def _routes(dealt: dict[str, int], groups: int, depth: int):
    """Searches one step deeper: (cell, word, n) for every prefix of `depth` that a word's search may enter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for cell, word, n in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    prefix = tuple(map(int, cell.split(","))) if cell else ()
                    out.extend((name(x), word, n) for x in extended(path(word, dealt, groups), prefix, depth))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES(pa))], ["cell", "word", "n"])

    return run


def _TYPES(pa):
    return pa.string(), pa.string(), pa.int64()


def _paths(dealt: dict[str, int], groups: int):
    """Each word with its whole path."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = [name(path(word.as_py(), dealt, groups)) for word in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns], ["path", "word", "n"])

    return run


def _cells(vocabulary: DataFrame, dealt: dict[str, int], groups: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """(cell, word, n) of the words and of the searches; a cell over `cell` words that can be split is split."""
    spark = vocabulary.sparkSession
    rest = written(vocabulary.select("word", "n").mapInArrow(_paths(dealt, groups), "path string, word string, n long"), "paths")
    searches = vocabulary.select(F.lit("").alias("cell"), "word", "n")
    stored, sent = [], []
    for depth in range(STEP, groups + STEP, STEP):
        depth = min(depth, groups)
        here = rest.withColumn("cell", F.substring_index("path", ",", depth))
        searches = searches.mapInArrow(_routes(dealt, groups, depth), "cell string, word string, n long")
        if depth == groups:
            stored.append(here.select("cell", "word", "n"))
            sent.append(searches)
            break
        large = written(here.groupBy("cell").count().filter(F.col("count") > cell).select("cell"), "large-cells")
        here, searches = written(here, "stored"), written(searches, "searches")
        stored.append(here.join(large, "cell", "left_anti").select("cell", "word", "n"))
        sent.append(searches.join(large, "cell", "left_anti").select("cell", "word", "n"))
        if large.isEmpty():
            break
        rest = here.join(large, "cell", "left_semi").select("path", "word", "n")
        searches = searches.join(large, "cell", "left_semi").select("cell", "word", "n")
    union = [spark.createDataFrame([], "cell string, word string, n long")] * 2
    for k, parts in enumerate((stored, sent)):
        for part in parts:
            union[k] = union[k].unionByName(part)
    return union[0], union[1]


def near_pairs(vocabulary: DataFrame, groups: int = GROUPS, cell: int = CELL, searches: int = SEARCHES) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words of (word, n) that are one edit apart, once."""
    dealt = letter_groups(vocabulary, groups)
    stored, sent = _cells(vocabulary, dealt, groups, cell)
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / cell).alias("blocks"))
    load = sent.groupBy("cell").agg(F.ceil(F.count("*") / searches).alias("turns"))
    plan = written(sizes.join(load, "cell"), "cells")
    of = F.pmod(F.xxhash64("word"), F.col("blocks"))
    turn = F.pmod(F.xxhash64("word"), F.col("turns"))
    every = F.lit(0).cast("long")
    rows = stored.join(plan, "cell").select("cell", of.alias("block"), F.explode(F.sequence(every, F.col("turns") - 1)).alias("turn"), F.lit(0).alias("kind"), "word", "n")
    rows = rows.unionByName(
        sent.join(plan, "cell").select("cell", F.explode(F.sequence(every, F.col("blocks") - 1)).alias("block"), turn.alias("turn"), F.lit(1).alias("kind"), "word", "n")
    )

    def run(batches):
        import pyarrow as pa

        key, trie, prefix = None, None, ()
        for batch in batches:
            out = []
            for cell_name, block, turn, kind, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell_name, block, turn) != key:
                    key, prefix = (cell_name, block, turn), tuple(map(int, cell_name.split(",")))
                    trie = Trie(len(prefix), groups)
                counts = path(word, dealt, groups)
                if kind == 0:
                    trie.add(counts, (word, n))
                else:
                    surplus, deficit = any(a > b for a, b in zip(prefix, counts)), any(a < b for a, b in zip(prefix, counts))
                    out.extend((word, n, other[1], other[2]) for other in trie.search(counts, word, surplus, deficit))
            if out:
                types = (pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["a", "a_n", "b", "b_n"])

    dealt_rows = rows.repartition("cell", "block", "turn").sortWithinPartitions("cell", "block", "turn", "kind")
    return dealt_rows.mapInArrow(run, "a string, a_n long, b string, b_n long")


def followed(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, for counts up to `most`."""
    steps = max(1, math.floor(math.log(max(most, 1) / LEAST_COUNT, RATIO) + 1e-9)) if most > LEAST_COUNT else 1
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        roots = written(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    return roots


def variants(vocabulary: DataFrame) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n."""
    vocabulary = written(vocabulary.select("word", "n"), "vocabulary")
    pairs = written(near_pairs(vocabulary), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word"), F.col("a_n").alias("n")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("other"))).alias("best")
    )
    is_form = -F.col("best.minus") >= RATIO * F.col("n")
    best = written(
        best.select(
            "word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
        ),
        "forms",
    )
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    roots = followed(best.filter("form is not null"), most)
    return (
        vocabulary.join(best, "word", "left").join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
