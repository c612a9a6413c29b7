"""Exact deduplication by Grace hashing.

1. Every task keeps the contents of its own rows in an open-addressing table and passes on each
   distinct content once, with the smallest row and the number of rows that had it. A group of
   copies that holds a third of all rows becomes at most one record per task here.
2. The remaining records are partitioned by leading digits of their digest. Partitions are
   measured; one that is over the limit is partitioned again by the next digit, until each
   bucket fits the table of one task. The exchanges are Spark's shuffles, so a lost executor
   costs its own tasks only.
3. In each bucket a table compares complete contents, never digests alone.
"""

from __future__ import annotations

import sys
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import SPACES, documents, free_names, written

#: Bytes, as Python keeps them, that a map-side table holds before it passes its records on.
COMBINE_BYTES = 48 << 20
#: Content bytes of a bucket that one task's table may hold.
BUCKET_BYTES = 96 << 20
#: Content bytes of one batch that a table passes on.
SLICE_BYTES = 4 << 20
#: Bytes of a table entry beside its content: hash, digest, smallest row, slots.
ENTRY_BYTES = 400
_DIGITS = 24


class ContentTable:
    """Open addressing with linear probing; a hit needs equal hashes and equal contents."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.size = 0

    def entry(self, hashed: int, content: str) -> tuple[int, bool]:
        """The entry's number and whether it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = hashed & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == hashed and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        slots[at] = e = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.size += sys.getsizeof(content) + ENTRY_BYTES
        if 3 * len(self.contents) > 2 * len(slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for e, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


_LOCAL = "row_no long, doc_id long, text_sha256 string, rep_no long, rep_row long, rep_doc long, rows long, content string"
_FOUND = "rep_no long, keep_id long, keep_row long, group_size long"


def _smaller(doc, row, other_doc, other_row) -> bool:
    """Order of (doc_id, row), null ids last."""
    return (doc is None, doc or 0, row) < (other_doc is None, other_doc or 0, other_row)


def _combine(limit: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        table, first, next_row = ContentTable(), base, base
        best: list[list] = []  # per entry: smallest doc_id, its row, number of rows, digest

        def passed(begin, end):
            some, none = best[begin:end], pa.nulls(end - begin, pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, pa.array([b[3] for b in some], pa.string()), pa.array(range(first + begin, first + end), pa.int64()), pa.array([b[1] for b in some], pa.int64()),
                 pa.array([b[0] for b in some], pa.int64()), pa.array([b[2] for b in some], pa.int64()), pa.array(table.contents[begin:end], pa.string())],
                ["row_no", "doc_id", "text_sha256", "rep_no", "rep_row", "rep_doc", "rows", "content"],
            )

        def flush():
            begin = held = 0
            for e, content in enumerate(table.contents):
                held += sys.getsizeof(content)
                if held > SLICE_BYTES:
                    yield passed(begin, e + 1)
                    begin, held = e + 1, 0
            if begin < len(best):
                yield passed(begin, len(best))

        def slices():
            """Batches cut where their entries could overfill the table."""
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    yield batch.slice(at, 512)

        for batch in slices():
            docs, shas, reps = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            rows = range(next_row, next_row + len(docs))
            for row, doc, sha, content in zip(rows, docs, shas, batch.column(1)):
                e, new = table.entry(int(sha[:15], 16), content.as_py())
                if new:
                    best.append([doc, row, 0, sha])
                b = best[e]
                b[2] += 1
                if _smaller(doc, row, b[0], b[1]):
                    b[:2] = doc, row
                reps.append(first + e)
            next_row += len(docs)
            none = pa.nulls(len(docs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), batch.column(2), pa.array(reps, pa.int64()), none, none, none, pa.nulls(len(docs), pa.string())],
                ["row_no", "doc_id", "text_sha256", "rep_no", "rep_row", "rep_doc", "rows", "content"],
            )
            if table.size > limit:
                yield from flush()
                first += len(best)
                table.clear()
                best.clear()
        if best:
            yield from flush()

    return run


def _match(batches):
    """Buckets arrive one after the other; a bucket's table goes when the next one begins."""
    import pyarrow as pa

    table, path, best, members = ContentTable(), None, [], []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in members], pa.int64())] + [pa.array([best[e][k] for _, e in members], pa.int64()) for k in range(3)],
            ["rep_no", "keep_id", "keep_row", "group_size"],
        )

    for batch in batches:
        plain = [batch.column(k).to_pylist() for k in range(6)]
        for bucket, rep, sha, row, doc, rows, content in zip(*plain, batch.column(6)):
            if bucket != path:
                if members:
                    yield flush()
                table.clear()
                best, members, path = [], [], bucket
            e, new = table.entry(int(sha[:15], 16), content.as_py())
            if new:
                best.append([doc, row, 0])
            b = best[e]
            b[2] += rows
            if _smaller(doc, row, b[0], b[1]):
                b[:2] = doc, row
            members.append((rep, e))
    if members:
        yield flush()


def _bucketed(reps: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """`reps` with a `path` of leading digest digits under which at most `limit` bytes lie."""
    total = reps.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    width = 1
    while 16**width * limit < 4 * total:
        width += 1
    reps = reps.withColumn("path", F.substring("text_sha256", 1, width))
    for _ in range(width, _DIGITS):
        over = reps.groupBy("path").agg(F.sum(F.octet_length("content")).alias("_bytes"), F.min("text_sha256").alias("_a"), F.max("text_sha256").alias("_b"))
        over = over.filter((F.col("_bytes") > limit) & (F.col("_a") != F.col("_b"))).select("path", F.lit(True).alias("_over"))
        if over.isEmpty():
            break
        longer = F.substring("text_sha256", F.lit(1), F.length("path") + 1)
        reps = reps.join(over, "path", "left").withColumn("path", F.when(F.col("_over"), longer).otherwise(F.col("path"))).drop("_over")
    return reps, -(-total // limit)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", combine_bytes: int = COMBINE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical after every run of ASCII white space became one space; null is
    the empty text. The row with the smallest doc_id stays; a null doc_id comes last, and of rows
    that repeat the same doc_id and text only one is `kept`. An empty table gives no rows.
    """
    normal = documents(docs, id_col, text_col).withColumn("text", F.regexp_replace("text", SPACES, " "))
    normal = normal.withColumn("text_sha256", F.sha2("text", 256))
    local = written(normal.mapInArrow(_combine(combine_bytes), _LOCAL), "exact-local")
    reps = local.filter(F.col("rows").isNotNull()).select("rep_no", "text_sha256", "rep_row", "rep_doc", "rows", "content")
    reps, tasks = _bucketed(reps, bucket_bytes)
    n = max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (
        reps.select("path", "rep_no", "text_sha256", "rep_row", "rep_doc", "rows", "content")
        .repartition(n, "path")
        .sortWithinPartitions("path")
        .mapInArrow(_match, _FOUND)
    )
    rows = local.filter(F.col("row_no").isNotNull()).select("row_no", "doc_id", "text_sha256", "rep_no")
    return rows.join(found, "rep_no").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def first_of_equals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that `exact_groups` keeps: one of each group of equal texts.

    Of rows that repeat the doc_id and the text and differ in other columns, any one stays.
    """
    own, keep, sha = free_names(docs, "own", "keep", "sha")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(sha))
    normal = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " "), 256)
    same = F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(own) == F.col(sha))
    return docs.withColumn(own, normal).join(kept, same, "left_semi").dropDuplicates([id_col, own]).drop(own)
