"""Packing token sequences by shortest-pack-first over the length histogram.

1. Tasks turn texts into ids, cut each document after every `max_tokens` ids and number the
   pieces of each length within their partition.
2. The histogram of lengths (at most `max_tokens` rows) goes to the driver, which places lengths
   longest first, always into the packs with most room, and counts packing patterns.
3. A piece's rank among the pieces of its length (its number in the partition plus the pieces of
   the partitions before) finds its place in the patterns, which are a bounded table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import documents, process_cache, written

#: Words and their ids that a worker process keeps.
CACHED_WORDS = 1_500_000
_PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long, ids array<int>"


class WordEncoder:
    """Ids of whole texts, from a table of words: tokens never cross white space.

    Unknown words of Latin letters, ASCII digits and signs are split as the tokenizer splits
    them, and their distinct parts are encoded in one call, where each part ends with an
    end-of-word token; any other word is encoded by itself.
    """

    def __init__(self, path: str) -> None:
        import re

        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿŒœ]{1,64}").fullmatch
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^0-9a-zß-öø-ÿœ]+").findall
        self.words: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}

    def _learn_parts(self, parts: list[str]) -> None:
        import numpy as np

        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.known.update((p, raw[a:b]) for p, a, b in zip(some, cuts, cuts[1:]))
            else:
                self.known.update(zip(some, self._alone(some)))

    def _alone(self, words: list[str]) -> Iterator[bytes]:
        import numpy as np

        for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(x.ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > CACHED_WORDS:
            self.words = {"": b""}
            words = words | {""}
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known, plain, other, new = self.known, [], [], {}
        for word in words:
            if self.plain(word) and "<|" not in word:
                parts = self.parts(word.lower())
                plain.append((word, parts))
                for p in parts:
                    if p not in known:
                        new[p] = None
            else:
                other.append(word)
        self._learn_parts(list(new))
        for word, parts in plain:
            self.words[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        self.words.update(zip(other, self._alone(other)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        for at, words in enumerate(split):
            try:
                yield b"".join(map(self.words.__getitem__, words))
            except KeyError:  # all that the rest lacks is learned in one call
                self._learn(set().union(*split[at:]).difference(self.words))
                if any(w not in self.words for w in words):  # the table was emptied meanwhile
                    self._learn({w for some in split[at:] for w in some})
                yield b"".join(map(self.words.__getitem__, words))


def _pieces(path: str, end_id: int, size: int, keep_ids: bool):
    def run(batches):
        import zlib
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        cache = process_cache("word-ids")
        if path not in cache:
            cache[path] = WordEncoder(path)
        encoder, end = cache[path], int(end_id).to_bytes(4, "little")
        names = [x.split()[0] for x in _PIECES.split(", ")]
        types = [pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int32())]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        cut = ids[4 * start : 4 * (start + size)]
                        length = len(cut) // 4
                        out.append((part, doc, start, length, zlib.crc32(cut), n, seen[length], np.frombuffer(cut, "<i4").tolist() if keep_ids else None))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of packs, [(length, how many of it)])] that hold every length of the histogram.

    Lengths go longest first into the packs with most room; packs alike share one pattern, so the
    work depends on the number of lengths and patterns, not on the number of documents.
    """
    open_packs: list[tuple[int, int, int, list]] = []  # (-room, tie, packs, pattern)
    tie, done = 0, []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not open_packs or -open_packs[0][0] < length:
                tie += 1
                heapq.heappush(open_packs, (-size, tie, left, []))
            room, _, packs, pattern = heapq.heappop(open_packs)
            room = -room
            below = -open_packs[0][0] if open_packs else 0
            each = min(max(1, (room - below) // length), room // length)
            if left < packs * each:
                each = max(1, left // packs)
            used = min(packs, left // each)
            if used < packs:
                tie += 1
                heapq.heappush(open_packs, (-room, tie, packs - used, pattern))
            left -= used * each
            room -= each * length
            if pattern and pattern[-1][0] == length:
                pattern = [*pattern[:-1], (length, pattern[-1][1] + each)]
            else:
                pattern = [*pattern, (length, each)]
            if room:
                tie += 1
                heapq.heappush(open_packs, (-room, tie, used, pattern))
            else:
                done.append((used, pattern))
    return done + [(packs, pattern) for _, _, packs, pattern in sorted(open_packs)]


def _places(patterns, size: int):
    """Per length, runs of ranks: (length, first rank, packs of which each holds `each`, first sequence, offset)."""
    import numpy as np

    rows, ranks, sequence = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, ranks.get(length, 0), each, sequence, offset))
            ranks[length] = ranks.get(length, 0) + packs * each
            offset += length * each
        sequence += packs
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), sequence


def _place(table, wide: int, names: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys = table[:, 0].astype(float) * wide + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length.astype(float) * wide + rank, side="right") - 1
            _, first, each, sequence, offset = table[at].T
            nth = rank - first
            keep = [c for c in names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in keep] + [pa.array(sequence + nth // each), pa.array(offset + nth % each * length)], [*keep, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    A null or empty text is the end id alone, so every row, repeated ones too, has at least one
    piece. `tokenizer` is the path of a tokenizers file whose tokens never cross white space.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = documents(docs, id_col, text_col).mapInArrow(_pieces(tokenizer, end_id, max_tokens, keep_ids), _PIECES)
    pieces = written(pieces if keep_ids else pieces.drop("ids"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, _ = _places(shortest_pack_first(histogram, max_tokens), max_tokens)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "rank"]
    ranked = ranked.select(names)
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:-1]) + ", sequence_id bigint, offset bigint"
    if not histogram:
        return spark.createDataFrame([], schema)
    return ranked.mapInArrow(_place(table, max(histogram.values()) + 1, names), schema)
