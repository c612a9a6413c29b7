"""Removal of long repeated byte strings by merging sorted suffix runs.

Every string of `length` bytes holds at least one anchor: the position of the smallest hash among its
grams of half its length. Equal strings choose the same anchor, so only the suffixes at anchors
have to be sorted, about two in a hundred.

1. Anchors are shuffled by the hash of their gram; those whose whole surroundings (all strings that
   may choose them) occur twice are settled at once.
2. Of what is left, suffixes go in sorted runs, front-coded (length of the prefix shared with the
   suffix before, and the rest), to the task that merges their grams. A loser tree that keeps the
   shared prefix with the last winner merges the runs and never compares a known prefix again.
3. Suffixes that share a gram, with the bytes before them, tell which strings occur elsewhere.
   Grams with very many different surroundings are counted string by string instead.
4. Each document's intervals are joined to its text and cut out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, process_cache, stop_split, written
from larder.llm.ngram_join import _BITMAP_BITS, bitmap_of
from larder.llm.shingles import mix

#: Bytes of a string that may not occur twice.
LENGTH = 400
#: Different surroundings of a gram that one task compares: with `LENGTH` bytes after and half of it before, 40 MB.
GROUP = 1 << 16
#: Bytes of suffixes that one merge holds.
MERGE_BYTES = 24 << 20
#: Bytes of suffixes that a task sorts into one run.
RUN_BYTES = 16 << 20
_SEGMENT = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, and two random numbers for each byte."""
    cache = process_cache("suffix-powers")
    if len(cache.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        base = 0xDA942042E4DD58B5
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(factor)
            cache[name] = np.multiply.accumulate(out)
        cache["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cache["other"] = mix(cache["byte"] + np.uint64(1))
    return cache["up"], cache["down"], cache["byte"], cache["other"]


def _sums(data: np.ndarray, other: bool) -> np.ndarray:
    up, _, byte, second = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((second if other else byte)[data] * up[: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every window of `width`, by running minima of blocks in both directions."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    square = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, the hash of each one's gram, and that of its surroundings.

    The surroundings reach from the first byte to the last of all strings that may choose the
    anchor, as far as the text does.
    """
    gram = length // 2
    width = length - gram + 1
    found = [[], [], []]
    for at in range(0, max(0, len(data) - length + 1), _SEGMENT):
        stop = min(len(data), at + _SEGMENT + length - 1)
        low, high = max(0, at - length), min(len(data), stop + length)
        sums = _sums(data[low:high], False)
        begin = np.arange(at - low, stop - low - gram + 1)
        keys = (_hashes(sums, begin, begin + gram) & ~np.uint64((1 << 21) - 1)) | (begin - begin[0]).astype(np.uint64)
        chosen = np.unique(_least_in_windows(keys, width) & np.uint64((1 << 21) - 1)).astype(np.int64) + at
        second = _sums(data[low:high], True)
        before, after = np.maximum(chosen - (length - gram), 0), np.minimum(chosen + length, len(data))
        where = _hashes(second, before - low, after - low) + mix((chosen - before).astype(np.uint64) + np.uint64(1))
        for column, values in zip(found, (chosen, _hashes(sums, chosen - low, chosen - low + gram), where)):
            column.append(values)
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    positions, grams, around = (np.concatenate(c) for c in found)
    first = np.unique(positions, return_index=True)[1]
    return positions[first], grams[first], around[first]


_ANCHORS = "gram long, around long, row_key long, at long"


def _anchors(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in range(0, batch.num_rows, 1024):
                some, out = batch.slice(part, 1024), [[], [], [], []]
                for row, text in zip(some.column(0).to_pylist(), some.column(1)):
                    at, grams, around = anchors(np.frombuffer(text.as_py().encode(), np.uint8), length)
                    for column, values in zip(out, (grams.view(np.int64), around.view(np.int64), np.full(len(at), row, np.int64), at)):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["gram", "around", "row_key", "at"])

    return run


_SORTED = "kind int, gram long, row_key long, at long"


def _settle(limit: int):
    """From anchors in order of (gram, surroundings): kind 0 for those whose surroundings occur again,
    kind 1 for the first of each of several surroundings of a gram, kind 2 for grams with over `limit` of them (in `at`)."""

    def run(batches):
        import pyarrow as pa

        def rows(kind, gram, row, at):
            n = len(gram)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *[pa.array(c, pa.int64()) for c in (gram, row, at)]], ["kind", "gram", "row_key", "at"])

        last = lone = first = None  # the last row; it, if nothing like it was seen yet; the last first row, if its gram is alone yet
        gram_now, kinds_now = None, 0
        for batch in batches:
            gram, around, row, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(gram):
                continue
            new = np.r_[True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])]
            if last is not None:
                new[0] = (gram[0], around[0]) != last[:2]
                if lone is not None and not new[0]:
                    yield rows(0, *[[v] for v in (lone[0], lone[2], lone[3])])
            again = ~new | np.r_[~new[1:], False]
            yield rows(0, gram[again], row[again], at[again])
            last = (gram[-1], around[-1], row[-1], at[-1])
            lone = last if new[-1] else None
            heads = np.flatnonzero(new)
            if not len(heads):
                continue
            g, r, a = gram[heads], row[heads], at[heads]
            same = np.r_[False, g[1:] == g[:-1]]
            same[0] = gram_now is not None and g[0] == gram_now
            if first is not None and same[0]:
                yield rows(1, *[[v] for v in first])
            several = same | np.r_[same[1:], False]
            yield rows(1, g[several], r[several], a[several])
            first = None if several[-1] else (g[-1], r[-1], a[-1])
            starts = np.flatnonzero(~same)
            sizes = np.diff(np.r_[starts, len(g)]) if len(starts) else np.zeros(0, int)
            kinds_now += int(starts[0]) if len(starts) else len(g)
            if len(starts):
                if kinds_now > limit:
                    yield rows(2, [gram_now], [None], [kinds_now])
                big = np.flatnonzero(sizes[:-1] > limit)
                yield rows(2, g[starts[big]], [None] * len(big), sizes[big])
                kinds_now = int(sizes[-1])
            gram_now = g[-1]
        if kinds_now > limit:
            yield rows(2, [gram_now], [None], [kinds_now])

    return run


# -- front-coded runs and their merge --------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are not looked at."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            size = min(len(x), len(y))
            differ = int.from_bytes(x[:size]) ^ int.from_bytes(y[:size])
            return known + (size - (differ.bit_length() + 7) // 8 if differ else size)
        known += len(x)
    return n


def front_coded(items: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, bytes before it, row, position); each suffix without what it shares with the one before."""
    import struct
    import zlib

    out, last = [], b""
    for suffix, before, row, at in items:
        shared = shared_prefix(last, suffix)
        out.append(struct.pack("<HHHqq", shared, len(suffix) - shared, len(before), row, at) + suffix[shared:] + before)
        last = suffix
    return zlib.compress(b"".join(out), 1)


def read_run(blob: bytes):
    """(suffix, length shared with the suffix before, bytes before it, row, position) in order."""
    import struct
    import zlib

    data, at, last = zlib.decompress(blob), 0, b""
    while at < len(data):
        shared, rest, before, row, position = struct.unpack_from("<HHHqq", data, at)
        at += 22
        last = last[:shared] + data[at : at + rest]
        at += rest
        yield last, shared, data[at : at + before], row, position
        at += before


def merge_runs(runs: list):
    """Merges sorted runs of (suffix, shared with its predecessor, ...) by a loser tree.

    Every player carries the prefix it shares with the last suffix that left the tree. Of two
    players the one that shares more is the smaller; only players that share equally much are
    compared, and from there on. Yields each item with the prefix shared with the one before.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [None] * size  # the current item of each run, None when it has ended
    known = [0] * size
    runs = [iter(r) for r in runs]
    for k, run in enumerate(runs):
        heads[k] = next(run, None)

    def beats(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then carries the prefix it shares with the winner."""
        if heads[b] is None:
            return a, b
        if heads[a] is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        one, two = heads[a][0], heads[b][0]
        shared = shared_prefix(one, two, known[a])
        if one[shared:] <= two[shared:]:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = beats(winners[2 * node], winners[2 * node + 1])
    champion = winners[1] if size > 1 else 0
    while heads[champion] is not None:
        yield heads[champion], known[champion]
        heads[champion] = next(runs[champion], None) if champion < len(runs) else None
        known[champion] = heads[champion][1] if heads[champion] is not None else 0
        node = (champion + size) // 2
        while node:
            champion, losers[node] = beats(champion, losers[node])
            node //= 2


def repeated_starts(suffixes: list[bytes], shared: list[int], befores: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each of the sorted suffixes that share a gram: intervals (from, to) of distances before the
    anchor at which a string of `length` bytes begins that also occurs at another of them."""
    m, reach = len(suffixes), length - length // 2
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m <= 12:
        for i in range(m):
            right = len(suffixes[i])
            for j in range(i + 1, m):
                right = min(right, shared[j])
                if right >= length - reach:
                    left = shared_prefix(befores[i], befores[j])
                    if length - right <= left:
                        span = max(0, length - right), min(reach, left)
                        out[i].append(span)
                        out[j].append(span)
        return out
    sizes, lefts = np.array([len(s) for s in suffixes]), np.array([len(b) for b in befores])
    order = sorted(range(m), key=befores.__getitem__)
    steps = np.array([0] + [shared_prefix(befores[a], befores[b]) for a, b in zip(order, order[1:])])
    rights = np.array([0] + shared[1:])
    place, hits = np.empty(m, int), np.zeros((reach + 3, m), np.int8)  # a row of zeros at either end
    for distance in range(reach + 1):
        place[order] = np.cumsum(steps < distance)
        key = np.cumsum(rights < length - distance) * (m + 1) + place
        some = np.flatnonzero((sizes >= length - distance) & (lefts >= distance))
        some = some[np.argsort(key[some], kind="stable")]
        same = key[some][1:] == key[some][:-1]
        hits[distance + 1, some[np.r_[False, same] | np.r_[same, False]] if len(some) else some] = 1
    edges = np.diff(hits, axis=0).T
    for (k, near), (_, far) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist()):
        out[k].append((near, far - 1))
    return out


def _place_keys(rows, at) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(np.asarray(rows, np.int64).astype(np.uint64)) + np.asarray(at, np.int64).astype(np.uint64)).astype(np.int64)


def _keyed(batches):
    import pyarrow as pa

    for batch in batches:
        row, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_place_keys(row, at)), batch.column(2)], ["row_key", "place", "hot"])


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & ((1 << _BITMAP_BITS) - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


_WORK = "part int, run binary, string long, row_key long, at long, distance int"


def _suffixes(filters, length: int, parts: int):
    """Front-coded runs of the open suffixes of a task; of grams with too many surroundings, every string's hash."""

    def run(batches):
        import pyarrow as pa

        rows_open, places, hot = filters.value
        reach = length - length // 2
        runs: dict[int, list] = {}
        held = 0

        def flush():
            blobs = [(part, front_coded(sorted(items))) for part, items in sorted(runs.items())]
            none = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary()), *none], [x.split()[0] for x in _WORK.split(", ")])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(_has(rows_open, keys)):
                row, data = int(keys[k]), batch.column(1)[int(k)].as_py().encode()
                whole = np.frombuffer(data, np.uint8)
                at, grams, _ = anchors(whole, length)
                own = _place_keys(np.full(len(at), row), at)
                for i in np.flatnonzero(_has(places, own)):
                    a = int(at[i])
                    item = data[a : a + length], data[max(0, a - reach) : a][::-1], row, a
                    runs.setdefault(int(grams[i] % np.uint64(parts)), []).append(item)
                    held += len(item[0]) + len(item[1]) + 100
                if held > RUN_BYTES:
                    yield flush()
                    runs.clear()
                    held = 0
                many = np.flatnonzero(_has(hot, own))
                for i in many:
                    a = int(at[i])
                    low = max(0, a - reach)
                    sums = [_sums(whole[low : a + length], other) for other in (False, True)]
                    starts = np.arange(low, min(a, len(data) - length) + 1)
                    with np.errstate(over="ignore"):
                        one, two = (_hashes(s, starts - low, starts - low + length) for s in sums)
                        strings = mix(one + mix(two)) + (a - starts).astype(np.uint64)
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(strings.view(np.int64)), pa.array(np.full(n, row)), pa.array(np.full(n, a)), pa.array((a - starts).astype(np.int32))],
                        [x.split()[0] for x in _WORK.split(", ")],
                    )
        if runs:
            yield flush()

    return run


_SPANS = "row_key long, begin long, finish long"


def _merge(length: int):
    """Runs arrive part by part; each part is merged and its grams' suffixes compared."""

    def run(batches):
        import pyarrow as pa

        gram, spans = length // 2, []

        def compare(group):
            if len(group) > 1:
                found = repeated_starts([g[0][0] for g in group], [g[1] for g in group], [g[0][2] for g in group], length)
                for (item, _), intervals in zip(group, found):
                    spans.extend((item[3], item[4] - far, item[4] - near + length) for near, far in intervals)

        def merged(blobs):
            group = []
            for item, shared in merge_runs([read_run(b) for b in blobs]):
                if shared < gram:
                    compare(group)
                    group = []
                group.append((item, shared))
            compare(group)

        def made():
            columns = list(zip(*spans)) or [()] * 3
            spans.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row_key", "begin", "finish"])

        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    merged(blobs)
                    part, blobs = p, []
                    if len(spans) > 50_000:
                        yield made()
                blobs.append(blob.as_py())
        merged(blobs)
        yield made()

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(row_key, begin, finish): bytes under strings that also begin elsewhere, from (row_key, text); spans may overlap."""
    spark = docs.sparkSession
    reach = length - length // 2
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = stop_split(spark, 2 * size // reach, 2_000_000)
    found = docs.select("row_key", "text").mapInArrow(_anchors(length), _ANCHORS).repartition(n_parts, "gram").sortWithinPartitions("gram", "around")
    found = written(found.mapInArrow(_settle(group), _SORTED), "anchors")
    hot = found.filter("kind = 2").select("gram", F.lit(True).alias("hot"))
    firsts = found.filter("kind = 1").select("gram", "row_key", "at").join(hot, "gram", "left")
    keyed = firsts.select("row_key", "at", F.coalesce("hot", F.lit(False)).alias("hot")).mapInArrow(_keyed, "row_key long, place long, hot boolean")
    keyed = written(keyed, "open-anchors")
    filters = [bitmap_of(keyed, "row_key"), bitmap_of(keyed.filter("not hot"), "place"), bitmap_of(keyed.filter("hot"), "place")]
    parts = max(1, n_parts, int(keyed.count() * (length + reach) // MERGE_BYTES))
    work = written(docs.select("row_key", "text").mapInArrow(_suffixes(spark.sparkContext.broadcast(filters), length, parts), _WORK), "suffix-runs")
    runs = work.filter("run is not null").select("part", "run").repartition(n_parts, "part").sortWithinPartitions("part")
    merged = runs.mapInArrow(_merge(length), _SPANS)
    strings = work.filter("run is null").select("string", "row_key", "at", "distance")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    counted = strings.join(twice, "string", "left_semi").select("row_key", (F.col("at") - F.col("distance")).alias("begin"), (F.col("at") - F.col("distance") + length).alias("finish"))
    settled = found.filter("kind = 0").select("row_key", (F.col("at") - reach).alias("begin"), (F.col("at") + length).alias("finish"))
    return settled.unionByName(merged).unionByName(counted)


def union_of(spans, n: int) -> list[tuple[int, int]]:
    """Disjoint ascending spans within [0, n); touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, s["begin"]), min(n, s["finish"])) for s in spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _cut(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            data = text.as_py().encode()
            gone, kept, at = union_of(spans.as_py() or [], len(data)), [], 0
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            out.append((left, len(data), len(data) - len(left), len(gone), [{"begin": a, "end": b} for a, b in gone], hashlib.sha256(left).hexdigest()))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string()]
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
        )


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, spans, kept_sha256), one row per input row.

    Every byte goes that lies under a string of `length` bytes which also begins anywhere else, in
    the same text too, whatever else is removed; `kept` are the bytes that stay, not always whole
    characters. A null text is the empty one. Rows that repeat each other hold each other's strings.
    An empty table gives no rows.
    """
    docs = documents(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(docs, length, group).groupBy("row_key").agg(F.collect_list(F.struct("begin", "finish")).alias("spans"))  # bounded by the document
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept_sha256 string"
    return docs.join(spans, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)
