"""Exact Jaccard self-join of word shingles by prefix trees.

1. Shingles get one global order: rare before frequent by a count sketch of fixed size, then by
   hash. Two sets with the wanted similarity share a shingle among the first ones of each, so a
   set sends only that prefix; the shuffle by shingle keeps those that several sets share.
2. Shingles with the same sets behind them are one group. In a group the sets' shared prefixes are
   put into a trie; each set walks it, the branches share its overlap so far, and a branch is left
   when its lengths and what remains of the prefixes cannot reach the similarity any more.
3. Before that, each set is compared with a leader of its groups, in a few rounds: sets known to be
   connected are not paired any more, so copies of one text cost as many comparisons as there are
   copies. Large groups that still hold several components are split into blocks of bounded size.
4. Pairs whose parity bits (one for each of many buckets of shingles) differ in more places than
   similar sets have shingles apart are no candidates. The others are compared by their whole
   shingle sets, each set's best candidate first; only candidates that are not yet connected follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, free_names, stop_split, written
from larder.llm.components import components
from larder.llm.shingles import mix, shingle_set

#: Least similarity in hundredths.
SIMILARITY = 75
#: Counters of the frequency sketch; more of them tell frequencies apart in larger corpora.
SKETCH_BITS = 21
#: Sets of a group that one task compares with each other.
GROUP = 128
#: Most rounds in which every set is compared with a leader of its groups; they end when one finds no link.
LEADER_ROUNDS = 2
_BLOCK = 1 << 15


def least_overlap(a: int, b: int, similarity: int) -> int:
    """Shared shingles that sets of `a` and `b` shingles need."""
    return -(-similarity * (a + b) // (100 + similarity))


# -- the order of shingles -----------------------------------------------------------------------


def _sketch(bits: int):
    """A task's counters, saturating at 255, in compressed blocks."""

    def run(batches):
        import zlib

        import pyarrow as pa
        from larder.llm.shingles import shingle_hashes, word_hashes

        counts, mask = np.zeros(1 << bits, np.int64), np.uint64((1 << bits) - 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingle_hashes(word_hashes(t.as_py())) & mask for t in batch.column(0).slice(at, 512)]
                at_once = np.concatenate(found).astype(np.int64)
                if len(at_once) > counts.size // 8:
                    counts += np.bincount(at_once, minlength=counts.size)
                else:
                    where, n = np.unique(at_once, return_counts=True)
                    counts[where] += n
        small = np.minimum(counts, 255).astype(np.uint8)
        blocks = [b for b in range(0, counts.size, _BLOCK) if small[b : b + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // _BLOCK for b in blocks], pa.int32()), pa.array([zlib.compress(small[b : b + _BLOCK].tobytes(), 1) for b in blocks], pa.binary())], ["block", "counts"]
        )

    return run


def _summed(batches):
    import zlib

    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
            sums[block] = sums.get(block, 0) + counts.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])


def frequency_levels(docs: DataFrame, bits: int) -> np.ndarray:
    """For each counter, 0 for usual counts and one more for each doubling above four times the mean."""
    rows = docs.select("text").mapInArrow(_sketch(bits), "block int, counts binary").repartition("block").mapInArrow(_summed, "block int, counts binary").collect()
    counts = np.zeros(1 << bits, np.int64)
    for r in rows:
        block = np.frombuffer(bytes(r["counts"]), np.int64)
        counts[r["block"] * _BLOCK : r["block"] * _BLOCK + len(block)] += block
    usual = 4 * max(1.0, counts.mean())
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, 31).astype(np.uint8)


# -- prefixes ------------------------------------------------------------------------------------

_PREFIXES = "row_key long, doc_id long, n long, node long, p long, last long, bits binary, key long"


def node_of(shingles: np.ndarray) -> int:
    """One number for a set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        total = np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)
    return int(mix(total).astype(np.int64)[0])


def ordered_keys(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Ascending keys in the global order: the level, then the hash."""
    level = levels[(shingles & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.int64)
    return np.sort((level << 58) | (shingles >> np.uint64(6)).astype(np.int64))


def parity_bits(shingles: np.ndarray) -> bytes:
    """For each of at least twice as many buckets as shingles, a bit that says whether it holds an odd number of them."""
    size = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _prefixes(levels, similarity: int):
    def run(batches):
        import pyarrow as pa

        names, sent, table = [x.split()[0] for x in _PREFIXES.split(", ")], set(), levels.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                facts, nodes, keys = [], [], []
                for text in some.column(2):
                    shingles = shingle_set(text.as_py())
                    n = len(shingles)
                    node, p, last, bits = None, 0, 0, None
                    if n:
                        node, p = node_of(shingles), n - -(-similarity * n // 100) + 1
                        prefix = ordered_keys(shingles, table)[:p]
                        last, bits = int(prefix[-1]), parity_bits(shingles)
                        if node not in sent:  # equal sets of one task send one prefix
                            sent.add(node)
                            keys.append(prefix)
                            nodes.append(np.full(p, node))
                    facts.append((n, node, p, last, bits))
                columns = list(zip(*facts))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.binary()), pa.nulls(len(facts), pa.int64())], names)
                if keys:
                    size = sum(map(len, keys))
                    none = pa.nulls(size, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(np.concatenate(nodes)), none, none, pa.nulls(size, pa.binary()), pa.array(np.concatenate(keys))], names)

    return run


_SHARED = "key long, node long, members long, signature long"


def _shared(batches):
    """From (key, node) in order: members of keys with several nodes, then one row for each such key."""
    import pyarrow as pa

    names = [x.split()[0] for x in _SHARED.split(", ")]
    last, held, count, total = None, False, 0, np.uint64(0)  # the open key, its only node yet unsent, its size and sum

    def groups(keys, counts, totals):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.int64()), pa.array(counts, pa.int64()), pa.array(totals, pa.uint64()).view(pa.int64())], names)

    def members(keys, nodes):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64())], names)

    for batch in batches:
        keys, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        new = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
        if last is not None and len(keys):
            new[0] = (keys[0], nodes[0]) != last
        keys, nodes = keys[new], nodes[new]
        if not len(keys):
            continue
        goes_on = last is not None and keys[0] == last[0]
        if last is not None and not goes_on and count > 1:
            yield groups([last[0]], [count], [total])
        if goes_on and held:
            keys, nodes = np.r_[last[0], keys], np.r_[last[1], nodes]
            count, total = 0, np.uint64(0)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        with np.errstate(over="ignore"):
            totals = np.add.reduceat(mix(nodes.astype(np.uint64)), starts)
            if goes_on:
                totals[0] += total
        counts = sizes.copy()
        if goes_on:
            counts[0] += count
        send = np.repeat(counts > 1, sizes)
        yield members(keys[send], nodes[send])
        done = np.flatnonzero(counts[:-1] > 1)
        yield groups(keys[starts[done]], counts[done], totals[done])
        last, held, count, total = (keys[-1], nodes[-1]), counts[-1] == 1, int(counts[-1]), totals[-1]
    if count > 1:
        yield groups([last[0]], [count], [total])


# -- groups --------------------------------------------------------------------------------------


class Trie:
    """Shared prefixes of sets from the group's first shingle on, each node with the bounds of what lies below."""

    __slots__ = ("branches", "sets", "least", "most", "rest")

    def __init__(self) -> None:
        self.branches: dict[int, Trie] = {}
        self.sets: list[tuple] = []
        self.least, self.most, self.rest = 1 << 62, 0, 0  # sizes of the sets below, most shingles after a prefix

    def add(self, item: tuple, keys: list[int]) -> None:
        node, n, rest = self, item[1], item[1] - item[2]
        for key in [None, *keys]:
            if key is not None:
                node = node.branches.setdefault(key, Trie())
            node.least, node.most, node.rest = min(node.least, n), max(node.most, n), max(node.rest, rest)
        node.sets.append(item)

    def partners(self, item: tuple, keys: list[int], similarity: int):
        """(set, shared prefix shingles) that may be similar to `item`; equal components are passed over."""
        n, rest, last, own = item[1], item[1] - item[2], item[3], {key: len(keys) - k for k, key in enumerate(keys)}
        stack = [(self, 0, len(keys))]
        while stack:
            node, overlap, left = stack.pop()
            for other in node.sets:
                if other[5] == item[5] and item[5] is not None:
                    continue
                m = other[1]
                if 100 * min(n, m) < similarity * max(n, m):
                    continue
                # beyond the prefix that ends first, at most what is left of its set is shared
                beyond = rest if last <= other[3] else m - other[2]
                if overlap + beyond >= least_overlap(n, m, similarity):
                    yield other, overlap
            for key, below in node.branches.items():
                here, after = (overlap + 1, own[key] - 1) if key in own else (overlap, left)
                if 100 * below.most < similarity * n or similarity * below.least > 100 * n:
                    continue
                if here + after + max(rest, below.rest) < least_overlap(n, below.least, similarity):
                    continue
                stack.append((below, here, after))


def _folded(bits: bytes, size: int) -> np.ndarray:
    """Parity bits for `size` bytes of buckets: halves fall together."""
    words = np.frombuffer(bits, np.uint64)
    while words.nbytes > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _near_bits(able: np.ndarray, n: np.ndarray, bits: list[bytes], similarity: int) -> None:
    """Clears the pairs whose parity bits differ in more places than similar sets have shingles apart."""
    x, y = np.nonzero(able)
    sizes = np.array([len(b) for b in bits])
    smaller = np.minimum(sizes[x], sizes[y])
    apart = n[x] + n[y] - 2 * -(-similarity * (n[x] + n[y]) // (100 + similarity))
    for size in np.unique(smaller).tolist():
        of_size = np.flatnonzero(smaller == size)
        who = np.unique(np.r_[x[of_size], y[of_size]])
        words = np.stack([_folded(bits[k], size) for k in who])
        for at in range(0, len(of_size), step := max(1, (1 << 23) // size)):
            some = of_size[at : at + step]
            differ = np.bitwise_count(words[np.searchsorted(who, x[some])] ^ words[np.searchsorted(who, y[some])]).sum(axis=1, dtype=np.int64)
            far = some[differ > apart[some]]
            able[x[far], y[far]] = False


def able_pairs(items: list[tuple], similarity: int, sides: list[int] | None) -> np.ndarray:
    """Which pairs of (node, n, p, last, shared keys, component, bits) sizes, numbers of keys and parity bits, where given, allow; each pair once."""
    n, p, last, keys = (np.array([item[k] for item in items]) for k in (1, 2, 3, 4))
    larger, smaller = np.maximum(n[:, None], n), np.minimum(n[:, None], n)
    # beyond the prefix that ends first, at most what is left of its set is shared
    beyond = np.where(last[:, None] <= last, (n - p)[:, None], n - p)
    need = -(-similarity * (n[:, None] + n) // (100 + similarity))
    able = (100 * smaller >= similarity * larger) & (np.minimum(keys[:, None], keys) + beyond >= need)
    if items[0][5] is not None:
        component = np.array([item[5] for item in items])
        able &= component[:, None] != component
    if sides:
        side = np.array(sides)
        able &= (side[:, None] == 1) & (side == 0)
    else:
        able &= np.tri(len(items), k=-1, dtype=bool)
    if items[0][6] is not None:
        _near_bits(able, n, [item[6] for item in items], similarity)
    return able


def group_pairs(key: int, items: list[tuple], similarity: int, sides: list[int] | None = None):
    """Candidate pairs (x, y, shared) whose first shared shingle is `key`; with sides, only across them.

    An item is (node, n, p, last, keys, component, bits). Sets that share an earlier shingle meet in that
    one's group, and sets whose sizes and numbers of keys cannot do are left out of the trie.
    """
    starts = [item[4].index(key) for item in items]
    able = able_pairs([(*item[:4], len(item[4]) - at, *item[5:]) for item, at in zip(items, starts)], similarity, sides)
    heads, partners = {}, {}
    for x, y in np.argwhere(able).tolist():
        for k in (x, y):
            if k not in heads:
                heads[k] = frozenset(items[k][4][: starts[k]])
        if heads[x].isdisjoint(heads[y]):
            partners.setdefault(x, set()).add(y)
    if not partners:
        return
    trie, place = Trie(), {item[0]: k for k, item in enumerate(items)}
    wanted = sorted(set().union(partners, *partners.values()))
    tails = {k: items[k][4][starts[k] :] for k in wanted}

    def of(x):
        for other, overlap in trie.partners(items[x], tails[x], similarity) if x in partners else ():
            if place[other[0]] in partners[x]:
                yield min(items[x][0], other[0]), max(items[x][0], other[0]), overlap

    for k in wanted:
        if not sides:
            yield from of(k)
        if not sides or not sides[k]:
            trie.add(items[k], tails[k])
    for k in wanted if sides else ():
        yield from of(k)


def _groups(batches, columns: int):
    """((key, one, two), rows) of each group and pair of blocks; a group holds a bounded number of sets."""
    now, rows = None, []
    for batch in batches:
        plain = [batch.column(k).to_pylist() for k in range(columns)]
        for row in zip(*plain):
            if row[:3] != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield now, rows


_WORK = "key long, one long, two long, side int, node long, component long, weight long"


def _able(similarity: int):
    """Of rows (key, one, two, side, node, component, weight, n, p, last, bits, shared) those that some other row of the group may be similar to."""

    def run(batches):
        import pyarrow as pa

        names, types, out = [x.split()[0] for x in _WORK.split(", ")], [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3, []

        def made():
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for group, rows in _groups(batches, 12):
            items = [(node, n, p, last, shared, component, bits) for _, node, component, _, n, p, last, bits, shared in rows]
            able = able_pairs(items, similarity, [r[0] for r in rows] if group[1] != group[2] else None)
            some = able.any(axis=0) | able.any(axis=1)
            out += [(*group, *rows[k][:4]) for k in np.flatnonzero(some)]
            if len(out) > 50_000:
                yield made()
        yield made()

    return run


def _pairs(similarity: int):
    """Candidate pairs of the groups, from rows (key, one, two, side, node, component, n, p, last, bits, keys)."""

    def run(batches):
        import pyarrow as pa

        out = []

        def made():
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared"])

        for group, rows in _groups(batches, 11):
            items = [(node, n, p, last, keys, component, bits) for _, node, component, n, p, last, bits, keys in rows]
            out.extend(group_pairs(group[0], items, similarity, [r[0] for r in rows] if group[1] != group[2] else None))
            if len(out) > 100_000:
                yield made()
        yield made()

    return run


# -- whole sets ----------------------------------------------------------------------------------

_BITMAP_BITS = 24


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size with the bit of every key; it lets all of them pass, and few others while they are few."""
    bit = F.col(column).bitwiseAND((1 << _BITMAP_BITS) - 1)
    words = keys.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(63).cast("int").alias("bit"))
    out = np.zeros(1 << (_BITMAP_BITS - 6), np.uint64)
    for r in words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect():
        out[r["word"]] = r["bits"] & ((1 << 64) - 1)
    return out


def _sets(bitmap):
    def run(batches):
        import pyarrow as pa

        bits = bitmap.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & ((1 << _BITMAP_BITS) - 1)
            hit = np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            for part in range(0, len(hit), 256):
                found = [shingle_set(batch.column(1)[int(k)].as_py()) for k in hit[part : part + 256]]
                found = [s for s in found if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    return run


def whole_sets(docs: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, from a second reading of the texts."""
    wanted = nodes.distinct()
    rows = facts.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(rows, "row_key"))
    found = docs.select("row_key", "text").mapInArrow(_sets(bitmap), "node long, shingles binary")
    return written(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verify(similarity: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (one, two))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append((100 + similarity) * shared >= similarity * (len(x) + len(y)))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


#: Comparisons with one set that go to one task; a set with more partners is sent to several.
PARTNERS = 256


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; a set with many partners is spread over tasks."""
    many = pairs.groupBy("a").agg(F.count("*").alias("_n")).filter(F.col("_n") > PARTNERS).select("a", F.ceil(F.col("_n") / PARTNERS).cast("int").alias("shares"))
    shares = F.coalesce("shares", F.lit(1))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")).join(many, "a", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    rows = pairs.select("a", "b").join(many, "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), shares).cast("int")).join(two, "b").join(one, ["a", "share"])
    return written(rows.select("a", "b", "one", "two").mapInArrow(_verify(similarity), "a long, b long"), "links")


# -- the join ------------------------------------------------------------------------------------


def _open_groups(kept: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the groups that lie in several components, (key, node, n, members, keys, component); a set without links is its own component."""
    rows = kept.withColumn("component", F.col("node"))
    if labels is not None:
        rows = kept.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter(F.col("_a") != F.col("_b")).select("key")
    return rows.join(mixed, "key", "left_semi")


def _likely(similarity: int):
    """Of pairs (a, b, n of a, n of b, bits of a, bits of b) those that the parity bits allow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for n, m, one, two in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                size = min(len(one), len(two))
                differ = int(np.bitwise_count(_folded(one, size) ^ _folded(two, size)).sum(dtype=np.int64))
                good.append(differ <= n + m - 2 * least_overlap(n, m, similarity))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _leader_links(groups: DataFrame, docs: DataFrame, facts: DataFrame, about: DataFrame, similarity: int, turn: int) -> DataFrame:
    """Each set compared with one leader of its groups: of those in another component and of a possible size, the one of most of them.

    A group's leader is in even rounds the set that shares most of its prefix with others (of near copies, the one
    they were made from), in odd rounds a random one, mostly of the group's largest component.
    """
    first = -F.col("central") if turn % 2 == 0 else F.lit(0.0)
    place = F.struct(first.alias("f"), F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("leader"), F.col("component").alias("of"), F.col("n").alias("size"))
    leaders = groups.groupBy("key").agg(F.min(place).alias("l"))
    able = (F.col("component") != F.col("l.of")) & (100 * F.least("n", "l.size") >= similarity * F.greatest("n", "l.size"))
    met = groups.join(leaders, "key").filter(able).groupBy("node", F.col("l.leader").alias("leader")).agg(F.count("*").alias("shared"))
    pairs = met.groupBy("node").agg(F.max(F.struct("shared", "leader")).alias("best"))
    pairs = pairs.select(F.col("best.leader").alias("a"), F.col("node").alias("b"))
    for end in ("a", "b"):
        pairs = pairs.join(about.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    likely = pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_likely(similarity), "a long, b long")
    pairs = written(likely, "leaders")
    sets = whole_sets(docs, facts, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    return verified(pairs, sets, similarity)


def _blocks(large: DataFrame, similarity: int, group: int) -> DataFrame:
    """Pairs of blocks of large groups, (key, one, two, side, node, component, weight): bands of like size, sets of a component together."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / similarity))).cast("int")
    sized = large.withColumn("band", band).withColumn("bucket", F.pmod(F.xxhash64("component"), F.ceil(F.col("members") / group)).cast("int"))
    sizes = sized.groupBy("key", "band", "bucket").agg(F.count("*").alias("_n"))
    sized = sized.join(sizes, ["key", "band", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("_n") / group)).cast("int"))
    place = ["key", "band", "bucket", "part"]
    blocks = sized.groupBy(*place).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = written(blocks.withColumn("block", F.xxhash64("band", "bucket", "part")), "blocks")
    one, two = (blocks.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "block", "low", "high")]) for s in ("one", "two"))
    near = (F.col("band_two") - F.col("band_one")).between(0, 1) & ((F.col("band_one") != F.col("band_two")) | (F.col("block_one") <= F.col("block_two")))
    settled = (F.col("low_one") == F.col("high_one")) & (F.col("low_two") == F.col("high_two")) & (F.col("low_one") == F.col("low_two"))
    pairs = one.join(two, "key").filter(near & ~settled).select("key", F.col("block_one").alias("one"), F.col("block_two").alias("two"))
    sides = F.when(F.col("one") == F.col("two"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    pairs = pairs.select("key", "one", "two", F.explode(sides).alias("side")).withColumn("block", F.when(F.col("side") == 0, F.col("one")).otherwise(F.col("two")))
    rows = sized.withColumn("block", F.xxhash64("band", "bucket", "part")).select("key", "block", "node", "component", F.col("keys").alias("weight"))
    return rows.join(pairs, ["key", "block"]).select("key", "one", "two", "side", "node", "component", "weight")


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: int, sketch_bits: int, group: int) -> DataFrame:
    """(row_key, doc_id, n, component_id, keep_row): the last is the row of each component that stays."""
    spark = docs.sparkSession
    docs = documents(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text")).select("row_key", "doc_id", "text")
    levels = spark.sparkContext.broadcast(frequency_levels(docs, sketch_bits))
    rows = written(docs.mapInArrow(_prefixes(levels, similarity), _PREFIXES), "prefixes")
    facts = rows.filter("key is null").select("row_key", "doc_id", "n", "node", "p", "last", "bits")
    tokens = rows.filter("key is not null").select("key", "node")
    n_parts = stop_split(spark, tokens.count(), 4_000_000)
    shared = written(tokens.repartition(n_parts, "key").sortWithinPartitions("key", "node").mapInArrow(_shared, _SHARED), "shared")
    members = shared.filter("node is not null").select("key", "node")
    kept = shared.filter("node is null").groupBy("members", "signature").agg(F.min("key").alias("key"), F.count("*").alias("keys")).select("key", "members", "keys")
    shares = members.groupBy("node").agg(F.count("*").alias("shared"))
    about = written(facts.filter("node is not null").select("node", "n", "p", "last", "bits").dropDuplicates(["node"]), "sets")
    sizes = about.select("node", "n", "p").join(shares, "node").select("node", "n", F.round(F.col("shared") / F.col("p"), 2).alias("central"))
    kept = written(members.join(kept, "key").join(sizes, "node").select("key", "node", "n", "central", "members", "keys"), "groups")

    labels, links = None, None
    for turn in range(LEADER_ROUNDS):
        groups = _open_groups(kept, labels)
        if groups.isEmpty():
            break
        found = _leader_links(groups, docs, facts, about, similarity, turn)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    groups = written(_open_groups(kept, labels), "open")
    place = [F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(0).alias("side")]
    work = groups.filter(F.col("members") <= group).select("key", *place, "node", "component", F.col("keys").alias("weight"))
    work = work.unionByName(_blocks(groups.filter(F.col("members") > group), similarity, group))
    order = ["key", "one", "two", "side"]
    # Sets of different components share the keys of open groups alone, and able ones meet in all of these: what is
    # left bounds the overlap anew. Most rows go by numbers, before any bits are sent.
    for bits in (None, None, "bits"):
        opened = work.select("key", "node", "weight").distinct().groupBy("node").agg(F.sum("weight").alias("shared"))
        opened = written(about.join(opened, "node"), "opened")
        sent = F.col(bits) if bits else F.lit(None).cast("binary").alias("bits")
        sized = work.join(opened.select("node", "n", "p", "last", sent, "shared"), "node").select(*order, "node", "component", "weight", "n", "p", "last", "bits", "shared")
        sized = sized.repartition(n_parts, "key", "one", "two").sortWithinPartitions(*order)
        work = written(sized.mapInArrow(_able(similarity), _WORK), "able")
    wanted = work.select("node").distinct()
    prefixes = members.join(wanted, "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # bounded by the set's own prefix
    work = work.join(opened.join(prefixes, "node"), "node").select(*order, "node", "component", "n", "p", "last", "bits", "keys")
    work = work.repartition(n_parts, "key", "one", "two").sortWithinPartitions(*order)
    pairs = written(work.mapInArrow(_pairs(similarity), "a long, b long, shared long"), "candidates")

    sets = whole_sets(docs, facts, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    found = verified(best, sets, similarity)
    links = found if links is None else links.unionByName(found)
    labels = components(links)
    side = [labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    rest = pairs.join(side[0], "a", "left").join(side[1], "b", "left")
    rest = rest.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).join(best.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(verified(rest, sets, similarity))
    labels = components(links)

    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("row_key").alias("row"))
    by_node = facts.filter("node is not null").groupBy("node").agg(F.min(order).alias("first"))
    by_node = by_node.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_component = by_node.groupBy("component").agg(F.min("first").alias("first"))
    found = by_node.select("node", "component").join(by_component, "component").select("node", "first")
    lone = F.col("node").isNull()
    return facts.join(found, "node", "left").select(
        "row_key", "doc_id", "n", F.when(lone, F.col("doc_id")).otherwise(F.col("first.doc")).alias("component_id"), F.when(lone, F.col("row_key")).otherwise(F.col("first.row")).alias("keep_row")
    )


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, sketch_bits: int = SKETCH_BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Rows link when 100 * shared >= `similarity` * all of their distinct five-word shingles; a row's
    component is the smallest doc_id that links reach. A row without words, or with a null text,
    has no shingles and is its own component. Rows that repeat a text are linked with each other;
    a null doc_id is never a component's id while another one is there. An empty table gives no rows.
    """
    rows = _grouped(docs, id_col, text_col, similarity, sketch_bits, group)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, sketch_bits: int = SKETCH_BITS, group: int = GROUP) -> DataFrame:
    """The rows of `docs`, with all their columns, that have the smallest doc_id of their component; rows that repeat it stay together."""
    rows = _grouped(docs, id_col, text_col, similarity, sketch_bits, group)
    own, keep = free_names(docs, "own", "keep")
    kept = rows.filter(F.col("row_key") == F.col("keep_row")).select(F.col("row_key").alias(keep)).distinct()
    key = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn(own, key).join(kept, F.col(own) == F.col(keep), "left_semi").drop(own)
