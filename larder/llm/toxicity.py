"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs that stand for letters) and
searched by an Aho-Corasick automaton for whole lexicon words; words inside an exception phrase do
not count. The weights of the words found, each damped by its number of finds, are summed and
normalised by the text's length, and a logistic curve turns the sum into a score.

Weights, exceptions and the curve are learned from a bounded sample of labelled rows
(`PER_LABEL` of each label, expected number, chosen by a hash of the id). A lexicon word has to
occur among many different neighbours in toxic texts, and equal folded texts count once, so that
copies of one text neither make words nor unmake them. The curve is fitted to all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import held_out, process_cache, written

#: Labelled rows of each label that the lexicon is learned from (expected number).
PER_LABEL = 12_000
#: Words of the lexicon at most, those of largest weight, and of its exceptions.
LEXICON_WORDS = 4096
#: Different pairs of neighbours that a lexicon word has, as a share of its finds in toxic texts.
VARIETY = 0.3

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}
# Digits and signs that stand for letters next to a letter.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}


def fold_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the folded letter or digit (a space for all else), the letter stood for (or 0), whether a letter."""
    import unicodedata

    cache = process_cache("fold")
    if "tables" not in cache:
        plain = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalnum():
                low = unicodedata.normalize("NFKD", ch.lower())[0].lower()[:1]
                plain[c] = ord(LOOK_ALIKES.get(low, low if low.isalnum() else " "))
        stands = np.zeros(0x110000, np.uint32)
        stands[[ord(c) for c in STAND_INS]] = [ord(c) for c in STAND_INS.values()]
        letter = plain != 32
        letter[48:58] = False
        for mark in range(0x300, 0x370):  # combining marks vanish
            plain[mark] = 0
        for hidden in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
            plain[hidden] = 0
        cache["tables"] = plain, stands, letter
    return cache["tables"]


def fold(text: str) -> tuple[str, int]:
    """The folded text, words between single spaces and one at either end, and the number of words."""
    plain, stands, letter = fold_tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = plain[codes]
    if not out.all():
        codes, out = codes[out != 0], out[out != 0]
    stand = np.flatnonzero(stands[codes])
    if len(stand):
        near = np.r_[False, letter[codes], False]
        digit = out[stand] != 32
        # a digit needs a letter on either side, a sign needs one after it: "idiot!!" ends with signs
        hit = stand[(digit & (near[stand] | near[stand + 2])) | (~digit & near[stand + 2])]
        out[hit] = stands[codes[hit]]
    space = out == 32
    out = np.concatenate([[32], out[~(space & np.r_[True, space[:-1]])], [32]]).astype(np.uint32)
    if len(out) > 2 and out[-2] == 32:
        out = out[:-1]
    return out.tobytes().decode("utf-32-le"), int((out == 32).sum()) - 1 if len(out) > 2 else 0


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    base: float = -30.0

    def automaton(self):
        """Finds words and exception phrases, each between spaces."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            machine.add_word(f" {word} ", (word, weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (phrase, None))
        machine.make_automaton()
        return machine

    def raw(self, machine, text: str) -> tuple[float, int]:
        """Length-normalised weight and the number of counted words."""
        folded, words = fold(text)
        hits, excepted = [], []
        if len(machine):
            for end, (found, weight) in machine.iter(folded):
                (excepted if weight is None else hits).append((end - len(found) - 1, end, found))
        if excepted:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in excepted)]
        counts: dict[str, int] = {}
        for _, _, found in hits:
            counts[found] = counts.get(found, 0) + 1
        total = sum(self.weights[w] * (1 + math.log(n)) for w, n in counts.items())
        return total / (1 + math.log1p(words / 1000) / 4), len(hits)

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * raw))))


def _flush(counter: dict, names: list[str], types: list):
    import pyarrow as pa

    columns = list(zip(*[(*k, *v) for k, v in counter.items()])) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _word_counts(batches):
    """Per word: toxic and clean texts that have it."""
    import pyarrow as pa

    names, types, counter = ["word", "toxic", "clean"], [pa.string(), pa.int64(), pa.int64()], {}
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for word in set(fold(text.as_py())[0].split()):
                counter.setdefault((word,), [0, 0])[1 - toxic] += 1
        if len(counter) > 400_000:
            yield _flush(counter, names, types)
            counter = {}
    yield _flush(counter, names, types)


def _contexts(wanted: dict[str, int]):
    """Per candidate word and pair of neighbours: toxic and clean occurrences."""

    def run(batches):
        import pyarrow as pa

        names, types = ["word", "left", "right", "toxic", "clean"], [pa.string()] * 3 + [pa.int64()] * 2
        counter = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = ["", *fold(text.as_py())[0].split(), ""]
                for k, word in enumerate(words):
                    if word in wanted and word:
                        counter.setdefault((word, words[k - 1], words[k + 1]), [0, 0])[1 - toxic] += 1
            if len(counter) > 400_000:
                yield _flush(counter, names, types)
                counter = {}
        yield _flush(counter, names, types)

    return run


def _raw_bins(lexicon: Lexicon, per_unit: int):
    def run(batches):
        import pyarrow as pa

        machine, counter = lexicon.automaton(), {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                counter.setdefault((round(lexicon.raw(machine, text.as_py())[0] * per_unit),), [0, 0])[1 - toxic] += 1
        yield _flush(counter, ["bin", "toxic", "clean"], [pa.int64()] * 3)

    return run


def _logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of weighted data by Newton steps, halved while they do not help."""
    design, b = np.c_[np.ones_like(x), x], np.zeros(2)

    def loss(b):
        z = design @ b
        return (ones * np.logaddexp(0, -z) + zeros * np.logaddexp(0, z)).sum() + ridge * b[1] ** 2

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ ((ones + zeros) * p - ones) + [0, 2 * ridge * b[1]]
        hessian = (design * ((ones + zeros) * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 2 * ridge])
        step = np.linalg.solve(hessian, gradient)
        while loss(b - step) > loss(b) and np.abs(step).max() > 1e-9:
            step /= 2
        b = b - step
        if np.abs(step).max() < 1e-7:
            break
    return float(b[0]), float(b[1])


def labelled(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(text, toxic) of a bounded sample of the rows one may learn from.

    Rows with a null id or text, or without a label, teach nothing; a text with both labels is toxic.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = F.when(F.col("toxic") == 1, per_label / max(1, sizes.get(1, 0))).otherwise(per_label / max(1, sizes.get(0, 0)))
    sample = marks.filter(pick < rate * (1 << 30))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    # at most about 2 * per_label ids: a bounded broadcast
    return texts.join(F.broadcast(sample), "doc_id").select("text", "toxic")


def _folded_keys(batches):
    """(key, text, toxic): the key is a hash of the folded text."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        keys = [hashlib.sha256(fold(text.as_py())[0].encode("utf-8", "surrogatepass")).digest() for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0), batch.column(1)], ["key", "text", "toxic"])


def distinct_texts(sample: DataFrame) -> DataFrame:
    """(text, toxic), one row for all that fold to the same text; with both labels it is toxic."""
    keyed = sample.mapInArrow(_folded_keys, "key binary, text string, toxic int")
    return keyed.groupBy("key").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _exceptions(around: DataFrame) -> list[str]:
    """Pairs of a lexicon word and a neighbour that are clean as a rule; a pair with the word before goes first."""
    found: list[str] = []
    for side, order in (("left", ("left", "word")), ("right", ("word", "right"))):
        rest = around.filter((F.col(side) != "") & ~F.concat_ws(" ", "left", "word").isin(found or [""]))
        pairs = rest.groupBy(F.concat_ws(" ", *order).alias("phrase")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        pairs = pairs.filter((F.col("clean") >= 3) & (F.col("clean") > 3 * F.col("toxic"))).orderBy(F.desc("clean"), "phrase")
        found += [r["phrase"] for r in pairs.limit(LEXICON_WORDS // 2).collect()]
    return sorted(found)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Lexicon:
    """A lexicon from labelled rows; without toxic and clean rows its score is the known base rate."""
    sample = written(labelled(docs, labels, per_label), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon(base=30.0 if toxic else -30.0)
    texts = written(distinct_texts(sample), "texts")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    words = texts.mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(a / (toxic + 1 - a + 0.5)) - F.log(b / (clean + 1 - b + 0.5))
    least = max(3, toxic // 400)
    found = words.filter(F.col("toxic") >= least).withColumn("weight", weight).withColumn("z", F.col("weight") / F.sqrt(1 / a + 1 / b))
    found = found.filter((F.col("weight") > 1.0) & (F.col("z") > 3)).orderBy(F.desc("z"), "word").limit(LEXICON_WORDS)
    candidates = {r["word"]: r for r in found.collect()}
    around = texts.mapInArrow(_contexts(dict.fromkeys(candidates, 1)), "word string, left string, right string, toxic long, clean long")
    around = written(around.groupBy("word", "left", "right").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "contexts")
    toxic_only = around.filter(F.col("toxic") > 0)
    variety = toxic_only.groupBy("word").agg(F.count("*").alias("contexts"), F.sum("toxic").alias("n")).collect()
    varied = {r["word"] for r in variety if r["contexts"] >= max(least, VARIETY * r["n"])}
    lexicon = Lexicon({w: float(candidates[w]["weight"]) for w in sorted(varied)})
    lexicon.exceptions = _exceptions(around.filter(F.col("word").isin(sorted(varied)))) if varied else []
    per_unit = 16
    bins = sample.mapInArrow(_raw_bins(lexicon, per_unit), "bin long, toxic long, clean long").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    x, ones, zeros = (np.array([r[c] for r in bins], float) for c in ("bin", "toxic", "clean"))
    # both labels are sampled alike; the curve is for the shares of the labelled rows as sampled
    lexicon.base, lexicon.slope = _logistic(x / per_unit, ones, zeros)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) of every row; a null or empty text has no hits."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        lexicon = shared.value
        machine = lexicon.automaton()
        for batch in batches:
            raws = [lexicon.raw(machine, text.as_py() or "") for text in batch.column(2)]
            scores = [lexicon.score(r) for r, _ in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([n for _, n in raws], pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long")
