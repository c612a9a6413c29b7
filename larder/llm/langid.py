"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* A text's features are the hashed 1-, 2- and 3-grams of its lower-cased letters, with every run of
  other characters as a boundary; whole texts are read.
* Document frequencies cover all training documents, counted inside the tasks and summed by Spark.
* The weights are fitted on a bounded sample (`per_language` documents of each language, chosen by
  a hash of the id) by follow-the-regularised-leader with an elastic-net penalty. Each of
  `shards` tasks fits its share, and the weights are averaged.
* A part of the sample that was not fitted sets the temperature of the softmax.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, held_out, process_cache, written

#: Hash buckets of the n-grams.
BUCKETS = 1 << 15
#: Sampled training documents of each language (expected number).
PER_LANGUAGE = 1500
#: Every so-many-th sampled document is kept for the temperature.
CALIBRATION = 6
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    cache = process_cache("letters")
    if "table" not in cache:
        table = np.full(0x110000, 32, np.uint32)
        at = [c for c in range(0x110000) if chr(c).isalpha()]
        table[at] = at
        cache["table"] = table
    return cache["table"]


def grams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a text's n-grams; None if it has no letter."""
    codes = letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    if space.all():
        return None
    codes = np.concatenate([[32], codes[~(space & np.r_[False, space[:-1]])], [32]]).astype(np.uint32)
    shift = np.uint32(33 - buckets.bit_length())
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
    mixed = np.concatenate([one * np.uint32(0x27D4EB2F), two * np.uint32(0x165667B1), three * np.uint32(0x9E3779B1)])
    counts = np.bincount((mixed >> shift).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def features(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[at]
    return values / max(np.sqrt(values @ values), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list, labels: list[int], classes: int, buckets: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal with an elastic net over (buckets, unit-length values) rows; the last weight row is the bias."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at):
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for (at, values), label in zip(rows, labels):
            at, values = np.append(at, buckets), np.append(values, 1.0)
            w = weights(at)
            slope = _softmax(values @ w)
            slope[label] -= 1
            g = values[:, None] * slope
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


_COUNTED = "bucket int, df long, language string, pick long, at array<int>, counts array<int>"


def _count(buckets: int):
    """Document frequencies of a task's texts, and the features of sampled ones."""

    def run(batches):
        import pyarrow as pa

        names, df = [x.split()[0] for x in _COUNTED.split(", ")], np.zeros(buckets, np.int64)
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            picked = []
            for text, language, pick, sampled in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                found = grams(text.as_py(), buckets)
                if found:
                    df[found[0]] += 1
                    if sampled:
                        picked.append((None, None, language, pick, found[0], found[1]))
            if picked:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*picked), kinds)], names)
        at = np.flatnonzero(df)
        none = [pa.nulls(len(at), t) for t in kinds[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64()), *none], names)

    return run


def _fit(languages: list[str], idf: np.ndarray):
    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("pick", "ascending"), ("language", "ascending")])
        rows = [(np.array(a), features(np.array(a), np.array(c), idf)) for a, c in zip(table["at"].to_pylist(), table["counts"].to_pylist())]
        w = ftrl(rows, [languages.index(x) for x in table["language"].to_pylist()], len(languages), len(idf))
        at = np.flatnonzero(np.r_[np.abs(w[:-1]).sum(axis=1), 1])
        return pa.table({"bucket": pa.array(at, pa.int32()), "rows": pa.array([len(rows)] * len(at), pa.int64()), "w": pa.array(w[at].tolist(), pa.list_(pa.float64()))})

    return run


def _logits(languages: list[str], idf: np.ndarray, weights: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for language, at, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                at = np.array(at)
                out.append((languages.index(language), (features(at, np.array(counts), idf) @ weights[at] + weights[-1]).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.float64()))], ["label", "logits"])

    return run


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, shards: int = 4) -> LanguageModel:
    """Learns from the rows whose crc32 is not divisible by five and whose text and language are known.

    With no such row, the model knows no language and every text is undetermined.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("language"))
    known = known.filter(~held_out() & F.col("text").isNotNull() & F.col("language").isNotNull())
    sizes = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(buckets), np.zeros((buckets + 1, 0)), 1.0)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n) * (1 << 30))]), F.col("language"))
    counted = written(known.select("text", "language", pick.alias("pick"), (pick < rate).alias("sampled")).mapInArrow(_count(buckets), _COUNTED), "language-counts")
    df = np.zeros(buckets)
    for r in counted.filter("bucket is not null").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    sample = counted.filter("bucket is null").select("language", "at", "counts", "pick")
    fitted = sample.filter(F.col("pick") % CALIBRATION != 0).withColumn("shard", F.pmod(F.xxhash64("pick", F.lit(1)), F.lit(shards)))
    fitted = fitted.groupBy("shard").applyInArrow(_fit(languages, idf), "bucket int, rows long, w array<double>").collect()
    weights = np.zeros((buckets + 1, len(languages)))
    total = sum(r["rows"] for r in fitted if r["bucket"] == buckets) or 1
    for r in fitted:
        weights[r["bucket"]] += np.array(r["w"]) * r["rows"] / total
    rest = sample.filter(F.col("pick") % CALIBRATION == 0).select("language", "at", "counts")
    rest = rest.mapInArrow(_logits(languages, idf, weights), "label int, logits array<double>").collect()
    temperature = _temperature(np.array([r["logits"] for r in rest]), np.array([r["label"] for r in rest])) if rest else 1.0
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), temperature)


def predict(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """The likeliest language and its calibrated probability; ("und", 0.0) without letters."""
    found = grams(text, len(model.idf)) if text and model.languages else None
    if not found:
        return UNDETERMINED, 0.0
    at, counts = found
    p = _softmax((features(at, counts, model.idf) @ model.weights[at] + model.weights[-1]).astype(np.float64) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; repeated rows get equal answers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [predict(shared.value, text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def determined(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is determined with a probability of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:  # only texts go to Python and only flags come back
            yield pd.Series([name != UNDETERMINED and p >= least for name, p in (predict(shared.value, text) for text in some)], dtype=bool)

    return docs.filter(F.pandas_udf(known, "boolean")(F.col(text_col)))
