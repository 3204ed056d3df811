"""Language identification by sparse multinomial logistic regression.

Character 1- to 3-grams are hashed into 2^14 features and weighted by TF-IDF,
with document frequencies over all training rows.  The weights are learned by
follow-the-regularised-leader with elastic-net penalties (McMahan et al.,
2013) on a bounded sample of the labelled rows, which the hash of the id
picks, and a temperature is fitted on a fifth of the sample that the weights
have not seen.  Prediction reads every whole text.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import text_batches
from .words import strings

BITS = 14
FEATURES = 1 << BITS
#: The bound of the training sample: rows of each language.
TRAIN_ROWS = 1500
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 1e-4, 1e-4, 3
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 + log count) of a text; none if it has no letter.

    Letters are lower-cased, everything else counts as one blank.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0)
    code = np.where(letter, code, np.uint32(32))
    blank = code == 32
    blank[1:] &= blank[:-1].copy()
    code = code[~blank]
    one = (code + np.uint32(1)) * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    total = np.zeros(FEATURES, dtype=np.int64)
    for salt, g in enumerate((one, two, three)):
        g = (g ^ (g >> np.uint32(16))) * np.uint32(0x7FEB352D + 2 * salt)
        total += np.bincount(g >> np.uint32(32 - BITS), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, 1.0 + np.log(total[at])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x languages
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        at, tf = grams(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        z = weigh(at, tf, self.idf) @ self.weights[at] / self.temperature
        p = softmax(z)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def weigh(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int) -> np.ndarray:
    """FTRL-proximal over (features, values, language) in the given order."""
    z, n = np.zeros((FEATURES, n_langs)), np.zeros((FEATURES, n_langs))

    def leader(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, lang in rows:
            za, na = z[at], n[at]
            w = leader(za, na)
            p = softmax(x @ w)
            p[lang] -= 1.0
            g = x[:, None] * p
            grown = na + g * g
            z[at] = za + g - (np.sqrt(grown) - np.sqrt(na)) / ALPHA * w
            n[at] = grown
    return leader(z, n)


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by a golden-section search."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth]
        return -float(np.log(np.maximum(p, 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in strings(batch.column("text")):
            at, _ = grams(text.as_py())
            held[at] += 1
            rows += 1
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], rows))], names=["feature", "n"])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(t.as_py()) for t in strings(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("key"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([t.astype(np.float32) for _, t in found], pa.list_(pa.float32()))],
            names=["lang", "key", "at", "tf"],
        )


def _train(idf: np.ndarray, limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["at"].map(len) > 0].sort_values(["key", "lang"], kind="stable")
        pdf = pdf[pdf.groupby("lang").cumcount() < limit]
        langs = sorted(pdf["lang"].unique())
        code = {x: i for i, x in enumerate(langs)}
        rows = [(np.asarray(a), weigh(np.asarray(a), np.asarray(t, dtype=float), idf), code[x]) for a, t, x in zip(pdf["at"], pdf["tf"], pdf["lang"])]
        seen, unseen = [r for i, r in enumerate(rows) if i % 5], rows[::5]
        if not langs:
            return pd.DataFrame({"langs": [[]], "weights": [b""], "temperature": [1.0]})
        weights = fit(seen or rows, len(langs))
        logits = np.array([x @ weights[at] for at, x, _ in unseen]).reshape(-1, len(langs))
        t = calibrate(logits, np.array([y for _, _, y in unseen], dtype=np.int64))
        return pd.DataFrame({"langs": [langs], "weights": [weights.astype(np.float32).tobytes()], "temperature": [t]})

    return run


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of (key, text, lang) rows; rows without key, text or lang are left out.

    Document frequencies cover all rows.  The weights see at most `train_rows`
    rows of each language, those of the least hashes of `key`, in one task.
    """
    labelled = labelled.where("key is not null and text is not null and lang is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), 1.0)
    held = labelled.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES)
    features = held[held["feature"] >= 0]
    df[features["feature"].to_numpy()] = features["n"].to_numpy()
    rows = int(held.loc[held["feature"] < 0, "n"].sum())
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1e-3
    # some 1.5 times the bound by hash, then the bound itself (tasks cut to it before they shuffle)
    rate = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(1.5 * train_rows / n)) for x, n in counts.items()))
    lot = F.xxhash64(F.lit("language sample"), "key")
    chosen = labelled.where(F.pmod(lot, F.lit(1 << 52)) < rate[F.col("lang")] * float(1 << 52)).select("lang", lot.alias("key"), "text")
    chosen = chosen.mapInArrow(_samples, "lang string, key long, at array<int>, tf array<float>")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = chosen.where("size(at) > 0").withColumn("place", place).where(F.col("place") <= train_rows).drop("place")
    found = chosen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_train(idf, train_rows), "langs array<string>, weights binary, temperature double").first()
    if found is None or not found["langs"]:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)
    langs = list(found["langs"])
    weights = np.frombuffer(bytes(found["weights"]), dtype=np.float32).reshape(FEATURES, len(langs))
    return Model(langs, idf, weights, found["temperature"])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.value.predict(t.as_py()) for t in strings(batch.column("lang_text"))]
            kept = [c for n, c in zip(batch.schema.names, batch.columns) if n != "lang_text"]
            names = [n for n in batch.schema.names if n != "lang_text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*names, "lang_pred", "lang_score"]
            )

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with lang_pred and lang_score (0 to 1).

    A null text, or one without a letter, is `und` with score 0, and so is
    everything if the model has learned no language.  The model (2^14 weights
    for each language) is broadcast.  Columns of those names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, lang_score double"
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("lang_text", F.col(text_col)).mapInArrow(_predict(held), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4 (null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every row of `docs` with held_out, lang_pred and lang_score.

    Learns from the rows that are not held out and have an id, a text and a
    language; id and language are not inputs of the prediction.  Repeated rows
    are predicted as often as they come.  A null id is not held out and not
    learned from.  A text of any length is read whole.  An empty table gives an
    empty result, one without labels `und` for every row.  Columns of `docs`
    with the names of results are replaced.
    """
    text_batches(docs.sparkSession)
    labelled = docs.where(~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(labelled, train_rows)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, text_col)
