"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams.  The weights are learnt with
follow-the-regularised-leader (proximal, per-coordinate rates) under an elastic-net
penalty, on a sample of labelled rows whose bound is a parameter; IDF is a statistic of
the corpus and counted over every row that may be learnt from.  A part of the sample that
takes no part in learning sets the temperature of the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_value

by_value(__name__)

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Labelled rows learnt from, per label (expected; the draw is by hash of the id).
ROWS_PER_LABEL = 1200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 2e-3, 1e-4
#: One in so many sampled rows sets the temperature instead of the weights.
CALIBRATE = 5

_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text and how often each occurs; None without a letter."""
    spaced = " " + _OTHER.sub(" ", (text or "").lower()) + " "
    if not any(map(str.isalpha, spaced)):
        return None
    codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for at in range(0, len(codes), _CHUNK):
        for order in ORDERS:
            part = codes[at : at + _CHUNK + order - 1]
            n = len(part) - order + 1
            if n <= 0:
                continue
            mixed = np.full(n, order, np.uint64)
            for i in range(order):
                mixed = (mixed ^ part[i : i + n]) * _MIX
                mixed ^= mixed >> np.uint64(29)
            total += np.bincount((mixed * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
    found = np.nonzero(total)[0]
    return found, total[found]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [bucket, label]
    temperature: float

    def vector(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        values = (1 + np.log(n)) * self.idf[found]
        return values / np.sqrt((values * values).sum())

    def logits(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(found, n) @ self.weights[found]

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = counts(text)
        if grams is None or not self.labels:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*grams) / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def learn(rows: list[tuple[str, np.ndarray, np.ndarray]], seen: np.ndarray, n_docs: int) -> Model:
    """Fit on ``(label, n-grams, counts)`` rows in a fixed order.

    ``seen`` is the number of documents that hold each n-gram, of ``n_docs`` in all.
    """
    labels = sorted({r[0] for r in rows})
    idf = np.log((1 + n_docs) / (1 + seen)) + 1
    if not labels:
        return Model([], idf, np.zeros((len(idf), 0), np.float32), 1.0)
    model = Model(labels, idf, np.zeros((len(idf), len(labels))), 1.0)
    place = {label: i for i, label in enumerate(labels)}
    examples = [(place[label], found, model.vector(found, n)) for label, found, n in rows]
    held = [x for i, x in enumerate(examples) if i % CALIBRATE == CALIBRATE - 1]
    fit = [x for i, x in enumerate(examples) if i % CALIBRATE != CALIBRATE - 1] or examples
    z, squares, w = np.zeros_like(model.weights), np.zeros_like(model.weights), model.weights
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(fit)):
            label, found, x = fit[i]
            rate = (BETA + np.sqrt(squares[found])) / ALPHA
            leader = z[found]
            own = -(leader - np.sign(leader) * L1) / (rate + L2)
            own[np.abs(leader) <= L1] = 0.0
            p = _softmax(x @ own)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(squares[found] + g * g) - np.sqrt(squares[found])) / ALPHA
            z[found] += g - sigma * own
            squares[found] += g * g
    rate = (BETA + np.sqrt(squares)) / ALPHA
    w[:] = -(z - np.sign(z) * L1) / (rate + L2)
    w[np.abs(z) <= L1] = 0.0
    if held:
        model.temperature = _temperature([(label, x @ w[found]) for label, found, x in held])
    model.weights = w.astype(np.float32)
    return model


def _temperature(held: list[tuple[int, np.ndarray]]) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    label = np.array([x[0] for x in held])
    z = np.stack([x[1] for x in held])

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(s)), label]).mean())

    low, high, golden = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str) -> Column:
    """Rows that take no part in learning: CRC-32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all texts hold each n-gram, and how many have a letter at all.

    Each task adds its texts up before anything is shuffled; the driver gets one row per
    bucket, ``2**BUCKET_BITS + 1`` at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BUCKET_BITS) + 1, np.int64)  # the last is of texts
        for batch in batches:
            for text in batch.column(0):
                grams = counts(text.as_py())
                if grams is not None:
                    seen[grams[0]] += 1
                    seen[-1] += 1
        found = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], names=["bucket", "n"])

    seen = np.zeros((1 << BUCKET_BITS) + 1, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        seen[r["bucket"]] = r["n"]
    return seen[:-1], int(seen[-1])


def fit(docs: DataFrame, learnable: Column, id_col: str, text_col: str, label_col: str, rows_per_label: int = ROWS_PER_LABEL) -> Model:
    """A model of the rows that are ``learnable``, have a label and an id.

    IDF is counted over all of them.  About ``rows_per_label`` rows of each label are drawn
    by a hash of the id for fitting the weights; their n-gram counts come to the driver, where the model is fitted: at most
    ``rows_per_label`` x labels x 2**16 entries, expected.
    """
    usable = docs.filter(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")
    )
    n = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}  # one row per label
    if not n:
        return learn([], np.zeros(1 << BUCKET_BITS, np.int64), 0)
    draw = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) / 1_000_000.0
    shares = F.create_map(*[F.lit(x) for label, k in n.items() for x in (label, min(1.0, rows_per_label / k))])
    drawn = usable.filter(draw < shares[F.col("label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, label in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                grams = counts(text)
                if grams is not None:
                    out.append((str(key), label, grams[0].astype("<u2").tobytes(), np.minimum(grams[1], 2**31 - 1).astype("<i4").tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "label", "grams", "n"])

    rows = drawn.mapInArrow(run, "id string, label string, grams binary, n binary").collect()
    rows.sort(key=lambda r: (r["id"], r["label"], bytes(r["grams"])))
    sample = [(r["label"], np.frombuffer(r["grams"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<i4")) for r in rows]
    return learn(sample, *document_counts(usable.select("text")))


def predict(docs: DataFrame, model: Model, text_col: str, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``lang_pred, score``; the model has a fixed size."""
    chosen = docs.select(F.col(text_col).alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in batch.column(0).to_pylist()]
            labels, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], labels, scores], names=[*keep, "lang_pred", "score"])

    return chosen.mapInArrow(run, chosen.drop("_text").schema.add("lang_pred", "string").add("score", "double"))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from rows that are not held out and have a label; predicts every row from its
    text alone.  Null texts and texts without a letter, and every text where no row has a
    label, are ``und`` with score 0.  Rows without an id are predicted, not learnt from.
    Repeated rows get equal predictions.  Empty tables give an empty result.
    """
    model = fit(docs, ~held_out(id_col), id_col, text_col, label_col)
    kept = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(kept, model, "text", "doc_id", "held_out")


def identified(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents, with all columns, whose language is known with at least the score ``least``."""
    model = fit(docs, ~held_out(id_col), id_col, text_col, label_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    judged = predict(whole, model, "text", "row")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
