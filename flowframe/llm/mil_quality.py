"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from its bytes alone (frequencies
of hashed byte pairs and of byte classes, and how often words repeat), a hidden layer embeds it, gated attention
weighs it within its document, and a logistic layer scores the weighted sum. Only document labels are needed to
learn which passages matter.

Rows: empty and null texts are a bag of one empty passage; a text of any length is scored whole, a block of passages
at a time, of which a few numbers a passage are kept; repeated rows have equal scores; ids of another type than an
integer are refused where labels are joined; labels repeated for a document count by their mean; null labels are left
out; of rows that repeat a labelled ``doc_id`` the least text is learnt from. Without usable labels every score is 1
(nothing speaks against a document). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe import runtime
from flowframe.llm.common import frugal, require_integer, texts_of, with_row

PASSAGE = 600
PAIRS = 192
#: The bytes of each class after the hashed pairs: capitals, small letters, digits, spaces, line
#: ends, full stops and commas, other ASCII marks, bytes of other characters, and the symbols of junk and tables.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" \t",
    b"\n\r",
    b".,",
    b"!?",
    b"|",
    b"#*$%&<>",
    bytes(range(128, 256)),
)
FEATURES = PAIRS + len(CLASSES) + 3
#: Most labelled documents that the model is fitted on; the least by hash of their doc_id are taken.
FIT_DOCS = 3000
#: Most passages of a document that the model is fitted on, evenly spaced; scores are of all passages.
FIT_PASSAGES = 32
#: Passages whose features are computed at once.
BLOCK = 4096
THRESHOLD = 0.7
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 150, 0.02, 1e-4, 7

_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(PAIRS)
_PAIR = _PAIR.astype(np.uint8)
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _k


def passage_features(text: str | None) -> Iterator[np.ndarray]:
    """Rows of ``FEATURES`` numbers, one for each passage of a whole text, at least one, in blocks."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        yield np.zeros((1, FEATURES), np.float32)
    for begin in range(0, len(raw), BLOCK * PASSAGE):
        # a pair of bytes counts where it begins, so the next block's first byte is looked at too
        data = np.frombuffer(raw, np.uint8)[begin : begin + BLOCK * PASSAGE + 1]
        size = min(len(raw) - begin, BLOCK * PASSAGE)
        n = -(-size // PASSAGE)
        out = np.zeros((n, FEATURES), np.float32)
        of = np.arange(size) // PASSAGE
        sizes = np.bincount(of, minlength=n).astype(np.float32)[:, None]
        pairs = _PAIR[data[:-1].astype(np.uint16) * 256 + data[1:]].astype(np.int64)
        counts = np.bincount(of[: len(pairs)] * PAIRS + pairs, minlength=n * PAIRS).reshape(n, PAIRS)
        out[:, :PAIRS] = np.sqrt(counts / sizes)
        k = len(CLASSES)
        counts = np.bincount(of * (k + 1) + _CLASS[data[:size]], minlength=n * (k + 1)).reshape(n, k + 1)
        out[:, PAIRS : PAIRS + k] = np.sqrt(counts[:, :k] / sizes)
        out[:, PAIRS + k] = (out[:, :PAIRS] ** 4).sum(1) * 4
        for p in range(n):
            words = raw[begin + p * PASSAGE : begin + (p + 1) * PASSAGE].split()
            out[p, PAIRS + k + 1] = 1 - len(set(words)) / len(words) if words else 0
        out[:, PAIRS + k + 2] = np.log1p(len(raw)) / 10
        yield out


class GatedAttention:
    """The model: embedding, gated attention over a bag's passages, logistic score."""

    def __init__(self, weights: dict[str, np.ndarray] | None, prior: float = 1.0) -> None:
        self.w, self.prior = weights, prior

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts."""
        if self.w is None:
            return np.full(len(texts), self.prior)
        embedded, bag, held = [], [], []

        def flush() -> None:
            if held:
                h, *_, logit = self._embed((np.concatenate(held) - self.w["mean"]) / self.w["scale"])
                embedded.append((h, logit))
                held.clear()

        for k, text in enumerate(texts):
            for block in passage_features(text):
                if sum(map(len, held)) + len(block) > BLOCK:
                    flush()
                held.append(block)
                bag.append(np.full(len(block), k))
        flush()
        if not bag:
            return np.empty(0)
        h, logit = (np.concatenate(x) for x in zip(*embedded))
        return self._pool(h, logit, np.concatenate(bag))[-1]

    def _embed(self, scaled):
        """Of each scaled passage: its embedding, the two gates, and the logit of its weight."""
        w = self.w
        h = np.tanh(scaled @ w["E"] + w["e"])
        t = np.tanh(h @ w["V"])
        s = 1 / (1 + np.exp(-np.clip(h @ w["U"], -40, 40)))
        return h, t, s, (t * s) @ w["q"]

    def _pool(self, h, logit, bag):
        """Weights of passages, weighted sums and scores of bags; ``bag`` numbers each passage's bag, ascending."""
        begin = np.flatnonzero(np.diff(bag, prepend=-1))
        a = np.exp(logit - np.maximum.reduceat(logit, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        return a, z, 1 / (1 + np.exp(-np.clip(z @ self.w["o"] + self.w["b"], -40, 40)))

    def gradients(self, scaled: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the bags' mean logistic loss, by each weight that is learnt."""
        w, begin = self.w, np.flatnonzero(np.diff(bag, prepend=-1))
        h, t, s, logit = self._embed(scaled)
        a, z, y = self._pool(h, logit, bag)
        dy = (y - labels) / len(labels)
        dz = dy[:, None] * w["o"]
        da = (dz[bag] * h).sum(1)
        da = a * (da - np.add.reduceat(a * da, begin)[bag])
        dt, ds = da[:, None] * w["q"] * s * (1 - t * t), da[:, None] * w["q"] * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        return {"E": scaled.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "q": (t * s).T @ da, "o": z.T @ dy, "b": dy.sum(keepdims=True)}

    @classmethod
    def fit(cls, x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> GatedAttention:
        """Full-batch Adam on the mean logistic loss of the bags, with weight decay; the same for the same input."""
        bags = len(labels)
        if not bags:
            return cls(None, 1.0)
        if labels.min() == labels.max():
            return cls(None, float((labels.sum() + 1) / (bags + 1)))
        rng, x = np.random.default_rng(SEED), x.astype(np.float64)
        d = x.shape[1]
        w = {
            "mean": x.mean(0),
            "scale": x.std(0) + 0.02,
            "E": rng.normal(0, d**-0.5, (d, HIDDEN)),
            "e": np.zeros(HIDDEN),
            "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)),
            "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)),
            "q": rng.normal(0, HIDDEN**-0.5, HIDDEN),
            "o": rng.normal(0, HIDDEN**-0.5, HIDDEN),
            "b": np.zeros(1),
        }
        model = cls(w)
        learnt = [k for k in w if k not in ("mean", "scale")]
        moments = {k: (np.zeros_like(w[k]), np.zeros_like(w[k])) for k in learnt}
        scaled = (x - w["mean"]) / w["scale"]
        for epoch in range(1, EPOCHS + 1):
            grads = model.gradients(scaled, bag, labels)
            for k in learnt:
                g = grads[k] + (DECAY * w[k] if w[k].ndim == 2 else 0)
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        return model


@frugal
def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (key, label, text): the features of the passages to learn from, as bytes."""
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            n = max(1, -(-len((text or "").encode("utf-8", "surrogatepass")) // PASSAGE))
            chosen = np.unique(np.linspace(0, n - 1, min(n, FIT_PASSAGES)).round().astype(np.int64))
            parts = [x[chosen[(chosen >= k * BLOCK) & (chosen < k * BLOCK + len(x))] - k * BLOCK] for k, x in enumerate(passage_features(text))]
            found.append(np.concatenate(parts).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(found, pa.binary())], names=["key", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> GatedAttention:
    """Fit on at most ``most`` of the labelled documents: ``labels`` (doc_id, label 0 or 1), ``docs`` (doc_id, text).

    The features are computed on the executors; the driver gets ``most`` bags of ``FIT_PASSAGES`` passages at most.
    """
    require_integer(docs)
    runtime.ship(docs.sparkSession)
    runtime.small_arrow_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("key"), "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # `most` rows of two numbers: a bounded table
    picked = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["key"]).groupBy("key", "label").agg(F.min("text").alias("text"))
    found = picked.mapInArrow(feature_rows, "key long, label int, features binary").collect()
    found.sort(key=lambda r: (r["key"], bytes(r["features"])))
    bags = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in found]
    x = np.concatenate([*bags, np.empty((0, FEATURES), np.float32)])
    return GatedAttention.fit(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([r["label"] for r in found], np.float64))


def score_rows(model):
    """For ``mapInArrow`` over (row, text): each row with its score; ``model`` is a broadcast."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(texts_of(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], names=["row", "score"])

    return run


def score(docs: DataFrame, model: GatedAttention, text_back: bool = False) -> DataFrame:
    """(row, score) of ``docs``: the columns as they came in ``row``, the text only if it is wanted back. Nothing but
    the text goes into a score."""
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_arrow_batches(spark)
    rows = with_row(docs, text_back)
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score_rows(spark.sparkContext.broadcast(model)), schema)


def held_out(doc_id):
    """Documents never learnt from: those whose CRC-32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> GatedAttention:
    """The model of ``labels.quality``, from the documents of ``sf_dir`` that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))


def drop_low_quality(docs: DataFrame, model: GatedAttention, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with their columns."""
    return score(docs, model, text_back=True).where(F.col("score") >= threshold).select("row.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, fitted(spark, sf_dir))
    doc_id = F.col("row.doc_id")
    return found.select(doc_id, F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
