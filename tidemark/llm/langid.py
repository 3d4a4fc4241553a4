"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then temperature calibration.

N-grams of one to three lower-cased characters (all that is no letter counts as a blank) are hashed to ``BUCKETS`` features.
Document frequencies are counted over all training documents. The regression is fitted on a bounded sample: about
``per_language`` labelled texts of each language, picked by a hash of the text, each text once however often it occurs under
whatever ids; a fifth of it sets the temperature. Weights of
a feature stay at nought until its gradients pass the L1 penalty, so the model is sparse. Every text is read whole, in blocks.

Null text and text without a letter is ``und``, with score 1; where nothing could be learned every text is ``und``, with score 0.
Rows are independent of each other, so ties and repeated rows need no rule. Other columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold_column, materialize, own_job, table

BITS = 15
BUCKETS = 1 << BITS
BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: Languages that can be learned; more are an error, since the sample and the weights grow with their number.
MAX_LANGS = 1000
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_ODD = np.uint32(2654435761)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), BLOCK):
        block = codes[start : start + BLOCK + 2]
        own = min(BLOCK, len(codes) - start)
        block = np.where(block < 128, _PLAIN[np.minimum(block, 127)], block)
        with np.errstate(over="ignore"):
            u = block * _ODD
            h = u[:own]
            for n in range(3):
                if n:
                    m = min(own, len(u) - n)
                    h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(31 + 2 * n) + u[n : n + m]
                counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return counts


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the unit-length TF-IDF vector."""
    at = np.flatnonzero(counts)
    x = np.sqrt(counts[at]) * idf[at]
    return at, (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)


@dataclass
class LangModel:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, languages) float32
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text):
            return "und", 1.0
        if not self.langs:
            return "und", 0.0
        at, x = features(gram_counts(text), self.idf)
        logits = x @ self.weights[at] / self.temperature
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader (proximal form) on the softmax loss; weights (BUCKETS, classes)."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def leader(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            zz, nn = z[at], n[at]
            w = leader(zz, nn)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = nn + g * g
            z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / alpha * w
            n[at] = more
    return leader(z, n).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden sections over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    low, high, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, training: Column, per_language: int = 400) -> LangModel:
    """docs: doc_id, text, lang. training: which rows may be learned from; null languages never are."""
    spark = docs.sparkSession
    learn = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += gram_counts(text) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(BUCKETS + 1), pa.int64()), "n": pa.array(np.r_[total, n], pa.int64())})

    with own_job(spark):
        found = learn.select("text").mapInArrow(df, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS + 1)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1

    per = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = materialize(per.select("lang", (F.lit(float(per_language) * (1 << 20)) / F.col("n")).alias("share")), "lang-shares")
    if share.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    picked = learn.join(F.broadcast(share), "lang").withColumn("key", F.xxhash64("text")).where(F.pmod("key", F.lit(1 << 20)) < F.col("share"))
    picked = picked.select("lang", "key", "text").dropDuplicates(["lang", "key"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(gram_counts(t), idf) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array([a.astype(np.uint16 if BITS <= 16 else np.uint32).tobytes() for a, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], ["key", "lang", "at", "x"])

    with own_job(spark):
        got = sorted(picked.mapInArrow(sample, "key long, lang string, at binary, x binary").collect(), key=lambda r: (r.key, r.lang))
    discard(share)
    langs = sorted({r.lang for r in got})
    rows = [(np.frombuffer(r.at, np.uint16 if BITS <= 16 else np.uint32).astype(np.int64), np.frombuffer(r.x, np.float32), langs.index(r.lang)) for r in got]
    fit, rest = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    weights = ftrl(fit, len(langs)) if langs else np.zeros((BUCKETS, 0), np.float32)
    logits = np.array([x @ weights[at] for at, x, _ in rest]).reshape(len(rest), len(langs))
    return LangModel(langs, weights, idf, temperature(logits, np.array([y for *_, y in rest], int)) if langs else 1.0)


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """docs with the columns lang_pred and score; columns of these names are replaced."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], [*own, "lang_pred", "score"])

    return docs.select(*own).mapInArrow(run, docs.select(*own).schema.add("lang_pred", "string").add("score", "double"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, fold_column(F.col("doc_id")) != 0)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_column(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
