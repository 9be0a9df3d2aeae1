"""Quality classifier by positive-unlabelled learning.

A linear model over word-shape features minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with logistic loss, full-batch gradient steps, and, where the bracket is negative, a step back along it.
Trusted positives are labelled good rows; unlabelled ones are rows whose labels are not looked at, and rows labelled
bad are not used at all.  The class prior is estimated from these two alone: of the sets of rows above a score,
none holds a smaller share of unlabelled rows than the prior times its share of positives, so that the least ratio of
the two bounds the prior, and meets it where negatives are few; scores come from the other half of the samples.
After the fit the constant is moved, so that ``THRESHOLD`` lies where the prior's share of unlabelled rows
passes, or where all but ``LEAST`` of the trusted positives do, if that is lower.

Both are drawn, by a hash of id and text, from all rows: at most ``SAMPLE`` each (a documented bound, as only
the fit uses them).  Every row is scored.  Features: shares of word shapes (letters folded to a, A, é;
digits to 0; runs collapsed) hashed to ``SHAPES`` cells, and a few statistics of repetition, length and
case; each as a share and, where it matters if it occurs at all, as log(1 + count).

Null or empty text: all features 0 but the constant and the mark of emptiness.  Without labelled rows the
score is 0.5 everywhere.  Repeated rows are scored each, rows with a null id too.  Very long texts are read
whole, one in a slice.  An empty table gives an empty result.  Columns beside id and text are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import crc_mod, cut, free_name, slices, split_words
from emulsa.llm.common import distinct as distinct_of

SAMPLE, SHAPES, THRESHOLD = 8_000, 192, 0.3
STEPS, RATE, DECAY, LEAST = 300, 0.05, 1e-4, 0.002
EXTRA = 12
WIDTH = 2 * SHAPES + EXTRA


def shapes(words: pa.Array) -> np.ndarray:
    """The hashed shape of each word."""
    s = pc.replace_substring_regex(words, r"[a-z]+", "a")
    s = pc.replace_substring_regex(s, r"[A-Z]+", "A")
    s = pc.replace_substring_regex(s, r"\p{Lu}+", "Á")
    s = pc.replace_substring_regex(s, r"[0-9]+", "0")
    s = pc.replace_substring_regex(s, r"[\p{Ll}á]+", "a")
    s = pc.replace_substring_regex(s, r"[AÁ]{2,}", "AA")
    d = s.dictionary_encode()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) % SHAPES for w in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
    return h[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.empty(0, np.int64)


def features(col: pa.Array) -> np.ndarray:
    codes, offsets, words = split_words(col)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), WIDTH), np.float32)
    per = np.maximum(n, 1)
    counts = np.bincount(doc * SHAPES + shapes(words)[codes], minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
    out[:, :SHAPES] = counts / per[:, None]
    out[:, SHAPES : 2 * SHAPES] = np.log1p(counts) / 4
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(float)
    same = np.zeros(len(codes), bool)
    if len(codes):
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc, weights=same, minlength=len(n))
    distinct = np.bincount(distinct_of(doc * (len(words) + 1) + codes) // (len(words) + 1), minlength=len(n)) if len(codes) else np.zeros(len(n))
    lines = pc.count_substring(pc.fill_null(col.cast(pa.string()), ""), "\n").to_numpy(zero_copy_only=False) + 1
    length = np.bincount(doc, weights=size[codes], minlength=len(n)) / per
    cols = [np.ones(len(n)), n == 0, again / per, np.log1p(again) / 4, distinct / per, np.log1p(n) / 8, length / 10, np.abs(length - 5) / 10, lines / per, np.log1p(lines) / 4, n < 20, distinct / per * np.log1p(n) / 8]
    out[:, 2 * SHAPES :] = np.stack(cols, 1)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def separate(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Weights that tell positives from unlabelled rows, by logistic loss."""
    x = np.concatenate([positive, unlabelled])
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))].astype(np.float32)
    each = np.where(y > 0, 0.5 / len(positive), 0.5 / len(unlabelled)).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, STEPS + 1):
        g = x.T @ ((sigmoid(x @ w) - y) * each) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The ratio of unlabelled to positive rows above a score, where it and its uncertainty are least."""
    cuts = np.unique(positive)
    share = lambda x: (len(x) - np.searchsorted(np.sort(x), cuts)) / len(x)
    p, u = share(positive), share(unlabelled)
    slack = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (positive, unlabelled))
    k = int(np.argmin((u + 1.01 * slack) / p))
    return float(u[k] / p[k])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior of the unlabelled rows, from them and positives; each half is judged by the weights of the other."""
    scale = np.maximum(np.abs(np.concatenate([positive, unlabelled])).max(0), 1e-6)
    p, u = (positive / scale).astype(np.float32), (unlabelled / scale).astype(np.float32)
    if min(len(p), len(u)) < 2:
        return 0.5
    found = []
    for k in (0, 1):
        w = separate(p[k::2], u[k::2])
        found.append(least_ratio(p[1 - k :: 2] @ w, u[1 - k :: 2] @ w))
    return float(np.clip(np.mean(found), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, scale of the features) of least non-negative risk, by Adam."""
    scale = np.maximum(np.abs(np.concatenate([positive, unlabelled])).max(0), 1e-6)
    p, u = (positive / scale).astype(np.float32), (unlabelled / scale).astype(np.float32)
    w = np.zeros(p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        zp, zu = sigmoid(p @ w), sigmoid(u @ w)
        risk_u, risk_p = -np.log(1 - zu + 1e-12).mean(), -np.log(1 - zp + 1e-12).mean()
        minus = u.T @ zu / len(u) - prior * (p.T @ zp) / len(p)  # gradient of R_u(-) - prior R_p(-)
        plus = prior * (p.T @ (zp - 1)) / len(p)
        g = plus + minus if risk_u - prior * risk_p >= 0 else -minus
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    # the constant is set so that THRESHOLD lies where the prior's share of unlabelled rows passes, or lower,
    # where all but LEAST of the trusted positives do
    cut = min(np.quantile(u @ w, 1 - prior), np.quantile(p @ w, LEAST))
    w[2 * SHAPES] += (np.log(THRESHOLD / (1 - THRESHOLD)) - cut) * scale[2 * SHAPES]
    return w, scale


def sampled(docs: DataFrame, size: int, ids: DataFrame | None = None) -> np.ndarray:
    """Features of at most ``size`` rows, the first by a hash of id and text, of those with one of the ids if given.

    Only ids and hashes are joined and sorted; texts stay where they are read and meet the chosen hashes, ``size`` at most, there.
    """
    hashed = docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h"))
    hashed = hashed.join(ids, "doc_id", "left_semi") if ids is not None else hashed
    chosen = cut(hashed.select("h").orderBy("h").limit(size).distinct())
    rows = docs.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "text")).join(F.broadcast(chosen), "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in features(batch.column(0))], pa.binary())], names=["f"])

    rows = rows.select("text").mapInArrow(run, "f binary").limit(size).collect()  # the limit bounds rows that share a hash
    return np.stack([np.frombuffer(bytes(r.f), np.float32) for r in rows]) if rows else np.empty((0, WIDTH), np.float32)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(crc_mod(F.col("doc_id"), 5) != 0)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("quality").isNotNull())
    good = labels.where("quality = 1").select("doc_id")
    if good.isEmpty():
        return None
    positive = sampled(docs, sample, good)
    unlabelled = sampled(docs, sample)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def scorer(model):
    """A column function: the score of each text under the broadcast model."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            out = [np.empty(0)]
            for batch in slices(iter([pa.RecordBatch.from_arrays([col], names=["text"])])):
                if model.value is None:
                    out.append(np.full(batch.num_rows, 0.5))
                else:
                    w, scale = model.value
                    out.append(sigmoid((features(batch.column(0)) / scale) @ w).astype(np.float64))
            yield pa.array(np.concatenate(out))

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int, out: str = "score") -> DataFrame:
    """docs with the score; only texts go to Python, and one number a row comes back."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))  # two vectors of WIDTH numbers
    return docs.withColumn(out, scorer(model)(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, sample)
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    out = free_name(docs, "__score")
    return scored(docs, labels, sample, out).where(F.col(out) >= THRESHOLD).drop(out)
