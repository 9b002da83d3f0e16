"""Toxicity by maximum-scoring segments of token log-odds.

Token log-odds between toxic and other labelled texts are shrunk by a Dirichlet prior whose shape is
the token distribution of the whole corpus. A linear scan finds every maximal scoring segment of a
text; how surprising a segment is follows from the extreme-value distribution of such scores, and a
logistic curve over that evidence gives the score between 0 and 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, hashed_words, keyed, text_slices

#: Bytes of text worked at once in a task: arrays of eight bytes and more are made for each of them.
SLICE_BYTES = 1 << 18
#: Labelled rows to learn from: at most about so many, taken by hash of the id where there are more.
LABELLED_ROWS = 100_000


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    weights: np.ndarray
    drift: float  # taken off every token, so that the expected score is negative
    rate: float  # lambda of the extreme-value distribution
    size: float  # its K
    curve: np.ndarray  # intercept and slopes of the logistic curve
    cut: float  # largest expected number of chance segments for a significant one


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one scan (Ruzzo and Tompa)."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # [start, end, left total, right total, index of the nearest earlier one with a smaller left total]
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new[0], new[2] = found[j][0], found[j][2]
            nearest = found[j][4]
            del found[j:]
            j = nearest
    return [(s, e, float(r - left)) for s, e, left, r, _ in found]


def _evidence(scores: np.ndarray, m: Model) -> tuple[float, float, float, list]:
    """Surprise of the best segment, summed surprise of the significant ones, share of words in them, and these segments."""
    n = len(scores)
    if n == 0:
        return 0.0, 0.0, 0.0, []
    base, bar = math.log(m.size * n), -math.log(m.cut)
    found = [(s, e, m.rate * x - base) for s, e, x in segments(scores)]
    kept = [x for x in found if x[2] >= bar]
    best = max((x[2] for x in found), default=-base)
    return best, sum(x[2] for x in kept), sum(e - s for s, e, _ in kept) / n, kept


def _features(best: float, total: float, share: float, n: int) -> list[float]:
    return [1.0, max(best, -20.0), math.log1p(max(total, 0.0)), share, math.log1p(n)]


def _token_scores(words: np.ndarray, m: Model) -> np.ndarray:
    at = np.minimum(np.searchsorted(m.tokens, words), max(len(m.tokens) - 1, 0))
    if not len(m.tokens):
        return np.full(len(words), -m.drift)
    return np.where(m.tokens[at] == words, m.weights[at], 0.0) - m.drift


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, n, n_toxic, n_other) of every token from (text, toxic); toxic is null for texts not learned from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
                words, first, _, _ = hashed_words(data, offsets)
                side = np.repeat(label[a:b], np.diff(first))
                h, inverse = np.unique(words, return_inverse=True)
                n = [np.bincount(inverse, side == x, len(h)).astype(np.int64) if len(h) else np.zeros(0, np.int64) for x in (1, 0)]
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": np.bincount(inverse, minlength=len(h)).astype(np.int64), "n_toxic": n[0], "n_other": n[1]})

    counted = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "h long, n long, n_toxic long, n_other long")
    return counted.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "n_toxic", "n_other")])


def _root_of_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * value)) = 1 for scores of negative mean."""
    lo, hi = 1e-6, 1e-3
    f = lambda r: float((shares * np.exp(np.minimum(r * values, 700))).sum()) - 1
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


_NUMBER = {"double": pa.float64(), "long": pa.int64()}
_PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))


def _per_text(texts: DataFrame, model: Model, columns: dict[str, str], row) -> DataFrame:
    """Apply row(scores, model) to the token scores of each text; other columns pass."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [c for c in texts.columns if c != "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in texts.dtypes if c != "text"] + [f"{k} {t}" for k, t in columns.items()])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text")), SLICE_BYTES):
                words, first, _, _ = hashed_words(data, offsets)
                s = _token_scores(words, m)
                out += [row(s[first[i] : first[i + 1]], m) for i in range(len(first) - 1)]
            made = {k: pa.array([r[k] for r in out], _NUMBER.get(t, _PASSAGES)) for k, t in columns.items()}
            yield pa.RecordBatch.from_pydict({**{c: batch.column(batch.schema.get_field_index(c)) for c in names}, **made})

    return texts.mapInArrow(score, schema)


def learn(documents: DataFrame, labels: DataFrame, prior: float = 2_000.0, flat: float = 0.5, least_z: float = 3.0, drift: float = 0.15, cut: float = 0.05, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, toxic 0/1) of ``documents`` (doc_id, text); the caller leaves held-out labels away.

    Of several labels of one id 1 wins; null labels and ids do not count. At most about ``labelled_rows``
    labels are used, chosen by hash. Token counts for the prior cover all documents. Without labels of
    both kinds every text scores the share of toxic labels (0 without labels).
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    share = labelled_rows / max(1, labels.count())
    if share < 1:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = documents.select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left")  # bounded by labelled_rows
    counts = token_counts(texts).persist()
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o"), F.count(F.lit(1)).alias("v")).first()
    n, n_t, n_o = (float(total[c] or 0) for c in ("n", "t", "o"))
    # The prior of a token: its share of the corpus, and a flat part that keeps tokens seen on one side only measurable.
    mass = prior + flat * float(total["v"])
    a = F.col("n") * F.lit(prior / max(n, 1.0)) + F.lit(flat)
    t, o = F.col("n_toxic") + a, F.col("n_other") + a
    odds = F.log(t / (F.lit(n_t + mass) - t)) - F.log(o / (F.lit(n_o + mass) - o))
    chosen = (
        counts.where("n_toxic + n_other > 0").select("h", "n_other", odds.alias("w"), (odds / F.sqrt(1 / t + 1 / o)).alias("z"))
        .where(F.abs("z") >= least_z).collect()  # tokens of the labelled rows only
        if n_t and n_o else []
    )
    counts.unpersist()
    h = np.array([r["h"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(h)
    w = np.array([r["w"] for r in chosen], np.float64)[order]
    seen = np.array([r["n_other"] for r in chosen], np.float64)[order]
    model = Model(h[order], w, drift, 1.0, 1.0, np.zeros(5), cut)
    if not len(w) or not (w > drift).any():
        rate = n_t / (n_t + n_o) if n_t + n_o else 0.0
        model.curve = np.array([math.log(max(rate, 1e-6) / max(1 - rate, 1e-6)), 0, 0, 0, 0])
        return model
    mass = seen / max(n_o, 1.0)
    if (mass * w).sum() >= drift * 0.5:  # keep the expected score of other texts clearly negative
        model.drift = drift = float(2 * (mass * w).sum())
    model.rate = _root_of_rate(np.concatenate([w - drift, [-drift]]), np.concatenate([mass, [max(0.0, 1 - mass.sum())]]))

    labelled = texts.where("toxic IS NOT NULL").select("doc_id", "toxic", "text")
    best = _per_text(labelled.where("toxic = 0"), model, {"s": "double", "n": "long"}, lambda s, m: {"s": max((x for _, _, x in segments(s)), default=0.0), "n": len(s)})
    fit = best.agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") * F.exp(-F.lit(model.rate) * F.col("s"))).alias("x")).first()
    model.size = max(1e-9, float(fit["c"]) / max(1e-9, float(fit["x"] or 0)))
    found = _per_text(labelled, model, {"best": "double", "total": "double", "share": "double", "n": "long"}, lambda s, m: dict(zip(("best", "total", "share", "n"), (*_evidence(s, m)[:3], len(s)), strict=True)))
    # One row of each id, however many rows share it, so that labelled_rows bounds what is collected.
    rows = found.groupBy("doc_id").agg(F.min(F.struct("toxic", "best", "total", "share", "n")).alias("x")).select("x.*").collect()
    x = np.array([_features(r["best"], r["total"], r["share"], r["n"]) for r in rows])
    model.curve = _logistic(x, np.array([r["toxic"] for r in rows], np.float64))
    return model


def score_documents(documents: DataFrame, model: Model, row_col: str | None = None) -> DataFrame:
    """(row_id, doc_id, score, passages) of every row; passages are (first word, end word, surprise) of each significant segment.

    Null and empty texts have no tokens and get the score of no evidence; repeated rows each get a row. ``row_col``
    names the column that tells rows apart, else one scan numbers them. Texts of any length are scored whole.
    """

    def row(s: np.ndarray, m: Model) -> dict:
        best, total, share, kept = _evidence(s, m)
        z = float(np.dot(m.curve, _features(best, total, share, len(s))))
        return {"score": 1 / (1 + math.exp(-min(max(z, -30.0), 30.0))), "passages": [{"first": a, "end": b, "surprise": c} for a, b, c in kept]}

    numbers = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = documents.select(numbers.alias("row_id"), "doc_id", "text")
    return _per_text(rows, model, {"score": "double", "passages": "array<struct<first:long,end:long,surprise:double>>"}, row)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id as text is not 1 modulo 3."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def reject(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, stored: bool = False) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with their columns as they are.

    For a ``stored`` table just as ``spark.read`` gives it rows are numbered by file and place, else in a written copy.
    Null and empty texts score as texts without evidence; an empty table gives an empty one.
    """
    row = free_name(documents, "__row")
    docs = keyed(documents, "toxicity-documents", row, stored)
    scored = score_documents(docs, learn(documents, training_labels(labels)), row)
    keep = scored.where(F.col("score") < threshold).select(F.col("row_id").alias(row))
    return docs.join(keep, row, "left_semi").drop(row)


def op6_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(documents, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score_documents(documents, model)
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
