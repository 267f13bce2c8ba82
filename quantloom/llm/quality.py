"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.arrays import SLICE_BYTES, mix64, slices, words

log = logging.getLogger(__name__)
#: Labelled documents that the field is trained on: those of the smallest hashed ids, of so many lines at most, which bounds what the
#: driver gathers.
TRAIN_DOCS, TRAIN_DOC_LINES = 3000, 512
#: Lines (and fillings) that chains take side by side.
CELLS = 400_000
#: Lines of one training chain; longer documents are cut into several.
TRAIN_LINES = 48
STEPS = 120
THRESHOLD = 0.3
FOLDS = 5

_SYMBOLS = b"#$%&*@^~<>{}[]\\_=+/"
_CLASSES = np.zeros((7, 256), np.uint8)
_CLASSES[0, 0x41:0x5B] = 1
_CLASSES[1, 0x30:0x3A] = 1
_CLASSES[2, list(_SYMBOLS)] = 1
_CLASSES[3, list(b"!?")] = 1
_CLASSES[4, list(b".,;:'\"()-")] = 1
_CLASSES[5, [0x20, 0x09, 0x0D]] = 1
_CLASSES[6, list(b"|")] = 1
OWN = len(_CLASSES) + 6
#: Where a line's own features have the logarithm of its size.
SIZE_AT = len(_CLASSES) + 1
#: Of a line: its own features, those of the line before and after, and a constant.
WIDTH = 3 * OWN + 1


def line_features(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines of all texts: features (lines x WIDTH), the text's index and the line's weight (bytes + 1)."""
    whole = b"\n".join(texts)
    a = np.frombuffer(whole, np.uint8)
    stop = np.append(np.flatnonzero(a == 0x0A), len(a))
    start = np.concatenate([[0], stop[:-1] + 1])
    n = len(start)
    size = stop - start
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(at, start, "right") - 1
    share = 1.0 / np.maximum(size, 1)
    x = np.zeros((n, OWN), np.float32)
    for k, of in enumerate(_CLASSES):
        total = np.zeros(len(a) + 1, np.int32 if len(a) < 1 << 31 else np.int64)
        np.cumsum(of[a], out=total[1:])
        x[:, k] = np.sqrt((total[stop] - total[start]) * share)
    _, h, ws, we = words(list(texts))
    line = np.searchsorted(start, ws, "right") - 1
    count = np.bincount(line, minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    k = len(_CLASSES)
    x[:, k] = np.bincount(line, again, n) / np.maximum(count, 1)
    x[:, k + 1] = np.log1p(size) / 8
    x[:, k + 2] = np.log1p(np.bincount(line, we - ws, n) / np.maximum(count, 1))
    x[:, k + 3] = count == 0
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    x[:, k + 4] = 1 - np.bincount(line[order], new, n) / np.maximum(count, 1)
    # the line before says the same words
    body = np.zeros(n, np.uint64)
    np.add.at(body, line, mix64(h + (np.arange(len(h)) - (np.cumsum(count) - count)[line]).astype(np.uint64)))
    x[1:, k + 5] = (body[1:] == body[:-1]) & (count[1:] > 0) & (doc[1:] == doc[:-1])
    joined = np.zeros((n, WIDTH), np.float32)
    joined[:, :OWN] = x
    same = doc[1:] == doc[:-1]
    joined[1:, OWN : 2 * OWN] = x[:-1] * same[:, None]
    joined[:-1, 2 * OWN : 3 * OWN] = x[1:] * same[:, None]
    joined[:, -1] = 1
    return joined, doc, size + 1.0


def _padded(doc: np.ndarray) -> list[np.ndarray]:
    """Chains of about equal length side by side: indexes (steps x chains) into lines, -1 beyond a chain's end, CELLS at most or one chain.

    Chains come in order of falling length, so that one long text doesn't pad all others.
    """
    _, first, count = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    first, count, out, lo = first[order], count[order], [], 0
    while lo < len(count):
        hi = min(len(count), lo + max(1, CELLS // int(count[lo])))
        step = np.arange(count[lo])[:, None]
        out.append(np.where(step < count[lo:hi], first[lo:hi] + step, -1))
        lo = hi
    return out


def _all_marginals(emit: np.ndarray, trans: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    p = np.zeros(len(emit))
    for at in groups:
        p += marginals(emit, trans, at)
    return p


def marginals(emit: np.ndarray, trans: np.ndarray, at: np.ndarray, gradient: bool = False):
    """P(good) of each line by the forward-backward algorithm, all chains side by side.

    emit: log-odds of good of each line. trans: scores of (state before, state). With ``gradient`` also the expected number of each
    pair of states.
    """
    steps, chains = at.shape
    live = (at >= 0).sum(axis=1)
    score = np.zeros((steps, chains, 2))
    score[:, :, 1] = np.where(at >= 0, emit[at], 0)
    fwd, bwd = score.copy(), np.zeros_like(score)
    for t in range(1, steps):
        c = live[t]
        fwd[t, :c] += np.logaddexp(fwd[t - 1, :c, 0, None] + trans[0], fwd[t - 1, :c, 1, None] + trans[1])
    for t in range(steps - 2, -1, -1):
        c = live[t + 1]
        after = bwd[t + 1, :c] + score[t + 1, :c]
        bwd[t, :c] = np.logaddexp(after[:, 0, None] + trans[:, 0], after[:, 1, None] + trans[:, 1])
    both = fwd + bwd
    odds = both[:, :, 1] - both[:, :, 0]
    p = np.zeros(len(emit))
    held = at >= 0
    p[at[held]] = 0.5 * (1 + np.tanh(0.5 * odds[held]))
    if not gradient:
        return p
    norm = np.logaddexp(both[:, :, 0], both[:, :, 1])
    pairs = np.zeros((2, 2))
    for t in range(1, steps):
        c = live[t]
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] += np.exp(fwd[t - 1, :c, i] + trans[i, j] + score[t, :c, j] + bwd[t, :c, j] - norm[t, :c]).sum()
    return p, pairs


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def calibrate(p: np.ndarray, good: np.ndarray, l2: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a document's mean marginal to its probability of being good (Newton)."""
    z = np.stack([_logit(p), np.ones(len(p))])
    theta = np.array([1.0, 0.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-theta @ z))
        g = z @ (good - q) - l2 * (theta - [1.0, 0.0])
        theta = theta + np.linalg.solve((z * (q * (1 - q))) @ z.T + l2 * np.eye(2), g)
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(x: np.ndarray, chain: np.ndarray, good: np.ndarray, steps: int = STEPS, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores that maximise the likelihood of the line labels (Adam over all chains)."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    groups = _padded(chain)
    y = good.astype(float)
    before, now = good[:-1].astype(int), good[1:].astype(int)
    inner = chain[1:] == chain[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (before[inner], now[inner]), 1)
    theta, m, v = np.concatenate([w, trans.ravel()]), 0.0, 0.0
    for i in range(1, steps + 1):
        w, trans = theta[: len(w)], theta[len(w) :].reshape(2, 2)
        emit, p, pairs = x @ w, np.zeros(len(x)), np.zeros((2, 2))
        for at in groups:
            one, both = marginals(emit, trans, at, gradient=True)
            p, pairs = p + one, pairs + both
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(x) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return theta[: len(w)], theta[len(w) :].reshape(2, 2)


def score_texts(texts: Sequence[bytes], w: np.ndarray, trans: np.ndarray, slope: float = 1.0, offset: float = 0.0) -> np.ndarray:
    """Calibrated mean P(good) over each text's lines, weighted by length."""
    x, doc, weight = line_features(texts)
    p = _all_marginals(x @ w, trans, _padded(doc))
    return 1 / (1 + np.exp(-slope * _logit(mean_marginal(p, doc, weight, len(texts))) - offset))


def mean_marginal(p: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """P(good) of each text's lines, averaged by length."""
    return np.bincount(doc, p * weight, n) / np.bincount(doc, weight, n)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = TRAIN_DOCS) -> tuple | None:
    """The field from up to ``n`` labelled documents outside the held-out fold; None without any.

    Every line of a document bears the document's label. Only the sample's line features reach the driver.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())

    @F.pandas_udf("lines array<binary>")
    def features(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for _, run in slices(list(texts)):
            x, doc, _ = line_features(run)
            cut = np.searchsorted(doc, np.arange(len(run) + 1))
            rows += [[x[i:j].tobytes()] for i, j in zip(cut, cut[1:], strict=False)]
        return pd.DataFrame({"lines": rows})

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n_lines = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    short = docs.where(F.coalesce(n_lines, F.lit(1)) <= TRAIN_DOC_LINES)
    # drawn from the labels that have a document here, whatever else is labelled: n rows of two numbers at most
    there = known.join(short.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    sample = there.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = short.select(F.col(doc_id).alias("doc_id"), body.alias("__text")).join(F.broadcast(sample), "doc_id")
    found = chosen.select("doc_id", "quality", features("__text").alias("f")).select("doc_id", "quality", "f.lines").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    if not found:
        log.warning("no labelled document to learn quality from: every score is 0.5")
        return None
    x = [np.frombuffer(r["lines"][0], np.float32).reshape(-1, WIDTH).astype(float) for r in found]
    return fit_documents(x, np.array([r["quality"] > 0 for r in found]))


def fit_documents(x: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Field and calibration from the line features of documents and their labels."""
    doc = np.repeat(np.arange(len(x)), [len(one) for one in x])
    part = np.concatenate([np.arange(len(one)) // TRAIN_LINES for one in x])
    chain = np.cumsum(np.append(0, (np.diff(doc) != 0) | (np.diff(part) != 0)))
    lines = np.concatenate(x)
    w, trans = fit(lines, chain, good[doc])
    weight = np.expm1(lines[:, SIZE_AT] * 8) + 1
    p = mean_marginal(_all_marginals(lines @ w, trans, _padded(chain)), doc, weight, len(x))
    return w, trans, *calibrate(p, good)


def with_score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from THRESHOLD on); columns of those names are replaced.

    Null counts as the empty text, whose one empty line is scored like any other; texts of any length are scored whole, in memory by their
    lines. Rows that repeat score alike. Labels of unknown documents and null labels are left out; of repeated labels the larger counts.
    Without labels every score is 0.5. Other columns, of any name, stay. An empty table gives no rows.
    """
    docs = docs.drop("held_out", "score", "predicted")
    model = train(docs, labels, doc_id, text)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(np.concatenate([score_texts(run, *model) for _, run in slices(list(texts), SLICE_BYTES)] or [np.zeros(0)]))

    found = docs.withColumns({"held_out": held_out(F.col(doc_id)), "score": score(F.coalesce(F.col(text), F.lit("")).cast("binary"))})
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
