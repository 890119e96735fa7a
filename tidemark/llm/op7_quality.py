"""Quality of documents from a linear-chain conditional random field over their lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, prefix_hash, span_hash, unused, utf8, words

#: Labelled documents and lines that training reads at most. Everything else covers all rows.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 2000, 50_000
THRESHOLD = 0.7
_OWN = 11
WIDTH = 3 * _OWN + 1


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, byte length and row of every line. A row has a line more than it has line feeds, so one at least.

    A line's own features are shares of its bytes or words; those of the lines before and after it follow, zero at the ends.
    """
    n, rows = len(data), len(at) - 1
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], cut + 1]), kind="stable")
    row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(at, cut, "right") - 1]), kind="stable")
    stop = np.concatenate([start[1:], [n]]) if rows else start
    stop = np.where(np.concatenate([row[1:] == row[:-1], [False]]), stop - 1, stop) if rows else start
    length = (stop - start).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[stop] - total[start]) / np.maximum(length, 1)

    lead = np.concatenate([[0], data[:-1]]) if n else data
    upper = ((data >= 65) & (data <= 90)) | ((lead == 0xC3) & (data >= 0x80) & (data <= 0x9E))
    lower = ((data >= 97) & (data <= 122)) | ((lead == 0xC3) & (data >= 0x9F))
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    mark = (data > 32) & (data < 127) & ~(upper | lower | digit)
    plain = np.isin(data, np.frombuffer(b".,;:'\"-()?", np.uint8))
    w0, w1, wrow = words(data, at)
    key = span_hash(prefix_hash(data), w0, w1) if n else np.zeros(0, np.uint64)
    line = np.searchsorted(start, w0, "right") - 1
    count = np.bincount(line, minlength=len(start)).astype(np.float64)
    again = np.zeros(len(w0), bool)
    again[1:] = (key[1:] == key[:-1]) & (line[1:] == line[:-1])
    odd = np.zeros(len(w0), bool)
    if len(w0):
        odd = (mark & ~plain)[w1 - 1]
    many = np.maximum(count, 1)
    own = np.stack(
        [share(upper), share(lower), share(digit), share(space), share(mark & ~plain), share(plain), np.bincount(line, again, len(start)) / many,
         np.bincount(line, odd, len(start)) / many, np.minimum(length / many, 30) / 10, np.log1p(length) / 5, (count == 0).astype(float)], 1,
    ) if len(start) else np.zeros((0, _OWN))
    same = (row[1:] == row[:-1])[:, None] if len(row) else np.zeros((0, 1), bool)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1), length, row


def marginals(emit: np.ndarray, row: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Forward-backward over the chains of lines with the same row (rows ascending): P(good) of each line,
    the sum of the chains' log normalisers, and expected counts of the four transitions.

    emit: log potentials (lines, 2), the second good; step: log potentials (from, to). Chains run side by
    side, longest first, a numpy step for each line position, so memory is that of the lines.
    """
    n = len(row)
    if not n:
        return np.zeros(0), 0.0, np.zeros((2, 2))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
    fwd[first] = emit[first]
    for t in range(1, size[0]):
        i = first[: active[t]] + t
        a = fwd[i - 1]
        fwd[i] = np.logaddexp(a[:, :1] + step[0], a[:, 1:] + step[1]) + emit[i]
    for t in range(size[0] - 2, -1, -1):
        i = first[: active[t + 1]] + t
        b = bwd[i + 1] + emit[i + 1]
        bwd[i] = np.logaddexp(b[:, :1] + step[:, 0], b[:, 1:] + step[:, 1])
    end = first + size - 1
    z = np.logaddexp(fwd[end, 0], fwd[end, 1])
    of = np.empty(n)
    of[first] = z
    of = np.repeat(z[np.argsort(order, kind="stable")], np.diff(np.concatenate([np.sort(first), [n]])))
    both = fwd + bwd
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.flatnonzero(row[1:] == row[:-1])
    pair = fwd[inner][:, :, None] + step + (emit[inner + 1] + bwd[inner + 1])[:, None, :] - of[inner][:, None, None]
    return good, float(z.sum()), np.exp(pair).sum(0)


def document_score(data: np.ndarray, at: np.ndarray, model: dict) -> np.ndarray:
    """For each row, its lines' P(good) weighted by their length (1 more, so that empty lines count), then calibrated."""
    x, length, row = line_features(data, at)
    emit = np.zeros((len(row), 2))
    emit[:, 1] = x @ model["weights"]
    good, _, _ = marginals(emit, row, model["step"])
    weight = length + 1
    mean = np.bincount(row, good * weight, len(at) - 1) / np.bincount(row, weight, len(at) - 1)
    return 1 / (1 + np.exp(-(model["slope"] * (mean - 0.5) + model["offset"])))


def fit(texts: list[str], labels: list[int], rounds: int = 120) -> dict:
    """Weights by Adam on the conditional log-likelihood, every line labelled as its document; then a logistic
    calibration of the documents' scores. Without both labels every document scores as the one label has it."""
    labels_ = np.asarray(labels, float)
    model = {"weights": np.zeros(WIDTH), "step": np.zeros((2, 2)), "slope": 0.0, "offset": 4.0 if not len(labels_) or labels_.mean() > 0.5 else -4.0}
    if len(set(labels)) < 2:
        return model
    data, at = utf8(pa.array(texts, pa.string()))
    parts = [(*line_features(data[at[i] : at[j]], at[i : j + 1] - at[i]), i) for i, j in pieces(at)]
    x, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] + p[3] for p in parts])
    y = labels_[row].astype(int)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    chain = np.cumsum(first | (place % 64 == 0))  # long documents train as chains of 64 lines
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    target = x.T @ y
    p, m, v, n = np.zeros(WIDTH + 4), 0.0, 0.0, len(row)
    for t in range(1, rounds + 1):
        emit = np.zeros((n, 2))
        emit[:, 1] = x @ p[:WIDTH]
        good, _, pairs = marginals(emit, chain, p[WIDTH:].reshape(2, 2))
        slope = np.concatenate([x.T @ good - target, (pairs - seen).ravel()]) / n + 1e-4 * p
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        p = p - 0.25 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model |= {"weights": p[:WIDTH], "step": p[WIDTH:].reshape(2, 2), "slope": 1.0, "offset": 0.0}
    s = np.concatenate([document_score(data[at[i] : at[j]], at[i : j + 1] - at[i], model) for i, j in pieces(at)])
    mean = np.log(s / (1 - s))
    a, b = 6.0, 0.0
    for _ in range(200):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-(a * mean + b)))
        g = np.array([((q - labels_) * mean).sum() + 0.05 * a, (q - labels_).sum()])
        w = q * (1 - q) + 1e-6
        h = np.array([[(w * mean * mean).sum() + 0.05, (w * mean).sum()], [(w * mean).sum(), w.sum()]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-6:
            break
    return model | {"slope": float(a), "offset": float(b)}


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, of: int = 4) -> dict:
    """Fit on labelled documents whose crc32(doc_id as text) mod `of` is not `held_out`.

    The sample holds SAMPLE_DOCUMENTS ids at most, the first by a hash of the id, and SAMPLE_LINES lines at
    most; only this bounded sample comes to the driver. Ids with two different labels are left out.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % of != held_out)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).collect()
    if not ids:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in ids], "doc_id long, y int")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    found = texts.join(F.broadcast(wanted), "doc_id").withColumn("n", lines).dropDuplicates(["doc_id"])
    short = {r.doc_id: r.n for r in found.select("doc_id", "n").collect()}
    room, keep = SAMPLE_LINES, []
    for r in ids:
        if short.get(r.doc_id, room + 1) <= room:
            room -= short[r.doc_id]
            keep.append(r.doc_id)
    keep_df = docs.sparkSession.createDataFrame([(k,) for k in keep], "doc_id long")
    rows = sorted(found.join(F.broadcast(keep_df), "doc_id").select("doc_id", "y", "text").collect())
    return fit([r.text for r in rows], [r.y for r in rows])


def score_column(model: dict, text: str = "text"):
    """A column expression with the score (0 to 1) of the whole text; null is an empty text."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, at = utf8(column)
            out = [document_score(data[at[i] : at[j]], at[i : j + 1] - at[i], model) for i, j in pieces(at)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(scores, "double").asNondeterministic()(F.col(text))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts have one empty line and are scored as that; repeated rows give repeated results; a
    null doc_id is not held out; an empty table gives no rows. Columns besides doc_id and text aren't read.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", "text").withColumn("score", score_column(model))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose score is THRESHOLD or more."""
    model = train(docs, labels)
    (name,) = unused(docs, "score")
    return docs.withColumn(name, score_column(model)).where(F.col(name) >= THRESHOLD).drop(name)
