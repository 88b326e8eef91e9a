"""Quality scores by Bradley-Terry ranking.

Every text is described by shares and counts of its characters, words and
lines. A bounded, seeded sample of labelled rows gives preference pairs: a row
with label 1 is preferred to a row with label 0. The chance of a preference is
the logistic function of the difference of two scores, and a score is linear in
the features, so the logistic loss on differences of features is minimised by
Newton's method. The cut lies at the quantile of sample scores that equals the
share of label 0 among labelled rows; scores are moved so that ``cut_score``
falls on it and squeezed between 0 and 1.

Null and empty texts have features of an empty text and are scored as well.
Rows that repeat a document get the same score. Without labels of both kinds
every text gets 0.5. Labels that are null or belong to held-out documents are
never read for the fit; a label given twice counts once, and a document with
both labels is left out. Of rows that share a sampled id the one with the
smallest features is learned from. Texts of any length are read whole; equal
scores stay equal, and a score on the cut is kept. Columns other than those
named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as T

#: Rows of each label that the fit may read at most.
SAMPLE_PER_LABEL = 4000
#: Opponents that every row of the rarer label meets.
OPPONENTS = 8

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[T.WHITE] = 4
_CLASS[list(b".,;:'\"()-")] = 5
_CLASS[list(b"#*$%&|<>@^~_=+\\/[]{}`")] = 6
_CLASS[list(b"!?")] = 7
FEATURES = [
    "log_words", "word_length", "long_words", "upper", "digits", "white", "points", "symbols", "marks", "other", "bare_symbols",
    "distinct_words", "distinct_pairs", "repeat_windows", "repeat_lines", "line_words", "marked_words", "upper_words",
]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for every text of a slice."""
    n = len(offsets) - 1
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    counts = np.bincount(row_of * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    starts, ends, rows = T.words(data, offsets)
    n_words = T.per_row(rows, n).astype(float)
    safe = np.maximum(n_words, 1)

    def share(marks):
        return np.bincount(rows, weights=marks, minlength=n) / safe

    def distinct(values, of):
        found = np.unique(T.mix(values ^ T.mix(of.astype(T.U64) + T.U64(7))), return_index=True)[1]
        return T.per_row(of[found], n) / np.maximum(T.per_row(of, n), 1)

    def holding(marked):
        sums = np.concatenate([[0], np.cumsum(marked)])
        return sums[ends] - sums[starts]

    length = ends - starts
    symbols, upper = holding(kind >= 6), holding(kind == 2)
    letters = holding((kind == 1) | (kind == 2) | (data >= 128))
    values = T.hashes(data, starts, ends)
    pairs, at2 = T.grams(values, rows, 2)
    wide, at8 = T.grams(values, rows, 8)
    low, high, line_row = T.runs(data != 10, offsets)
    lines = T.per_row(line_row, n)
    out = [
        np.log1p(n_words), np.minimum((np.diff(offsets) - counts[:, 4]) / safe, 30), share(length > 15), counts[:, 2] / size,
        counts[:, 3] / size, counts[:, 4] / size, counts[:, 5] / size, counts[:, 6] / size, counts[:, 7] / size, counts[:, 0] / size,
        share((letters == 0) & (symbols > 0)), distinct(values, rows), distinct(pairs, rows[at2]), 1 - distinct(wide, rows[at8]),
        1 - distinct(T.hashes(data, low, high), line_row), np.log1p(n_words / np.maximum(lines, 1)), share(symbols > 0),
        share((upper > 1) & (upper * 2 > letters)),
    ]
    return np.stack(out, axis=1)


def fit(x: np.ndarray, label: np.ndarray, share_of_zero: float, cut_score: float, seed: int = 5) -> dict:
    """Weights, cut and scale from a labelled sample."""
    middle, width = x.mean(axis=0), x.std(axis=0)
    width[width < 1e-9] = 1.0
    z = np.clip((x - middle) / width, -6, 6)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    rng = np.random.default_rng(seed)
    left = np.repeat(few, OPPONENTS)
    right = np.concatenate([rng.permutation(many)] * -(-len(left) // len(many)))[: len(left)]
    won, lost = (right, left) if few is bad else (left, right)
    d = z[won] - z[lost]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        slope = d.T @ p / len(d) - 1e-3 * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    score = z @ w
    # The sample holds other shares of the labels than the corpus, so its rows are weighed.
    mass = np.where(label == 0, share_of_zero / len(bad), (1 - share_of_zero) / len(good))
    order = np.argsort(score, kind="stable")
    at = int(np.searchsorted(np.cumsum(mass[order]), share_of_zero - 1e-12))
    near = score[order[[max(at, 0), min(at + 1, len(order) - 1)]]]
    scale = max(float(np.std(score)), 1e-9)
    return {"middle": middle, "width": width, "w": w, "cut": float(near.mean()), "scale": 2.0 / scale, "shift": float(np.log(cut_score / (1 - cut_score)))}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    raw = np.clip((x - model["middle"]) / model["width"], -6, 6) @ model["w"]
    return 1 / (1 + np.exp(-np.clip((raw - model["cut"]) * model["scale"] + model["shift"], -30, 30)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(
    documents: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label_column="quality",
    sample_per_label: int = SAMPLE_PER_LABEL, cut_score: float = 0.3,
) -> dict | None:
    """Fit on at most ``sample_per_label`` rows of each label; the sample goes to the driver, all else stays."""
    named = labels.select(F.col(id_column).alias("key"), F.col(label_column).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key"))
    )
    # A repeated label counts once, one that contradicts another not at all.
    known = named.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(sample_per_label) for k in (0, 1)]
    # At most twice the sample's bound.
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = documents.select(F.col(id_column).alias("key"), F.col(text_column).alias("body")).join(sample, "key")

    def measure(found):
        for batch in found:
            rows = [features(data, offsets) for _, _, data, offsets in T.slices(batch.column(1))]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(flat), pa.list_(pa.float64()))], ["key", "label", "x"])

    # Ids may repeat among documents: one row of each goes to the driver.
    measured = texts.select("key", "body", "label").mapInArrow(measure, "key long, label int, x array<double>")
    rows = measured.groupBy("key", "label").agg(F.min("x").alias("x")).toPandas()
    rows = rows.sort_values(["key", "label"], kind="stable")
    label = rows["label"].to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    return fit(np.stack(rows["x"].to_numpy()), label, totals[0] / (totals[0] + totals[1]), cut_score)


def quality_scores(documents: DataFrame, model: dict | None, id_column="doc_id", text_column="text", cut_score: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    fields = {"doc_id": pa.int64(), "score": pa.float64()}

    def rate(found):
        for batch in found:
            parts = {"doc_id": [batch.column(0)], "score": []}
            for _, _, data, offsets in T.slices(batch.column(1)):
                parts["score"].append(score(model, features(data, offsets)))
            yield T.batches(fields, parts)

    rated = documents.select(id_column, text_column).mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut_score).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, model: dict | None, text_column="text", cut_score: float = 0.3) -> DataFrame:
    """The rows whose text scores at least ``cut_score``, with all their columns, in one pass without a shuffle."""
    text_at = documents.columns.index(text_column)

    def keep(found):
        for batch in found:
            scores = [score(model, features(data, offsets)) for _, _, data, offsets in T.slices(batch.column(text_at))]
            yield batch.filter(pa.array(np.concatenate(scores) >= cut_score)) if scores else batch

    return documents.mapInArrow(keep, documents.schema)
