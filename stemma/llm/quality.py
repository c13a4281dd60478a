"""Quality by ordinal cumulative-link regression: one weight vector over hashed text, ordered thresholds between grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import NOT_SPACE, column, padded, row_of, slices, text_buffer, word_hashes, words
from ._learn import held_out, sample_each
from ._tables import bounded_batches

#: Hashed features of each kind, as a power of two.
HASH_BITS = 14
#: Kinds of features, each an average over its places in the text: trigrams of character classes and letters, word
#: shapes, words, and whether a word or a line was met before in the text.
KINDS = 4
#: Rows that training reads at most, and its steps.
TRAIN_ROWS, STEPS = 1500, 150
#: Grades that the model tells apart; more are grouped.
LEVELS = 10

#: Letters by themselves (small and capital apart), digits as one, white space as one, other bytes by themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = 0x30
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0x20
#: Word shapes: small, capital, digit, beyond ASCII, and each other byte as it is.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 1, 2, 3, 4
_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) of every place: weights of one kind sum to 1 in a text that has any."""
    size, top = 1 << HASH_BITS, np.uint64(64 - HASH_BITS)
    n = len(off) - 1
    rows, feats = [], []

    def add(kind: int, row: np.ndarray, h: np.ndarray) -> None:
        rows.append((kind, row))
        feats.append((h >> top).astype(np.int64) + kind * size)

    row = np.repeat(np.arange(n), np.diff(off))
    if len(data) > 2:
        c = _CLASS[data].astype(np.uint64)
        same = row[2:] == row[:-2]
        add(0, row[2:][same], (((c[:-2] << np.uint64(16)) | (c[1:-1] << np.uint64(8)) | c[2:]) * np.uint64(0x9E3779B97F4A7C15))[same])
    buf = padded(data)
    s, e, first = words(data, off, NOT_SPACE)
    if len(s):
        own = row_of(first)
        # shapes: first and last class, length up to 15, and how many classes change
        shape = _SHAPE[data]
        turns = np.concatenate([[0], np.cumsum(shape[1:] != shape[:-1])])
        code = (shape[s].astype(np.uint64) << np.uint64(24)) | (shape[e - 1].astype(np.uint64) << np.uint64(16)) | (np.minimum(e - s, 15).astype(np.uint64) << np.uint64(8)) | np.minimum(turns[e - 1] - turns[s], 15).astype(np.uint64)
        add(1, own, code * np.uint64(0xC4CEB9FE1A85EC53))
        h = word_hashes(buf, s, e)
        add(2, own, h)
        # the same word as before; the same as four words ago
        near = np.zeros(len(s), np.uint64)
        for k in (1, 2, 4):
            if len(s) > k:
                near[k:] |= ((h[k:] == h[:-k]) & (own[k:] == own[:-k])).astype(np.uint64) << np.uint64(k)
        add(3, own, (near + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    ls, le, lf = words(data, off, _LINE)
    if len(ls):
        own = row_of(lf)
        h = word_hashes(buf, ls, le, seed=3)
        key = h ^ (own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(ls), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        add(3, own, (again.astype(np.uint64) + np.uint64(101)) * np.uint64(0x9E3779B97F4A7C15))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    weights = []
    for _, r in rows:
        weights.append(1 / np.bincount(r, minlength=n).clip(1)[r])
    return np.concatenate([r for _, r in rows]), np.concatenate(feats), np.concatenate(weights)


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w . x - threshold k), thresholds ascending."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -30, 30)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(z) @ np.diff(self.grades)


def fit(texts: list[bytes], grades: np.ndarray, reg: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam over all rows at once.

    Thresholds are a first one and positive steps, so they stay ordered. Grades weigh alike, whatever their share.
    """
    grades = np.asarray(grades, float)
    levels = np.unique(grades)
    width = KINDS << HASH_BITS
    if len(levels) < 2:
        return OrdinalModel(levels if len(levels) else np.zeros(1), np.zeros(width), np.empty(0))
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = []
    for lo, hi in slices(off):
        row, feat, weight = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        key, back = np.unique((row + lo) * width + feat, return_inverse=True)
        parts.append((key, np.bincount(back, weight)))
    key, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    row, feat = np.divmod(key, width)
    # features met in few texts say little and cost much
    often = np.bincount(feat, minlength=width) >= 3
    some = often[feat]
    row, feat, value = row[some], feat[some], np.sqrt(value[some])
    y = np.searchsorted(levels, grades)
    k = len(levels) - 1
    share = np.bincount(y, minlength=k + 1)
    w, t = np.zeros(width), np.concatenate([[-(k - 1) / 2.0], np.full(k - 1, np.log(np.e - 1))])
    sample_weight = (len(y) / ((k + 1) * share))[y] / len(y)
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    scale = np.bincount(feat, value**2, width)
    used = np.flatnonzero(scale)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[feat] * value, len(y))
        theta = np.cumsum(np.concatenate([t[:1], np.log1p(np.exp(t[1:]))]))
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30)))  # P(grade > k)
        upper = np.concatenate([np.ones((len(y), 1)), tail], axis=1)[np.arange(len(y)), y]
        lower = np.concatenate([tail, np.zeros((len(y), 1))], axis=1)[np.arange(len(y)), y]
        prob = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / prob * sample_weight, lower * (1 - lower) / prob * sample_weight
        gz = -(du - dl)
        gtheta = np.zeros(k)
        np.add.at(gtheta, np.clip(y - 1, 0, None)[y > 0], du[y > 0])
        np.add.at(gtheta, y[y < k], -dl[y < k])
        gt = np.cumsum(gtheta[::-1])[::-1] * np.concatenate([[1.0], 1 / (1 + np.exp(-t[1:]))])
        gw = np.bincount(feat, gz[row] * value, width) + reg * w
        for i, (x, g) in enumerate(((w, gw), (t, gt))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            at = used if i == 0 else slice(None)
            x[at] -= (0.2 if i == 0 else 0.05) * (m[i][at] / (1 - 0.9**step)) / (np.sqrt(v[i][at] / (1 - 0.99**step)) + 1e-7)
    theta = np.cumsum(np.concatenate([t[:1], np.log1p(np.exp(t[1:]))]))
    return OrdinalModel(levels, w, theta)


def linear_scores(model: OrdinalModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """w . x of each text, with the square roots of features' shares as in training."""
    width = KINDS << HASH_BITS
    row, feat, weight = features(data, off)
    if not len(row):
        return np.zeros(len(off) - 1)
    own = model.weights[feat] != 0
    key = row[own] * width + feat[own]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[own][order]
    if not len(key):
        return np.zeros(len(off) - 1)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    value = np.sqrt(np.add.reduceat(weight, head))
    return np.bincount(key[head] // width, model.weights[key[head] % width] * value, len(off) - 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", most: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most about `most` graded rows of each grade, and ten times that in all, outside the held-out fold.

    Of rows with one id the greatest grade and the smallest text count. More than LEVELS grades are taken in so many groups of like size, each
    with its median as its grade.
    """
    known = labels.where(~held_out(id_col) & F.col(grade_col).isNotNull()).groupBy(id_col).agg(F.max(grade_col).alias("y"))
    ids = sample_each(known, id_col, "y", most).collect()
    if not ids:
        return fit([], np.empty(0))
    chosen = docs.sparkSession.createDataFrame(ids, known.schema)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), id_col).where("t is not null").groupBy(id_col).agg(F.min("t").alias("t"), F.max("y").alias("y")).toLocalIterator()
    found = sorted((r.t, r.y) for r in rows)
    return fit([t.encode() for t, _ in found], grouped(np.array([y for _, y in found], float)))


def grouped(y: np.ndarray) -> np.ndarray:
    """Grades as they are, or where there are more than LEVELS of them the medians of groups of like size."""
    if len(np.unique(y)) <= LEVELS:
        return y
    group = np.searchsorted(np.unique(np.quantile(y, np.arange(1, LEVELS) / LEVELS)), y, "right")
    return np.array([np.median(y[group == g]) for g in range(LEVELS + 1) if (group == g).any()])[np.unique(group, return_inverse=True)[1]]


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", above: float | None = None) -> DataFrame:
    """(id_col, expected_grade, p_above) for each row, over its whole text; p_above is P(grade > above), by default above the lowest.

    Null, empty and very short texts have the score of no features; repeated rows and null ids each get their row; where
    there was one grade to learn, it is everyone's; an empty table gives no rows. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k = 0 if above is None else int(np.searchsorted(model.grades, above, "right")) - 1

    def run(batches):
        machine = sent.value
        for batch in batches:
            data, off = text_buffer(column(batch, "text"))
            z = np.concatenate([linear_scores(machine, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(off, 1 << 20)] or [np.empty(0)])
            tails = machine.tails(z)
            p = tails[:, k] if 0 <= k < tails.shape[1] else np.full(len(z), float(k < 0))
            yield pa.record_batch([column(batch, "id"), pa.array(machine.expected(z) if tails.shape[1] else np.full(len(z), machine.grades[0])), pa.array(p)], names=["id", "expected_grade", "p_above"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, expected_grade double, p_above double").withColumnRenamed("id", id_col)
