"""Toxicity by a string subsequence kernel: a linear SVM over Nystroem features of words.

The kernel (Lodhi et al., "Text Classification using String Kernels") compares two strings by the subsequences of
three symbols they share, each weighted by DECAY to the power of its span in both; so letters put between those of an insult, or gaps,
cost a little and do not hide it. A text is a bag of short strings: it is as toxic as its worst string.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import ALNUM, LOWER, column, padded, slices, text_buffer, word_hashes, words
from ._learn import held_out, sample
from ._tables import bounded_batches

DECAY = 0.6
#: Bytes of one string; longer words are cut into windows of this size, each half over the next.
LONGEST = 16
#: Symbols of the kernel: a-z, digits as one, bytes beyond ASCII folded to 36.
SYMBOLS = 64
#: Labelled rows of each class that training reads at most.
TRAIN_ROWS = 2500
LANDMARKS = 96
#: Insults that training tells apart at most; those in most texts come first.
MOST_INSULTS = 1000

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x30:0x3A] = 27
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x80:] = 28 + np.arange(128) % 36


def strings(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer, and starts, ends and texts of all strings to score.

    These are the words (digits, letters, characters beyond ASCII), and with the characters between them left out: what white space
    surrounds ("i-d-i-o-t") and runs of three or more single letters ("i d i o t"), however long.
    """
    low = LOWER[data]
    s, e, first = words(low, off, ALNUM)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    # words that go on: no white space between, or both of one letter
    n = len(s)
    if n > 1:
        same = row[1:] == row[:-1]
        space = np.concatenate([[0], np.cumsum(low <= 0x20)])
        glued = same & (space[s[1:]] == space[e[:-1]])
        # characters, not bytes: all but what continues one
        chars = np.concatenate([[0], np.cumsum(low & 0xC0 != 0x80)])
        single = chars[e] - chars[s] == 1
        alone = same & single[1:] & single[:-1] & (s[1:] - e[:-1] <= 3)
        extra_s, extra_e, extra_row, more = [], [], [], []
        at = len(low)
        for link, least in ((glued, 2), (alone, 3)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], link.view(np.int8), [0]])))
            for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if z - a + 1 >= least:
                    joined = low[s[a] : e[z]]
                    joined = joined[ALNUM[joined]]
                    more.append(joined)
                    extra_s.append(at)
                    at += len(joined)
                    extra_e.append(at)
                    extra_row.append(row[a])
        if more:
            low = np.concatenate([low, *more])
            s, e, row = np.append(s, extra_s), np.append(e, extra_e), np.append(row, extra_row)
    long = np.flatnonzero(e - s > LONGEST)
    if len(long):
        half = LONGEST // 2
        many = -(-(e[long] - s[long] - LONGEST) // half) + 1
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        a = np.minimum(np.repeat(s[long], many) + half * k, np.repeat(e[long], many) - LONGEST)
        keep = e - s <= LONGEST
        s, e, row = np.concatenate([s[keep], a]), np.concatenate([e[keep], a + LONGEST]), np.concatenate([row[keep], np.repeat(row[long], many)])
    return padded(low), s, e, row


def by_length(buf: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Groups of strings of one length: their numbers and symbols (n, length)."""
    size = e - s
    for k in np.unique(size).tolist():
        which = np.flatnonzero(size == k)
        yield which, _SYMBOL[buf[s[which][:, None] + np.arange(k)]]


def self_kernel(x: np.ndarray) -> np.ndarray:
    """k(x, x) of strings of one length, by the kernel's recurrence over prefixes."""
    return kernel(x, x)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """k(x[i], y[i]) for strings of one length each (broadcast over leading axes): shared subsequences of three symbols."""
    lx, ly = x.shape[-1], y.shape[-1]
    shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1])
    if lx < 3 or ly < 3:
        return np.zeros(shape)
    same = x[..., :, None] == y[..., None, :]
    lam = DECAY
    before = np.ones((*shape, lx + 1, ly + 1), np.float64)
    for p in range(1, 3):
        now = np.zeros_like(before)
        for i in range(p, lx + 1):
            tail = np.zeros(shape)
            for j in range(p, ly + 1):
                tail = lam * (tail + lam * before[..., i - 1, j - 1] * same[..., i - 1, j - 1])
                now[..., i, j] = lam * now[..., i - 1, j] + tail
        before = now
    return lam * lam * (before[..., :-1, :-1] * same).sum(axis=(-1, -2))


@dataclass
class StringSVM:
    """The decision of the SVM as one table: w . phi(x) / |phi(x)| + bias, over all triples of symbols.

    Nystroem features are K_mm^-1/2 k_m(x), so the decision is a weighted sum of kernels with the landmarks; each kernel is
    a product of two subsequence maps, and the landmarks' weighted maps add up to `weights`.
    """

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0

    def decide(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Decisions of strings; those of fewer than three bytes have none (-1)."""
        out = np.full(len(s), -1.0)
        for which, x in by_length(buf, s, e):
            size = x.shape[1]
            if size < 3:
                continue
            for lo in range(0, len(which), 4000):
                part = x[lo : lo + 4000]
                columns = part.T.astype(np.int32)
                total = np.zeros(len(part))
                for i in range(size - 2):
                    for j in range(i + 1, size - 1):
                        pair = (columns[i] * SYMBOLS + columns[j]) * SYMBOLS
                        for k in range(j + 1, size):
                            total += DECAY ** (k - i + 1) * self.weights[pair + columns[k]]
                out[which[lo : lo + 4000]] = total / np.sqrt(self_kernel(part)) + self.bias
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.intercept, -30, 30)))


def _unique(buf, s, e):
    h = word_hashes(buf, s, e)
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    return h, at, back


def worst_strings(model: StringSVM, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The greatest decision of each text's strings; each distinct string is decided once."""
    out = np.full(len(off) - 1, -1.0)
    buf, s, e, row = strings(data, off)
    if len(s):
        _, at, back = _unique(buf, s, e)
        np.maximum.at(out, row, model.decide(buf, s[at], e[at])[back])
    return out


def _map(x: np.ndarray, out: np.ndarray | None = None, weight: float = 1.0) -> np.ndarray:
    """The subsequence map of one string over all triples of symbols, added to out."""
    out = np.zeros(SYMBOLS**3) if out is None else out
    x = x.astype(np.int64)
    for i in range(len(x) - 2):
        for j in range(i + 1, len(x) - 1):
            for k in range(j + 1, len(x)):
                out[(x[i] * SYMBOLS + x[j]) * SYMBOLS + x[k]] += weight * DECAY ** (k - i + 1)
    return out


def fit(texts: list[bytes], labels: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 6, seed: int = 7) -> StringSVM:
    """Train on labelled texts. Half of them choose the strings and train the SVM, the others set the score's slope (all do both if there are fewer than 1,000).

    Only texts have labels. A string counts as an insult if it is met in so many toxic texts and so few others that
    chance is out of question; strings of clean texts are the other class, and in each round those that the
    machine takes for insults join it (multiple-instance learning with hard negatives).
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    # strings of all texts by hash, and each distinct one's bytes
    hashes, row, known, bytes_of, size = [], [], [], [], []
    for lo, hi in slices(off):
        part, a, z, r = strings(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        usable = z - a >= 3
        a, z, r = a[usable], z[usable], r[usable]
        h, one, _ = _unique(part, a, z)
        hashes.append(h)
        row.append((r + lo).astype(np.int32))
        known.append(h[one])
        size.append(z[one] - a[one])
        bytes_of.append(part[np.minimum(a[one][:, None] + np.arange(LONGEST), len(part) - 1)])
    flat = StringSVM(np.zeros(SYMBOLS**3), -1.0)
    if not sum(map(len, row)) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(labels) else 0, 0.001, 0.999))
        flat.slope, flat.intercept = 0.0, float(np.log(share / (1 - share)))
        return flat
    row = np.concatenate(row)
    distinct, one = np.unique(np.concatenate(known), return_index=True)
    back = np.searchsorted(distinct, np.concatenate(hashes)).astype(np.int32)
    buf, size = padded(np.concatenate(bytes_of)[one].ravel()), np.concatenate(size)[one]
    at = np.arange(len(distinct))
    s, e = LONGEST * at, LONGEST * at + size
    del hashes, known, bytes_of
    half = np.arange(len(texts)) % 2 == 0 if len(texts) >= 1000 else np.ones(len(texts), bool)
    learn = half[row]
    pairs = np.unique(back[learn].astype(np.int64) * len(texts) + row[learn])
    word, doc = np.divmod(pairs, len(texts))
    bad = np.bincount(word, labels[doc] == 1, len(at))
    good = np.bincount(word, labels[doc] == 0, len(at))
    share = max(1e-3, (labels[doc] == 1).mean())
    surprise = -(bad * np.log(share) + good * np.log(max(1e-9, 1 - share))) * (bad / np.maximum(1, bad + good) >= 0.95)
    insult = np.flatnonzero((surprise > 12) & (bad >= 4))
    clean = np.flatnonzero(good > 0)
    if not len(insult) or not len(clean):
        flat.slope, flat.intercept = 0.0, float(np.log(labels.mean() / (1 - labels.mean())))
        return flat
    insult = insult[np.argsort(-bad[insult], kind="stable")][:MOST_INSULTS]
    known = _Features(buf, s, e)
    # landmarks: insults, each next one the least like those before, and clean strings, to which each round adds those hardest to tell
    marks, like = [int(insult[0])], np.zeros(len(insult))
    while True:
        like = np.maximum(like, known.of(insult, np.array(marks[-1:]))[:, 0])
        if len(marks) >= landmarks // 2 or like.min() >= 0.7:
            break
        marks.append(int(insult[like.argmin()]))
    often = np.bincount(word, minlength=len(at))
    share = landmarks // 4
    marks = np.unique(np.concatenate([marks, clean[np.argsort(-often[clean], kind="stable")[:share]], rng.choice(clean, min(len(clean), share), replace=False)]))
    easy = rng.choice(clean, min(len(clean), 2000), replace=False)
    hard = np.empty(0, np.int64)
    model = flat
    for _ in range(rounds):
        root = known.root(marks)
        which = np.concatenate([insult, easy, hard])
        y = np.concatenate([np.ones(len(insult)), -np.ones(len(easy) + len(hard))])
        half_weight = 0.5 if not len(hard) else 0.25
        weight = np.concatenate([0.25 * bad[insult] / bad[insult].sum() + 0.25 / len(insult), np.full(len(easy), half_weight / len(easy)), np.full(len(hard), 0.25 / max(1, len(hard)))])
        w, b = _svm(known.of(which, marks) @ root, y, weight)
        model = StringSVM(known.table(marks, root @ w), float(b))
        decided = model.decide(buf, s, e)
        top = clean[np.argsort(-decided[clean], kind="stable")][:600]
        hard = np.union1d(hard, top[decided[top] > -0.9])
        marks = np.unique(np.concatenate([marks, top[:share]]))
    worst = np.full(len(texts), -1.0)
    np.maximum.at(worst, row, decided[back])
    rest = half if half.all() else ~half
    model.slope, model.intercept = _platt(worst[rest], labels[rest])
    return model


class _Features:
    """Normalised kernels of strings with landmarks, each worked out once."""

    def __init__(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray):
        self.buf, self.s, self.e = buf, s, e
        self.norm: dict[int, float] = {}
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def symbols(self, k: int) -> np.ndarray:
        return _SYMBOL[self.buf[self.s[k] : self.e[k]]]

    def root(self, marks: np.ndarray) -> np.ndarray:
        """K_mm^-1/2."""
        gram = self.of(marks, marks)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        ok = value > 1e-6 * value.max()
        return vector[:, ok] / np.sqrt(value[ok]) @ vector[:, ok].T

    def table(self, marks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The landmarks' normalised subsequence maps, weighted and added up."""
        out = np.zeros(SYMBOLS**3)
        for m, w in zip(marks.tolist(), weights.tolist(), strict=True):
            _map(self.symbols(m), out, w / self.norm[m])
        return out

    def of(self, which: np.ndarray, marks: np.ndarray) -> np.ndarray:
        out = np.empty((len(which), len(marks)))
        for c, m in enumerate(marks.tolist()):
            if m not in self.norm:
                self.norm[m] = float(np.sqrt(self_kernel(self.symbols(m)[None])[0]))
                self.columns[m] = np.empty(0, np.int64), np.empty(0)
            ids, values = self.columns[m]
            new = np.setdiff1d(which, ids)
            if len(new):
                found = np.empty(len(new))
                for group, x in by_length(self.buf, self.s[new], self.e[new]):
                    found[group] = kernel(x, self.symbols(m)[None]) / (np.sqrt(self_kernel(x)) * self.norm[m])
                ids, values = np.concatenate([ids, new]), np.concatenate([values, found])
                order = np.argsort(ids)
                self.columns[m] = ids, values = ids[order], values[order]
            out[:, c] = values[np.searchsorted(ids, which)]
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-5, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the active rows (Chapelle, "Training a Support Vector Machine in the Primal")."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(steps):
        a = x1[active] * weight[active, None]
        w = np.linalg.solve(a.T @ x1[active] + reg * np.eye(len(w)), a.T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], w[-1]


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and intercept, by Newton steps with smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> StringSVM:
    """Fit on at most about `most` labelled rows of each class whose ids are not in the held-out fold; of rows with one id the smallest text."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    ids = [r for y in (0, 1) for r in sample(known.where(F.col("y") == y), id_col, most).collect()]
    if not ids:
        return fit([], np.empty(0))
    chosen = docs.sparkSession.createDataFrame(ids, known.schema)  # at most 2.2 * most rows
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), id_col).where("t is not null").groupBy(id_col).agg(F.min("t").alias("t"), F.max("y").alias("y")).orderBy(F.xxhash64(F.col(id_col).cast("string"))).select("t", "y").collect()
    return fit([r.t.encode() for r in rows], np.array([r.y for r in rows]))


def score_texts(docs: DataFrame, model: StringSVM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double from 0 to 1) for each row, over its whole text.

    Null, empty and wordless texts have the least score there is; repeated rows and null ids each get their row; other columns are not read; an empty
    table gives no rows. The model (2 MB) is sent to the tasks once; nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        machine = sent.value
        for batch in batches:
            data, off = text_buffer(column(batch, "text"))
            worst = [worst_strings(machine, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(off, 4 << 20)]
            yield pa.record_batch([column(batch, "id"), pa.array(machine.score(np.concatenate(worst) if worst else np.empty(0)))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
