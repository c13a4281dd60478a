"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, column, slices, text_buffer
from ._learn import held_out, sample_each
from ._tables import bounded_batches

#: Bytes of a window; a text is cut into as many as it needs, the last one filled with zero bytes.
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
#: Rows of each language that training reads at most (whole texts), and passes over their windows.
TRAIN_ROWS, EPOCHS = 400, 2
#: Windows of noise that stand for what is in no learned language, as a share of all others.
NOISE = 0.2
#: What a text without letters is.
UNKNOWN = "und"

#: Symbols: 0 padding, 1 every byte below 128 but a-z, then a-z, then each byte of 128 and more.
_SYMBOL = np.ones(256, np.uint8)
_SYMBOL[0] = 0
_SYMBOL[0x61:0x7B] = np.arange(2, 28)
_SYMBOL[0x80:] = np.arange(28, 156)
SYMBOLS = 156


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all windows (n, WINDOW) and the text of each."""
    size = np.diff(off)
    many = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = off[row] + k * WINDOW
    length = np.minimum(WINDOW, off[row + 1] - start)
    sym = np.concatenate([_SYMBOL[LOWER[data]], np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(sym, WINDOW)[start]
    short = np.flatnonzero(length < WINDOW)
    out[short] = np.where(np.arange(WINDOW) < length[short, None], out[short], 0)
    return out, row


@dataclass
class ByteCNN:
    """embedding -> convolutions of several widths -> ReLU -> max over the window -> softmax.

    The softmax has a class for each label and, last, one for noise: what looks like none of them.
    """

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width, EMBED, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """What each symbol, or each pair of symbols, adds to a filter at its place: convolution becomes table lookup."""
        out = []
        for f in self.filters:
            one = [(self.embed @ f[k]).astype(np.float32) for k in range(len(f))]
            parts = []
            for k in range(0, len(one) - 1, 2):
                parts.append((one[k][:, None, :] + one[k + 1][None, :, :]).reshape(-1, FILTERS))
            if len(one) % 2:
                parts.append(one[-1])
            out.append(parts)
        return out

    def logits(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * SYMBOLS + x[:, 1:]
        pooled = []
        for parts, f, b in zip(tables, self.filters, self.bias, strict=True):
            width = len(f)
            n = WINDOW - width + 1
            total = parts[0][pair[:, :n]]
            for k, part in enumerate(parts[1:], 1):
                at = 2 * k
                total += part[pair[:, at : at + n]] if at + 1 < width else part[x[:, at : at + n]]
            pooled.append(np.maximum(total.max(axis=1) + b, 0))
        return np.concatenate(pooled, axis=1) @ self.dense + self.dense_bias


def fit(texts: list[bytes], labels: list[str], seed: int = 5) -> ByteCNN | None:
    """Train on labelled texts: Adam on all their windows, each a sample of its text's label. None if there is nothing to learn from.

    Labels weigh alike, and within a label texts by the root of their windows, so neither a frequent language nor a
    few very long texts decide. Noise windows are random strings of all symbols, of those that no text has, and of letters.
    """
    names = sorted(set(labels))
    texts = list(texts)
    if not names or not any(texts):
        return None
    rng = np.random.default_rng(seed)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, row = windows(np.frombuffer(b"".join(texts), np.uint8), off)
    y = np.array([names.index(v) for v in labels])[row]
    classes, scale = len(names) + 1, 0.2
    weight = 1 / np.sqrt(np.bincount(row))[row]
    weight /= np.bincount(y, weight, minlength=len(names))[y]
    # noise: any symbols, those beyond ASCII that are not met in texts, letters in no order
    met = np.bincount(x.ravel(), minlength=SYMBOLS) > 0
    strange = np.flatnonzero(~met[28:]) + 28
    n_noise = max(30, int(NOISE * len(x)))
    kinds = [np.arange(1, SYMBOLS), strange if len(strange) else np.arange(28, SYMBOLS), np.arange(1, 28)]
    noise = np.concatenate([rng.choice(k, (n_noise // 3 + 1, WINDOW)) for k in kinds]).astype(x.dtype)
    x, y = np.concatenate([x, noise]), np.append(y, np.full(len(noise), classes - 1))
    weight = np.append(weight, np.full(len(noise), 1 / len(noise)))
    weight *= len(y) / weight.sum()
    p = {"e": rng.normal(0, scale, (SYMBOLS, EMBED)), "d": rng.normal(0, scale, (len(WIDTHS) * FILTERS, classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, scale, (w, EMBED, FILTERS)), np.zeros(FILTERS)
    m, v, step, rate = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0, 5e-3
    for epoch in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            xs, n = x[some], len(some)
            emb = p["e"][xs]
            best, pooled, patches = [], [], []
            for w in WIDTHS:
                patch = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
                conv = patch @ p[f"f{w}"].reshape(-1, FILTERS) + p[f"b{w}"]
                at = conv.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
                patches.append(patch)
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            z = hidden @ p["d"] + p["c"]
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), y[some]] -= 1
            q *= (weight[some] / n)[:, None]
            g = {"d": hidden.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = (q @ p["d"].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                chosen = np.take_along_axis(patches[i], best[i][:, :, None], 1)  # (n, FILTERS, w * EMBED)
                g[f"f{w}"] = np.einsum("nf,nfe->ef", own, chosen).reshape(w, EMBED, FILTERS)
                g[f"b{w}"] = own.sum(axis=0)
                to = np.einsum("nf,ef->nfe", own, p[f"f{w}"].reshape(-1, FILTERS)).reshape(n, FILTERS, w, EMBED)
                at = best[i][:, :, None] + np.arange(w)
                np.add.at(g["e"], np.take_along_axis(xs, at.reshape(n, -1), 1).ravel(), to.reshape(-1, EMBED))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate / (1 + epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCNN(names, p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["d"], p["c"])


def predict(model: ByteCNN, tables: list[list[np.ndarray]], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Class probabilities of each text, noise last: softmax of its windows' mean logits, windows weighted by what they hold."""
    x, row = windows(data, off)
    n = len(off) - 1
    total, held = np.zeros((n, len(model.labels) + 1)), np.zeros(n)
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        size = (part > 0).sum(axis=1)
        np.add.at(total, row[lo : lo + 512], model.logits(part, tables) * size[:, None])
        np.add.at(held, row[lo : lo + 512], size)
    z = total / np.maximum(held, 1)[:, None]
    z -= z.max(axis=1, keepdims=True)
    q = np.exp(z)
    return q / q.sum(axis=1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> ByteCNN | None:
    """Fit on whole texts of at most about `most` rows of each language (ten times that in all), whose ids are not in the held-out fold.

    A language of fewer rows gives all of them.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = sorted((r.t, r.y) for r in sample_each(rows, id_col, lang_col, most).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("y")).toLocalIterator())
    return fit([t.encode() for t, _ in found], [y for _, y in found])


def identify(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns in `keep`, lang_pred and score (probability of lang_pred) for each row, over its whole text.

    lang_pred is the likeliest learned language; where noise is likelier the score is below one half. Null texts and texts without a letter are 'und' with score 0, as are all where there was nothing to learn from.
    Repeated rows and null ids each get their row; an empty table gives no rows. The model (a few MB) is sent to the tasks
    once; nothing is shuffled.
    """
    keep = keep or []
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    base = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"), letters.alias("letters"))
    front = [base.schema["id"], *(base.schema[f"k{i}"] for i in range(len(keep)))]
    out = type(base.schema)([*front]).add("lang_pred", "string").add("score", "double")

    def run(batches):
        network = sent.value
        tables = network.tables() if network else None
        for batch in batches:
            data, off = text_buffer(column(batch, "text"))
            known = column(batch, "letters").to_numpy(zero_copy_only=False).astype(bool)
            names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if network:
                q = np.concatenate([predict(network, tables, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(off, 1 << 20)] or [np.zeros((0, len(network.labels) + 1))])[:, :-1]
                names = np.where(known, np.array(network.labels, object)[q.argmax(axis=1)] if len(q) else names, UNKNOWN)
                scores = np.where(known, q.max(axis=1, initial=0), 0.0)
            yield pa.record_batch([*(column(batch, f.name) for f in front), pa.array(names.tolist(), pa.string()), pa.array(scores)], names=out.names)

    return base.mapInArrow(run, out).select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def known_languages(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, languages: list[str] | None = None) -> DataFrame:
    """The rows whose language is known (not 'und', and one of `languages` if given) with at least that score, with all their columns.

    The default score is that of a language likelier than all others and noise together. Without a model, the rows with a letter.
    """
    if model is None:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    found = identify(docs, model, id_col, text_col, keep=docs.columns)
    plain = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    n = len(docs.columns)
    kept = plain.where((F.col(f"c{n + 1}") != UNKNOWN) & (F.col(f"c{n + 2}") >= least))
    if languages is not None:
        kept = kept.where(F.col(f"c{n + 1}").isin(languages))
    return kept.select(*[F.col(f"c{i + 1}").alias(c) for i, c in enumerate(docs.columns)])
