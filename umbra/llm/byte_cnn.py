"""Language ID by a byte convolutional network (filters of several widths, max pooling, softmax).

The network is trained in numpy on the driver from a bounded sample of labelled windows: about
``docs_per_lang`` documents of each language and ``windows_per_doc`` windows of each. It then scores
every fixed-length window of every whole text inside Spark tasks, in batches; a document gets the
mean of its windows' log probabilities, weighted by their bytes.

Defined cases: a null text, an empty text and a text without any letter get ``und`` and score 0.
Without any labelled row nothing is learned and every document gets ``und``. Repeated rows are
scored like any other, one output row for each input row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import bounded_batches, by_value, held_out, may_learn, spread

by_value(__name__)

WINDOW = 256            # bytes of a window
WIDTHS = (2, 3, 4)      # filter widths
FILTERS = 8             # filters of each width
REACH = max(WIDTHS) - 1
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (zero-padded), the text each belongs to, and its number of bytes.

    Neighbouring windows share REACH bytes, so no filter position of the text is left out.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    step = WINDOW - REACH
    count = np.maximum(1, -(-np.maximum(size - REACH, 1) // step))
    pad = b"\0" * WINDOW
    buf = np.frombuffer(pad.join(raw) + pad, dtype=np.uint8)
    at = np.concatenate(([0], np.cumsum(size + WINDOW)[:-1])) if len(raw) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(raw)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = at[owner] + nth * step
    held = np.clip(size[owner] - nth * step, 1, WINDOW)
    view = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)
    return view[start], owner, held


class ByteCNN:
    """One-hot bytes -> filters of width 2, 3, 4 -> max over the window -> ReLU -> softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.taps = {(w, o): rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for w in WIDTHS for o in range(w)}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters as two tables over byte pairs: a response is the sum of one row of each."""
        first = np.zeros((256, 256, FILTERS * len(WIDTHS)), np.float32)
        second = np.zeros_like(first)
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            for o in range(w):
                tap = self.taps[w, o]
                into = first if o < 2 else second
                into[:, :, cols] += tap[:, None, :] if o % 2 == 0 else tap[None, :, :]
        return first.reshape(65536, -1), second.reshape(65536, -1)

    @staticmethod
    def responses(win: np.ndarray, tables) -> np.ndarray:
        pair = (win[:, :-1].astype(np.uint16) << 8) | win[:, 1:]
        got = tables[0].take(pair[:, :-2], axis=0)
        got += tables[1].take(pair[:, 2:], axis=0)
        return got

    def log_probs(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, win: np.ndarray, label: np.ndarray, epochs: int = 6, rate: float = 0.02, batch: int = 64,
            seed: int = 11) -> "ByteCNN":
        """Adam on the cross-entropy; the gradient of a max goes to the position that attained it."""
        rng, t = np.random.default_rng(seed), 0
        params = {**{k: v for k, v in self.taps.items()}, "bias": self.bias, "out": self.out, "out_bias": self.out_bias}
        m = {k: np.zeros_like(v) for k, v in params.items()}
        s = {k: np.zeros_like(v) for k, v in params.items()}
        weight = len(label) / (len(self.langs) * np.maximum(1, np.bincount(label, minlength=len(self.langs))))
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                x, y = win[pick], label[pick]
                tables = self.fold_sparse(x)
                resp = tables
                where = resp.argmax(axis=1)
                pooled = np.take_along_axis(resp, where[:, None, :], axis=1)[:, 0, :]
                hidden = np.maximum(pooled + self.bias, 0)
                p = np.exp(self.log_probs(pooled))
                p[np.arange(len(y)), y] -= 1
                p *= weight[y][:, None] / len(y)
                grad = {"out": hidden.T @ p, "out_bias": p.sum(axis=0)}
                back = (p @ self.out.T) * (hidden > 0)
                grad["bias"] = back.sum(axis=0)
                for k, w in enumerate(WIDTHS):
                    cols = np.arange(k * FILTERS, (k + 1) * FILTERS)
                    for o in range(w):
                        g = np.zeros((256, FILTERS), np.float32)
                        byte = np.take_along_axis(x, where[:, cols] + o, axis=1)
                        np.add.at(g, (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), back[:, cols])
                        grad[w, o] = g
                t += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    params[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
        return self

    def fold_sparse(self, x: np.ndarray) -> np.ndarray:
        """Responses of a training batch, straight from the taps."""
        n = x.shape[1] - REACH
        return np.concatenate([sum(self.taps[w, o].take(x[:, o:o + n], axis=0) for o in range(w)) for w in WIDTHS], axis=2)


    def classify(self, texts: list[str | None], tables) -> tuple[list[str], list[float]]:
        """Language and score of every whole text, window by window."""
        texts = [t or "" for t in texts]
        total, weight, lo = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 500_000):
                size += len(texts[hi])
                hi += 1
            win, owner, held = windows_of(texts[lo:hi])
            for at in range(0, len(win), 64):
                logp = self.log_probs(self.responses(win[at:at + 64], tables).max(axis=1))
                np.add.at(total, lo + owner[at:at + 64], logp * held[at:at + 64, None])
                np.add.at(weight, lo + owner[at:at + 64], held[at:at + 64])
            lo = hi
        mean = total / np.maximum(weight, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True)) if len(texts) else mean
        p /= p.sum(axis=1, keepdims=True)
        known = [bool(LETTER.search(t)) for t in texts]
        best = p.argmax(axis=1)
        return ([self.langs[k] if ok else UNDETERMINED for k, ok in zip(best, known)],
                [float(p[i, k]) if known[i] else 0.0 for i, k in enumerate(best)])


def training_windows(docs: DataFrame, docs_per_lang: int, windows_per_doc: int):
    """Bounded labelled sample: evenly spaced windows of about ``docs_per_lang`` documents a language."""
    bounded_batches(docs.sparkSession)
    usable = docs.where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    langs = sorted(counts)
    take = F.lit(0.0)
    for lang in langs:
        take = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / counts[lang]))).otherwise(take)
    picked = usable.where(spread(F.col("doc_id"), 8) < take).select("doc_id", "lang", "text")

    def cut(batches):
        for b in batches:
            texts, label, ids = b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("doc_id").to_pylist()
            out_id, out_lang, out_nth, out_win = [], [], [], []
            for i, text in enumerate(texts):
                if not LETTER.search(text):
                    continue
                win, _, held = windows_of([text])
                win = win[held >= min(WINDOW // 2, held.max())]
                for j in sorted(set(np.linspace(0, len(win) - 1, windows_per_doc).astype(int).tolist())):
                    out_id.append(ids[i]); out_lang.append(label[i]); out_nth.append(j); out_win.append(win[j].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_lang, pa.string()), pa.array(out_nth, pa.int32()), pa.array(out_win, pa.binary())],
                ["doc_id", "lang", "nth", "win"])

    rows = picked.mapInArrow(cut, "doc_id long, lang string, nth int, win binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["nth"], r["lang"], bytes(r["win"])))
    win = np.frombuffer(b"".join(bytes(r["win"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return langs, win, np.array([langs.index(r["lang"]) for r in rows], np.int64)


def train(docs: DataFrame, docs_per_lang: int = 300, windows_per_doc: int = 3, epochs: int = 6) -> ByteCNN | None:
    """Fit a network on rows that may be learned from; None if there are none."""
    langs, win, label = training_windows(docs, docs_per_lang, windows_per_doc)
    return ByteCNN(langs).fit(win, label, epochs) if len(label) else None


def predict(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    def run(batches):
        tables = model.fold()
        for b in batches:
            lang, p = model.classify(b.column("text").to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def filtered(docs: DataFrame, model: ByteCNN | None, least_score: float) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language of at least ``least_score``; without a
    model, those whose text has a letter."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        tables = model.fold() if model else None
        for b in batches:
            texts = b.column(at).to_pylist()
            if model:
                keep = [x >= least_score and lang != UNDETERMINED for lang, x in zip(*model.classify(texts, tables))]
            else:
                keep = [bool(LETTER.search(t or "")) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on ``docs`` (doc_id, text, lang) and predict the language of each of its rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    got = predict(docs, train(docs, **options))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
