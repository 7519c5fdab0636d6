"""Toxicity scores of deobfuscated text: a noisy channel over character lattices, then a linear model.

A character trigram model is counted over all texts. Suspicious spans (leetspeak inside a word or at its
end, letters spaced out, letters repeated three times) become lattices, however long: a digit or mark may
stand for a letter or for nothing, or at a word's end for itself; a separator may be dropped or part two
words; a repeated letter may be dropped. Viterbi decoding under the trigram model picks
the restored span. The restored text is scored by logistic regression on its words and word beginnings,
learned from a bounded sample of labelled rows (``max_toxic`` and ``max_other`` documents, in
expectation), never from held-out ones.

Defined cases: null and empty texts get the score of a text without any known word. Without labelled rows
of both kinds every score is 0. A document with several label rows counts as toxic if any says so.
Repeated rows get equal scores, one output row for each input row.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import bounded_batches, by_value, held_out, may_learn, spread

by_value(__name__)

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
SYMBOLS = 64            # 0: no letter; then LETTERS; the last: any other letter
# The letters that digits and marks stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e"}
#: Log probabilities of the channel: a mark for a letter, a dropped mark, separator or repeated letter.
AS_LETTER, DROP_MARK, DROP_GAP, DROP_REPEAT = math.log(0.4), math.log(0.005), math.log(0.9), math.log(0.5)
#: The same of a separator between words, and of a final mark that stands for itself (the second: ! and |).
KEEP_GAP, KEEP_MARK, KEEP_POINT = math.log(0.9), math.log(0.05), math.log(0.5)
CACHED = 48             # characters of the longest span whose decoding is remembered
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
MARK = re.compile(r"[0134578@$!|€]")
LEETED = re.compile(r"(?<=[^\W\d_])[0134578@$!|€]+(?=[^\W\d_])|(?<!\w)[0134578@$!|€](?=[^\W\d_]{2})|(?<=[^\W\d_])[!|]*[0134578@$€][0134578@$!|€]*(?!\w)")
SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*][^\W_]){2,}(?!\w)")
FINAL = re.compile(r"[0134578@$!|€]+(?!\w)")
REPEATED = re.compile(r"([^\W\d_])\1\1")


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x250; others are treated as letters of the last symbol."""
    table = np.zeros(0x250, np.int64)
    for c in range(0x250):
        low = chr(c).lower()
        if low.isalpha():
            table[c] = LETTERS.index(low) + 1 if len(low) == 1 and low in LETTERS else SYMBOLS - 1
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < len(table), table[np.minimum(code, len(table) - 1)], SYMBOLS - 1)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """code, n: how often each run of three symbols occurs in all texts. Each task counts its own rows."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        table, total = symbol_table(), np.zeros(SYMBOLS ** 3, np.int64)
        for b in batches:
            s = symbols("  ".join(["", *(t or "" for t in b.column("text").to_pylist()), ""]), table)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_model(counts: dict[int, int]) -> np.ndarray:
    """log P(c | a, b), interpolated with log P(c | b) and a uniform share."""
    n = np.zeros(SYMBOLS ** 3)
    n[list(counts)] = list(counts.values())
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(axis=0) + 0.1
    two = two / two.sum(axis=1, keepdims=True)
    return np.log((n + 5.0 * two) / (n.sum(axis=2, keepdims=True) + 5.0))


class Restorer:
    """Decodes suspicious spans of lower-cased text."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.symbol = {c: i + 1 for i, c in enumerate(LETTERS)}
        self.remembered = lru_cache(50_000)(self._decode)

    def decode(self, span: str) -> str:
        return self.remembered(span) if len(span) <= CACHED else self._decode(span)

    @staticmethod
    def _about(span: str) -> tuple[set, set]:
        """The letters that ``span`` repeats three times, and the places of its final marks."""
        return {m[1] for m in REPEATED.finditer(span)}, {i for m in FINAL.finditer(span) for i in range(*m.span())}

    def _arcs(self, span: str, i: int, about: tuple[set, set] | None = None):
        tripled, final = about or self._about(span)
        c = span[i]
        if c in LEET:
            yield from ((x, AS_LETTER) for x in LEET[c])
            if i in final:
                yield c, KEEP_POINT if c in "!|" else KEEP_MARK
            else:
                yield "", DROP_MARK
        elif c.isalpha():
            yield c, 0.0
            if c in tripled and i and span[i - 1] == c:
                yield "", DROP_REPEAT
        elif c.isdigit():
            yield c, 0.0
        else:
            yield "", DROP_GAP
            yield c, KEEP_GAP

    def _decode(self, span: str) -> str:
        """The best path through the lattice of ``span``; a path is its last character and the path before."""
        best = {(0, 0): (0.0, None)}
        about = self._about(span)
        for i in range(len(span)):
            nxt: dict = {}
            arcs = list(self._arcs(span, i, about))
            for (a, b), (score, out) in best.items():
                for x, cost in arcs:
                    if x:
                        s = self.symbol.get(x, SYMBOLS - 1 if x.isalpha() else 0)
                        key, got = (b, s), score + cost + float(self.model[a, b, s])
                    else:
                        key, got = (a, b), score + cost
                    old = nxt.get(key)
                    if old is None or got > old[0]:
                        nxt[key] = (got, (x, out) if x else out)
            best = nxt
        ends = [(score + float(self.model[a, b, 0]), path) for (a, b), (score, path) in best.items()]
        top = max(e[0] for e in ends)
        return max(self._spelled(path) for score, path in ends if score == top)

    @staticmethod
    def _spelled(path) -> str:
        out = []
        while path:
            x, path = path
            out.append(x)
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        """``text`` in lower case with its suspicious spans decoded."""
        low = text.lower()
        spans = [(m.start(), m.end()) for m in SPACED.finditer(low)]
        if MARK.search(low):
            spans += self._tokens(low, LEETED)
        spans += self._tokens(low, REPEATED)
        if not spans:
            return low
        whole: list = []
        for lo, hi in sorted(spans):
            if whole and lo < whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], hi)
            else:
                whole.append([lo, hi])
        out, at = [], 0
        for lo, hi in whole:
            out += [low[at:lo], self.decode(low[lo:hi])]
            at = hi
        return "".join(out) + low[at:]

    @staticmethod
    def _tokens(low: str, sign: re.Pattern):
        """The runs without white space in which ``sign`` is found, up to their last letter, digit or @, $, €; a closing ! or | is punctuation."""
        end = 0
        for m in sign.finditer(low):
            if m.start() < end:
                continue
            lo, end = m.start(), m.end()
            while lo and not low[lo - 1].isspace():
                lo -= 1
            while end < len(low) and not low[end].isspace():
                end += 1
            hi = end
            while hi > m.start() + 1 and not (low[hi - 1].isalnum() or low[hi - 1] in "@$€"):
                hi -= 1
            yield lo, hi


def features(restored: str) -> set[str]:
    """Words, and word beginnings marked by a caret."""
    out = set(WORD.findall(restored))
    return out | {"^" + w[:p] for w in out for p in PREFIXES if len(w) > p}


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_other: int) -> DataFrame | None:
    """doc_id, toxic of a bounded sample of the labelled rows that may be learned from."""
    known = labels.where(may_learn(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, max_toxic / n[1])).otherwise(min(1.0, max_other / n[0]))
    return known.where(spread(F.col("doc_id"), 6) < share)


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, max_toxic: int = 3000, max_other: int = 9000, max_features: int = 4000):
    """(weights by feature, bias), or None without labelled rows of both kinds."""
    sample = _sample(docs, labels, max_toxic, max_other)
    if sample is None:
        return None
    # at most about max_toxic + max_other ids, whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def words(batches):
        restorer = Restorer(lm)
        for b in batches:
            got = [list(features(restorer.restore(t or ""))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(got, pa.list_(pa.string()))], ["doc_id", "toxic", "f"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        words, "doc_id long, toxic int, f array<string>").dropDuplicates(["doc_id"]).persist()
    try:
        size = {r["toxic"]: r["n"] for r in got.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(size) < 2:
            return None
        df = got.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(
            F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
        odds = F.log((F.col("pos") + 0.5) / (size[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (size[0] + 1.0))
        top = df.where(F.col("pos") >= 4).withColumn("odds", odds).where("odds > 1.5").orderBy(
            (F.col("odds") * F.col("pos")).desc(), "f").limit(max_features).select("f").collect()
        index = {r["f"]: i for i, r in enumerate(top)}
        ids = F.lit(list(index)) if index else F.array().cast("array<string>")
        held = got.select("doc_id", "toxic", F.array_intersect("f", ids).alias("f")).collect()
    finally:
        got.unpersist()
    held.sort(key=lambda r: r["doc_id"])
    label = np.array([r["toxic"] for r in held], np.float64)
    row = np.array([i for i, r in enumerate(held) for _ in r["f"]], np.int64)
    col = np.array([index[f] for r in held for f in sorted(r["f"])], np.int64)
    w, b = _regress(label, row, col, len(index))
    return {f: float(w[i]) for f, i in index.items()}, float(b)


def _regress(label, row, col, n, steps: int = 300, rate: float = 0.3, decay: float = 1e-3):
    """Logistic regression by full-batch AdaGrad on presence features."""
    w, b = np.zeros(n), 0.0
    gw, gb = np.full(n, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=w[col], minlength=len(label)) + b)))
        e = (p - label) / len(label)
        g, h = np.bincount(col, weights=e[row], minlength=n) + decay * w / len(label), e.sum()
        gw += g * g
        gb += h * h
        w -= rate * g / np.sqrt(gw)
        b -= rate * h / np.sqrt(gb)
    return w, b


def score(docs: DataFrame, lm: np.ndarray, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches):
        restorer = Restorer(lm)
        weights, bias = model
        short = min(PREFIXES)
        heads = {f.lstrip("^")[:short] for f in weights}
        for b in batches:
            z = []
            for t in b.column("text").to_pylist():
                known = {w for w in set(WORD.findall(restorer.restore(t or ""))) if w[:short] in heads}
                z.append(bias + sum(weights.get(f, 0.0) for f in sorted(known | {"^" + w[:p] for w in known for p in PREFIXES if len(w) > p})))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def language_model(docs: DataFrame) -> np.ndarray:
    """The trigram model of all texts; its counts are bounded by the alphabet."""
    return log_model({r["code"]: r["n"] for r in trigram_counts(docs).collect()})


def detect(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    lm = language_model(docs)
    got = score(docs, lm, train(docs, labels, lm, **options))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
