"""Benchmark decontamination by a broadcast hash set of test n-grams.

Every benchmark text is cut into windows of ``WIDTH`` words (a shorter text is one window). Their hashes,
with the words that they stand for, form an index that is broadcast when its size allows it. Tasks then hash
all word windows of a batch of documents at once, look the hashes up, compare the words of every
find, and mark the words covered. An index above ``MAX_WINDOWS`` or ``MAX_BYTES`` is never broadcast:
window hashes of the documents are joined to it by a shuffle, and each text is verified against the
windows that the join found for it. Both ways give the same rows.

Words are runs of ASCII letters (lower-cased) and digits and of all characters from U+0080.

Defined results: a null or empty text has no words and no hit; a benchmark text without words has no window;
rows of one item_id are one item; a row of benchmark without item_id makes hits but is no item; every row of
``documents`` gives one row, repeated and null ids included; an empty benchmark hits nothing. Texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import by_value, bounded_batches

WIDTH = 10                      # words of a window
MAX_WINDOWS = 200_000           # distinct windows of an index that is broadcast
MAX_BYTES = 32 << 20            # bytes of their words and item ids
PIECE = 1 << 20                 # bytes of text that are hashed at once
BITS = 22                       # bits of a hash that the first look-up reads

BASE = 0x9E3779B97F4A7C15       # odd, so that its powers have inverses modulo 2^64
STEP = 0xD1342543DE82EF95
INDEX_SCHEMA = "size int, hash long, window binary, items array<string>"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

by_value(__name__)


def _table() -> np.ndarray:
    is_word = np.zeros(256, bool)
    is_word[48:58] = is_word[97:123] = is_word[128:] = True
    return is_word


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of the words of byte strings, by differences of running sums."""

    def __init__(self):
        self.is_word = _table()
        # a byte counts by its place in a fixed mixing of 0..255
        mixed = np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP)
        self.value = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(BASE)
        self.grow(PIECE)

    def grow(self, n: int) -> None:
        self.power, self.inverse = _powers(BASE, n + 1), _powers(pow(BASE, -1, 1 << 64), n + 1)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end byte of each word of lower-cased UTF-8 ``data``."""
        got, at = [], 0
        while at < len(data):
            end = self._cut(data, at)
            got.append(self._piece(data, at, end))
            at = end
        if not got:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*got))

    def _cut(self, data: bytes, at: int) -> int:
        """An end for the piece that begins at ``at``, never inside a word."""
        end = at + PIECE
        while end < len(data):
            seen = self.is_word[np.frombuffer(data, np.uint8, min(PIECE, len(data) - end), end)]
            stop = np.flatnonzero(~seen)
            if len(stop):
                return end + int(stop[0]) + 1
            end += PIECE
        return len(data)

    def _piece(self, data: bytes, at: int, end: int):
        raw = np.frombuffer(data, np.uint8, end - at, at)
        if len(raw) >= len(self.power):
            self.grow(len(raw))
        edge = np.diff(self.is_word[raw].astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[:len(raw)], out=total[1:])
        h = (total[last] - total[first]) * self.inverse[first]
        h ^= h >> np.uint64(31)
        h *= np.uint64(STEP)
        h ^= h >> np.uint64(29)
        return h, first + at, last + at


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = (out + h[j:n + j]) * np.uint64(BASE)
    return out ^ (out >> np.uint64(32))


class Index:
    """Windows of a benchmark: hash -> words -> items, and the look-up tables of their hashes."""

    def __init__(self, rows: Iterable[tuple[int, int, bytes, list[str]]]):
        self.found: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for size, h, window, items in rows:
            self.found.setdefault(size, {}).setdefault(h & (1 << 64) - 1, {})[bytes(window)] = list(items)
        self.keys = {size: np.sort(np.fromiter(at, np.uint64, len(at))) for size, at in self.found.items()}
        self.first: dict[int, np.ndarray] = {}

    def lookup(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` that are in the index."""
        keys = self.keys[size]
        if len(keys) > 64 and size not in self.first:
            seen = np.zeros(1 << BITS, bool)
            seen[keys >> np.uint64(64 - BITS)] = True
            self.first[size] = seen
        at = np.flatnonzero(self.first[size][hashes >> np.uint64(64 - BITS)]) if len(keys) > 64 else np.arange(len(hashes))
        spot = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
        return at[keys[spot] == hashes[at]]


class Scanner:
    """Finds the windows of an index in texts."""

    def __init__(self):
        self.hasher = Hasher()

    def scan(self, texts: list[str | None], index: Index) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: number of words, [first byte, end byte, words) of its hit runs, and its items."""
        group, room = [], PIECE
        for text in texts:
            group.append((text or "").encode().lower())
            room -= len(group[-1])
            if room <= 0:
                yield from self._group(group, index)
                group, room = [], PIECE
        yield from self._group(group, index)

    def _group(self, group: list[bytes], index: Index):
        data = b"\0".join(group)
        h, first, last = self.hasher.words(data)
        offset = np.cumsum([0] + [len(x) + 1 for x in group])       # of each text in data
        begin = np.searchsorted(first, offset)                      # its first word
        owner = np.repeat(np.arange(len(group)), np.diff(begin))
        cover = np.zeros(len(h) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for size in index.found:
            hashes = window_hashes(h, size)
            for i in index.lookup(size, hashes).tolist():
                if owner[i] != owner[i + size - 1]:
                    continue
                words = b" ".join([data[a:b] for a, b in zip(first[i:i + size].tolist(), last[i:i + size].tolist())])
                found = index.found[size][int(hashes[i])].get(words)
                if found is not None:
                    cover[i] += 1
                    cover[i + size] -= 1
                    items.setdefault(int(owner[i]), set()).update(found)
        hit = np.cumsum(cover[:-1]) > 0
        for k in range(len(group)):
            a, b = int(begin[k]), int(begin[k + 1])
            runs = []
            if hit[a:b].any():
                edge = np.diff(hit[a:b].astype(np.int8), prepend=0, append=0)
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    runs.append((int(first[a + x] - offset[k]), int(last[a + y - 1] - offset[k]), y - x))
            yield b - a, runs, items.get(k, set())

    def windows(self, text: str | None, size: int | None = None) -> tuple[int, np.ndarray, list[bytes]]:
        """Size, hashes and words of the windows of a benchmark text."""
        data = (text or "").encode().lower()
        h, first, last = self.hasher.words(data)
        size = min(size or WIDTH, len(h))
        words = [data[a:b] for a, b in zip(first.tolist(), last.tolist())]
        return size, window_hashes(h, size) if size else h, [b" ".join(words[i:i + size]) for i in range(len(h) - size + 1)] if size else []


def windows(benchmark: DataFrame) -> DataFrame:
    """The distinct windows of ``benchmark`` (item_id, text), each with its items."""
    def run(batches):
        scanner = Scanner()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size, hashes, words = scanner.windows(text)
                if words:
                    n = len(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([size] * n, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(words, pa.binary()), pa.array([item] * n, pa.string())],
                        ["size", "hash", "window", "item"])

    bounded_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "size int, hash long, window binary, item string")
    return rows.groupBy("size", "hash", "window").agg(F.collect_set("item").alias("items"))


def small_index(index: DataFrame, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> Index | None:
    """The index for the driver to broadcast, or None if it is larger than the bounds."""
    n, size = index.agg(F.count("*"), F.sum(F.length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x)))).first()
    if n > max_windows or (size or 0) > max_bytes:
        return None
    return Index((r["size"], r["hash"], bytes(r["window"]), r["items"]) for r in index.collect())


def _found_for_text(docs: DataFrame, index: DataFrame) -> DataFrame:
    """_key (a digest of the text), _mine: the windows of ``index`` whose hashes the text holds."""
    sizes = [r["size"] for r in index.select("size").distinct().collect()]      # at most WIDTH

    def run(batches):
        scanner = Scanner()
        for b in batches:
            for text in b.column(0).to_pylist():
                data = (text or "").encode()
                h, _, _ = scanner.hasher.words(data.lower())
                key = hashlib.md5(data).digest()
                for size in sizes:
                    got = np.unique(window_hashes(h, size)).view(np.int64)
                    if len(got):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key] * len(got), pa.binary()), pa.array([size] * len(got), pa.int32()), pa.array(got)],
                            ["_key", "size", "hash"])

    held = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "_key binary, size int, hash long")
    held = held.join(index.select("size", "hash").distinct(), ["size", "hash"], "left_semi").distinct()
    return held.join(index, ["size", "hash"]).groupBy("_key").agg(
        F.collect_list(F.struct("size", "hash", "window", "items")).alias("_mine"))     # at most the windows of one text


def _scanned(docs: DataFrame, benchmark: DataFrame, emit, schema, max_windows: int, max_bytes: int) -> DataFrame:
    """``emit(batch, results)`` as the rows of each batch of ``docs``; its column ``text`` is a string."""
    spark = docs.sparkSession
    bounded_batches(spark)
    index = windows(benchmark)
    known = small_index(index, max_windows, max_bytes)
    at = docs.columns.index("text")
    if known is not None:
        shared = spark.sparkContext.broadcast(known)

        def run(batches):
            scanner, own = Scanner(), shared.value
            for b in batches:
                yield emit(b, list(scanner.scan(b.column(at).to_pylist(), own)))

        return docs.mapInArrow(run, schema)

    # too large to broadcast: each text travels with the windows that a join found for it
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_key"))
    rows = rows.join(_found_for_text(docs, index), "_key", "left").select("_row", "_mine")

    def run_own(batches):
        scanner = Scanner()
        for b in batches:
            flat = pa.RecordBatch.from_arrays(b.column(0).flatten(), names)
            out = []
            for text, mine in zip(flat.column(at).to_pylist(), b.column(1)):
                own = Index((x["size"], x["hash"], x["window"], x["items"]) for x in mine.as_py() or [])
                out += list(scanner.scan([text], own))
            yield emit(flat, out)

    return rows.mapInArrow(run_own, schema)


def digest(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): its words, words hit, items found, and their digest."""
    def emit(batch, results):
        items = [sorted(x) for _, _, x in results]
        n_hit = [sum(w for _, _, w in runs) for _, runs, _ in results]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _, _ in results], pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array([len(x) for x in items], pa.int64()),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
             pa.array([x > 0 for x in n_hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scanned(rows, benchmark, emit, SCHEMA, max_windows, max_bytes)


def removed(docs: DataFrame, benchmark: DataFrame, max_hit: float = 0.5, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without benchmark text: hit runs of words are cut from ``text``,
    and a document goes if more than ``max_hit`` of its words are hit (0: any hit)."""
    at = docs.columns.index("text")

    def emit(batch, results):
        keep, texts = [], []
        for text, (n, runs, _) in zip(batch.column(at).to_pylist(), results):
            keep.append(sum(w for _, _, w in runs) <= max_hit * n)
            if runs and keep[-1]:
                data, out, done = text.encode(), [], 0
                for a, b, _ in runs:
                    out.append(data[done:a])
                    done = b
                text = b"".join([*out, data[done:]]).decode()
            texts.append(text)
        columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1:]]
        return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scanned(docs, benchmark, emit, docs.schema, max_windows, max_bytes)


def oracle() -> str:
    """DuckDB SQL for ``digest`` over documents and benchmark: windows are compared as words."""
    upper, lower, gap = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"[x for x in string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{gap}') if x <> '']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), {WIDTH}) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[i + 1:i + size], ' ') AS g
        FROM (SELECT item, w, size, unnest(range(len(w) - size + 1)) AS i FROM bn)),
sizes AS (SELECT DISTINCT size FROM bn),
pos AS (SELECT k, size, i, array_to_string(w[i + 1:i + size], ' ') AS g
        FROM (SELECT k, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT k, size, i, g FROM pos JOIN (SELECT DISTINCT size, g FROM win) USING (size, g)),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM hit) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT k, item FROM hit JOIN win USING (size, g) WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN it USING (k)"""
