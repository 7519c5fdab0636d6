"""Weighted shingle signatures by DartMinHash (Christiani, 2020), in numpy on batches of texts.

A text's shingles (runs of five words) are the elements of a weighted set; an element that occurs n
times weighs 1 + ln n. Each element owns a region of the plane weight x rank, cut into weight cells
[0, 1), [1, 2), [2, 4), ...; hashed darts hit each cell as a Poisson process in rank order, the same for
every text that has the element. A text sees the darts below its element's weight, up to the rank at
which about k ln k + 2k darts are expected in all. Each dart hashes to one of k coordinates and the
earliest dart of a coordinate is kept. Two texts keep the same dart with a probability equal to their
weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from umbra.llm.base import by_value

by_value(__name__)

SHINGLE = 5
U = np.uint64
GOLD, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE, BASE_INV = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
#: Texts are hashed together up to this many bytes; a longer text is hashed on its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finalizer)."""
    x = (x + GOLD)
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, U(base))
    p[0] = U(1)
    return np.multiply.accumulate(p)


class Shingler:
    """Shingle hashes of texts; keeps the power tables between calls."""

    def __init__(self):
        self.up = self.down = _powers(BASE, 1)
        self.space = np.zeros(256, bool)
        self.space[[0x20, 9, 10, 11, 12, 13]] = True

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text index and hash of every word, in order."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(r) + 1 for r in raw], np.int64)
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if len(self.up) < len(buf) + 1:
            n = max(len(buf) + 1, CHUNK + 4096)
            self.up, self.down = _powers(BASE, n), _powers(BASE_INV, n)
        gap = self.space[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * self.up[:len(buf)], out=total[1:])
        h = mix((total[end] - total[start]) * self.down[start])
        return np.searchsorted(np.cumsum(size), start, side="right"), h

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text index and hash of every shingle; a text of fewer words has one, of all its words."""
        own, w = self.words(texts)
        n = len(w) - SHINGLE + 1
        out_own, out_h = own[:0], w[:0]
        if n > 0:
            h = w[:n].copy()
            for j in range(1, SHINGLE):
                h = h * M1 + w[j:j + n]
            same = own[:n] == own[SHINGLE - 1:]
            out_own, out_h = own[:n][same], mix(h[same])
        count = np.bincount(own, minlength=len(texts))
        for t in np.flatnonzero((count > 0) & (count < SHINGLE)):
            h = U(count[t])
            with np.errstate(over="ignore"):
                for x in w[own == t]:
                    h = h * M2 + x
            out_own, out_h = np.append(out_own, t), np.append(out_h, mix(np.array([h], U)))
        return out_own, out_h


def multisets(own: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs, sorted, and how often each occurs."""
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return own[first], h[first], np.diff(np.append(first, len(h)))


def weight(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def digests(n_texts: int, own, h, count) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for texts with equal shingle multisets."""
    one, two = np.zeros(n_texts, U), np.zeros(n_texts, U)
    item = mix(h ^ mix(count.astype(U)))
    np.add.at(one, own, item)
    np.add.at(two, own, mix(item ^ M2))
    return one, two


def signatures(n_texts: int, own, h, count, k: int) -> np.ndarray:
    """(n_texts, k) kept darts; a text without shingles keeps none (all ones)."""
    w = weight(count)
    mass = np.bincount(own, weights=w, minlength=n_texts)
    none = np.iinfo(np.uint64).max
    sig = np.full((n_texts, k), none, U)
    reach = (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-9)
    todo = mass > 0
    while todo.any():
        use = todo[own]
        part = np.full(n_texts * k, none, U)
        _throw(own[use], h[use], w[use], reach, k, part)
        part = part.reshape(n_texts, k)
        full = todo & (part != none).all(axis=1)
        sig[full] = part[full]
        todo &= ~full
        reach = np.where(todo, reach * 2, reach)      # a coordinate stayed empty: further ranks
    return sig


def _throw(own, h, w, reach, k, part) -> None:
    lo, span, cell = 0.0, 1.0, 0
    while len(own):
        rank = np.zeros(len(own))
        o, x, ww = own, mix(h ^ U(cell + 1)), w
        most = reach[o]
        while len(o):
            x = mix(x)
            u = ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
            rank = rank - np.log(u) / span
            go = rank < most
            o, x, ww, rank, most = o[go], x[go], ww[go], rank[go], most[go]
            place = mix(x ^ M1)
            hit = lo + (place >> U(11)).astype(np.float64) * (span / (1 << 53)) < ww
            at = mix(place)[hit]
            # the rank, then bits of the dart: the least of them is the earliest dart
            dart = (rank[hit].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (at >> U(32))
            np.minimum.at(part, o[hit] * k + (at % U(k)).astype(np.int64), dart)
        lo, span, cell = (1.0, 1.0, 1) if cell == 0 else (lo + span, span * 2, cell + 1)
        go = w > lo
        own, h, w = own[go], h[go], w[go]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band: of ``rows`` coordinates that a fixed rule draws for it."""
    draw = np.random.default_rng(5)
    pick = np.stack([draw.permutation(sig.shape[1])[:rows] for _ in range(bands)])
    out = mix(np.tile(np.arange(bands, dtype=U), (len(sig), 1)))
    for j in range(rows):
        out = mix(out * M1 + sig[:, pick[:, j]])
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of each row of ``a`` and each row of ``b`` (one byte a coordinate)."""
    out = np.empty((len(a), len(b)), np.float32)
    for lo in range(0, len(a), 64):
        out[lo:lo + 64] = (a[lo:lo + 64, None, :] == b[None, :, :]).sum(axis=2, dtype=np.uint16)
    return out / a.shape[1]


def chunks(texts: list[str]):
    """(first, last) of runs of texts of about CHUNK characters."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK // 2):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of distinct sorted hashes and counts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    wa, wb = weight(na), weight(nb)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low))
