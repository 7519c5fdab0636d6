"""In-task Mondrian solver for one small partition (hand-off target of the distributed loop).

It applies exactly the rules of the distributed rounds to the weighted tuples of
one partition held as NumPy arrays: dimension order by stored normalized width
(desc, then QI index), lazy tightening of numeric bounds on every attempt,
weighted lower median split, multiway split of a categorical label into its children.
Called through ``groupBy(pid).applyInPandas``; the partition is bounded by the
hand-off threshold, so memory per task is bounded.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass(frozen=True)
class LocalSpec:
    qi: tuple
    numeric: tuple          # bool per qi
    ranges: tuple           # global normalizer per qi (numeric: max-min, categorical: distinct count)
    k: int | None
    l: int | None
    guard: bool
    sa: str | None
    trees: tuple = ()       # categorical QIs that come with paths and widths
    ranged: bool = False    # a partition stands for a range of k, which its id names
    trace: bool = False     # tuples carry the ids of the partitions above


def child_id(parent: str, dim: int, branch: str) -> str:
    """The id of a child, as the distributed rounds make it."""
    return hashlib.sha256("\x1f".join((parent, str(dim), str(branch))).encode()).hexdigest()[:32]


def _l_diverse(sa_codes: np.ndarray, w: np.ndarray, l: int) -> bool:
    size = w.sum()
    if size < l:
        return False
    counts = np.bincount(sa_codes, weights=w)
    counts = counts[counts > 0]
    return len(counts) >= l and counts.max() * l <= size


def solve_partition(pdf: pd.DataFrame, spec: LocalSpec) -> pd.DataFrame:
    """The tuples of a partition with the class each ends in; for a range of k, once for each range that ends alike."""
    d = len(spec.qi)
    n = pdf["n"].to_numpy(dtype=np.int64)
    vals = []
    for i, c in enumerate(spec.qi):
        vals.append(pdf[c].to_numpy(dtype=np.float64) if spec.numeric[i] else pdf[c].to_numpy())
    sa_codes = None
    if spec.l is not None:
        sa_codes = pd.factorize(pdf[spec.sa])[0]
    lo0 = [float(pdf[f"lo_{i}"].iloc[0]) if spec.numeric[i] else None for i in range(d)]
    hi0 = [float(pdf[f"hi_{i}"].iloc[0]) if spec.numeric[i] else None for i in range(d)]
    lab0 = [None if spec.numeric[i] else pdf[f"lab_{i}"].iloc[0] for i in range(d)]
    lab0 = [None if (x is None or (isinstance(x, float) and np.isnan(x))) else x for x in lab0]
    dep0 = [int(pdf[f"dep_{i}"].iloc[0]) if i in spec.trees else None for i in range(d)]
    wd0 = [float(pdf[f"wd_{i}"].iloc[0]) if i in spec.trees else None for i in range(d)]
    paths = {i: [list(p) for p in pdf[f"path_{i}"]] for i in spec.trees}
    widths = {i: [list(p) for p in pdf[f"widths_{i}"]] for i in spec.trees}
    base_pid = str(pdf["pid"].iloc[0])

    # l-diversity is one setting: a range of one, which an allowed split covers
    k_range = tuple(int(x) for x in base_pid.split(":")[1:]) if spec.ranged else (spec.k, spec.k) if spec.l is None else (1, 1)
    stack = [(np.arange(len(n)), lo0, hi0, lab0, dep0, wd0, base_pid.split(":")[0], list(pdf["above"].iloc[0]) if spec.trace else [], k_range)]
    finished = []           # members, labels, widths, id, ids above, range of k
    while stack:
        idx, lo, hi, lab, dep, wd, name, above, (k_lo, k_hi) = stack.pop()
        lo, hi, lab = list(lo), list(hi), list(lab)
        w = n[idx]
        total = int(w.sum())

        def width(i):
            if spec.numeric[i]:
                return (hi[i] - lo[i]) / spec.ranges[i] if spec.ranges[i] > 0 else 0.0
            if i in spec.trees:
                return wd[i]
            return 1.0 if lab[i] is None else 0.0

        order = sorted(range(d), key=lambda i: (-width(i), i))
        for i in order:
            if k_lo > k_hi:
                break
            v = vals[i][idx]
            if spec.numeric[i]:
                uniq, inv = np.unique(v, return_inverse=True)
                cnt = np.bincount(inv, weights=w)
                lo[i], hi[i] = float(uniq[0]), float(uniq[-1])
                middle = total // 2
                if middle < (k_lo if spec.l is None else spec.l) or len(uniq) <= 1:
                    continue
                cum = np.cumsum(cnt)
                pos = int(np.searchsorted(cum, middle, side="left"))
                if pos + 1 >= len(uniq):
                    continue
                split, nxt = float(uniq[pos]), float(uniq[pos + 1])
                left_mask = v <= split
                if spec.l is None:
                    limit = min(middle, total - int(cum[pos])) if spec.guard else middle
                    if limit < k_lo:
                        continue
                else:
                    limit = 1
                    if not (_l_diverse(sa_codes[idx[left_mask]], w[left_mask], spec.l)
                            and _l_diverse(sa_codes[idx[~left_mask]], w[~left_mask], spec.l)):
                        continue
                llo, lhi, rlo, rhi = list(lo), list(hi), list(lo), list(hi)
                lhi[i], rlo[i] = split, nxt
                children = [(idx[left_mask], llo, lhi, lab, dep, wd, "L"), (idx[~left_mask], rlo, rhi, lab, dep, wd, "R")]
            else:
                if i in spec.trees:
                    if dep[i] >= len(paths[i][idx[0]]):         # the label is a leaf
                        continue
                    v = np.array([paths[i][r][dep[i]] for r in idx], dtype=object)
                elif lab[i] is not None:
                    continue
                codes, uniq = pd.factorize(v)
                sizes = np.bincount(codes, weights=w)
                if spec.l is None:
                    limit = int(sizes.min())
                    ok = limit >= k_lo
                else:
                    limit = 1
                    ok = all(_l_diverse(sa_codes[idx[codes == g]], w[codes == g], spec.l) for g in range(len(uniq)))
                if not ok:
                    continue
                children = []
                for g, value in enumerate(uniq):
                    clab = list(lab)
                    clab[i] = value
                    mine, cdep, cwd = idx[codes == g], dep, wd
                    if i in spec.trees:
                        cdep, cwd = list(dep), list(wd)
                        cdep[i], cwd[i] = dep[i] + 1, widths[i][mine[0]][dep[i] + 1]
                    children.append((mine, list(lo), list(hi), clab, cdep, cwd, value))
            # this dim is taken by every k up to its limit; larger ones try the next dim
            upto = min(limit, k_hi)
            stack.extend((*child, child_id(name, i, branch), [*above, name], (k_lo, upto)) for *child, branch in children)
            k_lo = upto + 1
        if k_lo <= k_hi:
            finished.append((idx, lab, wd, name, above, (k_lo, k_hi)))

    rows = np.concatenate([f[0] for f in finished])
    out = pdf[list(spec.qi) + ([spec.sa] if spec.sa else []) + ["n"]].iloc[rows].copy()
    repeat = lambda values: np.repeat(np.array(values, dtype=object), [len(f[0]) for f in finished])
    out["cls"] = repeat([f"{name}:{a}:{b}" if spec.ranged else name for _, _, _, name, _, (a, b) in finished])
    if spec.trace:
        out["above"] = [f[4] for f in finished for _ in f[0]]
    for i in range(d):
        if not spec.numeric[i]:
            out[f"lab_{i}"] = repeat([f[1][i] for f in finished])
        if i in spec.trees:
            out[f"wd_{i}"] = repeat([f[2][i] for f in finished]).astype(float)
    return out
