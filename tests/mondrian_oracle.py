"""A small, recursive, unweighted model of Mondrian used as a brute-force oracle in tests.

Each partition tries dimensions in order of normalized width (ties: lower QI index); a numeric
attempt always narrows the partition's bounds to its true min/max; a failed dimension is not
tried again in that partition; children start with every dimension allowed again.
"""

from __future__ import annotations

import sys
from collections import Counter


def _ldiv(sas, l):
    if len(sas) < l:
        return False
    c = Counter(sas)
    return len(c) >= l and max(c.values()) * l <= len(sas)


def oracle_mondrian(rows, numeric, k=None, l=None, guard=True, trees=None):
    """rows: list of (qi_tuple, sa). Returns list of classes: (rows, labels tuple).

    trees: dimension -> {child: parent} with one root; a dimension without one goes from ``*`` to the value."""
    trees = trees or {}

    def above(i, v):
        out = [v]
        while out[-1] in trees[i]:
            out.append(trees[i][out[-1]])
        return out[::-1]            # root first

    def leaves(i, node):
        inner = set(trees[i].values())
        return 0 if node not in inner else sum(v not in inner and node in above(i, v) for v in trees[i])

    def child(i, label, v):
        """The node below the label that covers a value; None at a leaf."""
        if i not in trees:
            return str(v) if label is None else None
        path = above(i, v)
        at = 0 if label is None else path.index(label)
        return path[at + 1] if at + 1 < len(path) else None

    sys.setrecursionlimit(100000)
    d = len(numeric)
    ranges = []
    lo0, hi0, lab0 = [], [], []
    for i in range(d):
        vals = [r[0][i] for r in rows]
        if numeric[i]:
            ranges.append(float(max(vals) - min(vals)))
            lo0.append(float(min(vals)))
            hi0.append(float(max(vals)))
        else:
            ranges.append(float(len(set(vals))))
            lo0.append(None)
            hi0.append(None)
        lab0.append(None)
    thr = k if l is None else l
    out = []

    def width(i, lo, hi, lab):
        if numeric[i]:
            return (hi[i] - lo[i]) / ranges[i] if ranges[i] > 0 else 0.0
        if i in trees and lab[i] is not None:
            root = next(iter(set(trees[i].values()) - set(trees[i])))
            return leaves(i, lab[i]) / leaves(i, root)
        return 1.0 if lab[i] is None else 0.0

    def attempt(members, i, lo, hi, lab):
        if numeric[i]:
            vals = sorted(set(r[0][i] for r in members))
            lo[i], hi[i] = float(vals[0]), float(vals[-1])
            total = len(members)
            middle = total // 2
            if middle < thr or len(vals) <= 1:
                return None
            cnt = Counter(r[0][i] for r in members)
            run = 0
            for j, v in enumerate(vals):
                run += cnt[v]
                if run >= middle:
                    break
            if j + 1 >= len(vals):
                return None
            split, nxt = vals[j], vals[j + 1]
            left = [r for r in members if r[0][i] <= split]
            right = [r for r in members if r[0][i] > split]
            if l is None:
                if guard and len(right) < k:
                    return None
            elif not (_ldiv([r[1] for r in left], l) and _ldiv([r[1] for r in right], l)):
                return None
            llo, lhi, rlo, rhi = list(lo), list(hi), list(lo), list(hi)
            lhi[i], rlo[i] = float(split), float(nxt)
            return [(left, llo, lhi, list(lab)), (right, rlo, rhi, list(lab))]
        groups = {}
        for r in members:
            groups.setdefault(child(i, lab[i], r[0][i]), []).append(r)
        if None in groups:
            return None
        for g in groups.values():
            if (l is None and len(g) < k) or (l is not None and not _ldiv([r[1] for r in g], l)):
                return None
        kids = []
        for v, g in groups.items():
            clab = list(lab)
            clab[i] = v
            kids.append((g, list(lo), list(hi), clab))
        return kids

    def rec(members, lo, hi, lab):
        lo, hi, lab = list(lo), list(hi), list(lab)
        allowed = set(range(d))
        while allowed:
            i = min(allowed, key=lambda j: (-width(j, lo, hi, lab), j))
            kids = attempt(members, i, lo, hi, lab)
            if kids:
                for kid in kids:
                    rec(*kid)
                return
            allowed.discard(i)
        labels = []
        for i in range(d):
            if numeric[i]:
                vals = [r[0][i] for r in members]
                a, b = min(vals), max(vals)
                labels.append(str(a) if a == b else f"{a},{b}")
            else:
                labels.append(lab[i] if lab[i] is not None else "*")
        out.append((members, tuple(labels)))

    if rows:
        rec(rows, lo0, hi0, lab0)
    return out


def oracle_release(rows, numeric, **kw):
    """Counter of (labels..., sa) -> count, the counted form of the release."""
    c = Counter()
    for members, labels in oracle_mondrian(rows, numeric, **kw):
        for r in members:
            c[labels + (r[1],)] += 1
    return c
