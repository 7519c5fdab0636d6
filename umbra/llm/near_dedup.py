"""Near-duplicate classes of documents: DartMinHash signatures, banded joins, exact checks.

Texts with equal shingle multisets are one node. Nodes that share a band key are candidates; a link is
a pair whose exact weighted Jaccard similarity is at least ``threshold``; classes are the connected
components. Of a bucket, all pairs are never formed as rows: inside a task the signatures of a bucket
are compared, and only the edges of a spanning forest over the members' components go on to the exact
check, by steps of the estimate and about the node of lowest rank first, so that the buckets of a group of
near copies propose the same pairs (estimates of NEAR and more; other ranks and picks in each round). When a round finds
no link any more, every pair of estimate SURE_NEAR and more that still stands in two components goes to
the exact check as well, once.

A bucket of more than BLOCK nodes is dealt into blocks anew in each round, and a block is compared with itself
only, so a round is linear in the bucket. Near copies of one text grow together in that way, and a bucket
whose nodes are all in one component is done. In the last round a large bucket that still holds several
is cut into smaller ones, by each run of SUB_ROWS coordinates: nodes that share none of the SUBS runs are not compared (of
similarity 0.8: one pair in 300,000). Only there, nodes of one small bucket are compared block by block.

At similarity 0.8 a pair shares a band with probability above 0.999 and has an estimate below NEAR
with probability 0.0001, below SURE_NEAR with 0.006.

Defined cases: a null text counts as empty; texts without a word are equal, and so one class. Nodes are
named by their text's digest, never by an id: rows that share an id, or have none, are linked by their
texts alone. The class id is the smallest id of the class, null if it has none; different classes may
share it then, and class_key tells them apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import bounded_batches, by_value, cut_lineage
from umbra.llm.components import components
from umbra.llm.darts import Shingler, agreement, band_keys, chunks, digests, mix, multisets, signatures, similarity

by_value(__name__)

COORDINATES, ROWS, BANDS = 160, 8, 48
THRESHOLD = 0.8
NEAR, SURE_NEAR = 0.68, 0.72
#: Estimates of SURE and more are alike for the order of checks, lower ones by steps of STEP.
SURE, STEP = 0.86, 0.06
ROUNDS = 5
FIRST_SKIPS = 4         # the first round leaves out one bucket of so many
BLOCK = 1024
#: Coordinates of a run by which large buckets are cut, and the runs of a signature.
SUB_ROWS = 5
SUBS = COORDINATES // SUB_ROWS
#: Most ids that are broadcast to find the texts of candidates; more are joined by a shuffle.
BROADCAST_IDS = 500_000
NO_ID = -(1 << 63)


def sketch(docs: DataFrame) -> DataFrame:
    """id, text_key, digest (one, two), band keys and signature (a byte a coordinate) of each row (id, text_key, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        shingler = Shingler()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            one, two = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            keys, low = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), COORDINATES), np.uint8)
            for lo, hi in chunks(texts):
                own, h, count = multisets(*shingler.shingles(texts[lo:hi]))
                one[lo:hi], two[lo:hi] = digests(hi - lo, own, h, count)
                sig = signatures(hi - lo, own, h, count, COORDINATES)
                keys[lo:hi], low[lo:hi] = band_keys(sig, BANDS, ROWS), (mix(sig) >> np.uint64(56)).astype(np.uint8)
            flat = pa.array(keys.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_key"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), flat),
                 pa.array([x.tobytes() for x in low], pa.binary())],
                ["id", "text_key", "one", "two", "keys", "sig"])

    return docs.select("id", "text_key", "text").mapInArrow(
        run, "id long, text_key binary, one long, two long, keys array<long>, sig binary")


def text_key(text: Column) -> Column:
    """What tells a row's text from every other; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """id, hashes (distinct, sorted as unsigned) and counts of each row (id, text)."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        shingler = Shingler()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                own, h, count = multisets(*shingler.shingles(texts[lo:hi]))
                at = pa.array(np.searchsorted(own, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))),
                     pa.ListArray.from_arrays(at, pa.array(count.astype(np.int32)))], ["id", "h", "n"])

    return rows.select("id", "text").mapInArrow(run, "id long, h array<long>, n array<int>")


def checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with whether they are at least ``threshold`` similar."""
    def run(batches):
        for b in batches:
            ok = []
            cols = [b.column(c) for c in ("ha", "na", "hb", "nb")]
            for r in range(b.num_rows):
                ha, na, hb, nb = (c[r].values.to_numpy() for c in cols)
                ok.append(similarity(ha.view(np.uint64), na, hb.view(np.uint64), nb) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    one = sets.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    two = sets.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    full = pairs.join(one, "a").join(two, "b")
    return full.select("a", "ha", "na", "b", "hb", "nb").mapInArrow(run, "a long, b long, ok boolean")


def forest(est: np.ndarray, first: np.ndarray, second: np.ndarray, part_x: np.ndarray, part_y: np.ndarray) -> list[int]:
    """Positions of the pairs that join components: by steps of the estimate, in each step those of the
    node of lowest rank first (``first``, ``second``: the lower and the higher rank of each pair). Ranks are
    the same in all buckets, so the buckets that a group of near copies shares propose the same pairs, a
    star about one of its nodes, instead of pairs of their own."""
    up: dict = {}

    def find(p):
        while up.get(p, p) != p:
            up[p] = up.get(up[p], up[p])
            p = up[p]
        return p

    out = []
    step = np.floor(np.minimum(est, SURE) / STEP + 1e-9)
    for i in np.lexsort((second, first, -step)):
        a, b = find(int(part_x[i])), find(int(part_y[i]))
        if a != b:
            up[a] = b
            out.append(i)
    return out


def proposals(live: DataFrame, turn: int, every: bool) -> DataFrame:
    """Pairs (a, b) to check: a spanning forest for each bucket block, or ``every`` near pair, each from the
    first band (and run) that it shares. ``live``: key, sub, one, two (the blocks that meet), side, id, part, sig, keys."""
    def groups(batches):
        held: list = []
        for b in batches:
            cols = [b.column(c) for c in ("key", "sub", "one", "two", "side", "id", "part")]
            num = [c.to_numpy() for c in cols]
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            keys = np.array(b.column("keys").to_pylist(), np.int64).reshape(-1, BANDS) if every else np.zeros((len(sig), 0), np.int64)
            edge = np.flatnonzero(np.logical_or.reduce([n[1:] != n[:-1] for n in num[:4]])) + 1
            cuts = [0, *edge.tolist(), len(sig)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                name = tuple(int(n[lo]) for n in num[:4])
                piece = [*(n[lo:hi] for n in num[4:]), sig[lo:hi], keys[lo:hi]]
                if held and held[0] == name:
                    held[1].append(piece)
                else:
                    if held:
                        yield held
                    held = [name, [piece]]
        if held:
            yield held

    def run(batches):
        out_a, out_b = [], []
        for (key, sub, one, two), pieces in groups(batches):
            side, ids, part, sig, keys = (np.concatenate(c) for c in zip(*pieces))
            if one == two:
                left = right = np.arange(len(ids))
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            est = agreement(sig[left], sig[right])
            ok = (est >= (SURE_NEAR if every else NEAR)) & (part[left][:, None] != part[right][None, :])
            if one == two:
                ok &= left[:, None] < right[None, :]
            i, j = np.nonzero(ok)
            x, y = left[i], right[j]
            if every:
                take = []
                if len(x):
                    first = keys[x, (keys[x] == keys[y]).argmax(axis=1)] == key
                    if sub >= 0:
                        runs = (sig[x] == sig[y]).reshape(-1, SUBS, SUB_ROWS).all(axis=2)
                        first &= runs.argmax(axis=1) == sub >> 40
                    take = np.flatnonzero(first)
            else:
                e = est[i, j]
                if turn:        # other picks than before
                    low, high = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                    e = e + (mix(low.view(np.uint64) ^ mix(high.view(np.uint64) + np.uint64(turn))) >> np.uint64(40)) * (0.08 / (1 << 24))
                rank = mix(ids.view(np.uint64) + np.uint64(turn))
                take = forest(e, np.minimum(rank[x], rank[y]), np.maximum(rank[x], rank[y]), part[x], part[y])
            for t in take:
                a, b = int(ids[x[t]]), int(ids[y[t]])
                out_a.append(min(a, b)); out_b.append(max(a, b))
            if len(out_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    order = ["key", "sub", "one", "two"]
    cols = [*order, "side", "id", "part", "sig", "keys"]
    return live.select(*cols).repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(run, "a long, b long").distinct()


def in_blocks(live: DataFrame, turn: int) -> DataFrame:
    """Rows (key, n, id, ...) of buckets with ``sub``, ``one``, ``two``, ``side``: each row once, in the block that it is dealt to in this round."""
    blocks = F.when(F.col("n") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK)).cast("long")
    own = F.pmod(F.xxhash64("id", F.lit(turn)), blocks)
    return live.withColumns({"sub": F.lit(-1).cast("long"), "one": own, "two": own, "side": F.lit(0)})


def in_runs(live: DataFrame) -> DataFrame:
    """The same for the last round, in which all pairs of two components meet: large buckets are cut by runs of coordinates."""
    small = live.where(F.col("n") <= BLOCK).select("*", F.lit(-1).cast("long").alias("sub"), F.lit(1).cast("long").alias("_blocks"))
    runs = F.transform(F.sequence(F.lit(0), F.lit(SUBS - 1)), lambda s: F.shiftleft(s.cast("long"), 40).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64(F.substring("sig", s * SUB_ROWS + 1, F.lit(SUB_ROWS))), 24)))
    large = live.where(F.col("n") > BLOCK).withColumn("sub", F.explode(runs))
    sizes = large.groupBy("key", "sub").agg(F.count("*").alias("_n"), F.min("part").alias("_lo"), F.max("part").alias("_hi")).where("_lo < _hi")
    large = large.join(sizes, ["key", "sub"]).withColumn("_blocks", F.when(F.col("_n") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("_n") / (BLOCK // 2))).cast("long"))
    rows = small.unionByName(large.drop("_n", "_lo", "_hi")).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return rows.withColumns({"one": F.least("_own", "_other"), "two": F.greatest("_own", "_other"),
                             "side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_blocks", "_own", "_other")


def _named(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` (one, two, ...) with the name of their node: one, or a hash of both where two nodes of ``marks`` share it."""
    # of n nodes, about n * n / 2**65 share it
    clash = marks.groupBy("one").agg(F.min("two").alias("_lo"), F.max("two").alias("_hi")).where("_lo < _hi").select("one", F.lit(True).alias("_clash"))
    named = rows.join(F.broadcast(cut_lineage(clash)), "one", "left")
    return named.withColumn("node", F.when(F.col("_clash"), F.xxhash64("one", "two")).otherwise(F.col("one"))).drop("_clash")


def _labelled(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, one, two), and for each digest its class_key, the class_id, and first_key, the text_key of the class's first row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("text_key"))
    marks = cut_lineage(sketch(rows))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
    # one node for each multiset; its text is that of its first row
    nodes = marks.groupBy("one", "two").agg(first, F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = cut_lineage(_named(nodes, marks).select(F.col("node").alias("id"), "one", "two", "first", "keys", "sig"))
    by_key = nodes.select("id", F.explode("keys").alias("key")).distinct().repartition("key")
    sizes = by_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(by_key.join(sizes, "key").select("key", "n", "id"))
    need = members.select("id").distinct()
    need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
    looks = nodes.join(need, "id", "left_semi").select("id", "sig", "keys")
    own = nodes.join(need, "id", "left_semi").select(F.col("id").alias("node"), F.coalesce("first.id", F.lit(NO_ID)).alias("_i"), F.col("first.text_key").alias("text_key"))
    own = F.broadcast(own) if own.count() <= BROADCAST_IDS else own
    texts = rows.withColumn("_i", F.coalesce("id", F.lit(NO_ID))).join(own, ["_i", "text_key"])
    sets = cut_lineage(shingle_sets(texts.select(F.col("node").alias("id"), "text").dropDuplicates(["id"])))
    tested = links = marks.sparkSession.createDataFrame([], "a long, b long")
    labels = marks.sparkSession.createDataFrame([], "id long, label long")
    turn, every = 0, False
    while True:
        # near copies share many bands, and one that joins them is enough: the first round leaves out a part of the buckets
        use = members.where(F.pmod(F.xxhash64("key"), F.lit(FIRST_SKIPS)) != 0) if not turn else members
        parts = cut_lineage(use.join(labels, "id", "left").select("key", "n", "id", F.coalesce("label", "id").alias("part")))
        split = parts.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        live = parts.join(split, "key").join(looks if every else looks.withColumn("keys", F.lit(None).cast("array<long>")), "id")
        pairs = cut_lineage(proposals(in_runs(live) if every else in_blocks(live, turn), turn, every).join(tested, ["a", "b"], "left_anti"))
        now = cut_lineage(checked(pairs, sets, threshold))
        tested = tested.unionByName(now.select("a", "b"))
        found = now.where("ok").select("a", "b")
        new = not found.isEmpty()
        if new:
            links = links.unionByName(found)
            labels = components(links)
        if every:
            break
        turn += 1
        every = not new or turn == ROUNDS
    parts = nodes.join(labels, "id", "left").select("id", "one", "two", F.coalesce("label", "id").alias("class_key"), "first")
    best = parts.groupBy("class_key").agg(F.min(F.struct("first.none", "first.id", "one", "two", "first.text_key")).alias("best"))
    of = parts.join(best, "class_key").select("one", "two", "class_key", F.col("best.id").alias("class_id"), F.col("best.text_key").alias("first_key"))
    return marks.select("id", "one", "two"), cut_lineage(of)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_key of each row (doc_id, text); equal rows give equal rows."""
    marks, of = _labelled(docs, threshold)
    return marks.join(of, ["one", "two"]).select(F.col("id").alias("doc_id"), "class_id", "class_key")


def first_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key of one row (doc_id, text) of each class: the first by id, rows without an id last, then by digest."""
    return _labelled(docs, threshold)[1].select(F.col("class_id").alias("doc_id"), F.col("first_key").alias("text_key")).distinct()
