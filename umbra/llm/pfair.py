"""Mixing sources to target weights by Pfair scheduling of source blocks.

Each source's documents, in a hashed order, form blocks of ``block_docs``. Time is cut into slots of one
block. With weight w, an exact fraction, the i-th block of a source may start at slot floor((i - 1) / w) and must be
done by slot ceil(i / w); at each slot the released block with the earliest deadline runs. The weights add up to
one, so every block meets its window: at every slot up to the first at which a source has run out (``in_mix``), a
source has run less than one block more or less than its weight asks for. Later slots of such a source stay empty,
and the others keep their windows.

The rule is one at every size of the table and for any number of sources. Sources of the same weight and size have the
same windows, so the schedule takes one entry a class of them (with tempered sizes at most as many as the root of twice
the rows); the driver sees these classes alone. Each slot depends on the one before, so one task makes the schedule, as
a stream of one row a block. It is joined to the rows by source and block.

Every row is scheduled, none is dropped or repeated. Defined cases: rows with a null source form a source
of their own; an empty table gives an empty result; rows that repeat an id are separate rows, and equal
rows share the positions among them in any order (many equal rows, also without id, are spread over groups). Sources
without a target weight get the least weight. Places depend on the rows alone, not on their partitions.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.base import by_value, cut_lineage, packed
from umbra.operators.ranks import running
from umbra.session import Stages

by_value(__name__)

BLOCK_DOCS = 16
#: Bounds that a caller may set for a coarser schedule: the most slots (blocks grow), the most sources (those that share a
#: hash of their name are scheduled as one). Without them no size of the table changes the rule.
SLOTS: int | None = None
MAX_SOURCES: int | None = None
#: Rows of one sorted group of a source, and groups that are added up together.
GROUP_ROWS, GROUPS = 128, 1024
#: Rows of the schedule that its task holds at once.
PLAN_ROWS = 1 << 16
LONG_MAX = (1 << 63) - 1


def shares(weights: list) -> list[int]:
    """Whole numbers in exact proportion to the weights (numbers above 0)."""
    exact = [Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("a target weight is above 0")
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    whole = [int(w * scale) for w in exact]
    common = math.gcd(*whole) if whole else 1
    return [w // common for w in whole]


def window(i: int, share: int, total: int) -> tuple[int, int]:
    """Release and deadline of the i-th block (from 1) of a source with weight share/total."""
    return (i - 1) * total // share, -(-i * total // share)


def planned(share: list[int], blocks: list[int], members: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(class, member, block from 0, release, deadline, slot) of every block by earliest deadline first; a class has
    ``members`` sources of one share and number of blocks. Slots without a released block are passed over.

    The members' i-th blocks are ready together and come before all their later ones, so one entry stands for them."""
    total = sum(a * m for a, m in zip(share, members))
    later = [(0, c, 1) for c, n in enumerate(blocks) if n]       # (release, class, block)
    heapq.heapify(later)
    ready, slot = [], 0
    while later or ready:
        if not ready and later[0][0] > slot:
            slot = later[0][0]
        while later and later[0][0] <= slot:
            release, c, i = heapq.heappop(later)
            heapq.heappush(ready, (window(i, share[c], total)[1], c, release, i, 0))
        deadline, c, release, i, m = ready[0]
        yield c, m, i - 1, release, deadline, slot
        if m + 1 < members[c]:
            heapq.heapreplace(ready, (deadline, c, release, i, m + 1))
        else:
            heapq.heappop(ready)
            if i < blocks[c]:
                heapq.heappush(later, (window(i + 1, share[c], total)[0], c, i + 1))
        slot += 1


def horizon(share: list[int], blocks: list[int], members: list[int]) -> int:
    """The slot up to which no source has run out."""
    total = sum(a * m for a, m in zip(share, members))
    return min((window(n + 1, a, total)[1] - 1 for a, n in zip(share, blocks)), default=0)


def schedule(share: list[int], blocks: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(source, block from 0, release, deadline, slot) of every block, each source a class of its own, and the ``horizon``."""
    one = [1] * len(share)
    return [(s, *rest) for s, _, *rest in planned(share, blocks, one)], horizon(share, blocks, one)


def block_size(rows: int) -> int:
    """Documents of a block: the same number at every size, unless the caller has bounded the slots."""
    return BLOCK_DOCS if SLOTS is None else max(BLOCK_DOCS, -(-rows // SLOTS))


def source_key(source: Column) -> Column:
    """A text that tells a null source from every other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def tempered(counts: dict, power: float) -> dict:
    """Target weights in proportion to a power of the sources' sizes."""
    return {s: n ** power for s, n in counts.items()}


def _spread(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``_salt``: the number of a row among its equals, by GROUP_ROWS (0 where there are no more of them)."""
    many = keyed.groupBy("_s", "_h").agg(F.count("*").alias("_many")).where(F.col("_many") > GROUP_ROWS)
    if many.isEmpty():
        return keyed.withColumn("_salt", F.lit(0).cast("long"))
    # written, so that the numbers do not change if a task runs again
    rows = cut_lineage(keyed.withColumn("_nr", F.monotonically_increasing_id()))
    # numbered inside each partition's run of up to 2^14 rows; one row a run is added up
    equal = rows.select("_s", "_h", "_nr", F.shiftright("_nr", 14).alias("_run")).join(many.select("_s", "_h"), ["_s", "_h"], "left_semi")
    before = Window.partitionBy("_s", "_h").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = equal.groupBy("_s", "_h", "_run").agg(F.count("*").alias("_n")).select("_s", "_h", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_s", "_h", "_run").orderBy("_nr"))
    salts = equal.withColumn("_nth", nth).join(runs, ["_s", "_h", "_run"]).select("_nr", F.floor((F.col("_first") + F.col("_nth") - 1) / GROUP_ROWS).alias("_salt"))
    return rows.join(salts, "_nr", "left").withColumn("_salt", F.coalesce("_salt", F.lit(0).cast("long"))).drop("_nr")


class _Weighted:
    """The sources of a table with their target weights.

    ``table``: _s, n and what else the ``aggs`` make, _c (class: sources of one weight and size), _m (member of the class, by name).
    ``share``, ``blocks``, ``members``: by class. ``key``: the source of a row of ``rows``, which has its name as _s."""

    def __init__(self, rows: DataFrame, weights: dict | None, power: float, block_docs: int | None, *aggs: Column):
        spark, self.key = rows.sparkSession, F.col("_s")
        count = lambda key: cut_lineage(rows.groupBy(key.alias("_s")).agg(F.count("*").alias("n"), *aggs))
        sizes = count(self.key)
        if MAX_SOURCES is not None and sizes.count() > MAX_SOURCES:
            self.key = F.concat(F.lit("#"), F.pmod(F.xxhash64("_s"), F.lit(MAX_SOURCES)).cast("string"))
            sizes = count(self.key)
        kinds: list = []
        if weights is None:
            sizes = sizes.withColumn("_w", F.lit(-1).cast("long"))
        else:
            named = {"null" if s is None else f"={s}": w for s, w in weights.items() if w}
            kinds = [min((w for w in named.values() if w > 0), default=1.0)]        # the first: for sources without a weight
            kinds += sorted(set(named.values()) - set(kinds))
            of = spark.createDataFrame([(s, kinds.index(w)) for s, w in named.items()], "_s string, _w long")
            sizes = sizes.join(of, "_s", "left").withColumn("_w", F.coalesce("_w", F.lit(0).cast("long")))
        got = sorted((r["_w"], r["n"], r["members"]) for r in sizes.groupBy("_w", "n").agg(F.count("*").alias("members")).collect())     # one row a class
        self.members = [m for *_, m in got]
        self.block_docs = block_docs or block_size(sum(n * m for _, n, m in got))
        self.share = shares([n ** power if weights is None else kinds[w] for w, n, _ in got])
        self.blocks = [-(-n // self.block_docs) for _, n, _ in got]
        starts, at = [], 0
        for c, (w, n, m) in enumerate(got):
            starts.append((w, n, c, at))
            at += m
        stages = Stages(spark)
        ranked = running(sizes, ["_w", "n", "_s"], F.lit(1), stages)
        starts = spark.createDataFrame(starts, "_w long, n long, _c long, _start long")
        self.table = cut_lineage(ranked.join(starts, ["_w", "n"]).withColumn("_m", F.col("before") - F.col("_start")).drop("before", "_start", "_w"))
        stages.release()

    def horizon(self) -> int:
        return horizon(self.share, self.blocks, self.members)

    def plan(self) -> DataFrame:
        """The schedule, made and written by one task in batches: one row a block."""
        share, blocks, members = self.share, self.blocks, self.members
        names = ["_c", "_m", "_block", "mix_release", "mix_deadline", "mix_slot"]

        def make(batches):
            for _ in batches:
                pass
            plan = planned(share, blocks, members)
            while part := list(islice(plan, PLAN_ROWS)):
                yield pd.DataFrame(part, columns=names).astype("int64")

        return cut_lineage(self.table.sparkSession.range(1, numPartitions=1).mapInPandas(make, ", ".join(f"{n} long" for n in names)))


def scheduled(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_docs: int | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id, source and any other columns) as a struct ``_row``, with mix_block, mix_release, mix_deadline, mix_slot,
    mix_position (the row's place in the interleaved order) and in_mix (the weights hold up to its slot).

    ``weights``: target weight by source name; by default they are tempered sizes."""
    sources = _Weighted(docs.select(source_key(F.col("source")).alias("_s")), weights, power, block_docs)
    block_docs, one = sources.block_docs, ["_c", "_m"]

    # the place of a row in its source: its group's rows before it, and the rows of the groups before
    keyed = _spread(packed(docs, _id=F.col("doc_id"), _s=source_key(F.col("source")), _h=F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])))
    group = F.pmod(F.xxhash64("_id", "_h", "_salt", F.lit(9)), F.ceil(F.col("n") / GROUP_ROWS)).alias("_g")
    keyed = keyed.withColumn("_s", sources.key).join(sources.table, "_s").select("_row", "_id", "_h", *one, group)
    filled = keyed.groupBy(*one, "_g").agg(F.count("*").alias("_n")).withColumn("_gg", F.floor(F.col("_g") / GROUPS))
    before = lambda by, nth: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = filled.groupBy(*one, "_gg").agg(F.sum("_n").alias("_n")).select(*one, "_gg", before(one, "_gg").alias("_far"))
    groups = filled.withColumn("_near", before([*one, "_gg"], "_g")).join(parts, [*one, "_gg"]).select(*one, "_g", "_n", (F.col("_far") + F.col("_near")).alias("_before"))

    # the few blocks that a group has rows of, as an array: the rows themselves are dealt out once
    block = lambda at: F.floor(at / block_docs)
    spans = groups.withColumn("_block", F.explode(F.sequence(block(F.col("_before")), block(F.col("_before") + F.col("_n") - 1))))
    spans = spans.join(sources.plan(), [*one, "_block"])
    spans = spans.groupBy(*one, "_g", "_before").agg(F.sort_array(F.collect_list(F.struct("_block", "mix_release", "mix_deadline", "mix_slot"))).alias("_plan"))
    inside = Window.partitionBy(*one, "_g").orderBy(F.xxhash64("_id", F.lit(10)), "_id", "_h")
    rows = keyed.withColumn("_nth", F.row_number().over(inside)).join(spans, [*one, "_g"]).withColumn("_at", F.col("_before") + F.col("_nth") - 1)
    rows = rows.withColumn("_p", F.element_at("_plan", (block(F.col("_at")) - block(F.col("_before")) + 1).cast("int")))
    return rows.select("_row", F.col("_p._block").alias("mix_block"), "_p.mix_release", "_p.mix_deadline", "_p.mix_slot",
                       (F.col("_p.mix_slot") * block_docs + F.col("_at") % block_docs).alias("mix_position"),
                       (F.col("_p.mix_slot") < min(sources.horizon(), LONG_MAX)).alias("in_mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the interleaved order, with its own columns alone. Written as a table, its files and their rows hold that
    order, which ``placed`` reads."""
    return scheduled(docs, **options).orderBy("mix_position").select("_row.*")


def placed(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_docs: int | None = None) -> DataFrame:
    """Each row of ``docs``, a table that holds what ``mixed`` gave, as a struct ``_row``, with mix_position (the number of rows
    before it, in the order of the files and of their rows) and in_mix (as ``scheduled`` has it, for the same weights).

    The order is that of the table alone, whoever mixed it; rows that are not read from files are written first."""
    def located(df):
        at = df.metadataColumn("_metadata")
        return packed(df, _s=source_key(F.col("source")), _file=at["file_name"], _index=at["row_index"])
    try:
        rows = located(docs)
    except AnalysisException:
        rows = located(cut_lineage(docs))
    files = rows.groupBy("_file", F.regexp_extract("_file", r"part-(\d+)", 1).cast("long").alias("_part")).agg((F.max("_index") + 1).alias("n"))
    starts, n = [], 0
    for r in sorted(files.collect(), key=lambda r: (r["_part"] is not None, r["_part"] or 0, r["_file"])):      # one row a file
        starts.append((r["_file"], n))
        n += r["n"]
    starts = docs.sparkSession.createDataFrame(starts, "_file string, _start long")
    rows = rows.join(F.broadcast(starts), "_file").withColumn("mix_position", F.col("_start") + F.col("_index"))
    return rows.select("_row", "mix_position", (F.col("mix_position") < _held(rows, weights, power, block_docs)).alias("in_mix"))


def _held(rows: DataFrame, weights: dict | None, power: float, block_docs: int | None) -> int:
    """The rows in the slots before the horizon. All these slots have a block, each full but for the last of a source that ends there."""
    sources = _Weighted(rows.select("_s", "mix_position"), weights, power, block_docs, (F.max("mix_position") + 1).alias("_end"))
    size, stages = sources.block_docs, Stages(rows.sparkSession)
    places = min(sources.horizon() * size, LONG_MAX)
    short = sources.table.withColumn("_short", F.pmod(-F.col("n"), F.lit(size))).where("_short > 0")
    ended = running(short, ["_end"], F.col("_short"), stages).select("_end", (F.col("before") + F.col("_short")).alias("_empty"))
    empty = ended.where(F.col("_end") + F.col("_empty") <= places).agg(F.max("_empty").alias("_empty")).first()["_empty"]
    stages.release()
    return places - (empty or 0)
