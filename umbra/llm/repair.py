"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. A node of the lattice is a
number of rows read and a state of that pattern; edges keep, re-role or delete the next row or insert one.
Forward and reverse heaps settle nodes by cost until no cheaper or equal path can be left; every
edge that joins the two sides at the least cost is a crossing, and the least concatenated audit wins.

Rows are sorted by range into tasks. A conversation that lies whole inside a task and has at most
``BLOCK`` rows is finished there. Others are cut into blocks, which may lie in different tasks: a block is
solved from every state to every state, the blocks' costs are chained for each conversation, and the chosen
pieces are applied to the blocks' rows. So a conversation of any length costs its tasks a block of rows at a
time; what one task gets of it is a row a block. (Its digest runs over its whole text by definition: one task reads
that in order, a block at a time, and its audit is one value.)

Defined results: a null in any column counts as one space (in the key of the damage, as role and as text; a null
turn sorts first and is no turn for ``gaps``; rows without conv_id are one conversation). Rows of
the same turn are ordered by role, then text. An empty role has no initial and is never kept. Empty texts are blank.
An empty table gives no rows; a conversation without rows after the damage gives zeros.
"""

from __future__ import annotations

import hashlib
import heapq
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import by_value, bounded_batches, cut_lineage
from umbra.session import Stages

BLOCK = 256                     # rows of a block
BLOCK_BYTES = 4 << 20           # characters of its texts, after which a block ends early
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5     # costs
FULL = {"u": "user", "a": "assistant"}
#: States: nothing yet, after a system row, after a user row, after an assistant row. state -> initial -> state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The initial that an inserted or re-roled row has after each state, and the state it leads to.
OWN, TO = "uuau", (2, 2, 3, 2)
ACCEPT = (0, 3)
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]     # that a path can join
LEGAL = {"su", "ua", "au"}

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECES = """conv_id long, done boolean, part int, nth int, first_turn long, last_turn long, turns long, first_role string, last_role string,
    gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string,
    costs array<long>, audits array<string>, roles array<string>, texts array<string>"""

by_value(__name__)


# --- the lattice -------------------------------------------------------------------------------------------

#: A row of the lattice: initial of its role, whether it must go, what keeping its text costs.
Row = tuple[str, bool, int]


def _ahead(rows: list[Row], i: int, q: int):
    """Edges that leave a node: (cost, edit, i, state)."""
    yield INSERT, "I", i, TO[q]
    if i < len(rows):
        initial, must_go, extra = rows[i]
        yield DELETE, "D", i + 1, q
        if not must_go:
            if initial in NEXT[q]:
                yield KEEP + extra, "K", i + 1, NEXT[q][initial]
            yield REROLE + extra, "R", i + 1, TO[q]


_FROM = tuple(tuple(p for p in range(4) if TO[p] == q) for q in range(4))
_KEPT_FROM = tuple({x: tuple(p for p in range(4) if NEXT[p].get(x) == q) for x in "sua"} for q in range(4))


def _back(rows: list[Row], i: int, q: int):
    """Edges that enter a node, in the same form."""
    for p in _FROM[q]:
        yield INSERT, "I", i, p
    if i:
        initial, must_go, extra = rows[i - 1]
        yield DELETE, "D", i - 1, q
        if not must_go:
            for p in _KEPT_FROM[q].get(initial, ()):
                yield KEEP + extra, "K", i - 1, p
            for p in _FROM[q]:
                yield REROLE + extra, "R", i - 1, p


def cheapest(rows: list[Row], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits that lead from state ``entry`` to one of ``exits``.

    Within one cost, nodes are settled in the direction of travel: edges without cost always read a row,
    so a node's label (cost, audit) is the least one when it is settled."""
    if not rows:
        return (0, "") if entry in exits else None
    n = len(rows)
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    behind: dict[tuple[int, int], tuple[int, str]] = {(n, q): (0, "") for q in exits}
    done_ahead: dict[tuple[int, int], tuple[int, str]] = {}
    done_behind: dict[tuple[int, int], tuple[int, str]] = {}
    heap_ahead, heap_behind = [(0, 0, "", entry)], [(0, -n, "", q) for q in exits]
    heapq.heapify(heap_behind)
    best: tuple[int, str] | None = None

    def crossing(left, edit, right, cost):
        nonlocal best
        total = left[0] + cost + right[0]
        if best is None or total <= best[0]:
            found = (total, left[1] + edit + right[1])
            if best is None or found < best:
                best = found

    while heap_ahead and heap_behind and (best is None or heap_ahead[0][0] + heap_behind[0][0] <= best[0]):
        if heap_ahead[0][0] <= heap_behind[0][0]:
            c, i, audit, q = heapq.heappop(heap_ahead)
            if (i, q) in done_ahead:
                continue
            label = done_ahead[i, q] = (c, audit)
            for w, edit, j, p in _ahead(rows, i, q):
                if (j, p) in done_behind:
                    crossing(label, edit, done_behind[j, p], w)
                if (j, p) not in done_ahead:
                    new = (c + w, audit + edit)
                    if (j, p) not in ahead or new < ahead[j, p]:
                        ahead[j, p] = new
                        heapq.heappush(heap_ahead, (new[0], j, new[1], p))
        else:
            c, i, audit, q = heapq.heappop(heap_behind)
            i = -i
            if (i, q) in done_behind:
                continue
            label = done_behind[i, q] = (c, audit)
            for w, edit, j, p in _back(rows, i, q):
                if (j, p) in done_ahead:
                    crossing(done_ahead[j, p], edit, label, w)
                if (j, p) not in done_behind:
                    new = (c + w, edit + audit)
                    if (j, p) not in behind or new < behind[j, p]:
                        behind[j, p] = new
                        heapq.heappush(heap_behind, (new[0], -j, new[1], p))
    return best


def apply(audit: str, entry: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """``role:text`` of the rows after the edits, and the state that they end in."""
    out, at, q = [], 0, entry
    for edit in audit:
        if edit == "I":
            out.append(FULL[OWN[q]] + ":")
            q = TO[q]
            continue
        if edit == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            q = NEXT[q][roles[at][:1]]
        elif edit == "R":
            out.append(f"{FULL[OWN[q]]}:{texts[at]}")
            q = TO[q]
        at += 1
    return out, q


# --- conversations in Spark --------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after the damage; copies of a row are adjacent."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                shown("role").alias("role"), shown("text").alias("text"), key.alias("_d")).where("_d <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_d") == 3, 2).otherwise(1).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, again: one row each, ``again`` if an earlier one has its role and text.

    Equal rows are counted before they are spread, and the first place of a text is joined back, so that no
    task sees all rows of one conversation or one text."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = same.withColumns({"_conv": F.coalesce(F.col("conv_id"), F.lit(0)), "_none": F.col("conv_id").isNull(),
                             "_key": F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))),
                             "_at": _place(F.col("turn"))})
    first = same.groupBy("_conv", "_none", "_key").agg(F.min("_at").alias("_first"))
    out = same.join(first, ["_conv", "_none", "_key"])
    return out.select("conv_id", "turn", "role", "text", (F.col("_at") > F.col("_first")).alias("_later"),
                      F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "conv_id", "turn", "role", "text", "copy", (F.col("_later") | (F.col("copy") > 1)).alias("again"))


def _place(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("some"), F.coalesce(turn, F.lit(0)).alias("turn"))


class _Open:
    """The rows of one conversation that a task has not written yet."""

    def __init__(self, conv, whole: bool):
        self.conv, self.whole, self.nth = conv, whole, 0
        self.clear()

    def clear(self):
        self.roles, self.texts, self.rows, self.size = [], [], [], 0
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, role: str, text: str, again: bool):
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.count["illegal"] += 1
        bare = text.rstrip(BLANKS)
        fault = "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            self.count[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.rows.append((role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK or self.size >= BLOCK_BYTES

    def finished(self) -> dict:
        """The result of a conversation that is whole."""
        cost, audit = cheapest(self.rows, 0, ACCEPT)
        lines, _ = apply(audit, 0, self.roles, self.texts)
        return {"conv_id": self.conv, "done": True, **self.count, "gaps": gaps(self.first_turn, self.last_turn, self.turns), "cost": cost,
                "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def block(self, part: int) -> dict:
        """A block: its rows, and what each pair of states costs."""
        found = [cheapest(self.rows, p, (q,)) for p, q in PAIRS]
        out = {"conv_id": self.conv, "done": False, "part": part, "nth": self.nth, **self.count, "first_turn": self.first_turn,
               "last_turn": self.last_turn, "turns": self.turns, "first_role": self.roles[0][:1], "last_role": self.roles[-1][:1],
               "costs": [x and x[0] for x in found], "audits": [x and x[1] for x in found], "roles": self.roles, "texts": self.texts}
        self.clear()
        return out


def gaps(first, last, turns: int) -> int:
    return 0 if first is None else min(last - first + 1 - turns, (1 << 63) - 1)


def _stream(batches):
    """Rows of a partition as plain tuples, in order."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batches(rows, schema: pa.Schema, many: int, size=lambda row: 0):
    """Rows (dicts) as batches of at most ``many`` rows, or about 16 million characters."""
    held, room = [], 1 << 24
    for row in rows:
        held.append({name: row.get(name) for name in schema.names})
        room -= size(row)
        if len(held) >= many or room <= 0:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, room = [], 1 << 24
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.replace("\n", " ").split(","))])


def pieces(rows: DataFrame) -> DataFrame:
    """Finished conversations (``done``) and blocks of the others, from the rows of ``marked``."""
    def cut(batches):
        part, now = TaskContext.get().partitionId(), None
        first = True
        for conv, turn, role, text, _, again in _stream(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    if now.rows:
                        yield now.finished() if now.whole and not now.nth else now.block(part)
                    first = False
                now = _Open(conv, not first)
            if now.full():                          # and more rows follow
                yield now.block(part)
                now.nth += 1
            now.add(turn, role, text, again)
        if now is not None:
            yield now.block(part)                   # it may go on in the next partition

    def run(batches):
        yield from _batches(cut(batches), schema, 1024, lambda x: sum(map(len, x.get("texts") or ())))

    schema = _arrow(_PIECES)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PIECES)


_CHAIN = """conv_id long, part int, nth int, entry int, audit string,
    gaps long, blank long, duplicate long, truncated long, illegal long, cost long"""


def chained(blocks: DataFrame) -> DataFrame:
    """For each block its entry state and audit (``part`` not null), for each conversation its counts and cost."""
    names = ["conv_id", "part", "nth", "first_turn", "last_turn", "turns", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal", "costs", "audits"]
    schema = _arrow(_CHAIN)

    def close(conv, path, ways, total):
        """``path``: for each block, for each state at its end the state at its entry and the audit between."""
        q = min((ways[q], q) for q in ACCEPT if q in ways)[1]
        cost = ways[q][0]
        for part, nth, came in reversed(path):
            q, audit = came[q]
            yield {"conv_id": conv, "part": part, "nth": nth, "entry": q, "audit": audit}
        yield {"conv_id": conv, "cost": cost, "gaps": gaps(total["first"], total["last"], total["turns"]),
               **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}}

    def chain(batches):
        begun, conv, path, ways, total = False, None, [], {}, {}
        for row in (dict(zip(names, x)) for x in _stream(batches)):
            if not begun or row["conv_id"] != conv:
                if begun:
                    yield from close(conv, path, ways, total)
                begun, conv, path, ways = True, row["conv_id"], [], {0: (0, "")}
                total = {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None}
            found: dict[int, tuple[int, str, int, str]] = {}
            for (p, q), cost, audit in zip(PAIRS, row["costs"], row["audits"]):
                if cost is not None and p in ways:
                    new = (ways[p][0] + cost, ways[p][1] + audit, p, audit)
                    if q not in found or new < found[q]:
                        found[q] = new
            path.append((row["part"], row["nth"], {q: (p, audit) for q, (_, _, p, audit) in found.items()}))
            shared = len(os.path.commonprefix([x[1] for x in found.values()]))      # what all ways share decides nothing
            ways = {q: (x[0], x[1][shared:]) for q, x in found.items()}
            if total["role"] is not None and total["role"] + row["first_role"] not in LEGAL:
                total["illegal"] += 1
            total["role"] = row["last_role"]
            for k in ("blank", "duplicate", "truncated", "illegal"):
                total[k] += row[k]
            if row["first_turn"] is not None:
                total["turns"] += row["turns"] - (total["last"] == row["first_turn"])
                total["first"] = row["first_turn"] if total["first"] is None else total["first"]
                total["last"] = row["last_turn"]
        if begun:
            yield from close(conv, path, ways, total)

    def run(batches):
        yield from _batches(chain(batches), schema, 1024)

    rows = blocks.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return rows.mapInArrow(run, _CHAIN)


def _digests(blocks: DataFrame, chain: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of the conversations that were cut: each read in order, a block at a time."""
    schema = _arrow("conv_id long, audit string, repaired_sha256 string")

    def read(batches):
        begun, conv, audits, sha, some = False, None, [], hashlib.sha256(), False
        for this, _, _, entry, audit, roles, texts in _stream(batches):
            if not begun or this != conv:
                if begun:
                    yield {"conv_id": conv, "audit": "".join(audits), "repaired_sha256": sha.hexdigest()}
                begun, conv, audits, sha, some = True, this, [], hashlib.sha256(), False
            audits.append(audit)
            for line in apply(audit, entry, roles, texts)[0]:
                sha.update((("\n" if some else "") + line).encode())
                some = True
        if begun:
            yield {"conv_id": conv, "audit": "".join(audits), "repaired_sha256": sha.hexdigest()}

    def run(batches):
        yield from _batches(read(batches), schema, 1024, lambda x: len(x["audit"]))

    rows = blocks.select("conv_id", "part", "nth", "roles", "texts").join(
        chain.where("part IS NOT NULL").select("part", "nth", "entry", "audit", F.col("conv_id").alias("_c")),
        ["part", "nth"]).where(F.col("conv_id").eqNullSafe(F.col("_c")))
    rows = rows.select("conv_id", "part", "nth", "entry", "audit", "roles", "texts")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return rows.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The result of every conv_id of ``conversations``, from its rows (conv_id, turn, role, text, copies)."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    stages = Stages(spark)
    cut = stages.write(pieces(stages.write(marked(rows))))
    blocks = cut.where("NOT done")
    chain = stages.write(chained(blocks))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    whole = chain.where("part IS NULL").drop("audit").join(_digests(blocks, chain).select(F.col("conv_id").alias("_c"), "audit", "repaired_sha256"),
                                                           F.col("conv_id").eqNullSafe(F.col("_c")))
    found = cut.where("done").select(*names).unionByName(whole.select(*names)).withColumnRenamed("conv_id", "_c")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    out = cut_lineage(out.select("conv_id", *[F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c in names[1:]]))
    stages.release()
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """Damages the rows of ``conversations`` and repairs every conversation."""
    return repaired(conversations, damaged(conversations))


def oracle() -> str:
    """DuckDB SQL for ``repair``: states are carried row by row, with up to two rows inserted after each."""
    line = "{'c': %s, 'a': %s, 'r': %s}"
    inserts = "(VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), " \
        "(0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']), " \
        "(0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])) AS ins(f, t, w, a, r)"
    step = "(VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS nx(f, x, t)"
    return f"""
WITH RECURSIVE bits(i, n, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, n + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE n < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
dam AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], [CAST(ord(x) AS BIGINT) for x in string_split(key, '')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS d FROM src, tab),
after AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dam WHERE d <> 0),
numbered AS (SELECT *, row_number() OVER () AS nr FROM after),
convs AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
rws AS (SELECT k, turn, role, text, left(role, 1) AS x, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, nr) AS i,
    row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, nr) > 1 AS again,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare
  FROM numbered JOIN convs ON numbered.conv_id IS NOT DISTINCT FROM convs.conv_id),
fl AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(x) OVER (PARTITION BY k ORDER BY i) || x AS pair FROM rws),
cnt AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM fl GROUP BY k),
edge AS MATERIALIZED (
  SELECT k, i, f, t, 2 AS w, 'D' AS a, [] AS r FROM fl, (VALUES (0, 0), (1, 1), (2, 2), (3, 3)) AS s(f, t)
  UNION ALL SELECT k, i, f, t, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM fl JOIN {step} USING (x)
    WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT k, i, f, t, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', [z || ':' || text]
    FROM fl, (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS s(f, t, z) WHERE fault IS NULL OR fault = 'truncated'),
moves AS MATERIALIZED (SELECT k, i, e.f AS f, ins.t AS t, e.w + ins.w AS w, e.a || ins.a AS a, list_concat(e.r, ins.r) AS r FROM edge AS e JOIN {inserts} ON e.t = ins.f),
dp(k, i, q, m) AS (
  SELECT k, 0::BIGINT, ins.t, {line % ('ins.w', 'ins.a', 'ins.r::VARCHAR[]')} FROM convs JOIN {inserts} ON ins.f = 0
  UNION ALL
  SELECT dp.k, dp.i + 1, t, min({line % ('m.c + w', 'm.a || a', 'list_concat(m.r, r)')}) FROM dp JOIN moves ON moves.k = dp.k AND moves.i = dp.i + 1 AND f = dp.q GROUP BY dp.k, dp.i, t),
fin AS (SELECT dp.k, min(m) AS m FROM dp LEFT JOIN cnt USING (k) WHERE dp.i = coalesce(n, 0) AND q IN (0, 3) GROUP BY dp.k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(m.c AS BIGINT) AS cost, m.a AS audit,
  sha256(array_to_string(m.r, chr(10))) AS repaired_sha256
FROM convs JOIN fin USING (k) LEFT JOIN cnt USING (k)"""
