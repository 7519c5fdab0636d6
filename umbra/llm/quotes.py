"""Quotation linking: quoted passages are joined to the messages they come from, as native Spark joins.

A line's leading ``>`` signs are its quote level. Lines of one level without a blank between them form a
passage. Quoted passages and their lines are normalised (lower case, single spaces) and hashed; each votes, by length,
for the message that has it as its own text: the latest earlier one of the same
conversation, else the first anywhere, if it is earlier by (conversation, turn). Votes of the lowest level that has any
decide: level 1 is what the author quoted; deeper levels, which the quoted message had quoted, count where that message
is not there. A message without a linked quote replies to the message before it in its conversation. Messages that reply to
each other form a thread; in it they stand in order of conversation and turn, so each comes after the one it replies to
(``position``). They lose their quotes and the lines that announce them. ``conversations`` gives threads as arrays.

Defined cases: equal rows are one message. Null conversations form one conversation, null turns come
first, a null text counts as empty and a null role stays null. A quote that matches nothing is dropped
from the text and counted in ``n_unlinked``. A hot conversation or line is worked on in blocks of
``BLOCK`` messages; the rows between blocks are one a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.base import cut_lineage
from umbra.operators.ranks import running
from umbra.session import Stages

NONE = -(1 << 63)
BLOCK = 256             # messages in order that are worked on together
QUOTE = r"^((?:[ \t]*>)+)"
# Endings of lines that announce a quote.
ANNOUNCES = r"(wrote|writes|schrieb|escribió|a écrit) ?:$"


def _line(line: Column) -> Column:
    mark = F.regexp_extract(line, QUOTE, 1)
    body = F.substr(line, F.length(mark) + 1)
    return F.struct((F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"), body.alias("body"),
                    F.trim(F.lower(F.regexp_replace(body, r"\s+", " "))).alias("norm"))


def parsed(messages: DataFrame) -> DataFrame:
    """key (conversation, turn, content hash), role, own text, own units, quoted units and counts of each message."""
    m = messages.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(NONE)).alias("t"),
        F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("h", F.xxhash64("role", "text")).groupBy("c", "t", "h").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    m = m.select(F.struct("c", "t", "h").alias("key"), "role", F.transform(F.split("text", "\n"), _line).alias("lines"))
    n, same = F.size("lines"), lambda i, j: (
        (F.get("lines", i)["level"] == F.get("lines", j)["level"]) & ((F.get("lines", i)["norm"] == "") == (F.get("lines", j)["norm"] == "")))
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.coalesce(same(i, i - 1), F.lit(False)))
    announces = lambda x, i: ((x["level"] == 0) & x["norm"].rlike(ANNOUNCES)
                              & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0))
    m = m.select("key", "role", "lines", starts.alias("starts"), F.transform(
        "lines", lambda x, i: F.struct(((x["level"] == 0) & ~announces(x, i)).alias("own"), x["body"].alias("body"))).alias("kept"))
    body = lambda a, j: F.slice("lines", a + 1, F.coalesce(F.get("starts", j + 1), F.size("lines")) - a)
    m = m.select("key", "role", "lines", "kept", F.transform("starts", lambda a, j: F.struct(
        F.get("lines", a)["level"].alias("level"), F.array_join(F.transform(body(a, j), lambda x: x["norm"]), " ").alias("norm"))).alias("passages"))
    units = lambda wanted: F.array_distinct(F.transform(F.filter(
        F.concat("passages", F.transform("lines", lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm")))),
        lambda x: wanted(x["level"]) & (x["norm"] != "")), lambda x: F.struct(x["level"].alias("l"), F.xxhash64(x["norm"]).alias("u"), F.length(x["norm"]).alias("w"))))
    own = F.array_join(F.transform(F.filter("kept", lambda x: x["own"]), lambda x: x["body"]), "\n")
    return m.select(
        "key", "role", F.regexp_replace(own, r"^\s+|\s+$", "").alias("own_text"), units(lambda x: x == 0).alias("own"), units(lambda x: x > 0).alias("quoted"),
        F.size(F.filter("passages", lambda x: (x["level"] > 0) & (x["norm"] != ""))).alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("levels"))


def in_order(messages: DataFrame) -> DataFrame:
    """key, b, prev of each message: its block in the order of all, and the message before it in its conversation, or null."""
    stages = Stages(messages.sparkSession)
    keys = messages.select("key", "key.c", "key.t", "key.h")
    rows = running(keys, ["c", "t", "h"], F.lit(1), stages, carry=["key"])
    out = cut_lineage(rows.select("key", F.floor(F.col("before") / BLOCK).alias("b"), F.when(F.col("prev_key.c") == F.col("c"), F.col("prev_key")).alias("prev")))
    stages.release()
    return out


def quote_parents(messages: DataFrame) -> DataFrame:
    """key, parent, n_linked, quote_level, n_found of each message (with its block ``b``) whose quotes match the own text of an earlier message."""
    quoted = messages.where(F.size("quoted") > 0).select("key", "b", F.explode_outer("quoted").alias("q")).select("key", "b", "q.l", "q.u", "q.w").where("u is not null")
    own = messages.select("key", "b", F.explode_outer("own").alias("o")).select("key", "b", "o.u").where("u is not null")
    own = own.join(quoted.select("u").distinct(), "u", "left_semi")
    # same conversation: the latest own line or passage before the quote, in order of turns
    line = quoted.select("key", "b", "l", "u", "w", F.lit(None).cast("struct<c:bigint,t:bigint,h:bigint>").alias("src")).unionByName(
        own.select("key", "b", F.lit(None).cast("int").alias("l"), "u", F.lit(None).cast("int").alias("w"), F.col("key").alias("src")))
    line = cut_lineage(line.select("*", F.col("key.c").alias("c")))
    # at one message its quotes come before its own text
    inside = Window.partitionBy("c", "u", "b").orderBy(F.col("key"), F.col("w").asc_nulls_last(), "l").rowsBetween(Window.unboundedPreceding, -1)
    blocks = line.groupBy("c", "u", "b").agg(F.max("src").alias("top"))
    earlier = Window.partitionBy("c", "u").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(blocks.select("c", "u", "b", F.max("top").over(earlier).alias("carry")))
    below = F.max(F.when(F.col("w").isNull(), F.col("src"))).over(inside)
    timeline = line.withColumn("near", below).where(F.col("w").isNotNull())
    local = timeline.join(carried, ["c", "u", "b"]).select("key", "l", "u", "w", F.coalesce("near", "carry").alias("src"))
    local = cut_lineage(local)
    first = cut_lineage(own.groupBy("u").agg(F.min("key").alias("first")))
    far = local.where("src is null").drop("src").join(first, "u").where(F.col("first") < F.col("key")).select("key", "l", "u", "w", F.col("first").alias("src"))
    votes = local.where("src is not null").unionByName(far).groupBy("key", "l", "src").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("l")).alias("level"), "w", (F.col("src.c") == F.col("key.c")).alias("near"), "src", "n"))
    return votes.groupBy("key").agg(best.alias("x"), F.sum("n").alias("n_found")).select(
        "key", F.col("x.src").alias("parent"), F.col("x.n").alias("n_linked"), (-F.col("x.level")).alias("quote_level"), "n_found")


def threads(parents: DataFrame) -> DataFrame:
    """key, root, depth of each row (key, parent). Each round, messages that have not reached their root
    take over the path of the message they have reached, so what is left of the paths halves."""
    paths = cut_lineage(parents.select("key", F.coalesce("parent", "key").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"),
                                       F.col("parent").isNull().alias("done")))
    while not paths.where("not done").isEmpty():
        over = paths.select(F.col("key").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"), F.col("done").alias("there"))
        step = paths.where("not done").join(over, "up").select(
            "key", F.col("upper").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        paths = cut_lineage(paths.where("done").unionByName(step))
    return paths.select("key", F.col("up").alias("root"), "depth")


def placed(threaded: DataFrame) -> DataFrame:
    """key, root, depth, position: places in each thread by conversation and turn, from running counts over ranges."""
    stages = Stages(threaded.sparkSession)
    flat = threaded.select("key", "root", "depth", *[F.col(f"root.{x}").alias(f"r{x}") for x in "cth"], *[F.col(f"key.{x}").alias(f"k{x}") for x in "cth"])
    rows = stages.write(running(flat, ["rc", "rt", "rh", "kc", "kt", "kh"], F.lit(1), stages).select("key", "root", "depth", "before"))
    start = rows.groupBy("root").agg(F.min("before").alias("start"))
    out = cut_lineage(rows.join(start, "root").select("key", "root", "depth", (F.col("before") - F.col("start")).alias("position")))
    stages.release()
    return out


def link(conversations: DataFrame) -> DataFrame:
    """One row for each message of ``conversations`` (conv_id, turn, role, text): its thread, place and depth in it, its
    parent, its quotes, and its text without them."""
    messages = cut_lineage(parsed(conversations))
    order = in_order(messages)
    quoted = cut_lineage(quote_parents(messages.join(order.select("key", "b"), "key")))
    parents = order.select("key", "prev").join(quoted, "key", "left").select(
        "key", F.coalesce("parent", "prev").alias("parent"), F.col("parent").isNotNull().alias("by_quote"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_linked", "quote_level", "n_found")])
    parents = cut_lineage(parents)
    out = messages.join(parents, "key").join(placed(threads(parents)), "key")
    real = lambda c, name: F.when(c != NONE, c).alias(name)
    return out.select(
        real(F.col("key.c"), "conv_id"), real(F.col("key.t"), "turn"), "role", real(F.col("root.c"), "thread_conv"), real(F.col("root.t"), "thread_turn"),
        "position", "depth", real(F.col("parent.c"), "parent_conv"), real(F.col("parent.t"), "parent_turn"), "by_quote", F.col("quote_level").cast("long").alias("quote_level"),
        F.col("n_quotes").cast("long").alias("n_quotes"), F.col("n_linked").cast("long").alias("n_linked"),
        (F.size("quoted") - F.col("n_found")).cast("long").alias("n_unlinked"), F.col("levels").cast("long").alias("levels"), "own_text")


def conversations(linked: DataFrame, part: int = BLOCK) -> DataFrame:
    """Threads of ``link`` in reply order: thread_conv, thread_turn, part, messages (position, role, text); a long thread has several
    parts of ``part`` messages, so that no row or task holds it whole."""
    rows = linked.withColumn("part", F.floor(F.col("position") / part))
    message = F.struct("position", "role", F.col("own_text").alias("text"))
    return rows.groupBy("thread_conv", "thread_turn", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))


# Which quotes a message is given by ``quoting``, by the remainder of its key: (level, turns back, edited).
GIVEN = {1: ((1, 1, False),), 2: ((1, 1, False), (2, 2, False)), 3: ((1, 1, False), (2, 2, False), (3, 3, False)), 4: ((1, 1, True),), 5: ((2, 2, False),)}
ABSENT = "a line that nobody wrote"
_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoting(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as mail that quotes: by a fixed rule five of six messages quote the messages one to three
    turns before, nested by level; some with other case and blanks, some an absent message that had quoted a present one."""
    said = conversations.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).agg(F.min("text").alias("_said"))
    rows = conversations.select("conv_id", "turn", "role", "text", F.pmod(F.col("conv_id") * 7 + F.col("turn") * 5, F.lit(6)).alias("_k"))
    for back in (1, 2, 3):
        before = said.select(F.col("_c"), (F.col("_t") + back).alias("_t"), F.col("_said").alias(f"_said{back}"))
        rows = rows.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")

    def quote(level, back, edited):
        text = F.col(f"_said{back}")
        if edited:
            text = F.replace(F.translate(text, *_LETTERS), F.lit(" "), F.lit("  "))
        mark = "> " * level
        return F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))

    head = F.lit("")
    for k, quotes in GIVEN.items():
        own = [F.lit("They wrote:\n")] + ([F.lit(f"> {ABSENT}\n")] if k == 5 else []) + [F.coalesce(quote(*q), F.lit("")) for q in quotes]
        head = F.when((F.col("_k") == k) & F.col(f"_said{quotes[0][1]}").isNotNull(), F.concat(*own)).otherwise(head)
    return rows.select("conv_id", "turn", "role", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def digest(linked: DataFrame) -> DataFrame:
    """``linked`` with the length and the digest of the text in its place."""
    return linked.select(*[c for c in linked.columns if c != "own_text"], F.length("own_text").cast("long").alias("n_chars"),
                         F.sha2("own_text", 256).alias("text_sha256"))


def quoting_sql() -> str:
    """``quoting`` in DuckDB SQL."""
    nl = "chr(10)"

    def quote(level, back, edited):
        text = f"s{back}.said"
        if edited:
            text = f"replace(translate({text}, '{_LETTERS[0]}', '{_LETTERS[1]}'), ' ', '  ')"
        mark = "> " * level
        return f"coalesce('{mark}' || replace({text}, {nl}, {nl} || '{mark}') || {nl}, '')"

    cases = " ".join(f"WHEN (c.conv_id * 7 + c.turn * 5) % 6 = {k} AND s{q[0][1]}.said IS NOT NULL THEN 'They wrote:' || {nl} || "
                     + (f"'> {ABSENT}' || {nl} || " if k == 5 else "") + " || ".join(quote(*x) for x in q) for k, q in GIVEN.items())
    joins = " ".join(f"LEFT JOIN said s{b} ON s{b}.conv_id = c.conv_id AND s{b}.turn + {b} = c.turn" for b in (1, 2, 3))
    return (f"(WITH said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY 1, 2) SELECT c.conv_id, c.turn, c.role, "
            f"CASE {cases} ELSE '' END || coalesce(c.text, '') AS text FROM conversations c {joins})")


def oracle(source: str = "conversations") -> str:
    """DuckDB SQL for ``digest(link(...))`` of ``source``, where (conv_id, turn) names a message; units are
    compared as text, not as hashes."""
    return f"""
WITH RECURSIVE m AS (SELECT DISTINCT coalesce(conv_id, {NONE}) AS c, coalesce(turn, {NONE}) AS t, role, coalesce(text, '') AS text FROM {source}),
l0 AS (SELECT c, t, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
l1 AS (SELECT c, t, i, line, regexp_extract(line, '{QUOTE}', 1) AS mark FROM l0),
l AS (SELECT c, t, i, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS body,
        trim(lower(regexp_replace(substr(line, length(mark) + 1), '\\s+', ' ', 'g'))) AS norm FROM l1),
s AS (SELECT *, lag(level) OVER q IS DISTINCT FROM level OR (lag(norm) OVER q = '') IS DISTINCT FROM (norm = '') AS fresh,
        coalesce(lead(level) OVER q, 0) AS after FROM l WINDOW q AS (PARTITION BY c, t ORDER BY i)),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY c, t ORDER BY i) AS run FROM s),
p AS (SELECT c, t, run, any_value(level) AS level, string_agg(norm, ' ' ORDER BY i) AS norm FROM r GROUP BY c, t, run),
u AS (SELECT c, t, level, norm FROM p WHERE norm <> '' UNION SELECT c, t, level, norm FROM l WHERE norm <> ''),
own AS (SELECT c, t, string_agg(body, chr(10) ORDER BY i) AS raw FROM s
        WHERE level = 0 AND NOT (regexp_matches(norm, '{ANNOUNCES}') AND after > 0) GROUP BY c, t),
stats AS (SELECT c, t, max(level) AS levels FROM l GROUP BY c, t),
quoted AS (SELECT c, t, count(*) AS n FROM p WHERE level > 0 AND norm <> '' GROUP BY c, t),
near AS (SELECT a.c, a.t, a.level, a.norm, max(b.t) AS bt FROM u a JOIN u b ON b.c = a.c AND b.t < a.t AND b.norm = a.norm AND b.level = 0 WHERE a.level > 0 GROUP BY ALL),
first AS (SELECT norm, min((c, t)) AS f FROM u WHERE level = 0 GROUP BY norm),
src AS (SELECT a.c, a.t, a.level, a.norm, CASE WHEN n.bt IS NOT NULL THEN (a.c, n.bt) WHEN f.f < (a.c, a.t) THEN f.f END AS s
        FROM u a LEFT JOIN near n USING (c, t, level, norm) LEFT JOIN first f USING (norm) WHERE a.level > 0),
lost AS (SELECT c, t, count(*) AS n FROM src WHERE s IS NULL GROUP BY c, t),
v AS (SELECT c, t, level, s, sum(length(norm)) AS w, count(*) AS n FROM src WHERE s IS NOT NULL GROUP BY c, t, level, s),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, t ORDER BY level, w DESC, (s[1] = c) DESC, s DESC) AS k FROM v) WHERE k = 1),
par AS (SELECT m.c, m.t, m.role, b.s IS NOT NULL AS by_quote, coalesce(b.n, 0) AS n_linked, coalesce(b.level, 0) AS quote_level, coalesce(lost.n, 0) AS n_unlinked,
          coalesce(b.s[1], CASE WHEN lag(m.t) OVER q IS NOT NULL THEN m.c END) AS pc, coalesce(b.s[2], lag(m.t) OVER q) AS pt
        FROM m LEFT JOIN best b USING (c, t) LEFT JOIN lost USING (c, t) WINDOW q AS (PARTITION BY m.c ORDER BY m.t)),
th AS (SELECT c, t, c AS rc, t AS rt, 0 AS depth FROM par WHERE pc IS NULL
       UNION ALL SELECT par.c, par.t, th.rc, th.rt, th.depth + 1 FROM par JOIN th ON par.pc = th.c AND par.pt = th.t),
x AS (SELECT par.*, th.rc, th.rt, th.depth, stats.levels, coalesce(quoted.n, 0) AS n_quotes, regexp_replace(coalesce(raw, ''), '^\\s+|\\s+$', '', 'g') AS txt
      FROM par JOIN th USING (c, t) JOIN stats USING (c, t) LEFT JOIN quoted USING (c, t) LEFT JOIN own USING (c, t))
SELECT nullif(c, {NONE}) AS conv_id, nullif(t, {NONE}) AS turn, role, nullif(rc, {NONE}) AS thread_conv, nullif(rt, {NONE}) AS thread_turn,
  row_number() OVER (PARTITION BY rc, rt ORDER BY c, t) - 1 AS position, CAST(quote_level AS BIGINT) AS quote_level, CAST(n_unlinked AS BIGINT) AS n_unlinked,
  CAST(depth AS BIGINT) AS depth, nullif(pc, {NONE}) AS parent_conv, nullif(pt, {NONE}) AS parent_turn, by_quote, CAST(n_quotes AS BIGINT) AS n_quotes,
  CAST(n_linked AS BIGINT) AS n_linked, CAST(levels AS BIGINT) AS levels, CAST(length(txt) AS BIGINT) AS n_chars, sha256(txt) AS text_sha256 FROM x"""
