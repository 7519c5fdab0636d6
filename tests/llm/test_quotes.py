import re
from collections import defaultdict

from umbra.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, own int, key string"


def plain(rows):
    """Parents, depths, threads and texts, message by message."""
    norm = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s).lower().strip(" ")
    msgs = {}
    for c, t, role, text, *_ in rows:
        c, t, text = quotes.NONE if c is None else c, quotes.NONE if t is None else t, text or ""
        lines = []
        for line in text.split("\n"):
            mark = re.match(quotes.QUOTE, line)
            mark = mark.group(1) if mark else ""
            lines.append((mark.count(">"), line[len(mark):], norm(line[len(mark):])))
        passages, before = [], None
        for level, _, n in lines:
            if before != (level, n == ""):
                passages.append([level, []])
            passages[-1][1].append(n)
            before = (level, n == "")
        units = [(level, " ".join(x)) for level, x in passages] + [(level, n) for level, _, n in lines]
        kept = [b for i, (level, b, n) in enumerate(lines) if level == 0 and not (
            re.search(quotes.ANNOUNCES, n) and i + 1 < len(lines) and lines[i + 1][0] > 0)]
        msgs[c, t, role, text] = {"own": {u for level, u in units if level == 0 and u}, "quoted": {(level, u) for level, u in units if level > 0 and u},
                                  "text": re.sub(r"^\s+|\s+$", "", "\n".join(kept))}
    order = sorted(msgs, key=lambda k: k[:2])
    out = {}
    for n, k in enumerate(order):
        votes, lost = defaultdict(int), 0
        for level, u in msgs[k]["quoted"]:
            near = [x for x in order[:n] if x[0] == k[0] and u in msgs[x]["own"]]
            far = [x for x in order if u in msgs[x]["own"]][:1]
            if near:
                votes[level, near[-1]] += len(u)
            elif far and far[0][:2] < k[:2]:
                votes[level, far[0]] += len(u)
            else:
                lost += 1
        best = max(votes, key=lambda x: (-x[0], votes[x], x[1][0] == k[0], x[1][:2])) if votes else (0, None)
        parent = best[1]
        by_quote = parent is not None
        if parent is None:
            same = [x for x in order[:n] if x[0] == k[0]]
            parent = same[-1] if same else None
        root, depth = (k, 0) if parent is None else (out[parent][0], out[parent][1] + 1)
        out[k] = (root, depth, parent, by_quote, msgs[k]["text"], best[0], lost)
    real = lambda k: (None, None) if k is None else tuple(None if x == quotes.NONE else x for x in k[:2])
    place = {k: sum(out[x][0] == out[k][0] for x in order[:n]) for n, k in enumerate(order)}
    return sorted([(*real(k), k[2], *real(r), d, *real(p), q, x, level, lost, place[k]) for k, (r, d, p, q, x, level, lost) in out.items()], key=str)


def got(df):
    rows = quotes.link(df).collect()
    return sorted([(r.conv_id, r.turn, r.role, r.thread_conv, r.thread_turn, r.depth, r.parent_conv, r.parent_turn, r.by_quote, r.own_text,
                   r.quote_level, r.n_unlinked, r.position) for r in rows], key=str)


ROWS = [
    (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "I am fine.\n\nThanks."), (1, 2, "u", "On Monday X wrote:\n> How are  YOU?\nGood."),
    (1, 3, "a", "> > How are you?\n> Good.\nyes"), (1, 4, "u", ">> Hello there.\nnested only"), (2, 0, "u", ">I am fine.\n> Thanks.\nreally?"),
    (2, 1, "u", "bye"), (2, 5, "u", "> bye\n> really?\n\n> really?\nok"), (0, 0, "u", "> bye\nquotes a later one"), (None, None, None, None),
    (None, 3, "u", ""), (1, 0, "u", "Hello there.\nHow are you?"), (3, 5, "u", ">nothing matches\nok"), (3, 6, "a", "ok\n>ok"), (3, 7, "a", ">ok\n>ok\n> >"),
    (9, 9, "u", "word " * 20_000 + "\n> bye"),
]


def test_small(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in ROWS], SCHEMA).repartition(4)
    assert got(df) == plain(ROWS)


def test_blocks_of_a_hot_conversation(spark):
    rows = []
    for t in range(0, 1500):
        text = f"line {t % 11}\ncommon line"
        if t % 7 == 3:
            text = f"> line {t * 5 % 11}\n" + text
        if t % 400 == 399:
            text = f"> only once {t - 350}\n" + text
        if t % 400 == 49:
            text += f"\nonly once {t}"
        rows.append((5, t, "u", text))
    assert got(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)) == plain(rows)


def test_tables(spark):
    """The derived mail: every level links, edited and absent originals are there, and most parents come from quotes."""
    df = quotes.quoting(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    rows = got(df)
    assert rows == plain([tuple(r) for r in df.collect()])
    assert sum(r[8] for r in rows) > len(rows) / 2 and {r[10] for r in rows} >= {0, 1, 2} and any(r[11] for r in rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.digest(quotes.link(quotes.quoting(empty))).count() == 0


def test_conversations_in_reply_order(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in ROWS], SCHEMA)
    linked = quotes.link(df)
    whole = {}
    for r in quotes.conversations(linked, 2).collect():
        assert len(r.messages) <= 2
        whole.setdefault((r.thread_conv, r.thread_turn), []).extend(r.messages)
    rows = linked.collect()
    assert sum(map(len, whole.values())) == len(rows)
    for own in whole.values():
        assert sorted(m.position for m in own) == list(range(len(own))) and not any(line.startswith(">") for m in own for line in m.text.split("\n"))
    at = {(r.conv_id, r.turn): r for r in rows}
    for r in rows:
        if r.parent_turn is not None or r.parent_conv is not None:
            parent = at[r.parent_conv, r.parent_turn]
            assert parent.position < r.position and parent.depth == r.depth - 1


def test_many_messages_without_a_turn(spark):
    rows = [(1, None, "u", f"text {i}") for i in range(600)] + [(1, 3, "a", "> text 5\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = quotes.link(df).collect()
    assert len(out) == 601 and max(r.position for r in out) == 600 and [r.by_quote for r in out if r.turn == 3] == [True]
    assert quotes.in_order(quotes.cut_lineage(quotes.parsed(df))).groupBy("b").count().agg({"count": "max"}).first()[0] <= quotes.BLOCK


def test_oracle(same_as_oracle):
    import hashlib

    import duckdb
    same_as_oracle("op5_quotes")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    own = con.execute("SELECT conv_id, turn, role, thread_conv, thread_turn, depth, parent_conv, parent_turn, by_quote, text_sha256, quote_level, n_unlinked, position "
                      f"FROM ({quotes.oracle()})").fetchall()
    assert sorted(own, key=str) == sorted([(*r[:9], hashlib.sha256(r[9].encode()).hexdigest(), *r[10:]) for r in plain(ROWS)], key=str)
