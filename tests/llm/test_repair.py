import hashlib
import random
import re
import zlib

import pytest

from umbra.llm import repair as rp

SCHEMA = "conv_id long, turn long, role string, text string, part int, done string, costs int"
BLANK = " \t\n\x0b\x0c\r"


def all_edits(rows, q, depth=0):
    """(cost, audit, state) of every sequence of edits with at most two rows inserted at a place."""
    if not rows:
        yield 0, "", q
    else:
        initial, must_go, extra = rows[0]
        for c, a, e in all_edits(rows[1:], q):
            yield c + 2, "D" + a, e
        if not must_go:
            if initial in rp.NEXT[q]:
                for c, a, e in all_edits(rows[1:], rp.NEXT[q][initial]):
                    yield c + extra, "K" + a, e
            for c, a, e in all_edits(rows[1:], rp.TO[q]):
                yield c + 1 + extra, "R" + a, e
    if depth < 2:
        for c, a, e in all_edits(rows, rp.TO[q], depth + 1):
            yield c + 5, "I" + a, e


def forward(rows, entry=0, exits=rp.ACCEPT):
    """The same by a plain table, a row at a time."""
    def inserted(at):
        for _ in range(2):
            for q, (c, a) in list(at.items()):
                new = (c + 5, a + "I")
                at[rp.TO[q]] = min(at.get(rp.TO[q], new), new)
        return at

    at = inserted({entry: (0, "")})
    for initial, must_go, extra in rows:
        new = {}
        for q, (c, a) in at.items():
            steps = [(q, 2, "D")]
            if not must_go:
                steps += [(rp.NEXT[q][initial], extra, "K")] if initial in rp.NEXT[q] else []
                steps += [(rp.TO[q], 1 + extra, "R")]
            for p, w, e in steps:
                new[p] = min(new.get(p, (c + w, a + e)), (c + w, a + e))
        at = inserted(new)
    return min((at[q] for q in exits if q in at), default=None)


def random_rows(r, n):
    return [(r.choice("suauat"), r.random() < 0.2, 5 * (r.random() < 0.2)) for _ in range(n)]


def test_all_edit_sequences():
    r = random.Random(1)
    for _ in range(150):
        rows = random_rows(r, r.randint(1, 4))
        assert rp.cheapest(rows, 0, rp.ACCEPT) == min((c, a) for c, a, q in all_edits(rows, 0) if q in rp.ACCEPT), rows


def test_pairs_of_states():
    r = random.Random(2)
    for _ in range(300):
        rows = random_rows(r, r.randint(1, 30))
        assert rp.cheapest(rows, 0, rp.ACCEPT) == forward(rows)
        for p, q in rp.PAIRS:
            assert rp.cheapest(rows, p, (q,)) == forward(rows, p, (q,)), (rows, p, q)
        lines, q = rp.apply(rp.cheapest(rows, 0, rp.ACCEPT)[1], 0, [x[0] for x in rows], ["" for _ in rows])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and q in rp.ACCEPT


def plain(rows):
    """conv_id -> result, message by message. ``rows``: conv_id, turn, role, text."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, lattice, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            lattice.append((role[:1], fault in ("blank", "duplicate"), 5 if fault == "truncated" else 0))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = forward(lattice) if kept else (0, "")
        lines, _ = rp.apply(audit, 0, [x[1] for x in kept], [x[2] for x in kept])
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def messages():
    r = random.Random(7)
    texts = ["Fine.", "Well, yes!", "cut of", "", " \n", "Why?", "é.", "tail. \t", "a\nb:c."]
    rows = []
    for conv in range(60):
        for turn in range(r.choice([1, 3, 8, 20])):
            if r.random() < 0.9:
                rows.append((conv, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "User"]), r.choice(texts) + (f" {turn}." if r.random() < 0.6 else "")))
    # a third of the rows in one conversation, many of them alike; one turn and null turns with many rows
    rows += [(900, i, "user" if i % 2 == 0 else "assistant", f"line {i}." if i % 7 else "same.") for i in range(300)]
    rows += [(901, 5, "user", f"t {i % 4}.") for i in range(40)] + [(901, None, "assistant", None) for _ in range(25)]
    rows += [(None, i % 9, r.choice(["user", "assistant", ""]), f"no id {i}!") for i in range(80)] + [(None, None, None, None)] * 3
    rows += [(902, 1 << 62, "user", "far."), (902, -(1 << 62), "assistant", "apart.")]
    rows += [(1000 + i, 0, "user", "alone.") for i in range(40)]       # some lose their only row
    rows += [(903, 0, "user", "x" * 200_000 + "."), (903, 1, "assistant", "y. " * 60_000)]
    return rows


@pytest.mark.parametrize("block,parts", [(rp.BLOCK, 4), (5, 1), (3, 7)])
def test_brute_force(spark, messages, monkeypatch, block, parts):
    monkeypatch.setattr(rp, "BLOCK", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(*m, 1, "x", 2) for m in messages], SCHEMA).repartition(5)
        got = {r[0]: tuple(r)[1:] for r in rp.repair(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain(messages)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_long_conversations_are_cut(spark):
    """One conversation with all rows lies in many tasks, as blocks of bounded size."""
    rows = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t ', id, '.') AS text", "1 AS copies")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = rp.pieces(rp.marked(rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(len(r.roles) <= rp.BLOCK for r in cut) and len({r.part for r in cut}) > 1 and sum(len(r.roles) for r in cut) == 5000


def test_empty(spark):
    assert rp.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(same_as_oracle):
    same_as_oracle("op11_conversation_repair")
