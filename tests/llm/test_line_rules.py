import re

from umbra.llm import line_rules


def plain(text):
    """The base counts, word by word."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts(edge_docs, edge_rows):
    texts = {r[0]: r[1] for r in edge_rows}
    got = line_rules.clean(edge_docs).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_lines(spark):
    good = "This is a sentence with quite a few plain words in it, and it ends well."
    other = "Another line tells of rivers, bridges and old mills before it comes to its own close!"
    rows = [(1, "\n".join([good, other, "Home | News | Sport | Weather | More", "Read more", "All rights reserved."])),
            (2, "\n".join([good] + [f"menu entry {i} without {i * 7} any end {i * 11} of a kind" for i in range(9)]))]
    got = {r.doc_id: r for r in line_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].clean_text == good + "\n" + other and got[1].n_lines_cut == 3 and got[1].kept
    assert got[2].clean_text == good and not got[2].kept and not got[2].base_failed


def test_line_ends(spark):
    """Blanks after a closing mark do not open a line; marks and phrases of other languages count."""
    ends = {".   ": True, ".\t \t ": True, "!\r": True, "。": True, "؟ ": True, "।": True, "": False, ",": False, " ": False, "…  ": True}
    line = "Words of a line that has no twin here, number"
    rows = [(i, f"{line} {i}{end}") for i, end in enumerate(ends)] + [(90, "Alle Rechte vorbehalten."), (91, "Lire la suite."), (92, "Política de cookies.")]
    got = {r.doc_id: r.n_lines_cut for r in line_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] == 0 for i in range(len(ends))] == list(ends.values()) and got[90] == got[91] == got[92] == 1


def test_oracle(same_as_oracle):
    same_as_oracle("op3_line_rules")


def test_empty(no_docs):
    assert line_rules.clean(no_docs).count() == 0
