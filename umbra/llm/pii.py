"""Personal data by a semi-Markov conditional random field, beside fixed base patterns.

Text around digits and at-signs is cut into atoms (alphanumeric runs, single marks, white space). Every
stretch of at most MAX_ATOMS atoms is a candidate segment, scored as a whole by features of its shape, its
length, its checksum, its edges and the word before it, and by the kind of the entity before it in the same
island. Dynamic programming over segments picks boundaries and types jointly. The weights and the scores of
kinds in sequence are fitted by conditional likelihood on a small set of sentences that templates and a
seeded rule produce: the same weights in every run.

Base patterns (email, ip, card, phone) are found first and always stay; the field adds segments that touch
no base span, also of kinds without a base pattern.

Defined cases: a null text counts as empty and has no spans. Text without a digit or at-sign has none.
Repeated rows get equal results, one output row for each input row. Work and memory grow linearly with a
text: an island is decoded as a whole over the places where candidate segments begin or end; the state at a
place is the kind of the last entity before it, so kinds follow each other across any text between them.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.base import bounded_batches, by_value

by_value(__name__)

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")
MAX_ATOMS = 24          # atoms of the longest entity, but for whole runs of RUN
REACH = 24              # characters of context on either side of a digit or at-sign
LONGEST_RUN = 80        # a segment of more than twice this is a single atom or a whole run of RUN

DOMAIN = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANCHOR = re.compile(r"[0-9@]+")
ATOM = re.compile(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]")
RUN = re.compile(r"[A-Za-z0-9_-]++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost and non-overlapping for each kind."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            # the local part is the run before the sign, but not what an earlier match took
            lo = m.start()
            while lo > last and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < m.start():
                out.append((lo, m.end(), "email"))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def islands(text: str):
    """Stretches (start, end) around the runs of RUN with digits and around at-signs, cut at white space and line ends."""
    lo = hi = over = -1
    for m in ANCHOR.finditer(text):
        a, b = m.span()
        while a > max(hi, 0) and RUN.match(text, a - 1, a):
            a -= 1
        if b > over:
            over = run.end() if (run := RUN.match(text, b)) else b
        b = over
        stop = max(0, a - 2 * REACH, text.rfind("\n", max(0, a - 2 * REACH), a) + 1)
        left = text.rfind(" ", stop, max(stop, a - REACH))
        left = stop if left < 0 else left
        end = text.find("\n", b, b + 2 * REACH)
        end = min(len(text), b + 2 * REACH) if end < 0 else end
        right = text.find(" ", min(end, b + REACH), end)
        right = end if right < 0 else right
        if left <= hi:
            hi = max(hi, right)
        else:
            if hi > lo:
                yield lo, hi
            lo, hi = left, right
    if hi > lo:
        yield lo, hi


# Words that announce a kind.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "credential", "bearer"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon", "cell"), "card": ("card", "visa", "mastercard", "amex", "carte", "karte"),
    "ip": ("ip", "host", "server", "address"), "email": ("mail", "email", "contact", "write"),
    "iban": ("iban", "account", "konto", "cuenta", "compte"), "ssn": ("ssn", "social", "security"),
}
CUE_OF = {w: k for k, words in CUES.items() for w in words}
SHAPES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("quad", re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ("intl", re.compile(r"\+[0-9](?:[ ().-]{0,2}[0-9]){8,14}")),
    ("local", re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")),
    ("groups", re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}")),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")),
    ("hex", re.compile(r"[0-9a-fA-F]{20,}")),
    ("mixed", re.compile(r"(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}")),
    ("short", re.compile(r"(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{6,15}")),
    ("trunk", re.compile(r"0[0-9]{1,4}[ /-][0-9]{3,5}[ -]?[0-9]{2,6}")),
    # public prefixes of access keys
    ("issued", re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[prs]k_(?:live|test)_[A-Za-z0-9]{8,}|xox[abprs]-[A-Za-z0-9-]{10,}")),
)


def atoms(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ATOM.finditer(text)]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    if not 15 <= len(s) <= 34:
        return False
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def segment_features(text: str, lo: int, hi: int, cue: str | None, assigned: bool) -> list[str]:
    """Features of the whole segment ``text[lo:hi]``; none marks a segment that can be no entity."""
    s = text[lo:hi]
    digits = [c for c in s if "0" <= c <= "9"]
    if not digits and "@" not in s:
        return []
    shapes = [name for name, rx in SHAPES if rx.fullmatch(s)]
    if not shapes:
        return []
    before, after = text[lo - 1:lo], text[hi:hi + 1]
    out = ["shape:" + x for x in shapes]
    out.append(f"length:{min((hi - lo) // 4, 12)}")
    edge = "whole" if not (before.isalnum() or before in "@+" and before) and not (after.isalnum() or after == "@") else "inside"
    if edge == "inside":
        out.append("inside")
    if lo > 1 and before in "-_" and text[lo - 2].isalnum() or after in "-_" and text[hi + 1:hi + 2].isalnum():
        out.append("part of a run")
    if text[hi:hi + 2][:1] in ".,-" and text[hi + 1:hi + 2].isdigit() or before in ".,-" and before and text[lo - 2:lo - 1].isdigit():
        out.append("part of a number")
    if "quad" in shapes:
        out.append("octets" if all(int(p) <= 255 for p in s.split(".")) else "no octets")
    if "groups" in shapes:
        out.append("luhn" if 13 <= len(digits) <= 19 and luhn("".join(digits)) else "no luhn")
    if "iban" in shapes:
        out.append("iban ok" if iban_ok(s) else "iban bad")
    if assigned:
        out.append("assigned")
    if cue:
        out.append("cue:" + cue)
        out += [f"cue:{cue}&{x}" for x in out if x.startswith("shape:")]
    return out


def _long_runs(text: str, lo: int, hi: int, at: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Runs of RUN, without marks at their ends, that are too long for other segments: after last atom by first atom."""
    out, first, end = {}, {a: i for i, (a, _) in enumerate(at)}, {b: i + 1 for i, (_, b) in enumerate(at)}
    for m in RUN.finditer(text, lo, hi):
        s = m.group()
        a, b = m.start() + len(s) - len(s.lstrip("_-")), m.end() - len(s) + len(s.rstrip("_-"))
        if a < b and (b - a > 2 * LONGEST_RUN or b - a > MAX_ATOMS) and (end[b] - first[a] > MAX_ATOMS or b - a > 2 * LONGEST_RUN and end[b] > first[a] + 1):
            out[first[a]] = [end[b]]
    return out


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Atoms of ``text[lo:hi]`` and the segments (first atom, after last atom, features) that may be entities."""
    at = [(a + lo, b + lo) for a, b in atoms(text[lo:hi])]
    long = _long_runs(text, lo, hi, at)
    out, cue, cue_at, assigned = [], None, -99, False
    for i, (a, b) in enumerate(at):
        s = text[a:b]
        if not s.isspace() and (s.isalnum() or s in "+("):
            use = cue if i - cue_at <= 8 else None
            for j in [*range(i + 1, min(len(at), i + MAX_ATOMS) + 1), *long.get(i, ())]:
                if j > i + 1 and at[j - 1][1] - a > 2 * LONGEST_RUN and j not in long.get(i, ()):
                    continue
                if text[at[j - 1][1] - 1].isalnum() and text[at[j - 1][0]].isascii():
                    f = segment_features(text, a, at[j - 1][1], use, assigned and i - cue_at <= 8)
                    if f:
                        out.append((i, j, f))
        w = s.lower()
        if w in CUE_OF:
            cue, cue_at, assigned = CUE_OF[w], i, False
        elif s in "=:" and s:
            assigned = True
    return at, out


class SemiCRF:
    """Weights by (feature, kind), a cost for each kind, and a score for each kind after another."""

    def __init__(self):
        self.w: dict[tuple[str, int], float] = {}
        self.trans = np.zeros((len(KINDS) + 1, len(KINDS)))      # by the last entity's kind (the last row: none yet)

    def segment_scores(self, segments) -> list[np.ndarray]:
        n = range(len(KINDS))
        return [np.array([sum(self.w.get((x, k), 0.0) for x in ["bias", *f]) for k in n]) for _, _, f in segments]

    @staticmethod
    def _places(segments):
        """How many places segments begin or end at, and for each place the segments (number, other place) that
        end and that begin there."""
        at = {a: p for p, a in enumerate(sorted({x for i, j, _ in segments for x in (i, j)}))}
        ending, leaving = [[] for _ in at], [[] for _ in at]
        for s, (i, j, _) in enumerate(segments):
            ending[at[j]].append((s, at[i]))
            leaving[at[i]].append((s, at[j]))
        return len(at), ending, leaving

    def best(self, segments) -> list[tuple[int, int, int]]:
        """The best segmentation: its entities as (first atom, after last atom, kind). Of equal ones, that which
        passes over a segment."""
        if not segments:
            return []
        scores, none = self.segment_scores(segments), len(KINDS)
        n, ending, leaving = self._places(segments)
        value = np.full(none + 1, -np.inf)
        value[none] = 0.0
        enter: list = [None] * n          # at places where segments begin: best value by kind to come, and the state before
        back: list[dict] = [{} for _ in range(n)]
        for p in range(n):
            for s, i in ending[p]:
                got = enter[i][0] + scores[s]
                for k in np.flatnonzero(got > value[:none]):
                    value[k], back[p][int(k)] = got[k], (s, i, int(enter[i][1][k]))
            if leaving[p]:
                step = value[:, None] + self.trans
                enter[p] = step.max(axis=0), step.argmax(axis=0)
        out, p, k = [], n - 1, int(value.argmax())
        while p >= 0:
            if k in back[p]:
                s, i, before = back[p][k]
                out.append((segments[s][0], segments[s][1], k))
                p, k = i, before
            else:
                p -= 1
        return out[::-1]

    def fit(self, sentences, epochs: int = 8, rate: float = 0.5, decay: float = 1e-3) -> "SemiCRF":
        """Gradient steps on the conditional log likelihood, by forward and backward sums over segments."""
        none, grown = len(KINDS), {}
        grown_trans = np.full(self.trans.shape, 1e-1)
        data = []
        for text, gold in sentences:
            at, segments = candidates(text, 0, len(text))
            first, end = {a: i for i, (a, _) in enumerate(at)}, {b: i + 1 for i, (_, b) in enumerate(at)}
            truth = {(first[a], end[b]): KINDS.index(k) for a, b, k in gold}
            assert all((i, j) in {(x, y) for x, y, _ in segments} for i, j in truth), (text, gold)
            if segments:
                data.append((segments, truth))
        rng = random.Random(3)
        for _ in range(epochs):
            rng.shuffle(data)
            for segments, truth in data:
                scores = self.segment_scores(segments)
                n, ending, leaving = self._places(segments)
                alpha = np.full((n, none + 1), -np.inf)
                enter = np.full((n, none), -np.inf)
                for p in range(n):
                    alpha[p] = alpha[p - 1] if p else np.where(np.arange(none + 1) == none, 0.0, -np.inf)
                    for s, i in ending[p]:
                        alpha[p, :none] = np.logaddexp(alpha[p, :none], enter[i] + scores[s])
                    enter[p] = np.logaddexp.reduce(alpha[p][:, None] + self.trans, axis=0)
                total = np.logaddexp.reduce(alpha[n - 1])
                beta = np.zeros((n, none + 1))           # of what follows a place, given the last entity's kind
                hope = np.zeros(self.trans.shape)
                for p in range(n - 1, -1, -1):
                    if p < n - 1:
                        beta[p] = beta[p + 1]
                    ahead = np.full(none, -np.inf)
                    for s, j in leaving[p]:
                        ahead = np.logaddexp(ahead, scores[s] + beta[j, :none])
                    if leaving[p]:
                        beta[p] = np.logaddexp(beta[p], np.logaddexp.reduce(self.trans + ahead, axis=1))
                        hope += np.exp(alpha[p][:, None] + self.trans + ahead - total)
                place = {a: p for p, a in enumerate(sorted({x for i, j, _ in segments for x in (i, j)}))}
                last, seen = none, np.zeros(self.trans.shape)
                for i, j in sorted(truth):
                    seen[last, truth[i, j]] += 1
                    last = truth[i, j]
                for s, (i, j, f) in enumerate(segments):
                    p = np.exp(enter[place[i]] + scores[s] + beta[place[j], :none] - total)
                    k_true = truth.get((i, j))
                    for k in range(none):
                        g = (k == k_true) - p[k]
                        if abs(g) > 1e-4:
                            for x in ("bias", *f):
                                old = self.w.get((x, k), 0.0)
                                g2 = grown[x, k] = grown.get((x, k), 1e-3) + g * g
                                self.w[x, k] = old + rate * (g - decay * old) / g2 ** 0.5
                g = seen - hope - decay * self.trans
                grown_trans += g * g
                self.trans = self.trans + rate * g / np.sqrt(grown_trans)
        return self


def training_sentences(n: int = 400, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with known entities and with numbers that are none, from a seeded rule."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "the", "in", "er", "ou", "le", "che", "mi", "to", "ra")) for _ in range(r.randint(1, 3)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid):
        while True:
            d = r.choice("345") + num(15)
            if luhn(d) == valid:
                return d if r.random() < 0.6 else " ".join(d[i:i + 4] for i in range(0, 16, 4))

    def iban():
        body = r.choice(("DE", "FR", "ES")) + "00" + num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return body[:2] + f"{check:02d}" + body[4:]

    octet = lambda: str(r.randint(0, 255))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k - 2)) + "a7"
    entity = {
        "email": lambda: (word(), f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com"),
        "ip": lambda: (r.choice(("ip", "host", word())), ".".join(octet() for _ in range(4))),
        "card": lambda: (r.choice(("card", word())), card(True)),
        "phone": lambda: r.choice(((r.choice(("tel", "call", word())), f"+{r.randint(1, 9)} ({num(3)}) {num(3)}-{num(4)}"),
                                   (r.choice(("phone", "tel", "call")), f"({num(3)}) {num(3)}-{num(4)}"),
                                   (r.choice(("phone:", "tel:", "call")), f"0{num(r.randint(2, 4))}{r.choice(' /-')}{num(r.randint(6, 8))}"))),
        "iban": lambda: (r.choice(("iban", "account", word())), iban()),
        "secret": lambda: r.choice((
            (r.choice(("token", "secret", "password", "key")) + r.choice((" = ", ": ", "=")) + r.choice(('"', "")), hexes(r.choice((24, 32, 40)))),
            (r.choice(("password", "pwd", "api_key", "secret")) + r.choice((" = ", ": ", "=")) + r.choice(('"', "")), r.choice("bdfgkm") + word() + word() + num(r.randint(1, 4)) + "x"),
            (r.choice(("key", "use", word())), r.choice(("AKIA", "ASIA")) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + num(1)),
            (r.choice(("token", "with", word())), f"gh{r.choice('pousr')}_" + "".join(r.choice("abcdefghijkmnpqrsABCDEFGHJKLMN0123456789") for _ in range(35)) + num(1)))),
        "ssn": lambda: (r.choice(("ssn", "social security")), f"{num(3)}-{num(2)}-{num(4)}"),
    }
    other = (
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: f"{num(1)},{num(3)}.{num(2)}",
        lambda: "card " + card(False), lambda: card(False), lambda: f"{r.randint(300, 999)}.{num(2)}.{num(2)}.{num(1)}", lambda: f"#{num(5)}",
        lambda: hexes(40), lambda: hexes(32), lambda: f"{word()}{num(2)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"@{word()}", lambda: f"{num(22)}",
        lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: "DE" + num(20), lambda: f"0{num(3)} {num(7)}", lambda: f"key {word()}{num(2)}", lambda: f"{word()}-{word()}{num(3)}",
        lambda: f"{word()}={word()}{word()}{num(2)}", lambda: f"{word()}_{num(2)}_{word()}", lambda: f"{word()}-{num(4)}-{word()}", lambda: f"{word()}: {word()}{num(3)}", lambda: f"{word()}-{num(4)}-{num(4)}-{word()}{num(8)}",
    )
    out = []
    for i in range(n):
        text, gold = word(), []
        for _ in range(r.randint(1, 3)):
            text += " " + word() + " "
            if r.random() < 0.6:
                kind = KINDS[(i + len(gold)) % len(KINDS)]
                cue, value = entity[kind]()
                text += cue + ("" if cue[-1] in '"=' else " " if cue[-1] != " " else "")
                gold.append((len(text), len(text) + len(value), kind))
                text += value
                while r.random() < 0.2:           # more of its kind, without a word before them
                    value = entity[kind]()[1]
                    text += r.choice((", ", "; ", " and ", f" {word()} "))
                    gold.append((len(text), len(text) + len(value), kind))
                    text += value
                text += r.choice(("", ".", ",", '"'))
            else:
                text += r.choice(other)() + r.choice(("", ".", ","))
        out.append((text + " " + word() + ".", gold))
    return out


@lru_cache(1)
def trained() -> SemiCRF:
    return SemiCRF().fit(training_sentences())


def field_spans(text: str, crf: SemiCRF) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of the best segmentation of each island."""
    out = []
    for lo, hi in islands(text):
        at, segments = candidates(text, lo, hi)
        out += [(at[i][0], at[j - 1][1], KINDS[k]) for i, j, k in crf.best(segments)]
    return out


def all_spans(text: str, crf: SemiCRF, base=None) -> list[tuple[int, int, str]]:
    """Base spans, and those of the field that touch none of them."""
    base = base_spans(text) if base is None else base
    taken = sorted((a, b) for a, b, _ in base)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else []
    starts = [a for a, _ in taken]
    added = []
    if ANCHOR.search(text):
        for a, b, k in field_spans(text, crf):
            at = int(np.searchsorted(starts, b))
            if not at or ends[at - 1] <= a:
                added.append((a, b, k))
    return sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the digest of the base spans, all spans and their number, of each row (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    crf = trained()

    def run(batches):
        for b in batches:
            counts, digest, spans, found = [], [], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                counts.append([sum(s[2] == k for s in base) for k in BASE])
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every = all_spans(text or "", crf, base)
                spans.append(joined(every))
                found.append(len(every))
            n = np.array(counts, np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(n[:, k]) for k in range(len(BASE))), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(found, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted_text(text: str | None, crf: SemiCRF) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in all_spans(text, crf):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the spans of a text column replaced; all other columns as they were."""
    bounded_batches(docs.sparkSession)
    crf, names, at = trained(), docs.columns, docs.columns.index(column)

    def run(batches):
        for b in batches:
            cols = b.columns
            cols[at] = pa.array([redacted_text(t, crf) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
