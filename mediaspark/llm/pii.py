"""Personal data: high-recall generators propose spans, boosted trees accept them, thresholds are calibrated.

Base spans (email, ip, card, phone by the BASE rules, leftmost and non-overlapping for each kind) always stay.
Wider GENERATORS propose further spans of the same kinds, overlapping ones included: written-out addresses,
IPv6, cards in other groups, phone numbers without a plus. Trees over format and context features score them;
a span is added at its kind's threshold, the best of overlapping ones, and never over a base span.

The trees learn from examples made here from formats and contexts with a fixed seed (no table has span
labels); a part left out of the fit sets for each kind the least threshold with PRECISION.

Defined results: null text counts as empty, and has no span; rows that repeat each get their row; of overlapping
proposals with one score the first by place and kind stays; a very long text is searched whole, in time that grows
as its length; an empty table gives an empty table. Positions are code points, ends exclusive. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm import boosting
from mediaspark.llm.common import tidy

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: Characters of context on each side.
AROUND = 24

# The rules of the base spans; fixed values.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Each @ with the run of local characters before it and the domain after it: what the pattern matches from the left, in linear time."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, "email", m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans in order of start, then kind. No match of the digit patterns can begin inside a run of digits that an earlier try began with, so ip needs no look further than its run."""
    out = _emails(text) if "@" in text else []
    if _ANY_DIGIT.search(text):
        if "." in text:
            out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


_ANY_DIGIT = re.compile(r"[0-9]")
#: (kind, what a text must hold, pattern) of the proposals.
GENERATORS = (
    ("email", "@", re.compile(r"[^\s@<>()\[\],;:\"]{1,64}@[^\s@<>()\[\],;:\"]{1,190}\.[^\W\d_]{2,}")),
    ("email", "at", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+){1,4}", re.I)),
    ("ip", ":", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")),
    ("card", "", re.compile(r"(?<![0-9])[0-9]{4}([./_–])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13}(?![0-9])")),
    ("phone", "", re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", "00", re.compile(r"(?<![0-9+.-])00[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])")),
)
_GOOD = re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|contact|mail|e-?mail|write|reach|card|visa|credit|pay|ip|host|server|addr\w*|t[ée]l[ée]phone|telefon|tel[ée]fono|courriel|correo|anruf\w*)\b", re.I)
_BAD = re.compile(r"\b(?:version|ver|v|isbn|order|ref|no|nr|id|page|pp|line|sku|part|model|serial|section|fig|table|eq|build|score|total|sum)\b[.:# ]*$", re.I)


def proposals(text: str) -> list[Span]:
    out = []
    digit = bool(_ANY_DIGIT.search(text))
    for kind, holds, pattern in GENERATORS:
        if (digit or kind == "email") and (holds in text or holds == "at" and "AT" in text):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    body, before, after = text[start:end], text[max(0, start - AROUND):start], text[end:end + AROUND]
    digits = _digits(body)
    near = before + after
    return [
        KINDS.index(kind), len(body), len(digits), len(digits) / max(1, len(body)), luhn(digits) if digits else 0,
        sum(c in " .-()/_" for c in body), len(set(c for c in body if not c.isalnum())), body.count("."), body.count(":"), body.count("@"),
        sum(c in "[({" for c in body), bool(re.search(r"\bat\b", body, re.I)), "::" in body, body[:1] == "(", body[:2] == "00",
        bool(_GOOD.search(near)), bool(_BAD.search(before)), before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in tuple("$€£#=/.,_-") if before else 0,
        after[:1] in tuple("%/=_-") if after else 0, sum(c.isdigit() for c in near) / max(1, len(near)), int(digits[:1] or 0), len(set(digits)),
        sum(c in "abcdefABCDEF" for c in body) if kind == "ip" else 0, not body.isascii(),
    ]


@dataclass
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]


def examples(n: int = 3000, seed: int = 5) -> tuple[list[tuple[str, Span]], np.ndarray]:
    """Texts with one proposal each and whether it is personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda k=6: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, k + 1))))

    def card(k: int, ok: bool) -> str:
        body = pick("3456") + num(k - 2)
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if ok else str((int(last) + int(rng.integers(1, 10))) % 10))

    hexes = lambda k: ":".join(f"{int(x):x}" for x in rng.integers(0, 65536, k))
    found, labels = [], []
    while len(found) < n:
        good, form = bool(rng.random() < 0.5), int(rng.integers(6))
        if form == 0:
            body = f"{word()}é{word()}@{word()}.{pick(['com', 'org', 'fr'])}" if good else f"{word()}/{word()}=@{word()}.{word(3)}xx"
        elif form == 1:
            body = f"{word()}.{word()} [at] {word()} [dot] com" if good else f"{word()} (at) {word()}.{num(2)}"
        elif form == 2:
            body = hexes(8) if good else ":".join(f"{int(x):02d}" for x in rng.integers(0, 60, int(rng.integers(3, 5))))
        elif form == 3:
            d = card(16, good) if rng.random() < 0.7 else card(13, good)
            body = pick("./").join([d[i:i + 4] for i in range(0, 16, 4)]) if len(d) == 16 else d
        elif form == 4:
            a, b, c = num(3), num(3), num(4)
            body = pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]) if good else pick([f"{a} {b} {c}", f"{a}.{b}.{c}"])
        else:
            body = f"00{pick(['33', '49', '34', '44'])} {num(3)} {num(3)} {num(3)}" if good else f"00{num(3).replace('0', '1')}{num(9)}"
        lead = pick(["call ", "tel. ", "contact: ", "mail ", "card ", "host ", "reach me on ", "write to "]) if good and rng.random() < 0.6 else pick(["order no. ", "version ", "isbn ", "ref ", "id=", "build ", "part ", "$"]) if not good and rng.random() < 0.7 else word() + " "
        head = " ".join(word() for _ in range(4)) + " " + lead
        text = head + body + pick([" ", ". ", ", "]) + " ".join(word() for _ in range(4))
        for span in proposals(text):
            if span[0] <= len(head) + 1 and span[2] >= len(head) + len(body) - 1:
                found.append((text, span))
                labels.append(good)
    return found, np.array(labels, float)


def train(seed: int = 5) -> Model:
    found, y = examples(seed=seed)
    x = np.array([features(t, s) for t, s in found], float)
    held = np.arange(len(y)) % 3 == 0
    trees = boosting.fit(x[~held], y[~held])
    p, thresholds = trees.probability(x[held]), {}
    for k, kind in enumerate(KINDS):
        own = x[held][:, 0] == k
        thresholds[kind] = 1.01
        for t in np.linspace(0.99, 0.5, 50):
            taken = own & (p >= t)
            if taken.sum() >= 10 and y[held][taken].mean() >= PRECISION:
                thresholds[kind] = float(t)
    return Model(trees, thresholds)


def added_spans(texts: list[str], base: list[list[Span]], model: Model) -> list[list[Span]]:
    """The accepted proposals of each text, none over a base span or another accepted one."""
    open_: list[tuple[int, Span]] = []
    for k, text in enumerate(texts):
        own = sorted(base[k])
        begins, ends = [b[0] for b in own], list(accumulate((b[2] for b in own), max))
        for s in proposals(text):
            before = bisect_left(begins, s[2])  # base spans that begin before its end
            if not before or ends[before - 1] <= s[0]:
                open_.append((k, s))
    out: list[list[Span]] = [[] for _ in texts]
    if open_:
        p = model.trees.probability(np.array([features(texts[k], s) for k, s in open_], float))
        ranked = sorted(zip(-p, open_), key=lambda x: (x[1][0], x[0], x[1][1]))
        for score, (k, s) in ranked:
            if -score >= model.thresholds[s[1]]:
                at = bisect_left(out[k], s)
                if (not at or out[k][at - 1][2] <= s[0]) and (at == len(out[k]) or s[2] <= out[k][at][0]):
                    out[k].insert(at, s)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, model: Model | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all (and the redacted text, if asked for)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(["redacted"] if with_text else [])]

    @tidy
    def run(batches):
        net = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [b + more for b, more in zip(base, added_spans(texts, base, net))]
                counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                more = [pa.array([redact(t, s) for t, s in zip(texts, every)], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([joined(s) for s in every], pa.string()), *more], names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", redacted string" * with_text
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
