"""Personal data by candidate generation and boosted trees.

Exact base rules find e-mail, IP, card and phone spans.  High-recall
generators propose more spans, which may overlap; boosted trees score each
from its format and its context, and thresholds per kind, calibrated for
precision on generated rows that the trees did not see, select what is added.
Base spans always stay; added spans overlap neither these nor each other.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.boosting import BoostedTrees
from shiftlog.llm.common import extended, rows_of

KINDS = ["email", "ip", "card", "phone", "secret"]
SPAN = "struct<kind:string,start:int,end:int,base:boolean,score:double>"

# The base rules.
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a run of digits is tried from its first digit only: equal matches, linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: High-recall generators; a candidate's own kind is only a feature's value.
_CANDIDATES = [
    ("email", re.compile(r"[\w.%+-]{1,64}\s?(?:@|[\[({]\s?(?:at|AT)\s?[\])}])\s?[\w-]{1,63}"
                         r"(?:\s?(?:\.|[\[({]\s?(?:dot|DOT)\s?[\])}])\s?[\w-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[.,:]\s?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5,7}"
                      r"(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+|00|\()?[0-9][0-9 ().\/-]{5,24}[0-9](?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}"
                          r"(?![A-Za-z0-9_/+=-])")),
]
_ANY = re.compile(r"[0-9@]|[\[({]\s?(?:at|AT)\s?[\])}]")
#: A secret may hold letters alone, in a text without any digit.
_LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20}")

# Words that speak for a kind when they stand before a span.
_CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api"),
}
#: Characters before a span that are looked at for context.
WINDOW = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if c in "0123456789"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start; leftmost and not overlapping per kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _EMAIL_DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _ANY.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                       for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                if 9 <= len(_digits(m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all generators; they may overlap."""
    if not _ANY.search(text) and not _LONG_TOKEN.search(text):
        return []
    return [(kind, m.start(), m.end()) for kind, rule in _CANDIDATES for m in rule.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    own, before = text[start:end], text[max(0, start - WINDOW):start].lower()
    after = text[end:end + 1]
    digits = _digits(own)
    groups = re.findall(r"[0-9]+", own)
    letters = sum(c.isalpha() for c in own)
    numbers = [int(g[:9]) for g in groups] or [0]
    hint = {k: float(any(w in before for w in words)) for k, words in _CONTEXT.items()}
    classes = (any(c.islower() for c in own) + any(c.isupper() for c in own) + bool(digits))
    return [
        float(KINDS.index(kind)), len(own), len(digits), letters, len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(digits) / len(own), float(own[:1] == "+"), float("(" in own),
        float(luhn(digits)) if digits else 0.0, float(max(numbers) <= 255), own.count("."),
        own.count("-"), own.count(" "), own.count(":"), float("@" in own),
        float(bool(re.search(r"[\[({]", own))), float(own[-2:].isalpha()), len(set(own)) / len(own),
        float(classes), float(bool(re.fullmatch(r"[0-9a-fA-F]+", own))),
        *(hint[k] for k in KINDS), hint[kind], float(before[-1:].isalnum()),
        float(before[-1:] in {'"', "'", "="}), float(after.isalnum()),
        float(after in {'"', "'"}),
    ]


def _generated(rng: random.Random, words: list[str]) -> tuple[str, str, str, int]:
    """A sentence of corpus words around one value: text, value, kind, label."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: re.sub(r"\W", "", rng.choice(words)) or "a"
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ"  # noqa: E731
                                         "23456789") for _ in range(n))

    def card(valid: bool) -> str:
        body = d(15)
        last = next(c for c in "0123456789" if luhn(body + c))
        return body + (last if valid else str((int(last) + rng.randint(1, 9)) % 10))

    quads = lambda s, sep: sep.join(s[i:i + 4] for i in range(0, 16, 4))
    octets = lambda: [str(rng.randint(0, 255)) for _ in range(4)]
    cue = {k: rng.choice(v) for k, v in _CONTEXT.items()}
    makes = [
        ("email", 1, lambda: (f"{w()}.{d(2)}@{w()}.example.com", "")),
        ("email", 1, lambda: (f"{w()} [at] {w()} [dot] org", "")),
        ("email", 1, lambda: (f"{w()}(at){w()}.net", "")),
        ("email", 0, lambda: (f"{w()}@{w()}.{d(1)}", "version ")),
        ("email", 0, lambda: (f"{w()} (at) {d(2)}.{d(2)}", "")),
        ("ip", 1, lambda: (".".join(octets()), "")),
        ("ip", 1, lambda: (" . ".join(octets()), f"{cue['ip']} ")),
        ("ip", 1, lambda: (":".join(hexa(4) for _ in range(8)), f"{cue['ip']} ")),
        ("ip", 0, lambda: (".".join(str(rng.randint(256, 999)) for _ in range(4)), "")),
        ("ip", 0, lambda: (", ".join(d(2) for _ in range(4)), "")),
        ("ip", 0, lambda: (":".join(d(2) for _ in range(4)), "")),
        ("card", 1, lambda: (card(True), "")),
        ("card", 1, lambda: (quads(card(True), rng.choice([".", "/", "_", "  "])),
                             f"{cue['card']} ")),
        ("card", 0, lambda: (card(False), "")),
        ("card", 0, lambda: (quads(card(False), rng.choice([" ", "-", "."])), "")),
        ("card", 0, lambda: (d(rng.choice([14, 17, 18])), "no ")),
        ("phone", 1, lambda: (f"+{d(1)} ({d(3)}) 555-{d(4)}", "")),
        ("phone", 1, lambda: (f"({d(3)}) {d(3)}-{d(4)}", f"{cue['phone']} ")),
        ("phone", 1, lambda: (f"{d(3)}-{d(3)}-{d(4)}", f"{cue['phone']}: ")),
        ("phone", 1, lambda: (f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"{cue['phone']} ")),
        ("phone", 0, lambda: (d(rng.randint(7, 18)), "")),
        ("phone", 0, lambda: (f"{d(4)}-{d(2)}-{d(2)}", "")),
        ("phone", 0, lambda: (" ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(4, 7))),
                              "")),
        ("phone", 0, lambda: (".".join(octets()), "")),
        ("phone", 0, lambda: (quads(card(False), " "), "")),
        ("phone", 0, lambda: (f"{d(3)}.{d(3)}.{d(3)}", "")),
        ("secret", 1, lambda: (hexa(rng.choice([32, 40, 64, 128, 256])), f'{cue["secret"]} = "')),
        ("secret", 1, lambda: (mixed(rng.choice([rng.randint(24, 48), rng.randint(49, 400)])),
                               f"{cue['secret']}: ")),
        ("secret", 1, lambda: (re.sub("[0-9]", "", mixed(rng.randint(40, 400))),
                               f"{cue['secret']}: ")),
        ("secret", 0, lambda: ("".join(w().title() for _ in range(rng.randint(8, 60)))
                               .ljust(20, "a"), "")),
        ("secret", 0, lambda: (rng.choice("-_/+xA") * rng.randint(20, 400), "")),
        ("secret", 0, lambda: (hexa(rng.choice([32, 40])), "commit ")),
        ("secret", 0, lambda: ("".join(w() for _ in range(8))[:60].lower().ljust(20, "a"), "")),
        ("secret", 0, lambda: ("/".join(w() for _ in range(7)).ljust(20, "a"), "")),
        ("secret", 0, lambda: (d(rng.randint(20, 30)), "")),
    ]
    kind, label, make = rng.choice(makes)
    value, lead = make()
    if rng.random() < 0.1:
        lead = lead.upper()
    left = " ".join(rng.choice(words) for _ in range(6))
    right = " ".join(rng.choice(words) for _ in range(4))
    close = '"' if lead.endswith('"') else ""
    return f"{left} {lead}{value}{close} {right}", value, kind, label


@dataclass(frozen=True)
class Model:
    trees: BoostedTrees
    thresholds: dict[str, float]


#: Documents that lend words to the generated training rows, and those rows.
SAMPLE_DOCS = 200
TRAINING_ROWS = 8000
#: Precision that a kind's threshold must reach on the calibration rows.
PRECISION = 0.99


def train(docs: DataFrame, seed: int = 7) -> Model:
    """Trees and thresholds from generated rows whose context is words of the
    first 2000 characters of at most ``SAMPLE_DOCS`` documents (lowest hash of the id); two thirds fit the
    trees, the rest calibrate the thresholds."""
    sample = (docs.where(F.col("text").isNotNull())
              .select("doc_id", F.substring("text", 1, 2000).alias("text"))
              .orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE_DOCS).collect())
    words = sorted({w for r in sample for w in r["text"].split()
                    if not any(c.isdigit() or c == "@" for c in w) and len(w) < 16}) or ["a", "b"]
    rng, x, y, kinds = random.Random(seed), [], [], []
    for _ in range(TRAINING_ROWS):
        text, value, kind, label = _generated(rng, words)
        at = text.index(value)
        for k, a, b in candidates(text):
            own = label and k == kind and abs(a - at) <= 1 and abs(b - at - len(value)) <= 1
            x.append(features(text, k, a, b))
            y.append(float(own))
            kinds.append(k)
    x, y, kinds = np.array(x), np.array(y), np.array(kinds)
    fit = np.arange(len(y)) % 3 < 2
    trees = BoostedTrees().fit(x[fit], y[fit])
    score, thresholds = trees.predict(x), {}
    for k in KINDS:
        own = ~fit & (kinds == k)
        order = np.argsort(-score[own], kind="stable")
        hits = y[own][order].cumsum() / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(hits >= PRECISION)
        thresholds[k] = max(0.5, float(score[own][order][good[-1]])) if len(good) else 2.0
    return Model(trees, thresholds)


def spans_of(texts: list[str], model: Model) -> list[list[tuple]]:
    """All spans of each text: kind, start, end, base, score; by kind, then
    start."""
    base = [base_spans(t) for t in texts]
    found = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)
             if c not in base[i]]
    out = [[(*s, True, 1.0) for s in spans] for spans in base]
    if found:
        scores = model.trees.predict(np.array([features(texts[i], k, a, b)
                                               for i, k, a, b in found]))
        taken = [[(s[1], s[2]) for s in spans] for spans in base]
        ranked = sorted(zip(-scores, found))
        for score, (i, kind, a, b) in ranked:
            if -score >= model.thresholds[kind] and all(b <= s or a >= e for s, e in taken[i]):
                taken[i].append((a, b))
                out[i].append((kind, a, b, False, float(-score)))
    order = {k: n for n, k in enumerate(KINDS)}
    return [sorted(s, key=lambda x: (order[x[0]], x[1], x[2])) for s in out]


def detect(docs: DataFrame, model: Model, column: str = "spans") -> DataFrame:
    """``docs`` with ``column``: kind, start and end in code points, whether a
    base rule found it, score; by kind as listed in ``KINDS``, then start.

    Null text has no spans.  Rows are independent, so repeated and null ids
    and other columns pass as they are (an old ``column`` is replaced),
    and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("base", pa.bool_()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "base", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = spans_of([t or "" for t in rows_of(batch, "text")[0]], shared.value)
            out = pa.array([[dict(zip(names, s)) for s in own] for own in spans], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, out],
                                             names=[*batch.schema.names, column])

    return docs.mapInArrow(run, extended(docs, **{column: f"array<{SPAN}>"}))


def redact(found: DataFrame, column: str = "spans") -> DataFrame:
    """``found`` with each span of ``text`` replaced by its kind in angle
    brackets; overlapping spans of different kinds become one, named after
    the first."""
    def cover(spans):
        by_start = F.array_sort(spans, lambda a, b: F.when(
            a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        text = F.col("text")

        def step(acc, s):
            new = s["start"] >= acc["at"]
            out = F.when(new, F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
            return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        return F.aggregate(by_start, start, step, lambda acc: F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))

    return found.withColumn("text", F.when(F.size(column) > 0, cover(F.col(column)))
                            .otherwise(F.col("text")))


def spans_text(spans):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")
