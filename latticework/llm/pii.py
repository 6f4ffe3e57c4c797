"""Personal data: exact base rules, and candidates judged by gradient-boosted trees.

Base spans (email, ip, card, phone) come from linear-time matchers of fixed patterns and always stay.
High-recall generators propose further, overlapping spans: obfuscated emails, IPv6 addresses, telephone
numbers without a plus, social-security-like and bank account numbers. Boosted trees score each candidate
by features of its format and of the words around it, and per-kind thresholds, calibrated on held-out
examples for a precision of at least PRECISION, select the ones to redact; of overlapping ones the best
scored stays, and base spans win over all.

No table marks personal data, so the trees are fitted on EXAMPLES made-up examples and counter-examples
(dates, prices, versions, order numbers ...) from a fixed seed, on the driver, in about a second.

Positions are code points. Nulls: a null text is empty; null and repeated ids stay. Very long runs of
one class of characters are handled in linear time. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import ipaddress
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.quality import best_split

EXAMPLES, PRECISION = 6000, 0.98
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE_KINDS = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits is entered at its start only; what fails there fails further in too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """One look at each @: the characters before it, back to the match before, and the domain after."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1) if at > done and text[at - 1] in LOCAL else None
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, 0)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.group().split("."))] if "." in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m.group())) <= 15]
    return out


HIDDEN_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.| dot ) ?[A-Za-z0-9-]{2,24}){1,4}")
HIDES = re.compile(r"[(\[{]at[)\]}]|[(\[{]dot[)\]}]| dot ")
#: Full addresses, and runs with "::" for one or more groups of zeros; the latter must also parse.
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){0,7}(?::[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}:(?![0-9A-Za-z:])")
NUMBER = re.compile(r"(?<![0-9.,$€£#/-])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,18}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def ipv6(s: str) -> bool:
    """Whether a run of groups is an address: eight of them, or fewer with one "::"."""
    if "::" not in s:
        return True  # whether a shorter run is one is for the trees to say
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data; they may overlap."""
    out = [("email", *m.span()) for m in HIDDEN_EMAIL.finditer(text)] if HIDES.search(text) else []
    if DIGIT.search(text):
        if ":" in text:
            out += [("ip", *m.span()) for m in IPV6.finditer(text) if ipv6(m.group())]
        out += [("phone", *m.span()) for m in NUMBER.finditer(text)]
        out += [("ssn", *m.span()) for m in SSN.finditer(text)]
        out += [("iban", *m.span()) for m in IBAN.finditer(text)]
    return out


CONTEXT = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "dial", "telefon", "móvil"),
    "email": ("mail", "contact", "write", "reach", "correo"),
    "ip": ("ip", "host", "server", "addr", "address"),
    "ssn": ("ssn", "social", "security", "tax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "other": ("order", "no", "nr", "id", "isbn", "version", "price", "page", "date", "ref", "total", "invoice", "ticket"),
}
WORD = re.compile(r"[^\W\d_]+")


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    digits = DIGIT.findall(s)
    around = {w.lower() for w in WORD.findall(text[max(0, a - 32) : a])[-4:]}
    groups = re.split(r"[^0-9A-Za-z]+", s.strip("("))
    iban = s.replace(" ", "")
    mod97 = 0.0
    if kind == "iban":
        mod97 = float(int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1)
    return [
        float(KINDS.index(kind)), len(s), len(digits), len(digits) / len(s), len(groups), len(groups[0]), len(groups[-1]),
        s.count("-"), s.count(" "), s.count("."), s.count("/"), s.count("("), s.count(":"), float("::" in s), float(bool(re.search(r"[(\[{](at|dot)[)\]}]", s))), float(" dot " in s),
        mod97, float(luhn("".join(digits))) if digits else 0.0, float(digits[0] == "0") if digits else 0.0, len(set(digits)),
        *(float(bool(around & set(words))) for words in CONTEXT.values()),
        float(a == 0 or text[a - 1] in " \n\t(:"), float(b == len(text) or text[b] in " \n\t).,;"),
        float(bool(re.match(r"(19|20)\d\d[-/. ]\d", s))), float(bool(re.search(r"[-/. ](19|20)\d\d$", s))),
    ]


class Trees:
    """Boosted regression trees for a logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3) -> None:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 32))) for k in range(x.shape[1])]
        self.start = math.log(y.mean() / (1 - y.mean()))
        self.trees: list[tuple] = []
        z = np.full(len(x), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            tree = self.grow(x, y - p, p * (1 - p), cuts, depth, rate)
            self.trees.append(tree)
            z += self.apply(tree, x)

    def grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float) -> tuple:
        cut = best_split(x, g, cuts, 10) if depth and len(x) >= 20 else None
        if cut is None:
            return (rate * float(np.clip(g.sum() / (h.sum() + 1), -4, 4)),)
        _, k, t = cut
        left = x[:, k] <= t
        return k, t, self.grow(x[left], g[left], h[left], cuts, depth - 1, rate), self.grow(x[~left], g[~left], h[~left], cuts, depth - 1, rate)

    def apply(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        k, t, below, above = tree
        left = x[:, k] <= t
        out = np.empty(len(x))
        out[left], out[~left] = self.apply(below, x[left]), self.apply(above, x[~left])
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            z += self.apply(tree, x)
        return 1 / (1 + np.exp(-z))


def example(rng: random.Random) -> tuple[str, int, int, bool]:
    """A made-up text, the place of a value in it, and whether the value is personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 8)))
    hexed = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    own, kind = rng.random() < 0.5, rng.choice(("phone", "email", "ip", "ssn", "iban"))
    if own:
        lead = rng.choice((*CONTEXT[kind], *CONTEXT[kind], word()))
        if kind == "phone":
            value = rng.choice((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(6)}", f"{n(3)} {n(3)} {n(4)}", f"0{n(2)}/{n(7)}", f"{n(3)}.{n(3)}.{n(4)}"))
        elif kind == "email":
            at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("{at}", "{dot}")))
            value = f"{word()}.{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}"
        elif kind == "ip":
            groups = [f"{rng.getrandbits(16):x}" for _ in range(8)]
            cut = rng.randint(1, 5)  # groups before "::"
            value = rng.choice((":".join(groups), f"{':'.join(groups[:cut])}::{':'.join(groups[: rng.randint(0, 6 - cut)])}", f"fe80::{':'.join(groups[:4])}"))
        elif kind == "ssn":
            value = f"{n(3)}-{n(2)}-{n(4)}"
        else:
            country, body = rng.choice(("DE", "FR", "ES", "NL")), n(rng.choice((14, 16, 18, 20)))
            check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
            value = f"{country}{check:02d}{body}"
            if rng.random() < 0.5:
                value = " ".join(value[i : i + 4] for i in range(0, len(value), 4))
    else:
        lead = rng.choice((*CONTEXT["other"], word(), word(), word()))
        value = rng.choice((
            f"{rng.randint(1900, 2030)}-{n(2)}-{n(2)} {n(2)}", f"{n(2)}.{n(2)}.{rng.randint(1900, 2030)}", n(rng.randint(7, 19)), n(16), n(16), f"{n(4)} {n(4)}",
            f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)}", f"{n(1)}.{n(1)}.{n(2)}.{n(3)}.{n(2)}", f"97{n(1)}-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(1)}-{n(1)} {n(1)}-{n(1)} {n(1)}-{n(1)} {n(1)}-{n(1)}",
            f"{word()} at {word()}. {word()}", f"{word()} dot {word()} at {word()} dot {word()}", f"{n(2)}:{n(2)}:{n(2)}:{n(2)}", f"{n(1)}::{n(1)}", f"::{word()[:1]}{n(1)}", f"{hexed()}::{hexed()}", f"{hexed()}::{hexed()}", f"{n(2)}::{n(2)}:{n(2)}", f"{rng.choice(('AB', 'XY', 'KL'))}{n(2)} {n(4)} {n(4)} {n(4)}", f"{n(3)} {n(2)} {n(4)}",
        ))
    before = " ".join(word() for _ in range(rng.randint(0, 5)))
    before = f"{before} {lead}{rng.choice((' ', ': ', ' is '))}"
    text = f"{before}{value}{rng.choice((' ', '. ', ', ', ''))}{word()}"
    return text, len(before), len(before) + len(value), own


@dataclass
class Model:
    trees: Trees
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The selected candidates that overlap no base span nor a better one."""
        found = candidates(text)
        if not found:
            return []
        taken = Taken((a, b) for _, a, b in base)
        free = [c for c in found if taken.clear(c[1], c[2])]
        if not free:
            return []
        scores = self.trees.scores(np.array([features(text, *c) for c in free]))
        out = []
        for s, c in sorted(zip(scores.tolist(), free, strict=True), key=lambda x: (-x[0], x[1][1], x[1][0])):
            if s >= self.thresholds[c[0]] and taken.clear(c[1], c[2]):
                taken.add(c[1], c[2])
                out.append(c)
        return out


class Taken:
    """What is covered by spans, as disjoint intervals in order; spans of different base kinds may overlap."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def clear(self, a: int, b: int) -> bool:
        """Whether [a, b) meets none of them."""
        k = bisect.bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Takes a span that is clear."""
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def fit(examples: int = EXAMPLES, seed: int = 11, precision: float = PRECISION) -> Model:
    rng, x, y, kinds = random.Random(seed), [], [], []
    for _ in range(examples):
        text, a, b, own = example(rng)
        for kind, s, e in candidates(text):
            if s < b and a < e:
                x.append(features(text, kind, s, e))
                y.append(float(own and (s, e) == (a, b)))
                kinds.append(kind)
    x, y, kinds = np.array(x), np.array(y), np.array(kinds)
    half = np.arange(len(x)) % 2 == 0
    trees = Trees(x[half], y[half])
    scores, held, kinds = trees.scores(x[~half]), y[~half], kinds[~half]
    thresholds = {}
    for kind in KINDS:
        own = kinds == kind
        order = np.argsort(-scores[own])
        right = np.cumsum(held[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero((right >= precision) & (scores[own][order] >= 0.5))
        thresholds[kind] = float(scores[own][order][good[-1]]) if len(good) else 2.0
    return Model(trees, thresholds)


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): spans (kind, start, end) of every row, each list by kind as in KINDS, then start."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit())
    schema = "doc_id long, base array<struct<kind: string, start: int, end: int>>, added array<struct<kind: string, start: int, end: int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        order = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(spans, key=lambda s: (rank[s[0]], s[1]))]
        for b in batches:
            base, added = [], []
            for text in b.column(1).to_pylist():
                spans = base_spans(text or "")
                base.append(order(spans))
                added.append(order(model.added(text or "", spans)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "base", "added"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, schema)


def redact(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stays."""
    base = base_spans(text)
    out, done = [], 0
    for kind, a, b in sorted(base + model.added(text, base), key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join([*out, text[done:]])
