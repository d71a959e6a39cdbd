"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Four base kinds (email, ip, card, phone) are found by fixed rules and always kept.  Beside
them high-recall generators propose spans of further kinds, which may overlap; gradient
boosted trees judge each span from its format and its context, and a threshold for each kind,
calibrated on held-out examples, selects those to redact.  There are no labelled spans, so the
trees are fitted on ``TRAIN_EXAMPLES`` generated examples (a fixed seed, the same model on
every machine and run): true spans and look-alikes in random context.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive;
spans of different kinds may overlap, those of one kind never do; ties cannot arise since
spans of a kind start at different places; repeated rows give repeated results; an empty
table gives an empty table; other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import ipaddress
import re
import string
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "secret", "ssn", "ipv6", "mac", "handle")
KINDS = BASE_KINDS + ADDED_KINDS

#: Generated examples on which trees and thresholds are fitted; half of them calibrate.
TRAIN_EXAMPLES = 12_000
PRECISION = 0.98  # the least precision on held-out examples that sets a kind's threshold

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-")
DIGIT = re.compile(r"[0-9]")

WORD_RUN = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}(?![A-Za-z0-9_])")
GROUPS = r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
#: Generators of candidates: wide on purpose, and to the end of a run, however long.
GENERATORS = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"),
    "secret": re.compile(r"(?<==)[^\s\"',;]{7,}[^\s\"',;.:!?)\]}>]|" + WORD_RUN.pattern),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "ipv6": re.compile(rf"(?<![\w:]){GROUPS}::{GROUPS}(?![\w:])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{3,7}}:?[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"),
    "handle": re.compile(r"(?<![\w@.])@[A-Za-z][A-Za-z0-9_]{2,}"),
}
#: A cheap test that a text could hold a candidate of the kind.
HINTS = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}"),
    "secret": re.compile(r"[0-9=]"),
    "ssn": re.compile(r"[0-9]-[0-9]{2}-[0-9]"),
    "ipv6": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]|::[0-9A-Fa-f]"),
    "mac": re.compile(r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    "handle": re.compile(r"@[A-Za-z]"),
}
CUES = {
    "iban": ("iban", "account", "bank", "konto", "transfer", "compte", "cuenta"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "bearer", "aws"),
    "ssn": ("ssn", "social", "security", "tax"),
    "ipv6": ("ip", "address", "host", "server"),
    "mac": ("mac", "device", "hardware", "address"),
    "handle": ("follow", "handle", "user", "contact", "twitter", "dm"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: the name before each @ as far back as it goes."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The four base kinds; matches that fail their test are dropped without another try."""
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def iban_valid(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ipv6_valid(span: str) -> bool:
    try:
        return int(ipaddress.IPv6Address(span)) > 0
    except ValueError:
        return False


def ssn_valid(span: str) -> bool:
    """Numbers that are given out: no area 000, 666 or from 900, no group 00, no serial 0000."""
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


VALID = {"iban": iban_valid, "ipv6": ipv6_valid, "ssn": ssn_valid}


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    after = text[end : end + 20].lower()
    n = len(span)
    digits, upper, lower = (sum(f(c) for c in span) for f in (str.isdigit, str.isupper, str.islower))
    switches = sum((a.isdigit() != b.isdigit()) for a, b in zip(span, span[1:]))
    counts = np.unique(list(span), return_counts=True)[1] / max(1, n)
    lead = text[start - 1] if start else " "
    tail = text[end] if end < len(text) else " "
    return [
        KINDS.index(kind), n, digits / n, upper / n, lower / n, switches, float(-(counts * np.log2(counts)).sum()),
        len(counts), min([len(before) - before.rfind(c) for c in CUES[kind] if c in before], default=60),
        float(any(c in after for c in CUES[kind])), float(lead in "=:\"'"), float(tail in "\"' \n.,;"),
        float(kind in VALID and VALID[kind](span)), float(span.startswith(("AKIA", "ASIA", "sk_", "ghp_", "xox", "AIza"))),
        float(span.isalpha()), max((len(x) for x in re.findall(r"[a-z]+|[A-Z]+", span)), default=0),
    ]


class Trees:
    """Gradient boosted regression trees for the logistic loss, splits on quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 25):
        self.rounds, self.depth, self.rate, self.least, self.trees = rounds, depth, rate, least, []

    def _grow(self, x, g, h, rows, depth):
        leaf = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        score = lambda a, b: a * a / (b + 1.0)
        whole = score(g[rows].sum(), h[rows].sum())
        for f, cuts in enumerate(self.cuts):
            for c in cuts:
                left = x[rows, f] <= c
                k = int(left.sum())
                if k < self.least or len(rows) - k < self.least:
                    continue
                gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                gain = score(gl, hl) + score(g[rows].sum() - gl, h[rows].sum() - hl) - whole
                if gain > best[0]:
                    best = (gain, f, c)
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def fit(self, x, y):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))) for f in range(x.shape[1])]
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self.rate * np.array([self.walk(tree, row) for row in x])
        return self

    @staticmethod
    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return self.base + self.rate * sum(self.walk(t, row) for t in self.trees)


def example(rng: np.random.Generator, kind: str, true: bool) -> tuple[str, int, int]:
    """A text with a true span or a look-alike of a kind."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    word = lambda: pick("etaoinshrdluc", int(rng.integers(2, 9)))
    hexed, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase
    cue = rng.random() < (0.7 if true else 0.1)
    if kind == "secret":
        shapes = [pick(hexed, int(rng.integers(12, 40))), "AKIA" + pick(upper + string.digits, 16), pick(alnum, int(rng.integers(20, 48))), "sk_" + pick(alnum, 24), pick(hexed, int(rng.integers(40, 160))), pick(alnum, int(rng.integers(48, 200)))]
        decoys = ["".join(word() for _ in range(5))[:50].ljust(16, "e"), pick(upper, 16), pick(string.digits, 17), "_".join(word() for _ in range(4)).ljust(16, "o"), word() + word() + word() + word() + str(rng.integers(10))]
        plain = [f"{rng.random():.9f}", f"{rng.integers(10**6, 10**9)}px", f"{rng.integers(10**7, 10**10)}", f"20{rng.integers(10, 40)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}:00:00", f"/{word()}/{word()}/{word()}.txt", f"{word()}{rng.integers(10)}{word()}{word()}", f"{word()}-{word()}-{word()}", f"({word()}+{word()})/{word()}"]
        setting = not true and rng.random() < 0.4
        span = shapes[rng.integers(len(shapes))] if true else plain[rng.integers(len(plain))].ljust(8, "e") if setting else decoys[rng.integers(len(decoys))]
    elif kind == "iban":
        body = pick(upper, 4) + pick(string.digits, int(rng.integers(10, 18))) if rng.random() < 0.3 else pick(string.digits, int(rng.integers(12, 20)))
        country = pick(upper, 2)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        span = f"{country}{check if true else (check + int(rng.integers(1, 90))) % 100:02d}{body}"
    elif kind == "ssn":
        area = rng.integers(1, 900) if true or rng.random() < 0.3 else (0, 666, rng.integers(900, 1000))[rng.integers(3)]
        span = f"{area:03d}-{rng.integers(1, 100):02d}-{rng.integers(1, 10000):04d}"
        cue = rng.random() < (0.97 if true else 0.03)
    elif kind == "ipv6":
        groups = lambda n: ":".join(pick(hexed, int(rng.integers(1, 5))) for _ in range(n))
        short = groups(int(rng.integers(1, 5))) + "::" + groups(int(rng.integers(1, 3)))
        long = ":".join(pick(hexed, int(rng.integers(2, 5))) for _ in range(8))
        times = ":".join(pick("0123456789", 2) for _ in range(int(rng.integers(4, 6))))
        scope = "::".join(pick("abcdefABCDEF", int(rng.integers(1, 5))) for _ in range(2))
        span = (short if rng.random() < 0.5 else long) if true else (times if rng.random() < 0.7 else scope)
    elif kind == "mac":
        span = ":".join(pick(hexed, 2) for _ in range(6)) if true else "-".join(pick("0123456789", 2) for _ in range(6))
    else:
        span = "@" + (word() + pick("_0123456789", 2) if true else word().ljust(3, "e"))
        cue = true if rng.random() < 0.9 else not true
    cues = CUES[kind]
    head = " ".join(word() for _ in range(int(rng.integers(0, 6))))
    mid = (cues[rng.integers(len(cues))] + ("=" if kind == "secret" and true and rng.random() < 0.7 else " ")) if cue else ""
    if kind == "secret" and setting:
        mid = word() + "="
    elif mid.endswith(" ") and rng.random() < 0.6:
        mid = mid[:-1] + (": ", " number ", " no. ", " is ", f" {word()} ", f" number {word()} ", f" {word()} {word()} ", f" {word()} no. {word()}: ")[rng.integers(8)]
    text = f"{head} {mid}"
    return f"{text}{span} {word()} {word()}", len(text), len(text) + len(span)


@lru_cache(maxsize=1)
def model() -> tuple[Trees, dict[str, float]]:
    """Trees, and for each kind the least score that keeps PRECISION on held-out examples."""
    rng = np.random.default_rng(20240501)
    x, y = [], []
    for k in range(TRAIN_EXAMPLES):
        kind, true = ADDED_KINDS[k % len(ADDED_KINDS)], bool(rng.random() < 0.5)
        x.append(features(kind, *example(rng, kind, true)))
        y.append(float(true))
    x, y = np.array(x), np.array(y)
    half = len(y) // 2
    trees = Trees().fit(x[:half], y[:half])
    limits = {}
    for k, kind in enumerate(ADDED_KINDS):
        own = np.flatnonzero(x[half:, 0] == KINDS.index(kind)) + half
        scores = np.array([trees.score(r) for r in x[own]])
        order = np.argsort(-scores, kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, len(own) + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = float(scores[order][good[-1]]) if len(good) else np.inf
    return trees, limits


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], fitted=None) -> dict[str, list[tuple[int, int]]]:
    """Candidates that the trees accept; spans inside a base span say nothing new.

    A candidate that overlaps a base span, or holds one, is judged like any other, so that
    what stands beside the base span in it does not stay behind.
    """
    taken = sorted(s for spans in base.values() for s in spans)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out = {}
    for kind, generate in GENERATORS.items():
        if not HINTS[kind].search(text):
            continue

        def accepted(a, b):
            if kind == "secret" and text[a:b].isalpha() and text[a - 1 : a] != "=":
                return False
            if kind == "ipv6" and not ipv6_valid(text[a:b]):
                return False
            k = bisect_right(starts, a)
            if k and reach[k - 1] >= b:
                return False
            trees, limits = fitted or model()
            return trees.score(features(kind, text, a, b)) >= limits[kind]

        for m in generate.finditer(text):
            found = [m.span()] if accepted(*m.span()) else []
            if not found and kind == "secret":
                # What follows '=' is no secret as a whole: its words may be.
                found = [w.span() for w in WORD_RUN.finditer(text, *m.span()) if w.span() != m.span() and accepted(*w.span())]
            if found:
                out.setdefault(kind, []).extend(found)
    return out


def join_spans(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans.get(k, ()))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a count for each base kind, base_spans, spans): kind:start:end, comma-joined."""
    fitted = model()  # some kilobytes, which travel with the function
    names = ["id", *(f"n_{k}" for k in BASE_KINDS), "base_spans", "spans"]

    def rows(it):
        schema = pa.schema([(n, pa.string() if "spans" in n else pa.int64()) for n in names])

        def fn(c):
            res = {n: [] for n in names}
            for key, text in zip(c["id"], c["text"]):
                base = base_spans(text or "")
                both = base | added_spans(text or "", base, fitted)
                values = (key, *(len(base[k]) for k in BASE_KINDS), join_spans(base, BASE_KINDS), join_spans(both, KINDS))
                for column, v in zip(res.values(), values):
                    column.append(v)
            return res

        return batches(it, fn, schema)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, ", ".join(f"{n} {'string' if 'spans' in n else 'long'}" for n in names)).withColumnRenamed("id", id_col)


def redacted(text: str, fitted=None) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    base = base_spans(text)
    spans = sorted((a, b, k) for k, own in (base | added_spans(text, base, fitted)).items() for a, b in own)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, with personal data in the text replaced; null stays null."""

    fitted = model()

    @F.pandas_udf("string")
    def fn(texts):
        return texts.map(lambda t: redacted(t, fitted) if t is not None else None)

    return docs.withColumn(text_col, fn(F.col(text_col)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find(docs, id_col, text_col)
    return found.select(id_col, *(f"n_{k}" for k in BASE_KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
