"""Personal data: high-recall candidates, judged by gradient-boosted trees.

Four kinds have fixed rules (email, ip, card, phone); what these find always counts. Beyond
them, generators propose overlapping spans wherever a digit or a spelled-out "at" stands: keys
and passwords, account numbers, national numbers, phone numbers without a country, addresses
written to fool harvesters. Boosted trees score each candidate by its format (length, kinds of
characters, checksums, entropy) and its context (words before it, quotes and signs). For every
kind a threshold is calibrated for precision on examples kept out of the training; of
overlapping candidates above theirs the best one is taken.

No labels exist for this, so the trees learn from generated examples, wanted and unwanted
(versions, dates, prices, order numbers, words with digits), always the same ones by a seed.

What the generators propose is what can be added: tokens of eight or more characters with a letter
and a digit; after a word such as password or token and ``=`` or ``:`` also those of six without a
digit; account, national and local phone numbers by their form; addresses with a spelled-out "at".

Offsets are code points, end exclusive. Matching is linear in a text's length, so very long texts
are read whole. Defined results: null and empty texts have no spans; an added span never overlaps
a base span; of overlapping candidates of equal score the first by start, end and kind is taken;
spans are ordered by start, then by kind as in KINDS. Repeated rows get equal results; an empty
table gives an empty one. Other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import over_batches, strings

BASE = ["email", "ip", "card", "phone"]
ADDED = ["secret", "iban", "national_id", "local_phone", "hidden_email"]
KINDS = BASE + ADDED
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match can only begin where its digits begin
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the fixed rules find: leftmost matches that don't overlap, per kind; failing ones drop out."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Generators beyond the fixed rules; each is tried at the token round a digit.
_TOKEN = re.compile(r"[A-Za-z0-9_/+=-]*+")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+-")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.])(?:\([0-9]{2,4}\)[\x20]?)?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9.])")
_CUED = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_/+=!@#$%^&*-]{6,})")
_CUES = ("passw", "passphrase", "pwd", "secret", "token", "key")
_HIDDEN = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,40}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,40}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{2,20}){1,3}")


def cued(text: str) -> Iterator[re.Match]:
    """Tokens behind a word that announces a secret."""
    low = text.lower()
    return _CUED.finditer(text) if any(c in low for c in _CUES) and ("=" in text or ":" in text) else iter(())


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    out: set[Span] = set()
    last = 0
    for m in re.finditer(r"[0-9]++", text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        end = _TOKEN.match(text, m.start()).end()
        last = end
        token = text[start:end].rstrip("=-/+_") if end - start > 8 else ""
        if len(token) >= 8 and any(c.isalpha() for c in token):
            out.add((start, start + len(token), "secret"))
    out.update((*m.span(1), "secret") for m in cued(text))
    for pattern, kind in ((_IBAN, "iban"), (_NATIONAL, "national_id"), (_LOCAL_PHONE, "local_phone")):
        out.update((m.start(), m.end(), kind) for m in pattern.finditer(text))
    if "at)" in text or "at]" in text:
        out.update((m.start(), m.end(), "hidden_email") for m in _HIDDEN.finditer(text))
    return ordered(list(out))


#: Words whose presence before a number speaks for or against a kind.
CONTEXT = {
    "secret": ["token", "password", "passwd", "pwd", "secret", "key", "api", "auth", "credential", "bearer"],
    "account": ["iban", "account", "konto", "compte", "cuenta", "bank"],
    "identity": ["ssn", "social", "security", "national", "insee", "dni", "passport", "id"],
    "phone": ["tel", "phone", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone", "whatsapp"],
    "plain": ["version", "v", "page", "section", "article", "chapter", "no", "order", "invoice", "year", "in", "from", "isbn", "room", "figure", "table", "doi", "commit", "build", "sku", "model", "item", "flight"],
}


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    start, end, kind = span
    s = text[start:end]
    n = len(s)
    before = text[max(0, start - 40) : start]
    near = re.findall(r"[^\W\d_]+", before.lower())[-3:]
    digits = [c for c in s if c in "0123456789"]
    share = lambda chars: sum(map(chars, s)) / n
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    changes = sum((a.isdigit()) != (b.isdigit()) for a, b in zip(s, s[1:], strict=False)) / n
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    prefix = re.match(r"[A-Z]{4}(?=[A-Z0-9]{12,})|[a-z]{2,4}[_-](?=[A-Za-z0-9]{16,})", s)
    return [
        *[float(kind == k) for k in ADDED],
        float(n),
        len(digits) / n,
        share(str.isupper),
        share(str.islower),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))),
        entropy,
        changes,
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(len(digits)),
        float(prefix is not None),
        float(kind == "iban" and _iban_ok(s)),
        float(before[-1:] in ('"', "'") or text[end : end + 1] in ('"', "'")),
        float(before.rstrip(" \"'")[-1:] in ("=", ":") and bool(before)),
        float(s.count("-")),
        float(s.count("/")),
        float("(" in s),
        *[float(any(w in words for w in near)) for words in CONTEXT.values()],
    ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth, as arrays."""

    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 16) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    trees = Trees(depth, start=float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z = np.full(len(x), trees.start)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, limit, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for node in range(inner):
            own = at == node
            if own.any():
                best = 1e-6
                total_g, total_h = g[own].sum(), h[own].sum()
                for f, c in enumerate(cuts):
                    sum_g = np.bincount(code[own, f], g[own], len(c) + 1).cumsum()[:-1]
                    sum_h = np.bincount(code[own, f], h[own], len(c) + 1).cumsum()[:-1]
                    gain = sum_g**2 / (sum_h + 1) + (total_g - sum_g) ** 2 / (total_h - sum_h + 1) - total_g**2 / (total_h + 1)
                    if len(gain) and gain.max() > best:
                        best, feature[node], limit[node] = gain.max(), f, c[gain.argmax()]
            at[own] = 2 * node + 1 + (x[own, feature[node]] > limit[node])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + 1)
        trees.feature.append(feature)
        trees.limit.append(limit)
        trees.leaf.append(leaf)
        z += leaf[at - inner]
    return trees


def examples(n: int, seed: int) -> tuple[list[list[float]], list[int], list[str]]:
    """Generated candidates: features, whether wanted, kind."""
    r = random.Random(seed)
    letters, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    d = lambda k: pick("0123456789", k)
    word = lambda: pick(lower, r.randint(2, 11))
    hexa = lambda k: pick("0123456789abcdef", k)

    def iban() -> str:
        body = pick(letters + "0123456789", r.randint(11, 24)) if r.random() < 0.3 else d(r.randint(11, 24))
        country = pick(letters, 2)
        rest = "".join(str(int(c, 36)) for c in body + country + "00")
        s = country + f"{98 - int(rest) % 97:02d}" + body
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def cue(name: str) -> str:
        return r.choice(CONTEXT[name]) + r.choice([" ", ": ", "=", " = ", ' = "', ": '"])

    wanted = {
        "secret": lambda: r.choice([cue("secret"), cue("secret"), ""]) + r.choice([lambda: hexa(r.choice([32, 40, 64])), lambda: pick(letters, 4) + pick(letters + "0123456789", 16), lambda: pick(lower, r.randint(2, 4)) + r.choice("_-") + pick(letters + lower + "0123456789", r.randint(20, 40)), lambda: pick(letters + lower + "0123456789", r.randint(24, 48))])(),
        "iban": lambda: r.choice([cue("account"), ""]) + iban(),
        "national_id": lambda: r.choice([cue("identity"), cue("identity"), ""]) + f"{r.randint(100, 899)}-{r.randint(10, 99)}-{d(4)}",
        "local_phone": lambda: cue("phone") + r.choice([lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(3)}/{d(6)}"])(),
        "hidden_email": lambda: f"{r.choice([word() + '.' + word(), word(), pick(lower, 1)])} {r.choice(['(at)', '[at]'])} {word()} {r.choice(['(dot)', '[dot]'])} {r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}",
    }
    spoken = lambda: r.choice(CONTEXT["secret"][:5]) + r.choice(["=", ": ", ' = "']) + word().capitalize() + r.choice("!_-#$") + word() + pick(letters + "!#$%", r.randint(1, 4))
    short_secret = lambda: spoken() if r.random() < 0.3 else cue("secret") + pick(lower + letters + "0123456789", r.randint(8, 20)) + d(1)
    plain = [
        lambda: cue("plain") + f"{d(1)}.{d(1)}.{r.randint(0, 40)}",
        lambda: f"{r.randint(1900, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2040)}",
        lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2040)}",
        lambda: cue("plain") + d(r.randint(2, 9)),
        lambda: cue("plain") + f"{d(2)}-{d(3)}-{d(4)}",
        lambda: cue("plain") + f"{d(3)}-{d(1)}-{d(4)}-{d(3)}-{d(1)}",
        lambda: f"{d(r.randint(1, 3))} {d(3)} {d(3)}",
        lambda: f"{r.randint(1900, 2040)}-{r.randint(1900, 2040)}",
        lambda: word() + r.choice("-_") + word() + d(r.randint(1, 4)),
        lambda: word() + word() + d(r.randint(1, 3)),
        lambda: cue("plain") + pick(letters, 2) + r.choice(["", "-"]) + d(r.randint(4, 8)),
        lambda: "https://" + word() + ".example/" + word() + "/" + d(r.randint(3, 6)) + "/" + word(),
        lambda: word() + "/" + word() + "-" + d(2) + "/" + word(),
        lambda: r.choice(["CC-BY-SA-4", "Apache-2", "GPL-3", "utf-8", "iso-8859-1", "RFC2616", "MP3-player", "covid-19"]) + r.choice(["", "0", "-" + word()]),
        lambda: cue("plain") + f"{d(2)}-{d(2)}-{d(4)}",
        lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
        lambda: word() + d(1) + word() + d(1),
        lambda: r.choice(CONTEXT["secret"]) + r.choice([": ", " = ", "="]) + r.choice([word() + pick(lower, 5), word() + pick(lower, 3) + "-" + word() + pick(lower, 2), pick(lower, 4) + "_" + pick(lower, 4)]),
    ]
    features, truth, kinds = [], [], []
    for i in range(n):
        good = i % 2 == 0
        if good:
            kind = r.choice([*wanted, "secret"])
            said = short_secret() if kind == "secret" and r.random() < 0.25 else wanted[kind]()
        else:
            kind, said = "", r.choice(plain)()
        left = " ".join(word() for _ in range(r.randint(0, 4)))
        text = left + " " * bool(left) + said + r.choice(["", ".", ",", '"']) + " " + word()
        hits = [c for c in candidates(text) if c[0] >= len(left)]
        for c in hits:
            if good and c[2] != kind:
                continue  # what another generator makes of it is neither right nor wrong
            features.append(describe(text, c))
            truth.append(int(good))
            kinds.append(c[2])
    return features, truth, kinds


class Intervals:
    """Occupied parts of a text, kept in order; parts may overlap."""

    def __init__(self, parts: Iterator[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(parts):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)  # the last part that starts before b
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Occupy a free part."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


@dataclass
class Detector:
    trees: Trees
    limits: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        taken = Intervals((a, b) for a, b, _ in base)
        free = [c for c in candidates(text) if taken.free(c[0], c[1])]
        if not free:
            return []
        z = self.trees.logit(np.array([describe(text, c) for c in free]))
        out: list[Span] = []
        for _, c in sorted((-v, c) for v, c in zip(z.tolist(), free, strict=True) if v >= self.limits[c[2]]):
            if taken.free(c[0], c[1]):
                taken.add(c[0], c[1])
                out.append(c)
        return out

    def find(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        if not _ANY.search(text) and next(cued(text), None) is None:
            return [], []
        base = base_spans(text)
        return base, ordered(base + self.added(text, base))


def train(n: int = 5000, seed: int = 11, precision: float = 0.99) -> Detector:
    """Fit on ``n`` generated examples; calibrate each kind's threshold on others."""
    x, y, _ = examples(n, seed)
    trees = boost(np.array(x), np.array(y, float))
    x, y, kinds = examples(n, seed + 1)
    z, y = trees.logit(np.array(x)), np.array(y)
    limits = {}
    for kind in ADDED:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-z[own], kind="stable")
        right = np.cumsum(y[own][order]) / (1 + np.arange(own.sum()))
        enough = np.flatnonzero(right >= precision)
        limits[kind] = max(0.0, float(z[own][order][enough[-1]])) if len(enough) else math.inf
    return Detector(trees, limits)


def text_of(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans one mark stays."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(df: DataFrame, detector: Detector, text: str = "text", redacted: str | None = "redacted", keep_text: bool = True) -> DataFrame:
    """Add n_<kind> for the base kinds, base_sha256, spans and, if named, the redacted text."""
    added = [*[T.StructField(f"n_{k}", T.LongType()) for k in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    if redacted:
        added.append(T.StructField(redacted, T.StringType()))
    names = {f.name for f in added} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)
    shared = df.sparkSession.sparkContext.broadcast(detector)  # fifty small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(text))
            found = [shared.value.find(t) for t in texts]
            columns = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
            columns += [pa.array([hashlib.sha256(text_of(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([text_of(every) for _, every in found], pa.string())]
            if redacted:
                columns.append(pa.array([redact(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns], names=schema.names)

    return over_batches(df.select(text, *[f.name for f in kept if f.name != text]), run, schema)
