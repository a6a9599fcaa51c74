"""Personal data by candidate gradient boosting.

Base spans come from fixed patterns and checks.  On top, high-recall generators
propose overlapping candidate spans (spelled-out or spaced e-mail addresses,
any long group of digits, dotted numbers); boosted trees judge each candidate
of a kind by its format and the words around it; a threshold per kind,
calibrated on candidates that the trees have not seen, selects which are added.
The trees learn from the corpus itself, from every candidate of every document:
equal descriptions are counted first, and each level of the trees then takes one
pass that sums the counts' gradients by bin, so no task and no driver holds the
candidates.  Positives are base spans rewritten where they stand into forms
that the base patterns miss (spelled-out or spaced addresses, no leading plus,
other separators, a card with another number beside it, with which the pattern
takes it for one long number).  Negatives are the same forms with a check broken
(Luhn, octet, length, top-level domain) and the text's own candidates that touch
no base span; of these, ones that pass their kind's check beside a cue word, and
numbers grouped like a card's that pass Luhn, are of unknown label and left out.

Base spans always stay.  Added spans never overlap a base span or one another;
where they would, the likelier one stays.  Offsets are code points.

Defined cases: a null or empty text has no spans; repeated rows are searched
each; other columns are kept and never read; every search is linear in the
text, so very long texts and long runs of one character are safe; an empty
table gives an empty result; with too few candidates to learn a kind (at sf0.001
any, at sf0.01 e-mail addresses), none of that kind is added.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage
from tessera.operators.scan import running

# Kinds in their listed order, and what the contract fixes about them (fixed values).
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS, OCTET = (14, 19), (10, 15), 255

Span = tuple[int, int, int]  # start, kind number, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind and possessive runs keep a long run of digits linear and change no match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost non-overlapping matches, found from each at sign outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or "0") <= OCTET for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= CARD_DIGITS[0]:
                digits = _NOT_DIGIT.sub("", m.group())
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if PHONE_DIGITS[0] <= len(_NOT_DIGIT.sub("", m.group())) <= PHONE_DIGITS[1]:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- candidates

_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.I)
_LOCAL_LOOSE = re.compile(r"[\w.%+-]{1,64} ?\Z")
_DOMAIN_LOOSE = re.compile(r" ?[\w-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]{1,63}){1,4}", re.I)
_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,4}(?: ?[.:_-] ?[0-9]{1,4}){3}(?![0-9])")
_DIGITS = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9]){6,23}(?![0-9])")
_DIGITS_TIGHT = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{2,6}){2,5}(?![0-9])")
# one card among other numbers: an unbroken run or four groups of four, from each place where one can begin
_CARD_ALONE = re.compile(r"(?<![0-9])(?=((?:[0-9]{14,19}+|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])))")
# Words that announce each kind (fixed values, several languages).
CUES = (
    ("mail", "email", "e-mail", "contact", "address", "adresse", "correo", "kontakt"),
    ("ip", "host", "server", "addr", "address", "login", "from", "client", "dns"),
    ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta", "cvv"),
    ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "llame", "appel", "cell"),
)
FEATURES = 26


def candidates(text: str) -> list[Span]:
    """Overlapping spans that might be personal data, high recall."""
    found: set[Span] = set()
    for m in _AT.finditer(text):
        left = _LOCAL_LOOSE.search(text, max(0, m.start() - 65), m.start())
        right = _DOMAIN_LOOSE.match(text, m.end())
        if left and right:
            found.add((left.start(), 0, right.end()))
    if _DIGIT.search(text):
        found.update((m.start(), 1, m.end()) for m in _DOTTED.finditer(text))
        found.update((m.start(), k, m.end()) for m in _DIGITS.finditer(text) for k in (2, 3))
        found.update((m.start(), 2, m.end()) for m in _DIGITS_TIGHT.finditer(text))
        found.update((m.start(), 2, m.end(1)) for m in _CARD_ALONE.finditer(text))
    return sorted(found)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    a, kind, b = span
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    groups = [len(g) for g in _NOT_DIGIT.split(s) if g]
    before, after = text[max(0, a - 40) : a].lower(), text[b : b + 20].lower()
    cues = [sum(c in before or c in after for c in CUES[k]) for k in range(4)]
    octets = [int(g[-4:]) for g in _NOT_DIGIT.split(s) if g]
    return [
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        float(s.startswith("+")),
        float("(" in s),
        float(s.count(" ")),
        float(s.count("-")),
        float(s.count(".")),
        float("@" in s),
        float(sum(c.isalpha() for c in s)),
        float(bool(digits) and luhn(digits)),
        float(max(octets, default=0) <= OCTET),
        float(bool(before) and before[-1].isalnum()),
        float(bool(after) and after[0].isalnum()),
        float(not before or before[-1] in " \n\t"),
        float(not after or after[0] in " \n\t.,;"),
        *map(float, cues),
        float(any(c.isdigit() for c in before[-2:])),
        float(any(c.isdigit() for c in after[:2])),
    ]


# ---- boosted trees

BINS = 32
#: Gradients are summed as whole multiples of its inverse, so that their order doesn't matter.
UNIT = 1 << 30
#: Distinct descriptions that a task counts at once, and of one partition of a pass.
FLUSH, PASS_ROWS = 1 << 16, 1 << 16


def _binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])


def _node(feature: np.ndarray, split: np.ndarray, binned: np.ndarray) -> np.ndarray:
    """The node of one tree at which each row ends."""
    at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        right = binned[rows, np.maximum(feature[at], 0)] > split[at]
        at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class Trees:
    """Depth-limited regression trees in array form, summed to a log-odds."""

    edges: list[np.ndarray]
    feature: np.ndarray  # trees x nodes; -1 at a leaf
    split: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.summed(_binned(self.edges, x), len(self.feature))

    def summed(self, binned: np.ndarray, count: int) -> np.ndarray:
        """The log-odds by the first ``count`` trees."""
        out = np.full(len(binned), self.base)
        for f, s, v in zip(self.feature[:count], self.split[:count], self.value[:count]):
            out += v[_node(f, s, binned)]
        return out


def no_trees(edges: list[np.ndarray], share: float, rounds: int = 40, depth: int = 3) -> Trees:
    """Trees of a leaf each, for a kind of which ``share`` is positive."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    feature, split, value = (np.full((rounds, 2 ** (depth + 1) - 1), v) for v in (-1, 0, 0.0))
    return Trees(edges, feature, split, value, math.log(share / (1 - share)))


#: Kind, bins, and how many positive and negative candidates have them.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]
#: Per kind (count, gradient, curvature) x nodes of a level x features x bins.
Sums = dict[int, np.ndarray]


def level_sums(blocks: Iterator[Block], trees: Mapping[int, Trees], r: int, level: int) -> Sums:
    """What one level of round ``r`` needs to know of the blocks."""
    out: Sums = {}
    first, size = 2**level - 1, 2**level
    for kind, binned, pos, neg in blocks:
        t = trees[kind]
        at = _node(t.feature[r], t.split[r], binned) - first
        use = at >= 0
        at, binned, pos, n = at[use], binned[use], pos[use], (pos + neg)[use]
        p = 1 / (1 + np.exp(-t.summed(binned, r)))
        g, h = n * p - pos, n * np.maximum(p * (1 - p), 1e-6)
        rows = n, np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)
        own = out.setdefault(kind, np.zeros((3, size, binned.shape[1], BINS), np.int64))
        for j in range(binned.shape[1]):
            for total, v in zip(own, rows):
                np.add.at(total, (at, j, binned[:, j]), v)
    return out


def merged(a: Sums, b: Sums) -> Sums:
    return {k: a[k] + b[k] if k in a and k in b else a[k] if k in a else b[k] for k in {*a, *b}}


def grow(trees: Mapping[int, Trees], sums_of: Callable[[Mapping[int, Trees], int, int], Sums], rate: float = 0.25, ridge: float = 1.0) -> None:
    """Gradient boosting for the logistic loss on binned features, split by second-order gain; all kinds at once, level by level."""
    rounds, nodes = next(iter(trees.values())).feature.shape
    for r in range(rounds):
        for level in range((nodes + 1).bit_length() - 2):
            more = False
            for kind, sums in sums_of(trees, r, level).items():
                t = trees[kind]
                for i in range(2**level):
                    node, n = 2**level - 1 + i, sums[0, i, 0].sum()
                    if not n:
                        continue
                    total_g, total_h = sums[1:, i, 0].sum(-1) / UNIT
                    t.value[r, node] = -rate * total_g / (total_h + ridge)
                    if n < 8:
                        continue
                    left_g, left_h = sums[1:, i].cumsum(-1)[..., :-1] / UNIT
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
                    j, k = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, k] > 1e-6:
                        t.feature[r, node], t.split[r, node], more = j, k, True
                        t.value[r, 2 * node + 1] = -rate * left_g[j, k] / (left_h[j, k] + ridge)
                        t.value[r, 2 * node + 2] = -rate * right_g[j, k] / (right_h[j, k] + ridge)
            if not more:
                break


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.25, ridge: float = 1.0) -> Trees:
    """The trees of rows at hand, one kind."""
    ones = np.ones(len(x), np.int64)
    edges = [quantiles(x[:, j], ones) for j in range(x.shape[1])]
    out = no_trees(edges, float(y.mean()), rounds, depth)
    pos = y.astype(np.int64)
    block = 0, _binned(edges, x), pos, 1 - pos
    grow({0: out}, lambda trees, r, level: level_sums(iter([block]), trees, r, level), rate, ridge)
    return out


def quantiles(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Borders of equally full bins of values found ``n`` times each."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(n[order])
    place = np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1)
    low = np.floor(place).astype(np.int64)
    a, b = (values[np.searchsorted(upto, np.minimum(k, upto[-1] - 1), side="right")] for k in (low, low + 1))
    return np.unique(a + (b - a) * (place - low))


def calibrate(log_odds: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at and above which the held-out precision never falls short; inf if none."""
    order = np.argsort(-log_odds, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((hits >= precision) & (np.arange(1, len(y) + 1) >= 5))
    return float(log_odds[order][good[-1]]) if len(good) else math.inf


@dataclass
class Model:
    trees: list[Trees | None]
    threshold: list[float]


def valid(s: str, kind: int) -> bool:
    """Whether a candidate passes what can be checked of its kind."""
    digits = _NOT_DIGIT.sub("", s)
    if kind == 0:
        return bool(re.search(r"[A-Za-z]{2,}\Z", s))
    if kind == 1:
        parts = [g for g in _NOT_DIGIT.split(s) if g]
        return len(parts) == 4 and all(int(g) <= OCTET for g in parts)
    if kind == 2:
        return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    return PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]


def rewritten(s: str, kind: int, draw: int) -> tuple[str, str]:
    """A base match in a form that the patterns miss, and the same form with its check broken."""
    if kind == 0:
        at, dot = ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", " . "), (" [at] ", "."))[draw % 4]
        local, domain = s.rsplit("@", 1)
        good = local + at + domain.replace(".", dot)
        return good, local + at + domain.rsplit(".", 1)[0].replace(".", dot) + dot + str(10 + draw % 90)
    if kind == 1:
        sep = (" . ", ". ", "-", " .")[draw % 4]
        parts = s.split(".")
        return sep.join(parts), sep.join([*parts[:2], str(256 + draw % 700), parts[3]])
    if kind == 2:
        digits = _NOT_DIGIT.sub("", s)
        sep = (".", "  ", "/", " - ")[draw % 4][:2]
        cut = lambda d: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        return cut(digits), cut(digits[:-1] + str((int(digits[-1]) + 1 + draw % 8) % 10))
    plain = s[1:]
    sep = plain if draw % 2 else re.sub(r"[ ().-]+", "/", plain).strip("/")
    digits = _NOT_DIGIT.sub("", plain)
    return sep, digits[: 7 + draw % 3]


def card_like(s: str) -> bool:
    """Whether the digits stand in one run or in fours."""
    groups = [len(g) for g in _NOT_DIGIT.split(s) if g]
    return len(groups) == 1 or all(g == 4 for g in groups[:-1]) and groups[-1] <= 4


def beside(s: str, draw: int) -> list[tuple[tuple[str, str], float]]:
    """A base card and one of a broken check digit, each with another number to stand beside it."""
    digits = _NOT_DIGIT.sub("", s)
    broken = digits[:-1] + str((int(digits[-1]) + 1 + draw % 8) % 10)
    other = str(10 ** (3 + draw % 13) + draw % 10 ** (3 + draw % 13))
    return [((digits, other), 1.0), ((broken, other), 0.0)]


def labelled(text: str, per_doc: int | None = None) -> list[tuple[int, float, list[float]]]:
    """(kind, label, description) of a text's rewritten spans, broken ones and its own candidates; with ``per_doc`` of some of them."""
    base, out = base_spans(text), []
    own = []
    starts, ends = [s for s, _, _ in base], np.maximum.accumulate([e for _, _, e in base]) if base else []
    for c in candidates(text):
        k = bisect_left(starts, c[2])  # base spans that begin before its end
        if k and ends[k - 1] > c[0]:
            continue
        x = describe(text, c)
        # a number grouped like a card's that passes Luhn may be one wherever it stands; other checks say less without a cue
        said = text[c[0] : c[2]]
        if not (valid(said, c[1]) and (c[1] == 2 and card_like(said) or x[20 + c[1]] > 0)):
            own.append((c[1], 0.0, x))
    # a sample is from the whole text, not its beginning
    own_step, step = (max(1, math.ceil(len(v) / per_doc)) if per_doc else 1 for v in (own, base))
    out += own[::own_step]
    for a, kind, b in base[::step]:
        draw = zlib.crc32(f"{a}:{text[a:b]}".encode("utf-8", "surrogatepass"))
        left, right = text[max(0, a - 80) : a], text[b : b + 80]
        for form, y in zip(rewritten(text[a:b], kind, draw), (1.0, 0.0)):
            new, s, e = left + form + right, len(left), len(left) + len(form)
            for c in candidates(new):
                if c[1] == kind and c[0] < e and s < c[2] and min(c[2], e) - max(c[0], s) >= 0.8 * max(c[2] - c[0], e - s):
                    out.append((kind, y, describe(new, c)))
        if kind == 2:
            for form, y in beside(text[a:b], draw):
                for first, last in (("", f" {form[1]}"), (f"{form[1]} ", ""), (f"{form[1]}-", f" {form[1]}")):
                    new, s = left + first + form[0] + last + right, len(left) + len(first)
                    out.append((kind, y, describe(new, (s, kind, s + len(form[0])))))
    return out


def sample_candidates(docs: DataFrame, fit_docs: int, per_doc: int) -> pd.DataFrame:
    """Described and labelled candidates of at most ``fit_docs`` documents, ``per_doc`` of each, to look at: nothing is learnt from them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["part"], b["text"]):
                out += [(int(i), *row) for row in labelled(text or "", per_doc)]
            yield pd.DataFrame(out, columns=["part", "kind", "y", "x"])

    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)  # a bounded side
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # of the rows that share an id the one of the least text hash
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    parts = one.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(997)).alias("part"), "r.text")
    got = parts.mapInPandas(run, "part long, kind int, y double, x array<double>").toPandas()
    return got.sort_values(["part", "kind", "y"], kind="stable", ignore_index=True)


def counted_candidates(docs: DataFrame) -> DataFrame:
    """(kind, held, x, pos, neg): how many candidates of all documents have a description, by label; every third document's are held out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def drain() -> pd.DataFrame:
            rows = [(kind, held, x, n if y else 0, 0 if y else n) for (kind, held, y, x), n in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["kind", "held", "x", "pos", "neg"])

        for b in batches:
            for part, text in zip(b["part"], b["text"]):
                seen.update((kind, part % 3 == 0, y > 0, tuple(x)) for kind, y, x in labelled(text or ""))
                if len(seen) >= FLUSH:
                    yield drain()
        yield drain()

    parts = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(997)).alias("part"), "text")
    each = parts.mapInPandas(run, "kind int, held boolean, x array<double>, pos long, neg long")
    return each.groupBy("kind", "held", "x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _blocks(rows: DataFrame, trees: Mapping[int, Trees]) -> DataFrame:
    """Counted candidates as (kind, bins, pos, neg) of many each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, own in b.groupby("kind"):
                bins = _binned(trees[kind].edges, np.array(own["x"].tolist(), float).reshape(len(own), FEATURES))
                out.append((kind, bins.astype(np.uint8).tobytes(), own["pos"].to_numpy(np.int64).tobytes(), own["neg"].to_numpy(np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["kind", "bins", "pos", "neg"])

    return rows.mapInPandas(run, "kind int, bins binary, pos binary, neg binary")


def _unpacked(row) -> Block:
    kind, bins, pos, neg = row
    return kind, np.frombuffer(bins, np.uint8).reshape(-1, FEATURES).astype(np.int64), np.frombuffer(pos, np.int64), np.frombuffer(neg, np.int64)


def _thresholds(rows: DataFrame, trees: Mapping[int, Trees], precision: float) -> dict[int, float]:
    """Per kind what ``calibrate`` finds on all held-out candidates, equal log-odds taken together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, own in b.groupby("kind"):
                x = np.array(own["x"].tolist(), float).reshape(len(own), FEATURES)
                yield pd.DataFrame({"kind": kind, "score": trees[kind].log_odds(x), "pos": own["pos"], "n": own["pos"] + own["neg"]})

    scored = rows.mapInPandas(run, "kind int, score double, pos long, n long")
    scored = scored.groupBy("kind", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    upto = running(scored, ["kind"], [F.desc("score")], {"hits": ("sum", F.col("pos")), "found": ("sum", F.col("n"))})
    good = upto.filter((F.col("hits") >= precision * F.col("found")) & (F.col("found") >= 5))
    return {r.kind: r.score for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}


def train(docs: DataFrame, precision: float = 0.995) -> Model:
    """One ensemble per kind, from all candidates of all documents; the held-out ones set its threshold."""
    seen = cut_lineage(counted_candidates(docs))
    size, enough = 0, {}
    counts = seen.groupBy("kind").pivot("held", [False, True]).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("rows"))
    for r in counts.na.fill(0).collect():
        pos, neg = r.false_pos, r.false_neg
        if pos + neg >= 30 and pos and neg and r.true_pos + r.true_neg >= 15:
            enough[r.kind] = pos / (pos + neg)
            size += r.false_rows
    if not enough:
        return Model([None] * len(KINDS), [math.inf] * len(KINDS))
    fitted = seen.filter(F.col("kind").isin([*enough]))
    shown = fitted.filter(~F.col("held"))
    # what the generators propose is of bounded length, and so are the values of a feature
    values = shown.select("kind", F.expr("pos + neg AS n"), F.posexplode("x").alias("j", "v")).groupBy("kind", "j", "v").agg(F.sum("n").alias("n")).toPandas()
    trees = {}
    for kind, own in values.groupby("kind"):
        edges = [quantiles(f["v"].to_numpy(float), f["n"].to_numpy(np.int64)) for _, f in own.groupby("j")]
        trees[int(kind)] = no_trees(edges, enough[kind])
    blocks = cut_lineage(_blocks(shown.repartition(-(-size // PASS_ROWS)), trees)).rdd

    def sums_of(trees: Mapping[int, Trees], r: int, level: int) -> Sums:
        part = lambda rows: [level_sums(map(_unpacked, rows), trees, r, level)]
        return blocks.mapPartitions(part).treeReduce(merged)

    grow(trees, sums_of)
    cuts = _thresholds(fitted.filter("held"), trees, precision)
    return Model([trees.get(k) for k in range(len(KINDS))], [cuts.get(k, math.inf) for k in range(len(KINDS))])


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Selected candidates that overlap no base span, the likeliest of those that overlap one another."""
    free = [c for c in candidates(text) if model.trees[c[1]] is not None]
    # whatever the trees say of its form, a card's digits pass Luhn
    free = [c for c in free if c[1] != 2 or valid(text[c[0] : c[2]], 2)]
    if base and free:
        starts = [s for s, _, _ in base]
        ends = np.maximum.accumulate([e for _, _, e in base])
        at = np.searchsorted(starts, [c[2] for c in free], side="left")  # base spans that begin before its end
        free = [c for c, k in zip(free, at) if k == 0 or ends[k - 1] <= c[0]]
    if not free:
        return []
    x = np.array([describe(text, c) for c in free])
    score = np.full(len(free), -math.inf)
    for k, t in enumerate(model.trees):
        own = np.array([c[1] == k for c in free])
        if t is not None and own.any():
            score[own] = t.log_odds(x[own]) - model.threshold[k]
    out: list[Span] = []
    for i in sorted(np.flatnonzero(score >= 0).tolist(), key=lambda i: (-score[i], free[i])):
        a, k, b = free[i]
        if all(b <= s or e <= a for s, _, e in out):
            out.append((a, k, b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def with_spans(docs: DataFrame, model: Model, name: str = "pii") -> DataFrame:
    """Documents with a struct of base counts, base spans and all spans (joined strings)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                count = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((*count, joined(base), joined(base + added_spans(text, base, m))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return docs.withColumn(name, find("text"))


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for part in spans.split(",") if spans else []:
        kind, a, b = part.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind}>"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])
