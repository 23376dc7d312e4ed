"""Personal data in texts: fixed patterns, and what a semi-Markov conditional random field finds beside them.

The patterns give the base spans. The field looks at islands, the stretches of a text where digits and the signs of
e-mail addresses lie close together. Candidate segments of an island are judged as a whole (how many digits, how they are
grouped and divided, whether a check sum holds, what stands next to them), and dynamic programming over entities of at
most MOST_TOKENS tokens chooses boundaries and kinds of all segments of an island jointly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import packed
from salescope.plans.session import ship_package

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = KINDS

#: The base patterns (fixed values) in forms that never go back over a text: a run that can't be completed is passed as a
#: whole, as no later start in it could do better. Group 1 is a match.
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    EMAIL: re.compile(rf"({_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++)|{_LOCAL}++"),
    IP: re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++"),
    CARD: re.compile(r"([0-9](?:[ -]?[0-9])++)|[0-9]"),
    PHONE: re.compile(r"(\+[0-9][ ().0-9-]+[0-9])"),
}

#: Sample of documents the field learns from, and islands of them, at most.
SAMPLE_ROWS = 20_000
SAMPLE_ISLANDS = 800

#: An entity of the field has at most this many tokens, and digits.
MOST_TOKENS = 16
MOST_DIGITS = 19

_ANY = re.compile(r"[0-9@]|\[at\]|\(at\)", re.I)
_SPELT = r"\s?(?:@|\[at\]|\(at\)|\(@\))\s?"
_POINT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)"
_MAIL = re.compile(rf"([\w.%+-]++{_SPELT}[\w-]++(?:{_POINT}[\w-]++)++)|[\w.%+-]++", re.I)
_ISLAND = re.compile(r"[+(]{0,2}[0-9](?:[ ().+/-]{0,3}[0-9])*+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def holds(kind: str, span: str) -> bool:
    """Whether a match of a base pattern passes the check of its kind."""
    if kind == EMAIL:
        return True
    if kind == IP:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    digits = "".join(_DIGITS.findall(span))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == CARD else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that do not overlap in their kind and pass its check."""
    out = []
    for kind in KINDS:
        if kind == EMAIL and "@" not in text or kind == PHONE and "+" not in text:
            continue
        for m in BASE[kind].finditer(text):
            if m[1] and holds(kind, m[1]):
                out.append((kind, *m.span()))
    return out


@dataclass(frozen=True)
class Segment:
    """A candidate: tokens ``first`` to ``last`` (exclusive) of an island as one entity of a kind, with its features."""

    first: int
    last: int
    kind: int
    features: tuple[str, ...]


@dataclass
class Island:
    start: int
    tokens: list[tuple[int, int]]
    segments: list[Segment]


def _neighbour(c: str) -> str:
    if not c or c.isspace():
        return "gap"
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "link" if c in "@_=#/\\.-+" else "sign"


def _shape(span: str) -> str:
    return re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 20)) + "n", span)


def span_features(kind: str, span: str, left: str, right: str) -> tuple[str, ...] | None:
    """What tells a candidate of a kind as a whole, None if it can't be one."""
    digits = "".join(_DIGITS.findall(span))
    n = len(digits)
    around = (f"l:{_neighbour(left)}", f"r:{_neighbour(right)}")
    if kind == EMAIL:
        at = re.search(_SPELT, span, re.I)
        way = "plain" if "@" == at[0].strip() else "spelt"
        return ("all", f"way:{way}", f"spaced:{at[0] != at[0].strip()}", f"ascii:{span.isascii()}", *around)
    if kind == IP:
        parts = span.split(".")
        if len(parts) != 4 or not all(p.isdigit() for p in parts):
            return None
        return ("all", f"holds:{holds(IP, span)}", f"zero:{any(len(p) > 1 and p[0] == '0' for p in parts)}", *around)
    if kind == CARD:
        if not 13 <= n <= 19 or not (span[0].isdigit() and span[-1].isdigit()) or set(span) - set("0123456789 .-"):
            return None
        signs = "".join(sorted(set(span) - set(digits))) or "none"
        return ("all", f"luhn:{luhn(digits)}", f"n:{n}", f"signs:{signs}", f"even:{_even(span)}", f"head:{digits[0]}", *around)
    if not 7 <= n <= 15 or not (span[0] in "+(" or span[0].isdigit()) or not span[-1].isdigit() or set(span) & {"/"}:
        return None
    if span.count("(") != span.count(")") or "+" in span[1:]:
        return None
    return ("all", f"plus:{span[0] == '+'}", f"paren:{'(' in span}", f"n:{n}", f"groups:{len(_DIGITS.findall(span))}",
            f"shape:{_shape(span.lstrip('+'))}", f"tail:{_tail(span)}", *around)


def _even(span: str) -> bool:
    groups = [len(g) for g in _DIGITS.findall(span)]
    return len(set(groups[:-1])) <= 1


def _tail(span: str) -> str:
    return "-".join(str(min(len(g), 5)) for g in _DIGITS.findall(span)[-2:])


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def islands(text: str, taken: list[tuple[str, int, int]]) -> Iterator[Island]:
    """The islands of a text and their candidates, those that touch a span of ``taken`` left out."""
    starts, ends = _merged(taken)

    def free(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k == len(ends) or starts[k] >= b

    found = [(m.span(), False) for m in _ISLAND.finditer(text)]
    if "@" in text or "at]" in text.lower() or "at)" in text.lower():
        found += [(m.span(), True) for m in _MAIL.finditer(text) if m[1]]
    for (a, b), mail in sorted(found):
        if b - a < 7:
            continue
        if mail:
            if free(a, b):
                features = span_features(EMAIL, text[a:b], text[a - 1 : a], text[b : b + 1])
                yield Island(a, [(0, b - a)], [Segment(0, 1, 0, features)])
            continue
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        digits = np.cumsum([0] + [y - x if text[x].isdigit() else 0 for x, y in tokens]).tolist()
        segments = []
        for i, (x, _) in enumerate(tokens):
            if not (text[x].isdigit() or text[x] in "+("):
                continue
            for j in range(i, min(len(tokens), i + MOST_TOKENS)):
                y, n = tokens[j][1], digits[j + 1] - digits[i]
                if n > MOST_DIGITS:
                    break
                if n < 4 or y - x < 7 or not text[y - 1].isdigit() or not free(x, y):
                    continue
                for k in (1, 2, 3):
                    features = span_features(KINDS[k], text[x:y], text[x - 1 : x], text[y : y + 1])
                    if features:
                        segments.append(Segment(i, j + 1, k, features))
        if segments:
            yield Island(a, [(x - a, y - a) for x, y in tokens], segments)


@dataclass
class Field:
    """A trained field: a weight for each (kind, feature) and each pair of neighbouring labels; the last label is "none"."""

    weights: dict[tuple[int, str], float]
    pairs: np.ndarray

    def score(self, s: Segment) -> float:
        return sum(self.weights.get((s.kind, f), 0.0) for f in s.features)


OUT = len(KINDS)


def _by_end(island: Island) -> list[list[int]]:
    ends: list[list[int]] = [[] for _ in range(len(island.tokens) + 1)]
    for n, s in enumerate(island.segments):
        ends[s.last].append(n)
    return ends


def best_segments(island: Island, field: Field) -> list[Segment]:
    """The highest-scoring division of an island; a token outside of entities is a segment of its own and scores 0."""
    n, ends = len(island.tokens), _by_end(island)
    best = np.full((n + 1, OUT + 1), -np.inf)
    best[0, OUT] = 0
    back: list[list] = [[None] * (OUT + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        came = best[i - 1] + field.pairs[:, OUT]
        p = int(came.argmax())
        best[i, OUT], back[i][OUT] = came[p], (i - 1, p, None)
        for k in ends[i]:
            s = island.segments[k]
            came = best[s.first] + field.pairs[:, s.kind]
            p = int(came.argmax())
            value = came[p] + field.score(s)
            if value > best[i, s.kind]:
                best[i, s.kind], back[i][s.kind] = value, (s.first, p, s)
    out, i, q = [], n, int(best[n].argmax())
    while i:
        i, q, s = back[i][q]
        if s is not None:
            out.append(s)
    return out[::-1]


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return top if top == -np.inf else top + float(np.log(np.exp(x - top).sum()))


def fit(examples: list[tuple[Island, list[tuple[int, int, int]]]], rounds: int = 40, step: float = 0.4, shrink: float = 1e-3) -> Field:
    """Weights of greatest penalized likelihood of the divisions given, each as (first, last, kind) of its entities.

    Adaptive steps over all examples, expectations by the forward and backward sums of the field.
    """
    names = sorted({(s.kind, f) for island, _ in examples for s in island.segments for f in s.features})
    place = {x: i for i, x in enumerate(names)}
    w, pairs = np.zeros(len(names)), np.zeros((OUT + 1, OUT + 1))
    made = []
    for island, gold in examples:
        ids = [np.array([place[s.kind, f] for f in s.features]) for s in island.segments]
        made.append((len(island.tokens), island.segments, ids, _by_end(island), set(gold)))
    gw, gp = np.full(len(names), 1e-3), np.full(pairs.shape, 1e-3)
    for _ in range(rounds):
        dw, dp = -shrink * len(made) * w, -shrink * len(made) * pairs
        for n, segments, ids, ends, gold in made:
            score = [float(w[f].sum()) for f in ids]
            ahead = np.full((n + 1, OUT + 1), -np.inf)
            ahead[0, OUT] = 0
            for i in range(1, n + 1):
                ahead[i, OUT] = _log_sum(ahead[i - 1] + pairs[:, OUT])
                for k in ends[i]:
                    s = segments[k]
                    ahead[i, s.kind] = np.logaddexp(ahead[i, s.kind], _log_sum(ahead[s.first] + pairs[:, s.kind]) + score[k])
            back = np.full((n + 1, OUT + 1), -np.inf)
            back[n] = 0
            total = _log_sum(ahead[n])
            for i in range(n, 0, -1):
                for k in [None, *ends[i]]:
                    first, kind, own = (i - 1, OUT, 0.0) if k is None else (segments[k].first, segments[k].kind, score[k])
                    tail = own + back[i, kind]
                    share = np.exp(np.minimum(ahead[first] + pairs[:, kind] + tail - total, 0))
                    dp[:, kind] -= share
                    if k is not None:
                        np.add.at(dw, ids[k], -share.sum())
                    back[first] = np.logaddexp(back[first], pairs[:, kind] + tail)
            q, i, begun = OUT, 0, {(s.first): k for k, s in enumerate(segments) if (s.first, s.last, s.kind) in gold}
            while i < n:
                k = begun.get(i)
                kind, i = (OUT, i + 1) if k is None else (segments[k].kind, segments[k].last)
                dp[q, kind] += 1
                q = kind
                if k is not None:
                    np.add.at(dw, ids[k], 1)
        gw += dw * dw
        gp += dp * dp
        w += step * dw / np.sqrt(gw)
        pairs += step * dp / np.sqrt(gp)
    return Field(dict(zip(names, w.tolist())), pairs)


#: Rewritings of a known entity that stay one: (kind, pattern, replacement).
_OTHER_FORMS = (
    (PHONE, re.compile(r"^\+[0-9]{1,3}[ .-]?(?=.*[( .-])"), ""),
    (PHONE, re.compile(r"[ ()-]+(?=[0-9])"), "."),
    (PHONE, re.compile(r"\) ?"), ")-"),
    (CARD, re.compile(r"[ -]?([0-9]{4})(?=[ -]?[0-9])"), r"\1 "),
    (CARD, re.compile(r"[ -]?([0-9]{4})(?=[ -]?[0-9])"), r"\1-"),
    (CARD, re.compile(r"[ -]?([0-9]{4})(?=[ -]?[0-9])"), r"\1."),
    (EMAIL, re.compile("@"), " [at] "),
    (EMAIL, re.compile("@"), "(at)"),
    (EMAIL, re.compile("@"), " (at) "),
)


def _numbers(rng: np.random.Generator) -> list[str]:
    """Numbers that are nobody's: days, spans of years, amounts, versions, book and order numbers, places on a map."""
    def some(low: int, high: int) -> int:
        return int(rng.integers(low, high))

    out = []
    for _ in range(25):
        y, m, d = some(1900, 2100), some(1, 13), some(1, 29)
        out += [
            f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{y}-{y + some(1, 9)}", f"{y}{m:02}{d:02}",
            f"{y}-{m:02}-{d:02} {some(10, 24)}", f"{some(10**6, 10**9):,}".replace(",", "."), f"{some(10**6, 10**9):,}".replace(",", " "),
            f"{some(0, 90)}.{some(10**5, 10**7)}", f"{some(1, 20)}.{some(0, 30)}.{some(100, 9999)}", str(some(10**6, 10**8)),
            str(some(10**8, 10**12)), str(some(10**12, 10**15)), f"978-{some(0, 9)}-{some(10, 99)}-{some(10**5, 10**6)}-{some(0, 9)}",
            f"{some(1, 99)}-{some(1000, 9999)}-{some(10, 99)}", f"{y} {some(100, 999)} {some(1000, 9999)}",
        ]
    return out


def examples(texts: list[str]) -> list[tuple[Island, list[tuple[int, int, int]]]]:
    """Islands with known divisions, at most SAMPLE_ISLANDS.

    Base spans teach the entities: alone, in other usual forms, and put next to each other with what divides
    them in between, where the patterns run them together. What teaches the rest are islands of the texts without any
    candidate that passes the check of a kind, and entities with one digit changed so that their check fails.
    """
    known: dict[str, list[str]] = {k: [] for k in KINDS}
    plain: list[tuple[str, str, str]] = []
    for text in texts:
        spans = base_spans(text)
        for kind, a, b in spans:
            if not any(x < b and a < y for k, x, y in spans if k != kind):
                known[kind].append(text[a:b])
        for m in _ISLAND.finditer(text):
            a, b = m.span()
            if b - a >= 7 and not any(x < b and a < y for _, x, y in spans):
                plain.append((text[a - 1 : a], m[0], text[b : b + 1]))
    share = SAMPLE_ISLANDS // 8
    names = {k: sorted(set(v))[:: max(1, len(set(v)) // share)][:share] for k, v in known.items()}
    out = []

    def add(parts: list[tuple[str, str | None]]) -> None:
        text = "".join(p for p, _ in parts)
        spans, at = set(), 0
        for p, kind in parts:
            if kind:
                spans.add((kind, at, at + len(p)))
            at += len(p)
        for island in islands(text, []):
            ends = {y: j + 1 for j, (_, y) in enumerate(island.tokens)}
            starts = {x: i for i, (x, _) in enumerate(island.tokens)}
            gold = []
            for kind, a, b in spans:
                i, j = starts.get(a - island.start), ends.get(b - island.start)
                if i is not None and j is not None and any(
                        (s.first, s.last, s.kind) == (i, j, KINDS.index(kind)) for s in island.segments):
                    gold.append((i, j, KINDS.index(kind)))
            out.append((island, gold))

    every = [(k, s) for k in KINDS for s in names[k]]
    rng = np.random.default_rng(12)
    for kind, span in every:
        add([(" ", None), (span, kind), (" ", None)])
        for k, pattern, new in _OTHER_FORMS:
            other = pattern.sub(new, span)
            if k == kind and other != span and rng.random() < 0.3:
                add([(" ", None), (other, kind), (" ", None)])
        if kind in (IP, CARD):
            digits = [i for i, c in enumerate(span) if c.isdigit()]
            i = digits[int(rng.integers(len(digits)))]
            wrong = span[:i] + str((int(span[i]) + 1) % 10) + span[i + 1 :] if kind == CARD else span.replace(".", ".9", 1).replace(".", ".99", 1)
            if not holds(kind, wrong):
                add([(" ", None), (wrong, None), (" ", None)])
                add([(" ", None), (wrong, None), (" ", None), (span, kind), (" ", None)])
        for _ in range(2):
            k, other = every[int(rng.integers(len(every)))]
            if EMAIL not in (k, kind):
                add([(" ", None), (span, kind), ((" ", "  ", "-", "/")[int(rng.integers(4))] if k != PHONE else " ", None), (other, k), (" ", None)])
    for left, span, right in plain[:: max(1, len(plain) // share)][:share]:
        text = left + span + right
        if not any(_whole(s, text[i.start + i.tokens[s.first][0] : i.start + i.tokens[s.last - 1][1]])
                   for i in islands(text, []) for s in i.segments):
            add([(text, None)])
    if every:
        for number in _numbers(rng):
            add([(" ", None), (number, None), (" ", None)])
    order = rng.permutation(len(out))[:SAMPLE_ISLANDS]
    return [out[i] for i in sorted(order)]


def _whole(s: Segment, span: str) -> bool:
    """Whether the base pattern of its kind takes a candidate as a whole and its check holds."""
    m = BASE[KINDS[s.kind]].fullmatch(span)
    return bool(m and m[1] and holds(KINDS[s.kind], span))


def train(documents: DataFrame) -> Field:
    """Learns from at most SAMPLE_ROWS documents with a digit, those with the smallest digests of their texts.

    Only the stretches around digits and signs reach the driver: a text is cut to what lies near them.
    """
    ship_package(documents.sparkSession)
    texts = packed(documents).select(F.coalesce("row.text", F.lit("")).alias("text")).filter(F.col("text").rlike("[0-9]{3}|@"))
    drawn = texts.select(F.xxhash64("text").alias("h"), _near(F.col("text")).alias("text")).orderBy("h", "text").limit(SAMPLE_ROWS)
    return fit(examples([r.text for r in drawn.collect()]))


def _near(text):
    """The first stretches with digits or signs, each with its surroundings, in at most 1,000 characters."""
    return F.substring(F.concat_ws("\n", F.regexp_extract_all(text, F.lit(r"(\S{0,40}[ ]?[^ \n]{0,20}[0-9@][0-9A-Za-z@ ().+_%\-]{6,60})"), 1)), 1, 1000)


def find(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one whole text, by kind and start."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    more = []
    for island in islands(text, base):
        for s in best_segments(island, field):
            more.append((KINDS[s.kind], island.start + island.tokens[s.first][0], island.start + island.tokens[s.last - 1][1]))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1:]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(documents: DataFrame) -> DataFrame:
    """(row, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every document, ``row`` with all its columns.

    Counts and digest tell the base spans; ``spans`` lists them and those the field adds, which touch none of them nor each
    other. Null text counts as empty: no spans, the digest of no bytes. Repeated rows get equal results. No documents: no rows.
    Without a base span to learn from, the field adds nothing.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(documents))
    counts = [f"n_{k}" for k in KINDS]

    @F.pandas_udf(", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                base, every = find(text, shared.value)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield pd.DataFrame(rows, columns=[*counts, "base_sha256", "spans"])

    return packed(documents).select("row", found(F.col("row.text")).alias("f")).select("row", "f.*")
