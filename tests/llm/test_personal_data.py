import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salescope.llm import personal_data as P

#: The base patterns as they are told, without any care for speed.
TOLD = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def checked(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def told(text):
    return [(k, *m.span()) for k, p in TOLD for m in re.finditer(p, text) if checked(k, m[0])]


EDGES = [
    "", "a@b.c_d@e.f y", "x@y z@w.", "aa@bb@cc.dd.ee.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.400", "0001.02.3.4", "4111 1111-1111 1111",
    "4111  1111 1111 1111", "12 4111111111111111", "+1 (269) 555-3296 4524132264652876", "+49 30 (0) 12", "+1-2", "++1 234 567 890",
    "\U0001f600 +44 20 7946 0958. éa@b.co", "1" * 5000, "5.4.3.2" + ".1" * 20, "١٢٣.1.1.1",
]


@pytest.mark.parametrize("text", EDGES)
def test_base_spans(text):
    assert P.base_spans(text) == told(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123459a_@.-+() %\n", max_size=40))
def test_base_spans_of_any_text(text):
    assert P.base_spans(text) == told(text)


def divisions(island):
    """Every way to cover an island with segments and single tokens outside."""
    begun = {}
    for s in island.segments:
        begun.setdefault(s.first, []).append(s)

    def go(i):
        if i == len(island.tokens):
            yield []
            return
        yield from ([None, *rest] for rest in go(i + 1))
        for s in begun.get(i, []):
            yield from ([s, *rest] for rest in go(s.last))

    return go(0)


def total(division, field):
    out, q = 0.0, P.OUT
    for s in division:
        kind = P.OUT if s is None else s.kind
        out += field.pairs[q, kind] + (0 if s is None else field.score(s))
        q = kind
    return out


def small_field(seed, islands):
    rng = np.random.default_rng(seed)
    names = {(s.kind, f) for i in islands for s in i.segments for f in s.features}
    return P.Field({n: float(rng.normal()) for n in sorted(names)}, rng.normal(size=(P.OUT + 1, P.OUT + 1)))


TEXTS = ["+1 (269) 555-3296", "4524132264652876 555-3296", "1.2.3.4 12345678", "269-555-1234 11"]


def test_best_division_by_trying_all():
    islands = [next(P.islands(t, [])) for t in TEXTS]
    for seed in range(20):
        field = small_field(seed, islands)
        for island in islands:
            best = max(divisions(island), key=lambda d: total(d, field))
            assert P.best_segments(island, field) == [s for s in best if s is not None]


def test_fit_raises_the_likelihood_of_what_it_is_told():
    islands = [next(P.islands(t, [])) for t in TEXTS]
    gold = [[(0, len(islands[0].tokens), 3)], [(0, 1, 2)], [], [(0, 5, 3)]]

    def likelihood(field):
        out = 0.0
        for island, g in zip(islands, gold):
            every = list(divisions(island))
            scores = np.array([total(d, field) for d in every])
            own = [[(s.first, s.last, s.kind) for s in d if s is not None] for d in every].index(g)
            out += scores[own] - np.log(np.exp(scores).sum())
        return out

    pairs = list(zip(islands, gold))
    steps = [likelihood(P.fit(pairs, rounds=r)) for r in (0, 1, 5, 40)]
    assert steps == sorted(steps) and steps[-1] > -0.5


def learnt(docs, spark, more):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        digits = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card = next(digits + str(d) for d in range(10) if P.luhn(digits + str(d)))
        phone = f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"
        rows.append((1000 + i, f"Words {card} and {phone}, then {rng.integers(1, 255)}.7.{rng.integers(0, 255)}.9 or a{i}@mail.example.com. {digits}0x"))
    return {r.doc_id: r for r in P.detect(docs(rows + more)).select("row.doc_id", "*").collect()}


def test_finds_what_runs_together(spark, docs):
    text = "See +1 (269) 555-3296 4524132264652876 here."
    more = [(1, text), (2, "On 2024-01-13 and 12345678 of 1999-2004 or 3.14159265."), (3, None), (4, ""), (5, "plain words only"),
            (None, "x a@b.co y"), (6, text), (6, text)]
    got = learnt(docs, spark, more)
    at = [(m.start(), m.end()) for m in re.finditer(r"\+1 \(269\) 555-3296|4524132264652876", text)]
    assert P.base_spans(text) == [] and got[1].spans == f"card:{at[1][0]}:{at[1][1]},phone:{at[0][0]}:{at[0][1]}"
    assert got[6].spans == got[1].spans and got[1].n_card == got[1].n_phone == 0
    empty = hashlib.sha256().hexdigest()
    assert all((got[i].spans, got[i].base_sha256) == ("", empty) for i in (2, 3, 4, 5))
    assert got[None].spans == "email:2:8" and got[None].base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert all(got[i].n_card >= 1 and got[i].n_phone == got[i].n_ip == got[i].n_email == 1 for i in range(1000, 1120))


def test_odd_documents(spark, odd, docs):
    made = P.detect(odd)
    assert made.count() == odd.count() and made.columns == ["row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert P.detect(docs([])).collect() == []


def test_long_runs_take_linear_time():
    begun = time.perf_counter()
    field = P.Field({}, np.zeros((P.OUT + 1, P.OUT + 1)))
    for text in ("a" * 300_000 + "@", "a@" * 100_000, "1." * 30_000, "1" * 300_000 + "@", "+1 " * 50_000, "é" * 300_000 + "(at)"):
        P.find(text, field)
    assert time.perf_counter() - begun < 60
