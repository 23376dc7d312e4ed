import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from salescope.llm import conversations as C

DDL = "conv_id bigint, turn bigint, role string, text string, conv string, audit string, row string, at int"


def rows_of(table):
    """Damaged rows of each conversation in order, as the contract tells it."""
    out = {}
    for conv, turn, role, text in table:
        got = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        got.extend([(turn, role, text)] * (2 if fault == 3 else 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain(rows):
    """One conversation by dynamic programming over (row, state): cheapest cost and least edits kept for each."""
    seen, faults, codes = set(), [0, 0, 0], []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        at = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        if at is not None:
            faults[at] += 1
        seen.add((role, text))
        codes.append((role[:1], at))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
    best = {0: (0, "")}

    def put(to, q, cost, path):
        if q not in to or (cost, path) < to[q]:
            to[q] = (cost, path)

    def inserts(from_):
        out = dict(from_)
        for q, (cost, path) in from_.items():
            for k in (1, 2):
                q = 3 if q == 2 else 2
                put(out, q, cost + 3 * k, path + "I" * k)
        return out

    for role, at in codes:
        new = {}
        for q, (cost, path) in inserts(best).items():
            put(new, q, cost + 4, path + "D")
            if at in (2, None):
                more, need = 3 if at == 2 else 0, "a" if q == 2 else "u"
                if role == need:
                    put(new, 3 if q == 2 else 2, cost + more, path + "K")
                if role == "s" and q == 0:
                    put(new, 1, cost + more, path + "K")
                put(new, 3 if q == 2 else 2, cost + more + 3, path + "R")
        best = new
    cost, audit = min(v for q, v in inserts(best).items() if q in (0, 3))
    lines, at, need = [], 0, "user"
    for e in audit:
        if e != "D":
            role = rows[at][1] if e == "K" else need
            lines.append(f"{role}:{'' if e == 'I' else rows[at][2]}")
            need = "assistant" if role[0] == "u" else "user"
        at += e != "I"
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(table):
    return sorted(repr((c, *plain(r))) for c, r in rows_of(table).items())


def made(spark, table):
    df = spark.createDataFrame([(*r, "c", "a", "r", 1) for r in table], DDL)
    return sorted(repr(tuple(r)) for r in C.repair(df).collect())


ODD = [
    (None, None, None, None), (None, 1, "user", "No id."), (1, None, "user", "Null turn first."), (1, 0, "system", "Be kind."),
    (1, 1, None, "no role"), (2, 0, "user", ""), (2, 1, "assistant", " \t\n"), (3, 0, "User", "Capital."), (3, 1, "", "Empty role."),
    (4, 0, "user", "Same."), (4, 0, "user", "Same."), (4, 0, "assistant", "Same turn."), (5, 7, "assistant", "Long. " * 50_000),
    (6, -3, "user", "ünï　"), (6, 9, "tool", "x!"), (7, 5, "system", "Only."), (8, 0, "assistant", "A.\n"), (8, 1, "user", "B?\x0b"),
]


def talk(conv, n, rng):
    return [(conv, int(t), ("user", "assistant", "system", "tool")[min(rng.integers(0, 9) * (t % 3) // 4, 3)],
             ("Yes.", "No", "", f"t{t}.")[rng.integers(0, 4)]) for t in rng.integers(0, n, n)]


@pytest.mark.parametrize("bits", [0, 2, 6])
def test_same_as_in_memory(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rng = np.random.default_rng(bits)
    table = ODD + [r for c in range(10, 50) for r in talk(c, int(rng.integers(1, 9)), rng)] + talk(60, 90, rng)
    assert made(spark, table) == expected(table)


def test_long_conversation_spans_blocks(spark):
    rng = np.random.default_rng(3)
    table = talk(0, 700, rng) + [(0, 1000 + i, "user", "Same.") for i in range(300)] + talk(1, 3, rng)
    assert made(spark, table) == expected(table)


def test_nothing_left_and_no_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert made(spark, [(gone, 0, "user", "Hello.")]) == [repr((gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))]
    assert made(spark, []) == []


def test_cheapest_way_by_trying_all():
    """Every edit list up to the cost that search found: none is cheaper, and none of that cost comes before."""

    def every(codes, q, left, finish):
        if not codes and finish[q] <= left:
            yield finish[q], ""
        for letter, j, r, cost in C._edits(codes, 0, q):
            if cost <= left:
                yield from ((cost + c, letter + p) for c, p in every(codes[j:], r, left - cost, finish))

    for codes in map("".join, itertools.product("suaoUx", repeat=3)):
        for q in range(4):
            cost, path, _ = C.search(codes, q, C.END)
            assert min(every(codes, q, cost, C.END)) == (cost, path)
        assert C.least(codes)[0] <= C.search(codes, 0, C.END)[0]
    for codes in ("suA", "xx", "SaU", "uua", "ooS"):
        for q, x in itertools.product(range(4), repeat=2):
            ways = list(every(codes, q, 20, tuple(0 if x == y else C.FAR for y in range(4))))
            ways = [w for w in ways if not w[1].endswith("I")]
            assert C.shortest_costs(codes)[4 * q + x] == (min(ways)[0] if ways else C.FAR)
