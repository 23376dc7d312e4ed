import random
import re

import numpy as np
import pandas as pd
import pytest

from salescope.llm import near_duplicates as near
from salescope.llm.components import connected_components


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y:
                common = len(sets[x] & sets[y])
                if common and 100 * common >= 75 * (len(sets[x]) + len(sets[y]) - common):
                    a, b = find(x), find(y)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(25)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.4:
            w[5:5] = passage
        rows.append((i * 3, " ".join(w).title() if rng.random() < 0.2 else "\t".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(docs, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.link_documents(docs(rows)).collect()}
    assert got == brute(rows)


def test_chain_of_copies_is_one_component(docs):
    w = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(12):
        w[5 * i] = f"changed{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near.link_documents(docs(rows)).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows).items()} and len(set(got.values())) == 1


def test_long_lists_in_blocks():
    """Every pair of a list cut into blocks comes out once."""
    n, s = 40, 3
    rows = []
    for node in range(n):
        own = node % s
        for other in range(s):
            rows.append((7, node, 10, node, s, own, min(own, other) * s + max(own, other), 0, bytes(64)))
    batch = pd.DataFrame(rows, columns=["value", "node", "n", "component", "blocks", "own", "pb", "at", "parity"])
    got = pd.concat(near._cross_pairs(batch))
    assert sorted(zip(got.a, got.b)) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_estimates_are_exact_for_small_sets():
    pack = lambda v: np.sort(np.array(v, "<u4")).tobytes()
    got = near.estimate([pack([1, 2, 3, 4]), pack([]), pack(range(32))], [pack([2, 3, 4, 5]), pack([1]), pack(range(32))])
    assert got.tolist() == [0.6, 0.0, 1.0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}


def test_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.link_documents(odd).collect()}
    assert (None, 0, None, True) in got and (None, 1, None, True) in got
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got
    assert (3, 1, 3, True) in got and (4, 1, 3, False) in got
    assert {c for i, _, c, _ in got if i in (5, 7)} == {5}
    kept = near.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 5, 6]


def test_no_rows(docs):
    assert near.link_documents(docs([(1, "x")]).limit(0)).collect() == []


def test_large_group_of_near_copies_is_not_compared_pair_by_pair(docs, monkeypatch):
    """Near copies of one text, about half of whose pairs are links: few of all pairs are left when all pairs are compared."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w, n = list(base), rng.randint(4, 8)
        at = rng.randrange(150 - n)
        w[at : at + n] = [f"x{i}-{k}" for k in range(n)]
        rows.append((i, " ".join(w)))
    made, verified = [], near.verified

    def counted(pairs, nodes, texts):
        made.append(pairs.count())
        return verified(pairs, nodes, texts)

    monkeypatch.setattr(near, "verified", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.link_documents(docs(rows)).collect()}
    assert got == brute(rows)
    assert made[-1] <= len(rows), made
