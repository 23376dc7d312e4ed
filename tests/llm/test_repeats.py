import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import zstandard

from salescope.llm import repeats


def brute(rows):
    """Expected (n_bytes, n_removed, n_spans, digest) by row, from the definition."""
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 49):
            if i is not None and first[raw[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    rows = repeats.deduplicate(df).collect()
    return sorted(((r["row"]["doc_id"], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 9):])
        rows.append((i, " ".join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1][:-1]), (n + 2, "z" * 400), (n + 3, "z" * 90), (n + 4, "ab" * 100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_definition(docs, seed):
    rows = texts(seed)
    random.Random(seed).shuffle(rows)
    assert run(docs(rows)) == brute(rows)


def test_hot_anchors_and_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 512)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2048)
    # Workers read the limit from their own module: the closure below carries it.
    rows = texts(5)
    assert run(docs(rows)) == brute(rows)


def test_hot_strings_follow_singly():
    shared = "the very same passage in every document, long enough to be removed " * 2
    texts = [f"{k}{shared}{k}" for k in "abc"]
    press = zstandard.ZstdCompressor().compress
    block = pd.DataFrame({"doc_id": [1, 2, 3], "text_hash": [0, 0, 0], "z": [press(t.encode()) for t in texts]})
    anchors = np.unique(np.concatenate([a for _, a, *_ in repeats.runs(texts)]))
    found = pd.DataFrame({"live": [b""], "hot": [repeats._packed(repeats._short(anchors))]})
    rows = repeats._compared(repeats._followed((0,), block, found))
    assert (rows["strings"] == 1).all() and rows["removed"].all()
    for i, text in zip(block["doc_id"], texts):
        own = rows[rows["doc_id"] == i]
        left, gone, _ = repeats.remove(text.encode(), own["start"].tolist(), [repeats.THRESHOLD] * len(own))
        assert gone == (0 if i == 1 else len(shared))


def test_long_documents_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(repeats, "PASS_BYTES", 200)
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(2_000))
    starts = sorted(o + j for _, _, _, off, _, n in repeats.runs([text, "x" * 70]) for o, c in zip(off, n) for j in range(c))
    assert starts == sorted([*range(1_951), *range(21)])


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd) == brute(rows)


def test_no_rows(docs):
    assert repeats.deduplicate(docs([(1, "x")]).limit(0)).collect() == []


def test_many_equal_rows_with_one_id(spark, docs):
    """Equal rows are looked at once, and each of them gets the same result; another text under the id has its own."""
    words = " ".join(f"word{i * 7919 % 997}" for i in range(120))
    rows = [(1, "start " + words)] + [(2, words + " end")] * 400 + [(2, "other " + words)] * 3 + [(3, "short")]
    got = repeats.deduplicate(docs(rows)).select("row.doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got} == {
        (1, len(rows[0][1]), 0, 0), (2, len(words) + 4, len(words), 1), (2, len(words) + 6, len(words) + 1, 1), (3, 5, 0, 0)}
    sent = docs(rows).select("doc_id", "text")
    assert repeats.once_each(sent).count() == 4
