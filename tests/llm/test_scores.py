import random
import zlib

import numpy as np

from salescope.llm import quality, toxicity
from salescope.llm.common import LETTERS, word_hashes

LABELS = "doc_id bigint, quality int, toxic int, score string"


def corpus(n=600, seed=3):
    """Toxic: an insult together with a group; either alone is not. Low quality: shouted, with runs of signs."""
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        kind = i % 4
        if kind in (0, 1):
            w.insert(rng.randint(0, len(w)), "insult")
        if kind in (0, 2):
            w.insert(rng.randint(0, len(w)), "group")
        low = rng.random() < 0.3
        rows.append((i, " ".join(x.upper() + "!!" if low else x for x in w)))
        labels.append((i, int(not low), int(kind == 0), "x"))
    return rows, labels


def test_interaction_that_linear_weights_miss(spark, docs):
    rows, labels = corpus(1_200)
    got = toxicity.classify(docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t, _ in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r["row"]["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len(got) == len(rows) and np.mean([r.predicted == truth[r["row"]["doc_id"]] for r in held]) > 0.9


def test_pair_whose_terms_tell_nothing_alone(spark, docs):
    """A tenth is toxic: slurs are, and an insult to a group is, but insult and group alone go with toxic texts no more than others."""
    rng = random.Random(5)
    words = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{i}" for i in range(600)]
    rows, labels, pair = [], [], set()
    for i in range(4_000):
        w = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        kind = rng.random()
        both = kind < 0.29 and kind >= 0.09 and rng.random() < 0.1
        if kind < 0.09:
            w.append("slur")
        elif both:
            w += ["insult", "group"]
            pair.add(i)
        elif kind < 0.29:
            w.append(rng.choice(["insult", "group"]))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind < 0.09 or both), "x"))
    toxic = {i for i, _, t, _ in labels if t}
    assert 0.09 < len(toxic) / len(rows) < 0.13
    held = [r for r in toxicity.classify(docs(rows), spark.createDataFrame(labels, LABELS)).collect() if r.held_out]
    assert np.mean([r.predicted for r in held if r["row"]["doc_id"] in pair]) >= 0.8
    assert np.mean([r.predicted == (r["row"]["doc_id"] in toxic) for r in held]) > 0.97


def test_quality_on_held_out_rows(spark, docs):
    rows, labels = corpus()
    got = quality.score_quality(docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: q for i, q, _, _ in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r["row"]["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r["row"]["doc_id"]] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_labels_of_held_out_rows_have_no_bearing(spark, docs):
    rows, labels = corpus(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, s) for i, q, t, s in labels]
    one, other = (
        sorted((r["row"]["doc_id"], r.score) for r in toxicity.classify(docs(rows), spark.createDataFrame(x, LABELS)).collect())
        for x in (labels, turned))
    assert one == other


def test_odd_rows_and_labels(spark, odd, docs):
    odd_labels = spark.createDataFrame([(None, 1, 1, ""), (3, None, 1, ""), (4, 0, None, ""), (4, 1, 1, ""), (99, 1, 0, "")], LABELS)
    none = odd_labels.limit(0)
    for run in (toxicity.classify, quality.score_quality):
        got = run(odd, odd_labels).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
        equal = {r.score for r in got if r["row"]["doc_id"] == 4}
        assert len(equal) == 1
        assert all(r.score == 0.5 for r in run(odd, none).collect())
        assert run(docs([(1, "x")]).limit(0), odd_labels).collect() == []


def test_word_hashes_by_hand():
    data = "Ab ab, xyzxyzxyz\tab".encode()
    h, start, end = word_hashes(data, LETTERS)
    assert [data[a:b] for a, b in zip(start, end)] == [b"Ab", b"ab", b"xyzxyzxyz", b"ab"]
    assert h[0] == h[1] == h[3] != h[2]
    assert word_hashes(b"")[0].size == 0
