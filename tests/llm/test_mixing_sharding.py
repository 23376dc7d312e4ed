import zlib
from collections import defaultdict

import pytest

from salescope.llm import mixing, sharding


def test_targets_are_met_to_the_word(docs):
    rows = [(i, " ".join(["w"] * (i * 37 % 91)), f"s{i % 7}") for i in range(300)]
    got = mixing.mix(docs(rows)).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        s = r["row"]["source"]
        taken[s] += r.taken
        target[s], size[s] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r["size"] and len(r.positions) == (r.taken > 0) + (r.taken > r["size"])
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.5 and target[s] <= 2 * size[s] for s in size)
    open_ = [target[f"s{i}"] / w for i, w in enumerate((5, 2, 1, 5, 2, 1, 5)) if target[f"s{i}"] < 2 * size[f"s{i}"]]
    assert max(open_) == pytest.approx(min(open_))


def test_positions_follow_the_schedule(docs):
    """Half-way through training, a growing source has spent less than half of its words, a fading one more."""
    rows = [(i, "w " * 10, s) for i, s in enumerate(["grows", "hold", "wanes"] * 200)]
    half = defaultdict(int)
    for r in mixing.mix(docs(rows)).collect():
        half[r["row"]["source"]] += sum(p < 0.5 for p in r.positions) / (r.taken and len(r.positions) or 1)
    assert half["grows"] < half["hold"] < half["wanes"]


def test_training_documents_have_the_taken_words(docs):
    df = docs([(i, " ".join(f"w{i}_{k}" for k in range(5 + i % 9)), f"s{i % 3}") for i in range(60)])
    taken = sum(r.taken for r in mixing.mix(df).collect())
    out = mixing.training_documents(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) == taken


def test_hot_source_is_cut_into_blocks(docs, monkeypatch):
    from salescope.llm import common

    monkeypatch.setattr(common, "BLOCK_ROWS", 10)
    rows = [(i, "w " * (i % 5), "hot" if i % 3 else "cold") for i in range(400)]
    got = mixing.mix(docs(rows)).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r["row"]["source"]] += r.taken
    assert all(abs(taken[r["row"]["source"]] - r.target) <= 0.5 for r in got)


def test_odd_rows(odd, docs):
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and sorted(r.taken for r in got)[:2] == [0, 0]
    assert len(mixing.mix(docs([(1, None), (2, "")])).collect()) == 2
    assert mixing.mix(docs([(1, "x")]).limit(0)).collect() == []
    assert mixing.training_documents(odd).columns == odd.columns


def test_shards_are_balanced_and_keep_groups(docs):
    rows = [(i, f"{i % 70} " * (i % 70 * i % 131)) for i in range(700)] + [(1000 + i, "the same text") for i in range(350)]
    got = sharding.shard_documents(docs(rows)).collect()
    assert len(got) == len(rows)
    own, slots, total = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        text = r["row"]["text"]
        assert r["size"] == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        own[text].add(r.shard)
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert all(len(s) == 1 for s in own.values()) and set(total) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) < 0.02 * sum(total.values()) / 16 + 2


def test_levels_of_batches(docs, monkeypatch):
    monkeypatch.setattr(sharding, "BATCH", 8)
    rows = [(i, "x" * (i * 31 % 97)) for i in range(300)]
    got = sharding.shard_documents(docs(rows), 4).collect()
    total = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    assert max(total) - min(total) <= 100 and len(got) == 300


def test_difference_by_hand():
    total, to = sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    assert sorted(total) == [14, 16]
    for s in (0, 1):
        assert sum(n for n, t in zip((8, 7, 6, 5, 4), to) if t[0] == s) == total[s]


def test_odd_shards(odd, docs):
    got = sharding.shard_documents(odd).collect()
    assert len(got) == 10
    nulls = [r for r in got if r["row"]["text"] is None]
    assert {(r["size"], r.text_crc32) for r in nulls} == {(1, 0)} and len({r.shard for r in nulls}) == 1
    assert sharding.shard_documents(docs([(1, "x")]).limit(0)).collect() == []
