"""Packing runs of groups against packing one by one, and whole shards."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from harbor.llm import sharding
from tests.llm.tables import AWKWARD, PROSE, documents


def one_by_one(histogram, capacity, shards):
    rooms = [capacity] * (shards or 0)
    out = Counter()
    for size, count in sorted(histogram, reverse=True):
        for _ in range(count):
            fitting = [(room, n) for n, room in enumerate(rooms) if room >= size]
            if fitting:
                at = min(fitting)[1]
            elif shards:
                at = max((room, n) for n, room in enumerate(rooms))[1]
            else:
                rooms.append(max(capacity, size))
                at = len(rooms) - 1
            rooms[at] -= size
            out[size, at] += 1
    return out


@pytest.mark.parametrize("shards", [None, 1, 5, 16])
@pytest.mark.parametrize("seed", range(5))
def test_runs_pack_as_single_groups(shards, seed):
    rng = random.Random(seed)
    histogram = [(size, rng.randint(1, 30)) for size in rng.sample(range(1, 400), 60)]
    total = sum(size * count for size, count in histogram)
    capacity = -(-total // shards) if shards else 1000
    found = Counter()
    ranks = defaultdict(list)
    for size, first, last, shard in sharding.pack(histogram, capacity, shards):
        found[size, shard] += last - first + 1
        ranks[size] += range(first, last + 1)
    assert found == one_by_one(histogram, capacity, shards)
    assert all(sorted(ranks[size]) == list(range(count)) for size, count in histogram)


def test_tree_keeps_order():
    rng = random.Random(0)
    tree, held = sharding.RoomTree(), set()
    for _ in range(3000):
        key = (rng.randint(0, 50), rng.randint(0, 50))
        if key in held and rng.random() < 0.7:
            held.discard(key)
            tree.remove(key)
        elif key not in held:
            held.add(key)
            tree.insert(key)
        ask = (rng.randint(0, 50), rng.randint(0, 50))
        assert tree.least_from(ask) == min((k for k in held if k >= ask), default=None)
        if held:
            assert tree.greatest() == max(held)

    def depth(node):
        return 1 + max(depth(node[2]), depth(node[3])) if node else 0

    assert depth(tree.root) <= 2 * len(held).bit_length() + 1


CROWD = [(n, PROSE, "en") for n in range(300)] + [(1000 + n, "x" * (n % 37) + str(n), "en") for n in range(600)]


@pytest.mark.parametrize("rows", [AWKWARD, CROWD, [], [(1, None, None)]])
def test_shards(spark, monkeypatch, rows):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    found = sharding.shard_documents(documents(spark, rows), 16).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(i) for i, *_ in rows)
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == texts
    slots, homes, load = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        homes[r["size"], r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and set(load) <= set(range(16))


def test_shards_are_near_equal(spark):
    rows = [(n, "x" * (n * 7919 % 501), "en") for n in range(3000)]
    found = sharding.shard_documents(documents(spark, rows), 16).groupBy("shard").agg({"size": "sum"}).collect()
    loads = [r[1] for r in found]
    assert len(loads) == 16 and max(loads) - min(loads) <= 0.01 * max(loads)
