import random
import zlib
from collections import Counter, defaultdict

import pytest
from cases import no_documents, odd_documents

from palimpsest.llm import sharding
from palimpsest.llm.sharding import find_cuts, shard_documents


def greedy(sizes, capacity):
    shards, held = 1, 0
    for s in sizes:
        if s > capacity:
            return 1 << 60
        if held + s > capacity:
            shards, held = shards + 1, 0
        held += s
    return shards


def smallest_capacity(sizes, shards):
    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes, middle) <= shards else (middle + 1, high)
    return low


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {d: t or "" for d, t in docs if d is not None}
    of = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            of[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_documents(spark, shards):
    df = odd_documents(spark)
    check(shard_documents(df, shards).collect(), [(r.doc_id, r.text) for r in df.collect()], shards)
    assert shard_documents(no_documents(spark), shards).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(shard_documents(df, 40).collect(), [(r.doc_id, r.text) for r in df.collect()], 40)


@pytest.mark.parametrize("cells", [4, 64, 1 << 14])
@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_those_of_the_smallest_capacity(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rng = random.Random(seed)
    n = rng.choice([5, 300, 2000])
    sizes = {rng.getrandbits(64) - (1 << 63): rng.choice([16, rng.randrange(16, 4000)]) for _ in range(n)}
    if seed % 2:
        sizes[rng.getrandbits(60)] = sum(sizes.values())  # a group with half of all bytes
    df = spark.createDataFrame(list(sizes.items()), "h long, size long")
    alone, cuts = find_cuts(df, 40)
    rest = [(h, s) for h, s in sorted(sizes.items()) if h not in alone]
    held = Counter()
    for h, s in rest:
        held[sum(h >= c for c in cuts)] += s
    assert len(held) + len(alone) <= 40
    assert max(held.values(), default=0) == smallest_capacity([s for _, s in rest], 40 - len(alone)) or not rest
    left = sum(s for _, s in rest)
    assert all(sizes[h] > left / 40 for h in alone)
