import random
import re

import numpy as np
import pytest
import xxhash
from cases import no_documents, odd_documents

from palimpsest.llm.components import connected_components
from palimpsest.llm import simhash
from palimpsest.llm.simhash import anchor_families, fingerprint_links, keep_one_of_each_group, simhash_groups


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_groups(rows, most=4):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    different = sorted({p for _, p in prints})
    linked = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if (a ^ b).bit_count() <= most]
    root = components(different, linked)
    low = {}
    for d, p in prints:
        if d is not None:
            low[root[p]] = min(low.get(root[p], d), d)
    key = lambda x: (x[0] is None, x)
    return sorted(((d, f"{p:016x}", low.get(root[p])) for d, p in prints), key=lambda x: str(key(x)))


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=lambda x: str((x[0] is None, x)))


def test_odd_documents_and_brute_force(spark):
    df = odd_documents(spark)
    assert got(simhash_groups(df)) == plain_groups([(r.doc_id, r.text) for r in df.collect()])
    assert simhash_groups(no_documents(spark)).count() == 0


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(simhash_groups(df)) == plain_groups([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("joint", [1, 2])
def test_every_close_pair_meets_at_an_anchor(joint):
    rng = random.Random(3)
    families = anchor_families(joint=joint)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        a, b = np.array([x], np.uint64), np.array([y], np.uint64)
        assert any(int(f.home(a)[0]) in f.copies(b)[1].tolist() for f in families)
        for f in families:
            rows, keys = f.copies(np.array([x, y], np.uint64))
            assert keys[0] == f.home(a)[0] and keys[np.searchsorted(rows, 1)] == f.home(b)[0]
            assert len(set(zip(rows.tolist(), keys.tolist(), strict=True))) == len(rows)


def test_links_give_the_components_of_all_close_pairs(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(40):  # chains of near copies
            prints.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "print long").repartition(3)
    unsigned = {p: p % (1 << 64) for p in prints}
    linked = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (unsigned[a] ^ unsigned[b]).bit_count() <= 4]
    want = components(prints, linked)
    for part, joint in ((1 << 16, 1), (2, 1), (2, 2)):  # 2: anchors with many at home are split
        labels = connected_components(fingerprint_links(df, part=part, joint=joint), "a", "b")
        found = {r.node: r.root for r in labels.collect()}
        assert {p: found.get(p, p) for p in prints} == want


def test_components_of_paths_and_no_links(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7), (None, 3), (500, 400)], "a long, b long")
    found = {r.node: r.root for r in connected_components(path, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(101)}, 400: 400, 500: 400}
    assert connected_components(path.limit(0), "a", "b").count() == 0


def test_hubs_are_split(spark):
    rng = random.Random(6)
    pairs = [(0, k) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(59, 160), (160, 100), (300, 301), (302, 301)]
    pairs += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = components({x for p in pairs for x in p}, pairs)
    want = {n: min(k for k in want if want[k] == want[n]) for n in want}
    for hub in (4, 1 << 20):
        found = {r.node: r.root for r in connected_components(df, "a", "b", hub=hub).collect()}
        assert {n: found.get(n, n) for n in want} == want


@pytest.mark.parametrize("held", [1, 1 << 15])
def test_groups_over_batches_keep_their_links(spark, monkeypatch, held):
    rng = random.Random(12)
    prints = set()
    for _ in range(3):  # many at one home
        x = rng.getrandbits(64)
        prints |= {x ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "print long").repartition(2)
    monkeypatch.setattr(simhash, "HELD", held)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = {r.node: r.root for r in connected_components(fingerprint_links(df), "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(found) == len(prints) and len(set(found.values())) == 3


def test_rows_that_share_an_id_stay_if_their_texts_are_apart(spark):
    one, two = "a text of some words that stands here alone", "quite another story about the sea and its ships"
    rows = [(5, one), (5, two), (5, one), (7, one + ""), (8, two), (None, one), (None, one), (9, None), (10, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = keep_one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.doc_id != 9) == sorted([("5", one), ("5", two), ("None", one), ("None", one)])
    assert got.where("doc_id = 9").count() == 1
