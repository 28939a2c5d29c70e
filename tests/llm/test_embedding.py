import numpy as np

from palimpsest.llm import embedding_dedup
from palimpsest.llm.embedding_dedup import embedding_groups

SCHEMA = "vec_id long, embedding array<float>, label int, node long, root long, copies long"


def brute(rows, least=0.9):
    n = len(rows)
    links, comp = np.zeros(n, int), list(range(n))
    good = [
        i for i, (_, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in good}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, i in enumerate(good):
        for j in good[x + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                comp[root(j)] = root(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(str((d, int(links[i]), low.get(root(i)), d is not None and d == low.get(root(i)))) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_odd_vectors(spark):
    a = [1.0, 0.0, 0.0]
    rows = [
        (5, a), (4, [0.95, 0.1, 0.0]), (4, [0.95, 0.1, 0.0]), (9, a), (1, None), (2, []), (3, [0.0, 0.0, 0.0]),
        (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (None, [0.0, 0.0, 5.0]),
        (10, [0.0, 1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1e-30, 0.0]), (13, [0.6, 0.4, 0.0]), (None, None),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    assert got(embedding_groups(df, passes=4)) == brute(rows)
    assert embedding_groups(df.limit(0), passes=2).count() == 0


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for size in [1] * 200 + [2] * 50 + [30, 150]:
        centre = rng.standard_normal(32)
        for _ in range(size):
            rows.append((len(rows) * 3, (centre + 0.15 * rng.standard_normal(32)).astype(np.float32).tolist()))
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(*rows[i], 1, 2, 3, 4) for i in order], SCHEMA)
    # small windows and blocks, so that groups are larger than both
    assert got(embedding_groups(df, window=8, block=16)) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows, pairs = [], 400
    for k in range(pairs):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        z = 0.905 * x + np.sqrt(1 - 0.905**2) * y
        rows += [(2 * k, x.astype(np.float32).tolist()), (2 * k + 1, z.astype(np.float32).tolist())]
    rows += [(10_000 + k, rng.standard_normal(64).astype(np.float32).tolist()) for k in range(4000)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    found = embedding_groups(df).where("n_links > 0").count()
    assert found >= 0.9 * 2 * pairs


def test_borders_of_partitions_and_sizes_lose_no_links(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        x = rng.standard_normal(16)
        rows += [(2 * k, 16, x.tolist()), (2 * k + 1, 16, (x + 0.1 * rng.standard_normal(16)).tolist())]
    df = spark.createDataFrame(rows, "node long, size int, embedding array<double>")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "100"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            links = embedding_dedup.sorted_passes(df, range(1), 20, 16, 0.9).collect()
            found.append({frozenset(r) for r in links})
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(found[0]) > 200 and found[0] <= found[1]
    assert [embedding_dedup.passes_for(n) for n in (0, 5_000, 100_000, 1_600_000)] == [16, 16, 16, 32]


def test_only_vectors_far_from_the_mean_are_multiplied(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows, multiplied = [], []
    for group, noise in enumerate((0.02, 0.02, 0.09)):  # the last is wider than the threshold allows
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(120):
            rows.append((len(rows), (centre + (noise if len(rows) % 10 else noise / 9) * rng.standard_normal(32)).tolist()))
    rows += [(len(rows) + k, rows[0][1]) for k in range(40)]
    plain = embedding_dedup.count_products
    monkeypatch.setattr(embedding_dedup, "count_products", lambda far, *a: multiplied.append(far.count()) or plain(far, *a))
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA.replace("float", "double")).repartition(5)
    assert got(embedding_groups(df, block=16)) == brute(rows)
    assert 0 < multiplied[0] <= 120


def test_the_number_of_partitions_does_not_matter(spark):
    """Pairs at the threshold that nothing else joins, among many others."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 32))
    y = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.905 * x + np.sqrt(1 - 0.905**2) * y
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, z]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("3", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append({r.vec_id for r in embedding_groups(df, passes=4).where("n_links > 0").collect()})
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert found[0] == found[1] and len(found[0]) > 2000
