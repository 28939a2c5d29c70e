import hashlib
import re

import duckdb
from cases import no_documents, odd_documents

from palimpsest.llm import queries
from palimpsest.llm.decontaminate import Windows, drop_leaks, find_leaks


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.drop("hit_words").collect())


ITEMS = [
    (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (12, "short ITEM"),
    (3, "one"),
    (None, "nobody owns this"),
    (4, None),
    (5, ""),
    (6, "É été"),
]
TEXTS = [
    "x alpha BETA gamma; delta epsilon zeta eta theta iota kappa lambda mu y",
    "alpha beta gamma delta epsilon zeta eta theta iota",
    "a short item and one short-item; nobody owns this",
    "é été É été",
]


def test_odd_documents_against_brute_force(spark):
    df = odd_documents(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain([(r.doc_id, r.text) for r in df.collect()], ITEMS)
    assert got(find_leaks(df, bench)) == want
    assert got(find_leaks(df, bench, most_windows=1)) == want  # too many windows to broadcast
    assert find_leaks(no_documents(spark), bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert got(find_leaks(df, nothing)) == plain([(r.doc_id, r.text) for r in df.collect()], [])


def test_whole_table_against_sql(spark, data):
    df = queries.op3_decontamination(spark, data)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    want = con.execute(queries.oracle_sql()["op3_decontamination"]).fetchall()
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(map(str, want))
    assert df.where("contaminated").count() > 0


def test_dropping_keeps_all_other_rows_and_columns(spark):
    df = odd_documents(spark, TEXTS).withColumnRenamed("h", "_leak_digest").withColumnRenamed("size", "_words")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    hit = {str(r[0]) for r in find_leaks(df, bench).where("contaminated").select("doc_id").collect()}
    rows = [r for r in df.collect() if str(r.doc_id) not in hit]
    assert 0 < len(rows) < df.count()
    for most in (1, 1 << 20):
        got = drop_leaks(df, bench, most_windows=most)
        assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, rows))


def test_over_a_million_windows_shuffle_hits_only(spark):
    """Windows of documents that are none of the benchmark's never reach an exchange."""
    words = "concat_ws(' ', transform(sequence(0, 1099), k -> concat('w', cast(hash(id, k) as string))))"
    bench = spark.range(1000).selectExpr("id as item_id", f"replace({words}, '-', 'm') as text")
    docs = spark.range(2000, 2400).selectExpr("id as doc_id", f"replace({words}, '-', 'm') as text")
    one = bench.limit(1).selectExpr("-1L as doc_id", "concat('before ', substring_index(text, ' ', 20), ' after') as text")
    for most in (1 << 20, 1 << 19):
        df = find_leaks(docs.unionByName(one), bench, most_windows=most)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in df.collect()}
        assert got == {**{i: (1100, 0, 0) for i in range(2000, 2400)}, -1: (22, 20, 1)}
        held = Windows(bench, 10, "item_id", "text", most)
        assert held.grams.count() == 1_091_000 and held.shards == -(-1_091_000 // most)
        # exploded windows go into a broadcast semi-join without an exchange between
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        lines = plan.splitlines()
        at = [k for k, x in enumerate(lines) if "posexplode" in x and "Generate" in x]
        assert at and all("LeftSemi" in next(x for x in reversed(lines[:k]) if "Join" in x or "Exchange" in x) for k in at)


def test_a_hash_of_the_mark_is_no_hit(spark, monkeypatch):
    from palimpsest.llm import decontaminate

    # every window and the mark have one hash: all windows are candidates, and only equal words count
    monkeypatch.setattr(decontaminate, "_hash", lambda array, at, length: f"{decontaminate.MARK}L + 0 * {at}")
    df = odd_documents(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(find_leaks(df, bench)) == plain([(r.doc_id, r.text) for r in df.collect()], ITEMS)
