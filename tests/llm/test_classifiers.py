"""Quality and toxicity: parts against brute force, held-out accuracy on the tables, odd inputs."""

import numpy as np
import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from palimpsest.llm import queries
from palimpsest.llm.quality import RuleModel, applies, classify_quality, fit_rules, lasso_logistic, sigmoid
from palimpsest.llm.toxicity import BlockMaxIndex, classify_toxicity, isotonic


def auc(y, s):
    one, zero = s[y == 1], s[y == 0]
    return np.mean([(one > z).mean() + (one == z).mean() / 2 for z in zero])


@pytest.mark.parametrize("name,label,least", [("op8_quality", "quality", 0.97), ("op4_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    rows = getattr(queries, name)(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y = rows[label].to_numpy()
    assert auc(y, rows["score"].to_numpy()) >= least
    assert (rows["predicted"].to_numpy() == y).mean() >= least


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_odd_documents(spark, classify):
    df = odd_documents(spark)
    texts = {d.doc_id: d.text or "" for d in df.collect()}
    rows = [(i, i % 2, i % 2) for i in range(8)] + [(2, 1, 0), (None, 1, 1), (5, None, None), (900, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        got = classify(df, some).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in df.collect())
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        by_text = {}
        for r in got:
            if r.doc_id is not None:
                assert by_text.setdefault(texts[r.doc_id], r.score) == r.score
        assert classify(no_documents(spark), some).count() == 0


def test_held_out_labels_do_not_matter(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    for classify, parts, part, label in ((classify_quality, 4, 2, "quality"), (classify_toxicity, 5, 0, "toxic")):
        out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part
        turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
        key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
        assert key(classify(docs, labels)) == key(classify(docs, turned))


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((400, 3)), 2)
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    model = fit_rules(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < 200 and ((model.predict(x) >= 0.5) == y).mean() > 0.95
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    assert np.allclose(np.sort(got), np.sort(model.predict(x)), atol=1e-12)
    empty = RuleModel(["a"], 0.3, [])
    assert abs(df.select(empty.column()).first()[0] - sigmoid(np.array(0.3))) < 1e-12
    assert applies(((0, True, 0.5),), x).tolist() == (x[:, 0] > 0.5).tolist()


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    z = rng.integers(0, 2, (300, 20)).astype(float)
    y = (rng.random(300) < sigmoid(2 * z[:, 0] - z[:, 1])).astype(float)
    b, w = lasso_logistic(z, y, 0.02, 4000)
    slope = z.T @ (sigmoid(b + z @ w) - y) / len(y)
    assert (np.abs(slope[w == 0]) <= 0.02 + 1e-5).all() and (w == 0).any()
    assert np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5)


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / max(np.linalg.norm(w), 1e-12)))
    index = BlockMaxIndex(np.arange(500), rng.integers(0, 2, 500), vectors, 40)
    dense = np.zeros((500, 40))
    for row, (t, w) in enumerate(index.vectors):
        dense[row, t] = w
    for _ in range(200):
        t = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        q = np.zeros(40)
        q[t] = w
        cosines = dense @ q
        order = [i for i in np.lexsort((np.arange(500), -np.round(cosines, 9))) if cosines[i] > 0][:10]
        rows, found = index.nearest(t, w, 10)
        assert rows.tolist() == order and np.allclose(found, cosines[order])


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(4)
    x = np.round(rng.random(300), 2)
    y = (rng.random(300) < x**2).astype(float)
    values, fitted = isotonic(x, y, np.ones(300))
    assert (np.diff(fitted) > 0).all() and 0 <= fitted[0] and fitted[-1] <= 1
    assert abs(np.interp(x, values, (fitted - 0.02 * values) / 0.98).mean() - y.mean()) < 1e-9


def test_toxic_documents_with_rare_telling_words_have_neighbours(spark):
    """Each telling word is in about one toxic example in fifty, below any border of significance."""
    rng = np.random.default_rng(5)
    common = [f"w{'abcdefghij'[k]}" for k in range(10)]
    telling = ["t" + "".join(chr(97 + int(c)) for c in f"{k:02d}") for k in range(50)]
    docs = []
    for i in range(600):
        words = rng.choice(common, 8).tolist() + (rng.choice(telling, 2).tolist() if i % 2 else [])
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    got = classify_toxicity(df, labels).where("held_out").collect()
    assert len(got) > 80 and all(r.evidence for r in got)
    y, s = np.array([r.doc_id % 2 for r in got]), np.array([r.score for r in got])
    assert auc(y, s) > 0.9


def plain_toxicity(docs, labels, k=25):
    """The whole query again, with dense vectors over all words and every cosine."""
    import re
    import zlib
    from collections import Counter

    learnt = {i: y for i, y in sorted(labels) if zlib.crc32(str(i).encode()) % 5}
    words = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t in docs}
    order = sorted(learnt)
    terms = sorted({w for i in order for w in words[i]})
    y = np.array([learnt[i] for i in order])
    has = np.array([[w in words[i] for w in terms] for i in order])
    a, seen, na, n = has[y == 1].sum(0), has.sum(0), y.sum(), len(y)
    b, nb = seen - a, n - y.sum()
    chi2 = n * (a * (nb - b) - b * (na - a)) ** 2 / (seen * np.maximum(n - seen, 1) * na * nb)
    df = np.array([sum(w in x for x in words.values()) for w in terms])
    weight = (np.log((1 + len(docs)) / (1 + df)) + 1) * np.sqrt(1 + chi2)

    def vector(i):
        v = np.array([1 + np.log(words[i][w]) if w in words[i] else 0.0 for w in terms]) * weight
        return v / max(np.linalg.norm(v), 1e-12)

    examples = np.array([vector(i) for i in order])
    share = y.mean()
    stand = np.array([(1 - share) * n / (n - na), share * n / na])

    def vote(v, without=None):
        c = examples @ v
        if without is not None:
            c[without] = 0
        near = sorted(np.flatnonzero(c > 0), key=lambda r: -round(c[r], 9))
        if len(near) > k and round(c[near[k - 1]], 9) == round(c[near[k]], 9):
            return None, None  # which of the equal ones counts is free
        near = near[:k]
        w = stand[y[near]] / (1.05 - np.minimum(c[near], 1))
        return (w[y[near] == 1].sum() + share) / (w.sum() + 1), {order[r] for r in near}

    own = [vote(examples[r].copy(), r)[0] for r in range(n)]
    assert None not in own
    x, fitted = isotonic(np.array(own), y, stand[y])
    out = {}
    for i in words:
        v, near = vote(vector(i))
        if v is not None:
            out[i] = np.clip(np.interp(v, x, fitted), 0, 1), near
    return out


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = ["w" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(120)]
    docs = []
    for i in range(300):
        own = rng.choice(words[: 80 if i % 3 else 120], rng.integers(5, 40)).tolist()
        docs.append((i, " ".join(own)))
    labels = [(i, int(i % 3 == 0)) for i in range(0, 300, 2)]
    want = plain_toxicity(docs, labels)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in classify_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == 300 and len(want) > 250
    for i, (score, near) in want.items():
        assert abs(got[i].score - score) < 1e-9 and set(got[i].evidence) == near


def test_texts_with_words_have_neighbours_and_scores_of_their_own(spark, data):
    rows = queries.op4_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    with_words = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    assert sum(not r.evidence for r in with_words) <= 0.02 * len(with_words)
    assert len({r.score for r in with_words}) > 0.5 * len({r.text for r in with_words})


def test_ids_may_be_strings(spark):
    rows = [(f"d{i}", "bad words here" if i % 2 else "all is well", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, toxic int")
    got = classify_toxicity(df.drop("toxic"), df.drop("text")).collect()
    assert all(r.predicted == int(r.doc_id[1:]) % 2 and all(e in {x[0] for x in rows} for e in r.evidence) for r in got)
