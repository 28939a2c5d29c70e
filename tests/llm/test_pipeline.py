"""The pipeline against plain versions of its stages, and on odd inputs."""

import sys

import numpy as np
import pytest
from test_decontaminate import plain as plain_leaks
from test_packing import check as check_packing
from test_packing import tokenizer  # noqa: F401
from test_simhash import plain_groups

import corpus_pipeline
from palimpsest.llm.decontaminate import drop_leaks
from palimpsest.llm.secret_scan import find_secrets, redact
from palimpsest.llm.simhash import keep_one_of_each_group

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_whole_pipeline_against_plain_stages(spark, data, tokenizer):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, data)
    assert good.columns == COLUMNS
    kept = {r.doc_id for r in good.collect()}
    known = [d for d, _ in rows if d in labels]
    assert np.mean([(d in kept) == labels[d] for d in known]) > 0.95
    rows = [r for r in rows if r[0] in kept]
    lowest = {c for _, _, c in plain_groups(rows)}
    rows = [r for r in rows if r[0] in lowest]
    leaks = plain_leaks(rows, items)
    clean = {r[0] for r in rows if any(x.startswith(f"({r[0]}, ") and x.endswith("False)") for x in leaks)}
    rows = [(d, redact(t, find_secrets(t)[1])) for d, t in rows if d in clean]
    got = corpus_pipeline.run(spark, data).collect()
    used, least = check_packing(got, rows, tokenizer, 2048)
    assert used <= least + 1


@pytest.fixture
def odd(spark):
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11),
        (4, "A b c d e f", "en", "s", 11), (None, "no id at all here", "en", "s", 3), (None, None, None, None, None),
        (5, "one two three four five six seven eight nine ten", "en", "s", 5), (6, "token = abcdef123456 and more", "en", "s", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_odd_rows(spark, odd, data):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten")], "item_id long, text string")
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    assert ids(keep_one_of_each_group(odd)) == ["1", "3", "5", "6", "None", "None"]
    for most in (50_000, 0):
        assert ids(drop_leaks(odd, bench, most_windows=most)) == sorted(map(str, [1, 2, 3, 3, 4, 6, None, None]))
    clean = {r.doc_id: r for r in corpus_pipeline.secrets(spark, odd, data).collect()}
    assert clean[6].text == "[secret] and more" and clean[6].n_chars == 17
    assert clean[1].text is None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, data).count() >= 0
        assert stage(spark, odd.limit(0), data).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, data).columns == COLUMNS


def test_columns_with_clashing_names_stay(spark, data):
    own = {"_own_kept": 1, "_stat_words": 2, "_leak_found": 3, "_words": 4, "component_id": 5, "_quality": 6}
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, text + " x" * i, "en", "s", 5, *own.values()) for i in range(3)], [*COLUMNS, *own])
    docs = docs.withColumn("doc_id", docs.doc_id.cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns
        assert all(tuple(r[5:]) == tuple(own.values()) for r in got.collect())


def test_entry_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("palimpsest.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "palimpsest.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    assert not [q for q in __spark_entry__.queries() if q.startswith("op") or q == "pipeline"]
    monkeypatch.delitem(sys.modules, "__spark_entry__")
