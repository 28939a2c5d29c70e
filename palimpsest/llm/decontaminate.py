"""Benchmark decontamination with a broadcast hash set of normalised word windows.

The windows of all benchmark items are hashed to 64 bits. A document's words are
hashed once, each window of its words is one hash of those, and the window
hashes are run past the set, which every executor holds as the broadcast side of
a semi-join. Only hits leave that join, and a hit's words are then joined with
the benchmark's, so a collision of hashes counts for nothing. All of it is
DataFrame and SQL functions, and nothing but hits, and one small row for each
document, is shuffled.

The set is broadcast in shards by hash, of at most about ``most_windows`` hashes
each: a benchmark of more windows takes one pass over the documents for each
shard, in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import UPPER, ascii_lower, free_prefix, materialize

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_WINDOWS = 1_000_000  # hashes in a broadcast: some 40 bytes each
MOST_BYTES = 64 << 20  # of the windows' words in a broadcast
MARK = 1  # stands in a document's hashes before those of its windows


def words_of(text: Column) -> Column:
    """The normalised words of a text, null as none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NO_WORD), "")


def _hash(array: str, at: str, length: int) -> str:
    return "xxhash64(" + ", ".join(f"{array}[{at} + {k}]" for k in range(length)) + ")"


def benchmark_windows(bench: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Each different window once: its words, their number, its hash and the items (as strings) that have it."""
    items = (
        bench.select(F.col(id_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_words"))
        .where(F.size("_words") > 0)
        .withColumn("_length", F.least(F.size("_words"), F.lit(size)))
        .withColumn("_at", F.explode(F.expr("sequence(1, size(_words) - _length + 1)")))
        .withColumn("_window", F.expr("slice(_words, _at, _length)"))
    )
    keyed = items.groupBy(F.array_join("_window", " ").alias("_key"), "_length").agg(F.collect_set("_item").alias("_items"))
    return keyed.withColumn("_hashes", F.expr("transform(split(_key, ' '), w -> xxhash64(w))"))


class Windows:
    """The benchmark's windows, materialised, with their hashes in shards that may be broadcast."""

    def __init__(self, bench: DataFrame, size: int, id_col: str, text_col: str, most: int):
        self.grams = materialize(
            benchmark_windows(bench, size, id_col, text_col).withColumn("_hash", window_hash("_hashes", "_length", size)).drop("_hashes")
        )
        told = self.grams.agg(
            F.count("*").alias("n"), F.sum(F.octet_length("_key") + 16 * F.size("_items")).alias("bytes"), F.collect_set("_length").alias("lengths")
        ).first()
        self.lengths = sorted(told["lengths"])  # at most as many as a window has words
        self.shards = max(1, -(-told["n"] // max(1, most)))
        self.small = self.shards == 1 and (told["bytes"] or 0) <= MOST_BYTES

    def hits(self, docs: DataFrame, kept: list[str], marks: bool) -> DataFrame:
        """``kept`` of ``docs`` (which has _words) with _at, _length and _items of each window that is the benchmark's.

        With ``marks`` each row comes once more, with nulls for these.
        """
        hashed = docs.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))")).withColumn("_n", F.size("_words"))
        first, starts = "1", []
        for length in self.lengths:  # the windows of each length come one after the other
            starts.append(first)
            first = f"{first} + greatest(0, _n - {length - 1})"
        lists = [f"if(_n >= {n}, transform(sequence(0, _n - {n}), i -> {_hash('_hashes', 'i', n)}), array())" for n in self.lengths]
        # a column of its own, so that exploding it is compiled and copies the words of no window but hits; outer, as Spark
        # would else put the whole expression into a filter (there is always a mark)
        hashed = hashed.withColumn("_all", F.expr(f"concat({', '.join([f'array({MARK}L)', *lists])})"))
        every = hashed.select(*dict.fromkeys([*kept, "_words", "_n"]), F.posexplode_outer("_all").alias("_place", "_h"))
        length, at = F.lit(None).cast("int"), F.lit(None).cast("int")
        for n, start in zip(self.lengths, starts, strict=True):
            here = F.col("_place") >= F.expr(start)
            length, at = F.when(here, n).otherwise(length), F.when(here, F.col("_place") - F.expr(start)).otherwise(at)
        found = None
        for shard in range(self.shards):
            own = self.grams.where(F.pmod("_hash", F.lit(self.shards)) == shard).select(F.col("_hash").alias("_known")).distinct()
            if not shard and marks:
                own = own.unionByName(docs.sparkSession.createDataFrame([(MARK,)], "_known long")).distinct()
            some = every.join(F.broadcast(own), F.col("_h") == F.col("_known"), "left_semi")
            if shard:
                some = some.where(F.col("_place") > 0)
            some = some.withColumn("_length", length).withColumn("_at", at)
            some = some.select(*kept, "_place", "_at", "_length", F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_length")), " ").alias("_k"))
            found = some if found is None else found.unionByName(some)
        if not marks:
            found = found.where(F.col("_place") > 0)
        keys = self.grams.select("_key", "_items")
        joined = found.join(F.broadcast(keys) if self.small else keys, F.col("_k") == F.col("_key"), "left")
        true = F.col("_key").isNotNull()
        joined = joined.where(true | (F.col("_place") == 0) if marks else true)
        return joined.select(*kept, "_at", "_length", "_items")


def window_hash(hashes: str, length: str, size: int) -> Column:
    """The hash of a window of up to ``size`` words, from those of its words."""
    out = F.lit(None).cast("long")
    for n in range(1, size + 1):
        out = F.when(F.col(length) == n, F.expr(_hash(hashes, "0", n))).otherwise(out)
    return out


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """Return id, n_words, the hit word places, n_hit, n_items, items_sha256 and contaminated for every row.

    ``hit_words`` are the places, from 0, of the words inside any occurrence of a
    window. Null and empty texts have no words; an item without words has no
    window, and one of fewer than ``size`` words is one window; an item with a
    null id still hits but is not counted among the items. Repeated rows give
    repeated rows; empty tables give no rows or no hits. Other columns are not
    read.
    """
    windows = Windows(bench, size, item_col, item_text_col, most_windows)
    own = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words_of(F.col(text_col)).alias("_words"))
    own = own.withColumn("_n", F.size("_words"))
    joined = windows.hits(own, ["_row", "_id", "_n"], marks=True)
    span = F.when(F.col("_items").isNotNull(), F.expr("sequence(_at, _at + _length - 1)"))
    return (
        joined.groupBy("_row", "_id", "_n")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(span)))).alias("hit_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"),
        )
        .select(
            F.col("_id").alias(id_col),
            F.col("_n").cast("long").alias("n_words"),
            "hit_words",
            F.size("hit_words").cast("long").alias("n_hit"),
            F.size("_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
            (F.size("hit_words") > 0).alias("contaminated"),
        )
    )


def drop_leaks(
    docs: DataFrame,
    bench: DataFrame,
    size: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """The rows, with all their columns, of which no word is inside an occurrence of a benchmark window.

    Null and empty texts stay. Whether a row goes depends on its text alone, so
    the digests of the texts with a hit are what leaves the first pass; the rows
    are then joined with these, which are broadcast while they are few.
    """
    windows = Windows(bench, size, item_col, item_text_col, most_windows)
    named = free_prefix(docs.columns, "_leak_")
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    own = docs.select(digest.alias("_digest"), words_of(F.col(text_col)).alias("_words"))
    leaks = materialize(windows.hits(own, ["_digest"], marks=False).select(F.col("_digest").alias(f"{named}digest")).distinct())
    few = leaks.limit(MOST_WINDOWS + 1).count() <= MOST_WINDOWS
    return docs.join(F.broadcast(leaks) if few else leaks, digest == F.col(f"{named}digest"), "left_anti")


ORACLE_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i)
  WHERE len(w) > 0),
docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM docs, (SELECT DISTINCT n FROM grams) AS x, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS (SELECT r, i, grams.n, item FROM windows JOIN grams ON windows.k = grams.k),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
