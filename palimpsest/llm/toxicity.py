"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows, as many of each label. The terms
are all words of that sample; how often they occur is counted over all
documents. Each term's weight is its TF-IDF times the root of one plus its
chi-square between the labels of the sample: a word that tells nothing counts as
in plain TF-IDF, and no word is left out. The index over the examples is
inverted: light terms have postings, those of at least an eighth of the examples
a row each, cut into blocks of examples, with the largest weight of each block.
A query sums its light terms exactly and takes the blocks in order of their
upper bound; blocks whose bound is below the k-th best cosine are not read, so
the neighbours are exact. Neighbours vote with weights that fall with distance;
votes are set back to the labels' true shares and smoothed, and an isotonic fit
over the examples' own votes, each left out in turn, calibrates the score. The
neighbours are returned as evidence.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.llm._common import binary_text, slices_by_bytes, utf8
from palimpsest.llm.quality import held_out, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
MOST_EXAMPLES = 4_000
BLOCK = 64
HEAVY = 16  # terms of one in so many examples have a row, not postings
TOGETHER = 128  # queries that are answered at once
MOST_KNOWN = 10_000


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def found_terms(text: bytes | None, places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the terms in a text, by place."""
    words = words_of(utf8(text))
    known = words.keys() & places.keys()
    terms = np.fromiter(map(places.__getitem__, known), np.int64, len(known))
    counts = np.fromiter(map(words.__getitem__, known), np.int64, len(known))
    order = np.argsort(terms)
    return terms[order], counts[order]


def words_in(docs: DataFrame) -> DataFrame:
    """``_id`` with the different words of each text."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "_text", 1 << 22):
                words = [list(words_of(utf8(x))) for x in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(words, pa.list_(pa.string()))], names=["_id", "words"])

    return docs.select("_id", binary_text(F.col("_text")).alias("_text")).mapInArrow(work, f"_id {id_type}, words array<string>")


def sample_terms(docs: DataFrame, sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """All words of the sample, and the chi-square of each between the labels."""
    chosen = docs.join(F.broadcast(sample), F.col("_id") == F.col("_label_id"))
    words = words_in(chosen.select(F.struct("_id", "_label").alias("_id"), "_text"))
    # of a bounded sample; rows that repeat an id count once
    words = words.select("_id", F.explode("words").alias("w")).distinct()
    counts = words.groupBy("w").agg(F.sum("_id._label").cast("double").alias("a"), F.count("*").cast("double").alias("n")).toArrow().sort_by("w")
    sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    na, nb = float(max(1, sizes.get(1, 0))), float(max(1, sizes.get(0, 0)))
    a, seen = (counts.column(c).to_numpy() for c in ("a", "n"))
    b, n = seen - a, na + nb
    chi2 = n * (a * (nb - b) - b * (na - a)) ** 2 / (seen * np.maximum(n - seen, 1) * na * nb)
    return counts.column("w").to_pylist(), chi2


def document_counts(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """The number of texts, and in how many each term occurs, summed in each partition before anything is shuffled."""
    places = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(places) + 1, np.int64)  # the last one counts texts
        for whole in batches:
            for batch in slices_by_bytes(whole, "_text", 1 << 22):
                for raw in batch.column("_text").to_pylist():
                    found = set(WORD.findall(utf8(raw).lower()))
                    at = [p for w in found if (p := places.get(w)) is not None]
                    total[at] += 1
                total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["t", "n"])

    texts = docs.select(binary_text(F.col("_text")).alias("_text"))
    sums = texts.mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))
    sums = sums.toArrow()  # one row for each term at most
    seen = np.zeros(len(terms) + 1, np.int64)
    seen[sums.column("t").to_numpy()] = sums.column("n").to_numpy()
    return int(seen[-1]), seen[:-1]


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among weighted examples."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        # examples that share their weightiest term stand together, so that a block's bounds are tight
        lead = [(int(t[w.argmax()]), round(-float(w.max()), 6)) if len(t) else (terms, 0.0) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], i))
        self.ids, self.labels = ids[order], labels[order]
        self.vectors = [vectors[i] for i in order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        rows = np.repeat(np.arange(len(order)), [len(t) for t, _ in self.vectors])
        places = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)])
        heavy = np.bincount(places, minlength=terms) * HEAVY > max(len(order), BLOCK)
        self.row_of = np.where(heavy, np.cumsum(heavy) - 1, -1)
        own = heavy[places]
        self.dense = np.zeros((int(heavy.sum()), self.blocks * BLOCK))
        self.dense[self.row_of[places[own]], rows[own]] = weights[own]
        self.dense = self.dense.reshape(-1, self.blocks, BLOCK)
        self.bounds = self.dense.max(axis=2, initial=0)
        by_term = np.argsort(places[~own], kind="stable")
        self.rows, self.weights = rows[~own][by_term], weights[~own][by_term]
        self.starts = np.searchsorted(places[~own][by_term], np.arange(terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term, ties by place."""
        return self.nearest_of([(terms, weights)], k, np.array([without]))[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k nearest of each query; a block is read for all queries at once that its bound does not rule out."""
        n, size = len(queries), self.blocks * BLOCK
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in queries)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in queries)])
        query = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        row = self.row_of[terms]
        own = row >= 0
        heavy = np.zeros((n, len(self.dense)))
        heavy[query[own], row[own]] = weights[own]
        # light terms: all postings of all queries, one after the other
        at, sizes = self.starts[terms[~own]], self.starts[terms[~own] + 1] - self.starts[terms[~own]]
        ends = np.cumsum(sizes)
        at = np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        cells = np.repeat(query[~own] * size, sizes) + self.rows[at]
        cosine = np.bincount(cells, np.repeat(weights[~own], sizes) * self.weights[at], n * size).astype(np.float64, copy=False)
        cosine = cosine.reshape(n, self.blocks, BLOCK)
        if without is not None:
            out = np.flatnonzero(without >= 0)
            cosine[out, without[out] // BLOCK, without[out] % BLOCK] = -np.inf
        bound = cosine.max(axis=2) + heavy @ self.bounds
        first = min(self.blocks, max(2, -(-2 * k // BLOCK)))
        read = np.zeros((n, self.blocks), bool)
        np.put_along_axis(read, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        self._read(cosine, heavy, read)
        # below the k-th best, even with rounding, no example of a block can enter
        best = -np.partition(-np.where(read[:, :, None], cosine, -np.inf).reshape(n, size), min(k, size) - 1, axis=1)[:, min(k, size) - 1]
        rest = ~read & (bound >= np.maximum(best, 0)[:, None] - 1e-8)
        self._read(cosine, heavy, rest)
        cosine[~(read | rest)] = -np.inf
        flat = cosine.reshape(n, size)
        least = -np.partition(-flat, min(k, size) - 1, axis=1)[:, min(k, size) - 1]
        found = []
        for q in range(n):
            rows = np.flatnonzero(flat[q] >= max(least[q] - 1e-8, 1e-300))
            top = rows[np.argsort(-np.round(flat[q, rows], 9), kind="stable")[:k]]
            found.append((top, flat[q, top]))
        return found

    def _read(self, cosine: np.ndarray, heavy: np.ndarray, wanted: np.ndarray) -> None:
        """Add the heavy terms' part to the cosines of the wanted blocks."""
        for block in np.flatnonzero(wanted.any(axis=0)) if len(self.dense) else ():
            own = np.flatnonzero(wanted[:, block])
            cosine[own, block] += heavy[own] @ self.dense[:, block]


class ToxicityModel:
    """The weights of terms, the index, and the calibration of the votes."""

    def __init__(self, idf: np.ndarray, k: int, share: float):
        self.idf, self.k, self.share = idf, k, share
        self.known: dict[bytes, tuple[float, list]] = {}

    def vector(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, np.float64))) * self.idf[t]
        return t, w / max(np.sqrt((w**2).sum()), 1e-12)

    def fit(self, rows: list[tuple[int, int, list[int], list[int]]]) -> ToxicityModel:
        """Index the examples (id, label, terms, counts) and calibrate on them."""
        labels = np.array([r[1] for r in rows], np.int64)
        ones = max(1, int(labels.sum()))
        #: how much an example of each label stands for, so that votes follow the labels' true shares
        self.stand = np.array([(1 - self.share) * len(rows) / max(1, len(rows) - ones), self.share * len(rows) / ones])
        ids = np.array([r[0] for r in rows], object)
        self.index = BlockMaxIndex(ids, labels, [self.vector(r[2], r[3]) for r in rows], len(self.idf))
        empty = [y for (t, _), y in zip(self.index.vectors, self.index.labels.tolist(), strict=True) if not len(t)]
        weight = np.bincount(empty, minlength=2)[:2] * self.stand
        #: without a term no example is nearer than another; those without a term vote
        self.without = float((weight[1] + 2 * self.share) / (weight.sum() + 2))
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        votes = [v for v, _ in self.votes(self.index.vectors, np.arange(len(rows)))]
        if len(rows) and 0 < labels.sum() < len(rows):
            self.x, self.y = isotonic(np.array(votes), self.index.labels, self.stand[self.index.labels])
        self.index.vectors = []  # not sent to executors
        return self

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
        """The vote and the neighbours of each vector."""
        out = []
        for at in range(0, len(vectors), TOGETHER):
            part = slice(at, at + TOGETHER)
            for rows, cosines in self.index.nearest_of(vectors[part], self.k, None if without is None else without[part]):
                labels = self.index.labels[rows]
                near = self.stand[labels] / (1.05 - np.minimum(cosines, 1))
                vote = float((near[labels == 1].sum() + self.share) / (near.sum() + 1)) if len(rows) else self.without
                out.append((vote, rows))
        return out

    def scores(self, texts: list[bytes | None], places: dict[str, int]) -> list[tuple[float, list]]:
        """The calibrated score, and the ids of the neighbours, of each text; texts met lately are not read again."""
        keys = [hashlib.blake2b(x or b"", digest_size=16).digest() for x in texts]
        new = {key: x for key, x in zip(keys, texts, strict=True) if key not in self.known}
        found = dict(self.known)
        votes = self.votes([self.vector(*found_terms(x, places)) for x in new.values()])
        for key, (vote, rows) in zip(new, votes, strict=True):
            found[key] = float(np.clip(np.interp(vote, self.x, self.y), 0, 1)), self.index.ids[rows].tolist()
        self.known = {key: found[key] for key in [*self.known, *new][-MOST_KNOWN:]}
        return [found[key] for key in keys]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of a rising fit of y to x by pooling adjacent violators, slightly tilted so that ranks stay."""
    values = np.unique(x)
    place = np.searchsorted(values, x)
    mass = np.bincount(place, weight)
    pools: list[list[float]] = []  # mean, mass, number of values
    for mean, m in zip((np.bincount(place, weight * y) / mass).tolist(), mass.tolist(), strict=True):
        pools.append([mean, m, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    fitted = np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])
    return values, 0.98 * fitted + 0.02 * values


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, border: float = 0.5, parts: int = 5, part: int = 0, k: int = 25,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_examples: int = MOST_EXAMPLES,
) -> DataFrame:
    """Return id, held_out, score, predicted and the neighbours' ids as evidence for every row.

    Labels of held-out rows are not learnt from. A text without any word of the examples,
    a null or empty one among them, gets the share of toxic ones among examples
    without words. Repeated rows and null ids are scored like any other; without
    labels all scores are 0.5; an empty table gives an empty result. Other
    columns are not read.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    keep = ~held_out(id_col, parts, part)
    usable = labels.where(keep & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    sizes = {int(r[0]): r[1] for r in usable.groupBy(label_col).count().collect()}  # two at most
    chosen = [
        (r[0], r[1])
        for y in (0, 1)
        for r in labelled_sample(usable.where(F.col(label_col) == y), id_col, label_col, keep, most_examples // 2).collect()
    ]
    chosen = sorted({i: (i, y) for i, y in chosen}.values())  # bounded by most_examples
    id_type = docs.schema[id_col].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame(chosen, f"_label_id {id_type}, _label int")
    share = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    terms, chi2 = sample_terms(own, sample)
    places = {t: i for i, t in enumerate(terms)}
    n, seen = document_counts(own, terms)
    idf = np.log((1 + n) / (1 + seen)) + 1
    joined = own.join(F.broadcast(sample), F.col("_id") == F.col("_label_id"))
    # one row for each example, whatever the number of documents with its id
    examples = joined.groupBy("_id").agg(F.min(F.struct("_label", binary_text(F.col("_text")).alias("_text"))).alias("r")).select("_id", "r.*")
    rows = sorted(((r["_id"], r["_label"], *found_terms(r["_text"], places)) for r in examples.toLocalIterator()), key=lambda r: r[0])
    model = ToxicityModel(idf * np.sqrt(1 + chi2), k, share).fit(rows)
    evidence_type = pa.list_(to_arrow_type(docs.schema[id_col].dataType))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "_text", 1 << 20):
                scored = model.scores(batch.column("_text").to_pylist(), places)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array([s for s, _ in scored], pa.float64()), pa.array([e for _, e in scored], evidence_type)],
                    names=["_id", "score", "evidence"],
                )

    texts = own.select("_id", binary_text(F.col("_text")).alias("_text"))
    return texts.mapInArrow(work, f"_id {id_type}, score double, evidence array<{id_type}>").select(
        F.col("_id").alias(id_col),
        held_out("_id", parts, part).alias("held_out"),
        "score",
        (F.col("score") >= border).cast("int").alias("predicted"),
        "evidence",
    )
