"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on labelled rows; every path from a root to a node
is a conjunctive rule over the statistics. Lasso logistic regression, fitted by
proximal gradient steps, gives most rules the weight zero. The rules left are
compiled into one Spark column, so that scoring is a scan with built-in
functions. Only fitting runs on the driver, over the statistics of at most
``most_labelled`` rows, chosen by a hash of their id; their texts stay where
they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import free_prefix

MOST_LABELLED = 10_000
Condition = tuple[int, bool, float]  # statistic, whether above, border
Rule = tuple[Condition, ...]


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a text as columns; shares are of what their name says, and 0 where there is none."""
    chars, n = F.char_length(text), F.size(words)
    # a count is what is shorter without what is counted, as regexp_count would make an array of all matches
    count = lambda pattern: chars - F.char_length(F.regexp_replace(text, pattern + "+", ""))
    marks = lambda mark: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    letters, lines = count(r"\p{L}"), F.transform(F.split(text, "\n"), F.trim)
    return {
        "log_words": F.log1p(n.cast("double")),
        "word_length": share(chars, n),
        "upper_share": share(count(r"\p{Lu}"), letters),
        "letter_share": share(letters, chars),
        "digit_share": share(count("[0-9]"), chars),
        "symbol_share": share(count(r"[#$%&*@^~<>{}\[\]=_+\\/]"), chars),
        "bar_share": share(marks("|"), n),
        "shout_share": share(marks("!"), n),
        "stop_share": share(marks(".") + marks("?"), n),
        "comma_share": share(marks(","), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(n, F.size(lines)),
    }


def with_statistics(docs: DataFrame, text_col: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """Add the words and the statistics as columns that begin with ``prefix``; returns the statistics' names without it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.withColumn(f"{prefix}words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    found = statistics(text, F.col(f"{prefix}words"))
    return docs.withColumns({prefix + name: column for name, column in found.items()}), list(found)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, seed: int) -> list[Rule]:
    """The paths of boosted regression trees on the logistic gradient, split at quantiles."""
    rng = np.random.default_rng(seed)
    borders = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(borders, x.T, strict=True)], axis=1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = sigmoid(margin)
        gradient, weight = y - p, p * (1 - p)
        part = np.flatnonzero(rng.random(len(y)) < 0.5)
        work: list[tuple[Rule, np.ndarray]] = [((), part)]
        leaves: list[Rule] = []
        while work:
            path, rows = work.pop()
            best = (1e-6, None)
            if len(path) < depth and len(rows) >= 40:
                for f, b in enumerate(borders):
                    g = np.bincount(binned[rows, f], gradient[rows], len(b) + 1).cumsum()
                    h = np.bincount(binned[rows, f], weight[rows], len(b) + 1).cumsum()
                    n = np.bincount(binned[rows, f], minlength=len(b) + 1).cumsum()
                    gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
                    gain[(n < 15) | (n[-1] - n < 15)] = 0
                    k = int(gain[:-1].argmax()) if len(b) else 0
                    if len(b) and gain[k] > best[0]:
                        best = (gain[k], (f, k))
            if best[1] is None:
                leaves.append(path)
                continue
            f, k = best[1]
            above = binned[rows, f] > k
            for side in (False, True):
                longer = (*path, (f, side, float(borders[f][k])))
                rules[longer] = None
                work.append((longer, rows[above == side]))
        for path in leaves:
            hit = applies(path, x)
            rows = part[hit[part]]
            margin[hit] += rate * gradient[rows].sum() / (weight[rows].sum() + 1)
    return list(rules)


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, border in rule:
        hit &= (x[:, f] > border) == above
    return hit


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised."""
    z = np.column_stack([np.ones(len(y)), z])
    rate = 4 * len(y) / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        step = v - rate * (z.T @ (sigmoid(z @ v) - y)) / len(y)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    """Weighted rules over named statistics."""

    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return sigmoid(self.intercept + sum((w * applies(r, x) for r, w in self.rules), np.zeros(len(x))))

    def column(self, prefix: str = "") -> Column:
        """The score as one column over the statistics, whose columns begin with ``prefix``."""
        terms = []
        for rule, weight in self.rules:
            conditions = " AND ".join(f"`{prefix}{self.names[f]}` {'>' if above else '<='} {border!r}D" for f, above, border in rule)
            terms.append(f"IF({conditions}, {weight!r}D, 0D)")
        if not terms:
            return F.lit(float(sigmoid(np.array(self.intercept))))
        # summed over an array: one sum of all rules would make a method that is too large for the JVM to compile
        return F.expr(f"1D / (1D + exp(-aggregate(array({', '.join(terms)}), {self.intercept!r}D, (a, x) -> a + x)))")

    def describe(self) -> list[str]:
        """The rules in words, the weightiest first."""
        order = sorted(self.rules, key=lambda r: -abs(r[1]))
        return [
            f"{w:+.3f} if " + " and ".join(f"{self.names[f]} {'>' if a else '<='} {b:.4g}" for f, a, b in r)
            for r, w in order
        ]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, seed: int = 8) -> RuleModel:
    """Fit the ensemble; the largest penalty whose loss on a fifth that is held back is near the least is taken."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleModel(names, float(np.log(rate / (1 - rate))), [])
    rules = grow_rules(x, y, trees, depth, 0.3, seed)
    z = np.column_stack([applies(r, x) for r in rules] or [np.zeros(len(y))]).astype(np.float64)
    back = np.random.default_rng(seed).random(len(y)) < 0.2
    losses = {}
    for penalty in (0.0005, 0.001, 0.002, 0.004, 0.008):
        b, w = lasso_logistic(z[~back], y[~back], penalty, 150)
        p = np.clip(sigmoid(b + z[back] @ w), 1e-6, 1 - 1e-6)
        losses[penalty] = -np.mean(np.where(y[back] > 0, np.log(p), np.log(1 - p))) if back.any() else 0.0
    penalty = max(k for k, v in losses.items() if v <= min(losses.values()) + 0.01)
    b, w = lasso_logistic(z, y, penalty)
    return RuleModel(names, b, [(r, float(v)) for r, v in zip(rules, w, strict=False) if abs(v) > 1e-4])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, keep: Column, most: int) -> DataFrame:
    """At most ``most`` labelled ids, chosen by a hash of the id; one row for each id."""
    usable = labels.where(keep & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    one = usable.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    return one.orderBy(F.xxhash64("_label_id"), "_label_id").limit(most)


def train_quality(
    docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality",
    id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED,
) -> RuleModel:
    """Fit the rules on labelled rows for which ``keep``, a condition on the labels, holds."""
    sample = F.broadcast(labelled_sample(labels, id_col, label_col, keep, most_labelled))  # at most most_labelled rows
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stats, names = with_statistics(own.join(sample, F.col("_id") == F.col("_label_id")), "_text", "_stat_")
    # one row for each id of the sample, whatever the number of documents with that id
    least = F.min(F.struct("_label", *(f"_stat_{n}" for n in names))).alias("_row")
    rows = sorted((r[0], *r[1]) for r in stats.groupBy("_id").agg(least).collect())
    data = np.array([r[1:] for r in rows], np.float64).reshape(-1, 1 + len(names))
    return fit_rules(data[:, 1:], data[:, 0], names)


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score; all columns of the input stay.

    Null and empty texts get the score of a text without words. Repeated rows
    and null ids are scored like any other; an empty table gives an empty
    result. Inner columns have names that no column of the input begins with.
    """
    prefix = free_prefix(docs.columns, "_stat_")
    stats, _ = with_statistics(docs, text_col, prefix)
    # exploded from an array of one, as Spark would put the whole expression into a filter on a plain column
    return stats.select(*docs.columns, F.explode(F.array(model.column(prefix))).alias(score_col))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of an id, written as text, leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def classify_quality(
    docs: DataFrame, labels: DataFrame, border: float = 0.7, parts: int = 4, part: int = 2,
    id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """Return id, held_out, score and predicted for every row; held-out rows' labels are not learnt from."""
    model = train_quality(docs, labels, ~held_out(id_col, parts, part), id_col=id_col, text_col=text_col, most_labelled=most_labelled)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return score_quality(own, model, "_text").select(
        F.col("_id").alias(id_col),
        held_out("_id", parts, part).alias("held_out"),
        "score",
        (F.col("score") >= border).cast("int").alias("predicted"),
    )
