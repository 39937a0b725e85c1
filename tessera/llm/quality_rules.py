"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Statistics of a text are Spark expressions. On a bounded sample of labelled rows (`fit_rows`, rows with the
smallest hash) small regression trees are boosted; every path from a root to a node below it is a
conjunctive rule. A logistic regression with an L1 penalty over the rules keeps few of them. Rules and
weights become one Spark column, so scoring is a projection without Python, joins or shuffles.

Defined results: null counts as empty; an empty text has all statistics at 0 and gets the score of the
rules that hold there; repeated rows get equal scores; without any labelled rows, or with one class only,
the score is the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import pick

#: Labelled rows that the fit reads at most.
FIT_ROWS = 12_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name, all finite doubles."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    n_words = F.size(words)
    per_word = F.greatest(n_words, F.lit(1)).cast("double")
    n_chars = F.length(t)
    per_char = F.greatest(n_chars, F.lit(1)).cast("double")
    n_lines = F.size(F.split(t, "\n"))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    return {
        "log_words": F.log1p(n_words.cast("double")),
        "chars_per_word": n_chars / per_word,
        "distinct_words": F.size(F.array_distinct(words)) / per_word,
        "repeated_words": count(r"(?:^|\s)(\S++)(?=\s++\1(?:\s|$))") / per_word,
        "bars": count(r"\|") / per_word,
        "exclamations": count(r"[!?]") / per_word,
        "symbols": count(r"[#$%&*<>{}=_~^@\\]") / per_word,
        "digits": count(r"[0-9]") / per_char,
        "upper": count(r"[A-Z]") / per_char,
        "stops": count(r"[.:;]") / per_word,
        "words_per_line": n_words / F.greatest(n_lines, F.lit(1)).cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, is_above, threshold): above means strictly greater."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.terms:
            out = out & ((stats[name] > threshold) if above else (stats[name] <= threshold))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, threshold in self.terms:
            out &= (x[name] > threshold) if above else (x[name] <= threshold)
        return out


def _grow(x: np.ndarray, names: list[str], cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, terms: tuple, rules: list[Rule], leaves: list, min_rows: int) -> None:
    """Greedy least-squares splits; every node below the root adds its path as a rule."""
    if terms:
        rules.append(Rule(terms))
    best = None
    if depth and len(rows) >= 2 * min_rows:
        r = residual[rows]
        total, n = r.sum(), len(rows)
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            bin_of = np.searchsorted(edges, x[rows, j], side="left")
            sums, counts = np.bincount(bin_of, r, len(edges) + 1), np.bincount(bin_of, minlength=len(edges) + 1)
            left_sum, left_n = np.cumsum(sums)[:-1], np.cumsum(counts)[:-1]
            fits = (left_n >= min_rows) & (n - left_n >= min_rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, left_sum**2 / left_n + (total - left_sum) ** 2 / (n - left_n), -np.inf)
            k = int(np.argmax(gain))
            if np.isfinite(gain[k]) and gain[k] > total**2 / n + 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, float(edges[k]))
    if best is None:
        leaves.append((rows, residual[rows].mean()))
        return
    _, j, cut = best
    below = x[rows, j] <= cut
    for part, above in ((rows[below], False), (rows[~below], True)):
        _grow(x, names, cuts, residual, part, depth - 1, (*terms, (names[j], above, cut)), rules, leaves, min_rows)


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3, min_rows: int = 5, seed: int = 7) -> list[Rule]:
    """Paths of boosted logistic trees, each grown on half of the rows, without repeats."""
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)))
        cuts.append((values[:-1] + values[1:]) / 2)
    f = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: list[Rule] = []
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        leaves: list = []
        grown: list[Rule] = []
        _grow(x, names, cuts, residual, rows, depth, (), grown, leaves, min_rows)
        columns = {n: x[:, i] for i, n in enumerate(names)}
        p = 1 / (1 + np.exp(-f))
        inner = {r.terms[:-1] for r in grown}
        for rule in (r for r in grown if r.terms not in inner):  # leaves give the step
            on = rule.holds(columns)
            h = (p[on] * (1 - p[on])).sum() + 1.0
            f[on] += rate * (y[on] - p[on]).sum() / h
        rules += grown
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept (not penalised) and weights by accelerated proximal gradient descent."""
    n, k = z.shape
    mean = z.mean(axis=0)
    centred = z - mean
    v = np.ones(k)
    for _ in range(20):  # the largest eigenvalue sets the step
        v = centred.T @ (centred @ v)
        v /= np.linalg.norm(v) + 1e-12
    lipschitz = 0.25 * (np.linalg.norm(centred @ v) ** 2 / n) + 0.25
    w, b, w_look, b_look, t = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(k), 0.0, 1.0
    b_look = b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(centred @ w_look + b_look, -30, 30)))
        gw, gb = centred.T @ (p - y) / n, (p - y).mean()
        w_new = w_look - gw / lipschitz
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - penalty / lipschitz, 0)
        b_new = b_look - gb / lipschitz
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_look, b_look = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return b - float(mean @ w), w


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, text: Column) -> Column:
        return self.score_of(statistics(text))

    def score_of(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{n} {'>' if a else '<='} {c:.4g}" for n, a, c in r.terms) for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit_arrays(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.002) -> RuleModel:
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y, names)
    columns = {n: x[:, i] for i, n in enumerate(names)}
    z = np.stack([r.holds(columns) for r in rules], axis=1).astype(float)
    deviation = z.std(axis=0)
    keep = deviation > 0
    z, rules, deviation = z[:, keep] / deviation[keep], [r for r, k in zip(rules, keep, strict=True) if k], deviation[keep]
    intercept, w = lasso_logistic(z, y.astype(float), penalty)
    return RuleModel(float(intercept), tuple((r, float(a / d)) for r, a, d in zip(rules, w, deviation, strict=True) if abs(a) > 1e-6))


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(key, label) of the `rows` labelled ids with the smallest hash: bounded, and the same on every run."""
    known = pick(labels, key=id_col, label=label_col).where(F.col("label").isNotNull() & F.col("key").isNotNull())
    return known.groupBy("key").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", fit_rows: int = FIT_ROWS, penalty: float = 0.002) -> RuleModel:
    """Fit on fit_rows labelled documents at most; their statistics, never texts, reach the driver."""
    chosen = F.broadcast(sampled_labels(labels, id_col, label_col, fit_rows))
    stats = statistics(F.col("text"))
    rows = pick(docs, key=id_col, text=text_col).join(chosen, "key")
    table = rows.select("label", *[c.cast("double").alias(n) for n, c in stats.items()]).toPandas()
    return fit_arrays(table[list(stats)].to_numpy(float), table["label"].to_numpy(float), list(stats), penalty)


def score_documents(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score. Statistics are a projection of their own, so each is computed once for all rules."""
    stats = statistics(F.col("text"))
    measured = pick(docs, key=id_col, text=text_col).select("key", *[c.cast("double").alias(n) for n, c in stats.items()])
    return measured.select(F.col("key").alias(id_col), model.score_of({n: F.col(n) for n in stats}).alias("score"))
