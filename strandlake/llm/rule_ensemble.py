"""Quality classifier: a sparse rule ensemble, compiled to Spark columns.

Small boosted trees are grown over statistics of labelled documents; every path from a root is a rule, a conjunction of
thresholds; an L1-penalised logistic regression over rules and standardised statistics keeps a few of them; the model is
then a sum of ``CASE WHEN`` terms that Spark computes beside the statistics, without Python.

Training reads at most ``max_rows`` labelled documents (a documented bound: those of the smallest md5 of the id); the
statistics come from whole texts. Labels, language, source and id are never inputs.

Defined cases: null and empty texts have all statistics 0 and get a score like any other text; without labelled rows of
both kinds the score is the share of label 1 (0.5 without any); documents without labels are scored only; repeated rows
get equal scores; of splits of one gain the first statistic and smallest threshold wins; an empty table gives no rows.
Further columns pass through :func:`keep_good` under any name and are ignored by :func:`classify`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, count_words, packed, unpacked

MAX_ROWS = 20_000
FEATURES = ("lower", "upper", "digit", "space", "symbol", "bar", "exclaim", "stop", "other", "word_chars", "line_words", "repeated_lines", "size")


def statistics(texts: DataFrame) -> DataFrame:
    """``texts`` with a struct ``stats`` of the statistics of the whole ``text``; other columns of it are kept, and should
    be named apart from those made here (see :func:`packed`)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.regexp_replace(t, "[a-z]+", "")  # most of a text goes here, so what follows is short
    share = lambda c: F.when(F.col("n") > 0, c / F.col("n")).otherwise(0.0)
    without = lambda c, pattern: F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))
    full = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    a = texts.withColumn("t", t).withColumn("rest", rest).withColumn("n", F.char_length("t")).withColumn("n_words", count_words(F.col("t"))).withColumn("full", full)
    spaces = without(F.col("rest"), f"{SPACE}+")
    counts = {
        "lower": F.col("n") - F.char_length("rest"),
        "upper": without(F.col("rest"), "[A-Z]+"),
        "digit": without(F.col("rest"), "[0-9]+"),
        "space": spaces,
        "symbol": without(F.col("rest"), "[#*$%&<>]+"),
        "bar": without(F.col("rest"), "[|]+"),
        "exclaim": without(F.col("rest"), "!+"),
        "stop": without(F.col("rest"), "[.,;:?]+"),
        "other": without(F.col("rest"), "[^\\x00-\\x7F]+"),
    }
    words = F.col("n_words").cast("double")
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    fields = [share(c).cast("double").alias(k) for k, c in counts.items()]
    fields += [
        ratio((F.col("n") - spaces).cast("double"), words).alias("word_chars"),
        ratio(words, F.size("full").cast("double")).alias("line_words"),
        ratio((F.size("full") - F.size(F.array_distinct("full"))).cast("double"), F.size("full").cast("double")).alias("repeated_lines"),
        F.log1p(words).alias("size"),
    ]
    return a.withColumn("stats", F.struct(*fields)).drop("t", "rest", "n", "n_words", "full")


@dataclass
class Rule:
    """A conjunction: (statistic, True for "at most", threshold) terms."""

    terms: tuple[tuple[int, bool, float], ...]

    def hits(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, below, at in self.terms:
            out &= (x[:, f] <= at) if below else (x[:, f] > at)
        return out

    def column(self, stats: Column) -> Column:
        out = None
        for f, below, at in self.terms:
            one = stats[FEATURES[f]] <= F.lit(at) if below else stats[FEATURES[f]] > F.lit(at)
            out = one if out is None else out & one
        return out


@dataclass
class RuleEnsemble:
    bias: float = 0.0
    rules: list[tuple[float, Rule]] = field(default_factory=list)
    linear: list[tuple[float, int, float, float]] = field(default_factory=list)  # weight, statistic, low, high

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for w, rule in self.rules:
            out += w * rule.hits(x)
        for w, f, low, high in self.linear:
            out += w * np.clip(x[:, f], low, high)
        return out

    def score(self, stats: Column) -> Column:
        """Probability of label 1 as a Spark column over the struct of statistics."""
        out = F.lit(float(self.bias))
        for w, rule in self.rules:
            out = out + F.when(rule.column(stats), F.lit(float(w))).otherwise(F.lit(0.0))
        for w, f, low, high in self.linear:
            out = out + F.lit(float(w)) * F.least(F.greatest(stats[FEATURES[f]], F.lit(float(low))), F.lit(float(high)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), out))))


def _tree(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, terms: tuple = ()) -> tuple[list[Rule], np.ndarray]:
    """Rules of all nodes of one tree below ``terms``, and its step for every row."""
    value = -gradient.sum() / (hessian.sum() + 1.0)
    rules = [Rule(terms)] if terms else []
    if depth == 0 or len(x) < 2 * least:
        return rules, np.full(len(x), value)
    total_g, total_h = gradient.sum(), hessian.sum()
    best = (1e-6, -1, 0.0)
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        place = np.searchsorted(at, x[:, f], side="left")  # x <= at[k] for k >= place
        g = np.cumsum(np.bincount(place, gradient, len(at) + 1))[:-1]
        h = np.cumsum(np.bincount(place, hessian, len(at) + 1))[:-1]
        n = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(n < least) | (len(x) - n < least)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(at[k]))
    if best[1] < 0:
        return rules, np.full(len(x), value)
    low = x[:, best[1]] <= best[2]
    step = np.zeros(len(x))
    for side, below in ((low, True), (~low, False)):
        more, step[side] = _tree(x[side], cuts, gradient[side], hessian[side], depth - 1, least, (*terms, (best[1], below, best[2])))
        rules += more
    return rules, step


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the bias is free."""
    n, d = z.shape
    size = 4.0 / max(1e-9, np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2 / n)
    w, b = np.zeros(d), 0.0
    v, c, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        moved = v - size * (z.T @ r) / n
        w2, b2 = np.sign(moved) * np.maximum(np.abs(moved) - size * penalty, 0), c - size * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, rate: float = 0.3) -> RuleEnsemble:
    """Grow trees, collect their paths as rules, and weigh them with the lasso."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.0), 1.0)
        return RuleEnsemble(bias=float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    margin, rules = np.zeros(len(y)), {}
    least = max(5, len(y) // 200)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        found, step = _tree(x, cuts, p - y, p * (1 - p), depth, least)
        rules |= {r.terms: r for r in found}
        margin += rate * step
    kept = list(rules.values())
    z = np.column_stack([r.hits(x).astype(np.float64) for r in kept]) if kept else np.zeros((len(y), 0))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    spread = clipped.std(axis=0)
    scale = np.where(spread > 1e-12, 0.4 / np.maximum(spread, 1e-12), 0.0)
    bias, w = _lasso(np.column_stack([z, (clipped - clipped.mean(axis=0)) * scale]), y.astype(np.float64), penalty)
    linear = [(float(v * s), f, float(a), float(b)) for f, (v, s, a, b) in enumerate(zip(w[len(kept) :], scale, low, high, strict=True)) if v * s]
    bias -= float(sum(v * clipped[:, f].mean() for v, f, _, _ in linear))
    return RuleEnsemble(bias, [(float(v), r) for v, r in zip(w, kept, strict=False) if v], linear)


def in_training(doc: Column) -> Column:
    """Rows whose labels may be learned: crc32(id as text) mod 3 is not 1."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1


def train(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled documents of the training part: the labelled ids of smallest md5, and of
    documents that share an id the one with the smallest text hash."""
    said = packed(labels, d=doc, y=label).select("d", "y")
    usable = said.where(F.col("y").isin(0, 1) & F.col("d").isNotNull() & in_training(F.col("d"))).groupBy("d").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.md5(F.col("d").cast("string").cast("binary")), "d").limit(max_rows)
    given = packed(documents, id=doc, text=text).select("id", "text")
    sample = given.join(F.broadcast(chosen), F.col("id") == F.col("d"))  # at most max_rows small rows
    stats = statistics(sample).select("id", "y", F.xxhash64("text").alias("mark"), "stats")
    once = stats.groupBy("id").agg(F.min(F.struct("mark", "y", "stats")).alias("s"))
    rows = once.select("id", "s.y", "s.stats.*").orderBy("id").toPandas()
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def classify(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = train(documents, labels, doc, text, label, max_rows)
    stats = statistics(packed(documents, doc_id=doc, text=text).select("doc_id", "text"))
    scored = stats.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents, all columns, that score ``threshold`` or more."""
    model = train(documents, labels, doc, text, max_rows=max_rows)
    scored = statistics(packed(documents, text=text)).select("row", model.score(F.col("stats")).alias("score"))
    # a filter is not pushed below a one-row explode; pushed down, it would compute every statistic once per rule
    held = scored.select("row", F.explode(F.array("score")).alias("held"))
    return unpacked(held.where(F.col("held") >= threshold), documents)
