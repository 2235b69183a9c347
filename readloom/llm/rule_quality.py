"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Shallow boosted trees over text statistics are grown on a bounded sample of
labelled documents; each path from a root to a node is a conjunctive rule. A
lasso logistic regression over the rules keeps few of them, and the weighted
rules become one Spark expression, so scoring is a projection over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS
from .line_quality import word_array

#: Labelled documents that the fit takes at most, by a hash of their ids.
SAMPLE = 8000
TREES, DEPTH, SHRINK, LEAF, CUTS = 30, 3, 0.3, 20, 32
LASSO, ROUNDS = 0.002, 400
THRESHOLD = 0.3

FEATURES = (
    "n_words", "word_len", "chars_per_line", "words_per_line", "upper", "digit", "symbol", "stop", "bang", "comma", "distinct_words", "distinct_lines", "longest_word",
    "short_words", "non_ascii", "blank",
)


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the statistics, columns f_<name>, of the whole text; a null text
    counts as empty and every statistic of an empty text is zero."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = lambda keep: F.length(F.regexp_replace("_t", f"[^{keep}]+", ""))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    counted = (
        docs.withColumn("_t", text)
        .withColumn("_w", word_array(F.col("_t")))
        .withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(x) > 0))
        .withColumn("_marks", F.regexp_replace("_t", r"[\p{L}\x20]+", ""))
        .withColumn("_lens", F.transform("_w", lambda w: F.length(w)))
    )
    mark = lambda keep: F.length(F.regexp_replace("_marks", f"[^{keep}]+", ""))
    counted = counted.select(
        *docs.columns,
        F.size("_w").alias("_nw"),
        F.length("_t").alias("_nc"),
        F.aggregate("_lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("_wc"),
        F.size("_l").alias("_nl"),
        left("A-Z").alias("_up"),
        mark("0-9").alias("_dg"),
        mark("#*$%&|<>{}\\\\[\\\\]=/~^_+").alias("_sy"),
        mark(".?").alias("_st"),
        mark("!").alias("_ba"),
        mark(",").alias("_co"),
        F.size(F.array_distinct("_w")).alias("_dw"),
        F.size(F.array_distinct("_l")).alias("_dl"),
        F.coalesce(F.array_max("_lens"), F.lit(0)).alias("_lo"),
        F.size(F.filter("_lens", lambda x: x <= 3)).alias("_sh"),
        (F.octet_length("_t") - F.length("_t")).alias("_na"),
        (F.length("_t") - F.length(F.btrim("_t", F.lit(BLANKS)))).alias("_bl"),
    )
    nw, nc, nl = F.col("_nw"), F.col("_nc"), F.col("_nl")
    values = {
        "n_words": nw.cast("double"), "word_len": share(F.col("_wc"), nw), "chars_per_line": share(nc, nl), "words_per_line": share(nw, nl), "upper": share(F.col("_up"), nc),
        "digit": share(F.col("_dg"), nc), "symbol": share(F.col("_sy"), nc), "stop": share(F.col("_st"), nw), "bang": share(F.col("_ba"), nw), "comma": share(F.col("_co"), nw),
        "distinct_words": share(F.col("_dw"), nw), "distinct_lines": share(F.col("_dl"), nl), "longest_word": F.col("_lo").cast("double"), "short_words": share(F.col("_sh"), nw),
        "non_ascii": share(F.col("_na"), nc), "blank": share(F.col("_bl"), nc),
    }
    return counted.select(*docs.columns, *[values[k].cast("double").alias(f"f_{k}") for k in FEATURES])


@dataclass(frozen=True)
class RuleModel:
    """log odds = bias + the weights of the rules that hold; a rule is a tuple
    of (feature, at most the cut?, cut)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]

    def score_column(self) -> Column:
        """The probability of label 1 as an expression over f_<name>."""
        test = lambda j, low, cut: f"(f_{FEATURES[j]} {'<=' if low else '>'} {cut!r}D)"
        terms = [f"CASE WHEN {' AND '.join(test(*t) for t in rule)} THEN {weight!r}D ELSE 0D END" for rule, weight in self.rules]
        while len(terms) > 8:  # a balanced sum, so that the expression stays shallow
            terms = ["(" + " + ".join(terms[i : i + 8]) + ")" for i in range(0, len(terms), 8)]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.bias!r}D', *terms])})))")

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, cut in rule:
        out &= (x[:, j] <= cut) == low
    return out


def _grow(x, cuts, bins, gradient, hessian, rows, depth, path, rules, out) -> None:
    """One regression tree on the gradient, by histograms; adds its paths to
    rules and its step to out."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-3, None)
    if depth and rows.size >= 2 * LEAF:
        for j, edges in enumerate(cuts):
            size = len(edges) + 1
            b = bins[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (gradient[rows], hessian[rows], None))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAF) | (rows.size - nl < LEAF)] = -1
            if gain.size and gain.max() > best[0]:
                best = (gain.max(), (j, int(gain.argmax())))
    if best[1] is None:
        out[rows] += SHRINK * g / (h + 1)
        return
    j, at = best[1]
    for low in (True, False):
        step = (*path, (j, low, float(cuts[j][at])))
        rules.add(step)
        _grow(x, cuts, bins, gradient, hessian, rows[(bins[rows, j] <= at) == low], depth - 1, step, rules, out)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Deterministic in its input. One class or no rows: the smoothed share of
    label 1 for every document, one half without rows."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return RuleModel(bias, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin, rules = np.full(len(y), bias), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        _grow(x, cuts, bins, y - p, p * (1 - p), np.arange(len(y)), depth, (), rules, margin)
    rules = sorted(rules)
    if not rules:  # no cut tells the labels apart
        return RuleModel(bias, ())
    a = np.stack([_holds(r, x) for r in rules], 1).astype(np.float64)
    a, kept = np.unique(a, axis=1, return_index=True)
    rules = [rules[i] for i in kept]
    centre = a.mean(0)
    a -= centre
    step = 4 * len(y) / np.linalg.norm(a, 2) ** 2
    w = np.zeros(a.shape[1])
    v, b, t = w, bias, 1.0
    for _ in range(ROUNDS):  # accelerated proximal gradient
        r = (1 / (1 + np.exp(-(b + a @ v))) - y) / len(y)
        after = v - step * (a.T @ r)
        after = np.sign(after) * np.maximum(np.abs(after) - step * lasso, 0)
        b -= 4 * r.sum()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = after + (t - 1) / later * (after - w), after, later
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - centre @ w), tuple((rules[i], float(w[i])) for i in on))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Fits on at most ``sample`` labelled documents for which ``learn``, a
    condition over id_col, holds; several labels of an id count as the lowest,
    and of several texts of an id the least is taken."""
    chosen = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)  # broadcast: ``sample`` rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    frame = with_features(rows, "_text").drop("_text").toPandas().sort_values("_id")
    return fit_rules(frame[[f"f_{k}" for k in FEATURES]].to_numpy(np.float64), frame["_y"].to_numpy(np.float64))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def rule_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns and held_out, score, predicted for every row.

    Null texts score as empty ones. Repeated ids keep a row each. Empty docs
    give an empty result; without labels every score is one half. Columns of
    docs named like the added ones are replaced; others stay as they are.
    """
    model = train(docs, labels, ~held_out(id_col, 5, 0), id_col, text_col, label_col)
    own = docs.drop("held_out", "score", "predicted")
    inner = own.select(F.struct(*own.columns).alias("_row"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    scored = with_features(inner, "_text").withColumn("score", model.score_column())
    # always true, but not pushed down: a filter on predicted is not made a second evaluation of all statistics
    once = F.spark_partition_id() >= 0
    return scored.select("_row.*", held_out("_id", 5, 0).alias("held_out"), "score", ((F.col("score") >= threshold) & once).cast("int").alias("predicted"))
