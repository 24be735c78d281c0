"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted shallow trees are grown on labelled rows; each path from a root is a rule, a
conjunction of thresholds. An L1-penalised logistic regression weighs the rules
and drops most. What is left is compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import map_batches, texts_of

STATS = (
    "log_bytes", "log_words", "mean_word", "long_word", "upper_share", "digit_share", "space_share", "newline_share", "high_share", "punct_share",
    "symbol_share", "bar_share", "bang_share", "line_mean", "distinct_words", "top_word", "distinct_lines", "short_words", "end_punct", "run_share",
    "word_entropy", "distinct_pairs", "url_share", "brace_share",
)
_CLASS = np.zeros(256, np.uint8)
for _name, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", bytes(range(128, 256)), b".,;:?'\"-", b"#$%&*@^~_=+<>\\", b"|", b"!", b"(){}[]/"), 1):
    _CLASS[list(_bytes)] = _name


def statistics(text: str) -> list[float]:
    """STATS of a whole text; all 0 for an empty one."""
    raw = text.encode("utf-8")
    words = text.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(STATS) - 1)
    n, m = len(raw), len(words)
    b = np.frombuffer(raw, np.uint8)
    c = np.bincount(_CLASS[b], minlength=11)
    lengths = np.fromiter(map(len, words), np.int32, m)
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    f = np.fromiter(counts.values(), np.float64, len(counts)) / m
    ends = sum(map(text.count, (". ", ".\n", "! ", "? ")))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float((lengths > 14).mean()), c[1] / n, c[2] / n, c[3] / n, c[4] / n, c[5] / n, c[6] / n,
        c[7] / n, c[8] / n, c[9] / n, n / len(lines), len(counts) / m, float(f.max()), len(set(lines)) / len(lines), float((lengths < 3).mean()), ends / m, float((b[1:] == b[:-1]).mean()) if n > 1 else 0.0,
        float(-(f * np.log2(f)).sum() / np.log2(m + 1)), len(set(zip(words, words[1:], strict=False))) / m, text.count("http") / m, c[10] / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS, of each row; of null and empty texts all are 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x)) for x in table.T)], names=["doc_id", *STATS])

    return map_batches(texts_of(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is above, threshold), all of which must hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s, above, t in self.conditions:
            out &= (x[:, s] > t) == above
        return out

    def column(self) -> Column:
        parts = [F.col(STATS[s]) > t if above else F.col(STATS[s]) <= t for s, above, t in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, cuts: list[np.ndarray], rows: np.ndarray, path: tuple, out: list[Rule], step: np.ndarray) -> None:
    """A regression tree on the gradients; every node but the root gives a rule."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    step[rows] = g / (h + 1.0)
    if path:
        out.append(Rule(path))
    if depth == 0 or len(rows) < 40:
        return
    best, found = 1e-3, None
    for s, edges in enumerate(cuts):
        if not len(edges):
            continue
        place = np.searchsorted(edges, x[rows, s])
        gs = np.cumsum(np.bincount(place, gradient[rows], len(edges) + 1))[:-1]
        hs = np.cumsum(np.bincount(place, hessian[rows], len(edges) + 1))[:-1]
        ns = np.cumsum(np.bincount(place, minlength=len(edges) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < 20) | (len(rows) - ns < 20)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, found = gain[i], (s, float(edges[i]))
    if found:
        s, t = found
        above = x[rows, s] > t
        for side in (False, True):
            grow(x, gradient, hessian, depth - 1, cuts, rows[above == side], (*path, (s, side, t)), out, step)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated proximal gradient; the intercept is free."""
    n, k = z.shape
    bound = 0.25 * (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        nw = v - z.T @ r / n / bound
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / bound, 0)
        nb = c - r.mean() / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x))))))

    def column(self) -> Column:
        """The score as one expression over STATS."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3) -> RuleEnsemble:
    """Without rows, or with one label only, every score is the label's share (0.5 without rows)."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    cuts = []
    for column in x.T:
        edges = np.unique(np.quantile(column, np.linspace(0.005, 0.995, 120)))
        cuts.append(edges)
    rules: list[Rule] = []
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(x, y - p, np.maximum(p * (1 - p), 1e-6), depth, cuts, np.arange(len(y)), (), rules, step)
        margin += 0.3 * step
    rules = list(dict.fromkeys(rules))
    z = np.stack([r.holds(x) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    if not rules:
        return RuleEnsemble([], [], float(margin[0]))
    w, b = lasso_logistic(z, y.astype(np.float64), penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble([rules[i] for i in keep], [float(w[i]) for i in keep], float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000) -> RuleEnsemble:
    """Learns from labelled rows whose fold is not held out, ``sample_rows`` of them at most.

    The sample is the ids with the least hashes, so it is the same at every run;
    its size does not grow with the tables. Null labels and ids are left out; of
    an id with several labels or texts the greatest counts, once; an empty table
    gives a model that scores 0.5. Only doc_id, text and quality are read, so
    other columns of any name do not matter.
    """
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample_rows)
    sample = texts_of(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")  # sample_rows at most
    by_id = sample.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text"))
    stats = with_statistics(by_id).join(by_id.select(F.col("doc_id").alias("q_id"), "quality"), F.col("doc_id") == F.col("q_id")).orderBy("doc_id")
    rows = stats.select("quality", *STATS).toArrow()
    x = np.stack([rows[s].to_numpy() for s in STATS], 1) if rows.num_rows else np.zeros((0, len(STATS)))
    return fit(x, rows["quality"].to_numpy().astype(np.float64))


def quality_scores(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, of each row.

    A null text is scored as an empty one; a null id is not held out; rows that
    repeat are scored each; an empty table gives no rows; no shuffle.
    """
    scored = with_statistics(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
