"""Document quality by hierarchical empirical Bayes.

A logistic classifier on shape features of a text gives its evidence as log
odds against the training prior.  Grouped sums over all documents, of labels where
there are any and of the classifier's probability elsewhere, give every host, and
every path below it, a posterior rate: a path's is shrunk towards its host's, a
host's towards the global rate, each by a prior strength estimated from the
spread between sites beyond that within them, so that sparse sites keep close to
their parents.  A document's score is the classifier's evidence together with the
log odds of its path's posterior, in which the document itself does not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textkit
from tidewright.llm.cluster import ship, small_batches, stash

SAMPLE_ROWS = 20_000  # labelled rows that the classifier is fitted on, at most
FEATURES = ("log_words", "word_length", "distinct", "top_word", "symbols", "digits", "upper", "bars", "lines", "line_repeats", "pair_repeats", "marked_words", "doubled")


def _byte_classes() -> np.ndarray:
    """symbols, digits, upper, letters, bars, lines: a 0/1 row for each class of bytes."""
    out = np.zeros((6, 256), np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[0, b] = not c.isalnum() and c not in ".,;:'\"-?!|()"
        out[1, b] = c.isdigit()
        out[2, b] = c.isupper()
        out[3, b] = c.isalpha()
    out[3, 128:] = 1
    out[4, ord("|")] = 1
    out[5, 10] = 1
    return out


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice; zeros for a text without words."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    classes = _byte_classes()
    sums = [np.concatenate([[0], np.cumsum(row[data], dtype=np.int64)]) for row in classes]
    starts, ends, at = textkit.words(data, offsets)
    hashed = textkit.spans(textkit.byte_values(lower=True)[data], starts, ends)
    marked = sums[0][ends] - sums[0][starts] > 0 if len(starts) else np.empty(0, bool)
    breaks = np.flatnonzero(data == 10)
    values = textkit.byte_values()[data]
    for i in range(n):
        a, b, lo, hi = int(offsets[i]), int(offsets[i + 1]), int(at[i]), int(at[i + 1])
        words = hi - lo
        if not words:
            continue
        size = b - a
        count = [int(s[b] - s[a]) for s in sums]
        letters = max(count[3], 1)
        _, times = np.unique(hashed[lo:hi], return_counts=True)
        cut = np.concatenate([[a], breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)] + 1, [b]])
        lines = len(cut) - 1
        twice = 0.0
        if lines > 1:
            own = textkit.spans(values[a:b], cut[:-1] - a, np.concatenate([cut[1:-1] - 1, cut[-1:]]) - a)
            twice = 1 - len(np.unique(own)) / lines
        pairs = 1 - len(np.unique(hashed[lo : hi - 1] * np.uint64(3) + hashed[lo + 1 : hi])) / (words - 1) if words > 1 else 0.0
        doubled = float((hashed[lo : hi - 1] == hashed[lo + 1 : hi]).mean()) if words > 1 else 0.0
        out[i] = (np.log(words), (ends[lo:hi] - starts[lo:hi]).mean(), len(times) / words, times.max() / words, count[0] / size, count[1] / size, count[2] / letters, count[4] / words, lines / words, twice, pairs, marked[lo:hi].mean(), doubled)
    return out


@dataclass(frozen=True)
class Classifier:
    """Logistic regression on standardised features and their squares; ``prior`` is the good share it was fitted on."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad, within +-30."""
        return np.clip(self._expand(x) @ self.weights - np.log(self.prior / (1 - self.prior)), -30, 30)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Classifier:
    """Newton steps on the penalised likelihood; without both classes the evidence is zero."""
    good = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    wide = 2 * len(FEATURES) + 1
    if len(np.unique(y)) < 2:
        weights = np.zeros(wide)
        weights[-1] = np.log(good / (1 - good))
        return Classifier(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), weights, good)
    model = Classifier(np.median(x, axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(wide), good)
    z, w = model._expand(x), np.zeros(wide)
    penalty = np.full(wide, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(model.centre, model.scale, w, good)


def _scorer(model: Classifier | None):
    """Evidence of each text; without a model its features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for first, data, offsets in textkit.text_slices(batch.column(last)):
                n = len(offsets) - 1
                x = features_of(data, offsets)
                made = pa.array(model.evidence(x)) if model else pa.array(x.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, n) for i in range(last)), made], names=[*batch.schema.names[:last], "made"])

    return score


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y): one row per labelled id; labels that disagree count as good."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on the ``sample_rows`` labelled documents first in a hash order of their ids."""
    chosen = known_labels(labels, id_col, label_col).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # At most ``sample_rows`` ids: the texts of others move nowhere.
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_t")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_y", "_t")
    with small_batches(docs.sparkSession):
        made = rows.mapInArrow(_scorer(None), "_y int, made array<double>").collect()
    x = np.array([r["made"] for r in made]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["_y"] for r in made], float))


def _strength(rates: DataFrame, parent: str) -> DataFrame:
    """(strength): how many documents a parent's rate counts as, by the spread of site rates beyond that within sites.

    ``rates`` has a row per site: n, good and good2, the sum and the sum of
    squares of its documents' shares of good, and the parent's rate.
    """
    p, mean = F.col(parent), F.col("good") / F.col("n")
    within = F.sum(F.greatest(F.col("good2") - F.col("n") * mean * mean, F.lit(0.0))) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    apart = F.sum(F.col("n") * (mean - p) * (mean - p)) - F.count("*") * within
    between = F.greatest(apart / F.greatest(F.sum(F.col("n") * p * (1 - p)), F.lit(1e-9)), F.lit(1e-4))
    return rates.agg(F.greatest(F.lit(1.0), F.coalesce(1 / between - 1, F.lit(100.0))).alias("strength"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, host, path, evidence, host_rate, path_rate, score, keep.

    ``score`` is the posterior probability of good quality; ``keep`` is score >=
    threshold.  ``host_rate`` and ``path_rate`` are those of the other documents
    there, shrunk to the parent's.  Null hosts and paths are sites of their own.  Texts without
    words have the evidence of all-zero features.  Without labels of both
    classes the evidence is zero and everything has the global rate.  Labels of
    one id that disagree count as good.  Repeated rows are scored each; an empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    model = train(docs, labels, id_col, text_col, label_col, sample_rows)
    kind = {c: docs.schema[c].dataType.simpleString() for c in (id_col, host_col, path_col)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("t"))
    evident = rows.mapInArrow(_scorer(model), f"id {kind[id_col]}, host {kind[host_col]}, path {kind[path_col]}, made double").withColumnRenamed("made", "evidence")
    prior = float(np.log(model.prior / (1 - model.prior)))
    share = F.coalesce(F.col("_y").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + prior))))
    known = known_labels(labels, id_col, label_col)
    scored = stash(evident.join(known, F.col("id") == F.col("_id"), "left").select("id", "host", "path", "evidence", share.alias("share")), "quality-evidence")

    odds = lambda p: F.log(p / (1 - p))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "good2")]
    paths = stash(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("share").alias("good"), F.sum(F.col("share") * F.col("share")).alias("good2")), "quality-paths")
    hosts = paths.groupBy("host").agg(*sums)
    total = float(paths.agg(((F.coalesce(F.sum("good"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("rate")).first()["rate"])
    host_k = float(_strength(hosts.withColumn("parent", F.lit(total)), "parent").first()["strength"])
    shrunk = lambda n, good, k, rate: (good + k * rate) / (n + k)
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    placed = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("parent", shrunk(F.col("host_n"), F.col("host_good"), host_k, total))
    path_k = float(_strength(placed, "parent").first()["strength"])
    sites = stash(placed.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", "host_n", "host_good"), "quality-sites")

    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    joined = joined.withColumn("host_rate", shrunk(F.col("host_n") - 1, F.greatest(F.col("host_good") - F.col("share"), F.lit(0.0)), host_k, total))
    joined = joined.withColumn("path_rate", shrunk(F.col("n") - 1, F.greatest(F.col("good") - F.col("share"), F.lit(0.0)), path_k, F.col("host_rate")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + odds(F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))))))
    return joined.select(F.col("id").alias(id_col), F.col("host").alias(host_col), F.col("path").alias(path_col), "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose id has only rejected rows; rows with a null id are judged together."""
    verdict = classify(docs, labels, id_col, **options).groupBy(id_col).agg(F.bool_or("keep").alias("__tw_keep")).filter("__tw_keep").select(F.col(id_col).alias("__tw_id"))
    return docs.join(verdict, F.col(id_col).eqNullSafe(F.col("__tw_id")), "left_semi")
