"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier, fitted on labelled documents, gives each document a probability from figures of its whole text.
Sites are grouped twice: by host and by path within the host. Both levels have a posterior mean quality: a path's mean is
shrunk to its host's posterior and a host's to the mean of all documents, by strengths that the data themselves give (within
variance over between variance, estimated by moments from grouped sums). A document's evidence is then combined
with its path's posterior, of which its own share is taken out first: log odds add. Sparse sites lie near their priors
and change nothing; large consistent ones move the borderline documents.

The classifier is fitted on at most ``FIT_ROWS`` labelled documents, those of the smallest id hash; everything else covers
all rows. Grouped sums are the only shuffle; texts never move.

Defined results: a null text counts as empty; null hosts and paths are groups of their own; labels that are null or of
unknown documents don't count; without labels of both classes every document has the labels' mean (1/2 without any);
repeated rows are judged alike; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_ROWS, hot_join, small_batches, text_or_empty, written
from textloom.llm.quality_rules import CHUNK_CHARS, base_figures

FIT_ROWS = 20_000
RIDGE, STEPS = 1.0, 25
THRESHOLD = 0.5
#: Hash places by which the rows to fit on are chosen.
PLACES = 1 << 20
FEATURES = ("log_words", "word_length", "symbols", "duplicate_lines", "repeated", "stuttered", "upper", "exclaiming", "digits", "variety")
#: Log odds that one document's evidence may have at most, either way.
LIMIT = 12.0


def features(texts: list[str | None]) -> np.ndarray:
    """[n, len(FEATURES)] figures of whole texts."""
    base = base_figures(texts)
    words = np.maximum(base["n_words"].to_numpy(), 1)
    out = np.zeros((len(base), len(FEATURES)))
    out[:, 0] = np.log1p(base["n_words"])
    out[:, 1] = base["word_chars"] / words
    out[:, 2] = base["n_symbols"] / words
    out[:, 3] = base["n_dup_lines"] / np.maximum(base["n_lines"], 1)
    out[:, 4] = base["n_repeat_words"] / words
    out[:, 5] = base["n_stuttered"] / words
    for i, t in enumerate(texts):
        t = t or ""
        own = t.split()
        out[i, 6] = sum(map(str.isupper, own)) / words[i]
        out[i, 7] = t.count("!") / words[i]
        out[i, 8] = sum(map(t.count, "0123456789")) / words[i]
        out[i, 9] = len(set(own)) / words[i] ** 0.7 if own else 0.0
    return out


def _batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        parts, chunk, chars = [], [], 0
        for t in texts:
            chunk.append(t)
            chars += len(t or "")
            if chars >= CHUNK_CHARS:
                parts.append(features(chunk))
                chunk, chars = [], 0
        parts.append(features(chunk))
        yield pd.DataFrame(np.vstack(parts), columns=list(FEATURES))


@dataclass
class Logistic:
    """Log odds = bias + weights . (x - mean) / scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def column(self, x: Column) -> Column:
        terms = [(x[f] - F.lit(float(m))) * F.lit(float(w / s)) for f, m, s, w in zip(FEATURES, self.mean, self.scale, self.weights, strict=True)]
        return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), sum(terms, F.lit(float(self.bias)))))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.bias + ((x - self.mean) / self.scale) @ self.weights, -LIMIT, LIMIT)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> Logistic:
    """Ridge logistic regression by Newton's method."""
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Logistic(np.zeros(k), np.ones(k), np.zeros(k), float(np.clip(log(p / (1 - p)), -LIMIT, LIMIT)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(k + 1, ridge)
    penalty[-1] = 0
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def _strength(groups: DataFrame, around: str) -> float:
    """Prior observations that one group's prior mean is worth. groups: n, total, squares and the column ``around``, the mean
    that the group's varies about."""
    m = F.col("total") / F.col("n")
    r = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("squares") - F.col("total") * m).alias("within"),
        F.sum(F.col("n") * F.pow(m - F.col(around), 2)).alias("between"),
    ).first()
    if not r["n"] or r["n"] <= r["k"]:
        return 1.0
    within = max(r["within"] / (r["n"] - r["k"]), 1e-12)
    spread = r["n"] - r["nn"] / r["n"]
    between = (r["between"] - (r["k"] - 1) * within) / spread if spread > 0 else 0.0
    return float(np.clip(within / between if between > 0 else np.inf, 1.0, 1e6))


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, host, path, evidence (the classifier's probability), host_quality, path_quality (posterior
    means), quality (the combined posterior) and kept. host and path default to the columns source and lang."""
    small_batches(docs.sparkSession)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = written(docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.pandas_udf(_batches, ", ".join(f"{f} double" for f in FEATURES))(text_or_empty(text_col)).alias("x")), "features")

    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.max(label_col).alias("y"))
    labelled = written(rows.join(known, "doc_id").select("x.*", "y", "doc_id"), "labelled")
    # ordering all labelled rows would send fit_rows of each task to the driver: first only those below a hash bound stay
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    bound = ceil(PLACES * min(1.0, 1.2 * fit_rows / max(1, labelled.count())))
    sample = labelled.where(place < bound).orderBy(place, "doc_id", *FEATURES).limit(fit_rows).drop("doc_id").collect()
    data = np.array([tuple(r) for r in sample], np.float64).reshape(-1, len(FEATURES) + 1)
    model = fit(data[:, :-1], (data[:, -1] > 0).astype(np.float64))

    odds = model.column(F.col("x"))
    scored = rows.select("doc_id", "host", "path", odds.alias("odds"), (1 / (1 + F.exp(-odds))).alias("p"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = written(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.count(F.lit(1)).alias("paths"))
    n, total = paths.agg(F.sum("n"), F.sum("total")).first()
    every = total / n if n else 0.5
    k_host = _strength(hosts.withColumn("every", F.lit(every)), "every")
    own = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))  # noqa: E731  # of a group, never null
    hosts = hosts.select(own("host").alias("hk"), F.col("paths"), ((k_host * every + F.col("total")) / (k_host + F.col("n"))).alias("host_quality"), (F.col("total") / F.col("n")).alias("host_mean"))
    hosts = written(hosts, "hosts")
    paths = written(hot_join(paths.withColumn("hk", own("host")), hosts, "hk", "paths", F.xxhash64("path")).drop("paths"), "paths")
    k_path = _strength(paths, "host_mean")
    paths = paths.select("hk", own("path").alias("pk"), "n", "total", "host_quality")

    keyed = scored.select("*", own("host").alias("hk"), own("path").alias("pk"))
    if paths.count() <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(paths), ["hk", "pk"])
    else:
        out = hot_join(keyed, paths, ["hk", "pk"], "n", F.xxhash64("doc_id"))
    posterior = lambda total, n: (k_path * F.col("host_quality") + total) / (k_path + n)
    others = posterior(F.col("total") - F.col("p"), F.col("n") - 1)
    combined = F.col("odds") + _odds(others) - _odds(F.lit(every))
    quality = 1 / (1 + F.exp(-combined))
    return out.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_quality", posterior(F.col("total"), F.col("n")).alias("path_quality"), quality.alias("quality"), (quality >= threshold).alias("kept"))
