"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on text statistics gives each document a probability. Its
evidence is combined with the site it comes from: the mean probability of
a path is shrunk toward its host's, and the host's toward the global mean, each with a
strength that the method of moments takes from the spread between groups. A sparse
site stays near the prior, a large one speaks for itself. Groups are sums with partial
aggregation: no host gathers its documents.

The regression is fitted on at most `sample` labelled documents (those of the smallest
hashes of doc_id). Everything else covers all documents. `source` is the host and
`lang` the path below it; both are parameters.

Defined cases: null and empty texts have the statistics of no words; null hosts and paths are groups
of their own; repeated rows count as rows; without any label all documents get the prior 0.5;
labels without a document, or null, are not used; several labels of one doc_id count each; an empty table gives an
empty result. Only doc_id, text, host and path columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .quality_rules import judged

SAMPLE = 50_000
FEATURES = ("log_words", "short", "symbols", "repeats", "dup_lines", "lost", "upper", "word_length")


def features(text: Column) -> Column:
    """Array of text statistics, in the order of FEATURES."""
    upper = F.regexp_count(text, F.lit("[A-Z]")) / F.greatest(F.lit(1), F.char_length(text))
    return F.transform(F.array(judged(text)), lambda r: F.array(
        F.log1p(r["n_words"].cast("double")), (r["n_words"] < 20).cast("double"),
        F.least(F.lit(4.0), r["n_symbols"] / F.greatest(F.lit(1), r["n_words"])),
        r["n_repeat_words"] / F.greatest(F.lit(1), r["n_words"]),
        F.least(F.lit(1.0), r["n_dup_lines"] * 10 / F.greatest(F.lit(1), r["n_words"])),
        (r["lost_punctuation"] + r["lost_navigation"] + r["lost_boilerplate"]) / F.greatest(F.lit(1), r["n_words"]),
        upper, F.least(F.lit(20.0), r["word_chars"] / F.greatest(F.lit(1), r["n_words"]))))[0]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps with a ridge; the intercept is first."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    penalty = np.full(len(beta), ridge * max(1, len(x)) ** 0.5)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty) + 1e-9 * np.eye(len(beta)),
                               design.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _strength(mean: float | None, variance: float | None) -> float:
    """Pseudo-counts of a beta prior with this mean and variance between groups."""
    if mean is None or not variance or not 0 < mean < 1:
        return 100.0
    return float(min(1e6, max(1.0, mean * (1 - mean) / variance - 1)))


def _spread(groups: DataFrame, center: str) -> float | None:
    """Variance of the groups' means around their centre, less what sampling gives; weighted by size."""
    rate = F.col("s") / F.col("n")
    r = groups.where("n > 1").agg(F.sum(F.col("n") * (rate - F.col(center)) ** 2), F.sum("n"),
                                  F.sum(rate * (1 - rate))).first()
    return None if not r[1] else max(1e-6, float(r[0]) / float(r[1]) - float(r[2]) / float(r[1]))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    rows = durable(docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"),
                               F.coalesce(F.col(path).cast("string"), F.lit("\x00")).alias("path"),
                               features(text_or_empty()).alias("x")))
    some = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("y")).where("_id is not null and y is not null")
            .orderBy(F.xxhash64("_id"), "_id", "y").limit(sample))
    fit = rows.join(some, F.col("doc_id") == F.col("_id")).select("x", "y").collect()  # `sample` rows of a few numbers
    if fit:
        x, y = np.array([r["x"] for r in fit], float), np.array([r["y"] for r in fit], float)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        beta = fit_logistic((x - mean) / scale, y)
        weights = beta[1:] / scale
        bias, prior = float(beta[0] - weights @ mean), float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    else:
        weights, bias, prior = np.zeros(len(FEATURES)), 0.0, 0.5
    logit = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b),
                        F.lit(bias), lambda a, v: a + v)
    scored = rows.select("doc_id", "host", "path", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)).alias("l"))
    scored = scored.withColumn("p_doc", 1 / (1 + F.exp(-F.col("l"))))

    paths = durable(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_doc").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    r = hosts.agg(F.sum("s"), F.sum("n")).first()
    overall = min(1 - 1e-6, max(1e-6, float(r[0]) / float(r[1]))) if r[1] else prior
    k_host = _strength(overall, _spread(hosts.withColumn("c", F.lit(overall)), "c"))
    hosts = hosts.select("host", ((F.col("s") + k_host * overall) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k_path = _strength(overall, _spread(paths, "host_rate"))
    paths = paths.select("host", "path", "host_rate",
                         ((F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"))

    def log_odds(c):
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
        return F.log(p / (1 - p))

    # The document's evidence is relative to the prior it was fitted with.
    total = F.col("l") - float(np.log(prior / (1 - prior))) + log_odds(F.col("path_rate"))
    return scored.join(paths, ["host", "path"]).select(
        "doc_id", "p_doc", "host_rate", "path_rate", (1 / (1 + F.exp(-total))).alias("posterior")).withColumn(
        "kept", F.col("posterior") >= 0.5)


def op10_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_doc", "host_rate", "path_rate", "posterior")], "kept")
