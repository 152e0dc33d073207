"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on word statistics, fitted to labelled documents, gives each document its own
evidence. Sums of that evidence per path and per host become beta posteriors: a path is shrunk towards
its host and a host towards the whole table, the more so the fewer documents it has. The strength of
each prior comes from the spread between sites (method of moments). A document's posterior joins its own
likelihood ratio to the prior of its path, from which the document itself is left out.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillmill.llm.shared import free_name, materialize, small_batches

#: Labelled documents used for the fit at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Site statistics are broadcast up to so many rows (names are cut to hashes, so a row is 64 bytes); beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
SALTS = 32
OWN = ("__host", "__path", "__logit", "__p", "__n", "__s", "__hm", "__salt")
FEATURES = ("pipes", "symbols", "shouts", "upper_words", "repeats", "variety", "word_length", "repeated_lines", "letters", "digits", "log_words")


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, each between about 0 and 3; of an empty one all zero."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = text.count
    lines = text.split("\n")
    joined = sum(map(len, words))
    kinds = len(set(words))
    return [
        math.log1p(10 * count("|") / n),
        math.log1p(10 * (count("*") + count("$") + count("&") + count("%") + count("#")) / n),
        math.log1p(10 * count("!") / n),
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        math.log1p(kinds) / math.log1p(n),
        math.log1p(joined / n),
        1 - len(set(lines)) / len(lines),
        sum(map(str.isalpha, words)) / n,
        math.log1p(10 * sum(map(str.isdigit, words)) / n),
        math.log1p(n) / 4,
    ]


class Model:
    """Weights on standardised features; ``logit`` is the evidence with the prior of the training rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = self._expand(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(len(self.w), ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._expand(x) @ self.w, -12, 12)


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents; an id with several labels counts by its mean, null labels not at all."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__id")
    # of several texts of an id the one of the least hash, so no more rows than labels come together
    rows = rows.groupBy("__id", "__y").agg(F.min_by("__t", F.xxhash64("__t")).alias("__t"))

    def measure(batches):
        for b in batches:
            x = [features(t) for t in b.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    got = rows.select("__t", "__y").mapInArrow(measure, "y double, x array<double>").toPandas()
    if got.empty:  # nothing is known: every document has even odds
        got = pd.DataFrame({"y": [0.0, 1.0], "x": [[0.0] * len(FEATURES)] * 2})
    # a fixed order keeps the sums, and so the weights, the same
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(float)
    order = np.lexsort((y, *x.T))
    return Model(x[order], y[order])


def _logit(model: Model, text: Column) -> Column:
    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(model.logit(np.array([features(t) for t in texts.to_pylist()])), pa.float64())

    return score(text)


def _strength(mean: float, spread: float, within: float) -> float:
    """Prior count of a beta with this mean whose groups spread so, less what sampling alone makes."""
    return min(max(mean * (1 - mean) / max(spread - within, 1e-6) - 1, 1.0), 1e6)


def site_priors(scored: DataFrame) -> tuple[DataFrame, dict]:
    """Per (host, path): n, s and the host's posterior mean; and the strengths of the priors."""
    site = materialize(
        scored.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum(F.round("__p", 9).cast("decimal(28,9)")).cast("double").alias("s")), "sites"
    )
    host = site.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = host.agg(F.sum("hn"), F.sum("hs")).first()
    if not total[0]:
        return site.withColumn("hm", F.lit(0.5)), {"mean": 0.5, "host": 1.0, "path": 1.0}
    mean = min(max(total[1] / total[0], 1e-4), 1 - 1e-4)
    spread = host.agg(
        F.avg((F.col("hs") / F.col("hn") - mean) ** 2), F.avg(F.lit(mean * (1 - mean)) / F.col("hn"))
    ).first()
    by_host = _strength(mean, *spread)
    host = host.select("__host", ((F.col("hs") + by_host * mean) / (F.col("hn") + by_host)).alias("hm"))
    site = site.join(host, "__host")
    m = F.col("hm")
    spread = site.agg(F.avg((F.col("s") / F.col("n") - m) ** 2), F.avg(m * (1 - m) / F.col("n"))).first()
    return site, {"mean": mean, "host": by_host, "path": _strength(mean, *spread)}


def quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str | None = "lang",
    label_col: str = "quality",
    threshold: float = 0.5,
    sample: int = SAMPLE,
) -> DataFrame:
    """``df`` with ``q_evidence, q_path, q_posterior, q_keep``; all rows and columns stay.

    Null hosts and paths are sites of their own. Null and empty texts have no evidence and are not kept.
    Repeated rows count as often as they occur. Without any label every evidence is 0. Columns of the input
    with the names of the four new ones are replaced. ``documents`` has no path, so ``lang`` stands for it there.
    """
    small_batches(df.sparkSession)
    model = fit(df, labels, id_col, text_col, label_col, sample)
    # names of our own give way, and come back
    kept = {c: free_name(df, f"kept_{i}") for i, c in enumerate(df.columns) if c.lower() in OWN}
    df = df.withColumnsRenamed(kept)
    id_col, text_col, host_col, path_col = (kept.get(c, c) for c in (id_col, text_col, host_col, path_col))
    path = F.col(path_col) if path_col else F.lit("")
    keyed = df.withColumn("__host", F.xxhash64(F.col(host_col))).withColumn("__path", F.xxhash64(F.col(host_col), path))
    keyed = keyed.withColumn("__logit", F.round(_logit(model, F.col(text_col)), 9))
    keyed = keyed.withColumn("__p", 1 / (1 + F.exp(-F.col("__logit"))))
    site, strength = site_priors(keyed.select("__host", "__path", "__p"))
    site = materialize(site.select("__path", F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("hm").alias("__hm")), "priors")
    if site.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(site), "__path")
    else:
        salted = keyed.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SALTS)))
        joined = salted.join(site.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["__path", "__salt"]).drop("__salt")
    k, prior = strength["path"], strength["mean"]
    rest_n, rest_s = F.col("__n") - 1, F.greatest(F.col("__s") - F.col("__p"), F.lit(0.0))
    # alone on its path, a document stands under its host's mean
    site_mean = F.least(F.greatest((rest_s + k * F.col("__hm")) / (rest_n + k), F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("__logit") - math.log(prior / (1 - prior)) + F.log(site_mean / (1 - site_mean))
    empty = F.coalesce(F.trim(F.col(text_col)), F.lit("")) == ""
    return (
        joined.withColumn("q_evidence", F.col("__logit"))
        .withColumn("q_path", F.round(site_mean, 9))
        .withColumn("q_posterior", F.round(F.when(empty, 0.0).otherwise(1 / (1 + F.exp(-odds))), 9))
        .withColumn("q_keep", F.col("q_posterior") >= threshold)
        .drop(*OWN).withColumnsRenamed({v: k for k, v in kept.items()})
    )
