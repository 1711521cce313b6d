"""Features, normalisation, logistic regression by gradient descent, preference and explanations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.functions.text import floor_number
from tessaria.operators.workspace import Workspace

#: Training settings. (Fixed values.)
STEPS, RATE, PENALTY, LEAST_LABELS = 1000, 0.5, 1.0, 32
PREFERENCE_LABELS, PREFERENCE_WEIGHT = 8, 0.15
TINY, TOP_REASONS = 1e-6, 3


def normalised(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """key and z-scores of the features: population deviation, 1 where there is none; nulls become 0. The means are one
    row, joined by broadcast."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in features), *(F.stddev_pop(c).alias(f"_s_{c}") for c in features))
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0), F.lit(0.0))
    return df.join(F.broadcast(stats)).select(key, *(z(c).alias(c) for c in features))


def descend(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and weights after batch gradient descent from zero with an L2 penalty on the weights."""
    n = len(y)
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w, bias = w - RATE * (x.T @ error / n + PENALTY / n * w), bias - RATE * error.mean()
    return np.concatenate(([bias], w))


def train_models(df: DataFrame, profile: str, features: Sequence[str], label: str) -> DataFrame:
    """profile, n, bias, weights per profile with at least LEAST_LABELS labels of both kinds. A profile's labels are its
    users' feedback, a bounded set, so one task fits each."""

    def fit(group: pa.Table) -> pa.Table:
        x = np.column_stack([group[c].to_numpy(zero_copy_only=False).astype(float) for c in features])
        found = descend(x, group[label].to_numpy(zero_copy_only=False).astype(float))
        return pa.table({"profile": group[profile].slice(0, 1).cast(pa.int64()), "n": pa.array([len(group)], pa.int64()), "bias": pa.array([found[0]]), "weights": pa.array([found[1:].tolist()], pa.list_(pa.float64()))})

    enough = df.groupBy(profile).agg(F.count("*").alias("_n"), F.sum(label).alias("_p")).filter((F.col("_n") >= LEAST_LABELS) & (F.col("_p") > 0) & (F.col("_p") < F.col("_n")))
    return df.join(enough.select(profile), profile, "left_semi").select(profile, *features, label).groupBy(profile).applyInArrow(fit, "profile long, n long, bias double, weights array<double>")


def trainable(df: DataFrame, profile: str, label: str) -> DataFrame:
    """profile, n of the profiles with at least LEAST_LABELS labels of both kinds."""
    counted = df.groupBy(profile).agg(F.count("*").alias("n"), F.sum(label).alias("_p"))
    return counted.filter((F.col("n") >= LEAST_LABELS) & (F.col("_p") > 0) & (F.col("_p") < F.col("n"))).drop("_p")


def gradient_models(df: DataFrame, profile: str, features: Sequence[str], label: str, steps: int = STEPS, written_every: int = 1) -> DataFrame:
    """profile, n, bias, weights after ``steps`` of ``descend`` for all profiles at once. A step is one aggregate: the errors of
    all labels under their profile's weights, summed by profile in partial sums, and weights moved by the sums; no task has
    all labels of a profile. Weights are written at each step (or every few), so the next one reads a small table whose size Spark knows
    and joins it without a sort of the labels by profile."""
    space = Workspace(df.sparkSession, "gradient")
    rows = space.write(df.select(F.col(profile).alias("profile"), F.array(*(F.col(c).cast("double") for c in features)).alias("x"), F.col(label).cast("double").alias("y")), "labels")
    zero = F.array(*(F.lit(0.0) for _ in features))
    models = space.write(trainable(rows, "profile", "y").select("profile", "n", F.lit(0.0).alias("bias"), zero.alias("weights")), "step0")
    for step in range(1, steps + 1):
        errors = rows.join(models, "profile").select("profile", "x", (probability(F.col("bias"), F.col("weights"), F.col("x")) - F.col("y")).alias("e"))
        sums = errors.groupBy("profile").agg(F.sum("e").alias("_e"), F.array(*(F.sum(F.col("e") * F.col("x")[i]) for i in range(len(features)))).alias("_g"))
        moved = F.zip_with("weights", "_g", lambda w, g: w - RATE * (g / F.col("n") + PENALTY / F.col("n") * w))
        models = models.join(sums, "profile").select("profile", "n", (F.col("bias") - RATE * F.col("_e") / F.col("n")).alias("bias"), moved.alias("weights"))
        if step % written_every == 0:
            models = space.write(models, f"step{step}")
    return models


def rescored(rows: DataFrame, models: DataFrame, profile: str) -> DataFrame:
    """``rows`` (profile, x, cold, score) with scores to three places and their kind: a profile with a model is scored anew
    (trained); without one a score that is there stays (kept), and a missing one is the cold start."""
    made = rows.join(models.select(profile, "bias", "weights"), profile, "left")
    trained, cold = F.round(probability(F.col("bias"), F.col("weights"), F.col("x")), 3), F.round(cold_start(F.col("cold"), F.lit(None).cast("double")), 3)
    has = F.col("bias").isNotNull()
    kind = F.when(has, "trained").when(F.col("score").isNull(), "cold_start").otherwise("kept")
    return made.withColumn("kind", kind).withColumn("score", F.when(has, trained).otherwise(F.coalesce("score", cold))).drop("bias", "weights")


def probability(bias: Column, weights: Column, x: Column) -> Column:
    total = F.aggregate(F.zip_with(weights, x, lambda w, v: w * v), bias, lambda s, v: s + v)
    return 1 / (1 + F.exp(-total))


def explanations(df: DataFrame, key: str, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """The TOP_REASONS largest contributions of each row: key, feature, contribution, rank."""
    terms = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(c) * w).alias("contribution")) for c, w in zip(features, weights, strict=True))))
    rows = df.select(key, terms.alias("t")).select(key, "t.*").filter(F.abs("contribution") >= TINY)
    w = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_REASONS)


def centroids(df: DataFrame, vector: str, liked: str, dims: int) -> DataFrame:
    """One row: mean vectors of liked and disliked rows, null unless there are enough of both."""
    mean = lambda flag: F.array(*(F.avg(F.when(F.col(liked) == flag, F.col(vector)[i].cast("double"))) for i in range(dims)))
    out = df.agg(mean(True).alias("plus"), mean(False).alias("minus"), F.count(liked).alias("n"), F.count_if(liked).alias("p"))
    ok = (F.col("n") >= PREFERENCE_LABELS) & (F.col("p") > 0) & (F.col("p") < F.col("n"))
    return out.select(F.when(ok, F.col("plus")).alias("plus"), F.when(ok, F.col("minus")).alias("minus"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def preference(vector: Column, plus: Column, minus: Column) -> Column:
    return F.least(F.greatest(cosine(vector, plus) - cosine(vector, minus), F.lit(-1.0)), F.lit(1.0))


def with_preference(base: Column, signal: Column) -> Column:
    return F.least(F.greatest(base + PREFERENCE_WEIGHT * F.coalesce(signal, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def relative_price(price: Column, m2: Column, price_min: Column, price_max: Column, size_min: Column, size_max: Column) -> Column:
    """A price against the middle of its scope's band, per square metre if sizes are bounded too. A band with one bound is
    that bound; null without a price band, or where a size is needed and missing."""
    middle = lambda lo, hi: F.coalesce((lo + hi) / 2, lo, hi)
    target, size = middle(price_min, price_max), middle(size_min, size_max)
    plain = F.when(target > 0, price / target)
    per_m2 = F.when((target > 0) & (size > 0) & (m2 > 0), F.try_divide(F.try_divide(price, m2), F.try_divide(target, size)))
    return F.when(size_min.isNull() & size_max.isNull(), plain).otherwise(per_m2)


def raw_features() -> list[Column]:
    """The eight raw features of a candidate: columns price, m2, rooms, floor (text), elevator, year, days, drop, and the
    scope's price_min, price_max, size_min, size_max."""
    c = lambda name: F.col(name).cast("double")
    bands = [c(n) for n in ("price_min", "price_max", "size_min", "size_max")]
    elevator = F.when(F.col("elevator").isNotNull(), F.when(F.col("elevator"), 1.0).otherwise(0.0))
    return [relative_price(c("price"), c("m2"), *bands), c("m2"), c("rooms"), floor_number(F.col("floor")), elevator, c("year"), c("days"), c("drop")]


def cold_start(value: Column, pool: Column) -> Column:
    """1 / (1 + v) without a model, else the pool's score, else one half."""
    return F.coalesce(1 / (1 + value), pool, F.lit(0.5))
