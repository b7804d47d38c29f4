"""Learned ranking: boosted regression trees on ranking gradients.

Each step turns the current scores into gradients and second derivatives a row
(pointwise, pairwise or listwise; plain column expressions and one self-join
within a query), fits one tree of Spark's ML library to their ratio, and adds
its prediction. Rows are written once a step, so lineage stays short.

Fitting a tree is distributed over rows; a query's rows never meet in one task
but for their rank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranking import mean_reciprocal_rank, ranked
from .sampling import folds, pu_bag


def inside(rank: Column | str, k: int = 50, tau: float = 8.0) -> Column:
    """How far a rank lies inside the cutoff: a logistic step, or a hard one for tau 0."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    if tau == 0:
        return (rank <= k).cast("double")
    return 1.0 / (1.0 + F.exp(-(F.lit(k + 0.5) - rank) / F.lit(float(tau))))


def with_ranks(frame: DataFrame, score: str = "score", tie: str = "fused") -> DataFrame:
    return ranked(frame, F.col(score).desc(), F.col(tie), F.col("item_id"), name="place")


def pair_weights(frame: DataFrame, n_relevant: DataFrame, k: int = 50, tau: float = 8.0, least: float = 1e-6) -> DataFrame:
    """query_key, pos, neg, weight: the change in recall at k that swapping a
    relevant and another row makes, over the query's number of relevant items.

    frame: query_key, item_id, label, place (the rank in the full pool).
    """
    rows = frame.withColumn("in", inside("place", k, tau))
    pos = rows.filter("label = 1").select("query_key", F.col("item_id").alias("pos"), F.col("in").alias("pos_in"))
    neg = rows.filter("label = 0").select("query_key", F.col("item_id").alias("neg"), F.col("in").alias("neg_in"))
    pairs = pos.join(neg, "query_key").join(n_relevant, "query_key")
    weight = F.abs(F.col("pos_in") - F.col("neg_in")) / F.col("n_relevant")
    return pairs.select("query_key", "pos", "neg", weight.alias("weight")).filter(F.col("weight") > least)


def pairwise(frame: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_key, item_id, gradient, hessian of the logistic loss over weighted pairs."""
    s = frame.select("query_key", "item_id", "score")
    rows = pairs.join(s.withColumnsRenamed({"item_id": "pos", "score": "s_pos"}), ["query_key", "pos"]).join(s.withColumnsRenamed({"item_id": "neg", "score": "s_neg"}), ["query_key", "neg"])
    wrong = 1.0 / (1.0 + F.exp(F.col("s_pos") - F.col("s_neg")))
    g, h = F.col("weight") * wrong, F.col("weight") * wrong * (1 - wrong)
    sides = F.explode(F.array(F.struct(F.col("pos").alias("item_id"), g.alias("g"), h.alias("h")), F.struct(F.col("neg").alias("item_id"), (-g).alias("g"), h.alias("h"))))
    return rows.select("query_key", sides.alias("x")).groupBy("query_key", "x.item_id").agg(F.sum("x.g").alias("gradient"), F.sum("x.h").alias("hessian"))


def pointwise(frame: DataFrame, _pairs: DataFrame | None = None) -> DataFrame:
    p = 1.0 / (1.0 + F.exp(-F.col("score")))
    return frame.select("query_key", "item_id", (F.col("label") - p).alias("gradient"), (p * (1 - p)).alias("hessian"))


def listwise(frame: DataFrame, _pairs: DataFrame | None = None) -> DataFrame:
    """Softmax over a query's rows against the even distribution over its relevant ones."""
    w = Window.partitionBy("query_key")
    e = F.exp(F.col("score") - F.max("score").over(w))
    p, t = e / F.sum(e).over(w), F.col("label") / F.greatest(F.sum("label").over(w), F.lit(1))
    return frame.select("query_key", "item_id", (t - p).alias("gradient"), (p * (1 - p)).alias("hessian"))


OBJECTIVES: dict[str, Callable] = {"pairwise": pairwise, "pointwise": pointwise, "listwise": listwise}


@dataclass
class Ensemble:
    """Trees whose scaled predictions add up; ``first`` uses a prefix of them."""

    features: list[str]
    rate: float
    trees: list = field(default_factory=list)

    def predict(self, frame: DataFrame, name: str = "score", first: int | None = None) -> DataFrame:
        out = assembled(frame, self.features)
        total = F.lit(0.0)
        for k, tree in enumerate(self.trees[:first]):
            out = tree.setPredictionCol(f"_p{k}").setFeaturesCol("_features").transform(out)
            total = total + F.lit(self.rate) * F.col(f"_p{k}")
        return out.withColumn(name, total).drop("_features", *[f"_p{k}" for k in range(len(self.trees))])

    def importance(self) -> dict[str, float]:
        sums = [0.0] * len(self.features)
        for tree in self.trees:
            for k, v in enumerate(tree.featureImportances.toArray()):
                sums[k] += v / max(1, len(self.trees))
        return dict(zip(self.features, sums))


def assembled(frame: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(frame)


def fit(
    frame: DataFrame, features: list[str], n_relevant: DataFrame | None = None, objective: str = "pairwise", rounds: int = 2, per_round: int = 50,
    rate: float = 0.06, depth: int = 6, bins: int = 254, l2: float = 3.0, k: int = 50, tau: float = 8.0, bag: DataFrame | None = None, seed: int = 42,
) -> Ensemble:
    """frame: query_key, item_id, label, fused, features. bag: the rows
    (query_key, item_id) that gradients are taken on; ranks always come from the
    full frame, and pair weights are renewed once a round."""
    model = Ensemble(features, rate)
    full = written(assembled(frame, features).select("query_key", "item_id", "label", "fused", "_features"), "ltr")
    scores = full.select("query_key", "item_id", F.lit(0.0).alias("score"))
    keys = bag.select("query_key", "item_id") if bag is not None else None
    for _ in range(rounds):
        current = full.join(scores, ["query_key", "item_id"])
        pairs = None
        if objective == "pairwise":
            placed = with_ranks(current).drop("_features")
            used = placed.join(keys, ["query_key", "item_id"], "left_semi") if keys is not None else placed
            pairs = written(pair_weights(used, n_relevant, k, tau), "pairs")
        for _ in range(per_round):
            current = full.join(scores, ["query_key", "item_id"])
            used = current.join(keys, ["query_key", "item_id"], "left_semi") if keys is not None else current
            step = OBJECTIVES[objective](used.drop("_features"), pairs)
            step = step.filter("hessian > 0").select("query_key", "item_id", "hessian", (F.col("gradient") / (F.col("hessian") + l2 * 1e-3)).alias("target"))
            rows = full.select("query_key", "item_id", "_features").join(step, ["query_key", "item_id"])
            if rows.isEmpty():
                return model
            tree = DecisionTreeRegressor(featuresCol="_features", labelCol="target", weightCol="hessian", maxDepth=depth, maxBins=bins, seed=seed).fit(rows)
            model.trees.append(tree)
            moved = tree.setPredictionCol("_p").transform(current)
            scores = written(moved.select("query_key", "item_id", (F.col("score") + rate * F.col("_p")).alias("score")), "scores")
    return model


def fit_bags(frame: DataFrame, features: list[str], n_relevant: DataFrame, seeds: tuple[int, ...] = (41, 42, 43), **params) -> list[Ensemble]:
    """A model for each bag of positives and sampled unlabelled rows."""
    return [fit(frame, features, n_relevant, bag=written(pu_bag(frame, seed).select("query_key", "item_id"), "bag"), seed=seed, **params) for seed in seeds]


def rank_by_models(frame: DataFrame, models: list[Ensemble], top: int = 50) -> DataFrame:
    out = frame
    for k, m in enumerate(models):
        out = m.predict(out, f"m{k}")
    return mean_reciprocal_rank(out, [f"m{k}" for k in range(len(models))], top=top)


def out_of_fold(frame: DataFrame, features: list[str], n_relevant: DataFrame, k: int = 2, seed: int = 42, **params) -> DataFrame:
    """frame with fold and score, each query scored by the model of the other folds."""
    queries = folds(frame.select("query_key").distinct().withColumn("all", F.lit(0)), "all", "query_key", k, seed).drop("all")
    rows = written(frame.join(queries, "query_key"), "folds")
    parts = None
    for f in range(k):
        model = fit(rows.filter(F.col("fold") != f), features, n_relevant, seed=seed, **params)
        part = model.predict(rows.filter(F.col("fold") == f))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def grid(frame: DataFrame, features: list[str], n_relevant: DataFrame, configs: list[dict], evaluate: Callable[[DataFrame], float], seconds: float = float("inf")) -> list[tuple[dict, float]]:
    """Out-of-fold value of each config, as many as the time allows, best first."""
    import time

    end, out = time.monotonic() + seconds, []
    for config in configs:
        if out and time.monotonic() > end:
            break
        out.append((config, evaluate(out_of_fold(frame, features, n_relevant, **config))))
    return sorted(out, key=lambda x: -x[1])
