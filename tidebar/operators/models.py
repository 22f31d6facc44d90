"""Training and scoring with Spark ML, one distributed fit at a time."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidebar.functions.expr import dbl
from tidebar.operators import surrogate
from tidebar.operators.cv import purged_folds
from tidebar.session import cut

SEED = 42
BOUND = 10.0
FIT_BYTES = 64 << 20       # vectors of one task of a fit

# Search grids per model family.  Depths end at 30, the most a tree here can have (the published list goes
# on to "unlimited"); trees stop by rows of a leaf, as there is no minimum for a split; a perceptron has no dropout.
GRIDS = {
    "RANDOM_FOREST": {"numTrees": [100, 250, 500, 1000], "maxDepth": [5, 10, 20, 30],
                      "minInstancesPerNode": [2, 5, 10], "featureSubsetStrategy": ["sqrt", "log2"]},
    "XGBOOST": {"maxIter": [200, 500, 1000], "maxDepth": [3, 5, 7, 9],
                "stepSize": [0.005, 0.01, 0.05, 0.1], "subsamplingRate": [0.6, 0.8, 1.0]},
    "NET": {"units": [32, 64, 128, 256]},
    "DEEP_NET": {"units": [32, 64, 128, 256]},
    "LATENT_FOREST": {"components": [8, 16, 32], "numTrees": [100, 250, 500]},
}
#: Names of recurrent nets, which Spark ML does not have; they are refused rather than replaced in silence.
RECURRENT = {"LSTM": "NET", "BILSTM": "DEEP_NET", "LSTM_RF": "LATENT_FOREST", "ARIMA_LSTM": "residual_model"}


def estimator(kind: str, n_inputs: int, features: str = "scaled", **params):
    common = {"labelCol": "Label", "featuresCol": features}
    if kind == "RANDOM_FOREST":
        return RandomForestClassifier(seed=SEED, **common, **params)
    if kind == "XGBOOST":
        return GBTClassifier(seed=SEED, **common, **params)
    if kind in ("NET", "DEEP_NET"):
        units = params.pop("units", 32)
        hidden = [units] if kind == "NET" else [units, max(2, units // 2), 16]
        return MultilayerPerceptronClassifier(layers=[n_inputs, *hidden, 2], seed=SEED, **common, **params)
    if kind == "LOGISTIC":
        return LogisticRegression(**common, **params)
    if kind in RECURRENT:
        raise ValueError(f"{kind} is a recurrent net, which there is none of here; the nearest is {RECURRENT[kind]}")
    raise ValueError(f"unknown model kind {kind!r}")


def stages_of(kind: str, n_inputs: int, components: int | None = None, **params) -> Pipeline:
    """Scaler fitted on the training rows, then the classifier; LATENT_FOREST is PCA features -> forest."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    if kind == "LATENT_FOREST":
        k = components or 8
        pca = PCA(k=k, inputCol="scaled", outputCol="latent")
        return Pipeline(stages=[scaler, pca, estimator("RANDOM_FOREST", k, "latent", **params)])
    return Pipeline(stages=[scaler, estimator(kind, n_inputs, **params)])


def clip_vector(df: DataFrame, col: str, out: str, bound: float = BOUND) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(
        vector_to_array(col), lambda x: F.greatest(dbl(-bound), F.least(dbl(bound), x)))))


def dealt(df: DataFrame, rows: int, n_inputs: int, *cols: str) -> DataFrame:
    """Hash-partition (at most `rows`) vectors for fits: a task per core, more only where bytes ask for it.

    Each pass of a learner sends a gradient or the histograms of its nodes per partition, so partitions must not follow the
    session's shuffle partitions, which grow with other tables.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * n_inputs * 8 / FIT_BYTES))
    return df.repartition(parts, *cols)


class Fitted:
    """A scaler model and a classifier model with the clip of +-10 between them."""

    def __init__(self, stages):
        self.stages = list(stages)

    def transform(self, df: DataFrame) -> DataFrame:
        d = clip_vector(self.stages[0].transform(df), "scaled", "scaled")
        for s in self.stages[1:]:
            d = s.transform(d)
        return d

    def save(self, path: str) -> None:
        PipelineModel(self.stages).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "Fitted":
        return cls(PipelineModel.load(path).stages)


def scaled(train: DataFrame):
    """(scaler fitted on the training rows, their scaled and clipped vectors, written once): what any number of models on
    the same rows start from."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    return scaler, cut(clip_vector(scaler.transform(train), "scaled", "scaled").select("Label", "scaled"))


def fit(train: DataFrame, kind: str, n_inputs: int, start=None, **params) -> Fitted:
    """Fit the scaler (or go on from `start`, as `scaled` gave it), then the rest on scaled vectors; a learner passes over
    its input many times, so these are written once."""
    scaler, d = start or scaled(train)
    models, rest = [scaler], stages_of(kind, n_inputs, **params).getStages()[1:]
    for stage in rest:
        models.append(stage.fit(d))
        d = models[-1].transform(d) if stage is not rest[-1] else d
    return Fitted(models)


def score(model: Fitted, df: DataFrame, cols: Sequence[str] = ("symbol", "bar_idx")) -> DataFrame:
    """Probability of class 1; 0 from a model that has only seen class 0."""
    d = model.transform(df)
    return d.select(*cols, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), dbl(0.0)).alias("prob"))


def class_report(scored: DataFrame, keys: Sequence[str], label: str = "Label",
                 pred: str = "prediction") -> DataFrame:
    """Accuracy and macro F1 per key from confusion counts."""
    c = lambda y, p: F.count_if((F.col(label) == y) & (F.col(pred) == p))
    d = scored.groupBy(*keys).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"),
                                  c(0, 0).alias("tn"))
    f1 = lambda t, a, b: F.when(2 * t + a + b > 0, 2 * t / (2 * t + a + b)).otherwise(dbl(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    present = lambda t, a, b: F.when(t + a + b > 0, 1).otherwise(0)
    one, zero = f1(tp, fp, fn), f1(tn, fn, fp)
    n_cls = present(tp, fp, fn) + present(tn, fn, fp)
    return d.select(*keys, "tp", "fp", "fn", "tn",
                    ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                    ((one + zero) / n_cls).alias("f1_macro"))


TRIAL = "trial int, params string, fold int, score double, n_train long, n_val long, pruned boolean"


def search(train: DataFrame, kind: str, n_inputs: int, grid: dict | None = None, trials: int = 10,
           metric: str = "f1_macro", idx: str = "train_idx", n: str = "n_train", n_splits: int = 3,
           purge: int = 60, embargo: int = 10, prune: bool = False, fixed: dict | None = None) -> DataFrame:
    """Sequential search with purged, embargoed folds; one row per (trial, fold), params as JSON.

    Every trial is proposed from the scores of those before it (`surrogate.propose`).  The folds of a trial are fitted
    side by side, each a distributed job; with `prune` they run one after another, and a trial whose mean falls under the
    median of earlier trials at the same fold ends there.  `fixed` parameters are not searched.  `train` is fitted many
    times, so its folds are materialised once, and their training rows are scaled once for all trials.
    """
    grid = grid or GRIDS[kind]
    roles = purged_folds(train, n_splits=n_splits, purge=purge, embargo=embargo, idx=idx, n=n)
    roles = cut(roles.select("fold", "role", "Label", "features"))
    sizes = {(r["fold"], r["role"]): r["count"] for r in roles.groupBy("fold", "role").count().collect()}   # folds x 2
    usable = [f for f in range(n_splits) if sizes.get((f, "train")) and sizes.get((f, "val"))]
    history: list[tuple[dict, float]] = []
    by_fold: list[list[float]] = []
    rows: list[tuple] = []
    part = lambda fold, role: roles.filter((F.col("fold") == fold) & (F.col("role") == role))
    starts = {fold: scaled(part(fold, "train")) for fold in usable}

    def run(params, fold):
        model = fit(part(fold, "train"), kind, n_inputs, starts[fold], **params, **(fixed or {}))
        return float(class_report(model.transform(part(fold, "val")), []).first()[metric])

    for trial in range(trials if usable else 0):
        params = surrogate.propose(grid, history, SEED)
        if params is None:
            break
        if prune:
            scores: list[float] = []
            for fold in usable:
                scores.append(run(params, fold))
                if surrogate.hopeless(scores, by_fold):
                    break
        else:
            with ThreadPoolExecutor(len(usable)) as pool:
                scores = list(pool.map(lambda fold: run(params, fold), usable))
        pruned = len(scores) < len(usable)
        history.append((params, sum(scores) / len(scores)))
        by_fold.append(scores)
        rows += [(trial, json.dumps(params, sort_keys=True), fold, score, sizes[fold, "train"], sizes[fold, "val"], pruned)
                 for fold, score in zip(usable, scores)]
    return train.sparkSession.createDataFrame(rows, TRIAL)


def best_params(trials: DataFrame) -> dict:
    """Parameters of the trial with the best mean score that ran to its end; of equal ones the first."""
    means = trials.filter("not pruned").groupBy("trial", "params").agg(F.avg("score").alias("mean"))
    best = means.orderBy(F.desc("mean"), "trial").first()
    return json.loads(best["params"]) if best else {}


def walk_forward(df: DataFrame, kind: str, n_inputs: int, epochs: Sequence[int], step: int = 60,
                 label_horizon: int = 0, workers: int = 4, **params) -> DataFrame:
    """Score test rows epoch by epoch, refitting on everything before each epoch.

    `df`: features, Label, test_idx (negative for training rows).  All series share one fit per
    epoch.  `label_horizon` leaves out the last rows whose labels would look into the epoch.
    """
    def run(epoch):
        train = df.filter(F.col("test_idx") < epoch * step - label_horizon)
        model = fit(train, kind, n_inputs, **params)
        part = df.filter(F.floor(F.col("test_idx") / step) == epoch)
        return score(model, part, ("symbol", "bar_idx", "Label")).withColumn("epoch", F.lit(epoch))
    with ThreadPoolExecutor(workers) as pool:
        frames = list(pool.map(run, epochs))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def importance(model: Fitted, cols: Sequence[str], spark) -> DataFrame:
    """Tree importance summed over the lags of each base column."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]   # one number per input
    flat = spark.createDataFrame([(values,)], "v array<double>").select(F.posexplode("v").alias("pos", "w"))
    names = F.array(*[F.lit(c) for c in cols])
    return (flat.withColumn("column", F.get(names, F.col("pos") % len(cols)))
            .groupBy("column").agg(F.sum("w").alias("importance")))
