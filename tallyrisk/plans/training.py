"""Training, comparison, tuning and scoring of classifiers with MLlib."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrisk.operators.clean import align
from tallyrisk.operators.evaluate import (
    add_cost,
    add_metrics,
    assign_folds,
    best_threshold,
    confusion,
    cv_metrics,
    cv_summary,
    fine_thresholds,
    predicted,
    roc_auc,
    threshold_curve,
)
from tallyrisk.operators.neighbours import nearest_neighbours
from tallyrisk.operators.running import ranked
from tallyrisk.operators.score import RULE_MODEL_VERSION, decide, request_features, rule_score
from tallyrisk.plans.leafwise import Leafwise, LeafwiseModel, Settings
from tallyrisk.session import settle, settle_evenly
from tallyrisk.sources.schemas import MODEL_BUNDLE
from tallyrisk.sources.tables import optional

LABEL = "label"
WEIGHT = "weight"
FEATURES = "features"
POSITIVES = "positive_weight"
# Fits that run at a time when models are compared: most of a boosted fit is waiting for short jobs.
PARALLEL_FITS = 5

# Model settings that carry over to MLlib.
FOREST_TREES = 100
BOOST_ROUNDS = 100
BOOST_STEP = 0.03
BOOST_DEPTH = 5
BOOST_SAMPLE = 0.85
HIDDEN_LAYERS = [100, 50]
NET_ITERATIONS = 500
# Rows of one task in a fit of the network, some 0.1 s a pass.
NET_ROWS = 10_000

# Settings of the compared families where they are not those above; positives of the depth-wise trees weigh three times.
COMPARED_LOGISTIC = {"maxIter": 1000}
COMPARED_DEPTHWISE = {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "subsamplingRate": 1.0, "seed": 42}
COMPARED_LEAFWISE = Settings(rounds=100, leaves=31, step=0.1, row_share=1.0, column_share=1.0, l1=0.0, l2=0.0, min_rows=20)
POSITIVE_WEIGHT = 3.0

# Parameter grids, named by their MLlib parameters; C is the inverse of the penalty on a sum of losses.
GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4]},
    "boosted_trees": {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.3]},
    "boosted_trees_sampled": {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "subsamplingRate": [0.8, 0.9, 1.0]},
    "logistic": {"C": [0.001, 0.01, 0.1, 1.0, 10.0], "elasticNetParam": [0.0, 1.0]},
}

# Search ranges as low, high, kind.
SEARCH_SPACE = {
    "maxIter": (50, 300, "int"),
    "maxDepth": (3, 10, "int"),
    "stepSize": (0.005, 0.1, "log"),
    "subsamplingRate": (0.5, 1.0, "float"),
    "minInstancesPerNode": (10, 100, "int"),
}


# --- weights and estimators ---------------------------------------------------------------------


def class_sizes(df: DataFrame, label: str = LABEL) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return row["neg"], row["pos"]


def with_class_weight(df: DataFrame, label: str = LABEL, balanced: bool = False) -> DataFrame:
    """Weight of positives = negatives / positives; or both classes weighted to the same total."""
    neg, pos = class_sizes(df, label)
    if balanced:
        weights = ((neg + pos) / (2.0 * max(pos, 1)), (neg + pos) / (2.0 * max(neg, 1)))
    else:
        weights = (neg / max(pos, 1), 1.0)
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(weights[0])).otherwise(F.lit(weights[1])))


def _assembler(features: Sequence[str], out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def logistic(features: Sequence[str], label: str = LABEL, weight: str | None = WEIGHT, **params) -> Pipeline:
    settings = {"maxIter": 500, **params}
    model = LogisticRegression(featuresCol=FEATURES, labelCol=label, **settings)
    if weight:
        model = model.setWeightCol(weight)
    scaler = StandardScaler(inputCol="raw_features", outputCol=FEATURES, withMean=True)
    return Pipeline(stages=[_assembler(features, "raw_features"), scaler, model])


def random_forest(features: Sequence[str], label: str = LABEL, weight: str | None = WEIGHT, **params) -> Pipeline:
    settings = {"numTrees": FOREST_TREES, "seed": 42, **params}
    model = RandomForestClassifier(featuresCol=FEATURES, labelCol=label, **settings)
    return Pipeline(stages=[_assembler(features), model.setWeightCol(weight) if weight else model])


def boosted_trees(
    features: Sequence[str],
    label: str = LABEL,
    weight: str | None = WEIGHT,
    validation: str | None = None,
    **params,
) -> Pipeline:
    """Boosted trees; with a validation flag column boosting stops when the held-out rows no longer improve."""
    settings = {
        "maxIter": BOOST_ROUNDS,
        "stepSize": BOOST_STEP,
        "maxDepth": BOOST_DEPTH,
        "subsamplingRate": BOOST_SAMPLE,
        "seed": 1001,
        **params,
    }
    model = GBTClassifier(featuresCol=FEATURES, labelCol=label, **settings)
    if weight:
        model = model.setWeightCol(weight)
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[_assembler(features), model])


def neural_net(features: Sequence[str], label: str = LABEL, **params) -> Pipeline:
    settings = {"layers": [len(features), *HIDDEN_LAYERS, 2], "maxIter": NET_ITERATIONS, "seed": 42, **params}
    model = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=label, **settings)
    scaler = StandardScaler(inputCol="raw_features", outputCol=FEATURES, withMean=True)
    return Pipeline(stages=[_assembler(features, "raw_features"), scaler, model])


def with_probability(model: Transformer | LeafwiseModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 as a plain column."""
    if isinstance(model, LeafwiseModel):
        return model.transform(df, name)
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in extra if c != name])


# --- evaluation -----------------------------------------------------------------------------------


def evaluate_scores(scored: DataFrame, label: str = LABEL, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: AUC, confusion counts, metrics and cost at the threshold."""
    counts = confusion(scored.withColumn("__guess", predicted(score, threshold)), label, "__guess")
    auc = roc_auc(scored, label, score).scalar()
    return add_metrics(add_cost(counts)).withColumn("auc", auc)


def families(features: Sequence[str], label: str = LABEL) -> dict[str, Estimator | Leafwise]:
    """The five families that are compared, for rows of ``with_family_weights``; the network knows no weights."""
    return {
        "logistic": logistic(features, label, **COMPARED_LOGISTIC),
        "random_forest": random_forest(features, label),
        "boosted_trees": boosted_trees(features, label, POSITIVES, **COMPARED_DEPTHWISE),
        "leafwise_trees": Leafwise(list(features), label, WEIGHT, COMPARED_LEAFWISE),
        "neural_net": neural_net(features, label),
    }


def with_family_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Both classes weighted to the same total, and the fixed weight of positives beside it."""
    fixed = F.when(F.col(label) == 1, F.lit(POSITIVE_WEIGHT)).otherwise(F.lit(1.0))
    return with_class_weight(df, label, balanced=True).withColumn(POSITIVES, fixed)


def compare_models(
    estimators: Mapping[str, Estimator | Leafwise], train: DataFrame, test: DataFrame, label: str = LABEL, parallelism: int = PARALLEL_FITS
) -> DataFrame:
    """Fit every estimator and list the test metrics, best AUC first. Fits do not depend on each other; ``parallelism`` of
    them run at a time."""

    def judged(name: str) -> DataFrame:
        scored = settle(with_probability(estimators[name].fit(train), test).select(label, "score"))
        return evaluate_scores(scored, label).withColumn("model", F.lit(name))

    pool = ThreadPool(max(1, min(parallelism, len(estimators))))
    try:
        rows = pool.map(inheritable_thread_target(train.sparkSession)(judged), list(estimators), chunksize=1)
    finally:
        pool.close()
        pool.join()
    table = reduce(DataFrame.unionByName, rows)
    return table.select("model", "auc", "recall", "precision", "f1", "cost").orderBy(F.desc("auc"), "model")


@dataclass(frozen=True)
class CrossValidation:
    out_of_fold: DataFrame
    test_scores: DataFrame | None
    importances: DataFrame | None
    per_fold: DataFrame
    summary: DataFrame
    overall: DataFrame


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame | None:
    """(feature, importance) of a tree model, or None for other models."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    values = last.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature STRING, importance DOUBLE")


def cross_validate(
    estimator: Estimator,
    train: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    label: str = LABEL,
    k: int = 5,
    stratified: bool = True,
    test: DataFrame | None = None,
    seed: int = 1001,
) -> CrossValidation:
    """Out-of-fold scores of every labelled row, the mean score of the fold models per test row,
    importances per fold, and metrics per fold and overall."""
    folded = settle_evenly(assign_folds(train, keys, k, seed, label if stratified else None))
    held, extra, weights = [], [], []
    for i in range(k):
        model = estimator.fit(folded.where(F.col("fold") != i))
        held.append(with_probability(model, folded.where(F.col("fold") == i)).select(*keys, label, "fold", "score"))
        if test is not None:
            extra.append(with_probability(model, test).select(*keys, "score"))
        table = importances(model, features, train.sparkSession)
        if table is not None:
            weights.append(table.withColumn("fold", F.lit(i)))
    out_of_fold = settle(reduce(DataFrame.unionByName, held))
    per_fold = settle(cv_metrics(out_of_fold, label, "score"))
    best = best_threshold(threshold_curve(out_of_fold, label, "score", fine_thresholds()))
    overall = best.withColumn("auc", roc_auc(out_of_fold, label, "score").scalar())
    submission = None
    if extra:
        submission = reduce(DataFrame.unionByName, extra).groupBy(*keys).agg(F.avg("score").alias("TARGET"))
    table = reduce(DataFrame.unionByName, weights) if weights else None
    return CrossValidation(out_of_fold, submission, table, per_fold, cv_summary(per_fold), overall)


# --- search ---------------------------------------------------------------------------------------


def grid_search(estimator: Pipeline, grid: Mapping[str, Sequence], train: DataFrame, fold: str = "fold", k: int = 5, label: str = LABEL, parallelism: int = 4) -> tuple[PipelineModel, DataFrame]:
    """Exhaustive search by exact AUC over given folds; the best model and (parameters, auc) rows."""
    last = estimator.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(last.getParam(name), list(values))
    maps = builder.build()
    judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0)
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=judge, numFolds=k, foldCol=fold, parallelism=parallelism
    ).fit(train)
    rows = [
        (i, {p.name: str(v) for p, v in m.items()}, float(auc)) for i, (m, auc) in enumerate(zip(maps, search.avgMetrics))
    ]
    table = train.sparkSession.createDataFrame(rows, "trial INT, parameters MAP<STRING, STRING>, auc DOUBLE")
    return search.bestModel, table.orderBy(F.desc("auc"), "trial")


def logistic_grid(n_rows: int) -> dict[str, list[float]]:
    """The logistic grid for a fit on ``n_rows`` rows. MLlib takes the mean of the losses, so C becomes 1 / (n C)."""
    grid = dict(GRIDS["logistic"])
    return {"regParam": [1.0 / (max(n_rows, 1) * c) for c in grid.pop("C")], **grid}


def draw(space: Mapping[str, tuple], rng: random.Random) -> dict[str, float | int]:
    """One random point: uniform, uniform in the logarithm, or uniform whole numbers."""
    point: dict[str, float | int] = {}
    for name, (low, high, kind) in space.items():
        if kind == "int":
            point[name] = rng.randint(low, high)
        elif kind == "log":
            point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            point[name] = rng.uniform(low, high)
    return point


def cost_search(
    make: Callable[..., Pipeline],
    space: Mapping[str, tuple],
    train: DataFrame,
    features: Sequence[str],
    n_trials: int,
    folds: int,
    label: str = LABEL,
    seed: int = 1001,
    points: int = 50,
) -> DataFrame:
    """Seeded random search; a trial's value is the mean over folds of the cost at the best
    threshold. ``make(features, **params)`` builds the estimator, ``train`` has a ``fold`` column."""
    rng = random.Random(seed)
    rows = []
    for trial in range(n_trials):
        params = draw(space, rng)
        held = []
        for i in range(folds):
            model = make(features, **params).fit(train.where(F.col("fold") != i))
            held.append(with_probability(model, train.where(F.col("fold") == i)).select("fold", label, "score"))
        curve = threshold_curve(reduce(DataFrame.unionByName, held), label, "score", fine_thresholds(points), ["fold"])
        cost = best_threshold(curve, ["fold"]).agg(F.avg("cost").alias("c")).first()["c"]
        rows.append((trial, {k: float(v) for k, v in params.items()}, float(cost)))
    table = train.sparkSession.createDataFrame(rows, "trial INT, parameters MAP<STRING, DOUBLE>, mean_cost DOUBLE")
    return table.orderBy("mean_cost", "trial")


# --- oversampling -----------------------------------------------------------------------------------


def _unit(*parts: Column) -> Column:
    """Number in [0, 1] from a hash: the same for a recomputed task."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_002.0)


def _neighbours(rare: DataFrame, features: Sequence[str], key: str, k: int) -> DataFrame:
    """id, x and near: each row with its k nearest others (gap, other, ox), by the distance of standardised features; a
    missing feature counts as the mean."""
    row = rare.agg(*[a for i, c in enumerate(features) for a in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    unit = [F.coalesce((F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(features)]
    points = settle(rare.select(F.col(key).alias("id"), F.array(*unit).alias("z"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")))
    pairs = nearest_neighbours(points, k)
    mates = pairs.join(points.select(F.col("id").alias("other"), F.col("x").alias("ox")), "other")
    near = mates.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("gap", "other", "ox"))).alias("near"))  # k entries
    return points.select("id", "x").join(near, "id")


def smote(df: DataFrame, features: Sequence[str], key: str, label: str = LABEL, k: int = 5, seed: int = 42) -> DataFrame:
    """Add synthetic rows of the rarer class until both classes have the same size. A synthetic row
    lies at a random spot between a rare row and one of its k nearest rare rows (Chawla et al. 2002)."""
    neg, pos = class_sizes(df, label)
    minority = 1 if pos <= neg else 0
    few, many = min(neg, pos), max(neg, pos)
    base = df.select(F.col(label).cast("int").alias(label), *[F.col(c).cast("double").alias(c) for c in features]).withColumn("synthetic", F.lit(False))
    if few < 2 or few == many:
        return base
    rare = df.where(F.col(label) == minority).select(
        F.col(key).alias("__key"), F.xxhash64(F.col(key), F.lit(seed)).alias("__mix"), *[F.col(c).cast("double").alias(c) for c in features]
    )
    each, rest = divmod(many - few, few)
    # Rows go by their number, so that repeated and missing keys neither multiply nor lose rows.
    numbered = ranked(rare, ["__mix", "__key", *features])
    copies = F.lit(each) + (F.col("id") < rest).cast("int")
    seeds = _neighbours(numbered, features, "position", k).withColumn("copies", copies.cast("int")).where("copies > 0")
    drawn = seeds.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    pick = F.pmod(F.xxhash64("id", "copy", F.lit(seed), F.lit("pick")), F.size("near")).cast("int")
    mate = F.get(F.col("near"), pick)["ox"]
    spot = _unit(F.col("id"), F.col("copy"), F.lit(seed), F.lit("spot"))
    mixed = F.zip_with("x", mate, lambda a, b: a + spot * (b - a))
    made = drawn.select(mixed.alias("v")).select(
        F.lit(minority).alias(label), *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(features)], F.lit(True).alias("synthetic")
    )
    return base.unionByName(made)


# --- saved models -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ModelBundle:
    model: PipelineModel
    feature_names: list[str]
    medians: dict[str, float]
    model_version: str


def save_bundle(spark: SparkSession, bundle: ModelBundle, path: str) -> None:
    bundle.model.write().overwrite().save(f"{path}/model")
    row = [(bundle.feature_names, bundle.medians, bundle.model_version)]
    spark.createDataFrame(row, MODEL_BUNDLE).write.mode("overwrite").parquet(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> ModelBundle | None:
    """The saved model, or None if there is none (then score with the rule model)."""
    about = optional(lambda: spark.read.parquet(f"{path}/about"))
    if about is None:
        return None
    missing = {"feature_names", "medians", "model_version"} - set(about.columns)
    if missing:
        raise ValueError(f"model bundle lacks {sorted(missing)}")
    row = about.first()
    return ModelBundle(PipelineModel.load(f"{path}/model"), list(row["feature_names"]), dict(row["medians"]), row["model_version"])


def score_batch(df: DataFrame, bundle: ModelBundle | None, keep: Sequence[str]) -> DataFrame:
    """Score a table of applicants: with the fitted model on aligned features, or with the rule model."""
    if bundle is None:
        scored = request_features(df).withColumn("score", rule_score())
        version = RULE_MODEL_VERSION
    else:
        scored = with_probability(bundle.model, align(df, bundle.feature_names, bundle.medians, keep))
        version = bundle.model_version
    return decide(scored).select(*keep, "score", "decision", "score_missing", F.lit(version).alias("model_version"))
