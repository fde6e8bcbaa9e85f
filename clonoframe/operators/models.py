"""Classifiers and grouped cross-validation over sample x feature tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe.operators import metrics, penalised, trees
from clonoframe.operators.features import drop_constant, fill_missing
from clonoframe.operators.sampling import stratified_folds
from clonoframe.session import cut_lineage, packed

ROWS_PER_TASK = 20_000
LINEAR = ("logistic", "lasso", "ridge", "elasticnet", "svm")


def prepare(
    features: DataFrame, columns: Sequence[str], target: str = "group", subject: str | None = None
) -> tuple[DataFrame, list[str], list[str]]:
    """Labelled rows as (sample_id, subject_id, class, label, vector), computed once.

    Constant columns are dropped. Returns the rows, the classes in label order and the
    columns in vector order.
    """
    rows = fill_missing(features.filter(F.col(target).isNotNull()), columns)
    kept = rows.select(
        "sample_id",
        F.col(subject or "sample_id").alias("subject_id"),
        F.col(target).cast("string").alias("class"),
        *columns,
    )
    kept = packed(kept, ROWS_PER_TASK)
    used = drop_constant(kept, columns)
    if not used:
        raise ValueError("no varying features")
    indexer = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc")
    model = indexer.fit(kept)
    ready = VectorAssembler(inputCols=used, outputCol="x").transform(model.transform(kept))
    return (
        ready.select("sample_id", "subject_id", "class", "label", "x"),
        list(model.labels),
        used,
    )


def estimator(
    method: str,
    n_classes: int = 2,
    n_trees: int = 500,
    n_rounds: int = 100,
    max_depth: int = 4,
    eta: float = 0.1,
    reg: float = 0.01,
    alpha: float = 0.5,
    svm_cost: float = 0.1,
    n_rows: int = 100,
    seed: int = 42,
):
    """A classifier by name; linear ones standardise their input first."""
    common = {"featuresCol": "x", "labelCol": "label"}
    if method == "logistic":
        clf = LogisticRegression(**common, maxIter=200, tol=1e-4)
    elif method in ("lasso", "ridge", "elasticnet"):
        mix = {"lasso": 1.0, "ridge": 0.0, "elasticnet": alpha}[method]
        clf = LogisticRegression(**common, regParam=reg, elasticNetParam=mix, maxIter=200, tol=1e-4)
    elif method == "tree":
        clf = DecisionTreeClassifier(**common, seed=seed)
    elif method == "rf":
        clf = RandomForestClassifier(**common, numTrees=n_trees, maxDepth=10, seed=seed)
    elif method == "boosting":
        clf = GBTClassifier(
            **common, maxIter=n_rounds, maxDepth=max_depth, stepSize=eta, subsamplingRate=0.8,
            featureSubsetStrategy="0.8", seed=seed,
        )
    elif method == "svm":
        clf = LinearSVC(**common, regParam=1.0 / (svm_cost * max(1, n_rows)), maxIter=100,
                        tol=1e-4, standardization=False)
    else:
        raise ValueError(f"unknown classifier '{method}'")
    if n_classes > 2 and method in ("logistic", "boosting", "svm"):
        return OneVsRest(classifier=clf, featuresCol="x", labelCol="label")
    return clf


def scored_rows(model, rows: DataFrame, n_classes: int) -> DataFrame:
    """(sample_id, class, label, prediction, score): score of class 1 for two classes."""
    out = model.transform(rows)
    if n_classes == 2 and "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif n_classes == 2 and "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.lit(None).cast("double")
    kept = [c for c in ("fold",) if c in rows.columns]
    return out.select(
        "sample_id", "class", "label", F.col("prediction").cast("double").alias("prediction"),
        score.alias("score"), *kept,
    )


def classify(features: DataFrame, columns: Sequence[str], method: str = "logistic", **options):
    """Fit on all labelled rows: (model, predictions with class names, training accuracy)."""
    rows, classes, used = prepare(features, columns, options.pop("target", "group"))
    model = estimator(method, len(classes), n_rows=rows.count(), **options).fit(rows)
    predicted = scored_rows(model, rows, len(classes))
    names = F.array(*[F.lit(c) for c in classes])
    predicted = predicted.withColumn(
        "predicted_class", F.element_at(names, F.col("prediction").cast("int") + 1)
    )
    accuracy = predicted.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return model, predicted, accuracy, used


def coefficients(model, columns: Sequence[str], classes: Sequence[str] | None = None) -> list[tuple]:
    """(class, feature, coefficient) of a linear model, one-vs-rest included."""
    if hasattr(model, "models"):
        return [
            (classes[i] if classes else str(i), f, float(c))
            for i, part in enumerate(model.models)
            for f, c in zip(columns, part.coefficients)
        ]
    if getattr(model, "numClasses", 2) > 2:
        matrix = model.coefficientMatrix.toArray()
        return [
            (classes[i] if classes else str(i), f, float(c))
            for i in range(len(matrix))
            for f, c in zip(columns, matrix[i])
        ]
    return [(classes[1] if classes else "1", f, float(c)) for f, c in zip(columns, model.coefficients)]


def linear_attribution(
    model, rows: DataFrame, columns: Sequence[str], classes: Sequence[str] | None = None
) -> DataFrame:
    """Coefficient times feature deviation: signed attribution and its size per class."""
    spark = rows.sparkSession
    stats = rows.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    lines = [
        (k, f, c, c * float(stats[f] or 0.0)) for k, f, c in coefficients(model, columns, classes)
    ]
    table = spark.createDataFrame(lines, "class string, feature string, coefficient double, attribution double")
    return table.withColumn("importance", F.abs("attribution"))


def linear_contributions(model, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact per-row contributions of a two-class linear model: coefficient x (value - mean)."""
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    weights = [float(c) for c in model.coefficients]
    parts = [
        ((F.col(c) - float(means[c])) * w).alias(c) for c, w in zip(columns, weights)
    ]
    return rows.select("sample_id", *parts).unpivot(
        ["sample_id"], list(columns), "feature", "contribution"
    )


def importances(model, columns: Sequence[str], spark) -> DataFrame:
    """Impurity importance of tree models, |coefficient| of linear ones."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "models"):
        parts = [
            m.featureImportances.toArray() if hasattr(m, "featureImportances")
            else np.abs(m.coefficients.toArray())
            for m in model.models
        ]
        values = np.mean(parts, axis=0)
    else:
        values = np.zeros(len(columns))
        lines = coefficients(model, columns)
        at = {c: i for i, c in enumerate(columns)}
        for _, feature, value in lines:
            values[at[feature]] += abs(value)
    return spark.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double"
    )


def category_importance(table: DataFrame) -> DataFrame:
    """Importance summed over feature families, by column prefix."""
    head = F.split_part("feature", F.lit("_"), F.lit(1))
    family = (
        F.when(head.isin("phys", "div", "conv"), "sample features")
        .when(head.isin("vgene", "jgene"), "gene usage")
        .when(head == "vj", "V-J pairing")
        .otherwise("other")
    )
    return table.groupBy(family.alias("category")).agg(F.sum("importance").alias("importance"))


def permutation_importance(
    model, features: DataFrame, columns: Sequence[str], label: str = "label", seed: int = 42
) -> DataFrame:
    """Drop in accuracy when one column is shuffled among the rows.

    Rows are sample-sized. The shuffle pairs two hash orders of the same rows.
    """
    base = features.select("sample_id", label, *columns).persist()
    judge = MulticlassClassificationEvaluator(metricName="accuracy", labelCol=label)
    pack = VectorAssembler(inputCols=list(columns), outputCol="x")
    reference = judge.evaluate(model.transform(pack.transform(base)))
    spark, lines = features.sparkSession, []
    order = W.orderBy("sample_id")
    numbered = base.withColumn("_i", F.row_number().over(order)).persist()
    for n, column in enumerate(columns):
        mixed = W.orderBy(F.xxhash64("sample_id", F.lit(seed + n)))
        swapped = base.select(F.row_number().over(mixed).alias("_i"), F.col(column).alias("_new"))
        rows = numbered.join(swapped, "_i").withColumn(column, F.col("_new")).drop("_new", "_i")
        lines.append((column, float(reference - judge.evaluate(model.transform(pack.transform(rows))))))
    return spark.createDataFrame(lines, "feature string, importance double")


# ---- cross-validation ------------------------------------------------------------------


def cross_validate(
    rows: DataFrame,
    classes: Sequence[str],
    columns: Sequence[str],
    method: str = "rf",
    n_folds: int = 5,
    seed: int = 42,
    **options,
) -> dict[str, DataFrame]:
    """Folds by subject, stratified by class: predictions, per-fold metrics, importances."""
    if method == "boosting":
        return boosted(rows, classes, columns, n_folds, seed, **options)
    if method == "rf":
        return forests(rows, classes, columns, n_folds, seed, options.get("n_trees", 500))
    spark = rows.sparkSession
    folded = packed(stratified_folds(rows, n_folds, "subject_id", "label", seed), ROWS_PER_TASK)
    folds = sorted(r["fold"] for r in folded.select("fold").distinct().collect())
    n = folded.count()
    predictions, tables, weights = [], [], []
    for fold in folds:
        train = folded.filter(F.col("fold") != fold)
        test = folded.filter(F.col("fold") == fold)
        model = estimator(method, len(classes), n_rows=n, seed=seed, **options).fit(train)
        predictions.append(scored_rows(model, test, len(classes)))
        tables.append(importances(model, columns, spark).withColumn("fold", F.lit(fold)))
        if method in LINEAR:
            lines = [(int(fold), f, c) for _, f, c in coefficients(model, columns, classes)]
            weights.append(spark.createDataFrame(lines, "fold int, feature string, weight double"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    out = held_out_tables(packed(union(predictions), ROWS_PER_TASK), len(classes))
    out["importance"] = union(tables).groupBy("feature").agg(F.avg("importance").alias("importance"))
    if weights:
        out["weights"] = union(weights)
    return out


def fold_metrics(predicted: DataFrame, n_classes: int) -> DataFrame:
    if n_classes > 2:
        hit = (F.col("label") == F.col("prediction")).cast("double")
        return predicted.groupBy("fold").agg(F.avg(hit).alias("accuracy"))
    cells = metrics.binary_metrics(predicted, ["fold"]).select("fold", "accuracy", "f1", "mcc")
    return (
        cells.join(metrics.roc_summary(predicted, ["fold"]).select("fold", "auc"), "fold")
        .join(metrics.pr_summary(predicted, ["fold"]), "fold")
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation of every metric over the folds."""
    names = [c for c in folds.columns if c != "fold"]
    tall = folds.unpivot(["fold"], names, "metric", "value")
    return tall.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def pooled_metrics(predicted: DataFrame) -> DataFrame:
    """AUC, AUC-PR and the confusion metrics at the best Youden threshold, over all folds."""
    roc = metrics.roc_summary(predicted).withColumn("_k", F.lit(1))
    cut = roc.select("best_threshold").scalar()
    called = predicted.withColumn("called", (F.col("score") >= cut).cast("int"))
    cells = metrics.binary_metrics(called, [], "called").drop("specificity").withColumn("_k", F.lit(1))
    pr = metrics.pr_summary(predicted).withColumn("_k", F.lit(1))
    return roc.join(pr, "_k").join(cells, "_k").drop("_k")


def held_out_tables(predicted: DataFrame, n_classes: int) -> dict[str, DataFrame]:
    """Per-fold, per-class and pooled metrics of held-out predictions."""
    out = {
        "predictions": predicted,
        "folds": fold_metrics(predicted, n_classes),
        "classes": metrics.class_metrics(predicted),
    }
    if n_classes == 2:
        out["pooled"] = pooled_metrics(predicted)
        out["roc"] = metrics.roc_points(predicted)
        out["fold_roc"] = metrics.roc_points(predicted, ["fold"])
    return out


def boosted(
    rows: DataFrame, classes: Sequence[str], columns: Sequence[str], n_folds: int = 5, seed: int = 42, **options
) -> dict:
    """Second-order boosting, the fit on all rows and every fold's fit abreast.

    Held-out tables as ``cross_validate`` gives them, gain shares of the fit on all rows, and the
    loss curve of every fit over the rounds.
    """
    known = ("n_rounds", "max_depth", "eta", "subsample", "colsample", "l2", "min_weight")
    folded = stratified_folds(rows, n_folds, "subject_id", "label", seed)
    folded = folded.withColumn("fold", F.col("fold").cast("int"))
    fit = trees.Boosted(
        folded, len(columns), len(classes), n_folds, seed=seed, **{k: v for k, v in options.items() if k in known}
    )
    out = held_out_tables(packed(fit.predictions(), ROWS_PER_TASK), len(classes))
    return out | {"importance": fit.importance(columns), "curve": fit.curve(), "model": fit}


def forest(
    rows: DataFrame, classes: Sequence[str], columns: Sequence[str], n_trees: int = 500, seed: int = 42, **options
) -> dict:
    """Random forest with out-of-bag predictions, error and permutation importances."""
    fit = trees.Forest(rows, len(columns), len(classes), n_trees, seed=seed, **options)
    votes = packed(fit.out_of_bag(), ROWS_PER_TASK)
    return {
        "model": fit,
        "predictions": votes,
        "error": trees.out_of_bag_error(votes),
        "classes": metrics.class_metrics(votes.filter(F.col("prediction").isNotNull())),
        "importance": fit.importance(columns),
    }


def forests(
    rows: DataFrame, classes: Sequence[str], columns: Sequence[str], n_folds: int = 5, seed: int = 42,
    n_trees: int = 500, max_depth: int = 10,
) -> dict:
    """A forest for each fold, all abreast: held-out tables and gain shares as ``cross_validate`` gives them."""
    folded = stratified_folds(rows, n_folds, "subject_id", "label", seed)
    mtry = math.ceil(math.sqrt(len(columns)))
    fit = trees.Forest(
        folded, len(columns), len(classes), n_trees, mtry, max_depth=max_depth, seed=seed, n_folds=n_folds
    )
    out = held_out_tables(packed(fit.held_out(), ROWS_PER_TASK), len(classes))
    return out | {"importance": fit.gain_shares(columns), "model": fit}


def tuned_regularized(
    rows: DataFrame, classes: Sequence[str], columns: Sequence[str], method: str = "lasso",
    alpha: float = 0.5, n_folds: int = 5, n_lambda: int = 100,
    lambdas: Sequence[float] | None = None, measure: str = "error", seed: int = 42,
) -> dict:
    """A path of penalties fitted on all rows and on every fold's training rows.

    The penalty is the one of least held-out error (``measure='loss'``: deviance). The
    curve over the path, the weights of the fit on all rows, and the metrics of the held-out
    predictions at the chosen penalty are returned.
    """
    mix = {"lasso": 1.0, "ridge": 0.0, "elasticnet": alpha}[method]
    folded = stratified_folds(rows, n_folds, "subject_id", "label", seed)
    data = packed(penalised.as_rows(folded), ROWS_PER_TASK)
    path = penalised.Path(data, len(columns), len(classes), n_folds, mix, n_lambda, lambdas=lambdas)
    step, spark = path.best_step(measure), rows.sparkSession
    weights = path.weights(spark, columns, classes)
    chosen = weights.filter(F.col("step") == step).groupBy("feature").agg(
        F.sum(F.abs("weight")).alias("importance")
    )
    predicted = packed(path.predictions(data, step), ROWS_PER_TASK)
    return {
        "lambda": float(path.lambdas[step]),
        "path": path,
        "curve": path.curve(spark),
        "path_weights": weights,
        "weights": chosen,
        "n_nonzero": chosen.filter(F.col("importance") > 0).count(),
        "held_out": held_out_tables(predicted, len(classes)),
    }


def ensemble_vote(members: Sequence[DataFrame], classes: Sequence[str], voting: str = "hard") -> DataFrame:
    """Combine member predictions: majority, or votes weighted by each member's accuracy.

    Ties go to the earlier class.
    """
    tagged = []
    for i, member in enumerate(members):
        weight = F.lit(1.0)
        if voting == "soft":
            weight = member.agg(
                F.avg((F.col("label") == F.col("prediction")).cast("double"))
            ).scalar()
        tagged.append(
            member.select("sample_id", "label", F.col("prediction"), weight.alias("w"))
        )
    votes = reduce(DataFrame.unionByName, tagged).groupBy("sample_id", "label", "prediction").agg(
        F.sum("w").alias("votes")
    )
    choice = F.max_by("prediction", F.struct(F.round("votes", 9), -F.col("prediction")))
    names = F.array(*[F.lit(c) for c in classes])
    return votes.groupBy("sample_id", "label").agg(choice.alias("prediction")).withColumn(
        "predicted_class", F.element_at(names, F.col("prediction").cast("int") + 1)
    )


def classify_ensemble(
    rows: DataFrame, classes: Sequence[str], columns: Sequence[str],
    methods: Sequence[str] = ("lasso", "rf", "boosting"), voting: str = "hard",
    n_folds: int = 5, seed: int = 42, **options,
) -> tuple[DataFrame, list[str]]:
    """Held-out predictions of several members, combined; failing members are skipped."""
    members, used = [], []
    for method in methods:
        try:
            cv = cross_validate(rows, classes, columns, method, n_folds, seed, **options)
        except ValueError:
            continue
        members.append(cv["predictions"])
        used.append(method)
    if not members:
        raise ValueError("no ensemble member could be fitted")
    return ensemble_vote(members, classes, voting), used


def compare_classifiers(
    rows: DataFrame, classes: Sequence[str], columns: Sequence[str], n_folds: int = 5,
    seed: int = 42, n_trees: int = 300, n_rounds: int = 50,
) -> DataFrame:
    """Held-out accuracy, macro-F1 and features used by five classifiers."""
    lines = []
    for method in ("logistic", "lasso", "ridge", "rf", "boosting"):
        cv = cross_validate(
            rows, classes, columns, method, n_folds, seed, n_trees=n_trees, n_rounds=n_rounds
        )
        line = cv["classes"].agg(
            F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1")
        ).withColumn("method", F.lit(method))
        used = cv["importance"].agg(F.sum((F.col("importance") > 0).cast("long"))).scalar()
        lines.append(line.withColumn("features_used", used))
    return reduce(DataFrame.unionByName, lines).select(
        "method", "accuracy", "macro_f1", "features_used"
    )


def save_model(model, info: dict, spark, path: str) -> None:
    """A fitted model with a JSON sidecar (feature names, vocabulary, metrics)."""
    PipelineModel(stages=[model]).write().overwrite().save(f"{path}/model")
    import json

    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/info")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    import json

    info = json.loads(spark.read.text(f"{path}/info").first()[0])
    return PipelineModel.load(f"{path}/model"), info


def apply_model(model: PipelineModel, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score new samples with a saved model; absent columns count as zero."""
    present = set(features.columns)
    filled = features.select(
        "sample_id",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c)
          for c in columns],
    )
    ready = VectorAssembler(inputCols=list(columns), outputCol="x").transform(filled)
    out = model.transform(ready)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select("sample_id", "prediction", score.alias("score"))
