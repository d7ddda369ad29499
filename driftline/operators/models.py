"""Classifier pipelines on panels: filled features, time-ordered folds, calibrated scores."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.sources.files import new_folder, written


#: Rounds of the boosted trees, in place of the study's 300 rounds of another library.
BOOSTS = 100
#: Trees of a forest, the fewest drawn rows of a node, and the seed of all trees.
TREES, LEAST_ROWS, SEED = 200, 5, 7
#: Buckets of a feature, as many as Spark's trees cut it into by default.
BINS = 32
#: Trees are fitted row by row on more counted rows than this, or if one stands for fewer rows than this (at 3 a forest gains nothing yet).
MOST_CELLS, LEAST_ALIKE = 200_000, 4
#: Trees of a forest that grow at a time.
PARALLEL = 8


def filled(panel: DataFrame, features: list[str]) -> DataFrame:
    """Missing feature columns and null features are 0."""
    have = set(panel.columns)
    return panel.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0) for f in features})


def balanced(panel: DataFrame, label: str) -> DataFrame:
    """+ weight: rows over twice the rows of the own class; labels are 0 or 1."""
    totals = panel.agg(F.count(label).alias("_all"), F.count_if(F.col(label) == 1).alias("_ones"))  # one row
    own = F.when(F.col(label) == 1, F.col("_ones")).otherwise(F.col("_all") - F.col("_ones"))
    return panel.crossJoin(F.broadcast(totals)).withColumn("weight", F.col("_all") / (2.0 * own)).drop("_all", "_ones")


def _classifier(label: str, kind: str) -> Estimator:
    columns = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    if kind == "logistic":
        return LogisticRegression(**columns, maxIter=50)
    if kind == "forest":
        return RandomForestClassifier(**columns, numTrees=TREES, minInstancesPerNode=LEAST_ROWS, seed=SEED)
    if kind == "boosted":
        return GBTClassifier(**columns, maxIter=BOOSTS, maxDepth=4, seed=SEED)
    raise ValueError(f"unknown classifier {kind}")


def pipeline(features: list[str], label: str, kind: str = "logistic") -> Estimator:
    gather = VectorAssembler(inputCols=features, outputCol="raw_features")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    rows = Pipeline(stages=[gather, scale, _classifier(label, kind)])
    return rows if kind == "logistic" else CountedTrees(features, label, kind, rows)


def bucket_cuts(panel: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Where each feature is cut, from all rows: between any two values if there are at most ``bins``, else at quantiles."""
    shares = [k / bins for k in range(1, bins)]
    kinds = panel.agg(*[F.approx_count_distinct(f) for f in features], *[F.percentile_approx(f, shares, 10_000) for f in features]).first()
    out = []
    for i, f in enumerate(features):
        cuts = kinds[len(features) + i] or []
        if kinds[i] <= 2 * bins:  # few values, so the exact ones are few too
            values = sorted(r[0] for r in panel.select(f).distinct().collect())
            if len(values) <= bins:
                cuts = [m if (m := a / 2 + b / 2) > a else b for a, b in zip(values, values[1:])] or values
        out.append(sorted({c + 0.0 for c in cuts if abs(c) < float("inf")}) or [0.0])
    return out


def _drawn(rows: str, cell: str, trees: int):
    """+ tree_0, tree_1, ...: how often a bag as large as the panel holds rows of this cell, for each tree.  Drawn by the cell, so reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            pairs = zip(table[cell].to_numpy().view(np.uint64).tolist(), table[rows].to_pylist())
            times = np.array([np.random.default_rng([SEED, key]).poisson(n, trees) for key, n in pairs], dtype=np.int64).reshape(-1, trees)
            for t in range(trees):
                table = table.append_column(f"tree_{t}", pa.array(times[:, t]))
            yield from table.to_batches()

    return run


class CountedTrees(Estimator):
    """Trees fitted on counted rows: a tree knows a feature by its bucket only, so rows that share buckets, label and weight are one, with a count.

    Boosted trees are those of all rows.  A forest's tree holds a row as often as a Poisson draw of mean 1 says, so it holds
    ``n`` alike rows as often as a draw of mean ``n``; the law is the same, the draws are not those of Spark's own forest.
    After two passes over the panel the work is bounded by the buckets, whatever the panel's length.

    Edge cases: panels whose buckets hardly ever agree (most are wide or small) are fitted row by row; labels are 0 or 1.
    """

    def __init__(self, features: list[str], label: str, kind: str, by_rows: Pipeline, most_cells: int = MOST_CELLS, least_alike: int = LEAST_ALIKE):
        super().__init__()
        self.features, self.label, self.kind, self.by_rows, self.most_cells, self.least_alike = features, label, kind, by_rows, most_cells, least_alike

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        buckets = [f"{f}_bucket" for f in self.features]
        cuts = bucket_cuts(dataset, self.features)
        into = Bucketizer(splitsArray=[[-float("inf"), *c, float("inf")] for c in cuts], inputCols=self.features, outputCols=buckets)
        ordered = [F.col(b).alias(b, metadata={"ml_attr": {"type": "numeric"}}) for b in buckets]  # trees would take buckets for categories
        cells = written(into.transform(dataset).groupBy(*ordered, self.label, "weight").agg(F.count(F.lit(1)).alias("rows")), "cells")
        size = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("rows").alias("rows")).first()
        if not size.cells or size.cells > self.most_cells or self.least_alike * size.cells > size.rows:
            return self.by_rows.fit(dataset)
        gather = VectorAssembler(inputCols=buckets, outputCol="features")
        grow = _classifier(self.label, self.kind).setMaxBins(BINS)
        if self.kind == "boosted":
            model = grow.fit(gather.transform(cells.withColumn("weight", F.col("weight") * F.col("rows"))))
        else:
            model = self._forest(cells, buckets, gather, grow)
        return PipelineModel(stages=[into, gather, model])

    def _forest(self, cells: DataFrame, buckets: list[str], gather: VectorAssembler, grow: RandomForestClassifier) -> RandomForestClassificationModel:
        trees = grow.getNumTrees()
        names = [f"tree_{t}" for t in range(trees)]
        keyed = cells.withColumn("cell", F.xxhash64(*buckets, self.label, "weight"))
        fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema] + [f"{n} long" for n in names])
        drawn = written(keyed.mapInArrow(_drawn("rows", "cell", trees), fields), "drawn")
        fewest = drawn.agg(*[F.min(F.when(F.col(n) > 0, F.col(n))).alias(n) for n in names]).first()  # null: an empty bag
        two = {"ml_attr": {"type": "nominal", "name": self.label, "vals": ["0", "1"]}}  # a bag may lack a class
        label = F.col(self.label).cast("double").alias(self.label, metadata=two)

        def tree(t: int):
            # A node needs LEAST_ROWS drawn rows: a cell as up to LEAST_ROWS rows says that exactly, and as one row if no cell is drawn less often.
            need = 1 if fewest[t] >= grow.getMinInstancesPerNode() else grow.getMinInstancesPerNode()
            times, parts = F.col(names[t]), F.least(F.col(names[t]), F.lit(need)).cast("int")
            bag = drawn.where(times > 0).select(*buckets, label, (F.col("weight") * times / parts).alias("weight"), F.explode(F.array_repeat(F.lit(0), parts)).alias("part"))
            bag = bag.coalesce(1)  # bounded by MOST_CELLS; trees grow side by side
            one = {grow.numTrees: 1, grow.bootstrap: False, grow.featureSubsetStrategy: "sqrt", grow.seed: grow.getSeed() + t, grow.minInstancesPerNode: need}
            return grow.fit(gather.transform(bag), one).trees[0]

        with ThreadPool(PARALLEL) as pool:
            grown = pool.map(inheritable_thread_target(cells.sparkSession)(tree), [t for t in range(trees) if fewest[t]], chunksize=1)
        kind = "org.apache.spark.ml.classification."
        array = RandomForestClassificationModel._new_java_array([t._java_obj for t in grown], cells.sparkSession._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel)
        whole = RandomForestClassificationModel._new_java_obj(kind + "RandomForestClassificationModel", grow.uid, array, len(buckets), 2)
        model = grow._copyValues(RandomForestClassificationModel(whole))
        model._transfer_params_to_java()
        return model


def folds(panel: DataFrame, time: str, count: int = 5) -> DataFrame:
    """+ fold: 0 (trained on only) to ``count``, by order of the distinct times, so that no time is on both sides."""
    times = panel.select(time).distinct().withColumn("_place", F.percent_rank().over(Window.orderBy(time)))
    placed = times.select(time, F.least(F.floor(F.col("_place") * (count + 1)).cast("int"), F.lit(count)).alias("fold"))
    return panel.join(placed, time)


def out_of_fold(panel: DataFrame, features: list[str], label: str, time: str, kind: str = "logistic", count: int = 5) -> DataFrame:
    """Every row after the first fold scored by a model of all earlier folds: + fold, score.  One-class pasts are passed over."""
    folder = new_folder(panel.sparkSession, "folds")  # read by every fold; a written table survives lost executors
    folds(filled(panel, features), time, count).write.parquet(folder)
    data = panel.sparkSession.read.parquet(folder)
    out = None
    for k in range(1, count + 1):
        past = data.where(F.col("fold") < k)
        if past.select(label).distinct().limit(2).count() < 2:
            continue
        model = pipeline(features, label, kind).fit(balanced(past, label))
        scored = model.transform(data.where(F.col("fold") == k)).withColumn("score", vector_to_array("probability")[1]).drop("raw_features", "features", "rawPrediction", "probability", "prediction", *[f"{f}_bucket" for f in features])
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else data.where("false").withColumn("score", F.lit(None).cast("double"))


def _curve(label: str) -> Pipeline:
    columns = {"probabilityCol": "curve", "rawPredictionCol": "curve_raw", "predictionCol": "curve_class"}
    return Pipeline(stages=[VectorAssembler(inputCols=["logit"], outputCol="logit_vector"), LogisticRegression(featuresCol="logit_vector", labelCol=label, **columns)])


def calibrated(scored: DataFrame, label: str) -> DataFrame:
    """+ calibrated: a logistic curve of the logit of ``score``, fitted on the out-of-fold scores of earlier folds only.

    Rows of the first scored fold, and of folds whose past has one class, keep their score as it is.
    """
    scored = written(scored, "scored")  # read by every fold
    clipped = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = scored.withColumn("logit", F.log(clipped / (1 - clipped)))
    out = None
    for k in sorted(r.fold for r in scored.select("fold").distinct().collect()):  # a handful of folds
        past, own = logit.where(F.col("fold") < k), logit.where(F.col("fold") == k)
        if past.select(label).distinct().limit(2).count() < 2:
            done = own.withColumn("calibrated", F.col("score"))
        else:
            done = _curve(label).fit(past).transform(own).withColumn("calibrated", vector_to_array("curve")[1]).drop("logit_vector", "curve", "curve_raw", "curve_class")
        out = done if out is None else out.unionByName(done)
    return (out if out is not None else logit.withColumn("calibrated", F.lit(None).cast("double"))).drop("logit")


def importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """feature, importance, largest first: a tree model's importances, or the sizes of a linear model's coefficients.

    A row a feature, so the list is as long as the model is wide.
    """
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
