"""Clusters of patients by their metrics (ML1 to ML4).

The reference keeps its feature list and number of clusters in unseen files, so
both are parameters here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.columns import complete_cases
from cohortflow.operators.joins import attach

FEATURES = ("mean", "sd", "cv", "TIR", "TBR", "TAR", "lbgi", "hbgi", "MAG", "MAGE")


def fit_clusters(
    metrics: DataFrame,
    features: Sequence[str] = FEATURES,
    k: int = 3,
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 1e-6,
) -> PipelineModel:
    """Scale the features and fit k-means on the complete patients.

    ``fit_report`` tells whether the centres came to rest within ``max_iter``.
    """
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        KMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=seed, maxIter=max_iter, tol=tol),
    ]
    return Pipeline(stages=stages).fit(complete_cases(metrics, features))


def fit_report(model: PipelineModel) -> dict[str, object]:
    """Rounds, convergence and within-cluster sum of squares of a model just fitted."""
    means = model.stages[-1]
    if not means.hasSummary:
        raise ValueError("a loaded model has no report of its fit")
    summary = means.summary
    return {
        "rounds": summary.numIter,
        "converged": summary.numIter < means.getMaxIter(),
        "cost": summary.trainingCost,
    }


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def features_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def score(model: PipelineModel, metrics: DataFrame) -> DataFrame:
    """Complete patients with their scaled features and cluster."""
    return model.transform(complete_cases(metrics, features_of(model))).drop("raw")


def assign_clusters(
    model: PipelineModel, metrics: DataFrame, patients: DataFrame, key: str = "patient_id"
) -> DataFrame:
    """Label per patient; NULL for one whose metrics are incomplete."""
    return attach(patients, score(model, metrics).select(key, "cluster"), key)


def project2d(model: PipelineModel, metrics: DataFrame, key: str = "patient_id") -> DataFrame:
    """First two principal components of the scaled features.

    A component's sign is set so that its largest loading is positive.
    """
    scored = score(model, metrics)
    pca = PCA(k=2, inputCol="scaled", outputCol="pc").fit(scored)
    loadings = pca.pc.toArray()
    signs = [1.0 if max(c, key=abs) > 0 else -1.0 for c in loadings.T]
    pc = vector_to_array("pc")
    return pca.transform(scored).select(
        key, "cluster", (pc[0] * signs[0]).alias("pc1"), (pc[1] * signs[1]).alias("pc2")
    )


def cluster_profile(model: PipelineModel, metrics: DataFrame) -> DataFrame:
    """Patients and mean scaled feature per cluster."""
    values = vector_to_array("scaled")
    names = features_of(model)
    plain = score(model, metrics).select("cluster", *[values[i].alias(f) for i, f in enumerate(names)])
    return profile_of(plain, names)


def profile_of(labelled: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """Patients and mean of each feature per label."""
    means = [F.avg(f).alias(f) for f in features]
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *means)


@dataclass(frozen=True)
class Centres:
    """A saved clustering as plain numbers: how features are scaled, and a row of them per centre.

    It assigns by column expressions, without a model's stages.
    """

    features: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    centres: tuple[tuple[float, ...], ...]

    @classmethod
    def of(cls, model: PipelineModel) -> Centres:
        scaler, means = model.stages[1], model.stages[2]
        rows = tuple(tuple(float(v) for v in c) for c in means.clusterCenters())
        return cls(
            tuple(features_of(model)), tuple(map(float, scaler.mean)), tuple(map(float, scaler.std)), rows
        )

    def scaled(self, metrics: DataFrame, keep: Sequence[str] = ("patient_id",)) -> DataFrame:
        """Complete patients with their scaled features; one that doesn't vary is 0, as in the model."""
        full = complete_cases(metrics, self.features)

        def one(f: str, mean: float, sd: float) -> Column:
            return ((F.col(f) - F.lit(mean)) / F.lit(sd) if sd else F.lit(0.0)).alias(f)

        return full.select(*keep, *map(one, self.features, self.means, self.sds))

    def distances(self) -> list[Column]:
        """Squared distance of a scaled row to each centre."""
        return [
            sum(((F.col(f) - F.lit(v)) * (F.col(f) - F.lit(v)) for f, v in zip(self.features, c)), F.lit(0.0))
            for c in self.centres
        ]

    def assign(self, metrics: DataFrame, keep: Sequence[str] = ("patient_id",)) -> DataFrame:
        """Scaled features and ``cluster``, the nearest centre, of centres at one distance the first."""
        far = self.distances()
        least = F.least(*far) if len(far) > 1 else far[0]
        nearest = F.array_position(F.array(*far), least) - 1
        return self.scaled(metrics, keep).withColumn("cluster", nearest.cast("int"))


def at_rest(model: PipelineModel, metrics: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row on a fit: patients, those nearer to another centre, centres away from their patients' mean.

    A fit stops when no centre moves by more than its own tolerance, so both
    numbers are 0 for one that has converged.
    """
    plain = Centres.of(model)
    own = score(model, metrics).select("patient_id", F.col("cluster").alias("own"))
    both = plain.assign(metrics).join(own, "patient_id")
    distance = F.array(*plain.distances())
    nearer = F.col("own") != F.col("cluster")
    # Of two centres at one distance either may be the model's.
    nearer &= F.abs(distance[F.col("own")] - distance[F.col("cluster")]) > 1e-9
    moved = both.agg(F.count(F.lit(1)).alias("n"), F.sum(nearer.cast("bigint")).alias("n_nearer"))
    profile = profile_of(both.drop("cluster"), plain.features, "own")
    centre = F.array(*[F.array(*[F.lit(v) for v in c]) for c in plain.centres])[F.col("own")]
    away = [F.abs(F.col(f) - centre[j]) for j, f in enumerate(plain.features)]
    off = F.greatest(*away) if len(away) > 1 else away[0]
    rest = profile.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum((off > tolerance).cast("bigint")).alias("n_away")
    )
    # Each side is one row.
    return moved.crossJoin(F.broadcast(rest)).select("n", "n_clusters", "n_nearer", "n_away")


def scaled_features(metrics: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Standardised features of the complete patients, in plain columns.

    The means and SDs, one row, are read first.
    """
    full = complete_cases(metrics.select(key, *features), features)
    moments = full.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_samp(f).alias(f"s_{f}") for f in features],
    ).first()

    def scaled(f: str) -> Column:
        centred = F.col(f) - F.lit(moments[f"m_{f}"])
        return F.try_divide(centred, F.lit(moments[f"s_{f}"])).alias(f)

    return full.select(key, *[scaled(f) for f in features])
