"""Groups of similar projects with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from needscope.config import Config
from needscope.functions.labels import GROUP_LABELS
from needscope.functions.numbers import exact_avg
from needscope.operators.quality import drop_null_features
from needscope.operators.scoring import join_null_safe
from needscope.sources.readers import inline_rows
from needscope.sources.scratch import settle

FEATURES = ("budget_usd", "target_beneficiaries", "ben_per_1000_usd", "funding_coverage_pct")
CATEGORY = "cluster"

# Column order of the benchmark table.
BENCHMARK_COLUMNS = (
    "project_code", "country", "iso3", "cluster", "organization", "year",
    "budget_usd", "target_beneficiaries", "funding_received_usd",
    "ben_per_1000_usd", "funding_coverage_pct", "budget_per_beneficiary_usd",
    "project_funding_gap_usd", "ben_ratio_zscore", "is_efficiency_outlier",
    "outlier_classification", "cluster_avg_ben_ratio", "cluster_std_ben_ratio",
    "benchmark_group", "benchmark_label",
)


def clean_features(df: DataFrame) -> DataFrame:
    return drop_null_features(df, [*FEATURES, CATEGORY])


def category_places(df: DataFrame, category: str = CATEGORY) -> DataFrame:
    """(category, index) as a written table: most frequent first, ties by name.

    The distinct values are sorted into ranges and numbered range by range, so
    any number of them is fine. Null has no place.
    """
    known = df.filter(F.col(category).isNotNull())
    counts = known.groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    ranged = counts.repartitionByRange(F.desc("__n"), F.col(category))
    ranged = settle(ranged.withColumn("__range", F.spark_partition_id()), "categories")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("__n"), category))
    place = (F.col("__start") + inside - 1).cast("double")
    return settle(ranged.join(starts, "__range").select(category, place.alias(f"{category}_index")), "category-index")


def index_category(df: DataFrame, category: str = CATEGORY, places: DataFrame | None = None) -> DataFrame:
    """Adds ``<category>_index``; null and values without a place get the next number.

    Give the ``places`` a model was fitted with to index other rows alike.
    """
    places = category_places(df, category) if places is None else places
    index = f"{category}_index"
    extra = places.agg(F.count(F.lit(1)).cast("double")).scalar()
    joined = df.join(places, category, "left")
    return joined.select(*df.columns, F.coalesce(F.col(index), extra).alias(index))


def assemble_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep").transform(df)


def scale_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``features``: mean 0, sample deviation 1 per column."""
    assembled = assemble_features(df, features)
    return _scaler().fit(assembled).transform(assembled)


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def scaled_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The scaled vector as one ``<name>_scaled`` column per feature."""
    values = vector_to_array("features")
    return df.select(
        *[c for c in df.columns if c not in ("raw_features", "features")],
        *[values[i].alias(f"{name}_scaled") for i, name in enumerate(features)],
    )


def _kmeans(k: int, cfg: Config) -> KMeans:
    return KMeans(
        k=k, seed=cfg.seed, maxIter=cfg.max_iter, tol=cfg.tol,
        featuresCol="features", predictionCol="benchmark_group",
    )


def fit_groups(
    df: DataFrame, features: Sequence[str] = FEATURES, category: str = CATEGORY, cfg: Config = Config()
) -> PipelineModel:
    """Assemble, scale, cluster rows of ``index_category``; best given as a written table."""
    columns = [*features, f"{category}_index"]
    stages = [
        VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="keep"),
        _scaler(),
        _kmeans(cfg.groups, cfg),
    ]
    return Pipeline(stages=stages).fit(df.select(*columns))


def assign_groups(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def in_nearest_group(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``in_nearest_group``: whether no centre is nearer than that of the own group."""
    value = vector_to_array("features")
    apart = [
        sum(((value[i] - F.lit(float(at))) ** 2 for i, at in enumerate(centre)), F.lit(0.0))
        for centre in model.stages[-1].clusterCenters()
    ]
    own = F.get(F.array(*apart), F.col("benchmark_group"))
    nearest = F.coalesce(own <= F.least(*apart) + 1e-9, F.lit(False)) if len(apart) > 1 else own.isNotNull()
    return df.withColumn("in_nearest_group", nearest)


def quality(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Silhouette of assigned groups with a verdict; null for a single group."""
    score = None if df.select("benchmark_group").distinct().limit(2).count() < 2 else _silhouette(df)
    verdict = F.when(F.col("silhouette") > 0.5, "good").when(F.col("silhouette") > 0.3, "acceptable")
    verdict = verdict.when(F.col("silhouette").isNull(), "single group").otherwise("weak")
    return inline_rows(df.sparkSession, [(score,)], "silhouette double").withColumn("verdict", verdict)


def _silhouette(df: DataFrame) -> float:
    evaluator = ClusteringEvaluator(
        featuresCol="features", predictionCol="benchmark_group", metricName="silhouette"
    )
    return evaluator.evaluate(df)


SEEDED = 4_096  # rows, those of least hash, from which the first centres are drawn


def sweep(df: DataFrame, ks: Sequence[int], cfg: Config = Config()) -> DataFrame:
    """Projects, silhouette and group sizes per k over one written scaled table.

    The silhouette is null where fewer than two groups hold rows. Rows without
    a feature are left out.

    All k move together: one scan gives the sums of the centres of every k
    that still moves, two more at the end the sizes and silhouettes of all. So
    the scans grow with the iterations and not with the number of k.
    """
    indexed = settle(index_category(clean_features(df).select(*FEATURES, CATEGORY)), "indexed")
    scaled = scale_features(indexed, [*FEATURES, f"{CATEGORY}_index"]).select(vector_to_array("features").alias("x"))
    points = settle(scaled, "scaled").persist()
    try:
        centres = move_centres(points, first_centres(points, ks, cfg), cfg)
        sums = group_sums(points, centres)
        scores = silhouettes(points, centres, sums)
    finally:
        points.unpersist()
    rows = []
    for k in ks:
        sizes = [int(n) for n in sums[k][:, -1]] + [0] * (k - len(sums[k]))
        rows.append((k, sum(sizes), scores[k], min(sizes), max(sizes)))
    schema = "k int, n_projects bigint, silhouette double, min_size bigint, max_size bigint"
    found = inline_rows(df.sparkSession, rows, schema)
    best = max(rows, key=lambda row: (row[2] is not None, row[2] or 0.0, -row[0]))[0]
    return found.withColumn("is_best", F.col("k") == best)


Centres = dict[int, np.ndarray]  # by k; at most k rows


def first_centres(points: DataFrame, ks: Sequence[int], cfg: Config) -> Centres:
    """Far-apart rows of a bounded sample, each drawn by its squared distance to those before."""
    sample = points.orderBy(F.xxhash64("x"), "x").limit(SEEDED).collect()
    x = np.array([r["x"] for r in sample], float).reshape(len(sample), -1)
    out: Centres = {}
    for k in ks:
        draw = np.random.default_rng(cfg.seed)
        chosen = [x[draw.integers(len(x))]] if len(x) else []
        apart = ((x - chosen[0]) ** 2).sum(1) if chosen else np.empty(0)
        while 0 < len(chosen) < k and apart.max() > 0:
            chosen.append(x[draw.choice(len(x), p=apart / apart.sum())])
            apart = np.minimum(apart, ((x - chosen[-1]) ** 2).sum(1))
        out[k] = np.array(chosen).reshape(len(chosen), x.shape[1])
    return out


def move_centres(points: DataFrame, centres: Centres, cfg: Config) -> Centres:
    """Lloyd's iterations for all k at once, until none moves more than ``cfg.tol``."""
    done, moving = dict(centres), dict(centres)
    for _ in range(cfg.max_iter):
        sums = group_sums(points, moving) if moving else {}
        for k in list(moving):
            held = sums[k][:, -1:]
            new = np.where(held > 0, sums[k][:, :-2] / np.maximum(held, 1), moving[k])
            still = ((new - moving[k]) ** 2).sum(1).max(initial=0.0) <= cfg.tol**2
            done[k] = moving[k] = new
            if still:
                del moving[k]
        if not moving:
            break
    return done


def group_sums(points: DataFrame, centres: Centres) -> Centres:
    """Per k and group: sums of the features, of the squared norms, and the rows. One scan."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((len(c), c.shape[1] + 2)) for k, c in centres.items()}
        for batch in batches:
            x = _matrix(batch)
            wide = np.c_[x, (x**2).sum(1), np.ones(len(x))]
            for k, c in centres.items():
                nearest = _distances(x, c).argmin(1) if len(c) else np.empty(0, int)
                held[k] += (nearest[:, None] == np.arange(len(c))).T.astype(float) @ wide[: len(nearest)]
        for k, total in held.items():
            group, axis = np.indices(total.shape)
            columns = [np.full(total.size, k), group.ravel(), axis.ravel(), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "part", "axis", "value"])

    out = {k: np.zeros((len(c), c.shape[1] + 2)) for k, c in centres.items()}
    for r in points.mapInArrow(add, _VALUES).groupBy("k", "part", "axis").agg(F.sum("value").alias("value")).collect():
        out[r.k][r.part, r.axis] = r.value
    return out


def silhouettes(points: DataFrame, centres: Centres, sums: Centres) -> dict[int, float | None]:
    """Mean silhouette by squared distances per k, in one scan.

    The mean squared distance of a row to a group follows from the group's
    sums, so no pairs are formed. A row alone in its group counts as 0.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(centres, 0.0)
        for batch in batches:
            x = _matrix(batch)
            norm, every = (x**2).sum(1)[:, None], np.arange(len(x))
            for k, c in centres.items():
                rows = sums[k][:, -1]
                if (rows > 0).sum() < 2 or not len(x):
                    continue
                own = _distances(x, c).argmin(1)
                apart = np.maximum(norm * rows + sums[k][:, -2] - 2 * x @ sums[k][:, :-2].T, 0)
                inside = apart[every, own] / np.maximum(rows[own] - 1, 1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    apart = np.where(rows > 0, apart / rows, np.inf)
                apart[every, own] = np.inf
                outside = apart.min(1)
                most = np.maximum(inside, outside)
                value = np.where((rows[own] > 1) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0)
                total[k] += float(value.sum())
        columns = [list(total), [0] * len(total), [0] * len(total), list(total.values())]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["k", "part", "axis", "value"])

    found = {r.k: r.value for r in points.mapInArrow(score, _VALUES).groupBy("k").agg(F.sum("value").alias("value")).collect()}
    several = {k: (sums[k][:, -1] > 0).sum() > 1 for k in centres}
    return {k: float(found[k] / sums[k][:, -1].sum()) if several[k] else None for k in centres}


_VALUES = "k long, part long, axis long, value double"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("benchmark_group").agg(F.count(F.lit(1)).alias("num_projects"))


def group_profiles(df: DataFrame) -> DataFrame:
    """Size, averages and most common sector of each group.

    Rows are combined per group and sector first; the group level then works
    on those few rows. Equal counts go to the first sector by name.
    """
    measures = {"budget": "budget_usd", "people": "target_beneficiaries",
                "efficiency": "ben_per_1000_usd", "coverage": "funding_coverage_pct"}
    sums = [F.sum(F.col(c).cast("decimal(28,9)")).alias(f"{m}_sum") for m, c in measures.items()]
    counts = [F.count(c).alias(f"{m}_n") for m, c in measures.items()]
    parts = df.groupBy("benchmark_group", "cluster").agg(F.count(F.lit(1)).alias("n"), *sums, *counts)

    def mean(measure: str):
        return F.sum(f"{measure}_sum").cast("double") / F.nullif(F.sum(f"{measure}_n"), F.lit(0))

    return parts.groupBy("benchmark_group").agg(
        F.sum("n").alias("num_projects"),
        F.round(mean("budget") / 1_000_000, 2).alias("avg_budget_musd"),
        F.round(mean("people"), 0).alias("avg_beneficiaries"),
        F.round(mean("efficiency"), 1).alias("avg_efficiency"),
        F.round(mean("coverage"), 1).alias("avg_coverage_pct"),
        F.min(F.struct((-F.col("n")).alias("order"), F.col("cluster"))).getField("cluster").alias("dominant_cluster"),
    )


def label_groups(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds ``benchmark_label``: labels go up with the average budget.

    Cluster ids are arbitrary, so the place in the budget order picks the
    label, not the id; places beyond the texts get the plain label. The join
    is left to the planner.
    """
    return _labelled(df, group_labels(df))


def _labelled(df: DataFrame, lookup: DataFrame) -> DataFrame:
    labelled = join_null_safe(df, lookup, ["benchmark_group"], "left")
    plain = F.concat(F.lit("Group "), F.col("benchmark_group").cast("string"))
    return labelled.withColumn("benchmark_label", F.coalesce("benchmark_label", plain))


def group_labels(df: DataFrame) -> DataFrame:
    """(benchmark_group, benchmark_label) by the average budget; no label beyond the texts."""
    known = df.filter(F.col("benchmark_group").isNotNull())
    budgets = known.groupBy("benchmark_group").agg(exact_avg(F.col("budget_usd")).alias("__avg"))
    order = Window.orderBy("__avg", "benchmark_group")
    placed = budgets.select("benchmark_group", (F.row_number().over(order) - 1).alias("__place"))
    names = inline_rows(df.sparkSession, list(enumerate(GROUP_LABELS)), "__place int, benchmark_label string")
    return placed.join(F.broadcast(names), "__place", "left").drop("__place")


@dataclass(frozen=True)
class GroupModel:
    """A fitted model with the category numbers and the labels it goes with."""

    model: PipelineModel
    places: DataFrame
    labels: DataFrame

    def benchmarks(self, projects: DataFrame) -> DataFrame:
        """The benchmark table of any projects, in the groups and labels of the fit.

        Rows without a feature are left out; a sector that the fit has not
        seen counts as one more category.
        """
        indexed = index_category(clean_features(projects), places=self.places)
        return benchmarks(_labelled(assign_groups(self.model, indexed), self.labels))


def fit_group_model(projects: DataFrame, cfg: Config = Config()) -> GroupModel:
    clean = clean_features(projects)
    places = category_places(clean)
    indexed = settle(index_category(clean, places=places), "indexed")
    model = fit_groups(indexed, cfg=cfg)
    return GroupModel(model, places, settle(group_labels(assign_groups(model, indexed)), "group-labels"))


_VERSIONS = "version bigint, at string"


def save_group_model(found: GroupModel, folder: str) -> int:
    """Keep a fit as the next version below ``folder``; its number.

    Everything is written under a name of its own first. The row in
    ``versions`` comes last and makes the version count, so a lost job leaves
    the versions as they were. One writer at a time.
    """
    spark = found.places.sparkSession
    version, at = len(_versions(spark, folder)) + 1, f"{folder}/fit-{uuid4().hex}"
    found.model.write().save(f"{at}/model")
    found.places.write.parquet(f"{at}/places")
    found.labels.write.parquet(f"{at}/labels")
    inline_rows(spark, [(version, at)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return version


def load_group_model(spark: SparkSession, folder: str, version: int | None = None) -> GroupModel:
    """A version of the model, the latest unless named; an unknown one is an error."""
    known = _versions(spark, folder)
    chosen = max(known, default=0) if version is None else version
    if chosen not in known:
        raise LookupError(f"no version {version or ''} of a group model in {folder}")
    at = known[chosen]
    return GroupModel(PipelineModel.load(f"{at}/model"), spark.read.parquet(f"{at}/places"), spark.read.parquet(f"{at}/labels"))


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    return {r.version: r.at for r in spark.read.schema(_VERSIONS).parquet(f"{folder}/versions").collect()}


def benchmarks(labelled: DataFrame) -> DataFrame:
    return labelled.select(*BENCHMARK_COLUMNS)
