"""Splits, fitted features and models on ``pyspark.ml``; everything is fitted on training rows only."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import num
from .clean import yeo_johnson
from .evaluate import checked_scores, compact_score, compact_scores, hurdle, quality_of_counts, score_counts, within_guardrail
from .tally import medians


def temporal_split(df: DataFrame, time: str, bounds: Sequence[str], names: Sequence[str] = ("train", "validation", "test", "final_test")) -> DataFrame:
    """``split`` by half-open periods [b0, b1), [b1, b2), ...; rows outside all are dropped."""
    if list(bounds) != sorted(set(bounds)) or len(bounds) - 1 > len(names):
        raise ValueError("bounds must rise, with a name for each period")
    t = F.col(time)
    label = None
    for name, a, b in zip(names, bounds[:-1], bounds[1:]):
        label = (F if label is None else label).when((t >= F.lit(a).cast("timestamp")) & (t < F.lit(b).cast("timestamp")), name)
    return df.withColumn("split", label).where("split is not null")


class ValueTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Logarithms and Yeo-Johnson transforms of numeric columns, switched by parameters and kept with a pipeline."""

    columns = Param(Params._dummy(), "columns", "columns to transform", TypeConverters.toListString)
    applyLog = Param(Params._dummy(), "applyLog", "add log1p columns", TypeConverters.toBoolean)
    applyYeoJohnson = Param(Params._dummy(), "applyYeoJohnson", "add Yeo-Johnson columns", TypeConverters.toBoolean)
    lambdas = Param(Params._dummy(), "lambdas", "a lambda for each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, applyLog=False, applyYeoJohnson=False, lambdas=None):
        super().__init__()
        self._setDefault(columns=[], applyLog=False, applyYeoJohnson=False, lambdas=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        names, out = self.getOrDefault(self.columns), {}
        if self.getOrDefault(self.applyLog):
            out |= {f"{c}_log": F.log1p(F.greatest(F.col(c), num(0))) for c in names}
        if self.getOrDefault(self.applyYeoJohnson):
            out |= {f"{c}_yj": yeo_johnson(F.col(c), x) for c, x in zip(names, self.getOrDefault(self.lambdas), strict=True)}
        return df.withColumns(out) if out else df


def fit_yeo_johnson(df: DataFrame, column: str, low: float = -2.0, high: float = 4.0, steps: int = 25, rounds: int = 3) -> float:
    """The lambda of the highest profile likelihood over all rows: a grid in one aggregation, refined round its best point."""
    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    for _ in range(rounds):
        grid = [low + (high - low) * k / (steps - 1) for k in range(steps)]
        jac = F.sum(F.signum("x") * F.log1p(F.abs("x")))
        row = own.agg(F.count("*").alias("n"), jac.alias("j"), *[F.var_pop(yeo_johnson(F.col("x"), g)).alias(f"v{k}") for k, g in enumerate(grid)]).first()
        score = [-(row["n"] / 2) * math.log(row[f"v{k}"]) + (g - 1) * row["j"] if row[f"v{k}"] else -math.inf for k, g in enumerate(grid)]
        best, step = grid[score.index(max(score))], (high - low) / (steps - 1)
        low, high = best - step, best + step
    return best


def median_imputer(columns: Sequence[str]) -> Imputer:
    return Imputer(strategy="median", inputCols=list(columns), outputCols=[f"{c}_filled" for c in columns])


def median_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls filled with exact medians; the imputer of a pipeline takes approximate ones."""
    return df.join(F.broadcast(medians(df, columns))).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def categorical_stages(few: Sequence[str], many: Sequence[str], bins: int = 1 << 15) -> list:
    """Indexed and one-hot columns for those with few values, hashed ones for the others; unseen values are kept."""
    index = StringIndexer(inputCols=list(few), outputCols=[f"{c}_index" for c in few], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in few], outputCols=[f"{c}_hot" for c in few], handleInvalid="keep")
    return [*([index, hot] if few else []), *([FeatureHasher(inputCols=list(many), outputCol="hashed", numFeatures=bins)] if many else [])]


def preprocessor(train: DataFrame, few: Sequence[str], many: Sequence[str], numeric: Sequence[str], bins: int = 1 << 12, seen: bool = True) -> Pipeline:
    """Median-filled and scaled numbers with encoded categories as ``features``; a numeric column without a value raises."""
    if seen and numeric:
        full = train.agg(*[F.count(c).alias(c) for c in numeric]).first()
        if empty := [c for c in numeric if not full[c]]:
            raise ValueError(f"no value in {empty}")
    filled = [f"{c}_filled" for c in numeric]
    stages = [median_imputer(numeric), VectorAssembler(inputCols=filled, outputCol="numbers", handleInvalid="error"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=False)] if numeric else []
    parts = (["scaled"] if numeric else []) + [f"{c}_hot" for c in few] + (["hashed"] if many else [])
    return Pipeline(stages=[*stages, *categorical_stages(few, many, bins), VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")])


def variant_assembler(columns: Sequence[str], variant: str) -> VectorAssembler:
    """Numeric features as they are, as logarithms or Yeo-Johnson transformed."""
    if variant not in ("original", "log", "yeo_johnson"):
        raise ValueError(f"unknown variant {variant!r}")
    end = {"original": "", "log": "_log", "yeo_johnson": "_yj"}[variant]
    return VectorAssembler(inputCols=[f"{c}{end}" for c in columns], outputCol="features", handleInvalid="error")


def ridge(train: DataFrame, label: str, alpha: float, weight: str | None = None) -> LinearRegression:
    """Ridge: least weighted squares plus ``alpha`` times the squared coefficients; rows without ``weight`` count once.

    Spark divides the loss by the sum of weights and the label by its weighted deviation, so both enter the penalty given to it.
    """
    w = F.col(weight) if weight else num(1)
    rows = train.where(F.col(label).isNotNull())
    total, squares, mean = rows.agg(F.sum(w), F.sum(w * w), F.sum(w * F.col(label)) / F.sum(w)).first()
    n = total or 1.0
    around = rows.agg(F.sum(w * F.pow(F.col(label) - num(mean or 0.0), 2))).first()[0]
    free = n - (squares or 0.0) / n
    sd = math.sqrt(around / free) if around and free > 0 else 1.0
    extra = {"weightCol": weight} if weight else {}
    return LinearRegression(labelCol=label, featuresCol="features", regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False, solver="l-bfgs", maxIter=200, tol=1e-9, **extra)


def tree_models(label: str, seed: int = 42) -> dict[str, Estimator]:
    return {"elastic_net": LinearRegression(labelCol=label, regParam=0.1, elasticNetParam=0.5), "forest": RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=6, seed=seed), "gbt": GBTRegressor(labelCol=label, maxIter=10, maxDepth=4, lossType="absolute", seed=seed)}


@contextmanager
def held(*frames: DataFrame) -> Iterator[list[DataFrame]]:
    """Frames kept on disk while they are read again and again, and let go after."""
    kept = [f.persist(StorageLevel.DISK_ONLY) for f in frames]
    try:
        yield kept
    finally:
        for f in kept:
            f.unpersist()


def fit_all(estimators: dict[str, Estimator], train: DataFrame | dict[str, DataFrame], pool: int = 4) -> dict[str, Transformer]:
    """Every estimator fitted on ``train`` (or on its own frame of that name), at most ``pool`` of them side by side."""
    frames = {name: train[name] if isinstance(train, dict) else train for name in estimators}
    with ThreadPoolExecutor(pool) as threads:
        jobs = {name: threads.submit(inheritable_thread_target(frames[name].sparkSession)(e.fit), frames[name]) for name, e in estimators.items()}
        return {name: job.result() for name, job in jobs.items()}


def score_all(df: DataFrame, models: dict[str, Transformer], keep: Sequence[str], output: str = "prediction") -> DataFrame:
    """The columns ``keep`` and each model's ``output`` under its name, from one scan of prepared rows."""
    from pyspark.ml.functions import vector_to_array

    out = df
    for k, model in enumerate(models.values()):
        own = model.copy()
        for param in ("prediction", "probability", "rawPrediction"):
            if own.hasParam(f"{param}Col"):
                own.set(own.getParam(f"{param}Col"), f"_{param}_{k}")
        out = own.transform(out)
    said = [(vector_to_array(f"_probability_{k}")[1] if output == "probability" else F.col(f"_{output}_{k}")).alias(name) for k, name in enumerate(models)]
    return out.select(*keep, *said)


def sweep(train: DataFrame, validation: DataFrame, label: str, estimators: dict[str, Estimator], late: float = 15.0, pool: int = 4) -> tuple[str, DataFrame]:
    """Fits each estimator and scores it; the name of the best by combined, then global error, and all scores.

    Estimators that are no pipelines read prepared columns: these are worked
    out once and kept, fits run side by side, and all candidates are scored in
    one scan of the validation rows.
    """
    if any(isinstance(e, Pipeline) for e in estimators.values()):
        fitted = fit_all(estimators, train, pool)
        scores = reduce(DataFrame.unionByName, [compact_score(m.transform(validation), label, "prediction", late).withColumn("candidate", F.lit(name)) for name, m in fitted.items()])
        found = scores.collect()
    else:
        with held(train, validation) as (own, rows):
            scores = compact_scores(score_all(rows, fit_all(estimators, own, pool), [label]), label, list(estimators), late)
            found = scores.collect()  # a row for each candidate
    best = min(found, key=lambda r: (r["combined_mae"] if r["combined_mae"] is not None else r["global_mae"], r["global_mae"], r["candidate"]))["candidate"]
    return best, train.sparkSession.createDataFrame(found, scores.schema)


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights n / (2 * n of the row's class)."""
    n, p = df.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    return df.withColumn(name, F.when(F.col(label) == 1, num(n / (2 * max(p, 1)))).otherwise(num(n / (2 * max(n - p, 1)))))


def delayed_weights(df: DataFrame, y: str, share: float, late: float = 15.0, name: str = "weight") -> DataFrame:
    """Late rows weigh 1 + ((1 - share) / share) * n / n_late, others 1."""
    if not 0 < share <= 1:
        raise ValueError("the share must lie in (0, 1]")
    n, k = df.agg(F.count("*"), F.count_if(F.col(y) > late)).first()
    return df.withColumn(name, F.when(F.col(y) > late, num(1 + (1 - share) / share * n / max(k, 1))).otherwise(num(1)))


def logistic_candidates(label: str, regs: Sequence[float] = (0.01, 0.1), weight: str | None = "weight") -> dict[str, LogisticRegression]:
    extra = {"weightCol": weight} if weight else {}
    return {f"reg_{r}": LogisticRegression(labelCol=label, regParam=r, **extra) for r in regs}


def tree_grid(label: str, trees: Sequence[int] = (20, 50), depths: Sequence[int] = (4, 6), seed: int = 42) -> dict[str, Estimator]:
    """Forests and boosted trees (absolute loss) of every number and depth, for ``sweep``."""
    cells = [(n, d) for n in trees for d in depths]
    forests = {f"forest_{n}_{d}": RandomForestRegressor(labelCol=label, numTrees=n, maxDepth=d, seed=seed) for n, d in cells}
    return forests | {f"gbt_{n}_{d}": GBTRegressor(labelCol=label, maxIter=n, maxDepth=d, lossType="absolute", seed=seed) for n, d in cells}


def logistic_sweep(train: DataFrame, validation: DataFrame, y: str, lates: Sequence[float] = (1.0, 15.0), regs: Sequence[float] = (0.01, 0.1), weights: Sequence[str] = ("none", "root", "balanced"), pool: int = 4) -> DataFrame:
    """Ranking quality on validation of classifiers of "later than ``late``", for every regularisation and weight of the classes (``root``: square roots of the balanced ones).

    All cells read one kept matrix and are scored in one scan; their scores
    are ranked from counts by cell and score, which are kept too, as ranking
    reads them several times.
    """
    cells, frames = {}, {}
    with held(train.select(y, "features"), validation.select(y, "features")) as (own, rows):
        for late in lates:
            labelled = balanced_weights(own.withColumn("_late", (F.col(y) > late).cast("int")), "_late", "_w")
            for kind in weights:
                weighed = labelled.withColumn("_w", {"none": num(1), "root": F.sqrt("_w"), "balanced": F.col("_w")}[kind])
                for name, estimator in logistic_candidates("_late", regs, "_w").items():
                    cell = f"{late}|{name}|{kind}"
                    cells[cell], frames[cell] = estimator, weighed
        scored = score_all(rows, fit_all(cells, frames, pool), [y], "probability")
        each = scored.select(y, F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"`{c}`").alias("score")) for c in cells])).alias("c")).select(y, "c.*")
        part = F.split("cell", r"\|")
        actual = F.col(y) > F.element_at(part, 1).cast("double")
        with held(score_counts(each, actual, "score", ["cell"])) as (counted,):
            found = quality_of_counts(counted, "score", ["cell"]).select(F.element_at(part, 1).cast("double").alias("late"), F.element_at(part, 2).alias("candidate"), F.element_at(part, 3).alias("weights"), "roc_auc", "average_precision")
            return train.sparkSession.createDataFrame(found.collect(), found.schema)  # a row for each cell


def two_stage_sweep(train: DataFrame, validation: DataFrame, y: str, probability: str, alphas: Sequence[float] = (0.1, 1.0, 10.0), low: float = 15.0, cap: float = 60.0) -> DataFrame:
    """Scores of the expected delay for each penalty of the ridge of moderate delays, from one scan."""
    checked_scores(validation, probability)
    with held(train.where((F.col(y) > low) & (F.col(y) <= cap)), validation) as (severity, rows):
        reference = medians(train.where(F.col(y) <= low), [y]).first()[0]
        fitted = fit_all({f"alpha_{a}": ridge(severity, y, a) for a in alphas}, severity)
        scored = score_all(rows, fitted, [y, probability])
        expected = scored.select(y, *[hurdle(F.col(probability), F.col(f"`{n}`"), num(reference)).alias(n) for n in fitted])
        scores = compact_scores(expected, y, list(fitted))
        return train.sparkSession.createDataFrame(scores.collect(), scores.schema)


def weight_sweep(train: DataFrame, validation: DataFrame, y: str, shares: Sequence[float] = (1.0, 0.75, 0.5, 0.25), alpha: float = 1.0, most: float = 0.25) -> DataFrame:
    """Scores of ridges whose late rows weigh more, and whether the global MAE stays within ``most`` of the unweighted one (share 1)."""
    with held(train, validation) as (own, rows):
        frames = {f"share_{s}": delayed_weights(own, y, s, name="_w") for s in shares}
        fitted = fit_all({n: ridge(f, y, alpha, "_w") for n, f in frames.items()}, frames)
        scores = compact_scores(score_all(rows, fitted, [y]), y, list(fitted))
        found = train.sparkSession.createDataFrame(scores.collect(), scores.schema)
    return within_guardrail(found, "share_1.0", most)


def two_stage(train: DataFrame, y: str, alpha: float = 1.0, low: float = 15.0, cap: float = 60.0) -> tuple[PipelineModel, float]:
    """A ridge of moderate delays (low < y <= cap), and the median of those up to ``low``."""
    severity = train.where((F.col(y) > low) & (F.col(y) <= cap))
    return Pipeline(stages=[ridge(severity, y, alpha)]).fit(severity), medians(train.where(F.col(y) <= low), [y]).first()[0]


def expected_delay(df: DataFrame, model: PipelineModel, reference: float, probability: str) -> DataFrame:
    return model.transform(df).withColumn("expected", hurdle(F.col(probability), F.col("prediction"), num(reference)))


def ablation(train: DataFrame, validation: DataFrame, label: str, groups: dict[str, Sequence[str]], alpha: float = 1.0) -> DataFrame:
    """Scores of a ridge without each group of numeric features (an entity's, or one window of it), and with all; ``allowed`` and ``gain`` against all."""
    every = [c for own in groups.values() for c in own]
    out = None
    for name, drop in {"all": (), **groups}.items():
        own = [c for c in every if c not in drop]
        step = Pipeline(stages=[VectorAssembler(inputCols=own, outputCol="features"), ridge(train, label, alpha)])
        one = compact_score(step.fit(train).transform(validation), label, "prediction").withColumn("without", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return within_guardrail(out, "all", name="without")


def learning_curve(train: DataFrame, validation: DataFrame, label: str, key: str, percents: Sequence[int] = (1, 5, 10), alpha: float = 1.0) -> DataFrame:
    """Scores of ridges on nested samples of the training rows."""
    from ..sources.flights import percent_sample

    out = None
    for p in percents:
        part = percent_sample(train, p, key)
        one = compact_score(ridge(part, label, alpha).fit(part).transform(validation), label, "prediction").withColumn("percent", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


def save_contract(model: PipelineModel, path: str, contract: dict[str, str]) -> None:
    """The fitted pipeline and, beside it, a one-row table of what it was made for."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([tuple(contract.values())], ", ".join(f"{k} string" for k in contract)).write.mode("overwrite").parquet(f"{path}/contract")


def load_contract(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/contract")


_LEDGER = "split string, contract string, path string, rows long, at_us long"


def contract_hash(models: dict[str, Transformer], columns: Sequence[str], locked: DataFrame, settings: dict[str, float | str]) -> str:
    """SHA-256 of everything that a frozen scoring depends on: each model's parameters and coefficients, the columns it reads, the settings, and the rows of the locked split."""
    from ..sources.flights import content_of

    def numbers(x) -> object:
        """Values to six digits: sums of a fit run in no fixed order, so the last ones change from run to run."""
        if hasattr(x, "toArray"):
            x = x.toArray().tolist()
        if isinstance(x, (list, tuple)):
            return [numbers(v) for v in x]
        return f"{x:.5e}" if isinstance(x, float) else str(x)

    def told(model: Transformer) -> list:
        if isinstance(model, PipelineModel):
            return [told(m) for m in model.stages]
        own = {p.name: numbers(model.getOrDefault(p)) for p in model.params if model.isSet(p) and p.name not in ("predictionCol", "probabilityCol", "rawPredictionCol")}
        fitted = [numbers(getattr(model, a)) for a in ("coefficients", "coefficientMatrix", "intercept", "interceptVector", "std", "labels", "categorySizes") if hasattr(model, a)]
        trees = [re.sub(r"-?\d+\.\d+(?:E-?\d+)?", lambda m: f"{float(m[0]):.5e}", model.toDebugString.split("\n", 1)[1])] if hasattr(model, "toDebugString") else []
        return [type(model).__name__, own, fitted, trees]

    parts = [[(name, told(m)) for name, m in sorted(models.items())], list(columns), sorted((k, numbers(v)) for k, v in settings.items()), content_of(locked.select(*columns))]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def score_locked(locked: DataFrame, split: str, ledger: str, models: dict[str, Transformer], columns: Sequence[str], settings: dict[str, float | str], score) -> DataFrame:
    """``score(locked)``, worked out once for each split: the rows are stored and named in the ledger with the hash of their contract.

    A second scoring under the same contract gives the stored rows; under
    another one it raises, as a locked split may be looked at once.
    """
    spark = locked.sparkSession
    contract = contract_hash(models, columns, locked, settings)
    try:
        known = spark.read.schema(_LEDGER).parquet(f"{ledger}/_ledger").where(F.col("split") == split).orderBy("at_us").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known:
        if known["contract"] != contract:
            raise ValueError(f"split {split!r} was scored already, under another contract")
        return spark.read.parquet(known["path"])
    path = f"{ledger}/{split}-{uuid.uuid4().hex}"
    score(locked).write.parquet(path)
    out = spark.read.parquet(path)
    spark.createDataFrame([(split, contract, path, out.count(), time.time_ns() // 1000)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{ledger}/_ledger")
    return out
