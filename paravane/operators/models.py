"""Feature preparation, models, calibration and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paravane.functions.draws import uniform
from paravane.functions.scalars import logistic
from paravane.sources.editions import kept

from .calibration import calibrate
from .linear import fastfood, hadamard, linear_scores  # noqa: F401
from .metrics import metric_bundle
from .quantiles import medians
from .sampling import stratified_folds
from .trees import forest_scores
from .worlds import all_worlds


def median_imputed(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls as the exact medians of fit's columns."""
    found = medians(fit, cols).withColumnsRenamed({c: f"__m_{c}" for c in cols})
    return df.crossJoin(F.broadcast(found)).withColumns({c: F.coalesce(c, f"__m_{c}") for c in cols}).select(*df.columns)


def standardised(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population deviation of fit's columns; no spread counts as 1."""
    stats = fit.agg(*[F.avg(c).alias(f"__a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    scale = lambda c: F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"__a_{c}")) / scale(c) for c in cols}).select(*df.columns)


def mode_imputed(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls as the most frequent values of fit's columns, ties by the smallest value."""
    for c in cols:
        top = fit.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(c).alias("v"))).alias("m"))
        df = df.crossJoin(F.broadcast(top.select(F.col("m.v").alias("__m")))).withColumn(c, F.coalesce(F.col(c), F.col("__m"))).drop("__m")
    return df


def one_hot(cat: list[str]) -> list:
    """Stages that encode categories; values not seen in training become all zeros."""
    return [StringIndexer(inputCols=cat, outputCols=[f"{c}_i" for c in cat], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in cat], outputCols=[f"{c}_o" for c in cat], dropLast=True)]


class Prepared:
    """The preprocessor: medians, standardisation, most frequent categories and one-hot codes of a training table."""

    def __init__(self, train: DataFrame, num: list[str], cat: list[str]):
        median = medians(train, num).first()
        self.num, self.cat = num, cat
        self.median = {c: float(median[c] or 0.0) for c in num}
        filled = train.fillna(self.median)
        stats = filled.agg(*[F.avg(c).alias(f"a_{c}") for c in num], *[F.stddev_pop(c).alias(f"s_{c}") for c in num]).first()
        self.scale = {c: (float(stats[f"a_{c}"]), float(stats[f"s_{c}"]) or 1.0) for c in num}
        self.mode = {c: (train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first() or [""])[0] for c in cat}
        self.encoder: PipelineModel = Pipeline(stages=one_hot(cat)).fit(train.fillna(self.mode)) if cat else None

    def __call__(self, df: DataFrame) -> DataFrame:
        out = df.fillna(self.median).fillna(self.mode)
        out = out.withColumns({f"{c}_z": (F.col(c) - self.scale[c][0]) / self.scale[c][1] for c in self.num})
        out = self.encoder.transform(out) if self.encoder else out
        return VectorAssembler(inputCols=[f"{c}_z" for c in self.num] + [f"{c}_o" for c in self.cat], outputCol="features").transform(out)


def balanced(df: DataFrame) -> DataFrame:
    """df with a weight that makes both classes equally heavy."""
    n = df.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    pos = max(1, n.pos or 0)
    return df.withColumn("weight", F.when(F.col("y") == 1, n.n / (2 * pos)).otherwise(n.n / (2 * max(1, n.n - pos))))


def fourier(df: DataFrame, dims: int, gamma: float, seed: int = 42) -> DataFrame:
    """df with `features` as Fastfood features of an RBF kernel, made in Arrow batches."""

    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for rows in batches:
            yield pd.Series(list(fastfood(np.stack(rows.to_numpy()), dims, gamma, seed)) if len(rows) else [])

    to_features = F.pandas_udf(made, "array<double>")
    return df.withColumn("features", array_to_vector(to_features(vector_to_array("features"))))


def hashed_cuts(train: DataFrame, width: int, bins: int = 8, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Each feature as the number of keyed random cut points below it: splits of a forest on them are random cuts.

    The cut points lie between the ends of train's features and are the same for every table that the step is given.
    """
    spark = train.sparkSession
    x = vector_to_array("features")
    ends = train.select(x.alias("x")).agg(*[F.min(F.col("x")[i]).alias(f"lo{i}") for i in range(width)], *[F.max(F.col("x")[i]).alias(f"hi{i}") for i in range(width)]).first()
    draws = [r.u for r in spark.range(width * bins).select(uniform("cut", F.col("id"), seed).alias("u")).collect()]
    out = []
    for i in range(width):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        cuts = sorted(lo + (hi - lo) * u for u in draws[i * bins : (i + 1) * bins])
        out.append(sum([F.when(x[i] > c, 1.0).otherwise(0.0) for c in cuts], F.lit(0.0)))
    return lambda df: df.withColumn("features", array_to_vector(F.array(*out)))


def estimators(
    n_rows: int, width: int, trees: int = 20, rounds: int = 20, depth: int = 6, layers: tuple[int, ...] = (16, 8), steps: int = 50
) -> dict[str, tuple[Callable, Callable | None]]:
    """name → (estimator, None or a function of the training table that gives an extra feature step).

    Sizes are parameters: trees and depth of forests, boosting rounds, hidden layers of the perceptron and its steps.
    """
    common = {"labelCol": "y", "featuresCol": "features"}
    forest = {"numTrees": trees, "maxDepth": depth, "seed": 42, "weightCol": "weight", **common}
    return {
        "logistic_l2": (lambda: LogisticRegression(regParam=1 / max(1, n_rows), elasticNetParam=0.0, standardization=False, maxIter=100, **common), None),
        "logistic_balanced": (lambda: LogisticRegression(regParam=1 / max(1, n_rows), elasticNetParam=0.0, standardization=False, maxIter=100, weightCol="weight", **common), None),
        "random_forest": (lambda: RandomForestClassifier(**forest), None),
        "extra_trees": (lambda: RandomForestClassifier(bootstrap=False, featureSubsetStrategy="sqrt", **forest), lambda train: hashed_cuts(train, width)),
        "gradient_boosting": (lambda: GBTClassifier(maxIter=rounds, stepSize=0.03, maxDepth=3, seed=42, **common), None),
        "svc_rbf": (lambda: LinearSVC(maxIter=50, regParam=1 / max(1, n_rows), weightCol="weight", **common), lambda _: lambda d: fourier(d, 128, 1 / width)),
        "mlp": (lambda: MultilayerPerceptronClassifier(layers=[width, *layers, 2], maxIter=steps, seed=42, **common), None),
        "gaussian_nb": (lambda: NaiveBayes(modelType="gaussian", **common), None),
    }


def positive_probability(scored: DataFrame) -> Column:
    """The model's probability of class 1, or the logistic of its margin where it gives none."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    return logistic(vector_to_array("rawPrediction")[1])


def fitted(train: DataFrame, name: str, num: list[str], cat: list[str], **sizes) -> Callable[[DataFrame], DataFrame]:
    """The named model fitted on train: a function that adds p to a table with the same columns."""
    prep = Prepared(train, num, cat)
    made = balanced(prep(train)).persist()
    first = made.select("features").first()
    make, extra = estimators(made.count(), len(first.features), **sizes)[name]
    step = extra(made) if extra else lambda d: d
    model = make().fit(step(made))
    made.unpersist()

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(step(prep(df)))
        return scored.select(*df.columns, positive_probability(scored).alias("p"))

    return score


def fit_score(train: DataFrame, test: DataFrame, name: str, num: list[str], cat: list[str], **sizes) -> DataFrame:
    """test's rows with p from the named model fitted on train."""
    return fitted(train, name, num, cat, **sizes)(test)


def out_of_fold(df: DataFrame, name: str, num: list[str], cat: list[str], folds: int = 3, seed: int = 42, **sizes) -> DataFrame:
    """Each row with fold and p of the model that didn't see its fold."""
    tagged = kept(stratified_folds(df, [], folds, 1, seed).drop("repeat"), "folds")
    out = None
    for k in range(1, folds + 1):
        part = fit_score(tagged.where(F.col("fold") != k), tagged.where(F.col("fold") == k), name, num, cat, **sizes)
        out = part if out is None else out.unionByName(part)
    return out


#: Models that linear_scores() fits for all groups and folds at once.
LINEAR: dict[str, dict] = {"logistic_l2": {}, "logistic_balanced": {"balanced": True}, "svc_rbf": {"loss": "hinge", "balanced": True, "dims": 128}}


def held_out_scores(rows: DataFrame, by: list[str], name: str, num: list[str], cat: list[str], folds: int, trees: int = 100, depth: int = 6, **sizes) -> DataFrame:
    """by.., fold, row_id, y, p: each row's score by the named model fitted on the other folds (1 to folds) of its group.

    Linear models, the kernel machine, forests and naive Bayes (numeric columns alone) come out of one plan for all groups and
    folds. Boosting and the perceptron are fitted one after another, with `sizes` as estimators() takes them.
    """
    cols, every = [*by, "fold", "row_id", "y", "p"], list(range(1, folds + 1))
    if name in LINEAR:
        return linear_scores(rows, by, num, cat, every, **LINEAR[name]).select(*cols)
    if name in ("random_forest", "extra_trees"):
        return forest_scores(rows, by, num, cat, every, trees, depth, random_cuts=name == "extra_trees").select(*cols)
    if name == "gaussian_nb":
        return held_out_nb(rows, by, {name: num}, folds, test=rows, keep=("fold",)).select(*cols)
    rows, out = kept(rows, "folds"), None
    for group in rows.select(*by).distinct().collect() if by else [()]:
        mine = reduce(lambda df, g: df.where(F.col(g[0]).eqNullSafe(F.lit(g[1]))), zip(by, group), rows)
        for k in every:
            part = fit_score(mine.where(F.col("fold") != k), mine.where(F.col("fold") == k), name, num, cat, trees=trees, depth=depth, **sizes).select(*cols)
            out = part if out is None else out.unionByName(part)
    return out


def training_copies(rows: DataFrame, by: list[str], outer: list[int], inner: int, seed: int = 42) -> DataFrame:
    """The training rows of each outer fold of rows(by.., fold, ..), once for each: outer, and fold, the inner one."""
    copies = rows.withColumnRenamed("fold", "__of").withColumn("outer", F.explode(F.array(*[F.lit(k) for k in outer]))).where("__of <> outer")
    return stratified_folds(copies.drop("__of"), [*by, "outer"], inner, 1, seed).drop("repeat")


def inner_scores(rows: DataFrame, by: list[str], name: str, num: list[str], cat: list[str], outer: int, inner: int = 3, seed: int = 42, **sizes) -> DataFrame:
    """by.., outer, row_id, y, p: out-of-fold scores inside the training rows of every outer fold of rows(by.., fold, ..).

    A row that no inner model scores (the other inner folds of a tiny group are empty, or naive Bayes misses a class there)
    gets the score of the model fitted on all training rows of its outer fold.
    """
    at = [*by, "outer"]
    copies = kept(training_copies(rows, by, list(range(1, outer + 1)), inner, seed), "inner-folds")
    found = held_out_scores(copies, at, name, num, cat, inner, **sizes).select(*at, "row_id", "p")
    found = kept(copies.select(*at, "row_id", "y").join(found, [*at, "row_id"], "left"), "inner-scores")
    if found.where("p IS NULL").isEmpty():
        return found
    twice = copies.withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2))))  # fold 2's model sees each row, as fold 1
    full = held_out_scores(twice, at, name, num, cat, 2, **sizes).where("fold = 2").select(*at, "row_id", F.col("p").alias("p_full"))
    return found.join(full, [*at, "row_id"], "left").withColumn("p", F.coalesce("p", "p_full")).drop("p_full")


def nested_scores(rows: DataFrame, name: str, num: list[str], cat: list[str], inner: int = 3, seed: int = 42, outer: list | None = None, by: list[str] | None = None) -> DataFrame:
    """by.., outer, inner, held, row_id, y, p, written: what calibration needs of every outer fold of rows(by.., fold, ..).

    Each model, one of LINEAR, is fitted on the rows outside an outer and an inner fold, and scores both: held rows are those
    of the inner fold, the others are those of the outer one. All models come out of one plan. outer: the outer folds, all
    where None.
    """
    by = by or []
    rows = kept(rows, "outer-folds")
    outer = sorted(r[0] for r in rows.select("fold").distinct().collect()) if outer is None else outer
    tests = rows.where(F.col("fold").isin(outer)).withColumns({"outer": F.col("fold"), "fold": F.lit(None).cast("int")})
    both = training_copies(rows, by, outer, inner, seed).unionByName(tests)
    found = linear_scores(both, [*by, "outer"], num, cat, list(range(1, inner + 1)), **LINEAR[name])
    return kept(found.select(*by, "outer", F.col("held").alias("inner"), F.col("fold").isNotNull().alias("held"), "row_id", "y", "p"), "nested-scores")


def calibrated_scores(nested: DataFrame, method: str, by: list[str] | None = None) -> DataFrame:
    """by.., outer, row_id, y, p of the rows of outer folds: the mean over inner folds of the scores calibrated on those.

    The calibrators of all outer and inner folds are fitted and applied in one plan.
    """
    at = [*(by or []), "outer"]
    found = calibrate(nested.where("held"), nested.where("not held").drop("held"), [*at, "inner"], method)
    return found.groupBy(*at, "row_id", "y").agg(F.avg("q").alias("p"))


def calibrated(train: DataFrame, test: DataFrame, name: str, num: list[str], cat: list[str], method: str = "sigmoid", folds: int = 3, seed: int = 42) -> DataFrame:
    """test's rows with p averaged over inner folds: fitted on the rest, calibrated on the fold by sigmoid or isotonic."""
    rows = train.withColumn("fold", F.lit(0)).unionByName(test.withColumn("fold", F.lit(1)))
    found = calibrated_scores(nested_scores(rows, name, num, cat, folds, seed, [1]), method)
    return test.join(found.select("row_id", "p"), "row_id")


def evaluate_all(df: DataFrame, by: list[str], names: list[str], num: list[str], cat: list[str], folds: int = 2, inner: int = 2, seed: int = 42, sigmoid: tuple[str, ...] = ("svc_rbf",), **sizes) -> DataFrame:
    """by.., model and out-of-fold metrics of every named model over each group (edition) of df.

    Models named in `sigmoid` are calibrated over inner folds of their training rows.
    """
    rows = kept(stratified_folds(df, by, folds, 1, seed).drop("repeat"), "folds")
    out = []
    for name in names:
        if name in sigmoid:
            found = calibrated_scores(nested_scores(rows, name, num, cat, inner, seed, list(range(1, folds + 1)), by), "sigmoid", by)
        else:
            found = held_out_scores(rows, by, name, num, cat, folds, **sizes)
        out.append(found.select(*by, F.lit(name).alias("model"), "row_id", "y", "p"))
    return metric_bundle(reduce(DataFrame.unionByName, out), [*by, "model"])


def closed_form_nb(train: DataFrame, test: DataFrame, by: list[str], num: list[str], smooth: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes from class means and variances, for all groups in one plan: test's rows with p.

    `smooth` times the greatest variance of a group's columns is added to each variance.
    """
    widest = train.groupBy(*by).agg(F.greatest(*[F.var_pop(c) for c in num], F.lit(0.0)).alias("w"))
    per = train.groupBy(*by, "y").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a_{c}") for c in num], *[F.var_pop(c).alias(f"v_{c}") for c in num])
    per = per.join(widest, by) if by else per.crossJoin(widest)
    cls = lambda k: per.where(F.col("y") == k).select(*by, F.col("n").alias(f"n{k}"), *[F.col(f"a_{c}").alias(f"a{k}_{c}") for c in num], *[(F.col(f"v_{c}") + smooth * F.col("w")).alias(f"v{k}_{c}") for c in num])
    stats = cls(0).join(cls(1), by) if by else cls(0).crossJoin(cls(1))
    rows = test.join(F.broadcast(stats), by) if by else test.crossJoin(F.broadcast(stats))
    like = lambda k: F.ln(F.col(f"n{k}").cast("double")) + sum([-0.5 * F.ln(F.col(f"v{k}_{c}")) - F.pow(F.col(c) - F.col(f"a{k}_{c}"), 2.0) / (2 * F.col(f"v{k}_{c}")) for c in num], F.lit(0.0))
    return rows.withColumn("p", logistic(like(1) - like(0))).select(*test.columns, "p")


def nb_statistics(rows: DataFrame, by: list[str], cols: list[str], folds: int, middle: bool = False) -> DataFrame:
    """by.., fold: what naive Bayes models without each fold need, from one small table of moments by fold and class.

    For each class k the count n_<k>, means a_<col>_<k> and variances v_<col>_<k> of the other folds, their pooled means
    m_<col> and variances w_<col>; with `middle` also medians (approximate beyond 10,000 values, in bounded memory).
    """
    at = [*by, "fold"]
    held = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("held")
    parts = rows.groupBy(*at, "y").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for k, f in (("k", F.count), ("a", F.avg), ("v", F.var_pop)) for c in cols])
    parts = parts.select("*", held).where("fold <> held").drop("fold").withColumnRenamed("held", "fold")

    def pooled(by_class: list[str], mean: str, var: str) -> DataFrame:
        mean_of = lambda c, x: F.try_divide(F.sum(F.col(f"k_{c}") * x), F.sum(f"k_{c}"))
        m = {c: mean_of(c, F.col(f"a_{c}")) for c in cols}
        spread = {c: F.greatest(mean_of(c, F.col(f"v_{c}") + F.col(f"a_{c}") * F.col(f"a_{c}")) - m[c] * m[c], F.lit(0.0)) for c in cols}
        return parts.groupBy(*at, *by_class).agg(F.sum("n").alias("n"), *[m[c].alias(f"{mean}_{c}") for c in cols], *[spread[c].alias(f"{var}_{c}") for c in cols])

    per, wide = pooled(["y"], "a", "v"), pooled([], "m", "w").drop("n")
    if middle:
        others = rows.select(*rows.columns, held).where("fold <> held").drop("fold").withColumnRenamed("held", "fold")
        wide = wide.join(others.groupBy(*at).agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"med_{c}") for c in cols]), at)
    side = lambda k: per.where(F.col("y") == k).select(*at, *[F.col(c).alias(f"{c}_{k}") for c in ("n", *[f"{m}_{c}" for m in "av" for c in cols])])
    return side(0).join(side(1), at).join(wide, at)


def _smoothing(used: list[str], smooth: float) -> Column:
    return smooth * F.greatest(*[F.col(f"w_{c}") for c in used], F.lit(0.0))


def _likelihood(used: list[str], k: int, smooth: float) -> Column:
    """The log of class k's share times its densities, over nb_statistics()."""
    out = F.ln(F.col(f"n_{k}").cast("double"))
    for c in used:
        var = F.col(f"v_{c}_{k}") + _smoothing(used, smooth)
        out = out - 0.5 * F.ln(var) - F.pow(F.col(c) - F.col(f"a_{c}_{k}"), 2.0) / (2 * var)
    return out


def held_out_nb(
    rows: DataFrame, by: list[str], models: dict[str, list[str]], folds: int, smooth: float = 1e-9, test: DataFrame | None = None, keep: tuple[str, ...] = (), fill: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """by.., keep.., model, row_id, y, p of naive Bayes models, each on its columns, for all groups in one plan.

    rows has fold: a row's p comes from the class means and variances of the other folds of its group, which are counted
    once for all models. As in closed_form_nb(), `smooth` times the greatest variance is added to each. Where test is
    given, its rows are scored in place of rows, each with its fold; with fill, a null there counts as the median of the
    other folds. stats may give what nb_statistics() found, written, so that every pass computes the same p.
    """
    cols = sorted({c for used in models.values() for c in used})
    at, fill = [*by, "fold"], fill and test is not None
    stats = nb_statistics(rows, by, cols, folds, fill) if stats is None else stats

    scored = (rows if test is None else test).join(F.broadcast(stats), at)
    if fill:
        scored = scored.withColumns({c: F.coalesce(c, f"med_{c}") for c in cols})
    return _nb_scores(scored, [*by, *keep, "row_id", "y"], models, smooth).select(*by, *keep, "model", "row_id", "y", "p")


class _Columns:
    """Columns of an Arrow batch as arrays of doubles, and which of their rows are null."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.found = batch, {}

    def __call__(self, *names: str) -> tuple[list[np.ndarray], np.ndarray]:
        for c in names:
            if c not in self.found:
                column = self.batch.column(c).cast(pa.float64())
                self.found[c] = column.fill_null(0.0).to_numpy(False), column.is_null().to_numpy(False)
        return [self.found[c][0] for c in names], np.any([self.found[c][1] for c in names], axis=0)


def _nb_scores(joined: DataFrame, out: list[str], models: dict[str, list[str]], smooth: float) -> DataFrame:
    """out.., model, p of rows joined with nb_statistics(), in Arrow batches: as one expression it is too long to be compiled."""
    cols = sorted({c for used in models.values() for c in used})
    more = [_smoothing(used, smooth).alias(f"__s_{i}") for i, used in enumerate(models.values())]
    asked = joined.select(*out, *[F.col(c).alias(f"__x_{c}") for c in cols], *[F.col(f"{m}_{c}_{k}") for m in "av" for c in cols for k in (0, 1)], "n_0", "n_1", *more)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _Columns(batch)
            for i, (name, used) in enumerate(models.items()):
                (n0, n1, s), null = at("n_0", "n_1", f"__s_{i}")
                odds = np.log(n1) - np.log(n0)
                with np.errstate(all="ignore"):
                    for c in used:
                        for k, sign in ((1, 1.0), (0, -1.0)):
                            (x, a, v), gone = at(f"__x_{c}", f"a_{c}_{k}", f"v_{c}_{k}")
                            v = v + s
                            null = null | gone | (v <= 0)
                            odds = odds + sign * (-0.5 * np.log(v) - (x - a) ** 2 / (2 * v))
                    p = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.repeat(name, len(p)), pa.array(p, mask=null)], [*out, "model", "p"])

    return asked.mapInArrow(score, joined.select(*out, F.lit("").alias("model"), F.lit(None).cast("double").alias("p")).schema)


def nb_stability(wide: DataFrame, rows: DataFrame, by: list[str], models: dict[str, list[str]], folds: int, worlds: dict[str, dict[str, Column]], clean: str, smooth: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """What stability_of() needs of the Shapley values of held_out_nb()'s models, each row's worlds beside each other.

    wide(by.., fold, ..) has each of rows once; worlds has each column's expression over it in each world. Gives
    means(by.., model, fold, world, feature, m, m0) and cosines(by.., model, fold, world, cosine). Nothing is joined by row:
    tasks add up their rows.
    """
    cols, at = sorted({c for used in models.values() for c in used}), [*by, "fold"]
    stats = nb_statistics(rows, by, cols, folds)
    moments = [f"{m}_{c}_{k}" for m in "av" for c in cols for k in (0, 1)] + [f"{m}_{c}" for m in "mw" for c in cols]
    more = [_smoothing(used, smooth).alias(f"__s_{i}") for i, used in enumerate(models.values())]
    wide = wide.withColumns({f"__{w}_{c}": e[c] for w, e in worlds.items() for c in cols})
    names = [f"__{w}_{c}" for w in worlds for c in cols]
    joined = wide.select(*at, *names).join(F.broadcast(stats), at).select(*at, *names, *moments, *more)

    seen = list(worlds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            get = _Columns(batch)
            group, keys = pd.MultiIndex.from_frame(batch.select(at).to_pandas()).factorize()

            def put(model: str, world: str, what: str, value: np.ndarray, null: np.ndarray) -> None:
                total, n = (np.bincount(group[~null], w, len(keys)) for w in (value[~null], None))  # noqa: B023
                for key, t, m in zip(keys, total, n):  # noqa: B023
                    sums[(*key, model, world, what)] = sums.get((*key, model, world, what), 0) + np.array([t, m])

            for i, (model, used) in enumerate(models.items()):
                value, null = {}, {}
                for c in used:
                    (s, m, w, a0, a1, v0, v1), gone = get(f"__s_{i}", f"m_{c}", f"w_{c}", f"a_{c}_0", f"a_{c}_1", f"v_{c}_0", f"v_{c}_1")
                    with np.errstate(all="ignore"):
                        d0, d1 = 2 * (v0 + s), 2 * (v1 + s)
                        mean = (w + (m - a0) ** 2) / d0 - (w + (m - a1) ** 2) / d1
                        for world in seen:
                            (x,), none = get(f"__{world}_{c}")
                            value[world, c], null[world, c] = (x - a0) ** 2 / d0 - (x - a1) ** 2 / d1 - mean, gone | none
                for world in seen:
                    if world == clean:
                        continue
                    ab, aa, bb = np.zeros((3, batch.num_rows))
                    for c in used:
                        x, y, nx, ny = value[world, c], value[clean, c], null[world, c], null[clean, c]
                        put(model, world, f"m|{c}", np.abs(x), nx)
                        put(model, world, f"m0|{c}", np.abs(y), ny)
                        ab, aa, bb = ab + np.where(nx | ny, 0.0, x * y), aa + np.where(nx, 0.0, x * x), bb + np.where(ny, 0.0, y * y)
                    with np.errstate(all="ignore"):
                        none = np.all([null[world, c] | null[clean, c] for c in used], axis=0) | (aa * bb == 0)
                        put(model, world, "cosine", ab / np.sqrt(aa * bb), none)
        if sums:
            parts = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=[*at, "model", "world", "what", "total", "n"])
            yield pa.RecordBatch.from_pandas(parts, pa.schema([*[(c, batch.schema.field(c).type) for c in at], *[(c, pa.string()) for c in ("model", "world", "what")], ("total", pa.float64()), ("n", pa.float64())]), preserve_index=False)

    keys = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in at)
    parts = joined.mapInArrow(add, f"{keys}, model string, world string, what string, total double, n double")
    parts = parts.groupBy(*by, "model", "fold", "world", "what").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("v"))
    parts = kept(parts.coalesce(1), "stability-sums")
    key = [*by, "model", "fold", "world"]
    what = F.split("what", r"\|")
    pick = lambda name: F.max(F.when(what[0] == name, F.col("v"))).alias(name)
    means = parts.where("what <> 'cosine'").groupBy(*key, F.get(what, F.lit(1)).alias("feature")).agg(pick("m"), pick("m0"))
    return means, parts.where("what = 'cosine'").select(*key, ((F.col("v") + 1) / 2).alias("cosine"))


def nb_scored(df: DataFrame, stats: DataFrame, by: list[str], used: list[str], smooth: float = 1e-9) -> DataFrame:
    """df(by.., fold, columns) with p of the model on `used` whose statistics nb_statistics() gave; one row a group is broadcast."""
    joined = df.join(F.broadcast(stats), [*by, "fold"])
    return joined.select(*df.columns, logistic(_likelihood(used, 1, smooth) - _likelihood(used, 0, smooth)).alias("p"))


def held_out_nb_attributions(
    rows: DataFrame, by: list[str], models: dict[str, list[str]], folds: int, smooth: float = 1e-9, test: DataFrame | None = None, keep: tuple[str, ...] = (), fill: bool = False
) -> DataFrame:
    """by.., keep.., model, row_id, feature, value: Shapley values of the log-odds of held_out_nb()'s models.

    The log-odds of naive Bayes are a sum over features, so a feature's Shapley value is its term less that term's mean
    over the background, the rows that the model was fitted on. Those means follow from the pooled moments; a row's
    values add up to its log-odds less the background's mean.
    """
    cols = sorted({c for used in models.values() for c in used})
    at, fill = [*by, "fold"], fill and test is not None
    parts = []
    for name, used in models.items():
        more = _smoothing(used, smooth)
        for c in used:
            far = lambda k, x: x / (2 * (F.col(f"v_{c}_{k}") + more))  # noqa: B023, E731
            here = lambda k: far(k, F.pow(F.col(c) - F.col(f"a_{c}_{k}"), 2.0))  # noqa: B023, E731
            mean = lambda k: far(k, F.col(f"w_{c}") + F.pow(F.col(f"m_{c}") - F.col(f"a_{c}_{k}"), 2.0))  # noqa: B023, E731
            parts.append(F.struct(F.lit(name).alias("model"), F.lit(c).alias("feature"), ((here(0) - here(1)) - (mean(0) - mean(1))).alias("value")))
    joined = (rows if test is None else test).join(nb_statistics(rows, by, cols, folds, fill), at)
    if fill:
        joined = joined.withColumns({c: F.coalesce(c, f"med_{c}") for c in cols})
    kept_cols = [*by, *keep]
    return joined.select(*kept_cols, "row_id", F.explode(F.array(*parts)).alias("s")).select(*kept_cols, "s.model", "row_id", "s.feature", "s.value")


def held_out_in_worlds(rows: DataFrame, by: list[str], models: dict[str, list[str]], folds: int, num: list[str], cat: list[str], seed: int = 42) -> DataFrame:
    """by.., world, severity, fold, model, row_id, y, p: models fitted without a fold, applied to that fold in each world.

    rows has fold. Each fold of each group is perturbed by its own statistics; the models see clean rows only. All groups,
    folds, worlds and models come out of one plan.
    """
    tests = all_worlds(rows, [*by, "fold"], num, cat, seed)
    return held_out_nb(rows, by, models, folds, test=tests, keep=("world", "severity", "fold"))


def subsample_logistic(samples: DataFrame, by: list[str], num: list[str], steps: int = 12) -> DataFrame:
    """Logistic regression for each of many small samples: by.., row_id, y, p, fitted in the group's own task.

    samples has fold: a row's p comes from the fit on the other folds of its group, whose means and deviations scale it.
    """

    def fit(pdf):
        import numpy as np

        y, fold, p = pdf["y"].to_numpy(float), pdf["fold"].to_numpy(), np.full(len(pdf), np.nan)
        for k in np.unique(fold):
            train = fold != k
            if not train.any():
                continue
            x = pdf[num].to_numpy(float)
            mean, sd = x[train].mean(0), x[train].std(0)
            x = np.c_[(x - mean) / np.where(sd > 0, sd, 1), np.ones(len(x))]
            xt, yt, w = x[train], y[train], np.zeros(x.shape[1])
            for _ in range(steps):  # reweighted least squares
                q = 1 / (1 + np.exp(-np.clip(xt @ w, -30, 30)))
                h = (xt * (q * (1 - q))[:, None]).T @ xt + np.diag([1.0] * len(num) + [1e-9])
                w += np.linalg.solve(h, xt.T @ (yt - q) - np.r_[w[:-1], 0.0])
            p[~train] = 1 / (1 + np.exp(-np.clip(x[~train] @ w, -30, 30)))
        return pdf[[*by, "row_id", "y"]].assign(p=[None if np.isnan(v) else v for v in p])

    schema = samples.select(*by, "row_id", "y").withColumn("p", F.lit(None).cast("double")).schema
    return samples.groupBy(*by).applyInPandas(fit, schema)


def subsample_importance(samples: DataFrame, by: list[str], num: list[str], repeats: int = 10, steps: int = 12, seed: int = 42) -> DataFrame:
    """by.., feature, importance: permutation importance of a class-balanced logistic model of each of many small samples.

    samples: by.., row_id, y, columns; a sample is fitted, shuffled and measured in its group's own task, so its size must be
    bounded, as a subsample's is. Importance is the mean drop of the AUROC; a sample of one class has nulls.
    """

    def measure(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("row_id")
        y, x = pdf["y"].to_numpy(float), pdf[num].to_numpy(float)
        x = np.where(np.isnan(x), np.nanmedian(x, axis=0) if len(x) else 0.0, x)
        positive, drops = int(y.sum()), [None] * len(num)
        if 0 < positive < len(y):
            sd = x.std(0)
            x = np.c_[(x - x.mean(0)) / np.where(sd > 0, sd, 1), np.ones(len(x))]
            weight, w = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive))), np.zeros(x.shape[1])
            for _ in range(steps):  # reweighted least squares
                q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1.0] * len(num) + [1e-9])
                w += np.linalg.solve(h, x.T @ (weight * (y - q)) - np.r_[w[:-1], 0.0])

            def area(score):
                _, at, n = np.unique(score, return_inverse=True, return_counts=True)
                rank = (np.cumsum(n) - (n - 1) / 2)[at]
                return (rank[y == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(y) - positive))

            base, rng = area(x @ w), np.random.default_rng([seed, *map(int, pdf[by].iloc[0])])
            for j in range(len(num)):
                lost = 0.0
                for _ in range(repeats):
                    lost += base - area(x @ w + (rng.permutation(x[:, j]) - x[:, j]) * w[j])
                drops[j] = lost / repeats
        out = pd.DataFrame({"feature": num, "importance": drops})
        for i, b in enumerate(by):
            out.insert(i, b, pdf[b].iloc[0])
        return out

    schema = ", ".join([*[f"`{b}` {samples.schema[b].dataType.simpleString()}" for b in by], "feature string, importance double"])
    return samples.groupBy(*by).applyInPandas(measure, schema)
