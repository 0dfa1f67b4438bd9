"""Queries: scans, cleaning, worlds, splits and features over the labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.functions.draws import hash_int, key, normal, uniform
from paravane.functions.scalars import clip, closed_bin, finite, floor_bin, logistic
from paravane.operators import models as m
from paravane.operators import sampling as s
from paravane.operators import worlds as w
from paravane.operators.trees import forest_scores
from paravane.sources import editions as src
from paravane.sources.editions import CATEGORICAL as CAT
from paravane.sources.editions import NUMERIC as NUM

from . import views as v
from .ctes import EDGES15, RUNS, SUBSAMPLE, SUBSAMPLE_KEY, arr, binned, h32, lit, normal as sql_normal, student3, u
from .registry import query

X = "x1 x2 x3"
#: The models that are fitted for all editions and folds at once.
MODELS = ["logistic_l2", "random_forest", "extra_trees", "svc_rbf", "gaussian_nb"]
BASE = "row_id, y, k1, k2"
SCHEMA = "row_id long, y int, x1 double, x2 double, x3 double, k1 string, k2 string"


@query("SELECT * FROM labelled", X)
def a1_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = src.scratch_path(spark, "labelled-csv")
    src.write_table(src.labelled(spark, sf), path, "csv")
    return src.read_csv(spark, path, SCHEMA)


@query("SELECT avg(y) AS prevalence FROM labelled", "prevalence")
def a2_prevalence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y")).agg(F.avg("y").alias("prevalence"))


@query("SELECT l_returnflag = 'R' AS y, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY ALL", "quantity")
def a3_partitioned_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("y"), F.col("l_quantity").cast("double").alias("q"))
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query("SELECT edition, count(*) AS n, avg(y) AS prevalence FROM editions GROUP BY ALL", "prevalence")
def a8_partitioned_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = src.scratch_path(spark, "editions")
    src.write_table(src.editions(spark, sf), path, by=["edition"])
    return spark.read.parquet(path).groupBy("edition").agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"))


_PROFILE = " UNION ALL ".join(
    f"SELECT count(*) AS n_rows, avg(y) AS prevalence, '{c}' AS \"column\", '{role}' AS role, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM labelled"
    for c, role in [("row_id", "numeric"), *[(x, "numeric") for x in NUM], *[(k, "categorical") for k in CAT]]
)


@query(_PROFILE, "prevalence")
def a9_profile(spark: SparkSession, sf: str) -> DataFrame:
    return src.profile(src.labelled(spark, sf), "y")


@query("SELECT o_orderkey AS row_id, o_totalprice::DOUBLE AS x1, (o_orderstatus = 'F')::INT AS y FROM orders WHERE o_orderstatus <> 'P'", "x1")
def b1_b2_b3_clean(spark: SparkSession, sf: str) -> DataFrame:
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").cast("double").alias("x1"), "o_custkey", "o_clerk" if "o_clerk" in src.table(spark, sf, "orders").columns else "o_orderpriority", "o_orderstatus")
    o = o.withColumn("target", F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0))
    return src.without(src.with_target(src.ingest(o), "target"), ["o_custkey", "o_clerk", "o_orderpriority", "o_orderstatus", "target", "hadm_id"])


@query("SELECT 'y' AS \"column\", count(DISTINCT y) AS n_distinct, 0 AS \"order\" FROM labelled")
def b5_target_detection(spark: SparkSession, sf: str) -> DataFrame:
    return src.binary_columns(src.labelled(spark, sf), ["label_mortality", "y"]).orderBy("order").limit(1)


@query("SELECT o_orderkey AS row_id, (o_orderstatus = 'O')::INT AS y FROM orders WHERE o_orderstatus IN ('F', 'O')")
def b7_binary_coercion(spark: SparkSession, sf: str) -> DataFrame:
    o = src.table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return src.coerce_binary(o, "o_orderstatus").select("row_id", "y")


@query("SELECT row_id, x1 / x2 AS ratio FROM labelled WHERE x2 <> 0", "ratio")
def b13_finite_filter(spark: SparkSession, sf: str) -> DataFrame:
    r = src.labelled(spark, sf).select("row_id", F.try_divide("x1", "x2").alias("ratio"))
    return r.where(finite(F.col("ratio")))


@query("SELECT edition, model, world, count(*) AS n, avg(p) AS p FROM predictions WHERE model IN ('nb_123', 'nb_12') AND world NOT IN ('clean', 'label_noise') GROUP BY ALL", "p")
def b14_membership_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = v.predictions(spark, sf).where(F.col("model").isin("nb_123", "nb_12") & ~F.col("world").isin("clean", "label_noise"))
    return kept.groupBy("edition", "model", "world").agg(F.count("*").alias("n"), F.avg("p").alias("p"))


_NOISE = {c: f"{c} + {sql_normal(f"'noise|{c}|' || row_id || '|42'")} * 0.2e0 * sd_{c}" for c in NUM}
_STATS = "stats AS (SELECT " + ", ".join(f"avg({c}) AS avg_{c}, stddev_pop({c}) AS sd_{c}, min({c}) AS min_{c}" for c in NUM) + ", quantile_cont(x1, 0.75) AS q75, count(*) AS n FROM labelled)"


def _world(**cols: str) -> str:
    xs = ", ".join(f"{cols.get(c, c)} AS {c}" for c in NUM)
    return f"WITH {_STATS} SELECT row_id, {cols.get('y', 'y')} AS y, {xs}, k1, k2 FROM labelled, stats"


@query(f"SELECT row_id, {h32("'k|' || row_id")} % 2147483647 AS h, {u("'k|' || row_id")} AS u, {sql_normal("'k|' || row_id")} AS z FROM labelled", "u z")
def c0_keyed_draws(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("row_id")
    return src.labelled(spark, sf).select("row_id", hash_int(key("k", i)).alias("h"), uniform("k", i).alias("u"), normal("k", i).alias("z"))


@query("SELECT *, 'W0_clean' AS world FROM labelled", X)
def c1_clean_world(spark: SparkSession, sf: str) -> DataFrame:
    return w.clean(src.labelled(spark, sf), [], NUM).withColumn("world", F.lit("W0_clean"))


@query(_world(**_NOISE), X)
def c2_gaussian_noise(spark: SparkSession, sf: str) -> DataFrame:
    return w.gaussian_noise(src.labelled(spark, sf), [], NUM)


_RANKS = ", ".join(f"row_number() OVER (ORDER BY {h32(f"'outlier-row|{c}|' || row_id || '|42'")}, row_id) AS r_{c}" for c in NUM)


@query(
    f"WITH {_STATS}, ranked AS (SELECT *, {_RANKS} FROM labelled) SELECT {BASE}, "
    + ", ".join(f"CASE WHEN r_{c} <= greatest(1, floor(n * 0.02e0)) THEN {c} + 3 * sd_{c} * {student3(f"'outlier|{c}|' || row_id || '|42'")} ELSE {c} END AS {c}" for c in NUM)
    + " FROM ranked, stats", X,
)
def c3_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return w.outliers(src.labelled(spark, sf), [], NUM)


_BLANK = ", ".join(f"CASE WHEN {u(f"'mcar|{c}|' || row_id || '|42'")} >= 0.1e0 THEN {c} END AS {c}" for c in NUM)


@query(
    f"WITH blank AS (SELECT {BASE}, {_BLANK} FROM labelled), q AS (SELECT quantile_cont(x1, 0.75) AS q FROM blank) SELECT {BASE}, "
    + ", ".join(f"CASE WHEN NOT (coalesce(blank.x1 >= q, false) AND {u(f"'mar|{c}|' || row_id || '|42'")} < 0.15e0) THEN blank.{c} END AS {c}" for c in NUM)
    + " FROM blank, q", X,
)
def c4_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return w.missingness(src.labelled(spark, sf), [], NUM)


@query(_world(**{c: f"{c} + 0.3e0 * sd_{c}" for c in NUM}), X)
def c5_additive_shift(spark: SparkSession, sf: str) -> DataFrame:
    return w.additive_shift(src.labelled(spark, sf), [], NUM)


@query(_world(**{c: f"0.5e0 * {c} + 0.5e0 * ({c} + 0.1e0 * avg_{c} + 0.2e0 * sd_{c} * {sql_normal(f"'surrogate|{c}|' || row_id || '|42'")})" for c in w.picked(NUM, 2, 42, "surrogate")}), X)
def c6_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return w.surrogates(src.labelled(spark, sf), [], NUM, k=2)


@query(_world(**{c: f"CASE WHEN sd_{c} > 0 THEN 0.4e0 * {c} + 0.6e0 * (CASE WHEN min_{c} >= 0 THEN ln(1 + greatest({c}, 0)) ELSE {c} * {c} / (1 + abs({c})) END) ELSE {c} END" for c in NUM}), X)
def c7_nonlinear(spark: SparkSession, sf: str) -> DataFrame:
    return w.nonlinear(src.labelled(spark, sf), [], NUM)


_MODE = "mode AS (SELECT k1 AS m FROM labelled GROUP BY k1 ORDER BY count(*) DESC, k1 LIMIT 1)"


@query(f"WITH {_MODE} SELECT row_id, k1 = m AS masked FROM labelled, mode")
def c8_subgroup_mask(spark: SparkSession, sf: str) -> DataFrame:
    return w.subgroup_mask(src.labelled(spark, sf), [], NUM, CAT).select("row_id", "masked")


@query(f"WITH {_STATS}, {_MODE} SELECT {BASE}, " + ", ".join(f"CASE WHEN k1 = m THEN {c} + 0.35e0 * sd_{c} ELSE {c} END AS {c}" for c in NUM) + " FROM labelled, stats, mode", X)
def c9_subgroup_shift(spark: SparkSession, sf: str) -> DataFrame:
    return w.subgroup_shift(src.labelled(spark, sf), [], NUM, cat=CAT)


def _resample(target: float) -> str:
    return f"""WITH sizes AS (SELECT count(*) AS n, sum(y) AS pos, round({lit(target)} * count(*))::BIGINT AS want1 FROM labelled),
cls AS (SELECT 1 AS y, pos::BIGINT AS have, want1 AS want FROM sizes UNION ALL SELECT 0, (n - pos)::BIGINT, n - want1 FROM sizes),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY y ORDER BY {h32("'prevalence|' || row_id || '|42'")}, row_id) AS rk FROM labelled l),
slots AS (SELECT y, have, unnest(generate_series(1, want)) AS slot FROM cls WHERE have < want)
SELECT r.row_id, r.y, x1, x2, x3, k1, k2, rk AS slot FROM ranked r JOIN cls USING (y) WHERE have >= want AND rk <= want
UNION ALL SELECT r.row_id, r.y, x1, x2, x3, k1, k2, s.slot FROM slots s JOIN ranked r ON r.y = s.y
  AND r.rk = floor({u("'prevalence-slot|' || s.y || '|' || s.slot || '|42'")} * have)::BIGINT + 1"""


@query(_resample(0.6), X)
def c10_prevalence_resample(spark: SparkSession, sf: str) -> DataFrame:
    return w.prevalence_resample(src.labelled(spark, sf), [], NUM, target=0.6)


@query(_world(**{c: f"CASE WHEN y = 1 THEN {c} + 0.35e0 * sd_{c} ELSE {c} END" for c in w.picked(NUM, 2, 42, "drift")}), X)
def c11_concept_drift(spark: SparkSession, sf: str) -> DataFrame:
    return w.concept_drift(src.labelled(spark, sf), [], NUM, k=2)


@query(_world(y=f"CASE WHEN {u("'flip|' || row_id || '|42'")} < 0.1e0 THEN 1 - y ELSE y END"), X)
def c12_label_noise(spark: SparkSession, sf: str) -> DataFrame:
    return w.label_noise(src.labelled(spark, sf), [], NUM)


@query("SELECT v.*, (SELECT count(*) FROM labelled) AS n FROM (VALUES " + ", ".join(f"('{n}', '{k}', {s}::INT)" for n, k, _, s in w.CATALOGUE) + ") v(name, kind, severity)")
def c13_world_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue with the rows that each world has; a world that replaces rows keeps their number."""
    used = w.all_worlds(src.labelled(spark, sf), [], NUM, CAT).groupBy(F.col("world").alias("name"), "severity").agg(F.count("*").alias("n"))
    return w.catalogue(spark).join(used, ["name", "severity"]).select("name", "kind", "severity", "n")


@query()
def c14_all_worlds(spark: SparkSession, sf: str) -> DataFrame:
    out = w.all_worlds(src.labelled(spark, sf), [], NUM, CAT)
    return out.groupBy("world", "severity").agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"), *[F.avg(c).alias(c) for c in NUM])


_D1 = f"""SELECT l.row_id, l.y, r.rep::INT AS repeat, ((r.rep - 1) * 5 + (row_number() OVER (PARTITION BY edition, r.rep, y ORDER BY {h32("'fold|' || r.rep || '|' || row_id || '|42'")}, row_id) - 1) % 5 + 1)::INT AS fold, edition
FROM editions l, generate_series(1, 3) r(rep)"""


@query(_D1)
def d1_stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return s.stratified_folds(src.editions(spark, sf).select("edition", "row_id", "y"), ["edition"], 5, 3)


@query(SUBSAMPLE.format(n=252, runs=1, h=SUBSAMPLE_KEY))
def d4_stratified_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return s.stratified_subsample(src.labelled(spark, sf).select("row_id", "y"), [], 252, 1)


@query(SUBSAMPLE.format(n=252, runs=RUNS, h=SUBSAMPLE_KEY))
def d5_repeated_subsamples(spark: SparkSession, sf: str) -> DataFrame:
    return s.stratified_subsample(src.labelled(spark, sf).select("row_id", "y"), [], 252, RUNS)


@query("SELECT edition, k1, CASE WHEN min(n) < 2 OR count(*) < 2 THEN 0 ELSE least(5, min(n)) END::INT AS n_folds FROM (SELECT edition, k1, y, count(*) AS n FROM editions GROUP BY ALL) GROUP BY ALL")
def d6_safe_folds(spark: SparkSession, sf: str) -> DataFrame:
    return s.safe_folds(src.editions(spark, sf), ["edition", "k1"], 5)


@query(f"SELECT row_id, y FROM labelled ORDER BY {h32("'sample|' || row_id || '|42'")}, row_id LIMIT 250")
def d7_fixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    return s.fixed_sample(src.labelled(spark, sf).select("row_id", "y"), 250)


@query(f"WITH blank AS (SELECT {BASE}, {_BLANK} FROM labelled), m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in NUM) + f" FROM blank) SELECT {BASE}, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NUM) + " FROM blank, m", X)
def e1_median_imputation(spark: SparkSession, sf: str) -> DataFrame:
    blank = w.missingness(src.labelled(spark, sf), [], NUM, extra_p=0.0)
    return m.median_imputed(blank, blank, NUM)


@query(_world(**{c: f"({c} - avg_{c}) / sd_{c}" for c in NUM}), X)
def e2_standardisation(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.labelled(spark, sf)
    return m.standardised(rows, rows, NUM)


@query(f"WITH b AS (SELECT row_id, CASE WHEN {u("'gone|' || row_id")} >= 0.2e0 THEN k2 END AS k2 FROM labelled), md AS (SELECT k2 AS v FROM b WHERE k2 IS NOT NULL GROUP BY k2 ORDER BY count(*) DESC, k2 LIMIT 1) SELECT row_id, coalesce(k2, v) AS k2 FROM b, md")
def e3_mode_imputation(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.labelled(spark, sf).select("row_id", F.when(uniform("gone", F.col("row_id")) >= 0.2, F.col("k2")).alias("k2"))
    return m.mode_imputed(rows, rows, ["k2"])


@query("SELECT k1, (k1 <> '1-URGENT')::INT::DOUBLE AS ones, count(*) AS n FROM labelled GROUP BY k1")
def e4_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = src.labelled(spark, sf)
    out = Pipeline(stages=m.one_hot(CAT)).fit(rows.where("k1 <> '1-URGENT'")).transform(rows)
    return out.groupBy("k1").agg(F.max(F.aggregate(vector_to_array("k1_o"), F.lit(0.0), lambda a, b: a + b)).alias("ones"), F.count("*").alias("n"))


_CODES = "codes AS (SELECT 1 AS f, k1 AS v, count(*) AS k FROM labelled GROUP BY k1 UNION ALL SELECT 2, k2, count(*) FROM labelled GROUP BY k2), shares AS (SELECT row_number() OVER (ORDER BY f, codes.k DESC, v) AS r, codes.k / sum(codes.k) OVER (PARTITION BY f) AS s FROM codes)"
_SCALED = " UNION ALL ".join(f"SELECT {i} AS i, round(avg(({c} - avg_{c}) / sd_{c}), 6) + 0e0 AS mean, stddev_pop(({c} - avg_{c}) / sd_{c}) AS sd FROM labelled, stats" for i, c in enumerate(NUM))


@query(f"WITH {_STATS}, {_CODES} {_SCALED} UNION ALL SELECT (r + {len(NUM) - 1})::INT, s, sqrt(s * (1 - s)) FROM shares", "mean sd")
def e5_preprocessor(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of each prepared feature: scaled numbers, then codes of categories, the frequent ones first."""
    from pyspark.ml.functions import vector_to_array

    rows = src.labelled(spark, sf)
    out = m.Prepared(rows, NUM, CAT)(rows).select(F.posexplode(vector_to_array("features")).alias("i", "v"))
    return out.groupBy("i").agg((F.round(F.avg("v"), 6) + 0.0).alias("mean"), F.stddev_pop("v").alias("sd"))


def _fitted(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scored = m.out_of_fold(src.labelled(spark, sf), name, NUM, CAT, 2, trees=10, rounds=5)
        return scored.select("row_id", "y", "p")

    return run


def _forest(random_cuts: bool, trees: int):
    """Both folds of both editions in one plan: every row's score from the forest that didn't see its fold."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = s.stratified_folds(src.editions(spark, sf), ["edition"], 2, 1).drop("repeat")
        return forest_scores(rows, ["edition"], NUM, CAT, [1, 2], trees=trees, depth=6, random_cuts=random_cuts).select("edition", "row_id", "y", "p")

    return run


for _id, _cuts in [("e7_random_forest", False), ("e8_extra_trees", True)]:
    _f = _forest(_cuts, 100)
    _f.__name__ = _id
    query()(_f)


def _linear(name: str):
    """Every row's score by the model that didn't see its fold, for both folds of both editions in one plan."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = s.stratified_folds(src.editions(spark, sf), ["edition"], 2, 1).drop("repeat")
        return m.held_out_scores(rows, ["edition"], name, NUM, CAT, 2).select("edition", "row_id", "y", "p")

    return run


for _id, _name in [("e6_logistic_l2", "logistic_l2"), ("e10_svc_rbf", "svc_rbf")]:
    _f = _linear(_name)
    _f.__name__ = _id
    query()(_f)


for _id, _name in [("e9_gradient_boosting", "gradient_boosting"), ("e11_mlp", "mlp"), ("e12_gaussian_nb", "gaussian_nb")]:
    _f = _fitted(_name)
    _f.__name__ = _id
    query()(_f)


_NB = ", ".join(f"avg({c}) AS a_{c}, var_pop({c}) AS v_{c}" for c in ("x1", "x2"))
_LIKE = "ln({t}.n::DOUBLE) " + " ".join(f"- 0.5e0 * ln({{t}}.v_{c} + 1e-9 * w) - pow({c} - {{t}}.a_{c}, 2) / (2 * ({{t}}.v_{c} + 1e-9 * w))" for c in ("x1", "x2"))


@query(f"WITH st AS (SELECT y, count(*) AS n, {_NB} FROM labelled GROUP BY y), wd AS (SELECT greatest(var_pop(x1), var_pop(x2), 0) AS w FROM labelled) SELECT row_id, labelled.y, 1 / (1 + exp(-(({_LIKE.format(t='s1')}) - ({_LIKE.format(t='s0')})))) AS p FROM labelled, st s0, st s1, wd WHERE s0.y = 0 AND s1.y = 1", "p")
def e12_closed_form_nb(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.labelled(spark, sf).select("row_id", "y", "x1", "x2")
    return m.closed_form_nb(rows, rows, [], ["x1", "x2"]).select("row_id", "y", "p")


def _calibrated(spark: SparkSession, sf: str, name: str, methods: tuple[str, ...]) -> DataFrame:
    """Every row of both editions scored by the calibrated models of the other of two folds, over three inner folds."""
    rows = s.stratified_folds(src.editions(spark, sf), ["edition"], 2, 1).drop("repeat")
    nested = m.nested_scores(rows, name, NUM, CAT, 3, by=["edition"])
    out = [m.calibrated_scores(nested, how, ["edition"]).withColumn("method", F.lit(how)) for how in methods]
    return reduce(DataFrame.unionByName, out).select("edition", "method", "row_id", "y", "p")


@query()
def e13_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "logistic_l2", ("sigmoid", "isotonic"))


@query()
def e10_e13_calibrated_svc(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "svc_rbf", ("sigmoid",))


@query()
def e14_positive_probability(spark: SparkSession, sf: str) -> DataFrame:
    """The logistic of the kernel machine's margin, by class, of both editions; each model scores the rows that it was fitted on."""
    rows = src.editions(spark, sf)
    asked = rows.withColumn("fold", F.lit(1)).unionByName(rows.withColumn("fold", F.lit(None).cast("int")))
    scored = m.linear_scores(asked, ["edition"], NUM, [], [0], **m.LINEAR["svc_rbf"]).where("fold IS NULL")
    return scored.groupBy("edition", "y").agg(F.count("*").alias("n"), F.avg("p").alias("p"))


@query()
def e16_d2_evaluate_models(spark: SparkSession, sf: str) -> DataFrame:
    """Both editions by five models, the kernel machine with calibrated probabilities."""
    return m.evaluate_all(src.editions(spark, sf), ["edition"], MODELS, NUM, CAT, trees=10, depth=4)


@query()
def d3_inner_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores inside the training rows of each outer fold of both editions."""
    rows = s.stratified_folds(src.editions(spark, sf), ["edition"], 2, 1).drop("repeat")
    return m.inner_scores(rows, ["edition"], "logistic_l2", NUM, CAT, 2).select("edition", "outer", "row_id", "y", "p")


@query()
def d5_subsample_models(spark: SparkSession, sf: str) -> DataFrame:
    from paravane.operators.metrics import metric_bundle

    sample = s.stratified_folds(s.stratified_subsample(src.labelled(spark, sf), [], 252, RUNS), ["run_id"], 5, 1)
    return metric_bundle(m.subsample_logistic(sample, ["run_id"], ["x1", "x2"]), ["run_id"])


@query(f"SELECT edition, model, fold, row_id, least(greatest(p / 0.7e0 - 0.2e0, 0e0), 1e0) AS held, exp(-p) AS e, ln(1 + p) AS l, sqrt(p) AS s, 1 / (1 + exp(-p)) AS g, {binned('p', arr(EDGES15))} AS bin, least({binned('p', arr(EDGES15))}, 14) AS closed FROM scored", "held e l s g")
def p1_p2_p3_scalars(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    rows = v.predictions(spark, sf).where("world = 'clean'")
    return rows.select("edition", "model", "fold", "row_id", clip(p / 0.7 - 0.2).alias("held"), F.exp(-p).alias("e"), F.log1p(p).alias("l"), F.sqrt(p).alias("s"), logistic(p).alias("g"), floor_bin(p, 15).alias("bin"), closed_bin(p, 15).alias("closed"))


@query("SELECT row_id, coalesce(x2 / nullif(x3, 0), 0) AS r FROM labelled", "r")
def p4_safe_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return src.labelled(spark, sf).select("row_id", F.coalesce(F.try_divide("x2", "x3"), F.lit(0.0)).alias("r"))
