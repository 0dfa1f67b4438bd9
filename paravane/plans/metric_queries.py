"""Queries: metrics of scored rows, summaries, composite scores, attribution, statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.operators import attribution as at
from paravane.operators import compare as cmp
from paravane.operators import composite as co
from paravane.operators import metrics as mt
from paravane.operators import models as m
from paravane.operators import stats as st
from paravane.operators.sampling import stratified_subsample
from paravane.sources import editions as src
from paravane.sources.editions import CATEGORICAL as CAT
from paravane.sources.editions import NUMERIC as NUM
from paravane.sources.editions import kept

from . import views as v
from .ctes import EDGES15, KEYS, RUNS, arr, average_rank, binned, linear_ctes, lit, stability_ctes, u
from .registry import query

EM = ["edition", "model"]
K5 = v.KEYS


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return v.predictions(spark, sf).where("world = 'clean'").drop("world", "severity")


@query(f"SELECT {KEYS}, auroc FROM areas", "auroc")
def f1_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return mt.auroc(v.predictions(spark, sf).withColumn("p", mt.clip(F.col("p"), 1e-7, 1 - 1e-7)), K5)


@query(f"SELECT {KEYS}, auprc FROM areas", "auprc")
def f2_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return mt.average_precision(v.predictions(spark, sf).withColumn("p", mt.clip(F.col("p"), 1e-7, 1 - 1e-7)), K5)


@query(f"SELECT {KEYS}, avg((p - y) * (p - y)) AS brier FROM predictions GROUP BY ALL", "brier")
def f3_brier(spark: SparkSession, sf: str) -> DataFrame:
    return v.predictions(spark, sf).groupBy(*K5).agg(mt.brier().alias("brier"))


def _ll(eps: str) -> str:
    q = f"least(greatest(p, {eps}), 1e0 - {eps})"
    return f"avg(-ln(CASE WHEN y = 1 THEN {q} ELSE 1 - {q} END))"


@query(f"SELECT {KEYS}, {_ll('1e-7')} AS loose, {_ll('1e-15')} AS tight FROM predictions GROUP BY ALL", "loose tight")
def f4_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return v.predictions(spark, sf).groupBy(*K5).agg(mt.log_loss(1e-7).alias("loose"), mt.log_loss(1e-15).alias("tight"))


def _ece(edges: list[float], closed: bool) -> str:
    b = binned("p", arr(edges))
    b = f"least({b}, {len(edges) - 2})" if closed else b
    return f"""WITH pts AS (SELECT {KEYS}, {b} AS bin, avg(p) AS pm, avg(y) AS ym, count(*) AS n FROM predictions GROUP BY ALL)
SELECT {KEYS}, coalesce(sum(abs(ym - pm) * n) FILTER (bin < {len(edges) - 1}), 0) / sum(n) AS ece FROM pts GROUP BY ALL"""


@query(_ece(EDGES15, False), "ece")
def f5_ece_floor(spark: SparkSession, sf: str) -> DataFrame:
    return mt.ece(v.predictions(spark, sf), K5, 15, "floor")


@query(_ece([i / 10 for i in range(11)], True), "ece")
def f6_ece_closed(spark: SparkSession, sf: str) -> DataFrame:
    return mt.ece(v.predictions(spark, sf), K5, 10, "closed")


@query(f"SELECT {KEYS}, aece FROM aeces", "aece")
def f7_adaptive_ece(spark: SparkSession, sf: str) -> DataFrame:
    return v.facts(spark, sf).select(*K5, "aece")


@query(f"SELECT {KEYS}, bin, p_mean, y_mean, n FROM curve", "p_mean y_mean")
def f8_reliability_curve(spark: SparkSession, sf: str) -> DataFrame:
    return mt.curve(v.predictions(spark, sf).withColumn("p", mt.clip(F.col("p"), 1e-7, 1 - 1e-7)), K5, 15)


@query(f"SELECT * FROM murphy", "brier_rel brier_res brier_unc")
def f9_brier_parts(spark: SparkSession, sf: str) -> DataFrame:
    return v.facts(spark, sf).select(*K5, "brier_rel", "brier_res", "brier_unc")


@query("SELECT edition, model, world, bin, sum(p_mean * n) / sum(n) AS p_mean, sum(y_mean * n) / sum(n) AS y_mean, sum(n)::BIGINT AS n, stddev_pop(y_mean) AS y_sd, count(DISTINCT fold) AS n_folds FROM curve GROUP BY ALL", "p_mean y_mean y_sd")
def f10_pooled_curve(spark: SparkSession, sf: str) -> DataFrame:
    points = mt.curve(v.predictions(spark, sf).withColumn("p", mt.clip(F.col("p"), 1e-7, 1 - 1e-7)), K5, 15)
    return mt.pooled_curve(points, ["edition", "model", "world"])


@query("SELECT edition, fold, count(*) AS n, avg(y) AS prevalence FROM predictions WHERE model = 'nb_123' AND world = 'clean' GROUP BY ALL", "prevalence")
def f11_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return clean(spark, sf).where("model = 'nb_123'").groupBy("edition", "fold").agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"))


@query(
    f"SELECT {KEYS}, brier, log_loss, n_eval, prevalence, auroc, auprc, ece, aece, brier_rel, brier_res, brier_unc FROM facts",
    "brier log_loss prevalence auroc auprc ece aece brier_rel brier_res brier_unc",
)
def f12_metric_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return v.facts(spark, sf)


@query("SELECT edition, model, count(*) AS n, avg(y) AS prevalence, avg(pow(p - y, 2)) AS brier FROM predictions WHERE world = 'clean' GROUP BY ALL", "prevalence brier")
def f12_headline(spark: SparkSession, sf: str) -> DataFrame:
    return clean(spark, sf).groupBy(*EM).agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"), mt.brier().alias("brier"))


@query("SELECT * FROM thresholds", "thr")
def f13_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return v.fold_thresholds(v.clean_scores(v.folded(spark, sf)))


@query("SELECT edition, model, fold, tp, fp, tn, fn, sens, spec, ppv FROM rates", "sens spec ppv")
def f14_f15_f16_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return v.ppv_facts(spark, sf).select(*EM, "fold", "tp", "fp", "tn", "fn", "sens", "spec", "ppv")


@query("SELECT edition, model, fold, thr, pi, ppv_std FROM ppv_facts", "thr pi ppv_std")
def f17_standardised_ppv(spark: SparkSession, sf: str) -> DataFrame:
    return v.ppv_facts(spark, sf).select(*EM, "fold", "thr", "pi", "ppv_std")


#: The models of the decision run that are fitted for all editions and folds at once.
PPV_MODELS = ["logistic_l2", "random_forest", "svc_rbf", "gaussian_nb"]


@query()
def f18_ppv_run(spark: SparkSession, sf: str) -> DataFrame:
    """Both editions: each outer fold's threshold from inner out-of-fold scores of its training rows, applied to the fold.

    The prevalence is that of the full edition.
    """
    rows = kept(m.stratified_folds(src.editions(spark, sf), ["edition"], 2, 1).drop("repeat"), "folds")
    inner, outer = [], []
    for name in PPV_MODELS:
        inner.append(m.inner_scores(rows, ["edition"], name, NUM, CAT, 2, 2, trees=10, depth=4).withColumnRenamed("outer", "fold").withColumn("model", F.lit(name)))
        outer.append(m.held_out_scores(rows, ["edition"], name, NUM, CAT, 2, trees=10, depth=4).withColumn("model", F.lit(name)))
    pi = rows.where("edition = 'full'").agg(F.avg("y").alias("pi_ref"))
    return mt.ppv_run(cmp.stacked(inner), cmp.stacked(outer), ["edition", "model", "fold"], pi)


BOOT = 200


def boot_sql(source: str, by: str, value: str) -> str:
    """Bootstrap of the mean as bootstrap_mean() does it."""
    return f"""WITH rws AS (SELECT {by}, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
num AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY v) AS i FROM rws), siz AS (SELECT {by}, count(*) AS n, avg(v) AS mean FROM rws GROUP BY ALL),
slt AS (SELECT siz.*, r.rep, unnest(generate_series(1, n)) AS slot FROM siz, generate_series(1, {BOOT}) r(rep)),
drw AS (SELECT *, floor({u("'boot|' || rep || '|' || slot || '|42'")} * n)::BIGINT + 1 AS i FROM slt),
mns AS (SELECT {by}, rep, avg(v) AS mm FROM drw JOIN num USING ({by}, i) GROUP BY ALL)
SELECT {by}, max(n) AS n, max(mean) AS mean, quantile_cont(mm, {lit((1 - 0.95) / 2)}) AS ci_lo, quantile_cont(mm, {lit((1 + 0.95) / 2)}) AS ci_hi FROM mns JOIN siz USING ({by}) GROUP BY ALL"""


CI = "mean ci_lo ci_hi"


@query(boot_sql("metric_long", "edition, model, world, metric", "value"), CI)
def g1_world_summary(spark: SparkSession, sf: str) -> DataFrame:
    long = cmp.long_form(v.facts(spark, sf), K5, v.METRICS)
    return st.bootstrap_mean(long, ["edition", "model", "world", "metric"], "value", BOOT)


_PARTS = "(UNPIVOT (SELECT edition, model, fold, R, S_drop, C_exp, E FROM parts_e) ON R, S_drop, C_exp, E INTO NAME component VALUE value)"


@query(boot_sql(_PARTS, "edition, model, component", "value"), CI)
def g2_component_summary(spark: SparkSession, sf: str) -> DataFrame:
    long = cmp.long_form(v.parts(spark, sf), ["edition", "model", "fold"], ["R", "S_drop", "C_exp", "E"], "component")
    return st.bootstrap_mean(long, ["edition", "model", "component"], "value", BOOT)


@query()
def g3_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    aggs = [f(c).alias(f"{c[5:]}_{n}") for c in ("time_fit", "time_total") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return v.costs(spark, sf).groupBy(*EM).agg(*aggs)


@query("SELECT edition, model, count(*) AS n, avg(ppv_std) AS mean, stddev_samp(ppv_std) AS std, stddev_samp(ppv_std) / sqrt(count(*)) AS sem FROM ppv_facts GROUP BY ALL", "mean std sem")
def g4_ppv_summary(spark: SparkSession, sf: str) -> DataFrame:
    sd = F.stddev_samp("ppv_std")
    return v.ppv_facts(spark, sf).groupBy(*EM).agg(F.count("*").alias("n"), F.avg("ppv_std").alias("mean"), sd.alias("std"), (sd / F.sqrt(F.count("*").cast("double"))).alias("sem"))


_TSTAT = "avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0)"


# The two-sided 5 % points of Student's t for 1 to 12 degrees of freedom, from the usual table.
T_POINTS = [12.7062, 4.3027, 3.1824, 2.7764, 2.5706, 2.4469, 2.3646, 2.3060, 2.2622, 2.2281, 2.2010, 2.1788]


@query(f"WITH pm AS (SELECT metric, model, avg(d) AS d, abs({_TSTAT}) > {arr(T_POINTS)}[count(d) - 1] AS big FROM metric_deltas GROUP BY ALL) SELECT metric, count(DISTINCT model) AS n_models, avg(d) AS mean, median(d) AS median, count(*) FILTER (big) AS n_significant FROM pm GROUP BY metric", "mean median")
def g5_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = st.paired_t(v.metric_deltas(spark, sf), ["metric", "model"], "d")
    return t.groupBy("metric").agg(F.count_distinct("model").alias("n_models"), F.avg("mean_delta").alias("mean"), F.median("mean_delta").alias("median"), F.count_if(st.t_pvalue(F.col("t_stat"), F.col("n")) < 0.05).alias("n_significant"))


@query("SELECT f.model, f.E AS E_full, d.E AS E_demo, f.E - d.E AS delta_E FROM summary f JOIN summary d USING (model) WHERE f.edition = 'full' AND d.edition = 'demo'", "E_full E_demo delta_E")
def g6_stability_by_edition(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.deltas(cmp.edition_join(v.summary(spark, sf), ["model"], ["E"]), ["model"], ["E"])


@query("SELECT edition, model, count(p) AS n, avg(p) AS mean, stddev_samp(p) AS std, min(p) AS min, quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.5) AS q50, quantile_cont(p, 0.75) AS q75, max(p) AS max FROM scored GROUP BY ALL", "mean std min q25 q50 q75 max")
def g7_describe(spark: SparkSession, sf: str) -> DataFrame:
    return st.describe(clean(spark, sf), EM, "p")


@query("SELECT avg(d) AS mean, median(d) AS median, count(*) AS n FROM fold_deltas", "mean median")
def g8_delta_moments(spark: SparkSession, sf: str) -> DataFrame:
    return v.fold_deltas(spark, sf).agg(F.avg("d").alias("mean"), F.median("d").alias("median"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT min(x1) AS mn, max(x1) AS mx FROM labelled), b AS (SELECT least(floor((x1 - mn) / (mx - mn) * 30), 29)::INT AS bin, mn, mx FROM labelled, e)
SELECT bin, min(mn + (mx - mn) * bin / 30) AS lo, count(*) AS n FROM b GROUP BY bin""", "lo")
def g9_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return st.histogram(src.labelled(spark, sf), [], "x1", 30)


@query("SELECT edition, model, " + ", ".join(f"avg(auroc) FILTER (world = '{w}') AS {w}" for w in src.WORLDS) + " FROM facts GROUP BY ALL", " ".join(src.WORLDS))
def g10_model_world_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return v.facts(spark, sf).groupBy(*EM).pivot("world", src.WORLDS).agg(F.avg("auroc"))


@query()
def f12_fitted_in_worlds(spark: SparkSession, sf: str) -> DataFrame:
    """Models × worlds × folds × editions: fitted, perturbed, scored and measured in one plan."""
    return v.world_facts(spark, sf)


@query()
def h6_h9_fitted_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return v.fitted_ranking(spark, sf)


COMP = "R Q_label S_drop S_ratio C_exp C_linear"


@query("SELECT edition, fold, model, R, Q_label, S_drop, S_ratio, C_exp, C_linear, E FROM parts_e", COMP + " E")
def h1_h5_components(spark: SparkSession, sf: str) -> DataFrame:
    return v.parts(spark, sf)


@query("SELECT edition, model, score FROM scores", "score")
def h6_composite(spark: SparkSession, sf: str) -> DataFrame:
    return v.scores(spark, sf)


_S, _C, _E = ["S_drop", "S_ratio"], ["C_exp", "C_linear"], ["E", "E2"]
_VARIANTS = " UNION ALL ".join(f"SELECT edition, model, '{a}|{b}|{d}' AS variant, (0.4e0 * R + 0.3e0 * {a} + 0.2e0 * {b} + 0.1e0 * coalesce({d}, 0)) / (0.4e0 + 0.3e0 + 0.2e0 + 0.1e0) AS score FROM (SELECT *, E * E AS E2 FROM summary)" for a in _S for b in _C for d in _E)


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return co.variant_scores(v.summary(spark, sf).withColumn("E2", F.col("E") * F.col("E")), _S, _C, _E, EM)


@query(_VARIANTS, "score")
def h7_variant_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _variants(spark, sf)


_KT = "sum(sign(a1 - a2) * sign(b1 - b2)) / nullif(sqrt(sum(sign(a1 - a2) * sign(a1 - a2)) * sum(sign(b1 - b2) * sign(b1 - b2))), 0)"


@query(f"""WITH vs AS ({_VARIANTS}), rf AS (SELECT edition, model, score AS rs FROM vs WHERE variant = 'S_drop|C_exp|E'), b AS (SELECT vs.*, rs FROM vs JOIN rf USING (edition, model)),
rk AS (SELECT edition, variant, {average_rank('edition, variant', 'score')} AS ra, {average_rank('edition, variant', 'rs')} AS rb FROM b),
s AS (SELECT edition, variant, corr(ra, rb) AS spearman FROM rk GROUP BY ALL),
pr AS (SELECT x.edition, x.variant, x.score AS a1, z.score AS a2, x.rs AS b1, z.rs AS b2 FROM b x JOIN b z ON x.edition = z.edition AND x.variant = z.variant AND x.model < z.model),
k AS (SELECT edition, variant, {_KT} AS kendall FROM pr GROUP BY ALL) SELECT * FROM s JOIN k USING (edition, variant)""", "spearman kendall")
def h8_variant_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return co.variant_agreement(_variants(spark, sf), "S_drop|C_exp|E", ["edition"])


@query(f"SELECT edition, model, score, {average_rank('edition', 'score')} AS place, row_number() OVER (PARTITION BY edition ORDER BY score DESC, model) AS position FROM scores", "score place")
def h9_final_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return co.final_ranking(v.scores(spark, sf), ["edition"])


def _sweep() -> str:
    out = []
    for i in range(7):
        w = 0.30 + (0.50 - 0.30) * i / 6
        s, c, e = (x / (1 - 0.4) * (1 - w) for x in (0.3, 0.2, 0.1))
        out.append(f"SELECT edition, model, {lit(w)} AS w_r, ({lit(w)} * R + {lit(s)} * S_drop + {lit(c)} * C_exp + {lit(e)} * coalesce(E, 0)) / {lit(w + s + c + e)} AS score FROM summary")
    return " UNION ALL ".join(out)


@query(_sweep(), "w_r score")
def h10_weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return co.weight_sweep(v.summary(spark, sf), EM)


@query("SELECT edition, model, severity, avg(0.5e0 * auroc + 0.5e0 * exp(-aece)) AS score FROM facts GROUP BY ALL", "score")
def h11_severity_curve(spark: SparkSession, sf: str) -> DataFrame:
    return co.severity_curve(v.facts(spark, sf)).groupBy(*EM, "severity").agg(F.avg("score").alias("score"))


@query("SELECT * FROM fold_scores", "score score_e")
def h12_fold_composite(spark: SparkSession, sf: str) -> DataFrame:
    return v.fold_scores(spark, sf)


_ATTR = "attr AS (" + " UNION ALL ".join(f"SELECT edition, row_id, '{c}' AS feature, b{i} * ({c} - m{i}) AS value FROM editions, lin WHERE edition = 'full'" for i, c in enumerate(NUM, 1)) + ")"


def _attr(spark: SparkSession, sf: str) -> DataFrame:
    """Attributions of a linear model of the label, fitted on all labelled rows."""
    rows = src.labelled(spark, sf)
    coef = st.ols(rows, "y", NUM).where("term <> 'intercept'").select(F.col("term").alias("feature"), "coef")
    return at.linear_attribution(rows.withColumn("edition", F.lit("full")), coef, NUM, ["edition"])


@query(f"WITH {_ATTR} SELECT * FROM attr", "value")
def i1_linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _attr(spark, sf)


@query()
def i2_sampled_shapley(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of edition full, attributed by sampling to the score of the model that didn't see its fold."""
    rows = v.folded(spark, sf).where("edition = 'full'")
    stats = v.kept(m.nb_statistics(rows, ["edition"], NUM, src.FOLDS), "nb-statistics")
    score = lambda df: m.nb_scored(df, stats, ["edition"], NUM)
    return at.sampled_shapley(rows, rows, NUM, score, 4)


@query(f"WITH {_ATTR} SELECT edition, feature, avg(abs(value)) AS mean_abs FROM attr GROUP BY ALL", "mean_abs")
def i3_mean_absolute(spark: SparkSession, sf: str) -> DataFrame:
    return at.mean_absolute(_attr(spark, sf), ["edition"])


_FULL = "edition = 'full' AND model = 'nb_123'"
_WORLD = stability_ctes("full_pairs", "world", "'nb_123' AS model", "e_world")
_WORLDS = f"WITH full_pairs AS (SELECT * FROM attr_pairs WHERE {_FULL}), " + ", ".join(f"{k} AS ({sql})" for k, sql in _WORLD.items())


def _worlds(spark: SparkSession, sf: str) -> DataFrame:
    """Attributions of a fitted model of edition full in the clean world and in those that move features."""
    return v.attributions(spark, sf).where(f"{_FULL} AND world <> 'label_noise'")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, keys = _worlds(spark, sf), ["fold", "row_id", "feature"]
    base = a.where("world = 'clean'").select(*keys, F.col("value").alias("v0"))
    return a.where("world <> 'clean'").join(base, keys)


@query(f"{_WORLDS} SELECT * FROM e_world_cos", "cosine")
def i4_row_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return at.row_cosine(_pairs(spark, sf), ["world"], "value", "v0")


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy("world", "feature").agg(F.avg(F.abs("value")).alias("ma"), F.avg(F.abs("v0")).alias("m0"))


@query(f"{_WORLDS} SELECT * FROM e_world_rank", "spearman")
def i5_rank_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return st.spearman(_means(spark, sf), ["world"], "ma", "m0")


@query(f"{_WORLDS} SELECT * FROM e_world_top", "jaccard")
def i6_topk_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.jaccard_top(_means(spark, sf), ["world"], "feature", "ma", "m0", 2)


@query(f"{_WORLDS} SELECT * FROM e_world", "E_cos E_rank E_jaccard E_mix")
def i7_stability_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return at.stability(_worlds(spark, sf), ["model"], "clean", 2)


@query("SELECT edition, model, fold, E_cos, E_rank, E_jaccard, E_mix FROM e_fold", "E_cos E_rank E_jaccard E_mix")
def i7_fold_stability(spark: SparkSession, sf: str) -> DataFrame:
    return v.fold_stability(spark, sf)


@query("SELECT edition, world, fold, model, row_id, feature, value FROM attributions", "value")
def i1_fitted_attributions(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of both editions in four worlds, attributed to the features of models that didn't see its fold."""
    return v.attributions(spark, sf)


@query(f"WITH {_ATTR}, bt AS (SELECT feature FROM attr GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 1) SELECT row_id, feature, edition, CASE feature WHEN 'x1' THEN x1 WHEN 'x2' THEN x2 ELSE x3 END AS x, value FROM attr JOIN bt USING (feature) JOIN labelled USING (row_id)", "x value")
def i8_top_feature_pairs(spark: SparkSession, sf: str) -> DataFrame:
    values = cmp.long_form(src.labelled(spark, sf), ["row_id"], NUM, "feature", "x")
    return at.top_feature_pairs(_attr(spark, sf), values, ["edition"])


def _importance(rows: DataFrame) -> DataFrame:
    """Importance of each feature to a class-balanced logistic model of the rows, ten repeats."""
    return at.permutation_importance(rows, NUM, m.fitted(rows, "logistic_balanced", NUM, []), 10)


@query()
def i9_permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _importance(kept(src.dealt(src.labelled(spark, sf).select("row_id", "y", *NUM)), "rows"))


@query(f"WITH a AS (SELECT world, feature, avg(abs(value)) AS w FROM attributions WHERE {_FULL} GROUP BY ALL), rk AS (SELECT {average_rank('', 'a.w')} AS ra, {average_rank('', 'b.w')} AS rb FROM a JOIN a b USING (feature) WHERE a.world = 'noise' AND b.world = 'clean') SELECT corr(ra, rb) AS spearman FROM rk", "spearman")
def i10_importance_agreement(spark: SparkSession, sf: str) -> DataFrame:
    kept = v.kept(at.mean_absolute(_worlds(spark, sf), ["world"]), "mean-attributions").withColumnRenamed("mean_abs", "importance")
    one = lambda w: kept.where(F.col("world") == w).drop("world")
    return at.importance_agreement(one("noise").withColumn("g", F.lit(1)), one("clean"), ["g"]).drop("g")




@query("SELECT f.model, f.fold, f.world, f.auroc AS auroc_full, d.auroc AS auroc_demo, f.auroc - d.auroc AS delta_auroc, f.ece AS ece_full, d.ece AS ece_demo, f.ece - d.ece AS delta_ece FROM facts f JOIN facts d USING (model, fold, world) WHERE f.edition = 'full' AND d.edition = 'demo'", "auroc_full auroc_demo delta_auroc ece_full ece_demo delta_ece")
def j1_j5_edition_joins(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["model", "fold", "world"]
    return cmp.deltas(cmp.edition_join(v.facts(spark, sf), keys, ["auroc", "ece"]), keys, ["auroc", "ece"])


_HALVES = "a AS (SELECT model, fold, score FROM fold_scores WHERE edition = 'full' AND fold <> 1), b AS (SELECT model, fold, score FROM fold_scores WHERE edition = 'demo' AND model <> 'nb_12')"


@query(f"WITH {_HALVES} SELECT (SELECT count(*) FROM a JOIN b USING (model, fold)) AS n_merged, (SELECT count(*) FROM a ANTI JOIN b USING (model, fold)) AS n_left_only, (SELECT count(*) FROM b ANTI JOIN a USING (model, fold)) AS n_right_only")
def j6_m22_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    f = v.fold_scores(spark, sf)
    a, b = f.where("edition = 'full' AND fold <> 1").select("model", "fold", "score"), f.where("edition = 'demo' AND model <> 'nb_12'").select("model", "fold", "score")
    return cmp.unmatched(a, b, ["model", "fold"])


@query("SELECT p.edition, p.fold, p.model, p.R, e.E FROM parts p LEFT JOIN (SELECT edition, fold, model, E FROM parts_e WHERE E IS NOT NULL) e USING (edition, fold, model)", "R E")
def j7_left_join_stability(spark: SparkSession, sf: str) -> DataFrame:
    p = v.parts(spark, sf)
    return co.with_stability(p.select("edition", "fold", "model", "R"), p.where("E IS NOT NULL").select("edition", "fold", "model", "E"), ["edition", "fold", "model"])


@query("SELECT a.edition, a.fold, a.model AS m1, b.model AS m2, a.score - b.score AS d FROM fold_scores a JOIN fold_scores b ON a.edition = b.edition AND a.fold = b.fold AND a.model < b.model", "d")
def j8_model_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.model_pairs(v.fold_scores(spark, sf), ["edition", "fold"], "score").select("edition", "fold", "m1", "m2", "d")


@query(f"SELECT edition, world, model, auroc_mean, {average_rank('edition, world', 'auroc_mean')} AS avg_rank, rank() OVER (PARTITION BY edition, world ORDER BY auroc_mean DESC) AS min_rank FROM (SELECT edition, world, model, avg(auroc) AS auroc_mean FROM facts GROUP BY ALL)", "auroc_mean avg_rank")
def k1_k2_k5_ranks(spark: SparkSession, sf: str) -> DataFrame:
    mean = v.facts(spark, sf).groupBy("edition", "world", "model").agg(F.avg("auroc").alias("auroc_mean"))
    by = ["edition", "world"]
    return mean.withColumns({"avg_rank": st.average_rank(by, "auroc_mean"), "min_rank": st.min_rank(by, "auroc_mean")})


@query(boot_sql("fold_deltas", "model", "d"), CI)
def l1_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return st.bootstrap_mean(v.fold_deltas(spark, sf), ["model"], "d", BOOT)


@query()
def l1_poisson_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return st.bootstrap_mean(src.labelled(spark, sf), ["k1"], "x1", 20, mode="poisson")


@query(f"SELECT model, metric, count(d) AS n, avg(d) AS mean_delta, {_TSTAT} AS t_stat FROM metric_deltas GROUP BY ALL", "mean_delta t_stat")
def l2_paired_t(spark: SparkSession, sf: str) -> DataFrame:
    return st.paired_t(v.metric_deltas(spark, sf), ["model", "metric"], "d")


_SIGNED = f"""rk AS (SELECT model, metric, d, {average_rank('model, metric', 'abs(d)', False)} AS r, count(*) OVER (PARTITION BY model, metric, abs(d)) AS t FROM metric_deltas WHERE d <> 0),
sr AS (SELECT model, metric, count(*) AS n_nonzero, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY ALL)"""


@query(f"WITH {_SIGNED} SELECT *, least(w_plus, w_minus) AS wilcoxon, (w_plus - w_minus) / nullif(w_plus + w_minus, 0) AS rank_biserial FROM sr", "w_plus w_minus ties wilcoxon rank_biserial")
def l3_l9_signed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return st.signed_ranks(v.metric_deltas(spark, sf), ["model", "metric"], "d")


_SIGN_TEST = """WITH s AS (SELECT model, metric, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg FROM metric_deltas GROUP BY ALL)
SELECT model, metric, n_pos, n_neg, least(1e0, 2 * list_sum(list_transform(range(0, least(n_pos, n_neg) + 1), lambda k: exp(lgamma(n_pos + n_neg + 1) - lgamma(k + 1) - lgamma(n_pos + n_neg - k + 1) - (n_pos + n_neg) * ln(2))))) AS p_sign FROM s"""


@query(_SIGN_TEST, "p_sign")
def l4_sign_test(spark: SparkSession, sf: str) -> DataFrame:
    return st.sign_test(v.metric_deltas(spark, sf), ["model", "metric"], "d")


_HOLM = f"""WITH pv AS (SELECT model, metric, p_sign AS p FROM ({_SIGN_TEST})),
o AS (SELECT *, coalesce(p, 1e0) AS q, count(*) OVER (PARTITION BY metric) AS mm, row_number() OVER (PARTITION BY metric ORDER BY coalesce(p, 1e0), model) AS i FROM pv)
SELECT model, metric, p, max(least(1e0, (mm - i + 1) * q)) OVER (PARTITION BY metric ORDER BY q, model ROWS UNBOUNDED PRECEDING) AS p_holm FROM o"""


@query(_HOLM, "p p_holm")
def l5_k3_holm(spark: SparkSession, sf: str) -> DataFrame:
    """The sign tests' p-values, stepped down over the models of each metric."""
    rows = st.sign_test(v.metric_deltas(spark, sf), ["model", "metric"], "d").select("model", "metric", F.col("p_sign").alias("p"))
    return st.holm(rows, ["metric"], "p", ["model"], "p_holm")


@query("SELECT model, metric, CASE WHEN count(d) >= 2 THEN avg(d) / nullif(stddev_samp(d), 0) END AS dz FROM metric_deltas GROUP BY ALL", "dz")
def l6_cohen_dz(spark: SparkSession, sf: str) -> DataFrame:
    return st.cohen_dz(v.metric_deltas(spark, sf), ["model", "metric"], "d")


_PAIR = "j AS (SELECT f.model, f.world, f.fold, f.auroc AS va, d.auroc AS vb FROM facts f JOIN facts d USING (model, world, fold) WHERE f.edition = 'full' AND d.edition = 'demo')"


@query(f"""WITH {_PAIR}, rk AS (SELECT world, fold, {average_rank('world, fold', 'va')} AS ra, {average_rank('world, fold', 'vb')} AS rb FROM j), s AS (SELECT world, fold, count(*) AS n, corr(ra, rb) AS spearman FROM rk GROUP BY ALL),
pr AS (SELECT x.world, x.fold, x.va AS a1, z.va AS a2, x.vb AS b1, z.vb AS b2 FROM j x JOIN j z ON x.world = z.world AND x.fold = z.fold AND x.model < z.model), k AS (SELECT world, fold, {_KT} AS kendall FROM pr GROUP BY ALL) SELECT * FROM s JOIN k USING (world, fold)""", "spearman kendall")
def l7_l8_rank_correlations(spark: SparkSession, sf: str) -> DataFrame:
    joined = cmp.edition_join(v.facts(spark, sf), ["model", "world", "fold"], ["auroc"])
    return cmp.rank_agreement(joined, ["world", "fold"], "model", "auroc_full", "auroc_demo")


@query()
def l10_regression(spark: SparkSession, sf: str) -> DataFrame:
    joined = cmp.edition_join(v.parts(spark, sf).join(v.fold_scores(spark, sf).select("edition", "fold", "model", "score"), ["edition", "fold", "model"]), ["model", "fold"], ["score", "R", "S_drop", "C_exp"])
    d = cmp.deltas(joined, [], ["score", "R", "S_drop", "C_exp"])
    return st.ols(d, "delta_score", ["delta_R", "delta_S_drop", "delta_C_exp"])


def _grouped_regression() -> str:
    fits = ", ".join(f"{k} AS ({sql})" for k, sql in linear_ctes("labelled", "k2").items()).replace("lin_", "seg_").replace("lin AS", "seg AS")
    rss = "(n * (vy - (b1 * d1 + b2 * d2 + b3 * d3)) / (n - 4))"
    term = lambda name, b, inner, vif: f"SELECT k2, '{name}' AS term, {b} AS coef, sqrt({rss} * {inner}) AS se, {b} / sqrt({rss} * {inner}) AS t_stat, {vif} AS vif, n FROM seg"
    terms = [term(c, f"b{i}", f"i{i}{i} / n", f"c{i}{i} * i{i}{i}") for i, c in enumerate(NUM, 1)]
    spread = " + ".join(f"m{i} * i{i}{j} * m{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    terms.append(term("intercept", "(my - b1 * m1 - b2 * m2 - b3 * m3)", f"(1 + {spread}) / n", "NULL::DOUBLE"))
    return f"WITH {fits} " + " UNION ALL ".join(terms)


@query(_grouped_regression(), "coef se t_stat vif")
def l10_grouped_regression(spark: SparkSession, sf: str) -> DataFrame:
    """The label on three columns, in every segment at once."""
    return st.ols(src.labelled(spark, sf), "y", NUM, ["k2"]).select("k2", "term", "coef", "se", "t_stat", "vif", "n")


_M1 = "SELECT f.model, f.score AS score_full, d.score AS score_demo, f.score - d.score AS delta_score, rank() OVER (ORDER BY f.score DESC) AS rank_full, rank() OVER (ORDER BY d.score DESC) AS rank_demo FROM scores f JOIN scores d USING (model) WHERE f.edition = 'full' AND d.edition = 'demo'"


@query(f"SELECT *, rank_demo - rank_full AS rank_change FROM ({_M1})", "score_full score_demo delta_score")
def m1_k4_score_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.score_comparison(v.scores(spark, sf))


@query(f"""WITH m AS ({_M1}), rk AS (SELECT {average_rank('', 'score_full')} AS ra, {average_rank('', 'score_demo')} AS rb FROM m), s AS (SELECT count(*) AS n, corr(ra, rb) AS spearman FROM rk),
pr AS (SELECT x.score_full AS a1, z.score_full AS a2, x.score_demo AS b1, z.score_demo AS b2 FROM m x JOIN m z ON x.model < z.model) SELECT n, spearman, (SELECT {_KT} FROM pr) AS kendall FROM s""", "spearman kendall")
def m2_rank_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.rank_agreement(cmp.score_comparison(v.scores(spark, sf)), [], "model", "score_full", "score_demo")


@query("SELECT model, world, metric, avg(d) AS delta FROM metric_deltas GROUP BY ALL", "delta")
def m3_b16_b18_metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    mean = v.facts(spark, sf).groupBy("edition", "model", "world").agg(*[F.avg(c).alias(c) for c in v.METRICS])
    d = cmp.deltas(cmp.edition_join(mean, ["model", "world"], v.METRICS), [], v.METRICS)
    return cmp.long_form(d.select("model", "world", *[F.col(f"delta_{c}").alias(c) for c in v.METRICS]), ["model", "world"], v.METRICS, "metric", "delta")


@query(boot_sql("metric_deltas", "metric, world", "d"), CI)
def m4_delta_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.delta_intervals(v.metric_deltas(spark, sf).withColumnRenamed("d", "delta"), "world", BOOT)


_MODEL_PAIRS = "SELECT a.edition, a.model AS m1, b.model AS m2, a.score - b.score AS d FROM fold_scores a JOIN fold_scores b ON a.edition = b.edition AND a.fold = b.fold AND a.model < b.model"
_PAIRED = """ts AS (SELECT {by}, count(d) AS n, avg(d) AS mean_delta, avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0) AS t_stat FROM {rows} GROUP BY ALL),
dr AS (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2e0 AS r FROM {rows} WHERE d <> 0),
ws AS (SELECT {by}, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS wilcoxon FROM dr GROUP BY ALL)
SELECT {by}, n, mean_delta, t_stat, wilcoxon FROM ts LEFT JOIN ws USING ({by})"""


def _statistics(d: DataFrame, by: list[str]) -> DataFrame:
    rows = v.kept(d, "differences")
    return st.paired_t(rows, by, "d").join(st.signed_ranks(rows, by, "d").select(*by, "wilcoxon"), by, "left")


@query(f"WITH {_PAIRED.format(rows='fold_deltas', by='model')}", "mean_delta t_stat wilcoxon")
def m5_paired_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """t and W of m5_paired_tests, whose p-values SQL can't give."""
    return _statistics(v.fold_deltas(spark, sf), ["model"])


@query()
def m5_paired_tests(spark: SparkSession, sf: str) -> DataFrame:
    return st.paired_tests(v.fold_deltas(spark, sf), ["model"], "d")


@query(f"WITH pairs AS ({_MODEL_PAIRS}), {_PAIRED.format(rows='pairs', by='edition, m1, m2')}", "mean_delta t_stat wilcoxon")
def m6_model_pair_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics(cmp.model_pairs(v.fold_scores(spark, sf), ["edition", "fold"], "score"), ["edition", "m1", "m2"])


@query()
def m6_model_pair_tests(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cmp.model_pairs(v.fold_scores(spark, sf), ["edition", "fold"], "score")
    return st.paired_tests(pairs, ["edition", "m1", "m2"], "d", ["edition"])


SUMM = ["R", "S_drop", "S_ratio", "C_exp", "C_linear"]


@query("SELECT f.model, " + ", ".join(f"f.{c} - d.{c} AS delta_{c}" for c in SUMM) + " FROM summary f JOIN summary d USING (model) WHERE f.edition = 'full' AND d.edition = 'demo'", " ".join(f"delta_{c}" for c in SUMM))
def m7_ablation_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.deltas(cmp.edition_join(v.summary(spark, sf), ["model"], SUMM), [], SUMM).select("model", *[f"delta_{c}" for c in SUMM])


@query(f"WITH vs AS ({_VARIANTS}) SELECT f.variant, f.model, f.score - d.score AS delta_score FROM vs f JOIN vs d USING (variant, model) WHERE f.edition = 'full' AND d.edition = 'demo'", "delta_score")
def m8_variant_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.deltas(cmp.edition_join(_variants(spark, sf), ["variant", "model"], ["score"]), [], ["score"]).select("variant", "model", "delta_score")


_PT = f"SELECT edition, m1, m2, {_TSTAT} AS t FROM (SELECT a.edition, a.model AS m1, b.model AS m2, a.score - b.score AS d FROM fold_scores a JOIN fold_scores b ON a.edition = b.edition AND a.fold = b.fold AND a.model < b.model) GROUP BY ALL"


@query(f"WITH pt AS ({_PT}) SELECT f.m1, f.m2, f.t AS t_full, d.t AS t_demo, f.t - d.t AS delta_t FROM pt f JOIN pt d USING (m1, m2) WHERE f.edition = 'full' AND d.edition = 'demo'", "t_full t_demo delta_t")
def m9_test_deltas(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cmp.model_pairs(v.fold_scores(spark, sf), ["edition", "fold"], "score")
    t = st.paired_t(pairs, ["edition", "m1", "m2"], "d").withColumnRenamed("t_stat", "t")
    return cmp.deltas(cmp.edition_join(t, ["m1", "m2"], ["t"]), [], ["t"])


@query(f"WITH {_PAIRED.format(rows='metric_deltas', by='metric, model')}", "mean_delta t_stat wilcoxon")
def m10_metric_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics(v.metric_deltas(spark, sf), ["metric", "model"])


@query()
def m10_metric_tests(spark: SparkSession, sf: str) -> DataFrame:
    return st.paired_tests(v.metric_deltas(spark, sf), ["metric", "model"], "d", ["metric"])


_POOL = "pooled AS (SELECT edition, model, world, bin, sum(y_mean * n) / sum(n) AS ym, sum(n) AS n FROM curve GROUP BY ALL), gap AS (SELECT f.model, f.world, f.bin, abs(f.ym - d.ym) AS g, f.n + d.n AS n FROM pooled f JOIN pooled d USING (model, world, bin) WHERE f.edition = 'full' AND d.edition = 'demo')"


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    points = mt.curve(v.predictions(spark, sf).withColumn("p", mt.clip(F.col("p"), 1e-7, 1 - 1e-7)), K5, 15)
    return mt.pooled_curve(points, ["edition", "model", "world"])


@query(f"WITH {_POOL} SELECT model, world, count(*) AS n_bins, sum(g * n) / sum(n) AS l1, max(g) AS max_gap FROM gap GROUP BY ALL", "l1 max_gap")
def m11_j10_curve_distance(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.curve_distance(_pooled(spark, sf), ["model", "world"])


@query(f"WITH {_POOL} SELECT model, world, max(g) AS max_gap FROM gap GROUP BY ALL ORDER BY max_gap DESC, model, world LIMIT 5", "max_gap")
def m12_n2_largest_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.curve_distance(_pooled(spark, sf), ["model", "world"]).select("model", "world", "max_gap").orderBy(F.desc("max_gap"), "model", "world").limit(5)


@query()
def m13_cost_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c = v.costs(spark, sf)
    c = c.groupBy(*EM).agg(F.avg(cmp.cost_choice(c, ["time_attr", "time_pred", "time_fit"])).alias("t"))
    return cmp.deltas(cmp.edition_join(c, ["model"], ["t"]), [], ["t"])


@query(f"WITH r AS (SELECT edition, model, world, avg(auroc) AS sc FROM facts GROUP BY ALL), k AS (SELECT edition, model, world, {average_rank('edition, world', 'sc')} AS rk FROM r) SELECT a.edition, a.world AS world_i, b.world AS world_j, corr(a.rk, b.rk) AS rho FROM k a JOIN k b USING (edition, model) GROUP BY ALL", "rho")
def m14_j9_world_rank_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.world_rank_matrix(v.facts(spark, sf), ["edition"])


@query("SELECT model, 'auroc' AS metric, max(r.value) AS ref, quantile_cont(s.value, 0.025) AS q025, quantile_cont(s.value, 0.5) AS q50, quantile_cont(s.value, 0.975) AS q975, avg((s.value < r.value)::INT) * 100 AS percentile FROM run_scores s JOIN ref_scores r USING (model) GROUP BY ALL", "ref q025 q50 q975 percentile")
def m15_reference_percentile(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda d: d.withColumn("metric", F.lit("auroc"))
    return cmp.reference_percentile(named(v.run_scores(spark, sf)), named(v.reference_scores(spark, sf)), ["auroc"])


_TOPS = ", ".join(f"avg((pos <= {k})::INT) FILTER (rpos <= {k}) AS top{k}" for k in (1, 2, 3))
_RS = f"""ps AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY value DESC) AS r, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, model) AS pos FROM run_scores),
rp AS (SELECT model, rank() OVER (ORDER BY value DESC) AS rr, row_number() OVER (ORDER BY value DESC, model) AS rpos FROM ref_scores)"""


@query(f"WITH {_RS} SELECT run_id, corr(r, rr) AS spearman, {_TOPS} FROM ps JOIN rp USING (model) GROUP BY run_id", "spearman top1 top2 top3")
def m16_j13_n3_rank_stability(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.rank_stability(v.run_scores(spark, sf), v.reference_scores(spark, sf))


@query(f"WITH {_RS} SELECT avg((pos = 1)::INT) AS p_best, avg((pos <= 3)::INT) AS p_top FROM ps JOIN rp USING (model) WHERE rpos = 1", "p_best p_top")
def m17_n4_decision_stability(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.decision_stability(v.run_scores(spark, sf), v.reference_scores(spark, sf))


@query()
def m18_importance_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Importances in each of 1,000 subsamples against those of the whole table."""
    rows = kept(src.dealt(src.labelled(spark, sf).select("row_id", "y", *NUM)), "rows")
    runs = m.subsample_importance(stratified_subsample(rows, [], 252, RUNS), ["run_id"], NUM)
    return at.importance_agreement(runs, v.kept(_importance(rows), "importance"), ["run_id"])


_M19 = "ppvl AS (UNPIVOT (SELECT edition, model, fold, sens, spec, ppv, ppv_std FROM ppv_facts) ON sens, spec, ppv, ppv_std INTO NAME metric VALUE value), pd AS (SELECT f.model, f.metric, f.fold, f.value AS vf, d.value AS vd, f.value - d.value AS d FROM ppvl f JOIN ppvl d USING (model, metric, fold) WHERE f.edition = 'full' AND d.edition = 'demo')"


def _ppv_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The folds in which both editions have a rate: a fold whose rate is undefined in one of them is no pair."""
    facts = v.kept(v.ppv_facts(spark, sf), "ppv-facts")  # a row for each fold, read by both sides of the join
    long = cmp.long_form(facts, ["edition", "model", "fold"], ["sens", "spec", "ppv", "ppv_std"]).where("value IS NOT NULL")
    return cmp.deltas(cmp.edition_join(long, ["model", "metric", "fold"], ["value"]), [], ["value"]).withColumnRenamed("delta_value", "d")


@query(f"WITH {_M19} SELECT model, metric, count(d) AS n, avg(vf) AS mean_full, avg(vd) AS mean_demo, avg(d) AS mean_delta, stddev_samp(d) AS sd, avg(d) / nullif(stddev_samp(d), 0) AS dz, {_TSTAT} AS t_stat FROM pd GROUP BY ALL", "mean_full mean_demo mean_delta sd dz t_stat")
def m19_paired_editions(spark: SparkSession, sf: str) -> DataFrame:
    d = _ppv_deltas(spark, sf)
    by = ["model", "metric"]
    means = d.groupBy(*by).agg(F.avg("value_full").alias("mean_full"), F.avg("value_demo").alias("mean_demo"), F.stddev_samp("d").alias("sd"))
    return means.join(st.paired_t(d, by, "d"), by).join(st.cohen_dz(d, by, "d"), by)


@query(f"WITH {_M19} SELECT metric, count(d) AS n, avg(d) AS mean_delta, {_TSTAT} AS t_stat FROM pd WHERE metric = 'ppv_std' GROUP BY metric", "mean_delta t_stat")
def m20_pooled_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return st.paired_t(_ppv_deltas(spark, sf).where("metric = 'ppv_std'"), ["metric"], "d")


@query(f"WITH {_M19} SELECT model, avg(vf) AS full_ppv, avg(vd) AS demo_ppv FROM pd WHERE metric = 'ppv_std' GROUP BY model", "full_ppv demo_ppv")
def m21_topline(spark: SparkSession, sf: str) -> DataFrame:
    d = _ppv_deltas(spark, sf).where("metric = 'ppv_std'")
    return d.groupBy("model").agg(F.avg("value_full").alias("full_ppv"), F.avg("value_demo").alias("demo_ppv"))


@query("SELECT edition, model, score, position FROM (SELECT *, row_number() OVER (ORDER BY edition, score DESC, model) AS position FROM scores)", "score")
def n1_mixed_sort(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return v.scores(spark, sf).withColumn("position", F.row_number().over(Window.orderBy("edition", F.desc("score"), "model")))


@query(f"WITH {_ATTR} SELECT row_id, feature, value, pos FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature) AS pos FROM attr) WHERE pos <= 2", "value")
def n5_topk_features(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("row_id").orderBy(F.abs("value").desc(), "feature")
    return _attr(spark, sf).withColumn("pos", F.row_number().over(w)).where("pos <= 2").select("row_id", "feature", "value", "pos")


@query("SELECT edition, count(*) AS n, sum(n)::BIGINT AS rws FROM curve WHERE fold = 1 GROUP BY ALL UNION ALL SELECT edition, count(*), sum(n)::BIGINT FROM curve WHERE fold = 2 GROUP BY ALL UNION ALL SELECT edition, count(*), sum(n)::BIGINT FROM curve WHERE fold = 3 GROUP BY ALL")
def o1_union_curves(spark: SparkSession, sf: str) -> DataFrame:
    points = mt.curve(v.predictions(spark, sf).withColumn("p", mt.clip(F.col("p"), 1e-7, 1 - 1e-7)), K5, 15)
    return cmp.stacked([points.where(F.col("fold") == k).groupBy("edition").agg(F.count("*").alias("n"), F.sum("n").alias("rws")) for k in (1, 2, 3)])


@query("SELECT DISTINCT model, row_id FROM predictions WHERE edition = 'demo' AND p > 0.5 INTERSECT SELECT DISTINCT model, row_id FROM predictions WHERE edition = 'full' AND y = 1")
def o2_o3_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    p = v.predictions(spark, sf)
    return p.where("edition = 'demo' AND p > 0.5").select("model", "row_id").intersect(p.where("edition = 'full' AND y = 1").select("model", "row_id"))


@query("SELECT model, row_id, edition, world, p / 0.7e0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY model, row_id ORDER BY edition, severity) AS rn FROM predictions) WHERE rn = 1", "p")
def o5_first_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.first_by_key(v.predictions(spark, sf), ["model", "row_id"], ["edition", "severity"]).select("model", "row_id", "edition", "world", (F.col("p") / 0.7).alias("p"))
