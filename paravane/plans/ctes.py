"""DuckDB SQL for the shared test views: common table expressions that refer to each other by name."""

from __future__ import annotations

import re

KEYS = "edition, model, world, severity, fold"


def lit(x: float) -> str:
    """x as a DOUBLE literal."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def arr(xs: list[float]) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


def h32(k: str) -> str:
    return f"('0x' || substr(md5({k}), 1, 8))::BIGINT"


def u(k: str) -> str:
    """Uniform draw of a key."""
    return f"(({h32(k)}::DOUBLE + 0.5e0) / 4294967296e0)"


def normal(k: str) -> str:
    return f"(sqrt(-2 * ln({u(k + " || '|1'")})) * cos(6.283185307179586e0 * {u(k + " || '|2'")}))"


def student3(k: str) -> str:
    squares = " + ".join(f"pow({normal(k + f" || '|c|{i}'")}, 2)" for i in (1, 2, 3))
    return f"({normal(k + " || '|n'")} / sqrt(({squares}) / 3e0))"


EDGES15 = [i / 15 for i in range(16)]
INNER15 = [i / 15 for i in range(1, 15)]


def binned(p: str, edges: str) -> str:
    return f"len(list_filter({edges}, lambda e: e <= {p})) - 1"


def average_rank(by: str, value: str, desc: bool = True) -> str:
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"(rank() OVER ({part} ORDER BY {value} {'DESC' if desc else 'ASC'}) + (count(*) OVER ({ties}) - 1) / 2e0)"


#: The fitted models whose scores the metric queries read, with their columns; those of ATTRIBUTED have attributions too.
MODELS = {"nb_123": ["x1", "x2", "x3"], "nb_12": ["x1", "x2"], "nb_23": ["x2", "x3"], "nb_3": ["x3"]}
ATTRIBUTED = ("nb_123", "nb_12")
#: The naive Bayes models of the subsampling experiments: the columns that each one reads.
NB_MODELS = {"nb_all": ["x1", "x2", "x3"], "nb_x1": ["x1"], "nb_x2": ["x2"], "nb_x3": ["x3"]}
RUNS = 1000

SUBSAMPLE = """WITH c AS (SELECT y, count(*) AS n FROM labelled GROUP BY y), t AS (SELECT y, n, least(n, greatest(least(2, n), round({n}::DOUBLE * n / sum(n) OVER ()))) AS t FROM c),
want AS (SELECT y, CASE WHEN row_number() OVER (ORDER BY n DESC, y) = 1 THEN greatest(0, least(n, t + least({n}, sum(n) OVER ()) - sum(t) OVER ())) ELSE t END AS want FROM t),
r AS (SELECT g.run_id::INT AS run_id, row_id, y, row_number() OVER (PARTITION BY g.run_id, y ORDER BY {h}, row_id) AS rk FROM labelled, generate_series(1, {runs}) g(run_id))
SELECT run_id, row_id, r.y FROM r JOIN want ON r.y = want.y WHERE rk <= want"""
#: One digest gives the draws of four runs.
SUBSAMPLE_KEY = "('0x' || substr(md5('subsample|' || ((g.run_id - 1) // 4) || '|' || row_id || '|42'), 8 * ((g.run_id - 1) % 4) + 1, 8))::BIGINT"


def _nb_ctes() -> dict[str, str]:
    """Held-out naive Bayes scores of all subsamples, and as run 0 of the whole table; then the AUROC of each run."""
    cols = NB_MODELS["nb_all"]
    stats = ", ".join(f"avg({c}) AS a_{c}, var_pop({c}) AS v_{c}" for c in cols)
    scored = []
    for name, used in NB_MODELS.items():
        wide = f"1e-9 * greatest({', '.join(f'w_{c}' for c in used)}, 0e0)"
        like = lambda t: f"ln({t}.n::DOUBLE) " + " ".join(f"- 0.5e0 * ln({t}.v_{c} + {wide}) - pow(r.{c} - {t}.a_{c}, 2) / (2 * ({t}.v_{c} + {wide}))" for c in used)
        scored.append(
            f"SELECT r.run_id, '{name}' AS model, r.row_id, r.y, 1 / (1 + exp(-(({like('s1')}) - ({like('s0')})))) AS p FROM nbrows r JOIN nbwide USING (run_id, fold) "
            "JOIN nbfit s0 ON s0.run_id = r.run_id AND s0.fold = r.fold AND s0.y = 0 JOIN nbfit s1 ON s1.run_id = r.run_id AND s1.fold = r.fold AND s1.y = 1"
        )
    others = "FROM nbrows s, generate_series(1, 5) g(left_out) WHERE s.fold <> g.left_out GROUP BY ALL"
    return {
        "subruns": SUBSAMPLE.format(n=252, runs=RUNS, h=SUBSAMPLE_KEY),
        "nbrows": f"""SELECT run_id, row_id, y, x1, x2, x3, ((row_number() OVER (PARTITION BY run_id, y ORDER BY {h32("'fold|1|' || row_id || '|42'")}, row_id) - 1) % 5 + 1)::INT AS fold
  FROM (SELECT run_id, row_id, y FROM subruns UNION ALL SELECT 0 AS run_id, row_id, y FROM labelled) JOIN (SELECT row_id, x1, x2, x3 FROM labelled) USING (row_id)""",
        "nbfit": f"SELECT run_id, g.left_out AS fold, y, count(*) AS n, {stats} {others}",
        "nbwide": f"SELECT run_id, g.left_out AS fold, {', '.join(f'var_pop({c}) AS w_{c}' for c in cols)} {others}",
        "nbscored": "\n  UNION ALL ".join(scored),
        "nbarea": """SELECT run_id, model, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auroc
  FROM (SELECT *, rank() OVER (PARTITION BY run_id, model ORDER BY p) + (count(*) OVER (PARTITION BY run_id, model, p) - 1) / 2e0 AS rk FROM nbscored) GROUP BY ALL""",
    }


def _fact_ctes() -> dict[str, str]:
    """Held-out naive Bayes scores of both editions in four worlds, the attributions of their features, and E."""
    cols = MODELS["nb_123"]
    noise = {c: normal(f"'noise|{c}|' || row_id || '|42'") for c in cols}
    moved = ", ".join(f"CASE w.world WHEN 'noise' THEN {c} + {noise[c]} * 0.2e0 * sd_{c} WHEN 'shift' THEN {c} + 0.3e0 * sd_{c} ELSE {c} END AS {c}" for c in cols)
    others = "FROM folded s, generate_series(1, 3) g(left_out) WHERE s.fold <> g.left_out GROUP BY ALL"
    joined = "FROM moved r JOIN nb_class s0 ON s0.edition = r.edition AND s0.fold = r.fold AND s0.y = 0 JOIN nb_class s1 ON s1.edition = r.edition AND s1.fold = r.fold AND s1.y = 1 JOIN nb_pool q ON q.edition = r.edition AND q.fold = r.fold"
    scored, attributed = [], []
    for name, used in MODELS.items():
        wide = f"1e-9 * greatest({', '.join(f'w_{c}' for c in used)}, 0e0)"
        like = lambda t: f"ln({t}.n::DOUBLE) " + " ".join(f"- 0.5e0 * ln({t}.v_{c} + {wide}) - pow(r.{c} - {t}.a_{c}, 2) / (2 * ({t}.v_{c} + {wide}))" for c in used)
        scored.append(f"SELECT r.edition, '{name}' AS model, world, severity, r.fold, row_id, r.y, 1 / (1 + exp(-(({like('s1')}) - ({like('s0')})))) AS p {joined}")
        if name in ATTRIBUTED:
            far = lambda t, c, x: f"({x}) / (2 * ({t}.v_{c} + {wide}))"
            for c in used:
                here = f"{far('s0', c, f'pow(r.{c} - s0.a_{c}, 2)')} - {far('s1', c, f'pow(r.{c} - s1.a_{c}, 2)')}"
                mean = f"{far('s0', c, f'w_{c} + pow(m_{c} - s0.a_{c}, 2)')} - {far('s1', c, f'w_{c} + pow(m_{c} - s1.a_{c}, 2)')}"
                attributed.append(f"SELECT r.edition, '{name}' AS model, world, r.fold, row_id, '{c}' AS feature, ({here}) - ({mean}) AS value {joined}")
    by = "edition, model, fold, world"
    return {
        "folded": f"SELECT edition, ({h32("'fold|' || row_id")} % 3 + 1)::INT AS fold, row_id, y, {', '.join(cols)} FROM editions",
        "fold_spread": f"SELECT edition, fold, {', '.join(f'coalesce(nullif(stddev_pop({c}), 0), 1e0) AS sd_{c}' for c in cols)} FROM folded GROUP BY ALL",
        "moved": f"""SELECT edition, w.world, w.severity, fold, row_id, CASE WHEN w.world = 'label_noise' AND {u("'flip|' || row_id || '|42'")} < 0.1e0 THEN 1 - y ELSE y END AS y, {moved}
  FROM folded JOIN fold_spread USING (edition, fold), (VALUES ('clean', 0), ('noise', 1), ('shift', 2), ('label_noise', 3)) w(world, severity)""",
        "nb_class": f"SELECT edition, g.left_out AS fold, y, count(*) AS n, {', '.join(f'avg({c}) AS a_{c}, var_pop({c}) AS v_{c}' for c in cols)} {others}",
        "nb_pool": f"SELECT edition, g.left_out AS fold, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS w_{c}' for c in cols)} {others}",
        "predictions": "\n  UNION ALL ".join(scored),
        "scored": "SELECT edition, model, fold, row_id, y, p FROM predictions WHERE world = 'clean'",
        "attributions": "\n  UNION ALL ".join(attributed),
        "attr_pairs": f"SELECT {by}, row_id, feature, a.value, b.value AS v0 FROM attributions a JOIN (SELECT edition, model, fold, row_id, feature, value FROM attributions WHERE world = 'clean') b USING (edition, model, fold, row_id, feature) WHERE a.world IN ('noise', 'shift')",
        **stability_ctes("attr_pairs", by, "edition, model, fold", "e_fold"),
    }


def stability_ctes(pairs: str, by: str, over: str, name: str, k: int = 2) -> dict[str, str]:
    """Cosine, rank agreement and top-k overlap of pairs(by, row_id, feature, value, v0), and as `name` their means over worlds."""
    top = lambda x: f"row_number() OVER (PARTITION BY {by} ORDER BY {x} DESC, feature) <= {k}"
    return {
        f"{name}_cos": f"SELECT {by}, (avg(c) + 1) / 2 AS cosine FROM (SELECT {by}, row_id, sum(value * v0) / nullif(sqrt(sum(value * value) * sum(v0 * v0)), 0) AS c FROM {pairs} GROUP BY ALL) GROUP BY ALL",
        f"{name}_mean": f"SELECT {by}, feature, avg(abs(value)) AS ma, avg(abs(v0)) AS m0 FROM {pairs} GROUP BY ALL",
        f"{name}_rank": f"SELECT {by}, corr(ra, rb) AS spearman FROM (SELECT {by}, {average_rank(by, 'ma')} AS ra, {average_rank(by, 'm0')} AS rb FROM {name}_mean) GROUP BY ALL",
        f"{name}_top": f"SELECT {by}, count(*) FILTER (ia AND ib) / nullif(count(*) FILTER (ia OR ib)::DOUBLE, 0) AS jaccard FROM (SELECT {by}, {top('ma')} AS ia, {top('m0')} AS ib FROM {name}_mean) GROUP BY ALL",
        name: f"""SELECT {over}, avg(cosine) AS E_cos, avg((coalesce(spearman, 0) + 1) / 2) AS E_rank, avg(jaccard) AS E_jaccard,
  (avg(cosine) + avg((coalesce(spearman, 0) + 1) / 2) + avg(jaccard)) / 3 AS E_mix FROM {name}_cos JOIN {name}_rank USING ({by}) JOIN {name}_top USING ({by}) GROUP BY ALL""",
    }


def linear_ctes(rows: str, by: str = "") -> dict[str, str]:
    """Least squares of y on x1, x2, x3 in each group of rows, by Cramer's rule on the covariances."""
    xs, group = ["x1", "x2", "x3"], f"{by}, " if by else ""
    cov = ", ".join([f"covar_pop({a}, {b}) AS c{i}{j}" for i, a in enumerate(xs, 1) for j, b in enumerate(xs, 1)] + [f"covar_pop({a}, y) AS d{i}, avg({a}) AS m{i}" for i, a in enumerate(xs, 1)])
    minor = lambda i, j: (lambda r, c: f"(c{r[0]}{c[0]} * c{r[1]}{c[1]} - c{r[0]}{c[1]} * c{r[1]}{c[0]})")([k for k in (1, 2, 3) if k != i], [k for k in (1, 2, 3) if k != j])
    inverse = ", ".join(f"{'-' if (i + j) % 2 else ''}{minor(i, j)} / det AS i{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    coef = ", ".join(f"i{i}1 * d1 + i{i}2 * d2 + i{i}3 * d3 AS b{i}" for i in (1, 2, 3))
    return {
        "lin_cov": f"SELECT {group}count(*) AS n, avg(y) AS my, var_pop(y) AS vy, {cov} FROM {rows}{' GROUP BY ALL' if by else ''}",
        "lin_det": f"SELECT *, c11 * {minor(1, 1)} - c12 * {minor(1, 2)} + c13 * {minor(1, 3)} AS det FROM lin_cov",
        "lin_inv": f"SELECT *, {inverse} FROM lin_det",
        "lin": f"SELECT *, {coef} FROM lin_inv",
    }


CTES = {
    "labelled": """SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS y, o_totalprice::DOUBLE AS x1, c_acctbal::DOUBLE AS x2,
  c_nationkey::DOUBLE AS x3, o_orderpriority AS k1, c_mktsegment AS k2 FROM orders JOIN customer ON o_custkey = c_custkey""",
    "editions": "SELECT *, 'full' AS edition FROM labelled UNION ALL SELECT *, 'demo' AS edition FROM labelled WHERE row_id % 20 = 0",
    **_fact_ctes(),
    **linear_ctes("labelled"),
    "held": f"SELECT {KEYS}, y, least(greatest(p, 1e-7), 1e0 - 1e-7) AS p FROM predictions",
    "by_score": f"SELECT {KEYS}, p, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM held GROUP BY ALL",
    "cumulated": f"""SELECT *, coalesce(sum(neg) OVER low, 0) AS neg_low, coalesce(sum(pos) OVER low, 0) AS pos_low, sum(pos) OVER whole AS all_pos, sum(neg) OVER whole AS all_neg
  FROM by_score WINDOW low AS (PARTITION BY {KEYS} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), whole AS (PARTITION BY {KEYS})""",
    "areas": f"""SELECT {KEYS}, sum(pos * (neg_low + neg / 2)) / nullif(max(all_pos) * max(all_neg), 0) AS auroc,
  sum(pos * (all_pos - pos_low) / ((all_pos - pos_low) + (all_neg - neg_low))) / nullif(max(all_pos), 0) AS auprc FROM cumulated GROUP BY ALL""",
    "plain": f"SELECT {KEYS}, avg((p - y) * (p - y)) AS brier, avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS log_loss, count(*) AS n_eval, avg(y) AS prevalence FROM held GROUP BY ALL",
    "curve": f"SELECT {KEYS}, bin, avg(p) AS p_mean, avg(y) AS y_mean, count(*) AS n FROM (SELECT *, {binned('p', arr(EDGES15))} AS bin FROM held) WHERE bin BETWEEN 0 AND 14 GROUP BY ALL",
    "eces": f"SELECT {KEYS}, sum(abs(y_mean - p_mean) * n) / sum(n) AS ece FROM curve GROUP BY ALL",
    "cuts": f"SELECT {KEYS}, list_concat([0e0], quantile_cont(p, {arr(INNER15)}), [1e0]) AS cut FROM held GROUP BY ALL",
    "acurve": f"""SELECT {KEYS}, greatest(0, least(len(list_filter(cut, lambda e: e < p)) - 1, 14)) AS bin, avg(p) AS p_mean, avg(y) AS y_mean, count(*) AS n
  FROM held JOIN cuts USING ({KEYS}) GROUP BY ALL""",
    "aeces": f"SELECT {KEYS}, sum(abs(y_mean - p_mean) * n) / sum(n) AS aece FROM acurve GROUP BY ALL",
    "murphy": f"""SELECT {KEYS}, sum(n * pow(p_mean - y_mean, 2)) / sum(n) AS brier_rel, sum(n * pow(y_mean - prevalence, 2)) / sum(n) AS brier_res,
  max(prevalence * (1 - prevalence)) AS brier_unc FROM acurve JOIN plain USING ({KEYS}) GROUP BY ALL""",
    "facts": f"SELECT * FROM plain JOIN areas USING ({KEYS}) JOIN eces USING ({KEYS}) JOIN aeces USING ({KEYS}) JOIN murphy USING ({KEYS})",
    "clean_facts": "SELECT edition, model, fold, auroc AS auc0, ece AS ece0 FROM facts WHERE world = 'clean'",
    "ln_facts": "SELECT edition, model, fold, auroc AS auc_ln FROM facts WHERE world = 'label_noise'",
    "parts": """SELECT edition, fold, model, max(auc0) AS R, least(greatest(max(auc_ln) / (max(auc0) + 1e-12), 0e0), 1e0) AS Q_label,
  least(greatest(1 - avg(greatest(0e0, auc0 - auroc)), 0e0), 1e0) AS S_drop, avg(least(greatest(auroc / (auc0 + 1e-12), 0e0), 1e0)) AS S_ratio,
  avg(exp(-abs(ece - ece0) / (ece0 + 1e-12))) AS C_exp, least(greatest(1 - avg(least(1e0, abs(ece - ece0) / (ece0 + 1e-12))), 0e0), 1e0) AS C_linear
  FROM facts JOIN clean_facts USING (edition, model, fold) JOIN ln_facts USING (edition, model, fold) WHERE world IN ('noise', 'shift') GROUP BY edition, fold, model""",
    "parts_e": "SELECT parts.*, E_mix AS E FROM parts LEFT JOIN (SELECT edition, model, fold, E_mix FROM e_fold) USING (edition, model, fold)",
    "summary": "SELECT edition, model, avg(R) AS R, avg(S_drop) AS S_drop, avg(S_ratio) AS S_ratio, avg(C_exp) AS C_exp, avg(C_linear) AS C_linear, avg(E) AS E FROM parts_e GROUP BY ALL",
    "scores": "SELECT edition, model, (0.4e0 * R + 0.3e0 * S_drop + 0.2e0 * C_exp + 0.1e0 * coalesce(E, 0)) / (0.4e0 + 0.3e0 + 0.2e0 + 0.1e0) AS score FROM summary",
    "fold_scores": "SELECT edition, fold, model, (0.4e0 * R + 0.3e0 * S_drop + 0.2e0 * C_exp + 0.1e0 * coalesce(E, 0)) / (0.4e0 + 0.3e0 + 0.2e0 + 0.1e0) AS score, (0.4e0 * R + 0.3e0 * S_drop + 0.2e0 * C_exp + 0.1e0 * E) / (0.4e0 + 0.3e0 + 0.2e0 + 0.1e0) AS score_e FROM parts_e",
    "fold_deltas": "SELECT f.model, f.fold, f.score - d.score AS d FROM fold_scores f JOIN fold_scores d ON f.model = d.model AND f.fold = d.fold WHERE f.edition = 'full' AND d.edition = 'demo'",
    "metric_long": f"UNPIVOT (SELECT {KEYS}, auroc, brier, log_loss, ece, aece FROM facts) ON auroc, brier, log_loss, ece, aece INTO NAME metric VALUE value",
    "metric_deltas": """SELECT f.model, f.world, f.fold, f.metric, f.value - d.value AS d FROM metric_long f JOIN metric_long d
  ON f.model = d.model AND f.world = d.world AND f.fold = d.fold AND f.metric = d.metric WHERE f.edition = 'full' AND d.edition = 'demo'""",
    "thresholds": """SELECT edition, model, g.left_out::INT AS fold, coalesce(quantile_cont(p, 1e0 - 0.8e0) FILTER (y = 1), 1e0) AS thr
  FROM predictions, generate_series(1, 3) g(left_out) WHERE world = 'clean' AND fold <> g.left_out GROUP BY ALL""",
    "pi_ref": "SELECT avg(y) AS pi FROM labelled",
    "conf": """SELECT edition, model, fold, thr, count(*) FILTER (p >= thr AND y = 1) AS tp, count(*) FILTER (p >= thr AND y = 0) AS fp, count(*) FILTER (p < thr AND y = 0) AS tn,
  count(*) FILTER (p < thr AND y = 1) AS fn FROM predictions JOIN thresholds USING (edition, model, fold) WHERE world = 'clean' GROUP BY ALL""",
    "rates": "SELECT *, tp / nullif((tp + fn)::DOUBLE, 0) AS sens, tn / nullif((tn + fp)::DOUBLE, 0) AS spec, tp / nullif((tp + fp)::DOUBLE, 0) AS ppv FROM conf",
    "ppv_facts": "SELECT *, sens * pi / nullif(sens * pi + (1 - spec) * (1 - pi), 0) AS ppv_std FROM rates, pi_ref",
    **_nb_ctes(),
    "run_scores": "SELECT run_id, model, auroc AS value FROM nbarea WHERE run_id > 0",
    "ref_scores": "SELECT model, auroc AS value FROM nbarea WHERE run_id = 0",
}


def with_ctes(select: str) -> str:
    """select, preceded by the expressions that it needs."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(select)
    if not need:
        return select
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in need)
    return f"WITH {head}\n{select}" if not select.lstrip().upper().startswith("WITH ") else f"WITH {head},\n{select.lstrip()[5:]}"
