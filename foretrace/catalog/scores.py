"""Queries over the prediction log and count forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.catalog.registry import query, r, rounded
from foretrace.functions import scalars as S
from foretrace.functions.counts import over_probability, recency_weight
from foretrace.functions.seasons import season_of_id
from foretrace.operators import facts as X
from foretrace.operators import forecasts as C
from foretrace.operators import scoring as E
from foretrace.session import bounded
from foretrace.sources.views import Views


def scored(v: Views):
    return E.score_rows(v.preds)


_SUMMARY = f"""count(actual_home_win) AS n, count(*) AS n_logged,
  {r("avg(CAST(correct AS DOUBLE))", "accuracy")}, {r("avg(brier)", "brier")},
  CAST(coalesce(sum(CAST(correct AS BIGINT)), 0) AS BIGINT) AS wins,
  CAST(count(actual_home_win) - coalesce(sum(CAST(correct AS BIGINT)), 0) AS BIGINT) AS losses,
  {r("avg(actual_home_win)", "home_win_rate")},
  {r("greatest(avg(actual_home_win), 1 - avg(actual_home_win))", "baseline_accuracy")},
  {r("avg(actual_home_win) * (1 - avg(actual_home_win))", "baseline_brier")}, CAST(0.25 AS DOUBLE) AS coin_flip_brier"""


@query("hist_summary", f"SELECT {_SUMMARY} FROM scored")
def hist_summary(v: Views):
    """Record, Brier and baselines of the whole log."""
    return rounded(E.summarize(scored(v)))


@query("summary_by_model", f"SELECT model_name, season, {_SUMMARY} FROM scored GROUP BY model_name, season")
def summary_by_model(v: Views):
    """The same per model and season."""
    return rounded(E.summarize(scored(v), ["model_name", "season"]))


def _buckets(value: str, edges, labels, lowest: bool) -> str:
    parts = [
        f"WHEN {value} {'>=' if lowest else '>'} {edges[0]} AND {value} <= {hi} THEN '{name}'"
        for hi, name in zip(edges[1:], labels)
    ]
    return f"CASE {' '.join(parts)} END"


@query("calibration_table", f"""SELECT {_buckets('prob_home_win', S.CALIBRATION_EDGES, S.CALIBRATION_LABELS, True)} AS bucket,
  count(*) AS n, {r("avg(prob_home_win)", "predicted")}, {r("avg(actual_home_win)", "actual")}
  FROM scored WHERE actual_home_win IS NOT NULL GROUP BY 1""")
def calibration_table(v: Views):
    """Predicted and actual home-win rate per bucket."""
    return rounded(E.calibration_table(scored(v)))


_TIER = ("CASE WHEN greatest(prob_home_win, 1 - prob_home_win) >= 0.60 THEN 'Strong Pick' "
         "WHEN greatest(prob_home_win, 1 - prob_home_win) >= 0.55 THEN 'Lean' ELSE 'Toss-Up' END")


@query("tier_breakdown", f"""SELECT {_TIER} AS tier, count(*) AS n, {r("avg(CAST(correct AS DOUBLE))", "accuracy")},
  {r("avg(brier)", "brier")} FROM scored WHERE actual_home_win IS NOT NULL GROUP BY 1""")
def tier_breakdown(v: Views):
    """Accuracy and Brier per confidence tier."""
    return rounded(E.tier_breakdown(scored(v)))


@query("confidence_tier", f"SELECT game_id, {_TIER} AS tier FROM preds")
def confidence_tier(v: Views):
    """Tier of every prediction."""
    p = F.col("prob_home_win")
    return v.preds.select("game_id", S.confidence_tier(F.greatest(p, 1 - p)).alias("tier"))


_EDGE = "round(CASE WHEN prob_home_win >= 0.5 THEN prob_home_win - closing_prob_home ELSE closing_prob_home - prob_home_win END, 9)"


@query("edge_realization", f"""SELECT {_buckets(_EDGE, S.EDGE_EDGES, S.EDGE_LABELS, False)} AS bucket, count(*) AS n,
  {r("avg(CASE WHEN prob_home_win >= 0.5 THEN prob_home_win ELSE 1 - prob_home_win END)", "model_said")},
  {r("avg(CASE WHEN prob_home_win >= 0.5 THEN closing_prob_home ELSE 1 - closing_prob_home END)", "market_said")},
  {r("avg(CASE WHEN prob_home_win >= 0.5 THEN actual_home_win ELSE 1 - actual_home_win END)", "actual")}
  FROM scored WHERE actual_home_win IS NOT NULL AND closing_prob_home IS NOT NULL GROUP BY 1""")
def edge_realization(v: Views):
    """Claimed edge against the outcome."""
    return rounded(E.edge_realization(scored(v)))


@query("market_comparison", f"""SELECT count(*) AS n, {r("avg(brier)", "model_brier")},
  {r("avg(power(closing_prob_home - actual_home_win, 2))", "market_brier")},
  {r("avg(CAST((prob_home_win >= 0.5) = (actual_home_win = 1) AS DOUBLE))", "model_accuracy")},
  {r("avg(CAST((closing_prob_home >= 0.5) = (actual_home_win = 1) AS DOUBLE))", "market_accuracy")},
  {r("avg(abs(prob_home_win - closing_prob_home))", "mean_abs_edge")}
  FROM scored WHERE actual_home_win IS NOT NULL AND closing_prob_home IS NOT NULL""")
def market_comparison(v: Views):
    """Model and market on the same games."""
    return rounded(E.market_comparison(scored(v)))


@query("clv_summary", f"""WITH moves AS (SELECT CASE WHEN prob_home_win >= 0.5 THEN closing_prob_home - market_prob_home
    ELSE market_prob_home - closing_prob_home END AS move FROM scored
  WHERE actual_home_win IS NOT NULL AND closing_prob_home IS NOT NULL AND market_prob_home IS NOT NULL)
SELECT count(*) AS n, {r("avg(move)", "mean_clv")}, {r("avg(CAST(move > 0 AS DOUBLE))", "beat_close_rate")} FROM moves""")
def clv_summary(v: Views):
    """Movement of the price toward the pick."""
    return rounded(E.clv_summary(scored(v)))


@query("recent_form", f"""SELECT count(*) AS n, {r("avg(CAST(correct AS DOUBLE))", "accuracy")}, {r("avg(brier)", "brier")},
  CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS wins, CAST(count(*) - sum(CAST(correct AS BIGINT)) AS BIGINT) AS losses
  FROM (SELECT * FROM scored WHERE actual_home_win IS NOT NULL ORDER BY game_date DESC, game_id DESC LIMIT 25)""")
def recent_form(v: Views):
    """Record over the 25 newest played predictions."""
    return rounded(E.recent_form(scored(v), ["game_date", "game_id"]))


@query("coverage_stats", f"""SELECT count(*) AS n, CAST(sum(CASE WHEN feature_coverage < 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n_degraded,
  {r("min(feature_coverage)", "min_coverage")} FROM preds""")
def coverage_stats(v: Views):
    """Predictions made on incomplete features."""
    return rounded(E.coverage_stats(v.preds))


@query("edge_ranking", f"""SELECT game_id, CASE WHEN prob_home_win >= 0.5 THEN home_id ELSE away_id END AS pick,
  CASE WHEN prob_home_win >= 0.5 THEN away_id ELSE home_id END AS against,
  {r("CASE WHEN prob_home_win >= 0.5 THEN prob_home_win ELSE 1 - prob_home_win END", "model_p")},
  {r("CASE WHEN prob_home_win >= 0.5 THEN market_prob_home ELSE 1 - market_prob_home END", "market_p")},
  {r(_EDGE.replace("closing_prob_home", "market_prob_home"), "edge")}, {_TIER} AS confidence
  FROM preds WHERE {_EDGE.replace("closing_prob_home", "market_prob_home")} >= 0.03""")
def edge_ranking(v: Views):
    """Disagreements with the market of three points or more."""
    return rounded(E.edge_ranking(v.preds))


@query("day_report", f"""SELECT game_id, model_name, CASE WHEN prob_home_win >= 0.5 THEN home_id ELSE away_id END AS pick,
  {r("greatest(prob_home_win, 1 - prob_home_win)", "prob")}, {_TIER} AS confidence, correct, {r("brier")},
  {r("closing_prob_home")}, NOT correct AND {_TIER} = 'Strong Pick' AS strong_miss
  FROM scored WHERE actual_home_win IS NOT NULL
  AND game_date = (SELECT max(game_date) FROM scored WHERE actual_home_win IS NOT NULL)""")
def day_report(v: Views):
    """Every pick of the newest played night."""
    rows = scored(v)
    return rounded(E.day_games(rows, E.latest_played_date(rows)))


_FRESH = "CASE WHEN m.game_id % 11 = 0 THEN NULL ELSE m.home_win END"


@query("attach_outcomes", f"""WITH log AS (SELECT game_id, model_name, prob_home_win,
    CASE WHEN game_id % 3 = 0 THEN actual_home_win END AS stored FROM preds),
joined AS (SELECT l.*, coalesce({_FRESH}, l.stored) AS actual FROM log l LEFT JOIN (SELECT * FROM matches WHERE game_id % 7 > 0) m
    ON l.game_id = m.game_id)
SELECT game_id, model_name, {r("prob_home_win")}, {r("actual", "actual_home_win")},
  CASE WHEN actual IS NOT NULL THEN (prob_home_win >= 0.5) = (actual = 1) END AS correct,
  {r("power(prob_home_win - actual, 2)", "brier")} FROM joined""")
def attach_outcomes(v: Views):
    """Fresh results win, stored results survive."""
    log = v.preds.select(
        "game_id", "model_name", "prob_home_win",
        F.when(F.col("game_id") % 3 == 0, F.col("actual_home_win")).alias("actual_home_win"))
    fresh = v.matches.where("game_id % 7 > 0").select(
        "game_id", F.when(F.col("game_id") % 11 != 0, F.col("home_win")).alias("home_win"))
    return rounded(E.attach_outcomes(log, fresh))


@query("hist_filters", """SELECT game_id, model_name FROM preds WHERE season = 1998 AND actual_home_win IS NOT NULL
  AND game_date >= DATE '1998-03-01'""")
def hist_filters(v: Views):
    """Season, played and date filters, all pushed to the scan."""
    return E.played(v.preds.where((F.col("season") == 1998) & (F.col("game_date") >= F.lit("1998-03-01").cast("date")))).select(
        "game_id", "model_name")


@query("effective_date", """SELECT game_id, coalesce(CASE WHEN game_id % 4 > 0 THEN CAST(game_date AS VARCHAR) END,
  substr(CAST(game_date AS VARCHAR) || 'T23:40:00Z', 1, 10)) AS effective_date FROM preds""")
def effective_date(v: Views):
    """Game date, else the date part of the prediction stamp."""
    day = F.col("game_date").cast("string")
    return v.preds.select("game_id", S.effective_date(
        F.when(F.col("game_id") % 4 > 0, day), F.concat(day, F.lit("T23:40:00Z"))).alias("effective_date"))


@query("season_tag", """SELECT game_id, CASE WHEN game_id % 9 > 0
  THEN CAST(season AS VARCHAR) || '-' || CAST(season + 1 AS VARCHAR) END AS season_label FROM preds""")
def season_tag(v: Views):
    """Season label read from an id; a malformed id gives null."""
    text = F.when(F.col("game_id") % 9 > 0, F.concat(F.col("season").cast("string"), F.lit("020001"))).otherwise("bad!id")
    return v.preds.select("game_id", season_of_id(text).alias("season_label"))


_CELLS = """cells AS (SELECT model_name, season, prob_home_win AS p, actual_home_win AS y FROM preds WHERE actual_home_win IS NOT NULL),
sizes AS (SELECT model_name, season, count(*) AS n, sum(y) AS pos FROM cells GROUP BY ALL),
naive AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS n_train, sum(pos) OVER w / sum(n) OVER w AS rate FROM sizes
  WINDOW w AS (PARTITION BY model_name ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranks AS (SELECT *, rank() OVER (PARTITION BY model_name, season ORDER BY p)
  + (count(*) OVER (PARTITION BY model_name, season, p) - 1) / 2.0 AS avg_rank FROM cells)"""
_FOLDS = f"""folds AS (SELECT c.model_name, c.season, n.n_train, n.n AS n_test, avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS accuracy,
  avg(power(p - y, 2)) AS brier, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss,
  (sum(CASE WHEN y = 1 THEN avg_rank END) - n.pos * (n.pos + 1) / 2) / (n.pos * (n.n - n.pos)) AS roc_auc,
  avg(CASE WHEN (y = 1 AND p > n.rate) OR (y = 0 AND p < n.rate) THEN 1.0 ELSE 0.0 END) AS beat_naive_rate,
  avg(power(n.rate - y, 2)) AS naive_brier
  FROM ranks c JOIN naive n ON c.model_name = n.model_name AND c.season = n.season WHERE n.n_train IS NOT NULL
  GROUP BY c.model_name, c.season, n.n_train, n.n, n.pos, n.rate)"""
_NAMES = ["accuracy", "brier", "log_loss", "roc_auc", "beat_naive_rate", "naive_brier"]


@query("fold_metrics", f"WITH {_CELLS}, {_FOLDS} SELECT model_name, season, n_train, n_test, {', '.join(r(c) for c in _NAMES)} FROM folds")
def fold_metrics(v: Views):
    """Walk-forward metrics per model and season."""
    return rounded(E.fold_metrics(v.preds, ["model_name"], "season", v.rows("orders")))


@query("fold_wavg", f"WITH {_CELLS}, {_FOLDS} SELECT model_name, count(*) AS n_folds, "
       + ", ".join(r(f"sum({c} * n_test) / sum(n_test)", c) for c in _NAMES) + " FROM folds GROUP BY model_name")
def fold_wavg(v: Views):
    """Fold metrics averaged by test size."""
    folds = E.fold_metrics(v.preds, ["model_name"], "season", v.rows("orders"))
    return rounded(E.fold_average(folds, ["model_name"]))


def counts(v: Views):
    """Shot counts of a team-game with a rate forecast."""
    return X.team_totals(v.shots).select(
        "game_id", "team_id", "season", F.col("shots_for").alias("y"),
        (0.5 + ((F.col("team_id") * 13 + F.col("game_id")) % 300).cast("double") / 100).alias("pred"))


_COUNTS = """counts AS (SELECT game_id, team_id, season, shots_for AS y,
  0.5 + CAST((team_id * 13 + game_id) % 300 AS DOUBLE) / 100 AS pred FROM team_agg)"""


def _poisson(mu: str, k: int) -> str:
    return f"1 - list_sum(list_transform(range(0, {k + 1}), lambda i: exp(-{mu} + i * ln({mu}) - lgamma(i + 1))))"


def _negbin(mu: str, k: int, d: float) -> str:
    n = f"CAST({1 / d} AS DOUBLE)"
    return (f"1 - list_sum(list_transform(range(0, {k + 1}), lambda i: exp(lgamma(i + {n}) - lgamma({n}) - lgamma(i + 1) "
            f"+ {n} * ln({n} / ({n} + {mu})) + i * ln({mu} / ({n} + {mu})))))")


@query("over_prob_poisson", f"WITH {_COUNTS} SELECT game_id, team_id, " + ", ".join(
    r(_poisson("pred", k), f"p_over_{k}") for k in (1, 2, 3)) + " FROM counts")
def over_prob_poisson(v: Views):
    """P(count > line) at 1.5, 2.5 and 3.5."""
    return rounded(counts(v).select("game_id", "team_id", *[
        over_probability(F.col("pred"), k + 0.5).alias(f"p_over_{k}") for k in (1, 2, 3)]))


@query("over_prob_nb", f"WITH {_COUNTS} SELECT game_id, team_id, " + ", ".join(
    r(_negbin("(pred * 10)", k, 0.03258), f"p_over_{k}") for k in (22, 24, 27, 30)) + " FROM counts")
def over_prob_nb(v: Views):
    """P(count > line) with over-dispersion, at the lines of a larger count."""
    return rounded(counts(v).select("game_id", "team_id", *[
        over_probability(F.col("pred") * 10, k + 0.5, 0.03258).alias(f"p_over_{k}") for k in (22, 24, 27, 30)]))


def _line(k: int, group: str) -> str:
    p, a = _poisson("pred", k), f"CASE WHEN y > {k}.5 THEN 1.0 ELSE 0.0 END"
    rate = f"avg({a})"
    return f"""SELECT {group} CAST({k}.5 AS DOUBLE) AS line, count(*) AS n, avg(power({p} - {a}, 2)) AS brier,
  {rate} * {rate} - 2 * {rate} * {rate} + {rate} AS brier_base,
  avg(CAST(({p} > 0.5) = (y > {k}.5) AS DOUBLE)) AS accuracy, greatest({rate}, 1 - {rate}) AS acc_base, {rate} AS over_rate
  FROM counts {'GROUP BY season' if group else ''}"""


_LINE_COLS = ["brier", "brier_base", "accuracy", "acc_base", "over_rate"]


@query("count_scoring", f"WITH {_COUNTS}, lines AS ({' UNION ALL '.join(_line(k, '') for k in (1, 2, 3))}) "
       f"SELECT line, n, {', '.join(r(c) for c in _LINE_COLS)} FROM lines")
def count_scoring(v: Views):
    """Count forecasts against climatology and the majority, per line."""
    return rounded(C.count_scoring(counts(v), [1.5, 2.5, 3.5]))


@query("line_skill", f"WITH {_COUNTS}, lines AS ({' UNION ALL '.join(_line(k, 'season,') for k in (1, 2, 3))}) SELECT line, "
       + ", ".join(r(f"avg({c})", c) for c in _LINE_COLS) + ", " + r("1 - avg(brier) / avg(brier_base)", "skill")
       + " FROM lines GROUP BY line")
def line_skill(v: Views):
    """Line scores averaged over seasons."""
    return rounded(C.line_skill(C.count_scoring(counts(v), [1.5, 2.5, 3.5], ["season"])))


@query("count_errors", f"WITH {_COUNTS} SELECT season, count(*) AS n, {r('avg(abs(y - pred))', 'mae')}, "
       f"{r('sqrt(avg(power(y - pred, 2)))', 'rmse')}, {r('avg(pred) - avg(y)', 'bias')} FROM counts GROUP BY season")
def count_errors(v: Views):
    """MAE, RMSE and bias per season."""
    return rounded(C.count_errors(counts(v), ["season"]))


@query("nb_dispersion", f"""WITH {_COUNTS} SELECT season,
  {r("greatest(avg(power(y - pred, 2) - pred) / avg(pred * pred), 0)", "dispersion")} FROM counts GROUP BY season""")
def nb_dispersion(v: Views):
    """Method-of-moments dispersion per season."""
    return rounded(C.nb_dispersion(counts(v), ["season"]))


@query("drift_factor", f"""WITH {_COUNTS} SELECT team_id, season, count(*) AS n,
  {r("CASE WHEN count(*) >= 40 THEN avg(y) / avg(pred) ELSE 1.0 END", "factor")} FROM counts GROUP BY team_id, season""")
def drift_factor(v: Views):
    """Actual over forecast mean, one for small samples."""
    return rounded(C.drift_factor(counts(v), ["team_id", "season"], min_sample=40))


@query("apply_factor", f"""WITH {_COUNTS}, f AS (SELECT season, avg(y) / avg(pred) AS factor FROM counts GROUP BY season)
SELECT game_id, team_id, {r("pred * factor", "pred")} FROM counts JOIN f USING (season)""")
def apply_factor(v: Views):
    """Forecasts scaled by their season's factor."""
    rows = counts(v)
    return rounded(C.apply_factor(rows, C.drift_factor(rows, ["season"]), ["season"]).select("game_id", "team_id", "pred"))


@query("recency_weight", f"""WITH ages AS (SELECT season, row_number() OVER (ORDER BY season DESC) - 1 AS age
  FROM (SELECT DISTINCT season FROM matches))
SELECT game_id, {r("power(0.5, age / 0.5)", "weight")} FROM matches JOIN ages USING (season)""")
def recency_weight_query(v: Views):
    """Training weight by season age, half-life half a season."""
    from foretrace.operators.models import season_ages

    ages = bounded(season_ages(v.matches))
    return rounded(v.matches.join(ages, "season").select("game_id", recency_weight(F.col("age"), 0.5).alias("weight")))


@query("null_profile", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'null_rate')}, "
    f"{r(f'avg({c})', 'mean')}, {r(f'CAST(min({c}) AS DOUBLE)', 'min')}, {r(f'CAST(max({c}) AS DOUBLE)', 'max')} FROM shots"
    for c in ("xg", "goal", "sog", "distance", "goalie_id")) + ")")
def null_profile(v: Views):
    """Null rate and range of the shot columns in one pass."""
    return rounded(E.null_profile(v.shots, ["xg", "goal", "sog", "distance", "goalie_id"]))
