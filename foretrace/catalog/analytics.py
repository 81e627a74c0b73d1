"""Queries over the studies of scored rows and players."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.catalog.registry import RAW, query, r, rounded
from foretrace.catalog.scores import scored
from foretrace.catalog.windows import W1
from foretrace.functions import scalars as S
from foretrace.operators import analytics as A
from foretrace.operators import facts as X
from foretrace.operators import features as Y
from foretrace.operators.history import games_before, with_history
from foretrace.sources.views import Views

_GAMES = f"played AS (SELECT game_id, is_home, row_number() OVER ({W1}) - 1 AS games_played FROM sides)"


@query("by_experience", f"""WITH {_GAMES} SELECT CASE WHEN games_played >= 40 THEN 40 WHEN games_played >= 20 THEN 20 WHEN games_played >= 10 THEN 10 ELSE 0 END::BIGINT AS bucket,
  count(*) AS n, count(brier) AS n_played, {r('avg(brier)', 'brier')}, {r('avg(feature_coverage)', 'mean_coverage')},
  {r(f'avg(CAST(feature_coverage >= {S.MIN_FEATURE_COVERAGE} AS DOUBLE))', 'share_covered')}
FROM scored s JOIN played p ON s.game_id = p.game_id AND p.is_home GROUP BY 1""")
def by_experience(v: Views):
    """Brier and feature coverage by how many games the home team had played."""
    games = with_history(v.sides, Y.BY_SEASON, Y.IN_SEASON, [games_before()], v.match_bound).where("is_home").select("game_id", "games_played")
    return rounded(A.by_experience(scored(v).join(games, "game_id")))




def _mixed(x: str, name: str) -> str:
    """Columns that end in the 32-bit mix of x."""
    return f"""(({x}) & 4294967295)::UBIGINT AS {name}0, (xor({name}0, {name}0 >> 16) * {A.MIX[0]}) & 4294967295 AS {name}1,
  (xor({name}1, {name}1 >> 13) * {A.MIX[1]}) & 4294967295 AS {name}2, xor({name}2, {name}2 >> 16) AS {name}"""


@query("brier_bootstrap", f"""WITH sample AS (SELECT brier - power(closing_prob_home - actual_home_win, 2) AS d, game_id::UBIGINT AS k
  FROM scored WHERE brier IS NOT NULL AND closing_prob_home IS NOT NULL AND actual_home_win IS NOT NULL),
hashed AS (SELECT d, {_mixed(f'(k >> 32) + {A.GOLDEN}', 'a')}, {_mixed('xor(a, k & 4294967295)', 'h')} FROM sample),
drawn AS (SELECT d, h, unnest(range(0, 201)) AS replicate FROM hashed),
numbers AS (SELECT d, replicate, {_mixed(f'h + replicate::UBIGINT * {A.GOLDEN}', 'x')}, x / 4294967296.0::DOUBLE AS u FROM drawn),
weighted AS (SELECT replicate, d, CASE WHEN replicate = 0 THEN 1 ELSE {' + '.join(f"CAST(u >= {p}::DOUBLE AS BIGINT)" for p in A.POISSON_STEPS)} END AS w FROM numbers),
means AS (SELECT replicate, count(*) AS n, sum(d * w) / sum(w) AS mean FROM weighted GROUP BY replicate)
SELECT max(n) AS n, {r('max(mean) FILTER (replicate = 0)', 'difference')}, {r('quantile_cont(mean, 0.025) FILTER (replicate > 0)', 'low')},
  {r('quantile_cont(mean, 0.975) FILTER (replicate > 0)', 'high')} FROM means""")
def brier_bootstrap(v: Views):
    """Brier difference to the closing price with a bootstrap interval of 200 resamples."""
    return rounded(A.brier_difference(scored(v)))


@query("pair_lift", f"""WITH met AS (SELECT a.player_id AS p1, b.player_id AS p2, CAST(a.sog AS DOUBLE) AS x, CAST(b.sog AS DOUBLE) AS y
  FROM player_games a JOIN player_games b ON a.game_id = b.game_id AND a.team_id = b.team_id AND a.player_id < b.player_id),
sums AS (SELECT p1, p2, count(*) AS n, avg(CAST(x >= 1 AND y >= 1 AS DOUBLE)) AS joint, avg(CAST(x >= 1 AS DOUBLE)) AS h1, avg(CAST(y >= 1 AS DOUBLE)) AS h2,
  avg(x * y) AS xy, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(y * y) AS yy FROM met GROUP BY p1, p2 HAVING count(*) >= 3),
spread AS (SELECT *, sqrt(greatest((xx - mx * mx) * (yy - my * my), 0)) AS s FROM sums)
SELECT p1, p2, n, {r('CASE WHEN s > 1e-9 THEN (xy - mx * my) / s END', 'correlation')}, {r('CASE WHEN h1 * h2 <> 0 THEN joint / (h1 * h2) END', 'lift')} FROM spread""")
def pair_lift(v: Views):
    """Correlation and lift of team-mates' shots who met three times or more."""
    return rounded(A.pair_lift(X.player_games(v.shots), least_games=3))


_ROWS = RAW["edge_realization"]
_BUCKET = _ROWS[len("SELECT "):_ROWS.index(" AS bucket")]
_Z = "(wins - expected) / sqrt(variance)"
_T = f"(1 / (1 + 0.3275911 * abs({_Z}) / sqrt(2.0)))"


@query("edge_p_values", f"""WITH picks AS (SELECT {_BUCKET} AS bucket, CASE WHEN prob_home_win >= 0.5 THEN closing_prob_home ELSE 1 - closing_prob_home END AS m,
  CASE WHEN prob_home_win >= 0.5 THEN actual_home_win ELSE 1 - actual_home_win END AS won
  FROM scored WHERE actual_home_win IS NOT NULL AND closing_prob_home IS NOT NULL),
sums AS (SELECT bucket, count(*) AS n, sum(won) AS wins, sum(m) AS expected, sum(m * (1 - m)) AS variance FROM picks GROUP BY bucket)
SELECT bucket, n, {r('wins')}, {r('expected')}, {r(_Z, 'z')},
  {r(f'{_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-power({_Z}, 2) / 2)', 'p_value')} FROM sums""")
def edge_p_values(v: Views):
    """Wins against the closing price's expectation per edge bucket, with p-values."""
    return rounded(A.edge_p_values(scored(v)))
