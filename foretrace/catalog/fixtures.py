"""The same views as SQL text, for the oracle side of every check."""

VIEWS = {
    "matches": """
  SELECT o_orderkey AS game_id,
         CAST(year(o_orderdate) AS BIGINT) AS season,
         CAST(o_orderdate AS DATE) AS game_date,
         CAST(CASE WHEN o_orderkey % 20 = 0 THEN 30000 ELSE 20000 END + dayofyear(o_orderdate) AS BIGINT) AS game_num,
         CASE WHEN o_orderkey % 20 = 0 THEN 'P' ELSE 'R' END AS game_type,
         o_custkey // 256 AS league,
         o_custkey // 16 AS home_id,
         (o_custkey // 256) * 16 + ((o_custkey // 16) % 16 + 1 + o_orderkey % 15) % 16 AS away_id,
         CASE WHEN o_orderkey % 50 = 7 THEN NULL
              WHEN o_totalprice > 230000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS home_win,
         CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS BIGINT) AS went_to_ot,
         CASE o_orderstatus WHEN 'F' THEN 'OFF' WHEN 'O' THEN 'FUT' ELSE 'LIVE' END AS game_state,
         CAST(floor(o_totalprice / 1000) AS BIGINT) % 7 AS home_score,
         CAST(floor(o_totalprice / 7000) AS BIGINT) % 6 AS away_score
  FROM orders""",
    "sides": """
  SELECT game_id, season, game_date, game_num, game_type, league,
         home_id AS team_id, away_id AS opp_id, TRUE AS is_home, home_win AS won FROM matches
  UNION ALL
  SELECT game_id, season, game_date, game_num, game_type, league,
         away_id, home_id, FALSE, 1 - home_win FROM matches""",
    "shots": """
  SELECT m.game_id, m.season, m.game_num, m.game_date, m.game_type, m.home_id, m.away_id,
         l_linenumber % 2 = 1 AS is_home,
         CASE WHEN l_linenumber % 2 = 1 THEN m.home_id ELSE m.away_id END AS team_id,
         CASE WHEN l_linenumber % 2 = 1 THEN m.away_id ELSE m.home_id END AS def_team_id,
         CASE WHEN l_linenumber % 2 = 1 THEN m.home_id ELSE m.away_id END * 20 + l_partkey % 20 AS player_id,
         CASE WHEN l_partkey % 97 = 0 THEN NULL
              ELSE CASE WHEN l_linenumber % 2 = 1 THEN m.away_id ELSE m.home_id END * 2
                   + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END END AS goalie_id,
         CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_discount END AS xg,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS goal,
         CAST(CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS sog,
         l_quantity AS distance,
         CAST(CASE WHEN l_partkey % 10 = 0 THEN 4 ELSE 5 END AS BIGINT) AS home_skaters,
         CAST(CASE WHEN l_suppkey % 7 = 0 THEN 4 ELSE 5 END AS BIGINT) AS away_skaters,
         CAST(CASE WHEN m.went_to_ot = 1 AND l_linenumber >= 6 THEN 4
              ELSE 1 + l_linenumber % 3 END AS BIGINT) AS period,
         CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_no, l_suppkey AS supp_no
  FROM lineitem JOIN matches m ON l_orderkey = m.game_id""",
    "quotes0": """
  SELECT l_orderkey AS game_id, l_suppkey % 5 AS book,
         min(CAST(floor(l_extendedprice) AS BIGINT) % 201 - 100) AS raw, max(l_quantity) AS total
  FROM lineitem GROUP BY l_orderkey, l_suppkey % 5""",
    "quotes1": """
  SELECT game_id, book, total, CASE WHEN raw >= 0 THEN 100 + raw ELSE raw - 100 END AS home_ml FROM quotes0""",
    "quotes": """
  SELECT game_id, book, total, home_ml,
         CASE WHEN home_ml > 0 THEN -(home_ml + 20)
              WHEN home_ml <= -120 THEN -home_ml - 20 ELSE -110 END AS away_ml
  FROM quotes1""",
    "preds": """
  SELECT game_id, season, game_date, home_id, away_id, home_win AS actual_home_win,
         CASE WHEN game_id % 3 = 0 THEN 'model_b' ELSE 'model_a' END AS model_name,
         CAST(0.30 AS DOUBLE) + CAST((game_id * 7919) % 400 AS DOUBLE) / 1000 AS prob_home_win,
         CAST(0.35 AS DOUBLE) + CAST((game_id * 6101) % 300 AS DOUBLE) / 1000 AS market_prob_home,
         CASE WHEN game_id % 4 = 0 THEN NULL
              ELSE CAST(0.35 AS DOUBLE) + CAST((game_id * 4517) % 300 AS DOUBLE) / 1000 END AS closing_prob_home,
         CAST(0.60 AS DOUBLE) + CAST(game_id % 41 AS DOUBLE) / 100 AS feature_coverage
  FROM matches""",
    "team_agg": """
  SELECT game_id, season, game_num, game_date, game_type, team_id, is_home, home_id, away_id,
         CASE WHEN team_id = home_id THEN away_id ELSE home_id END AS opp_id,
         coalesce(sum(xg), 0) AS xg_for,
         coalesce(sum(CASE WHEN home_skaters = 5 AND away_skaters = 5 THEN xg ELSE 0 END), 0) AS xg_for_5v5,
         CAST(sum(goal) AS BIGINT) AS goals_for, CAST(sum(sog) AS BIGINT) AS shots_for,
         count(*) AS corsi_for,
         CAST(sum(CASE WHEN distance < 20 THEN 1 ELSE 0 END) AS BIGINT) AS hd_chances_for,
         CAST(sum(CASE WHEN distance < 20 THEN goal ELSE 0 END) AS BIGINT) AS hd_goals_for
  FROM shots GROUP BY ALL""",
    "team_pairs": """
  SELECT a.*, b.xg_for AS xg_against, b.xg_for_5v5 AS xg_against_5v5, b.goals_for AS goals_against,
         b.shots_for AS shots_against, b.corsi_for AS corsi_against,
         b.hd_chances_for AS hd_chances_against, b.hd_goals_for AS hd_goals_against
  FROM team_agg a LEFT JOIN team_agg b ON a.game_id = b.game_id AND a.opp_id = b.team_id""",
    "ot_games": """
  SELECT game_id FROM shots WHERE game_type = 'R' GROUP BY game_id HAVING max(period) > 3""",
    "team_games": """
  SELECT p.*,
         xg_for / (xg_for + xg_against + 1e-9) AS xgf_pct,
         xg_for_5v5 / (xg_for_5v5 + xg_against_5v5 + 1e-9) AS xgf_pct_5v5,
         corsi_for / (corsi_for + corsi_against + 1e-9) AS cf_pct,
         shots_for / (shots_for + shots_against + 1e-9) AS sf_pct,
         goals_for - goals_against AS goal_diff,
         CASE WHEN m.home_win IS NOT NULL
              THEN CASE WHEN (m.home_win = 1) = p.is_home THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
              WHEN goals_for > goals_against THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS won,
         CASE WHEN o.game_id IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS shot_ot
  FROM team_pairs p JOIN matches m ON p.game_id = m.game_id LEFT JOIN ot_games o ON p.game_id = o.game_id""",
    "facts": """
  SELECT *, CASE WHEN won = 1 AND shot_ot = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS regulation_win
  FROM team_games""",
    "player_games": """
  SELECT game_id, season, game_num, player_id, team_id,
         CAST(sum(sog) AS BIGINT) AS sog, coalesce(sum(xg), 0) AS xg, count(xg) AS shot_attempts,
         round(coalesce(sum(xg), 0) / greatest(count(xg), 1), 5) AS xg_per_attempt
  FROM shots WHERE game_type = 'R' GROUP BY ALL""",
    "goalie_agg": """
  SELECT game_id, season, game_num, game_date, goalie_id, def_team_id AS team_id,
         CAST(sum(sog) AS BIGINT) AS shots_against, CAST(sum(goal) AS BIGINT) AS goals_against,
         coalesce(sum(xg), 0) AS xg_against
  FROM shots WHERE game_type = 'R' AND goalie_id IS NOT NULL GROUP BY ALL""",
    "goalie_games": """
  SELECT *, shots_against - goals_against AS saves,
         (shots_against - goals_against) / CAST(greatest(shots_against, 1) AS DOUBLE) AS save_pct,
         xg_against - goals_against AS gsax,
         shots_against / CAST(greatest(sum(shots_against) OVER (PARTITION BY game_id, team_id), 1) AS DOUBLE) AS shot_share,
         shots_against = max(shots_against) OVER (PARTITION BY game_id, team_id)
           AND shots_against / CAST(greatest(sum(shots_against) OVER (PARTITION BY game_id, team_id), 1) AS DOUBLE) > 0.5
           AS is_starter
  FROM goalie_agg""",
    "st_shots": """
  SELECT *, CASE WHEN sh > df THEN 'PP' WHEN sh < df THEN 'PK' WHEN sh = 5 AND df = 5 THEN '5v5' ELSE 'other' END AS situation
  FROM (SELECT *, CASE WHEN is_home THEN home_skaters ELSE away_skaters END AS sh,
               CASE WHEN is_home THEN away_skaters ELSE home_skaters END AS df
        FROM shots WHERE game_type = 'R') s""",
    "st_games": """
  SELECT i.game_id, i.season, i.game_num, i.team_id,
         coalesce(pp_goals, 0) AS pp_goals, coalesce(pp_xg, 0) AS pp_xg, coalesce(pp_shots, 0) AS pp_shots,
         coalesce(pk_goals_against, 0) AS pk_goals_against, coalesce(pk_xg_against, 0) AS pk_xg_against,
         coalesce(pk_shots_against, 0) AS pk_shots_against
  FROM (SELECT DISTINCT game_id, season, game_num, team_id FROM st_shots) i
  LEFT JOIN (SELECT game_id, team_id, CAST(sum(goal) AS BIGINT) AS pp_goals, sum(xg) AS pp_xg,
                    CAST(sum(sog) AS BIGINT) AS pp_shots
             FROM st_shots WHERE situation = 'PP' GROUP BY ALL) p
    ON i.game_id = p.game_id AND i.team_id = p.team_id
  LEFT JOIN (SELECT game_id, def_team_id AS team_id, CAST(sum(goal) AS BIGINT) AS pk_goals_against,
                    sum(xg) AS pk_xg_against, CAST(sum(sog) AS BIGINT) AS pk_shots_against
             FROM st_shots WHERE situation = 'PP' GROUP BY ALL) k
    ON i.game_id = k.game_id AND i.team_id = k.team_id""",
    "scored": """
  SELECT *, CASE WHEN actual_home_win IS NOT NULL THEN (prob_home_win >= 0.5) = (actual_home_win = 1) END AS correct,
         power(prob_home_win - actual_home_win, 2) AS brier
  FROM preds""",
}

_NEEDS: dict[str, set[str]] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it refers to, in definition order."""
    import re

    def named(text: str) -> set[str]:
        return {v for v in VIEWS if re.search(rf"\b{v}\b", text)}

    if not _NEEDS:
        for name, text in VIEWS.items():
            found = named(text) - {name}
            _NEEDS[name] = found.union(*[_NEEDS.get(f, set()) for f in found]) if found else set()
    wanted = named(sql)
    wanted = wanted.union(*[_NEEDS[w] for w in wanted]) if wanted else set()
    sql = sql.strip()
    if not wanted:
        return sql
    # A view that several others read is computed once.
    readers = {v: sum(len(re.findall(rf"\b{v}\b", t)) for t in [sql, *(VIEWS[w] for w in wanted if w != v)]) for v in wanted}
    prefix = ",\n".join(f"{v} AS {'MATERIALIZED ' if readers[v] > 1 else ''}({VIEWS[v]}\n)" for v in VIEWS if v in wanted)
    if sql[:4].upper() == "WITH":
        recursive = sql[4:].lstrip().upper().startswith("RECURSIVE")
        rest = sql[4:].lstrip()
        rest = rest[len("RECURSIVE"):].lstrip() if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}{prefix},\n{rest}"
    return f"WITH {prefix}\n{sql}"
