"""Shared pieces of the oracle SQL: the derived matches and the rating fold as a recursive CTE."""

from __future__ import annotations

MATCHES = """
nr AS (
  SELECT n_nationkey, n_name, n_regionkey,
         row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS npos,
         count(*) OVER (PARTITION BY n_regionkey) AS nn
  FROM nation),
fx_b AS (
  SELECT o_orderkey AS id, n_regionkey AS rk, nn,
         CASE WHEN month(o_orderdate) IN (6, 7) THEN o_orderdate - INTERVAL 61 DAY ELSE o_orderdate END AS ts,
         npos * 6 + (o_custkey // 25) % 6 AS hidx,
         CAST(floor(o_totalprice) AS BIGINT) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nr ON c_nationkey = n_nationkey),
fx_x AS (SELECT *, (hidx + 1 + id % (nn * 6 - 1)) % (nn * 6) AS aidx FROM fx_b),
matches AS (
  SELECT id, ts, strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' AS date, strftime(ts, '%Y-%m-%d') AS day,
         ['PL','PD','BL1','SA','FL1'][rk + 1] AS league,
         CASE WHEN month(ts) >= 8 THEN year(ts) ELSE year(ts) - 1 END AS season_year,
         CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR) AS season,
         h.n_name || '-' || CAST(hidx % 6 AS VARCHAR) AS home,
         a.n_name || '-' || CAST(aidx % 6 AS VARCHAR) AS away,
         p % 5 AS hg, (p // 7 + id) % 4 AS ag,
         0 AS matchday, 0 AS src_rank, id AS ord
  FROM fx_x JOIN nr h ON h.n_regionkey = rk AND h.npos = hidx // 6
            JOIN nr a ON a.n_regionkey = rk AND a.npos = aidx // 6)
"""

CONFIG = """
cfg AS (SELECT * FROM (VALUES ('PL', 1.15::DOUBLE, 1600.0::DOUBLE), ('PD', 1.05::DOUBLE, 1515.0::DOUBLE),
  ('BL1', 1.0::DOUBLE, 1500.0::DOUBLE), ('SA', 1.0::DOUBLE, 1500.0::DOUBLE),
  ('FL1', 0.85::DOUBLE, 1470.0::DOUBLE)) t(league, strength, baseline))
"""

COUNTRY = """
country AS (SELECT * FROM (VALUES ('PL', 'ENG', 'Premier League'), ('PD', 'ESP', 'La Liga'),
  ('BL1', 'GER', 'Bundesliga'), ('SA', 'ITA', 'Serie A'), ('FL1', 'FRA', 'Ligue 1'))
  t(league, country, label))
"""

SIDES = """
sides AS (
  SELECT id, ts, src_rank, ord, date, day, league, home AS team, away AS opponent, hg AS goals, ag AS opp_goals,
         0 AS side, 'H' AS home_away FROM matches
  UNION ALL
  SELECT id, ts, src_rank, ord, date, day, league, away, home, ag, hg, 1, 'A' FROM matches)
"""

BREAKS = """
br_t AS (SELECT DISTINCT ts FROM matches),
br_l AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts FROM br_t),
br_f AS (SELECT ts, prev_ts, coalesce(epoch_ms(ts) - epoch_ms(prev_ts) >= 5184000000, false) AS is_break FROM br_l),
instants AS (SELECT ts, prev_ts, is_break,
  CAST(sum(CASE WHEN is_break THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS INTEGER) AS break_no FROM br_f)
"""


def fold(prefix: str = "", source: str = "matches", flat: bool = False) -> str:
    """CTEs `{prefix}events` and `{prefix}state`: the fold over `source`, one league per pool.

    State is a list with one rating per team of the pool, NULL until the team first plays.
    """
    strength = "1.0::DOUBLE" if flat else "c.strength"
    start = "1500.0::DOUBLE" if flat else "c.baseline"
    breaks = f"""
{prefix}bt AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT ts FROM {source})),
{prefix}bk AS (SELECT ts FROM {prefix}bt WHERE epoch_ms(ts) - epoch_ms(prev_ts) >= 5184000000 {'AND false' if flat else ''}),
"""
    return breaks + f"""
{prefix}tm AS (SELECT league, team, row_number() OVER (PARTITION BY league ORDER BY team) AS ix
  FROM (SELECT league, home AS team FROM {source} UNION SELECT league, away FROM {source})),
{prefix}sz AS (SELECT league, count(*) AS n FROM {prefix}tm GROUP BY league),
{prefix}st AS (
  SELECT league, ts, 1 AS kind, src_rank, ord, id, day, home, away, hg, ag FROM {source}
  UNION ALL
  SELECT z.league, b.ts, 0, 0, 0, NULL, strftime(b.ts, '%Y-%m-%d'), NULL, NULL, NULL, NULL
  FROM {prefix}bk b, {prefix}sz z),
{prefix}sq AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.league ORDER BY s.ts, kind, src_rank, ord) AS step,
         h.ix AS hi, a.ix AS ai,
         CASE WHEN hg > ag THEN 1.0::DOUBLE WHEN hg < ag THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS act,
         24.0::DOUBLE * {strength} * (1.0::DOUBLE + ln(abs(hg - ag) + 1)) AS k, {start} AS base
  FROM {prefix}st s JOIN cfg c ON c.league = s.league
  LEFT JOIN {prefix}tm h ON h.league = s.league AND h.team = s.home
  LEFT JOIN {prefix}tm a ON a.league = s.league AND a.team = s.away),
{prefix}fo AS (
  SELECT league, 0::BIGINT AS step, [NULL::DOUBLE for x in range(n)] AS r, NULL::DOUBLE AS hb, NULL::DOUBLE AS ab,
         NULL::DOUBLE AS ha, NULL::DOUBLE AS aa
  FROM {prefix}sz
  UNION ALL
  SELECT league, step,
    CASE WHEN kind = 0 THEN list_transform(r, lambda x: x + 0.15::DOUBLE * (base - x))
         ELSE list_transform(r, lambda x, i: CASE WHEN i = hi THEN ha WHEN i = ai THEN aa ELSE x END) END,
    hb, ab, ha, aa
  FROM (
    SELECT *, hb + k * (act - e) AS ha, ab + k * ((1.0::DOUBLE - act) - (1.0::DOUBLE - e)) AS aa
    FROM (
      SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (ab - hb - 65.0::DOUBLE) / 400.0::DOUBLE)) AS e
      FROM (
        SELECT q.*, f.r, coalesce(f.r[q.hi], q.base) AS hb, coalesce(f.r[q.ai], q.base) AS ab
        FROM {prefix}fo f JOIN {prefix}sq q ON q.league = f.league AND q.step = f.step + 1)))),
{prefix}ev AS (
  SELECT q.league, q.step, 0 AS side, q.home AS team, 'match' AS event, q.day AS date, q.id AS match_id,
         q.ts, q.src_rank, q.ord, f.hb AS rating_before, f.ha AS rating_after
  FROM {prefix}fo f JOIN {prefix}sq q USING (league, step) WHERE q.kind = 1
  UNION ALL
  SELECT q.league, q.step, 1, q.away, 'match', q.day, q.id, q.ts, q.src_rank, q.ord, f.ab, f.aa
  FROM {prefix}fo f JOIN {prefix}sq q USING (league, step) WHERE q.kind = 1
  UNION ALL
  SELECT q.league, q.step, NULL, t.team, 'regress', q.day, NULL, q.ts, NULL, NULL, p.r[t.ix], f.r[t.ix]
  FROM {prefix}fo f JOIN {prefix}sq q USING (league, step)
  JOIN {prefix}fo p ON p.league = f.league AND p.step = f.step - 1
  JOIN {prefix}tm t ON t.league = f.league
  WHERE q.kind = 0 AND f.r[t.ix] IS NOT NULL),
{prefix}events AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY step, side) AS seq FROM {prefix}ev),
{prefix}rec AS (
  SELECT team, count(*) AS matches, count(*) FILTER (WHERE g > o) AS wins, count(*) FILTER (WHERE g = o) AS draws,
         count(*) FILTER (WHERE g < o) AS losses, arg_max(day, (ts, src_rank, ord)) AS last_updated,
         min((ts, src_rank, ord, side)) AS first_seen
  FROM (SELECT home AS team, hg AS g, ag AS o, day, ts, src_rank, ord, 0 AS side FROM {source}
        UNION ALL SELECT away, ag, hg, day, ts, src_rank, ord, 1 FROM {source}) GROUP BY team),
{prefix}state AS (
  SELECT e.team, e.rating, r.matches, r.wins, r.draws, r.losses, r.last_updated, r.first_seen
  FROM (SELECT team, arg_max(rating_after, seq) AS rating FROM {prefix}events GROUP BY team) e
  JOIN {prefix}rec r USING (team)),
{prefix}ranked AS (SELECT *, row_number() OVER (ORDER BY rating DESC, first_seen) AS rank FROM {prefix}state)
"""


def query(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body
