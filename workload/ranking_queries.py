"""Rankings and agreement with an external ranking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.functions import labels
from ladderline.operators import agreement, fold, merge, rankings
from ladderline.session import written
from workload import oracle_core as o
from workload.merge_queries import REGISTRY_ROWS
from workload.rating_queries import CONFIG, DIGITS, FOLD, final, match_table, nullable, r4
from workload.registry import register

# every third team is left out of the registry
REG = FOLD + [o.SIDES, o.COUNTRY, REGISTRY_ROWS, """
known AS (SELECT r.team, first_league AS league, c.country, c.label FROM reg r JOIN country c ON c.league = first_league
  WHERE r.team NOT LIKE '%-3')
"""]


def partial_registry(matches):
    return merge.registry(matches).where(~F.col("team").like("%-3"))


def _setup(spark, sf_dir):
    """Match table, final records and a registry lacking some teams."""
    m = match_table(spark, sf_dir)
    states = fold.final_states(fold.rating_fold(m, CONFIG, with_events=False))
    return m, states, partial_registry(m)


@register("global_rank", o.query(FOLD, f"SELECT rank, team, round(rating, {DIGITS}) AS rating FROM ranked"))
def global_rank(spark, sf_dir):
    return rankings.ranked(final(spark, sf_dir)).select("rank", "team", r4("rating").alias("rating"))


@register("top20", o.query(FOLD, f"""
SELECT rank, team, round(rating, {DIGITS}) AS rating, wins, draws, losses FROM ranked WHERE rank <= 20"""))
def top20(spark, sf_dir):
    return rankings.top(final(spark, sf_dir)).select(
        "rank", "team", r4("rating").alias("rating"), "wins", "draws", "losses")


@register("ratings_registry", o.query(REG, f"""
SELECT rank, r.team, coalesce(k.league, '?') AS league, coalesce(k.country, '?') AS country,
  k.team IS NOT NULL AS registered, round(rating, {DIGITS}) AS rating FROM ranked r LEFT JOIN known k ON k.team = r.team"""))
def ratings_registry(spark, sf_dir):
    _, states, registry = _setup(spark, sf_dir)
    return rankings.with_registry(rankings.ranked(states), registry).select(
        "rank", "team", "league", "country", "registered", r4("rating").alias("rating"))


@register("rank_display", o.query(REG, """
SELECT rank, r.team, coalesce(k.country, '???') AS league, floor(rating + 0.5)::BIGINT AS rating,
  CAST(wins AS VARCHAR) || '-' || CAST(draws AS VARCHAR) || '-' || CAST(losses AS VARCHAR) AS wdl, last_updated AS updated
FROM ranked r LEFT JOIN known k ON k.team = r.team"""))
def rank_display(spark, sf_dir):
    _, states, registry = _setup(spark, sf_dir)
    return rankings.display(rankings.ranked(states), registry)


@register("rank_by_league", o.query(REG, f"""
SELECT rank, r.team, round(rating, {DIGITS}) AS rating FROM ranked r JOIN known k ON k.team = r.team
WHERE k.country = 'ESP'"""))
def rank_by_league(spark, sf_dir):
    _, states, registry = _setup(spark, sf_dir)
    teams = rankings.with_registry(rankings.ranked(states), registry)
    return rankings.of_league(teams, "PD").select("rank", "team", r4("rating").alias("rating"))


@register("league_rank", o.query(REG, """
SELECT rank, r.team, coalesce(k.league, '?') AS league,
  row_number() OVER (PARTITION BY coalesce(k.league, '?') ORDER BY rank) AS league_rank
FROM ranked r LEFT JOIN known k ON k.team = r.team"""))
def league_rank(spark, sf_dir):
    _, states, registry = _setup(spark, sf_dir)
    teams = rankings.with_registry(rankings.ranked(states), registry)
    return rankings.league_ranks(teams).select("rank", "team", "league", "league_rank")


@register("league_avg", o.query(REG, """
SELECT p AS position, c AS country, coalesce(floor(avg(rating) + 0.5), 0)::BIGINT AS average
FROM (VALUES (0::BIGINT, 'ENG'), (1, 'ESP'), (2, 'GER'), (3, 'ITA'), (4, 'FRA')) t(p, c)
LEFT JOIN (SELECT rating, country FROM state s JOIN known k ON k.team = s.team) x ON x.country = c
GROUP BY ALL"""))
def league_avg(spark, sf_dir):
    _, states, registry = _setup(spark, sf_dir)
    return rankings.league_averages(rankings.with_registry(states, registry))


@register("headline", o.query(REG, """
SELECT (SELECT count(*) FROM state) AS teams_rated, (SELECT count(*) FROM matches) AS matches_processed,
  (SELECT count(DISTINCT league) FROM known) AS leagues, (SELECT count(DISTINCT season) FROM matches) AS seasons,
  (SELECT substr(min(season), 1, 4) || '-' || substr(max(season), 6, 4) FROM matches) AS years,
  team AS top_team, floor(rating + 0.5)::BIGINT AS top_rating FROM ranked WHERE rank = 1"""))
def headline(spark, sf_dir):
    m, states, registry = _setup(spark, sf_dir)
    return rankings.headline(states, m, registry)


# Reference ranking: the first four teams by name of each league; two entries match nobody, the
# fourth of a league matches under its own name, and a fifth team competes for the first one's name.
REF = """
ref_t AS (
  SELECT league, team, row_number() OVER (PARTITION BY league ORDER BY team) AS i,
    CASE league WHEN 'PL' THEN 0 WHEN 'PD' THEN 1 WHEN 'BL1' THEN 2 WHEN 'SA' THEN 3 ELSE 4 END AS lp
  FROM (SELECT DISTINCT league, team FROM sides)),
ref_n AS (SELECT *, (i - 1) * 5 + lp + 1 AS rk, CASE WHEN i = 5 THEN lp + 1 ELSE rk END AS target FROM ref_t WHERE i <= 5),
ranking AS (
  SELECT CASE WHEN rk IN (7, 13) THEN 'Nobody ' || CAST(rk AS VARCHAR) WHEN i = 4 THEN team
    ELSE 'Ref ' || CAST(rk AS VARCHAR) END AS ref_team, 2100 - 10 * rk AS ref_elo, rk AS ref_rank FROM ref_n WHERE i <= 4),
names AS (SELECT team, 'Ref ' || CAST(target AS VARCHAR) AS ref_team FROM ref_n WHERE i <> 4)
"""


def matched_sql(prefix: str, ranked: str) -> str:
    return f"""
{prefix}named AS (SELECT r.team, r.rating, r.rank, coalesce(n.ref_team, r.team) AS ref_team
  FROM {ranked} r LEFT JOIN names n ON n.team = r.team),
{prefix}found AS (
  SELECT ref_team, ref_elo, ref_rank, max(rank) AS rank, arg_max(rating, rank) AS rating
  FROM {prefix}named JOIN ranking USING (ref_team) GROUP BY ref_team, ref_elo, ref_rank),
{prefix}matched AS (SELECT *, row_number() OVER (ORDER BY rating DESC, ref_rank) AS local_rank FROM {prefix}found),
{prefix}rho AS (
  SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN 1.0::DOUBLE - 6.0::DOUBLE * sum((x - y) * (x - y)) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1.0))
    ELSE 0.0 END AS spearman
  FROM (SELECT row_number() OVER (ORDER BY rating, ref_rank) AS x, row_number() OVER (ORDER BY ref_elo, ref_rank) AS y
        FROM {prefix}matched))
"""


BEFORE = "before_2000 AS (SELECT * FROM matches WHERE ts < TIMESTAMP '2000-01-01')"
MATCHED = FOLD + [o.SIDES, REF, matched_sql("", "ranked")]
TWO_RUNS = MATCHED + [BEFORE, o.fold("old_", "before_2000"), matched_sql("old_", "old_ranked")]


def reference(matches):
    """(ranking, names) as in REF."""
    position = F.array_position(F.array(*[F.lit(x) for x in ("PL", "PD", "BL1", "SA", "FL1")]), F.col("league"))
    teams = matches.select("league", F.explode(F.array("home", "away")).alias("team")).distinct()
    # the rank limit is applied before the shuffle
    first = (
        teams.withColumn("i", F.row_number().over(W.partitionBy("league").orderBy("team"))).where("i <= 5")
        .withColumn("rk", (F.col("i") - 1) * 5 + position)
        .withColumn("target", F.when(F.col("i") == 5, position).otherwise(F.col("rk")))
    )
    first = written(first, "reference")  # 25 rows that several joins read
    rk = F.col("rk").cast("string")
    name = (
        F.when(F.col("rk").isin(7, 13), F.concat(F.lit("Nobody "), rk))
        .when(F.col("i") == 4, F.col("team")).otherwise(F.concat(F.lit("Ref "), rk))
    )
    ranking = first.where("i <= 4").select(
        name.alias("ref_team"), (2100 - 10 * F.col("rk")).alias("ref_elo"), F.col("rk").alias("ref_rank"))
    names = first.where("i <> 4").select(
        "team", F.concat(F.lit("Ref "), F.col("target").cast("string")).alias("ref_team"))
    return ranking, names


def _matched(spark, sf_dir):
    m = match_table(spark, sf_dir)
    ranking, names = reference(m)
    states = fold.final_states(fold.rating_fold(m, CONFIG, with_events=False))
    return agreement.matched(rankings.ranked(states), ranking, names), ranking


def _ranked_runs(spark, sf_dir):
    m = match_table(spark, sf_dir)
    before = m.where(F.col("ts") < F.lit("2000-01-01").cast("timestamp"))

    def run(rows):
        return rankings.ranked(fold.final_states(fold.rating_fold(rows, CONFIG, with_events=False)))

    return m, run(before), run(m)


def _runs(spark, sf_dir):
    m, old, new = _ranked_runs(spark, sf_dir)
    ranking, names = reference(m)
    return agreement.matched(old, ranking, names), agreement.matched(new, ranking, names), ranking


@register("ref_match", o.query(MATCHED, f"""
SELECT ref_team, ref_elo, ref_rank, rank, round(rating, {DIGITS}) AS rating FROM matched"""))
def ref_match(spark, sf_dir):
    found, _ = _matched(spark, sf_dir)
    return found.select("ref_team", "ref_elo", "ref_rank", "rank", r4("rating").alias("rating"))


@register("local_rank", o.query(MATCHED, "SELECT ref_team, ref_rank, local_rank FROM matched"))
def local_rank(spark, sf_dir):
    found, _ = _matched(spark, sf_dir)
    return found.select("ref_team", "ref_rank", "local_rank")


@register("ref_compare", o.query(MATCHED, """
SELECT g.ref_team, g.ref_rank, g.ref_elo, local_rank::DOUBLE AS local_rank, floor(rating + 0.5)::DOUBLE AS rating,
  (local_rank - g.ref_rank)::DOUBLE AS rank_diff FROM ranking g LEFT JOIN matched m ON m.ref_team = g.ref_team"""))
def ref_compare(spark, sf_dir):
    compared = agreement.compare(*_matched(spark, sf_dir))
    return compared.select("ref_team", "ref_rank", "ref_elo", *nullable("local_rank", "rating", "rank_diff"))


@register("rank_change_label", o.query(MATCHED, """
SELECT g.ref_team, CASE WHEN local_rank > g.ref_rank THEN '+' || CAST(local_rank - g.ref_rank AS VARCHAR)
  WHEN local_rank = g.ref_rank THEN '=' ELSE CAST(local_rank - g.ref_rank AS VARCHAR) END AS label
FROM ranking g LEFT JOIN matched m ON m.ref_team = g.ref_team"""))
def rank_change_label(spark, sf_dir):
    compared = agreement.compare(*_matched(spark, sf_dir))
    return compared.select("ref_team", labels.signed(F.col("rank_diff")).alias("label"))


@register("assign_ranks", o.query(FOLD, """
SELECT team, row_number() OVER (ORDER BY v, rank) AS ascending, row_number() OVER (ORDER BY v DESC, rank) AS descending
FROM (SELECT team, rank, floor(rating / 10) AS v FROM ranked)"""))
def assign_ranks(spark, sf_dir):
    """Ratings in steps of ten, so that many are equal."""
    teams = rankings.ranked(final(spark, sf_dir)).select("team", "rank", F.floor(F.col("rating") / 10).alias("v"))
    up = agreement.assign_ranks(teams, "v", "rank", "ascending")
    return agreement.assign_ranks(up, "v", "rank", "descending", ascending=False).select(
        "team", "ascending", "descending")


@register("spearman", o.query(MATCHED, "SELECT n, round(spearman, 9) AS spearman FROM rho"))
def spearman(spark, sf_dir):
    found, _ = _matched(spark, sf_dir)
    return agreement.spearman(found).withColumn("spearman", F.round("spearman", 9))


@register("rank_mae", o.query(MATCHED, """
SELECT round(coalesce(avg(abs(local_rank - ref_rank)), 0), 9) AS mean_abs_rank_error FROM matched"""))
def rank_mae(spark, sf_dir):
    found, _ = _matched(spark, sf_dir)
    return agreement.rank_error(found).select(F.round("mean_abs_rank_error", 9).alias("mean_abs_rank_error"))


@register("top10_overlap", o.query(MATCHED, """
SELECT count(*) AS matched, count(*) FILTER (WHERE local_rank <= 10 AND ref_rank <= 10) AS overlap FROM matched"""))
def top10_overlap(spark, sf_dir):
    found, _ = _matched(spark, sf_dir)
    return agreement.top_overlap(found)


@register("ref_diff", o.query(MATCHED, """
SELECT r.team, n.ref_team, floor(r.rating + 0.5)::BIGINT - g.ref_elo AS rating_diff, r.rank - g.ref_rank AS rank_diff
FROM ranked r JOIN names n ON n.team = r.team JOIN ranking g ON g.ref_team = n.ref_team"""))
def ref_diff(spark, sf_dir):
    m = match_table(spark, sf_dir)
    states = fold.final_states(fold.rating_fold(m, CONFIG, with_events=False))
    return agreement.rating_difference(rankings.ranked(states), *reference(m))


KEY_TEAMS = ["Ref 1", "Ref 3", "Ref 6"]


@register("before_after", o.query(TWO_RUNS, """
SELECT g.ref_team, coalesce(om.local_rank, 0) AS old_rank, coalesce(m.local_rank, 0) AS new_rank, g.ref_rank,
  coalesce(om.local_rank, 0) - coalesce(m.local_rank, 0) AS change,
  CASE WHEN change > 0 THEN '+' || CAST(change AS VARCHAR) WHEN change = 0 THEN '=' ELSE CAST(change AS VARCHAR) END
    AS change_label,
  g.ref_team IN ('Ref 1', 'Ref 3', 'Ref 6') AS key_team
FROM ranking g LEFT JOIN old_matched om ON om.ref_team = g.ref_team LEFT JOIN matched m ON m.ref_team = g.ref_team"""))
def before_after(spark, sf_dir):
    old, new, ranking = _runs(spark, sf_dir)
    return agreement.before_after(old, new, ranking, KEY_TEAMS)


@register("spearman_delta", o.query(TWO_RUNS, """
SELECT round(o.spearman, 9) AS old_spearman, round(n.spearman, 9) AS new_spearman, round(n.spearman - o.spearman, 9) AS change
FROM old_rho o CROSS JOIN rho n"""))
def spearman_delta(spark, sf_dir):
    old, new, _ = _runs(spark, sf_dir)
    both = agreement.spearman_delta(old, new)
    return both.select(*[F.round(c, 9).alias(c) for c in both.columns])


@register("movement_label", o.query(TWO_RUNS, """
SELECT team, coalesce(p.rank, 0) AS old_rank, coalesce(r.rank, 0) AS new_rank,
  CASE WHEN new_rank < old_rank THEN 'IMPROVED' WHEN new_rank > old_rank THEN 'dropped' ELSE 'unchanged' END AS movement
FROM ranked r FULL JOIN old_ranked p USING (team)"""))
def movement_label(spark, sf_dir):
    _, old, new = _ranked_runs(spark, sf_dir)
    return agreement.movements(old, new)
