import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from helpers import replay, table
from ladderline.config import RatingConfig
from ladderline.operators import breaks, fold, pools, profiles, rankings, wide_pools
from ladderline.session import written

CONFIG = RatingConfig()


def random_rows(seed, n=400, leagues=("PL", "SA", "XX", ""), teams=6, mixed=False):
    rng = random.Random(seed)
    rows, day = [], 0
    for i in range(n):
        day += rng.choice([0, 0, 0, 1, 1, 2]) if rng.random() > 0.02 else 70
        league = rng.choice(leagues)
        a, b = rng.sample(range(teams), 2)
        # with `mixed`, leagues share their teams
        prefix = "t" if mixed else f"{league}-"
        import datetime

        date = (datetime.date(2016, 1, 1) + datetime.timedelta(days=day)).isoformat() + "T15:00:00Z"
        rows.append((i, date, league, f"{prefix}{a}", f"{prefix}{b}", rng.randrange(5), rng.randrange(5)))
    return rows


def check(done, rows, config):
    expected, history = replay(rows, config)
    got = {r["team"]: r for r in fold.final_states(done).collect()}
    assert set(got) == set(expected)
    for team, value in expected.items():
        assert got[team]["rating"] == pytest.approx(value, abs=1e-9)
    found = {}
    for r in fold.rating_events(done).orderBy("team", "seq").collect():
        found.setdefault(r["team"], []).append((r["event"], r["date"], r["match_id"], r["rating_after"]))
        assert r["seq"] == len(found[r["team"]])
    for team, entries in history.items():
        assert [e[:3] for e in found[team]] == [e[:3] for e in entries]
        assert [e[3] for e in found[team]] == pytest.approx([e[3] for e in entries], abs=1e-9)


@pytest.mark.parametrize("mixed", [False, True])
def test_matches_sequential_replay(spark, mixed):
    rows = random_rows(1, mixed=mixed)
    check(written(fold.rating_fold(table(spark, rows), CONFIG), "f"), rows, CONFIG)


@pytest.mark.parametrize("wide", [False, True])
def test_oversized_pools_give_the_same(spark, wide):
    rows = random_rows(2, n=160, leagues=("PL", "SA"), teams=9)
    done = fold.rating_fold(table(spark, rows), CONFIG, max_group_rows=40, wide=wide)
    check(written(done, "f"), rows, CONFIG)


@pytest.mark.parametrize("wide", [False, True])
def test_only_the_oversized_pool_is_cut(spark, wide):
    rows = random_rows(3, n=200, leagues=("PL",) * 9 + ("SA",))
    # leagueless rows, a team meeting itself, a debut after the last break
    rows += [(900, "2030-01-01T15:00:00Z", "PL", "PL-1", "PL-1", 2, 0), (901, "2030-01-02T15:00:00Z", "PL", "PL-1", "new", 0, 0)]
    done = fold.rating_fold(table(spark, rows), CONFIG, max_group_rows=70, wide=wide)
    check(written(done, "f"), rows, CONFIG)


def test_size_alone_never_changes_the_result(spark):
    rows = random_rows(4, n=200, leagues=("PL",) * 9 + ("SA",))
    m = written(table(spark, rows), "m")
    whole = sorted(map(tuple, fold.rating_events(fold.rating_fold(m, CONFIG)).collect()), key=repr)
    for limit in (30, 70):
        cut = fold.rating_events(fold.rating_fold(m, CONFIG, max_group_rows=limit))
        assert sorted(map(tuple, cut.collect()), key=repr) == whole


def test_a_match_without_an_instant_raises(spark):
    rows = random_rows(5, n=20)
    m = table(spark, rows).withColumn("ts", F.when(F.col("id") != rows[7][0], F.col("ts")))
    with pytest.raises(Exception, match="match without an instant"):
        fold.rating_fold(m, CONFIG).count()


def test_wide_pool_without_leagues(spark):
    rows = random_rows(12, n=100, leagues=("PL", "", "XX"), teams=12, mixed=True)
    done = fold.rating_fold(table(spark, rows), CONFIG, max_group_rows=40, wide=True)
    check(written(done, "f"), rows, CONFIG)


def test_round_sizes_follow_the_busiest_team(spark):
    rows = [("p", f"a{i}", f"b{i}") for i in range(1000)] + [("q", "hot", f"c{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "pool string, home string, away string")
    assert wide_pools.round_sizes(df) == {"p": 1000, "q": 31}


def test_partitioning_and_input_order_do_not_matter(spark):
    rows = random_rows(4)
    base = table(spark, rows)
    shuffled = base.repartition(7, "id").orderBy(F.rand(3))
    one, two = (
        {r["team"]: r["rating"] for r in fold.final_states(fold.rating_fold(m, CONFIG)).collect()}
        for m in (base, shuffled))
    assert one == two


def test_flat_replay_with_league_settings_equals_the_fold(spark):
    rows = random_rows(5)
    check(written(fold.rating_fold(table(spark, rows), CONFIG.flat()), "f"), rows, CONFIG.flat())


def test_margin_off_and_other_parameters(spark):
    config = RatingConfig(goal_margin=False, k_factor=30.0, home_advantage=0.0, season_regression=0.5)
    rows = random_rows(6)
    check(written(fold.rating_fold(table(spark, rows), config), "f"), rows, config)


def day(n, time="T15:00:00Z"):
    import datetime

    return (datetime.date(2016, 1, 1) + datetime.timedelta(days=n)).isoformat() + time


def test_break_threshold_is_exactly_sixty_days(spark):
    rows = [(1, day(0), "PL", "a", "b", 1, 0), (2, day(60), "PL", "a", "b", 1, 0),
            (3, day(120, "T14:59:59.999Z"), "PL", "a", "b", 1, 0)]
    found = breaks.season_breaks(table(spark, rows), CONFIG).collect()
    assert [tuple(r) for r in found] == [(1, day(0)[:10], day(60)[:10], 60, 2)]


def test_long_pauses_and_many_short_ones(spark):
    """Buckets are half a gap wide: pauses below the gap never count, whatever their phase."""
    rows, n = [], 0
    for i, gap in enumerate([59, 31, 29, 60, 61, 30, 59, 120, 1, 59]):
        rows.append((i, day(n), "PL", "a", "b", 1, 0))
        n += gap
    rows.append((99, day(n), "PL", "a", "b", 1, 0))
    found = [r["gap_days"] for r in breaks.season_breaks(table(spark, rows), CONFIG).orderBy("break_no").collect()]
    assert found == [60, 61, 120]


def test_idle_pool_still_regresses_and_debutants_do_not(spark):
    rows = [(1, day(0), "PL", "a", "b", 3, 0), (2, day(0), "SA", "x", "y", 2, 0),
            (3, day(100), "SA", "x", "z", 2, 0)]
    done = written(fold.rating_fold(table(spark, rows), CONFIG), "f")
    check(done, rows, CONFIG)
    regressed = Counter(r["team"] for r in fold.rating_events(done).where("event = 'regress'").collect())
    assert regressed == {"a": 1, "b": 1, "x": 1, "y": 1}


def test_same_day_match_wins_over_regression_in_the_snapshot(spark):
    rows = [(1, day(0), "PL", "a", "b", 3, 0), (2, day(90), "PL", "a", "b", 0, 1)]
    done = written(fold.rating_fold(table(spark, rows), CONFIG), "f")
    expected, _ = replay(rows, CONFIG)
    snap = profiles.daily_snapshot(fold.rating_events(done)).where(F.col("date") == day(90)[:10]).collect()
    assert {r["team"]: r["rating"] for r in snap} == pytest.approx(expected)


def test_league_learned_later_sets_the_regression_target(spark):
    rows = [(1, day(0), "", "a", "b", 3, 0), (2, day(1), "PL", "a", "c", 1, 0), (3, day(90), "PL", "a", "c", 1, 0)]
    check(written(fold.rating_fold(table(spark, rows), CONFIG), "f"), rows, CONFIG)


def test_registry_league_is_used_when_a_match_has_none(spark):
    rows = [(1, day(0), "", "a", "b", 1, 1)]
    registry = spark.createDataFrame([("a", "PL")], "team string, league string")
    states = fold.final_states(fold.rating_fold(table(spark, rows), CONFIG, registry=registry))
    got = {r["team"]: r["rating"] for r in states.collect()}
    assert got["a"] > 1590 and got["b"] < 1510


def test_pools_from_the_match_graph(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("f", "f"), ("z", "y"), ("y", "c")]
    df = spark.createDataFrame(edges, "home string, away string")
    got = {r["node"]: r["root"] for r in pools.connected_components(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "z": "a", "y": "a", "d": "d", "e": "d", "f": "f"}


def test_pools_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(70)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]  # a long chain
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "home string, away string")
    got = {r["node"]: r["root"] for r in pools.connected_components(df).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_invariants(spark):
    rows = random_rows(7)
    m = written(table(spark, rows), "m")
    done = written(fold.rating_fold(m, CONFIG), "f")
    found = profiles.checks(m, fold.final_states(done), fold.rating_events(done)).collect()
    assert len(found) == 7 and all(r["violations"] == 0 for r in found)
    records = {r["team"]: tuple(r)[1:] for r in profiles.team_record(m).collect()}
    states = fold.final_states(done).select("team", "matches", "wins", "draws", "losses", "last_updated").collect()
    assert {r["team"]: tuple(r)[1:] for r in states} == records


def test_equal_ratings_rank_by_first_appearance(spark):
    rows = [(1, day(0), "PL", "z", "y", 1, 0), (2, day(0), "PL", "b", "a", 1, 0), (3, day(1), "PL", "d", "c", 1, 0)]
    ranked = rankings.ranked(fold.final_states(fold.rating_fold(table(spark, rows), CONFIG)))
    assert [r["team"] for r in ranked.orderBy("rank").collect()] == ["z", "b", "d", "y", "a", "c"]
    top = rankings.top(fold.final_states(fold.rating_fold(table(spark, rows), CONFIG)), 2)
    assert [(r["rank"], r["team"]) for r in top.orderBy("rank").collect()] == [(1, "z"), (2, "b")]


def test_events_can_be_left_out(spark):
    rows = random_rows(8)
    done = fold.rating_fold(table(spark, rows), CONFIG, with_events=False)
    expected, _ = replay(rows, CONFIG)
    assert fold.rating_events(done).isEmpty()
    assert {r["team"]: r["rating"] for r in fold.final_states(done).collect()} == pytest.approx(expected)
