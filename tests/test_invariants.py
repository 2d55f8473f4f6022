"""Numbers that must agree across marts, and plans that must hold at scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from podium.plans import load
from podium.plans.registry import BUILDERS
from podium.roles import Tables
from tests.oracle import DATA

SF_DIR = f"{DATA}/sf0.001"
load()


@pytest.fixture(scope="module")
def rows(spark):
    queries = entry.queries()

    def get(name):
        return queries[name](spark, SF_DIR).collect()

    return get


def test_periods_add_up_to_careers(rows):
    career = {r["entity_id"]: (r["contests"], r["wins"]) for r in rows("A01_best_rank_tally")}
    total = {}
    for r in rows("A08_per_period"):
        n, w = total.get(r["entity_id"], (0, 0))
        total[r["entity_id"]] = (n + r["contests"], w + r["wins"])
    assert total == career


def test_leaderboard_agrees_with_careers(rows):
    career = {r["entity_id"]: r["wins"] for r in rows("A01_best_rank_tally")}
    board = rows("L01_win_leaderboard")
    assert board and all(career[r["entity_id"]] == r["wins"] for r in board)
    assert [(-r["wins"], r["entity_id"]) for r in board] == sorted((-r["wins"], r["entity_id"]) for r in board)


def test_snapshot_agrees_with_boards(rows):
    kpi = rows("A02_kpi_snapshot")[0]
    assert kpi["scoped_entities"] == len(rows("A01_best_rank_tally"))
    assert kpi["events"] == len(rows("J02_left_chain_stats"))


def test_no_view_in_the_search_index(rows):
    views = {r["event_id"] for r in rows("C01_canonical_groups") if r["is_variant"]}
    assert views and not [r for r in rows("U05_search_index") if r["kind"] == "event" and r["id"] in views]


def test_most_active_pair_met(rows):
    assert any(r["pair_id"] == 1 and r["shared"] == r["a_wins"] + r["b_wins"] + r["ties"] > 0 for r in rows("J07_head_to_head"))


def test_results_survive_repointing(rows, spark):
    repointed = sum(r["results"] for r in rows("C03_repointed_results"))
    t = Tables(spark, SF_DIR)
    assert repointed == t.results.join(t.boats, "boat_id", "left_semi").count()


def test_reading_order_of_sorted_reports(rows):
    got = [(r["position"], r["month"], r["period"]) for r in rows("L04_calendar_order")]
    assert got == sorted(got)
    order = [(999 if r["contest_no"] is None else r["contest_no"], r["contest_key"] is None, r["contest_key"] or "", r["contest_id"]) for r in rows("L03_nulls_last_order")]
    assert order == sorted(order)


def plan(spark, name):
    # as on a cluster: no side is known to be small
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return BUILDERS[name](Tables(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [n for n in BUILDERS if n != "S11_full_reload"])
def test_plans_hold_at_scale(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "EvalPython" not in text
    if not name.startswith(("H06", "H07", "H10", "H11", "H13", "S14")):
        assert "MapInArrow" not in text and "MapInPandas" not in text


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(spark, "A01_best_rank_tally")
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "lineitem" in line)
    assert "l_tax" not in scan and "l_shipdate" not in scan


def test_top_n_is_cut_before_the_shuffle(spark):
    assert plan(spark, "W08_top_per_kind").count("WindowGroupLimit") == 2


def test_ranking_shares_its_shuffle_with_the_join(spark):
    text = plan(spark, "J01_star_join") + plan(spark, "W14_first_winner_per_period")
    assert "hashpartitioning(contest_id" in text


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_read_the_marked_events_once(spark):
    """Marks are worked out once for an event, not again for each use or for each contest of a series."""
    from podium.plans import events
    from podium.roles import Tables

    plan = _plan(events.groups(Tables(spark, SF_DIR)))
    assert "marked-" in plan and "orders.parquet" not in plan and "lineitem.parquet" not in plan


def test_marked_events_are_written_once_for_a_query(spark, monkeypatch):
    """Groups and audits of one query read the same table of events, and its rows meet the counts without names."""
    import re

    from podium.plans import audits, events
    from podium.roles import Tables

    written = []
    monkeypatch.setattr(events, "shared_table", lambda df, name: written.append(_plan(df)) or df)
    t = Tables(spark, SF_DIR)
    events.groups(t), events.groups(t), audits.audited_events(t)
    assert len(written) == 1
    assert re.search(r"Join \[(\w+)#", written[0])[1] == "series_id"  # the last of the joins


def test_entries_of_metrics_are_dealt_once(spark):
    """From the entries to the counts of an event, rows are dealt by participant, then by event, and by nothing else."""
    import re

    from podium.plans import events
    from podium.roles import Tables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(events.metrics(Tables(spark, SF_DIR)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    keys = [re.sub(r"#\d+L?", "", k) for k in dealt]
    assert sorted(keys) == ["contest_id", "contest_id", "event_id", "participant_id", "participant_id"]


def test_season_facts_of_the_wanted_kinds(spark):
    from podium.plans import marts
    from podium.roles import Tables

    t = Tables(spark, SF_DIR)
    wanted = ("entity", "contest", "night")
    rows = {r for r in marts.season_facts(t).collect() if r["kind"] in wanted}
    assert rows and rows == set(marts.season_facts(t, wanted).collect())
