"""Event documents: results gathered by race."""

from __future__ import annotations

from podium.plans import load


def test_gathered_results_are_sent_once(spark):
    load()
    from podium.plans.marts import gathered

    listed = spark.createDataFrame([(r, r % 2, r * 10 + k) for r in range(20) for k in (2, 1, 1)], "race_id long, subpart int, e long")
    races = spark.createDataFrame([(r, r) for r in range(20)], "race_id long, place long")
    joined = races.join(gathered(listed).hint("merge"), "race_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(race_id") == 2  # the races and the entries, each once
    got = {r["race_id"]: (r["subpart"], r["results"]) for r in joined.collect()}
    assert got == {r: (r % 2, [r * 10 + 1, r * 10 + 1, r * 10 + 2]) for r in range(20)}


DEALT = """doc_id long, part int, place long, entity_id long, contest_id long, rank long, boat_id long, line_no int, rating int, elapsed_s int, points int, status string,
    people array<struct<display_name:string,participant_type:string>>, boats array<struct<boat_name:string,raw_class:string>>,
    race struct<race_id:long,contest_no:int,contest_key:string,day:string,start_hour:int,distance_nm:int>"""


def test_entries_meet_their_race_where_they_are(spark):
    load()
    from podium.plans.marts import race_results

    def entry(place, entity, rank, contest, people=1, boats=1):
        named = [(f"E{entity}.{k}", "boat") for k in range(people)]
        return (1, 0, place, entity, contest, rank, entity * 2, 1, 90, 3661, 4, "", named, [("B", "J29")] * boats or None, None)

    def race(place, race_id):
        return (1, 0, place, *[None] * 11, (race_id, 3, "Race 3", "1995-01-01", 12, 9))

    rows = [
        race(1, 10), entry(1, 5, 2, 10), entry(1, 5, 1, 11), entry(1, 6, 501, 10), entry(1, 7, 3, 10, boats=0), entry(1, 8, 4, 10, people=2),
        race(2, 12),
        race(3, 14), entry(3, 9, 1, 14, boats=0),
    ]
    found = race_results(spark.createDataFrame(rows, DEALT).repartition("doc_id", "part"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # dealt out by part before, and not sent again
    got = {(r["place"], r["subpart"]): (r["race"]["race_id"], [(x["display_name"], x["rank"], x["boat_name"], x["elapsed_time"]) for x in r["results"]]) for r in found.collect()}
    assert got == {
        (1, 0): (10, [("E5.0", 2, "B", "1:01:01"), ("E8.0", 4, "B", "1:01:01"), ("E8.1", 4, "B", "1:01:01")]),
        (1, 1): (10, [("E6.0", 501, "B", "1:01:01")]),
        (2, 0): (12, []),
        (3, 0): (14, []),
    }


def test_standings_of_single_events_are_dealt_once(spark):
    """From the ranks in contests to the documents rows are dealt by event, and by nothing else."""
    import re

    load()
    from podium.plans import marts
    from podium.roles import Tables

    plan = marts.standing_documents(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    dealt = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)]
    assert sorted(set(dealt)) in (["contest_id", "event_id"], ["contest_id", "entity_id", "event_id"])
    assert dealt.count("event_id") == 1
