"""Rule cascades on small fixtures."""

from __future__ import annotations

import pytest

from podium.operators import events as ev
from podium.operators import history, loads, rescore, resolve, search


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


BOATS = "boat_id long, name string, sail string, raw_class string, club string, uses long"


def survivors(spark, rows, manual=None):
    out = resolve.reconcile(frame(spark, BOATS, rows), manual).collect()
    return {r["boat_id"]: r for r in out}


def test_same_identifier_is_one_entity(spark):
    got = survivors(spark, [(1, "Sly\n Fox", "34142", None, None, 3), (2, "Sly Fox", "34142", None, None, 5)])
    assert {r["canonical_id"] for r in got.values()} == {2}
    assert got[1]["best_name"] == "Sly Fox" and got[1]["best_ident"] == "34142"


def test_unknown_identifier_joins_the_only_one(spark):
    got = survivors(spark, [(1, "Mojo", "???", "J29", None, 9), (2, "MOJO", "34142", "J/29", None, 1), (3, "Mojo", "34143", None, None, 0)])
    # two strong identifiers: no sole one, so the dominant row decides by near copies of its own identifier
    assert got[2]["canonical_id"] == 2
    got = survivors(spark, [(1, "Mojo", "???", "J29", None, 9), (2, "MOJO", "34142", "J/29", None, 1)])
    assert {r["canonical_id"] for r in got.values()} == {2} and got[1]["rule"] == 2
    assert got[1]["best_name"] == "Mojo" and got[1]["best_class"] == "J/29" and got[1]["best_ident"] == "34142"


def test_two_classes_stay_apart(spark):
    rows = [(1, "Echo", "34142", "J/29", None, 4), (2, "Echo", "55555", "Sonar", None, 3)]
    assert {k: r["canonical_id"] for k, r in survivors(spark, rows).items()} == {1: 1, 2: 2}


def test_unused_near_copy_joins_the_dominant_row(spark):
    rows = [(1, "Echo", "34142", "J/29", None, 4), (2, "Echo", "34143", "J/29", None, 0), (3, "Echo", "77777", None, None, 2)]
    got = survivors(spark, rows)
    assert {k: (r["canonical_id"], r["rule"]) for k, r in got.items()} == {1: (1, 3), 2: (1, 3), 3: (3, 0)}


def test_manual_rule_comes_first(spark):
    rows = [(1, "Red Ring", "1", "x", None, 0), (2, "red ring", "21000", "y", None, 0), (3, "Other", None, None, None, 0)]
    got = survivors(spark, rows, {"redring": ("Red Ring", "21000", "J/29")})
    assert got[1]["rule"] == got[2]["rule"] == 1 and got[3]["rule"] == 4
    assert got[1]["canonical_id"] == got[2]["canonical_id"] and got[1]["best_class"] == "J/29"


def test_synthetic_names(spark):
    rows = [(1, "Sail 34142", "34142", None), (2, "Mojo", "34142", "J/29"), (3, "Bow 7", "70007", None), (4, "A", "70007", None), (5, "B", "70007", None),
            (6, "Sail 9", "90009", "Sonar"), (7, "C", "90009", "J/29")]
    got = resolve.absorb_synthetic(frame(spark, "entity_id long, name string, ident string, cls string", rows)).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


ENTRIES = "entry_id long, period int, name string, sail string, type string, skipper string"
OURS = "boat_id long, name string, sail string, class string"


def test_match_cascade(spark):
    entries = frame(spark, ENTRIES, [
        (1, 2001, "Mojo", "CAN 100", "J 29", "Bob Smith"), (2, 2003, "mojo", "100", "J 29", "Robert Smith"), (3, 2002, "Jah Mon", "200", "Sonar", "Ann Lee"),
        (4, 2002, "Alpha", "300", "J 29", "X Y"), (5, 2002, "Beta", "300", "Sonar", "Z Z"),
    ])
    ours = frame(spark, OURS, [(1, "Mojo ", "", ""), (2, "Jahmon", "", ""), (3, "Gone", "200", ""), (4, "Lost", "300", "J/29"), (5, "Open", "300", ""),
                               (6, "None", "999", ""), (7, "Odd", "300", "C&C 30")])
    matched = resolve.match_cascade(ours, entries)
    got = {r["boat_id"]: (r["match_type"], r["review_reason"]) for r in matched.collect()}
    assert got == {1: ("name", None), 2: ("fuzzy_name", None), 3: ("sail", None), 4: ("sail+type", None), 5: (None, "sail matches several names"),
                   6: (None, None), 7: (None, "sail matches several names, none of this type")}
    owners = {r["boat_id"]: (r["owners"], r["latest_owner"]) for r in resolve.owners_of_matches(matched, entries).collect()}
    assert owners[1] == (1, "Robert Smith") and owners[4] == (1, "X Y") and owners[5] == (None, None)


def test_owner_at(spark):
    tenures = frame(spark, "tenure_id long, entity_id long, owner string, start_period int, end_period int",
                    [(1, 1, "A", None, 2000), (2, 1, "B", 2001, 2003), (3, 2, "C", 1990, 1991)])
    wanted = frame(spark, "entity_id long, period int", [(1, 1999), (1, 2002), (1, 2009), (2, 2000), (3, 2000)])
    got = {(r["entity_id"], r["period"]): (r["owner"], r["covered"]) for r in history.owner_at(wanted, tenures).collect()}
    assert got == {(1, 1999): ("A", True), (1, 2002): ("B", True), (1, 2009): ("B", False), (2, 2000): ("C", False), (3, 2000): (None, False)}


EVENTS = "event_id long, period int, event_type string, event_name string, source_file string, series_month string, first_date string"


def test_canonical_groups(spark):
    events = frame(spark, EVENTS, [
        (1, 2001, "tns", "June TNS", "june_tns.htm", "june", "2001-06-01"), (2, 2001, "tns", "June TNS Overall", "june_tns_overall.htm", "june", "2001-06-01"),
        (3, 2001, "trophy", "Glube Cup", "glube.htm", None, "2001-07-01"), (4, 2001, "trophy", "Glube Cup A&B", "glube_ab.htm", None, "2001-07-01"),
        (5, 2001, "trophy", "Fall Race", "fall1.htm", None, "2001-09-01"), (6, 2001, "trophy", "Fall Race", "fall2.htm", None, "2001-09-01"),
        (7, 2001, "trophy", "Alone", "alone.htm", None, None),
    ])
    counts = frame(spark, "event_id long, contests long, results long, standings long", [(i, 1, 10 - i, 1) for i in range(1, 8)])
    got = {r["event_id"]: r for r in ev.canonical_groups(events.join(counts, "event_id")).collect()}
    assert {k: r["canonical_event_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert {k for k, r in got.items() if r["is_variant"]} == {2, 4, 6}
    assert got[4]["canonical_name"] == "Glube Cup" and got[7]["canonical_name"] == "Alone"


@pytest.mark.parametrize(
    "name, kind_of, helms, oneoffs, n, want",
    [
        ("Ladies Day", "trophy", 0.0, 0.0, 5, ("special_local", "special_local_keyword")),
        ("Laser Cup", "trophy", 0.0, 0.0, 5, ("special_external", "special_external_keyword")),
        ("Womens Open", "championship", 0.0, 0.0, 5, ("special_local", "event_type_championship,special_local_keyword")),
        ("Open", "championship", 0.0, 0.0, 5, ("special_external", "event_type_championship")),
        ("Day", "trophy", 0.9, 0.0, 10, ("special_local", "helm_dominated_large_event")),
        ("Day", "trophy", 0.0, 0.7, 12, ("special_local", "mostly_oneoff_participants")),
        ("Day", "trophy", 0.9, 0.7, 9, None),
    ],
)
def test_special_events(spark, name, kind_of, helms, oneoffs, n, want):
    rows = frame(spark, "event_id long, event_name string, event_type string, participants long, helm_ratio double, oneoff_ratio double",
                 [(1, name, kind_of, n, helms, oneoffs)])
    got = [(r["kind"], r["reasons"]) for r in ev.special_events(rows).collect()]
    assert got == ([want] if want else [])


def test_certificates_resolve_in_order(spark):
    register = frame(spark, "reg_no long, name string, sail string, class string, cert_ref string",
                     [(1, "Mojo", "1", "J/29", "C1"), (2, "Mojo", "2", "Sonar", "C2"), (3, "Echo", "3", "C&C 30", "C3")])
    certs = frame(spark, "cert_ref string, tot int", [("C1", 900), ("C2", 950)])
    wanted = frame(spark, "boat_id long, name string, sail string, class string",
                   [(1, "Mojo", "2", "x"), (2, "Mojo", "9", "x"), (3, "New", "9", "j 29"), (4, "Echo", "3", "J/29"), (5, "New", "9", "zz")])
    got = {r["boat_id"]: (r["cert_ref"], r["tot"]) for r in rescore.resolve_certificates(wanted, register, certs).collect()}
    assert got == {1: ("C2", 950), 2: ("C1", 900), 3: ("C1", 900), 4: ("C3", None), 5: (None, None)}


def test_wind_decides_the_winner(spark):
    rows = frame(spark, "contest_id long, entity_id long, boat_id long, line_no int, rank int, elapsed_s int, wind_kc long, tot_low int, tot_medium int, tot_high int",
                 [(1, 1, 1, 1, 1, 3600, 500, 1200, 1000, 1000), (1, 2, 2, 1, 2, 3700, 500, 700, 1000, 1000)])
    got = {r["shift_kt"]: (r["band"], r["winner"], r["changed"]) for r in rescore.wind_shift_scenarios(rescore.winners_by_band(rows), [0, 5, 9]).collect()}
    assert got == {0: ("low", 2, False), 5: ("medium", 1, True), 9: ("high", 1, False)}


def test_snapshot_diff_and_upsert(spark):
    left = frame(spark, "path string, checksum string", [("a", "1"), ("b", "2"), ("c", "3")])
    right = frame(spark, "path string, checksum string", [("a", "1"), ("b", "9"), ("d", "4")])
    assert {r["path"]: r["change"] for r in loads.snapshot_diff(left, right).collect()} == {"b": "changed", "c": "missing_right", "d": "missing_left"}
    both = loads.upsert(left, right, ["path"], [])
    assert {r["path"]: r["checksum"] for r in both.collect()} == {"a": "1", "b": "9", "c": "3", "d": "4"}
    assert {r["path"] for r in loads.cache_misses(right, left, ["path"]).collect()} == {"d"}


def test_search_needs_every_term(spark):
    index = frame(spark, "kind string, id long, label string, hint string, keywords string",
                  [("boat", i, f"Red {i:02}", "", f"red {i:02} j/29") for i in range(12)] + [("event", 1, "Red Cup", "", "red cup")])
    assert [r["id"] for r in search.search(index, "RED j/29").orderBy("place").collect()] == list(range(8))
    assert {r["kind"] for r in search.search(index, "red").collect()} == {"boat", "event"}


def test_high_low_by_turns(spark):
    rows = frame(spark, "day int, hour int, h long", [(1, 2, 10), (1, 8, 200), (1, 14, 20), (2, 3, 300), (2, 9, 10), (3, 5, 150)])
    got = {(r["day"], r["hour"]): r["label"] for r in history.high_low(rows, ["day"], "hour", "h", 100).collect()}
    assert got == {(1, 2): "low", (1, 8): "high", (1, 14): "low", (2, 3): "high", (2, 9): "low", (3, 5): "high"}


def test_event_metrics_send_the_entries_once(spark):
    rows = [(1, 2000, 7), (1, 2000, 8), (2, 2000, 7), (3, 2001, 7), (4, None, 8), (4, 2001, None), (4, 2001, 9)]
    entries = spark.createDataFrame(rows, "event_id long, period int, participant_id long")
    people = spark.createDataFrame([(7, "helm"), (8, "boat"), (None, "boat")], "participant_id long, participant_type string")
    got = ev.event_metrics(entries, people)
    assert got._jdf.queryExecution().analyzed().toString().count("Join ") == 1  # with the people only
    found = {r["event_id"]: (r["participants"], r["helms"], r["boats"], r["oneoffs"]) for r in got.collect()}
    assert found == {1: (2, 1, 1, 1), 2: (1, 1, 0, 0), 3: (1, 1, 0, 1)}
