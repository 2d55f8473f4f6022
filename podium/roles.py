"""Binding of the given tables to the roles the operators work on.

Each binding is a plain projection of one table, written in the SQL both engines share, so that a query and its
oracle start from the same rows. Nothing is computed here that an operator is responsible for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.ranking import hot_groups, rank_within
from podium.session import fresh_folder, tune

#: Where the scope of a folder of tables has been written, by application and folder.
_SCOPES: dict[tuple[str, str], str] = {}

BINDINGS: dict[str, tuple[str, list[str]]] = {
    # one row per (contest, participant) entry
    "results": (
        "lineitem",
        [
            "l_orderkey AS contest_id",
            "l_suppkey AS entity_id",
            "l_partkey AS boat_id",
            "l_linenumber AS line_no",
            "CAST(round(l_extendedprice * 100) AS BIGINT) AS metric",
            "CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'DNC' ELSE 'DNS' END WHEN 'N' THEN '' "
            "ELSE CASE WHEN l_linenumber = 7 THEN 'DNF' END END AS status",
            "CAST(floor(l_extendedprice / 5) AS INT) AS elapsed_s",
            "CAST(60 + l_partkey % 240 AS INT) AS rating",
            "CAST(l_quantity AS INT) AS points",
        ],
    ),
    # one row per contest header
    "contest_headers": (
        "orders",
        [
            "o_orderkey AS contest_id",
            "o_custkey AS series_id",
            "o_custkey * 10000 + CAST(year(o_orderdate) AS BIGINT) AS event_id",
            "CAST(o_orderdate AS DATE) AS contest_date",
            "CAST(year(o_orderdate) AS INT) AS period",
            "CAST(month(o_orderdate) AS INT) AS month",
            "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day",
            "CAST(day(o_orderdate) AS INT) AS day_no",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS contest_no",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Race ' || CAST(o_orderkey % 9 AS STRING) END AS contest_key",
            "CAST(5 + o_custkey % 20 AS INT) AS distance_nm",
            "CAST(10 + o_custkey % 9 AS INT) AS start_hour",
        ],
    ),
    # one row per event series
    "series": (
        "customer",
        [
            "c_custkey AS series_id",
            "CASE c_mktsegment WHEN 'MACHINERY' THEN 'tns' WHEN 'BUILDING' THEN 'championship' ELSE 'trophy' END "
            "AS event_type",
            "CASE WHEN c_custkey % 23 = 0 THEN 'Ladies ' WHEN c_custkey % 29 = 0 THEN 'Laser Regatta ' ELSE '' END || "
            "'Cup ' || CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING) || CASE c_custkey % 4 WHEN 1 THEN ' Overall' "
            "WHEN 2 THEN ' A&B' WHEN 3 THEN ' ??' ELSE '' END AS event_name",
            "'results/cup-' || CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING) || CASE c_custkey % 4 WHEN 1 THEN '_overall.htm' "
            "WHEN 2 THEN '_ab.htm' WHEN 3 THEN '_2.htm' ELSE '.htm' END AS source_file",
            "CASE c_custkey % 6 WHEN 0 THEN 'may' WHEN 1 THEN 'june' WHEN 2 THEN 'july' WHEN 3 THEN 'august' "
            "WHEN 4 THEN 'september' END AS series_month",
        ],
    ),
    # events announced before any of their contests; those whose list_no is a multiple of five are on the list
    "announced": (
        "customer",
        [
            "c_custkey AS list_no",
            "c_custkey * 10000 + 1994 AS event_id",
            "CAST(1994 AS INT) AS period",
            "CASE WHEN c_custkey % 9 = 0 THEN 'Spring  Cup' WHEN c_custkey % 11 = 0 THEN 'Spring ##' ELSE 'Spring Cup' END AS event_name",
            "CASE WHEN c_custkey % 3 = 0 THEN 'tns' ELSE 'trophy' END AS event_type",
            "CASE c_custkey % 4 WHEN 0 THEN 'june' WHEN 1 THEN 'july' WHEN 2 THEN 'may' END AS series_month",
            "CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 3 AS INT) END AS entries",
            "CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 2 AS INT) END AS races_sailed",
            "CASE WHEN c_custkey % 6 < 3 THEN 'as-of' WHEN c_custkey % 6 = 3 THEN 'final' END AS publication_status",
        ],
    ),
    # competing entities
    "entities": (
        "supplier",
        [
            "s_suppkey AS entity_id",
            "s_name AS entity_name",
            "CAST(s_nationkey AS BIGINT) AS nation_id",
            "CASE WHEN s_suppkey % 4 = 0 THEN 'helm' ELSE 'boat' END AS participant_type",
            "CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 'Owner ' || CAST(s_nationkey AS STRING) END AS owner",
        ],
    ),
    # entity-owner tenure, several per entity; both ends may be open
    "tenures": (
        "customer",
        [
            "c_custkey AS tenure_id",
            "CAST(floor(c_custkey / 15) AS BIGINT) AS entity_id",
            "'Owner ' || CAST(c_nationkey AS STRING) AS owner",
            "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(1994 + c_custkey % 7 AS INT) END AS start_period",
            "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(1994 + c_custkey % 7 + c_nationkey % 2 AS INT) END "
            "AS end_period",
        ],
    ),
    # handicap factors of a boat in thousandths, by wind band; null where the boat has no certificate
    "ratings": (
        "part",
        [
            "p_partkey AS boat_id",
            "p_brand AS class",
            "CASE WHEN p_size % 5 <> 0 THEN 880 + p_size * 4 END AS tot_low",
            "CASE WHEN p_size % 5 <> 0 THEN CAST(900 + p_partkey % 60 * 3 AS INT) END AS tot_medium",
            "CASE WHEN p_size % 5 <> 0 THEN CAST(1080 - p_size * 3 + p_partkey % 40 AS INT) END AS tot_high",
            "CAST(500 + p_size AS INT) AS tod",
        ],
    ),
    # certificates on file and the register that says whose they are
    "certificates": (
        "part",
        [
            "CASE WHEN p_size % 7 <> 0 THEN 'C' || CAST(p_partkey AS STRING) END AS cert_ref",
            "CAST(900 + p_size * 4 AS INT) AS tot",
            "CAST(880 + p_size * 4 + p_partkey % 13 * 5 AS INT) AS tot_low",
            "CAST(920 + p_size * 4 - p_partkey % 11 * 5 AS INT) AS tot_high",
        ],
    ),
    "cert_register": (
        "part",
        [
            "p_partkey AS reg_no",
            "p_name || ' ' || CAST(p_partkey % 50 AS STRING) AS name",
            "CAST(20000 + CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS sail",
            "p_type || '-' || p_brand AS class",
            "CASE WHEN p_size % 3 = 0 THEN 'C' || CAST(p_partkey AS STRING) END AS cert_ref",
        ],
    ),
    "cert_wanted": (
        "part",
        [
            "p_partkey AS boat_id",
            "p_name || ' ' || CAST(CASE WHEN p_size < 20 THEN p_partkey % 50 ELSE p_partkey % 97 END AS STRING) AS name",
            "CAST(20000 + CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS sail",
            "lower(p_type) || ' ' || p_brand AS class",
        ],
    ),
    # noisy entity register: names, identifiers and classes as typed by hand
    "boats": (
        "part",
        [
            "p_partkey AS boat_id",
            "CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || ' **' "
            "WHEN 2 THEN replace(p_name, ' ', '   ') WHEN 3 THEN p_name || ' ??' "
            "WHEN 4 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Sail ' || CAST(20000 + CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) ELSE "
            "p_name || '''s' END WHEN 5 THEN replace(p_name, ' ', ' & ') ELSE p_name END AS name",
            "CASE p_partkey % 9 WHEN 0 THEN '???' WHEN 1 THEN NULL WHEN 2 THEN '0' "
            "WHEN 3 THEN '# ' || CAST(20000 + CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) "
            "WHEN 4 THEN 'can ' || CAST(100 + p_size AS STRING) WHEN 5 THEN 'X' || CAST(p_size % 10 AS STRING) || 'X' "
            "ELSE CAST(20000 + CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) END AS sail",
            "CASE CAST(substr(p_brand, 7) AS INT) % 9 WHEN 0 THEN 'J' || substr(p_brand, 7) "
            "WHEN 1 THEN 'j/' || substr(p_brand, 7) || ' ib' WHEN 2 THEN 'C & C ' || substr(p_brand, 7) "
            "WHEN 3 THEN 'A' || CAST(p_size % 5 AS STRING) || '/' || CAST(p_size AS STRING) WHEN 4 THEN 'e22' "
            "WHEN 5 THEN 'Far 30 ??' WHEN 6 THEN NULL WHEN 7 THEN 'J29' ELSE p_type END AS raw_class",
            "CASE WHEN p_size % 2 = 0 THEN ' Home  Club ' END AS club",
            "CAST(1995 + p_size % 7 AS INT) AS first_period",
            "CASE WHEN p_partkey % 4 = 0 THEN 'helm' ELSE 'boat' END AS participant_type",
        ],
    ),
    # entries of another results archive, and our own boats to be matched with them
    "outside_entries": (
        "part",
        [
            "p_partkey AS entry_id",
            "CAST(1995 + p_size % 7 AS INT) AS period",
            "p_name || ' ' || CAST(p_partkey % 40 AS STRING) AS name",
            "CASE WHEN p_partkey % 5 = 0 THEN 'CAN ' ELSE '' END || CAST(300 + p_partkey % 700 AS STRING) AS sail",
            "p_type AS type",
            "CASE p_partkey % 3 WHEN 0 THEN 'BOB SMITH ' WHEN 1 THEN 'Robert Smith ' ELSE 'bob  smith ' END "
            "|| CAST(p_size % 4 AS STRING) AS skipper",
        ],
    ),
    "own_boats": (
        "part",
        [
            "p_partkey AS boat_id",
            "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' ' || CAST(p_partkey % 60 AS STRING) "
            "WHEN 1 THEN replace(p_name, ' ', '-') || CAST(p_partkey % 60 AS STRING) "
            "ELSE 'Unseen ' || CAST(p_partkey AS STRING) END AS name",
            "CASE WHEN p_partkey % 9 = 0 THEN '999' ELSE CAST(250 + p_partkey % 800 AS STRING) END AS sail",
            "CASE WHEN p_size % 3 > 0 THEN lower(p_type) ELSE '' END AS class",
        ],
    ),
    "registry": (
        "part",
        [
            "p_partkey AS reg_no",
            "CASE WHEN p_partkey % 2 = 0 THEN 'Unseen ' || CAST(p_partkey AS STRING) ELSE p_name END AS name",
            "CASE WHEN p_size % 2 = 0 THEN 'ann lee ' || CAST(p_size AS STRING) END AS owner",
        ],
    ),
    # hourly observations; their thirty days are laid out over the calendar of the contests
    "observations": (
        "events",
        [
            "event_id AS obs_id",
            "user_id AS station_id",
            "CAST(DATE '1995-01-01' + CAST((day(ts) - 1) * 80 + event_id % 80 AS INT) AS STRING) AS day",
            "CAST(day(ts) AS INT) AS day_no",
            "CAST(hour(ts) AS INT) AS hour",
            "CAST(round(value * 100) AS BIGINT) AS speed_c",
            "CAST(event_id * 37 % 360 AS INT) AS direction",
            "CASE WHEN event_id % 4 > 0 THEN CAST(event_id * 53 % 300 AS INT) END AS temp_d",
            "CAST(event_id * 7 % 5 AS INT) AS rain_mm",
            "CAST(event_id % 9 AS INT) AS sky",
            "event_type AS kind",
        ],
    ),
}


def cte(name: str) -> str:
    """The binding as SQL, for the oracle."""
    table, exprs = BINDINGS[name]
    return f"SELECT {', '.join(exprs)} FROM {table}"


class Tables:
    """The given tables and the roles bound to them, read lazily."""

    RAW = (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations"
    ).split()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self._open: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        """A table; its files are listed and its schema is read once."""
        if table not in self._open:
            self._open[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._open[table]

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.RAW:
            return self.raw(name)
        if name in BINDINGS:
            table, exprs = BINDINGS[name]
            return self.raw(table).selectExpr(*exprs)
        raise AttributeError(name)

    @cached_property
    def hot_contests(self) -> list[int]:
        return hot_groups(self.results, ["contest_id"], 2_000_000)

    @property
    def ranked(self) -> DataFrame:
        """Results with their published rank in the contest."""
        return rank_within(
            self.results,
            ["contest_id"],
            "metric",
            [F.col("boat_id"), F.col("line_no"), F.col("entity_id")],
            descending=True,
            hot=self.hot_contests,
        )

    @property
    def contests(self) -> DataFrame:
        return self.contest_headers.join(self.series, "series_id")

    @property
    def star(self) -> DataFrame:
        """Ranked results with their contest and event."""
        return self.ranked.join(self.contests, "contest_id")

    @cached_property
    def marked(self) -> DataFrame:
        """Events with their counts and the marks by which views of one event are told; worked out once for a query."""
        from podium.plans.events import marked

        return marked(self)

    @cached_property
    def skipped(self) -> DataFrame:
        """(event_id, special, variant) of the events that leaderboards leave out, one row each.

        Worked out once in an application for a folder of tables, which are taken not to change, and written to the shared
        folder; every board then reads this small table instead of working out the scope again.
        """
        from podium.plans.events import skip_flags

        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _SCOPES:
            path = fresh_folder(self.spark, "scope")
            skip_flags(self).write.parquet(path)
            _SCOPES[key] = path
        return self.spark.read.schema("event_id long, special boolean, variant boolean").parquet(_SCOPES[key])

    @cached_property
    def open_contests(self) -> DataFrame:
        """Contests of events that are neither special nor another view of an event."""
        from podium.operators.scope import exclude

        return exclude(self.contests, self.skipped, on="event_id")

    @property
    def scoped(self) -> DataFrame:
        """Star of the open contests without no-shows: the scope of most leaderboards."""
        from podium.operators.scope import showed_up

        return self.ranked.where(showed_up("status")).join(self.open_contests, "contest_id")

    @property
    def best(self) -> DataFrame:
        """Best rank of each entity in each contest, within scope."""
        return self.scoped.groupBy("contest_id", "entity_id", "period", "event_id", "event_type").agg(
            F.min("rank").alias("rank")
        )


CTES: dict[str, str] = {
    **{name: cte(name) for name in BINDINGS},
    "ranked": """SELECT *, CAST(row_number() OVER (PARTITION BY contest_id
        ORDER BY metric DESC, boat_id, line_no, entity_id) AS BIGINT) AS rank FROM results""",
    "contests": "SELECT * FROM contest_headers JOIN series USING (series_id)",
    "star": "SELECT * FROM ranked JOIN contests USING (contest_id)",
    "open_contests": "SELECT * FROM contests WHERE event_id NOT IN (SELECT event_id FROM skipped)",
    "scoped": """SELECT * FROM star WHERE event_id NOT IN (SELECT event_id FROM skipped)
        AND (status IS NULL OR status NOT IN ('DNS', 'DNC'))""",
    "best": """SELECT contest_id, entity_id, period, event_id, event_type, min(rank) AS rank
        FROM scoped GROUP BY ALL""",
}

NEEDS: dict[str, list[str]] = {
    "ranked": ["results"],
    "contests": ["contest_headers", "series"],
    "star": ["ranked", "contests"],
    "open_contests": ["contests", "skipped"],
    "scoped": ["star", "skipped"],
    "best": ["scoped"],
}


def define(name: str, needs: list[str], sql: str) -> None:
    """Add a role that is put together elsewhere."""
    CTES[name] = sql
    NEEDS[name] = needs


def with_roles(sql: str) -> str:
    """Prefix ``sql`` with the role CTEs it names (all lower in the chain included)."""
    import re

    wanted: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in wanted:
            wanted.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
