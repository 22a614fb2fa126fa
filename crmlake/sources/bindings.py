"""Bindings: the CRM and training-centre tables expressed over the test tables.

The driver ships TPC-H-style parquet tables. Each binding is a SQL view that
renames and derives columns so that the result has the shape of one table of
the data model (``crmlake.sources.schemas``). The *same* text feeds Spark
(``spark.sql(text, table=DataFrame)``) and the DuckDB oracle (as a CTE), so
both engines see identical inputs. Bindings only shape rows; every query's
work happens in the operators, on whatever rows the bindings produce.

Mapping: employees = staff = supplier; customers = students = customer;
products = part; opportunities = lineitem x orders; interactions =
consultations = events; tickets = enrollments = orders; payments = lineitem;
classes = nation; courses = region; feedbacks = conversations; users =
supplier; activity log = events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crmlake.session import ensure_checkpoint_dir
from crmlake.sources.sinks import KeyMarks
from crmlake.sources.sizes import join_partitions

# Dialect tokens: the only spellings that differ between Spark SQL and DuckDB.
_DIALECT = {
    "spark": {"TS0": "TIMESTAMP_NTZ '2020-01-01 00:00:00'", "TS1997": "TIMESTAMP_NTZ '1997-01-01 00:00:00'"},
    "duckdb": {"TS0": "TIMESTAMP '2020-01-01 00:00:00'", "TS1997": "TIMESTAMP '1997-01-01 00:00:00'"},
}

BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "b_employees": (("supplier", "nation", "region"), """
SELECT s.s_suppkey AS EmployeeID, s.s_name AS FullName,
       lower(replace(s.s_name, '#', '.')) || '@staff.example' AS Email,
       '08' || lpad(CAST(s.s_suppkey AS VARCHAR(20)), 8, '0') AS Phone,
       r.r_name AS Department,
       CASE WHEN s.s_acctbal > 5000 THEN 'Senior' ELSE 'Junior' END AS Role,
       CASE WHEN s.s_suppkey % 4 = 3 THEN 'Inactive' ELSE 'Active' END AS Status
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey"""),
    "b_customers": (("customer", "nation", "region"), """
SELECT c.c_custkey AS CustomerID, c.c_name AS FullName,
       lower(replace(c.c_name, '#', '.')) || '@mail.example' AS Email,
       '09' || lpad(CAST(c.c_custkey AS VARCHAR(20)), 8, '0') AS Phone,
       n.n_name AS Company, c.c_mktsegment AS Segment, r.r_name AS Source,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_custkey % 10 END AS AssignedTo,
       {TS0} + INTERVAL '1' MINUTE * c.c_custkey AS CreatedAt,
       CASE WHEN c.c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS Status
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey"""),
    "b_products": (("part",), """
SELECT p_partkey AS ProductID, p_name AS ProductName, p_type AS Category,
       CAST(p_retailprice AS DECIMAL(15,2)) AS Price, p_brand AS Description,
       CASE WHEN p_size > 45 THEN 'Inactive' ELSE 'Active' END AS Status
FROM {part}"""),
    "b_opportunities": (("lineitem", "orders"), """
SELECT l.l_orderkey * 10 + l.l_linenumber AS OpportunityID, o.o_custkey AS CustomerID,
       l.l_suppkey AS EmployeeID, l.l_partkey AS ProductID,
       'Deal ' || CAST(l.l_orderkey AS VARCHAR(20)) || '-' || CAST(l.l_linenumber AS VARCHAR(20)) AS Title,
       CASE l.l_returnflag || l.l_linestatus WHEN 'NO' THEN 'Lead' WHEN 'NF' THEN 'Qualified'
            WHEN 'RO' THEN 'Proposal' WHEN 'AO' THEN 'Negotiation' WHEN 'RF' THEN 'Closed Won'
            ELSE 'Closed Lost' END AS Stage,
       CAST(l.l_extendedprice AS DECIMAL(15,2)) AS Value,
       CAST(round(l.l_discount * 100) AS INT) AS Probability, o.o_orderdate AS CreatedAt,
       CASE WHEN l.l_linestatus = 'F' AND l.l_returnflag IN ('R', 'A') THEN l.l_shipdate END AS ClosedAt
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"""),
    "b_interactions": (("events",), """
SELECT event_id AS InteractionID, user_id AS CustomerID, event_id % 10 AS EmployeeID,
       event_type AS Type, props AS Subject, ts AS InteractedAt
FROM {events}"""),
    "b_tickets": (("orders",), """
SELECT o_orderkey AS TicketID, o_custkey AS CustomerID,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 10 END AS EmployeeID,
       'Ticket ' || CAST(o_orderkey AS VARCHAR(20)) AS Subject,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
            WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unset' END AS Priority,
       CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress' ELSE 'Resolved' END AS Status,
       o_orderdate AS CreatedAt
FROM {orders}"""),
    "b_users": (("supplier",), """
SELECT s_suppkey AS UserID,
       CASE WHEN s_acctbal > 0 THEN lower(replace(s_name, '#', '_'))
            ELSE 'ext_' || CAST(s_suppkey AS VARCHAR(20)) END AS Username,
       'secret' AS Password, s_name AS FullName,
       CASE WHEN s_acctbal < 100 THEN 'admin' WHEN s_suppkey % 5 = 4 THEN 'guest' ELSE 'employee' END AS Role,
       CASE WHEN s_suppkey % 5 = 4 OR s_acctbal <= 0 THEN NULL ELSE s_suppkey END AS EmployeeID,
       CASE WHEN s_suppkey % 6 = 5 THEN 'Inactive' ELSE 'Active' END AS Status
FROM {supplier}"""),
    "b_activity": (("events",), """
SELECT event_id AS LogID, 'u' || CAST(user_id AS VARCHAR(20)) AS Username,
       'User ' || CAST(user_id AS VARCHAR(20)) AS FullName,
       CASE event_type WHEN 'view' THEN 'LOGIN' WHEN 'purchase' THEN 'LOGOUT' WHEN 'signup' THEN 'CREATE'
            WHEN 'click' THEN 'UPDATE' ELSE 'DELETE' END AS Action,
       CASE event_id % 6 WHEN 0 THEN 'Auth' WHEN 1 THEN 'Customer' WHEN 2 THEN 'Opportunity'
            WHEN 3 THEN 'Interaction' WHEN 4 THEN 'Ticket' ELSE 'User' END AS Module,
       props AS Description, '10.0.0.' || CAST(user_id % 250 AS VARCHAR(20)) AS IPAddress,
       ts AS CreatedAt
FROM {events}"""),
    # ---- training centre -------------------------------------------------
    "b_courses": (("region",), """
SELECT r_regionkey AS CourseID, r_name AS CourseName,
       CASE r_regionkey % 5 WHEN 0 THEN 'Lập trình' WHEN 1 THEN 'Ngoại ngữ' WHEN 2 THEN 'Kỹ năng'
            WHEN 3 THEN 'Thiết kế' ELSE 'Tin học' END AS Category,
       CAST(1000000 + 500000 * r_regionkey AS DECIMAL(12,2)) AS Fee,
       'Course of ' || r_name AS Description,
       CASE WHEN r_regionkey = 4 THEN 'Inactive' ELSE 'Active' END AS Status
FROM {region}"""),
    "b_classes": (("nation",), """
SELECT n_nationkey AS ClassID, n_regionkey AS CourseID, n_name AS ClassName,
       CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey END AS TeacherID,
       CASE WHEN n_nationkey % 8 = 7 THEN NULL
            ELSE CAST({TS0} + INTERVAL '7' DAY * n_nationkey AS DATE) END AS StartDate,
       580 + n_nationkey * 2 AS MaxStudents, 560 + n_nationkey * 3 AS CurrentStudents,
       CASE n_nationkey % 4 WHEN 0 THEN 'Upcoming' WHEN 1 THEN 'Ongoing' WHEN 2 THEN 'Completed'
            ELSE 'Cancelled' END AS Status
FROM {nation}"""),
    "b_students": (("customer",), """
SELECT c_custkey AS StudentID, c_name AS FullName,
       lower(replace(c_name, '#', '.')) || '@student.example' AS Email,
       '07' || lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS Phone,
       CASE c_nationkey % 5 WHEN 0 THEN 'Website' WHEN 1 THEN 'Facebook' WHEN 2 THEN 'Referral'
            WHEN 3 THEN 'Walk-in' ELSE 'Zalo' END AS Source,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 10 END AS AssignedTo,
       CASE c_custkey % 5 WHEN 0 THEN 'Prospect' WHEN 1 THEN 'Enrolled' WHEN 2 THEN 'Studying'
            WHEN 3 THEN 'Graduated' ELSE 'Dropped' END AS Status,
       {TS0} + INTERVAL '1' MINUTE * c_custkey AS CreatedAt
FROM {customer}"""),
    "b_enrollments": (("orders",), """
SELECT o_orderkey AS EnrollmentID, o_custkey AS StudentID, o_orderkey % 25 AS ClassID,
       o_orderkey % 10 AS StaffID, CAST(o_orderdate AS DATE) AS EnrollDate,
       CASE o_orderstatus WHEN 'O' THEN 'Confirmed' WHEN 'P' THEN 'Studying' ELSE 'Completed' END AS Status,
       CAST(o_totalprice AS DECIMAL(12,2)) AS TotalFee, CAST(0 AS DECIMAL(12,2)) AS Discount,
       CAST(o_totalprice AS DECIMAL(12,2)) AS FinalFee, o_orderdate AS CreatedAt
FROM {orders}"""),
    "b_payments": (("lineitem", "orders"), """
SELECT l.l_orderkey * 10 + l.l_linenumber AS PaymentID, l.l_orderkey AS EnrollmentID,
       o.o_custkey AS StudentID, CAST(l.l_extendedprice AS DECIMAL(12,2)) AS Amount,
       CAST(l.l_shipdate AS DATE) AS PaymentDate,
       CASE l.l_returnflag WHEN 'N' THEN 'Tiền mặt' WHEN 'R' THEN 'Chuyển khoản' ELSE 'Thẻ' END AS Method,
       l.l_suppkey AS CreatedBy, l.l_shipdate AS CreatedAt
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"""),
    "b_consultations": (("events",), """
SELECT event_id AS ConsultID, user_id AS StudentID, event_id % 10 AS StaffID,
       event_type AS Type, props AS Subject,
       CASE event_type WHEN 'purchase' THEN 'Đã đăng ký' WHEN 'signup' THEN 'Quan tâm'
            WHEN 'error' THEN 'Không quan tâm' ELSE 'Cần suy nghĩ' END AS Result,
       ts AS ConsultedAt
FROM {events}"""),
    "b_feedbacks": (("conversations",), """
SELECT conv_id * 1000 + turn AS FeedbackID, conv_id AS StudentID, conv_id % 10 AS StaffID,
       CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id % 25 END AS ClassID,
       role AS Type, text AS Subject,
       CASE turn % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Resolved'
            ELSE 'Closed' END AS Status,
       {TS0} + INTERVAL '1' SECOND * (conv_id * 1000 + turn) AS CreatedAt
FROM {conversations}"""),
    # ---- change sets for the maintenance operators (value-based rules) ----
    "c_return_tickets": (("lineitem", "orders"), """
SELECT o.o_custkey AS CustomerID, CAST(NULL AS BIGINT) AS EmployeeID,
       'Return ' || CAST(l.l_orderkey AS VARCHAR(20)) || '-' || CAST(l.l_linenumber AS VARCHAR(20)) AS Subject,
       CASE WHEN l.l_quantity >= 45 THEN 'High' END AS Priority,
       l.l_shipdate AS RequestedAt, l.l_orderkey AS src_order, l.l_linenumber AS src_line,
       l.l_partkey AS src_part, l.l_suppkey AS src_supp, l.l_quantity AS src_qty
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag = 'R'"""),
    "c_segment_changes": (("customer",), """
SELECT c_custkey AS CustomerID, 'Enterprise' AS Segment, CAST(NULL AS BIGINT) AS AssignedTo
FROM {customer} WHERE c_acctbal > 9000"""),
    "c_ticket_transitions": (("orders",), """
SELECT o_orderkey AS TicketID,
       CASE WHEN o_orderstatus = 'P' THEN 'Resolved' ELSE 'Closed' END AS Status
FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('P', 'F')"""),
    "c_deal_changes": (("orders",), """
SELECT o_orderkey * 10 + 1 AS OpportunityID,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Closed Won' WHEN '2-HIGH' THEN 'Closed Lost'
            ELSE 'Negotiation' END AS Stage
FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"""),
    "c_feedback_answers": (("conversations",), """
SELECT conv_id * 1000 + turn AS FeedbackID, 'Answer to ' || role AS Response
FROM {conversations} WHERE role = 'user'"""),
    "c_ticket_purge": (("orders",), """
SELECT o_orderkey AS TicketID FROM {orders}
WHERE o_orderstatus = 'F' AND o_orderdate < {TS1997}"""),
    "c_closed_customers": (("customer",), """
SELECT c_custkey AS CustomerID FROM {customer} WHERE c_acctbal < -900"""),
    "c_retired_products": (("part",), """
SELECT p_partkey AS ProductID FROM {part} WHERE p_size > 45"""),
    "c_leaving_employees": (("supplier",), """
SELECT s_suppkey AS EmployeeID FROM {supplier} WHERE s_acctbal < 0"""),
    "c_enrollment_requests": (("events",), """
SELECT event_id AS seq, user_id AS StudentID, event_id % 25 AS ClassID, event_id % 10 AS StaffID,
       CAST(round(value * 100000) AS DECIMAL(12,2)) AS TotalFee,
       CAST(round(value * 1000) AS DECIMAL(12,2)) AS Discount
FROM {events} WHERE event_type = 'purchase'"""),
    "c_fee_forms": (("events",), """
SELECT event_id AS seq, user_id AS StudentID, event_id % 25 AS ClassID,
       CASE event_type WHEN 'purchase' THEN ' ' || CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR(20)) || '.50 '
            WHEN 'click' THEN '' WHEN 'view' THEN 'free' WHEN 'signup' THEN NULL ELSE '  ' END AS TotalFee,
       CASE WHEN event_id % 3 = 0 THEN '100' WHEN event_id % 3 = 1 THEN ' 12.25' END AS Discount
FROM {events}"""),
    "c_user_removals": (("supplier",), """
SELECT s_suppkey AS UserID FROM {supplier} WHERE s_acctbal < 1000"""),
    "c_signups": (("customer", "nation"), """
SELECT c.c_custkey AS seq,
       CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN lower(n.n_name)
            WHEN c.c_mktsegment = 'MACHINERY' AND c.c_acctbal < 0 THEN 'ab'
            ELSE lower(replace(c.c_name, '#', '_')) END AS Username,
       'pw' || CAST(c.c_custkey AS VARCHAR(20)) AS Password,
       CASE WHEN c.c_acctbal < -500 THEN 'mismatch' ELSE 'pw' || CAST(c.c_custkey AS VARCHAR(20)) END AS Confirm,
       CASE WHEN c.c_mktsegment = 'FURNITURE' AND c.c_acctbal > 9500 THEN ' ' ELSE c.c_name END AS FullName
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey"""),
    "c_ticket_activity": (("orders",), """
SELECT 'system' AS Username, 'Ticket bot' AS FullName, 'CREATE' AS Action, 'Ticket' AS Module,
       'Ticket ' || CAST(o_orderkey AS VARCHAR(20)) AS Description, '127.0.0.1' AS IPAddress,
       o_orderdate AS CreatedAt, o_orderkey AS seq
FROM {orders} WHERE o_orderstatus = 'O'"""),
}

# Staff is the same binding as employees (same shape, StaffID key).
_ALIASES = {"b_staff": ("b_employees", {"EmployeeID": "StaffID"})}


def binding_columns(name: str) -> list[str]:
    """Output column names of a binding, read from its select list."""
    import re
    if name in _ALIASES:
        base, renames = _ALIASES[name]
        return [renames.get(c, c) for c in binding_columns(base)]
    text = BINDINGS[name][1]
    select = text.split("\nFROM ")[0]
    return re.findall(r"\bAS (\w+)\s*(?=,|\n|$)", select)


def _render(text: str, dialect: str) -> str:
    for token, spelling in _DIALECT[dialect].items():
        text = text.replace("{" + token + "}", spelling)
    return text


def oracle_views(names: list[str]) -> str:
    """``WITH`` prefix defining the named bindings for DuckDB."""
    parts = []
    for name in names:
        if name in _ALIASES:
            base, renames = _ALIASES[name]
            _, text = BINDINGS[base]
            body = _render(text, "duckdb").format(**{t: t for t in BINDINGS[base][0]})
            cols = ", ".join(f"{old} AS {new}" for old, new in renames.items())
            parts.append(f"{name} AS (SELECT *, {cols} FROM ({body}) x)")
            continue
        deps, text = BINDINGS[name]
        parts.append(f"{name} AS ({_render(text, 'duckdb').format(**{t: t for t in deps})})")
    return "WITH " + ",\n".join(parts) + "\n"


class Bindings:
    """Lazily built binding DataFrames over ``sf_dir``; one parquet read per table.

    ``Bindings.of(spark, sf_dir)`` shares one instance per session and folder,
    so file listings, footers and size checks are paid once, not per query.
    """

    _shared: dict[tuple[int, str], "Bindings"] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Bindings":
        key = (id(spark), sf_dir.rstrip("/"))
        inst = cls._shared.get(key)
        if inst is None or inst.spark is not spark:
            inst = cls._shared[key] = cls(spark, sf_dir)
        return inst

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}
        self._marks: KeyMarks | None = None
        self._stored: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        if table not in self._base:
            self._base[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._base[table]

    def base_rows(self, table: str) -> int:
        """Rows of a base table, from its Parquet footers."""
        if table not in self._rows:
            self._rows[table] = self.base(table).count()
        return self._rows[table]

    def rows(self, name: str) -> int:
        """About how many rows table ``name`` has: those of the largest table behind it."""
        return max(self.base_rows(t) for t in BINDINGS["b_" + name][0])

    def _order_lines(self) -> dict[str, DataFrame]:
        """The two large tables that bindings join, dealt by the order when they are large."""
        lines, orders = self.base("lineitem"), self.base("orders")
        n = join_partitions(lines, "l_orderkey", self.base_rows("lineitem"), orders, "o_orderkey", self.base_rows("orders"))
        if n:
            lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
        return {"lineitem": lines, "orders": orders}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view("b_" + name)

    def stored(self, name: str, store) -> DataFrame:
        """What ``store(path)`` returns for a new folder of the shared checkpoint folder, stored once per provider."""
        if name not in self._stored:
            self._stored[name] = store(f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
        return self._stored[name]

    def after(self, name: str, key: str) -> int:
        """Where new keys of table ``name`` begin (its recorded mark)."""
        if self._marks is None:
            self._marks = KeyMarks(self.spark, f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/key-marks-{uuid.uuid4().hex}")
        return self._marks.after(name, getattr(self, name), key)

    def view(self, name: str) -> DataFrame:
        if name in self._views:
            return self._views[name]
        if name in _ALIASES:
            base, renames = _ALIASES[name]
            df = self.view(base)
            for old, new in renames.items():
                df = df.withColumnRenamed(old, new)
        else:
            deps, text = BINDINGS[name]
            tables = self._order_lines() if deps == ("lineitem", "orders") else {t: self.base(t) for t in deps}
            df = self.spark.sql(_render(text, "spark"), **tables)
        self._views[name] = df
        return df
