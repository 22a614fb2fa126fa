"""Table-maintenance operators: keys, defaults, transitions, deletes, guards."""

import pytest
from row_tools import rows
from pyspark.sql import functions as F

from crmlake.operators import mutations as M
from crmlake.operators.audit import audit_violations, integrity_audit
from crmlake.sources import schemas as S

AS_OF = "2025-06-20 12:00:00"


def test_append_assigns_keys_in_order_and_defaults(seed, spark):
    new = spark.createDataFrame([(3, "", "B ticket", None, 2), (1, "4", "A ticket", "High", 1)],
                                "CustomerID long, EmployeeID string, Subject string, Priority string, seq int")
    out = M.append(new, S.SUPPORT_TICKETS, AS_OF, ["seq"], 5, optional=["EmployeeID"])
    got = rows(out.filter("TicketID > 5").orderBy("TicketID"), "TicketID", "Subject", "EmployeeID",
               "Priority", "Status")
    assert got == [(6, "A ticket", 4, "High", "Open"), (7, "B ticket", None, "Medium", "Open")]
    assert out.filter("TicketID > 5").select(F.col("CreatedAt").cast("string")).first()[0] == AS_OF
    assert out.count() == 2          # the new rows, not the table


def test_update_by_key_assigns_null_and_keeps_others(seed, spark):
    ch = spark.createDataFrame([(1, "Enterprise", None)], "CustomerID long, Segment string, AssignedTo long")
    out = M.update_by_key(seed.customers, ch, "CustomerID", ["Segment", "AssignedTo"])
    assert rows(out.filter("CustomerID = 1"), "Segment", "AssignedTo") == [("Enterprise", None)]
    assert rows(out.filter("CustomerID = 2"), "Segment", "AssignedTo") == [("SMB", 1)]


def test_update_last_writer_wins_by_seq(seed, spark):
    ch = spark.createDataFrame([(1, "A", 1), (1, "B", 3), (1, "C", 2)], "CustomerID long, Segment string, seq int")
    out = M.update_by_key(seed.customers, ch, "CustomerID", ["Segment"], seq="seq")
    assert rows(out.filter("CustomerID = 1"), "Segment") == [("B",)]


def test_stamp_on_transition_resolve_and_close(seed, spark):
    ch = spark.createDataFrame([(4, "Resolved"), (1, "Closed")], "TicketID long, Status string")
    out = M.stamp_on_transition(seed.tickets, ch, "TicketID", "Status", "ResolvedAt", ["Resolved"], AS_OF)
    got = {r[0]: (r[1], r[2] and str(r[2])) for r in rows(out, "TicketID", "Status", "ResolvedAt")}
    assert got[4] == ("Resolved", AS_OF)
    assert got[1] == ("Closed", None)          # moving to Closed erases ResolvedAt
    assert got[3] == ("Resolved", "2025-06-08 09:00:00")  # untouched rows keep their stamp


def test_stamp_preserve_existing_for_deals(seed, spark):
    ch = spark.createDataFrame([(6, "Closed Won"), (1, "Closed Lost"), (8, "Negotiation")],
                               "OpportunityID long, Stage string")
    re = M.stamp_on_transition(seed.opportunities, ch, "OpportunityID", "Stage", "ClosedAt", S.CLOSED_STAGES, AS_OF)
    keep = M.stamp_on_transition(seed.opportunities, ch, "OpportunityID", "Stage", "ClosedAt", S.CLOSED_STAGES,
                                 AS_OF, preserve_existing=True)
    r1 = {r[0]: str(r[1]) if r[1] else None for r in rows(re, "OpportunityID", "ClosedAt")}
    r2 = {r[0]: str(r[1]) if r[1] else None for r in rows(keep, "OpportunityID", "ClosedAt")}
    assert r1[6] == AS_OF and r2[6] == "2025-06-01 10:00:00"
    assert r1[1] == r2[1] == AS_OF and r1[8] is None


def test_delete_cascade_leaves_no_orphans(seed, spark):
    keys = spark.createDataFrame([(6,), (None,)], "CustomerID long")
    out = M.delete_cascade(seed.customers, "CustomerID", {
        "tickets": (seed.tickets, "CustomerID"), "interactions": (seed.interactions, "CustomerID"),
        "opportunities": (seed.opportunities, "CustomerID")}, keys)
    assert out["parent"].count() == 7 and out["tickets"].count() == 3
    audit = integrity_audit({"Customers": out["parent"], "SupportTickets": out["tickets"],
                             "Interactions": out["interactions"], "Opportunities": out["opportunities"]})
    assert audit.filter("check_name = 'foreign_key' AND violations > 0").count() == 0


def test_delete_nullify_reports_restricted_children(seed, spark):
    keys = spark.createDataFrame([(2,)], "EmployeeID long")
    out = M.delete_nullify(seed.employees, "EmployeeID", {"customers": (seed.customers, "AssignedTo")}, keys,
                           cascade={"interactions": (seed.interactions, "EmployeeID")},
                           restrict={"opportunities": (seed.opportunities, "EmployeeID")})
    assert out["customers"].filter("AssignedTo IS NULL").count() == 4
    assert out["interactions"].count() == 5
    assert sorted(r[0] for r in rows(out["violations_opportunities"], "OpportunityID")) == [3, 4, 5, 8]


def test_guarded_delete_keeps_last_admin(seed, spark):
    both = spark.createDataFrame([(1,), (2,)], "UserID long")
    out = M.guarded_delete(seed.users, both)
    assert rows(out["users"], "UserID") == [(1,)] and rows(out["refused"], "UserID") == [(1,)]
    more = seed.users.unionByName(spark.createDataFrame(
        [(3, "root", "x", "admin", "Root", "Active")],
        "UserID long, Username string, Password string, Role string, FullName string, Status string"),
        allowMissingColumns=True)
    out2 = M.guarded_delete(more, spark.createDataFrame([(1,)], "UserID long"))
    assert sorted(r[0] for r in rows(out2["users"], "UserID")) == [2, 3]


ADMIN_SCHEMA = "UserID long, Role string, Status string"


@pytest.mark.parametrize("admins,batch,refused", [
    ([(1, "Active"), (2, "Inactive")], [2], [2]),                  # one active left: no admin goes
    ([(1, "Active"), (2, "Active")], [1, 2], [2]),                 # the first goes, the second stays
    ([(1, "Active"), (2, "Active"), (3, "Inactive")], [1, 3], [3]),
    ([(1, "Active"), (2, "Active"), (3, "Inactive")], [2, 3], [3]),
    ([(1, "Inactive"), (2, "Active"), (3, "Active")], [1, 2], []),
    ([(1, "Active"), (2, "Active"), (3, "Active")], [1, 2, 3], [3]),
    ([(1, "Inactive")], [1], [1]),
])
def test_guarded_delete_equals_one_by_one(spark, admins, batch, refused):
    users = spark.createDataFrame([(u, "admin", s) for u, s in admins] + [(9, None, None)], ADMIN_SCHEMA)
    out = M.guarded_delete(users, spark.createDataFrame([(u,) for u in [*batch, 9]], "UserID long"))
    assert sorted(r[0] for r in rows(out["refused"], "UserID")) == refused
    kept = [u for u, _ in admins if u not in batch or u in refused]
    assert sorted(r[0] for r in rows(out["users"], "UserID")) == kept


def test_unordered_changes_for_one_key_raise(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(Exception, match="several changes"):
        M.update_by_key(base, twice, "k", ["v"]).collect()
    once = spark.createDataFrame([(1, None), (None, "n"), (None, "m")], "k long, v string")
    assert sorted(map(tuple, M.update_by_key(base, once, "k", ["v"]).collect())) == [(1, None), (2, "b")]


def test_signup_outcomes_in_reference_order(seed, spark):
    req = spark.createDataFrame([
        (1, "admin", "secret1", "secret1", "A"),      # taken
        (2, "bob", "secret1", "secret1", "B"),        # username too short
        (3, "carol", "abc", "abc", "C"),              # password too short
        (4, "dave", "secret1", "secret2", "D"),       # mismatch
        (5, "  ", "secret1", "secret1", "E"),         # blank after strip
        (6, " erin ", "secret1", "secret1", "Erin"),  # ok (stripped)
        (7, "erin", "secret9", "secret9", "Erin2"),   # duplicate of an earlier request
    ], "seq long, Username string, Password string, Confirm string, FullName string")
    got = dict(rows(M.signup_outcomes(req, seed.users), "seq", "outcome"))
    assert got == {1: "duplicate", 2: "username_short", 3: "password_short", 4: "confirm_mismatch",
                   5: "missing", 6: "ok", 7: "duplicate"}
    users = M.accept_signups(M.signup_outcomes(req, seed.users), req, S.USERS, AS_OF, 2)
    assert rows(users.filter("UserID = 3"), "Username", "Role", "Status") == [("erin", "guest", "Inactive")]


def test_derive_accounts_insert_ignore_within_batch(seed, spark):
    people = spark.createDataFrame([(10, "x.y@a.vn", "First"), (11, "X.Y@b.vn", "Second"), (12, None, "NoMail")],
                                   "EmployeeID long, Email string, FullName string")
    out = M.derive_accounts(people, seed.users, S.USERS, AS_OF, 2)
    assert rows(out, "UserID", "Username", "EmployeeID", "FullName") == [(3, "x_y", 10, "First")]


def test_audit_finds_duplicates_nulls_orphans(spark):
    emp = spark.createDataFrame([(1, "A"), (1, "B"), (2, None)], "EmployeeID long, FullName string")
    cust = spark.createDataFrame([(1, "C", 9), (2, "D", 1)], "CustomerID long, FullName string, AssignedTo long")
    out = {(r[0], r[1], r[2]): (r[3], r[4]) for r in
           rows(integrity_audit({"Employees": emp, "Customers": cust}))}
    assert out[("Employees", "primary_key", "EmployeeID")] == (2, 1)
    assert out[("Employees", "not_null", "FullName")] == (1, 0)
    assert out[("Customers", "foreign_key", "AssignedTo")] == (1, 1)


def test_tableset_reads_contract_folders(spark, seed, tmp_path):
    from crmlake.plans import crm
    from crmlake.sources.tableset import TableSet
    root = str(tmp_path)
    for attr in ("customers", "employees", "opportunities", "tickets", "interactions"):
        df = getattr(seed, attr)
        name = {"tickets": "SupportTickets"}.get(attr, attr.capitalize())
        df.write.parquet(f"{root}/{name}")
    ts = TableSet.files(spark, root)
    assert crm.crm_kpis(ts).first().won_value == 15_000_000


def test_appends_follow_the_recorded_mark(spark, seed, tmp_path):
    from crmlake.sources.tableset import TableSet
    root = str(tmp_path)
    seed.tickets.write.parquet(f"{root}/SupportTickets")
    ts = TableSet.files(spark, root)
    new = spark.createDataFrame([(i, 1, f"Later {i}") for i in range(3)], "seq long, CustomerID long, Subject string")
    for _ in range(2):
        ts.append("tickets", M.append(new, S.SUPPORT_TICKETS, AS_OF, ["seq"], ts.after("tickets", "TicketID")))
    assert sorted(r[0] for r in rows(ts.tickets, "TicketID")) == list(range(1, 12))
    # a recorded mark is used as it is: the base is not asked, even for keys above it
    assert ts._marks().last("SupportTickets") == 11 and ts.after("tickets", "TicketID") == 11
    ts._marks().record("SupportTickets", 100)
    assert ts.after("tickets", "TicketID") == 100
    # nothing to add: no mark, no file
    ts.append("tickets", M.append(new.limit(0), S.SUPPORT_TICKETS, AS_OF, ["seq"], 100))
    assert ts.tickets.count() == 11 and ts._marks().last("SupportTickets") == 100


def test_an_append_does_not_read_its_base(spark):
    """Once the mark is recorded, no base table is in the plan of the new rows."""
    from crmlake.plans import maintenance as MT
    from crmlake.sources.bindings import Bindings
    t = Bindings.of(spark, "/root/testdata/sf0.001")
    df = MT.log_ticket_activity(t, AS_OF)
    assert "events" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == t.view("c_ticket_activity").count()


def test_replace_rows_and_changed_only(seed, spark):
    ch = spark.createDataFrame([(2, "SMB"), (99, "SMB")], "CustomerID long, Segment string")
    changed = M.update_by_key(seed.customers, ch, "CustomerID", ["Segment"], changed_only=True)
    assert rows(changed, "CustomerID", "Segment") == [(2, "SMB")]
    whole = M.update_by_key(seed.customers, ch, "CustomerID", ["Segment"])
    assert sorted(rows(M.replace_rows(seed.customers, changed, "CustomerID")), key=str) == sorted(rows(whole), key=str)


@pytest.mark.parametrize("mode,names,outcomes", [
    ("binary", ["José", "jose", "ana"], ["ok", "ok", "ok", "ok"]),
    ("ci_ai", ["ana"], ["duplicate", "ok", "duplicate", "duplicate"])])
def test_usernames_under_the_collation(spark, mode, names, outcomes):
    people = spark.createDataFrame([(1, "Jose@x", "A"), (2, "José@x", "B"), (3, "ana@x", "C"), (4, "ana@y", "D")],
                                   "EmployeeID long, Email string, FullName string")
    users = spark.createDataFrame([(1, "JOSÉ ")], "UserID long, Username string")
    got = M.derive_accounts(people, users, S.USERS, AS_OF, 1, mode=mode)
    assert sorted(r[0].lower() for r in rows(got, "Username")) == sorted(n.lower() for n in names)
    req = spark.createDataFrame([(1, "josé"), (2, "Bảo An"), (3, "bao an"), (4, "BAO AN  ")], "seq long, Username string") \
        .selectExpr("*", "'secret1' AS Password", "'secret1' AS Confirm", "'Name' AS FullName")
    assert [r[0] for r in rows(M.signup_outcomes(req, users, mode=mode).orderBy("seq"), "outcome")] == outcomes


def test_audit_violations_list_the_offending_values(spark):
    from crmlake.operators.audit import audit_violations
    emp = spark.createDataFrame([(1, "A"), (1, "B"), (2, None)], "EmployeeID long, FullName string")
    cust = spark.createDataFrame([(1, "C", 9), (2, "D", 1), (3, "E", 9)],
                                 "CustomerID long, FullName string, AssignedTo long")
    got = sorted(rows(audit_violations({"Employees": emp, "Customers": cust})))
    assert got == [("Customers", "foreign_key", "AssignedTo", "9", 2),
                   ("Employees", "not_null", "FullName", "2", 1),
                   ("Employees", "primary_key", "EmployeeID", "1", 2)]


def test_audit_under_the_collation_and_by_text_keys(spark):
    from crmlake.operators.audit import audit_violations
    from crmlake.sources.schemas import Col, STR, Table
    a = Table("A", "Code", (Col("Code", STR, False, max_len=3), Col("Name", STR)), ("Name",))
    b = Table("B", "Id", (Col("Id", STR, False), Col("ACode", STR)), (), (("ACode", "A", "Code"),))
    ta = spark.createDataFrame([("x", "Nguyễn"), ("y", "nguyen  "), ("long", None), (None, "z"), ("X", "w")], "Code string, Name string")
    tb = spark.createDataFrame([("1", "x"), ("2", "X "), ("3", "no"), ("3", None), ("4", "no")], "Id string, ACode string")
    tables, contracts = {"A": ta, "B": tb}, {"A": a, "B": b}
    exact = sorted(rows(audit_violations(tables, contracts)), key=str)
    assert exact == sorted([("A", "max_length", "Code", "long", 1), ("A", "not_null", "Code", None, 1), ("B", "primary_key", "Id", "3", 2),
                            ("B", "foreign_key", "ACode", "X ", 1), ("B", "foreign_key", "ACode", "no", 2)], key=str)
    loose = sorted(rows(audit_violations(tables, contracts, mode="ci_ai")), key=str)
    assert loose == sorted([("A", "max_length", "Code", "long", 1), ("A", "not_null", "Code", None, 1), ("B", "primary_key", "Id", "3", 2),
                            ("A", "primary_key", "Code", "X", 2), ("A", "unique", "Name", "Nguyễn", 2),
                            ("B", "foreign_key", "ACode", "no", 2)], key=str)


def test_audit_reads_every_table_once(spark):
    """One scan per base table of each binding, in both audit plans."""
    from crmlake.plans import maintenance as MT
    from crmlake.sources.bindings import _ALIASES, BINDINGS, Bindings
    t = Bindings.of(spark, "/root/testdata/sf0.001")
    base = sum(len(BINDINGS[_ALIASES.get(v, (v,))[0]][0]) for v in MT.AUDITED.values())
    for df in (MT.audit(t), MT.audit_details(t)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert 16 <= plan.count("Relation [") <= base
        assert "Join LeftAnti" not in plan


def test_audit_shuffles_a_hot_key_as_one_row_per_task(spark):
    """Entries are combined before the exchange: its rows don't grow with a value's copies."""
    from crmlake.operators.audit import audit_violations
    emp = spark.createDataFrame([(1, "A")], "EmployeeID long, FullName string")
    cust = spark.range(0, 5000, 1, 4).selectExpr("id AS CustomerID", "'n' AS FullName", "CASE WHEN id % 3 = 0 THEN 7 ELSE 1 END AS AssignedTo")
    df = audit_violations({"Employees": emp, "Customers": cust})
    assert rows(df) == [("Customers", "foreign_key", "AssignedTo", "7", 1667)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning(domain"):]
    assert "partial_count" in first


def test_audit_sorts_no_number_to_compare_text_by_the_collation(spark):
    t = {"Employees": spark.sql("SELECT id AS EmployeeID, 'x' AS FullName, concat('A', id % 40, '@b') AS Email FROM range(100)"),
         "Customers": spark.sql("SELECT id % 90 AS CustomerID, 'y' AS FullName, if(id % 2 = 0, 'é ', 'E') AS Email, id AS AssignedTo FROM range(120)")}
    df = audit_violations(t, mode="ci_ai")
    plan = df._jdf.queryExecution().executedPlan().toString()
    tagged = [ln for ln in plan.splitlines() if "Aggregate(key" in ln and "count(1)" in ln]
    assert tagged and not any("SortAggregate" in ln for ln in tagged)
    got = rows(df.groupBy("table_name", "check_name").agg(F.count("*").alias("n"), F.sum("rows").alias("r")))
    want = {("Employees", "unique", 40, 100), ("Customers", "primary_key", 30, 60), ("Customers", "unique", 1, 120),
            ("Customers", "foreign_key", 20, 20)}
    assert set(got) == want
    assert rows(df.where("check_name = 'unique' AND table_name = 'Customers'"), "value", "rows") == [("E", 120)]


# ---- joins of large tables -------------------------------------------------------------------
def test_large_updates_are_dealt_over_partitions_that_grow_with_the_rows(spark, monkeypatch):
    import re

    from crmlake.plans.registry import QUERIES
    from crmlake.sources import sizes as Z
    from crmlake.sources.bindings import Bindings
    sf, deals = "/root/testdata/sf0.001", QUERIES["s07_deal_transitions"].build
    plain = rows(deals(Bindings(spark, sf)))
    t = Bindings(spark, sf)
    lines = t.base("lineitem").count()
    monkeypatch.setattr(Z, "TASK_BYTES", 50_000)
    monkeypatch.setattr(Z, "SMALL_BYTES", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = deals(t)
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\d+)\)", plan)
        per_deal, per_line = (-(-Z.row_bytes(df, lines) // 50_000) for df in (t.opportunities, t.base("lineitem")))
        assert lines == t.rows("opportunities") == len(plain) and min(per_deal, per_line) > 20
        # each side once: lines and orders by the order, deals and changes by the deal
        assert sorted(dealt) == sorted([("l_orderkey", str(per_line)), ("o_orderkey", str(per_line)),
                                        ("OpportunityID", str(per_deal)), ("OpportunityID", str(per_deal))])
        assert sorted(rows(out), key=str) == sorted(plain, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_joins_of_two_large_sides_are_dealt(spark, monkeypatch):
    from crmlake.sources import sizes as Z
    monkeypatch.setattr(Z, "TASK_BYTES", 800)
    monkeypatch.setattr(Z, "SMALL_BYTES", 80)
    base, cores = spark.range(10_000), spark.sparkContext.defaultParallelism
    few, many = spark.range(10), spark.range(20_000)
    assert Z.join_partitions(base, "id", 10_000, spark.range(11), "id") == 100
    assert Z.join_partitions(base, "id", 10_001, spark.range(11), "id") == 101
    assert Z.join_partitions(base, "id", 10_000, few, "id") is None              # may be broadcast
    assert Z.join_partitions(base, "id", 100 * cores, many, "id") is None        # a partition per core holds it
    assert Z.join_partitions(base, "id", 10_000, many, "id") == 200              # by the larger side
    assert Z.join_partitions(base, "id", 10_000, many.selectExpr("cast(id AS int) AS id"), "id") is None
    changes = spark.range(0, 20_000, 7).selectExpr("id", "'x' AS v")
    want = sorted(map(tuple, M.update_by_key(base, changes, "id", ["v"]).collect()))
    got = M.update_by_key(base.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), changes, "id", ["v"], rows=10_000)
    assert sorted(map(tuple, got.where("id IS NOT NULL").collect())) == want
    assert [r.v for r in got.where("id IS NULL").collect()] == [None]
