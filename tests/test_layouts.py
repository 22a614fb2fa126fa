"""Stored layouts and the search index: same rows, less read or rewritten."""

from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from row_tools import rows

from crmlake.functions import predicates as Pr
from crmlake.operators import mutations as M
from crmlake.operators import paging as Pg
from crmlake.operators.aggregates import Child, attach_children
from crmlake.operators.search_index import GramIndex, grams_of, literal_parts
from crmlake.plans import crm, edu
from crmlake.plans import params as P
from crmlake.plans import registry_stored as R
from crmlake.sources import layouts as L
from crmlake.sources.bindings import Bindings

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- order as a column ---------------------------------------------------------------------
def test_as_shown_tells_a_wrong_order(spark):
    df = spark.createDataFrame([(i, (i * 7) % 50) for i in range(50)], "id int, v int").repartition(5)
    right = rows(Pg.as_shown(df.orderBy("v")).select("position", "v").orderBy("position"))
    assert right == [(i + 1, i) for i in range(50)]
    wrong = rows(Pg.as_shown(df.orderBy(F.desc("v"))).select("position", "v").orderBy("position"))
    assert wrong != right and sorted(p for p, _ in wrong) == list(range(1, 51))


# ---- months --------------------------------------------------------------------------------
def test_rolling_window_and_month_to_date_prune_months(spark):
    t = Bindings.of(spark, SF)
    df = R.by_month(t, "opportunities", "ClosedAt")
    stored = L.WithTables(t, opportunities=df)
    got = crm.monthly_won_revenue(stored, P.AS_OF_ORDERS, P.MONTHS)
    assert rows(got) == rows(crm.monthly_won_revenue(t, P.AS_OF_ORDERS, P.MONTHS))
    assert "ClosedAt_month" in plan_of(got).split("PartitionFilters: [")[1].split("]")[0]
    pays = L.WithTables(t, payments=R.by_month(t, "payments", "PaymentDate"))
    got = edu.edu_kpis(pays, P.AS_OF_EDU)
    assert rows(got) == rows(edu.edu_kpis(t, P.AS_OF_EDU))
    assert any("PaymentDate_month" in p.split("]")[0] for p in plan_of(got).split("PartitionFilters: [")[1:])


def test_month_folders_keep_every_row(spark, tmp_path):
    df = spark.sql("""SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE timestamp_ntz'2024-01-31 23:59:59' + make_dt_interval(CAST(id AS INT)) END AS at
                      FROM range(400)""")
    laid = L.write_by_month(df, "at", str(tmp_path / "m"))
    assert sorted(rows(laid.select("id", "at"), "id", "at"), key=str) == sorted(rows(df, "id", "at"), key=str)
    for as_of, months in (("2025-01-31 12:00:00", 3), ("2024-02-29 00:00:00", 0), ("2024-03-31 00:00:00", 1), ("2030-01-01 00:00:00", 12)):
        plain = df.where(Pr.rolling_months("at", as_of, months))
        got = Pr.where(laid, Pr.rolling_months("at", as_of, months), Pr.in_months(laid, "at", as_of, months))
        assert sorted(rows(got, "id")) == sorted(rows(plain, "id"))
        plain = df.where(Pr.month_to_date("at", as_of))
        assert sorted(rows(Pr.where(laid, Pr.month_to_date("at", as_of), Pr.in_months(laid, "at", as_of)), "id")) == sorted(rows(plain, "id"))
    assert Pr.in_months(df, "at", "2024-01-01 00:00:00") is None


def test_undated_rows_and_rows_of_one_time_are_dealt_to_several_tasks(spark, tmp_path):
    df = spark.sql("""SELECT id, CASE WHEN id % 4 = 0 THEN timestamp_ntz'2024-02-03 00:00:00' END AS at FROM range(40000)""")
    laid = L.write_by_month(df, "at", str(tmp_path / "m"))
    sizes = rows(laid.groupBy("at_month", F.input_file_name()).count(), "at_month", "count")
    assert sum(n for _, n in sizes) == 40000 and laid.select("id").distinct().count() == 40000
    # a task writes a file per month: four tasks share the rows, about alike
    assert max(n for _, n in sizes) < 15000 and sum(m is None for m, _ in sizes) >= 3


# ---- buckets -------------------------------------------------------------------------------
def test_bucketed_children_are_not_shuffled(spark, tmp_path):
    # one parent holds a third of the children
    child = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 1000 END AS pid", "id AS cid")
    parent = spark.range(1000).withColumnRenamed("id", "pk")
    laid = L.write_buckets(child, "pid", 4, str(tmp_path / "c"))
    laid_parent = L.write_buckets(parent, "pk", 4, str(tmp_path / "p"))

    def report(p, c):
        return attach_children(p, "pk", [Child(c, "pid", {"n": F.count(F.lit(1)), "top": F.max("cid")})])
    got = report(laid_parent, laid)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(report(laid_parent, laid)) and "Exchange" in plan_of(report(parent, child))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(rows(got)) == sorted(rows(report(parent, child)))


def test_registered_bucketed_lists_shuffle_no_child(spark):
    t = Bindings.of(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(R.s09_bucketed(t))
        child = plan[:plan.index("bucketed_")]
        assert child.count("Exchange") == plan.count("Exchange") or "Exchange" not in child.split("FileScan")[-1]
        deep = [ln for ln in plan_of(R.q25_bucketed(t)).splitlines()]
        scan = next(i for i, ln in enumerate(deep) if "FileScan" in ln and "bucketed_" in ln)
        indent = len(deep[scan]) - len(deep[scan].lstrip(" :+-*()0123456789"))
        above = []
        for ln in reversed(deep[:scan]):
            own = len(ln) - len(ln.lstrip(" :+-*()0123456789"))
            if own < indent:
                above.append(ln)
                indent = own
            if "Join" in ln and own <= indent:
                break
        assert above and not any("Exchange" in ln for ln in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_grow_in_number_with_the_largest_table(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_BUCKET", 500)
    assert L.buckets_for(spark.range(10), spark.range(6001), least=8) == 13
    assert L.buckets_for(spark.range(0), least=8) == 8
    t = Bindings(spark, SF)
    most = -(-t.opportunities.count() // 500)
    got = R.q05_bucketed(t)
    assert most > P.BUCKETS and plan_of(got).count(f"SelectedBucketsCount: {most} out of {most}") >= 2
    assert sorted(rows(got), key=str) == sorted(rows(crm.customer_list(t)), key=str)


# ---- key ranges ----------------------------------------------------------------------------
def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_folders_of_key_ranges_grow_with_the_table_and_not_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "shared_folder", lambda _, name: str(tmp_path / name))
    base = spark.range(-300, 500).selectExpr("id * 700 AS TicketID", "concat('n', id) AS Subject")
    keys = spark.range(0, 500, 3).selectExpr("id * 700 AS TicketID")
    t = L.WithTables(SimpleNamespace(spark=spark), tickets=base)
    left = R._changed_in_place(t, "tickets", "TicketID", keys, lambda part: M.delete_by_key(part, keys, "TicketID"))
    assert sorted(rows(left)) == [(i * 700, f"n{i}") for i in range(-300, 500) if i < 0 or i % 3]
    assert len(list((tmp_path / "ranges-tickets").glob("key_range=*"))) <= L.FOLDERS
    assert L.range_width(base, "TicketID", 10_000) == 10_000
    assert L.range_width(base.where("false"), "TicketID", 500) == 500
    assert L.range_width(spark.range(500 * (L.FOLDERS - 1)), "id", 500) == 500


def test_changes_rewrite_only_the_ranges_they_touch(spark, tmp_path):
    base = spark.range(1, 1001).selectExpr("id", "concat('n', id) AS name")
    path = tmp_path / "t"
    L.write_key_ranges(base, "id", str(path), 100)
    first = files_of(path)
    assert len({f.split("/")[0] for f in first}) == 11
    changes = spark.createDataFrame([(5, "five"), (250, "two fifty"), (99_999, "no such row"), (None, "no key")], "id long, name string")
    L.change_key_ranges(spark, "id", str(path), base.schema, changes, lambda part: M.update_by_key(part, changes, "id", ["name"]), 100)
    second = files_of(path)
    untouched = {f for f in first if f.split("/")[0] not in ("key_range=0", "key_range=2")}
    assert untouched <= set(second) and all(first[f] == second[f] for f in untouched)
    assert not {f for f in first if f not in untouched} & set(second)
    want = {i: f"n{i}" for i in range(1, 1001)} | {5: "five", 250: "two fifty"}
    assert dict(rows(L.read_key_ranges(spark, "id", str(path), base.schema))) == want
    # delete all of one folder and a part of another; then write into the emptied one again
    gone = spark.range(100, 205)
    L.change_key_ranges(spark, "id", str(path), base.schema, gone, lambda part: M.delete_by_key(part, gone, "id"), 100)
    want = {i: n for i, n in want.items() if not 100 <= i < 205}
    assert dict(rows(L.read_key_ranges(spark, "id", str(path), base.schema))) == want
    back = spark.createDataFrame([(150, "again")], "id long, name string")
    L.change_key_ranges(spark, "id", str(path), base.schema, back, lambda part: part.unionByName(back), 100)
    assert dict(rows(L.read_key_ranges(spark, "id", str(path), base.schema))) == want | {150: "again"}


def test_the_read_of_a_change_is_pruned(spark, tmp_path):
    base = spark.range(1, 2001).selectExpr("id", "id AS v")
    path = str(tmp_path / "t")
    L.write_key_ranges(base, "id", path, 100)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    keys = spark.createDataFrame([(5,), (1999,)], "id long")
    L.change_key_ranges(spark, "id", path, base.schema, keys, lambda part: part.mapInArrow(count, part.schema), 100)
    assert 0 < seen.value <= 3 * 201          # two folders, whatever the number of evaluations
    assert L.read_key_ranges(spark, "id", path, base.schema).count() == 2000


# ---- search index ---------------------------------------------------------------------------
def test_grams_of_patterns():
    assert literal_parts(r"ab%c_d\%e\\f") == ["ab", "c", "d%e\\f"]
    assert grams_of("abcd%bcd_xy") == ["abc", "bcd"] and grams_of("ab") == [] and grams_of("%%") == []


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    names = ["Nguyễn Văn An", "nguyen van an", "ΟΔΥΣΣΕΥΣ", "50% off_now", "back\\slash", "", None, "ab", "straße", "😀😀😀😀"]
    rows_ = [(i, names[i % len(names)], f"city {i // 40}" if i % 3 else None) for i in range(400)]
    path = str(tmp_path_factory.mktemp("grams"))
    spark.createDataFrame(rows_, "id int, name string, city string").repartitionByRange(8, "id").write.parquet(f"{path}/t")
    return {m: GramIndex.build(spark, f"{path}/t", ["name", "city"], f"{path}/{m}", m) for m in ("binary", "ci")}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(q=st.one_of(st.sampled_from(["Nguyễn", "nguyen", "NGUYEN", "δυσ", "σς", "ευς", "50%", "50\\%", "%off", "f_n", "k\\\\s", "city 3", "CITY",
                                    "ty 7", "a", "", "  ", "zzzz", "ß", "SS", "traße", "😀😀😀", "an%city", "_yễn%", "ab%"]),
                   st.text(alphabet="aeinvyc t0%_ễΣσ", max_size=6)))
def test_indexed_search_equals_the_scan(spark, indexed, q):
    for mode, index in indexed.items():
        whole = spark.read.parquet(index.table)
        want = sorted(rows(Pr.where(whole, Pr.search(index.columns, q, mode)), "id"))
        assert sorted(rows(index.search(q), "id")) == want


def test_indexed_search_reads_fewer_files(spark, indexed):
    index = indexed["binary"]
    assert len(index.files("city 3")) == 2 and index.files("zzzz") == [] and index.files("ab") is None
    assert len(index.search("city 3").inputFiles()) == 2
    assert len(index.search("ab").inputFiles()) == 8                       # under three characters: the whole table
    assert len(index.search("city 3", mode="ci").inputFiles()) == 8        # another mode than the index has
    assert index.search("city 3", mode="ci_ai").count() == index.search("city 3").count()


def test_a_written_list_takes_dense_files(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "concat('Deal ', id) AS Title").repartition(3)
    listed = Pg.PagedList.build(df, [("id", "desc")], str(tmp_path / "l"))
    files = [f.name for name in ("unsorted", "rows") for f in (tmp_path / "l" / name).rglob("*.parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert rows(listed.page(2, 10).orderBy("row_num"), "id", "row_num") == [(299 - i, i + 1) for i in range(10, 20)]
