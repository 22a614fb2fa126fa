"""Edge rows of the scalar functions, predicates, paging and aggregation operators."""

import pytest
from row_tools import rows
from pyspark.sql import functions as F

from crmlake.functions import predicates as Pr
from crmlake.functions import scalars as X
from crmlake.operators import paging as Pg
from crmlake.operators.aggregates import Child, attach_children, combine_rows, distinct_count
from crmlake.operators.joins import anti, lookup


def test_field_rank_puts_unlisted_and_null_first(spark):
    df = spark.createDataFrame([("Closed Won",), (None,), ("Weird",), ("Lead",)], "Stage string")
    out = df.orderBy(X.field_rank("Stage", ["Lead", "Closed Won"]), "Stage")
    assert [r[0] for r in out.collect()] == [None, "Weird", "Lead", "Closed Won"]


def test_bround_is_half_even_like_python(spark):
    df = spark.createDataFrame([(1, 0), (5, 3), (2, 1)], "won long, lost long")
    got = rows(df.select(X.win_rate("won", "lost").alias("r")))
    assert [g[0] for g in got] == [100.0, 62.5, 66.7]
    one = spark.range(1).select(F.bround(F.lit(6.25), 1).alias("x")).first().x
    assert one == round(6.25, 1) == 6.2


def test_win_rate_zero_when_nothing_closed_and_row_rate_blank(spark):
    df = spark.createDataFrame([(0, 0, 0)], "won long, lost long, total long")
    r = df.select(X.win_rate("won", "lost").alias("a"), X.row_win_rate("won", "total").alias("b"),
                  X.win_tier(X.row_win_rate("won", "total")).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.0, None, None)


def test_display_scalars(spark):
    long_text = "x" * 81
    df = spark.createDataFrame([(long_text, None, "", 1234567.5, "admin", "Nguyễn", 15, 0)],
                               "d string, n string, e string, m double, role string, name string, cur int, mx int")
    r = df.select(X.preview("d").alias("p"), X.preview("n").alias("pn"), X.placeholder("e").alias("ph"),
                  X.placeholder("n").alias("ph2"), X.fmt_money("m").alias("money"),
                  X.label("role", {"admin": "Admin"}, "secondary").alias("lab"),
                  X.label(F.lit("zzz"), {"admin": "Admin"}).alias("lab2"),
                  X.initial("name").alias("ini"),
                  X.occupancy_pct("cur", "mx").alias("occ")).first()
    assert r.p == "x" * 80 + "…" and r.pn == "" and r.ph == "—" and r.ph2 == "—"
    assert r.money == "1,234,568 ₫" and r.lab == "Admin" and r.lab2 == "zzz" and r.ini == "N"
    assert r.occ is None  # zero capacity: no division error


def test_occupancy_cap_and_truncation(spark):
    df = spark.createDataFrame([(25, 20), (2, 3)], "cur int, mx int")
    got = rows(df.select(X.occupancy_pct("cur", "mx").alias("a"),
                         X.occupancy_pct("cur", "mx", cap=False).alias("b"), X.is_full("cur", "mx").alias("c")))
    assert got == [(100, 125, True), (66, 66, False)]


def test_strip_and_numbers(spark):
    df = spark.createDataFrame([("\t  abc \n", "  ", "12.5", "x1")], "a string, b string, c string, d string")
    r = df.select(X.strip_ws("a").alias("a"), X.blank_to_null("b").alias("b"),
                  X.to_number("c").alias("c"), X.to_number("d").alias("d"), X.to_number("b").alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("abc", None, 12.5, 0.0, 0.0)


def test_derive_username(spark):
    df = spark.createDataFrame([("An.Nguyen@crm.vn",)], "e string")
    assert df.select(X.derive_username("e")).first()[0] == "an_nguyen"


def test_search_modes_and_wildcards(spark):
    df = spark.createDataFrame([("Nguyễn Văn An",), ("nguyen van binh",), ("50% off",), ("5x0 off",)], "n string")
    assert df.filter(Pr.search(["n"], "Nguy")).count() == 1
    assert df.filter(Pr.search(["n"], "nguyen")).count() == 1
    assert df.filter(Pr.search(["n"], "NGUY", mode="ci")).count() == 2
    assert df.filter(Pr.search(["n"], "nguyen", mode="ci_ai")).count() == 2
    # the user's % is a wildcard, as in the reference (no escaping)
    assert df.filter(Pr.search(["n"], "5%0")).count() == 2
    assert Pr.search(["n"], "   ") is None
    assert df.filter(Pr.search(["n"], " ", skip_blank=False)).count() == 4


def test_search_blank_always_applied_drops_all_null_rows(spark):
    df = spark.createDataFrame([(None, None), ("a", None)], "x string, y string")
    assert df.filter(Pr.search(["x", "y"], "", skip_blank=False)).count() == 1


def test_facets_skip_empty_values(spark):
    df = spark.createDataFrame([("SMB", 1), ("Ent", 2)], "Segment string, AssignedTo long")
    assert Pr.facets({"Segment": "", "AssignedTo": None}) is None
    assert Pr.where(df, Pr.facets({"Segment": "SMB", "AssignedTo": None})).count() == 1


def test_not_in_excludes_null(spark):
    df = spark.createDataFrame([("Lead",), (None,), ("Closed Won",)], "Stage string")
    assert df.filter(Pr.none_of("Stage", ["Closed Won"])).count() == 1


def test_rolling_months_and_month_to_date(spark):
    df = spark.createDataFrame([("2024-02-28 10:00:00",), ("2024-02-28 08:00:00",), ("2025-02-01 00:00:00",),
                                ("2025-02-27 23:00:00",)],
                               "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    # time of day is kept: 09:00 a year earlier is the bound
    assert df.filter(Pr.rolling_months("t", "2025-02-28 09:00:00", 12)).count() == 3
    # month end is clamped: 31 March minus one month is 28 February
    assert df.filter(Pr.rolling_months("t", "2025-03-31 00:00:00", 1)).count() == 0
    assert df.filter(Pr.month_to_date("t", "2025-02-15 00:00:00")).count() == 2


def _numbers(spark, n=137):
    return spark.range(n).select(F.col("id"), (F.col("id") % 7).alias("g"))


@pytest.mark.parametrize("page", [1, 3, 14, 15, 99, 0])
def test_paginate_shallow_and_deep_agree(spark, page):
    df = _numbers(spark)
    order = [("g", "desc"), "id"]
    shallow = rows(Pg.paginate(df, order, page, 10), "row_num", "id", "page")
    deep = rows(Pg.paginate(df, order, page, 10, shallow_bytes=0), "row_num", "id", "page")
    assert shallow == deep or sorted(shallow) == sorted(deep)
    eff = min(max(page, 1), 14)
    assert {r[2] for r in shallow} == {eff}
    assert sorted(r[0] for r in shallow) == list(range((eff - 1) * 10 + 1, min(eff * 10, 137) + 1))


def test_pages_partition_the_list(spark):
    df = _numbers(spark, 53)
    seen = []
    for p in range(1, 7):
        seen += [r[0] for r in rows(Pg.paginate(df, ["id"], p, 10, shallow_bytes=25), "id")]
    assert sorted(seen) == list(range(53)) and len(seen) == 53


def test_a_paged_list_is_evaluated_once_and_pruned(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(0, 500, 1, 5).selectExpr("id", "id % 50 AS g", "concat('n', id) AS name").mapInArrow(count, "id long, g long, name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # several small partitions
    lst = Pg.PagedList.build(df, ["g", "id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(range(500), key=lambda i: (i % 50, i))
    assert lst.directory.count() == 4
    for page in (1, 2, 20, 49, 50, 51, -3):
        got = lst.page(page, 10)
        eff = min(max(page, 1), 50)
        assert sorted(rows(got, "row_num", "id", "page")) == [((eff - 1) * 10 + i + 1, ordered[(eff - 1) * 10 + i], eff) for i in range(10)]
        files = {r[0].split("/__part=")[1].split("/")[0] for r in got.select(F.input_file_name()).distinct().collect()}
        assert len(files) <= 2
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "(__part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert seen.value == 500                      # seven pages, one evaluation
    again = Pg.PagedList(spark, lst.path)         # another session's view of this version
    assert rows(again.page(7, 10).orderBy("row_num"), "id") == rows(lst.page(7, 10).orderBy("row_num"), "id")
    for key in ({"g": 0}, {"g": 17}, {"g": 49}, {"g": 60}, {"g": 17, "id": 118}):
        want = [i for i in ordered if (i % 50, i) >= (key["g"], key.get("id", -1))][:10]
        assert [r[0] for r in rows(lst.page_after(key, 10).orderBy("row_num"), "id")] == want


def test_a_paged_list_without_rows(spark):
    lst = Pg.PagedList.build(_numbers(spark).limit(0), ["id"])
    assert lst.total() == 0 and lst.page(3).count() == 0 and lst.page_after({"id": 1}).count() == 0


def test_position_numbers_the_shown_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 3)], "k string, v int")
    assert sorted(rows(Pg.with_position(df, [("v", "desc")]), "position", "k")) == [(1, "d"), (2, "a"), (3, "b"), (4, "c")]


def test_page_meta_clamps(spark):
    df = _numbers(spark, 53)
    m = Pg.page_meta(df, 99, 10).first()
    assert (m.page, m.pages, m.total, m.has_prev, m.has_next, m.first_row, m.last_row) == \
        (6, 6, 53, True, False, 51, 53)
    e = Pg.page_meta(df.limit(0), 3, 10).first()
    assert (e.page, e.pages, e.total, e.has_prev, e.has_next, e.show_bar) == (1, 1, 0, False, False, False)


def test_global_index_matches_row_number(spark):
    df = _numbers(spark, 500).repartition(7)
    got = rows(Pg.global_index(df, [("g", "asc"), ("id", "desc")], "pos"), "pos", "g", "id")
    expect = sorted(((r[1], -r[2]) for r in got))
    assert [(g, i) for _, g, i in sorted(got)] == [(g, -i) for g, i in expect]
    assert sorted(r[0] for r in got) == list(range(1, 501))


def test_attach_children_has_no_fanout_and_fills_zero(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    a = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 12)], "pid long, aid long")
    b = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "pid long, bid long")
    out = attach_children(parent, "id", [Child(a, "pid", {"na": distinct_count("aid"), "ra": F.count(F.lit(1))}),
                                         Child(b, "pid", {"nb": F.count(F.lit(1))})])
    assert sorted(rows(out, "id", "na", "ra", "nb")) == [(1, 2, 3, 3), (2, 1, 1, 0), (3, 0, 0, 0)]
    filtered = attach_children(parent.filter("id = 2"), "id", [Child(a, "pid", {"na": distinct_count("aid")})],
                               prefilter=True)
    assert rows(filtered, "id", "na") == [(2, 1)]


def test_combine_rows_is_one_row(spark):
    out = combine_rows(spark.range(3).agg(F.count("*").alias("a")), spark.range(5).agg(F.sum("id").alias("b")))
    assert rows(out, "a", "b") == [(3, 10)]


def test_anti_join_ignores_null_keys(spark):
    emp = spark.createDataFrame([(1,), (2,)], "EmployeeID long")
    users = spark.createDataFrame([(1,), (None,)], "EmployeeID long")
    assert rows(anti(emp, users, "EmployeeID", "EmployeeID")) == [(2,)]


def test_deep_pages_split_duplicate_key_groups(spark):
    # 9 rows tie on the sort key g=1 and differ only in v; pages of 4 cut the group
    vals = [(0, 10)] + [(None, v) for v in range(9)] + [(2, 20), (2, 21)]
    df = spark.createDataFrame(vals, "g int, v int")
    seen = []
    for p in range(1, 4):
        page = rows(Pg.paginate(df, ["g"], p, 4, shallow_bytes=0), "row_num", "g", "v")
        assert sorted(r[0] for r in page) == list(range((p - 1) * 4 + 1, min(p * 4, 12) + 1))
        seen += [(r[1], r[2]) for r in page]
    assert sorted(seen, key=str) == sorted(vals, key=str)
    # positions agree with the shallow (top-K) strategy on the key order
    for p in range(1, 4):
        deep = sorted(r[:2] for r in rows(Pg.paginate(df, ["g"], p, 4, shallow_bytes=0), "row_num", "g"))
        top = sorted(r[:2] for r in rows(Pg.paginate(df, ["g"], p, 4), "row_num", "g"))
        assert deep == top


def test_collation_modes_for_facets_and_grouping(spark):
    from crmlake.operators.aggregates import count_by
    df = spark.createDataFrame([("SMB",), ("smb ",), ("Smb",), ("Enterprise",), ("Kỹ năng",)], "s string")
    assert df.filter(Pr.facet("s", "smb")).count() == 0
    assert df.filter(Pr.facet("s", "smb", mode="ci_ai")).count() == 3
    assert df.filter(Pr.facet("s", "ky nang", mode="ci_ai")).count() == 1
    got = sorted(r[1] for r in rows(count_by(df, ["s"], collation="UNICODE_CI_AI_RTRIM")))
    assert got == [1, 1, 3]
    assert len(rows(count_by(df, ["s"]))) == 5


def test_pages_cover_tied_rows_once_across_strategies(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").alias("v")).repartition(7)
    for limits in ([0] * 8, [10**6] * 8, [10**6] * 4 + [0] * 4):
        seen = []
        for page, limit in enumerate(limits, 1):
            seen += [r[0] for r in rows(Pg.paginate(df, ["g"], page, 10, shallow_bytes=limit), "v")]
        assert sorted(seen) == list(range(0, 160, 2))
    # an expression as the sort key, past the end
    last = [rows(Pg.paginate(df, [F.col("g").desc()], 99, 30, shallow_bytes=n), "v", "row_num") for n in (0, 10**6)]
    assert sorted(last[0]) == sorted(last[1]) and len(last[0]) == 20


@pytest.mark.parametrize("q,hits", [("a\\b", ["ab"]), ("50\\%", ["50%"]), ("\\\\", ["a\\b"]), ("_b", ["ab", "a\\b"])])
def test_search_takes_backslashes(spark, q, hits):
    df = spark.createDataFrame([("ab",), ("a\\b",), ("50%",), ("500",)], "v string")
    assert sorted(r[0] for r in df.filter(Pr.search(["v"], q)).collect()) == sorted(hits)


def test_strip_takes_unicode_space(spark):
    texts = ["\u00a0\u3000 x y\u2003\n", "\x1f\x1c", "\t\u0085z", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.strip_ws("t")).collect()]
    assert got == [t.strip() for t in texts]
