"""Registered queries over stored layouts of the bound tables, with oracle SQL.

Each stores the tables it needs once per provider in the shared checkpoint folder (by month, in
buckets, in key ranges, in several files with a search index) and asks the same question as its plain form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from crmlake.operators import mutations as M
from crmlake.operators.search_index import GramIndex
from crmlake.plans import crm, edu, registry_crm, registry_edu, registry_maintenance  # noqa: F401  (their oracles)
from crmlake.plans import params as P
from crmlake.plans.catalog import QUERIES, register
from crmlake.plans.oracle import contains
from crmlake.sources import layouts as L


def _oracle(name: str) -> dict:
    q = QUERIES[name]
    return {"views": q.views, "sql": q.sql, "ctes": q.ctes}


# ---- by month (F9, F10) ---------------------------------------------------------------------
def by_month(t, name: str, column: str) -> DataFrame:
    return t.stored(f"{name}-{column}-month", lambda path: L.write_by_month(getattr(t, name), column, path))


@register("q34_monthly_won_revenue_by_month", **_oracle("q34_monthly_won_revenue"))
def q34_by_month(t):
    """Q34/F9 monthly won revenue from opportunities stored by closing month."""
    return crm.monthly_won_revenue(L.WithTables(t, opportunities=by_month(t, "opportunities", "ClosedAt")), P.AS_OF_ORDERS, P.MONTHS)


@register("q18_edu_kpis_by_month", **_oracle("q18_edu_kpis"))
def q18_by_month(t):
    """Q18/F10 training-centre KPIs, payments stored by month."""
    return edu.edu_kpis(L.WithTables(t, payments=by_month(t, "payments", "PaymentDate")), P.AS_OF_EDU)


# ---- buckets (J7, J8, S9, S10) ----------------------------------------------------------------
def in_buckets(t, key: str, *names: str) -> dict[str, DataFrame]:
    """The named tables, in the same number of buckets of ``key``."""
    n = t.stored(f"{'-'.join(names)}-{key}-count", lambda _: L.buckets_for(*[getattr(t, x) for x in names], least=P.BUCKETS))
    return {x: t.stored(f"{x}-{key}-{n}-buckets", lambda path, x=x: L.write_buckets(getattr(t, x), key, n, path)) for x in names}


@register("q05_customer_list_bucketed", **_oracle("q05_customer_list"))
def q05_bucketed(t):
    """Q5/J7 customer list, customers and children bucketed on the customer."""
    return crm.customer_list(L.WithTables(t, **in_buckets(t, "CustomerID", "customers", "opportunities", "tickets")))


@register("q25_enrollment_list_bucketed", **_oracle("q25_enrollment_list"))
def q25_bucketed(t):
    """Q25/J8 enrollments with balances, payments bucketed on the enrollment."""
    return edu.enrollment_list(L.WithTables(t, **in_buckets(t, "EnrollmentID", "payments")))


@register("s09_tickets_snapshot_bucketed", **_oracle("s09_tickets_snapshot"))
def s09_bucketed(t):
    """S9 tickets left after their customers were deleted, tickets bucketed on the customer."""
    return M.delete_by_key(in_buckets(t, "CustomerID", "tickets")["tickets"], t.view("c_closed_customers"), "CustomerID")


# ---- key ranges (S6, S7, S8) --------------------------------------------------------------------
def _changed_in_place(t, name: str, key: str, keys: DataFrame, change) -> DataFrame:
    """The table after ``change`` was applied in place to the folders that hold one of ``keys``."""
    base = getattr(t, name)
    path = L.shared_folder(t.spark, f"ranges-{name}")
    width = L.range_width(base, key, P.KEYS_PER_FOLDER)
    L.write_key_ranges(base, key, path, width)
    L.change_key_ranges(t.spark, key, path, base.schema, keys, change, width)
    return L.read_key_ranges(t.spark, key, path, base.schema)


@register("s06_update_segments_in_place", **_oracle("s06_update_segments"))
def s06_in_place(t):
    """S6 keyed update that rewrites only the key ranges it touches."""
    changes = t.view("c_segment_changes")
    return _changed_in_place(t, "customers", "CustomerID", changes,
                             lambda part: M.update_by_key(part, changes, "CustomerID", ["Segment", "AssignedTo"]))


@register("s08_purge_tickets_in_place", **_oracle("s08_purge_tickets"))
def s08_in_place(t):
    """S8 delete that rewrites only the key ranges it touches."""
    keys = t.view("c_ticket_purge")
    return _changed_in_place(t, "tickets", "TicketID", keys, lambda part: M.delete_by_key(part, keys, "TicketID"))


# ---- search index (F2) ---------------------------------------------------------------------------
_SEARCHED = ["FullName", "Company", "Email", "Phone"]


def customer_index(t, mode: str = "binary") -> GramIndex:
    def store(path: str) -> DataFrame:
        t.customers.repartitionByRange(P.SEARCH_FILES, "CustomerID").write.parquet(f"{path}/rows")
        GramIndex.build(t.spark, f"{path}/rows", _SEARCHED, f"{path}/index", mode)
        return t.spark.createDataFrame([(path,)], "path string")
    path = t.stored(f"customers-index-{mode}", store).first()[0]
    return GramIndex(t.spark, f"{path}/rows", _SEARCHED, f"{path}/index", mode)


@register("f02_customer_search_indexed", ["b_customers"], f"SELECT * FROM b_customers WHERE {contains(_SEARCHED, P.SEARCH_CUSTOMER)}")
def f02(t):
    """F2 customer search that reads the files whose trigrams can match."""
    return customer_index(t).search(P.SEARCH_CUSTOMER)


@register("f02_customer_search_indexed_ci", ["b_customers"], "SELECT * FROM b_customers WHERE "
          + " OR ".join(f"lower({c}) LIKE '%customer#%_12%'" for c in _SEARCHED))
def f02_ci(t):
    """F2 the same ignoring case, with wildcards in the text."""
    return customer_index(t, "ci").search("CUSTOMER#%_12")
