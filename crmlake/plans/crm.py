"""CRM reports: dashboards, lists, 360 views and the statistics page.

Each function takes a table provider ``t`` (anything with ``employees``,
``customers``, ``products``, ``opportunities``, ``interactions``, ``tickets``,
``users``, ``activity`` DataFrame attributes, e.g.
``crmlake.sources.bindings.Bindings``) plus the request's parameters, and
returns a lazy DataFrame. Lists return the whole filtered list; ``*_page``
wraps a list with ``paginate`` (the reference slices the full result in the
web process; here only the page leaves the cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.functions.predicates import (facet, in_months, none_of, one_of, rolling_months, search,
                                          where)
from crmlake.functions.scalars import (field_rank, money, month_label, month_start,
                                       row_win_rate, win_rate, win_tier)
from crmlake.operators.aggregates import (Child, attach_children, combine_rows, count_by,
                                          distinct_count, null_safe_avg, null_safe_sum)
from crmlake.operators.joins import anti, lookup
from crmlake.operators.paging import (ACTIVITY_PER_PAGE, DEFAULT_PER_PAGE, order_spec,
                                      page_meta, paginate, top_n)
from crmlake.sources.sinks import cut_lineage
from crmlake.sources.schemas import (CLOSED_STAGES, OPEN_TICKET_STATUSES, STAGES,
                                     TICKET_PRIORITIES_REPORT, TICKET_STATUSES)

WON = "Closed Won"
LOST = "Closed Lost"

def _count():
    return F.count(F.lit(1))


# Total orders of the lists: reference order, then key, then enough columns
# to break ties among rows that share a (non-unique) key.
CUSTOMER_ORDER = (("CreatedAt", "desc"), "CustomerID")
OPPORTUNITY_ORDER = (("CreatedAt", "desc"), "OpportunityID", "Stage", "Value",
                               "EmployeeID", "ProductID", "ClosedAt", "Probability")
INTERACTION_ORDER = (("InteractedAt", "desc"), "InteractionID")
TICKET_ORDER = (("CreatedAt", "desc"), "TicketID")
ACTIVITY_ORDER = (("CreatedAt", "desc"), "LogID")


# ---- dashboard (Q1-Q3) ----------------------------------------------------
def crm_kpis(t) -> DataFrame:
    """Q1: one row; one aggregate pass per table (scalars of a table share a scan)."""
    return combine_rows(
        t.customers.agg(_count().alias("customers")),
        t.employees.agg(_count().alias("employees")),
        t.opportunities.agg(
            F.count_if(none_of("Stage", CLOSED_STAGES)).alias("open_opps"),
            money(null_safe_sum(F.when(F.col("Stage") == WON, F.col("Value")))).alias("won_value")),
        t.tickets.agg(F.count_if(one_of("Status", OPEN_TICKET_STATUSES)).alias("open_tickets")),
        t.interactions.agg(_count().alias("interactions")),
    )


def deals_by_stage(t) -> DataFrame:
    """Q2: count and value per stage, in stage order (unlisted/NULL first)."""
    return (t.opportunities.groupBy("Stage")
            .agg(_count().alias("count"), money(null_safe_sum("Value")).alias("total_value"))
            .orderBy(field_rank("Stage", STAGES), "Stage"))


def recent_interactions(t, n: int = 5) -> DataFrame:
    """Q3: the ``n`` latest interactions with customer and employee names."""
    i = lookup(t.interactions, t.customers, "CustomerID", "CustomerID", {"FullName": "customer"}, "inner")
    i = lookup(i, t.employees, "EmployeeID", "EmployeeID", {"FullName": "employee"}, "inner")
    return (top_n(i, INTERACTION_ORDER, n)
            .select("InteractionID", "Subject", "Type", "InteractedAt", "customer", "employee"))


# ---- global search (Q4) -----------------------------------------------------
def global_search(t, q: str, per_source: int = 5, mode: str = "binary") -> DataFrame:
    """Q4: first ``per_source`` matches (by key) in customers, opportunities,
    interactions and tickets, unioned with a ``source`` column. Blank ``q``
    returns no rows."""
    q = (q or "").strip()
    none = F.lit(bool(q))
    c = where(t.customers, search(["FullName", "Company", "Email"], q, mode), none)
    cust = top_n(c, ["CustomerID"], per_source).select(
        F.lit("customers").alias("source"), F.col("CustomerID").alias("id"),
        F.col("FullName").alias("title"), F.col("Segment").alias("label"),
        F.col("Company").alias("customer"))

    def via_customer(df, key, title, lab, source, extra_order=()):
        j = lookup(df, t.customers, "CustomerID", "CustomerID", {"FullName": "customer"}, "inner")
        j = where(j, search([title, "customer"], q, mode), none)
        return top_n(j, [key, *extra_order], per_source).select(
            F.lit(source).alias("source"), F.col(key).alias("id"), F.col(title).alias("title"),
            F.col(lab).alias("label"), F.col("customer"))

    opp = via_customer(t.opportunities, "OpportunityID", "Title", "Stage", "opportunities",
                       ("Stage", "customer", "Value"))
    inter = via_customer(t.interactions, "InteractionID", "Subject", "Type", "interactions")
    tick = via_customer(t.tickets, "TicketID", "Subject", "Status", "tickets")
    return cust.unionByName(opp).unionByName(inter).unionByName(tick)


def global_search_totals(t, q: str, per_source: int = 5, mode: str = "binary") -> DataFrame:
    """Hits per source and their total, as the search page shows."""
    hits = global_search(t, q, per_source, mode)
    return hits.agg(*[F.count_if(F.col("source") == s).alias(s)
                      for s in ("customers", "opportunities", "interactions", "tickets")],
                    _count().alias("total"))


# ---- lists (Q5, Q8-Q10, Q43) ----------------------------------------------------
def _customer_rows(t, q: str = "", segment: str = "", assigned=None, mode: str = "binary") -> DataFrame:
    """Q5 without the child counts: filters and order use customer columns only."""
    preds = [search(["FullName", "Company", "Email", "Phone"], q, mode),
             facet("Segment", segment, mode), facet("AssignedTo", assigned, mode)]
    c = where(t.customers, *preds)
    return lookup(c, t.employees, "AssignedTo", "EmployeeID", {"FullName": "employee_name"}, "left")


def _with_customer_counts(t, rows: DataFrame, prefilter: bool) -> DataFrame:
    return attach_children(rows, "CustomerID", [
        Child(t.opportunities, "CustomerID", {"opp_count": distinct_count("OpportunityID")}),
        Child(t.tickets, "CustomerID", {"ticket_count": distinct_count("TicketID")}),
    ], prefilter=prefilter)


def customer_list(t, q: str = "", segment: str = "", assigned=None, mode: str = "binary") -> DataFrame:
    """Q5: customers with owner name and distinct opportunity/ticket counts."""
    filtered = bool((q or "").strip() or segment or assigned is not None)
    return _with_customer_counts(t, _customer_rows(t, q, segment, assigned, mode), prefilter=filtered)


def opportunity_list(t, q: str = "", stage: str = "", employee=None, mode: str = "binary") -> DataFrame:
    """Q8: opportunities with customer, company, owner and product names."""
    o = where(t.opportunities, facet("Stage", stage, mode), facet("EmployeeID", employee, mode))
    o = lookup(o, t.customers, "CustomerID", "CustomerID",
               {"FullName": "customer", "Company": "Company"}, "inner")
    o = lookup(o, t.employees, "EmployeeID", "EmployeeID", {"FullName": "employee"}, "inner")
    o = lookup(o, t.products, "ProductID", "ProductID", {"ProductName": "ProductName"}, "left")
    return where(o, search(["Title", "customer", "Company"], q, mode))


def interaction_list(t, q: str = "", itype: str = "", mode: str = "binary") -> DataFrame:
    """Q9: interactions with customer, company and employee names."""
    i = where(t.interactions, facet("Type", itype, mode))
    i = lookup(i, t.customers, "CustomerID", "CustomerID",
               {"FullName": "customer", "Company": "Company"}, "inner")
    i = lookup(i, t.employees, "EmployeeID", "EmployeeID", {"FullName": "employee"}, "inner")
    return where(i, search(["Subject", "customer", "Company"], q, mode))


def ticket_list(t, q: str = "", status: str = "", priority: str = "", mode: str = "binary") -> DataFrame:
    """Q10: tickets with customer, company and (optional) assignee."""
    k = where(t.tickets, facet("Status", status, mode), facet("Priority", priority, mode))
    k = lookup(k, t.customers, "CustomerID", "CustomerID",
               {"FullName": "customer", "Company": "Company"}, "inner")
    k = lookup(k, t.employees, "EmployeeID", "EmployeeID", {"FullName": "employee"}, "left")
    return where(k, search(["Subject", "customer", "Company"], q, mode))


def activity_log(t, q: str = "", action: str = "", module: str = "", mode: str = "binary") -> DataFrame:
    """Q43: activity-log search (facets first: they prune; search after)."""
    return where(t.activity, facet("Action", action, mode), facet("Module", module, mode),
                 search(["Username", "FullName", "Description"], q, mode))


# list -> (rows before late columns, order, page size, late columns for a page)
LISTS = {
    "customers": (_customer_rows, CUSTOMER_ORDER, DEFAULT_PER_PAGE,
                  lambda t, page: _with_customer_counts(t, page, prefilter=True)),
    "opportunities": (opportunity_list, OPPORTUNITY_ORDER, DEFAULT_PER_PAGE, None),
    "interactions": (interaction_list, INTERACTION_ORDER, DEFAULT_PER_PAGE, None),
    "tickets": (ticket_list, TICKET_ORDER, DEFAULT_PER_PAGE, None),
    "activity": (activity_log, ACTIVITY_ORDER, ACTIVITY_PER_PAGE, None),
}


def paged(lists: dict, t, which: str, page: int = 1, **params) -> DataFrame:
    """The requested (clamped) page of a list. Columns that neither
    filter nor order the list (child counts, balances) are computed after
    paging, for the page's keys only."""
    fn, order, per_page, late = lists[which]
    rows = paginate(fn(t, **params), order, page, per_page)
    if late is None:
        return rows
    # the page (<= per_page rows) feeds both the key set and the parent side:
    # materialise it once in the shared checkpoint folder
    return late(t, cut_lineage(rows))


def list_page(t, which: str, page: int = 1, **params) -> DataFrame:
    """O8 over one of the CRM lists."""
    return paged(LISTS, t, which, page, **params)


def list_page_meta(t, which: str, page: int = 1, **params) -> DataFrame:
    """O8/O9 metadata row of a list page (counts the list without late columns)."""
    fn, _, per_page, _ = LISTS[which]
    return page_meta(fn(t, **params), page, per_page)


# ---- pick lists, workload, catalogue, accounts (Q6, Q11-Q15) -------------------------
def active_owners(t) -> DataFrame:
    """Q6: active employees for owner pick lists, by name."""
    return (t.employees.filter(F.col("Status") == "Active")
            .select("EmployeeID", "FullName").orderBy("FullName", "EmployeeID"))


def employee_workload(t) -> DataFrame:
    """Q11: employees with distinct customer and opportunity counts."""
    e = t.employees.select("EmployeeID", "FullName", "Email", "Phone", "Department", "Role", "Status")
    return attach_children(e, "EmployeeID", [
        Child(t.customers, "AssignedTo", {"customer_count": distinct_count("CustomerID")}),
        Child(t.opportunities, "EmployeeID", {"opp_count": distinct_count("OpportunityID")}),
    ]).orderBy("FullName", "EmployeeID")


def product_catalogue(t) -> DataFrame:
    """Q12: all products by category and name."""
    return t.products.orderBy("Category", "ProductName", "ProductID")


def user_accounts(t) -> DataFrame:
    """Q13: accounts with employee name and department (Inactive first)."""
    u = lookup(t.users, t.employees, "EmployeeID", "EmployeeID",
               {"FullName": "emp_name", "Department": "Department"}, "left")
    return u.orderBy(F.col("Status").desc(), "Role", "Username", "UserID")


def pending_accounts(t) -> DataFrame:
    """Number of inactive (pending) accounts."""
    return t.users.agg(F.count_if(F.col("Status") == "Inactive").alias("pending_count"))


def employees_without_account(t) -> DataFrame:
    """Q14: active employees no account points at (NULL-guarded anti join)."""
    e = t.employees.filter(F.col("Status") == "Active")
    return (anti(e, t.users, "EmployeeID", "EmployeeID")
            .select("EmployeeID", "FullName", "Department").orderBy("FullName", "EmployeeID"))


def pick_lists(t, support_department: str = "Support") -> DataFrame:
    """Q15 (CRM): customers, active products with price, support staff."""
    def shape(df, name, id_col, label_col, extra):
        return df.select(F.lit(name).alias("list"), F.col(id_col).cast("long").alias("id"),
                         F.col(label_col).alias("label"), extra.cast("string").alias("extra"))
    customers = shape(t.customers, "customers", "CustomerID", "FullName", F.col("Company"))
    products = shape(t.products.filter(F.col("Status") == "Active"), "products", "ProductID",
                     "ProductName", F.col("Price"))
    support = shape(t.employees.filter(F.col("Department") == support_department), "support",
                    "EmployeeID", "FullName", F.col("Department"))
    return customers.unionByName(products).unionByName(support)


def customer_360(t) -> DataFrame:
    """Q7 (batch form): every customer's profile with owner and the tab counts
    of its detail page (opportunities, won deals, interactions, tickets, open tickets)."""
    c = lookup(t.customers, t.employees, "AssignedTo", "EmployeeID", {"FullName": "employee_name"}, "left")
    return attach_children(c, "CustomerID", [
        Child(t.opportunities, "CustomerID", {
            "opp_count": _count(), "won_count": F.count_if(F.col("Stage") == WON),
            "won_value": null_safe_sum(F.when(F.col("Stage") == WON, F.col("Value")))}),
        Child(t.interactions, "CustomerID", {"interaction_count": _count()}),
        Child(t.tickets, "CustomerID", {
            "ticket_count": _count(),
            "open_ticket_count": F.count_if(one_of("Status", OPEN_TICKET_STATUSES))}),
    ]).withColumn("won_value", money("won_value"))


def customer_detail(t, customer_id=None) -> dict[str, DataFrame]:
    """Q7: profile, opportunities, interactions and tickets of one customer (F8 point
    lookups), or of all customers when no id is given."""
    def of(df):
        return df if customer_id is None else df.filter(F.col("CustomerID") == F.lit(customer_id))
    opps = lookup(of(t.opportunities), t.products, "ProductID", "ProductID",
                  {"ProductName": "ProductName"}, "left")
    opps = lookup(opps, t.employees, "EmployeeID", "EmployeeID", {"FullName": "emp"}, "left")
    inters = lookup(of(t.interactions), t.employees, "EmployeeID", "EmployeeID",
                    {"FullName": "emp"}, "inner")
    tickets = lookup(of(t.tickets), t.employees, "EmployeeID", "EmployeeID",
                     {"FullName": "emp"}, "left")
    return {"customer": of(t.customers),
            "opportunities": opps.orderBy(*order_spec(*OPPORTUNITY_ORDER)),
            "interactions": inters.orderBy(*order_spec(*INTERACTION_ORDER)),
            "tickets": tickets.orderBy(*order_spec(*TICKET_ORDER))}


# ---- statistics page (Q33-Q42) ------------------------------------------------
def stage_report(t) -> DataFrame:
    """Q33: count, value and average probability per stage."""
    return (t.opportunities.groupBy("Stage")
            .agg(_count().alias("count"), money(null_safe_sum("Value")).alias("total_value"),
                 null_safe_avg("Probability").alias("avg_prob"))
            .orderBy(field_rank("Stage", STAGES), "Stage"))


def monthly_won_revenue(t, as_of, months: int = 12) -> DataFrame:
    """Q34: won deals per calendar month closed since ``as_of - months``."""
    o = where(t.opportunities, F.col("Stage") == WON, F.col("ClosedAt").isNotNull(),
              rolling_months("ClosedAt", as_of, months), in_months(t.opportunities, "ClosedAt", as_of, months))
    return (o.groupBy(month_start("ClosedAt").alias("month_start"))
            .agg(_count().alias("deals"), money(null_safe_sum("Value")).alias("revenue"))
            .orderBy("month_start")
            .select(month_label("month_start").alias("month"), "deals", "revenue"))


def employee_performance(t, fanout: str = "exact") -> DataFrame:
    """Q35: per employee customers, opportunities, won deals, won revenue,
    interactions, win rate and tier.

    ``fanout='exact'`` counts each opportunity once. ``fanout='reference'``
    reproduces the reference's LEFT JOIN fan-out, where ``won`` and
    ``revenue`` are multiplied by max(customers, 1) * max(interactions, 1)
    rows, computed in closed form from per-child row counts (the joined rows
    are never built).
    """
    if fanout not in ("exact", "reference"):
        raise ValueError("fanout must be 'exact' or 'reference'")
    e = t.employees.select("EmployeeID", "FullName", "Department")
    won = F.col("Stage") == WON
    out = attach_children(e, "EmployeeID", [
        Child(t.customers, "AssignedTo", {"customers": distinct_count("CustomerID"), "__c_rows": _count()}),
        Child(t.opportunities, "EmployeeID", {
            "total_opps": distinct_count("OpportunityID"), "won": F.count_if(won),
            "revenue": null_safe_sum(F.when(won, F.col("Value")))}),
        Child(t.interactions, "EmployeeID", {"interactions": distinct_count("InteractionID"),
                                             "__i_rows": _count()}),
    ])
    if fanout == "reference":
        # three counts multiply past a BIGINT; decimals keep revenue exact
        wide = "decimal(19,0)"
        factor = (F.greatest(F.col("__c_rows"), F.lit(1)).cast(wide)
                  * F.greatest(F.col("__i_rows"), F.lit(1)).cast(wide))
        out = (out.withColumn("won", (F.col("won").cast(wide) * factor).cast("double"))
               .withColumn("revenue", F.col("revenue") * factor))
    out = (out.withColumn("revenue", money("revenue"))
           .withColumn("win_rate", row_win_rate("won", "total_opps", "int" if fanout == "exact" else "long"))
           .withColumn("tier", win_tier("win_rate")))
    return (out.select("EmployeeID", "FullName", "Department", "customers", "total_opps", "won",
                       "revenue", "interactions", "win_rate", "tier")
            .orderBy(F.col("revenue").desc(), "EmployeeID"))


def customers_by_segment(t) -> DataFrame:
    """Q36."""
    return count_by(t.customers, ["Segment"]).orderBy(F.col("count").desc(), "Segment")


def customers_by_source(t) -> DataFrame:
    """Q37."""
    return count_by(t.customers, ["Source"]).orderBy(F.col("count").desc(), "Source")


def ticket_matrix(t) -> DataFrame:
    """Q38: status x priority counts, in status order."""
    return (count_by(t.tickets, ["Status", "Priority"])
            .orderBy(field_rank("Status", TICKET_STATUSES), "Status", "Priority"))


def tickets_by_status(t) -> DataFrame:
    """Q39."""
    return count_by(t.tickets, ["Status"]).orderBy(field_rank("Status", TICKET_STATUSES), "Status")


def tickets_by_priority(t) -> DataFrame:
    """Q40: report priority order (unlisted values first)."""
    return (count_by(t.tickets, ["Priority"])
            .orderBy(field_rank("Priority", TICKET_PRIORITIES_REPORT), "Priority"))


def interactions_by_type(t) -> DataFrame:
    """Q41."""
    return count_by(t.interactions, ["Type"]).orderBy(F.col("count").desc(), "Type")


def report_kpis(t) -> DataFrame:
    """Q42: the statistics page's KPI row; the opportunity scalars
    (revenue, average deal, won and lost counts) come from one scan."""
    won = F.col("Stage") == WON
    opp = t.opportunities.agg(
        money(null_safe_sum(F.when(won, F.col("Value")))).alias("total_revenue"),
        null_safe_avg(F.when(won, F.col("Value"))).alias("avg_deal_value"),
        F.count_if(won).alias("__won"), F.count_if(F.col("Stage") == LOST).alias("__lost"))
    opp = opp.withColumn("win_rate", win_rate("__won", "__lost")).drop("__won", "__lost")
    return combine_rows(
        t.customers.agg(_count().alias("total_customers")),
        opp,
        t.tickets.agg(F.count_if(one_of("Status", OPEN_TICKET_STATUSES)).alias("open_tickets")),
        t.interactions.agg(_count().alias("total_interactions")),
    ).select("total_customers", "total_revenue", "win_rate", "avg_deal_value",
             "open_tickets", "total_interactions")
