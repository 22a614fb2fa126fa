"""Registered CRM queries (Q1-Q15, Q33-Q43) with their oracle SQL."""

from __future__ import annotations

from crmlake.plans import crm
from crmlake.plans import params as P
from crmlake.plans import oracle as O
from crmlake.plans.catalog import PAGE_SELECT, meta_sql, page_ctes, register
from crmlake.plans.oracle import contains

OPP = ["b_opportunities"]
CUST_EMP = ["b_customers", "b_employees"]

OPPORTUNITY_ORDER_SQL = ("CreatedAt DESC, OpportunityID, Stage, Value, EmployeeID, ProductID, "
                         "ClosedAt NULLS FIRST, Probability")

ALL_CRM = ["b_customers", "b_employees", "b_opportunities", "b_tickets", "b_interactions"]


# ---- dashboard -------------------------------------------------------------------
@register("q01_crm_kpis", ALL_CRM, """
SELECT (SELECT count(*) FROM b_customers) AS customers,
       (SELECT count(*) FROM b_employees) AS employees,
       (SELECT count(*) FROM b_opportunities WHERE Stage NOT IN ('Closed Won', 'Closed Lost')) AS open_opps,
       (SELECT CAST(IFNULL(SUM(Value), 0) AS DOUBLE) FROM b_opportunities WHERE Stage = 'Closed Won') AS won_value,
       (SELECT count(*) FROM b_tickets WHERE Status IN ('Open', 'In Progress')) AS open_tickets,
       (SELECT count(*) FROM b_interactions) AS interactions""")
def q01(t):
    """Q1 CRM dashboard KPI row."""
    return crm.crm_kpis(t)


@register("q02_deals_by_stage", OPP, """
SELECT Stage, count(*) AS count, CAST(IFNULL(SUM(Value), 0) AS DOUBLE) AS total_value
FROM b_opportunities GROUP BY Stage""")
def q02(t):
    """Q2 opportunity count and value per stage."""
    return crm.deals_by_stage(t)


@register("q03_recent_interactions", ["b_interactions", "b_customers", "b_employees"],
          O.INTERACTIONS.sql(columns="InteractionID, Subject, Type, InteractedAt, customer, employee")
          + " ORDER BY InteractedAt DESC, InteractionID LIMIT 5")
def q03(t):
    """Q3 five most recent interactions."""
    return crm.recent_interactions(t)


GLOBAL_SEARCH_SQL = O.global_search_sql(P.SEARCH_CUSTOMER)


@register("q04_global_search", ["b_customers", "b_opportunities", "b_interactions", "b_tickets"],
          GLOBAL_SEARCH_SQL)
def q04(t):
    """Q4 global search, five hits per source."""
    return crm.global_search(t, P.SEARCH_CUSTOMER)


@register("q04_global_search_totals", ["b_customers", "b_opportunities", "b_interactions", "b_tickets"],
          "SELECT count(*) FILTER (WHERE source = 'customers') AS customers, "
          "count(*) FILTER (WHERE source = 'opportunities') AS opportunities, "
          "count(*) FILTER (WHERE source = 'interactions') AS interactions, "
          "count(*) FILTER (WHERE source = 'tickets') AS tickets, count(*) AS total "
          "FROM (" + GLOBAL_SEARCH_SQL + ") hits")
def q04t(t):
    """Q4/A15 number of search hits per source and in total."""
    return crm.global_search_totals(t, P.SEARCH_CUSTOMER)


# ---- lists ---------------------------------------------------------------------------
@register("q05_customer_list", ALL_CRM[:4], O.CUSTOMERS.sql())
def q05(t):
    """Q5 customer list with owner and distinct opportunity / ticket counts."""
    return crm.customer_list(t)


_Q5_WHERE = (f"{contains(['FullName', 'Company', 'Email', 'Phone'], P.SEARCH_COMPANY)} "
             f"AND Segment = '{P.SEGMENT}'")
_Q5_PAGE = page_ctes(O.CUSTOMERS.sql(_Q5_WHERE), "CreatedAt DESC, CustomerID", P.PAGE, 10)


@register("q05_customer_list_page", ALL_CRM[:4], PAGE_SELECT.format(per_page=10), ctes=_Q5_PAGE)
def q05p(t):
    """Q5 one page of the searched, segment-filtered customer list."""
    return crm.list_page(t, "customers", P.PAGE, q=P.SEARCH_COMPANY, segment=P.SEGMENT)


@register("q05_customer_list_last_page", ALL_CRM[:4], PAGE_SELECT.format(per_page=10), ctes=page_ctes(
    O.CUSTOMERS.sql(_Q5_WHERE), "CreatedAt DESC, CustomerID", P.PAST_THE_END, 10))
def q05l(t):
    """O8 a page number past the end of the searched customer list gives its last page."""
    return crm.list_page(t, "customers", P.PAST_THE_END, q=P.SEARCH_COMPANY, segment=P.SEGMENT)


@register("q05_customer_list_page_meta", ALL_CRM[:4], meta_sql(P.PAGE, 10), ctes=_Q5_PAGE)
def q05m(t):
    """Q5/O9 page metadata of the searched customer list."""
    return crm.list_page_meta(t, "customers", P.PAGE, q=P.SEARCH_COMPANY, segment=P.SEGMENT)


@register("q06_active_owners", ["b_employees"], """
SELECT EmployeeID, FullName FROM b_employees WHERE Status = 'Active'""")
def q06(t):
    """Q6 active-owner pick list."""
    return crm.active_owners(t)


@register("q07_customer_360", ALL_CRM, """
SELECT c.*, e.FullName AS employee_name,
       IFNULL(o.opp_count, 0) AS opp_count, IFNULL(o.won_count, 0) AS won_count,
       CAST(IFNULL(o.won_value, 0) AS DOUBLE) AS won_value,
       IFNULL(i.n, 0) AS interaction_count,
       IFNULL(t.n, 0) AS ticket_count, IFNULL(t.open_n, 0) AS open_ticket_count
FROM b_customers c
LEFT JOIN b_employees e ON c.AssignedTo = e.EmployeeID
LEFT JOIN (SELECT CustomerID, count(*) AS opp_count,
                  count(*) FILTER (WHERE Stage = 'Closed Won') AS won_count,
                  SUM(CASE WHEN Stage = 'Closed Won' THEN Value END) AS won_value
           FROM b_opportunities GROUP BY CustomerID) o ON o.CustomerID = c.CustomerID
LEFT JOIN (SELECT CustomerID, count(*) AS n FROM b_interactions GROUP BY CustomerID) i
       ON i.CustomerID = c.CustomerID
LEFT JOIN (SELECT CustomerID, count(*) AS n,
                  count(*) FILTER (WHERE Status IN ('Open', 'In Progress')) AS open_n
           FROM b_tickets GROUP BY CustomerID) t ON t.CustomerID = c.CustomerID""")
def q07(t):
    """Q7 customer 360 for every customer: profile, owner and tab counts."""
    return crm.customer_360(t)


@register("q08_opportunity_list", ["b_opportunities", "b_customers", "b_employees", "b_products"],
          O.OPPORTUNITIES.sql())
def q08(t):
    """Q8 opportunity list with customer, company, owner and product."""
    return crm.opportunity_list(t)


_Q8_PAGE = page_ctes(O.OPPORTUNITIES.sql(f"Stage = '{P.STAGE}'"),
                     OPPORTUNITY_ORDER_SQL, P.PAGE, 10)


@register("q08_opportunity_list_page", ["b_opportunities", "b_customers", "b_employees", "b_products"],
          PAGE_SELECT.format(per_page=10), ctes=_Q8_PAGE)
def q08p(t):
    """Q8 one page of the stage-filtered opportunity list (top-K strategy)."""
    return crm.list_page(t, "opportunities", P.PAGE, stage=P.STAGE)


_Q8_DEEP = page_ctes(O.OPPORTUNITIES.sql(), OPPORTUNITY_ORDER_SQL, P.DEEP_PAGE, 10)


@register("q08_opportunity_list_deep_page", ["b_opportunities", "b_customers", "b_employees", "b_products"],
          PAGE_SELECT.format(per_page=10), ctes=_Q8_DEEP)
def q08d(t):
    """Q8 a deep page of the full opportunity list from its page directory (the list is
    evaluated, sorted and written once; the page reads one or two of its partitions)."""
    from crmlake.operators.paging import paginate
    return paginate(crm.opportunity_list(t), crm.OPPORTUNITY_ORDER, P.DEEP_PAGE, 10, shallow_bytes=0)


@register("q09_interaction_list", ["b_interactions", "b_customers", "b_employees"],
          O.INTERACTIONS.sql())
def q09(t):
    """Q9 interaction list with customer, company and employee."""
    return crm.interaction_list(t)


_Q9_PAGE = page_ctes(O.INTERACTIONS.sql(
    f"Type = '{P.EVENT_TYPE}' AND {contains(['Subject', 'customer', 'Company'], P.SEARCH_COMPANY)}"),
    "InteractedAt DESC, InteractionID", P.PAGE, 10)


@register("q09_interaction_list_page", ["b_interactions", "b_customers", "b_employees"],
          PAGE_SELECT.format(per_page=10), ctes=_Q9_PAGE)
def q09p(t):
    """Q9 one page of the type-filtered, searched interaction list."""
    return crm.list_page(t, "interactions", P.PAGE, q=P.SEARCH_COMPANY, itype=P.EVENT_TYPE)


@register("q10_ticket_list", ["b_tickets", "b_customers", "b_employees"], O.TICKETS.sql())
def q10(t):
    """Q10 ticket list with customer, company and assignee."""
    return crm.ticket_list(t)


_Q10_PAGE = page_ctes(O.TICKETS.sql(
    f"Status = '{P.TICKET_STATUS}' AND Priority = '{P.TICKET_PRIORITY}'"),
    "CreatedAt DESC, TicketID", P.PAGE, 10)


@register("q10_ticket_list_page", ["b_tickets", "b_customers", "b_employees"],
          PAGE_SELECT.format(per_page=10), ctes=_Q10_PAGE)
def q10p(t):
    """Q10 one page of the status- and priority-filtered ticket list."""
    return crm.list_page(t, "tickets", P.PAGE, status=P.TICKET_STATUS, priority=P.TICKET_PRIORITY)


@register("q10_ticket_list_page_meta", ["b_tickets", "b_customers", "b_employees"],
          meta_sql(P.PAGE, 10), ctes=_Q10_PAGE)
def q10m(t):
    """Q10/O9 page metadata of the filtered ticket list."""
    return crm.list_page_meta(t, "tickets", P.PAGE, status=P.TICKET_STATUS, priority=P.TICKET_PRIORITY)


@register("q11_employee_workload", ["b_employees", "b_customers", "b_opportunities"],
          O.EMPLOYEES.sql(columns="EmployeeID, FullName, Email, Phone, Department, Role, Status, "
                                  "customer_count, opp_count"))
def q11(t):
    """Q11 employee workload: distinct customers and opportunities."""
    return crm.employee_workload(t)


@register("q12_product_catalogue", ["b_products"], """
SELECT * REPLACE (CAST(Price AS DOUBLE) AS Price) FROM b_products""")
def q12(t):
    """Q12 product catalogue."""
    return crm.product_catalogue(t)


@register("q13_user_accounts", ["b_users", "b_employees"], O.ACCOUNTS.sql())
def q13(t):
    """Q13 accounts with employee name and department."""
    return crm.user_accounts(t)


@register("q13_pending_accounts", ["b_users"], """
SELECT count(*) FILTER (WHERE Status = 'Inactive') AS pending_count FROM b_users""")
def q13p(t):
    """Q13/A15 count of pending (inactive) accounts."""
    return crm.pending_accounts(t)


@register("q14_employees_without_account", ["b_employees", "b_users"],
          "SELECT EmployeeID, FullName, Department FROM b_employees ANTI JOIN b_users USING (EmployeeID) "
          "WHERE Status = 'Active'")
def q14(t):
    """Q14 active employees without an account (NULL-guarded anti join)."""
    return crm.employees_without_account(t)


@register("q15_crm_pick_lists", ["b_customers", "b_products", "b_employees"], f"""
SELECT 'customers' AS list, CustomerID AS id, FullName AS label, Company AS extra FROM b_customers
UNION ALL
SELECT 'products', ProductID, ProductName, CAST(Price AS VARCHAR) FROM b_products WHERE Status = 'Active'
UNION ALL
SELECT 'support', EmployeeID, FullName, Department FROM b_employees
WHERE Department = '{P.SUPPORT_DEPARTMENT}'""")
def q15(t):
    """Q15 CRM pick lists: customers, active products with price, support staff."""
    return crm.pick_lists(t, P.SUPPORT_DEPARTMENT)


# ---- statistics page ------------------------------------------------------------------
@register("q33_stage_report", OPP, """
SELECT Stage, count(*) AS count, CAST(IFNULL(SUM(Value), 0) AS DOUBLE) AS total_value,
       IFNULL(CAST(SUM(Probability) AS DOUBLE) / COUNT(Probability), 0) AS avg_prob
FROM b_opportunities GROUP BY Stage""")
def q33(t):
    """Q33 stage report with average probability."""
    return crm.stage_report(t)


@register("q34_monthly_won_revenue", OPP, f"""
SELECT strftime(ClosedAt, '%m/%Y') AS month, count(*) AS deals,
       CAST(IFNULL(SUM(Value), 0) AS DOUBLE) AS revenue
FROM b_opportunities
WHERE Stage = 'Closed Won' AND ClosedAt IS NOT NULL
  AND ClosedAt >= TIMESTAMP '{P.AS_OF_ORDERS}' - INTERVAL {P.MONTHS} MONTH
GROUP BY strftime(ClosedAt, '%Y-%m'), strftime(ClosedAt, '%m/%Y')""")
def q34(t):
    """Q34 won revenue per month over the last twelve months."""
    return crm.monthly_won_revenue(t, P.AS_OF_ORDERS, P.MONTHS)


_Q35 = """
SELECT e.EmployeeID, e.FullName, e.Department,
       IFNULL(c.customers, 0) AS customers, IFNULL(o.total_opps, 0) AS total_opps,
       {won} AS won, CAST({revenue} AS DOUBLE) AS revenue,
       IFNULL(i.interactions, 0) AS interactions,
       CASE WHEN IFNULL(o.total_opps, 0) > 0
            THEN CAST(round_even({won} / IFNULL(o.total_opps, 0) * 100, 0) AS INTEGER) END AS win_rate,
       CASE WHEN IFNULL(o.total_opps, 0) = 0 THEN NULL
            WHEN round_even({won} / IFNULL(o.total_opps, 0) * 100, 0) >= 60 THEN 'success'
            WHEN round_even({won} / IFNULL(o.total_opps, 0) * 100, 0) >= 30 THEN 'warning'
            ELSE 'danger' END AS tier
FROM b_employees e
LEFT JOIN (SELECT AssignedTo, COUNT(DISTINCT CustomerID) AS customers, count(*) AS c_rows
           FROM b_customers GROUP BY AssignedTo) c ON c.AssignedTo = e.EmployeeID
LEFT JOIN (SELECT EmployeeID, COUNT(DISTINCT OpportunityID) AS total_opps,
                  SUM(CASE WHEN Stage = 'Closed Won' THEN 1 ELSE 0 END) AS won,
                  SUM(CASE WHEN Stage = 'Closed Won' THEN Value ELSE 0 END) AS revenue
           FROM b_opportunities GROUP BY EmployeeID) o ON o.EmployeeID = e.EmployeeID
LEFT JOIN (SELECT EmployeeID, COUNT(DISTINCT InteractionID) AS interactions, count(*) AS i_rows
           FROM b_interactions GROUP BY EmployeeID) i ON i.EmployeeID = e.EmployeeID"""
_FAN = "GREATEST(IFNULL(c.c_rows, 0), 1) * GREATEST(IFNULL(i.i_rows, 0), 1)"


@register("q35_employee_performance", ["b_employees", "b_customers", "b_opportunities", "b_interactions"],
          _Q35.format(won="CAST(IFNULL(o.won, 0) AS BIGINT)", revenue="IFNULL(o.revenue, 0)"))
def q35(t):
    """Q35 employee performance, exact counts, with win rate and tier."""
    return crm.employee_performance(t, "exact")


@register("q35_employee_performance_reference",
          ["b_employees", "b_customers", "b_opportunities", "b_interactions"],
          _Q35.format(won=f"CAST(CAST(IFNULL(o.won, 0) AS HUGEINT) * {_FAN} AS DOUBLE)",
                      revenue=f"IFNULL(o.revenue, 0) * {_FAN}"))
def q35r(t):
    """Q35 employee performance with the reference's join fan-out in won/revenue."""
    return crm.employee_performance(t, "reference")


@register("q36_customers_by_segment", ["b_customers"], """
SELECT Segment, count(*) AS count FROM b_customers GROUP BY Segment""")
def q36(t):
    """Q36 customers per segment."""
    return crm.customers_by_segment(t)


@register("q37_customers_by_source", ["b_customers"], """
SELECT Source, count(*) AS count FROM b_customers GROUP BY Source""")
def q37(t):
    """Q37 customers per source."""
    return crm.customers_by_source(t)


@register("q38_ticket_matrix", ["b_tickets"], """
SELECT Status, Priority, count(*) AS count FROM b_tickets GROUP BY Status, Priority""")
def q38(t):
    """Q38 ticket status x priority matrix."""
    return crm.ticket_matrix(t)


@register("q39_tickets_by_status", ["b_tickets"], """
SELECT Status, count(*) AS count FROM b_tickets GROUP BY Status""")
def q39(t):
    """Q39 tickets per status."""
    return crm.tickets_by_status(t)


@register("q40_tickets_by_priority", ["b_tickets"], """
SELECT Priority, count(*) AS count FROM b_tickets GROUP BY Priority""")
def q40(t):
    """Q40 tickets per priority."""
    return crm.tickets_by_priority(t)


@register("q41_interactions_by_type", ["b_interactions"], """
SELECT Type, count(*) AS count FROM b_interactions GROUP BY Type""")
def q41(t):
    """Q41 interactions per type."""
    return crm.interactions_by_type(t)


@register("q42_report_kpis", ALL_CRM, """
SELECT (SELECT count(*) FROM b_customers) AS total_customers,
       o.total_revenue,
       CASE WHEN o.won + o.lost > 0
            THEN round_even(CAST(o.won AS DOUBLE) / CAST(o.won + o.lost AS DOUBLE) * 100.0, 1)
            ELSE 0.0 END AS win_rate,
       o.avg_deal_value,
       (SELECT count(*) FROM b_tickets WHERE Status IN ('Open', 'In Progress')) AS open_tickets,
       (SELECT count(*) FROM b_interactions) AS total_interactions
FROM (SELECT CAST(IFNULL(SUM(Value) FILTER (WHERE Stage = 'Closed Won'), 0) AS DOUBLE) AS total_revenue,
             IFNULL(CAST(SUM(Value) FILTER (WHERE Stage = 'Closed Won') AS DOUBLE)
                    / COUNT(Value) FILTER (WHERE Stage = 'Closed Won'), 0) AS avg_deal_value,
             count(*) FILTER (WHERE Stage = 'Closed Won') AS won,
             count(*) FILTER (WHERE Stage = 'Closed Lost') AS lost
      FROM b_opportunities) o""")
def q42(t):
    """Q42 statistics KPI row with win rate and average deal value."""
    return crm.report_kpis(t)


@register("q43_activity_log", ["b_activity"], O.ACTIVITY.sql())
def q43(t):
    """Q43 the full activity log (no filter)."""
    return crm.activity_log(t)


_Q43_PAGE = page_ctes(O.ACTIVITY.sql(
    f"Action = '{P.ACTION}' AND {contains(['Username', 'FullName', 'Description'], P.SEARCH_LOG)}"),
    "CreatedAt DESC, LogID", 2, 20)


@register("q43_activity_log_page", ["b_activity"], PAGE_SELECT.format(per_page=20), ctes=_Q43_PAGE)
def q43p(t):
    """Q43 page 2 (20 per page) of the action-filtered, searched activity log."""
    return crm.list_page(t, "activity", 2, q=P.SEARCH_LOG, action=P.ACTION)


# ---- rows of the customer page's tabs, for all customers ---------------------------
@register("q07_customer_opportunities", ["b_opportunities", "b_products", "b_employees"], """
SELECT d.*, (SELECT any_value(x.ProductName) FROM b_products x WHERE x.ProductID = d.ProductID) AS ProductName,
       (SELECT any_value(x.FullName) FROM b_employees x WHERE x.EmployeeID = d.EmployeeID) AS emp
FROM b_opportunities d""")
def q07_opportunities(t):
    """Q7 deals of every customer with product and employee."""
    return crm.customer_detail(t)["opportunities"]


@register("q07_customer_interactions", ["b_interactions", "b_employees"], """
SELECT i.*, w.FullName AS emp FROM b_employees w, b_interactions i WHERE i.EmployeeID = w.EmployeeID""")
def q07_interactions(t):
    """Q7 interactions of every customer with their employee."""
    return crm.customer_detail(t)["interactions"]


@register("q07_customer_tickets", ["b_tickets", "b_employees"], """
SELECT k.*, (SELECT any_value(x.FullName) FROM b_employees x WHERE x.EmployeeID = k.EmployeeID) AS emp
FROM b_tickets k""")
def q07_tickets(t):
    """Q7 tickets of every customer with their employee, if any."""
    return crm.customer_detail(t)["tickets"]
