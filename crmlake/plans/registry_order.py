"""Registered queries that carry their row order as a column (O1-O5), point lookups (F8), collation
modes and form numbers (X9), with oracle SQL.

``position`` numbers the rows as the report gives them (``paging.as_shown`` sorts nothing), so a wrong order
gives other rows than the oracle's ``row_number()``.
"""

from __future__ import annotations

from crmlake.operators.paging import as_shown, with_position
from crmlake.plans import crm, edu
from crmlake.plans import maintenance as MT
from crmlake.plans import oracle as O
from crmlake.plans import params as P
from crmlake.plans.audit_oracle import violations_sql
from crmlake.plans.catalog import PAGE_SELECT, meta_sql, page_ctes, register

AS_OF = P.AS_OF_ORDERS
TS = f"TIMESTAMP '{AS_OF}'"


def _position(order: str, columns: str, source: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS position, {columns} FROM {source}"


def _rank(column: str, values: list[str]) -> str:
    return f"coalesce(list_position([{', '.join(repr(v) for v in values)}], {column}), 0)"


# ---- O1: one time, newest first -----------------------------------------------------------
@register("o1_ticket_order", ["b_tickets"], _position("CreatedAt DESC, TicketID", "TicketID, CreatedAt", "b_tickets"))
def o1(t):
    """O1 all tickets as the detail pages show them, newest first."""
    return as_shown(crm.customer_detail(t)["tickets"]).select("position", "TicketID", "CreatedAt")


@register("o1_consultation_order", ["b_consultations", "b_staff"], _position(
    "ConsultedAt DESC, ConsultID", "ConsultID, ConsultedAt", "b_consultations SEMI JOIN b_staff USING (StaffID)"))
def o1c(t):
    """O1 all consultations as the detail pages show them, newest first."""
    return as_shown(edu.student_detail(t)["consultations"]).select("position", "ConsultID", "ConsultedAt")


# ---- O2: names and dates, ascending -------------------------------------------------------
@register("o2_staff_order", ["b_staff"], _position("FullName, StaffID", "StaffID, FullName", "b_staff"))
def o2(t):
    """O2 staff workload by name."""
    return as_shown(edu.staff_workload(t)).select("position", "StaffID", "FullName")


@register("o2_catalogue_order", ["b_products"], _position(
    "Category, ProductName, ProductID", "ProductID, Category, ProductName", "b_products"))
def o2p(t):
    """O2 product catalogue by category and name."""
    return as_shown(crm.product_catalogue(t)).select("position", "ProductID", "Category", "ProductName")


@register("o2_course_order", ["b_courses"], _position("Category, CourseName, CourseID", "CourseID, Category, CourseName", "b_courses"))
def o2c(t):
    """O2 course list by category and name."""
    return with_position(edu.course_list(t), edu.COURSE_ORDER).select("position", "CourseID", "Category", "CourseName")


@register("o2_open_class_order", ["b_classes"], _position(
    "StartDate NULLS FIRST, ClassID", "ClassID", "b_classes WHERE Status IN ('Ongoing', 'Upcoming')"))
def o2o(t):
    """O2 open classes by start date, undated first."""
    return as_shown(edu.open_classes_with_seats(t)).select("position", "ClassID")


@register("o2_debtor_order", ["b_enrollments", "b_students", "b_classes", "b_payments"], _position(
    "student, EnrollmentID", "EnrollmentID, student",
    f"({O.DEBTS.sql('remaining > 0')}) d WHERE Status IN ('Confirmed', 'Studying')"))
def o2d(t):
    """O2 debtors by student name."""
    return as_shown(edu.debtors(t)).select("position", "EnrollmentID", "student")


# ---- O3: mixed directions ----------------------------------------------------------------
@register("o3_account_order", ["b_users"], _position(
    "Status DESC, Role, Username, UserID", "UserID, Status, Role, Username", "b_users"))
def o3(t):
    """O3 accounts: inactive first, then role and username."""
    return as_shown(crm.user_accounts(t)).select("position", "UserID", "Status", "Role", "Username")


# ---- O4: custom ranks --------------------------------------------------------------------
_STAGES = ["Lead", "Qualified", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
_STATUSES = ["Open", "In Progress", "Resolved", "Closed"]
_PRIORITIES = ["Critical", "High", "Medium", "Low"]


@register("o4_stage_order", ["b_opportunities"], _position(
    f"{_rank('Stage', _STAGES)}, Stage", "Stage", "(SELECT DISTINCT Stage FROM b_opportunities) s"))
def o4(t):
    """O4 stages in sales order."""
    return as_shown(crm.stage_report(t)).select("position", "Stage")


@register("o4_ticket_matrix_order", ["b_tickets"], _position(
    f"{_rank('Status', _STATUSES)}, Status, Priority", "Status, Priority", "(SELECT DISTINCT Status, Priority FROM b_tickets) s"))
def o4m(t):
    """O4 ticket matrix in status order."""
    return as_shown(crm.ticket_matrix(t)).select("position", "Status", "Priority")


@register("o4_priority_order", ["b_tickets"], _position(
    f"{_rank('Priority', _PRIORITIES)}, Priority", "Priority", "(SELECT DISTINCT Priority FROM b_tickets) s"))
def o4p(t):
    """O4 priorities in report order, unlisted values first."""
    return as_shown(crm.tickets_by_priority(t)).select("position", "Priority")


# ---- O5: aggregates, largest first --------------------------------------------------------
def _counted(column: str, view: str) -> str:
    return _position(f"n DESC, {column}", f"{column}, n AS count", f"(SELECT {column}, count(*) AS n FROM {view} GROUP BY {column}) g")


@register("o5_segment_order", ["b_customers"], _counted("Segment", "b_customers"))
def o5(t):
    """O5 segments by size."""
    return as_shown(crm.customers_by_segment(t)).select("position", "Segment", "count")


@register("o5_interaction_type_order", ["b_interactions"], _counted("Type", "b_interactions"))
def o5i(t):
    """O5 interaction types by number."""
    return as_shown(crm.interactions_by_type(t)).select("position", "Type", "count")


@register("o5_performance_order", ["b_employees", "b_opportunities"], _position(
    "revenue DESC, EmployeeID", "EmployeeID, CAST(revenue AS DOUBLE) AS revenue", """(
  SELECT e.EmployeeID, IFNULL(o.revenue, 0) AS revenue
  FROM b_employees e LEFT JOIN (SELECT EmployeeID, SUM(CASE WHEN Stage = 'Closed Won' THEN Value ELSE 0 END) AS revenue
                                FROM b_opportunities GROUP BY EmployeeID) o USING (EmployeeID)) r"""))
def o5p(t):
    """O5 employees by won revenue."""
    return as_shown(crm.employee_performance(t)).select("position", "EmployeeID", "revenue")


# ---- F8: one row by key, and the rows of its tabs -------------------------------------------
@register("f08_customer", ["b_customers"], f"SELECT * FROM b_customers WHERE CustomerID = {P.CUSTOMER_KEY}")
def f08(t):
    """F8 one customer by key."""
    return crm.customer_detail(t, P.CUSTOMER_KEY)["customer"]


@register("f08_customer_tickets", ["b_tickets", "b_employees"], f"""
SELECT k.*, e.FullName AS emp FROM b_tickets k LEFT JOIN b_employees e USING (EmployeeID) WHERE k.CustomerID = {P.CUSTOMER_KEY}""")
def f08t(t):
    """F8 the tickets of one customer."""
    return crm.customer_detail(t, P.CUSTOMER_KEY)["tickets"]


@register("f08_student", ["b_students", "b_staff"], f"""
SELECT s.*, f.FullName AS staff_name FROM b_students s LEFT JOIN b_staff f ON f.StaffID = s.AssignedTo
WHERE s.StudentID = {P.STUDENT_KEY}""")
def f08s(t):
    """F8 one student by key, with the assigned staff."""
    return edu.student_detail(t, P.STUDENT_KEY)["student"]


@register("q17_student_feedbacks", ["b_feedbacks"], "SELECT * FROM b_feedbacks")
def q17_feedbacks(t):
    """Q17 the rows of the feedback tab, all students."""
    return edu.student_detail(t)["feedbacks"]


# ---- O8: pages of the remaining lists -------------------------------------------------------
_CLASS_PAGE = page_ctes(O.CLASSES.sql(), "ClassID", 2, 10)
_COURSE_PAGE = page_ctes(O.COURSES.sql(), "Category, CourseName, CourseID", 1, 10)


@register("q23_class_list_page", ["b_classes", "b_courses", "b_staff"], PAGE_SELECT.format(per_page=10), ctes=_CLASS_PAGE)
def q23p(t):
    """Q23 second page of the class list."""
    return edu.list_page(t, "classes", 2)


@register("q23_class_list_page_meta", ["b_classes", "b_courses", "b_staff"], meta_sql(2, 10), ctes=_CLASS_PAGE)
def q23m(t):
    """Q23/O9 page metadata of the class list."""
    return edu.list_page_meta(t, "classes", 2)


@register("q24_course_list_page", ["b_courses"], PAGE_SELECT.format(per_page=10), ctes=_COURSE_PAGE)
def q24p(t):
    """Q24 first page of the course list."""
    return edu.list_page(t, "courses", 1)


# ---- text under the database's collation ------------------------------------------------------
def _folded(column: str) -> str:
    return f"lower(strip_accents(rtrim({column})))"


@register("q05_customer_list_search_ci_ai", ["b_customers", "b_employees", "b_opportunities", "b_tickets"], O.CUSTOMERS.sql(
    "(" + " OR ".join(f"contains({_folded(c)}, '{P.SEARCH_FOLDED}')" for c in ("FullName", "Company", "Email", "Phone")) + ")"))
def q05_ci_ai(t):
    """Q5/F2 customer search that ignores case and accents."""
    return crm.customer_list(t, q=P.SEARCH_FOLDED, mode="ci_ai")


@register("q24_course_list_facet_ci_ai", ["b_courses"], O.COURSES.sql(f"{_folded('Category')} = '{P.CATEGORY_FOLDED}'"))
def q24_ci_ai(t):
    """Q24/F1 course list by a category typed without accents."""
    return edu.course_list(t, category=P.CATEGORY_FOLDED, mode="ci_ai")


@register("s04_derive_accounts_ci_ai", ["b_employees", "b_users"], f"""
SELECT (SELECT max(UserID) FROM b_users) + row_number() OVER (ORDER BY EmployeeID, Username) AS UserID,
       Username, '123456' AS Password, 'employee' AS Role, EmployeeID, FullName, 'Active' AS Status, {TS} AS CreatedAt
FROM (SELECT arg_min(Username, EmployeeID) AS Username, min(EmployeeID) AS EmployeeID, arg_min(FullName, EmployeeID) AS FullName,
             {_folded('Username')} AS k
      FROM (SELECT lower(replace(split_part(Email, '@', 1), '.', '_')) AS Username, EmployeeID, FullName
            FROM b_employees WHERE Email IS NOT NULL) c GROUP BY k) d
WHERE NOT EXISTS (SELECT 1 FROM b_users u WHERE {_folded('u.Username')} = d.k)""")
def s04_ci_ai(t):
    """S4 employee accounts, usernames unique under the collation."""
    return MT.employee_accounts(t, AS_OF, mode="ci_ai")


@register("s13_signup_outcomes_ci_ai", ["c_signups", "b_users"], f"""
SELECT p.seq, p.Username, p.FullName,
       CASE WHEN p.pre IS NOT NULL THEN p.pre
            WHEN EXISTS (SELECT 1 FROM b_users u WHERE {_folded('u.Username')} = p.k) THEN 'duplicate'
            WHEN p.seq <> f.first_seq THEN 'duplicate' ELSE 'ok' END AS outcome
FROM checked p LEFT JOIN (SELECT k, min(seq) AS first_seq FROM checked WHERE pre IS NULL GROUP BY k) f ON f.k = p.k""", ctes=f"""
trimmed AS (SELECT seq, trim(Username) AS Username, trim(Password) AS Password, trim(Confirm) AS Confirm, trim(FullName) AS FullName
            FROM c_signups),
checked AS (SELECT *, {_folded('Username')} AS k,
                   CASE WHEN IFNULL(Username, '') = '' OR IFNULL(Password, '') = '' OR IFNULL(FullName, '') = '' THEN 'missing'
                        WHEN length(Username) < 4 THEN 'username_short' WHEN length(Password) < 6 THEN 'password_short'
                        WHEN Password IS DISTINCT FROM Confirm THEN 'confirm_mismatch' END AS pre FROM trimmed)""")
def s13_ci_ai(t):
    """S13 sign-up outcomes, usernames unique under the collation."""
    return MT.signup_outcomes(t, mode="ci_ai")


@register("s14_integrity_violations_ci_ai", list(MT.AUDITED.values()), violations_sql("lower(strip_accents(rtrim({})))"))
def s14_ci_ai(t):
    """S14 offending values, text keys compared under the collation."""
    return MT.audit_details(t, mode="ci_ai")


# ---- X9: form text as numbers --------------------------------------------------------------
@register("x09_form_amounts", ["c_fee_forms"], """
SELECT seq, StudentID, ClassID, fee AS TotalFee, off AS Discount, fee - off AS FinalFee
FROM (SELECT *, coalesce(TRY_CAST(nullif(trim(TotalFee), '') AS DOUBLE), 0) AS fee,
             coalesce(TRY_CAST(nullif(trim(Discount), '') AS DOUBLE), 0) AS off FROM c_fee_forms) f""")
def x09(t):
    """X9 amounts of enrollment forms: blank, absent and unreadable text is 0."""
    return MT.form_amounts(t)
