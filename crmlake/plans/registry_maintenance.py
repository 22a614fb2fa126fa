"""Registered table-maintenance jobs (S4-S15) with oracle SQL.

Change sets are the ``c_*`` bindings (value-based rules over the test
tables). Snapshot outputs are compared whole; surrogate keys in SQL are
``max(key) + row_number() OVER (request order)``.
"""

from __future__ import annotations

from crmlake.operators.mutations import replace_rows
from crmlake.plans import maintenance as MT
from crmlake.plans import params as P
from crmlake.plans.audit_oracle import audit_sql, violations_sql
from crmlake.plans.catalog import register

AS_OF = P.AS_OF_ORDERS
TS = f"TIMESTAMP '{AS_OF}'"


@register("s04_derive_accounts", ["b_employees", "b_users"], f"""
SELECT (SELECT max(UserID) FROM b_users) + row_number() OVER (ORDER BY EmployeeID, Username) AS UserID,
       Username, '123456' AS Password, 'employee' AS Role, EmployeeID, FullName,
       'Active' AS Status, {TS} AS CreatedAt
FROM (SELECT Username, arg_min(EmployeeID, EmployeeID) AS EmployeeID, arg_min(FullName, EmployeeID) AS FullName
      FROM (SELECT lower(replace(split_part(Email, '@', 1), '.', '_')) AS Username, EmployeeID, FullName
            FROM b_employees WHERE Email IS NOT NULL) c
      GROUP BY Username) d
WHERE Username NOT IN (SELECT Username FROM b_users WHERE Username IS NOT NULL)""")
def s04(t):
    """S4 employee accounts derived from e-mails, existing usernames skipped."""
    return MT.employee_accounts(t, AS_OF)


@register("s05_append_return_tickets", ["b_tickets", "c_return_tickets"], f"""
SELECT * FROM b_tickets
UNION ALL
SELECT (SELECT max(TicketID) FROM b_tickets)
         + row_number() OVER (ORDER BY RequestedAt, src_order, src_line, src_part, src_supp, src_qty) AS TicketID,
       CustomerID, EmployeeID, Subject, IFNULL(Priority, 'Medium') AS Priority, 'Open' AS Status,
       {TS} AS CreatedAt
FROM c_return_tickets""")
def s05(t):
    """S5 append one ticket per returned line item with defaults and new keys."""
    return t.tickets.unionByName(MT.open_return_tickets(t, AS_OF))


@register("s06_update_segments", ["b_customers", "c_segment_changes"], """
SELECT c.* REPLACE (CASE WHEN ch.CustomerID IS NOT NULL THEN ch.Segment ELSE c.Segment END AS Segment,
                    CASE WHEN ch.CustomerID IS NOT NULL THEN ch.AssignedTo ELSE c.AssignedTo END AS AssignedTo)
FROM b_customers c LEFT JOIN c_segment_changes ch ON c.CustomerID = ch.CustomerID""")
def s06(t):
    """S6 keyed update of customer segment and owner."""
    return MT.reassign_segments(t, t.rows("customers"))


@register("s07_ticket_transitions", ["b_tickets", "c_ticket_transitions"], f"""
SELECT t.* REPLACE (CASE WHEN ch.TicketID IS NOT NULL THEN ch.Status ELSE t.Status END AS Status),
       CASE WHEN ch.TicketID IS NOT NULL AND ch.Status = 'Resolved' THEN {TS} END AS ResolvedAt
FROM b_tickets t LEFT JOIN c_ticket_transitions ch ON t.TicketID = ch.TicketID""")
def s07(t):
    """S7 ticket status changes stamping ResolvedAt."""
    return MT.transition_tickets(t, AS_OF, t.rows("tickets"))


@register("s07_deal_transitions", ["b_opportunities", "c_deal_changes"], f"""
SELECT o.* REPLACE (CASE WHEN ch.OpportunityID IS NULL THEN o.Stage ELSE ch.Stage END AS Stage,
                    CASE WHEN ch.OpportunityID IS NULL THEN o.ClosedAt
                         WHEN starts_with(ch.Stage, 'Closed') THEN {TS} END AS ClosedAt)
FROM b_opportunities o LEFT JOIN c_deal_changes ch ON ch.OpportunityID = o.OpportunityID""")
def s07_deals(t):
    """S7 deal stage changes stamping or erasing ClosedAt."""
    return MT.close_deals(t, t.view("c_deal_changes"), AS_OF, rows=t.rows("opportunities"))


@register("s07_feedback_answers", ["b_feedbacks", "c_feedback_answers"], f"""
SELECT f.* REPLACE (CASE WHEN a.FeedbackID IS NULL THEN f.Status ELSE 'Resolved' END AS Status),
       a.Response, CASE WHEN a.FeedbackID IS NOT NULL THEN {TS} END AS ResolvedAt
FROM b_feedbacks f LEFT JOIN c_feedback_answers a ON a.FeedbackID = f.FeedbackID""")
def s07_feedbacks(t):
    """S7 feedback answers stamping ResolvedAt."""
    return MT.resolve_feedbacks(t, AS_OF, t.rows("feedbacks"))


@register("s08_purge_tickets", ["b_tickets", "c_ticket_purge"], """
SELECT * FROM b_tickets WHERE TicketID NOT IN (SELECT TicketID FROM c_ticket_purge WHERE TicketID IS NOT NULL)""")
def s08(t):
    """S8 delete tickets by key."""
    return MT.purge_tickets(t)


_DEL = "(SELECT CustomerID FROM c_closed_customers WHERE CustomerID IS NOT NULL)"


@register("s09_delete_customers_cascade", ["b_customers", "b_tickets", "b_interactions",
                                           "b_opportunities", "c_closed_customers"], f"""
SELECT (SELECT count(*) FROM b_customers WHERE CustomerID NOT IN {_DEL}) AS customers_left,
       (SELECT count(*) FROM b_tickets WHERE CustomerID NOT IN {_DEL}) AS tickets_left,
       (SELECT count(*) FROM b_interactions WHERE CustomerID NOT IN {_DEL}) AS interactions_left,
       (SELECT count(*) FROM b_opportunities WHERE CustomerID NOT IN {_DEL}) AS opportunities_left""")
def s09(t):
    """S9 delete customers with their tickets, interactions and opportunities (row counts left)."""
    return MT.delete_customers_summary(t)


def _cascade_snapshot(name: str, view: str, key: str):
    @register(f"s09_{name}_snapshot", [view, "c_closed_customers"], f"""
SELECT v.* FROM {view} v ANTI JOIN c_closed_customers d ON v.CustomerID = d.CustomerID""")
    def s09_snapshot(t):
        """S9 the whole table after the customers of the change set were deleted."""
        return MT.delete_customers(t)[key]


for _name, _key in [("customers", "parent"), ("tickets", "tickets"), ("interactions", "interactions"),
                    ("opportunities", "opportunities")]:
    _cascade_snapshot(_name, f"b_{_name}", _key)


@register("s10_retire_products", ["b_opportunities", "c_retired_products"], """
SELECT o.* REPLACE (CASE WHEN o.ProductID IN (SELECT ProductID FROM c_retired_products) THEN NULL
                         ELSE o.ProductID END AS ProductID)
FROM b_opportunities o""")
def s10(t):
    """S10 delete products; opportunities keep their rows with ProductID NULL."""
    return MT.retire_products(t)


_EMP = "(SELECT EmployeeID FROM c_leaving_employees WHERE EmployeeID IS NOT NULL)"


@register("s10_remove_employees", ["b_employees", "b_customers", "b_interactions", "b_tickets",
                                   "b_opportunities", "c_leaving_employees"], f"""
SELECT (SELECT count(*) FROM b_employees WHERE EmployeeID NOT IN {_EMP}) AS employees_left,
       (SELECT count(*) FROM b_customers WHERE AssignedTo IS NULL OR AssignedTo IN {_EMP}) AS customers_unassigned,
       (SELECT count(*) FROM b_interactions WHERE EmployeeID NOT IN {_EMP}) AS interactions_left,
       (SELECT count(*) FROM b_tickets WHERE EmployeeID IS NULL OR EmployeeID NOT IN {_EMP}) AS tickets_left,
       (SELECT count(*) FROM b_opportunities WHERE EmployeeID IN {_EMP}) AS opportunity_violations""")
def s10e(t):
    """S10 delete employees: unassign customers, cascade interactions and tickets, report
    opportunity violations."""
    return MT.remove_employees_summary(t)


_LEAVING = "EXISTS (SELECT 1 FROM c_leaving_employees d WHERE d.EmployeeID = v.{})"


def _removal_snapshot(name: str, view: str, key: str, sql: str):
    @register(f"s10_{name}_snapshot", [view, "c_leaving_employees"], sql)
    def s10_snapshot(t):
        """S10 the whole table after the employees of the change set were removed."""
        return MT.remove_employees(t)[key]


for _name, _key in [("employees", "parent"), ("interactions", "interactions"), ("tickets", "tickets")]:
    _removal_snapshot(_name, f"b_{_name}", _key,
                      f"SELECT v.* FROM b_{_name} v WHERE NOT {_LEAVING.format('EmployeeID')}")
_removal_snapshot("customers", "b_customers", "customers", f"""
SELECT v.* REPLACE (CASE WHEN {_LEAVING.format('AssignedTo')} THEN NULL ELSE v.AssignedTo END AS AssignedTo)
FROM b_customers v""")


@register("s11_enrollments_snapshot", ["b_enrollments", "c_enrollment_requests"], f"""
SELECT * FROM b_enrollments
UNION ALL
SELECT (SELECT max(EnrollmentID) FROM b_enrollments) + row_number() OVER (ORDER BY seq) AS EnrollmentID,
       StudentID, ClassID, StaffID, CAST({TS} AS DATE) AS EnrollDate, 'Confirmed' AS Status,
       IFNULL(TotalFee, 0) AS TotalFee, IFNULL(Discount, 0) AS Discount,
       CAST(IFNULL(TotalFee, 0) - IFNULL(Discount, 0) AS DECIMAL(12,2)) AS FinalFee, {TS} AS CreatedAt
FROM c_enrollment_requests""")
def s11(t):
    """S11 enrollment requests appended as confirmed enrollments (FinalFee = fee - discount)."""
    return t.enrollments.unionByName(MT.register_enrollments(t, AS_OF)["enrollments"])


@register("s11_class_counters", ["b_classes", "c_enrollment_requests"], """
SELECT cl.* REPLACE (CAST(cl.CurrentStudents + IFNULL(r.n, 0) AS INTEGER) AS CurrentStudents)
FROM b_classes cl LEFT JOIN (SELECT ClassID, count(*) AS n FROM c_enrollment_requests GROUP BY ClassID) r
  ON cl.ClassID = r.ClassID""")
def s11c(t):
    """S11 class counters incremented by the requests per class."""
    return replace_rows(t.classes, MT.register_enrollments(t, AS_OF)["classes"], "ClassID")


@register("s11_student_status", ["b_students", "c_enrollment_requests"], """
SELECT s.* REPLACE (CASE WHEN s.StudentID IN (SELECT StudentID FROM c_enrollment_requests)
                         THEN 'Enrolled' ELSE s.Status END AS Status)
FROM b_students s""")
def s11s(t):
    """S11 requesting students set to Enrolled."""
    return replace_rows(t.students, MT.register_enrollments(t, AS_OF)["students"], "StudentID")


# removals one after the other: an admin stays once the active admins removed before it leave only one
_REFUSED = """refused AS (SELECT UserID
FROM (SELECT UserID, count(*) FILTER (WHERE Status = 'Active')
               OVER (ORDER BY UserID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM b_users SEMI JOIN c_user_removals USING (UserID) WHERE Role = 'admin') batch
WHERE before >= (SELECT count(*) FROM b_users WHERE Role = 'admin' AND Status = 'Active') - 1)"""


@register("s12_guarded_user_delete", ["b_users", "c_user_removals"], """
SELECT * FROM b_users
WHERE UserID NOT IN (SELECT UserID FROM c_user_removals) OR UserID IN (SELECT UserID FROM refused)""",
          ctes=_REFUSED)
def s12(t):
    """S12 delete accounts but keep the last active admin."""
    return MT.remove_users(t)["users"]


@register("s12_refused_removals", ["b_users", "c_user_removals"], "SELECT UserID FROM refused", ctes=_REFUSED)
def s12r(t):
    """S12 the accounts of the batch whose removal is refused."""
    return MT.remove_users(t)["refused"]


_SIGNUP_CTES = r"""r AS (SELECT seq, regexp_replace(Username, '^\s+|\s+$', '', 'g') AS Username,
              regexp_replace(Password, '^\s+|\s+$', '', 'g') AS Password,
              regexp_replace(Confirm, '^\s+|\s+$', '', 'g') AS Confirm,
              regexp_replace(FullName, '^\s+|\s+$', '', 'g') AS FullName FROM c_signups),
pre AS (SELECT *, CASE WHEN IFNULL(length(Username), 0) = 0 OR IFNULL(length(Password), 0) = 0
                            OR IFNULL(length(FullName), 0) = 0 THEN 'missing'
                       WHEN length(Username) < 4 THEN 'username_short'
                       WHEN length(Password) < 6 THEN 'password_short'
                       WHEN Password IS DISTINCT FROM Confirm THEN 'confirm_mismatch' END AS pre FROM r),
firsts AS (SELECT Username, min(seq) AS first_seq FROM pre WHERE pre IS NULL GROUP BY Username),
outcomes AS (SELECT p.seq, p.Username, p.FullName, p.Password,
       CASE WHEN p.pre IS NOT NULL THEN p.pre
            WHEN p.Username IN (SELECT Username FROM b_users WHERE Username IS NOT NULL) THEN 'duplicate'
            WHEN p.seq <> f.first_seq THEN 'duplicate' ELSE 'ok' END AS outcome
FROM pre p LEFT JOIN firsts f ON p.Username = f.Username)"""


@register("s13_signup_outcomes", ["c_signups", "b_users"],
          "SELECT seq, Username, FullName, outcome FROM outcomes", ctes=_SIGNUP_CTES)
def s13(t):
    """S13 sign-up validation outcome per request (missing, short, mismatch, duplicate, ok)."""
    return MT.signup_outcomes(t)


@register("s13_accept_signups", ["c_signups", "b_users"], f"""
SELECT * FROM b_users
UNION ALL
SELECT (SELECT max(UserID) FROM b_users) + row_number() OVER (ORDER BY seq) AS UserID, Username, Password,
       FullName, 'guest' AS Role, CAST(NULL AS BIGINT) AS EmployeeID, 'Inactive' AS Status
FROM outcomes WHERE outcome = 'ok'""", ctes=_SIGNUP_CTES)
def s13a(t):
    """S13 accepted sign-ups appended as inactive guest accounts."""
    return t.users.unionByName(MT.accept_signups(t, AS_OF))


@register("s14_integrity_audit", list(MT.AUDITED.values()), audit_sql())
def s14(t):
    """S14 integrity audit: key/unique duplicates, NOT NULL, lengths, orphan foreign keys."""
    return MT.audit(t)


@register("s14_integrity_violations", list(MT.AUDITED.values()), violations_sql())
def s14v(t):
    """S14 the offending values behind each finding (duplicate and orphan keys, bad rows)."""
    return MT.audit_details(t)


@register("s15_append_activity", ["b_activity", "c_ticket_activity"], """
SELECT * FROM b_activity
UNION ALL
SELECT (SELECT max(LogID) FROM b_activity) + row_number() OVER (ORDER BY CreatedAt, seq) AS LogID,
       Username, FullName, Action, Module, Description, IPAddress, CreatedAt
FROM c_ticket_activity""")
def s15(t):
    """S15 activity entries appended to the log with new LogIDs."""
    return t.activity.unionByName(MT.log_ticket_activity(t, AS_OF))


@register("s15_activity_stream", ["b_activity"], """
SELECT row_number() OVER (ORDER BY CreatedAt, Username, Action, Module, Description, IPAddress, LogID) AS LogID,
       Username, FullName, Action, Module, Description, IPAddress, CreatedAt
FROM b_activity""")
def s15s(t):
    """S15 activity entries appended by a Structured Streaming query (file source, foreachBatch)."""
    return MT.stream_activity(t)
