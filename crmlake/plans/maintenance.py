"""Table-maintenance jobs (S3-S15) over the bound tables.

Each job takes the current tables and a change set (``t.view('c_...')``).
Appends return the new rows; the caller writes them with ``sinks.append_keyed``
(``TableSet.append``), which records the key mark that the next append begins at.
Updates and deletes return new snapshots (or one-row summaries of several). The
registered append queries add the new rows to their base, so that they can be
compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.functions.scalars import to_number
from crmlake.operators import mutations as M
from crmlake.operators.aggregates import combine_rows
from crmlake.operators.audit import audit_violations, integrity_audit
from crmlake.sources import schemas as S

# Contract name -> binding name of every audited table.
AUDITED = {
    "Employees": "b_employees", "Customers": "b_customers", "Products": "b_products",
    "Opportunities": "b_opportunities", "Interactions": "b_interactions",
    "SupportTickets": "b_tickets", "Users": "b_users", "ActivityLog": "b_activity",
    "Staff": "b_staff", "Courses": "b_courses", "Classes": "b_classes", "Students": "b_students",
    "Enrollments": "b_enrollments", "Payments": "b_payments", "Consultations": "b_consultations",
    "Feedbacks": "b_feedbacks",
}

RETURN_TICKET_ORDER = ["RequestedAt", "src_order", "src_line", "src_part", "src_supp", "src_qty"]


def _count():
    return F.count(F.lit(1))


def open_return_tickets(t, as_of) -> DataFrame:
    """S5 (+S3 defaults): one new ticket per returned line item; keys follow
    the existing ones in request order; Priority/Status/CreatedAt defaults."""
    return M.append(t.view("c_return_tickets"), S.SUPPORT_TICKETS, as_of, RETURN_TICKET_ORDER,
                    t.after("tickets", "TicketID"), optional=["EmployeeID"], columns=t.tickets.columns)


def reassign_segments(t, rows: int | None = None) -> DataFrame:
    """Keyed update of Segment and AssignedTo (NULL assigns NULL)."""
    return M.update_by_key(t.customers, t.view("c_segment_changes"), "CustomerID",
                           ["Segment", "AssignedTo"], rows=rows)


def transition_tickets(t, as_of, rows: int | None = None) -> DataFrame:
    """Ticket status changes; ResolvedAt = as_of when the new status is
    Resolved, NULL otherwise (moving to Closed erases it)."""
    return M.stamp_on_transition(t.tickets, t.view("c_ticket_transitions"), "TicketID", "Status",
                                 "ResolvedAt", ["Resolved"], as_of, rows=rows)


def close_deals(t, changes: DataFrame, as_of, preserve_existing: bool = False, rows: int | None = None) -> DataFrame:
    """Opportunity stage changes; ClosedAt = as_of for Closed Won/Lost,
    NULL for any other stage."""
    return M.stamp_on_transition(t.opportunities, changes, "OpportunityID", "Stage", "ClosedAt",
                                 S.CLOSED_STAGES, as_of, preserve_existing=preserve_existing,
                                 seq="seq" if "seq" in changes.columns else None, rows=rows)


def resolve_feedbacks(t, as_of, rows: int | None = None) -> DataFrame:
    """Feedback answers; the status becomes Resolved, ResolvedAt = as_of."""
    answers = t.view("c_feedback_answers").withColumn("Status", F.lit("Resolved"))
    return M.stamp_on_transition(t.feedbacks, answers, "FeedbackID", "Status", "ResolvedAt", ["Resolved"],
                                 as_of, extra=["Response"], rows=rows)


def purge_tickets(t) -> DataFrame:
    """Delete tickets by key."""
    return M.delete_by_key(t.tickets, t.view("c_ticket_purge"), "TicketID")


def delete_customers(t) -> dict[str, DataFrame]:
    """Customers and their tickets, interactions and opportunities."""
    return M.delete_cascade(t.customers, "CustomerID", {
        "tickets": (t.tickets, "CustomerID"),
        "interactions": (t.interactions, "CustomerID"),
        "opportunities": (t.opportunities, "CustomerID"),
    }, t.view("c_closed_customers"))


def delete_customers_summary(t) -> DataFrame:
    """S9 summary: rows left in each table after the cascade."""
    out = delete_customers(t)
    return combine_rows(*[df.agg(_count().alias(f"{name}_left")) for name, df in
                          [("customers", out["parent"]), ("tickets", out["tickets"]),
                           ("interactions", out["interactions"]),
                           ("opportunities", out["opportunities"])]])


def retire_products(t) -> DataFrame:
    """Delete products; opportunities keep the row with ProductID NULL."""
    out = M.delete_nullify(t.products, "ProductID", {"opportunities": (t.opportunities, "ProductID")},
                           t.view("c_retired_products"))
    return out["opportunities"]


def remove_employees(t) -> dict[str, DataFrame]:
    """Delete employees the reference's way: customers unassigned,
    interactions and tickets deleted; opportunities (NOT NULL owner) are
    reported as violations rather than half-applied."""
    return M.delete_nullify(
        t.employees, "EmployeeID", {"customers": (t.customers, "AssignedTo")},
        t.view("c_leaving_employees"),
        cascade={"interactions": (t.interactions, "EmployeeID"), "tickets": (t.tickets, "EmployeeID")},
        restrict={"opportunities": (t.opportunities, "EmployeeID")})


def remove_employees_summary(t) -> DataFrame:
    out = remove_employees(t)
    return combine_rows(
        out["parent"].agg(_count().alias("employees_left")),
        out["customers"].agg(F.count_if(F.col("AssignedTo").isNull()).alias("customers_unassigned")),
        out["interactions"].agg(_count().alias("interactions_left")),
        out["tickets"].agg(_count().alias("tickets_left")),
        out["violations_opportunities"].agg(_count().alias("opportunity_violations")))


def register_enrollments(t, as_of) -> dict[str, DataFrame]:
    """Enrollment requests -> new enrollments, changed classes, changed students."""
    return M.apply_enrollments(t.view("c_enrollment_requests"), t.classes, t.students, S.ENROLLMENTS, as_of, ["seq"],
                               t.after("enrollments", "EnrollmentID"), columns=t.enrollments.columns)


def form_amounts(t) -> DataFrame:
    """Amounts of enrollment forms as numbers; blank, absent and unreadable text counts as 0."""
    fee, discount = to_number("TotalFee"), to_number("Discount")
    return t.view("c_fee_forms").select("seq", "StudentID", "ClassID", fee.alias("TotalFee"), discount.alias("Discount"),
                                        (fee - discount).alias("FinalFee"))


def remove_users(t) -> dict[str, DataFrame]:
    """Delete accounts, keeping the last active admin."""
    return M.guarded_delete(t.users, t.view("c_user_removals"))


def employee_accounts(t, as_of, mode: str = "binary") -> DataFrame:
    """Accounts derived from employee e-mails (INSERT IGNORE)."""
    return M.derive_accounts(t.employees, t.users, S.USERS, as_of, t.after("users", "UserID"), mode=mode)


def signup_outcomes(t, mode: str = "binary") -> DataFrame:
    """Validation outcome of every sign-up request."""
    return M.signup_outcomes(t.view("c_signups"), t.users, mode=mode)


def accept_signups(t, as_of, mode: str = "binary") -> DataFrame:
    """New accounts of the accepted sign-ups, inactive guests."""
    outcomes = M.signup_outcomes(t.view("c_signups"), t.users, mode=mode)
    return M.accept_signups(outcomes, t.view("c_signups"), S.USERS, as_of, t.after("users", "UserID"), columns=t.users.columns)


def audit(t, mode: str = "binary") -> DataFrame:
    """Integrity findings over every bound table."""
    return integrity_audit({name: t.view(view) for name, view in AUDITED.items()}, mode=mode)


def audit_details(t, mode: str = "binary") -> DataFrame:
    """The offending values behind every audit finding."""
    return audit_violations({name: t.view(view) for name, view in AUDITED.items()}, mode=mode)


def log_ticket_activity(t, as_of) -> DataFrame:
    """S15 (batch): activity entries appended with new LogIDs."""
    return M.append_activity(t.view("c_ticket_activity"), S.ACTIVITY_LOG, as_of, ["CreatedAt", "seq"],
                             t.after("activity", "LogID"), columns=t.activity.columns)


def stream_activity(t) -> DataFrame:
    """S15 (stream): events landing as files are appended to an activity log
    by a Structured Streaming query (file source -> foreachBatch append with
    new LogIDs); returns the resulting log. Runs with an available-now
    trigger into a fresh folder under the shared checkpoint folder."""
    import time

    from crmlake.session import ensure_checkpoint_dir
    from crmlake.streaming import activity as A
    base = ensure_checkpoint_dir(t.spark).rstrip("/") + f"/activity-stream-{time.time_ns()}"
    source = A.entries_from_events(A.event_stream(t.spark, t.sf_dir, "events.parquet"))
    query = A.start_activity_stream(t.spark, source, f"{base}/log", f"{base}/_checkpoint")
    query.awaitTermination()
    return A.read_log(t.spark, f"{base}/log")
