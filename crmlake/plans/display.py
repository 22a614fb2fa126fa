"""Display rows of the list pages (X10-X16): what the templates compute per
row — dates and times as text, money with separators, previews of long
text, code -> label/class maps, initials and the empty-value dash —
computed as columns over the whole lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.functions import scalars as X
from crmlake.operators.joins import lookup
from crmlake.plans import crm
from crmlake.sources import schemas as S

# Badge classes of the account page.
ROLE_CLASSES = {"admin": "danger", "employee": "primary", "guest": "secondary"}


def recent_interactions_display(t, n: int = 5) -> DataFrame:
    """Dashboard feed: the latest interactions with ``%d/%m/%Y %H:%M`` times."""
    return (crm.recent_interactions(t, n)
            .select("InteractionID", "Subject", "customer", "employee",
                    X.fmt_datetime("InteractedAt").alias("at_text")))


def ticket_rows(t) -> DataFrame:
    """Ticket list rows: status/priority badge classes (fallback 'secondary'),
    created date text, assignee or dash."""
    k = lookup(t.tickets, t.employees, "EmployeeID", "EmployeeID", {"FullName": "employee"}, "left")
    return k.select("TicketID",
                    X.label("Status", S.TICKET_STATUS_CLASSES, "secondary").alias("status_class"),
                    X.label("Priority", S.TICKET_PRIORITY_CLASSES, "secondary").alias("priority_class"),
                    X.fmt_date("CreatedAt").alias("created_text"),
                    X.placeholder("employee").alias("employee_text"))


def account_rows(t) -> DataFrame:
    """Account list rows: role label (unknown roles shown as is) and class."""
    return t.users.select("UserID", "Username",
                          X.label("Role", S.ROLE_LABELS).alias("role_label"),
                          X.label("Role", ROLE_CLASSES, "secondary").alias("role_class"))


def activity_rows(t) -> DataFrame:
    """Activity log rows with ``%d/%m/%Y %H:%M:%S`` times."""
    return t.activity.select("LogID", "Username", "Action", "Module",
                             X.fmt_datetime("CreatedAt", seconds=True).alias("at_text"))


def product_rows(t) -> DataFrame:
    """Catalogue rows: price text and an 80-character description preview."""
    return t.products.select("ProductID", "ProductName", X.fmt_money("Price").alias("price_text"),
                             X.preview("Description").alias("description_preview"))


def course_rows(t) -> DataFrame:
    """Course rows: fee text and description preview."""
    return t.courses.select("CourseID", "CourseName", X.fmt_money("Fee").alias("fee_text"),
                            X.preview("Description").alias("description_preview"))


def feedback_rows(t) -> DataFrame:
    """Feedback rows: preview of the (whole) subject text and class or dash."""
    f = lookup(t.feedbacks, t.classes, "ClassID", "ClassID", {"ClassName": "ClassName"}, "left")
    return f.select("FeedbackID", X.preview("Subject").alias("subject_preview"),
                    F.length("Subject").alias("subject_chars"),
                    X.placeholder("ClassName").alias("class_text"))


def student_cards(t) -> DataFrame:
    """Student profile header: avatar initial, name, staff or dash."""
    s = lookup(t.students, t.staff, "AssignedTo", "StaffID", {"FullName": "staff_name"}, "left")
    return s.select("StudentID", X.initial("FullName").alias("initial"), "FullName",
                    X.placeholder("staff_name").alias("staff_text"))
