"""Typed table contracts (S2): column types, keys, defaults and enum domains.

Two databases share one shape: a CRM (employees, customers, products,
opportunities, interactions, support tickets, users, activity log) and a
training centre (staff, courses, classes, students, enrollments, payments,
consultations, feedbacks, users, activity log). Keys are ``LongType`` so that
bindings over the test tables conform without casts.

``TABLES`` drives the integrity audit (S14), append defaults (S3/S5) and
``conform`` (cast + reorder an input DataFrame to the contract).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = T.LongType()
MONEY_CRM = T.DecimalType(15, 2)
MONEY_EDU = T.DecimalType(12, 2)
TS = T.TimestampNTZType()
STR = T.StringType()
INT = T.IntegerType()
DATE = T.DateType()

NOW = "__now__"  # default marker: stamp with the operator's as_of


@dataclass(frozen=True)
class Col:
    name: str
    dtype: T.DataType
    nullable: bool = True
    default: object = None
    max_len: int | None = None


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    columns: tuple[Col, ...]
    unique: tuple[str, ...] = ()
    foreign: tuple[tuple[str, str, str], ...] = ()  # (column, parent table, parent key)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in self.columns])

    @property
    def defaults(self) -> dict[str, object]:
        return {c.name: c.default for c in self.columns if c.default is not None}

    @property
    def not_null(self) -> list[str]:
        return [c.name for c in self.columns if not c.nullable]

    @property
    def lengths(self) -> dict[str, int]:
        return {c.name: c.max_len for c in self.columns if c.max_len}


def _t(name, key, cols, unique=(), foreign=()):
    return Table(name, key, tuple(cols), tuple(unique), tuple(foreign))


# ---- CRM -----------------------------------------------------------------
EMPLOYEES = _t("Employees", "EmployeeID", [
    Col("EmployeeID", KEY, False), Col("FullName", STR, False, max_len=100),
    Col("Email", STR, max_len=100), Col("Phone", STR, max_len=20),
    Col("Department", STR, max_len=50), Col("Role", STR, max_len=50),
    Col("HireDate", DATE), Col("Status", STR, default="Active", max_len=20)],
    unique=("Email",))
CUSTOMERS = _t("Customers", "CustomerID", [
    Col("CustomerID", KEY, False), Col("FullName", STR, False, max_len=100),
    Col("Email", STR, max_len=100), Col("Phone", STR, max_len=20),
    Col("Company", STR, max_len=100), Col("Segment", STR, max_len=50),
    Col("Source", STR, max_len=50), Col("AssignedTo", KEY),
    Col("CreatedAt", TS, default=NOW), Col("Status", STR, default="Active", max_len=20)],
    unique=("Email",), foreign=(("AssignedTo", "Employees", "EmployeeID"),))
PRODUCTS = _t("Products", "ProductID", [
    Col("ProductID", KEY, False), Col("ProductName", STR, False, max_len=100),
    Col("Category", STR, max_len=50), Col("Price", MONEY_CRM), Col("Description", STR),
    Col("Status", STR, default="Active", max_len=20)])
OPPORTUNITIES = _t("Opportunities", "OpportunityID", [
    Col("OpportunityID", KEY, False), Col("CustomerID", KEY, False),
    Col("EmployeeID", KEY, False), Col("ProductID", KEY), Col("Title", STR, max_len=200),
    Col("Stage", STR, max_len=50), Col("Value", MONEY_CRM), Col("Probability", INT),
    Col("CreatedAt", TS, default=NOW), Col("ExpectedClose", DATE), Col("ClosedAt", TS),
    Col("Notes", STR)],
    foreign=(("CustomerID", "Customers", "CustomerID"),
             ("EmployeeID", "Employees", "EmployeeID"),
             ("ProductID", "Products", "ProductID")))
INTERACTIONS = _t("Interactions", "InteractionID", [
    Col("InteractionID", KEY, False), Col("CustomerID", KEY, False),
    Col("EmployeeID", KEY, False), Col("Type", STR, max_len=50),
    Col("Subject", STR, max_len=200), Col("Notes", STR), Col("InteractedAt", TS, default=NOW)],
    foreign=(("CustomerID", "Customers", "CustomerID"),
             ("EmployeeID", "Employees", "EmployeeID")))
SUPPORT_TICKETS = _t("SupportTickets", "TicketID", [
    Col("TicketID", KEY, False), Col("CustomerID", KEY, False), Col("EmployeeID", KEY),
    Col("Subject", STR, False, max_len=200), Col("Description", STR),
    Col("Priority", STR, default="Medium", max_len=20), Col("Status", STR, default="Open", max_len=30),
    Col("CreatedAt", TS, default=NOW), Col("ResolvedAt", TS)],
    foreign=(("CustomerID", "Customers", "CustomerID"),
             ("EmployeeID", "Employees", "EmployeeID")))
USERS = _t("Users", "UserID", [
    Col("UserID", KEY, False), Col("Username", STR, False, max_len=50),
    Col("Password", STR, False, max_len=100), Col("Role", STR, False, default="employee", max_len=20),
    Col("EmployeeID", KEY), Col("FullName", STR, max_len=100),
    Col("Status", STR, default="Active", max_len=20), Col("CreatedAt", TS, default=NOW)],
    unique=("Username",), foreign=(("EmployeeID", "Employees", "EmployeeID"),))
ACTIVITY_LOG = _t("ActivityLog", "LogID", [
    Col("LogID", KEY, False), Col("Username", STR, max_len=50), Col("FullName", STR, max_len=100),
    Col("Action", STR, max_len=50), Col("Module", STR, max_len=50), Col("Description", STR),
    Col("IPAddress", STR, max_len=45), Col("CreatedAt", TS, default=NOW)])

# ---- Training centre -----------------------------------------------------
STAFF = _t("Staff", "StaffID", [
    Col("StaffID", KEY, False), Col("FullName", STR, False, max_len=100),
    Col("Email", STR, max_len=100), Col("Phone", STR, max_len=20),
    Col("Department", STR, max_len=50), Col("Role", STR, max_len=50),
    Col("HireDate", DATE), Col("Status", STR, default="Active", max_len=20)],
    unique=("Email",))
COURSES = _t("Courses", "CourseID", [
    Col("CourseID", KEY, False), Col("CourseName", STR, False, max_len=150),
    Col("Category", STR, max_len=50), Col("Level", STR, max_len=30), Col("Duration", INT),
    Col("Fee", MONEY_EDU), Col("Description", STR), Col("Status", STR, default="Active", max_len=20)])
CLASSES = _t("Classes", "ClassID", [
    Col("ClassID", KEY, False), Col("CourseID", KEY, False), Col("ClassName", STR, max_len=100),
    Col("TeacherID", KEY), Col("StartDate", DATE), Col("EndDate", DATE),
    Col("Schedule", STR, max_len=100), Col("Room", STR, max_len=50),
    Col("MaxStudents", INT, default=30), Col("CurrentStudents", INT, default=0),
    Col("Status", STR, default="Upcoming", max_len=20)],
    foreign=(("CourseID", "Courses", "CourseID"), ("TeacherID", "Staff", "StaffID")))
STUDENTS = _t("Students", "StudentID", [
    Col("StudentID", KEY, False), Col("FullName", STR, False, max_len=100),
    Col("Email", STR, max_len=100), Col("Phone", STR, max_len=20), Col("DOB", DATE),
    Col("Gender", STR, max_len=10), Col("Address", STR), Col("Source", STR, max_len=50),
    Col("AssignedTo", KEY), Col("Status", STR, default="Prospect", max_len=20), Col("Notes", STR),
    Col("CreatedAt", TS, default=NOW)],
    unique=("Email",), foreign=(("AssignedTo", "Staff", "StaffID"),))
ENROLLMENTS = _t("Enrollments", "EnrollmentID", [
    Col("EnrollmentID", KEY, False), Col("StudentID", KEY, False), Col("ClassID", KEY, False),
    Col("StaffID", KEY), Col("EnrollDate", DATE), Col("Status", STR, default="Pending", max_len=30),
    Col("TotalFee", MONEY_EDU), Col("Discount", MONEY_EDU, default=0), Col("FinalFee", MONEY_EDU),
    Col("Notes", STR), Col("CreatedAt", TS, default=NOW)],
    foreign=(("StudentID", "Students", "StudentID"), ("ClassID", "Classes", "ClassID"),
             ("StaffID", "Staff", "StaffID")))
PAYMENTS = _t("Payments", "PaymentID", [
    Col("PaymentID", KEY, False), Col("EnrollmentID", KEY, False), Col("StudentID", KEY, False),
    Col("Amount", MONEY_EDU, False), Col("PaymentDate", DATE), Col("Method", STR, max_len=30),
    Col("Note", STR, max_len=200), Col("CreatedBy", KEY), Col("CreatedAt", TS, default=NOW)],
    foreign=(("EnrollmentID", "Enrollments", "EnrollmentID"),
             ("StudentID", "Students", "StudentID"), ("CreatedBy", "Staff", "StaffID")))
CONSULTATIONS = _t("Consultations", "ConsultID", [
    Col("ConsultID", KEY, False), Col("StudentID", KEY, False), Col("StaffID", KEY, False),
    Col("Type", STR, max_len=30), Col("Subject", STR, max_len=200), Col("Notes", STR),
    Col("Result", STR, max_len=50), Col("NextAction", STR, max_len=200),
    Col("ConsultedAt", TS, default=NOW)],
    foreign=(("StudentID", "Students", "StudentID"), ("StaffID", "Staff", "StaffID")))
FEEDBACKS = _t("Feedbacks", "FeedbackID", [
    Col("FeedbackID", KEY, False), Col("StudentID", KEY, False), Col("StaffID", KEY),
    Col("ClassID", KEY), Col("Type", STR, default="Feedback", max_len=30),
    Col("Subject", STR, False, max_len=200), Col("Content", STR),
    Col("Priority", STR, default="Medium", max_len=20), Col("Status", STR, default="Open", max_len=30),
    Col("Response", STR), Col("CreatedAt", TS, default=NOW), Col("ResolvedAt", TS)],
    foreign=(("StudentID", "Students", "StudentID"), ("StaffID", "Staff", "StaffID"),
             ("ClassID", "Classes", "ClassID")))
EDU_USERS = _t("EduUsers", "UserID", [
    Col("UserID", KEY, False), Col("Username", STR, False, max_len=50),
    Col("Password", STR, False, max_len=100), Col("Role", STR, default="employee", max_len=20),
    Col("StaffID", KEY), Col("FullName", STR, max_len=100),
    Col("Status", STR, default="Active", max_len=20), Col("CreatedAt", TS, default=NOW)],
    unique=("Username",), foreign=(("StaffID", "Staff", "StaffID"),))
EDU_ACTIVITY_LOG = Table("EduActivityLog", "LogID", ACTIVITY_LOG.columns)

TABLES: dict[str, Table] = {t.name: t for t in [
    EMPLOYEES, CUSTOMERS, PRODUCTS, OPPORTUNITIES, INTERACTIONS, SUPPORT_TICKETS, USERS,
    ACTIVITY_LOG, STAFF, COURSES, CLASSES, STUDENTS, ENROLLMENTS, PAYMENTS, CONSULTATIONS,
    FEEDBACKS, EDU_USERS, EDU_ACTIVITY_LOG]}

# ---- Fixed values: enum domains and display orders of the reference ------
# (ordered lists; the order is the report/list order the reference uses)
STAGES = ["Lead", "Qualified", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
CLOSED_STAGES = ["Closed Won", "Closed Lost"]
TICKET_STATUSES = ["Open", "In Progress", "Resolved", "Closed"]
OPEN_TICKET_STATUSES = ["Open", "In Progress"]
TICKET_PRIORITIES_LIST = ["Low", "Medium", "High", "Critical"]
TICKET_PRIORITIES_REPORT = ["Critical", "High", "Medium", "Low"]
SEGMENTS = ["SMB", "Enterprise", "Startup"]
CUSTOMER_SOURCES = ["Website", "Referral", "Event", "Social", "Other"]
INTERACTION_TYPES = ["Email", "Call", "Meeting", "Demo", "Chat"]
PRODUCT_CATEGORIES = ["CRM", "Analytics", "Integration", "Support"]
DEPARTMENTS = ["Sales", "Support", "Marketing", "Management"]
STUDENT_STATUSES = ["Prospect", "Enrolled", "Studying", "Graduated", "Dropped"]
STUDENT_SOURCES = ["Website", "Facebook", "Referral", "Walk-in", "Zalo"]
CLASS_STATUSES = ["Upcoming", "Ongoing", "Completed", "Cancelled"]
COURSE_CATEGORIES = ["Lập trình", "Ngoại ngữ", "Kỹ năng", "Thiết kế", "Tin học"]
ENROLLMENT_STATUSES = ["Pending", "Confirmed", "Studying", "Completed", "Dropped", "Refunded"]
PAYMENT_METHODS = ["Tiền mặt", "Chuyển khoản", "Thẻ"]
CONSULT_TYPES = ["Gọi điện", "Gặp mặt", "Zalo", "Email", "Demo"]
CONSULT_RESULTS = ["Quan tâm", "Cần suy nghĩ", "Đã đăng ký", "Không quan tâm"]
FEEDBACK_STATUSES = ["Open", "Processing", "Resolved", "Closed"]
ACTIVITY_ACTIONS = ["LOGIN", "LOGOUT", "CREATE", "UPDATE", "DELETE"]
ACTIVITY_MODULES = ["Auth", "Customer", "Opportunity", "Interaction", "Ticket", "User"]
USER_ROLES = ["admin", "employee", "guest"]
ROLE_LABELS = {"admin": "Admin", "employee": "Nhân viên", "guest": "Khách"}
TICKET_STATUS_CLASSES = {"Open": "danger", "In Progress": "warning",
                         "Resolved": "success", "Closed": "secondary"}
TICKET_PRIORITY_CLASSES = {"Low": "secondary", "Medium": "info",
                           "High": "warning", "Critical": "danger"}


def conform(df: DataFrame, table: Table, allow_missing: bool = True) -> DataFrame:
    """Cast and order ``df`` to the contract; absent columns become typed NULLs.

    Extra columns are dropped. With ``allow_missing=False`` an absent column
    raises instead (a strict read).
    """
    present = set(df.columns)
    cols = []
    for c in table.columns:
        if c.name in present:
            cols.append(F.col(c.name).cast(c.dtype).alias(c.name))
        elif allow_missing:
            cols.append(F.lit(None).cast(c.dtype).alias(c.name))
        else:
            raise ValueError(f"{table.name}: missing column {c.name}")
    return df.select(*cols)
