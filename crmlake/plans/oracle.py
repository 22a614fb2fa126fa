"""Oracle text of the lists, built from one declared specification per list.

A list is a base view, the relations looked up for each of its rows, and the
columns computed from both. Every relation is looked up on a unique key:
children are aggregated per key before they are joined, so no list groups
joined rows. Conditions are stated on the finished list's column names.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lookup:
    """Columns ``{output name: column}`` of ``relation``, found where its
    ``pk`` equals the base view's ``fk``. A row without a match is dropped
    when ``required``; otherwise its columns are ``default``."""
    relation: str
    fk: str
    pk: str
    columns: dict[str, str]
    required: bool = False
    default: str = "NULL"


@dataclass(frozen=True)
class ListSpec:
    base: str
    lookups: tuple[Lookup, ...] = ()
    money: tuple[str, ...] = ()       # decimals shown as doubles
    computed: tuple[str, ...] = ()    # "expression AS name" over the list's columns

    def sql(self, where: str = "TRUE", columns: str = "*") -> str:
        picked, joins = [f"{self.base}.*"], []
        for i, look in enumerate(self.lookups):
            picked += [f"IFNULL(found{i}.{col}, {look.default}) AS {out}" for out, col in look.columns.items()]
            joins.append(f"{'INNER' if look.required else 'LEFT'} JOIN {look.relation} found{i} "
                         f"ON found{i}.{look.pk} = {self.base}.{look.fk}")
        shown = "*"
        if self.money:
            shown += " REPLACE (" + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in self.money) + ")"
        shown = ", ".join([shown, *self.computed])
        joined = f"SELECT {', '.join(picked)} FROM {self.base} {' '.join(joins)}"
        return f"SELECT {columns} FROM (SELECT {shown} FROM ({joined}) looked_up) listed WHERE {where}"


def per_key(view: str, key: str, **aggregates: str) -> str:
    """A child view aggregated to one row per non-NULL ``key``."""
    cols = ", ".join(f"{expr} AS {name}" for name, expr in aggregates.items())
    return f"(SELECT {key}, {cols} FROM {view} WHERE {key} IS NOT NULL GROUP BY {key})"


def contains(columns: list[str], q: str) -> str:
    pattern = "'%" + q.replace("'", "''") + "%'"
    return "(" + " OR ".join(f"{c} LIKE {pattern}" for c in columns) + ")"


def distinct_children(view: str, key: str, child: str) -> str:
    return per_key(view, key, n=f"count(DISTINCT {child})")


# ---- customer relations ----------------------------------------------------------------
CUSTOMER_OF = Lookup("b_customers", "CustomerID", "CustomerID",
                     {"customer": "FullName", "Company": "Company"}, required=True)


def _employee(name: str, fk: str = "EmployeeID", required: bool = False) -> Lookup:
    return Lookup("b_employees", fk, "EmployeeID", {name: "FullName"}, required)


CUSTOMERS = ListSpec("b_customers", (
    _employee("employee_name", "AssignedTo"),
    Lookup(distinct_children("b_opportunities", "CustomerID", "OpportunityID"), "CustomerID", "CustomerID",
           {"opp_count": "n"}, default="0"),
    Lookup(distinct_children("b_tickets", "CustomerID", "TicketID"), "CustomerID", "CustomerID",
           {"ticket_count": "n"}, default="0")))
OPPORTUNITIES = ListSpec("b_opportunities", (
    CUSTOMER_OF, _employee("employee", required=True),
    Lookup("b_products", "ProductID", "ProductID", {"ProductName": "ProductName"})), money=("Value",))
INTERACTIONS = ListSpec("b_interactions", (CUSTOMER_OF, _employee("employee", required=True)))
TICKETS = ListSpec("b_tickets", (CUSTOMER_OF, _employee("employee")))
ACTIVITY = ListSpec("b_activity")
EMPLOYEES = ListSpec("b_employees", (
    Lookup(distinct_children("b_customers", "AssignedTo", "CustomerID"), "EmployeeID", "AssignedTo",
           {"customer_count": "n"}, default="0"),
    Lookup(distinct_children("b_opportunities", "EmployeeID", "OpportunityID"), "EmployeeID", "EmployeeID",
           {"opp_count": "n"}, default="0")))
ACCOUNTS = ListSpec("b_users", (
    Lookup("b_employees", "EmployeeID", "EmployeeID", {"emp_name": "FullName", "Department": "Department"}),))

# source, view, id, title, label, further sort column
SEARCHED = (("opportunities", "b_opportunities", "OpportunityID", "Title", "Stage", "Value"),
            ("interactions", "b_interactions", "InteractionID", "Subject", "Type", "0"),
            ("tickets", "b_tickets", "TicketID", "Subject", "Status", "0"))


def global_search_sql(q: str, per_source: int = 5) -> str:
    """Hits of all sources as one relation, the first few of each kept by rank."""
    hits = [f"SELECT 'customers' AS source, CustomerID AS id, FullName AS title, Segment AS label, "
            f"Company AS customer, 0 AS tie FROM b_customers WHERE {contains(['FullName', 'Company', 'Email'], q)}"]
    for source, view, key, title, label, tie in SEARCHED:
        found = ListSpec(view, (CUSTOMER_OF,)).sql(contains([title, "customer"], q))
        hits.append(f"SELECT '{source}', {key}, {title}, {label}, customer, {tie} FROM ({found}) f")
    return ("SELECT source, id, title, label, customer FROM (SELECT *, row_number() OVER ("
            "PARTITION BY source ORDER BY id, label, customer, tie) AS place FROM ("
            + " UNION ALL ".join(hits) + f") hits) ranked WHERE place <= {per_source}")


# ---- training centre ---------------------------------------------------------------------
STUDENT_OF = Lookup("b_students", "StudentID", "StudentID", {"student": "FullName"}, required=True)
COURSE_OF_CLASS = "(SELECT ClassID, ClassName, CourseName FROM b_classes JOIN b_courses USING (CourseID))"
COURSE_OF_ENROLLMENT = (f"(SELECT EnrollmentID, ClassName, CourseName FROM b_enrollments "
                        f"JOIN {COURSE_OF_CLASS} taught USING (ClassID))")
PAID = Lookup(per_key("b_payments", "EnrollmentID", total="SUM(Amount)"), "EnrollmentID", "EnrollmentID",
              {"paid": "total"}, default="0")


def _staff(name: str, fk: str = "StaffID", required: bool = False) -> Lookup:
    return Lookup("b_staff", fk, "StaffID", {name: "FullName"}, required)


STUDENTS = ListSpec("b_students", (
    _staff("staff_name", "AssignedTo"),
    Lookup(distinct_children("b_enrollments", "StudentID", "EnrollmentID"), "StudentID", "StudentID",
           {"enroll_count": "n"}, default="0")))
NEW_STUDENTS = ListSpec("b_students", (_staff("staff_name", "AssignedTo"),))
CLASSES = ListSpec("b_classes", (
    Lookup("b_courses", "CourseID", "CourseID",
           {"CourseName": "CourseName", "Category": "Category", "Fee": "Fee"}, required=True),
    _staff("teacher", "TeacherID")), money=("Fee",))
COURSES = ListSpec("b_courses", money=("Fee",))
ENROLLMENTS = ListSpec("b_enrollments", (
    STUDENT_OF,
    Lookup(COURSE_OF_CLASS, "ClassID", "ClassID", {"ClassName": "ClassName", "CourseName": "CourseName"},
           required=True),
    _staff("staff"), PAID),
    money=("TotalFee", "Discount", "FinalFee", "paid"), computed=("CAST(FinalFee - paid AS DOUBLE) AS remaining",))
DEBTS = ListSpec("b_enrollments", (
    STUDENT_OF, Lookup("b_classes", "ClassID", "ClassID", {"ClassName": "ClassName"}, required=True), PAID),
    money=("FinalFee", "paid"), computed=("CAST(FinalFee - paid AS DOUBLE) AS remaining",))
PAYMENTS = ListSpec("b_payments", (
    STUDENT_OF,
    Lookup(COURSE_OF_ENROLLMENT, "EnrollmentID", "EnrollmentID",
           {"ClassName": "ClassName", "CourseName": "CourseName"}, required=True),
    _staff("staff", "CreatedBy")), money=("Amount",))
CONSULTATIONS = ListSpec("b_consultations", (
    Lookup("b_students", "StudentID", "StudentID", {"student": "FullName", "Phone": "Phone"}, required=True),
    _staff("staff", required=True)))
FEEDBACKS = ListSpec("b_feedbacks", (
    STUDENT_OF, Lookup("b_classes", "ClassID", "ClassID", {"ClassName": "ClassName"}), _staff("staff")))
WORKLOAD = ListSpec("b_staff", (
    Lookup(distinct_children("b_students", "AssignedTo", "StudentID"), "StaffID", "AssignedTo",
           {"students": "n"}, default="0"),
    Lookup(distinct_children("b_enrollments", "StaffID", "EnrollmentID"), "StaffID", "StaffID",
           {"enrollments": "n"}, default="0")))
