"""Oracle side of the integrity audit (S14), written by hand from the reference's DDL.

``CONSTRAINTS`` states, table by table, the constraints on the columns that the
bindings provide. It does not use ``sources.schemas``, so a wrong contract shows as a
difference between the audit and this SQL.
"""

from __future__ import annotations

# The declared constraints. A line per table: name, view, primary key; then
# UNIQUE columns, NOT NULL columns, VARCHAR lengths and foreign keys.
CONSTRAINTS = """
table Employees b_employees EmployeeID
unique Email
required EmployeeID FullName
length FullName 100 Email 100 Phone 20 Department 50 Role 50 Status 20

table Customers b_customers CustomerID
unique Email
required CustomerID FullName
length FullName 100 Email 100 Phone 20 Company 100 Segment 50 Source 50 Status 20
foreign AssignedTo Employees EmployeeID

table Products b_products ProductID
required ProductID ProductName
length ProductName 100 Category 50 Status 20

table Opportunities b_opportunities OpportunityID
required OpportunityID CustomerID EmployeeID
length Title 200 Stage 50
foreign CustomerID Customers CustomerID
foreign EmployeeID Employees EmployeeID
foreign ProductID Products ProductID

table Interactions b_interactions InteractionID
required InteractionID CustomerID EmployeeID
length Type 50 Subject 200
foreign CustomerID Customers CustomerID
foreign EmployeeID Employees EmployeeID

table SupportTickets b_tickets TicketID
required TicketID CustomerID Subject
length Subject 200 Priority 20 Status 30
foreign CustomerID Customers CustomerID
foreign EmployeeID Employees EmployeeID

table Users b_users UserID
unique Username
required UserID Username Password Role
length Username 50 Password 100 Role 20 FullName 100 Status 20
foreign EmployeeID Employees EmployeeID

table ActivityLog b_activity LogID
required LogID
length Username 50 FullName 100 Action 50 Module 50 IPAddress 45

table Staff b_staff StaffID
unique Email
required StaffID FullName
length FullName 100 Email 100 Phone 20 Department 50 Role 50 Status 20

table Courses b_courses CourseID
required CourseID CourseName
length CourseName 150 Category 50 Status 20

table Classes b_classes ClassID
required ClassID CourseID
length ClassName 100 Status 20
foreign CourseID Courses CourseID
foreign TeacherID Staff StaffID

table Students b_students StudentID
unique Email
required StudentID FullName
length FullName 100 Email 100 Phone 20 Source 50 Status 20
foreign AssignedTo Staff StaffID

table Enrollments b_enrollments EnrollmentID
required EnrollmentID StudentID ClassID
length Status 30
foreign StudentID Students StudentID
foreign ClassID Classes ClassID
foreign StaffID Staff StaffID

table Payments b_payments PaymentID
required PaymentID EnrollmentID StudentID Amount
length Method 30
foreign EnrollmentID Enrollments EnrollmentID
foreign StudentID Students StudentID
foreign CreatedBy Staff StaffID

table Consultations b_consultations ConsultID
required ConsultID StudentID StaffID
length Type 30 Subject 200 Result 50
foreign StudentID Students StudentID
foreign StaffID Staff StaffID

table Feedbacks b_feedbacks FeedbackID
required FeedbackID StudentID Subject
length Type 30 Subject 200 Status 30
foreign StudentID Students StudentID
foreign StaffID Staff StaffID
foreign ClassID Classes ClassID
"""


def _rules() -> list[tuple[str, str, str, str, str, object]]:
    """(table, view, primary key, check, column, argument)."""
    views = {w[1]: w[2] for w in map(str.split, CONSTRAINTS.splitlines()) if w[:1] == ["table"]}
    out, table, view, key = [], "", "", ""
    for words in filter(None, map(str.split, CONSTRAINTS.splitlines())):
        head, rest = words[0], words[1:]
        if head == "table":
            table, view, key = rest
            out.append((table, view, key, "primary_key", key, None))
        elif head == "unique":
            out += [(table, view, key, "unique", c, None) for c in rest]
        elif head == "required":
            out += [(table, view, key, "not_null", c, None) for c in rest]
        elif head == "length":
            out += [(table, view, key, "max_length", c, int(n)) for c, n in zip(rest[::2], rest[1::2], strict=True)]
        else:
            column, parent, parent_key = rest
            out.append((table, view, key, "foreign_key", column, (views[parent], parent_key)))
    return out


def violations_sql(text_key: str = "{}") -> str:
    """The offending values, one SELECT per constraint. ``text_key`` is what UNIQUE compares (the smallest
    spelling of equal ones is shown)."""
    out = []
    for table, view, key, check, column, arg in _rules():
        if check == "unique":
            out.append(f"SELECT '{table}' AS table_name, '{check}' AS check_name, '{column}' AS column_name, "
                       f"min({column}) AS value, count(*) AS rows FROM {view} v WHERE {column} IS NOT NULL "
                       f"GROUP BY {text_key.format(column)} HAVING count(*) > 1")
            continue
        if check == "primary_key":
            value, cond, more = column, f"{column} IS NOT NULL", "HAVING count(*) > 1"
        elif check == "foreign_key":
            value, more = column, ""
            cond = f"{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {arg[0]} p WHERE p.{arg[1]} = v.{column})"
        else:
            value, more = key, ""
            cond = f"{column} IS NULL" if check == "not_null" else f"length({column}) > {arg}"
        out.append(f"SELECT '{table}' AS table_name, '{check}' AS check_name, '{column}' AS column_name, "
                   f"CAST({value} AS VARCHAR) AS value, count(*) AS rows FROM {view} v WHERE {cond} GROUP BY {value} {more}")
    return "\nUNION ALL\n".join(out)


def audit_sql() -> str:
    """One row per constraint with its counts."""
    names = ", ".join(f"('{t}', '{check}', '{c}')" for t, _, _, check, c, _ in _rules())
    return f"""SELECT l.table_name, l.check_name, l.column_name, CAST(coalesce(sum(f.rows), 0) AS BIGINT) AS violations,
       CASE WHEN l.check_name IN ('not_null', 'max_length') THEN 0 ELSE count(f.value) END AS keys
FROM (VALUES {names}) l(table_name, check_name, column_name)
LEFT JOIN ({violations_sql()}) f USING (table_name, check_name, column_name)
GROUP BY l.table_name, l.check_name, l.column_name"""
