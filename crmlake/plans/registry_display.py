"""Registered display-row queries (X10-X16) and the case-insensitive search
mode, with oracle SQL."""

from __future__ import annotations

from crmlake.plans import crm, display
from crmlake.plans import params as P
from crmlake.plans.catalog import register

_PREVIEW = ("CASE WHEN length({c}) > 80 THEN substr({c}, 1, 80) || '…' "
            "ELSE IFNULL({c}, '') END")


@register("x10_recent_interactions_display", ["b_interactions", "b_customers", "b_employees"], """
SELECT i.InteractionID, i.Subject, c.FullName AS customer, e.FullName AS employee,
       strftime(i.InteractedAt, '%d/%m/%Y %H:%M') AS at_text
FROM b_interactions i JOIN b_customers c ON i.CustomerID = c.CustomerID
JOIN b_employees e ON i.EmployeeID = e.EmployeeID
ORDER BY i.InteractedAt DESC, i.InteractionID LIMIT 5""")
def x10a(t):
    """X10 dashboard feed times as dd/mm/yyyy hh:mm."""
    return display.recent_interactions_display(t)


@register("x10_activity_rows", ["b_activity"], """
SELECT LogID, Username, Action, Module, strftime(CreatedAt, '%d/%m/%Y %H:%M:%S') AS at_text
FROM b_activity""")
def x10b(t):
    """X10 activity-log times with seconds."""
    return display.activity_rows(t)


@register("x15_ticket_rows", ["b_tickets", "b_employees"], """
SELECT t.TicketID,
       CASE t.Status WHEN 'Open' THEN 'danger' WHEN 'In Progress' THEN 'warning'
                     WHEN 'Resolved' THEN 'success' WHEN 'Closed' THEN 'secondary'
                     ELSE 'secondary' END AS status_class,
       CASE t.Priority WHEN 'Low' THEN 'secondary' WHEN 'Medium' THEN 'info' WHEN 'High' THEN 'warning'
                       WHEN 'Critical' THEN 'danger' ELSE 'secondary' END AS priority_class,
       strftime(t.CreatedAt, '%d/%m/%Y') AS created_text,
       IFNULL(NULLIF(e.FullName, ''), '—') AS employee_text
FROM b_tickets t LEFT JOIN b_employees e ON t.EmployeeID = e.EmployeeID""")
def x15a(t):
    """X15 ticket badge classes with fallback, X10 date, X13 dash."""
    return display.ticket_rows(t)


@register("x15_account_rows", ["b_users"], """
SELECT UserID, Username,
       CASE Role WHEN 'admin' THEN 'Admin' WHEN 'employee' THEN 'Nhân viên' WHEN 'guest' THEN 'Khách'
                 ELSE Role END AS role_label,
       CASE Role WHEN 'admin' THEN 'danger' WHEN 'employee' THEN 'primary' WHEN 'guest' THEN 'secondary'
                 ELSE 'secondary' END AS role_class
FROM b_users""")
def x15b(t):
    """X15 role labels and classes."""
    return display.account_rows(t)


@register("x12_product_rows", ["b_products"], f"""
SELECT ProductID, ProductName, format('{{:,.0f}}', CAST(IFNULL(Price, 0) AS DOUBLE)) || ' ₫' AS price_text,
       {_PREVIEW.format(c="Description")} AS description_preview
FROM b_products""")
def x12a(t):
    """X11 price text and X12 description preview of the catalogue."""
    return display.product_rows(t)


@register("x12_course_rows", ["b_courses"], f"""
SELECT CourseID, CourseName, format('{{:,.0f}}', CAST(IFNULL(Fee, 0) AS DOUBLE)) || ' ₫' AS fee_text,
       {_PREVIEW.format(c="Description")} AS description_preview
FROM b_courses""")
def x12b(t):
    """X11 fee text and X12 description preview of the courses."""
    return display.course_rows(t)


@register("x12_feedback_rows", ["b_feedbacks", "b_classes"], f"""
SELECT f.FeedbackID, {_PREVIEW.format(c="f.Subject")} AS subject_preview,
       length(f.Subject) AS subject_chars, IFNULL(NULLIF(cl.ClassName, ''), '—') AS class_text
FROM b_feedbacks f LEFT JOIN b_classes cl ON f.ClassID = cl.ClassID""")
def x12c(t):
    """X12 preview of whole feedback texts, their length, X13 class or dash."""
    return display.feedback_rows(t)


@register("x16_student_cards", ["b_students", "b_staff"], """
SELECT s.StudentID, substr(s.FullName, 1, 1) AS initial, s.FullName,
       IFNULL(NULLIF(st.FullName, ''), '—') AS staff_text
FROM b_students s LEFT JOIN b_staff st ON s.AssignedTo = st.StaffID""")
def x16(t):
    """X16 avatar initial and X13 staff placeholder."""
    return display.student_cards(t)


@register("q09_interaction_list_search_ci", ["b_interactions", "b_customers", "b_employees"], f"""
SELECT i.*, c.FullName AS customer, c.Company, e.FullName AS employee
FROM b_interactions i
JOIN b_customers c ON i.CustomerID = c.CustomerID
JOIN b_employees e ON i.EmployeeID = e.EmployeeID
WHERE i.Subject ILIKE '%{P.SEARCH_COMPANY.lower()}%' OR c.FullName ILIKE '%{P.SEARCH_COMPANY.lower()}%'
   OR c.Company ILIKE '%{P.SEARCH_COMPANY.lower()}%'""")
def q09ci(t):
    """Q9 interaction list searched case-insensitively (F2 'ci' mode)."""
    return crm.interaction_list(t, q=P.SEARCH_COMPANY.lower(), mode="ci")
