"""Training-centre reports: students, classes, courses, enrollments with
balances, payments, consultations, feedbacks and staff workload.

Table provider ``t`` needs ``staff``, ``students``, ``courses``, ``classes``,
``enrollments``, ``payments``, ``consultations``, ``feedbacks`` DataFrames.
Balances (paid / remaining) always aggregate payments per enrollment before
joining, so an enrollment with many payments never multiplies other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.functions.predicates import (facet, in_months, month_to_date, none_of, one_of, search,
                                          where)
from crmlake.functions.scalars import (debt_flag, fmt_date, fmt_money, is_full, money,
                                       occupancy_pct, placeholder)
from crmlake.operators.aggregates import (Child, attach_children, combine_rows,
                                          distinct_count, null_safe_sum, with_balance)
from crmlake.operators.joins import lookup
from crmlake.operators.paging import DEFAULT_PER_PAGE, page_meta, top_n

# Fixed status groups used by the reference's edu pages.
CLASS_OPEN = ["Ongoing", "Upcoming"]
ENROLLMENT_ACTIVE = ["Studying", "Confirmed"]
FEEDBACK_OPEN = ["Open", "Processing"]
STUDENT_GONE = ["Dropped"]

STUDENT_ORDER = (("CreatedAt", "desc"), "StudentID")
ENROLLMENT_ORDER = (("CreatedAt", "desc"), "EnrollmentID")
PAYMENT_ORDER = (("PaymentDate", "desc"), "PaymentID", "Amount", "CreatedAt", "EnrollmentID",
                 "CreatedBy", "Method")
CONSULT_ORDER = (("ConsultedAt", "desc"), "ConsultID")
FEEDBACK_ORDER = (("CreatedAt", "desc"), "FeedbackID")
CLASS_ORDER = ("ClassID",)
COURSE_ORDER = ("Category", "CourseName", "CourseID")


def _count():
    return F.count(F.lit(1))


def _with_course(df: DataFrame, t, columns: dict[str, str], how: str = "inner") -> DataFrame:
    """Classes carry CourseID; attach course columns through it."""
    return lookup(df, t.courses, "CourseID", "CourseID", columns, how)


def _class_and_course(df: DataFrame, t, class_cols: dict[str, str], course_cols: dict[str, str],
                      how: str = "inner") -> DataFrame:
    out = lookup(df, t.classes, "ClassID", "ClassID", {**class_cols, "CourseID": "__course"}, how)
    out = lookup(out, t.courses, "__course", "CourseID", course_cols, how)
    return out.drop("__course")


# ---- lists ------------------------------------------------------------------------
def _student_rows(t, q: str = "", status: str = "", source: str = "", mode: str = "binary") -> DataFrame:
    """Q16 without the enrollment count (filters and order use student columns)."""
    preds = [search(["FullName", "Email", "Phone"], q, mode), facet("Status", status, mode),
             facet("Source", source, mode)]
    s = where(t.students, *preds)
    return lookup(s, t.staff, "AssignedTo", "StaffID", {"FullName": "staff_name"}, "left")


def _with_enroll_count(t, rows: DataFrame, prefilter: bool) -> DataFrame:
    return attach_children(rows, "StudentID", [
        Child(t.enrollments, "StudentID", {"enroll_count": distinct_count("EnrollmentID")})],
        prefilter=prefilter)


def student_list(t, q: str = "", status: str = "", source: str = "", mode: str = "binary") -> DataFrame:
    """Q16: students with assigned staff and distinct enrollment count."""
    filtered = bool((q or "").strip() or status or source)
    return _with_enroll_count(t, _student_rows(t, q, status, source, mode), prefilter=filtered)


def class_list(t, q: str = "", status: str = "", mode: str = "binary") -> DataFrame:
    """Q23: classes with course name, category, fee and teacher. A blank
    search is no filter (the reference's blank-search branch errors)."""
    c = where(t.classes, facet("Status", status, mode))
    c = _with_course(c, t, {"CourseName": "CourseName", "Category": "Category", "Fee": "Fee"})
    c = lookup(c, t.staff, "TeacherID", "StaffID", {"FullName": "teacher"}, "left")
    return where(c, search(["ClassName", "CourseName"], q, mode))


def course_list(t, q: str = "", category: str = "", mode: str = "binary") -> DataFrame:
    """Q24: courses; the search always applies (``LIKE '%%'`` when blank)."""
    return where(t.courses, search(["CourseName", "Description"], q, mode, skip_blank=False),
                 facet("Category", category, mode))


def _enrollment_rows(t, q: str = "", status: str = "", mode: str = "binary") -> DataFrame:
    """Q25 without paid/remaining (filters and order do not use them)."""
    e = where(t.enrollments, facet("Status", status, mode))
    e = lookup(e, t.students, "StudentID", "StudentID", {"FullName": "student"}, "inner")
    e = _class_and_course(e, t, {"ClassName": "ClassName"}, {"CourseName": "CourseName"})
    e = lookup(e, t.staff, "StaffID", "StaffID", {"FullName": "staff"}, "left")
    return where(e, search(["student", "ClassName"], q, mode, skip_blank=False))


def enrollment_list(t, q: str = "", status: str = "", mode: str = "binary") -> DataFrame:
    """Q25: enrollments with student, class, course, staff, paid and remaining."""
    return with_balance(_enrollment_rows(t, q, status, mode), "EnrollmentID", "FinalFee",
                        t.payments, "EnrollmentID", "Amount")


def payment_ledger(t, q: str = "", mode: str = "binary") -> DataFrame:
    """Q27: payments with student, class, course and the recording staff."""
    p = lookup(t.payments, t.students, "StudentID", "StudentID", {"FullName": "student"}, "inner")
    p = lookup(p, t.enrollments, "EnrollmentID", "EnrollmentID", {"ClassID": "ClassID"}, "inner")
    p = _class_and_course(p, t, {"ClassName": "ClassName"}, {"CourseName": "CourseName"})
    p = lookup(p, t.staff, "CreatedBy", "StaffID", {"FullName": "staff"}, "left")
    return where(p, search(["student", "ClassName"], q, mode, skip_blank=False)).drop("ClassID")


def consultation_list(t, q: str = "", ctype: str = "", mode: str = "binary") -> DataFrame:
    """Q30: consultations with student name and phone and staff name."""
    c = where(t.consultations, facet("Type", ctype, mode))
    c = lookup(c, t.students, "StudentID", "StudentID", {"FullName": "student", "Phone": "Phone"}, "inner")
    c = lookup(c, t.staff, "StaffID", "StaffID", {"FullName": "staff"}, "inner")
    return where(c, search(["student", "Subject"], q, mode, skip_blank=False))


def feedback_list(t, q: str = "", status: str = "", mode: str = "binary") -> DataFrame:
    """Q31: feedbacks with student, class (optional) and staff (optional)."""
    f = where(t.feedbacks, facet("Status", status, mode))
    f = lookup(f, t.students, "StudentID", "StudentID", {"FullName": "student"}, "inner")
    f = lookup(f, t.classes, "ClassID", "ClassID", {"ClassName": "ClassName"}, "left")
    f = lookup(f, t.staff, "StaffID", "StaffID", {"FullName": "staff"}, "left")
    return where(f, search(["student", "Subject"], q, mode, skip_blank=False))


# list -> (rows before late columns, order, page size, late columns for a page)
LISTS = {
    "students": (_student_rows, STUDENT_ORDER, DEFAULT_PER_PAGE,
                 lambda t, page: _with_enroll_count(t, page, prefilter=True)),
    "classes": (class_list, CLASS_ORDER, DEFAULT_PER_PAGE, None),
    "courses": (course_list, COURSE_ORDER, DEFAULT_PER_PAGE, None),
    "enrollments": (_enrollment_rows, ENROLLMENT_ORDER, DEFAULT_PER_PAGE,
                    lambda t, page: with_balance(page, "EnrollmentID", "FinalFee", t.payments,
                                                 "EnrollmentID", "Amount", prefilter=True)),
    "payments": (payment_ledger, PAYMENT_ORDER, DEFAULT_PER_PAGE, None),
    "consultations": (consultation_list, CONSULT_ORDER, DEFAULT_PER_PAGE, None),
    "feedbacks": (feedback_list, FEEDBACK_ORDER, DEFAULT_PER_PAGE, None),
}


def list_page(t, which: str, page: int = 1, **params) -> DataFrame:
    """O8 over one of the edu lists (late columns for the page only)."""
    from crmlake.plans.crm import paged
    return paged(LISTS, t, which, page, **params)


def list_page_meta(t, which: str, page: int = 1, **params) -> DataFrame:
    fn, _, per_page, _ = LISTS[which]
    return page_meta(fn(t, **params), page, per_page)


# ---- 360, dashboard, balances -------------------------------------------------------------
def student_360(t) -> DataFrame:
    """Q17 (batch form): every student with assigned staff, tab counts and
    fee balance (fees of its enrollments minus its payments)."""
    s = lookup(t.students, t.staff, "AssignedTo", "StaffID", {"FullName": "staff_name"}, "left")
    out = attach_children(s, "StudentID", [
        Child(t.enrollments, "StudentID", {"enroll_count": _count(),
                                           "total_fee": null_safe_sum("FinalFee")}),
        Child(t.payments, "StudentID", {"payment_count": _count(), "paid": null_safe_sum("Amount")}),
        Child(t.consultations, "StudentID", {"consult_count": _count()}),
        Child(t.feedbacks, "StudentID", {"feedback_count": _count()}),
    ])
    return out.withColumn("remaining", F.col("total_fee") - F.col("paid"))


def active_staff(t) -> DataFrame:
    """Q6 (training centre): active staff for pick lists, by name."""
    return (t.staff.filter(F.col("Status") == "Active")
            .select("StaffID", "FullName").orderBy("FullName", "StaffID"))


def student_detail(t, student_id=None) -> dict[str, DataFrame]:
    """Q17 (one student, or all when no id is given): profile, enrollments with balance, consultations,
    feedbacks and payments (payments get ClassName through their enrollment,
    which the reference's query omits)."""
    def of(df):
        return df if student_id is None else df.filter(F.col("StudentID") == F.lit(student_id))
    profile = lookup(of(t.students), t.staff, "AssignedTo", "StaffID",
                     {"FullName": "staff_name"}, "left")
    enrolls = _class_and_course(of(t.enrollments), t, {"ClassName": "ClassName"},
                                {"CourseName": "CourseName"})
    enrolls = with_balance(enrolls, "EnrollmentID", "FinalFee", of(t.payments),
                           "EnrollmentID", "Amount")
    consults = lookup(of(t.consultations), t.staff, "StaffID", "StaffID", {"FullName": "staff"}, "inner")
    pays = lookup(of(t.payments), t.staff, "CreatedBy", "StaffID", {"FullName": "staff"}, "left")
    pays = lookup(pays, t.enrollments, "EnrollmentID", "EnrollmentID", {"ClassID": "__class"}, "left")
    pays = lookup(pays, t.classes, "__class", "ClassID", {"ClassName": "ClassName"}, "left").drop("__class")
    from crmlake.operators.paging import order_spec
    return {"student": profile,
            "enrollments": enrolls.orderBy(*order_spec(*ENROLLMENT_ORDER)),
            "consultations": consults.orderBy(*order_spec(*CONSULT_ORDER)),
            "feedbacks": of(t.feedbacks).orderBy(*order_spec(*FEEDBACK_ORDER)),
            "payments": pays.orderBy(*order_spec(*PAYMENT_ORDER))}


def outstanding_fees(t) -> DataFrame:
    """Q19: ``SUM(FinalFee - IFNULL(paid, 0))`` over active enrollments."""
    e = t.enrollments.filter(one_of("Status", ENROLLMENT_ACTIVE))
    b = with_balance(e, "EnrollmentID", "FinalFee", t.payments, "EnrollmentID", "Amount")
    return b.agg(money(null_safe_sum("remaining")).alias("v"))


def edu_kpis(t, as_of) -> DataFrame:
    """Q18: students, active enrollments, open classes, month-to-date revenue,
    pending fees and open feedbacks in one row."""
    return combine_rows(
        t.students.agg(F.count_if(none_of("Status", STUDENT_GONE)).alias("students")),
        t.enrollments.agg(F.count_if(one_of("Status", ENROLLMENT_ACTIVE)).alias("enrollments")),
        t.classes.agg(F.count_if(one_of("Status", CLASS_OPEN)).alias("classes")),
        where(t.payments, month_to_date("PaymentDate", as_of), in_months(t.payments, "PaymentDate", as_of))
        .agg(money(null_safe_sum("Amount")).alias("revenue")),
        outstanding_fees(t).select(F.col("v").alias("pending_fee")),
        t.feedbacks.agg(F.count_if(one_of("Status", FEEDBACK_OPEN)).alias("open_feedback")),
    )


def newest_students(t, n: int = 5) -> DataFrame:
    """Q20: the ``n`` newest students with staff name."""
    s = lookup(t.students, t.staff, "AssignedTo", "StaffID", {"FullName": "staff_name"}, "left")
    return top_n(s, [("CreatedAt", "desc"), ("StudentID", "desc")], n)


def next_open_classes(t, n: int = 6) -> DataFrame:
    """Q21: the first ``n`` open classes by start date (undated first)."""
    c = t.classes.filter(one_of("Status", CLASS_OPEN))
    c = _with_course(c, t, {"CourseName": "CourseName", "Category": "Category"})
    c = lookup(c, t.staff, "TeacherID", "StaffID", {"FullName": "teacher"}, "left")
    return top_n(c, ["StartDate", "ClassID"], n)


def latest_consultations(t, n: int = 5) -> DataFrame:
    """Q22: the ``n`` latest consultations with student and staff names."""
    c = lookup(t.consultations, t.students, "StudentID", "StudentID", {"FullName": "student"}, "inner")
    c = lookup(c, t.staff, "StaffID", "StaffID", {"FullName": "staff"}, "inner")
    return top_n(c, CONSULT_ORDER, n)


def open_classes_with_seats(t) -> DataFrame:
    """Q26: open classes with course, fee and free seats (no floor at 0)."""
    c = t.classes.filter(one_of("Status", CLASS_OPEN))
    c = _with_course(c, t, {"CourseName": "CourseName", "Fee": "Fee"})
    return (c.withColumn("seats", F.col("MaxStudents") - F.col("CurrentStudents"))
            .orderBy("StartDate", "ClassID")
            .select("ClassID", "ClassName", "CourseName", "Fee", "seats"))


def total_collected(t) -> DataFrame:
    """Q28: all payments."""
    return t.payments.agg(money(null_safe_sum("Amount")).alias("v"))


def debtors(t) -> DataFrame:
    """Q29: payable enrollments (Confirmed/Studying) with remaining > 0."""
    e = t.enrollments.filter(one_of("Status", ["Confirmed", "Studying"]))
    e = lookup(e, t.students, "StudentID", "StudentID", {"FullName": "student"}, "inner")
    e = lookup(e, t.classes, "ClassID", "ClassID", {"ClassName": "ClassName"}, "inner")
    b = with_balance(e, "EnrollmentID", "FinalFee", t.payments, "EnrollmentID", "Amount")
    return (b.filter(F.col("remaining") > 0)
            .select("EnrollmentID", "student", "ClassName", "FinalFee", "paid", "remaining", "StudentID")
            .orderBy("student", "EnrollmentID"))


def staff_workload(t) -> DataFrame:
    """Q32: staff with distinct assigned students and distinct enrollments."""
    s = t.staff.select("StaffID", "FullName", "Email", "Phone", "Department", "Role", "Status")
    return attach_children(s, "StaffID", [
        Child(t.students, "AssignedTo", {"students": distinct_count("StudentID")}),
        Child(t.enrollments, "StaffID", {"enrollments": distinct_count("EnrollmentID")}),
    ]).orderBy("FullName", "StaffID")


def class_occupancy(t) -> DataFrame:
    """Occupancy percent (list page caps at 100, home page does not)
    and the full flag."""
    c = t.classes
    return c.select("ClassID", "ClassName", "CurrentStudents", "MaxStudents",
                    occupancy_pct("CurrentStudents", "MaxStudents", cap=True).alias("pct"),
                    occupancy_pct("CurrentStudents", "MaxStudents", cap=False).alias("pct_home"),
                    is_full("CurrentStudents", "MaxStudents").alias("is_full"))


def enrollment_statement(t) -> DataFrame:
    """Q45: display rows of the enrollment list: money with thousands
    separators and the currency mark, debt flag, date, staff placeholder."""
    e = lookup(t.enrollments, t.staff, "StaffID", "StaffID", {"FullName": "staff"}, "left")
    b = with_balance(e, "EnrollmentID", "FinalFee", t.payments, "EnrollmentID", "Amount")
    return b.select("EnrollmentID",
                    fmt_money("FinalFee").alias("fee_text"),
                    fmt_money("paid").alias("paid_text"),
                    fmt_money("remaining").alias("remaining_text"),
                    debt_flag("remaining").alias("in_debt"),
                    placeholder(fmt_date("EnrollDate")).alias("enroll_date_text"),
                    placeholder("staff").alias("staff_text"))


def pick_lists(t, teaching_department: str = "Teaching") -> DataFrame:
    """Q15 (edu): active courses with fee, active teachers, non-dropped
    students, all students, all classes with course name."""
    def shape(df, name, id_col, label_col, extra):
        return df.select(F.lit(name).alias("list"), F.col(id_col).cast("long").alias("id"),
                         F.col(label_col).alias("label"), extra.cast("string").alias("extra"))
    courses = shape(t.courses.filter(F.col("Status") == "Active"), "courses", "CourseID",
                    "CourseName", F.col("Fee"))
    teachers = shape(t.staff.filter((F.col("Department") == teaching_department)
                                    & (F.col("Status") == "Active")), "teachers", "StaffID",
                     "FullName", F.col("Department"))
    active = shape(t.students.filter(none_of("Status", STUDENT_GONE)), "students_active",
                   "StudentID", "FullName", F.col("Phone"))
    students = shape(t.students, "students", "StudentID", "FullName", F.col("Phone"))
    classes = shape(_with_course(t.classes, t, {"CourseName": "CourseName"}), "classes",
                    "ClassID", "ClassName", F.col("CourseName"))
    return (courses.unionByName(teachers).unionByName(active).unionByName(students)
            .unionByName(classes))
