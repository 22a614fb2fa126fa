"""The reference's seed rows, typed in by hand (only the columns the
reports read), as a table provider with the same attributes as
``Bindings``. Missing contract columns are typed NULLs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import DataFrame, SparkSession

from crmlake.sources import schemas as S


def _ts(s):
    return dt.datetime.fromisoformat(s) if s else None


def _d(s):
    return dt.date.fromisoformat(s) if s else None


EMPLOYEES = ("EmployeeID long, FullName string, Email string, Department string, Status string", [
    (1, "Nguyễn Văn An", "an.nguyen@crm.vn", "Sales", "Active"),
    (2, "Trần Thị Bình", "binh.tran@crm.vn", "Sales", "Active"),
    (3, "Lê Hoàng Cường", "cuong.le@crm.vn", "Support", "Active"),
    (4, "Phạm Minh Đức", "duc.pham@crm.vn", "Marketing", "Active"),
    (5, "Hoàng Thị Em", "em.hoang@crm.vn", "Support", "Active"),
])
CUSTOMERS = ("CustomerID long, FullName string, Email string, Company string, Segment string, "
             "Source string, AssignedTo long, CreatedAt timestamp_ntz", [
    (1, "Nguyễn Quốc Hùng", "hung@techvn.com", "TechVN JSC", "SMB", "Website", 1, _ts("2025-01-01 00:00:01")),
    (2, "Lê Thị Mai", "mai@retail360.vn", "Retail 360", "SMB", "Referral", 1, _ts("2025-01-01 00:00:02")),
    (3, "Trần Văn Sơn", "son@bigcorp.vn", "BigCorp Vietnam", "Enterprise", "Event", 2, _ts("2025-01-01 00:00:03")),
    (4, "Phạm Thanh Hà", "ha@startup.io", "StartupIO", "Startup", "Social", 2, _ts("2025-01-01 00:00:04")),
    (5, "Đỗ Minh Tuấn", "tuan@manufact.vn", "Manufact VN", "Enterprise", "Website", 2, _ts("2025-01-01 00:00:05")),
    (6, "Vũ Thị Lan", "lan@smeshop.vn", "SME Shop", "SMB", "Referral", 1, _ts("2025-01-01 00:00:06")),
    (7, "Bùi Đức Thắng", "thang@fintech.vn", "FinTech Solutions", "Startup", "Social", 4, _ts("2025-01-01 00:00:07")),
    (8, "Ngô Thanh Xuân", "xuan@distributor.vn", "VN Distributor Co.", "Enterprise", "Event", 2, _ts("2025-01-01 00:00:08")),
])
PRODUCTS = ("ProductID long, ProductName string, Category string, Price decimal(15,2), Status string", [
    (1, "CRM Starter", "CRM", D("5000000"), "Active"),
    (2, "CRM Professional", "CRM", D("15000000"), "Active"),
    (3, "CRM Enterprise", "CRM", D("40000000"), "Active"),
    (4, "Analytics Add-on", "Analytics", D("8000000"), "Active"),
    (5, "Integration Pack", "Integration", D("6000000"), "Active"),
])
OPPORTUNITIES = ("OpportunityID long, CustomerID long, EmployeeID long, ProductID long, Stage string, "
                 "Value decimal(15,2), Probability int, ClosedAt timestamp_ntz", [
    (1, 1, 1, 1, "Proposal", D("5000000"), 60, None),
    (2, 2, 1, 1, "Qualified", D("5000000"), 40, None),
    (3, 3, 2, 3, "Negotiation", D("40000000"), 75, None),
    (4, 4, 2, 1, "Lead", D("5000000"), 20, None),
    (5, 5, 2, 3, "Proposal", D("48000000"), 55, None),
    (6, 6, 1, 2, "Closed Won", D("15000000"), 100, _ts("2025-06-01 10:00:00")),
    (7, 7, 4, 2, "Qualified", D("15000000"), 50, None),
    (8, 8, 2, 3, "Closed Lost", D("40000000"), 0, _ts("2025-05-30 15:00:00")),
])
INTERACTIONS = ("InteractionID long, CustomerID long, EmployeeID long, Type string, InteractedAt timestamp_ntz", [
    (1, 1, 1, "Call", _ts("2025-05-10 09:30:00")),
    (2, 1, 1, "Meeting", _ts("2025-05-20 14:00:00")),
    (3, 3, 2, "Email", _ts("2025-05-15 08:00:00")),
    (4, 3, 2, "Meeting", _ts("2025-06-01 10:00:00")),
    (5, 6, 1, "Call", _ts("2025-05-28 11:00:00")),
    (6, 4, 2, "Chat", _ts("2025-06-03 16:30:00")),
    (7, 7, 4, "Demo", _ts("2025-06-05 09:00:00")),
    (8, 2, 1, "Email", _ts("2025-06-07 08:30:00")),
])
TICKETS = ("TicketID long, CustomerID long, EmployeeID long, Subject string, Priority string, "
           "Status string, ResolvedAt timestamp_ntz", [
    (1, 6, 3, "Không đăng nhập được vào hệ thống", "High", "Resolved", _ts("2025-06-02 10:00:00")),
    (2, 6, 3, "Yêu cầu xuất báo cáo tùy chỉnh", "Medium", "Closed", _ts("2025-06-05 14:00:00")),
    (3, 1, 3, "Câu hỏi về tích hợp email marketing", "Low", "Resolved", _ts("2025-06-08 09:00:00")),
    (4, 3, 5, "Yêu cầu đào tạo nhân viên", "Medium", "Open", None),
    (5, 7, 5, "Audit log không hiển thị đủ", "High", "In Progress", None),
])
USERS = ("UserID long, Username string, Password string, Role string, FullName string, Status string", [
    (1, "admin", "admin123", "admin", "Quản trị viên", "Active"),
    (2, "guest", "guest123", "guest", "Khách", "Active"),
])

STAFF = ("StaffID long, FullName string, Email string, Department string, Status string", [
    (1, "Nguyễn Thị Lan", "lan.nguyen@edu.vn", "Sales", "Active"),
    (2, "Trần Văn Minh", "minh.tran@edu.vn", "Sales", "Active"),
    (3, "Lê Hoàng Phúc", "phuc.le@edu.vn", "Teaching", "Active"),
    (4, "Phạm Thị Hoa", "hoa.pham@edu.vn", "Teaching", "Active"),
    (5, "Đỗ Minh Quân", "quan.do@edu.vn", "Admin", "Active"),
    (6, "Vũ Thị Thu", "thu.vu@edu.vn", "Support", "Active"),
])
COURSES = ("CourseID long, CourseName string, Category string, Fee decimal(12,2), Status string", [
    (1, "Lập trình Python cơ bản", "Lập trình", D("3500000"), "Active"),
    (2, "Lập trình Web với Flask", "Lập trình", D("5000000"), "Active"),
    (3, "Data Science với Python", "Lập trình", D("7000000"), "Active"),
    (4, "Tiếng Anh giao tiếp A1-A2", "Ngoại ngữ", D("4000000"), "Active"),
    (5, "IELTS Foundation", "Ngoại ngữ", D("8500000"), "Active"),
    (6, "Kỹ năng thuyết trình", "Kỹ năng", D("2500000"), "Active"),
    (7, "Microsoft Office nâng cao", "Tin học", D("2000000"), "Active"),
    (8, "Thiết kế đồ họa với Photoshop", "Thiết kế", D("4500000"), "Active"),
])
CLASSES = ("ClassID long, CourseID long, ClassName string, TeacherID long, StartDate date, "
           "MaxStudents int, CurrentStudents int, Status string", [
    (1, 1, "Python K01 - Tối T2T4T6", 3, _d("2025-06-02"), 20, 15, "Ongoing"),
    (2, 1, "Python K02 - Sáng T7CN", 3, _d("2025-07-05"), 20, 8, "Upcoming"),
    (3, 2, "Flask Web K01 - Tối T3T5", 4, _d("2025-06-10"), 15, 10, "Ongoing"),
    (4, 4, "Anh văn A1 - Sáng T2T4T6", 4, _d("2025-06-02"), 25, 20, "Ongoing"),
    (5, 5, "IELTS K05 - Tối T2T4", 3, _d("2025-07-01"), 15, 5, "Upcoming"),
    (6, 6, "Thuyết trình K03", 4, _d("2025-06-15"), 30, 22, "Ongoing"),
    (7, 7, "Office K08 - Chiều T7", 3, _d("2025-06-07"), 20, 18, "Ongoing"),
    (8, 3, "Data Science K01", 4, _d("2025-08-01"), 12, 0, "Upcoming"),
])
STUDENTS = ("StudentID long, FullName string, Email string, Source string, AssignedTo long, Status string", [
    (1, "Nguyễn Quang Huy", "huy.nq@gmail.com", "Facebook", 1, "Studying"),
    (2, "Trần Thị Bảo Châu", "chau.ttb@gmail.com", "Website", 1, "Studying"),
    (3, "Lê Văn Đức", "duc.lv@gmail.com", "Referral", 2, "Enrolled"),
    (4, "Phạm Ngọc Hà", "ha.pn@gmail.com", "Zalo", 2, "Prospect"),
    (5, "Hoàng Minh Tuấn", "tuan.hm@gmail.com", "Walk-in", 1, "Studying"),
    (6, "Vũ Thị Lan Anh", "lanh.vt@gmail.com", "Facebook", 6, "Graduated"),
    (7, "Đỗ Quốc Bảo", "bao.dq@gmail.com", "Website", 2, "Studying"),
    (8, "Bùi Thị Mai", "mai.bt@gmail.com", "Referral", 1, "Prospect"),
    (9, "Ngô Văn Thắng", "thang.nv@gmail.com", "Zalo", 6, "Enrolled"),
    (10, "Cao Thị Hồng", "hong.ct@gmail.com", "Facebook", 2, "Dropped"),
])
ENROLLMENTS = ("EnrollmentID long, StudentID long, ClassID long, StaffID long, EnrollDate date, "
               "Status string, TotalFee decimal(12,2), Discount decimal(12,2), FinalFee decimal(12,2)", [
    (1, 1, 1, 1, _d("2025-05-28"), "Studying", D("3500000"), D("0"), D("3500000")),
    (2, 2, 1, 1, _d("2025-05-30"), "Studying", D("3500000"), D("350000"), D("3150000")),
    (3, 3, 3, 2, _d("2025-06-08"), "Confirmed", D("5000000"), D("0"), D("5000000")),
    (4, 5, 4, 1, _d("2025-05-25"), "Studying", D("4000000"), D("0"), D("4000000")),
    (5, 6, 1, 1, _d("2025-01-10"), "Completed", D("3500000"), D("0"), D("3500000")),
    (6, 7, 3, 2, _d("2025-06-09"), "Studying", D("5000000"), D("500000"), D("4500000")),
    (7, 9, 7, 6, _d("2025-06-05"), "Studying", D("2000000"), D("0"), D("2000000")),
    (8, 1, 6, 1, _d("2025-06-10"), "Studying", D("2500000"), D("250000"), D("2250000")),
])
PAYMENTS = ("PaymentID long, EnrollmentID long, StudentID long, Amount decimal(12,2), PaymentDate date, "
            "Method string, CreatedBy long", [
    (1, 1, 1, D("3500000"), _d("2025-05-28"), "Chuyển khoản", 1),
    (2, 2, 2, D("1575000"), _d("2025-05-30"), "Tiền mặt", 1),
    (3, 2, 2, D("1575000"), _d("2025-06-15"), "Chuyển khoản", 1),
    (4, 3, 3, D("2500000"), _d("2025-06-08"), "Tiền mặt", 2),
    (5, 4, 5, D("4000000"), _d("2025-05-25"), "Chuyển khoản", 1),
    (6, 6, 7, D("4500000"), _d("2025-06-09"), "Thẻ", 2),
    (7, 7, 9, D("1000000"), _d("2025-06-05"), "Tiền mặt", 6),
    (8, 8, 1, D("2250000"), _d("2025-06-10"), "Chuyển khoản", 1),
])
CONSULTATIONS = ("ConsultID long, StudentID long, StaffID long, Type string, Result string", [
    (1, 1, 1, "Zalo", "Đã đăng ký"), (2, 2, 1, "Gặp mặt", "Đã đăng ký"),
    (3, 4, 2, "Gọi điện", "Cần suy nghĩ"), (4, 4, 2, "Zalo", "Quan tâm"),
    (5, 8, 1, "Gọi điện", "Cần suy nghĩ"), (6, 10, 2, "Gặp mặt", "Không quan tâm"),
    (7, 3, 2, "Email", "Đã đăng ký"), (8, 9, 6, "Zalo", "Đã đăng ký"),
])
FEEDBACKS = ("FeedbackID long, StudentID long, StaffID long, ClassID long, Type string, Subject string, "
             "Status string", [
    (1, 1, 3, 1, "Feedback", "Giảng viên giảng rất dễ hiểu", "Closed"),
    (2, 5, 4, 4, "Complaint", "Máy lạnh phòng 201 bị hỏng", "Resolved"),
    (3, 2, 1, 1, "Request", "Xin tài liệu học thêm", "Resolved"),
    (4, 7, 2, 3, "Feedback", "Lớp Flask rất thực tế", "Closed"),
    (5, 9, 6, 7, "Complaint", "Lịch học bị thay đổi không báo trước", "Processing"),
])

_TABLES = {
    "employees": (EMPLOYEES, S.EMPLOYEES), "customers": (CUSTOMERS, S.CUSTOMERS),
    "products": (PRODUCTS, S.PRODUCTS), "opportunities": (OPPORTUNITIES, S.OPPORTUNITIES),
    "interactions": (INTERACTIONS, S.INTERACTIONS), "tickets": (TICKETS, S.SUPPORT_TICKETS),
    "users": (USERS, S.USERS), "staff": (STAFF, S.STAFF), "courses": (COURSES, S.COURSES),
    "classes": (CLASSES, S.CLASSES), "students": (STUDENTS, S.STUDENTS),
    "enrollments": (ENROLLMENTS, S.ENROLLMENTS), "payments": (PAYMENTS, S.PAYMENTS),
    "consultations": (CONSULTATIONS, S.CONSULTATIONS), "feedbacks": (FEEDBACKS, S.FEEDBACKS),
}


class SeedTables:
    """Table provider over the seed rows (same attribute names as Bindings)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._cache: dict[str, DataFrame] = {}

    def after(self, name: str, key: str) -> int:
        return getattr(self, name).agg({key: "max"}).first()[0] or 0

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name == "activity":
            return self.spark.createDataFrame([], S.ACTIVITY_LOG.schema)
        if name not in self._cache:
            (ddl, rows), contract = _TABLES[name]
            self._cache[name] = S.conform(self.spark.createDataFrame(rows, ddl), contract)
        return self._cache[name]
