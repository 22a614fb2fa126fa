"""Expected answers on the reference's seed rows (FIXTURES.md §3)."""

from row_tools import rows

from crmlake.plans import crm, edu, maintenance
from crmlake.sources import schemas as S
from crmlake.operators import mutations as M

M_ = 1_000_000


def test_q01_crm_kpis(seed):
    r = crm.crm_kpis(seed).first()
    assert (r.customers, r.employees, r.open_opps, r.won_value, r.open_tickets, r.interactions) == \
        (8, 5, 6, 15 * M_, 2, 8)


def test_q42_report_kpis(seed):
    r = crm.report_kpis(seed).first()
    assert r.total_customers == 8 and r.total_revenue == 15 * M_
    assert r.win_rate == 50.0 and r.avg_deal_value == 15 * M_
    assert r.open_tickets == 2 and r.total_interactions == 8


def test_q33_stage_report_in_stage_order(seed):
    got = rows(crm.stage_report(seed), "Stage", "count", "total_value", "avg_prob")
    assert got == [("Lead", 1, 5 * M_, 20.0), ("Qualified", 2, 20 * M_, 45.0),
                   ("Proposal", 2, 53 * M_, 57.5), ("Negotiation", 1, 40 * M_, 75.0),
                   ("Closed Won", 1, 15 * M_, 100.0), ("Closed Lost", 1, 40 * M_, 0.0)]


def test_q02_deals_by_stage(seed):
    got = rows(crm.deals_by_stage(seed), "Stage", "count")
    assert [g[0] for g in got] == S.STAGES and sum(g[1] for g in got) == 8


def test_q05_customer_child_counts(seed):
    got = sorted(rows(crm.customer_list(seed), "CustomerID", "opp_count", "ticket_count"))
    assert got == [(1, 1, 1), (2, 1, 0), (3, 1, 1), (4, 1, 0), (5, 1, 0), (6, 1, 2), (7, 1, 1), (8, 1, 0)]


def test_q35_exact_and_reference_fanout(seed):
    exact = {r[0]: r[1:] for r in rows(crm.employee_performance(seed, "exact"), "EmployeeID", "customers",
                                        "total_opps", "won", "revenue", "interactions")}
    assert exact == {1: (3, 3, 1, 15 * M_, 4), 2: (4, 4, 0, 0, 3), 3: (0, 0, 0, 0, 0),
                     4: (1, 1, 0, 0, 1), 5: (0, 0, 0, 0, 0)}
    ref = {r[0]: r[1:] for r in rows(crm.employee_performance(seed, "reference"), "EmployeeID", "won", "revenue")}
    assert ref[1] == (12, 180 * M_)
    perf = {r[0]: r[1:] for r in rows(crm.employee_performance(seed, "exact"), "EmployeeID", "win_rate", "tier")}
    assert perf[1] == (33, "warning") and perf[3] == (None, None) and perf[2] == (0, "danger")


def test_q36_q37_segments_sources(seed):
    assert dict(rows(crm.customers_by_segment(seed))) == {"SMB": 3, "Enterprise": 3, "Startup": 2}
    assert dict(rows(crm.customers_by_source(seed))) == {"Website": 2, "Referral": 2, "Event": 2, "Social": 2}


def test_q38_to_q41_ticket_and_interaction_counts(seed):
    assert sorted(rows(crm.ticket_matrix(seed))) == sorted([
        ("Open", "Medium", 1), ("In Progress", "High", 1), ("Resolved", "High", 1),
        ("Resolved", "Low", 1), ("Closed", "Medium", 1)])
    assert rows(crm.tickets_by_status(seed)) == [("Open", 1), ("In Progress", 1), ("Resolved", 2), ("Closed", 1)]
    assert rows(crm.tickets_by_priority(seed)) == [("High", 2), ("Medium", 2), ("Low", 1)]
    assert dict(rows(crm.interactions_by_type(seed))) == {"Call": 2, "Meeting": 2, "Email": 2, "Chat": 1, "Demo": 1}


def test_q34_monthly_won_revenue(seed):
    assert rows(crm.monthly_won_revenue(seed, "2025-12-01 00:00:00")) == [("06/2025", 1, 15 * M_)]
    assert rows(crm.monthly_won_revenue(seed, "2026-07-01 00:00:00")) == []


def test_q19_q28_q18_money(seed):
    assert crm_value(edu.outstanding_fees(seed)) == 3_500_000
    assert crm_value(edu.total_collected(seed)) == 20_900_000
    assert edu.edu_kpis(seed, "2025-06-20 00:00:00").first().revenue == 11_825_000


def crm_value(df):
    return df.first()[0]


def test_q25_paid_and_remaining(seed):
    got = {r[0]: (r[1], r[2]) for r in rows(edu.enrollment_list(seed), "EnrollmentID", "paid", "remaining")}
    assert {k: (float(a), float(b)) for k, (a, b) in got.items()} == {
        1: (3.5e6, 0), 2: (3.15e6, 0), 3: (2.5e6, 2.5e6), 4: (4.0e6, 0), 5: (0, 3.5e6),
        6: (4.5e6, 0), 7: (1.0e6, 1.0e6), 8: (2.25e6, 0)}


def test_q29_debtors(seed):
    assert sorted(r[0] for r in rows(edu.debtors(seed), "EnrollmentID")) == [3, 7]


def test_q32_staff_workload(seed):
    got = {r[0]: (r[1], r[2]) for r in rows(edu.staff_workload(seed), "StaffID", "students", "enrollments")}
    assert got == {1: (4, 5), 2: (4, 2), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (2, 1)}


def test_q16_student_enrollment_counts(seed):
    got = dict(rows(edu.student_list(seed), "StudentID", "enroll_count"))
    assert got == {1: 2, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 7: 1, 8: 0, 9: 1, 10: 0}


def test_q44_occupancy(seed):
    got = {r[0]: r[1:] for r in rows(edu.class_occupancy(seed), "ClassID", "pct", "pct_home", "is_full")}
    assert got[1] == (75, 75, False) and got[8] == (0, 0, False) and got[7] == (90, 90, False)


def test_s4_derive_accounts(seed):
    new = maintenance.employee_accounts(seed, "2025-06-01 00:00:00")
    got = rows(new, "UserID", "Username", "Role", "EmployeeID")
    assert sorted(g[1] for g in got) == ["an_nguyen", "binh_tran", "cuong_le", "duc_pham", "em_hoang"]
    assert sorted(g[0] for g in got) == [3, 4, 5, 6, 7]
    assert {g[2] for g in got} == {"employee"}


def test_s11_enrollment_request_effects(seed, spark):
    req = spark.createDataFrame([(1, 4, 2, 1, 3500000, 350000)],
                                "seq long, StudentID long, ClassID long, StaffID long, TotalFee long, Discount long")
    out = M.apply_enrollments(req, seed.classes, seed.students, S.ENROLLMENTS, "2025-06-20 00:00:00", ["seq"], 8)
    new = out["enrollments"].filter("EnrollmentID = 9").first()
    assert float(new.FinalFee) == 3_150_000 and new.Status == "Confirmed"
    assert out["classes"].filter("ClassID = 2").first().CurrentStudents == 9
    assert out["students"].filter("StudentID = 4").first().Status == "Enrolled"


def test_q07_customer_detail_point_lookup(seed):
    d = crm.customer_detail(seed, 6)
    assert d["customer"].count() == 1
    assert rows(d["opportunities"], "OpportunityID", "ProductName", "emp") == [(6, "CRM Professional", "Nguyễn Văn An")]
    assert d["tickets"].count() == 2 and d["interactions"].count() == 1


def test_q17_student_detail_point_lookup(seed):
    d = edu.student_detail(seed, 1)
    got = sorted(rows(d["enrollments"], "EnrollmentID", "ClassName", "paid", "remaining"))
    assert [(g[0], g[1], float(g[2]), float(g[3])) for g in got] == [
        (1, "Python K01 - Tối T2T4T6", 3.5e6, 0.0), (8, "Thuyết trình K03", 2.25e6, 0.0)]
    # payments carry the class name through their enrollment
    assert sorted(rows(d["payments"], "PaymentID", "ClassName")) == [(1, "Python K01 - Tối T2T4T6"),
                                                                    (8, "Thuyết trình K03")]
    assert d["consultations"].count() == 1 and d["feedbacks"].count() == 1


def test_s7_resolve_feedback_with_response(seed, spark):
    ch = spark.createDataFrame([(5, "Resolved", "Đã xử lý")], "FeedbackID long, Status string, Response string")
    out = M.stamp_on_transition(seed.feedbacks, ch, "FeedbackID", "Status", "ResolvedAt", ["Resolved"],
                                "2025-06-20 00:00:00", extra=["Response"])
    r = out.filter("FeedbackID = 5").first()
    assert (r.Status, r.Response, str(r.ResolvedAt)) == ("Resolved", "Đã xử lý", "2025-06-20 00:00:00")
    assert out.filter("FeedbackID = 1").first().Response is None
