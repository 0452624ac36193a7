"""Intended vs as-written values of the reference's defects D6-D9, on one hand-made fixture."""
from pyspark.sql import functions as F

from riskloom.plans import specs
from riskloom.operators.rollup import rollup


def _previous(spark):
    # one applicant, four earlier applications (decision day, approved, prolongation)
    rows = [(1, 10, -700, 1, 5.0), (1, 11, -300, 1, 1.0), (1, 12, -200, 0, 3.0), (1, 13, -100, 1, None)]
    return spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, DAYS_DECISION int, is_approved int, prolongation double")


def _one(df, names):
    r = df.first()
    return {n: r[n] for n in names}


def test_d7_d8_d9_previous(spark):
    df = _previous(spark)
    pick = {"prev_last_application", "prev_recent_applications_cnt", "prev_prolong_max", "prev_recent_approved"}
    intended = [a for a in specs.PREVIOUS if a.name in pick]
    written = [a for a in specs.previous_as_written() if a.column in {"DAYS_DECISION", "prolongation", "is_approved"}
               and (a.name.endswith("_as_written") or a.name == "prev_recent_approved")]
    got = _one(rollup(df, "SK_ID_CURR", intended, order_by=["DAYS_DECISION"], tie_break=["SK_ID_PREV"]), pick)
    assert got == {"prev_last_application": -100, "prev_recent_applications_cnt": 3, "prev_prolong_max": 5.0,
                   "prev_recent_approved": 2}
    names = [a.name for a in written]
    got_w = _one(rollup(df, "SK_ID_CURR", written, order_by=["DAYS_DECISION"], tie_break=["SK_ID_PREV"]), names)
    assert got_w["prev_last_application_as_written"] == -700
    assert got_w["prev_recent_applications_cnt_as_written"] == 4
    assert got_w["prev_prolong_max_as_written"] == 3.0


def test_d6_installments_recent_vs_oldest(spark):
    from riskloom.plans import features as fe

    rows = [(1, float(d), d, 0, 0, float(d) + delay, 100.0, 100.0) for d, delay in [(-40, 9), (-30, 1), (-20, 2), (-10, 3)]]
    df = spark.createDataFrame(rows, "SK_ID_PREV long, DAYS_INSTALMENT double, NUM_INSTALMENT_NUMBER int, NUM_INSTALMENT_VERSION int, "
                                     "SK_ID_CURR int, "
                                     "DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double")
    recent = fe.installments_agg(df).first()
    oldest = fe.installments_agg(df, as_written=True).first()
    assert recent["delay_recent_max"] == 3.0 and recent["delay_recent_mean"] == 2.0
    assert oldest["delay_recent_max"] == 9.0 and oldest["delay_recent_mean"] == 4.0


def test_d2_was_disbursed_and_d1_flags(spark):
    from riskloom.plans import features as fe

    rows = [("Approved", -5.0), ("Refused", -5.0), ("Unused offer", None), ("Canceled", 365243.0)]
    df = spark.createDataFrame(
        [(i, 1, s, 1.0, 1.0, 1.0, d, 1.0, 1.0, 1.0, 1.0, 1, 1) for i, (s, d) in enumerate(rows)],
        "SK_ID_PREV long, SK_ID_CURR long, NAME_CONTRACT_STATUS string, AMT_ANNUITY double, AMT_APPLICATION double, "
        "AMT_CREDIT double, DAYS_FIRST_DRAWING double, DAYS_FIRST_DUE double, DAYS_LAST_DUE_1ST_VERSION double, "
        "DAYS_LAST_DUE double, DAYS_TERMINATION double, unpaid_inst_cnt long, inst_cnt long")
    out = fe.previous_derived(df).orderBy("SK_ID_PREV").select("is_approved", "is_refused", "was_disbursed").collect()
    assert [tuple(r) for r in out] == [(1, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, 0)]
