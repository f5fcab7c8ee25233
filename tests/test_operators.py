"""Operator tests on small inline inputs (rows of FIXTURES.md)."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions import messages as M
from scrivener.functions import scoring as S
from scrivener.functions.text import decode_text, file_ext
from scrivener.operators import base as B
from scrivener.operators import events as E
from scrivener.operators import ingest as IN
from scrivener.operators import marts as MT
from scrivener.operators import metrics as H
from scrivener.operators import notify as N
from scrivener.operators import similarity as SIM
from scrivener.operators import tables as TB
from scrivener.operators import windows as W


def test_severity_boundaries(spark):
    rows = [(0.39, 0.69), (0.4, 0.7), (0.49, 0.0), (0.5, 0.0), (0.69, 0.0), (0.7, 0.0), (None, None)]
    df = spark.createDataFrame(rows, "internal_score double, ai_generated_probability double")
    got = [tuple(r) for r in S.with_check_flags(df).select(
        "severity", "requires_review", "ai_generated_likely").collect()]
    assert got == [("low", False, False), ("medium", False, True), ("medium", False, False),
                   ("medium", True, False), ("medium", True, False), ("high", True, False),
                   (None, False, False)]


def test_check_record_shape(spark):
    df = spark.createDataFrame([("sub1", 0.8, 0.2, 0.9, ["stub-flag"])],
                               "submission_id string, internal_score double, external_score double, "
                               "ai_generated_probability double, flagged_sections array<string>")
    r = S.check_record(df).collect()[0]
    assert r.severity == "high" and r.requires_review and r.ai_generated_likely
    assert r.flagged_sections == ["stub-flag"]
    for s in (r.internal_score, r.external_score, r.ai_generated_probability):
        assert 0.0 <= s <= 1.0


def test_percent_matches_python(spark):
    vals = [0.0625, 0.3815, 0.125, 0.7000000000000001, 0.0, 1.0, 0.00125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.p for r in df.select(M.percent("x").alias("p")).collect()]
    assert got == [f"{v:.1%}" for v in vals]


def test_check_messages(spark):
    df = spark.createDataFrame(
        [("s1", 0.8, "high", True), ("s2", 0.55, "medium", True), ("s3", 0.1, "low", False),
         ("s4", None, None, None)],
        "submission_id string, internal_score double, severity string, requires_review boolean")
    got = [r.m for r in df.select(M.check_message("submission_id", "internal_score", "severity",
                                                  "requires_review").alias("m")).collect()]
    assert got == [
        "⚠️ HIGH RISK: Plagiarism check for submission s1 detected 80.0% similarity. Manual review required.",
        "⚠️ REVIEW NEEDED: Plagiarism check for submission s2 detected 55.0% similarity.",
        "✓ Plagiarism check completed for submission s3: 10.0% similarity (low risk)",
        "✓ Plagiarism check completed for submission s4: 0.0% similarity (unknown risk)",
    ]


def test_upload_message_defaults_length(spark):
    df = spark.createDataFrame([("sub1", 11), ("sub2", None)], "id string, text_length int")
    got = [r.m for r in df.select(M.upload_message("id", "text_length").alias("m")).collect()]
    assert got[1] == ("✓ Your paper (submission sub2, 0 characters) has been successfully uploaded "
                      "and is queued for plagiarism checking")
    assert "submission sub1, 11 characters" in got[0]


def _window_events(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [
        (base + dt.timedelta(seconds=1), "paper_uploaded", None, None, None, None),
        (base + dt.timedelta(minutes=1), "plagiarism_checked", 0.8, 0.2, 0.9, "high"),
        (base + dt.timedelta(minutes=2), "plagiarism_checked", None, None, None, "low"),
        (base + dt.timedelta(minutes=4, seconds=59, microseconds=999000), "unknown", None, None, None, None),
        (base + dt.timedelta(minutes=5), "unknown", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, internal_score double, "
                                       "external_score double, ai_generated_probability double, severity string")


def test_window_metrics_fixture(spark):
    out = W.window_analytics(_window_events(spark)).orderBy("window_start").collect()
    assert len(out) == 2                       # the 00:10 window is not emitted
    a, b = out
    assert (a.submission_count, a.total_checks, a.high_risk_count) == (1, 2, 1)
    assert abs(a.avg_internal_score - 0.4) < 1e-12     # NULL score counts as 0.0
    assert abs(a.avg_ai_probability - 0.45) < 1e-12
    assert b.window_start == dt.datetime(2024, 1, 1, 0, 5)
    assert (b.submission_count, b.total_checks, b.avg_internal_score) == (0, 0, 0.0)


def test_window_partition_invariance(spark):
    """Partial + final aggregation gives the same result for any split."""
    from scrivener.plans import views as V
    ev = V.event_stream(spark, "/root/testdata/sf0.001")
    one = W.window_analytics(ev.coalesce(1)).orderBy("window_start").collect()
    many = W.window_analytics(ev.repartition(8)).orderBy("window_start").collect()
    assert len(one) == len(many)
    for x, y in zip(one, many):
        assert x.window_start == y.window_start and x.submission_count == y.submission_count
        assert abs(x.avg_internal_score - y.avg_internal_score) < 1e-9


def test_legacy_window(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=i), "paper_uploaded", None) for i in range(12)]
    rows += [(base, "plagiarism_checked", 0.33)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, internal_score double")
    r = W.legacy_window(df).collect()[0]
    assert r.submission_rate == 12 / 60.0 and r.spike_detected
    assert abs(r.avg_ai_probability - 0.33 * 0.8) < 1e-12


def test_latest_and_history(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, i * 5), i) for i in range(12)],
                               "window_start timestamp_ntz, submission_count int")
    assert W.latest_window(df).collect()[0].submission_count == 11
    assert [r.submission_count for r in W.window_history(df, last=3).collect()] == [9, 10, 11]
    assert W.latest_window(df.where("false")).count() == 0          # the 404 case


def test_decode_splits_malformed(spark):
    df = spark.createDataFrame([('{"id": "sub1", "user_id": "u1"}',), ('{not json',)], "value string")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("user_id", T.StringType())])
    good, bad = E.decode(df, schema)
    assert [r.id for r in good.collect()] == ["sub1"]
    assert bad.collect()[0].error == "malformed JSON"


def test_encode_keeps_nulls(spark):
    df = spark.createDataFrame([("s1", None)], "id string, text string")
    assert json.loads(E.encode(df).collect()[0].value) == {"id": "s1", "text": None}


def test_dispatch_drops_unhandled(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("zzz", 3)], "topic string, x int")
    out = E.dispatch(df, {"a": lambda d: d.withColumn("h", F.lit("A")),
                          "b": lambda d: d.withColumn("h", F.lit("B"))})
    assert sorted((r.topic, r.h) for r in out.collect()) == [("a", "A"), ("b", "B")]


def test_enrich_keeps_null_text(spark):
    df = spark.createDataFrame([("s1", "hello world"), ("s2", None)], "id string, text string")
    out = {r.id: r for r in E.enrich_submission(df).collect()}
    assert out["s1"].text_length == 11 and out["s2"].text_length is None
    assert out["s1"].event_type == "paper_uploaded"
    assert out["s1"].processing_pipeline == "submission-service"


def test_valid_rejected_and_backfill(spark):
    users = spark.createDataFrame([("u1", "Alice", "alice@test.com", "student")],
                                  "id string, name string, email string, role string")
    subs = spark.createDataFrame([("sub1", "u1", "hello"), ("sub2", "nonexistent", "test")],
                                 "id string, user_id string, text string")
    assert [r.id for r in TB.valid_rows(subs, users).collect()] == ["sub1"]
    assert [r.id for r in TB.rejected_rows(subs, users).collect()] == ["sub2"]
    ev = spark.createDataFrame([("sub1", None), ("sub9", "")], "submission_id string, text string")
    got = {r.submission_id: (r.text, r.status) for r in TB.backfill_text(ev, subs).collect()}
    assert got == {"sub1": ("hello", "ok"), "sub9": (None, "rejected")}


def test_apply_changes_fixture(spark):
    """create u4 -> update u4; create u6 -> delete u6; update/delete of absent ids are no-ops."""
    base = spark.createDataFrame([("u1", "Alice", "alice@test.com", "student")],
                                 "id string, name string, email string, role string")
    ch = spark.createDataFrame([
        ("u4", "insert", "001", "Dave", "dave@test.com", "student"),
        ("u4", "update", "002", "David", "dave@test.com", "faculty"),
        ("u6", "insert", "003", "Eve", "eve@test.com", "student"),
        ("u6", "delete", "004", None, None, None),
        ("u9", "update", "005", "Ghost", "g@test.com", "student"),
        ("u8", "delete", "006", None, None, None),
        ("u1", "insert", "007", "Dup", "dup@test.com", "student"),
    ], "id string, op string, seq string, name string, email string, role string")
    out = {r.id: (r.name, r.role) for r in TB.apply_changes(base, ch).collect()}
    assert out == {"u1": ("Alice", "student"), "u4": ("David", "faculty")}


def test_latest_per_key_and_dedupe(spark):
    df = spark.createDataFrame([("s1", 1, 0.1), ("s1", 3, 0.9), ("s1", 2, 0.5), ("s2", 1, 0.2)],
                               "submission_id string, seq int, internal_score double")
    latest = {r.submission_id: r.internal_score for r in
              B.latest_per_key(df, ["submission_id"], ["seq"]).collect()}
    first = {r.submission_id: r.internal_score for r in
             B.first_per_key(df, ["submission_id"], ["seq"]).collect()}
    assert latest == {"s1": 0.9, "s2": 0.2} and first == {"s1": 0.1, "s2": 0.2}


def test_rank_helpers_match_window(spark):
    from scrivener.plans import views as V
    s = V.submissions(spark, "/root/testdata/sf0.001")
    got = TB.by_user_newest_first(s).select("id", "position")
    from pyspark.sql import Window
    ref = s.select("id", F.row_number().over(
        Window.partitionBy("user_id").orderBy(F.desc("uploaded_at"), F.desc("id"))).alias("position"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_previous_value_matches_lag(spark):
    from pyspark.sql import Window
    from scrivener.plans import views as V
    c = V.counter_samples(spark, "/root/testdata/sf0.001")
    got = B.previous_value(c, ["job"], ["ts", "event_id"], "value", F.date_trunc("day", "ts"))
    ref = c.withColumn("prev", F.lag("value").over(Window.partitionBy("job").orderBy("ts", "event_id")))
    cols = ["job", "event_id", "prev"]
    assert got.select(cols).exceptAll(ref.select(cols)).count() == 0


def test_notifications_newest_first(spark):
    t = dt.datetime(2024, 1, 1)
    n = spark.createDataFrame([
        ("1", "user_123", "Message 1", t), ("2", "user_123", "Message 2", t + dt.timedelta(seconds=1)),
        ("3", "user_456", "Message 3", t)], "id string, user_id string, message string, created_at timestamp")
    top = N.newest_per_user(n, 5).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.message) for r in top] == [
        ("user_123", "Message 2"), ("user_123", "Message 1"), ("user_456", "Message 3")]


def test_user_fallback(spark):
    users = spark.createDataFrame([("u1", "Alice", "alice@test.com", "student")],
                                  "id string, name string, email string, role string")
    req = spark.createDataFrame([("u1", "student"), ("u7", "faculty")], "user_id string, role string")
    out = {r.id: (r.name, r.email, r.role) for r in MT.user_fallback(req, users).collect()}
    assert out["u7"] == ("Demo Faculty", "u7@example.com", "faculty")
    assert out["u1"] == ("Alice", "alice@test.com", "student")


def test_faculty_summary_flagged(spark):
    recent = spark.range(10)
    lw = spark.createDataFrame([(dt.datetime(2024, 1, 1), 0.6, 12)],
                               "window_start timestamp, avg_internal_score double, submission_count int")
    r = MT.faculty_summary(recent, lw).collect()[0]
    assert (r.total_submissions, r.flagged_count, r.spike_detected) == (10, 6, True)
    none = MT.faculty_summary(recent, lw.where("false")).collect()[0]
    assert (none.flagged_count, none.spike_detected) == (0, False)


def test_file_ingest(spark, tmp_dir):
    files = {"a.TXT": "hello".encode(), "b.py": b"\xff\xfe\xfa", "c.pdf": b"%PDF-1.4",
             "big.txt": b"x" * (10 * 1024 * 1024 + 1)}
    for name, data in files.items():
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(data)
    out = {os.path.basename(r.file_url): r for r in
           IN.files_to_submissions(IN.read_files(spark, tmp_dir)).collect()}
    assert out["a.TXT"].ext == ".txt" and out["a.TXT"].text == "hello"
    assert out["b.py"].text is None and out["c.pdf"].text is None
    assert out["big.txt"].status.startswith("rejected") and out["a.TXT"].status == "accepted"


def test_a_file_over_the_reader_limit_is_a_rejected_row(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "big.txt"), "wb") as f:
        f.write(b"x" * 2_000_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000000")
    try:
        r = IN.files_to_submissions(IN.read_files(spark, tmp_dir, limit=500_000), limit=500_000).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(x.n_bytes, x.text, x.status) for x in r] == [(2_000_000, None, "rejected: file too large")]


def test_file_ext_rules(spark):
    df = spark.createDataFrame([("/x/a.TXT",), ("b.tar.gz",), (".bashrc",), ("noext",)], "p string")
    assert [r.e for r in df.select(file_ext("p").alias("e")).collect()] == [".txt", ".gz", "", ""]
    bad = spark.createDataFrame([(b"\xff", ".txt"), (b"ok", ".pdf")], "c binary, e string")
    assert [r.t for r in bad.select(decode_text("c", "e").alias("t")).collect()] == [None, None]


def test_object_events(spark):
    ev = spark.createDataFrame([
        ('{"Records":[{"s3":{"bucket":{"name":"submission-bucket"},"object":{"key":"papers/1234.pdf"}}}]}',),
        ('{"Records":[]}',)], "value string")
    out = IN.object_events(ev).collect()
    assert (out[0].bucket, out[0].key, out[0].triggers) == ("submission-bucket", "papers/1234.pdf", True)
    assert out[1].error == "no records in event"


def test_page_sample(spark):
    pages = spark.createDataFrame([(1, i, "x" * 10) for i in range(12)] + [(2, 0, "abc")],
                                  "doc_id long, page_no long, text string")
    out = {r.doc_id: (r.page_count, r.sample_text_length) for r in IN.page_sample(pages).collect()}
    assert out == {1: (12, 30), 2: (1, 3)}


def test_similarity_small_corpus(spark):
    docs = spark.createDataFrame([
        (1, "the quick brown fox jumps over the lazy dog"),
        (2, "a quick brown fox jumps over the lazy cat"),
        (3, "completely different words here and there too"),
        (4, "short text"),
    ], "doc_id long, text string")
    inner = {r.doc_id: r.internal_score for r in SIM.internal_similarity(docs).collect()}
    # doc 1 shingles: 5, shared with doc 2: "quick brown fox jumps over", "brown fox jumps over the",
    # "fox jumps over the lazy"
    assert abs(inner[1] - 3 / 5) < 1e-12 and inner[3] == 0.0 and inner[4] == 0.0
    corpus = spark.createDataFrame([(0, "brown fox jumps over the lazy dog")], "item_id long, text string")
    ext = {r.doc_id: r.external_score for r in SIM.external_similarity(docs, corpus).collect()}
    assert abs(ext[1] - 3 / 5) < 1e-12 and ext[3] == 0.0
    flags = {r.doc_id: r.flagged_sections for r in SIM.flagged_sections(docs).collect()}
    assert flags[1] == ["brown fox jumps over the", "fox jumps over the lazy", "quick brown fox jumps over"]


def test_histogram_quantile(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "j", 0.05)] * 90 + [(t, "j", 0.3)] * 10
    df = spark.createDataFrame(rows, "ts timestamp_ntz, job string, latency_s double")
    q = H.histogram_quantile(df, ["job"]).collect()[0].quantile
    # rank 95 falls in (0.25, 0.5]: 0.25 + 0.25 * (95 - 90) / 10
    assert abs(q - 0.375) < 1e-12


def test_sustained_alert(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("j", t + dt.timedelta(hours=h), b) for h, b in
            [(0, True), (1, True), (2, True), (3, False), (4, True), (5, True)]]
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, breach boolean")
    fired = [r.ts.hour for r in H.sustained(df, ["job"], "ts", "breach", 3600, 7200).collect()]
    assert fired == [2]


def test_inhibit_null_safe(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([
        (t, "A", "critical", None, "i1", None), (t, "A", "warning", None, "i1", None),
        (t, "A", "warning", None, "i2", None)],
        "ts timestamp, alertname string, severity string, dev string, instance string, namespace string")
    rules = [{"source": {"severity": "critical"}, "target_re": {"severity": "warning"},
              "equal": ["alertname", "dev", "instance"]}]
    out = sorted((r.severity, r.instance) for r in H.inhibit(a, rules).collect())
    assert out == [("critical", "i1"), ("warning", "i2")]


def test_routes_first_match(spark):
    a = spark.createDataFrame([("critical", "loki"), ("info", "loki"), ("info", None)],
                              "severity string, component string")
    got = [r.r for r in a.select(H.route([({"severity": "critical"}, "critical"),
                                          ({"component": "loki"}, "platform")], "default").alias("r")).collect()]
    assert got == ["critical", "platform", "default"]


def test_consume_window_records_both_shapes(spark):
    recs = spark.createDataFrame([
        ('{"window_start": "2024-01-01T00:05:00", "submission_count": 3, "avg_internal_score": 0.5}',),
        ('{"window_start": 1704067500000, "window_end": 1704067800000, "event_count": 7, '
         '"generated_at": 1704067801000}',),
    ], "value string")
    out = W.consume_window_records(recs).collect()
    assert out[0].window_start == dt.datetime(2024, 1, 1, 0, 5) and out[0].submission_count == 3
    assert out[0].total_checks == 0 and out[0].avg_external_score == 0.0
    assert out[1].window_start == dt.datetime(2024, 1, 1, 0, 5)
    assert out[1].window_end == dt.datetime(2024, 1, 1, 0, 10)
    assert (out[1].submission_count, out[1].avg_internal_score) == (0, 0.0)


def test_sessionize_matches_session_window(spark):
    from scrivener.plans import views as V
    ev = V.event_stream(spark, "/root/testdata/sf0.001")
    a = W.session_analytics(ev, ("user_id",), gap_seconds=1800, tie="event_id")
    b = W.window_analytics(ev, kind="session", gap="30 minutes", keys=("user_id",))
    cols = ["user_id", "window_start", "window_end", "submission_count", "total_checks"]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_rate_handles_counter_reset(spark):
    t = dt.datetime(2024, 1, 1)
    vals = [0.0, 5.0, 10.0, 2.0, 4.0]           # reset after 10
    df = spark.createDataFrame([("j", t + dt.timedelta(seconds=10 * i), i, v) for i, v in enumerate(vals)],
                               "job string, ts timestamp_ntz, event_id long, value double")
    r = H.rate(df, ["job"], tie="event_id").collect()[0].rate
    assert abs(r - (5 + 5 + 2 + 2) / 300) < 1e-12


def test_error_rate_breach(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("j", t, 500)] * 20 + [("j", t, 200)] * 5
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, status int")
    r = H.error_rate(df, ["job"]).collect()[0]
    assert abs(r.error_rate - 20 / 300) < 1e-12 and r.breach


def test_ratio_and_reject_old(spark):
    t = dt.datetime(2024, 1, 10)
    use = spark.createDataFrame([("j", t, 95.0)], "job string, ts timestamp_ntz, usage double")
    lim = spark.createDataFrame([("j", t, 100.0)], "job string, ts timestamp_ntz, limit double")
    r = H.ratio(use, lim, ["job", "ts"], "usage", "limit", threshold=0.9).collect()[0]
    assert r.ratio == 0.95 and r.breach
    s = spark.createDataFrame([(t,), (t - dt.timedelta(hours=169),), (t - dt.timedelta(hours=1),)],
                              "ts timestamp_ntz")
    assert sorted(r.accepted for r in H.reject_old(s).collect()) == [False, True, True]


def test_series_counts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("j", "p1", t, 10.0), ("j", "p1", t + dt.timedelta(hours=1), 500.0),
            ("j", "p2", t, 600.0)]
    df = spark.createDataFrame(rows, "job string, pod string, ts timestamp_ntz, value double")
    r = H.series_counts(df, ["job", "pod"], ["job"], high=400.0).collect()[0]
    assert (r.n_series, r.n_high, r.n_current) == (2, 2, 1)


def test_group_alerts_sorted_text(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(t, "A", "b-desc"), (t, "A", "a-desc")],
                              "ts timestamp_ntz, alertname string, description string")
    r = H.group_alerts(a, ["ts", "alertname"]).collect()[0]
    assert (r.n_alerts, r.descriptions) == (2, "a-desc; b-desc")


def test_change_conflicts_numeric_sequence(spark):
    """9 comes before 10: the delete precedes the insert."""
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    ch = spark.createDataFrame([(1, "delete", 9, None), (1, "insert", 10, "b"), (1, "insert", 11, "c"),
                                (1, "update", 12, "d")], "id long, op string, seq long, name string")
    assert [(r.seq, r.conflict) for r in TB.change_conflicts(base, ch).collect()] == [(11, "insert of a live id")]
    assert [tuple(r) for r in TB.apply_changes(base, ch).collect()] == [(1, "d")]
    only = ch.where("seq <> 12 and op <> 'delete'")
    assert [tuple(r) for r in TB.apply_changes(base, only).collect()] == [(1, "a")]


def test_duplicate_keys_of_several_columns(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("x", None), (None, "x"), ("y", None), ("y", None)],
                               "a string, b string")
    got = TB.duplicate_keys(df, ["a", "b"], "t").collect()
    assert [(r.key, r.n) for r in got] == [('["y",null]', 2)]


def test_hash_ids_tell_nulls_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x")], "a string, b string")
    assert df.select(M.hash_id("a", "b").alias("h")).distinct().count() == 2


def test_faculty_list_looks_at_all_students(spark):
    users = spark.createDataFrame([(i, "student" if i > 11 else "faculty") for i in range(20)], "id long, role string")
    subs = spark.createDataFrame([(i, i % 20, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(200)],
                                 "id long, user_id long, uploaded_at timestamp_ntz")
    assert MT.student_submissions(users, subs).count() == 80
    assert [r.id for r in MT.faculty_recent(users, subs).collect()] == [199, 198, 197, 196, 195, 194, 193, 192, 179, 178]


def test_running_count_matches_window(spark):
    from pyspark.sql import Window
    t = dt.datetime(2024, 1, 1)
    rows = [("u", t + dt.timedelta(hours=7 * i), i, i % 3 == 0) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long, f boolean")
    got = B.running_count(df, ["k"], ["ts", "i"], "f", F.date_trunc("day", "ts"))
    ref = df.withColumn("running", F.sum(F.col("f").cast("int")).over(
        Window.partitionBy("k").orderBy("ts", "i").rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["i", "running"]
    assert got.select(cols).exceptAll(ref.select(cols)).count() == 0


def test_change_conflicts_fixture(spark):
    base = spark.createDataFrame([("u1", "Alice", "alice@test.com", "student")],
                                 "id string, name string, email string, role string")
    ch = spark.createDataFrame([
        ("u4", "insert", "20240101001"), ("u4", "update", "20240101002"),
        ("u6", "insert", "20240102003"), ("u6", "delete", "20240102004"),
        ("u9", "update", "20240103005"), ("u8", "delete", "20240103006"),
        ("u1", "insert", "20240104007"), ("u6", "update", "20240105008"),
    ], "id string, op string, seq string")
    got = sorted((r.id, r.conflict) for r in TB.change_conflicts(base, ch).collect())
    assert got == [("u1", "insert of a live id"), ("u6", "update of an absent id"),
                   ("u8", "delete of an absent id"), ("u9", "update of an absent id")]


def test_quantile_exact_against_sorted_values(spark):
    import math
    from scrivener.plans import views as V
    r = V.requests(spark, "/root/testdata/sf0.01")
    got = {x.job: (x.quantile, x.n) for x in H.quantile_exact(r, ["job"], window="3650 days").collect()}
    pdf = r.select("job", "latency_s").toPandas()
    for job, (q, n) in got.items():
        vals = sorted(pdf[pdf.job == job].latency_s)
        assert n == len(vals) and q == vals[math.ceil(0.95 * n) - 1]


def test_restart_rules_at_the_boundaries(spark):
    t = dt.datetime(2024, 1, 1)
    # a change every 5 minutes: three within 15 minutes from the fourth sample on
    rows = [("a", t + dt.timedelta(minutes=5 * i), float(i)) for i in range(8)]
    rows += [("b", t + dt.timedelta(minutes=20 * i), float(i)) for i in range(4)]
    rows += [("c", t, 0.0), ("c", t + dt.timedelta(minutes=1), 36_000.0)]
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, value double")
    got = {(r.job, (r.ts - t).total_seconds() / 60): r for r in H.restart_rules(df, ["job"]).collect()}
    assert [got["a", 5 * i].changes for i in range(1, 6)] == [0, 1, 2, 2, 2]
    assert not any(r.changes_alert for r in got.values())        # never more than two: the earlier sample counts too
    assert got["b", 25].changes == 0                              # its earlier sample is out of range
    assert got["c", 5].restart_rate == 10.0 and not got["c", 10].restart_alert and got["c", 15].restart_alert
    assert got["c", 60].restart_alert and ("c", 65) not in got


def test_changes_alert_needs_its_time(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(minutes=i), float(i % 2)) for i in range(5)]
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, value double")
    got = {(r.ts - t).total_seconds() / 60: (r.changes, r.changes_alert) for r in H.restart_rules(df, ["job"]).collect()}
    assert got[5] == (4, False) and got[10] == (4, True) and got[15] == (4, True) and got[20] == (0, False)


def test_bucket_quantile(spark):
    rows = [("a", "0.1", 0.0), ("a", "0.5", 2.0), ("a", "1", 3.0), ("a", "+Inf", 4.0), ("b", "0.5", 1.0),
            ("c", "1", 0.0), ("c", "+Inf", 2.0), ("d", "1", 2.0), ("d", "+Inf", 2.0)]
    got = {r.job: r.quantile for r in H.bucket_quantile(
        spark.createDataFrame(rows, "job string, le string, rate double"), ["job"], q=0.5).collect()}
    assert got == {"a": 0.5, "b": None, "c": 1.0, "d": 0.5}


def test_id_default_and_newest_first(spark):
    df = spark.createDataFrame([("", "u1", "a"), (None, "u1", "b"), ("s9", "u1", "c")],
                               "id string, user_id string, text string")
    ids = [r.i for r in df.select(M.id_or_new("id", "user_id", "text").alias("i")).collect()]
    assert ids[2] == "s9" and len(ids[0]) == 64 and ids[0] != ids[1]
    again = [r.i for r in df.select(M.id_or_new("id", "user_id", "text").alias("i")).collect()]
    assert again == ids                                  # replay-stable
    t = dt.datetime(2024, 1, 1)
    subs = spark.createDataFrame([("s1", t), ("s2", t), ("s3", t + dt.timedelta(days=1))],
                                 "id string, uploaded_at timestamp_ntz")
    assert [r.id for r in TB.newest_first(subs).collect()] == ["s3", "s2", "s1"]


def test_user_and_submission_rules_and_defaults(spark):
    from scrivener import schemas
    u = spark.createDataFrame([("u1", "a", "e", "student"), ("", "b", "e", "dean"), (None, "c", "e", None)], schemas.USER)
    got = [r.v for r in u.select(E.violations(E.user_rules()).alias("v")).collect()]
    assert got == [[], ["id", "role"], ["id", "role"]]
    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("s1", "u1", "a", t, "f", "x"), (None, "u1", "a", None, "f", "x"),
                               ("", "u1", "a", None, "f", "x")], schemas.SUBMISSION)
    full = E.submission_defaults(s, F.lit(t)).collect()
    assert full[0].id == "s1" and full[1].id == full[2].id and len(full[1].id) == 64
    assert all(r.uploaded_at == full[0].uploaded_at for r in full)
    assert [r.v for r in s.select(E.violations(E.submission_rules()).alias("v")).collect()] == [[], ["id"], ["id"]]
