"""Small literal examples of the formulas."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import arrow, grades, stats, text
from quarrymill.operators import evaluation as ev
from quarrymill.operators import hygiene, labeling, relational, retrieval
from quarrymill.sources import readers, writers
from quarrymill.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson(spark):
    def w(s, n):
        return tuple(one(spark, *stats.wilson(F.lit(s), F.lit(n))))

    assert w(0, 0) == (0.0, 1.0)
    low, high = w(0, 100)
    assert low == 0.0 and high < 0.05
    a, b = w(1, 10), w(10, 100)
    assert a[1] - a[0] > b[1] - b[0]


def test_direction_and_tiers(spark):
    d = [one(spark, grades.direction(F.lit(a), F.lit(b)))[0] for a, b in ((3, 1), (1, 3), (2, 2), (9, 1))]
    assert d == ["underclass", "overclass", "confirm", "lateral"]
    assert one(spark, grades.is_human(F.lit(" LLM_judge_1")), grades.is_human(F.lit("kim")), grades.is_machine_strict(F.lit("gpt-4"))) == (False, True, True)


MASKS = [
    ("901231-1234567", "[RRN]", "rrn"), ("9012311234567", "[RRN]", "rrn"), ("901231 5234567", "[FRN]", "frn"), ("110111-9234567", "[CORPNO]", "corp_reg"), ("1234-5678-9012-3456", "[CARD]", "credit_card"), ("1234567890123456", "[CARD]", "credit_card"),
    ("a@b.co c@d.org", "[EMAIL] [EMAIL]", "email"), ("010-1234-5678", "[PHONE]", "phone_mobile"), ("01012345678", "[PHONE]", "phone_mobile"), ("02-123-4567", "[PHONE]", "phone_land"), ("M12345678", "[PASSPORT]", "passport_kr"), ("host 10.0.0.255 up", "host [IP] up", "ipv4"),
    ("사번: 123456", "[EMP]", "employee_id"), ("123-45-67890", "[BIZNO]", "business_no"), ("12345-67890", "[BIZNO]", "business_no"),
    # not these
    ("999.1.1.1", "999.1.1.1", None), ("20240115123456789", "20240115123456789", None), ("065-123-4567", "065-123-4567", None), ("K12345678", "K12345678", None), ("서버10.0.0.1에서", "서버[IP]에서", "ipv4"), ("계약010-1234-5678", "계약010-1234-5678", None),
]


def test_masks(spark):
    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(MASKS)] + [(900, None), (901, "")], "id int, t string")
    got = {r.id: r for r in text.mask_pii(df, "t").collect()}
    kinds = [*[k for k, *_ in text.PII], "business_no"]
    for k, (raw, masked, kind) in enumerate(MASKS):
        assert (raw, got[k].masked) == (raw, masked)
        assert {x: got[k][x] for x in kinds if got[k][x]} == ({kind: masked.count("[")} if kind else {})
    assert got[900].masked == got[901].masked == "" and not any(got[900][x] for x in kinds)


def test_mask_can_skip_a_kind_and_take_more(spark):
    r = text.mask_pii(spark.createDataFrame([("EMP12345 X-1",)], "t string"), "t", skip=("employee_id",), extra=(("own", r"X-\d", "[OWN]"),)).first()
    assert r.masked == "EMP12345 [OWN]" and r.own == 1 and "employee_id" not in r.asDict()


def test_business_number_check_digit(spark):
    def ok(n):
        d = [int(c) for c in n]
        return (10 - (sum(a * b for a, b in zip(d, (1, 3, 7, 1, 3, 7, 1, 3, 5), strict=False)) + d[8] * 5 // 10) % 10) % 10 == d[9]

    numbers = [f"12081{k:05d}" for k in range(40)]
    good = [n for n in numbers if ok(n)]
    df = spark.createDataFrame([(n, f"no {n}, {n} and 9{n}.") for n in numbers], "n string, t string")
    got = {r.n: r for r in text.mask_pii(df, "t").collect()}
    assert good and all(got[n].masked == (f"no [BIZNO], [BIZNO] and 9{n}." if n in good else f"no {n}, {n} and 9{n}.") for n in numbers)


def test_tiers_and_reviewers(spark):
    rows = [("human_review", "kim", "x"), ("human_review", "codex_1", "x"), ("human_review", "", "gold_candidate"), ("nkt_designated", "kim", None), ("rule_llm_agreement", None, None), ("llm_judge_a", "kim", "gold_candidate"), ("llm_judge_a", "kim", None), (None, None, None)]
    got = [r.t for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, s string, r string, v string").select("k", grades.tier("s", "r", "v").alias("t")).orderBy("k").collect()]
    assert got == ["locked_gold_eval", "silver_train", "gold_candidate", "legal_floor", "gold_candidate", "gold_candidate", "silver_train", "silver_train"]
    people = ["kim", "aiden", "Claude", "ai_1", "review_assist", "-", "human", "GPT-4", "models inc"]
    got = [(r.h, r.m) for r in spark.createDataFrame([(k, p) for k, p in enumerate(people)], "k int, p string").select("k", grades.is_human("p").alias("h"), grades.is_machine_strict("p").alias("m")).orderBy("k").collect()]
    assert got == [(True, False), (True, False), (True, True), (True, True), (True, True), (True, True), (True, True), (True, True), (False, False)]


def test_consensus(spark):
    def c(rule, judge, agreed=1.0, evidence=True, shadow=None, airgap=False, conf=0.0):
        return one(spark, labeling.consensus(F.lit(rule), F.lit(judge), F.lit(agreed), F.lit(evidence), F.lit(shadow).cast("string"), F.lit(airgap), F.lit(conf)).alias("c")).c

    assert c("S2", "S2").is_gold and c("S2", "S2").status == "gold_candidate" and c("S2", "S2", conf=0.4).priority == pytest.approx(0.6)
    assert c("S1", "S2", 0.1, False).status == "needs_review_ts_downgrade" and c("S3", "S3", shadow="TS").status == "needs_review_ts_downgrade"
    assert c("S2", "S2", evidence=False).status == "needs_review_no_evidence" and c("S3", "S2").status == "needs_review_disagree" and c("S2", "S2", 0.6).status == "needs_review_low_agreement"
    assert c("TS", "TS", airgap=True).status == "needs_review_airgap_upper" and c("S2", "S2", shadow="S3").status == "needs_review_production_suspect"
    assert c("TS", "S3", 0.5, False, "S2").flags == ["ts_downgrade_suspect", "production_suspect", "low_agreement", "no_evidence"]
    assert c("TS", "S1", 0.5, shadow="TS", conf=0.25).priority == pytest.approx(100 + 10 + 5 + 1 + 0.75)


def test_gates(spark):
    k = lambda *a, **b: one(spark, ev.kill_gate(*[F.lit(x) for x in a[:3]], a[3], **b).alias("g")).g
    assert k(0, 5, 0.1, 20).tripped is False and k(1, 30, 0.3, 20).reasons == ["high_grade_miss", "fatigue", "overturn_rate"]
    assert k(9, 999, 0.9, 0, least_misses=0, most_overturned=0.0).tripped is False
    g = lambda *a, **b: one(spark, ev.deploy_gate(*[F.lit(x).cast("double") for x in a], **b).alias("g")).g
    assert g(0.1, 0.6, 0.5, 0.1, 0.6).passed and g(0.13, 0.5, 0.995, 0.1, 0.6).failed == ["degenerate", "fnr_high_regression", "f1_regression"]
    assert g(None, 0.6, 0.5, None, None).failed == ["fnr_high_present"] and g(0.3, 0.6, None, None, None, first_high_fnr=0.2).failed == ["first_deploy_fnr_floor"]
    r = lambda *a: one(spark, ev.rollback_need(*[F.lit(x).cast("double") for x in a]).alias("g")).g.reason
    assert [r(None, 0.9, 99), r(0.1, 0.9, 19), r(0.1, 0.21, 20), r(0.1, 0.2, 20)] == ["no_baseline", "insufficient_live_data", "regressed", "within_tolerance"]


def test_bootstrap_interval(spark):
    df = spark.range(4000).select("id", (F.col("id") % 4 == 0).alias("hit"))
    r = ev.bootstrap_interval(df, F.col("hit")).first()
    assert r.n == 4000 and r.mean == 0.25 and 0.23 < r.low < 0.25 < r.high < 0.27 and r.high - r.low > 0.02
    assert tuple(r) == tuple(ev.bootstrap_interval(df.repartition(7), F.col("hit")).first())
    assert ev.bootstrap_interval(df.limit(0), F.col("hit")).first().n == 0


def test_required_tokens(spark):
    t = "머리말 12 ms\n응답 시간 350 ms 이고 '특정 표현'은 빼면 안 된다. 수율 97.5%"
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(6).alias("end")), F.struct(F.lit(10).alias("start"), F.lit(17).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(9999).alias("end")))
    assert one(spark, text.body_facts(F.lit(t)))[0] == ["응답 시간 350 ms", "수율 97.5%", "특정 표현"]
    k = one(spark, text.required_tokens(F.lit(t), spans, F.lit("TS-kw:핵심|x"), F.lit("반도체")))[0]
    assert [x.source for x in k] == ["evidence@0", "evidence@N", "body_fact", "body_fact"]
    k = one(spark, text.required_tokens(F.lit("nothing here"), F.lit(None).cast("array<struct<start:int,end:int>>"), F.lit(None).cast("string"), F.lit("반도체")))[0]
    assert [tuple(x) for x in k] == [("반도체", "domain")]


def test_normal_text():
    assert arrow.normal_text("- 3 -\nPage 2 of 9\nＡＢ<EOP>  c\t d\r\n\n\n\ne") == "AB c d\n\ne"
    assert arrow.normal_text("- 3 -\na", boilerplate=False) == "- 3 -\na"
    assert arrow.normal_text("수신자 참조 내용 끝", stop_words=True) == "내용"


def test_headings():
    lines = ["제1조 목적", "Ⅱ. 개요", "1.2 범위 설명", "3. 범위", "[4] 넷", "## five", "2024. 1. 5.", "3 items", "1. 5억원", "12억"]
    assert [x[0] for x, _ in arrow._sections("\n".join(lines)) if x] == lines[:6]
    c = arrow.heading_chunks("앞\n# 가\n" + "문장이다. " * 30 + "\n# 나\n끝", size=60, overlap=20)
    assert c[0][1:] == ("앞", 1, 0, 20, []) and c[-1][5] == ["# 나"] and c[-1][1].endswith("# 나\n끝") and c[-1][3] > 0 and all(x[2] <= 80 for x in c)
    assert arrow.heading_chunks("# 가\n짧다") == [(0, "# 가\n짧다", 6, 0, 0, ["# 가"])]


def test_page_numbers_and_chunks():
    assert arrow.without_page_numbers("1\n\na\n\n2\n\nb\n\n3") == "\na\n\n\nb\n"
    assert arrow.without_page_numbers("3\n\na\n\n2") == "3\n\na\n\n2"
    parts = arrow.chunks("one two three four", size=8, overlap=2)
    assert [p[0] for p in parts] == list(range(len(parts))) and all(len(p[1]) <= 10 for p in parts)
    assert arrow.chunks(None) == [] and arrow.heading_chunks("") == []
    assert [c[5] for c in arrow.heading_chunks("# A\nx. y.\n# B\nz.")] == [["# A"], ["# B"]]


def test_retrieval_metrics(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (2, "a", 2), (2, "y", 3), (3, "x", 1)], "qid long, id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "qid long, id string")
    m = {r.qid: r for r in retrieval.metrics(ranks, rel, 3).collect()}
    assert (m[1].recall, m[1].mrr, m[1].ndcg) == (1.0, 1.0, 1.0) and abs(m[1].precision - 1 / 3) < 1e-12
    assert m[2].mrr == 0.5 and abs(m[2].ndcg - 1 / 1.584962500721156) < 1e-9
    assert m[3].recall == m[3].mrr == m[3].ndcg == 0.0


@pytest.mark.parametrize(("s", "v", "m", "grade"), [(1, 1, 1, "S2"), (0, 0, 0, "S3"), (1, 2, 2, "S2"), (2, 2, 2, "TS"), (1, 1, 0, "S3"), (2, 2, 0, "S1")])
def test_svm(spark, s, v, m, grade):
    assert one(spark, labeling.svm_grade(F.lit(s), F.lit(v), F.lit(m)))[0] == grade


def test_reviewer_reliability(spark):
    rows = [("A", 1, 1, 1, "good"), ("A", 2, 2, 1, "good2"), ("B", 1, 1, 2, "bad"), ("B", 2, 2, 1, "good")]
    r = {x.reviewer: x for x in ev.reviewer_reliability(spark.createDataFrame(rows, "item string, at int, tie int, level int, reviewer string")).collect()}
    assert (r["good"].total, r["good"].reliability) == (2, 1.0) and r["good2"].reliability == 1.0
    assert (r["bad"].reliability, r["bad"].overturned) == (0.0, 1)


def test_eval_cards(spark):
    rows = [("s", "S3", "S3")] * 50 + [("t", "TS", "TS")] * 5 + [("u", "TS", "TS")] * 100
    c = {x.slice: x.verdict for x in ev.cards(spark.createDataFrame(rows, "src string, label string, pred string"), "src").collect()}
    assert c == {"s": "N/A", "t": "INCONCLUSIVE", "u": "PASS"}


def test_drift_and_cosine(spark):
    v = spark.createDataFrame([(0.1,), (0.9,)], "c double")
    assert tuple(ev.drift(spark, v, v.limit(0), "c").first()) == (0.0, False)
    assert tuple(ev.drift(spark, v, v, "c").first()) == (0.0, False)
    a = lambda *x: F.array(*[F.lit(float(k)) for k in x])
    assert one(spark, stats.cosine(a(1, 0), a(1, 0)), stats.cosine(a(1, 0), a(0, 1)), stats.cosine(a(0, 0), a(0, 1))) == (1.0, 0.0, 0.0)


def test_audit_chain(spark):
    rows = [(1, "", "a" * 20), (2, "a" * 16, ""), (3, "a" * 16, "b" * 20), (4, "x" * 16, "c" * 20)]
    got = relational.chain_breaks(spark.createDataFrame(rows, "id int, before string, own string"), ["id"], "before", "own").orderBy("id").collect()
    assert [r.link_ok for r in got] == [True, True, True, False]


@pytest.mark.parametrize("secret", ["", "k"])
def test_chain_links(spark, secret):
    rows = [(c, k, f"p{c}{k}") for c in (1, 2, 3) for k in range(9)]
    df = spark.createDataFrame(rows, "c int, k int, p string").repartition(4)
    got = {(r.c, r.k): r.link for r in relational.chain_links(df, "c", ["k"], "p", secret).collect()}
    for c in (1, 2, 3):
        before = "0" * 16
        for k in range(9):
            m = f"{before}|p{c}{k}".encode()
            full = (hmac.new(secret.encode(), m, hashlib.sha256) if secret else hashlib.sha256(m)).hexdigest()[:32]
            assert got[c, k] == f"{before[:16]}:{full}"
            before = full
    links = spark.createDataFrame([(c, k, v[:16] if (c, k) != (2, 5) else "x" * 16, v[17:]) for (c, k), v in got.items()], "c int, k int, b string, o string")
    broken = relational.chain_breaks(links, ["k"], "b", "o", "c").where("not link_ok").collect()
    assert [(r.c, r.k) for r in broken] == [(2, 5)]


def test_small_operators(spark):
    f = lambda *a: one(spark, labeling.metadata_floor(*[F.lit(x) for x in a]).alias("m")).m
    assert tuple(f("S3", " Secret", "all")) == ("S1", True, False) and tuple(f("TS", "confidential", "all")) == ("TS", False, False)
    assert f("S2", "none", "approved_only").conflict and not f("S2", "", "department").conflict and f("S3", None, "department").conflict and not f("S3", "secret", "department").conflict
    c = ev.readiness(spark.createDataFrame([("a", "x", "PASS"), ("b", "x", "BLOCKED"), ("b", "y", "PASS"), ("c", "x", "FAIL"), ("c", "y", "BLOCKED")], "p string, name string, status string"), "p")
    assert {(r.p, r.verdict, r.released) for r in c.collect()} == {("a", "PASS", True), ("b", "CONDITIONALLY_READY", False), ("c", "FAIL", False)}
    s = relational.schema_changes(*[spark.createDataFrame(x, "code string, place int") for x in ([("A", 1), ("B", 2), ("C", 3)], [("A", 1), ("C", 2), ("D", 3)])])
    assert {tuple(r) for r in s.collect()} == {("A", "kept", False), ("B", "removed", True), ("C", "reordered", True), ("D", "added", True)}
    m = ev.centroid(spark.createDataFrame([([1.0, 3.0],), ([3.0, 5.0],)], "v array<double>"), "v").first().centroid
    assert m == [2.0, 4.0]
    q = retrieval.multi_query(spark.createDataFrame([(1, 0, "a", 1, 0.9), (1, 1, "a", 2, 0.3), (1, 1, "b", 1, 0.4), (2, 0, "c", 1, 0.7)], "qid int, variant int, id string, rank int, score double"))
    assert {(r.qid, r.id): r.score for r in q.collect()} == pytest.approx({(1, "a"): 1 / 61 + 1 / 62, (1, "b"): 1 / 61, (2, "c"): 0.7})


def test_splits_are_stable_and_leak_free(spark):
    df = spark.createDataFrame([(f"k{i % 40}", "AB"[i % 2]) for i in range(80)], "key string, label string")
    h = hygiene.stratified_holdout(df, "key", "label", 0.25, at_least_one=True)
    assert h.count() == 40 and h.where("held").count() == 10
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, hygiene.stratified_holdout(df.repartition(3), "key", "label", 0.25, at_least_one=True).collect()))


def test_jsonl_and_csv(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "é"}\n\n# note\n{broken\n{"id": 2}\n')
    got = readers.jsonl(spark, str(p), "id long, t string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "é"), (2, None)]
    writers.jsonl(spark.createDataFrame([(1, "é")], "id long, t string"), str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"id": 1, "t": "é"}]
    c = tmp_path / "r.csv"
    c.write_text("﻿doc_id,model_label,human_label,review_decision,reviewer_id\nd1,TS,S1,,kim\n,TS,S1,,kim\nd3,TS,XX,,gpt-1\n")
    good, bad = readers.review_csv(spark, str(c))
    assert [(r.doc_id, r.review_decision) for r in good.collect()] == [("d1", "corrected")]
    assert sorted(",".join(r.reasons) for r in bad.collect()) == ["bad_label,machine_reviewer", "no_id"]


def test_office_files(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(b.getvalue())
    (tmp_path / "b.txt").write_bytes("가".encode("cp949"))
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.html").write_text("<p>a &amp; b<script>x</script></p>")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hi\na | b" and got["b.txt"].text == "가" and got["e.html"].text == "a & b"
    assert got["c.bin"].error == "unsupported: bin" and got["d.docx"].text == "" and got["d.docx"].error


def test_hooks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF x")
    (tmp_path / "b.hwp").write_bytes(b"y")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.documents(spark, str(tmp_path), {"pdf": lambda data: data.decode()[5:], "hwp": lambda data: 1 / 0}).collect()}
    assert got["a.pdf"].text == "x" and got["b.hwp"].text == "" and "ZeroDivisionError" in got["b.hwp"].error
    mask = arrow.masked_entities(lambda t: [(0, 3, "PER"), (2, 5, "ORG"), (6, 9, "LOC")])
    assert [r[0] for r in spark.createDataFrame([("abcde fgh",), (None,)], "t string").select(mask("t")).collect()] == ["ab[ORG] [LOC]", None]
    q = spark.createDataFrame([(1, "x"), (2, "y")], "qid int, text string")
    more = spark.createDataFrame([(1, ["z", "x", "w"])], "qid int, variants array<string>")
    got = {r.qid: r.variants for r in retrieval.expanded(q, F.array(F.lit("r")), more, 4).collect()}
    assert got == {1: ["x", "r", "z", "w"], 2: ["y", "r"]}


def test_alias_swap(spark, tmp_path):
    for v in ("1", "2"):
        writers.swap(spark, spark.createDataFrame([(int(v),)], "x int"), str(tmp_path / "t"), v, str(tmp_path / "alias"), "now")
    assert writers.through_alias(spark, str(tmp_path / "alias"), "now").first().x == 2
    key = F.lit("0123456789abcdef")
    assert one(spark, writers.opened(writers.sealed(F.lit("s"), key), key))[0] == "s"


def test_outbox_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(m, t + datetime.timedelta(seconds=k), ok) for m, oks in ((1, [False, True, True]), (2, [False] * 6), (3, [False])) for k, ok in enumerate(oks)]
    df = spark.createDataFrame(rows, "message long, ts timestamp, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.outbox(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("outbox_rows").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("outbox_rows").collect()))
    assert got == sorted(map(tuple, jobs.outbox_batch(df).collect())) == [(1, "delivered", 2, 0), (2, "dead", 5, 0), (3, "retry", 1, 2)]


def test_empty_tables(spark):
    g = spark.createDataFrame([], "doc_id long, text string, label string, pred string, confidence double, source string")
    assert ev.confusion(g).agg(F.sum("n")).first()[0] == 0
    assert ev.overall(ev.per_class(ev.confusion(g))).first().accuracy == 0.0
    assert ev.reliability(g, "confidence", F.col("label") == F.col("pred")).count() == 0
    assert relational.upsert(g, g, ["doc_id"]).count() == 0
