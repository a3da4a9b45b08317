import json
import os

import pytest
from pyspark.sql import functions as F

from citegrove.plans import pipelines
from citegrove.schemas import CLAIM, TRACE
from citegrove.session import table
from citegrove.sources import records, scans, sinks
from citegrove.streaming import judgments


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_jsonl_keys(spark, tmp_path):
    p = str(tmp_path / "claims.jsonl")
    write(p, [{"problem_id": "a", "claim": "1"}, "", {"problem_id": "b", "claim": "2"}, {"problem_id": "a", "claim": "3"}])
    last = {r["problem_id"]: r["claim"] for r in scans.scan_jsonl(spark, p, CLAIM, "problem_id").collect()}
    first = {r["problem_id"]: r["claim"] for r in scans.scan_jsonl(spark, p, CLAIM, "problem_id", "first").collect()}
    assert last == {"a": "3", "b": "2"} and first == {"a": "1", "b": "2"}
    write(p, ["{broken"])
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.scan_jsonl(spark, p, CLAIM).collect()
    with pytest.raises(Exception, match="(?i)path"):
        scans.scan_documents(spark, str(tmp_path / "no"), CLAIM)


def test_judgments_and_traces(spark, tmp_path):
    row = {"ref_index": 0, "status": "covered", "covered_by": [1], "adequacy": "a", "rationale": "r", "reasoning_chain": ["x"]}
    doc = {"problem_id": "p", "arm": "m+card", "runs": [{"reference_coverage": [row], "decision_sufficiency": "sufficient", "missing": []}] * 2}
    write(str(tmp_path / "problem_p/one.json"), [doc])
    write(str(tmp_path / "problem_p/_skip.json"), [doc])
    v = scans.scan_judgments(spark, str(tmp_path)).collect()
    assert [(r["run"], r["status"], r["covered_by"]) for r in v] == [(0, "covered", [1]), (1, "covered", [1])]
    write(str(tmp_path / "t.jsonl"), [{"type": "step", "step": 1, "ts": 1.5, "payload": "x"}, '{"type": "st'])
    assert scans.scan_traces(spark, str(tmp_path / "t.jsonl")).count() == 1
    assert TRACE.startswith("type")


def test_arms(spark):
    df = spark.createDataFrame([("p", {"card": ("m", "card", 0, 1, ["e"], 1, None)})], scans.arm_schema())
    assert scans.arms_available(df).first()["arms"] == ["card"]
    assert scans.load_arm(df, "card").first()["experiments"] == ["e"]
    with pytest.raises(Exception, match="no arm rag in p; it has card"):
        scans.load_arm(df, "rag").collect()


def test_mappers(spark):
    atom = "<entry><id>http://arxiv.org/abs/2401.00001v3</id><title>A\n  title</title><summary> S\n s</summary><published>2024-01-02</published><author><name>Ann</name></author><author><name>Bob</name></author></entry>"
    r = records.from_atom(spark.createDataFrame([(atom,)], "x string"), "x").first()
    assert (r["title"], r["abstract"], r["authors"], r["year"], r["arxiv_id"], r["doi"]) == ("A title", "S s", ["Ann", "Bob"], 2024, "2401.00001", "")
    work = {"id": "https://openalex.org/W1", "title": "T", "doi": "https://doi.org/10.1/x", "publication_year": 2020, "cited_by_count": 4, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "topics": [{"id": "https://openalex.org/T9"}], "open_access": {"oa_url": "u"}}
    r = records.from_openalex(spark.createDataFrame([(json.dumps(work),)], "x string"), "x").first()
    assert (r["doi"], r["abstract"], r["topic_ids"], r["pdf_url"], r["citations"]) == ("10.1/x", "a b a", ["T9"], "u", 4)
    r = records.from_scholar(spark.createDataFrame([('{"title": "T", "abstract": "", "tldr": {"text": "short"}}',)], "x string"), "x").first()
    assert r["abstract"] == "short"
    r = records.from_serp(spark.createDataFrame([('{"title": "T", "publication_info": {"summary": "A B, C D - Venue, 2019 - x"}}',)], "x string"), "x").first()
    assert (r["year"], r["authors"]) == (2019, ["A B", "C D"])
    r = records.from_task_papers(spark.createDataFrame([('{"title": "T", "published": "2021-03-04", "tasks": ["a", {"name": "b"}], "datasets": []}',)], "x string"), "x").first()
    assert (r["year"], r["tags"]) == (2021, {"tasks": ["a", "b"]})


def test_registry(spark):
    s = records.Sources()
    one = records.from_scholar(spark.createDataFrame([('{"title": "T"}',)], "x string"), "x")
    s.register("a", lambda q, n: one.limit(n))
    got = s.search(["a"], [("q1", "norms"), ("q2", "claim")], 5).orderBy("call").collect()
    assert [(r["sources"], r["queries"], r["buckets"]) for r in got] == [(["a"], ["q1"], ["norms"]), (["a"], ["q2"], ["claim"])]
    s.register("bad", lambda q, n: 1 / 0)
    assert s.search(["a", "bad"], [("q1", "norms")], 5).count() == 1 and [f[1:3] for f in s.failed] == [("bad", "q1")]
    with pytest.raises(ValueError, match="ZeroDivisionError"):
        s.search(["bad"], [("q1", "norms")], 5)
    with pytest.raises(KeyError, match="unknown"):
        s.get(["b"])


def test_pdf_and_cache(spark):
    words = [("d", 1, 0.0, 40.0, 100.0)] * 5 + [("d", 1, 60.0, 90.0, 100.0)] * 5 + [("d", 2, 10.0, 90.0, 100.0)] * 5
    got = {r["page"]: r["two_columns"] for r in scans.pdf_columns(spark.createDataFrame(words, "doc string, page int, x0 double, x1 double, width double")).collect()}
    assert got == {1: True, 2: False}
    b = spark.createDataFrame([(bytearray(b"%PDF-1"), None), (bytearray(b"<html>"), "text/html"), (None, "application/pdf")], "c binary, t string")
    assert [r[0] for r in b.select(scans.is_pdf(F.col("c"), F.col("t"))).collect()] == [True, False, True]
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", "hit", "x" * 9), ("b", "miss", None)], "k string, status string, text string")
    assert [r["k"] for r in scans.cache_misses(want, cache, ["k"]).collect()] == ["c"]
    assert {r["k"]: r["text"] for r in scans.cached_text(want, cache, ["k"], 5).collect()} == {"a": "x" * 9, "b": None, "c": None}
    assert [r["topic_id"] for r in records.resolve_topics(spark.createDataFrame([(0, "u/T1", 0.9), (1, "u/T2", 0.1)], "pos int, id string, score double")).collect()] == ["T1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    p = str(tmp_path / "rows")
    assert sinks.append_new(df, p, "k") == 2
    assert sinks.append_new(spark.createDataFrame([("b", 5), ("c", 3)], "k string, v int"), p, "k") == 1
    sinks.upsert_file(spark.createDataFrame([("b", 9)], "k string, v int"), p, "k", "v", str(tmp_path / "new"))
    assert {(r["k"], r["v"]) for r in spark.read.schema("k string, v int").json(str(tmp_path / "new")).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    sinks.write_by_key(df, str(tmp_path / "by"), "k")
    assert sorted(x for x in os.listdir(tmp_path / "by") if x.startswith("k=")) == ["k=a", "k=b"]
    kept = spark.createDataFrame([("p", 0, "m1"), ("p", 1, "old")], "pid string, run int, prompt string")
    arms = spark.createDataFrame([("p", "m1")], "pid string, prompt string")
    assert sorted(r["run"] for r in sinks.passes_to_run(kept, arms, 3, ["prompt"]).collect()) == [1, 2]
    drafts = spark.createDataFrame([("1.2", [("c0", "A"), ("c1", "B")], [(["c0", "c1"], "control", "e1"), (["c0"], "headline", "e2")])], "paper_id string, claims array<struct<cid:string,claim:string>>, experiments array<struct<claims:array<string>,role:string,text:string>>")
    got = sinks.materialize(drafts).collect()
    assert [(r["problem_id"], r["experiments"], r["roles"]) for r in got] == [("1_2", ["e1", "e2"], ["control", "headline"])]
    assert sinks.report_table(df.orderBy("k"), ["k", "v"]).splitlines()[-1] == "| b | 2 |"


def test_stream(spark, tmp_path):
    row = {"problem_id": "p", "model": "m", "condition": "c", "ref_index": 0, "judge": "j", "run": 0}
    write(str(tmp_path / "in/1.json"), [row | {"status": "missing", "judged_at": "2025-01-01T00:00:00Z"}] * 2)
    run = lambda: judgments.keep_latest(judgments.read_judgments(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), ["problem_id", "judge"]).awaitTermination()
    run()
    write(str(tmp_path / "in/2.json"), [row | {"status": "covered", "judged_at": "2025-01-01T05:00:00Z"}])
    run()
    last = max(int(x) for x in os.listdir(tmp_path / "t") if x.isdigit())
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / f"t/{last}")).collect()] == ["covered"]


def test_pipelines(spark, sf):
    spec = pipelines.GatherSpec(["vision"], ["code repair"], [], top_k=5)
    got = pipelines.gather(table(spark, sf, "paper"), spec)
    assert got.groupBy("pool").count().agg(F.max("count")).first()[0] == 5
    kept = pipelines.curate(table(spark, sf, "menu_item"))
    assert kept.groupBy("key").count().count() > 3
    out = pipelines.retrieve(table(spark, sf, "benchmark_problem"), "problem_id", "claim", table(spark, sf, "documents"), "doc_id", "text", "source", k=4, cap=2)
    assert out.groupBy("problem_id", "source").count().agg(F.max("count")).first()[0] <= 2
