"""The model steps with scripted answers, evidence texts, taxonomy upkeep and reports, on hand-worked cases."""

import json

import pytest
from pyspark.sql import functions as F

from citegrove.operators import evidence, reports, steps, taxonomy


def scripted(answers):
    class Client:
        def complete(self, prompt):
            if prompt not in answers:
                raise ValueError("no answer")
            a = answers[prompt]
            return a if isinstance(a, str) else json.dumps(a)

    return Client


TAX = "task string, area string, keywords array<string>, datasets array<string>, metrics array<string>, card_type string, source string, o long"


@pytest.fixture
def tasks(spark):
    rows = [("Code Repair", "Agents", ["bug fixing"], [], [], "empirical", "seed", 1), ("Visual Grounding", "", None, [], [], "empirical", "seed", 2), ("Bug Fixing Repair Code", "X", [], [], [], "empirical", "seed", 3)]
    return spark.createDataFrame(rows, TAX)


def test_taxonomy(spark, tasks):
    labels = spark.createDataFrame([("code repair",), ("repair of code, bug fixing",), ("Weather",), ("the weather",), ("?",), (None,)], "label string")
    got = {r["label"]: r["task"] for r in taxonomy.canonical_labels(labels, "label", tasks, "o").collect()}
    assert got == {"code repair": "Code Repair", "repair of code, bug fixing": "Code Repair", "Weather": None, "the weather": None, "?": None, None: None}
    grown, named = taxonomy.add_labels(tasks, labels, "label", "o")
    assert {r["label"]: r["task"] for r in named.collect()} == {"code repair": "Code Repair", "repair of code, bug fixing": "Code Repair", "Weather": "Weather", "the weather": "Weather", "?": "?", None: None}
    assert {(r["task"], r["o"]) for r in grown.filter("source = 'custom'").collect()} == {("?", 4), ("Weather", 5)}
    changes = spark.createDataFrame([("Code Repair", ["a", "b", "c"], ["b"], ["c", "d"], "Tools")], "task string, set_keywords array<string>, remove_keywords array<string>, add_keywords array<string>, set_area string")
    t = {r["task"]: r for r in taxonomy.edit(tasks, spark.createDataFrame([("Visual Grounding",)], "task string"), changes).collect()}
    assert set(t) == {"Code Repair", "Bug Fixing Repair Code"} and (t["Code Repair"]["keywords"], t["Code Repair"]["area"]) == (["a", "c", "d"], "Tools")
    with pytest.raises(Exception, match="there is a task Code Repair"):
        taxonomy.edit(tasks, new=tasks.limit(1)).collect()
    subs = spark.createDataFrame([("c", "CODE repair"), ("c", "none"), ("d", None)], "c string, s string")
    assert {r["c"]: r["keywords"] for r in taxonomy.keywords_of(subs, "c", "s", tasks).collect()} == {"c": ["bug fixing"], "d": []}
    assert {r["line"] for r in taxonomy.vocabulary(tasks).collect()} == {"[Agents] Code Repair", "[Other] Visual Grounding", "[X] Bug Fixing Repair Code"}


def test_steps(spark, tasks):
    claims = spark.createDataFrame([(1, "A"), (2, "B")], "k long, claim string")
    answer = {"subfields": ["CODE REPAIR", "odd one", "odd one"], "new_subfields": ["Weather"], "entities": {"models": ["m"]}, "confidence": 0.9}
    out, grown = steps.classify(claims, "k", "claim", tasks, "o", "about {claim}", scripted({"about A": answer}))
    got = {r["k"]: r for r in out.collect()}
    assert (got[1]["subfields"], got[1]["new_subfields"], got[1]["temporal_mode"], got[1]["confidence"], got[1]["error"]) == (["Code Repair", "odd one", "Weather"], ["Weather"], "static", 0.9, None)
    assert got[2]["subfields"] == [] and "no answer" in got[2]["error"] and grown.filter("task = 'Weather'").count() == 1
    q = steps.generate_queries(claims, "k", F.col("claim"), scripted({"A": {"b": ["X ", "x", ""], "a": ["x", "y"]}}))
    assert sorted((r["bucket"], r["query"]) for r in q.collect()) == [("a", "x"), ("a", "y")]
    items, failed = steps.extract(claims, "k", F.col("claim"), ["datasets", "controls"], scripted({"A": {"datasets": [{"name": "D"}, {"name": " "}], "controls": [{"name": "C", "detail": "seed"}]}}))
    assert sorted((r["list"], r["name"]) for r in items.collect()) == [("controls", "C"), ("datasets", "D")] and [r["k"] for r in failed.collect()] == [2]
    menu = {"datasets": [{"name": "AdvBench", "evidence": ["P", "Q"]}], "controls": [{"name": "random seeds training", "evidence": ["P"]}]}
    said = spark.createDataFrame([("P", "datasets", "advbench"), ("P", "controls", "training with random seeds")], "title string, key string, text string")
    kept, counts = steps.consolidate(claims, "k", F.col("claim"), ["datasets", "controls"], said, scripted({"A": menu}))
    assert sorted((r["key"], r["kind"], r["evidence"]) for r in kept.collect()) == [("datasets", None, ["P"]), ("threats", "control", ["P"])]
    assert {r["key"]: r["links_dropped"] for r in counts.collect()} == {"datasets": 1, "controls": 0}
    known = spark.createDataFrame([(1, ["AdvBench", "accuracy"])], "k long, names array<string>")
    r = steps.recipes(claims, "k", F.col("claim"), known, scripted({"A": {"recipes": [{"dataset": "advbench", "model": "z", "metrics": ["Accuracy"]}]}})).first()
    assert r["checks"].asDict() == {"dataset": True, "model": False, "method_under_test": False, "metrics": True}
    assert steps.decompose(claims, "k", F.col("claim"), scripted({"A": "- one?\n\n-two?\n- one?"})).filter("k = 1").first()["questions"] == ["one?", "two?"]
    p = {r["k"]: r for r in steps.propose(claims, "k", F.col("claim"), 2, scripted({"A": {"experiments": ["a", "b", "c"]}})).collect()}
    assert (p[1]["experiments"], p[1]["n_returned"]) == (["a", "b"], 3) and p[2]["experiments"] == []
    cache = claims.filter("k = 2").select(F.md5("claim").alias("prompt_md5"), F.lit('{"choice": "Missing", "p": 0.7}').alias("answer"))
    c = {r["k"]: (r["choice"], r["p"]) for r in steps.choose(claims, "k", F.col("claim"), ["covered", "missing"], cache, scripted({"A": {"choice": "odd", "p": 1}})).collect()}
    assert c == {1: (None, None), 2: ("missing", 0.7)}
    assert steps.temperature("gpt-5.5", 0.2) is None and steps.temperature("qwen", 0.2) == 0.2
    assert steps.delays(5, [None, 90.0, 0.5]) == [1.0, 60.0, 0.5, 8.0]


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")], "k long, t string")
    got = {r["k"]: r for r in steps.embed(df, "k", "t", dims=8).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1]["vector"] == got[2]["vector"] and abs(sum(x * x for x in got[5]["vector"]) - 1) < 1e-9 and not any(got[4]["vector"])
    cache = spark.createDataFrame([(got[5]["hash"], [9.0])], "hash string, vector array<double>")
    assert {r["k"]: r["vector"] for r in steps.embed(df, "k", "t", dims=8, cache=cache).collect()}[5] == [9.0]


def test_evidence(spark):
    rows = [
        ("c", "datasets", 1, "D1", "main", None, None), ("c", "datasets", 2, "D2", None, None, None), ("c", "threats", 1, "T", None, "why", "control"), ("c", "threats", 2, "U", None, None, "confound"),
        ("c", "protocols", 1, "P", None, "how", None), ("c", "odd", 1, "O", None, None, None), ("c", "baselines", 1, None, None, None, None), ("c", "baselines", 2, "B", "r", None, None),
    ]
    card = spark.createDataFrame(rows, "claim string, key string, place long, name string, role string, detail string, kind string")
    s = evidence.card_sections(card, ["claim"], "2").orderBy("number").collect()
    assert [(r["number"], r["body"]) for r in s] == [(0, "- [control] T: why\n- [confound] U"), (2, "- B (r)"), (4, "D1 (main), D2")] and s[0]["title"].startswith("Control conditions")
    text = evidence.card_text(evidence.card_sections(card, ["claim"], "0.4", "protocols,datasets"), ["claim"]).first()["evidence"]
    assert text == "How this subfield takes a measurement:\n  - P: how\nDatasets this subfield evaluates on:\n  D1 (main), D2"
    assert evidence.menu_text(card, ["claim"], "0.4").first()["text"] == "baselines: B (r)\ndatasets: D1 (main), D2\nthreats:\n  - T — why\n  - U\nprotocols:\n  - P — how"
    with pytest.raises(ValueError, match="unknown sections"):
        evidence.resolve_sections("nope")
    assert evidence.resolve_sections("design") == ["protocols", "controls", "confounds"]
    claims = spark.createDataFrame([("c",), ("d",)], "claim string")
    shown = spark.createDataFrame([("c", "text"), ("d", ""), ("x", "y")], "claim string, evidence string")
    got = {(r["claim"], r["condition"]) for r in evidence.conditions(["nocard", "card", "rag"], claims, "claim", cards=shown, label="v2").collect()}
    assert got == {("c", "nocard"), ("d", "nocard"), ("c", "card:v2")}
    with pytest.raises(ValueError, match="unknown conditions"):
        evidence.conditions(["odd"], claims, "claim")
    lex = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q long, d long, rank int")
    den = spark.createDataFrame([(2, 30, 1)], "q long, d long, rank int")
    assert {(r["q"], r["d"]) for r in evidence.choose_ranking(lex, den, "q", "d", "hybrid").collect()} == {(1, 10), (1, 20), (2, 30)}
    ranked = spark.createDataFrame([("q", 2, " B", "x\ny"), ("q", 1, "A", None), ("q", 3, None, "z")], "q string, rank int, title string, abstract string")
    assert evidence.abstracts(ranked, "q", 2, 2).first()["evidence"] == "[1] A\n    \n[2] B\n    x "
    assert evidence.passages(ranked.withColumn("passage", F.lit("p")), "q").first()["evidence"] == "[from: A]\np\n\n[from:  B]\np\n\n[from: ]\np"


def test_reports(spark):
    df = spark.createDataFrame([(0.1234, 0.01, 0.2), (-0.5, -0.6, 0.1), (None, None, None)], "m double, lo double, hi double")
    assert [r[0] for r in df.select(reports.interval(F.col("m"), F.col("lo"), F.col("hi"))).collect()] == ["**+0.123 [+0.010, +0.200]**", "−0.500 [−0.600, +0.100]", "– [–, –]"]
    st = spark.createDataFrame([("p", "m", "c", 0, ["covered", "missing"]), ("p", "m", "c", 1, [])], "problem_id string, model string, condition string, ref_index int, run_statuses array<string>")
    first = reports.first_votes(st)
    assert reports.strict_share(first).first()["strict"] == 1.0 and reports.compare_runs(first, first.withColumn("status", F.lit("missing"))).first()["delta"] == -1.0
    kits = spark.createDataFrame([("a", {"x": "ax", "y": "ay"}), ("b", {"x": "bx"})], "kit string, texts map<string,string>")
    cases = spark.createDataFrame([(1, "a", ["x", "free"]), (2, "a", None)], "id long, kit string, keys array<string>")
    assert {r["id"]: r["proposal"] for r in reports.cross_kits(cases, kits, {"a": "b", "b": "a"}, ["x", "y"]).collect()} == {1: ["ax", "free"], 2: ["bx", "y"]}
    f, v = spark.createDataFrame([("f",), ("g",)], "field string"), spark.createDataFrame([("v",)], "venue string")
    assert [r["field"] for r in reports.harvest_plan(f, v, spark.createDataFrame([("f", "v")], "field string, venue string")).collect()] == ["g"]
    cand = spark.createDataFrame([(1, 0, "arxiv", " "), (1, 1, "field", "u1"), (1, 2, "open", "u2")], "k long, step int, resolver string, url string")
    assert {r["k"]: r["url"] for r in reports.resolve_pdfs(spark.createDataFrame([(1,), (2,)], "k long"), cand, "k").collect()} == {1: "u1", 2: None}
    lab = spark.createDataFrame([("p_c1", "p", "F", "l"), ("p_c2", "p", "G", "l"), ("q", "q", "F", "l"), ("q", "q", None, None)], "problem_id string, paper string, field string, label string")
    assert [tuple(r) for r in reports.label_table(lab).collect()] == [("l", 3, 2, "F 2, G 1")]
    rows = spark.createDataFrame([("a", ["1", "2"], ["x", "y"])], "problem_id string, experiments array<string>, roles array<string>")
    assert reports.checked_dataset(rows, rows).count() == 1
    for bad, why in ((rows.unionByName(rows), "twice"), (rows.withColumn("roles", F.array(F.lit("x"))), "parallel"), (rows.withColumn("problem_id", F.lit("b")), "missing|wanted")):
        with pytest.raises(Exception, match=why):
            reports.checked_dataset(bad, rows).collect()
    assert {tuple(r) for r in reports.stamped_arms(f, f.limit(1), ["field"]).collect()} == {("f", True), ("g", False)}
    assert {tuple(r) for r in reports.provenance(cand, "resolver").collect()} == {("arxiv", 1), ("field", 1), ("open", 1)}
