import math
import random

import pytest
from pyspark.sql import functions as F

from citegrove.operators import curation, identity, models, quality, ranking, retrieval, scoring
from citegrove.schemas import PAPER

PAPERS = "seq long, " + PAPER


def papers(spark, rows):
    blank = dict.fromkeys([c.split()[0] for c in PAPERS.replace("map<string,array<string>>", "map").split(", ")])
    return spark.createDataFrame([tuple({**blank, **r}.values()) for r in rows], PAPERS)


def test_merge_and_versions(spark):
    rows = [
        {"seq": 1, "title": "A b", "abstract": "xx", "doi": "10.1/A", "authors": ["Z Y"], "sources": ["s2"], "citations": 3, "tags": {"t": ["1"]}},
        {"seq": 2, "title": "A  B!", "abstract": "yy", "doi": "10.1/a ", "authors": [], "sources": ["s1", None], "venue": "V", "citations": 9, "tags": {"t": ["2"], "u": ["3"]}},
        {"seq": 3, "title": "a B", "abstract": "yyy", "doi": "10.2/b", "authors": ["z y"]},
        {"seq": 4, "title": "", "authors": None},
    ]
    first = {r["seq"]: r for r in identity.merge_by_identity(papers(spark, rows)).collect()}
    assert set(first) == {1, 3, 4}
    r = first[1]
    assert (r["abstract"], r["venue"], r["citations"], r["n"]) == ("xx", "V", 9, 2)
    assert [s for s in r["sources"] if s] == ["s1", "s2"] and r["tags"] == {"t": ["1"], "u": ["3"]}
    again = {r["seq"]: r for r in identity.merge_by_version(identity.merge_by_identity(papers(spark, rows))).collect()}
    assert set(again) == {1, 4} and again[1]["abstract"] == "yyy" and again[1]["keyed"] and not again[4]["keyed"]
    kept = {(r["seq"], r["kept_seq"], r["n"]) for r in identity.representatives(papers(spark, rows)).collect()}
    assert kept == {(1, 3, 3), (4, 4, 1)}
    assert identity.merge_by_identity(papers(spark, [])).count() == 0


def test_bm25_against_plain(spark):
    random.seed(3)
    vocabulary = [f"w{i:02d}" for i in range(30)]
    docs = [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "w01 w01 w02"), (63, "w01 w01 w02")]
    queries = [(1, "w01 w02 w01"), (2, "w05"), (3, "nothing"), (4, None), (5, "w02 w01")]
    got = {}
    for r in retrieval.bm25(spark.createDataFrame(queries, "q long, t string"), "q", "t", spark.createDataFrame(docs, "d long, t string"), "d", "t", 5).collect():
        got.setdefault(r["q"], {})[r["rank"]] = r["d"]
    toks = [(d, (t or "").split()) for d, t in docs]
    n, avg = len(toks), sum(len(t) for _, t in toks) / len(toks)
    for q, t in queries:
        score = []
        for d, ts in toks:
            s = 0.0
            for w in set((t or "").split()):
                df = sum(w in x for _, x in toks)
                if df and w in ts:
                    tf = ts.count(w)
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (len(ts) or 1) / avg))
            if s > 0:
                score.append((round(s, 9), d))
        want = [d for _, d in sorted(score, reverse=True)[:5]]
        assert [got.get(q, {})[k] for k in sorted(got.get(q, {}))] == want


def test_dense_rrf_caps(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0])], "d long, v array<float>")
    got = retrieval.dense_top_k(v.filter("d = 1").withColumnRenamed("d", "q"), "q", v, "d", "v", 3).orderBy("rank").collect()
    assert [r["d"] for r in got] == [4, 1, 3]
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q long, d long, rank int")
    b = spark.createDataFrame([(1, 30, 1), (1, 10, 2)], "q long, d long, rank int")
    fused = retrieval.rrf(a, b, "q", "d").orderBy("rank").collect()
    assert [r["d"] for r in fused] == [10, 30, 20]
    r = spark.createDataFrame([(1, i, g, i) for i, g in enumerate("aaaab", 1)], "q long, d long, g string, rank int")
    assert sorted(x["d"] for x in ranking.cap_per_group(r, ["q"], "g", 2, 3).collect()) == [1, 2, 5]
    t = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((50, 60, 30), 1)], "q long, rank int, t string")
    assert sorted(x["rank"] for x in retrieval.within_budget(t, "q", "t", 85).collect()) == [1, 3]


def test_passages(spark):
    long = "a" * 2500
    rows = [(1, None), (2, "short"), (3, long), (4, "b" * 300 + "\n\n" + "c" * 300 + "\n\n \n\n" + "d" * 900), (5, "e" * 500 + "\n\n" + long + "\n\n" + "f" * 400 + "\n\n" + "g" * 200), (6, "")]
    got = {}
    for r in retrieval.passages(spark.createDataFrame(rows, "k long, t string"), "k", "t").orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["passage"])
    assert set(got) == {3, 4, 5}
    assert [len(c) for c in got[3]] == [1100, 1100, 600] and got[3][1] == long[950:2050]
    assert got[4] == ["b" * 300 + "\n\n" + "c" * 300, "d" * 900]
    assert got[5] == ["e" * 500, long[:1100], long[950:2050], long[1900:] + "\n\n" + "f" * 400, "g" * 200][:4]


def test_bm25_with_a_cap(spark, monkeypatch):
    """The cap of a group inside and both ways of joining give what a plain ranking gives, whatever the partitions."""
    random.seed(5)
    words = [f"w{i:02d}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(random.choices(words, k=8)), random.choice(["x", "y", "z", None])) for i in range(90)], "d long, t string, g string").repartition(5)
    queries = spark.createDataFrame([(i, " ".join(random.choices(words, k=3))) for i in range(9)], "q long, t string")
    full = retrieval.bm25(queries, "q", "t", docs, "d", "t", 1000).join(docs.select("d", "g"), "d").collect()
    want, seen = {}, {}
    for r in sorted(full, key=lambda r: (r["q"], r["rank"])):
        seen[r["q"], r["g"]] = seen.get((r["q"], r["g"]), 0) + 1
        if seen[r["q"], r["g"]] <= 2 and len(want.setdefault(r["q"], [])) < 5:
            want[r["q"]].append(r["d"])
    for travelling in (20_000, 1):
        monkeypatch.setattr(retrieval, "TRAVELLING", travelling)
        monkeypatch.setattr(retrieval, "DOC_BLOCK", 7)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
        got = {}
        for r in sorted(retrieval.bm25(queries, "q", "t", docs, "d", "t", 5, group="g", cap=2).collect(), key=lambda r: (r["q"], r["rank"])):
            got.setdefault(r["q"], []).append(r["d"])
        assert got == want
    assert retrieval.bm25(queries, "q", "t", docs.filter("false"), "d", "t", 5).count() == 0
    assert retrieval.bm25(queries.filter("false"), "q", "t", docs, "d", "t", 5).count() == 0


def many_queries(spark):
    """300 queries and 400 documents that all have a term in common, and what a plain ranking gives."""
    random.seed(8)
    words = [f"w{i:02d}" for i in range(40)]
    ds = [(i, "all " + " ".join(random.choices(words, k=6))) for i in range(400)]
    qs = [(f"q{i}", "all " + " ".join(random.choices(words, k=3))) for i in range(300)]
    toks = [t.split() for _, t in ds]
    df = {w: sum(w in t for t in toks) for w in [*words, "all"]}
    want = set()
    for q, text in qs:
        score = {}
        for (d, _), t in zip(ds, toks, strict=True):
            score[d] = sum(math.log(1 + (400 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5) for w in set(text.split()) if w in t)
        best = sorted(score, key=lambda d: (round(score[d], 9), d), reverse=True)
        want |= {(q, d, i) for i, d in enumerate(best[:5], 1)}
    return spark.createDataFrame(qs, "q string, t string"), spark.createDataFrame(ds, "d long, t string").repartition(3), want


def test_bm25_of_many_queries(spark, shuffled, monkeypatch):
    """More queries than travel at once: rounds give what a plain ranking gives, and only k rows a query and task are shuffled, not all pairs."""
    queries, docs, want = many_queries(spark)
    monkeypatch.setattr(retrieval, "TRAVELLING", 100)
    before = shuffled()
    got = {(r["q"], r["d"], r["rank"]) for r in retrieval.bm25(queries, "q", "t", docs, "d", "t", 5).collect()}
    assert got == want
    assert shuffled() - before < 300 * 400 / 4


def test_bm25_of_many_files(spark, shuffled):
    """Documents in 60 files, each a split of its own: results are the same, and only the lists of so many tasks as the cores allow are shuffled."""
    queries, docs, want = many_queries(spark)
    sizes = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    try:
        for x in sizes:
            spark.conf.set(x, "64k")
        before = shuffled()
        got = {(r["q"], r["d"], r["rank"]) for r in retrieval.bm25(queries, "q", "t", docs.repartition(60), "d", "t", 5).collect()}
        assert got == want
        assert shuffled() - before < 300 * 5 * 20
    finally:
        for x in sizes:
            spark.conf.unset(x)


def test_cap_of_many_files(spark, shuffled):
    """The same with a cap of two of a group: 30 queries, documents in 60 files."""
    queries, docs, _ = many_queries(spark)
    queries, docs = queries.limit(30), docs.withColumn("g", F.col("d") % 7)
    want, seen = {}, {}
    for r in sorted(retrieval.bm25(queries, "q", "t", docs, "d", "t", 400).collect(), key=lambda r: (r["q"], r["rank"])):
        g = r["q"], r["d"] % 7
        seen[g] = seen.get(g, 0) + 1
        if seen[g] <= 2 and len(want.setdefault(r["q"], [])) < 6:
            want[r["q"]].append(r["d"])
    sizes = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    try:
        for x in sizes:
            spark.conf.set(x, "64k")
        before, got = shuffled(), {}
        for r in sorted(retrieval.bm25(queries, "q", "t", docs.repartition(60), "d", "t", 6, group="g", cap=2).collect(), key=lambda r: (r["q"], r["rank"])):
            got.setdefault(r["q"], []).append(r["d"])
        assert got == want
        assert shuffled() - before < 30 * 6 * 16 + 3_000
    finally:
        for x in sizes:
            spark.conf.unset(x)


def test_balanced_top_k(spark):
    rows = [("p", i, 2010 if i <= 5 else 2025) for i in range(1, 9)] + [("small", 1, 2000)]
    df = spark.createDataFrame(rows, "pool string, rank int, year int")
    got = sorted((r["pool"], r["rank"]) for r in ranking.balanced_top_k(df, "pool", 3).collect())
    assert got == [("p", 1), ("p", 2), ("p", 6), ("small", 1)]


EV = "problem_id string, model string, condition string, ref_index int, judge string, run int, judged_at timestamp, status string, covered_by array<int>, chain int"


def passes(spark, rows):
    import datetime as dt

    full = [("p", "m", c, i, "j", k, dt.datetime(2025, 1, 1, k), s, by, ch) for c, i, k, s, by, ch in rows]
    return spark.createDataFrame(full, EV)


def test_votes_and_metrics(spark):
    p = passes(
        spark,
        [
            ("card", 0, 0, "covered", [1], 1), ("card", 0, 1, "covered", [2], 3), ("card", 0, 2, "missing", [], 9),
            ("card", 1, 0, "covered", [0], 1), ("card", 1, 1, "missing", [], 2),
            ("card", 2, 0, None, None, 0), ("card", 3, 0, "partial", [7], 1),
        ],
    )
    items = {r["ref_index"]: r for r in scoring.aggregate_runs(p.withColumn("covered_by", F.coalesce("covered_by", F.array().cast("array<int>")))).collect()}
    assert (items[0]["status"], items[0]["covered_by"], items[0]["chain"]) == ("covered", [1, 2], 3)
    assert (items[1]["status"], items[1]["covered_by"], items[1]["mean_value"]) == ("CONTESTED", [0], 0.5)
    assert items[2]["status"] is None
    agg = scoring.aggregate_runs(p)
    r = scoring.recall(agg, scoring.ARM).first()
    assert r["n"] == 4 and abs(r["recall"] - (1 + 0.5 + 0.5) / 3) < 1e-9
    zero = scoring.recall(agg, scoring.ARM, "zero").first()
    assert abs(zero["recall"] - 0.5) < 1e-9
    vote = {r["ref_index"]: r for r in scoring.majority_vote(p, scoring.ITEM, "status", "judged_at").collect()}
    assert vote[1]["winner"] == "covered" and vote[2]["winner"] is None
    assert scoring.recall(scoring.aggregate_runs(p.filter("false")), scoring.ARM).count() == 0


def test_self_recall_and_order(spark):
    p = passes(spark, [("card", i, k, "covered", [i], 1) for i in range(4) for k in range(3)])
    assert scoring.recall(scoring.aggregate_runs(p.repartition(5)), scoring.ARM).first()["recall"] == 1.0
    m = scoring.matched(scoring.aggregate_runs(p), scoring.ARM, None, 4).first()
    assert (m["matched"], m["precision"], m["f1"]) == (4, 1.0, 1.0)


def test_n_proposed(spark):
    """k follows the experiments of the arm: seven of seven items count, and three of five where no more were proposed."""
    rows = [("card", i, 0, "covered", [i], 1) for i in range(7)] + [("card", 0, 1, "covered", [0, 10], 1), ("card", 1, 1, "covered", [-1, 1], 1)]
    rows += [("rag", i, 0, "covered", [i % 3], 1) for i in range(5)] + [("rag", 0, 1, "covered", [6], 1), ("nocard", 0, 0, "missing", None, 1)]
    p = passes(spark, rows).withColumn("covered_by", F.coalesce("covered_by", F.array().cast("array<int>")))
    n = scoring.n_proposed(p, scoring.ARM)
    assert {r["condition"]: r["n_proposed"] for r in n.collect()} == {"card": 7, "rag": 3, "nocard": 0}
    m = scoring.matched(scoring.aggregate_runs(p).join(n, scoring.ARM), scoring.ARM, None, "n_proposed")
    assert {r["condition"]: (r["n_items"], r["k"], r["matched"], r["precision"]) for r in m.collect()} == {"card": (7, 7, 7, 1.0), "rag": (5, 3, 3, 1.0), "nocard": (1, 0, 0, 0.0)}


def test_r_precision_takes_each_arms_number(spark):
    from citegrove.plans.catalog import REGISTRY

    sf = "/root/testdata/sf0.01"
    rows = REGISTRY.queries()["r_precision"](spark, sf).collect()
    named = {}
    for r in spark.read.parquet(f"{sf}/evaluation.parquet").filter("ref_index is not null").collect():
        named.setdefault(tuple(r[c] for c in scoring.ARM), set()).update(r["covered_by"] or [])
    n = dict.fromkeys(named, 0)
    for arm, js in named.items():
        for j in sorted(j for j in js if j >= 0):
            n[arm] = j + 1 if j < n[arm] + 3 else n[arm]
    assert {tuple(r[c] for c in scoring.ARM): r["k"] for r in rows} == {tuple(r[c] for c in scoring.ARM): min(r["n_items"], n[tuple(r[c] for c in scoring.ARM)]) for r in rows}
    assert any(r["k"] != min(r["n_items"], 5) for r in rows)


def test_matching():
    assert scoring.matching([[0], [0, 1], [1]], 2) == 2
    assert scoring.matching([[0, 1], [0]], 9) == 2 and scoring.matching([[5]], 3) == 0 and scoring.matching([], 3) == 0


def test_bootstrap_parity(spark):
    v = [0.1, -0.2, 0.3, 0.05, 0.0]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)], "g string, o int, v double")
    r = scoring.seeded_bootstrap(df, ["g"], "v", "o", rounds=200, seed=7).first()
    rng = random.Random(7)
    means = sorted(sum(rng.choices(v, k=5)) / 5 for _ in range(200))
    assert (r["lo"], r["hi"]) == pytest.approx((means[5], means[195]))
    p = spark.createDataFrame([("u", "none", 0.25), ("u", "card", 1.0), ("w", "card", 1.0)], "u string, arm string, v double")
    assert [tuple(r) for r in scoring.paired(p, ["u"], "arm", "v", "none", "card").collect()] == [("u", 0.25, 1.0, 0.75)]
    h = scoring.hash_bootstrap(df, ["g"], F.col("v"), "o", 100, "s").first()
    assert h["n"] == 5 and h["lo"] <= h["mean"] <= h["hi"]


def test_curation(spark):
    items = spark.createDataFrame(
        [(1, "s", "datasets", ["a", "b"]), (2, "s", "datasets", ["a", "a", " "]), (3, "t", "datasets", ["a"]), (4, "t", "threats", None)], "item_id long, subfield string, key string, evidence array<string>"
    )
    got = {r["item_id"]: r["relaxed"] for r in curation.prune_relaxed(items, ["subfield", "key"]).collect()}
    assert got == {1: False, 3: True, 4: False}
    tags = [["a"], ["a", "b"], ["b"], [], ["a"]]
    assert curation.allocate(tags, ["a", "b"], 4) == [0, 1, 4, 2] and curation.allocate(tags, ["a", "b"], 9) == [0, 1, 4, 2, 3] and curation.allocate(tags, ["b", "a"], 3) == [1, 0, 2]
    kinds = ["control"] + ["confound"] * 4
    assert curation.allocate_kinds(tags, kinds, ["a", "b"], 4) == [0, 1, 2, 4] and curation.allocate_kinds([["a"]] * 5, ["control"] * 5, ["a"], 4) == [0, 1, 2, 3]
    names = spark.createDataFrame(
        [
            (1, "s", "baselines", None, "KN (Knowledge Neurons)", ["p"], "d"), (2, "t", "baselines", "", "Knowledge Neurons (KN)", ["q", "p"], "longer"), (3, "t", "baselines", None, "ROME", None, None), (4, "t", "baselines", None, None, ["z"], None),
            (5, "s", "threats", "control", "Pre-edit model baseline", ["a", "b"], None), (6, "t", "threats", "control", "Pre-edit unedited model baseline", ["c"], "x"), (7, "t", "threats", "confound", "Pre-edit model baseline", ["a"], None), (8, "u", "threats", "control", "Random seeds", [" ", None], None),
        ], "item_id long, subfield string, key string, kind string, name string, evidence array<string>, detail string",
    ).withColumns({"applies_when": F.array(F.lit("Method comparison"), F.lit("odd")), "role": F.lit(None).cast("string"), "variants": F.lit("clash")})
    assert {(r["node"], r["slot"]) for r in curation.alias_slots(names).collect()} == {(1, 1), (2, 1), (3, 3), (5, 5), (6, 6), (7, 7), (8, 8)}
    m = {r["item_id"]: r for r in curation.merge_menu(names).collect()}
    assert (m[1]["name"], m[1]["evidence"], m[1]["subfields"], m[1]["variants"], m[1]["detail"]) == ("Knowledge Neurons", ["p", "q"], ["s", "t"], ["KN", "KN (Knowledge Neurons)", "Knowledge Neurons (KN)"], "longer")
    a = {r["item_id"]: r for r in curation.absorb_design(curation.merge_menu(names)).collect()}
    assert set(a) == {1, 3, 5, 7, 8} and (a[5]["evidence"], a[5]["subfields"], a[5]["variants"], a[5]["detail"], a[5]["applies_when"]) == (["a", "b", "c"], ["s", "t"], ["Pre-edit unedited model baseline"], "x", ["method comparison"])
    card = [(r["key"], r["place"], r["item_id"]) for r in curation.curate(names, ["t", "s"], "2").collect()]
    assert sorted(card) == [("baselines", 1, 1), ("threats", 1, 5), ("threats", 2, 8), ("threats", 3, 7)]
    assert curation.curate(names.filter("false")).count() == 0
    d = spark.createDataFrame([(1, "g", "Pre-edit model baseline", ["a", "b"]), (2, "g", "Pre-edit (unedited) model baseline", ["a"]), (3, None, "Random seeds", []), (4, None, "the", None)], "item_id long, g string, name string, evidence array<string>")
    assert {(r["g"], r["item_id"], r["host"]) for r in curation.absorb(d, ["g"]).collect()} == {("g", 1, 1), ("g", 2, 1), (None, 3, 3), (None, 4, 4)}
    k = spark.createDataFrame([(i, "g", "control" if i < 2 else "confound") for i in range(6)], "item_id long, g string, kind string")
    assert sorted(r["item_id"] for r in curation.kind_quota(k, ["g"], [F.col("item_id")], 5).collect()) == [0, 1, 2, 3, 4]


def test_grounded(spark):
    rows = [("AdvBench", ["on advbench data"]), ("Adv-Bench-XL", ["the dvbenc thing"]), ("QQ (full)", ["a qq b"]), ("Zeta", ["none", None]), (None, ["x"]), ("xyzabc", ["ends in xyz", "abc begins"]), ("Ab", None), ("?", ["?"])]
    df = spark.createDataFrame(rows, "n string, p array<string>")
    assert [r[0] for r in df.select(curation.grounded(F.col("n"), F.col("p"))).collect()] == [True, True, True, False, False, False, False, False]


def test_guard(spark):
    items = spark.createDataFrame(
        [
            (1, "datasets", "AdvBench", "AdvBench", ["P", "Q", None]), (2, "threats", "Random seed control", "Random seed control across training runs", ["P", "Q"]), (3, "threats", "Same prompt", "Same prompt", ["P"]),
            (4, "datasets", "Other", "Other", []), (5, "datasets", None, "x", ["P"]),
        ], "item_id long, key string, name string, text string, evidence array<string>",
    )
    said = spark.createDataFrame([("P", "datasets", "Adv-Bench (small)"), ("P", "threats", "control runs with random seeds, training apart"), ("Q", "protocols", "random control of training")], "title string, key string, text string")
    kept, counts = curation.guard(items, said)
    assert {r["item_id"]: r["evidence"] for r in kept.collect()} == {1: ["P"], 2: ["P"]}
    assert {r["key"]: tuple(r)[1:] for r in counts.collect()} == {"datasets": (1, 2, 1), "threats": (2, 1, 1)}
    r = spark.createDataFrame([("AdvBench test", "nothing", ["accuracy", "zzz"]), (None, "Llama", None)], "dataset string, model string, metrics array<string>")
    known = F.array(*map(F.lit, ["advbench", "Llama-3", "Accuracy", "abc"]))
    got = [(x["checks"].asDict(), x["untraceable"]) for x in curation.recipe_checks(r, known, ["dataset", "model"], "metrics").collect()]
    assert got == [({"dataset": True, "model": False, "metrics": False}, ["zzz"]), ({"dataset": False, "model": True, "metrics": True}, [])]


def test_sufficiency(spark):
    rows = [("a", 0, "no", "r0", ["m1"]), ("a", 1, "yes", "r1", ["m2", None]), ("a", 2, "yes", "r2", None), ("b", 0, "yes", "q0", None), ("b", 1, "no", "q1", ["z"]), ("c", 0, None, None, ["k"])]
    df = spark.createDataFrame(rows, "arm string, run int, sufficiency string, reasoning string, missing array<string>").repartition(3)
    got = {r["arm"]: (r["n_runs"], r["sufficiency"], r["reasoning"], r["missing"], r["missing_all_runs"]) for r in scoring.aggregate_sufficiency(df, ["arm"]).collect()}
    assert got == {"a": (3, "yes", "r1", ["m2", None], ["m1", "m2"]), "b": (2, None, "q0", [], ["z"]), "c": (1, None, "", ["k"], ["k"])}


def test_quality(spark):
    df = spark.createDataFrame([(["x" * 120, "y" * 130], ["control", "headline"], "c"), (["short"], ["odd", "control"], " "), (None, None, None)], "e array<string>, r array<string>, c string")
    got = [r[0] for r in df.select(quality.reference_faults(F.col("e"), F.col("r"), F.col("c"))).collect()]
    assert got == ["", "needs two experiments; 1 short experiments; claim is blank; roles are not parallel; unknown role", "needs two experiments; claim is blank"]
    cols = "seq long, title string, arxiv_id string, pdf_url string, url string, doi string"
    bundle = spark.createDataFrame([(1, "A Very Long Title About Steering Vectors", "", None, None, None), (2, "Other", "2401.00001v2", None, None, None), (3, None, None, None, None, None)], cols)
    source = spark.createDataFrame([(9, "a very long title about steering vectors, extended", None, None, None, None), (8, "Zzz", None, None, None, "10.48550/arXiv.2401.00001")], cols)
    assert {(r["seq"], r["source_seq"]) for r in quality.leaked(bundle, source).collect()} == {(1, 9), (2, 8)}
    short = spark.createDataFrame([(5, "Steering, Vectors", None, None, None, None), (6, "zz", None, None, None, None), (7, None, None, None, None, None)], cols)
    assert {(r["seq"], r["source_seq"]) for r in quality.leaked(bundle, short).collect()} == {(1, 5)}
    said = df.select(quality.reference_messages(F.col("e"), F.col("r"), F.col("c"), F.lit(True)).alias("m")).collect()
    assert said[0]["m"] == ["still a draft"] and "experiments[0]: 5 characters, 120 at least" in said[1]["m"] and "roles[0]: unknown role odd" in said[1]["m"] and len(said[2]["m"]) == 3
    assert quality.leaked(bundle.filter("false"), source).count() == 0
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("ab", "bc"))
    assert {tuple(r) for r in quality.symmetric_difference(a, b, ["k"]).collect()} == {("a", "left"), ("c", "right")}


def test_models(spark):
    class Flaky:
        calls = 0

        def complete(self, prompt):
            if prompt == "bad":
                raise ValueError("no")
            return 'Sure: {"label": "no"}' if prompt == "drop" else '{"label": "yes"}'

    df = spark.createDataFrame([(1, "keep"), (2, "drop"), (3, "bad"), (4, None)], "k long, p string")
    out = {r["k"]: r for r in models.complete(df, "k", "p", Flaky).collect()}
    assert out[3]["error"] == "ValueError: no" and out[4]["answer"] is None and out[4]["error"] is None
    assert sorted(r["k"] for r in models.screen(df, "k", "p", Flaky).collect()) == [1, 3, 4]
    cache = df.filter("k = 1").select(F.md5("p").alias("prompt_md5"), F.lit("cached").alias("answer"))
    assert {r["k"]: r["answer"] for r in models.cached(df, cache, "k", "p", Flaky).collect()}[1] == "cached"
    answers = iter(["a", "b"])
    assert models.validated(lambda _: next(answers), lambda x: None if x == "b" else "not b", "p") == ("b", None)


def test_main_body(spark):
    from citegrove.functions.text import REFERENCES, YEAR

    body, years = "x" * 500, " (1999)" * 12
    rows = [(1, body + " References" + years + " Appendix"), (2, body + " (2001)" * 25), (3, body + " References 2001"), (4, "References" + years + body), (5, ""), (6, None)]
    got = {r["k"]: r["cut"] for r in retrieval.main_body(spark.createDataFrame(rows, "k long, t string"), "k", "t", YEAR, REFERENCES).collect()}
    assert got == {1: 501, 2: 502, 3: len(rows[2][1]), 4: len(rows[3][1]), 5: 0}
