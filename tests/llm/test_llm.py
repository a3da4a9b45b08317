"""The training-data operators on small cases: brute force, round trips, nulls, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from citegrove.llm import bpe, canonmap, consensus, packing, queries, readability, setjoin, survivor, termcount, twins
from citegrove.operators import graph

SF = "/root/testdata/sf0.001"

# ---- p1 ------------------------------------------------------------------

VOTES = "i long, who string, label string"


def simulated(seed=1, items=400):
    rng = random.Random(seed)
    right = {"good1": 0.95, "good2": 0.9, "good3": 0.9, "fair": 0.7, "spam": 1 / 3, "contrary": 0.1}
    rows, truth = [], {}
    for i in range(items):
        t = truth[i] = rng.choice("abc")
        for who in rng.sample(sorted(right), 4):
            rows.append((i, who, t if rng.random() < right[who] else rng.choice([x for x in "abc" if x != t])))
    return rows, truth, right


def test_consensus_beats_majority(spark):
    rows, truth, right = simulated()
    c = consensus.consensus(spark.createDataFrame(rows, VOTES), ["i"], "who", "label", list("abc"))
    got = {r["i"]: r["label"] for r in c.items.collect()}
    per = {}
    for i, _, x in rows:
        per.setdefault(i, []).append(x)
    majority = sum(Counter(v).most_common(1)[0][0] == truth[i] for i, v in per.items())
    assert sum(got[i] == truth[i] for i in truth) > majority + 20
    acc = {r["annotator"]: (r["triplet_accuracy"], r["accuracy"]) for r in c.annotators.collect()}
    for who, p in right.items():
        assert abs(acc[who][0] - p) < 0.15 and abs(acc[who][1] - p) < 0.12


def test_consensus_edges(spark):
    rows = [(1, "x", "a"), (1, "y", "a"), (1, None, "b"), (2, "x", "odd"), (3, "x", None), (4, "z", "b")]
    df = spark.createDataFrame(rows, VOTES).withColumns({c: F.lit("clash") for c in ("votes", "annotator", "a", "v")})
    got = {r["i"]: r for r in consensus.consensus(df, ["i"], "who", "label", list("abc")).items.collect()}
    assert set(got) == {1, 4} and got[1]["label"] == "a" and got[1]["agreement"] == 1.0 and got[4]["agreement"] is None
    none = consensus.consensus(df.filter("false"), ["i"], "who", "label", list("abc"))
    assert none.items.count() == 0 and none.annotators.count() == 0


def test_all_pairs_and_triplets(spark, monkeypatch):
    """Large items and annotators with many partners: moments and spreads are those of all pairs and triplets, whatever the blocks."""
    rng = random.Random(4)
    who, k = range(70), 2
    votes = {(i, a): int(rng.random() < (0.3 + 0.4 * (i % 2) if a % 3 else 0.5)) for i in range(12) for a in who if i < 9 or rng.random() < 0.6}
    items = {a: {i for i, x in votes if x == a} for a in who}
    share = {a: [sum(votes[i, a] == z for i in items[a]) / len(items[a]) for z in range(k)] for a in who}
    n = {(a, b): len(items[a] & items[b]) for a in who for b in who if a != b}
    c = {(a, b): [sum(votes[i, a] == votes[i, b] == z for i in items[a] & items[b]) / m - share[a][z] * share[b][z] for z in range(k)] for (a, b), m in n.items()}
    known = spark.createDataFrame([(i, a, v) for (i, a), v in votes.items()], "_item long, a long, v int")
    rates = spark.createDataFrame([(a, share[a]) for a in who], "a long, m array<double>")
    size = {}
    for a in who:
        for z in range(k):
            trips = [(min(n[a, x], n[a, y], n[x, y]), c[a, x][z], c[a, y][z], c[x, y][z]) for x in who for y in who if x < y and a not in (x, y)]
            num = sum(w * p * q * ((r > 0) - (r < 0)) for w, p, q, r in trips)
            size[a, z] = max(0.0, num / sum(w * abs(r) for w, _, _, r in trips)) ** 0.5
    for block in (256, 20):
        monkeypatch.setattr(consensus, "BLOCK", block, raising=False)
        moments = consensus.pair_moments(known, rates, k, len(votes))
        got = {(r["i"], r["j"]): r for r in moments.collect()}
        assert {x: r["n"] for x, r in got.items()} == n
        assert all(abs(got[x][f"c{z}"] - c[x][z]) < 1e-9 for x in n for z in range(k))
        spread = {r["a"]: r for r in consensus.triplet_spread(moments, k).collect()}
        assert all(abs(abs(spread[a][f"s{z}"]) - size[a, z]) < 1e-9 for a in who for z in range(k))


def test_one_vote(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, k + 1) for k in range(5)]
    rows = [(1, "j", 0, "a", t[0]), (1, "j", 0, "b", t[1]), (1, "j", 0, "b", t[1]), (1, "j", 1, "a", t[2]), (1, "j", 2, "a", None), (1, "k", 0, None, t[0])]
    df = spark.createDataFrame(rows, "i long, who string, run int, s string, at timestamp")
    assert [(r["who"], r["s"]) for r in consensus.one_vote_each(df, ["i"], "who", "s", "run", "at").collect()] == [("j", "a")]
    s = spark.createDataFrame([(" Covered.",), ("PARTIAL\n",), ("missing .",), ("covered!",), ("",), (None,)], "s string")
    assert [r[0] for r in s.select(consensus.usable_status(F.col("s"))).collect()] == ["covered", "partial", "missing", None, None, None]


# ---- p2 ------------------------------------------------------------------

PAPER = "seq long, title string, abstract string, authors array<string>, doi string, arxiv_id string, sources array<string>"
FULL = "We measure how often the model fails on long inputs and report results for nine datasets in all."


def paper(seq, title, authors, doi=None, arxiv=None, abstract=None, sources=("s",)):
    return (seq, title, abstract, authors, doi, arxiv, list(sources))


def test_survivors(spark):
    rows = [
        paper(1, "A Study: of x", ["Ann Bell"], "doi:10.5555/REC.1", None, "<p>" + FULL[:70] + "...</p>", (" S1",)),
        paper(2, "a study of x!", ["Bell, Ann"], "10.5555/rec.1", "arXiv:2401.00001v2", FULL.replace(" ", "  "), ("s2", None, "")),
        paper(3, "Renamed", ["A. Bell"], "https://x/10.5555/rec.1", None, FULL),
        paper(4, "A study of x", ["Zed Other"], "10.5555/vol.3.p1", None, "N/A"),
        paper(5, "A study of x", [], None, "2401.00001", "See full text."),
        paper(6, "A study of x", ["Zed Other"], "10.48550/arxiv.2402.00002", "2402.00002", None),
        paper(7, None, None, None, None, None, ()),
        paper(8, "A study of x", ["ANN BELL"], "10.5555/rec.9", None, FULL, ("S1",)),
        paper(9, "", [None, " "], "n/a", "", "  "),
    ]
    df = spark.createDataFrame(rows, PAPER).withColumn("first_seq", F.lit("clash"))
    works = {r["seq"]: r["first_seq"] for r in survivor.group_works(df).collect()}
    assert works == {1: 1, 2: 1, 3: 1, 5: 1, 8: 1, 4: 4, 6: 4, 7: 7, 9: 9}
    got = {r["first_seq"]: r for r in survivor.survivors(df.drop("first_seq")).collect()}
    assert set(got) == {1, 4}
    assert (got[1]["doi"], got[1]["arxiv_id"], got[1]["abstract_seq"], got[1]["sources"]) == ("10.5555/rec.1", "2401.00001", 2, "s,s1,s2")
    assert (got[4]["doi"], got[4]["arxiv_id"], got[4]["abstract_seq"]) == ("10.48550/arxiv.2402.00002", "2402.00002", None)
    assert survivor.survivors(df.drop("first_seq").filter("false")).count() == 0


def test_judged_as_by_hand(spark):
    """The sums by work and field give what a loop over all values and sources gives."""
    import math

    rng = random.Random(3)
    rows = [(w, "f", f"v{rng.randint(0, 2)}", rng.choice("abcd")) for w in range(25) for _ in range(rng.randint(1, 6))]
    facts = Counter((w, v) for w, _, v, _ in rows)
    yes, given = Counter((w, v, s) for w, _, v, s in rows), Counter((w, s) for w, _, _, s in rows)
    p = {(w, v): n / sum(g for (x, _), g in given.items() if x == w) for (w, v), n in facts.items()}
    for _ in range(survivor.ROUNDS):
        tp, t, tn, f = Counter(), Counter(), Counter(), Counter()
        for w, v in facts:
            for (x, s), g in given.items():
                if x == w:
                    y = yes[w, v, s]
                    tp[s], t[s], tn[s], f[s] = tp[s] + p[w, v] * y, t[s] + p[w, v] * g, tn[s] + (1 - p[w, v]) * (g - y), f[s] + (1 - p[w, v]) * g
        sens, spec = {s: (tp[s] + 3) / (t[s] + 4) for s in t}, {s: (tn[s] + 6) / (f[s] + 7) for s in t}
        prior = math.log((1 + sum(t.values())) / (1 + sum(f.values())))
        for w, v in facts:
            score = prior
            for (x, s), g in given.items():
                if x == w:
                    y = yes[w, v, s]
                    score += y * math.log(sens[s] / (1 - spec[s])) + (g - y) * math.log((1 - sens[s]) / spec[s])
            p[w, v] = 1 / (1 + math.exp(-score))
    got = {(r["work"], r["value"]): r["p"] for r in survivor.judge_values(spark.createDataFrame(rows, "work long, field string, value string, source string")).collect()}
    assert got == pytest.approx(p, abs=1e-9)


def test_abstracts_that_go_on_differently(spark):
    """The text that many records give beats a longer one with the same opening; cut texts count for what they begin."""
    other = FULL[:70] + " but then this one goes on in quite another way, and " + "at greater length " * 20
    texts = [other, FULL[:40] + "...", FULL[: len(FULL) - 5] + "...", FULL, FULL]
    rows = [paper(i, "One title", ["Ann Bell"], None, None, t, (f"s{i}",)) for i, t in enumerate(texts, 1)]
    assert [r["abstract_seq"] for r in survivor.survivors(spark.createDataFrame(rows, PAPER)).collect()] == [4]
    full = survivor._full_texts(spark.createDataFrame([(1, t.rstrip(".")) for t in {*texts}] + [(2, other)], "first_seq long, text string"))
    assert {(r["first_seq"], len(r["text"]), r["full"][70:80]) for r in full.collect() if len(r["text"]) == 40} == {(1, 40, FULL[70:80]), (1, 40, other[70:80])}
    assert full.filter("text = full").count() == 3


def test_two_sided_quality(spark):
    rows = [(w, "f", f"v{w}", s) for w in range(30) for s in "abc"] + [(w, "f", f"bad{w}", "d") for w in range(30)]
    rows += [(90, "f", "x", "a"), (90, "f", "y", "d"), (91, "f", None, "a"), (92, "f", "x", None)]
    got = {(r["work"], r["value"]): r["p"] for r in survivor.judge_values(spark.createDataFrame(rows, "work long, field string, value string, source string")).collect()}
    assert got[90, "x"] > 0.9 > 0.5 > got[90, "y"] and got[1, "v1"] > 0.9 > 0.2 > got[1, "bad1"] and (91, None) not in got


# ---- p3 ------------------------------------------------------------------


def test_twins(spark):
    rows = [
        (1, "A  Tool-use: plan", "first_author: Ann B | year: 2020 | venue: V."),
        (2, "a tool use\\n plan!", '{"venue": "v", "Year": "2020.", "first author": "ANN  B"}'),
        (3, "A TOOLUSE PLAN", "venue=v; FIRST-AUTHOR=ann b; year= 2020"),
        (4, "A tooluse plan 2", "venue=v; first_author=ann b; year=2020"),
        (5, "café x", "year: 2021\nvenue: "), (6, "CAFÉ x", "year: 2021"), (7, "...", "year: 1"), (8, "?!", "year: 1"),
        (9, None, "year: 1"), (10, "solo", None), (11, "solo", "not a record"), (12, "solo", "{broken"), (13, "模型", "year: 1"), (14, "模 型", "year: 1"),
    ]
    df = spark.createDataFrame(rows, "hit_id long, title string, record string").withColumns({"raw": F.lit("clash"), "label": F.lit(1), "_key": F.lit(0)})
    got = {r["hit_id"]: r["n_copies"] for r in twins.collapse_copies(df, "hit_id", twins.paper_hit_record(), "title").collect()}
    assert got == {1: 3, 4: 1, 5: 2, 10: 3, 13: 2}
    assert twins.collapse_copies(df.filter("false"), "hit_id", twins.paper_hit_record(), "title").count() == 0


def test_heavy_values(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY_FLOOR", 5)
    rows = [(i, "Same title" if i % 2 else f"t{i}", f"year: {i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "hit_id long, title string, record string")
    got = {r["hit_id"]: r["n_copies"] for r in twins.collapse_copies(df, "hit_id", twins.paper_hit_record(), "title").collect()}
    want = {}
    for i, t, y in rows:
        want.setdefault((t, y), []).append(i)
    assert got == {min(v): len(v) for v in want.values()}


# ---- p4 ------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "t", "hot"), [(0, Fraction(3, 5), 512), (1, Fraction(3, 4), 3)])
def test_similar_pairs(spark, monkeypatch, seed, t, hot):
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "PROBES", 7 if hot == 3 else 4096)
    rng = random.Random(seed)
    bases = [list("abcdefgh"), list("abxyz"), list("pqrstuvwkl")]
    rows = [(i, [x for x in rng.choice(bases) if rng.random() < 0.85] + [rng.choice("mno12345") for _ in range(rng.randint(0, 3))], rng.random() < 0.5) for i in range(150)]
    rows += [(900, None, True), (901, [], False), (902, ["", None], True), (903, ["a", "a", "b", None], False), (904, ["b", "a"], True), (905, ["b", "a", ""], False)]
    df = spark.createDataFrame(rows, "id long, v array<string>, side boolean").withColumn("tokens", F.lit("clash"))
    sets = {i: ({x for x in v or [] if x}, s) for i, v, s in rows}
    for side in (None, "side"):
        got = [(r["item_a"], r["item_b"]) for r in setjoin.similar_pairs(df, "id", "v", t, side).collect()]
        want = {
            (a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if sets[a][0] and sets[b][0] and Fraction(len(sets[a][0] & sets[b][0]), len(sets[a][0] | sets[b][0])) >= t and (side is None or sets[a][1] != sets[b][1])
        }
        assert len(got) == len(set(got)) and set(got) == want
    assert setjoin.similar_pairs(df.filter("false"), "id", "v", t).count() == 0
    links, members = setjoin.similar_classes(df, "id", "v", t)
    first = {r["item"]: r["first_item"] for r in members.collect()}
    linked = {(r["item_a"], r["item_b"]) for r in links.collect()}
    assert first == {i: min(j for j, (x, _) in sets.items() if x == v) for i, (v, _) in sets.items() if v}
    every = {(a, b) for a, b in itertools.combinations(sorted(first), 2) if first[a] == first[b] or (min(first[a], first[b]), max(first[a], first[b])) in linked}
    assert every == {(a, b) for a, b in itertools.combinations(sorted(first), 2) if Fraction(len(sets[a][0] & sets[b][0]), len(sets[a][0] | sets[b][0])) >= t}


@pytest.mark.parametrize(("t", "wider"), [(Fraction(3, 5), 1000), (Fraction(3, 5), 0)])
def test_similar_pairs_in_hot_partitions(spark, monkeypatch, t, wider):
    """Many records around the same few rare values: partitions of three and more tokens, or dealt ones."""
    monkeypatch.setattr(setjoin, "HOT", 4)
    monkeypatch.setattr(setjoin, "PROBES", 9)
    monkeypatch.setattr(setjoin, "WIDER", wider)
    rng = random.Random(11)
    rows = [(i, rng.sample("abcdef", rng.randint(2, 6)) + rng.sample("uvwxyz", rng.randint(0, 3))) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, v array<string>")
    got = [(r["item_a"], r["item_b"]) for r in setjoin.similar_pairs(df, "id", "v", t).collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if Fraction(len({*a[1]} & {*b[1]}), len({*a[1]} | {*b[1]})) >= t}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("t", "hot"), [(Fraction(1, 2), 512), (Fraction(1, 3), 3)])
def test_similar_pairs_at_low_thresholds(spark, monkeypatch, t, hot):
    """Records of one value, and single common tokens in hot partitions."""
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "PROBES", 7 if hot == 3 else 4096)
    rng = random.Random(5)
    rows = [(i, rng.sample("abcdefghij", rng.choice((1, 1, 2, 2, 3, 4, 6))), rng.random() < 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<string>, side boolean")
    for side in (None, "side"):
        got = [(r["item_a"], r["item_b"]) for r in setjoin.similar_pairs(df, "id", "v", t, side).collect()]
        want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if Fraction(len({*a[1]} & {*b[1]}), len({*a[1]} | {*b[1]})) >= t and (side is None or a[2] != b[2])}
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError, match="at_least"):
        setjoin.similar_pairs(df, "id", "v", Fraction(0))


def test_merging():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
        need, low = rng.randint(1, 9), rng.randint(0, 10)
        count = Counter(x for v in lists for x in v if x >= low)
        assert sorted(setjoin._occurs(lists, low, need)) == sorted(x for x, n in count.items() if n >= need)


# ---- p5 ------------------------------------------------------------------


def test_value_counts(spark, monkeypatch):
    monkeypatch.setattr(termcount, "RANGE", 4)
    rng = random.Random(5)
    rows = [(i, [rng.choice([f"V {k}", f" v  {k}\t", None, " ", ""]) for k in (rng.randint(0, 9) for _ in range(rng.randint(0, 6)))]) for i in range(80)] + [(80, None), (81, [])]
    df = spark.createDataFrame(rows, "id long, vs array<string>").withColumn("value", F.lit("clash"))
    clean = {i: [" ".join(x.split()).lower() for x in v or [] if x and x.strip()] for i, v in rows}
    occ, rec = Counter(x for v in clean.values() for x in v), Counter(x for v in clean.values() for x in set(v))
    counts = termcount.value_counts(df, "id", "vs")
    assert {r["value"]: (r["n_occ"], r["n_rec"]) for r in counts.collect()} == {x: (n, rec[x]) for x, n in occ.items()}
    n = termcount.records_with_values(df, "vs")
    assert n.first()["n"] == sum(bool(v) for v in clean.values())
    marked = {r["value"]: r["mark"] for r in termcount.mark_useless(counts, n).collect()}
    assert all(m == ("rare" if rec[x] < 3 else "common") for x, m in marked.items())
    assert termcount.value_counts(df.filter("false"), "id", "vs").count() == 0
    assert termcount.records_with_values(df.filter("false"), "vs").first()["n"] == 0


# ---- p6 ------------------------------------------------------------------

ENTRIES = [
    (1, "dataset", "QuastazarQA", None), (2, "dataset", "QuastazarQA-XL", None), (3, "dataset", "QuastazarQA-T", None), (4, "dataset", "Plondax-T", None), (5, "dataset", "Plondax", None),
    (6, "model", "Brewlyph", None), (7, "model", "Brewlyph-2", None), (8, "model", "Brewlyph-2.5", None), (9, "metric", "Paired Evidence Divergence", "PED"), (10, "dataset", "Plondax-XL", None),
]
TYPED = [
    ("dataset", "the Quastazar QA (subset)", 1), ("dataset", "quastzar-qa_xl corpus", 2), ("dataset", "QUASTAZARQA–T", 3), ("dataset", "Qaustazarqa: held-out questions", 1), ("dataset", "Plondax data", 5),
    ("dataset", "Zemuvobos-XL", 0), ("dataset", "n/a", 0), ("model", "Brewlyph2 (7B)", 7), ("model", "berwlyph-v2.5-8x7b-instruct", 8), ("model", "Brewlyph 70B-chat", 6), ("model", "Brewlyph-3", 0),
    ("metric", "PED", 9), ("metric", "ped [paired  eviidence  divergence]", 9), ("metric", "Paired-Evidence-Divergences (%)", 9), ("metric", "QuastazarQA", 0), ("metric", None, 0), ("odd", "PED", 0), ("metric", " ", 0),
]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_map_values(spark, monkeypatch, limit):
    monkeypatch.setattr(canonmap, "BROADCAST_ENTRIES", limit)
    entries = spark.createDataFrame(ENTRIES, "entry_id long, kind string, name string, short_form string")
    typed = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(TYPED)], "i long, kind string, value string").withColumns({"n": F.lit("clash"), "entry_id": F.lit("clash")})
    got = {r["i"]: r["entry_id"] for r in canonmap.map_values(typed, entries).collect()}
    want = {i: e for i, (_, _, e) in enumerate(TYPED)}
    assert got == want
    assert {r["entry_id"] for r in canonmap.map_values(typed, entries.filter("false")).collect()} == {0}
    assert canonmap.map_values(typed.filter("false"), entries).count() == 0


def test_map_values_by_join_equals_broadcast(spark, monkeypatch):
    """Carried words, sizes, versions, splits known from the whole list only, short forms, and ties by frequency."""
    more = [(11, "dataset", "Vexilorum", "VX"), (12, "dataset", "Vexilorun", "VX"), (13, "dataset", "Tramoline-Prime", None), (14, "dataset", "Orbisect-Prime", None), (15, "metric", "Weighted Overlap", "wo"), (16, "metric", "Worst Overlap", "WO"), (17, "dataset", "  ", " ")]
    more_typed = ["our Quastazar-QA corpus (held out)", "an quastazarQA benchmark dataset", "the plondax data", "tramoline prime", "Tramolin-Prmie", "Orbisect", "Vexilorum", "vexilorun", "VEXILORUN", "Vexi-lorun", "Vexiloruk", "VX", "the VX data", "Plondx xl", "qa", "()", "Quastazarqa-xl: remark"]
    typed = [(k, v) for k, v, _ in TYPED] + [("dataset", v) for v in more_typed] + [("metric", v) for v in ("wo", "Worst overlap", "worst-overlap", "Worst Overlap", "our wieghted overlap metric", "the WO")]
    typed += [("model", v) for v in ("the Brewlyph-2 70b checkpoint", "our brewlyph 2.5 chat", "Brewlyhp v2", "brewlyph 8x7b")]
    entries = spark.createDataFrame(ENTRIES + more, "entry_id long, kind string, name string, short_form string")
    values = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(typed)], "i long, kind string, value string")
    got = []
    for limit in (20_000, 1):
        monkeypatch.setattr(canonmap, "BROADCAST_ENTRIES", limit)
        got.append({typed[r["i"]]: r["entry_id"] for r in canonmap.map_values(values, entries).collect()})
    assert got[0] == got[1]
    assert got[1][("dataset", "the Quastazar QA (subset)")] == 1 and got[1][("dataset", "Vexiloruk")] == 12 and got[1][("metric", "the WO")] == 16
    monkeypatch.setattr(canonmap, "MOST_SPLITS", 1)
    with pytest.raises(ValueError, match="splits"):
        canonmap.map_values(values, entries)


def test_distance_and_deletes():
    assert canonmap.distance("abc", "abc", 2) == 0 and canonmap.distance("abc", "acb", 2) == canonmap.SWAP
    assert canonmap.distance("abc", "abbc", 2) == canonmap.DOUBLE and canonmap.distance("abc", "xbc", 2) == canonmap.OTHER + canonmap.FIRST
    assert canonmap.distance("abc", "xyz", 2) == float("inf")
    rng = random.Random(6)
    for _ in range(300):
        a = "".join(rng.choices("abcdef", k=rng.randint(5, 14)))
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice([[], [rng.choice("abcdef")], [b[i], rng.choice("abcdef")]])
        assert canonmap.deletes(a) & canonmap.deletes("".join(b))


# ---- p7 ------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    e = bpe.PrefixEncoder(open(bpe.RANKS, "rb").read())
    return e, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def test_encoder_is_exact(encoders):
    own, other = encoders
    rng = random.Random(7)
    bits = ["a", "e", "ing", " the", "  ", "\n", "\t", "é", "中文", "🙂", "0", "2024", "\x1c", "\x85", "\xa0", "<|endoftext|>", "'s", "'S", "=", "́", "a" * 90, "-" * 50, "\r\n", "xyzzy", "Qq"]
    for _ in range(1500):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        assert list(own.encode(s)) == other.encode_ordinary(s) and own.count(s) == len(other.encode_ordinary(s))
    for b, r in list(own.ranks.items())[::97]:
        assert base64.b64decode(base64.b64encode(b)) == own.bytes[r]


def test_encode_texts(spark, encoders):
    long = "word " * 30_000 + "x" * 20_000
    rows = [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (4, " \n"), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted((i, encoders[1].encode_ordinary(t or "")) for i, t in rows)
    assert sorted(r["n_tokens"] for r in bpe.count_tokens(df, "doc_id", "text").collect()) == sorted(len(encoders[1].encode_ordinary(t or "")) for _, t in rows)
    assert bpe.encode_texts(df.filter("false"), "doc_id", "text").count() == 0


# ---- p8 ------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([1, 3, 50, 90, 130, 200, 333, 400, 512, 700, 1000, 2500, None, 0])) for i in range(600)] + [(5, 100), (5, 100)]
    df = spark.createDataFrame(sizes, "doc_id long, size0 long").withColumn("kind", F.lit("k"))
    pieces = packing.cut_pieces(df, "doc_id", "size0", F.lit(1000).cast("long")).withColumn("capacity", F.lit(1000).cast("long"))
    out = packing.pack(pieces.select("kind", "doc_id", "piece", "size", "capacity"), "kind", "doc_id").collect()
    used = Counter()
    for r in out:
        used[r["container"]] += r["size"]
    total = sum(s or 0 for _, s in sizes)
    assert sum(used.values()) == total and max(used.values()) <= 1000
    assert {(r["doc_id"], r["piece"]) for r in out} == {(i, p) for i, s in sizes if s for p in range(-(-s // 1000))}
    assert total / (1000 * len(used)) > 0.95
    empty = pieces.filter("false").select("kind", "doc_id", "piece", "size", "capacity")
    assert packing.pack(empty, "kind", "doc_id").count() == 0


def test_bins():
    """No bin overflows, no piece is lost, and there are few more bins than the sizes need."""
    rng = random.Random(10)
    for capacity in (10, 512, 3_000_000):
        for _ in range(40):
            sizes = sorted((min(capacity, max(1, int(capacity * rng.random() ** rng.choice((1, 2, 6))))) for _ in range(rng.randint(0, 300))), reverse=True)
            used = Counter()
            for b, s in zip(packing.fill_bins(sizes, capacity), sizes, strict=True):
                used[b] += s
            assert sum(used.values()) == sum(sizes) and max(used.values(), default=0) <= capacity
            assert len(used) <= 11 / 9 * -(-sum(sizes) // capacity) + sum(s > capacity // 2 for s in sizes) + 1


def test_fill_of_every_budget(spark):
    """The share of space used, by budget; with pieces of more than half a container everything else must fit beside."""
    got = {r["capacity"]: r["fill"] for r in queries.REGISTRY.queries()["p8_fill"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {512, 2048, 8192} and min(got.values()) > 0.96


def test_containers_of_every_budget(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").limit(5).write.parquet(f"{tmp_path}/documents.parquet")
    budgets = spark.range(1, 151).select(F.col("id").cast("int").alias("budget_id"), F.lit("b").alias("budget_name"), (F.col("id") + 500).cast("int").alias("capacity_tokens"))
    budgets.write.parquet(f"{tmp_path}/context_budget.parquet")
    got = queries.REGISTRY.queries()["p8_containers"](spark, str(tmp_path))
    assert got.select("budget_id").distinct().count() == 150


# ---- p9 ------------------------------------------------------------------


def corpus_words(spark):
    return readability.frequent_words(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text")


def test_reading_levels_held_out(spark):
    """Passages left out of the fit get their level; the lists come from the documents, which hold no passage."""
    passages = sorted((r["text"], r["level"]) for r in spark.read.parquet(f"{SF}/graded_passage.parquet").collect())
    listed = corpus_words(spark)
    order = sorted(range(len(passages)), key=lambda i: hashlib.md5(passages[i][0].encode()).hexdigest())
    right = 0
    for fold in range(4):
        out = order[fold::4]
        f = readability.fit([p for i, p in enumerate(passages) if i not in set(out)], listed)
        got = f.level([f.features(passages[i][0])[2] for i in out])[0]
        right += sum(int(x) == passages[i][1] for x, i in zip(got, out, strict=True))
    assert right / len(passages) > 0.95


def test_prose_gate(spark):
    """English prose of subjects that neither passages nor documents know is prose; other languages, tables, logs and code are not."""
    f = readability.fit([(r["text"], r["level"]) for r in spark.read.parquet(f"{SF}/graded_passage.parquet").collect()], corpus_words(spark))
    cooking = "Peel the onions and chop them finely before you melt some butter in a heavy saucepan. Stir the onions over a low flame until they are soft, then pour in the stock and simmer it with the lid on for half an hour. Season the soup with pepper and serve it with toasted bread."
    tenancy = "The tenant shall not assign, sublet or part with possession of the premises or any part thereof without the prior written consent of the landlord, and shall at the expiry of the term yield up the premises in good repair together with all fixtures belonging to the landlord."
    terse = "Assume autoregressive exchangeability. Posterior contraction precludes representational degeneracy. Hence overparameterised ergodicity. Semiparametric superposition: unresolved. Distributional robustness subsumes exchangeability. Assume doubly robust distributional robustness. Hence hierarchical inter-annotator heterogeneity."
    german = "Der Mieter darf die Wohnung ohne die Zustimmung des Vermieters nicht an andere vermieten, und er muss sie am Ende des Vertrags in gutem Zustand mit allen Schlüsseln an den Vermieter zurückgeben, der sie in der Woche danach prüft."
    french = "Nous montrons que les résultats ne changent pas avec la taille du modèle, et que la méthode que nous proposons est plus stable que celles des travaux qui l'ont précédée dans les mêmes conditions de mesure et sur les mêmes données."
    log = "2025-04-10 INFO step=7273 loss=0.66324\n" * 40
    code = "for i in range(10):\n    x[i] = f(x[i], y=i)\n    if x[i] > 3:\n        print(x[i])\n" * 10
    grid = "| model | accuracy | loss |\n| a | 0.5 | 0.1 |\n" * 20
    for t in (cooking, tenancy, terse):
        assert f.features(t)[1]
    for t in (german, french, log, grid, code, "", "the cat sat on the mat"):
        assert not f.features(t)[1]


def test_reading_edges(spark):
    graded = spark.read.parquet(f"{SF}/graded_passage.parquet")
    text = graded.filter("level = 1").first()["text"]
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "   "), (5, '[{"id": 1, "v": 2}]' * 20), (6, "Wir zeigen, dass die Ergebnisse stabil bleiben. " * 20), (7, "short text"), (8, text * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"level": F.lit("clash"), "prose": F.lit(0)})
    both = df.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").withColumns({"level": F.lit(""), "prose": F.lit(0)}))
    got = [r for r in readability.reading_levels(both, "doc_id", "text", graded).collect() if r["doc_id"] < 1000]
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["prose"]} == {1, 8} and {r["level"] for r in got if r["prose"]} == {1}
    assert all(r["level"] is None for r in got if r["doc_id"] in (2, 3, 4))
    assert readability.reading_levels(df.filter("false"), "doc_id", "text", graded).count() == 0
    with pytest.raises(ValueError, match="two levels"):
        readability.reading_levels(df, "doc_id", "text", graded.filter("level = 1"))


# ---- the queries ---------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.REGISTRY.queries()))
def test_query(spark, name):
    import os

    import duckdb

    df = queries.REGISTRY.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if sql := queries.REGISTRY.oracle_sql().get(name):
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        want = [tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall()]
        assert sorted(names) == sorted(df.columns) and sorted(map(repr, rows)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    import os

    folder = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(SF):
        t = spark.read.parquet(f"{SF}/{f}")
        (t if f.startswith(("graded", "context", "canon")) else t.limit(0)).coalesce(1).write.parquet(f"{folder}/{f}")
    return folder


@pytest.mark.parametrize("name", list(queries.REGISTRY.queries()))
def test_empty(spark, empty, name):
    assert queries.REGISTRY.queries()[name](spark, empty).count() == 0
