import pytest
from pyspark.sql import functions as F

from citegrove.functions import text
from citegrove.functions.html import html_to_text
from citegrove.functions.rules import FAMILIES, GENERIC_CLASSES


def values(spark, rows, column, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_titles_and_keys(spark):
    got = values(spark, ["A\\n Tale:  of TWO", "", None, "Ümlaut-x_y"], text.normalize_title(F.col("a")))
    assert got == ["a tale of two", "", "", "mlaut x y"]
    assert values(spark, ["Ab-C 1", None], text.squash(F.col("a"))) == ["abc1", None]
    df = spark.createDataFrame([(" 10.1/X ", "", "T"), ("", "2401.1", "T"), (None, None, "A b!")], "d string, x string, t string")
    assert [r[0] for r in df.select(text.dedup_key(F.col("d"), F.col("x"), F.col("t"))).collect()] == ["doi:10.1/x", "arxiv:2401.1", "title:a b"]
    df = spark.createDataFrame([("T", ["Ann B"]), ("T", []), ("", ["A"]), (None, None)], "t string, a array<string>")
    assert [r[0] for r in df.select(text.version_key(F.col("t"), F.col("a"))).collect()] == ["t|ann b", "", "", ""]


def test_stem_and_words(spark):
    words = ["editing", "editor", "edits", "baselines", "baseline", "ties", "as", "using"]
    assert values(spark, words, text.stem(F.col("a"))) == ["edit", "edit", "edit", "baselin", "baselin", "tie", "as", "using"]
    assert [sorted(x) for x in values(spark, ["Editing the editors", None], text.content_words(F.col("a")))] == [["edit"], []]
    assert [sorted(x) for x in values(spark, ["The art of RL2 a", None], text.taxonomy_tokens(F.col("a")))] == [["art", "rl2"], []]
    assert values(spark, ["GPT-4 at a-b cd"], text.bm25_tokens(F.col("a"))) == [["gpt-4", "a-b"]]


@pytest.mark.parametrize(
    ("name", "canon"),
    [
        ("Llama-3.1-70B (chat)", "Llama-3"), ("GPT-3.5", "GPT-3.5"), ("Mixtral 8x7B", "Mixtral"), ("DeepSeek-R1", "DeepSeek"), ("transformers", ""),
        ("IKE (In-Context Editing)", "IKE"), ("", ""), (None, ""), ("Qwen 72B", "Qwen"),
    ],
)
def test_canon_model(spark, name, canon):
    assert values(spark, [name], text.canon_model(F.col("a"), FAMILIES, GENERIC_CLASSES)) == [canon]


def test_canon_generic_and_aliases(spark):
    assert values(spark, ["AdvBench: Harmful", "AdvBench (subset)", "(all)", "A-CF.", None], text.canon_generic(F.col("a"))) == ["AdvBench", "AdvBench", "(all)", "A-CF", ""]
    assert values(spark, ["KN (Knowledge Neurons)", "Model (7B)", "x"], text.alias_set(F.col("a"))) == [["kn", "knknowledgeneurons", "knowledgeneurons"], ["model", "model7b"], []]


def test_word_contains(spark):
    df = spark.createDataFrame([("a map of rl", "rl"), ("curl", "rl"), ("c++ code", "c++"), ("x", ""), ("x", None)], "t string, k string")
    assert [r[0] for r in df.select(text.word_contains(F.col("t"), F.col("k"))).collect()] == [True, False, True, False, False]


def test_small_functions(spark):
    assert values(spark, ["m+nocard", "m+rag", "m+retr", "m+card:x", "Z", None], text.arm_base(F.col("a"))) == ["nocard", "rag", "retrieval", "card", "z", ""]
    assert values(spark, ["u?api_key=abc&x=1", "token=q p"], text.redact(F.col("a"))) == ["u?api_key=<redacted>&x=1", "token=<redacted> p"]
    assert values(spark, ["my abcdefgh here"], text.redact(F.col("a"), {"KEY": "abcdefgh"})) == ["my <KEY:redacted> here"]
    assert values(spark, ["- a\n\nb \n- a"], text.distinct_lines(F.col("a"))) == [["a", "b"]]
    assert values(spark, ['```json\n{"a": 1}\n```', 'x {"b": 2} y', "say [1, 2]", "none", None], text.json_candidates(F.col("a"))) == ['{"a": 1}', '{"b": 2}', "[1, 2]", None, None]
    df = spark.createDataFrame([("1_2", "c0"), ("1.2", "c3")], "p string, c string")
    assert [r[0] for r in df.select(text.problem_id(F.col("p"), F.col("c"))).collect()] == ["1_2", "1_2_c3"]
    df = spark.createDataFrame([(10, 2026), (10, 2017), (10, None), (None, 2030)], "c long, y int")
    assert [round(r[0], 4) for r in df.select(text.authority(F.col("c"), F.col("y"), 2026)).collect()] == [2.3979, 0.6931, 1.1989, 0.0]
    assert values(spark, [["x", " Method Comparison"], None], text.claim_types(F.col("a")), "a array<string>") == [["method comparison"], []]


def test_html():
    page = '<html><nav>no</nav><article><h2>Top</h2><p>a &amp; b<br>c</p><table><tr><td>1</td><td>2</td></tr></table><math alttext="x^2"><mi>x</mi></math><div class="ltx_bibliography">refs</div></article>tail</html>'
    got = html_to_text(page)
    assert "no" not in got and "refs" not in got and "tail" not in got
    assert got.startswith("## Top") and "a & b\nc" in got and "1 | 2 |" in got and "x^2" in got
    assert html_to_text(None) is None and html_to_text("") == ""
