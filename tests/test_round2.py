"""Limits and special values: many rule nodes, NaN claims, colliding keys, absent classes, early list items, stage rows."""

import math

from pyspark.sql import functions as F

from claimsieve.functions.expr import edge_rank
from claimsieve.operators.classify import prior_correct
from claimsieve.operators.encode import fit_frequencies, freq_encode
from claimsieve.operators.rule import apply_rule, interpolate, locate
from claimsieve.operators.textjobs import markdown_blocks, parse_stages


def test_many_nodes(spark):
    df = spark.createDataFrame([(400.0,), (480.0,), (-5.0,), (9000.0,)], "x double").withColumn("xs", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: i * 10.0))
    ys = F.transform(F.col("xs"), lambda v: v / 10)
    got = locate(df, F.col("xs"), "x").select("x", interpolate(ys).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == {400.0: 40.0, 480.0: 48.0, -5.0: 0.0, 9000.0: 49.0}
    assert df.select(edge_rank("xs", "x").alias("r")).collect()[3]["r"] == 50


def test_nan_and_null_claims_have_no_class(spark):
    curve = "struct<alpha:double,beta:double,gamma:double,xs:array<double>,ys:array<double>>"
    xs = [0.0, 1000.0]
    rule = spark.createDataFrame([((None, None, None, xs, [10.0, 100.0]), (None, None, None, xs, [20.0, 200.0]))], f"lower {curve}, upper {curve}")
    rows = [(1, 500.0, math.nan), (2, math.nan, 5.0), (3, None, 5.0), (4, 500.0, None), (5, 500.0, 1.0), (6, 500.0, 1e6)]
    got = {r["k"]: r["risk_class"] for r in apply_rule(spark.createDataFrame(rows, "k int, payout double, excess double"), rule).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: 0, 6: 2}


def test_pair_keys_do_not_collide_and_are_counted_once(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), ("a", "b_c"), (None, "z"), ("z", None), ("a\\", "b")], "x string, y string")
    keys = {"pair": ["x", "y"], "one": ["x"]}
    out = freq_encode(df, fit_frequencies(df, df, keys, "train"), keys)
    assert {(r["x"], r["y"]): r["pair_freq"] for r in out.collect()} == {("a_b", "c"): 1.0, ("a", "b_c"): 2.0, (None, "z"): None, ("z", None): None, ("a\\", "b"): 1.0}
    assert out._jdf.queryExecution().executedPlan().toString().count("Generate") == 0


def test_absent_class_scores_nothing(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.0, 0.0, 1.0],)], "probability array<double>")
    got = [r["corrected"] for r in prior_correct(df, F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), 1.0).collect()]
    assert [round(x, 6) for x in got[0]] == [0.285714, 0.714286, 0.0] and got[1] == [0.0, 0.0, 1.0]


def test_ordered_items_on_early_lines(spark):
    df = spark.createDataFrame([(1, "1. one\n2. two")], "doc_id int, text string")
    assert [r["kind"] for r in markdown_blocks(df).orderBy("line_no").collect()] == ["ordered", "ordered"]
    assert [r["kind"] for r in markdown_blocks(df, ordered_after=20).collect()] == ["paragraph", "paragraph"]


def test_stage_rows(spark):
    lines = ["| G1 | a b | DONE | x |", "|A20|a | b|PENDING|y|", "| G1 | a | LATER | x |", "G1 | a | DONE | x |", "| G1 |  | DONE | x |", "| X1 | a | DONE | x |"]
    got = parse_stages(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_no int, line string")).collect()
    assert [(r["stage"], r["content"], r["status"], r["artifacts"]) for r in got] == [("G1", "a b", "DONE", "x"), ("A20", "a | b", "PENDING", "y")]
