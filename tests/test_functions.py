"""Typed functions, and the checks between them that their types make needless."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railframe import types as t
from railframe.plans import nodes as N


def judged(spark, values, ddl, kind):
    return [(r["ok"], r["v"], [e["message"] for e in r["errors"]]) for r in t.validate(spark.createDataFrame([(v,) for v in values], f"v {ddl}"), kind, "v").collect()]


def test_functions_have_both_types(spark):
    length = t.Function[t.String, t.Integer[t.between(1)]](lambda c: F.length(c).cast("bigint"))
    assert length.input_type == t.String and length.output_type <= t.Integer and not length.output_type <= t.String
    assert judged(spark, ["abc", "", None], "string", length) == [(True, 3, []), (False, 0, ["Must be within 1.."]), (False, None, ["Must be a String"])]
    assert t.Function[t.String, t.String]() == t.String and t.Function[t.String]() == t.String
    with pytest.raises(TypeError, match="needs one"):
        t.Function[t.String, t.Integer]()
    with pytest.raises(t.TypeMismatch):
        length >> t.Function[t.String, t.String](F.upper)


def test_opaque_functions_are_not_checked(spark):
    double = t.Function.opaque(lambda c: c * 2, "double")
    assert judged(spark, [2, None], "long", double) == [(True, 4, []), (True, None, [])]
    assert judged(spark, [2, None], "long", t.Integer >> double) == [(True, 4, []), (False, None, ["Must be a Integer"])]
    assert t.Function[t.Anything, t.Anything](double.fn).guaranteed
    assert judged(spark, ["abc"], "string", t.String >> F.length >> t.Integer[3]) == [(True, 3, [])]


def test_functions_that_prove_each_other_share_one_check(spark):
    small, plus = t.Integer[t.between(0, 100)], lambda c: c + 40
    first, second = t.Function[t.Integer, small](plus), t.Function[t.Integer[t.between(-5, 500)], small](plus)
    both = first >> second
    assert type(both) is N.Convert and both.inp == first
    assert judged(spark, [1, 50, 70, None], "long", both) == [(True, 81, []), (False, 130, ["Must be within 0..100"]), (False, None, ["Must be within 0..100"]), (False, None, ["Must be a Integer"])]
    open_ = t.Function[t.Integer, t.Integer](plus) >> t.Function[small, t.Integer](plus)  # not proven: checked between
    assert [r[0] for r in judged(spark, [1, 70], "long", open_)] == [True, False]
    text = both >> t.Function[t.Integer, t.String](t.python_step(hex, T.StringType()))
    assert judged(spark, [1], "long", text) == [(True, "0x51", [])]


def test_filters_of_long_chains_are_generated_code(spark, capsys):
    size = t.Lax.Integer
    for _ in range(6):
        size = size.transform(t.Integer, lambda c: c + 1).check(lambda c: c < 100, "too large")
    df = spark.createDataFrame([("1", 1), ("94", 2), ("93", 3), ("x", 4), (None, 5)], "size string, col int")
    kind = t.Hash(size=size, col=t.Integer)
    kept, left = t.filtered(df, kind), t.invalid(df, kind)
    assert sorted(map(tuple, kept.collect())) == [(7, 1), (99, 3)]
    assert sorted(r["col"] for r in left.collect()) == [2, 4, 5] and all(r["errors"] for r in left.collect())
    for found in (kept, left):  # a lambda is interpreted, row by row
        found.explain()
        assert "transform(" not in capsys.readouterr().out
