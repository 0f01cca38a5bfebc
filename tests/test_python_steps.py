"""Steps in Python anywhere in a type, in batches, and what they raise."""

import decimal
import math

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from railframe import types as t
from railframe.functions import udf

BAD = "invalid literal for int() with base 10: '{}'"


INT = t.String.transform(t.Integer, t.python_step(lambda s: int(s), T.LongType(), (ValueError,)))


def judged(spark, rows, ddl, kind):
    return [r.asDict(True) for r in t.validate(spark.createDataFrame(rows, ddl), kind).collect()]


def errors(row):
    return [(e["path"], e["message"]) for e in row["errors"]]


def test_in_arrays_and_maps(spark):
    kind = t.Hash(a=t.Array[INT], n=t.Array[t.Array[INT]], m=t.Hash[t.String, INT], h=t.Array[t.Hash(x=INT, y=t.String)])
    rows = [
        (["1", "x", None], [["4"], ["y", "6"], [], None], {"a": "1", "b": "z"}, [("5", "k"), ("q", None)]),
        ([], [], {}, []),
        (["7"], [[], ["8", "9"]], {"c": "3"}, [("10", "l")]),
        (None, None, None, None),
    ]
    a, b, c, d = judged(spark, rows, "a array<string>, n array<array<string>>, m map<string,string>, h array<struct<x:string,y:string>>", kind)
    assert errors(a) == [("a[1]", BAD.format("x")), ("a[2]", "Must be a String"), ("n[1][0]", BAD.format("y")), ("n[3]", "must be an Array"), ("m[b]", BAD.format("z")), ("h[1].x", BAD.format("q")), ("h[1].y", "Must be a String")]
    assert a["a"] == [1, None, None] and a["n"] == [[4], None, [], None] and a["m"] is None
    assert b["ok"] and b["a"] == [] and b["n"] == [] and b["m"] == {} and b["h"] == []
    assert c["ok"] and c["a"] == [7] and c["n"] == [[], [8, 9]] and c["m"] == {"c": 3} and c["h"] == [{"x": 10, "y": "l"}]
    assert not d["ok"] and [p for p, _ in errors(d)] == ["a", "n", "m", "h"]


def test_keys_tails_choices_tuples_and_filtered(spark):
    upper = t.String.transform(t.String, t.python_step(str.upper, T.StringType()))
    kind = t.Hash(
        m=t.Hash[upper, t.Array[INT]].filtered(),
        a=t.Array[INT].filtered(),
        c=t.Array[t.Value["-"].transform(t.Integer, lambda c: c.try_cast("bigint")) | INT | t.Static[-1]],
        u=t.Tuple[INT, upper],
        r=t.Hash({"k": INT, "_": INT}),
    )
    rows = [({"x": ["1"], "y": ["b"]}, ["1", "b", "2"], ["5", "-", "b"], ["1", "q"], {"k": "1", "l": "2"}), ({}, [], [], ["1", "q"], {"k": "1", "l": "z"})]
    a, b = judged(spark, rows, "m map<string,array<string>>, a array<string>, c array<string>, u array<string>, r map<string,string>", kind)
    assert a["m"] == {"X": [1]} and a["a"] == [1, 2] and a["c"] == [5, -1, -1] and a["u"] == {"_0": 1, "_1": "Q"} and a["ok"]
    assert a["r"] == {"k": 1, "_": {"l": 2}} and errors(b) == [("r.l", BAD.format("z"))]


def test_chains_of_steps(spark):
    plus = lambda n: t.python_step(lambda x, n=n: x + n, T.LongType())
    long_ = INT
    for n in range(4):
        long_ = long_.transform(t.Integer, plus(n)) >> t.Integer[t.between(0, 1000)]
    kind = t.Hash(v=long_, a=t.Array[long_])
    a, b = judged(spark, [("5", ["1", "2"]), ("999", ["x", "994", "995"])], "v string, a array<string>", kind)
    assert a["ok"] and a["v"] == 11 and a["a"] == [7, 8]
    assert errors(b) == [("v", "Must be within 0..1000"), ("a[0]", BAD.format("x")), ("a[2]", "Must be within 0..1000")]


def test_batches_hold_the_values_of_many_rows(spark, tmp_path):
    def doubled(a):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(f"{len(a)}\n")
        return pc.multiply(a, 2)

    kind = t.Hash(a=t.Array[t.Array[t.Integer.transform(t.Integer, t.batch_step(doubled, T.LongType()))]])
    df = spark.range(1, 101, numPartitions=1).selectExpr("array(array(id, id + 1), array(), array(id)) AS a")
    assert [r["a"] for r in t.filtered(df, kind).collect()] == [[[2 * i, 2 * i + 2], [], [2 * i]] for i in range(1, 101)]
    assert [int(n) for n in open(f"{tmp_path}/calls").read().split()] == [300]


def test_batches_that_fail_are_halved(spark):
    def roots(a):
        return [math.sqrt(x) for x in a.to_pylist()]

    kind = t.Hash(a=t.Array[t.Float.transform(t.Float, t.batch_step(roots, T.DoubleType()))].policy(rescue=ValueError))
    a, b = judged(spark, [([4.0, -1.0, 9.0, -2.0],), ([16.0],)], "a array<double>", kind)
    assert [p for p, _ in errors(a)] == ["a[1]", "a[3]"] and a["a"] == [2.0, None, 3.0, None] and b["a"] == [4.0] and b["ok"]
    calls = []

    def picky(a):
        calls.append(len(a))
        if 777 in a.to_pylist():
            raise KeyError(777)
        return a

    made, said = udf.together(picky, pa.array(range(1000)), (KeyError,))
    assert made == [i if i != 777 else None for i in range(1000)] and [i for i, s in enumerate(said) if s] == [777] and len(calls) < 25


def test_only_named_exceptions_are_rescued(spark):
    def nope(v):
        if v != 10:
            raise ArithmeticError("nope")
        return v

    kind = t.Hash(v=t.Integer.build(t.Integer, t.python_step(nope, T.LongType())))
    rescued = t.Hash(v=kind.at_key("v").policy(rescue=ArithmeticError))
    assert [(r["ok"], errors(r)) for r in judged(spark, [(10,), (11,)], "v long", rescued)] == [(True, []), (False, [("v", "nope")])]
    several = t.Hash(v=kind.at_key("v").rescue(KeyError, ArithmeticError))
    assert [r["ok"] for r in judged(spark, [(10,), (11,)], "v long", several)] == [True, False]
    for wrong in (kind, t.Hash(v=kind.at_key("v").policy(rescue=KeyError))):
        with pytest.raises(Exception, match="nope"):
            judged(spark, [(11,)], "v long", wrong)
    with pytest.raises(TypeError):
        t.String.policy(rescue="ValueError")
    assert rescued.at_key("v").output_type <= t.Integer


def test_checks_and_step_classes_in_python(spark):
    class Doubled(t.Step):
        takes, gives, in_python = t.Integer, t.Integer, True

        def apply(self, v):
            if v > 100:
                raise OverflowError(f"{v} is too much")
            return 2 * v

    prime = t.Integer.check(t.python_step(lambda n: n > 1 and all(n % d for d in range(2, n)), T.BooleanType()), "must be prime")
    kind = t.Hash(p=t.Array[prime], d=t.Array[Doubled()].rescue(OverflowError))
    a, b = judged(spark, [([2, 4, 7], [1, 101]), ([11], [50])], "p array<long>, d array<long>", kind)
    assert errors(a) == [("p[1]", "must be prime"), ("d[1]", "101 is too much")] and a["d"] == [2, None]
    assert b["ok"] and b["d"] == [100] and b["p"] == [11]


def test_values_of_many_types(spark):
    same = lambda kind, dtype: t.Array[kind.transform(kind, t.python_step(lambda v: v, dtype))]
    kind = t.Hash(d=same(t.Decimal, T.DecimalType(38, 18)), t=same(t.Time, T.TimestampType()), y=same(t.Date, T.DateType()), b=same(t.Boolean, T.BooleanType()))
    df = spark.sql("SELECT array(cast(1.5 AS decimal(38,18))) AS d, array(timestamp '2024-02-03 04:05:06') AS t, array(date '2024-02-29') AS y, array(true, false) AS b")
    got = t.validate(df, kind)
    assert got.select("d", "t", "y", "b").collect() == df.collect() and got.first()["ok"] and df.first()["d"] == [decimal.Decimal("1.5")]
    json = t.Hash(v=t.Array[t.Anything.transform(t.String, t.python_step(lambda v: repr(v), T.StringType()))])
    df = spark.sql("""SELECT parse_json('{"v": [1, "a", {"b": null}, [2.5]]}') AS j""")
    assert t.validate(df, t.Hash(j=json)).first()["j"]["v"] == ["1", "'a'", "{'b': None}", "[2.5]"]


NESTED = st.lists(st.none() | st.lists(st.none() | st.lists(st.integers(-9, 9), max_size=3), max_size=3), max_size=5)


@settings(max_examples=60, deadline=None)
@given(NESTED, st.integers(0, 3))
def test_lists_are_closed_as_they_were(rows, cut):
    a = pa.array(rows, pa.list_(pa.list_(pa.int64())))[min(cut, len(rows)) :]
    flat, lengths = udf.opened(a, 2)
    assert udf.closed(flat, lengths).to_pylist() == a.to_pylist()


def test_clashing_names_are_refused_or_replaced(spark):
    df = spark.createDataFrame([(1, "a", "b")], "v long, ok string, errors string")
    with pytest.raises(ValueError, match="ok"):
        t.validate(df, t.Integer, "v")
    assert t.validate(df, t.Integer, "v", ok="fine", errors="said").columns == ["ok", "errors", "v", "fine", "said"]
    with pytest.raises(ValueError, match="errors"):
        t.validate(df, t.Hash(v=t.Integer, errors=t.String))
    bad = t.invalid(df, t.String, "v")
    assert bad.columns == ["v", "ok", "errors"] and bad.first()["errors"][0]["message"] == "Must be a String"
