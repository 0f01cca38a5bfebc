"""Validity, values and errors of types on small tables; one Spark job for each table of cases."""

import datetime
import decimal
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railframe import types as t
from railframe.plans import nodes as N


def judged(spark, of, values, ddl):
    """(ok, value, messages) of each value in a column of one type."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    rows = sorted(t.validate(df, of, "v").collect(), key=lambda r: r["i"])
    return [(r["ok"], r["v"], [e["message"] for e in r["errors"]]) for r in rows]


def from_json(spark, of, texts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string").withColumn("v", F.try_parse_json("v"))
    rows = sorted(t.validate(df, of, "v").collect(), key=lambda r: r["i"])
    return [(r["ok"], r["v"], [(e["path"], e["message"]) for e in r["errors"]]) for r in rows]


SCALARS = [
    ("any", t.Anything, "int", [(1, True), (None, True)]),
    ("never", t.Nothing, "int", [(1, False), (None, False)]),
    ("string", t.String, "string", [("a", True), (None, False)]),
    ("string of int", t.String, "int", [(1, False)]),
    ("integer of string", t.Integer, "string", [("a", False)]),
    ("integer of float", t.Integer, "double", [(1.0, False)]),
    ("numeric", t.Numeric, "double", [(1.5, True), (None, False)]),
    ("boolean", t.Boolean, "boolean", [(True, True), (False, True), (None, False)]),
    ("true", t.true, "boolean", [(True, True), (False, False)]),
    ("nil", t.Nil, "int", [(None, True), (1, False)]),
    ("email", t.Email, "string", [("a@b.com", True), ("nope", False), ("a@b\nc", False)]),
    ("uuid", t.UUID4, "string", [("9f5a5b0a-1b3d-4c5e-8f7a-2b3c4d5e6f70", True), ("nope", False)]),
    ("from", t.Integer[t.between(18)], "int", [(18, True), (17, False), (None, False)]),
    ("stacked", t.Integer[t.between(0, 100)][t.between(10)], "int", [(10, True), (100, True), (9, False), (101, False)]),
    ("slice", t.Integer[0:10], "int", [(0, True), (9, True), (10, False)]),
    ("float bound on integers", t.Integer[t.between(0.5, 2.5)], "int", [(1, True), (0, False), (3, False)]),
    ("set", t.Integer[1, 2, 3], "int", [(2, True), (4, False)]),
    ("pattern", t.String[re.compile("^a")], "string", [("abc", True), ("bcd", False), ("b\nab", True)]),
    ("size", t.String.where(size=t.between(1, 3)), "string", [("ab", True), ("abcd", False)]),
    ("sizes meet", t.String.where(size=t.between(0, 40)).where(size=t.between(10, 100)), "string", [("a" * 20, True), ("a" * 5, False), ("a" * 50, False)]),
    ("check", t.String.check(lambda c: c.startswith("a"), "must start with a"), "string", [("abc", True), ("bcd", False)]),
    ("value", t.Anything.value(5), "double", [(5.0, True), (6.0, False)]),
    ("literal of another kind", t.Value["a"], "int", [(1, False)]),
    ("choice", t.String | t.Integer, "int", [(1, True), (None, False)]),
    ("absorbed", t.Integer | t.Numeric, "double", [(1.5, True)]),
    ("ranges meet", t.Integer[t.between(2)] & t.Integer[t.between(0, 100)], "int", [(50, True), (1, False), (101, False)]),
    ("nothing in common", t.Integer[t.between(2, 10)] & t.Integer[t.between(11, 100)], "int", [(5, False), (50, False)]),
    ("both at run time", t.String.where(size=t.between(1, 3)) & t.String[re.compile("a")], "string", [("ab", True), ("b", False), ("abcd", False)]),
    ("reduced sequence", t.Integer[t.between(0, 100)] >> t.Integer[t.between(-10, 110)], "int", [(50, True), (101, False)]),
    ("unchecked", t.String / t.String[re.compile("a")], "string", [("a", True), ("b", False)]),
    ("not", ~t.String, "int", [(1, True)]),
    ("not a range", ~t.Integer[t.between(1, 5)], "int", [(3, False), (9, True)]),
    ("interface", t.Interface["upcase"], "string", [("a", True)]),
    ("interface of int", t.Interface["upcase"], "int", [(1, False)]),
    ("present", t.String.present(), "string", [("a", True), ("", False), (" ", True)]),
    ("nullable", t.Integer.nullable(), "int", [(None, True), (1, True)]),
    ("options", t.Integer.options([1, 2]), "int", [(1, True), (3, False)]),
    ("excluded", t.Integer.excluded_from([1, 2]), "int", [(1, False), (3, True)]),
    ("metadata", t.String.metadata(label="Name"), "string", [("a", True)]),
    ("respond_to", t.Anything.policy(respond_to="upcase"), "string", [("a", True)]),
    ("dates", t.Date[t.between(datetime.date(2024, 1, 1), datetime.date(2024, 12, 31))], "date", [(datetime.date(2024, 5, 1), True), (datetime.date(2023, 5, 1), False)]),
    ("year", t.Date.where(year=t.between(2000, 2020)), "date", [(datetime.date(2010, 1, 1), True), (datetime.date(2024, 1, 1), False)]),
    ("missing attribute", t.Integer.where(size=3), "int", [(3, False)]),
    ("array", t.Array[t.Integer], "array<int>", [([1, 2], True), ([], True), ([None], False), (None, False)]),
    ("array of refined", t.Array[t.Integer] & t.Array[t.Integer[t.between(0, 10)]], "array<int>", [([1, 2], True), ([20], False)]),
    ("array size", t.Array.where(size=t.between(1, 2)), "array<int>", [([1], True), ([], False)]),
    ("array options", t.Array[t.Integer].options([1, 2]), "array<int>", [([1, 2, 1], True), ([1, 3], False)]),
    ("map", t.Hash[t.String, t.Integer[t.between(0)]], "map<string,int>", [({"a": 1}, True), ({"a": -1}, False), (None, False)]),
    ("tuple", t.Tuple[t.String, t.String["a", "b"]], "array<string>", [(["x", "a"], True), (["x", "c"], False), (["x"], False), (None, False)]),
    ("range", t.Range[t.Integer[t.between(0)]], "struct<from:int,to:int>", [((1, 2), True), ((None, 2), True), ((-1, 2), False), (None, False)]),
    ("static", t.Integer.static(10), "string", [("x", True)]),
]


@pytest.mark.parametrize("name,of,ddl,cases", SCALARS, ids=[c[0] for c in SCALARS])
def test_validity(spark, name, of, ddl, cases):
    got = judged(spark, of, [v for v, _ in cases], ddl)
    assert [ok for ok, _, _ in got] == [ok for _, ok in cases]
    assert all(bool(errors) != ok for ok, _, errors in got)


CONVERSIONS = [
    ("to_i", t.String.transform(t.Integer, "to_i"), "string", [("12", 12), ("3x", 3), ("x", 0), ("-1_000", -1000)]),
    ("to_f", t.String.transform("to_f"), "string", [("1.5e2", 150.0), ("x", 0.0)]),
    ("trim then size", t.String.transform(t.String, F.trim).where(size=t.between(1, 3)), "string", [("  ab  ", "ab")]),
    ("invoke", t.String.invoke(["strip", "upcase"]), "string", [("  ab ", "AB")]),
    ("split", t.String.split(), "string", [("a,b,c", ["a", "b", "c"]), ("a, b", ["a", "b"]), ("a,,", ["a"]), ("", []), (",a", ["", "a"])]),
    ("split at a dot", t.String.split("."), "string", [("a.b.", ["a", "b"])]),
    ("choice converts", t.Integer | t.String.transform(t.Integer, "to_i"), "string", [("2", 2)]),
    ("lax integer of text", t.Lax.Integer, "string", [("2", 2), ("1,200", 1200), ("2.7", 2)]),
    ("lax integer of float", t.Lax.Integer, "double", [(2.7, 2), (-2.7, -2)]),
    ("lax integer of integer", t.Lax.Integer, "int", [(1, 1)]),
    ("lax string of float", t.Lax.String, "double", [(1.5, "1.5"), (1e20, "1.0e+20"), (1e7, "10000000.0"), (123456789.25, "123456789.25"), (1e-5, "1.0e-05"), (0.0005, "0.0005"), (-2.5e-7, "-2.5e-07"), (1e15, "1000000000000000.0"), (0.0, "0.0"), (1e16, "1.0e+16")]),
    ("lax string of decimal", t.Lax.String, "decimal(10,4)", [(decimal.Decimal("1.5000"), "1.5"), (decimal.Decimal("2.0000"), "2.0")]),
    ("lax decimal", t.Lax.Decimal, "string", [("1,200.5", decimal.Decimal("1200.5"))]),
    ("date", t.Encoder(t.String, t.Date, lambda c: c.try_cast("date"), lambda c: c.cast("string")).decoding(), "string", [("2024-01-02", datetime.date(2024, 1, 2))]),
    ("filtered array", t.Array[t.Lax.Integer].filtered(), "array<string>", [(["1", "x", "3"], [1, 3])]),
    ("array converts", t.Array[t.Lax.Integer], "array<string>", [(["1", "2"], [1, 2])]),
    ("filtered map", t.Hash[t.String, t.Integer[t.between(0)]].filtered(), "map<string,int>", [({"a": 1, "b": -1}, {"a": 1})]),
    ("map converts", t.Hash[t.String.invoke("upcase"), t.Lax.Integer], "map<string,string>", [({"a": "1"}, {"A": 1})]),
]


@pytest.mark.parametrize("name,of,ddl,cases", CONVERSIONS, ids=[c[0] for c in CONVERSIONS])
def test_values(spark, name, of, ddl, cases):
    got = judged(spark, of, [v for v, _ in cases], ddl)
    assert [(ok, v) for ok, v, _ in got] == [(True, v) for _, v in cases]


def test_failed_conversions_are_errors(spark):
    assert [ok for ok, _, _ in judged(spark, t.Lax.Integer, ["x", "-5", "1,2", None, "9" * 30], "string")] == [False] * 5
    assert [ok for ok, _, _ in judged(spark, t.FORMS.decoder(t.Boolean), ["yes", "TRUE", "0", ""], "string")] == [False, True, True, False]
    assert [ok for ok, _, _ in judged(spark, t.FORMS.decoder(t.Date), ["2024-1-5", "2024-02-30", "2024-02-29"], "string")] == [False, False, True]


def test_messages(spark):
    said = lambda of, v, ddl: judged(spark, of, [v], ddl)[0][2]
    assert said(t.String, 1, "int") == ["Must be a String"]
    assert said(t.Integer[t.between(1, 3)], 5, "int") == ["Must be within 1..3"]
    assert said(t.Integer[1, 2], 5, "int") == ["Must be included in [1, 2]"]
    assert said(t.String | t.Integer[t.between(0)], -1, "int") == ["Must be a String", "Must be within 0.."]
    assert said(t.String.present(), "", "string") == ["must be present"]
    assert said(t.String.invalid("no text"), "x", "string") == ["no text"]
    assert said(t.Integer.options([1, 2]), 3, "int") == ["must be included in [1, 2]"]


def test_records_gather_errors(spark):
    df = spark.createDataFrame([("a", 1, 9), (None, -1, 9)], "name string, age int, extra int")
    person = t.Hash({"name": t.String, "age": t.Integer[t.between(0)], "nick?": t.String, "role": t.String.default("user"), "gone": t.Integer})
    rows = t.validate(df, person).collect()
    assert rows[0].asDict().keys() == {"name", "age", "role", "ok", "errors"}
    assert [(e["path"], e["message"]) for e in rows[1]["errors"]] == [("name", "Must be a String"), ("age", "Must be within 0.."), ("gone", "Must be a Integer")]
    kept = t.Hash({"name": t.String, "age": t.Integer})
    assert t.filtered(df, kept).collect() == [("a", 1)]
    good, bad = t.split(df, kept)
    assert good.count() == bad.count() == 1 and bad.columns == ["name", "age", "extra", "errors"]
    with pytest.raises(Exception, match="Must be a String"):
        t.parse(df, kept).collect()
    assert t.parse(df.where("name = 'a'"), kept).first() == ("a", 1)
    nested = t.Hash(title=t.String, friend=t.Hash(name=t.String["x"]))
    row = t.validate(spark.createDataFrame([("t", ("y",))], "title string, friend struct<name:string>"), nested).first()
    assert [(e["path"]) for e in row["errors"]] == ["friend.name"] and not row["ok"]


def test_json_values(spark):
    record = t.Hash({"name": t.String, "age?": t.Lax.Integer, "tags": t.Array[t.String].nullable()})
    got = from_json(spark, record, ['{"name": "a", "age": "3", "tags": null, "x": 1}', '{"name": 1, "tags": ["a", 2]}', '{"name": "b", "tags": []}', "[1]", "null", None, "{"])
    assert [g[0] for g in got] == [True, False, True, False, False, False, False]
    assert got[0][1]["age"] == 3 and got[2][1]["age"] is None and got[2][1]["tags"] == []
    assert ("name", "Must be a String") in got[1][2] and ("tags[1]", "Must be a String") in got[1][2]
    assert got[3][2] == [("", "must be a Hash")]
    default = t.Hash(role=t.String.default("user"))
    got = from_json(spark, default, ["{}", '{"role": "x"}', '{"role": null}'])
    assert [g[0] for g in got] == [True, True, False] and got[0][1]["role"] == "user"
    shut = t.Hash({"name": t.String, "_": t.Nothing})
    assert [g[0] for g in from_json(spark, shut, ['{"name": "a"}', '{"name": "a", "b": 1}'])] == [True, False]
    kinds = [(t.Integer, [True, False, False, False]), (t.Float, [False, True, False, False]), (t.Numeric, [True, True, False, False]), (t.String, [False, False, True, False]), (t.Nil, [False] * 3 + [True])]
    for of, want in kinds:
        assert [g[0] for g in from_json(spark, t.Hash(v=of), ['{"v": 5}', '{"v": 5.7}', '{"v": "5"}', '{"v": null}'])] == want


def linked():
    return t.Hash(value=t.Integer, next=t.Nil | t.defer(linked))


def test_types_that_hold_themselves(spark):
    deep = '{"value": 1, "next": ' * 12 + "null" + "}" * 12
    got = from_json(spark, t.defer(linked), ['{"value": 1, "next": null}', '{"value": 1, "next": {"value": "x", "next": null}}', '{"value": 1, "next": {"value": 2, "next": null}}', '{"value": 1}', deep])
    assert [g[0] for g in got] == [True, False, True, False, False]
    assert t.defer(linked) <= t.defer(linked)


def test_structs(spark):
    class Staff(t.Struct):
        name = t.attribute(t.String)
        age = t.attribute(t.Lax.Integer >> t.Integer[t.between(18)], writer=True)

    class Manager(Staff):
        reports = t.attribute(t.Integer, optional=True)

    assert list(Manager.attributes) == ["name", "age", "reports"] and Manager.of() <= Staff.of() and not Staff.of() <= t.Hash(x=t.String)
    df = spark.createDataFrame([("a", "20"), ("b", "7")], "name string, age string")
    assert [r["ok"] for r in t.validate(df, Staff.of()).collect()] == [True, False]
    assert [r["ok"] for r in Staff.set(df, "age", F.lit("30")).collect()] == [True, True]
    with pytest.raises(AttributeError):
        Staff.set(df, "name", F.lit("x"))


def test_pipelines_and_policies(spark):
    seen = []

    def loud(step):
        seen.append(step)
        return step

    steps = t.Anything.pipeline().step(t.String).around(loud).step(t.String.invoke("upcase")).step_checked(t.String.where(size=2))
    assert len(seen) == 2 and [v for _, v, _ in judged(spark, steps, ["ab"], "string")] == ["AB"]

    @t.policy("shout_for_tests", for_type="string")
    def shout(of):
        return of.invoke("upcase")

    assert judged(spark, t.String.policy("shout_for_tests"), ["a"], "string")[0][1] == "A"
    with pytest.raises(t.TypeMismatch):
        t.Integer.policy("shout_for_tests")
    assert t.String.options(["a"]).collected_metadata() == {"options": ["a"]}
    assert t.String.metadata(label="Name").collected_metadata() == {"label": "Name"}


class Doubled(t.Step):
    takes, gives = t.Integer, t.Integer[t.between(0, 100)]

    def __init__(self, by=2):
        self.by = by

    def apply(self, c):
        return c * self.by


def test_steps_as_classes(spark):
    got = judged(spark, t.Integer[t.between(0)] >> Doubled(), [4, -1, 60], "int")
    assert [(ok, errors) for ok, _, errors in got] == [(True, []), (False, ["Must be within 0.."]), (False, ["Must be within 0..100"])] and got[0][1] == 8
    assert Doubled() == Doubled(2) != Doubled(3) and Doubled() <= t.Integer
    with pytest.raises(TypeError):
        t.String >> Doubled()


DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def test_weekdays_by_name_or_number(spark):
    """Names in any case or numbers, each once, sorted."""
    numbered = t.String.invoke("downcase")[tuple(DAYS)].transform(t.Integer, lambda c: F.array_position(F.array(*map(F.lit, DAYS)), c).cast("bigint"))
    day = t.Lax.Integer[t.between(1, 7)] | numbered
    week = t.Array[day].where(size=t.between(1, 7)).check(lambda c: F.size(F.array_distinct(c)) == F.size(c), "must be unique") >> t.Array[t.Integer].invoke("sort")
    got = judged(spark, week, [["Monday", "tuesday", "7"], ["1", "MONDAY"], ["noday"], []], "array<string>")
    assert [ok for ok, _, _ in got] == [True, False, False, False] and got[0][1] == [1, 2, 7] and "must be unique" in got[1][2]


def test_what_cannot_be_is_refused_when_built():
    for bad in (lambda: t.String >> t.Integer, lambda: t.Integer[re.compile("a")], lambda: t.String[5], lambda: t.Integer.static("x"), lambda: t.String.transform("to_r"), lambda: t.Hash.tagged_by("k", t.Hash(k=t.String)), lambda: t.Hash(a=t.String) >> t.Hash(a=t.Integer)):
        with pytest.raises(TypeError):
            bad()


ORDERED = [
    (t.Integer, t.Numeric), (t.Integer[t.between(5, 6)], t.Integer[t.between(0, 10)]), (t.Integer[1, 2], t.Integer[t.between(0, 5)]), (t.Value[5], t.Numeric), (t.Value["a"], t.String), (t.String["a"], t.String["a", "b"]),
    (t.String, t.String | t.Integer), (t.Nothing, t.String), (t.String, t.Anything), (t.Array[t.Integer], t.Array[t.Numeric]), (t.Tuple[t.Integer, t.Integer], t.Array[t.Integer]),
    (t.Hash(a=t.Integer, b=t.String), t.Hash(a=t.Numeric)), (t.Hash(a=t.Integer), t.Hash({"a?": t.Integer})), (t.Hash(a=t.Integer), t.Hash), (t.Hash(a=t.Integer, b=t.Integer), t.Hash[t.String, t.Integer]),
    (t.Not[t.Numeric], t.Not[t.Integer]), (t.Integer, t.Not[t.String]), (t.Interface["size", "upcase"], t.Interface["size"]), (t.String, t.Interface["upcase"]), (t.Static[3], t.Integer[t.between(0, 5)]),
]


@pytest.mark.parametrize("a,b", ORDERED)
def test_order(a, b):
    assert a <= b and b >= a
    assert not b <= a or a is b
    assert (a | b) >= a and (a & b) <= b or not (a.preserving and b.preserving)


def tree():
    return t.Integer | t.Array[t.defer(tree)]


def wider_tree():
    return t.Numeric | t.String | t.Array[t.defer(wider_tree)]


def itself():
    return t.String | t.defer(itself)


def test_unions_of_conjunctions():
    sized, short = t.Interface["size"], t.String.where(size=t.between(0, 5))
    assert (t.String | t.Integer)[t.Pattern("a")] <= t.String | t.Integer
    assert N.Meet(t.String | t.Array, sized) <= N.Choice(N.Meet(t.String, sized), N.Meet(t.Array, sized))
    assert N.Choice(short, t.Integer[1, 2]) <= t.Integer[t.between(0, 5)] | t.String
    assert not t.String | t.Integer <= t.String and not t.Anything <= t.String | t.Integer and t.Nothing <= t.Nothing
    assert t.Static[5] <= t.Integer and not t.Value[5] <= t.Integer  # 5.0 has the value, too
    assert t.defer(tree) <= t.defer(wider_tree) and not t.defer(wider_tree) <= t.defer(tree)
    assert t.defer(itself) <= t.String and t.String <= t.defer(itself) and not t.defer(itself) <= t.Integer


def test_what_a_conversion_makes_counts():
    made = t.String.transform(t.Integer, "to_i")
    assert made <= t.Integer and t.Integer <= made and not made <= t.String


def test_rewrites():
    assert t.Integer[t.between(0, 100)][t.between(10)] == t.Integer[t.between(10, 100)]
    assert t.Integer[1, 2, 3][t.OneOf((2, 3, 4))] == t.Integer[2, 3]
    assert t.String >> t.String is t.String and (t.Integer | t.Numeric) == t.Numeric and (t.Integer | t.Integer) == t.Integer
    assert isinstance(t.String & t.Integer, N.Never) and isinstance(t.Tuple[t.String, t.Integer] & t.Tuple[t.Integer, t.Integer], N.Never)
    assert (t.Array[t.Integer] & t.Array[t.Integer[t.between(0, 1)]]) == t.Array[t.Integer[t.between(0, 1)]]
    assert isinstance(t.Array[t.String.invoke("strip")] >> t.Array[t.String.invoke("upcase")], N.Array)
    assert (~~t.String) == t.String and (t.Anything >> t.String) is t.String and (t.Anything | t.String) is t.String
    assert (t.Hash(a=t.Integer) + {"a?": t.String, "b": t.String}).to_h() == {"a?": t.String, "b": t.String}
    assert (t.Hash(a=t.Integer, b=t.String) & t.Hash(a=t.Integer[t.between(0)])).to_h() == {"a": t.Integer[t.between(0)]}


def test_codecs(spark):
    team = t.Hash(title=t.String, founded=t.Date, members=t.Array[t.Hash(name=t.String, joined=t.Date)], dates=t.Range[t.Date].nullable())
    decode, encode = t.JSON.for_(team)
    wire = [("T", "2024-01-02", [("a", "2020-02-03")], ("2024-01-01", None, False)), ("T", "no", [("a", "2020-02-03")], None)]
    df = spark.createDataFrame(wire, "title string, founded string, members array<struct<name:string,joined:string>>, dates struct<from:string,to:string,exclusive:boolean>")
    got = t.validate(df, decode).collect()
    assert [r["ok"] for r in got] == [True, False] and got[0]["members"][0]["joined"] == datetime.date(2020, 2, 3) and got[0]["dates"]["from"] == datetime.date(2024, 1, 1)
    back = t.filtered(t.filtered(df, decode), encode).collect()
    assert len(back) == 1 and back[0]["founded"] == "2024-01-02" and back[0]["members"][0]["joined"] == "2020-02-03" and back[0]["dates"]["from"] == "2024-01-01"
    with pytest.raises(TypeError, match="a.b"):
        t.Codec().noop(t.String).decoder(t.Hash(a=t.Hash(b=t.Date)))
    codec = t.Codec(t.FORMS).register("order", t.Hash(n=t.Integer))
    assert codec.has("order") and not codec.has("x") and judged(spark, codec.decode("order"), [("7",)], "struct<n:string>")[0][1]["n"] == 7
    with pytest.raises(KeyError):
        codec.decode("x")
    with pytest.raises(RuntimeError):
        codec.freeze().register("x", t.String)
    assert (t.Date >> t.JSON) <= t.String and (t.JSON >> t.Date) <= t.Date


def test_json_schema():
    order = t.Hash({"id": t.UUID4, "n": t.Integer[t.between(1, 9)], "code?": t.String[re.compile("^a")], "role": t.String.default("user"), "kind": t.String["a", "b"], "tags": t.Array[t.String].where(size=t.between(1, 3)), "at": t.Date, "_": t.Nothing})
    got = order.to_json_schema(root=True)
    assert got["$schema"].startswith("https://json-schema.org") and got["required"] == ["id", "n", "role", "kind", "tags", "at"] and got["additionalProperties"] is False
    assert got["properties"] == {
        "id": {"type": "string", "format": "uuid"}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "code": {"type": "string", "pattern": "^a"}, "role": {"type": "string", "default": "user"},
        "kind": {"type": "string", "enum": ["a", "b"]}, "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 3}, "at": {"type": "string", "format": "date"},
    }
    assert (t.String | t.Integer).to_json_schema() == {"anyOf": [{"type": "string"}, {"type": "integer"}]}
    assert t.Integer[0:10].to_json_schema() == {"type": "integer", "minimum": 0, "maximum": 9}
    assert t.Not[t.String].to_json_schema() == {"not": {"type": "string"}} and t.Nothing.to_json_schema() == {"not": {}}
    assert t.Lax.Integer.to_json_schema()["anyOf"][0] == {"type": "integer"}
    nested = t.defer(linked).to_json_schema()
    assert nested["$ref"] == "#/$defs/linked" and nested["$defs"]["linked"]["properties"]["next"]["anyOf"][1] == {"$ref": "#/$defs/linked"}
    tagged = t.Hash.tagged_by("k", t.Hash(k="a", x=t.String), t.Hash(k="b")).to_json_schema()
    assert tagged["properties"]["k"]["enum"] == ["a", "b"] and tagged["allOf"][0]["if"] == {"properties": {"k": {"const": "a"}}}


def test_spark_types_and_diagrams():
    record = t.Hash({"a": t.Integer, "b?": t.Array[t.Lax.Decimal], "c": t.String.metadata(label="C"), "d": t.String | t.Integer})
    got = record.to_struct_type()
    assert got["a"].dataType == T.LongType() and got["b"].dataType == T.ArrayType(T.DecimalType(38, 18)) and got["c"].metadata == {"label": "C"} and got["d"].dataType == T.VariantType()
    chart = (t.String >> t.String.transform(t.Integer, "to_i") | t.Integer).to_mermaid("TD")
    assert chart.startswith("flowchart TD") and '"String"' in chart and "to_i" in chart and "-->" in chart


def test_sources_and_streams(spark, tmp_path):
    from railframe.sources import readers
    from railframe.streaming import streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in/people.csv").write_text("name,age,language\nAda,36,Ruby\nBob,12,ruby\nCid,x,Go\n")
    row = t.Hash(name=t.String, age=t.Lax.Integer >> t.Integer[t.between(18)], language=t.String)
    people = readers.csv(spark, str(tmp_path / "in"), row)
    assert [r["name"] for r in t.filtered(people, row).collect()] == ["Ada"]
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": null}\n{\n')
    lines = readers.json_lines(spark, str(tmp_path / "lines.json"))
    assert sorted(r["ok"] for r in t.validate(lines, t.Hash(a=t.Integer), "value").collect()) == [False, False, True]
    def fetch(url):
        if url == "bad":
            raise OSError
        return url.upper().encode()

    fetched = readers.downloaded(spark.createDataFrame([("a",), ("bad",), (None,)], "url string"), fetch)
    assert {r["url"]: r["body"] for r in fetched.collect()} == {"a": b"A", "bad": None, None: None}
    stream = streams.files(spark, str(tmp_path / "in"), readers.text_schema(row), "*.csv", "csv")
    query = streams.split_sinks(stream, row, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.json(str(tmp_path / "bad")).count() == 3


def test_plans_grow_with_the_length_of_a_chain_and_the_depth_of_arrays(spark):
    from railframe.operators.dataset import lowered

    size = lambda o: sum(len(c._jc.toString()) for c in (o.value, o.ok, o.errors))

    def chain(n):
        of = t.Lax.Integer
        for _ in range(n):
            of = of.transform(t.Integer, lambda c: c + 1).check(lambda c: c > 0, "must be positive")
        return of

    def nested(n):
        of, ddl = t.Lax.Integer, "string"
        for _ in range(n):
            of, ddl = t.Array[of], f"array<{ddl}>"
        return size(lowered(spark.createDataFrame([], f"v {ddl}"), of, "v"))

    text = spark.createDataFrame([("1",), ("x",)], "v string")
    ten, twenty = (size(lowered(text, chain(n), "v")) for n in (10, 20))
    assert twenty < 200_000 and twenty < 2.5 * ten
    assert nested(5) - nested(4) < 1.5 * (nested(3) - nested(2)) + 2000
    assert [(ok, v) for ok, v, _ in judged(spark, chain(8), ["1", "-20", "x"], "string")] == [(True, 9), (False, None), (False, None)]
