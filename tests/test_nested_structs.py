"""Structs inside structs: their own validity and errors, equality, changes inside."""

import pytest
from pyspark.sql import functions as F

from railframe import types as t


class Account(t.Struct):
    name = t.attribute(t.String.present())

    class address(t.Struct):
        city = t.attribute(t.String)
        zip = t.attribute(t.Lax.Integer)

    @t.many
    class friends(t.Struct):
        name = t.attribute(t.String)
        age = t.attribute(t.Integer[t.between(18)])

        @t.many
        class pets(t.Struct):
            kind = t.attribute(t.String["cat", "dog"])

    @t.maybe
    class note(t.Struct):
        text = t.attribute(t.String)


DDL = "id int, name string, address struct<city:string,zip:string>, friends array<struct<name:string,age:long,pets:array<struct<kind:string>>>>"
ROWS = [
    (1, "a", ("x", "1,000"), [("f", 20, [("cat",), ("dog",)]), ("g", 30, [])]),
    (2, "b", ("x", "?"), [("f", 20, [("cat",), ("cow",)]), (None, 3, [])]),
    (3, "", None, None),
    (4, "d", ("y", "7"), []),
]


def test_inner_structs_are_classes_and_attributes(spark):
    assert list(Account.attributes) == ["name", "address", "friends", "note"] and Account.Address.__name__ == "Address"
    assert Account.attributes["note"].optional and Account.attribute_at("friends[0].pets[1].kind") is Account.Friends.Pets.attributes["kind"]
    assert Account.of() <= t.Hash(name=t.String, address=t.Hash(city=t.String)) and not Account.of() <= t.Hash(address=t.Hash(city=t.Integer))
    assert Account.of().to_json_schema()["properties"]["friends"]["items"]["properties"]["pets"]["type"] == "array"

    class Special(Account):
        class address(t.Struct):
            street = t.attribute(t.String)

    assert list(Special.Address.attributes) == ["street"] and list(Special.attributes) == list(Account.attributes)


def test_each_struct_has_its_own_errors(spark):
    made = Account.new(spark.createDataFrame(ROWS, DDL))
    paths = ["", "address", "friends", "friends[0]", "friends[0].pets[1]", "friends[1]"]
    got = {r["name"]: r for r in made.select("name", "address", "ok", *(Account.valid(p).alias(f"v{i}") for i, p in enumerate(paths)), *(Account.errors(p).alias(f"e{i}") for i, p in enumerate(paths))).collect()}
    assert [got["a"][f"v{i}"] for i in range(6)] == [True] * 6 and got["a"]["address"]["zip"] == 1000 and got["a"]["ok"]
    assert [got["b"][f"v{i}"] for i in range(6)] == [False] * 6 and not got["b"]["ok"]
    said = lambda i: [(e["path"], e["message"]) for e in got["b"][f"e{i}"]]
    assert [p for p, _ in said(1)] == ["zip"] * len(said(1)) and said(4) == [("kind", 'Must be included in ["cat", "dog"]')]
    assert [p for p, _ in said(3)] == ["pets[1].kind"] and {p for p, _ in said(5)} == {"name", "age"}
    assert [p for p, _ in said(2)] == ["[0].pets[1].kind", "[1].name", "[1].age"]
    assert not got[""]["v0"] and not got[""]["v1"] and not got[""]["v2"] and got[""]["v3"]
    with pytest.raises(AttributeError):
        Account.valid("addresses")
    with pytest.raises(AttributeError):
        Account.valid("friends[0].pet")


def test_changes_inside_and_equality(spark):
    df = spark.createDataFrame(ROWS, DDL)
    changed = Account.with_(df, **{"address.zip": F.lit("12")})
    assert [r["address"]["zip"] for r in changed.collect() if r["address"]] == [12, 12, 12]
    for wrong in ("address.street", "friend"):
        with pytest.raises(AttributeError):
            Account.with_(df, **{wrong: F.lit("x")})
    pairs = df.selectExpr("struct(*) AS a", "struct(id + 1 AS other, name, friends, address) AS b", "struct(*) AS c").withColumn("c", F.col("c").withField("friends", F.transform("c.friends", lambda f: f.withField("age", f["age"] + 1))))
    got = pairs.select(Account.same("a", "b"), Account.same("a", "c")).collect() if "note" in df.columns else pairs.withColumns({x: F.col(x).withField("note", F.lit(None).cast("struct<text:string>")) for x in "abc"}).select(Account.same("a", "b"), Account.same("a", "c")).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (True, True), (True, True)]
