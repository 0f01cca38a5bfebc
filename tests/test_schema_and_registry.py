"""JSON Schema of meets, unions, pipelines and interfaces; registries by row; sinks that a batch writes twice."""

import time

import pytest

from railframe import types as t
from railframe.operators.codec import NoEntry
from railframe.streaming import streams


class Doubled(t.Step):
    takes, gives = t.Integer[t.between(1, 9)], t.Integer

    def apply(self, c):
        return c * 2


@pytest.mark.parametrize(
    "kind,want",
    [
        (t.String[t.Pattern("a")][t.Pattern("b")], {"type": "string", "pattern": "a", "allOf": [{"pattern": "b"}]}),
        (t.Integer[t.between(1, 10)] & t.Integer[t.between(5, 20)], {"type": "integer", "minimum": 5, "maximum": 10}),
        (t.String.where(size=t.between(2)).where(size=t.between(0, 5)), {"type": "string", "minLength": 2, "maxLength": 5}),
        (t.String["a", "b", "c"] & t.String["b", "c", "d"], {"type": "string", "enum": ["b", "c"]}),
        (t.String[t.Pattern("a")] | t.String[t.Pattern("b")], {"type": "string", "anyOf": [{"pattern": "a"}, {"pattern": "b"}]}),
        (t.Value["a"] | t.Value["b"] | t.Value["c"], {"type": "string", "enum": ["a", "b", "c"]}),
        (t.String | t.Integer | t.Array[t.String], {"anyOf": [{"type": "string"}, {"type": "integer"}, {"type": "array", "items": {"type": "string"}}]}),
        (t.String.pipeline().step(t.String[t.Pattern("x")]).step(t.String.invoke("upcase")), {"type": "string", "pattern": "x"}),
        (t.Hash(a=t.Integer.pipeline(), b=Doubled()), {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer", "minimum": 1, "maximum": 9}}, "required": ["a", "b"]}),
    ],
)
def test_schemas_keep_all_constraints(kind, want):
    assert kind.to_json_schema() == want


def test_interfaces_are_the_types_that_answer():
    got = t.Interface["keys"].to_json_schema()
    assert got == {"type": "object"} and "array" in t.Interface["size"].to_json_schema()["type"] and "integer" not in t.Interface["size"].to_json_schema()["type"]
    both = (t.Hash(a=t.Integer, b=t.String) & t.Hash(b=t.String[t.Pattern("x")], c=t.Float)).to_json_schema()
    assert both["properties"] == {"b": {"type": "string", "pattern": "x"}} and both["required"] == ["b"]


def test_registries(spark):
    shapes = t.Codec(t.JSON, "shapes").register("circle", t.Hash(r=t.Float | t.Integer, on=t.Date)).register("name", t.String).register("list", t.Array[t.Time]).freeze()
    rows = [("circle", '{"r": 2, "on": "2024-02-29"}'), ("circle", '{"r": "x", "on": "2023-02-29"}'), ("name", '"n"'), ("list", '["2024-01-01T00:00:00Z", "no"]'), ("square", "{}"), (None, "1"), ("name", "not json"), ("name", None)]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "i long, kind string, payload string, key string")
    got = sorted(shapes.decoded_by("kind").apply(df).collect(), key=lambda r: r["i"])
    assert [r["ok"] for r in got] == [True, False, True, False, False, False, False, False]
    assert got[0]["payload"] == '{"on":"2024-02-29","r":2.0}' and got[2]["payload"] == '"n"' and got[1]["payload"] is None
    assert [(e["path"], e["message"]) for e in got[4]["errors"]] == [("kind", "shapes: nothing is registered under square")]
    assert "null" in got[5]["errors"][0]["message"] and {e["path"] for e in got[1]["errors"]} == {"r", "on"} and got[3]["errors"][0]["path"] == "[1]"
    assert shapes.decoded_by("kind").apply(df.limit(0)).count() == 0
    values = spark.sql("SELECT 'circle' AS kind, to_variant_object(named_struct('r', 1.5D, 'on', date '2024-03-01')) AS payload")
    back = shapes.encoded_by("kind").apply(values).first()
    assert back["ok"] and back["payload"] == '{"on":"2024-03-01","r":1.5}'
    with pytest.raises(ValueError):
        shapes.decoded_by("kind").apply(df.withColumnRenamed("key", "ok"))


def test_unknown_and_frozen_entries():
    codec = t.Codec(t.JSON, "mine").register("a", t.Date).freeze()
    assert codec.has("a") and not codec.has("b")
    with pytest.raises(NoEntry, match="nothing is registered under 'b', but .'a'."):
        codec.decode("b")
    for act in (lambda c: c.noop(t.Time), lambda c: c.register("b", t.Date), lambda c: c.encoder(t.Encoder(t.String, t.Date, lambda c: c, lambda c: c))):
        for frozen in (codec, t.JSON, t.FORMS):
            with pytest.raises(RuntimeError, match="frozen"):
                act(frozen)
    assert t.Codec(t.JSON).noop(t.Time).noops != t.JSON.noops


def test_a_batch_that_runs_again_replaces_its_files(spark, tmp_path):
    from railframe.sources.readers import write_split

    df = spark.createDataFrame([(1, "a"), (-1, "b")], "n long, s string")
    kind = t.Hash(n=t.Integer[t.between(0)], s=t.String)
    for _ in range(2):
        write_split(df, kind, f"{tmp_path}/good", f"{tmp_path}/bad", mode="overwrite")
    assert spark.read.parquet(f"{tmp_path}/good").count() == 1 and spark.read.json(f"{tmp_path}/bad").count() == 1
    df.write.parquet(f"{tmp_path}/in")
    for n in ("one", "two"):  # a new checkpoint: the batch is run again
        streams.split_sinks(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), kind, f"{tmp_path}/g", f"{tmp_path}/b", f"{tmp_path}/{n}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/g").count() == 1 and spark.read.json(f"{tmp_path}/b").count() == 1


def test_meets_of_unions_build_in_linear_time(spark):
    unions = [t.String[t.Pattern(f"a{i}")] | t.String[t.Pattern(f"b{i}")] for i in range(12)]
    began = time.perf_counter()
    kind = unions[0]
    for u in unions[1:]:
        kind = kind & u
    assert kind <= unions[5] and kind <= t.String and not kind <= t.String[t.Pattern("c")] and not t.String <= kind
    assert time.perf_counter() - began < 1
    df = spark.createDataFrame([(" ".join(f"a{i}" for i in range(12)),), (" ".join(f"{'ab'[i % 2]}{i}" for i in range(12)),), (" ".join(f"a{i}" for i in range(11)),), (None,)], "v string")
    assert [r["ok"] for r in t.validate(df, kind, "v").collect()] == [True, True, False, False]
    small = (t.Value["a"] | t.Value["b"] | t.Value["c"]) & (t.Value["b"] | t.Value["c"] | t.Value["d"])
    assert small == t.Value["b"] | t.Value["c"]
    assert (t.Value["a"] | t.Value["b"] | t.Integer) & (t.Value["x"] | t.Value["y"] | t.Date) == t.Nothing
