"""Names by namespaces; encoders whose wire type depends on the type; codecs of types that hold themselves; numbers of lines."""

import pytest
from pyspark.sql import functions as F

from railframe import types as t
from railframe.operators import codec as C
from railframe.plans import nodes as N
from railframe.plans.export import json_schema, mermaid
from railframe.sources import readers
from railframe.streaming import streams


class Shop(t.Namespace):
    Price = t.Float[t.between(0)]
    Tree = t.defer(lambda: t.Hash(name=t.String, kids=t.Array[Shop.Tree]))

    class Orders:
        Id = t.Integer


class Own(Shop):
    Extra = t.String


def test_types_are_named_by_where_they_stand():
    assert [repr(x) for x in (Shop.Price, Shop.Orders.Id, Own.Price, Own.Orders.Id, Own.Extra)] == ["Shop.Price", "Shop.Orders.Id", "Own.Price", "Own.Orders.Id", "Own.Extra"]
    assert repr(Shop.Price) == "Shop.Price" and "Shop" not in repr(t.Integer)
    Shop.Late = t.Integer[t.between(1)]
    assert repr(Shop.Late) == "Shop.Late"
    Own.Alias = Shop.Late
    assert repr(Own.Alias) == "Own.Alias" and repr(Shop.Late) == "Shop.Late"


def test_names_change_nothing_else(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "v double")
    for kind in (Shop.Price, Own.Price):
        assert kind <= t.Float and t.equivalent(kind, t.Float[t.between(0)])
        assert [r["ok"] for r in t.validate(df, kind, "v").collect()] == [True, False, False]
    assert json_schema(Shop.Price) == json_schema(t.Float[t.between(0)])


def test_names_in_definitions_diagrams_and_messages():
    schema = json_schema(t.Hash(root=Shop.Tree))
    assert list(schema["$defs"]) == ["Shop.Tree"]
    assert schema["$defs"]["Shop.Tree"]["properties"]["kids"] == {"type": "array", "items": {"$ref": "#/$defs/Shop.Tree"}}
    drawn = mermaid(t.Hash(root=Shop.Tree, price=Shop.Price))
    assert '"Shop.Tree"' in drawn and '["Shop.Price"]' in drawn and drawn.count("subgraph") == drawn.count("  end")
    with pytest.raises(t.TypeMismatch, match="Shop.Orders.Id"):
        Shop.Orders.Id >> t.String


def test_a_codec_keeps_cycles():
    made = []

    def tree():
        made.append(1)
        return t.Hash(at=t.Date, kids=t.Array[own])

    own = t.defer(tree)
    decode = t.JSON.decoder(t.Hash(a=own, b=own))
    (_, a), (_, b) = decode.fields
    assert a == b and a.target() is b.target() and len(made) == 1
    inner = dict((k.name, f) for k, f in a.target().fields)["kids"].of
    assert inner == a  # the back edge
    assert len(json_schema(decode)["$defs"]) == 1


def test_values_of_recursive_types_through_a_codec(spark):
    node = t.defer(lambda: t.Hash({"on": t.Date, "next?": node}))
    nest = lambda n, last="2024-01-31": '{"on": "2024-01-31", "next": ' * n + '{"on": "%s"}' % last + "}" * n
    df = spark.createDataFrame([(0, nest(0)), (1, nest(5)), (2, nest(5, "soon"))], "id long, v string").select("id", F.parse_json("v").alias("v"))
    got = {r["id"]: r for r in t.validate(df, t.Hash(id=t.Integer, v=t.JSON.decoder(node))).collect()}
    assert [got[i]["ok"] for i in range(3)] == [True, True, False]
    assert got[2]["errors"][0]["path"] == "v.next.next.next.next.next.on"


def test_ranges_are_an_entry_of_a_codec(spark):
    kind = t.Hash(r=t.Range[t.Date])
    with pytest.raises(C.NoEncoder, match="r: no encoder"):
        t.Codec().encoder(C.DATE).decoder(kind)
    codec = t.Codec().encoder(C.DATE).encoder(C.RANGE)
    df = spark.createDataFrame([(("2024-01-01", "2024-02-01", False),), (("2024-01-01", None, True),), (("x", None, True),)], "r struct<from:string,to:string,exclusive:boolean>")
    for c in (codec, t.JSON):
        read = t.validate(df, c.decoder(kind))
        assert [r["ok"] for r in read.collect()] == [True, True, False]
        back = t.filtered(read.where("ok").select("r"), c.encoder_of(kind))
        assert [tuple(r["r"]) for r in back.collect()] == [("2024-01-01", "2024-02-01", False), ("2024-01-01", None, True)]
    with pytest.raises(C.NoEncoder, match="r.from"):
        t.Codec().encoder(C.RANGE).decoder(kind)


PAIRS = t.Encoder(
    t.Array,
    t.Range[t.Anything],
    lambda c: F.when(F.size(c) == 2, F.struct(c[0].alias("from"), c[1].alias("to"), F.lit(False).alias("exclusive"))),
    lambda c: F.array(c["from"], c["to"]),
    "pairs",
    lambda of, part: N.Array(part(N.base_of(of).of, "[]")),
)


def test_an_own_encoder_takes_its_parts_through_the_codec(spark):
    """Ranges as lists of two, with ends as the codec writes them; it comes before the codec's own for ranges."""
    codec = t.Codec(t.JSON).encoder(PAIRS)
    kind = t.Hash(days=t.Range[t.Date])
    df = spark.createDataFrame([(["2024-01-01", "2024-02-01"],), (["2024-01-01", "x"],), (["2024-01-01"],), (None,)], "days array<string>")
    read = t.validate(df, codec.decoder(kind))
    assert [r["ok"] for r in read.collect()] == [True, False, False, False]
    assert [r["days"] for r in t.filtered(read.where("ok").select("days"), codec.encoder_of(kind)).collect()] == [["2024-01-01", "2024-02-01"]]
    with pytest.raises(C.NoEncoder, match=r"r\.\[\]"):
        t.Codec().encoder(PAIRS).decoder(t.Hash(r=t.Range[t.Date]))


def written_lines(tmp_path, files):
    for name, texts in files.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in texts))
    return str(tmp_path)


@pytest.mark.parametrize("limit", [0, readers.BROADCAST_BYTES])
def test_numbers_of_lines_over_many_splits(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(readers, "BROADCAST_BYTES", limit)
    files = {"b.txt": [f"b {i} {'x' * (i % 90)}" for i in range(3000)], "a.txt": [f"a {i}" for i in range(50)], "c.txt": [], "d.txt": ["", "same", "same", ""]}
    folder = written_lines(tmp_path, files)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        df = readers.lines(spark, folder, row="row", file="file")
        got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["row"], r["value"]) for r in df.collect())
        assert spark.read.text(folder).select("_metadata.file_block_start").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = [(name, i + 1, x) for name in sorted(files) for i, x in enumerate(files[name])]
    assert got == [(name, i, n + 1, x) for n, (name, i, x) in enumerate(want)]


def test_numbers_of_no_lines_and_names_that_clash(spark, tmp_path):
    folder = written_lines(tmp_path, {"e.txt": []})
    assert readers.lines(spark, folder, row="row").collect() == []
    with pytest.raises(ValueError):
        readers.lines(spark, folder, column="Line")
    with pytest.raises(ValueError):
        readers.csv_lines(spark, folder, t.Hash(line=t.String))
    with pytest.raises(ValueError):
        readers.lines(spark, folder, line="n", row="n")


def test_invalid_rows_of_csv_by_line(spark, tmp_path):
    folder = written_lines(tmp_path, {"a.csv": ["name,n", "x,1", "", '"y, z",two', ",3"], "b.csv": ["name,n", "w,x"]})
    kind = t.Hash(name=t.String.present(), n=t.Lax.Integer)
    df = readers.csv_lines(spark, folder, kind, file="file")
    assert df.columns == ["name", "n", "line", "file"]
    got = t.validate(df, t.Hash(name=t.String.present(), n=t.Lax.Integer, line=t.Integer, file=t.String)).where("NOT ok")
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["errors"][0]["path"]) for r in got.select("file", "line", "errors").collect()) == [("a.csv", 4, "n"), ("a.csv", 5, "name"), ("b.csv", 2, "n")]


def test_numbers_over_the_batches_of_a_stream(spark, tmp_path):
    source, out, check = (tmp_path / n for n in ("in", "out", "check"))
    source.mkdir()

    def run():
        stream = spark.readStream.format("text").load(str(source))
        streams.numbered_sink(stream, str(out), str(check), path="file").awaitTermination()
        return sorted((r["file"].rsplit("/", 1)[1], r["line"], r["row"], r["value"]) for r in spark.read.parquet(f"{out}/rows").collect())

    written_lines(source, {"a.txt": ["p", "q"]})
    assert run() == [("a.txt", 1, 1, "p"), ("a.txt", 2, 2, "q")]
    written_lines(source, {"b.txt": ["r"], "c.txt": ["s", "t"]})
    assert run()[2:] == [("b.txt", 1, 3, "r"), ("c.txt", 1, 4, "s"), ("c.txt", 2, 5, "t")]
