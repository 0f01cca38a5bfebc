"""Types that hold themselves to any depth, against plain recursion."""

import json
import random

from pyspark.sql import functions as F

from railframe import types as t
from railframe.operators import deep
from railframe.plans.cells import TAGS, has_tag
from railframe.sources.readers import from_json


def linked():
    return t.Hash(value=t.Integer, next=t.Nil | t.defer(linked, None))


def tree():
    return t.Integer | t.Array[t.defer(tree, None)]


def even():
    return t.Hash(even=t.Nil | t.defer(odd, None))


def odd():
    return t.Hash(odd=t.defer(even, None))


def not_tree():
    """Lists of what is none of these, so that validity changes at each level."""
    return t.Array[~t.defer(not_tree, None)]


def branching():
    return t.Nil | t.Hash(left=t.defer(branching, None), right=t.defer(branching, None), v=t.Integer)


def plain_list(v):
    return isinstance(v, dict) and type(v.get("value")) is int and "next" in v and (v["next"] is None or plain_list(v["next"]))


def plain_tree(v):
    return type(v) is int or isinstance(v, list) and all(map(plain_tree, v))


def plain_not_tree(v):
    return isinstance(v, list) and not any(map(plain_not_tree, v))


def plain_even(v, key="even"):
    if not isinstance(v, dict) or key not in v:
        return False
    return key == "even" and v[key] is None or plain_even(v[key], "odd" if key == "even" else "even")


def plain_branching(v):
    return v is None or isinstance(v, dict) and type(v.get("v")) is int and all(k in v and plain_branching(v[k]) for k in ("left", "right"))


def judged(spark, values, kind):
    df = from_json(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, j string"), "j")
    return [r for r in sorted(t.validate(df, kind, "j").collect(), key=lambda r: r["i"])]


def listed(depth, bad=None, end=None):
    v = end
    for i in range(depth, 0, -1):
        v = {"value": "x" if i == bad else i, "next": v}
    return v


def test_lists_of_any_depth(spark):
    values = [listed(d) for d in (1, 3, 4, 5, 9, 10, 30, 50)] + [listed(50, 50), listed(40, 17), listed(12, end={"value": 1}), listed(9, end=5), None, 3]
    got = judged(spark, values, t.defer(linked, None))
    assert [r["ok"] for r in got] == list(map(plain_list, values))
    assert json.loads(got[7]["j"]) == values[7] and all((not r["errors"]) == r["ok"] for r in got)
    assert (f"{'next.' * 16}value", "Must be a Integer") in [(e["path"], e["message"]) for e in got[9]["errors"]]


def test_trees_negations_branches_and_turns(spark):
    rng = random.Random(4)

    def grown(depth, leaf):
        return leaf() if depth == 0 else [grown(depth - 1, leaf), *(leaf() for _ in range(rng.randrange(3)))]

    trees = [grown(d, lambda: rng.choice([1, 2, 3, 3, 3, "x"] if bad else [1, 2])) for d in (0, 1, 3, 9, 14) for bad in (0, 1)]
    assert [r["ok"] for r in judged(spark, trees, t.defer(tree, None))] == list(map(plain_tree, trees))
    nested = []
    for d in range(12):
        v = rng.choice([[], 1])
        for _ in range(d):
            v = [v] if rng.random() < 0.7 else [v, 1]
        nested.append(v)
    assert [r["ok"] for r in judged(spark, nested, t.defer(not_tree, None))] == list(map(plain_not_tree, nested))
    turns = []
    for d in range(0, 15, 3):
        v = rng.choice([None, {"even": None}])
        for i in range(d):
            v = {"odd" if i % 2 == 0 else "even": v}
        turns += [v, {"even": v}]
    assert [r["ok"] for r in judged(spark, turns, t.defer(even, None))] == list(map(plain_even, turns))

    def branch(depth):
        return None if depth == 0 or rng.random() < 0.2 else {"left": branch(depth - 1), "right": branch(rng.randrange(depth)), "v": rng.choice([1] * 40 + ["x"])}

    branches = [branch(d) for d in (0, 1, 2, 5, 8, 8, 8)]
    assert [r["ok"] for r in judged(spark, branches, t.defer(branching, None))] == list(map(plain_branching, branches))


def test_inside_records_and_where_columns_clash(spark):
    df = from_json(spark.createDataFrame([(1, json.dumps(listed(7)), 5, 7), (2, json.dumps(listed(7, 6)), 6, 8), (3, json.dumps(listed(2)), 7, 9), (4, None, 8, 1)], "id long, j string, __deep long, which int"), "j")
    kind = t.Hash(id=t.Integer[t.between(1, 9)], j=t.defer(linked, None), __deep=t.Integer)
    got = sorted(t.validate(df, kind).collect())
    assert [(r["id"], r["ok"], r["__deep"]) for r in got] == [(1, True, 5), (2, False, 6), (3, True, 7), (4, False, 8)]
    assert sorted(r["id"] for r in t.filtered(df, kind).collect()) == [1, 3]
    assert sorted(r["which"] for r in t.invalid(df, kind).collect()) == [1, 8]
    assert t.validate(df.limit(0), kind).count() == 0
    assert t.defer(linked, None) <= t.defer(linked, None)
    repeated = df.where("id < 3").unionByName(df.where("id < 3"))
    assert sorted((r["id"], r["ok"]) for r in t.validate(repeated, kind).collect()) == [(1, True)] * 2 + [(2, False)] * 2


def test_a_stream_is_unrolled_only(spark, tmp_path):
    spark.createDataFrame([(json.dumps(listed(3)),), (json.dumps(listed(30)),)], "j string").write.parquet(f"{tmp_path}/in")
    from railframe.streaming.streams import to_files

    stream = from_json(spark.readStream.schema("j string").parquet(f"{tmp_path}/in"), "j")
    got = to_files(t.validate(stream, t.defer(linked, None), "j").selectExpr("ok", "exists(errors, e -> e.message = 'nested deeper than 3') AS deeper"))
    assert sorted(map(tuple, got.collect())) == [(False, True), (True, False)]


def test_lists_take_few_rounds_and_read_no_more_than_they_need(spark, monkeypatch):
    tables, made = [], deep.written
    monkeypatch.setattr(deep, "written", lambda df, name: tables.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or made(df, name))
    values = [listed(d) for d in (2, 20, 50)] + [listed(50, 49)]
    assert [r["ok"] for r in judged(spark, values, t.defer(linked, None))] == list(map(plain_list, values))
    assert len(tables) < 25
    # A filter of what waits would be pushed below what it reads, which would be made twice; a value is taken from the one around it once.
    assert not any(plan.count("parse_json") + plan.count("parseJson") > 1 for name, plan in tables if name == "deep_rows")
    assert max(len(plan) for name, plan in tables) < 200_000


def test_results_are_merged_and_values_taken_out_of_the_whole(spark, monkeypatch):
    """The files of results are far smaller than their rows in memory, so their size must not make Spark broadcast them."""
    plans, made = [], deep.written
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(deep, "written", lambda df, name: note(df) or made(df, name))
    df = from_json(spark.createDataFrame([(json.dumps(listed(d, bad)),) for d, bad in ((2, None), (20, 19), (20, None))], "j string"), "j")
    got = t.validate(df, t.defer(linked, None), "j")
    note(got)
    assert sorted((r["ok"], *(e["path"] for e in r["errors"] if e["message"] == "Must be a Integer")) for r in got.collect()) == [(False, "next." * 18 + "value"), (True,), (True,)]
    assert sum("SortMergeJoin" in p for p in plans) > 1 and not any("Broadcast" in p for p in plans)
    assert not any("try_variant_get(try_variant_get(" in p for p in plans)


def test_kinds_of_variants_are_those_of_their_schemas(spark):
    texts = ['{"a": {"b": [1]}}', "{}", "[]", '[1, "a", {"x": 2}, null]', "null", '"s"', '"2020-01-01"', "1", "1.5", "1e3", "true", "false", "9" * 20, "bad", None]
    df = from_json(spark.createDataFrame([(x,) for x in texts], "v string"), "v")
    df = df.union(spark.sql("SELECT cast(date'2020-01-01' AS variant) UNION ALL SELECT cast(timestamp'2020-01-01 00:00:00' AS variant) UNION ALL SELECT to_variant_object(map('a', 1))"))
    schema = F.schema_of_variant("v")
    told = df.select(*(F.struct(has_tag(F.col("v"), k), F.coalesce(schema.rlike(tag), F.lit(False))).alias(k) for k, (tag, _) in TAGS.items())).collect()
    assert len(told) == len(texts) + 3 and all(a is b for r in told for a, b in r)
