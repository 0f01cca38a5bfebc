"""A Merkle manifest of a dataset, with a proof for each row.

Rows are sorted and dealt into ranges, so that a range holds whole runs of neighbouring leaves, however many rows one
source has. The nodes of each level are made from those of the level below, sixteen by sixteen. A range then proves all
its leaves together, as an octopus reaches out once with all its arms: from the coordinates of its leaves follows the
smallest set of nodes that it lacks, at most fifteen on either side of a level; they are fetched in one join, what lies
between is derived once and shared, and every row's own proof is expanded from them where the rows are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, out_batch, ranged, saved

#: Children of a node.
ARITY = 16
#: Rows in a range of leaves, about; a task holds one range.
RANGE_ROWS = 100_000
#: The tree above the sources counts as one more source, of this level onwards.
TOP = 100


def part(c: Column) -> Column:
    """A value as the leaf takes it: - for null, else its bytes, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """source, doc_id, leaf, and the leaf of the row whose text is in lower case, where tampered."""
    known = [part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), hashed(*known, part(F.col("text"))).alias("leaf"), F.when(tampered, hashed(*known, part(lower_ascii(F.col("text"))))).alias("other")
    )


def by_fifth(doc_id: Column) -> Column:
    """Where 5 divides the checksum of an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def runs_of(placed: DataFrame, group: str, name: str) -> DataFrame:
    """For each range and group: start (place of the range's first row in the group), n, and total (rows of the group)."""
    here = placed.groupBy("part", group).agg(F.count("*").alias("n"))
    whole = W.partitionBy(group)
    runs = here.withColumn("start", F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(whole))
    return saved(runs, f"{name}_runs")


def above(nodes: DataFrame) -> DataFrame:
    """The nodes of the next level; a source with one node is at its end."""
    wide = nodes.where("total > 1").groupBy("source", "total", F.expr(f"at div {ARITY}").alias("up"))
    made = wide.agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("run"))
    return made.select("source", F.col("up").alias("at"), hashed(F.array_join("run.h", "")).alias("h"), F.expr(f"(total + {ARITY - 1}) div {ARITY}").alias("total"))


def levels(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The levels of trees whose largest has `most` leaves, from the nodes upwards; each is written."""
    found = [nodes]
    while most > 1:
        most = math.ceil(most / ARITY)
        found.append(saved(above(found[-1]), f"{name}_{len(found)}"))
    return found


def lacking(start: int, end: int, total: int) -> Iterator[tuple[int, int]]:
    """Level and place of each node that leaves start to end (exclusive) of a tree of `total` leaves lack for their proofs."""
    level = 0
    while total > 1:
        first, last = start // ARITY * ARITY, min(-(-end // ARITY) * ARITY, total)
        yield from ((level, i) for i in (*range(first, start), *range(end, last)))
        start, end, total, level = first // ARITY, -(-end // ARITY), -(-total // ARITY), level + 1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Arm:
    """The nodes of one tree above leaves start to start + len(own), from these and the fetched ones."""

    def __init__(self, own: list[str], start: int, total: int, fetched: dict[tuple[int, int], str]):
        self.known: list[tuple[int, list[str]]] = []  # of each level: the place of its first node here, and the nodes
        level = 0
        while total > 1:
            first, last = start // ARITY * ARITY, min(-(-(start + len(own)) // ARITY) * ARITY, total)
            own = [fetched[level, i] for i in range(first, start)] + own + [fetched[level, i] for i in range(start + len(own), last)]
            self.known.append((first, own))
            own = [sha("".join(own[i : i + ARITY])) for i in range(0, len(own), ARITY)]
            start, total, level = first // ARITY, -(-total // ARITY), level + 1
        self.root = own[0]
        self._rest: dict[tuple[int, int], str] = {}

    def sides(self, level: int, at: int) -> tuple[str, str]:
        """What stands left and right of a node in its run."""
        first, nodes = self.known[level]
        run = (at - first) // ARITY * ARITY
        own = at - first
        return "".join(nodes[run:own]), "".join(nodes[own + 1 : run + ARITY])

    def siblings(self, at: int, level: int = 0) -> str:
        """The siblings of a leaf and of all nodes above it, level by level; those above are shared."""
        if level == len(self.known):
            return ""
        up = (level + 1, at // ARITY)
        if up not in self._rest:
            self._rest[up] = self.siblings(up[1], level + 1)
        return "".join(self.sides(level, at)) + self._rest[up]

    def folded(self, h: str, at: int) -> str:
        """The root that another hash at a leaf's place leads to."""
        for level in range(len(self.known)):
            left, right = self.sides(level, at)
            h, at = sha(left + h + right), at // ARITY
        return h


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of docs.

    A tree of its own for each source, leaves ascending by doc_id, and one of the sources' roots, ascending bytewise, a null
    source first. tampered (default: where 5 divides the crc32 of doc_id) marks rows whose text is folded with A-Z in lower
    case. Null values are leaves' parts of their own; null ids come first in their source and are not tampered by default;
    rows that repeat an id are ordered by their leaf, and each has its proof. An empty table has no rows, and no root.
    """
    spark = docs.sparkSession
    made = saved(leaves(docs, by_fifth(F.col("doc_id")) if tampered is None else tampered), "leaves")
    rows = made.count()
    placed = ranged(made, "source", ["doc_id", "leaf"], rows, RANGE_ROWS, "placed")
    runs = runs_of(placed, "source", "placed")
    same = F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.part") == F.col("r.part"))
    found = placed.alias("p").join(runs.alias("r"), same).select("p.source", "p.doc_id", "p.leaf", "p.other", "p.part", "p.place", "r.start", "r.n", "r.total")
    # Only leaves near the end of a run can be another range's missing ones.
    near = found.where((F.col("place") < ARITY) | (F.col("place") >= F.col("n") - ARITY))
    as_nodes = lambda df: df.select("source", (F.col("start") + F.col("place")).alias("at"), F.col("leaf").alias("h"), "total")
    below = levels(as_nodes(found), runs.agg(F.max("total")).first()[0] or 0, "level")
    below[0] = as_nodes(near)

    ends = [df.where("total = 1").select("source", F.col("h").alias("leaf")) for df in below]
    roots = ends[0]
    for df in ends[1:]:
        roots = roots.unionByName(df)
    # The sources' roots are leaves of one more tree.
    sources = roots.select(F.col("source").alias("member"), "leaf", F.lit("").alias("source"))
    count = sources.count()
    tops = ranged(sources, "source", ["member"], count, RANGE_ROWS, "sources")
    top_runs = runs_of(tops, "source", "sources")
    joined = tops.alias("p").join(top_runs.alias("r"), F.col("p.part") == F.col("r.part"))
    numbered = saved(joined.select("p.member", "p.source", F.col("p.leaf").alias("h"), (F.col("start") + F.col("place")).alias("at"), "total"), "numbered")
    upper = levels(numbered.drop("member"), count, "top")
    top = upper[-1].where("total = 1").first()
    root = top["h"] if top else None

    # One row for each range and source: where the range's leaves stand, and where the source stands among the sources.
    spans = runs.alias("r").join(numbered.alias("s"), F.col("r.source").eqNullSafe(F.col("s.member"))).select("r.part", "r.source", "r.start", "r.n", "r.total", F.col("s.at").alias("member"))

    @F.udf("array<struct<level:int,at:long>>", useArrow=True)
    def missing(start, end, total):
        return list(lacking(start, end, total))

    def wanted(df: DataFrame, base: int) -> DataFrame:
        lacks = df.select("part", "source", F.explode(missing("start", "end", "total")).alias("x"))
        return lacks.select("part", "source", (F.col("x.level") + base).alias("level"), F.col("x.at").alias("at"))

    own = wanted(spans.withColumn("end", F.col("start") + F.col("n")), 0)
    over = wanted(spans.groupBy("part").agg(F.min("member").alias("start"), (F.max("member") + 1).alias("end")).select("part", F.lit("").alias("source"), "start", "end", F.lit(count).cast("long").alias("total")), TOP)
    nodes = None
    for base, some in ((0, below), (TOP, upper)):
        for i, df in enumerate(some):
            df = df.select("source", "at", "h", F.lit(base + i).alias("level"))
            nodes = df if nodes is None else nodes.unionByName(df)
    lacks = own.unionByName(over)
    hit = F.col("n.source").eqNullSafe(F.col("w.source")) & (F.col("n.level") == F.col("w.level")) & (F.col("n.at") == F.col("w.at"))
    fetched = nodes.alias("n").join(lacks.alias("w"), hit).select("w.part", "w.source", "w.level", "w.at", "n.h")

    null = lambda kind: F.lit(None).cast(kind)
    # A range's rows in this order: fetched nodes (0), spans of its sources (1), leaves (2).
    told = fetched.select("part", F.lit(0).alias("kind"), F.col("source"), F.col("level").cast("long").alias("a"), F.col("at").alias("b"), null("long").alias("c"), F.col("h").alias("leaf"), null("string").alias("other"), null("long").alias("doc_id"))
    told = told.unionByName(spans.select("part", F.lit(1).alias("kind"), "source", F.col("start").alias("a"), F.col("total").alias("b"), F.col("member").alias("c"), null("string").alias("leaf"), null("string").alias("other"), null("long").alias("doc_id")))
    told = told.unionByName(placed.select("part", F.lit(2).alias("kind"), "source", F.col("place").alias("a"), null("long").alias("b"), null("long").alias("c"), "leaf", "other", "doc_id"))
    result = arrow_schema(RESULT)

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "kind", "source", "a", "b", "c", "leaf", "other", "doc_id"]
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in names)))
        for _, own in groupby(rows, key=lambda r: r[0]):
            lines = proven(own, count, root)
            while some := list(islice(lines, 5000)):
                yield out_batch(result, list(zip(*some)))

    ranges = placed.agg(F.max("part")).first()[0]
    return told.repartitionById((ranges or 0) + 1, "part").sortWithinPartitions("part", "kind", "source", "a").mapInArrow(expanded, RESULT)


def proven(rows: Iterator[tuple], sources: int, root: str | None) -> Iterator[tuple]:
    """The results of one range's rows."""
    fetched: dict[str | None, dict[tuple[int, int], str]] = {}
    above_: dict[tuple[int, int], str] = {}
    spans: dict[str | None, tuple[int, int, int]] = {}
    own: dict[str | None, list[tuple]] = {}
    for _, kind, source, a, b, c, leaf, other, doc_id in rows:
        if kind == 0 and a >= TOP:
            above_[a - TOP, b] = leaf
        elif kind == 0:
            fetched.setdefault(source, {})[a, b] = leaf
        elif kind == 1:
            spans[source] = (a, b, c)
        else:
            own.setdefault(source, []).append((doc_id, leaf, other))
    arms = {s: Arm([r[1] for r in own[s]], start, total, fetched.get(s, {})) for s, (start, total, _) in spans.items()}
    order = sorted(spans, key=lambda s: spans[s][2])
    head = Arm([arms[s].root for s in order], spans[order[0]][2], sources, above_)
    for s in order:
        arm, (start, _, member) = arms[s], spans[s]
        rest = head.siblings(member)
        for i, (doc_id, leaf, other) in enumerate(own[s], start):
            folded = head.root if other is None else head.folded(arm.folded(other, i), member)
            yield doc_id, leaf, arm.root, root, sha(arm.siblings(i) + rest), folded, folded == root
