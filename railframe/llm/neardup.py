"""Near duplicates: MinHash bands propose pairs, odd sketches sift them, whole shingle sets confirm them.

Every document is reduced where it lies to a key of its shingle set, MinHash bands and an odd sketch: the parity bitmap
into which its samples by one-permutation MinHash (the least hash in each of BINS ranges) are folded. The population count
of two bitmaps' XOR estimates how many samples differ, sharply at high similarity. Documents with equal sets form one class, and only a class's representative is compared.

Within a band's bucket every member is first compared with the bucket's hub, the member with the most company over all
bands; so a group of near copies costs a comparison for each copy. Buckets whose members then lie in one component are
done. In the others all pairs of members from different components count: small buckets list them, large ones are met
block by block on their sketches, a few nearest partners first, then more, then all. No link is lost to a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, keyed_join, mix, out_batch, partitions, prepare, saved, shingles, split_join

#: 24 bands of 5 rows miss a pair of similarity 0.85 with probability 8e-7, one of 0.8 with 6e-5.
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
#: Ranges of hashes whose minima are folded, and bits of an odd sketch.
BINS, BITS = 1024, 2048
#: A bucket with at most so many members lists its pairs; members of a block in larger ones.
SMALL, BLOCK = 32, 512
#: Ids that a broadcast may hold; beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Pairs with one text that a task compares, and rows of ids in a file of a round.
PAIRS_OF_TEXT, ROUND_ROWS = 2_000, 100_000

_A = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)


def minhash(h: np.ndarray) -> np.ndarray:
    """SAMPLES minima of multiplicative hashes of the shingles."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 512):
        np.minimum(low, (h[i : i + 512, None] * _A).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)], np.uint64).view(np.int64)


def odd_sketch(h: np.ndarray) -> np.ndarray:
    """Bits that an odd number of samples fall on, as 64-bit words. h: sorted, so a range's least hash is its first."""
    ranges = h >> np.uint64(64 - (BINS.bit_length() - 1))
    samples = h[np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))]
    at = (mix(samples) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing(sizes, percent: int, m=np):
    """The largest XOR count of a pair of this similarity, but for a chance of about 1e-7. sizes: of both sets together;
    m: numpy or pyspark.sql.functions, whose columns it takes as well.

    The union has sizes / (1 + similarity) shingles, which fill some ranges. In a range the samples differ if the union's
    least is not in both: a binomial number of ranges, and no more than the shingles that differ. Each flips a bit, and a
    second one where the other set has a shingle in the range too. Bits that meet lower the count."""
    j = percent / 100
    union = sizes / (1 + j)
    load = union / BINS
    empty = m.exp(-load)
    filled = BINS * (1 - empty)
    by_chance = (1 - j) * filled + 5.5 * m.sqrt(j * (1 - j) * filled) + 2
    ranges = m.least(by_chance, (1 - j) * union) if hasattr(m, "least") else m.minimum(by_chance, (1 - j) * union)
    second = 1 - load * empty / (1 - empty)
    return ranges * (1 + second) + 5.5 * m.sqrt(ranges * second * (1 - second)) + 2


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key, bands, odd of every row; the last three are null without words."""
    prepare(docs.sparkSession)
    ddl = "doc_id long, n_shingles long, key binary, bands array<long>, odd array<long>"
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                h = shingles(text)
                if len(h):
                    low = minhash(h)
                    rows.append((doc, len(h), xxhash.xxh128_digest(h.tobytes()), bands(low), odd_sketch(h)))
                else:
                    rows.append((doc, 0, None, None, None))
            yield out_batch(out, list(zip(*rows)) or [[]] * len(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def differing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def company(pairs: DataFrame, side: str) -> DataFrame:
    """How many pairs each document of one side is in."""
    return saved(pairs.groupBy(side).agg(F.count("*").alias("n")), "company")


def sifted(pairs: DataFrame, reps: DataFrame, percent: int, of: dict[str, DataFrame]) -> DataFrame:
    """Pairs (x, y) whose set sizes and odd sketches allow the similarity. of: how many pairs each y, and x too, is in, where
    that is unbounded."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}"))
    both = pairs
    for c in ("x", "y"):
        both = split_join(both, side(c), c, of[c]) if c in of else both.join(side(c), c)
    sizes = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    return both.where(sizes & (differing("ox", "oy") <= most_differing(F.col("nx") + F.col("ny"), percent, F))).select("x", "y")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, of: dict[str, DataFrame]) -> DataFrame:
    """Pairs (x, y) whose whole shingle sets have 100 * intersection >= percent * union. A text with more than PAIRS_OF_TEXT pairs
    is copied to as many tasks as they fill. of: as for `sifted`."""
    ddl = "x long, y long"
    out = arrow_schema(ddl)
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            found = []
            for x, y, tx, ty in zip(*(b[c].to_pylist() for c in ("x", "y", "tx", "ty"))):
                if last != (y, ty):  # rows come sorted by y from the join: a hub's set is made once
                    last, held = (y, ty), shingles(ty)
                own = shingles(tx)
                both = np.intersect1d(own, held, assume_unique=True).size
                if 100 * both >= percent * (len(own) + len(held) - both):
                    found.append((x, y))
            yield out_batch(out, list(zip(*found)) or [[], []])

    # x first: the hub's text, y, joins last and is not shuffled once for each pair.
    both = pairs
    for c in ("x", "y"):
        both = split_join(both, side(c), c, of[c], rows=PAIRS_OF_TEXT) if c in of else both.join(side(c), c)
    return both.select("x", "y", "tx", "ty").mapInArrow(run, ddl)


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id of the edges (x, y), by alternating large and small stars.

    Each round takes each id's least neighbour, by partial minima, and joins it back; the number of rounds grows with the
    logarithm of the longest path. Rounds are written to the scratch folder, in as many files as they have rows for. An
    id with many neighbours is dealt to several tasks where its minimum is no broadcast."""
    most = partitions(edges.sparkSession)

    def measured(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.lit(0))).first())

    def least(df: DataFrame) -> DataFrame:
        return saved(df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(files), "least")

    e = saved(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    now, state = measured(e), None
    while state != now:
        state, files = now, max(1, min(most, 8 + now[0] // ROUND_ROWS))
        both = e.union(e.select("y", "x")).toDF("u", "v")
        low = least(both)
        large = keyed_join(both, low.select("u", F.least("u", "m").alias("m")), "u", low.select("u", "n"))
        large = saved(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "stars")
        low = least(large)
        small = keyed_join(large, low.select("u", "m"), "u", low.select("u", "n"))
        e = small.select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").union(low.select("u", "m"))
        e = saved(e.distinct().coalesce(files), "edges")
        now = measured(e)
    return e.select(F.col("x").alias("id"), F.col("y").alias("component")).union(e.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct())


def blockwise(members: DataFrame, reps: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (x, y) of different components in large buckets, at most `most` partners of x in each component of each block.

    members: band, rep, component. Those outside the bucket's largest component meet all members, in blocks of rows; what
    is held is two blocks of sketches of one size. Only pairs that the sketches allow are returned, each from the first band that its
    two have in common."""
    ddl = "x long, y long"
    out = arrow_schema(ddl)
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("odd_ones"))
    main = saved(main, "main")
    rows = keyed_join(members, main, "band", main.select("band", F.col("all").alias("n"))).join(reps.select("rep", "n", "odd", "bands"), "rep")
    x_blocks, y_blocks = (F.ceil(F.col(c) / n).cast("int") for c, n in (("odd_ones", BLOCK), ("all", BLOCK)))
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    cols = ["band", "xb", "yb", "rep", "component", "n", "odd", "bands"]
    xs = rows.where("component <> main").withColumn("xb", spread(x_blocks)).withColumn("yb", F.explode(F.sequence(F.lit(0), y_blocks - 1))).select(*cols)
    ys = rows.withColumn("yb", spread(y_blocks)).withColumn("xb", F.explode(F.sequence(F.lit(0), x_blocks - 1))).select(*(F.col(c).alias(c) for c in cols))  # columns of its own, beside xs
    count = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)

    def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
        wide = lambda c: t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return t["rep"].to_numpy(), t["component"].to_numpy(), t["n"].to_numpy().astype(np.float64), wide("odd"), wide("bands")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        (xi, xc, xn, xo, xb), (yi, yc, yn, yo, yb) = arrays(a), arrays(b)
        band = key[0].as_py()
        found_x, found_y = [], []
        for i in range(len(xi)):
            ok = np.flatnonzero((yc != xc[i]) & (100 * np.minimum(yn, xn[i]) >= percent * np.maximum(yn, xn[i])))
            # The first band in common does it.
            ok = ok[yb[ok, np.argmax(yb[ok] == xb[i], axis=1)] == band] if len(ok) else ok
            z = count[(yo[ok] ^ xo[i]).view(np.uint16)].sum(axis=1, dtype=np.int32)
            near = z <= most_differing(yn[ok] + xn[i], percent)
            ok, z = ok[near], z[near]
            if most is not None and len(ok) > most:
                by = np.lexsort((yi[ok], z, yc[ok]))
                ok, group = ok[by], yc[ok][by]
                ok = ok[np.arange(len(ok)) - np.searchsorted(group, group) < most]
            found_x.append(np.full(len(ok), xi[i]))
            found_y.append(yi[ok])
        return pa.table([np.concatenate(found_x), np.concatenate(found_y)], schema=out)

    keys = ["band", "xb", "yb"]
    met = xs.groupBy(*keys).cogroup(ys.groupBy(*keys)).applyInArrow(meet, ddl)
    return met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Linked are documents with 100 * intersection >= percent * union of their sets of distinct 5-word shingles; a text with
    fewer words is one shingle. Null and empty texts and texts without words have the empty set and are linked with
    nothing. component_id is the smallest doc_id that links reach, kept whether that is the document itself. Rows that
    share an id are one document, linked if any of their texts is; a row with a null id has a null component and is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = saved(signatures(docs), "signatures")
    full = sig.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    reps = saved(full.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")
    flat = reps.select(F.explode("bands").alias("band"), "rep").distinct()
    shared = saved(flat.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    sizes = shared.select("band", F.col("size").alias("n"))
    members = saved(keyed_join(flat, shared, "band", sizes), "members")
    met = members.groupBy("rep").agg(F.sum("size").alias("company"))
    hubs = saved(members.join(met, "rep").groupBy("band").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("y")), "hubs")
    pairs = saved(keyed_join(members, hubs, "band", sizes).where("rep <> y").select(F.col("rep").alias("x"), "y").distinct(), "pairs")

    ids = saved(members.select("rep").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = saved(docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["rep"], "left_semi"), "texts")
    sketches = reps.select("rep", "n", "odd", "bands")

    def linked(candidates: DataFrame, *sides: str) -> DataFrame:
        of = {side: company(candidates, side) for side in sides}
        return saved(confirmed(sifted(candidates, sketches, percent, of), texts, percent, of), "links")

    link = linked(pairs, "y")  # x has at most BANDS hubs
    tried = [pairs]
    # An id with several texts joins the classes of all of them.
    several = full.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    keyed = full.join(several, "doc_id", "left_semi").select("doc_id", "key")
    copies = reps.select("key", F.col("copies").alias("n"))
    own = split_join(keyed, reps.select("key", "rep"), "key", copies).select(F.col("doc_id").alias("x"), F.col("rep").alias("y")).where("x <> y")
    found = components(link.union(own))
    rest = members.select("band", "rep", "size")
    for most in (1, 8, None):
        labelled = saved(rest.join(found, rest["rep"] == found["id"], "left").select("band", "rep", "size", F.coalesce("component", "rep").alias("component")), "labelled")
        mixed = saved(labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"), "mixed")
        open_ones = saved(keyed_join(labelled, mixed, "band", sizes), "open")
        if open_ones.isEmpty():
            break
        large = open_ones.where(f"size > {SMALL}")
        rest = large.select("band", "rep", "size")
        more = []
        if most == 1:  # the first time only: all pairs of a small bucket are tried at once
            side = lambda c: open_ones.where(f"size <= {SMALL}").select("band", F.col("rep").alias(c), F.col("component").alias(f"c{c}"))
            more.append(side("x").join(side("y"), "band").where("x > y AND cx <> cy").select("x", "y").distinct())
        if not large.isEmpty():
            more.append(blockwise(large.select("band", "rep", "component"), sketches, percent, most))
        if not more:
            break
        before = reduce(DataFrame.union, [t.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")) for t in tried])
        new = saved(reduce(DataFrame.union, more).distinct().join(before, ["x", "y"], "left_anti"), "new")
        tried.append(new)
        link = linked(new, "x", "y")
        if link.isEmpty():
            if large.isEmpty():
                break
            continue
        found = components(found.select(F.col("id").alias("x"), F.col("component").alias("y")).union(link))
    # Classes first: they are unique, where the documents of one class may be a third of all.
    classes = reps.select("key", "rep").join(found, F.col("rep") == found["id"], "left")
    classes = saved(classes.select("key", F.coalesce("component", "rep").alias("class")), "labels")
    merged = keyed_join(full.select("doc_id", "n_shingles", "key"), classes, "key", copies).select("doc_id", "n_shingles", "class")
    merged = merged.union(sig.where("key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return merged.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is kept, each with all its columns; the others are copies of one that stays."""
    gone = saved(near_duplicates(docs.select("doc_id", "text"), percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
