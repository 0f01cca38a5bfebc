"""Personal data: fixed patterns, and terms that reveal the protected entities by co-occurrence.

What a pattern finds is a protected entity, and so are the classes that it belongs to: its kind, and of a mail address the
domain. The words of a text outside its entities are terms, each together with every entity of the text, however far apart.
Over the corpus, with n(x) the number of documents that hold x, the pointwise mutual information
log2(n(t, e) N / (n(t) n(e))) of a term and an entity is compared with the entity's information content log2(N / n(e)): a
term whose share reaches DISCLOSURE lets a reader infer the entity where the entity itself has been removed, so all its
occurrences in documents that hold the entity become spans too, and sanitised text generalises both to the names of their
kinds. For classes, which are frequent, the estimate is smoothed towards independence, so that a few common documents do not
prove much. A pair must occur in SUPPORT different texts to count. Everything is DataFrame operations: words are counted
with partial aggregation, entities without support and terms that are too frequent to reach the share with any entity are
left out before terms and entities meet, and an entity may stand in any share of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted, saved
from .spans import SPAN, found, kept, let, listed, masked, overlaps

KINDS = ["email", "ip", "card", "phone", "term"]

# Fixed patterns, written so that long runs take linear time and constant stack.
# A local part starts where its run does, or where the last match ended; a domain's dots stand between its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:(?![ -](?![0-9]))[0-9 -]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: A term: a word of two or more letters.
TERM = r"(?<!\p{L})\p{L}{2,}+"
SUPPORT, DISCLOSURE = 2, 0.9
#: Documents without the term's and the class's connection that smoothing adds to what is counted of a class.
SMOOTHING = 1.0
#: Texts whose places a broadcast may hold; beyond, the join is salted.
BROADCAST_TEXTS = 50_000


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    places = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda s, v: s + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns; a match that fails its test is dropped whole, nothing is retried."""
    n = lambda m: F.length(digits(m))
    email = kept(found(text, EMAIL, "@"), 0, lambda m: F.lit(True))
    ip = kept(found(text, IP, "."), 1, lambda m: m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"))
    card = kept(found(text, CARD), 2, lambda m: n(m).between(14, 19) & luhn(digits(m)))
    phone = kept(found(text, PHONE, "+"), 3, lambda m: n(m).between(10, 15))
    return F.concat(email, ip, card, phone)


def words(text: Column) -> Column:
    """The different words of a text as they stand there."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def lowered(found_words: Column) -> Column:
    return F.array_distinct(F.transform(found_words, F.lower))


def classes(entity: Column, kind: Column) -> Column:
    """What an entity belongs to, written as no entity can be."""
    names = F.array(*(F.lit(f"kind:{k}") for k in KINDS))
    domain = F.concat(F.lit("domain:"), F.substring_index(entity, "@", -1))
    return F.when(kind == 0, F.array(F.element_at(names, kind + 1), domain)).otherwise(F.array(F.element_at(names, kind + 1)))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base (spans), entities with their classes, terms (the different ones of each row, in lower case), text_key and, of
    rows with entities, the text."""
    body = F.col(text).cast("string")
    entity = lambda s: F.lower(body.substr(s["start"] + 1, s["end"] - s["start"]))
    named = F.flatten(F.transform("base", lambda s: let(entity(s), lambda e: F.concat(F.array(e), classes(e, s["kind"])))))
    based = docs.withColumn("base", base_spans(body)).withColumn("entities", F.array_distinct(named))
    terms = lowered(words(masked(body, F.col("base"), [""] * len(KINDS))))
    return based.withColumns({"terms": terms, "text_key": F.xxhash64(body), "held": F.when(F.size("base") > 0, body)})


def disclosing(texts: DataFrame, scan: DataFrame, support: int = SUPPORT, share: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """text_key, terms: for each text that holds an entity, those of its terms that disclose it or one of its classes.

    texts: text_key, copies, entities, terms of the different texts with entities; scan: terms of every row. Counts are of
    rows; the support counts different texts, so copies of one text prove nothing."""
    each = texts.select("text_key", "copies", F.explode("entities").alias("entity"))
    entities = saved(each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts"), "entities")
    total = float(max(1, scan.count()))
    most = entities.agg(F.max("n_entity")).first()[0] or 1
    # With both <= n_entity, a term reaches the share only if n_term is not above this; it grows with n_entity.
    bound = lambda n: n * F.pow(total / n, F.lit(1 - share)) * (1 + 1e-9)
    counts = scan.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = counts.where((F.col("n_term") >= support) & (F.col("n_term") <= bound(F.lit(float(most)))))
    held = saved(each.join(entities, "entity"), "held")
    rare = texts.join(held.select("text_key").distinct(), "text_key", "left_semi").select("text_key", F.explode("terms").alias("term")).join(counts, "term")
    near = saved(held.join(rare, "text_key").where(F.col("n_term") <= bound(F.col("n_entity"))), "near")
    pairs = near.groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    prior = F.col("n_entity") / total
    added = F.when(F.col("entity").contains(":"), F.lit(smoothing)).otherwise(0.0)
    mutual = F.log2((F.col("both") + added * prior) / (F.col("n_term") + added) / prior)
    told = pairs.where((F.col("texts") >= support) & (prior < 1) & (mutual >= -share * F.log2(prior))).select("entity", "term")
    return near.join(told, ["entity", "term"]).groupBy("text_key").agg(F.collect_set("term").alias("terms"))


def spanned(scan: DataFrame) -> DataFrame:
    """A written scan with spans in the place of entities, terms, text_key and held; every row has its own."""
    of_text = scan.where(F.size("entities") > 0).groupBy("text_key")
    texts = saved(of_text.agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.first("held").alias("held")), "texts")
    told = saved(disclosing(texts, scan), "told")
    # A pattern of the text's own disclosing words, as they stand in it; words hold letters only.
    forms = F.filter(words(F.col("held")), lambda w: F.array_contains("told", F.lower(w)))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})"))
    placed = F.transform(found(F.col("held"), pattern), lambda m: F.struct(m["start"], m["end"], F.lit(4).alias("kind")))
    marked = texts.select("text_key", "held").join(told.withColumnRenamed("terms", "told"), "text_key")
    places = saved(marked.select("text_key", placed.alias("places")), "places")
    joined = scan.join(F.broadcast(places), "text_key", "left") if places.count() <= BROADCAST_TEXTS else salted(scan, places, "text_key", "left")
    free = F.filter(F.coalesce("places", F.array().cast(SPAN)), lambda m: ~F.exists("base", lambda b: overlaps(b, m)))
    return joined.withColumn("spans", F.concat("base", free)).drop("entities", "terms", "text_key", "held", "places")


def personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and spans (start, end, kind as a place in KINDS) of every row of docs (doc_id, text).

    Null and empty texts have no spans; rows that repeat an id or a text each get their own."""
    rows = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("body"))
    return spanned(saved(scanned(rows, "body").drop("body"), "personal")).select("doc_id", "base", "spans")


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data and the terms that reveal it replaced by their kinds in angle brackets; null texts stay null.

    Each row is masked at its own spans, whatever its id."""
    # The row is carried whole, so its columns may have the scan's names.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").cast("string").alias("body"))
    marked = spanned(saved(scanned(rows, "body").drop("body"), "personal"))
    clean = masked(F.col(f"row.`{text}`").cast("string"), F.col("spans"), KINDS)
    return marked.select(*((clean if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(found_spans: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the listed base spans, and all spans listed."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found_spans.select("doc_id", *map(count, range(4)), F.sha2(listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))
