"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

A candidate is a maximal run of 16 or more letters, digits and + / _ = -, with dots inside; what the patterns found is rated
too, and a token may lie in, extend or cross their spans. Its encoding (digits, hex, letters, base32,
base64) is inferred from its characters and gives the size of the alphabet. Three tests each ask whether the token could
still be written by people, their null hypothesis: chi-squared, against the non-central distribution that letters of a
language give; runs, against what people write in that encoding: the many changes between vowels and others of words for
letters and base32, the few between low and high digits of counted or grouped numbers for digits, and the few changes of
character class of an identifier for the others; serial correlation, against the strong one of a pattern such as abcdef
or 012345. A token must fail all of them, so its p-value is the largest of the three. All grow
sharper with the length. Over the whole corpus the p-values of each class of length go through a Benjamini-Hochberg
step, on a histogram of bounded size, so that of the tokens reported in each class a share of at most FDR is expected to
be none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .spans import found, kept, let, listed, masked, upper_tail

KINDS = ["assign", "access", "hex", "random"]

# Fixed patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

# Of one-character steps only, so that long runs take constant stack.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-](?:(?!\.(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=.-]){15,}+"

#: Share of false reports that is allowed in each class of length.
FDR = 0.01
#: p-values are counted by steps of 10 ** -0.05 down to 10 ** -20.
STEP, STEPS = 0.05, 400
#: What people write: change of class from one character to the next, of vowels and others in words, serial correlation of a pattern.
CHANGES, ALTERNATION, CORRELATION = 0.15, 0.55, 0.75


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns. Of an assignment that is too short the whole match is dropped; nothing is retried."""
    assign = kept(found(text, ASSIGN), 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6)
    access = kept(found(text, ACCESS, "AKIA"), 1, lambda m: F.lit(True))
    hexes = kept(found(text, HEX), 2, lambda m: F.lit(True))
    return F.concat(assign, access, hexes)


def p_value(token: Column) -> Column:
    """The battery's p-value of a token: small if it looks random in every way."""
    n = F.length(token).cast("double")
    # Encoding: alphabet size, and the excess of a language's sum of squared frequencies over a uniform alphabet's.
    digits, hexes, letters, base32 = token.rlike("^[0-9]+$"), token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), token.rlike("^([a-z]+|[A-Z]+)$"), token.rlike("^([A-Z2-7]+|[a-z2-7]+)=*$")
    size = F.when(digits, 10.0).when(hexes, 16.0).when(letters, 26.0).when(base32, 32.0).otherwise(64.0)
    excess = size * F.when(digits | hexes, 0.25).otherwise(0.066) - 1
    squares = F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda s, c: s + F.when(c != "", F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), 2)).otherwise(0.0))
    chi2 = size * squares / n - n
    expected = (size - 1) + (n - 1) * excess
    spread = F.sqrt(2 * (size - 1) + 4 * (n - 1) * excess)
    by_chi2 = upper_tail((expected - chi2) / spread)

    def changes(*marks: tuple[str, str]) -> Column:
        classes = token
        for pattern, mark in marks:
            classes = F.regexp_replace(classes, pattern, mark)
        return F.length(classes) - 1

    more = lambda c: upper_tail((c - (n - 1) * CHANGES - 0.5) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES)))
    fewer = lambda c: upper_tail(((n - 1) * ALTERNATION - c - 0.5) / F.sqrt((n - 1) * ALTERNATION * (1 - ALTERNATION)))
    by_runs = (
        F.when(digits, more(changes(("[0-4]+", "~"), ("[5-9]+", "-"))))
        .when(~hexes & (letters | base32), fewer(changes(("[aeiouAEIOU]+", "~"), ("[^~]+", "-"))))
        .otherwise(more(changes(("[A-Z]+", "~"), ("[a-z]+", "a"), ("[0-9]+", "0"), ("[+/_=-]+", "-"))))
    )

    def serial(x: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

        def around(mean: Column) -> Column:
            spread2 = total(F.transform(x, lambda v: v * v)) - n * mean * mean
            lag = total(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: (a - mean) * (b - mean)))
            r = F.when(spread2 > 0, F.least(F.abs(lag / spread2), F.lit(0.999))).otherwise(F.lit(0.999))
            return upper_tail((F.atanh(F.lit(CORRELATION)) - F.atanh(r)) * F.sqrt(n - 3))

        return let(total(x) / n, around)  # once, not for each character

    by_serial = let(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double")), serial)
    return F.greatest(by_chi2, by_runs, by_serial)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __base (spans) and __tokens (array of start, end, step of the p-value, class of length) to every row."""
    body = F.col(text).cast("string")
    step = lambda t: F.least(F.floor(-F.log10(F.greatest(p_value(t), F.lit(1e-300))) / STEP), F.lit(STEPS)).cast("int")
    rated = lambda tokens: F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), step(t["text"]).alias("step"), F.floor(F.log2(t["end"] - t["start"])).cast("int").alias("length")))
    none = F.array().cast("array<struct<start:int,end:int,step:int,length:int>>")
    tokens = let(found(body, TOKEN), lambda found_tokens: F.when(F.size(found_tokens) > 0, rated(found_tokens)).otherwise(none))
    return docs.withColumn("__base", base_spans(body)).withColumn("__tokens", tokens)


def thresholds(scan: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The least step of a p-value that is reported, for each class of length; from counts of all tokens, at most STEPS + 1 for each class."""
    counts = scan.select(F.explode("__tokens").alias("t")).groupBy("t.length", "t.step").agg(F.count("*").alias("n"))
    above = Window.partitionBy("length").orderBy(F.col("step").desc())
    rows = counts.withColumn("reported", F.sum("n").over(above)).withColumn("all", F.sum("n").over(Window.partitionBy("length")))
    good = rows.where(F.col("all") * F.pow(F.lit(10.0), -STEP * F.col("step")) <= fdr * F.col("reported"))
    return {r["length"]: r["step"] for r in good.groupBy("length").agg(F.min("step").alias("step")).collect()}


def with_random(scan: DataFrame, least: dict[int, int]) -> DataFrame:
    """Adds __spans: the base ones, and the tokens that pass their class's threshold."""
    def reported(t: Column) -> Column:
        out = F.lit(False)
        for length, step in sorted(least.items()):
            out = out | ((t["length"] == length) & (t["step"] >= step))
        return out

    random = F.transform(F.filter("__tokens", reported), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(3).alias("kind")))
    return scan.withColumn("__spans", F.concat("__base", random)).drop("__tokens")


def secrets(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """All columns of docs but the text, and base and spans (start, end, kind as a place in KINDS) of each row.

    Columns of docs that are named base or spans give way to these. Null and empty texts have no spans. The scan is written
    once, without the texts, and read for the thresholds and the result.
    """
    scan = saved(scanned(docs, text).drop(text, "base", "spans"), "secrets")
    return with_random(scan, thresholds(scan, fdr)).withColumnsRenamed({"__base": "base", "__spans": "spans"})


def digest(found_spans: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the listed base spans, and all spans listed."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found_spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """docs with every secret of the text replaced by its kind in angle brackets; null texts stay null.

    The scan is written once, with the rows."""
    # The row is carried whole, so its columns may have the scan's names.
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").cast("string").alias("body"))
    scan = saved(scanned(held, "body").drop("body"), "secrets")
    marked = with_random(scan, thresholds(scan, fdr))
    clean = masked(F.col(f"row.`{text}`").cast("string"), F.col("__spans"), KINDS)
    return marked.select(*((clean if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
