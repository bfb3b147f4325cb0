"""Secrets in texts: fixed patterns, and further tokens that look random and could hardly be text.

A token is a secret of the method if no test of the battery tells it from a random string of its encoding, and if its
likelihood as text is so small beside that as a random string that, over all tokens of its lengths, the rate of false
discoveries stays under a bound. Everything over documents is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .staging import stage

KINDS = ("assign", "access", "hex")
#: The fixed patterns with the least length of a match, written so that a scan stays linear where that changes nothing.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
LAST_GROUP = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Candidates of the battery: runs of an encoding's signs, long enough, with both letters and digits or with a capital after a small letter.
TOKEN = {"random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9+/_=-])"}
MIXED = "[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]|[a-z][A-Z]"
#: Encodings from narrow to wide: name, pattern of the whole token, signs in order of their value.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64_url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Bound of the false-discovery rate among the tokens reported, and the strata of lengths it holds in.
RATE = 0.01
STRATA = (16, 20, 24, 32, 48, 64, 1 << 30)
#: A token is random to the battery if its combined p-value is at least this: so large a share of random tokens is lost.
SIZE = 0.001
#: Bins of the p-values of the text hypothesis: so many to a power of ten, down to 10^-DECADES.
BINS, DECADES = 4, 300
#: Text as the other hypothesis: shares of the letters in per mille, and the chance that the next sign is of another class
#: (small letter, capital, digit, other sign) than the last, shared evenly by the three others.
LETTERS = {"a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24, "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1}
CHANGE = 0.15


def base_spans(df: DataFrame) -> DataFrame:
    """Add ``base``, the valid matches of the fixed patterns in ``df.text``."""
    df = spans.find(df, BASE, {"access": "AKIA"})
    group = "regexp_extract(s.found, '" + LAST_GROUP.replace("\\", "\\\\").replace("'", "\\'") + "', 1)"
    return df.withColumn("base", F.expr(f"concat(filter(assign, s -> length({group}) >= 6), access, hex)")).drop(*BASE)


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of a standard normal, by Abramowitz and Stegun's rational form 26.2.17 (errors below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / 2.5066282746310002 * series)


def text_likelihood() -> Column:
    """log10 of the likelihood of ``body`` as text: a chain over classes of signs, letters by their shares, others evenly."""
    shares = {**{c: n / 1000 for c, n in LETTERS.items()}, **dict.fromkeys("0123456789", 0.1), **dict.fromkeys("+/_-", 0.25)}
    logs = ", ".join(f"{math.log10(x)!r}D" for x in shares.values())
    signs = f"aggregate(split(lower(body), ''), 0D, (t, c) -> t + element_at(array({logs}), locate(c, '{''.join(shares)}')))"
    runs = F.regexp_count("body", F.lit("[a-z]+|[A-Z]+|[0-9]+|[+/_-]+"))
    return F.expr(signs) + (runs - 1) * math.log10(CHANGE / 3) + (F.col("n") - runs) * math.log10(1 - CHANGE)


def battery(tokens: DataFrame) -> DataFrame:
    """Add the tests' p-values to a table with ``found``; tokens of no encoding have nulls.

    chi: uniform use of the encoding's signs (Wilson-Hilferty, upper tail). runs: number of runs above and below the middle
    of the alphabet (Wald-Wolfowitz, both tails). serial: correlation of neighbouring signs' values (both tails).
    p: Fisher's combination of the three, against the hypothesis that the token is random. log_p_text: log10 of a p-value
    against the hypothesis that it is text, which is 1 for tokens that p, below SIZE, tells from random ones.
    """
    body = F.rtrim(F.col("found"), F.lit("="))
    signs = F.lit(None).cast("string")
    for _, pattern, alphabet in reversed(ENCODINGS):
        signs = F.when(body.rlike(pattern), F.lit(alphabet)).otherwise(signs)
    df = tokens.withColumn("body", body).withColumn("signs", signs)
    df = df.withColumns({"n": F.length("body").cast("double"), "m": F.length("signs").cast("double")})
    df = df.withColumn("v", F.expr("transform(split(body, ''), c -> cast(locate(c, signs) as double))"))
    tally = "aggregate(transform(array_distinct(v), x -> cast(size(filter(v, y -> y = x)) as double)), 0D, (t, c) -> t + c * c)"
    df = df.withColumns(
        {
            "x2": F.expr(f"{tally} * m / n - n"),
            "high": F.expr("cast(size(filter(v, x -> x > (m + 1) / 2)) as double)"),
            "runs": F.expr("1D + size(filter(sequence(1, size(v) - 1), i -> (v[i] > (m + 1) / 2) != (v[i - 1] > (m + 1) / 2)))"),
            "mean": F.expr("aggregate(v, 0D, (t, x) -> t + x) / n"),
        }
    )
    df = df.withColumns(
        {
            "square": F.expr("aggregate(v, 0D, (t, x) -> t + (x - mean) * (x - mean))"),
            "lagged": F.expr("aggregate(sequence(1, size(v) - 1), 0D, (t, i) -> t + (v[i] - mean) * (v[i - 1] - mean))"),
        }
    )
    free = F.col("m") - 1
    hilferty = (F.pow(F.greatest(F.col("x2"), F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    low = F.col("n") - F.col("high")
    expected = 2 * F.col("high") * low / F.col("n") + 1
    variance = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    chi = F.when(hilferty > 0, _normal_tail(hilferty) / 2).otherwise(1 - _normal_tail(hilferty) / 2)
    runs = F.when(variance > 0, _normal_tail((F.col("runs") - expected) / F.sqrt(variance))).otherwise(0.0)
    serial = F.when(F.col("square") > 0, _normal_tail((F.col("lagged") / F.col("square") + 1 / F.col("n")) * F.sqrt(F.col("n")))).otherwise(0.0)
    df = df.withColumns({"p_chi": chi, "p_runs": runs, "p_serial": serial})
    half = -sum(F.log(F.greatest(F.col(p), F.lit(1e-300))) for p in ("p_chi", "p_runs", "p_serial"))
    # the upper tail of chi-squared with six degrees of freedom
    df = df.withColumn("p", F.when(F.col("signs").isNotNull(), F.exp(-half) * (1 + half + half * half / 2)))
    # a likelihood ratio of c or more has a probability of 1/c at most under its denominator, so this is a p-value against text
    ratio = text_likelihood() + F.col("n") * F.log10("m")
    df = df.withColumn("log_p_text", F.when(F.col("signs").isNotNull(), F.when(F.col("p") < SIZE, 0.0).otherwise(F.least(F.lit(0.0), ratio))))
    return df.drop("v", "square", "lagged", "mean", "runs", "high")


def stratum(n: Column) -> Column:
    return sum((n >= bound).cast("int") for bound in STRATA[1:])


def cut_offs(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """``(family, stratum, cut)``: Benjamini-Hochberg over all tested tokens of each family and stratum of lengths.

    P-values are counted by bins of 1/BINS power of ten, each taken for its upper end. Tokens of bin ``cut`` and beyond are
    reported; among them the expected share of texts is at most ``rate``. The table has two rows for each stratum; the bins
    are counted by a partial aggregation, so the number of tokens doesn't matter.
    """
    bins = tested.groupBy("family", "stratum", "bin").agg(F.count("*").alias("c"))
    ordered = Window.partitionBy("family", "stratum").orderBy(F.desc("bin"))
    every = Window.partitionBy("family", "stratum")
    ranked = bins.withColumns({"rank": F.sum("c").over(ordered), "total": F.sum("c").over(every)})
    passes = -F.col("bin") / BINS <= math.log10(rate) + F.log10(F.col("rank") / F.col("total"))
    return ranked.groupBy("family", "stratum").agg(F.min(F.when(passes, F.col("bin"))).alias("cut")).where("cut is not null")


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``(doc_id, base, added, confirmed)`` for every row of ``docs``: arrays of (kind, start, stop) in code points, and a number.

    base are the valid matches of the fixed patterns. added, of kind random, are tokens that overlap none of them and that
    the battery and the text hypothesis report under false-discovery control, per stratum of lengths over the whole
    corpus; confirmed counts the tokens inside base spans that are reported likewise, as a family of their own. Null and
    empty texts have neither. Repeated rows get equal results, null doc_ids stay null, other columns are not used, and an
    empty table gives an empty one. The texts are scanned once; the control and the result read the tokens found then.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = spans.find(base_spans(texts), TOKEN)
    family = "if(exists(base, b -> b.start < s.stop and s.start < b.stop), 'base', 'free')"
    tokens = F.expr(f"transform(filter(random, s -> s.found rlike '{MIXED}'), s -> named_struct('start', s.start, 'stop', s.stop, 'found', s.found, 'family', {family}))")
    plain = F.expr("transform(base, s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop))")
    found = stage(marked.select("doc_id", plain.alias("base"), tokens.alias("tokens")).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    tested = battery(found.select("row", F.explode("tokens").alias("s")).select("row", "s.start", "s.stop", "s.found", "s.family")).where("signs is not null")
    bin_ = F.least(F.lit(BINS * DECADES), F.floor(-F.col("log_p_text") * BINS)).cast("int")
    tested = stage(tested.select("row", "start", "stop", "family", stratum(F.col("n")).alias("stratum"), bin_.alias("bin")), "secret-tests")
    # at most two rows for each stratum
    reported = tested.join(F.broadcast(cut_offs(tested, rate)), ["family", "stratum"]).where("bin >= cut")
    span = F.when(F.col("family") == "free", F.struct(F.lit("random").alias("kind"), "start", "stop"))
    added = reported.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("added"), F.count_if(F.col("family") == "base").alias("confirmed"))
    empty = F.array().cast("array<struct<kind: string, start: int, stop: int>>")
    return found.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"), F.coalesce("confirmed", F.lit(0).cast("long")).alias("confirmed"))


def summary(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the text of all spans, per row of find_secrets."""
    out = found.withColumn("every", F.concat("base", "added"))
    counts = [spans.count("base", k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans.joined("base", KINDS), 256).alias("base_sha256"), spans.joined("every", (*KINDS, "random")).alias("spans"), F.size("added").cast("long").alias("n_added"), "confirmed", F.size("every").cast("long").alias("n_secrets"))
