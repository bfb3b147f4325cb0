"""Personal data in texts: fixed patterns, and further spans by weak supervision.

Labelers vote on every candidate span; expectation-maximisation estimates from the votes how reliable each labeler is
and how likely each pattern of votes means personal data; those likelihoods train a classifier of spans. Everything over
documents is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .staging import stage

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that a scan stays linear: a run is entered at its start, or where the last match ended, and never given back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms that the fixed patterns miss: spelt-out addresses, hexadecimal addresses, dotted cards, phones without a plus.
LOOSE = {
    "email_loose": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "ip_loose": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Za-z:])",
    "card_loose": r"(?<![0-9./])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9./])",
    "phone_loose": r"(?<![0-9A-Za-z+./-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z/-])",
}
GUARDS = {"email": "@", "phone": "+", "email_loose": "at", "ip_loose": ":"}
#: Words before a span that speak for its kind, and words that speak against any kind.
CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "address", "host", "server", "login from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial"),
}
AGAINST = ("version", "isbn", "order", "invoice", "page", "section", "doi", "build")
#: Gazetteer: endings of mail domains, leading digits of cards, leading digits of international numbers.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co")
CONTEXT = 32
THRESHOLD = 0.9
ROUNDS = 50
LABELERS = ("pattern", "gazetteer", "context", "check")


def luhn(digits: str) -> str:
    """SQL that tells whether the digits of the SQL value pass the check: from the right, every second is doubled."""
    value = f"cast(substring({digits}, length({digits}) - i, 1) as int) * (1 + i % 2)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + {value} - if({value} > 9, 9, 0)) % 10 = 0"


def base_spans(df: DataFrame) -> DataFrame:
    """Add ``base``, the valid matches of the fixed patterns in ``df.text``, and ``failed``, those that fail their check."""
    df = spans.find(df, BASE, {k: GUARDS[k] for k in BASE if k in GUARDS})
    digits = "regexp_replace(s.found, '[^0-9]', '')"
    valid = {
        "ip": "forall(split(s.found, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(right(concat('0', ltrim('0', p)), 4) as int), 0) <= 255)",
        "card": f"if(length({digits}) between 14 and 19, {luhn(digits)}, false)",
        "phone": f"length({digits}) between 10 and 15",
    }
    judged = ", ".join(f"transform({k}, s -> named_struct('kind', if({v}, '{k}', '{k}_failed'), 'start', s.start, 'stop', s.stop, 'found', s.found))" for k, v in valid.items())
    df = df.withColumn("judged", F.expr(f"concat(email, {judged})")).drop(*BASE)
    return df.withColumns({"base": F.expr("filter(judged, s -> not s.kind like '%failed')"), "failed": F.expr("filter(judged, s -> s.kind like '%failed')")}).drop("judged")


def _candidates(df: DataFrame) -> DataFrame:
    """Add ``candidates``: base spans, and looser ones that overlap none of them, with their labelers' votes and features.

    Looser are the forms of LOOSE, and matches of the fixed patterns that fail their check: cards with a wrong digit, addresses
    with a part above 255, short or long phone numbers."""
    df = spans.find(df, LOOSE, {k: GUARDS[k] for k in LOOSE if k in GUARDS})
    df = df.withColumn("loose", F.expr(f"filter(concat(failed, {', '.join(LOOSE)}), s -> not exists(base, b -> b.start < s.stop and s.start < b.stop))")).drop(*LOOSE, "failed")
    df = df.withColumn("all", F.expr("concat(transform(base, s -> struct(s.*, true as strict)), transform(loose, s -> struct(s.*, false as strict)))".replace("struct(s.*, true as strict)", "named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop, 'found', s.found, 'strict', true)").replace("struct(s.*, false as strict)", "named_struct('kind', substring_index(s.kind, '_', 1), 'start', s.start, 'stop', s.stop, 'found', s.found, 'strict', false)")))
    around = f"lower(substring(text, greatest(1, s.start - {CONTEXT - 1}), s.start + 1 - greatest(1, s.start - {CONTEXT - 1})))"
    df = df.withColumn("all", F.expr(f"transform(all, s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop, 'found', s.found, 'strict', s.strict, 'before', {around}, 'digits', regexp_replace(s.found, '[^0-9]', '')))"))
    cue = "case s.kind " + " ".join(f"when '{k}' then s.before rlike '(?<![a-z])({'|'.join(v)})'" for k, v in CUES.items()) + " end"
    against = f"s.before rlike '(?<![a-z])({'|'.join(AGAINST)})'"
    known = f"""case s.kind
        when 'email' then lower(regexp_extract(s.found, '([A-Za-z0-9-]+)$', 1)) in ({', '.join(f"'{e}'" for e in ENDINGS)})
        when 'ip' then not s.found rlike '^(0|1)[.]'
        when 'card' then s.digits rlike '^(3[47]|4|5[1-5]|2[2-7]|6)'
        when 'phone' then not s.digits rlike '^0*$' end"""
    check = f"""case s.kind
        when 'card' then length(s.digits) between 14 and 19 and {luhn('s.digits')}
        when 'phone' then length(s.digits) between 10 and 15 and not s.digits rlike '^([0-9])\\\\1+$'
        when 'ip' then s.found like '%:%' or not s.found rlike '(^|[.])(0[0-9]|[3-9][0-9]{{2}}|2[6-9][0-9]|25[6-9]|[0-9]{{4}})'
        when 'email' then length(s.found) between 6 and 120 end"""
    votes = f"""transform(all, s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop, 'strict', s.strict,
        'pattern', if(s.strict, 1, 0), 'gazetteer', if({known}, 1, -1), 'context', if({against}, -1, if({cue}, 1, 0)), 'check', if({check}, 1, -1),
        'length', least(4, cast(length(s.found) div 8 as int)), 'share', cast(floor(4 * length(s.digits) / length(s.found)) as int)))"""
    return df.withColumn("candidates", F.expr(votes)).drop("all", "loose")


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, how often): how likely each pattern of votes is personal data.

    Each labeler has a rate of each of its votes for either class, the same for all kinds, and each kind has a share of
    true spans. All start from the labelers' majority; one occurrence of each vote and class is added throughout.
    """
    if not patterns:
        return {}
    likely = {(k, v): 1 / (1 + math.exp(-sum(v))) for k, v, _ in patterns}
    for _ in range(rounds):
        share: dict[str, float] = {}
        for kind in {k for k, _, _ in patterns}:
            own = [(likely[k, v], n) for k, v, n in patterns if k == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        rate: dict[tuple[int, int, bool], float] = {}
        for i in range(len(LABELERS)):
            for true in (True, False):
                mass = {vote: 1.0 + sum((likely[k, v] if true else 1 - likely[k, v]) * n for k, v, n in patterns if v[i] == vote) for vote in (-1, 0, 1)}
                for vote, m in mass.items():
                    rate[i, vote, true] = m / sum(mass.values())
        for k, v, _ in patterns:
            odds = math.log(share[k] / (1 - share[k])) + sum(math.log(rate[i, vote, True] / rate[i, vote, False]) for i, vote in enumerate(v))
            likely[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return likely


FEATURES = [f"kind_{k}" for k in KINDS] + [f"{n}_{s}" for n in LABELERS[1:] for s in ("for", "against")] + ["length", "share"]


def _feature(name: str) -> str:
    if name.startswith("kind_"):
        return f"if(s.kind = '{name[5:]}', 1.0, 0.0)"
    if name in ("length", "share"):
        return f"s.{name} / 4.0"
    labeler, side = name.rsplit("_", 1)
    return f"if(s.{labeler} = {1 if side == 'for' else -1}, 1.0, 0.0)"


def train(candidates: DataFrame) -> dict[str, float] | None:
    """Weights of the span classifier by feature name and ``bias``; None where there is nothing to learn.

    ``candidates`` has one row for each span. Only counts of equal votes and features leave the executors, of which there
    can't be more than the kinds, votes and two five-step features allow. The classifier doesn't see the pattern vote,
    so it judges loose spans by what base spans look like. Its labels are the likelihoods as weights of both classes.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    columns = ["kind", *LABELERS, "length", "share"]
    counted = candidates.groupBy(*columns).agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in counted:
        key = (r["kind"], tuple(r[n] for n in LABELERS))
        patterns[key] = patterns.get(key, 0) + r["n"]
    likely = reliabilities([(k, v, n) for (k, v), n in sorted(patterns.items())])
    rows = []
    for r in counted:
        p = likely[r["kind"], tuple(r[n] for n in LABELERS)]
        rows += [(*[r[c] for c in columns], 1.0, p * r["n"]), (*[r[c] for c in columns], 0.0, (1 - p) * r["n"])]
    # one certain example against each kind keeps the classifier defined where all votes agree
    rows += [(k, 0, -1, -1, -1, 0, 0, 0.0, 1.0) for k in KINDS]
    if not counted:
        return None
    names = ", ".join(f"{c} {'string' if c == 'kind' else 'int'}" for c in columns)
    table = candidates.sparkSession.createDataFrame(rows, f"{names}, label double, weight double").withColumn("s", F.struct(*columns))
    table = table.select(*[F.expr(_feature(f)).cast("double").alias(f) for f in FEATURES], "label", "weight")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=100).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table))
    return dict(zip(FEATURES, model.coefficients.toArray().tolist(), strict=True)) | {"bias": model.intercept}


def _accepted(weights: dict[str, float] | None, threshold: float) -> Column:
    if weights is None:
        return F.array().cast("array<struct<kind: string, start: int, stop: int>>")
    score = " + ".join([repr(weights["bias"]), *[f"{weights[f]!r} * {_feature(f)}" for f in FEATURES]])
    level = math.log(threshold / (1 - threshold))
    # no weighing makes up for a failed check: a card of 300,000 digits or with a wrong one, an address part above 255
    return F.expr(f"transform(filter(candidates, s -> not s.strict and s.check = 1 and cast({score} as double) >= {level!r}), s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop))")


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, base, added)`` for every row of ``docs``: arrays of (kind, start, stop) in code points.

    base are the valid matches of the fixed patterns; added are the spans that the trained classifier accepts with
    ``threshold``, none of which overlaps a base span or fails the check of its kind. Null and empty texts have neither. Repeated rows get equal
    results, null doc_ids stay null, other columns are not used, and an empty table gives an empty one. The texts are
    scanned once; training and the result read the spans found then.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = stage(_candidates(base_spans(texts)).select("doc_id", "candidates"), "pii-candidates")
    weights = train(found.select(F.explode("candidates").alias("s")).select("s.*"))
    base = F.expr("transform(filter(candidates, s -> s.strict), s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop))")
    return found.select("doc_id", base.alias("base"), _accepted(weights, threshold).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the text of all spans, per row of find_personal_data."""
    out = found.withColumn("every", F.concat("base", "added"))
    counts = [spans.count("base", k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans.joined("base", KINDS), 256).alias("base_sha256"), spans.joined("every", KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size("every").cast("long").alias("n_personal"))
