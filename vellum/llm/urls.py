"""URL filters: ordered rules, else a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict); a rule is a host and the beginning of a path. The longest that fits decides.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
SIZES = (3, 4, 5)
DIMENSIONS = 1 << 14
#: Without a rule, a url is blocked from this probability on. Set by hand, near what ``choose_threshold`` finds by
#: cross-validation over hosts (0.85 at PRECISION, 0.5 at a precision of 0.95); over words, none reaches PRECISION; see the README.
THRESHOLD = 0.8
PRECISION = 0.99
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The words of the labelled table. Hosts to be blocked have a word of BAD, the others have none; GOOD has words that only
#: look like them. Paths of both kinds share the forms of PATHS, so a path counts only where it has such words itself.
BAD = "casino poker bets betting slots jackpot roulette lottery gambling xxx porn adult sex nude escort cams hentai viagra cialis pills pharmacy replica warez crack keygen torrent pirated payday loans spam malware phishing popup ads adserver tracker track banner clickbait prize winner win cheap free".split()
GOOD = "garden library museum weather recipes history science school travel music council herald gazette cycling bridge river mountain bakery hotel clinic theatre studio market report archive forum wiki docs tools press better alphabet freedom cheaper winter window trackside address roads heads pillow essex middlesex shadow loading download bettina adulthood slotted broker shopping student encyclopedia".split()
SYLLABLES = "an ber co den er fi gra han in jo ka li mon nor ol per qui ren sta tion ul ver wen yr zel the ing ough str ch ly ble".split()
LABELS_OF_HOSTS = ("", "www.", "m.", "blog.", "shop.", "news.", "static.", "en.")
ENDINGS = (".com", ".org", ".net", ".info", ".co.uk", ".de", ".example", ".example.com", ".example.org", ".example.net", ".io")
PATHS = ("/", "", "/{n}", "/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/{w}/{n}", "/{w}-{v}.html", "/articles/{w}", "/2021/05/{w}-and-{v}", "/{w}/", "/index.php", "/wiki/{w}")
HOSTS_EACH = 1_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; and on from there up to ``?``, ``#``
    or the end. Both are empty for null and where there is no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def labelled_urls(spark) -> DataFrame:
    """The small built-in table ``(host, path, label, word, words)``, 1 to be blocked: HOSTS_EACH invented hosts of each kind and a
    path for each; ``word`` is the host's own, ``words`` all that host and path are made of.

    Names are put together from the words above and nonsense syllables by a seeded generator, so the table is the same always.
    """
    rng = random.Random(20240601)
    noise = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))
    rows = []
    for i in range(2 * HOSTS_EACH):
        bad = i % 2
        word = (BAD if bad else GOOD)[i // 2 % len(BAD if bad else GOOD)]
        other = rng.choice((noise(), noise(), rng.choice(GOOD), rng.choice(BAD if bad else GOOD)))
        name = rng.choice((f"{word}-{other}", f"{other}-{word}", f"{other}{word}", f"{word}{other}", word, f"{other}-{word}-{noise()}"))
        if not bad and rng.random() < 0.5:
            name = rng.choice((noise(), noise() + noise(), f"{noise()}-{noise()}"))
        words = BAD if bad and rng.random() < 0.5 else [*GOOD, noise()]
        path = rng.choice(PATHS).format(n=rng.randint(1, 99_999), w=rng.choice(words), v=rng.choice(words))
        used = [w for w in (*BAD, *GOOD) if w in name or w in path]
        rows.append((rng.choice(LABELS_OF_HOSTS) + name + rng.choice(ENDINGS), path, float(bad), word if word in name else name, used))
    return spark.createDataFrame(rows, "host string, path string, label double, word string, words array<string>").coalesce(1)


def choose_threshold(labelled: DataFrame, precision: float = PRECISION, folds: int = FOLDS, by: str = "host") -> tuple[float, float, float]:
    """``(threshold, precision, recall)``: the least probability that reaches ``precision`` when every host is scored by a model that hasn't
    seen it, or the one of best precision where none does: blocking a good site costs more than letting a bad one through.

    Hosts are dealt to folds by hash. With ``by="word"``, words are, and a fold's model is fitted on the rows that hold none of
    its words: that tells how it does on words the table doesn't have. Only counts by steps of a twentieth leave the executors.
    """
    from pyspark.ml.functions import vector_to_array

    fold = lambda word: F.pmod(F.xxhash64(word), F.lit(folds))
    rows = labelled.withColumn("fold", fold(F.col(by))).withColumn("seen", F.transform(F.col("words") if by == "word" else F.array(by), fold)).cache()
    scored = None
    for k in range(folds):
        apart = rows.where((F.col("fold") != k) & ~F.array_contains("seen", F.lit(k).cast("long")))
        part = train(apart).transform(_grams(rows.where(F.col("fold") == k)))
        part = part.select("label", F.floor(vector_to_array("probability")[1] * 20).cast("int").alias("step"))
        scored = part if scored is None else scored.union(part)
    counts = {(r["step"], r["label"]): r["count"] for r in scored.groupBy("step", "label").count().collect()}
    rows.unpersist()
    found = []
    for step in range(1, 20):
        hit = sum(n for (s, y), n in counts.items() if s >= step and y == 1)
        wrong = sum(n for (s, y), n in counts.items() if s >= step and y == 0)
        missed = sum(n for (s, y), n in counts.items() if s < step and y == 1)
        found.append((step / 20, hit / max(1, hit + wrong), hit / max(1, hit + missed)))
    return next((f for f in found if f[1] >= precision), max(found, key=lambda f: f[1]))


def _grams(df: DataFrame) -> DataFrame:
    """Add ``grams``: the different n-grams of host and path, each marked with where it is from. All digits count as 0."""

    def cut(name: str, n: int) -> Column:
        whole = F.concat(F.lit("^"), F.translate(F.lower(F.col(name)), "123456789", "0" * 9), F.lit("$"))
        last = F.char_length(whole) - n + 1
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(f"{name[0]}{n}:"), F.substr(whole, i, F.lit(n))))
        return F.when(last > 0, pieces).otherwise(F.array().cast("array<string>"))

    parts = [cut(name, n) for name in ("host", "path") for n in SIZES]
    return df.withColumn("grams", F.array_distinct(F.concat(*parts)))


def train(labelled: DataFrame):
    """A pipeline from ``grams`` to ``score`` fitted on ``(host, path, label)``; rows with nulls are left out.

    The table is meant to be small and the number of dimensions is fixed, so the model is too.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = _grams(labelled.dropna(subset=["host", "path", "label"]))
    stages = [HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="grams", outputCol="features"), LogisticRegression(regParam=0.01, maxIter=60, probabilityCol="probability")]
    return Pipeline(stages=stages).fit(rows.select("grams", "label"))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule, as (rule, verdict), that fits: its host is the url's or a parent domain of it and its path begins
    the url's. Null where none does. The rules are part of the plan, so their number is meant to be some hundreds."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages``.

    score is the model's probability that the url is to be blocked. The verdict is that of the longest fitting rule,
    else block from ``threshold`` on. Null urls and those without ``://`` have an empty host and path and are judged by
    the model like any other. Repeated rows get equal results, null page_ids stay null, other columns are not used, and an
    empty table gives an empty one.
    """
    from pyspark.ml.functions import vector_to_array

    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    scored = model.transform(_grams(rows)).withColumn("score", vector_to_array("probability")[1])
    scored = scored.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
