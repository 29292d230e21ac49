r"""Secret scans: fixed patterns and character Markov models, with DataFrame functions only.

Fixed kinds, leftmost and non-overlapping each: ``assign`` (a key name, ``:`` or ``=``, a value of six characters
or more), ``access`` (``AKIA`` and capitals or digits, 20 characters or more), ``hex`` (24 lower-case hex digits or
more). A further kind, ``random``, covers runs of ``MIN_RUN`` or more characters of ``ALPHABET``, or what fixed
spans leave of them: two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are trained on labelled samples, and a run whose log-likelihood ratio exceeds ``MIN_RATIO`` per
character is taken for a secret.

Samples (text, is_secret) are generated by rule (hashes in several alphabets; identifiers of programmers' words in
several spellings, dates, rulers of one character), and may be extended by ordinary words of labelled documents, at most ``MAX_WORDS`` of them. The
trained table has one number per pair of characters, so its size is fixed.

Defined results: a null text is empty and has no spans; offsets count code points; equal rows give equal rows;
an empty table gives an empty table; further columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEY_NAME = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
MIN_RATIO = 0.75
SAMPLES = 4000
MAX_WORDS = 20_000
SMOOTHING = 0.5
PLACEHOLDER = "[SECRET]"
#: Words that programmers' identifiers are made of.
IDENTIFIER_WORDS = (
    "get set user name list index count value key map file path read write open close start stop first last next page "
    "item order price total date time number string array object type class method field table column row data base "
    "cache query result request response client server session config option default error message event handler "
    "create update delete insert select join group sort filter parse format print load save send receive connect "
    "build test check valid input output stream buffer thread process memory size length width height color image "
    "window button menu screen layout style theme account address city country language version release project"
).split()


def generated_samples(spark: SparkSession) -> DataFrame:
    """Labelled samples (text, is_secret) by rule."""
    ids = spark.range(SAMPLES)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id")), 256)
    base64 = F.base64(F.unhex(digest))
    secrets = [digest, base64, F.regexp_replace(base64, "[+/=]", ""), F.translate(base64, "+/=", "-_"), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))]
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    four = [word(k) for k in range(4)]
    plain = [
        F.concat_ws("_", *four),
        F.concat_ws("-", *four),
        F.concat_ws("/", *four),
        F.concat(*[F.initcap(w) for w in four]),
        F.upper(F.concat_ws("_", *four)),
        F.concat(four[0], F.initcap(four[1]), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")),
        F.concat(*four),
        F.repeat(F.substr(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(24)),
        F.concat_ws("-", F.col("id") % 60 + 1970, F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), four[0]),
    ]
    labelled = [F.struct(s.alias("text"), F.lit(True).alias("is_secret")) for s in secrets] + [F.struct(p.alias("text"), F.lit(False).alias("is_secret")) for p in plain]
    return ids.select(F.inline(F.array(*labelled)))


def document_samples(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Ordinary words of documents whose ids are in ``good`` (doc_id): letters alone, a bounded sample by hash order."""
    words = docs.join(F.broadcast(good), "doc_id").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[A-Za-z]{6,}\b"), F.lit(0))).alias("text"))
    return words.distinct().orderBy(F.xxhash64("text"), "text").limit(MAX_WORDS).select("text", F.lit(False).alias("is_secret"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs: entry i * (n + 1) + j for characters i (0: start) and j of ALPHABET."""
    n = len(ALPHABET)
    pairs = (
        samples.select("is_secret", F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "").alias("chars"))
        .select("is_secret", F.explode(F.transform("chars", lambda c, k: F.struct(F.coalesce(F.get("chars", k - 1), F.lit("")).alias("a"), c.alias("b")))).alias("p"))
        .groupBy("is_secret", "p.a", "p.b")
        .count()
        .select("is_secret", F.when(F.col("a") == "", 0).otherwise(F.call_function("instr", F.lit(ALPHABET), F.col("a"))).alias("i"), F.call_function("instr", F.lit(ALPHABET), F.col("b")).alias("j"), "count")
        .where((F.col("j") > 0) & ((F.col("i") > 0) | (F.col("a") == "")))
    )
    counts = {True: {}, False: {}}
    for r in pairs.collect():  # at most 2 * (n + 1) * n rows
        counts[r["is_secret"]][r["i"], r["j"]] = r["count"]
    rows = {label: [sum(found.get((i, j), 0) for j in range(1, n + 1)) for i in range(n + 1)] for label, found in counts.items()}
    chance = lambda label, i, j: (counts[label].get((i, j), 0) + SMOOTHING) / (rows[label][i] + SMOOTHING * n)
    return [0.0 if j == 0 else math.log(chance(True, i, j) / chance(False, i, j)) for i in range(n + 1) for j in range(n + 1)]


def log_ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of random to ordinary for a string over ALPHABET."""
    weights = F.lit(model)
    width = len(ALPHABET) + 1
    places = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(
        places, zero, lambda acc, j: F.struct((acc["sum"] + F.get(weights, acc["last"] * width + j)).alias("sum"), j.alias("last")), lambda acc: acc["sum"]
    )


def _located(text: Column, pattern: str, kind: int) -> Column:
    """All matches of the pattern: array of (start, end, kind, text), from the lengths of what lies between them."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int,found:string>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(between, found, lambda a, b: F.struct(a.alias("between"), b.alias("found")))
    return F.aggregate(F.filter(pairs, lambda x: x["found"].isNotNull()), zero, step, lambda acc: acc["spans"])


def _uncovered(run: Column, fixed: Column) -> Column:
    """What the fixed spans leave of a run: its pieces of MIN_RUN or more characters."""
    zero = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int,found:string>>").alias("pieces"))

    def upto(acc: Column, end: Column) -> Column:
        found = F.substr(run["found"], acc["at"] - run["start"] + 1, end - acc["at"])
        piece = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(KINDS.index("random")).alias("kind"), found.alias("found"))
        return F.when(end - acc["at"] >= MIN_RUN, F.concat(acc["pieces"], F.array(piece))).otherwise(acc["pieces"])

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), upto(acc, x["start"]).alias("pieces"))

    overlapping = F.array_sort(F.filter(fixed, lambda x: (x["start"] < run["end"]) & (run["start"] < x["end"])))
    return F.aggregate(overlapping, zero, step, lambda acc: upto(acc, run["end"]))


def with_spans(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """Add ``spans``: array of (start, end, kind), kinds numbered as in KINDS, sorted by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,found:string>>")
    value = lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2))
    fixed = docs.withColumn(
        "_fixed",
        F.concat(
            F.when(body.rlike(KEY_NAME), F.filter(_located(body, ASSIGN, 0), lambda x: value(x) >= 6)).otherwise(none),
            F.when(body.contains("AKIA"), _located(body, ACCESS, 1)).otherwise(none),
            F.when(body.rlike(HEX), _located(body, HEX, 2)).otherwise(none),
        ),
    ).withColumn("_runs", F.when(body.rlike(RUN), _located(body, RUN, 3)).otherwise(none))
    alone = F.when(F.size("_fixed") == 0, F.col("_runs")).otherwise(F.flatten(F.transform("_runs", lambda r: _uncovered(r, F.col("_fixed")))))
    random = F.filter(alone, lambda r: log_ratio(r["found"], model) > MIN_RATIO * F.length(r["found"]))
    spans = F.array_sort(F.transform(F.concat("_fixed", random), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return fixed.withColumn("spans", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).drop("_fixed", "_runs")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float]) -> DataFrame:
    """The documents with every span replaced by PLACEHOLDER (overlapping spans by one), ``n_chars`` kept in step; same columns."""
    names = {c: f"_doc{i}" for i, c in enumerate(docs.columns)}
    found = with_spans(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), model, names["text"])
    text = F.col(names["text"])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(PLACEHOLDER)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    clean = F.when(F.size("spans") == 0, text).otherwise(
        F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    )
    changed = F.size("spans") > 0
    result = found.withColumn("_clean", clean)
    columns = []
    for c, n in names.items():
        if c == "text":
            columns.append(F.col("_clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length("_clean").cast("long")).otherwise(F.col(n)).alias(c))
        else:
            columns.append(F.col(n).alias(c))
    return result.select(*columns)
