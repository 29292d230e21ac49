r"""Quality rules: robust multivariate outliers, with DataFrame functions only.

Fixed rules first: a document fails with fewer than ``MIN_WORDS`` words or with more than 30 of 100 words in
repeated eight-word windows. The others are judged by their statistics, each transformed to a bounded scale
and rounded to hundredths: equal rows then count as one, and sums do not depend on the order of rows.

For each language and source, each language and all rows a minimum-covariance-determinant estimate is made: four
starts (scales of median deviations alone, hyperbolic tangents, spatial signs, a hashed quarter of the rows) take two
concentration steps each, the ``KEPT_SHARE`` of rows with the smallest Mahalanobis distance giving the next mean and
covariance; the start with the least determinant goes on until no determinant falls any more. The covariance is then
made consistent at the normal distribution and reweighted once: mean and covariance of all rows inside the
``REWEIGHT_TAIL`` quantile of chi-squared. ``FLOOR`` regularises each standard deviation, so a statistic that most
documents share exactly is judged on a natural scale. A language's estimate is drawn to that of all rows, and that of
a language and source to its language's, by the weight of ``PRIOR`` rows; so groups of any size are judged alike, a
few rows mostly by their language, many by themselves. Rows beyond the ``TAIL`` quantile of chi-squared are rejected.

All texts are read in one pass without a shuffle: windows, lines and counts stay inside the row. Steps after
that read the distinct vectors. Quantiles come from counts by bin (bins of the logarithm for distances, without a largest
one); tables of a row per group are broadcast up to ``GROUPS`` rows and joined by a shuffle beyond.

Defined results: a null text has no words and fails; null language or source are values of their own; rows
that are equal get the same verdict each; an empty table gives an empty table; further columns are kept as
they are. ``kept`` is never null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
KEPT_SHARE = 0.75
REWEIGHT_TAIL = 0.025
#: At the normal distribution so many clean documents would be lost.
TAIL = 1e-9
PRIOR = 50
#: A log determinant that falls by less has stopped.
FALL = 1e-3
#: Steps to a unit of the transformed statistics.
UNIT = 100
GROUPS = 100_000
EVERYTHING = 0
#: Standard deviations added to each statistic's own, in its unit.
FLOOR = {"word_length": 0.05, "symbols": 0.15, "capitals": 0.15, "dup_lines": 0.10, "repeats": 0.08, "echoes": 0.05}


def repeated_words(words: Column) -> Column:
    """Words inside eight-word windows that occur twice or more in the array, first occurrences included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(at: Column) -> Column:
        # at: ascending starts of repeated windows; each adds the words up to the next start, the last one all of its own
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + F.coalesce(x, F.lit(WINDOW)).cast("long"))

    def repeated_starts(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(
            placed,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])), lambda e: e["i"]
                )
            ),
        )

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(repeated_starts(h), covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct column ``stats`` of counts over the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = docs.withColumns(
        {
            "_words": F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)),
            "_lines": F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0),
        }
    )
    stats = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))).cast("long").alias("n_echoes"),
    )
    return parts.withColumn("stats", stats).drop("_words", "_lines")


def base_failed(s: str = "stats") -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{s}.n_words"))


def _vector(s: str = "stats") -> dict[str, Column]:
    """Transformed statistics; shares are damped by a few words so that short texts are not judged by chance."""
    n, chars, lines = F.col(f"{s}.n_words"), F.col(f"{s}.word_chars"), F.col(f"{s}.n_lines")
    share = lambda x: F.log1p(100 * F.col(f"{s}.{x}") / (chars + 100))
    return {
        "word_length": F.log((chars + 120) / (n + 20)),
        "symbols": share("n_symbols"),
        "capitals": share("n_capitals"),
        "dup_lines": F.col(f"{s}.n_dup_lines") / (lines + 4),
        "repeats": F.col(f"{s}.n_repeat_words") / (n + 20),
        "echoes": F.col(f"{s}.n_echoes") / (n + 20),
    }


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str], floors: list[float]) -> DataFrame:
    """For each key: rows, mean m0, ... and floored covariance c0_0, ... of x0, ..., each row counted ``copies`` times.

    The xs are whole numbers, so their sums do not depend on the order of rows.
    """
    d = len(floors)
    sums = [F.sum(F.col("copies") * F.col(f"x{i}")).cast("double").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("copies") * F.col(f"x{i}") * F.col(f"x{j}")).cast("double").alias(f"p{i}_{j}") for i, j in _pairs(d)]
    found = rows.groupBy(*keys).agg(F.sum("copies").alias("n"), *sums, *products)
    scatter = {(i, j): F.col(f"p{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n")) for i, j in _pairs(d)}
    cells = [(F.greatest(v, F.lit(0.0)) + F.lit(floors[i] ** 2) if i == j else v).alias(f"c{i}_{j}") for (i, j), v in scatter.items()]
    return found.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(d)], *cells)


def _inverted(found: DataFrame, d: int) -> DataFrame:
    """Add the inverse p0_0, ... of the covariance and its log determinant, by sweeping each of its rows."""
    cell = lambda i, j: F.col(f"c{max(i, j)}_{min(i, j)}")
    start = F.struct(F.array(*[cell(i, j) for i in range(d) for j in range(d)]).alias("a"), F.lit(0.0).alias("logdet"))

    def sweep(state: Column, k: Column) -> Column:
        a = state["a"]
        at = lambda i, j: F.get(a, i * d + j)
        pivot = F.greatest(at(k, k), F.lit(1e-6))

        def swept(_: Column, place: Column) -> Column:
            i, j = F.floor(place / d).cast("int"), F.pmod(place, F.lit(d))
            return F.when((i == k) & (j == k), -1 / pivot).when((i == k) | (j == k), F.get(a, place) / pivot).otherwise(F.get(a, place) - at(i, k) * at(k, j) / pivot)

        return F.struct(F.transform(a, swept).alias("a"), (state["logdet"] + F.log(pivot)).alias("logdet"))

    done = found.withColumn("swept", F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), start, sweep))
    return done.select(*found.columns, *[(-F.col("swept.a")[i * d + j]).alias(f"p{i}_{j}") for i, j in _pairs(d)], F.col("swept.logdet").alias("logdet"))


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance of x to the centre m by the inverse covariance p."""
    off = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(d)]
    return sum((F.lit(1.0 if i == j else 2.0) * F.col(f"p{i}_{j}") * off[i] * off[j] for i, j in _pairs(d)), F.lit(0.0))


def _quantiles(rows: DataFrame, keys: list[str], bins: list[Column], share: float) -> DataFrame:
    """Per key, for each binned value: the bin where the given share of rows is reached, as q0, q1, ...

    Rows are counted by bin first, so what meets in one task for a key is its bins and not its rows.
    """
    long = rows.select(*keys, "copies", F.explode(F.array(*[F.struct(F.lit(i).alias("of"), v.cast("int").alias("bin")) for i, v in enumerate(bins)])).alias("b"))
    counts = long.groupBy(*keys, "b.of", "b.bin").agg(F.sum("copies").alias("n"))
    held = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("of", "bin", "n"))).alias("held"))

    def reached(i: int) -> Column:
        mine = F.filter("held", lambda b: b["of"] == i)
        total = F.aggregate(mine, F.lit(0).cast("long"), lambda t, b: t + b["n"])
        start = F.struct(F.lit(0).cast("long").alias("until"), F.lit(None).cast("int").alias("at"))
        step = lambda t, b: F.struct((t["until"] + b["n"]).alias("until"), F.coalesce(t["at"], F.when(t["until"] + b["n"] >= F.lit(share) * total, b["bin"])).alias("at"))
        return F.aggregate(mine, start, step)["at"]

    return held.select(*keys, *[reached(i).alias(f"q{i}") for i in range(len(bins))])


def chi_squared_tail(x: float, d: int) -> float:
    """P(chi-squared of an even number d of degrees > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi_squared_quantile(tail: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_tail(middle, d) > tail else (low, middle)
    return high


def consistency(share: float, d: int) -> float:
    """What the covariance of the ``share`` of normal rows that are nearest the centre is multiplied with."""
    return share / (1 - chi_squared_tail(chi_squared_quantile(1 - share, d), d + 2))


class Determinants:
    """Minimum-covariance-determinant estimates of stored rows (lang_group, group, copies, x0, x1, ...)."""

    def __init__(self, vectors: DataFrame, floors: list[float], scratch: Scratch):
        self.d, self.floors, self.scratch, self.vectors = len(floors), floors, scratch, vectors
        self.xs = [f"x{i}" for i in range(self.d)]
        levels = F.array(F.col("group"), F.col("lang_group"), F.lit(EVERYTHING))
        self.each = vectors.select(F.explode(levels).alias("group"), "copies", *self.xs)
        self.groups = scratch.save(vectors.select("group", "lang_group").distinct(), "groups")
        self.few = self.groups.count() <= GROUPS

    def small(self, rows: DataFrame) -> DataFrame:
        """A table of a few rows per group: broadcast where groups are few, else joined by a shuffle."""
        return F.broadcast(rows) if self.few else rows

    def scales(self) -> DataFrame:
        """Median m and width w (from the median deviation) of each x."""
        centre = _quantiles(self.each, ["group"], [F.col(x) for x in self.xs], 0.5)
        centre = self.scratch.save(centre.select("group", *[F.col(f"q{i}").cast("double").alias(f"m{i}") for i in range(self.d)]), "centre")
        off = [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(self.d)]
        spread = _quantiles(self.each.join(self.small(centre), "group"), ["group"], off, 0.5)
        widths = [F.sqrt(F.pow(1.4826 * F.col(f"q{i}"), F.lit(2)) + F.lit(f**2)).alias(f"w{i}") for i, f in enumerate(self.floors)]
        spread = spread.select("group", *widths)
        return self.scratch.save(centre.join(self.small(spread), "group"), "scales")

    def starts(self) -> DataFrame:
        """Four first estimates a group, by start: scales alone, hyperbolic tangents, spatial signs, and a hashed quarter of the rows."""
        d, scales = self.d, self.scales()
        z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"w{i}") for i in range(d)]
        whole = lambda v: F.round(1000 * v).cast("long")
        placed = self.each.join(self.small(scales), "group").select("group", "copies", *[v.alias(f"z{i}") for i, v in enumerate(z)])
        length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(d)), F.lit(1e-12)))
        shapes = F.array(
            F.struct(F.lit(1).alias("start"), *[whole(F.tanh(f"z{i}")).alias(f"x{i}") for i in range(d)]),
            F.struct(F.lit(2).alias("start"), *[whole(F.col(f"z{i}") / length).alias(f"x{i}") for i in range(d)]),
        )
        shaped = placed.select("group", "copies", F.explode(shapes).alias("s")).select("group", "copies", "s.*")
        # shapes are in thousandths of the widths: the widths turn their inverse into units of x
        found = _inverted(_moments(shaped, ["group", "start"], [100.0] * d).drop("n", *[f"m{i}" for i in range(d)]), d).join(self.small(scales), "group")
        unit = ["group", "start", *[f"m{i}" for i in range(d)]]
        turned = found.select(*unit, *[(F.col(f"p{i}_{j}") * 1e6 / (F.col(f"w{i}") * F.col(f"w{j}"))).alias(f"p{i}_{j}") for i, j in _pairs(d)])
        plain = scales.withColumn("start", F.lit(0)).select(*unit, *[(1 / (F.col(f"w{i}") * F.col(f"w{i}")) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in _pairs(d)])
        quarter = self.each.where(F.pmod(F.xxhash64(*self.xs), F.lit(4)) == 0)
        drawn = _inverted(_moments(quarter, ["group"], self.floors), d).withColumn("start", F.lit(3)).select(*plain.columns)
        return self.scratch.save(plain.unionByName(turned).unionByName(drawn), "start")

    def concentrated(self, estimate: DataFrame, name: str) -> DataFrame:
        """One concentration step: mean and covariance of the ``KEPT_SHARE`` of rows that are nearest by the estimate."""
        known = ["group", "start", *[f"m{i}" for i in range(self.d)], *[f"p{i}_{j}" for i, j in _pairs(self.d)]]
        near = self.each.join(self.small(estimate.select(*known)), "group")
        # bins of the logarithm, so there is no largest one: 16 to a doubling of the squared distance
        near = near.select("group", "start", "copies", *self.xs, F.floor(F.log2(_distance(self.d) + 2.0**-10) * 16).cast("int").alias("bin"))
        edges = self.scratch.save(_quantiles(near, ["group", "start"], [F.col("bin")], KEPT_SHARE), f"{name}_edges")
        kept = near.join(self.small(edges), ["group", "start"]).where("bin <= q0")
        return self.scratch.save(_inverted(_moments(kept, ["group", "start"], self.floors), self.d), name)

    def least(self) -> DataFrame:
        """The estimate of the least determinant for each group."""
        estimate = self.starts()
        for step in (1, 2):
            estimate = self.concentrated(estimate, f"try{step}")
        best = estimate.groupBy("group").agg(F.min_by(F.struct(*estimate.columns[1:]), F.struct("logdet", "start")).alias("e"))
        estimate, step, falling = self.scratch.save(best.select("group", "e.*"), "best"), 0, True
        while falling:
            step += 1
            later = self.concentrated(estimate, f"step{step}")
            turns = later.withColumn("turn", F.lit(1)).unionByName(estimate.withColumn("turn", F.lit(0)))
            both = turns.groupBy("group").agg(
                F.min_by(F.struct(*estimate.columns[1:]), F.struct("logdet", "turn")).alias("e"),
                (F.max(F.when(F.col("turn") == 0, F.col("logdet"))) - F.min("logdet")).alias("fall"),
            )
            both = self.scratch.save(both.select("group", "e.*", "fall"), f"least{step}")
            falling = (both.agg(F.max("fall")).first()[0] or 0) > FALL
            estimate = both.drop("fall")
        return estimate

    def final(self) -> DataFrame:
        """Centre m and inverse p for each language and source: consistent, reweighted and drawn to the wider groups."""
        d = self.d
        reach = consistency(KEPT_SHARE, d) * chi_squared_quantile(REWEIGHT_TAIL, d)
        near = self.each.join(self.small(self.least().drop("n", "start", "logdet")), "group").where(_distance(d) <= F.lit(reach))
        wide = _moments(near, ["group"], self.floors)
        factor = F.lit(consistency(1 - REWEIGHT_TAIL, d))
        cells = [f"c{i}_{j}" for i, j in _pairs(d)]
        wide = self.scratch.save(wide.select("group", "n", *[f"m{i}" for i in range(d)], *[(factor * F.col(c)).alias(c) for c in cells]), "reweighted")
        # a group without a row in reach has no estimate of its own and takes the wider one
        langs = self.groups.select(F.col("lang_group").alias("group"), F.lit(EVERYTHING).alias("lang_group")).distinct()
        lang = self.drawn(langs, wide, wide.where(F.col("group") == EVERYTHING))
        own = self.drawn(self.groups, wide, self.scratch.save(lang, "languages"))
        return self.scratch.save(_inverted(own, d).drop("logdet", *cells), "estimates")

    def drawn(self, groups: DataFrame, own: DataFrame, wider: DataFrame) -> DataFrame:
        """Centre and covariance of each group, drawn to those of the wider group by the weight of ``PRIOR`` rows."""
        names = [f"m{i}" for i in range(self.d)] + [f"c{i}_{j}" for i, j in _pairs(self.d)]
        wide = wider.select(F.col("group").alias("lang_group"), *[F.col(c).alias(f"wide_{c}") for c in names])
        known = groups.join(self.small(own), "group", "left").join(self.small(wide), "lang_group")
        n = F.coalesce("n", F.lit(0))
        weight = n / (n + F.lit(float(PRIOR)))
        return known.select("group", *[(weight * F.coalesce(c, F.lit(0.0)) + (1 - weight) * F.col(f"wide_{c}")).alias(c) for c in names])


def judge(measured: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``distance`` (squared; null where a fixed rule failed) and ``kept`` to stored rows with stats, lang and source."""
    vector = _vector()
    d, floors = len(vector), [UNIT * FLOOR[k] for k in vector]
    columns = [F.col(f"`{c}`") for c in measured.columns]
    xs = [F.round(UNIT * v).cast("long").alias(f"x{i}") for i, v in enumerate(vector.values())]
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    keys = [F.xxhash64(F.lit("lang"), lang).alias("lang_group"), F.xxhash64(F.lit("source"), lang, source).alias("group")]
    passed = measured.where(~base_failed())
    placed = passed.select(*keys, *xs)
    model = Determinants(scratch.save(placed.groupBy(*placed.columns).agg(F.count("*").alias("copies")), "vectors"), floors, scratch)
    judged = passed.select(F.struct(*columns).alias("_row"), F.struct(keys[1], *xs).alias("_own")).select("_row", "_own.*").join(model.small(model.final()), "group")
    judged = judged.select("_row.*", _distance(d).alias("distance"))
    failed = measured.where(base_failed()).select(*columns, F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed).withColumn("kept", F.coalesce(F.col("distance") <= F.lit(chi_squared_quantile(TAIL, d)), F.lit(False)))


def keep_good(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    names = {c: f"_doc{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("lang"), F.col("source"))
    measured = scratch.save(with_statistics(plain, names["text"]), "measured")
    return judge(measured, scratch).where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
