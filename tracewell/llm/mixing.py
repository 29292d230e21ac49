"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target over its own size is the number of copies that its documents expect. The whole part of it is given
to every document as certain copies; the fraction sets the inclusion odds of one more copy, which are unequal: the
source's odds times the document's size over the source's mean size, held between 1/``MOST_TILT`` and ``MOST_TILT``
(so long documents, which close the missing words in fewer draws, come in more often, and none is shut out).
Documents rank by Pareto's variable, their random odds divided by their inclusion odds, and the first ones are taken
until the words still missing are reached. At most one document more is taken where its size closes what then is left.

The random number of a document is a hash of its id and text, so reruns, lost tasks and other partitionings
agree. No source is sorted whole: words are summed in ``SLOTS`` slots of the ranking variable, and only the
slot where a source crosses its goal is sorted. Sources are ranked in ranges, and their level is found by sums.
Tables of a row per source are broadcast up to ``SOURCES`` rows and joined by a shuffle beyond.

Defined results: a null text has size 0; documents without words may be copied, which adds no words; a null
source is a source of its own, ordered last; rows equal in id and text share one rank, and where only some of them fit
they are numbered and the first ones are taken (which of them may follow the files' layout, how many never does);
an empty table gives an empty table; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm.joins import within_bound

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
MOST_TILT = 2.0
SLOTS = 4096
RANGES = 64
SOURCES = 100_000
SEED = "7"


def with_size_and_rank(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add ``mix_size`` (words) and ``mix_u`` (a number in (0, 1) fixed by id and text)."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.col(doc_id).cast("string"), F.col(text)))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return docs.withColumns(
        {
            "mix_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
            "mix_u": (number + 0.5) / F.lit(float(1 << 52)),
        }
    )


def source_targets(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: ``source_size``, ``n_docs`` and ``target``.

    Targets are a level times weight, each held at ``max_copies`` times its size. What held sources leave goes to the
    others by weight, until no further source is above; a pass over the sources' sums for each such turn.
    """
    per_source = sized.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n_docs"))
    # ranks by code point without one sort of all: ranges in order, ranks inside them, and the rows of the ranges before
    ranged = per_source.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = scratch.save(ranged, "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    offsets = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    number = (F.col("before") + F.row_number().over(inside) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))
    ranked = ranged.join(F.broadcast(offsets), "range").select(
        "source", "source_size", "n_docs", weight.alias("w"), (F.lit(float(max_copies)) * F.col("source_size")).alias("cap")
    )
    ranked = scratch.save(ranked, "weighed")
    level, held = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("cap") / F.col("w") <= F.lit(level)
        everything, taken, left, n = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~above, F.col("w"))), F.count(F.when(above, 1))
        ).first()
        if left is None or n == held:
            break
        level, held = (share * everything - taken) / left, n
    target = F.col("cap") if left is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def _plan(sized: DataFrame, targets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Per source: certain copies, inclusion probability and the last rank taken; and the groups of equal rows behind it
    of which ``take`` among ``n`` rows come in: the group where the goal is crossed and the one that fills up."""
    goals = targets.select(
        F.col("source").alias("goal_source"),
        "source_size",
        "n_docs",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("certain"),
    ).select(
        "*",
        (F.col("target") - F.col("certain") * F.col("source_size")).alias("missing"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("certain")).otherwise(0.0).alias("chance"),
    )
    goals = scratch.save(goals, "goals")
    same_source = F.col("source").eqNullSafe(F.col("goal_source"))
    ranked = sized.select("source", "mix_size", "mix_u").join(within_bound(goals, SOURCES), same_source).where("chance > 0")
    ranked = ranked.select("goal_source", "mix_size", "mix_u", "missing", _pareto().alias("q"))
    ranked = ranked.withColumn("slot", F.floor(F.col("q") / (1 + F.col("q")) * SLOTS))

    by_slot = ranked.groupBy("goal_source", "slot").agg(F.sum("mix_size").alias("words"), F.first("missing").alias("missing"))
    running = Window.partitionBy("goal_source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        by_slot.withColumn("until", F.sum("words").over(running))
        .where("until >= missing")
        .groupBy(F.col("goal_source").alias("cross_source"))
        .agg(F.min_by(F.struct("slot", (F.col("until") - F.col("words")).alias("before")), "slot").alias("at"))
        .select("cross_source", F.col("at.slot").alias("cross_slot"), F.col("at.before").alias("before"))
    )
    crossing = within_bound(scratch.save(crossing, "crossing"), SOURCES)
    there = ranked.join(crossing, F.col("goal_source").eqNullSafe(F.col("cross_source")) & (F.col("slot") == F.col("cross_slot")))
    equal = there.groupBy("goal_source", "q", "mix_u", "mix_size").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("before", "missing", "cross_slot")])
    by_rank = Window.partitionBy("goal_source").orderBy("q")
    within = equal.withColumn("until", F.col("before") + F.sum(F.col("mix_size") * F.col("n")).over(by_rank))
    fits = F.col("until") <= F.col("missing")
    last = (
        within.groupBy(F.col("goal_source").alias("last_source"))
        .agg(
            F.max(F.when(fits, F.col("q"))).alias("last_q"),
            F.max(F.when(fits, F.col("until"))).alias("last_until"),
            F.min(F.when(~fits, F.struct("q", "mix_u", "mix_size", "n"))).alias("crossed"),
            F.first("before").alias("before"),
            F.first("cross_slot").alias("cross_slot"),
            F.first("missing").alias("missing"),
        )
        .select(
            "last_source",
            # no document of the slot fits: all slots before it are taken, and nothing of it
            F.coalesce("last_q", F.col("cross_slot") / (F.lit(SLOTS) - F.col("cross_slot")) - 1e-12).alias("last_q"),
            "crossed",
            (F.col("missing") - F.coalesce("last_until", "before")).alias("left"),
        )
        .withColumn("fitting", F.least("crossed.n", F.floor(F.floor("left") / F.nullif(F.col("crossed.mix_size"), F.lit(0)))))
        .select("last_source", "last_q", "crossed", "fitting", (F.col("left") - F.coalesce(F.col("fitting") * F.col("crossed.mix_size"), F.lit(0))).alias("gap"))
    )
    last = scratch.save(last, "last")
    filling = (
        ranked.join(within_bound(last, SOURCES), F.col("goal_source").eqNullSafe(F.col("last_source")))
        .where((F.col("q") > F.col("last_q")) & (F.abs(F.col("gap") - F.col("mix_size")) < F.col("gap")))
        .groupBy("goal_source")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("mix_size")).alias("off"), "q", "mix_u", "mix_size")).alias("fill"))
        .select(F.col("goal_source").alias("some_source"), F.col("fill.mix_u").alias("some_u"), F.col("fill.mix_size").alias("some_size"), F.lit(1).cast("long").alias("take"))
    )
    crossed = last.where("fitting > 0").select("last_source", "crossed.mix_u", "crossed.mix_size", "fitting")
    some = scratch.save(filling.union(crossed).groupBy("some_source", "some_u", "some_size").agg(F.sum("take").alias("take")), "some")
    some = ranked.join(within_bound(some, SOURCES), _in_group("goal_source")).groupBy("some_source", "some_u", "some_size", "take").agg(F.count("*").alias("n"))
    plan = goals.join(last, F.col("goal_source").eqNullSafe(F.col("last_source")), "left").select("goal_source", "source_size", "n_docs", "target", "certain", "chance", "last_q")
    return scratch.save(plan, "plan"), scratch.save(some, "counted")


def _in_group(source: str) -> Column:
    return F.col(source).eqNullSafe(F.col("some_source")) & (F.col("mix_u") == F.col("some_u")) & (F.col("mix_size") == F.col("some_size"))


def _pareto() -> Column:
    """Random odds divided by inclusion odds: the source's, times the document's size over the source's mean, within bounds."""
    chance = F.nullif(F.col("chance"), F.lit(0.0))
    relative = F.col("mix_size") * F.col("n_docs") / F.nullif(F.col("source_size"), F.lit(0))
    tilt = F.least(F.lit(MOST_TILT), F.greatest(F.lit(1 / MOST_TILT), relative))
    return (F.col("mix_u") / (1 - F.col("mix_u"))) / (chance / (1 - chance) * tilt)


def mix(sized: DataFrame, scratch: Scratch, measured: DataFrame | None = None, **options) -> DataFrame:
    """Add ``source_size``, ``target``, ``copies`` and ``taken`` to rows that carry ``mix_size`` and ``mix_u``.

    measured: the same rows with at least source, mix_size and mix_u, where these are stored apart from texts.
    """
    measured = sized if measured is None else measured
    plan, some = _plan(measured, source_targets(measured, scratch, **options), scratch)
    kept = [F.col(f"`{c}`") for c in sized.columns]
    placed = (
        sized.select(F.struct(*kept).alias("_row"), "source", "mix_size", "mix_u")
        .join(within_bound(plan, SOURCES), F.col("source").eqNullSafe(F.col("goal_source")))
        .join(within_bound(some, SOURCES), _in_group("source"), "left")
        .withColumn("mix_q", _pareto())
    )

    def taken(rows: DataFrame, added: Column) -> DataFrame:
        copies = F.col("certain") + F.coalesce(added.cast("long"), F.lit(0))
        return rows.select("_row.*", "source_size", "target", copies.alias("copies"), (copies * F.col("mix_size")).alias("taken"))

    whole = (F.col("chance") > 0) & ((F.col("mix_q") <= F.col("last_q")) | (F.col("take") >= F.col("n")))
    if some.where("take < n").isEmpty():
        return taken(placed, whole)
    parted = F.coalesce(F.col("take") < F.col("n"), F.lit(False))
    tied = placed.where(parted).select("_row", "source", "mix_size", "mix_u", "source_size", "target", "certain", "take")
    return taken(placed.where(~parted), whole).unionAll(taken(_numbered(scratch.save(tied, "tied")), F.col("number") <= F.col("take")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Number equal rows of a saved table from 1, by file and by place in it: no task sorts a whole group."""
    group = ["source", "mix_u", "mix_size", "file"]
    rows = rows.withColumns({"file": F.col("_metadata.file_name"), "place": F.col("_metadata.row_index")})
    before = Window.partitionBy(*group[:-1]).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(*group).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    files = files.select(*[F.col(c).alias(f"of_{c}") for c in group], "before")
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("mix_u") == F.col("of_mix_u")) & (F.col("mix_size") == F.col("of_mix_size")) & (F.col("file") == F.col("of_file"))
    number = F.row_number().over(Window.partitionBy(*group).orderBy("place"))
    return rows.withColumn("number", number).join(files, same).withColumn("number", F.col("number") + F.col("before"))


def copy_out(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``. Texts are not shuffled."""
    names = {c: f"_doc{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    sized = with_size_and_rank(plain.withColumn("source", F.col(names["source"])), text=names["text"], doc_id=names["doc_id"])
    measured = scratch.save(sized.select("source", "mix_size", "mix_u"), "measured")
    taken = mix(sized, scratch, measured, **options).where("copies > 0")
    copied = taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE = r"""
with sized as materialized (
  select *, row_number() over (partition by source, u, size) as k from (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         (('0x' || substr(md5(concat_ws(':', '7', doc_id::varchar, text)), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents)),
src as (select source, sum(size)::bigint as source_size, count(*) as n_docs from sized group by source),
weighed as (
  select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
         2.0::double * source_size as cap from src),
levels as (
  select *, ((sum(source_size) over ())::double * 1.5::double
             - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level
  from weighed),
goals as (
  select source, source_size, n_docs, target,
         case when source_size > 0 then floor(target / source_size) else 0 end::bigint as certain
  from (select source, source_size, n_docs,
               least(cap, coalesce(max(case when cap / w > level then level end) over () * w, cap)) as target from levels)),
g as (
  select *, target - certain * source_size as missing,
         case when source_size > 0 then target / source_size - certain else 0.0 end::double as chance from goals),
ranked as (
  select s.doc_id, s.source, s.size, s.u, s.k, g.missing,
         (s.u / (1 - s.u)) / (g.chance / (1 - g.chance) * least(2.0::double, greatest(0.5::double, (s.size * g.n_docs)::double / g.source_size))) as q
  from sized s join g on s.source is not distinct from g.source where g.chance > 0),
cum as (select *, sum(size) over (partition by source order by q, k rows between unbounded preceding and current row) as until from ranked),
last as (select source, any_value(missing) - coalesce(max(case when until <= missing then until end), 0) as gap from cum group by source),
added as (
  select source, u, size, k, until <= missing or (fits and row_number() over (partition by source, fits order by off, q, k) = 1) as extra from (
    select c.*, abs(l.gap - c.size) as off, c.until > c.missing and abs(l.gap - c.size) < l.gap as fits from cum c join last l on c.source is not distinct from l.source))
select s.doc_id, s.size, g.source_size, g.target, (s.size * (g.certain + case when a.extra then 1 else 0 end))::bigint as taken
from sized s join g on s.source is not distinct from g.source
left join added a on s.source is not distinct from a.source and s.u = a.u and s.size = a.size and s.k = a.k
"""
