"""Edits of a document's rows as a log: every operation sees what those before it left, and says what became of it.

Operations on one row are a sequential fold, read in order from sorted partitions with the state of one row at a time; rows that an
operation makes are folded in the next round, with the operations that name them. So there are as many rounds as rows made of
rows made of rows are deep, and no row's log is held whole. Places need no shifting of ordinals: a row's place is a path
(its anchor's path, then the negative number of the operation and the piece), and paths sort in document order.

Operations (op, seq, doc_id, kind, row_id, expected, pieces, req_ids); seq is unique and gives the order:

- ``edit``: the row's text becomes the first piece, the others are new rows right after it;
- ``split``: the same, with two pieces at least and an id for each;
- ``delete``: the row goes to the archive, with its id;
- ``revert``: the text before the last change that had one comes back, after a split the requirement id too;
- ``add``: new rows right after the row, or at the document's end where none is named.

``expected`` is the hash of the text that the writer saw; null accepts any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch

#: Outcomes that change something; others are conflict, missing, unchanged, refused.
APPLIED = "applied"
PLACE = "array<struct<turn:long,piece:int>>"
FOLDED = f"what string, op string, seq long, row_id string, doc_id long, place {PLACE}, req_id string, text string, old_text string, kind string, outcome string"
_PLACE = pa.list_(pa.struct([("turn", pa.int64()), ("piece", pa.int32())]))
_SCHEMA = pa.schema([
    ("what", pa.string()), ("op", pa.string()), ("seq", pa.int64()), ("row_id", pa.string()), ("doc_id", pa.int64()), ("place", _PLACE),
    ("req_id", pa.string()), ("text", pa.string()), ("old_text", pa.string()), ("kind", pa.string()), ("outcome", pa.string()),
])


#: Further columns of an operation; rows and operations of a task.
OPERATION = {"op": "string", "kind": "string", "expected": "string", "pieces": "array<string>", "req_ids": "array<string>"}
KINDS = ("edit", "split", "delete", "revert", "add")
TASK_ROWS = 250_000


def content_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Row:
    """A row while its operations are read: what it is now (row_id, doc_id, place, req_id, text), and what the last change replaced.

    What is said are tuples in the order of the columns of ``FOLDED``: millions of them make no dictionary each.
    """

    __slots__ = ("state", "before")

    def __init__(self, state: tuple | None):
        self.state = state
        self.before: tuple[str, str, str | None] | None = None  # old text, kind and requirement id of the last change with an old text

    @staticmethod
    def _made(op: str, seq: int, doc_id: int | None, pieces: list[str], place: list, first: int, req_ids: list, out: list[tuple]) -> None:
        for k, piece in enumerate(pieces, first):
            own = place + [{"turn": -seq if place else seq, "piece": k}]
            out.append(("made", op, seq, f"{op}.{k}", doc_id, own, req_ids[k - first], piece, None, None, None))

    def _outcome(self, kind: str, row_id: str | None, expected: str | None, pieces: list[str]) -> str:
        if row_id is None:
            return APPLIED if kind == "add" and pieces else "refused"
        if self.state is None:
            return "missing"
        if kind not in KINDS or (kind in ("edit", "add") and not pieces) or (kind == "split" and len(pieces) < 2):
            return "refused"
        if kind != "add" and expected is not None and expected != content_hash(self.state[4]):
            return "conflict"
        new = self.before and self.before[0] if kind == "revert" else pieces[0] if kind == "edit" else None
        return "unchanged" if kind in ("edit", "revert") and new in (None, self.state[4]) else APPLIED

    def take(self, op: str, seq: int, doc_id: int | None, kind: str | None, row_id: str | None, expected: str | None, pieces: list | None, req_ids: list | None, out: list[tuple]) -> None:
        pieces, kind = [s for p in pieces or () if p and (s := p.strip())], kind or ""
        outcome, state = self._outcome(kind, row_id, expected, pieces), self.state
        out.append(("outcome", op, seq, row_id, doc_id, None, None, None, None, kind, outcome))
        if outcome != APPLIED:
            return
        if state is not None:  # the row's document, whatever the operation says
            doc_id = state[1]
        if kind == "add":
            given = (req_ids or []) + [None] * len(pieces)
            self._made(op, seq, doc_id, pieces, state[2] if state else [], 0, given, out)
            out.append(("audit", op, seq, f"{op}.0", doc_id, None, given[0], "\n\n".join(pieces), None, kind, None))
            return
        own_id, _, place, req_id, old = state
        if kind == "delete":
            out.append(("audit", op, seq, row_id, doc_id, None, req_id, "", old, kind, None))
            out.append(("archived", op, seq, *state, None, None, None))
            self.state = None
            return
        new = self.before[0] if kind == "revert" else pieces[0]
        out.append(("audit", op, seq, row_id, doc_id, None, req_id, new, old, kind, None))
        ids = [i or req_id for i in (req_ids or []) + [None] * len(pieces)] if kind == "split" else [req_id] * max(1, len(pieces))
        back = self.before[2] if kind == "revert" and self.before[1] == "split" else ids[0]
        self.state = (own_id, doc_id, place, back, new)
        if old:
            self.before = (old, kind, req_id)
        if kind != "revert":
            self._made(op, seq, doc_id, pieces[1:], place, 1, ids[1:], out)

    def finish(self, out: list[tuple]) -> None:
        if self.state is not None:
            out.append(("live", None, None, *self.state, None, None, None))


def _batch(said: list[tuple]) -> pa.RecordBatch:
    columns = zip(*said, strict=True) if said else ((),) * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _fold(rows: DataFrame, log: DataFrame, n: int) -> DataFrame:
    """Outcomes, audit rows, made, archived and live rows of one round of ``n`` rows and operations."""
    none = lambda kind: F.lit(None).cast(kind)
    state = rows.select("row_id", "seq", F.lit(True).alias("is_row"), "doc_id", "place", "req_id", F.coalesce("text", F.lit("")).alias("text"), *[none(k).alias(c) for c, k in OPERATION.items()])
    steps = log.select("row_id", "seq", F.lit(False).alias("is_row"), "doc_id", none(PLACE).alias("place"), none("string").alias("req_id"), none("string").alias("text"), *OPERATION)
    # appended rows wait for no other row: each operation alone
    key = F.coalesce("row_id", F.concat(F.lit("+"), F.col("seq").cast("string")))
    both = state.unionByName(steps).withColumn("key", key)
    names = both.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = None, _Row(None)
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(names.index(c)).to_pylist() for c in ("key", "is_row", "row_id", "doc_id", "place", "req_id", "text", "op", "seq", "kind", "expected", "pieces", "req_ids"))
            for key, is_row, row_id, doc_id, place, req_id, text, op, seq, kind, expected, pieces, req_ids in zip(*columns, strict=True):
                if key != now:
                    row.finish(out)
                    now, row = key, _Row(None)
                if is_row:
                    row = _Row((row_id, doc_id, place, req_id, text))
                else:
                    row.take(op, seq, doc_id, kind, row_id, expected, pieces, req_ids, out)
            yield _batch(out)
        out = []
        row.finish(out)
        yield _batch(out)

    # as many tasks as the rows need, so that what one sorts does not grow with the log
    return both.repartition(-(-n // TASK_ROWS) or 1, "key").sortWithinPartitions("key", F.col("seq").asc_nulls_first()).mapInArrow(run, FOLDED)


class Folded(dict):
    """Tables by name; ``live`` is numbered when it is asked for."""

    def __init__(self, number: Callable[[], DataFrame], **tables: DataFrame):
        super().__init__(tables)
        self._number = number

    def __missing__(self, name: str) -> DataFrame:
        if name != "live":
            raise KeyError(name)
        self[name] = self._number()
        return self[name]


def fold(live: DataFrame, log: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """The log over live rows (row_id, doc_id, ordinal, req_id, text): tables ``live`` (with ordinals anew), ``archived``,
    ``outcomes`` (op, seq, row_id, outcome) and ``audit`` (seq, kind, row_id, req_id, old_text, text).

    Operations on rows that are nowhere are missing; null texts are empty; row ids are unique and not null; an empty log leaves the rows.
    """
    place = F.array(F.struct(F.lit(-(1 << 62)).cast("long").alias("turn"), F.col("ordinal").cast("int").alias("piece")))
    # a row that an operation makes begins with it: earlier operations don't find it
    rows = live.select(F.col("row_id").cast("string").alias("row_id"), F.lit(None).cast("long").alias("seq"), "doc_id", place.alias("place"), "req_id", "text")
    left = scratch.save(log.withColumn("row_id", F.col("row_id").cast("string")), "log")
    form = r"^(.*)\.\d+$"
    made_by = F.regexp_extract("row_id", form, 1)
    folded, turn, empty = [], 0, left.limit(0)
    while True:
        # operations on a row that another one of the log is to make wait for it
        waiting = left.where(F.rlike("row_id", F.lit(form)))
        now, later = left, empty
        if not waiting.isEmpty():
            later = waiting.join(left.select(F.col("op").alias("_maker")), made_by == F.col("_maker"), "left_semi")
            now = left.join(later.select("seq"), "seq", "left_anti")
            if turn and now.isEmpty() and rows.isEmpty():
                now, later = left, empty  # what is left waits for rows that were never made
        done = scratch.save(_fold(rows, now, rows.count() + now.count()), f"round{turn}")
        folded.append(done)
        rows = done.where("what = 'made'").select("row_id", "seq", "doc_id", "place", "req_id", "text")
        # makers that made nothing are done as well: whoever waits for them finds no row
        left, turn = scratch.save(later, f"log{turn}"), turn + 1
        if left.isEmpty():  # nothing names the rows that were made last
            folded.append(rows.select(F.lit("live").alias("what"), "row_id", "doc_id", "place", "req_id", F.coalesce("text", F.lit("")).alias("text")))
            break
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), folded)
    state = ["row_id", "doc_id", "req_id", "text"]
    return Folded(
        lambda: _numbered(whole.where("what = 'live'").select(*state, "place"), scratch).select(*state, "ordinal"),
        archived=whole.where("what = 'archived'").select(*state, "seq"),
        outcomes=whole.where("what = 'outcome'").select("op", "seq", "row_id", "outcome"),
        audit=whole.where("what = 'audit'").select("seq", "kind", "doc_id", "row_id", "req_id", "old_text", "text"),
    )


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Ordinals from 0 in the order of places, per document: a row's number in its range of places, from where the document
    begins there, after what earlier ranges hold of it."""
    ranges = -(-rows.count() // TASK_ROWS) or 1
    dealt = rows.repartitionByRange(ranges, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    parted = scratch.save(dealt.drop("place").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "parted")
    counts = parted.groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("_first"))
    earlier = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("doc_id", "part", (F.col("_first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("_start"))
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.part") == F.col("b.part"))
    return parted.alias("d").join(starts.alias("b"), same).select("d.*", (F.col("at") - F.col("_start")).alias("ordinal"))
