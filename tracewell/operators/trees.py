"""Folder trees: paths, document order, counts of whole subtrees, and the draft of a suite as rows of a version.

A folder has id (long, unique), parent, name and ordinal. Paths are found by doubling: each round joins every open folder with
the one its path has reached so far, so a tree of depth d takes log2(d) rounds of one join, however many folders there are.
The sort key of a node is the array of its ancestors' (kind, ordinal, id), itself last; arrays sort as the tree reads from
top to bottom, so no driver walks it. Counts go up by adding each folder's own count to every id in its key.

Defined results: a folder whose parent is not in the table is a root; folders on a cycle of parents, or below one, are in no
tree; null ordinals come last among siblings, ties go by id; subfolders come before cases; cases without a folder in the tree
are not in it (their path in a draft is empty); empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.scratch import Scratch

FOLDER, CASE = 0, 1
RANGE_ROWS = 100_000  # about as many rows are sorted in one task


def _node(kind: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col("ordinal").isNull().alias("last"), F.col("ordinal").cast("long").alias("ordinal"), F.col("id").cast("long").alias("id"))


def _doubled(state: DataFrame, scratch: Scratch, name: str, *grown: str) -> DataFrame:
    """(id, up, grown arrays), joined with what ``up`` has reached until it is null or must be on a cycle."""
    state = scratch.save(state, f"{name}0")
    turn, rows = 0, state.count()
    while not state.where("up is not null").isEmpty() and 2**turn <= rows:
        reached = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in grown])
        on = state.where("up is not null").join(reached, F.col("up") == F.col("_id"))
        turn += 1
        longer = on.select("id", F.col("_up").alias("up"), *[F.concat(f"_{c}", c).alias(c) for c in grown])
        state = scratch.save(state.where("up is null").unionByName(longer), f"{name}{turn}")
    return state.where("up is null")


def ancestors(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, ancestor) for every way up along links (id, parent), by doubling: round k adds the ways of up to 2 ** k links.

    Ways that never end, on a cycle of parents, are an error.
    """
    jumps = scratch.save(links.where("parent is not null").select("id", F.col("parent").alias("ancestor")), "ways0")
    found, turn, most = jumps, 0, jumps.count()
    while True:
        first = jumps.select("id", F.col("ancestor").alias("_via"))
        turn += 1
        longer = scratch.save(first.join(found.withColumnRenamed("id", "_via"), "_via").select("id", "ancestor"), f"ways{turn}")
        if longer.isEmpty():
            return found
        if 2 ** (turn - 1) >= most:
            raise ValueError("a cycle of parents")
        jumps = scratch.save(first.join(jumps.withColumnRenamed("id", "_via"), "_via").select("id", "ancestor"), f"jumps{turn}")
        found = found.unionByName(longer)


def forest(folders: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, parent, name, depth, path, key) of every folder that hangs from a root; depth counts from 1."""
    known = folders.select(F.col("id").alias("_known"))
    linked = folders.select("id", "parent", "name", "ordinal").join(known, F.col("parent") == F.col("_known"), "left").withColumnRenamed("_known", "up")
    linked = scratch.save(linked, "linked")
    # ids alone first: on a cycle a path would grow without end
    rooted = _doubled(linked.select("id", "up"), scratch, "ids").select("id")
    start = linked.join(rooted, "id", "left_semi").select("id", "up", F.array("name").alias("path"), F.array(_node(FOLDER)).alias("key"))
    paths = _doubled(start, scratch, "paths", "path", "key").drop("up")
    return linked.select("id", "parent", "name").join(paths, "id").select("id", "parent", "name", F.size("key").alias("depth"), "path", "key")


def numbered(rows: DataFrame, scratch: Scratch, key: str = "key", into: str = "position") -> DataFrame:
    """Rows with their place, from 0, in the order of ``key``: sorted inside ranges, after the rows of the ranges before.

    There are more ranges for more rows, so a task sorts about as many of any table.
    """
    given = scratch.save(rows, f"{into}_given")  # read to find the ranges and again to deal rows to them
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // RANGE_ROWS))
    # a sorted range numbers its own rows in the lower 33 bits
    ranged = given.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_own", F.monotonically_increasing_id())
    ranged = scratch.save(ranged, f"{into}_ranges").withColumn("_range", F.shiftright("_own", 33))
    scratch.drop(f"{into}_given")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_own").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(into, place).drop("_range", "_own", "_before")


def tree(folders: DataFrame, cases: DataFrame, scratch: Scratch) -> DataFrame:
    """Folders and their cases (id, folder_id, ordinal, name) as they read from top to bottom.

    (position, kind, id, parent, name, depth, path, n_cases): a case's path is its folder's; n_cases counts a folder's whole subtree.
    """
    found = scratch.save(forest(folders, scratch), "forest")
    own = cases.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n"))
    upwards = found.join(own, "id").select(F.explode("key.id").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n_cases"))
    shown = found.join(upwards, "id", "left").select(F.lit("folder").alias("kind"), "id", "parent", "name", "depth", "path", "key", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))
    above = found.select(F.col("id").alias("folder_id"), "depth", "path", F.col("key").alias("_above"))
    placed = cases.join(above, "folder_id").select(
        F.lit("case").alias("kind"), "id", F.col("folder_id").alias("parent"), "name", (F.col("depth") + 1).alias("depth"), "path", F.concat("_above", F.array(_node(CASE))).alias("key"), F.lit(None).cast("long").alias("n_cases")
    )
    return numbered(shown.unionByName(placed), scratch).drop("key")


def draft_rows(cases: DataFrame, folders: DataFrame, live: DataFrame, archive: DataFrame, fields: list[str], scratch: Scratch) -> DataFrame:
    """The draft of a suite as the rows that a new version would have.

    cases: uid, ordinal, folder_id, def_hash, citations (array of strings) and ``fields``; live and archive: id, req_id, text.
    Result: uid, ordinal, folder_path, def_hash, data, content_hash, req_hashes (id to the hash of its text), basis_hash and reqs
    (the cited texts). Citations that are no whole numbers cite nothing, nor do those past 64 bits; one cited twice counts
    once; a live text goes before an archived one; one found in neither has a null hash and no text.
    """
    cited = cases.select("uid", F.explode("citations").alias("v")).where(F.col("v").rlike(r"\A[0-9]+\z")).select("uid", F.col("v").try_cast("long").alias("id")).where("id is not null").distinct()
    sides = [rows.select("id", F.struct(F.md5("text").alias("hash"), "req_id", "text").alias(name)) for rows, name in ((live, "_live"), (archive, "_old"))]
    found = cited.join(sides[0], "id", "left").join(sides[1], "id", "left").select("uid", "id", F.coalesce("_live", "_old").alias("req"))
    entries = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("id", "req"))).alias("_cited"))
    paths = forest(folders, scratch).select(F.col("id").alias("folder_id"), "path")
    rows = cases.join(paths, "folder_id", "left").join(entries, "uid", "left").withColumn("_cited", F.coalesce("_cited", F.array().cast(entries.schema["_cited"].dataType)))
    kinds = dict(cases.dtypes)
    content = F.md5(F.concat_ws(T.UNIT_SEPARATOR, *[F.col(c).cast("string") if kinds[c] == "string" else F.to_json(F.col(c)) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string") for c in (*fields, "citations")]))
    hashes = F.map_from_entries(F.transform("_cited", lambda e: F.struct(e["id"].cast("string"), e["req"]["hash"])))
    basis = F.array_join(F.transform("_cited", lambda e: F.concat(e["id"].cast("string"), F.lit(":"), F.coalesce(e["req"]["hash"], F.lit("null")))), ",")
    return rows.select(
        "uid",
        "ordinal",
        F.coalesce("path", F.array().cast("array<string>")).alias("folder_path"),
        F.coalesce("def_hash", F.lit("")).alias("def_hash"),
        F.struct(*fields, "citations").alias("data"),
        content.alias("content_hash"),
        hashes.alias("req_hashes"),
        F.md5(F.concat(content, F.lit(T.UNIT_SEPARATOR), basis)).alias("basis_hash"),
        F.transform(F.filter("_cited", lambda e: e["req"].isNotNull()), lambda e: e["req"]).alias("reqs"),
    )
