"""MinHash near-duplicates with DartMinHash signatures.

A document's elements are its distinct shingles of ``SHINGLE`` words (one shingle of all words where there are
fewer); an element's weight is how often it occurs in the text, and similarity is weighted Jaccard: the sum of the
lesser weights over the sum of the greater ones, which for texts that repeat no shingle is that of plain sets. Each
element owns a Poisson process of hashed darts over rank and weight: the weight axis is cut into the regions [0, 1),
[1, 2), [2, 4) and so on, the darts of a region come in ascending rank with hashed gaps, and a dart counts where it
falls below the element's weight. Darts are thrown up to the rank at which ``K (ln K + 4)`` of them are expected in
the whole document, each at a hashed coordinate; the earliest dart of each of the ``K`` coordinates is the signature.
Where a coordinate stays empty, the document is thrown again with doubled rank. Time is in proportion to elements
plus darts, not to elements times coordinates.

``ROWS`` coordinates make a band key, ``BANDS`` keys a document: a pair of similarity 0.8 meets in some bucket but for
3 in a million. Equal word sequences are one node first, so copies never meet in a bucket. Links are exact. Which
pairs of a bucket can be left out follows from counts: of two nodes that are alike, each shares at least
s / (1 + s) of both sizes with other nodes (s: the similarity), so a node with too many elements that no other node
has goes at once, whatever the size of its buckets. What stays is compared in two turns of one comparison a node:
with the leader of its buckets that has the least share of such lonely elements (in a group of edited copies that is
the one next to the original), then with the first of those that are joined with nothing. Buckets whose nodes are not
one class by then are dealt into blocks of about ``BLOCK`` nodes; a task compares all pairs of two blocks that are of
different classes and returns the links that join classes, never a row for each pair.

Defined results: texts without words link with nothing; a null text has no words; rows without an id link with
nothing; rows that repeat an id are one document, which links with what any of its texts does; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm.components import components
from tracewell.llm.joins import within_bound
from tracewell.llm.tokenizing import by_size

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 4
BANDS = 24
K = ROWS * BANDS
BLOCK = 256
ELEMENT_BITS = 40
#: So many ids at most (16 MB) are broadcast; beyond that the tables are joined by a shuffle.
BROADCAST_IDS = 1 << 20
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, their bounds per text, and two hashes of each text's word sequence."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(coded.dictionary) else np.zeros(0, dtype=np.uint64)
    real = np.array([w != "" for w in coded.dictionary.to_pylist()], dtype=bool)
    index = coded.indices.to_numpy()
    keep = real[index] if len(index) else np.zeros(0, dtype=bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    bounds = before[bounds - bounds[0]]
    flat = words[index[keep]] if len(index) else np.zeros(0, dtype=np.uint64)
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        place = (np.arange(len(flat)) - np.repeat(bounds[:-1], n)).astype(U)
        whole = [np.concatenate([[U(0)], np.cumsum(mix(flat + (place + U(1)) * k), dtype=U)]) for k in (GOLDEN, U(0xD6E8FEB86659FD93))]
        text_hashes = np.stack([h[bounds[1:]] - h[bounds[:-1]] for h in whole], axis=1)
        padded = np.concatenate([flat, np.zeros(SHINGLE, dtype=U)])
        rolled = np.zeros(len(flat), dtype=U)
        for k in range(SHINGLE):
            rolled = rolled * GOLDEN + mix(padded[k : k + len(flat)] + U(k))
        rolled = mix(rolled)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    starts = np.repeat(bounds[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = rolled[starts]
    until = np.concatenate([[0], np.cumsum(counts)])
    out[until[short]] = text_hashes[short, 0]
    return out, until, text_hashes


def weighed(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (``ELEMENT_BITS`` of their hashes), how often each occurs there, and bounds per text."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=U), np.diff(bounds))
    keys = np.sort((owner << U(ELEMENT_BITS)) | (hashes >> U(64 - ELEMENT_BITS)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    until = np.searchsorted(keys >> U(ELEMENT_BITS), np.arange(len(bounds), dtype=U))
    return keys & U((1 << ELEMENT_BITS) - 1), counts, until


def occurrences(elements: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sets as plain ones: a shingle that occurs c times is c numbered elements."""
    until = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(until[-1]) - np.repeat(until[:-1], counts)
    return np.repeat(elements, counts) | (number.astype(U) << U(ELEMENT_BITS)), until[bounds]


def signatures(elements: np.ndarray, bounds: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """Earliest dart of each coordinate: [texts, k] of 64-bit values; rows of texts without elements are 0."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    total = np.bincount(owner, weights=weights, minlength=texts)
    signature = np.full((texts, k), np.iinfo(np.uint64).max, dtype=U)
    limit = np.where(total > 0, k * (np.log(k) + 4) / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        _throw(signature, elements[mine], owner[mine], weights[mine], limit, k)
        empty = (signature == np.iinfo(np.uint64).max).any(axis=1) & (total > 0)
        limit, todo = np.where(empty, 2 * limit, limit), empty
    signature[total == 0] = 0
    return signature


def _throw(signature: np.ndarray, elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, limit: np.ndarray, k: int) -> None:
    flat = signature.reshape(-1)
    region = 0
    inside = np.arange(len(elements))
    while len(inside):
        low, high = (0.0 if region == 0 else 2.0 ** (region - 1)), 2.0**region
        inside = inside[weights[inside] > low]
        seed = mix(elements[inside] + U(region + 1) * GOLDEN)
        rank, alive, throw = np.zeros(len(inside)), inside, 0
        while len(alive):
            throw += 1
            dart = mix(seed + U(throw) * GOLDEN)
            rank = rank - np.log(((dart >> U(11)).astype(float) + 0.5) / float(1 << 53)) / (high - low)
            on = rank <= limit[owner[alive]]
            alive, seed, rank, dart = alive[on], seed[on], rank[on], dart[on]
            spot = mix(dart ^ GOLDEN)
            height = low + (high - low) * ((spot >> U(40)).astype(float) / float(1 << 24))
            hit = height <= weights[alive]
            # rank as ordered bits, then the dart's own bits: the least is the earliest, and names the dart
            value = (rank[hit].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (spot[hit] & U(0xFFFFFFFF))
            coordinate = (dart[hit] % U(k)).astype(np.int64)
            np.minimum.at(flat, owner[alive[hit]] * k + coordinate, value)
        region += 1


def band_keys(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    bands = signature.reshape(n, BANDS, ROWS)
    key = np.zeros((n, BANDS), dtype=U) + np.arange(1, BANDS + 1, dtype=U) * GOLDEN
    for r in range(ROWS):
        key = mix(key * GOLDEN + bands[:, :, r])
    return key.view(np.int64)


def with_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_a and text_b (the word sequence's hash), n_elements, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for block in by_size(batch, "text"):
                    hashes, bounds, text = shingles(block.column("text"))
                    elements, counts, until = weighed(hashes, bounds)
                    keys = band_keys(signatures(elements, until, counts.astype(float)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                    columns = [block.column("doc_id"), *(pa.array(text[:, c].copy().view(np.int64)) for c in (0, 1)), pa.array(np.diff(bounds)), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_a", "text_b", "n_elements", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, text_a long, text_b long, n_elements long, bands array<long>"
    )


def weighted_sets(docs: DataFrame) -> DataFrame:
    """node (the document's id), text_a and the numbered elements of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for block in by_size(batch, "text"):
                    hashes, bounds, text = shingles(block.column("text"))
                    flat, until = occurrences(*weighed(hashes, bounds))
                    lists = pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(text[:, 0].copy().view(np.int64)), lists], names=["node", "text_a", "elements"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, text_a long, elements array<long>")


def _facts(sets: DataFrame) -> DataFrame:
    """node, size (least number of elements of its texts), shared (of them, at most so many occur in other nodes), lonely."""
    each = sets.select("node", F.explode("elements").alias("element"))
    alone = each.groupBy("element").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node", F.size("elements").alias("n")).groupBy("node").agg(F.min("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("texts"))
    found = sizes.join(alone, "node", "left")
    lonely = F.when(F.col("texts") == 1, F.coalesce("alone", F.lit(0))).otherwise(0)
    return found.select("node", "size", (F.col("most") - lonely).alias("shared"), (lonely / F.col("size")).alias("lonely"))


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, other) that are alike."""
    left, right = (sets.select(F.col("node").alias(k), F.col("elements").alias(f"{k}_set")) for k in ("node", "other"))
    common = F.size(F.array_intersect("node_set", "other_set"))
    alike = common >= F.lit(similarity) * (F.size("node_set") + F.size("other_set") - common)
    return pairs.join(left, "node").join(right, "other").where(alike).select("node", "other")


def _unit_links(rows: pa.Table, low: int, high: int, similarity: float) -> list[tuple[int, int]]:
    """Links of one unit of work that join what is not joined yet: a spanning forest, not all pairs."""
    node, block, root = (rows.column(c).to_numpy() for c in ("node", "block", "root"))
    lists = rows.column("elements").combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    sizes, shared = np.diff(bounds), rows.column("shared").to_numpy()
    part = np.unique(root, return_inverse=True)[1]
    mark, links = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool), []
    right = np.flatnonzero(block == high)
    for x in np.flatnonzero(block == low):
        total = sizes[x] + sizes[right]
        least = similarity / (1 + similarity) * total - 1e-9
        open_ = (part[right] != part[x]) & (np.minimum(shared[right], shared[x]) >= least) & (np.minimum(sizes[right], sizes[x]) >= least)
        others = right[open_ & (right > x)] if low == high else right[open_]
        if not len(others):
            continue
        mark[ids[bounds[x] : bounds[x + 1]]] = True
        for y in others:
            if part[y] != part[x]:
                common = int(mark[ids[bounds[y] : bounds[y + 1]]].sum())
                if common >= similarity * (sizes[x] + sizes[y] - common):
                    links.append((int(node[x]), int(node[y])))
                    part[part == part[y]] = part[x]
        mark[ids[bounds[x] : bounds[x + 1]]] = False
    return links


def _rest(live: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (node, other) between all pairs of different roots that share a bucket of ``live``, block by block."""
    sizes = live.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = live.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    dealt = dealt.select("bucket", "node", "root", "shared", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("bucket", "node", "root", "shared", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    work = dealt.join(sets.select("node", "elements"), "node")
    unit = ["bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def finish() -> Iterator[pa.RecordBatch]:
            if held and (found := _unit_links(pa.Table.from_batches(held), now[1], now[2], similarity)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["node", "other"])

        for batch in batches:
            values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in unit], axis=1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if (key := tuple(values[a].tolist())) != now:
                        yield from finish()
                        held, now = [], key
                    held.append(batch.slice(a, b - a))
        yield from finish()

    return work.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "node long, other long")


def near_duplicates(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least id of its class) and kept (the one that stays), one row per row of docs (doc_id, text)."""
    signed = scratch.save(with_signatures(docs.select("doc_id", "text")), "signed")
    real = signed.where("doc_id is not null and n_elements > 0")
    same = ["text_a", "text_b"]
    nodes = scratch.save(real.groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")

    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    several = placed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = scratch.save(placed.join(several.select("bucket"), "bucket").select("node", "bucket"), "members")
    wanted = within_bound(scratch.save(members.select(F.col("node").alias("doc_id")).distinct(), "wanted"), BROADCAST_IDS)
    sets = weighted_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"))
    sets = scratch.save(sets.groupBy("node", "text_a").agg(F.first("elements").alias("elements")), "sets")
    facts = scratch.save(_facts(sets).where(F.col("shared") >= F.lit(similarity) * F.col("size")), "facts")
    rows = scratch.save(members.join(facts, "node"), "rows")
    scratch.drop("members")

    # the bound that a partner of the bucket's least size would leave
    fits = F.col("shared") >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.greatest(F.lit(similarity) * F.col("size"), F.col("least_size"))) - F.lit(1e-9)

    def open_buckets(rooted: DataFrame, order: Column) -> DataFrame:
        buckets = rooted.groupBy("bucket").agg(
            F.min("root").alias("least"), F.max("root").alias("most"), F.min("size").alias("least_size"),
            F.min(F.struct(order.alias("order"), "node", "root")).alias("leader"),
        ).where("least < most")
        return rooted.join(buckets.drop("least", "most"), "bucket").where(fits)

    def turn(rooted: DataFrame, order: Column, name: str) -> DataFrame:
        """Compare each node with the first leader of its open buckets."""
        asked = open_buckets(rooted, order).where(F.col("root") != F.col("leader.root"))
        pairs = asked.groupBy("node").agg(F.min("leader").alias("leader")).select("node", F.col("leader.node").alias("other"))
        return scratch.save(_compared(pairs, sets, similarity), name).distinct()

    central = F.struct("lonely", F.xxhash64("node").alias("hash"))
    first = turn(rows.withColumn("root", F.col("node")), central, "first")
    heads = first.select(F.col("node").alias("other"), F.col("other").alias("above"))
    joined = first.join(heads, "other", "left").select("node", F.coalesce("above", "other").alias("root"))
    joined = scratch.save(rows.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "joined")
    # then the most central of those that are joined with nothing yet
    second = turn(joined, F.struct((F.col("root") != F.col("node")).alias("member"), "lonely", F.xxhash64("node", F.lit(2)).alias("hash")), "second")
    links = first.unionByName(second).select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = scratch.save(components(links, scratch, "two"), "roots")
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = open_buckets(rooted, central)
    # what stays alone in its bucket has no partner there
    two = left.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    rest = scratch.save(_rest(left.join(two, "bucket").select("bucket", "node", "root", "shared"), sets, similarity), "rest")
    if not rest.isEmpty():
        # roots are stars already: they and the new links make the classes
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = scratch.save(components(stars.unionByName(rest.select(F.col("node").alias("a"), F.col("other").alias("b"))), scratch, "all"), "all_roots")
    for name in ("sets", "facts", "rows", "first", "joined", "second", "rest"):
        scratch.drop(name)
    classes = scratch.save(nodes.select(*same, "node").join(roots, "node", "left").select(*same, F.coalesce("root", "node").alias("class_id")), "classes")
    linked = real.select("doc_id", *same).join(classes, same).select("doc_id", "class_id")
    alone = signed.where("doc_id is null or n_elements = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_first(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without all but one of each class, with the columns of ``docs``; repeated rows of one id are one."""
    judged = scratch.save(near_duplicates(docs, scratch), "judged")
    gone = within_bound(scratch.save(judged.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone"), BROADCAST_IDS)
    repeated = scratch.save(judged.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again"), "repeated")
    names = {c: f"_doc{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    stay = plain.join(gone, F.col(names["doc_id"]) == F.col("_gone"), "left_anti")
    if not repeated.isEmpty():
        again = within_bound(repeated, BROADCAST_IDS)
        here = F.col(names["doc_id"]) == F.col("_again")
        # equal ids are told apart by their rows alone: the first by text, then by all other columns
        first = Window.partitionBy(names["doc_id"]).orderBy(names["text"], *[F.col(n).cast("string") for n in names.values()])
        one = stay.join(again, here, "left_semi").withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
        stay = stay.join(again, here, "left_anti").unionByName(one)
    return stay.select(*[F.col(n).alias(c) for c, n in names.items()])
