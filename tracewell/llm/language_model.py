"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the words before it, times that of its part of the class given the same
words and the class, times its own share of the part. A class is drawn in two steps, a group of ``MEMBERS`` classes and the class
in its group. All three are softmaxes over sums of weights of hashed features: a bias, the word before, the two words before (n-grams), the second and the third word before (skips). The most frequent
tokens are classes of their own; the others are classed by how often they occur in the training texts and by a hash of
their last letters, and a class has ``SUBS`` hashed parts, so that no vocabulary is needed to normalize. Bins of counts hold
like shares of the training tokens, and with the training tokens the feature buckets, single tokens and bins grow
(``Sizes``). Within a part tokens have their relative frequency; in the classes of the rarest, the share of tokens never
seen follows from the numbers of words seen once and twice.

How it runs: texts are cut into blocks of about ``BLOCK`` bytes, stored as indexes into the block's own
dictionary. The words of all dictionaries are dealt by hash into parts, a part sums its words over the blocks and
answers each block with the corpus counts of its words; neither a count table nor a vocabulary is held anywhere
whole, and there are as many parts as blocks need. Training takes ``ROUNDS`` rounds, each over its share of the
blocks, all of them once: every shard starts from the same weights, takes stochastic gradient steps (observed class
minus a class drawn from the model) and returns its change. Blocks are dealt to shards by their name and learnt in order,
changes are averaged by tokens in the order of shards, a slice of the weights to a task: scores depend on how the input is
cut into blocks, not on tasks, fetch order or cluster size. Weights grow with the square root of the training tokens and are sent
to all tasks; a round has so many tasks that their changes are about as large as the texts.

Defined results: a null text is empty and holds the end token alone; a null id counts as the empty string for
the fold; equal rows give equal rows; without training texts nothing is known and class weights stay zero; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm.neardup import GOLDEN, mix
from tracewell.llm.tokenizing import by_size

BLOCK = 16 << 20
FOLDS = 10
#: The least numbers, of a small corpus; ``Sizes`` has those of a larger one.
SINGLES = 32
ENDINGS = 8
MEMBERS = 8  # classes of a group; divides the numbers of single tokens and of ending classes
SUBS = 16  # hashed parts of a class, told apart by the last softmax
BINS = (1, 15, 255)  # the largest count of each bin but the last
CLASSES = SINGLES + ENDINGS * (len(BINS) + 1)
BUCKETS = 1 << 16
ROUNDS = 4
SLICES = 16
BUCKETS_PER_ROOT = 16  # buckets per square root of the training tokens
LEVELS = 48  # counts by powers of two, from which bins are made
TOPS = SINGLES + 8 * LEVELS  # more than there are single tokens for any number of training tokens
TRAINERS = 8
TOKEN_BYTES = 6
STEP = 0.5
BATCH = 4096
CHUNK = 1024  # tokens whose probabilities are held at once, small enough for a core's cache
REACH = 16.0  # the largest weight: no product of five exponentials leaves float32
LOWEST, HIGHEST = np.exp(np.array([-REACH, REACH], dtype=np.float32))
BLOCKS_PER_PART = 16
ADDED = 0.1
U = np.uint64
END = np.int64(0x5EED)  # the end token's hash
TOKENIZED = (
    "block long, doc_ids array<long>, held array<boolean>, bounds array<long>, ids binary, words binary, features binary, endings binary, learned binary"
)
ANSWERS = (
    "block long, part int, counts binary, total long, distinct long, once long, twice long, mass array<long>, "
    "top_words array<long>, top_counts array<long>, top_endings array<long>"
)
CODED = (
    "block long, turn int, doc_ids array<long>, held array<boolean>, bounds array<long>, classes binary, parts binary, hashes binary, ids binary, "
    "known array<long>, base array<double>, inner array<double>"
)


def packed(x: np.ndarray) -> bytes:
    """An array, its bytes by significance, compressed."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.zeros(0, dtype=np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in doc_ids], dtype=bool)


def tokenized(docs: DataFrame) -> DataFrame:
    """One row per block of texts: documents, token bounds, token indexes into the block's dictionary, training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in by_size(batch, "text", BLOCK):
                yield pa.RecordBatch.from_pylist([_tokenize(block)], schema=_schema(TOKENIZED))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENIZED)


def _schema(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _tokenize(block: pa.RecordBatch) -> dict:
    ids = block.column("doc_id").to_pylist()
    held = held_out(ids)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(block.column("text"), "")))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy().astype(np.int32)
    keep = np.array([w != "" for w in words], dtype=bool)[index] if len(index) else np.zeros(0, dtype=bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    bounds = before[bounds - bounds[0]]
    # every text's words, then one end
    n = len(ids)
    until = bounds + np.arange(n + 1)
    tokens = np.full(until[-1], len(words), dtype=np.int32)
    spots = np.ones(until[-1], dtype=bool)
    spots[until[1:] - 1] = False
    tokens[spots] = index[keep]
    hashes = pd.util.hash_array(np.asarray(words, dtype=object), categorize=False).view(np.int64) if words else np.zeros(0, dtype=np.int64)
    last = pc.utf8_slice_codeunits(coded.dictionary, -2).dictionary_encode()
    ending_of = np.array([zlib.crc32(e.encode()) % ENDINGS for e in last.dictionary.to_pylist()], dtype=np.uint8)
    endings = np.append(ending_of[last.indices.to_numpy()], np.uint8(0))
    hashes = np.append(hashes, END)
    learned = np.bincount(tokens[np.repeat(~held, np.diff(until))], minlength=len(words) + 1)
    # by all that is in it: blocks of one name are equal, ids and texts, and take equal answers
    name = int.from_bytes(hashlib.blake2b(b"".join((tokens.tobytes(), hashes.tobytes(), until.tobytes(), repr(ids).encode())), digest_size=8).digest()) >> 1
    return {
        "block": name, "doc_ids": ids, "held": held, "bounds": until, "ids": packed(tokens), "words": packed(hashes),
        "features": packed(_feature_hash(hashes)), "endings": packed(endings), "learned": packed(learned),
    }


def _feature_hash(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes.view(U)) >> U(32)).astype(np.uint32)


def _part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (words.view(U) >> U(16)) % U(parts)


def corpus_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """Answers to each block (the counts of its words in a part, in the block's order), and a row of facts per part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, learned, endings = unpacked(row["words"], np.int64), unpacked(row["learned"], np.int64), unpacked(row["endings"], np.uint8)
                part = _part_of(words, parts)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=U))
                mine = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                found = [k for k in range(parts) if len(mine[k])]
                columns = [[row["block"]] * len(found), found, *([packed(x[mine[k]]) for k in found] for x in (words, learned, endings))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, dealt.types, strict=True)], schema=dealt)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [unpacked(r["words"], np.int64) for r in rows]
        every = np.concatenate(words)
        distinct, at = np.unique(every, return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([unpacked(r["learned"], np.int64) for r in rows]).astype(float)).astype(np.int64)
        ending = np.zeros(len(distinct), dtype=np.int64)
        ending[at] = np.concatenate([unpacked(r["endings"], np.uint8) for r in rows])
        until = np.cumsum([0, *map(len, words)])
        out = [{"block": r["block"], "part": r["part"], "counts": packed(c[at[a:b]])} for r, a, b in zip(rows, until, until[1:], strict=False)]
        top = np.argsort(-c, kind="stable")[:TOPS]
        seen = c > 0
        cell = (level(c[seen]) * ENDINGS + ending[seen]) * SUBS + sub_of(distinct[seen])
        mass = np.bincount(cell, weights=c[seen].astype(float), minlength=LEVELS * ENDINGS * SUBS)
        facts = {"total": c.sum(), "distinct": seen.sum(), "once": (c == 1).sum(), "twice": (c == 2).sum(), "mass": mass.astype(np.int64)}
        facts |= {"part": rows[0]["part"], "top_words": distinct[top], "top_counts": c[top], "top_endings": ending[top]}
        return pa.Table.from_pylist([*out, facts], schema=_schema(ANSWERS))

    dealt = _schema("block long, part int, words binary, learned binary, endings binary")
    sent = blocks.select("block", "words", "learned", "endings").mapInArrow(deal, "block long, part int, words binary, learned binary, endings binary")
    return sent.groupBy("part").applyInArrow(answer, ANSWERS)


def sub_of(words: np.ndarray) -> np.ndarray:
    """The part of its class that a word's hash falls into."""
    return ((words.view(U) >> U(40)) % U(SUBS)).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """The power of two at or below each count."""
    return np.frexp(counts.astype(float))[1].astype(np.int64) - 1


class Sizes:
    """How large the model is for a number of training tokens."""

    def __init__(self, total: int):
        self.buckets = BUCKETS
        while self.buckets < BUCKETS_PER_ROOT * total**0.5:
            self.buckets *= 2
        doublings = (self.buckets // BUCKETS).bit_length() - 1
        self.singles = SINGLES + 8 * doublings
        self.bins = len(BINS) + doublings // 2  # besides that of words seen once or never

    def limits(self, mass: np.ndarray) -> tuple[int, ...]:
        """The largest count of each bin but the last: bins of like mass, from the mass of each level of counts."""
        upto = np.cumsum(mass[1:])
        cuts = [int(np.searchsorted(upto, upto[-1] * k / self.bins)) + 1 for k in range(1, self.bins)]
        last = int(np.flatnonzero(mass)[-1]) if mass.any() else 0
        return (1, *[2 ** (k + 1) - 1 for k in sorted(set(cuts)) if k < last])


class Shares:
    """What is known of the corpus in a few numbers: totals, the single tokens and the tokens in each class."""

    def __init__(
        self, total: int, distinct: int, once: int, twice: int, singles: list[tuple[int, int]], mass: list[int],
        bins: tuple[int, ...] = BINS, room: int = SINGLES,
    ):
        self.bins, self.room, self.endings = np.array(bins), room, len(mass) // ((len(bins) + 1) * SUBS)
        self.total, self.distinct = total, distinct
        self.unseen = once / (once + 2 * twice) if once else 1.0
        words = np.array([w for w, _ in singles], dtype=np.int64)
        self.single_counts = np.array([c for _, c in singles], dtype=np.int64)
        self.single_hashes = _feature_hash(words)
        self.mass = np.zeros((room + len(mass) // SUBS, SUBS))  # of each class and part; a single token is one part
        self.mass[: len(singles), 0] = self.single_counts
        self.mass[room:] = np.array(mass, dtype=float).reshape(-1, SUBS)

    def classes(self, hashes: np.ndarray, counts: np.ndarray, endings: np.ndarray) -> np.ndarray:
        found = self.room + np.searchsorted(self.bins, counts, "left") * self.endings + endings
        for k, (h, c) in enumerate(zip(self.single_hashes, self.single_counts, strict=True)):
            found[(hashes == h) & (counts == c)] = k
        return found.astype(np.uint16)

    def parts(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.where(classes < self.room, 0, sub_of(words)).astype(np.uint8)

    def inner(self, counts: np.ndarray, classes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its part of the class."""
        share = counts / np.maximum(self.mass[classes, parts], 1)
        rare = (classes >= self.room) & (classes < self.room + self.endings)
        share = np.where(rare, np.where(counts > 0, share * (1 - self.unseen), self.unseen), share)
        return np.log10(np.maximum(share, 1e-300))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.total + ADDED * (self.distinct + 1)))


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each document's own values in their order, whatever else is in the block."""
    return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), weights=values, minlength=len(bounds) - 1)


def _code(shares: Shares, parts: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block with the corpus counts of its words: classes and feature hashes by word, sums by document."""
    answers = {r["part"]: r["counts"] for r in right.to_pylist()}
    out = []
    for row in left.to_pylist():
        words, tokens, hashes = unpacked(row["words"], np.int64), unpacked(row["ids"], np.int32), unpacked(row["features"], np.uint32)
        part = _part_of(words, parts)
        order = np.argsort(part, kind="stable")
        counts = np.zeros(len(words), dtype=np.int64)
        counts[order] = np.concatenate([unpacked(answers[k], np.int64) for k in np.unique(part).tolist()])
        classes = shares.classes(hashes, counts, unpacked(row["endings"], np.uint8))
        bounds = np.array(row["bounds"])
        sub = shares.parts(words, classes)
        sums = lambda x: per_document(x[tokens], bounds)  # noqa: B023, E731
        out.append(
            {
                "block": row["block"], "turn": int(row["block"] % ROUNDS), "doc_ids": row["doc_ids"], "held": row["held"], "bounds": row["bounds"],
                "classes": packed(classes), "parts": packed(sub), "hashes": row["features"], "ids": row["ids"],
                "known": sums((counts > 0).astype(float)).astype(np.int64), "base": sums(shares.base(counts)), "inner": sums(shares.inner(counts, classes, sub)),
            }
        )
    return pa.Table.from_pylist(out, schema=_schema(CODED))


def features(hashes: np.ndarray, bounds: np.ndarray, many: int = BUCKETS, at: np.ndarray | None = None) -> np.ndarray:
    """Feature buckets of the tokens at these places (or all): [5, tokens]; before a text's first word stands a mark of its own."""
    at = np.arange(len(hashes)) if at is None else at
    place = at - bounds[np.searchsorted(bounds, at, "right") - 1]
    one, two, three = (np.where(place >= k, hashes[np.maximum(at - k, 0)].astype(U), U(1 << 32) + U(k)) for k in (1, 2, 3))
    # n-grams: the word before, the two before; skips: the second and the third before alone
    seeds = np.stack([one * U(4) + U(1), (mix(one) + two) * U(4) + U(2), two * U(4) + U(3), mix(three) * U(4) + U(3)])
    found = np.zeros((5, len(at)), dtype=np.int64)
    mixed = mix(seeds)
    found[1:] = mixed - mixed // U(many - 1) * U(many - 1) + U(1)  # the remainder, which numpy takes one by one
    return found


def inside(buckets: np.ndarray, outcomes: np.ndarray, many: int, kind: int) -> np.ndarray:
    """Buckets of the same features together with a group (kind 1) or a class (kind 0), for the softmax over what is in it."""
    seeds = buckets.view(U) * GOLDEN
    seeds += outcomes.view(U) + U(1 + (kind << 32))
    return (mix(seeds) & U(many - 1)).view(np.int64)  # many is a power of two


def class_weights(powers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unnormalized probabilities [tokens, outcomes]: products of the exponentials of weights."""
    found = powers.take(at[1], axis=0, mode="clip")
    one = np.empty_like(found)
    for feature in at[2:]:
        found *= powers.take(feature, axis=0, mode="clip", out=one)
    bias = at[0]
    found *= powers[bias[:1]] if (bias == bias[0]).all() else powers.take(bias, axis=0, mode="clip", out=one)
    return found


def draw(powers: np.ndarray, at: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """An outcome drawn from the model for each token: how many running sums lie below a threshold."""
    many = powers.shape[1]
    upto = np.tril(np.ones((many, many), dtype=np.float32))
    thresholds = random.random(at.shape[1], dtype=np.float32)
    drawn = np.empty(at.shape[1], dtype=np.int64)
    for a in range(0, at.shape[1], CHUNK):
        rows = slice(a, a + CHUNK)
        sums = upto @ class_weights(powers, at[:, rows]).T  # outcomes by tokens: each step runs over all tokens
        if not (sums[-1].min() > 0 and np.isfinite(sums[-1].max())):  # weights outran float32
            np.clip(powers, LOWEST, HIGHEST, out=powers)
            sums = upto @ class_weights(powers, at[:, rows]).T
        # the last sum is above every threshold
        drawn[rows] = np.add.reduce((sums[:-1] <= thresholds[rows] * sums[-1]).view(np.uint8), axis=0, dtype=np.uint8)
    return drawn


def log_chance(powers: np.ndarray, at: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each observed outcome."""
    chance = class_weights(powers, at)
    return np.log(chance[np.arange(len(observed)), observed] / (chance @ np.ones(chance.shape[1], dtype=np.float32)))


def split(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponentials of the weights of groups, of the classes in them and of parts, each in one piece."""
    groups = weights.shape[1] - SUBS - MEMBERS
    weights = weights.view(np.float32)  # an array that was sent has a type of its own, equal to this one, with which ufunc.at is 30 times slower
    return tuple(np.exp(np.clip(part, -REACH, REACH)) for part in np.split(weights, [groups, groups + MEMBERS], axis=1))


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = unpacked(row["ids"], np.int32)
    return np.array(row["bounds"]), unpacked(row["classes"], np.uint16)[ids], unpacked(row["parts"], np.uint8)[ids], unpacked(row["hashes"], np.uint32)[ids]


def _step(powers: np.ndarray, visits: np.ndarray, at: np.ndarray, observed: np.ndarray, random: np.random.Generator, gains: np.ndarray) -> None:
    """A stochastic gradient step of one softmax: the observed outcome gains what one drawn from the model loses.

    Weights are held as exponentials, so a sum is a product and a token costs no exponential for each outcome; ``gains`` has the factor of
    a bucket that so many tokens of the batch visit.
    """
    many, flat = powers.shape[1], powers.reshape(-1)
    drawn = draw(powers, at, random)
    wrong = np.flatnonzero(drawn != observed)  # elsewhere gain and loss are one
    every = at.reshape(-1)
    np.add.at(visits, every, 1)
    own = at.take(wrong, axis=1)
    gain = gains.take(visits.take(own)).reshape(-1)
    own *= many
    np.multiply.at(flat, (own + observed[wrong]).reshape(-1), gain)
    np.divide.at(flat, (own + drawn[wrong]).reshape(-1), gain)
    visits[every] = 0


def _outcomes(buckets: np.ndarray, classes: np.ndarray, parts: np.ndarray, many: int, room: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each softmax its number, the tokens it decides, their buckets and what was observed; a single token has no parts."""
    every = np.arange(len(classes))
    group, member = np.divmod(classes.astype(np.int64), MEMBERS)
    with np.errstate(over="ignore"):
        yield 0, every, buckets, group
        yield 1, every, inside(buckets, group, many, 1), member
        inner = np.flatnonzero(classes >= room)
        if len(inner):
            yield 2, inner, inside(buckets.take(inner, axis=1), classes[inner].astype(np.int64), many, 0), parts[inner].astype(np.int64)


def learn(tables: tuple[np.ndarray, ...], row: dict, step: float, room: int = SINGLES) -> int:
    """Gradient steps over a block's training texts, in place; returns their tokens."""
    bounds, classes, parts, hashes = _arrays(row)
    at = np.flatnonzero(np.repeat(~np.array(row["held"], dtype=bool), np.diff(bounds)))
    many = len(tables[0])
    visits = np.zeros(many, dtype=np.int64)
    gains = [np.exp((step / (np.arange(5 * BATCH + 1) / t.shape[1] ** 0.5 + 4)).astype(np.float32)) for t in tables]
    random = np.random.default_rng(row["block"] & 0xFFFFFFFF)
    for a in range(0, len(at), BATCH):
        mine = at[a : a + BATCH]
        with np.errstate(over="ignore"):
            buckets = features(hashes, bounds, many, mine)
        for k, _, b, observed in _outcomes(buckets, classes[mine], parts[mine], many, room):
            _step(tables[k], visits, b, observed, random, gains[k])
    return len(at)


def log_chances(tables: tuple[np.ndarray, ...], row: dict, room: int) -> np.ndarray:
    """Natural logarithm of each token's group, class and part, by the three softmaxes."""
    bounds, classes, parts, hashes = _arrays(row)
    logs, many = np.zeros(len(classes)), len(tables[0])
    for a in range(0, len(classes), CHUNK):
        own = np.arange(a, min(a + CHUNK, len(classes)))
        with np.errstate(over="ignore"):
            buckets = features(hashes, bounds, many, own)
        for k, at, b, observed in _outcomes(buckets, classes[own], parts[own], many, room):
            logs[own[at]] += log_chance(tables[k], b, observed)
    return logs


def train(coded: DataFrame, spark, buckets: int, classes: int, total: int, room: int) -> np.ndarray:
    width = classes // MEMBERS + MEMBERS + SUBS
    weights = np.zeros((buckets, width), dtype=np.float32)
    height = buckets // SLICES
    shards = int(max(TRAINERS, total * TOKEN_BYTES // (ROUNDS * weights.nbytes)))
    kinds = "slice int, shard int, tokens long, part binary"
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)
        step = STEP / (1 + turn / ROUNDS)

        def change(batches: Iterator[pa.RecordBatch], start=start, step=step) -> Iterator[pa.RecordBatch]:
            mine, tokens, now = None, 0, None

            def finish() -> Iterator[pa.RecordBatch]:
                for k in range(SLICES if tokens else 0):
                    rows = slice(k * height, (k + 1) * height)
                    # weights that were never touched change by nothing, not by a rounding error
                    part = np.log(np.concatenate([m[rows] / first for m, first in zip(mine, split(start.value[rows]), strict=True)], axis=1)) * np.float32(tokens)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([now], pa.int32()), pa.array([tokens]), pa.array([part.tobytes()])], names=["slice", "shard", "tokens", "part"])

            for batch in batches:
                for row in batch.to_pylist():
                    if row["shard"] != now:
                        yield from finish()
                        mine, tokens, now = split(start.value), 0, row["shard"]
                    tokens += learn(mine, row, step, room)
            yield from finish()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    part = np.frombuffer(row["part"], dtype=np.float32)
                    held = sums.setdefault(row["slice"], [0, np.zeros(len(part))])
                    held[0] += row["tokens"]
                    held[1] += part
            for k, (tokens, part) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([tokens]), pa.array([(part / tokens).astype(np.float32).tobytes()])], names=["slice", "shard", "tokens", "part"])

        # blocks are dealt to shards by their name and changes added in the order of shards, so the sums don't depend on tasks
        mine = coded.where(F.col("turn") == turn).select("block", "held", "bounds", "classes", "parts", "hashes", "ids", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"))
        changes = mine.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(change, kinds)
        summed = changes.repartition(SLICES, "slice").sortWithinPartitions("slice", "shard").mapInArrow(add, kinds)
        for row in summed.toLocalIterator():  # a slice at a time
            weights[row["slice"] * height : (row["slice"] + 1) * height] += np.frombuffer(row["part"], dtype=np.float32).reshape(height, width)
        start.destroy()
    return weights


def score(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text of docs (doc_id, text)."""
    spark = scratch.spark
    blocks = scratch.save(tokenized(docs), "blocks")
    parts = max(SLICES, blocks.count() // BLOCKS_PER_PART)
    answers = scratch.save(corpus_counts(blocks, parts), "answers")
    facts = answers.where("block is null")
    sums = facts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "once", "twice")]).first()
    tops = facts.select(F.inline(F.arrays_zip("top_words", "top_counts", "top_endings"))).where("top_counts > 0")
    total = int(sums[0])
    sizes = Sizes(total)
    top = tops.orderBy(F.desc("top_counts"), "top_words").limit(sizes.singles).collect()
    mass = np.zeros((LEVELS, ENDINGS, SUBS), dtype=np.int64)
    for r in facts.select(F.posexplode("mass").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        mass.reshape(-1)[r["k"]] = r["n"]
    for r in top:
        mass[level(np.array(r["top_counts"])), r["top_endings"], sub_of(np.array([r["top_words"]]))[0]] -= r["top_counts"]
    bins = sizes.limits(mass.sum(axis=(1, 2)))
    binned = np.zeros((len(bins) + 1, ENDINGS, SUBS), dtype=np.int64)
    np.add.at(binned, np.searchsorted(np.array(bins), 1 << np.arange(LEVELS), "left"), mass)
    shares = Shares(*sums[:4], [(r["top_words"], r["top_counts"]) for r in top], binned.reshape(-1).tolist(), bins, sizes.singles)
    code = partial(_code, shares, parts)
    replies = answers.where("block is not null").select(F.col("block").alias("of"), "part", "counts")
    coded = blocks.drop("learned").groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(lambda left, right: code(left, right), CODED)
    coded = scratch.save(coded, "coded")
    scratch.drop("blocks")
    scratch.drop("answers")
    weights, room = spark.sparkContext.broadcast(train(coded, spark, sizes.buckets, len(shares.mass), total, sizes.singles)), sizes.singles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = split(weights.value)
        for batch in batches:
            for row in batch.to_pylist():
                bounds = np.array(row["bounds"])
                outer = per_document(log_chances(own, row, room), bounds) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.diff(bounds)), pa.array(row["known"], pa.int64()),
                        pa.array(np.full(len(row["doc_ids"]), total)), pa.array(row["base"], pa.float64()), pa.array(outer + np.array(row["inner"])),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

