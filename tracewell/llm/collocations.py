"""Phrase collocations per language: candidates from sketch upper bounds, counted by delimiter-guarded automata.

A text is lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line breaks, and a piece into words at blanks and
tabs. Equal pieces of a block are one piece with a weight. Three passes, each over all texts:

1. Every block of texts counts the hashes of its phrases of 1 to ``longest`` words in a sketch of ``2^k`` counters. The
   sketch is dealt by hash into ``SLICES`` slices; a slice adds up what the blocks send and keeps one bit per counter:
   whether its sum, an upper bound of every phrase in it, reaches the least count. The sketch grows with the bytes of text
   up to ``MOST_BITS``; that is a bound of its broadcast (128 MB), not of results: a fuller sketch lets more phrases pass.
2. A block takes as candidates those of its phrases whose own bound and those of all their parts reach the least count,
   compiles them into Aho-Corasick automata (at most ``AUTOMATON`` phrases each; " a b " with a blank at both ends, so that
   a match holds whole words), scans its pieces, counts all overlapping matches, and sends count per phrase. Single
   words, the parts of phrases, are counted from the block's dictionary, behind the same bound.
3. Counts are summed over blocks, and only then the least count applies, exactly. Cuts, scores and drops are joins of that
   table with itself; products are decimals of 38 digits and the division is that of whole numbers.

The best phrases of a language come from a tree of sorted groups, so no language is sorted in one task.

Defined results: a null text is empty, a null language is ``und`` (rows that say ``und`` are the same language); equal rows count
each; ties go by count, then by the phrase's bytes, so they are never open; a word may be as long as a text; an empty table
or one without candidates gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm.joins import within_bound
from tracewell.llm.neardup import GOLDEN, mix
from tracewell.llm.tokenizing import by_size

LEAST = 10
LONGEST = 3
OVERLAP = 50
TOP = 2000
BREAKS = r"[.,;:!?\n-\r]"
SKETCH_BLOCK = 8 << 20
SCAN_BLOCK = 4 << 20
AUTOMATON = 200_000  # phrases of one automaton
LEAST_BITS, MOST_BITS = 20, 30
BYTES_PER_COUNTER = 4
SLICES = 64
FANS = (256, 16)  # groups per language on the way to its best phrases
LANGUAGES = 100_000  # rows up to which a table of one row per language is broadcast
UNKNOWN = "und"
U = np.uint64
SENT = "slice int, counters binary, counts binary"
COUNTED = "lang string, words int, phrase string, f long"


class Pieces:
    """The distinct pieces of the texts of one language in a block: word numbers, bounds and weights."""

    def __init__(self, texts: pa.Array, lang: str):
        pieces = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS).flatten().value_counts()
        self.lang, weights = lang, pieces.field("counts").to_numpy()
        lists = pc.ascii_split_whitespace(pieces.field("values"))  # of ASCII's white space only blanks and tabs are left
        bounds = lists.offsets.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(weights)), np.diff(bounds))
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary
        index = coded.indices.to_numpy().astype(np.int64)
        keep = pc.not_equal(self.words, "").to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, dtype=bool)
        self.index, self.owner = index[keep], owner[keep]
        self.weights = weights.astype(np.int64)

    def starts(self, longest: int) -> list[np.ndarray]:
        """Where phrases of 1, 2, ... words begin: they end in the piece in which they begin."""
        found = [np.arange(len(self.index))]
        for n in range(1, longest):
            at = found[-1][found[-1] < len(self.index) - n]
            found.append(at[self.owner[at + n] == self.owner[at]])
        return found

    def hashes(self, starts: list[np.ndarray]) -> list[np.ndarray]:
        """Hashes of the phrases that begin there, of the language and the words."""
        words = np.asarray(self.words.to_pylist(), dtype=object)
        word = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, dtype=U)
        seed = pd.util.hash_array(np.array([self.lang], dtype=object), categorize=False)
        with np.errstate(over="ignore"):
            single = mix(word + seed * GOLDEN)[self.index]
            whole, found = single, [single]
            for n, at in enumerate(starts[1:], 1):
                longer = np.zeros(len(single), dtype=U)
                longer[at] = mix(whole[at] * GOLDEN + single[at + n])
                whole = longer
                found.append(longer[at])
        return found


def _by_language(batch: pa.RecordBatch) -> Iterator[Pieces]:
    """Pieces of each language of a block."""
    coded = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
    order = coded.indices.to_numpy()
    texts = pc.fill_null(batch.column("text"), "")
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield Pieces(texts.take(pa.array(np.flatnonzero(order == k))) if len(coded.dictionary) > 1 else texts, lang)


def sketch(docs: DataFrame, scratch: Scratch, bits: int, longest: int = LONGEST, least: int = LEAST) -> np.ndarray:
    """One bit per counter, eight to a byte: whether the phrases of this counter can occur ``least`` times."""
    height = (1 << bits) // SLICES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for block in by_size(whole, "text", SKETCH_BLOCK):
                found = []
                for pieces in _by_language(block):
                    starts = pieces.starts(longest)
                    for at, h in zip(starts, pieces.hashes(starts), strict=True):
                        # a count beyond the least one decides as well as the least one
                        found.append(np.repeat((h >> U(64 - bits)).astype(np.uint32), np.minimum(pieces.weights[pieces.owner[at]], least)))
                every = np.sort(np.concatenate(found))
                last = np.flatnonzero(np.append(every[1:] != every[:-1], np.ones(min(1, len(every)), dtype=bool)))
                counters, counts = every[last], np.minimum(np.diff(last, prepend=-1), least).astype(np.uint32)
                cuts = np.searchsorted(counters, np.arange(SLICES + 1, dtype=np.int64) * height)
                rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                gaps = [np.diff(counters[a:b], prepend=np.uint32(k * height)) for k, a, b in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in rows], pa.int32()), pa.array([_packed(x) for x in gaps], pa.binary()),
                        pa.array([_packed(counts[a:b]) for _, a, b in rows], pa.binary()),
                    ],
                    names=["slice", "counters", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()])], names=["slice", "enough"])

        for batch in batches:
            for k, counters, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "counters", "counts")), strict=True):
                if k != now:
                    yield from finish()
                    now, sums = k, np.zeros(height, dtype=np.uint32)
                sums[np.cumsum(_unpacked(counters))] += _unpacked(counts)  # the counters of a row are distinct
        yield from finish()

    sent = docs.select("lang", "text").mapInArrow(send, SENT)
    bounds = scratch.save(sent.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, enough binary"), "sketch")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in bounds.toLocalIterator():  # a slice at a time
        out[row["slice"] * height // 8 : (row["slice"] + 1) * height // 8] = np.frombuffer(row["enough"], dtype=np.uint8)
    scratch.drop("sketch")
    return out


def _packed(x: np.ndarray) -> bytes:
    """Mostly small numbers: their bytes by significance, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) + len(x).to_bytes(8, "little")


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[-8:], "little")
    raw = np.frombuffer(pa.decompress(data[:-8], decompressed_size=4 * size, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, size).T).reshape(-1).view("<u4")


def candidates(pieces: Pieces, enough: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, list[list[str]]]:
    """Numbers of the words, and the phrases of 2, 3, ... words, whose bounds and whose parts' bounds suffice."""
    starts = pieces.starts(longest)
    bits = U((len(enough) * 8).bit_length() - 1)
    passing = []
    for h in pieces.hashes(starts):
        counter = (h >> (U(64) - bits)).astype(np.int64)
        passing.append((enough[counter >> 3] >> (7 - (counter & 7)).astype(np.uint8)) & 1 > 0)
    words = pieces.words.to_pylist()
    width = max(1, len(words))
    whole, good, found = pieces.index, passing[0], []
    for n, at in enumerate(starts[1:], 1):
        # a number per distinct phrase of n words, then with the next word: no hash decides what is one phrase
        here = np.zeros(len(pieces.index), dtype=bool)
        here[at] = passing[n]
        here[at] &= good[at] & good[at + 1]
        spots = np.flatnonzero(here)
        keys, first, number = np.unique(whole[spots] * width + pieces.index[spots + n], return_index=True, return_inverse=True)
        whole = np.zeros(len(pieces.index), dtype=np.int64)
        whole[spots] = number
        good = here
        found.append([" ".join([words[pieces.index[k + i]] for i in range(n + 1)]) for k in spots[first].tolist()])
    return np.flatnonzero(np.bincount(pieces.index[passing[0]], minlength=len(words))), found


def scan(pieces: Pieces, phrases: list[str], most: int = AUTOMATON) -> np.ndarray:
    """How often each phrase occurs in the pieces, overlapping matches included."""
    counts = np.zeros(len(phrases), dtype=np.int64)
    used = np.unique(pieces.owner)
    words = pieces.words.take(pa.array(pieces.index))
    bounds = np.searchsorted(pieces.owner, np.append(used, len(pieces.weights)))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")
    of = pieces.weights[used]
    # pieces of like weight are one string; a line break keeps a match within its piece
    strings = [(int(w), " " + " \n ".join(lines.filter(pa.array(of == w)).to_pylist()) + " ") for w in np.unique(of)]
    for a in range(0, len(phrases), most):
        mine = phrases[a : a + most]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(mine):
            automaton.add_word(f" {phrase} ", k)
        automaton.make_automaton()
        for weight, string in strings:
            hits = np.fromiter(map(itemgetter(1), automaton.iter(string)), dtype=np.int32)
            counts[a : a + most] += weight * np.bincount(hits, minlength=len(mine))
    return counts


def shard_counts(docs: DataFrame, enough, longest: int = LONGEST) -> DataFrame:
    """Per block: all words of a language (words 0), its single words and its candidate phrases with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for block in by_size(whole, "text", SCAN_BLOCK):
                for pieces in _by_language(block):
                    if not len(pieces.index):
                        continue
                    singles, found = candidates(pieces, enough.value, longest)
                    weights = pieces.weights[pieces.owner]
                    of_word = np.bincount(pieces.index, weights=weights, minlength=len(pieces.words)).astype(np.int64)
                    phrases = [p for group in found for p in group]
                    sizes = np.concatenate([[0], np.ones(len(singles), dtype=int), *(np.full(len(g), n) for n, g in enumerate(found, 2))])
                    texts = pa.concat_arrays([pa.array([None], pa.string()), pieces.words.take(pa.array(singles)).cast(pa.string()), pa.array(phrases, pa.string())])
                    f = np.concatenate([[weights.sum()], of_word[singles], scan(pieces, phrases)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pieces.lang] * len(f), pa.string()), pa.array(sizes, pa.int32()), texts, pa.array(f, pa.int64())], names=["lang", "words", "phrase", "f"]
                    )

    return docs.select("lang", "text").mapInArrow(count, COUNTED)


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """Exact counts of all phrases of 1 to ``longest`` words that occur ``least`` times, and of all words (words 0) of a language."""
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // BYTES_PER_COUNTER).bit_length()))
    enough = scratch.spark.sparkContext.broadcast(sketch(docs, scratch, bits, longest, least))
    summed = shard_counts(docs, enough, longest).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return scratch.save(summed.where((F.col("words") == 0) | (F.col("f") >= least)), "counts")


def collocations(
    docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, overlap: int = OVERLAP, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language of docs (lang, text)."""
    counts = phrase_counts(docs, scratch, least, longest)
    known = counts.where("words > 0").select("lang", "phrase", "f")
    chosen = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("each"))

    # cuts: the first k words and the rest, both of which are in the table, as no part is rarer than its phrase
    cuts = chosen.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("each", F.lit(1), F.col("k")), " ").alias("head"), F.expr("array_join(slice(each, k + 1, words - k), ' ')").alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0))) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")

    # shorter candidates that lie in a longer one nearly as frequent
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(each, i, m), ' '))))")
    covers = chosen.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("cover"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(f"cover is null or 100 * cast(cover as decimal(20,0)) < {overlap} * cast(a as decimal(20,0))").drop("cover")

    # the best of each group, then of fewer groups, then of the language
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("_group", F.xxhash64("phrase"))
    for fan in FANS:
        within = Window.partitionBy("lang", "_group").orderBy(*order)
        kept = kept.withColumn("_group", F.pmod("_group", F.lit(fan))).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = within_bound(counts.where("words = 0").select("lang", F.col("f").alias("n")), LANGUAGES)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with docs as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
cut as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from docs),
pieces as (select lang, piece, count(*) as m from cut group by all),
listed as (select lang, m, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, m, 1 as words, unnest(w) as phrase from listed
  union all select lang, m, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from listed
  union all select lang, m, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from listed
),
counts as (select lang, words, phrase, sum(m)::bigint as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from counts where words = 1 group by lang),
chosen as (select lang, words, phrase, f as a, string_split(phrase, ' ') as w from counts where words > 1 and f >= 10),
cuts as (
  select lang, phrase, a, 1 as k, w[1] as head, array_to_string(w[2:], ' ') as tail from chosen
  union all select lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] from chosen where words = 3
),
scored as (
  select c.lang, c.phrase, c.a, c.k, h.f as l, t.f as r, ((1000000::hugeint * c.a * c.a) // (h.f::hugeint * t.f))::bigint as score
  from cuts c join counts h on h.lang = c.lang and h.phrase = c.head join counts t on t.lang = c.lang and t.phrase = c.tail
),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covers as (
  select lang, phrase, max(a) as cover from (
    select lang, w[1] || ' ' || w[2] as phrase, a from chosen where words = 3
    union all select lang, w[2] || ' ' || w[3], a from chosen where words = 3
  ) group by all
),
kept as (
  select b.* from best b left join covers v on v.lang = b.lang and v.phrase = b.phrase
  where v.cover is null or 100::hugeint * v.cover < 50::hugeint * b.a
),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::int as rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
