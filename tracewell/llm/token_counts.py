"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A pre-token is a run of blanks with the text up to the next blank; no piece of the vocabulary holds a blank after
another character, so the best segmentation of a text is that of its pre-tokens. The distinct pre-tokens of a
block of texts are put in order, which walks their trie depth first: the forward scores of a prefix are computed
once and stay while words share it, and the count at a word's end is stored for all its occurrences.

A piece's score is the one in the vocabulary file. The best total wins, of equal ones the fewer pieces. A
character in no piece counts one token per UTF-8 byte, at ``UNKNOWN`` below the lowest score.

Texts are counted where they are read; a block's trie is dropped with the block, terminal counts of
at most ``KNOWN`` words stay for the next ones, so memory is bounded (by ``BLOCK`` bytes of text, or one row) and
nothing is shuffled.

Defined results: null and empty texts have no tokens; equal rows give equal rows; an empty table gives an
empty table; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tokenizing import by_size

BLOCK = 16 << 20
KNOWN = 500_000
UNKNOWN = 10.0
PRE_TOKEN = re.compile(r" *[^ ]+| +")
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, score double"


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores = {piece.replace("▁", " "): score for piece, score in scores.items()}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        self.known: dict[str, tuple[int, float]] = {}
        # every end of a piece: its score, or None where that end is no piece; what is absent ends none
        self.ends: dict[str, float | None] = {piece[k:]: None for piece in self.scores for k in range(1, len(piece))} | self.scores

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and score of each distinct word; up to KNOWN words of earlier blocks are remembered."""
        fresh = [w for w in words if w not in self.known]
        found = dict(zip(fresh, zip(*(x.tolist() for x in self._walk(fresh)), strict=True), strict=True))
        every = [found[w] if w in found else self.known[w] for w in words]
        self.known.update(islice(found.items(), max(0, KNOWN - len(self.known))))
        return np.array([n for n, _ in every], dtype=np.int64), np.array([s for _, s in every], dtype=float)

    def _walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        scores, ends, unknown = self.scores, self.ends, self.unknown
        tokens, totals = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        best, used, last = [0.0], [0], ""
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                if char in scores:
                    top, n = best[end - 1] + scores[char], used[end - 1] + 1
                else:
                    top, n = best[end - 1] + unknown, used[end - 1] + len(char.encode())
                for start in range(end - 2, -1, -1):
                    score = ends.get(word[start:end], unknown)
                    if score is None:
                        continue
                    if score == unknown:
                        break
                    total = best[start] + score
                    if total > top or (total == top and used[start] + 1 < n):
                        top, n = total, used[start] + 1
                best.append(top)
                used.append(n)
            tokens[at], totals[at], last = used[-1], best[-1], word
        return tokens, totals


@lru_cache(maxsize=2)
def unigram(vocabulary: str = "piece_bpe_32k.model") -> Unigram:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return Unigram({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)})


def count_block(texts: pa.Array, model: Unigram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, tokens and score of each text."""
    texts = pc.fill_null(texts, "")
    pieces = pc.split_pattern(texts, " ")
    bounds = pieces.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    flat = pieces.flatten()
    # runs of blanks show as empty pieces; these texts are cut by the pattern itself
    empty = np.concatenate([[0], np.cumsum(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))])
    odd = np.flatnonzero(empty[bounds[1:]] > empty[bounds[:-1]])
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    words = [" " + w for w in coded.dictionary.to_pylist()]
    place = {w: i for i, w in enumerate(words)}
    cut = {}
    for i in odd:
        text = texts[int(i)].as_py()
        cut[i] = [place.setdefault(w, len(place)) for w in PRE_TOKEN.findall(" " + text)] if text else []
    words += list(place)[len(words) :]
    tokens, scores = model.count(words)
    sums = [np.concatenate([[0], np.cumsum(x[index])]) for x in (np.ones(len(words), dtype=np.int64), tokens, scores)]
    found = [s[bounds[1:]] - s[bounds[:-1]] for s in sums]
    for i, own in cut.items():
        for k, x in enumerate((None, tokens, scores)):
            found[k][i] = len(own) if x is None else x[own].sum()
    return tuple(found)


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and the score of the best segmentation of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(vocabulary)
        for batch in batches:
            for block in by_size(batch, "text", BLOCK):
                columns = [block.column("doc_id"), *(pa.array(x) for x in count_block(block.column("text"), model))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, SCHEMA)
