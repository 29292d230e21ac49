"""Byte-level BPE ids of whole texts in Arrow batches, each distinct word encoded once per batch.

A white-space run after other text always begins a pre-token of the byte-level pattern. A text can therefore
be cut before single blanks, its pieces counted as a dictionary, and only distinct pieces be encoded. Texts
where a run of white space would be cut inside, or with a special token's string, go to the tokenizer whole.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, then a blank: there a cut before the blank would fall inside a run.
CUT_RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
SPECIAL = "<|endoftext|>"


class Encoder:
    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks)) as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes_of = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, rank in table.items():
            self.bytes_of[rank] = len(token)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One uint32 array of ids per text; a null text is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, CUT_RUN), pc.match_substring(texts, SPECIAL)).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        plain = np.flatnonzero(~odd)
        if len(plain):
            for i, ids in zip(plain, self._encode_plain(texts.take(pa.array(plain)) if odd.any() else texts), strict=True):
                out[i] = ids
        return out

    def _encode_plain(self, texts: pa.Array) -> list[np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        words = pieces.flatten().dictionary_encode()
        index = words.indices.to_numpy().astype(np.int64)
        known = words.dictionary.to_pylist()
        first = np.zeros(len(index), dtype=bool)
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        # units: a blank and the word, except where the word begins its text
        heads, head_of = np.unique(index[first], return_inverse=True)
        unit = index.copy()
        unit[first] = len(known) + head_of
        tokens, lengths = self._encode_units([" " + w for w in known])
        alone = [self.words.encode_ordinary(known[i]) for i in heads]
        tokens = np.concatenate([tokens, *(np.array(x, dtype=np.uint32) for x in alone)]) if alone else tokens
        lengths = np.concatenate([lengths, np.array([len(x) for x in alone], dtype=np.int64)])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sizes = lengths[unit]
        until = np.concatenate([[0], np.cumsum(sizes)])
        ids = tokens[np.repeat(starts[unit] - until[:-1], sizes) + np.arange(until[-1])]
        return np.split(ids, until[bounds[1:-1]])

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and the number of ids of each."""
        joined = [i for i, u in enumerate(units) if not u[-1].isspace()]
        found = np.array(self.words.encode_ordinary("".join(units[i] for i in joined)), dtype=np.uint32)
        token_ends = np.cumsum(self.bytes_of[found])
        unit_ends = np.cumsum([len(units[i].encode()) for i in joined])
        ends = np.searchsorted(token_ends, unit_ends) + 1
        lengths = np.zeros(len(units), dtype=np.int64)
        lengths[joined] = np.diff(ends, prepend=0)
        if len(joined) < len(units):  # few: units that end in white space
            at = np.concatenate([[0], np.cumsum(lengths)])
            parts, last = [], 0
            for i in sorted(set(range(len(units))) - set(joined)):
                own = np.array(self.words.encode_ordinary(units[i]), dtype=np.uint32)
                parts += [found[last : at[i]], own]
                last, lengths[i] = at[i], len(own)
            found = np.concatenate([*parts, found[last:]])
        return found, lengths


@lru_cache(maxsize=2)
def encoder(vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> Encoder:
    return Encoder(vocabulary, ranks)


class WordEncoder:
    """Ids of a vocabulary with word ends that drops white space: no id spans two words, so each distinct word is encoded once.

    Words of Latin letters go to tiktoken: its ranks are the merges in their order, a word's end is a zero byte that joins the last
    character first of all. Others go to the tokenizer as one text with a special token between them, which cuts the
    ids again; a word that holds a special token's string goes alone. ``REMEMBERED`` words are kept between batches.
    """

    MARK = "<|startoftext|>"
    REMEMBERED = 500_000
    #: Words whose normal form is the word in lower case: up to U+017F, without zero bytes, white space or special tokens.
    PLAIN = r"^(?:[\x01-;=-\x{84}\x{86}-\x{9f}\x{a1}-\x{17f}]|<[^|])*<?$"
    #: The pre-tokens of such a word, by its letters and numbers; each gets its end.
    PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-\u017f]+|[0-9²³¹¼-¾]|[^a-z0-9²³¹¼-¾ªµºß-öø-\u017f\t-\r ]+")

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        self.whole = Tokenizer.from_file(path)
        self.mark = self.whole.token_to_id(self.MARK)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end, byte_of = model["end_of_word_suffix"], _bytes_by_sign()
        written = lambda token: bytes(byte_of[c] for c in token.removesuffix(end)) + b"\0" * token.endswith(end)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [*byte_of, *(c + end for c in byte_of), *dict.fromkeys(merged)]
        ranks, self.id_of = {}, np.zeros(len(order), dtype=np.uint32)
        for rank, token in enumerate(order):
            ranks.setdefault(written(token), rank)
            self.id_of[rank] = model["vocab"][token]
        self.line = ranks[b"\n"]
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens, self.bounds = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, words: list[str]) -> None:
        is_plain = pc.match_substring_regex(pa.array(words), self.PLAIN).to_pylist()
        plain, rest = list(compress(words, is_plain)), [w for w, yes in zip(words, is_plain, strict=True) if not yes]
        odd, other = [w for w in rest if "<|" in w], [w for w in rest if "<|" not in w]
        ends = self.PRE_TOKEN.sub("\\g<0>\0", "\n".join(plain).lower())
        found = [(self.id_of[x := np.array(self.words.encode_ordinary(ends), dtype=np.int64)], x == self.line)] if plain else []
        if other:
            found.append((x := self._ids(self.MARK.join(other)), x == self.mark))
        found += [(x := self._ids(w), np.zeros(len(x), dtype=bool)) for w in odd]
        self.number.update(zip(plain + other + odd, count(len(self.number)), strict=False))
        lengths = [np.diff(np.flatnonzero(cut), prepend=-1, append=len(x)) - 1 for x, cut in found]
        self.tokens = np.concatenate([self.tokens, *(x[~cut] for x, cut in found)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(lengths))])

    def encode(self, texts: pa.Array, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the closing id at its end, and the number of each text's ids."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) > self.REMEMBERED:
            self._forget()
        if new := [w for w in words if w not in self.number]:
            self._learn(new)
        at = np.array([self.number[w] for w in words], dtype=np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, dtype=np.int64)
        # every text's words, then the closing id as one more word
        ends = np.diff(bounds).cumsum() + np.arange(len(texts))
        unit = np.full(len(at) + len(texts), len(self.number), dtype=np.int64)
        is_word = np.ones(len(unit), dtype=bool)
        is_word[ends] = False
        unit[is_word] = at
        starts, sizes = np.append(self.bounds[:-1], self.bounds[-1]), np.append(np.diff(self.bounds), 1)
        size = sizes[unit]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = np.append(self.tokens, np.uint32(closing))[np.repeat(starts[unit] - until[:-1], size) + np.arange(until[-1])]
        return ids, np.diff(until[np.concatenate([[0], ends + 1])])


def _bytes_by_sign() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: printable bytes stand for themselves, others for signs from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def word_encoder(vocabulary: str = "word_bpe_49k.json") -> WordEncoder:
    return WordEncoder(vocabulary)


def by_size(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of the batch with about ``limit`` bytes of the column each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
