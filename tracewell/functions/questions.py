"""Unicode forms of texts, predicates on questions and rewrites, and edits of a span of a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.functions import text as T

#: Characters that extraction drops, what a question may end in, greetings, words that point back, leaked reasoning.
DROPPED = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​‎‏﻿]"
SPACES = r"(?U)[\s\x1c-\x1f]+"
QUESTION_END = r"(?U)[\s?!.,;:؟،؛]+$"
GREETING = r"(?iU)^\s*(?:hi|hello|hey|yo|thanks|thank you|good (?:morning|evening|afternoon)|مرحبا|أهلا|اهلا|السلام عليكم|شكرا|شكراً)\b"
GREETING_CHARS = 40
POINTS_BACK = r"(?iU)\b(?:this|that|these|those|it|its)\b|هذه|هذا|هؤلاء|تلك|ذلك|الحالة"
LEAK = (
    r"(?i)^(?:okay|ok|alright|so)?[,.\s]*(?:we need to|let me|i need to|i will|i'll|thinking process|first,|to rewrite|here is|here's"
    r"|rewritten query|the user (?:is asking|asks|asked|wants|wanted|would like|is requesting|requests))"
)
VERDICT_LINE = (
    r"^(?i:\W*(?:(?:(?:user|response|agent|assistant|prompt)\s+)?safety\s*:\s*(?:safe|unsafe)"
    r"|S\d+(?:\s*,\s*S\d+)*|(?:safety\s+)?categor(?:y|ies)\s*:.*)\W*)$|^(?:safe|unsafe)$"
)
VERDICT_LINES = 4
ARABIC = "[؀-ۿ]"
REWRITE_CHARS, REWRITE_TIMES = 400, 3


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _compatible_folded(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC").str.casefold()


def extracted_text(text: Column) -> Column:
    """Compatibility form without control and zero-width characters, runs of blanks and tabs as one blank; null is empty."""
    return F.regexp_replace(F.regexp_replace(_compatible(F.coalesce(text, F.lit(""))), DROPPED, ""), "[ \t]+", " ")


def question_key(text: Column) -> Column:
    """Equal for questions that differ in case, white space, compatible characters and closing marks alone; null is empty."""
    flat = F.trim(F.regexp_replace(_compatible_folded(F.coalesce(text, F.lit(""))), SPACES, " "))
    return F.regexp_replace(flat, QUESTION_END, "")


def is_smalltalk(question: Column) -> Column:
    """Whether a short question opens with a greeting or thanks."""
    flat = T.collapse(question)
    return F.rlike(flat, F.lit(GREETING)) & (F.length(flat) <= GREETING_CHARS)


def points_back(question: Column) -> Column:
    """Whether a question has a word that only what was said before explains."""
    return F.rlike(question, F.lit(POINTS_BACK))


def is_verdict(text: Column) -> Column:
    """Whether a text is only a safety classifier's verdict: one to four lines, each in one of its forms."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda line: F.trim(line)), lambda line: line != "")
    return F.size(lines).between(1, VERDICT_LINES) & F.forall(lines, lambda line: F.rlike(line, F.lit(VERDICT_LINE)))


def is_usable_rewrite(rewrite: Column, question: Column, context: Column) -> Column:
    """Whether a rewrite can stand for its question in a search: neither empty nor a verdict, leaked reasoning or an essay, and
    it shares a content word with the question or its context, unless it is in another script. Null is empty.
    """
    out = F.trim(F.coalesce(rewrite, F.lit("")))
    asked = F.coalesce(question, F.lit(""))
    words = F.transform(F.regexp_extract_all(out, F.lit(f"({T.CONTENT_WORD})"), F.lit(1)), lambda w: F.lower(w))
    known = T.content_words(F.concat_ws(" ", asked, context))
    other_script = F.rlike(out, F.lit(ARABIC)) != F.rlike(asked, F.lit(ARABIC))
    fits = F.length(out) <= F.greatest(F.lit(REWRITE_CHARS), F.length(asked) * REWRITE_TIMES)
    return (out != "") & ~is_verdict(out) & ~F.rlike(out, F.lit(LEAK)) & fits & (other_script | F.arrays_overlap(words, known))


def find_span(text: Column, find: Column) -> Column:
    """The part of a text that is the given one, as it stands or but for white space between its words; null where none is."""
    quoted = F.transform(F.split(T.collapse(find), " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    loose = F.regexp_substr(text, F.array_join(quoted, r"\s*"))
    return F.when(T.collapse(find) != "", F.when(F.contains(text, find), find).otherwise(loose)).when((find != "") & F.contains(text, find), find)


def edited(text: Column, find: Column, by: Column) -> Column:
    """The text with the first such span replaced; null where there is none, nothing to put there, or no change but at the ends."""
    span = find_span(text, find)
    at = F.instr(text, span)
    new = F.concat(F.substring(text, F.lit(1), at - 1), by, F.substr(text, at + F.length(span)))
    return F.when((at > 0) & (by != "") & (F.trim(new) != F.trim(text)), new)
