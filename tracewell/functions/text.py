"""Scalar text and hash functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic marks to strip, letters to fold, requirement ids, and what may stand before one that opens a text.
ARABIC_MARKS = "[ً-ْٰـ]"
ARABIC_FROM, ARABIC_TO = "أإآٱىة", "اااايه"
ID_FORM = r"(?:FR|NFR|BR|UR|SR|REQ|US|SYS|DR|FN)[-_ ]?\d+(?:\.\d+)*[a-z]?|UC-[A-Z0-9]+(?:-[A-Z0-9]+)*"
REQUIREMENT_ID = rf"\b({ID_FORM})\b"
REQUIREMENT_HEAD, LIST_HEAD = 160, 40
OPENING_MARKS = r"(?:\*\*|\|\s*|[-*•]\s+|\(?\d{1,3}[.)]\s+)*"
OPENING_LABELS = (
    r"(?:(?i:(?:requirement|req\.?|user\s+story|story|use\s+case|feature)\s*(?:id|no\.?|number|#|code)?|(?:id|no\.?|number|#|code))"
    r"|الرقم التعريفي|رقم المتطلب|رقم حالة الاستخدام|المعرف|الرمز)?"
)
OPENING_ID = rf"^\s*{OPENING_MARKS}{OPENING_LABELS}\s*[:|#.\-–—]?\s*(?:\*\*)?\s*({ID_FORM})\b"
AFTER_OPENING = r"^(?:\s*(?:[:|–—)\-.]|\*\*)|\s+[^\sa-z])"
ARABIC_WORD = "[\u0621-\u064a]{3,}"
VISUAL_ORDER = "^[\u0621-\u064a]+لا$|^اال[\u0621-\u064a]|^امل[\u0621-\u064a]"
VISUAL_ORDER_LIMIT, RTL_SHARE = 0.05, 0.3
CONTENT_WORD = r"[\p{L}]{4,}"
FILLER = """what which when where does this that these those with from have about there their they them then than into your some
 more also only such each based provided sources source following include includes including would should could"""
SUPPORT_WORDS, SUPPORT_SHARE = 3, 0.7
CASE_TYPES = ("functional", "negative")
ABSTAIN = "The BRDs do not specify this."
#: Labels that name a part of a requirement, the words that titles write small, and what ends a sentence.
SUB_LABELS = """acceptance criteria, acceptance criterion, description, details, notes, note, rationale, priority, source, trigger,
 inputs, input, outputs, output, preconditions, pre-conditions, precondition, postconditions, post-conditions, postcondition,
 main flow, basic flow, main success scenario, alternative flow, alternative flows, alternate flow, alternate flows,
 exception flow, exception flows, exceptions, steps, expected result, expected results, fit criterion, validation,
 validations, dependencies, actors, user story, story, business value, comments, معايير القبول, الوصف, ملاحظات, ملاحظة,
 الشروط المسبقة, الشروط اللاحقة, التدفق الرئيسي, التدفق البديل, الاستثناءات, الأولوية, المصدر, الخطوات, النتيجة المتوقعة,
 المدخلات, المخرجات"""
PART_LABELS = """business rules, business rule, rules, validation rules, constraints, error handling, error messages, messages,
 notifications, permissions, fields, data fields, ui notes, قواعد العمل, القيود, الرسائل, الإشعارات, الصلاحيات, الحقول"""
SMALL_WORDS = "a an and as at by for from in into of on or per the to via vs with without"
BOLD_LINE = r"^\*\*(.+?)\*\*:?$"
TITLE_CHARS, TITLE_WORDS, PLAIN_TITLE_WORDS = 90, 10, 6
WORD = r"[\p{L}\p{N}]+"
UNIT_SEPARATOR = "\x1f"


def normalize(text: Column) -> Column:
    """Arabic fold and lower case."""
    return F.lower(F.translate(F.regexp_replace(text, ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO))


def terms(text: Column, least: int = 2) -> Column:
    """Distinct folded words of at least that many characters, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(normalize(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.length(w) >= least))


def all_terms(text: Column, least: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(normalize(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.length(w) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / F.nullif(union, F.lit(0)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, length: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > length, F.concat(F.rtrim(F.substring(flat, 1, length)), F.lit("…"))).otherwise(flat)


def slug(text: Column, length: int = 80, otherwise: str = "brd") -> Column:
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(words, r"^[-_]+|[-_]+$", ""), 1, length), r"^[-_]+|[-_]+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(otherwise)


def _written(found: Column) -> Column:
    """An id as it is kept: blanks and underscores are hyphens; null where nothing was found."""
    return F.when(F.length(found) > 0, F.regexp_replace(found, "[_ ]", "-"))


def requirement_id(text: Column) -> Column:
    """The first requirement id in the head of a text; null if none."""
    return _written(F.regexp_extract(F.substring(text, 1, REQUIREMENT_HEAD), REQUIREMENT_ID, 1))


def opening_id(text: Column) -> Column:
    """The id that a text opens with, so that the text is that requirement; null where it only mentions one or lists several."""
    line = F.substring_index(F.trim(F.regexp_replace(text, r"^\s+", "")), "\n", 1)
    rest = F.substr(line, F.length(F.regexp_extract(line, OPENING_ID, 0)) + 1)
    found = F.regexp_extract(line, OPENING_ID, 1)  # most lines have none, and are asked no more
    goes_on = (F.length(F.trim(rest)) > 0) & ~F.rlike(rest, F.lit(AFTER_OPENING))
    listed = F.rlike(F.substring(rest, 1, LIST_HEAD), F.lit(REQUIREMENT_ID))
    return F.when((F.length(found) > 0) & ~goes_on & ~listed, _written(found))


def heading_id(heading: Column) -> Column:
    """The only id of a heading; null where it names none or several (a group)."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all(heading, F.lit(REQUIREMENT_ID), F.lit(1)), lambda i: F.regexp_replace(i, "[_ ]", "-")))
    return F.when(F.size(ids) == 1, F.coalesce(opening_id(heading), F.get(ids, F.lit(0))))


def text_lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.length(F.trim(x)) > 0)


def looks_table(text: Column) -> Column:
    """Two lines or more, of which at least two and six of ten have a pipe."""

    def most(lines: Column) -> Column:
        return once(F.size(F.filter(lines, lambda x: x.contains("|"))), lambda piped: (F.size(lines) >= 2) & (piped >= 2) & (piped >= F.size(lines) * 0.6))

    return once(text_lines(text), most)


def plain_line(line: Column) -> Column:
    """Trimmed, without the marks of a line that is bold as a whole."""
    return F.trim(F.regexp_replace(F.trim(line), BOLD_LINE, "$1"))


def _among(line: Column, *lists: str) -> Column:
    known = [x.strip() for names in lists for x in names.replace("\n", " ").split(",")]
    return F.lower(F.trim(F.regexp_replace(plain_line(line), ":+$", ""))).isin(known)


def is_sub_label(line: Column) -> Column:
    return _among(line, SUB_LABELS)


def is_part_label(line: Column) -> Column:
    """Whether a label names a part of the requirement it stands in."""
    return _among(line, SUB_LABELS, PART_LABELS)


def title_like(block: Column) -> Column:
    """The title that a block of one short line is, else null: bold, or capitalised in Latin script, or of few other words."""
    line = F.trim(block)
    bold = F.rlike(line, F.lit(BOLD_LINE))
    title = plain_line(line)
    words = F.split(F.trim(F.regexp_replace(title, ":+$", "")), r"\s+")
    latin = F.filter(words, lambda w: F.rlike(w, F.lit("^[A-Za-z]")))
    told = F.filter(latin, lambda w: ~F.lower(w).isin(SMALL_WORDS.split()))
    capital = (F.size(told) > 0) & F.forall(told, lambda w: F.rlike(w, F.lit("^[A-Z]")))
    apt = (
        ~F.rlike(line, F.lit(r"\n|\||^(?:- |\* |> |#)"))
        & F.length(title).between(1, TITLE_CHARS)
        & ~is_sub_label(title)
        & ~F.rlike(title, F.lit("[.;,!?؟؛،۔]$"))
        & (bold | ~title.endswith(":"))
        & (F.size(words) <= TITLE_WORDS)
    )
    shaped = F.when(F.size(latin) * 2 > F.size(words), capital).otherwise(F.size(words) <= PLAIN_TITLE_WORDS)
    return F.when(apt & bold, F.trim(F.regexp_replace(title, ":+$", ""))).when(apt & shaped, title)


def row_id(row: Column, owner: Column) -> Column:
    """A table row's id: that in its first cell, else its owner's, else the only one it mentions."""
    first = _written(F.regexp_extract(F.substring_index(F.regexp_replace(F.trim(row), r"^\|+", ""), "|", 1), REQUIREMENT_ID, 1))
    ids = F.array_distinct(F.transform(F.regexp_extract_all(row, F.lit(REQUIREMENT_ID), F.lit(1)), lambda i: F.regexp_replace(i, "[_ ]", "-")))
    return F.coalesce(first, owner, F.when(F.size(ids) == 1, F.get(ids, F.lit(0))))


def requirement_label(block: Column) -> Column:
    """The first line of a block, up to its first sentence end or to where the story begins; cut at a word after 100 characters."""
    line = collapse(plain_line(F.substring_index(F.trim(block), "\n", 1)))
    short = F.regexp_extract(line, r"^(.*?)(?:\s(?=As an?\s)|(?<=[.!?؟])\s|$)", 1)
    return F.when(F.length(short) <= 100, short).otherwise(F.concat(F.regexp_replace(F.substring(short, 1, 100), r" [^ ]*$", ""), F.lit("…")))


def row_text(text: Column) -> Column:
    """The data row where a text is a table row under its header (two piped lines, and they are the last), else the text."""
    lines = text_lines(text)
    piped = F.transform(lines, lambda x: x.contains("|"))
    two = (F.size(F.filter(piped, lambda x: x)) == 2) & F.coalesce(F.get(piped, F.size(lines) - 1) & F.get(piped, F.size(lines) - 2), F.lit(False))
    return F.when(two, F.element_at(lines, -1)).otherwise(F.coalesce(text, F.lit("")))


def word_set(text: Column) -> Column:
    """Distinct folded words of letters, digits and underscores, of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(normalize(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) >= 2))


def table_pieces(text: Column) -> Column:
    """A table's data rows, each under what stands before the table and its header; the text itself where it has no data row."""
    divides = lambda x: F.rlike(F.trim(F.translate(x, "|:", "")), F.lit("^[- ]+$"))

    def pieces(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.contains("|")), F.lit(True)).cast("int")
        return once(at, lambda at: once(F.filter(F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1))), lambda x: ~divides(x)), lambda data: under(lines, at, data)))

    def under(lines: Column, at: Column, data: Column) -> Column:
        shown = once(F.concat(F.array_join(F.slice(lines, F.lit(1), at), "\n"), F.lit("\n")), lambda prefix: F.transform(data, lambda row: F.concat(prefix, row)))
        return F.when((at > 0) & (F.size(data) > 0), shown)

    return F.coalesce(once(text_lines(text), pieces), F.array(text))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is found once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join_path(*parts: Column) -> Column:
    """Segments of all parts joined by " / ", without empty ones and without one that repeats the one before; null if none."""
    pieces = F.flatten(F.array(*[F.split(F.coalesce(p, F.lit("")), " / ") for p in parts]))
    kept = F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.nullif(F.array_join(F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1))), " / "), F.lit(""))


def paragraph_spaces(text: Column) -> Column:
    """Control characters dropped, runs of blanks as one, none beside line ends, at most one blank line in a row."""
    plain = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), "\r\n?", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), "[ \\t]*\n[ \\t]*", "\n")
    return F.regexp_replace(F.regexp_replace(plain, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cache_key(namespace: str, parts: Column) -> Column:
    """Content hash of a namespace and its inputs as JSON."""
    return F.sha2(F.concat(F.lit(namespace), F.lit("\0"), F.to_json(parts)), 256)


def line_fingerprint(line: Column) -> Column:
    """What lines share that differ in numbers, case and spaces alone."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"\d+", "#"), r"\s+", " ")))


def title_from_filename(name: Column) -> Column:
    """File name without folders and extension, separators as blanks, first letter raised."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\\\]", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    words = F.trim(F.regexp_replace(stem, r"[-_\s]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def grounded(answer: Column, sources: Column) -> Column:
    """Whether an answer abstains, or cites a source that there is."""
    plain = F.trim(answer)
    return (F.length(plain) == 0) | plain.contains(ABSTAIN) | (F.size(citations(plain, sources)) > 0)


def citations(text: Column, sources: Column) -> Column:
    """Distinct source numbers [n] within 1 and the number of sources, ascending."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= sources))))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


def embed_input(title: Column, path: Column, text: Column) -> Column:
    return F.concat(F.concat_ws(" › ", title, path), F.lit("\n\n"), text)


def embed_hash(model: str, embedded: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), embedded), 256)


def definition_hash(*fields: Column) -> Column:
    return F.md5(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(f, F.lit("")) for f in fields]))


def visual_order_ratio(text: Column) -> Column:
    """Share of Arabic words that show a reversed article or a swapped lam-alef: the sign of extraction in visual order."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ARABIC_WORD})"), F.lit(1))
    return F.coalesce(F.size(F.filter(words, lambda w: F.rlike(w, F.lit(VISUAL_ORDER)))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def content_words(text: Column) -> Column:
    """Distinct lower-case words of four letters or more that carry content."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CONTENT_WORD})"), F.lit(1)), lambda w: F.lower(w))
    return F.array_except(words, F.array(*map(F.lit, FILLER.split())))


def rerank_text(path: Column, text: Column) -> Column:
    """A passage under its path, unless it begins with the path's last label (its first 40 characters) already."""
    label = F.substring(F.element_at(F.split(path, " / "), -1), 1, 40)
    return F.when((F.length(path) > 0) & ~F.startswith(F.regexp_replace(text, r"^\s+", ""), label), F.concat_ws("\n", path, text)).otherwise(text)


def conserved(whole: Column, pieces: Column) -> Column:
    """Whether pieces hold all of a text and nothing else, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return bare(whole) == bare(F.array_join(pieces, ""))


def clean_filename(name: Column, length: int = 120) -> Column:
    """File name without folders, control and reserved characters, and outer blanks or dots; "file" where nothing is left."""
    base = F.regexp_replace(name, r"^.*[/\\\\]", "")
    plain = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f<>:\"|?*]", ""), r"^[\s.]+|[\s.]+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, length), F.lit("")), F.lit("file"))


def clean_mime(mime: Column) -> Column:
    """Media type in lower case without parameters; octet-stream where it is none."""
    plain = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return F.when(F.rlike(plain, F.lit(r"^[a-z0-9.+-]+/[a-z0-9.+-]+$")), plain).otherwise("application/octet-stream")


def valid_link(link: Column) -> Column:
    return F.coalesce(F.rlike(F.trim(link), F.lit(r"^(?i)https?://[^\s/?#]+[^\s]*$")), F.lit(False))
