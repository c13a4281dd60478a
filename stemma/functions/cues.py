"""What short texts on a page say: type codes, badges, headings, figures, tables and leading numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, squeeze, strip_leading_number

#: A type's mark, its heading with a title, and words that speak of figures and tables (looked for where their first letters are).
TYPE_MARK = r"유형\s*0?(\d{1,2})"
TYPE_TITLE = r"유형\s*(\d{1,2})(?:\s*([가-힣]{2,16}))?"
FIGURE_WORDS = r"(?=[가-힣fFdD])(?i:그림|도형|그래프|figure|diagram)"
TABLE_WORDS = r"(?=[가-힣tT])(?i:다음 표|표\s*\d|table)"
#: Words that ask for something, lines of a book's packaging, a page's reference to a type, a choice alone on its line, and subjects.
ASKING = r"구하시오|하시오|고르시오|나타내시오|풀이하시오|푸시오|전개하시오|인수분해하시오|계산하시오|답하시오|말하시오|정리하시오|구하여라"
PACKAGING_LINE = r"^(?:#\s*)?(?:유형\s*\d+|개념\s*\d+(?:\s*-\s*\d+)?|정답 및 풀이\s*\d+쪽|대표 문제|보기)\s*\z"
TYPE_REFERENCE = r"^\d+쪽\s*유형\s*\d+"
CHOICE_LINE = r"^(?:[①-⑳]|\d+)\s*\z"
SUBJECTS = r"방정식|부등식|복소수|다항식|행렬|순열"
EXAMPLE = "대표 문제"
#: The most letters of an example's caption, of a reference to a type (one less) and of an atom.
CAPTION_LETTERS, REFERENCE_LETTERS, ATOM_LETTERS = 24, 39, 16
#: Fixed value: the greatest code of a type.
LAST_TYPE = 26


def _code(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def type_markers(text: Column) -> Column:
    """Codes of all type marks in a text, in order, with two digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(TYPE_MARK), F.lit(1)), _code)


def badge_code(text: Column) -> Column:
    """The code on a badge: its one number from 1 to 26, else two digits at its end that are such a number, else null."""
    fits = lambda n: n.between(1, LAST_TYPE)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,2})"), F.lit(1)), lambda n: n.cast("int"))
    last = F.nullif(F.regexp_extract(text, r"(\d{2})\s*\z", 1), F.lit("")).cast("int")
    return bound(F.filter(numbers, fits), lambda found: F.when(F.size(found) == 1, _code(F.get(found, F.lit(0)))).when(fits(last), _code(last)))


def type_heading(text: Column) -> Column:
    """The first type mark as a heading: its number as printed and the title behind it, if there is one; null without a mark."""
    at = lambda k: F.regexp_extract(squeeze(text), TYPE_TITLE, k)
    return F.when(at(1) != "", F.rtrim(F.concat_ws(" ", F.lit("유형"), at(1), at(2))))


def shows_figure(text: Column) -> Column:
    return text.rlike(FIGURE_WORDS)


def shows_table(text: Column) -> Column:
    return text.rlike(TABLE_WORDS)


def leading_index(text: Column) -> Column:
    """The number that a text begins with, white space apart: one to three digits and no more, not 01 to 09, at least 1; else null."""
    digits = F.regexp_extract(F.regexp_replace(text, r"\s+", ""), r"^\d+", 0)
    return F.when(F.length(digits).between(1, 3) & ~digits.rlike(r"^0\d\z") & (digits.cast("int") >= 1), digits)


def _body(text: Column, number: str) -> Column:
    """The text without its number in front, where it has one of that form, and white space around it."""
    own = F.regexp_extract(text, number, 0)
    return F.regexp_replace(F.when(own == "", text).otherwise(strip_leading_number(text, own)), r"^\s+|\s+\z", "")


def packaging_only(text: Column) -> Column:
    """Whether what leaked behind an item is a book's packaging: nothing but its number, captions, references to types, or a choice above a subject. Null for null."""

    def judge(body: Column) -> Column:
        lines = F.filter(F.transform(F.split(body, "\n"), lambda t: F.regexp_replace(t, r"^\s+|\s+\z", "")), lambda t: t != "")
        packs = lambda t: t.rlike(PACKAGING_LINE) | t.rlike(TYPE_REFERENCE) | F.contains(t, F.lit(EXAMPLE))
        caption = (F.length(body) <= CAPTION_LETTERS) & F.contains(body, F.lit(EXAMPLE)) & ~body.rlike(ASKING)
        reference = (F.length(body) <= REFERENCE_LETTERS) & body.rlike(TYPE_REFERENCE)
        choice = (F.size(lines) == 2) & F.coalesce(F.get(lines, F.lit(0)).rlike(CHOICE_LINE) & F.get(lines, F.lit(1)).rlike(SUBJECTS), F.lit(False))
        return (body == "") | caption | reference | body.rlike(PACKAGING_LINE) | ((F.size(lines) <= 2) & F.forall(lines, packs)) | choice

    return F.when(text.isNotNull(), bound(_body(text, r"\d{3,4}"), judge))


def short_atom(text: Column) -> Column:
    """Whether an item is a short expression that asks for nothing: 1 to 16 letters without number, TeX commands, signs of grouping and white space. False for null."""

    def judge(body: Column) -> Column:
        letters = F.length(F.regexp_replace(body, r"\$+|\\[a-zA-Z]+|[{}]|\s+", ""))
        return letters.between(1, ATOM_LETTERS) & ~body.rlike(ASKING + "|다음 중|" + EXAMPLE)

    return F.coalesce(bound(_body(text, r"^\d{3,4}"), judge), F.lit(False))


#: Fixed value: what titles, file names and kinds of sources that are only for tests hold.
FIXTURE_WORDS = r"(?i)STEP\s*\d|fixture|regression|Internal STEP|Production UI Test|do not use"


def fixture_source(title: Column, filename: Column, kind: Column) -> Column:
    """Whether a source is one for tests, by its title, file name and kind together; nulls are empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(part(title), F.lit(" "), part(filename), F.lit(" "), part(kind)).rlike(FIXTURE_WORDS)
