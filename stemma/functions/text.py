"""Text as columns: normal forms, keys, parsers and checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def bare(text: Column) -> Column:
    """The text without white space; most of it is blanks, which need no pattern."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"\s+", "")


def char_count(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, r"\s+", ""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_number(raw: Column) -> Column:
    """A problem number of one to four digits, padded to four; spaces and one closing full stop are let go, all else is null."""
    plain = F.regexp_replace(F.regexp_replace(raw, r"\s+", ""), r"\.$", "")
    return F.when(plain.rlike(r"^[0-9]{1,4}$"), F.lpad(plain, 4, "0"))


def public_code(n: Column, prefix: str = "QB-") -> Column:
    """prefix and at least six digits."""
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0")))


def checked_sha256(raw: Column) -> Column:
    """A SHA-256 in lower case; an error for anything else that is not null."""
    plain = F.lower(F.trim(raw))
    return F.when(plain.rlike("^[0-9a-f]{64}$") | plain.isNull(), plain).otherwise(F.raise_error(F.concat(F.lit("not a SHA-256: "), raw)).cast("string"))


def normal_text(text: Column) -> Column:
    """The form that problem texts are compared in: no image marks, single dollar signs, spaces and line ends squeezed."""
    no_images = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " ")
    single = F.replace(no_images, F.lit("$$"), F.lit("$"))
    spaces = F.regexp_replace(single, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(spaces, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def duplicate_key(text: Column) -> Column:
    """The looser form of duplicate search: small letters and digits only, of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def traced_rules(text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Apply (name, pattern, replacement) in order: struct(text, fired), the result and the names of the rules whose pattern was there.

    Each step is worked out once from the one before.
    """
    def step(name: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.regexp_replace(s["text"], pattern, replacement).alias("text"), F.when(s["text"].rlike(pattern), F.array_append(s["fired"], F.lit(name))).otherwise(s["fired"]).alias("fired"))

    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("fired"))
    for rule in rules:
        state = bound(state, step(*rule))
    return state


def first_rule(text: Column, rules: Sequence[tuple], default: Column | None = None) -> Column:
    """The first rule (pattern, id, confidence, name) whose pattern is in the text, as struct(id, confidence, rule)."""
    pack = lambda i, c, n: F.struct(F.lit(i).cast("string").alias("id"), F.lit(float(c)).alias("confidence"), F.lit(n).alias("rule"))
    out = None
    for pattern, key, confidence, name in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, pack(key, confidence, name)) if out is None else out.when(hit, pack(key, confidence, name))
    rest = default if default is not None else pack(None, 0.28, "UNCLEAR")
    return out.otherwise(rest) if out is not None else rest


def tags(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order; unknown ones do not."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def structure_key(unit: Column, type_id: Column, choices: Column, figure: Column, table: Column, level: Column) -> Column:
    """What two variants of one problem share."""
    return F.concat_ws(
        "|",
        F.coalesce(F.nullif(unit, F.lit("")), F.lit("미정")),
        F.coalesce(F.nullif(type_id, F.lit("")), F.lit("TYPE_UNCLEAR")),
        F.when(choices >= 5, "MC5").when(choices > 0, F.concat(F.lit("C"), choices.cast("string"))).otherwise("CR"),
        F.when(figure, "FIG").otherwise("NOFIG"),
        F.when(table, "TAB").otherwise("NOTAB"),
        F.when(level.isNull(), "D?").otherwise(F.concat(F.lit("D"), level.cast("string"))),
    )


def ranges(text: Column, most: int = 2000, span: int | None = None) -> Column:
    """[a~b] marks with 1 <= a <= b <= most (and b - a <= span) as array of struct(a, b)."""
    number = lambda k: F.regexp_extract_all(text, F.lit(r"\[\s*(\d{1,4})\s*~\s*(\d{1,4})\s*\]"), F.lit(k))
    pairs = F.transform(F.arrays_zip(number(1).alias("a"), number(2).alias("b")), lambda p: F.struct(p["a"].cast("long").alias("a"), p["b"].cast("long").alias("b")))
    return F.filter(pairs, lambda p: (p["a"] >= 1) & (p["a"] <= p["b"]) & (p["b"] <= most) & (F.lit(True) if span is None else p["b"] - p["a"] <= span))


def balance(text: Column) -> Column:
    """Checks of TeX source: struct(begins, ends, dollars, low, depth, ok); low and depth are the least and last brace depth."""
    signs = F.regexp_extract_all(text, F.lit(r"([{}])"), F.lit(1))
    fold = F.aggregate(signs, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, s: F.struct((a["d"] + F.when(s == "{", 1).otherwise(-1)).alias("d"), F.least(a["low"], a["d"] + F.when(s == "{", 1).otherwise(-1)).alias("low")))
    begins, ends, dollars = (F.regexp_count(text, F.lit(p)).cast("long") for p in (r"\\begin\{", r"\\end\{", r"\$"))
    low, depth = fold["low"].cast("long"), fold["d"].cast("long")
    ok = (begins == ends) & (dollars % 2 == 0) & (low >= -2) & (depth < 3)
    return F.struct(begins.alias("begins"), ends.alias("ends"), dollars.alias("dollars"), low.alias("low"), depth.alias("depth"), ok.alias("ok"))


def token_hit_rate(text: Column, tokens: Column) -> Column:
    """Share of required tokens that the text holds; null where none is required, and an empty token never counts as held."""
    held = F.size(F.filter(tokens, lambda t: (t != "") & F.contains(text, t)))
    return F.when(F.size(tokens) > 0, held / F.size(tokens))


def char_error_rate(found: Column, truth: Column) -> Column:
    """Edit distance over the length of the truth, both without white space; over an empty truth 1, or 0 if nothing was found."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    h, t = bare(found), bare(truth)
    return F.when(F.length(t) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(h, t) / F.length(t))


def class_ratio(text: Column, pattern: str) -> Column:
    """Share of visible characters that a class matches; 0 for blank texts."""
    n = char_count(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(0.0)


def redact(text: Column, secrets: Column, mark: str = "[redacted]") -> Column:
    """Every literal of the array replaced; empty ones are skipped."""
    return F.aggregate(F.filter(secrets, lambda s: s != ""), text, lambda t, s: F.replace(t, s, F.lit(mark)))


def sanitise_html(html: Column, allowed: Sequence[str] = ("p", "br", "b", "i", "em", "strong", "ul", "ol", "li", "sub", "sup", "table", "tr", "td", "th")) -> Column:
    """Scripts, styles and comments gone with what they hold, other tags kept bare if allowed and else dropped."""
    gone = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    bare = F.regexp_replace(gone, rf"(?i)<(/?)({'|'.join(allowed)})\b[^>]*>", "<$1$2>")
    return F.regexp_replace(bare, rf"(?i)<(?!/?(?:{'|'.join(allowed)})>)[^>]*>", "")


def strip_leading_number(text: Column, number: Column) -> Column:
    """The text without its own number in front, padded or not, and what sets it off."""
    plain = F.regexp_replace(number, "^0+(?=[0-9])", "")
    return F.regexp_replace(text, F.concat(F.lit(r"^\s*#?\s*0*"), plain, F.lit(r"(?![0-9])[.)]?\s*")), F.lit(""))


def strip_trailing_lines(text: Column, pattern: str, most: int = 8) -> Column:
    """The text without its last lines that are blank or match a pattern whole, at most so many of them."""
    lines = F.split(text, "\n")
    kept = F.aggregate(
        F.reverse(lines),
        F.struct(F.lit(0).alias("gone"), F.lit(True).alias("open")),
        lambda a, s: F.struct((a["gone"] + F.when(a["open"] & s.rlike(rf"^\s*(?:{pattern})?\s*$"), 1).otherwise(0)).alias("gone"), (a["open"] & s.rlike(rf"^\s*(?:{pattern})?\s*$") & (a["gone"] + 1 < most)).alias("open")),
    )
    return F.array_join(F.slice(lines, F.lit(1), F.size(lines) - kept["gone"]), "\n")


def compose_stem(shared: Column, own: Column) -> Column:
    """A shared prompt in front of an item's own text, unless it is there already."""
    blank = F.trim(F.coalesce(shared, F.lit(""))) == ""
    return F.when(blank, own).when(F.contains(squeeze(own), squeeze(shared)), own).otherwise(F.concat(F.trim(shared), F.lit("\n"), own))


def script_only(text: Column, letters: str = "가-힣") -> Column:
    """What is left of a text of letters in one range, Hangul syllables if none is given."""
    return F.regexp_replace(text, f"[^{letters}]", "")


def core_title(title: Column) -> Column:
    """A type's title without its word and number in front."""
    return F.trim(F.regexp_replace(title, r"^유형\s*\d+\s*", ""))
