"""A page's layout and the numbers on it as columns over one array of its blocks: regions, anchors with their evidence, and the roles of what follows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repair import STEM_START, resolve_digits
from .text import bare as _bare
from .text import bound

#: The bands of headers and footers, where a gap between left edges may lie, and the least gap that counts.
HEADER_Y, FOOTER_Y, GAP_FROM, GAP_TO, LEAST_GAP = 0.07, 0.93, 0.18, 0.88, 0.08
#: Words that ask for something, heads of theory, marks of lists, and circled numbers. What begins with one of few letters is looked for at these alone, not tried word by word at every place, and signs in a row are ranges.
PROBLEM_BODY = r"(?=[가-힣])(?:구하시오|구하여라|구하라|값은\?|값은\b|고르시오|다음 중|다음중|서술하시오|증명하시오|말하시오|만족시키|고르면)"
THEORY_HEAD = r"(?=[가-힣])(?:용어|정의|정리|성질|개념|주의|보기|예제|풀이|설명|항:|상수항|동류항|내림차순|오름차순)"
LIST_MARK = r"[⑴-⑽㈎-㈐]"
CIRCLED, CHOICES = r"[①-⑩]", r"[①-⑤]"
#: Fixed value: signs, names and coefficients of formulas.
FORMULA = r"(?=[=^\\fs0123456789])(?:[=^\\]|frac|sqrt|\d+x)"
#: Heads of examples, solutions, explanations and answer keys, titles of sections, chains of equations, and definitions.
EXAMPLE_HEAD = r"예제|보기|Example|EXAMPLE"
SOLUTION_HEAD = r"(?:^|[^가-힣])(풀이|해답|Solution)(?:\z|[^가-힣])"
EXPLAIN_HEAD = r"(?:^|[●•])설명(?:\z|주어진|[:：])"
LOCAL_HEAD = r"^(풀이|설명|해답)"
ANSWER_HEADER = r"정답및풀이"
SECTIONISH = r"단원|활용-|연산\z|정리\z|공식\z|추정\z"
EQUALS_CHAIN = r"(=|∴|이므로|따라서).{0,40}(=|∴)"
DEFINITION = r"항:|정의|용어"
#: Fixed value: what the first 400 characters of a page on theory hold.
EXAMPLE_PAGE = r"(?=[가-힣])(?:보기|예제|정의|정리)"


def _median(values: Column) -> Column:
    """The middle one in order, of an even number the later; 0 of none."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def _box(x: Column, width: Column, y: float = HEADER_Y, height: float = FOOTER_Y - HEADER_Y) -> list[Column]:
    return [F.least(F.lit(0.98), F.greatest(F.lit(0.0), x)).alias("x"), F.lit(y).alias("y"), F.least(F.lit(1.0), F.greatest(F.lit(0.01), width)).alias("w"), F.lit(height).alias("h")]


def _region(kind: str, box: list[Column], confidence: Column | float, *evidence: Column | str) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(kind).alias("kind"), *box, lit(confidence).cast("double").alias("confidence"), F.array(*map(lit, evidence)).alias("evidence"))


def page_map(blocks: Column) -> Column:
    """struct(layout, gap, cut, sidebar_x, sidebar_end, second_x, regions) of a page's blocks (array of struct x, y, w, content).

    The widest gap between distinct left edges cuts the body in two: a narrow right part with less text is a sidebar, two parts of
    width are columns, other gaps are MIXED, none ONE_COLUMN; UNKNOWN without blocks between header and footer.
    """
    body = F.filter(blocks, lambda b: b["x"].between(0, 1) & (b["y"] > HEADER_Y) & (b["y"] < FOOTER_Y))

    def by_gap(body: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.filter(F.transform(body, lambda b: b["x"]), lambda x: x.between(GAP_FROM, GAP_TO))))
        steps = lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: F.struct((F.get(xs, i) - F.get(xs, i - 1)).alias("gap"), (-i).alias("k"), ((F.get(xs, i) + F.get(xs, i - 1)) / 2).alias("cut")))
        widest = bound(edges, lambda xs: F.when(F.size(xs) > 1, F.array_max(steps(xs))))
        return bound(F.struct(F.coalesce(widest["gap"], F.lit(0.0)).alias("gap"), F.coalesce(widest["cut"], F.lit(0.5)).alias("cut"), body.alias("body")), by_cut)

    def by_cut(g: Column) -> Column:
        left, right = (F.filter(g["body"], test) for test in (lambda b: b["x"] + b["w"] / 2 < g["cut"], lambda b: b["x"] + b["w"] / 2 >= g["cut"]))
        chars = lambda part: F.aggregate(part, F.lit(0), lambda n, b: n + F.coalesce(F.length(b["content"]), F.lit(0)))
        width = lambda part: _median(F.transform(part, lambda b: b["w"]))
        parts = F.struct(g["gap"].alias("gap"), g["cut"].alias("cut"), F.size(g["body"]).alias("n"), F.size(left).alias("nl"), F.size(right).alias("nr"), width(left).alias("lw"), width(right).alias("rw"), _median(F.transform(right, lambda b: b["x"])).alias("rx"), chars(left).alias("lc"), chars(right).alias("rc"))
        return bound(parts, decided)

    def decided(m: Column) -> Column:
        gap, cut = m["gap"], m["cut"]
        narrow = (m["rw"] > 0) & (m["rw"] < 0.32) & (m["rx"] >= 0.62) & (m["rw"] / F.greatest(m["lw"], F.lit(0.2)) < 0.62)
        wide = gap >= LEAST_GAP
        side = wide & narrow & (m["nr"] >= 1) & (m["lc"] > m["rc"])
        two = wide & (m["nl"] >= 2) & (m["nr"] >= 2) & (m["rw"] >= 0.28) & (m["lw"] >= 0.28) & (cut > 0.38) & (cut < 0.62)
        mixed = wide & (m["nl"] > 0) & (m["nr"] > 0)
        layout = F.when(m["n"] == 0, "UNKNOWN").when(side, "MAIN_PLUS_SIDEBAR").when(two, "TWO_COLUMN").when(mixed, "MIXED").otherwise("ONE_COLUMN")
        bands = F.array(_region("HEADER", _box(F.lit(0.0), F.lit(1.0), 0.0, HEADER_Y), 0.9, "top_band"), _region("FOOTER", _box(F.lit(0.0), F.lit(1.0), FOOTER_Y, 1 - FOOTER_Y), 0.9, "bottom_band"))
        alone = _box(F.lit(0.06), F.lit(0.88))
        main = (
            F.when(side, F.array(_region("MAIN_COLUMN_1", _box(F.lit(0.06), F.greatest(F.lit(0.4), cut - 0.08)), 0.78, "left_text_cluster", "width_ratio_narrow_right", F.concat(F.lit("gap_"), F.format_string("%.3f", gap))), _region("SIDEBAR", _box(F.least(F.lit(0.92), cut), F.greatest(F.lit(0.08), 0.98 - cut)), 0.74, "narrow_right_cluster", "repeated_alignment", "density_lower_than_main")))
            .when(two, F.array(_region("MAIN_COLUMN_1", _box(F.lit(0.04), cut - 0.06), 0.8, "column_gap", "similar_widths"), _region("MAIN_COLUMN_2", _box(cut, 0.96 - cut), 0.8, "column_gap", "similar_widths")))
            .when(mixed, F.array(_region("MAIN_COLUMN_1", alone, 0.55, "gap_present_widths_unbalanced")))
            .otherwise(F.array(_region("MAIN_COLUMN_1", alone, F.when(m["n"] > 0, 0.7).otherwise(0.4), "single_left_cluster")))
        )
        side_x = F.when(side, F.least(F.lit(0.92), cut))
        return F.struct(layout.alias("layout"), gap.alias("gap"), cut.alias("cut"), side_x.alias("sidebar_x"), (side_x + F.greatest(F.lit(0.08), 0.98 - cut)).alias("sidebar_end"), F.when(two & ~side, cut).alias("second_x"), F.concat(bands, main).alias("regions"))

    return bound(body, by_gap)


def region_of(page: Column, x: Column, y: Column) -> Column:
    """The region of page_map() that a point lies in."""
    return F.when(y <= HEADER_Y, "HEADER").when(y >= FOOTER_Y, "FOOTER").when(F.coalesce((x >= page["sidebar_x"]) & (x <= page["sidebar_end"]), F.lit(False)), "SIDEBAR").when(F.coalesce(x >= page["second_x"], F.lit(False)), "MAIN_COLUMN_2").otherwise("MAIN_COLUMN_1")


def stem_like(rest: Column, following: Column, style: Column) -> Column:
    """Whether what stands behind a number reads as a problem's stem."""
    blob = F.concat(rest, F.lit(" "), following)
    return (
        blob.rlike(PROBLEM_BODY)
        | ((style == "4_DIGIT") & (F.length(F.regexp_replace(rest, r"[|\s#]", "")) >= 4))
        | (blob.rlike(FORMULA) & blob.rlike(r"(?:\S\s*+){8}"))
        | blob.rlike(CIRCLED)
        | (rest.rlike(STEM_START) & (F.length(rest) >= 4) & ~F.substring(rest, 1, 12).rlike(THEORY_HEAD))
    )


def theory_like(rest: Column, following: Column, example_page: Column) -> Column:
    """Whether it reads as theory. example_page: whether the page begins with an example or a definition (see EXAMPLE_PAGE)."""
    blob = F.concat(rest, F.lit(" "), following)
    said = blob.rlike(LIST_MARK) | rest.rlike(THEORY_HEAD) | (example_page & (F.length(rest) < 18))
    return said & ~blob.rlike(PROBLEM_BODY)


def is_seed(n: Column, x: Column) -> Column:
    """Whether a number read by glued_number() can bear out others on its page: left-hand, not a circled one or one in brackets, and no lone digit."""
    return F.coalesce(n["value"].isNotNull() & ~n["style"].isin("CIRCLED", "PAREN") & (x <= 0.38) & ((n["style"] == "4_DIGIT") | (n["value"] >= 10) | n["glued"]), F.lit(False))


def number_among(n: Column, content: Column, seeds: Column) -> Column:
    """A number read again by those of its page (array of long): long runs of digits, and doubtful ones."""

    def read(t: Column) -> Column:
        near = F.filter(seeds, lambda v: v.between(10, 999))
        long = (F.length(t["run"]) == 4) & (F.size(near) >= 2)
        doubtful = n["ambiguous"] & (t["run"] != "") & (F.size(seeds) >= 2)
        return F.when(long, resolve_digits(t["run"], t["rest"], near)).when(doubtful, resolve_digits(t["run"], n["rest"], seeds)).otherwise(n)

    run = lambda bare: F.regexp_extract(bare, r"^(\d{3,4})", 1)
    cut = bound(_bare(content), lambda t: bound(run(t), lambda r: F.struct(r.alias("run"), F.substring(t, F.length(r) + 1, F.length(t)).alias("rest"))))
    # most texts do not begin with digits, and nothing else is done with these
    return F.when(content.rlike(r"^\s*\d\s*\d\s*\d"), bound(cut, read)).otherwise(n)


def anchor_facts(n: Column, x: Column, y: Column, following: Column, page: Column, example_page: Column, seeds: Column, lefts: Column) -> dict[str, Column]:
    """What is known of a block's number: its region, whether a stem is attached, a neighbour's number, how many numbers are aligned, a choice, theory, and requests."""
    rest, text = n["rest"], F.concat(n["rest"], following)
    hit = n["value"].isNotNull() & (n["style"] != "CIRCLED") & F.exists(seeds, lambda s: F.abs(s - n["value"]) == 1)
    return {
        "region": region_of(page, x, y), "leftish": x.between(0.05, 0.36), "attached": F.coalesce(stem_like(rest, following, n["style"]), F.lit(False)), "hit": F.coalesce(hit, F.lit(False)),
        "aligned": F.size(F.filter(lefts, lambda o: F.abs(o - x) < 0.05)), "choice": F.coalesce((n["style"] == "CIRCLED") | ((n["style"] == "PAREN") & following.rlike(CIRCLED)), F.lit(False)),
        "theory": theory_like(rest, following, example_page), "asks": text.rlike(PROBLEM_BODY), "math": text.rlike(r"[=^\\]"),
    }


def anchor_score(n: Column) -> Column:
    """How much speaks for a number as a problem's, from 0 to 1; columns as anchor_facts() names them."""
    add = lambda test, value: F.when(test, value).otherwise(0.0)
    c = F.col
    main = c("region").isin("MAIN_COLUMN_1", "MAIN_COLUMN_2")
    score = 0.15 + add(c("leftish"), 0.12) + add(c("attached"), 0.18) + add(c("hit"), 0.14) + add(c("aligned") >= 2, 0.08) + add(main, 0.08) + add(c("math"), 0.05) + add(c("choice"), -0.45) + add(c("theory"), -0.28) + add(~main, -0.3) + add(n["ambiguous"], -0.2)
    score += add((n["style"] == "NUMBER_PUNCT") & (F.length(n["rest"]) < 8) & c("theory"), -0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def anchor_kind(n: Column) -> Column:
    """A number's class; columns as anchor_facts() names them."""
    c = F.col
    return (
        F.when(n["reason"] == "step_marker", "STEP_MARKER")
        .when((F.length(n["display"]) >= 2) & n["display"].startswith("0") & (n["style"] != "4_DIGIT"), "PAGE_DECORATION")
        .when(c("choice"), "CHOICE_MARKER")
        .when(c("region").isin("HEADER", "FOOTER"), "PAGE_DECORATION")
        .when(((n["style"] == "PAREN") | c("theory")) & ~c("asks"), "THEORY_LIST")
        .when((n["style"] == "1_DIGIT") & (F.length(n["rest"]) < 28) & ~c("asks") & ~n["rest"].rlike(r"[=^\\]"), "THEORY_LIST")
        .when(c("attached") & (c("leftish") | c("hit")), "PROBLEM_ANCHOR")
        .otherwise("UNKNOWN")
    )


def anchor_evidence(n: Column) -> Column:
    c = F.col
    several = c("aligned") >= 2
    said = [(c("leftish"), "left_of_main_band"), (c("attached"), "stem_or_instruction"), (c("hit"), "neighbor_plus_minus_one"), (several, "same_x_band_count"), (c("choice"), "choice_marker"), (c("theory"), "definition_or_list"), (c("region") == "SIDEBAR", "inside_rail"), (several & c("hit"), "left_index_cluster")]
    return F.array_compact(F.array(*[F.when((n["reason"] != "step_marker") & t, v) for t, v in said]))


def answer_key_like(blocks: Column) -> Column:
    """Whether a page reads as a list of answers: eight numbers or more and at most one request."""
    body = F.filter(blocks, lambda b: (b["y"] > HEADER_Y) & (b["y"] < FOOTER_Y))
    asks = F.size(F.filter(body, lambda b: F.coalesce(b["content"].rlike(PROBLEM_BODY), F.lit(False))))
    return (F.size(body) >= 8) & (asks <= 1) & (F.size(F.filter(body, lambda b: F.coalesce(b["content"].rlike(r"^\s*\d\s*\d"), F.lit(False)))) >= 8)


def catalog_like(blocks: Column) -> Column:
    """Whether it reads as a table of contents: six numbered titles or more and at most three requests."""
    asks = lambda b: F.coalesce(b["content"].rlike(PROBLEM_BODY), F.lit(False))
    titles = F.size(F.filter(blocks, lambda b: F.coalesce(b["content"].rlike(r"^\s*\d(?:\s*\d){1,3}\s*가"), F.lit(False)) & ~asks(b)))
    return (titles >= 6) & (F.size(F.filter(blocks, asks)) <= 3)


def role_facts(display: Column, preview: Column, until: Column, blocks: Column, x: Column, y: Column, h: Column) -> dict[str, Column]:
    """What stands around a problem (box x, y, h): until is the page's text from it to the next problem, blocks are the page's."""
    body, text = _bare(preview), _bare(until)
    said = lambda b: F.coalesce(b["content"], F.lit(""))
    nearby = F.array_join(F.transform(F.filter(blocks, lambda b: (F.abs(b["y"] - y) < 0.08) & (F.abs(b["x"] - x) < 0.25)), said), "")
    local = F.exists(blocks, lambda b: b["y"].between(y - 0.01, y + h) & (b["x"] <= 0.55) & ~_bare(said(b)).rlike(ANSWER_HEADER) & (_bare(said(b)).rlike(LOCAL_HEAD) | _bare(said(b)).rlike(SOLUTION_HEAD)))
    return {
        "local": local, "example": nearby.rlike(EXAMPLE_HEAD) | F.substring(body, 1, 12).rlike(EXAMPLE_HEAD), "derived": text.rlike(SOLUTION_HEAD) & ~text.rlike(ANSWER_HEADER) & text.rlike(EQUALS_CHAIN), "explained": text.rlike(EXPLAIN_HEAD),
        "asks": text.rlike(PROBLEM_BODY) | body.rlike(PROBLEM_BODY), "choices": text.rlike(CHOICES), "section": body.rlike(SECTIONISH), "defines": body.rlike(DEFINITION), "digits": F.length(display),
    }


#: Scores of a role in the order in which the first of equal ones wins.
ROLES = ("EXERCISE_PROBLEM", "WORKED_EXAMPLE", "THEORY_LIST", "SOLUTION_STEP")


def role_scores() -> dict[str, Column]:
    """The score of each of ROLES, and what the evidence is; columns as role_facts() names them, with `exercise` (in a run of exercises) and `sequence` (a neighbour's number on the page)."""
    c = F.col
    add = lambda *pairs: sum((F.when(t, v).otherwise(0.0) for t, v in pairs), F.lit(0.0))
    worked = c("explained") | c("local")
    titled, defines, single = c("section") & ~c("asks") & (c("digits") <= 2), c("defines") & ~c("asks"), (c("digits") == 1) & ~c("asks") & ~c("exercise")
    said = [(c("exercise"), "exercise_region"), (c("sequence"), "peer_sequence"), (c("asks"), "instruction_syntax"), (c("choices"), "choice_group"), (c("example"), "example_heading_nearby"), (worked, "worked_explain_or_solution_heading"), (c("local"), "in_worked_solution_container"), (c("derived"), "derivation_after_solution_head"), (titled, "section_title_pattern"), (defines, "definition_item"), (single, "single_digit_outside_exercise")]
    scores = [add((c("exercise"), 0.28), (c("sequence"), 0.18), (c("asks"), 0.22), (c("choices"), 0.12)), add((c("example"), 0.34), (worked, 0.22), (c("local"), 0.5), (c("derived"), 0.18)), add((titled, 0.35), (defines, 0.4)), add((c("derived"), 0.2), (single, 0.25))]
    ranked = F.sort_array(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("k"), F.lit(r).alias("role")) for i, (r, s) in enumerate(zip(ROLES, scores))]), asc=False)
    return {"ranked": ranked, "exercise_score": scores[0], "said": F.array_compact(F.array(*[F.when(t, v) for t, v in said]))}


def context_role() -> Column:
    """struct(role, score, confidence, evidence): the greatest score if it is at least 0.28 and 0.08 ahead of the next, else UNKNOWN; columns as role_scores() names them, and `region`."""
    c = F.col
    best, ahead = c("ranked")[0], c("ranked")[0]["score"] - c("ranked")[1]["score"]
    more = lambda v: F.array_append("said", v)
    out = lambda role, score, confidence, evidence: F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), score.alias("score"), confidence.alias("confidence"), evidence.alias("evidence"))
    weak = (best["role"] == "WORKED_EXAMPLE") & c("asks") & c("exercise") & c("sequence") & ~c("local")
    return (
        F.when(c("region").isin("HEADER", "FOOTER"), out("PAGE_DECORATION", F.lit(0.2), F.lit(0.9), F.array(F.lit("header_or_footer"))))
        .when(best["score"] < 0.28, out("UNKNOWN", best["score"], F.lit(0.35), more("low_role_score")))
        .when(ahead < 0.08, out("UNKNOWN", best["score"], F.lit(0.4), more("role_tie")))
        .when(weak, out("EXERCISE_PROBLEM", c("exercise_score"), F.least(F.lit(0.9), 0.5 + c("exercise_score")), more("exercise_overrides_weak_example")))
        .otherwise(out(best["role"], best["score"], F.least(F.lit(0.95), 0.45 + best["score"]), c("said")))
    )
