"""Crops against a plain judge, crop by crop, and known cases."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

import stemma.queries  # noqa: F401
from stemma.catalog import QUERIES
from stemma.operators.crops import MATH, gated_crops
from stemma.sources.views import crop_parts, crops

SPACE = " \t\n\x0b\f\r"
COLUMNS = "page long, item long, number string, canonical string, x double, y double, w double, h double, stem string, markdown string, anchored boolean, unstable boolean, uncertain boolean, columns int, last boolean, figure_hint boolean, image struct<width:int,height:int,ink:double,components:int,left_top_ink:boolean,top:double,bottom:double,left:double,right:double,blob_edge:boolean,blob_share:double>"


def inter(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def share(a, b):
    """How much of b lies in a."""
    return inter(a, b) / (b[2] * b[3]) if b[2] * b[3] > 0 else 0.0


def judged(rows, blocks, images):
    pages, out = defaultdict(list), {}
    for r in rows:
        pages[r["page"]].append(r)
    for page, crops_ in pages.items():
        numbers = {r["number"] for r in crops_ if r["number"] is not None}
        for r in crops_:
            box = (r["x"], r["y"], r["w"], r["h"])
            others = [(o, (o["x"], o["y"], o["w"], o["h"])) for o in crops_ if o["item"] != r["item"]]
            iou = max([i / (box[2] * box[3] + b[2] * b[3] - i) for _, b in others if (i := inter(box, b)) > 0], default=0.0)
            below = min([(b[1], o["item"], o) for o, b in others if abs(b[0] - box[0]) < 0.08 and b[1] > box[1] + 0.01], key=lambda v: v[:2], default=None)
            after = below and below[2]
            stem, own = r["stem"] or "", r["canonical"] or r["number"]
            text = stem + "\n" + (r["markdown"] or "")
            bare = re.sub(MATH, " ", text)
            lines = [s for line in bare.split("\n") if (s := line.strip(SPACE))]
            hits = [(n, i) for n in numbers - {own} if re.match(r"[0-9]{4}\Z", n) for i, s in enumerate(lines) if re.match(rf"(?:#{{1,3}}\s*)?{n}(?:\s*(?:[|•.]|대표)|\s|\Z)", s)]
            last_only = bool(hits) and all(i >= len(lines) - 1 for _, i in hits)
            said = bool(own and re.match(r"[0-9]{4}\Z", own)) and own in bare
            ranges = {n for m in re.findall(r"\[(\d{4})\s*[~\-–]\s*(\d{4})\]", text) for n in m} - {own}
            adjacent = "NONE" if not after or after["number"] not in stem else "BODY_INTRUSION" if re.search(re.escape(after["number"]) + r"\s+[^\n]{24,}", stem) else "HEADER_ONLY"
            im = r["image"]
            hard, soft = [], []
            if not (box[0] >= -1e-6 and box[1] >= -1e-6 and box[2] > 0 and box[3] > 0 and box[0] + box[2] <= 1 + 1e-6 and box[1] + box[3] <= 1 + 1e-6):
                hard.append("INVALID_BBOX")
            if im and (im["width"] < 64 or im["height"] < 48):
                hard.append("EMPTY_CROP")
            if im and (im["ink"] is not None and im["ink"] < 0.008 or im["components"] == 0 and (im["ink"] is None or im["ink"] < 0.012)):
                hard.append("NO_CONTENT")
            if r["unstable"] or r["canonical"] is None:
                hard.append("IDENTITY_UNSTABLE")
            if r["uncertain"]:
                hard.append("NUMBER_UNCERTAIN")
            anchored = r["anchored"] and r["canonical"] is not None
            if not said and not anchored and not (im and im["left_top_ink"]):
                hard.append("SELF_NUMBER_MISSING")
            elif not said and anchored:
                soft.append("self_number_from_segment_anchor")
            if adjacent == "BODY_INTRUSION":
                hard.append(adjacent)
            if ranges or hits and not last_only or iou >= 0.12:
                hard.append("NEIGHBOR_NUMBER_INTRUSION")
            if hits and last_only:
                soft.append("neighbor_header_last_line")
            if after:
                px, py = max(0, box[0] - 0.022), max(0, box[1] - 0.022)
                if share((px, py, min(1 - px, box[2] + 0.044), min(1 - py, box[3] + 0.044)), (after["x"], after["y"], after["w"], min(0.03, after["h"]))) >= 0.4:
                    soft.append("neighbor_header_in_pad")
            if (r["columns"] or 0) >= 2 and box[2] > 0.62:
                hard.append("COLUMN_INTRUSION")
            mine = lambda ps: [(p["x"], p["y"], p["w"], p["h"]) for p in ps if (p["page"], p["item"]) == (page, r["item"])]  # noqa: B023, E731
            if any(share(box, p) < 0.45 for p in mine(b for b in blocks if len((b["content"] or "").strip()) >= 4)):
                hard.append("KNOWN_BLOCK_OUTSIDE_CROP")
            pictured = mine(images)
            if any(share(box, p) < 0.7 for p in pictured) or im and im["blob_edge"] and im["blob_share"] >= 0.08:
                hard.append("FIGURE_BOUNDARY_RISK")
            if im:
                for e, cut, maybe in (("top", 0.5, 0.32), ("bottom", 0.5, 0.32), ("left", 0.55, 0.38), ("right", 0.5, 0.32)):
                    if im[e] is not None and im[e] >= cut:
                        hard.append(f"{e.upper()}_CUT_RISK")
                    elif im[e] is not None and im[e] >= maybe:
                        soft.append(f"{e}_edge_ambiguous")
                if r["figure_hint"] and not im["blob_edge"] and not pictured:
                    soft.append("visual_figure_unconfirmed")
                if r["last"] and im["bottom"] is not None and 0.22 <= im["bottom"] < 0.5:
                    soft.append("column_last_bottom_uncertain")
            else:
                soft.append("image_features_missing")
            review = [s for s in soft if s not in ("self_number_from_segment_anchor", "visual_figure_unconfirmed")]
            height = box[3]
            if after and after["y"] < box[1] + box[3] - 0.002:
                height = after["y"] - 0.006 - box[1]
            if "INVALID_BBOX" in hard and not (box[1] + height <= 1 + 1e-6 and box[0] + box[2] <= 1 + 1e-6) or height != box[3] and height < 0.035:
                height = None
            out[page, r["item"]] = (iou, after and after["number"], sorted({n for n, _ in hits}), adjacent, "CROP_UNSAFE" if hard else "CROP_REVIEW" if review else "CROP_SAFE", sorted(hard), sorted(soft), height)
    return out


def same(found, want):
    assert set(found) == set(want)
    for k, w in want.items():
        h = found[k]
        assert h[1:7] == w[1:7] and h[0] == pytest.approx(w[0], abs=2e-6), (k, h, w)
        assert (h[7] is None) == (w[7] is None) and (w[7] is None or h[7] == pytest.approx(w[7], abs=2e-6)), (k, h, w)


def test_query(spark, sf):
    """The registered query on all crops of the table."""
    rows = [r.asDict(recursive=True) for r in crops(spark, sf).collect()]
    parts = [[r.asDict() for r in crop_parts(spark, sf, s).collect()] for s in (0.1, 0.05)]
    by = [defaultdict(list), defaultdict(list)]
    for group, ps in zip(by, parts):
        for p in ps:
            group[p["page"]].append(p)
    want = {}
    pages = defaultdict(list)
    for r in rows:
        pages[r["page"]].append(r)
    for page, rs in pages.items():
        want |= judged(rs, by[0][page], by[1][page])
    cut = lambda v: sorted(v.split(",")) if v else []
    same({(r.page, r.item): (r.iou, r.next_number, cut(r.neighbours), r.adjacent, r.decision, cut(r.hard), cut(r.soft), r.recovery_h) for r in QUERIES["crop_decisions"](spark, sf).collect()}, want)
    assert {w[4] for w in want.values()} == {"CROP_SAFE", "CROP_REVIEW", "CROP_UNSAFE"} and len({h for w in want.values() for h in w[5]}) >= 13 and {w[3] for w in want.values()} >= {"NONE", "BODY_INTRUSION"}


GOOD = dict(width=520, height=400, ink=0.1, components=9, left_top_ink=True, top=0.0, bottom=0.0, left=0.0, right=0.0, blob_edge=False, blob_share=0.0)


def test_known_cases(spark):
    """Safe, intruded, cut, in mathematics, ranges, headers in the margin; nulls and an empty table."""
    base = dict(page=1, item=1, number="0159", canonical="0159", x=0.05, y=0.2, w=0.45, h=0.16, stem="0159 다음 중 옳은 것은?", markdown=None, anchored=True, unstable=False, uncertain=False, columns=1, last=False, figure_hint=False, image=GOOD)
    far = base | dict(item=2, number="0160", canonical="0160", x=0.55, y=0.7, stem="0160 x")
    cases = {
        1: ([base, far], "CROP_SAFE", set()), 2: ([base | dict(stem="0159 다음\n0160 | 대표 문제 이것은 다음 문제 본문입니다.\nend"), far], "CROP_UNSAFE", {"NEIGHBOR_NUMBER_INTRUSION"}), 3: ([base | dict(image=GOOD | dict(top=0.62))], "CROP_UNSAFE", {"TOP_CUT_RISK"}),
        4: ([base | dict(image=GOOD | dict(width=20, height=10, ink=0.002, components=0))], "CROP_UNSAFE", {"EMPTY_CROP", "NO_CONTENT"}), 5: ([base | dict(image=GOOD | dict(bottom=0.36))], "CROP_REVIEW", set()),
        6: ([base | dict(stem="0159 다음 식 $i^{0160}+f(0160)$"), far], "CROP_SAFE", set()), 7: ([base, far | dict(x=0.05, y=0.365)], "CROP_REVIEW", set()), 8: ([base | dict(stem="0159 [0160~0161] 세 다항식")], "CROP_UNSAFE", {"NEIGHBOR_NUMBER_INTRUSION"}),
        9: ([base | dict(image=None, stem=None)], "CROP_REVIEW", set()), 10: ([base | dict(number=None, canonical=None, anchored=None, unstable=None, uncertain=None, columns=None, last=None, figure_hint=None)], "CROP_UNSAFE", {"IDENTITY_UNSTABLE"}),
        11: ([base | dict(x=0.8)], "CROP_UNSAFE", {"INVALID_BBOX"}),
    }
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [r | dict(page=k) for k, (rs, _, _) in cases.items() for r in rs]
    t = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)
    found = {(r.page, r.item): r for r in gated_crops(t).collect()}
    for k, (_, decision, hard) in cases.items():
        assert (found[k, 1].decision, set(found[k, 1].hard)) == (decision, hard), k
    assert gated_crops(t.limit(0)).count() == 0
    same({k: (r.iou, r.next_number, sorted(r.neighbours), r.adjacent, r.decision, sorted(r.hard), sorted(r.soft), r.recovery_h) for k, r in found.items() if k[0] != 10}, {k: v for k, v in judged([r for r in rows if r["page"] != 10], [], []).items()})


def test_full_pages_and_shuffles(spark, sf):
    """Full pages, met in tiles, have the same crops as pages met as arrays; texts are dealt by page, so that few exchanges are left."""
    parts = [crop_parts(spark, sf, s) for s in (0.1, 0.05)]
    some = lambda full: sorted(map(str, gated_crops(crops(spark, sf).where("page % 5 = 1"), *[p.where("page % 5 = 1") for p in parts], full=full).drop("image").collect()))
    as_arrays = some(10**6)
    assert as_arrays == some(0) and as_arrays == some(6)
    plan = QUERIES["crop_decisions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8
