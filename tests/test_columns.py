"""Page columns against plain loops over each page."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliograph.operators import columns as C
from foliograph.plans import queries_columns as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def alike(a, b):
    return a[1] == b[1] and abs(a[0] - b[0]) <= 3 or abs(a[1] - b[1]) <= 5 and abs(a[0] - b[0]) <= 1


def plain(lines):
    """Candidates, columns and each line's column by (doc_id, page), line after line."""
    found, chosen, of_line = defaultdict(list), {}, {}
    for doc, rows in lines.items():
        edges = [(r["llx"], r["urx"]) for r in rows]
        for k, r in enumerate(rows):
            page = found[doc, r["page"]]
            c = next((c for c in page if alike((c["left"], c["right"]), edges[k])), None)
            if c is None:
                c = {"left": r["llx"], "right": r["urx"], "top": r["ury"], "bottom": r["lly"], "qty": 0, "contiguous": 0}
                page.append(c)
            c["qty"] += 1
            c["top"], c["bottom"] = max(c["top"], r["ury"]), min(c["bottom"], r["lly"])
            c["contiguous"] += any(0 <= j < len(rows) and alike((c["left"], c["right"]), edges[j]) for j in (k - 1, k + 1))
    for key, page in found.items():
        out = []
        for k, c in enumerate(sorted(page, key=lambda c: -c["qty"])):
            wide = c["right"] - c["left"] > 50
            if not k and wide:
                out.append(c)
                continue
            ok = c["qty"] >= 3 and c["contiguous"] >= 0.8 * c["qty"] and wide
            for b in out:
                beside = c["left"] > b["right"] or b["left"] > c["right"] or c["bottom"] > b["top"] or b["bottom"] > c["top"]
                width = b["right"] - b["left"]
                one = abs(c["left"] - b["left"]) <= 2 and abs(c["right"] - b["right"]) >= 0.15 * width or abs(c["right"] - b["right"]) <= 2 and abs(c["left"] - b["left"]) >= 0.15 * width
                ok = ok and (beside or one)
            if ok:
                out.append(c)
        chosen[key] = out
    for doc, rows in lines.items():
        for r in rows:
            place = None
            for k, c in enumerate(chosen[doc, r["page"]]):
                beside = r["llx"] > c["left"] - 3 and r["urx"] < c["right"] + 5
                if alike((c["left"], c["right"]), (r["llx"], r["urx"])) or beside and r["ury"] <= c["top"] and r["lly"] >= c["bottom"]:
                    place = k
                    break
                if beside and min(abs(r["lly"] - c["top"]), abs(c["bottom"] - r["ury"])) <= 16:
                    place = k
            of_line[doc, r["line_idx"]] = place
    return found, chosen, of_line


def test_columns(spark):
    lines = defaultdict(list)
    for r in Q.two_columns(spark, SF).orderBy("doc_id", "line_idx").collect():
        lines[r["doc_id"]].append(r.asDict())
    found, chosen, of_line = plain(lines)
    for query, wanted in ((Q.column_candidates, found), (Q.page_columns, chosen)):
        got = defaultdict(list)
        for r in sorted(query(spark, SF).collect(), key=lambda r: r["place"]):
            got[r["doc_id"], r["page"]].append({k: v for k, v in r.asDict().items() if k not in ("doc_id", "page", "place")})
        assert got == {k: v for k, v in wanted.items() if v}
    assert {(r["doc_id"], r["line_idx"]): r["column"] for r in Q.line_columns(spark, SF).collect()} == of_line
    assert len(set(of_line.values())) > 2


def test_empty(spark):
    lines = Q.two_columns(spark, SF).limit(0)
    assert C.with_column(lines, C.columns(C.candidates(lines)), F.lit(1)).count() == 0
