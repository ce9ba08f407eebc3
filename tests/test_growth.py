"""What keeps queries from growing faster than their input: where rows are shuffled, and passes beside plain loops."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from foliograph.operators import by_document
from foliograph.operators import spans as P
from foliograph.operators import token_features as TF
from foliograph.operators import tokens as T
from foliograph.operators.elements import elements
from foliograph.plans import views as V

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan_of(df):
    """The nodes of the physical plan, the root first."""
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


@tables
def test_words_are_not_shuffled_for_their_numbers(spark):
    lines = plan_of(V.token(spark, SF).select("doc_id", "tok_idx", "token"))
    words = next(k for k, x in enumerate(lines) if "Generate posexplode" in x)
    assert any("Exchange" in x for x in lines[words:]) and not any("Exchange" in x or "Window" in x for x in lines[:words])


@tables
@pytest.mark.parametrize("name", ["line_ends", "page_ranges"])
def test_partitions_of_words_follow_the_texts(spark, monkeypatch, name):
    import __spark_entry__  # noqa: F401  (fills the registry)
    from foliograph.plans import catalog

    def dealt_over():
        return [int(n) for x in plan_of(catalog.QUERIES[name](spark, SF)) for n in re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", x)]

    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt_over() == [session]
    wanted = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    held = V.table(spark, SF, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(by_document, "TEXT_BYTES", held // 10)
    assert dealt_over() == [-(-held // (held // 10))] and dealt_over()[0] > session
    assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == wanted


def test_partitions_of_no_texts(spark):
    texts = spark.createDataFrame([(None,), ("",), ("ä",)], "text string")
    assert [by_document.partitions_of(x) for x in (texts.limit(0), texts.filter("text is null"), texts)] == [0, 0, 1]


def test_page_ranges_equal_one_pass(spark):
    some, big = random.Random(23), "9" * 25
    words = ["1", "2", "007", "10", "-", "-", "-", "12-34", "34-12", "5-5", "0-0", "00-1", "09-10", "1-2-3", "-4", "4-", "+1", "x-2", "", None, big, f"1-{big}", f"{big}-1", f"{big}-1{big}", f"0{big}-{big}", "9223372036854775807-9223372036854775808"]
    words += ["1-2\n", "2\n", f"{big}\n", "\u0661-\u0662"]
    rows = [(d, 2 * k, some.choice(words)) for d in (1, 2, None) for k in range(400)]
    rows += [(3, 4 * k + n, x) for k, (a, b) in enumerate([(a, b) for a in ("2", "2\n", "10", big, f"{big}\n") for b in ("2", "2\n", "10", big, f"{big}\n")]) for n, x in enumerate((a, "-", b, "|"))]
    wanted = set()
    for k, (d, idx, token) in enumerate(rows):
        one, two = [(rows + [(0, 0, None)] * 2)[k + n] for n in (1, 2)]
        number = lambda x: x is not None and re.search(r"^[0-9]+$", x)
        inside = token is not None and re.search(r"^([0-9]+)-([0-9]+)$", token)
        across = one[0] == two[0] == d and one[2] == "-" and number(token) and number(two[2]) and int(token) < int(two[2])
        if inside and int(inside[1]) < int(inside[2]) or across:
            wanted.add((d, idx))
    found = TF.with_page_ranges(spark.createDataFrame(rows, "doc_id long, tok_idx long, token string"))
    assert found.columns == ["doc_id", "tok_idx", "token", "is_page_range"]
    assert {(r["doc_id"], r["tok_idx"]) for r in found.collect() if r["is_page_range"]} == wanted
    assert {rows[k][2] for k in range(len(rows)) if rows[k][:2] in wanted} >= {"12-34", "00-1", "09-10", "1", f"1-{big}", f"{big}-1{big}", "9223372036854775807-9223372036854775808", "1-2\n"}
    # one window for each of the two tokens ahead, and longs before patterns
    plan = next(x for x in plan_of(found) if "Window [" in x)
    assert plan.count("lead(token") == 2
    told = next(x for x in plan_of(found) if "regexp_extract" in x)
    assert told.index("try_cast") < told.index("regexp_extract")


@tables
@pytest.mark.parametrize("limit", ["-1", None])
def test_runs_stay_where_they_are(spark, limit):
    """How large the phrases are is not known when the query is planned, and every run of tokens went to the partition of its text."""
    import __spark_entry__  # noqa: F401  (fills the registry)
    from foliograph.plans import catalog

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, limit or before)
    try:
        lines = plan_of(catalog.QUERIES["phrase_matches"](spark, SF))
    finally:
        spark.conf.set(name, before)
    words = next(k for k, x in enumerate(lines) if "Generate posexplode" in x)
    assert any("BroadcastHashJoin" in x for x in lines[:words]) and not any("Exchange" in x for x in lines[:words])


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_phrases_equal_one_pass(spark, longest):
    some = random.Random(longest)
    rows = [(d, k, some.choice(["Of", "the", "THE", "of", "with", ""])) for d in (1, 2, None) for k in range(300)] + [(3, 0, "with")]
    phrases = ["of the", "the of", "with", "with", "of the of the", "of", "Of", "the  with", "", None]
    wanted = []
    for k, (d, idx, _) in enumerate(rows):
        for n in range(1, longest + 1):
            run = rows[k : k + n]
            text = " ".join(w.lower() for _, _, w in run)
            if len(run) == n and run[-1][0] == d and text in phrases:
                wanted.append((d, idx, n, text))
    tokens = spark.createDataFrame(rows, "doc_id long, tok_idx long, token string")
    found = TF.phrase_matches(tokens, spark.createDataFrame([(x,) for x in phrases], "phrase string"), longest)
    assert found.columns == ["doc_id", "tok_idx", "n", "phrase"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def plain_elements(rows):
    """One token after the other: (doc, level, element, path, first, last, text, llx, ury)."""
    out, counts, last = [], {}, {}
    for doc, k, token, llx, ury, label in rows:
        parts = label.split(":")
        for level in range(1, len(parts) + 1):
            begins = any(x.startswith("^") for x in parts[:level])
            path = ":".join(x.lstrip("^") for x in parts[:level])
            e = last.get((doc, level))
            if e and not begins and e["path"] == path and e["last"] == k - 1:
                e["last"], e["tokens"], e["llx"], e["ury"] = k, e["tokens"] + [token], min(e["llx"], llx), max(e["ury"], ury)
            else:
                counts[doc, level] = counts.get((doc, level), 0) + 1
                last[doc, level] = {"doc": doc, "level": level, "n": counts[doc, level], "path": path, "first": k, "last": k, "tokens": [token], "llx": llx, "ury": ury}
                out.append(last[doc, level])
    return sorted((e["doc"], e["level"], e["n"], e["path"], e["first"], e["last"], " ".join(x for x in e["tokens"] if x is not None), e["llx"], e["ury"]) for e in out)


@pytest.mark.parametrize("batch", [1, 2, 7, 10_000])
def test_elements_equal_one_pass(spark, batch):
    some = random.Random(batch)
    labels = ["a", "a:x", "a:^x", "^a", "^a:x", "b:x:y", "b:x:^y", "b", "a:y", "b:^x:y"]
    rows = [(d, k, some.choice(["p", "q", None]), some.randrange(9), some.randrange(9), some.choice(labels)) for d in (1, 2, 5) for k in range(120) if some.random() > 0.1]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        frame = spark.createDataFrame(rows, "doc_id long, tok_idx long, token string, llx long, ury long, label string").withColumns({"lly": F.col("llx"), "urx": F.col("ury")})
        # a token without a label is in no element, and a document may have no number
        more = spark.createDataFrame([(7, 0, "x", 1, 1, None), (None, 0, "n", 1, None, "a")], "doc_id long, tok_idx long, token string, llx long, ury long, label string").withColumns({"lly": F.col("llx"), "urx": F.col("ury")})
        got = [tuple(r) for r in elements(frame.union(more)).select("doc_id", "level", "element", "path", "first_token", "last_token", "text", "llx", "ury").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (None, 1, 1, "a", 0, 0, "n", 1, None) in got
    assert sorted(x for x in got if x[0] is not None) == plain_elements(rows)


@tables
def test_elements_sort_tokens_once(spark):
    tokens = V.token(spark, SF).withColumn("label", F.lit("a:b"))
    lines = plan_of(elements(tokens))
    words = next(k for k, x in enumerate(lines) if "Generate posexplode" in x)
    assert sum("Sort [" in x for x in lines[:words]) == 1 and not any("Exchange" in x or "Aggregate" in x for x in lines[:words])


@tables
@pytest.mark.parametrize("name, least", [("spread_labels", 1), ("predicted_features", 1), ("phantom_tokens", 1)])
def test_tokens_that_are_joined_keep_their_partitions(spark, name, least):
    from foliograph.plans import catalog

    lines = plan_of(catalog.QUERIES[name](spark, SF))
    words = next(k for k, x in enumerate(lines) if "Generate posexplode" in x)
    assert sum("REPARTITION_BY_NUM" in x for x in lines[:words]) == least and any("SortMergeJoin" in x or "BroadcastHashJoin" in x for x in lines)


def test_spread_labels(spark):
    from foliograph.operators import body as B

    tokens = spark.createDataFrame([(1, k, k // 3) for k in range(9)] + [(2, 0, 0)], "doc_id long, tok_idx long, line_idx long")
    lines = spark.createDataFrame([(1, 0, "p-begin--x"), (1, 1, "notext"), (2, 0, "s-begin")], "doc_id long, line_idx long, label string")
    got = {(r["doc_id"], r["tok_idx"]): r["label"] for r in B.token_body_labels(tokens, lines).collect()}
    assert got == {(1, 0): "p-begin--x", (1, 1): "p-inside", (1, 2): "p-inside", **{(1, k): "notext" for k in (3, 4, 5)}, (2, 0): "s-begin"}


def test_labels_come_to_tokens_by_document(spark):
    tokens = spark.createDataFrame([(1, 0, 0), (1, 1, 5), (1, 2, 9), (2, 0, 0), (None, 0, 3)], "doc_id long, tok_idx long, start long")
    spans = spark.createDataFrame([(1, "in", 5, 6), (1, "out", 5, 9), (1, None, 0, 0), (None, "x", 0, 9)], "doc_id long, label string, start long, stop long")
    found = P.token_labels(tokens, spans)
    assert {(r["doc_id"], r["tok_idx"]): r["label"] for r in found.collect()} == {(1, 0): "", (1, 1): "out:in", (1, 2): "out", (2, 0): "O", (None, 0): "O"}
    assert sum("tok_idx" in x and "Exchange" in x for x in plan_of(found)) <= 1


def test_broken_words_by_a_window(spark):
    words = [("re-", 0), ("port", 1), ("Report", 1), ("ab-", 1), ("cd", 2), ("in-", 2), ("put", 3)]
    rows = [(d, k, line, w) for d in (1, None) for k, (w, line) in enumerate(words)]
    tokens = spark.createDataFrame(rows, "doc_id long, tok_idx long, line_idx long, token string")
    found = T.dehyphenated(tokens, spark.createDataFrame([("input",)], "word string"))
    assert sorted((str(r["doc_id"]), r["tok_idx"], r["lhs"], r["rhs"], r["joined"], r["word"]) for r in found.collect()) == sorted(
        (str(d), k, a, b, j, w) for d in (1, None) for k, a, b, j, w in [(0, "re", "port", d == 1, "report" if d else "re-port"), (3, "ab", "cd", False, "ab-cd"), (5, "in", "put", True, "input")]
    )
    assert not any("LeftSemi" in x for x in plan_of(found))


def test_in_all(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (0, "b"), (0, "b"), (1, "c"), (None, "b"), (0, None), (1, None)], "k long, w string")
    found = P.in_all(rows, "w", F.col("k") == 0, F.col("k") == 1)
    assert sorted(str(r["w"]) for r in found.collect()) == ["None", "a"]
    assert not any("Join" in x for x in plan_of(found))


def test_references_are_read_once_and_equal_xpath(spark):
    from foliograph.operators import linking as L

    texts = [
        '<reference refID="r1"><ref-marker>[1]</ref-marker><authors><author><author-last>A&amp;B</author-last></author><author><author-last>C<i>d</i>e</author-last></author></authors><title>On <b>two</b> <!-- x -->things</title><date>1999</date><date/><date>2000<!-- y -->a</date></reference>',
        '<reference><title>first</title><title>second</title><x><title>no</title></x><number> 7 </number><authors><author-last>no</author-last></authors></reference>',
        '<?xml version="1.0"?><reference refID=""><pages><![CDATA[1<2]]></pages><volume/><date>\n</date><journal>Zeitschrift für &#228;</journal></reference>',
        "<other><reference><title>deep</title></reference><title>t</title></other>",
        None,
    ]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, xml string")
    one = lambda path: F.xpath_string(F.col("xml"), F.lit(f"/reference/{path}"))
    names = ["ref-marker", "title", "conference", "journal", "volume", "number", "pages"]
    wanted = frame.select("doc_id", F.when(one("@refID") != "", one("@refID")).otherwise("-1").alias("ref_id"), *[one(n).alias(n.replace("-", "_")) for n in names], F.xpath("xml", F.lit("/reference/authors/author/author-last/text()")).alias("authors"), F.xpath("xml", F.lit("/reference/date/text()")).alias("dates"))
    found = L.parsed_references(frame)
    assert found.columns == wanted.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert not any("xpath" in x for x in plan_of(found))


def test_rungs_of_pairs_are_told_once(spark):
    from foliograph.operators import name_matching as N

    authors = spark.createDataFrame([(1, 0, "Ann", "", "Lee"), (1, 1, "Bo", "C", "Dahl")], "doc_id long, author_no long, first string, middle string, last string")
    emails = spark.createDataFrame([(1, 0, "alee", "@x.edu"), (1, 1, "bcdahk", "@x.edu")], "doc_id long, email_no long, name string, domain string")
    found = N.matches(authors, emails)
    assert {(r["author_no"], r["email_no"], r["kind"]) for r in found.collect()} >= {(0, 0, "EXACT")}
    assert not any("Join" in x and ("aggregate" in x or "array_contains" in x) for x in plan_of(found))


@tables
@pytest.mark.parametrize("name", ["line_lexical_v2", "line_layout_v2"])
def test_patterns_are_looked_for_once_and_behind_the_shuffle(spark, name):
    import __spark_entry__  # noqa: F401  (fills the registry)
    from foliograph.plans import catalog

    lines = plan_of(catalog.QUERIES[name](spark, SF))
    dealt = [k for k, x in enumerate(lines) if "REPARTITION_BY_NUM" in x]
    assert len(dealt) == 1 and sum("Exchange" in x for x in lines) == 1 and not any("Join" in x for x in lines)
    assert any("containsYear" in x for x in lines[: dealt[0]]) and not any("containsYear" in x for x in lines[dealt[0] :])


def test_ranks_of_widths_and_distances(spark):
    from foliograph.operators import line_features as L

    widths, drops = [50, 40, 40, 50, 9, 60, 9, 9], [10, 12, 12, 10, 10, 15, 0, 10]
    rows = [(d, k, 0, 0, 900 - sum(drops[:k]), w, 0, 1 + k % 2, ["beginBrackets"] if k < 2 else []) for d in (1, None) for k, w in enumerate(widths)]
    found = L.with_layout_features_v2(spark.createDataFrame(rows, "doc_id long, line_idx long, page long, llx long, lly long, urx long, ury long, font long, features array<string>"))
    got = {(r["doc_id"], r["line_idx"]): (r["width_rank"], r["vertical"], r["uses_ref_font"]) for r in found.collect()}
    # of widths 50 is seen before 40, and 9 is no width; distances are 10, 12, 15, the last line and the one at equal height have none
    assert [got[1, k] for k in range(8)] == [(1, None, True), (2, "space", False), (2, "space", True), (1, None, False), (None, None, True), (3, "outlier", False), (None, None, True), (None, None, False)]
    assert {got[None, k] for k in range(8)} == {(None, None, False)}
