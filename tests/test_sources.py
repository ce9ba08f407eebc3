"""Readers and writers on files written here."""

from pyspark.sql import functions as F

import pytest

from foliograph.operators import tokens as T
from foliograph.sources import readers as R
from foliograph.sources import writers as W
from foliograph.streaming import jobs as J

XML = """<document><fonts><font n="1" name="Times" h="10.0"/></fonts>
<page n="1"><line><tbox llx="10" lly="700" urx="50" ury="712" f="1">In the </tbox><tbox llx="50" lly="700" urx="90" ury="712" f="1">soft­hy</tbox></line>
<line><tbox llx="10" lly="680" urx="40" ury="690" f="2">second</tbox></line></page>
<page n="2"><line><tbox llx="10" lly="700" urx="40" ury="710" f="1">third</tbox></line></page></document>"""


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_page_xml(spark, tmp_path):
    write(tmp_path, "a.xml", XML)
    found = R.box_lines(R.boxes(R.pages(spark, str(tmp_path)))).orderBy("line_idx").collect()
    assert [(r["line_idx"], r["text"], r["llx"], r["urx"], r["font"]) for r in found] == [(0, "In the soft-hy", 10, 90, 1), (1, "second", 10, 40, 2), (2, "third", 10, 40, 1)]


def test_labelled_lines(spark, tmp_path):
    text = "a@b c@0,1,2,3,4,5,true,false,biblio\nplain@1,1,2,3,4,5,false,true,pre\n\nlost@1,1,2,3,4,5,false,true,junk\n"
    got = R.labelled_lines(spark, write(tmp_path, "x.txt", text)).orderBy("line_no").collect()
    # the last line feed is an empty last line, which ends the second instance
    assert [(r["instance"], r["text"], r["page"], r["multibox"], r["new_ref"], r["label"]) for r in got] == [(0, "a@b c", 0, True, False, "biblio"), (0, "plain", 1, False, True, "pre"), (1, "lost", 1, False, True, "junk")]
    open_end = R.labelled_lines(spark, write(tmp_path, "y.txt", text.rstrip("\n")))
    assert open_end.count() == 2


def test_small_formats(spark, tmp_path):
    m = R.manifest(spark, write(tmp_path, "m", "a.xml -> b.xml\nbroken\n")).collect()
    assert [tuple(r) for r in m] == [("a.xml", "b.xml")]
    f = R.feature_lines(spark, write(tmp_path, "f", "# c\nx y LAB\n\nz LAB2")).orderBy("line_no").collect()
    assert [(r["instance"], r["features"], r["label"]) for r in f] == [(0, ["x", "y"], "LAB"), (1, ["z"], "LAB2")]
    r = R.records(spark, write(tmp_path, "r", "one\n<NEWREFERENCE>\ntwo\n<NEWREFERENCE>\n"), "<NEWREFERENCE>")
    assert sorted(x["text"] for x in r.collect()) == ["one", "two"]
    d = R.institutions(spark, write(tmp_path, "d", "# c\nwww.x.edu;;X;;Here\nx.edu;;X2;;There\nbad;;line\n")).collect()
    assert [tuple(x) for x in d] == [("x.edu", "X2", "There")]
    t = R.truth(spark, write(tmp_path, "t", "Filename,applicable\np1,true,Doe J.,j@x.edu,Univ; X,Roe R.,r@x.edu,\n")).collect()
    assert [tuple(x) for x in t] == [("p1", True, "Doe J.", "j@x.edu", "Univ, X")]
    s = R.sidecar(spark, write(tmp_path, "s", "CitationType = NUMERICAL_BRACKETS\nnothing\n")).collect()
    assert [(x["key"], x["value"]) for x in s] == [("CitationType", "NUMERICAL_BRACKETS")]


def test_folders(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "r").mkdir()
    for name in ("l/a.xml", "l/b.xml", "r/a.ann"):
        write(tmp_path, name, "x")
    left, right = R.listed(spark, str(tmp_path / "l")), R.listed(spark, str(tmp_path / "r"), "*.ann")
    pairs = {r["stem"]: r["right_path"] is not None for r in R.paired_folders(left, right, ".xml", ".ann").collect()}
    assert pairs == {"a": True, "b": False}
    with pytest.raises(Exception, match="no partner"):
        R.paired_folders(left, right, ".xml", ".ann", strict=True).collect()
    (tmp_path / "l" / "c").mkdir()
    write(tmp_path, "l/c/a.xml", "x")
    write(tmp_path, "l/a.xmlx", "x")
    deep = R.paired_folders(R.listed(spark, str(tmp_path / "l"), "*"), right, ".xml", ".ann", (str(tmp_path / "l"), str(tmp_path / "r")))
    assert sorted((r["stem"], r["right_path"] is not None) for r in deep.collect()) == [("a", True), ("b", False), ("c/a", False)]
    first = [r["path"] for r in R.shuffled(left, 7).collect()]
    assert first == [r["path"] for r in R.shuffled(left.repartition(3), 7).collect()]
    assert R.shuffled(left, 7, 1).count() == 1


def test_writers(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, "A", "x"), (1, 1, "B", "x"), (1, 2, "C", "y"), (1, 3, "D", "x")], "doc_id long, tok_idx long, token string, label string")
    assert [(r["first"], r["label"], r["text"]) for r in W.fields(tokens).orderBy("first").collect()] == [(0, "x", "A B"), (2, "y", "C"), (3, "x", "D")]
    assert W.inline_tags(tokens).first()["text"] == "<x> A B </x>\n<y> C </y>\n<x> D </x>"
    lines = spark.createDataFrame([(1, "header", None, 0, "T"), (1, "reference", 2, 1, "R")], "doc_id long, kind string, ref_no int, line_idx int, text string")
    W.segmented_text(lines, str(tmp_path / "seg"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "seg")).collect()) == ["h: T", "r2: R"]
    log = spark.createDataFrame([(1, "error", "no header")], "doc_id long, level string, message string")
    W.log(log, str(tmp_path / "log"))
    W.log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("level = 'error'").count() == 2
    W.spans(spark.createDataFrame([(1, "a", 0, 3)], "doc_id long, label string, start int, stop int"), str(tmp_path / "spans"))
    W.summary(log, str(tmp_path / "sum"))
    assert spark.read.text(str(tmp_path / "sum")).first()["value"] == "1;error;no header"
    W.annotated_xml(lines.select("doc_id", F.struct("kind", "text").alias("section")), str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "document").load(str(tmp_path / "xml")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    J.run_batches(J.new_files(spark, str(tmp_path / "in"), events.schema, 2), lambda df, n: seen.append(df.count()), str(tmp_path / "state"))
    assert sum(seen) == 100 and len(seen) == 2
    again = []
    J.run_batches(J.new_files(spark, str(tmp_path / "in"), events.schema, 2), lambda df, n: again.append(n), str(tmp_path / "state"))
    assert not again
    assert J.window_counts(events, "10 minutes").agg(F.sum("n")).first()[0] == 100
    assert J.sessions(events, "2 minutes").count() == 100
    assert J.sessions(events, "5 minutes").count() == 3


def test_lexer(spark):
    lines = spark.createDataFrame([(1, 0, "Dr. J. Smith's  3rd e-mail: a@b.co (x) Ph.D.")], "doc_id long, line_idx long, text string")
    assert [r["token"] for r in T.lexed(lines).orderBy("pos").collect()] == ["Dr", ".", "J.", "Smith", "'", "s", "3rd", "e", "-", "mail", ":", "a@b.co", "(", "x", ")", "Ph.D."]


def test_linked_headers_come_back(spark, tmp_path):
    authors = spark.createDataFrame([(1, 0, "A", "B & <C>", 1, 0, "whole"), (1, 1, "D", "E", None, None, None), (2, 0, "F", "G", 0, None, None), (3, 0, "H", "I", 7, 9, "part")], "doc_id long, author_id long, first string, last string, email_id long, inst_id long, how string")
    emails = spark.createDataFrame([(1, 0, "x@y.z"), (1, 1, "b@c.d"), (2, 0, "f@g.h"), (4, 0, "k@l.m")], "doc_id long, email_id long, email string")
    institutions = spark.createDataFrame([(1, 0, "Uni \"Q\"")], "doc_id long, inst_id long, name string")
    headers = W.linked_headers(authors, emails, institutions)
    assert headers.count() == 4
    path = str(tmp_path / "headers")
    W.annotated_xml(headers, path)
    assert 'email="1-whole"' in "".join(p.read_text() for p in (tmp_path / "headers").glob("part*"))
    got = sorted((tuple(r) for r in R.linked_authors(spark, path).collect()), key=lambda r: r[:2])
    assert got == [
        (1, 0, "A", "B & <C>", "b@c.d", "whole", 0, 'Uni "Q"'),
        (1, 1, "D", "E", None, None, None, None),
        (2, 0, "F", "G", "f@g.h", None, None, None),
        (3, 0, "H", "I", None, "part", 9, None),
    ]
