"""Readers of page XML, manifests, labelled lines, feature lines, dictionaries and truth files.

Text formats are read with ``spark.read.text`` and taken apart by expressions. Where the order
of lines matters across a file, a file is one row (``wholetext``), so its lines stay together
and files are the unit of parallel work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT, _TEXT = T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: The page XML of the text extractor.
PAGE_XML = _struct(
    fonts=_struct(font=T.ArrayType(_struct(_n=_INT, _name=_TEXT, _h=T.DoubleType()))),
    page=T.ArrayType(_struct(_n=_INT, line=T.ArrayType(_struct(tbox=T.ArrayType(_struct(_llx=_INT, _lly=_INT, _urx=_INT, _ury=_INT, _f=_INT, _VALUE=_TEXT)))))),
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``in -> out`` lines as two columns; lines without the arrow are left out."""
    parts = F.split("value", "->")
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("input"), F.trim(parts[1]).alias("output"))


def present(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows whose input is among the listed files, and a message for each that is missing, which is skipped."""
    have = files.select(F.col("path").alias("input")).distinct()
    missing = wanted.join(have, "input", "left_anti").select(F.col("input").alias("doc_id"), F.lit("error").alias("level"), F.lit("missing input").alias("message"))
    return wanted.join(have, "input", "left_semi"), missing


def in_list_order(files: DataFrame, names: DataFrame) -> DataFrame:
    """The listed files that ``names`` (line_no, value) has, in its order; of a name listed twice the first line counts."""
    first = names.groupBy(F.col("value").alias("path")).agg(F.min("line_no").alias("line_no"))
    return files.join(first, "path").orderBy("line_no")


def listed(spark: SparkSession, folder: str, glob: str = "*.xml", recursive: bool = True) -> DataFrame:
    """Files below a folder with their size and time; contents are not read unless used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "modificationTime", "length")


def shuffled(files: DataFrame, seed: int, limit: int | None = None) -> DataFrame:
    """Files in an order that a seed fixes, whatever their partitions; the first ``limit`` of them."""
    ordered = files.orderBy(F.xxhash64(F.lit(seed), "path"), "path")
    return ordered if limit is None else ordered.limit(limit)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Parsed page documents: path, fonts and page. Blanks in boxes stay, they matter to the lexer; broken files have null pages."""
    reader = spark.read.format("xml").schema(PAGE_XML).option("rowTag", "document").option("ignoreSurroundingSpaces", "false").option("mode", "PERMISSIVE")
    return reader.load(path).withColumn("path", F.input_file_name())


def boxes(documents: DataFrame) -> DataFrame:
    """One row for each text box: path, page, global line number, box number, place, font and text."""
    page = documents.select("path", F.posexplode("page").alias("page_no", "p"))
    line = page.select("path", "page_no", F.posexplode("p.line").alias("line_no", "l"))
    box = line.select("path", "page_no", "line_no", F.posexplode("l.tbox").alias("box_no", "b"))
    order = Window.partitionBy("path").orderBy("page_no", "line_no")
    return box.select(
        "path",
        "page_no",
        (F.dense_rank().over(order) - 1).alias("line_idx"),
        "box_no",
        *[F.col(f"b._{c}").alias(c) for c in ("llx", "lly", "urx", "ury")],
        F.col("b._f").alias("font"),
        F.translate("b._VALUE", "­", "-").alias("text"),
    )


def box_lines(found: DataFrame) -> DataFrame:
    """Lines from boxes: joined text, the box around them, the first box's font."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_no", "text"))), lambda x: x["text"]), "")
    first = F.min_by("font", "box_no")
    return found.groupBy("path", "page_no", "line_idx").agg(text.alias("text"), F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"), first.alias("font"))


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value, instance): instances are what blank lines part."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    lines = whole.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("line_no", "value"))
    blank = F.col("value").rlike(r"^\s*$")
    instance = F.sum(blank.cast("int")).over(Window.partitionBy("path").orderBy("line_no"))
    return lines.withColumn("instance", instance).withColumn("_blank", blank)


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """Labelled line records. The fields follow the last ``@``; an instance that no blank line ends is dropped."""
    lines = _file_lines(spark, path)
    closed = F.sum(F.col("_blank").cast("int")).over(Window.partitionBy("path"))
    fields = F.split(F.regexp_extract("value", "^(.*)@([^@]*)$", 2), ",")
    number = lambda k: F.get(fields, F.lit(k)).try_cast("int")
    kept = lines.withColumn("_n", closed).filter("not _blank and instance < _n")
    names = ("page", "llx", "lly", "urx", "ury", "font")
    return kept.select(
        "path",
        "instance",
        "line_no",
        F.regexp_extract("value", "^(.*)@([^@]*)$", 1).alias("text"),
        *[number(k).alias(n) for k, n in enumerate(names)],
        (F.get(fields, F.lit(6)) == "true").alias("multibox"),
        (F.get(fields, F.lit(7)) == "true").alias("new_ref"),
        F.get(fields, F.lit(8)).alias("label"),
    )


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Feature records: features and, last on the line, the label. Lines that start with ``#`` are comments."""
    words = F.split(F.trim("value"), r"\s+")
    lines = _file_lines(spark, path).filter(~F.col("_blank") & ~F.startswith("value", F.lit("#")))
    return lines.select("path", "instance", "line_no", F.slice(words, 1, F.size(words) - 1).alias("features"), F.element_at(words, -1).alias("label"))


def paired_lists(sources: DataFrame, annotations: DataFrame) -> DataFrame:
    """Two lists of file names (path, line_no, value) joined by line number; of a source named twice the last pair stays."""
    both = sources.select("line_no", F.col("value").alias("source")).join(annotations.select("line_no", F.col("value").alias("annotation")), "line_no")
    return both.groupBy("source").agg(F.max_by("annotation", "line_no").alias("annotation"))


def paired_folders(left: DataFrame, right: DataFrame, left_suffix: str, right_suffix: str, roots: tuple[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Files of two listings that share a name but for their suffixes; files without the suffix are left out.

    With ``roots``, the folders listed, the shared name is the path below them. A file without
    a partner has a null beside it, or fails the job where ``strict``.
    """

    def side(files: DataFrame, suffix: str, root: str | None, name: str) -> DataFrame:
        whole = F.substring("path", F.lit(1), F.length("path") - len(suffix))
        stem = F.substring_index(whole, "/", -1) if root is None else F.substring_index(whole, f"{root.rstrip('/')}/", -1)
        return files.filter(F.endswith("path", F.lit(suffix))).select(stem.alias("stem"), F.col("path").alias(name))

    a, b = (side(f, x, root, name) for f, x, root, name in zip((left, right), (left_suffix, right_suffix), roots or (None, None), ("left_path", "right_path")))
    both = a.join(b, "stem", "full_outer")
    if not strict:
        return both
    alone = F.raise_error(F.concat(F.lit("no partner of "), F.coalesce("left_path", "right_path")))
    paired = F.when(F.col("left_path").isNotNull() & F.col("right_path").isNotNull(), F.col("left_path")).otherwise(alone)
    return both.withColumn("left_path", paired)


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Texts between separators, without the blank ones."""
    body = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path, lineSep=separator).select(body.alias("text")).filter("text <> ''")


def institutions(spark: SparkSession, path: str) -> DataFrame:
    """``domain;;name;;address`` lines. Of a domain listed twice the last stays; a leading ``www.`` is dropped; short lines are left out."""
    parts = F.split("value", ";;")
    lines = _file_lines(spark, path).filter(~F.col("_blank") & ~F.startswith("value", F.lit("#")) & (F.size(parts) >= 3))
    rows = lines.select("path", "line_no", F.regexp_replace(F.trim(parts[0]), "^www[.]", "").alias("domain"), F.struct(F.trim(parts[1]).alias("name"), F.trim(parts[2]).alias("address")).alias("v"))
    return rows.groupBy("domain").agg(F.max_by("v", F.struct("path", "line_no")).alias("v")).select("domain", "v.name", "v.address")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Author, e-mail and institution triples of a truth CSV: no quoting, ``;`` in a cell stands for a comma, trailing empty cells are cut."""
    cells = F.split(F.regexp_replace("value", ",+$", ""), ",")
    lines = _file_lines(spark, path).filter("line_no > 0 and not _blank").withColumn("_cells", cells)
    lines = lines.withColumn("_k", F.explode(F.filter(F.sequence(F.lit(0), F.size("_cells")), lambda k: 3 * k + 4 < F.size("_cells"))))
    cell = lambda k: F.replace(F.get("_cells", 2 + 3 * F.col("_k") + k), F.lit(";"), F.lit(","))
    return lines.select(F.get("_cells", F.lit(0)).alias("filename"), (F.lower(F.get("_cells", F.lit(1))) == "true").alias("applicable"), cell(0).alias("author"), cell(1).alias("email"), cell(2).alias("institute"))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """``key = value`` lines of info files."""
    at = F.instr("value", "=")
    return spark.read.text(path).withColumn("path", F.input_file_name()).filter(at > 1).select("path", F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("value"))


#: Shape of a header with its links as attributes.
HEADER_XML = "_id long, author array<struct<_id: long, _email: string, _institution: long, first: string, last: string>>, email array<struct<_id: long, address: string>>, institution array<struct<_id: long, name: string>>"


def linked_authors(spark: SparkSession, path: str) -> DataFrame:
    """Authors of headers written with link attributes: doc_id, author_id, first, last, email, how, inst_id, institution, the links followed; null where there is none."""
    headers = spark.read.format("xml").schema(HEADER_XML).option("rowTag", "document").load(path)
    each = headers.select(F.col("_id").alias("doc_id"), F.explode("author").alias("a"), F.coalesce("email", F.array()).alias("emails"), F.coalesce("institution", F.array()).alias("places"))
    number = F.substring_index("a._email", "-", 1).cast("long")
    how = F.when(F.contains("a._email", F.lit("-")), F.regexp_extract("a._email", "^[^-]*-(.*)$", 1))
    one = lambda rows, key, value: F.get(F.filter(rows, lambda x: x["_id"] == key), F.lit(0))[value]
    return each.select("doc_id", F.col("a._id").alias("author_id"), "a.first", "a.last", one("emails", number, "address").alias("email"), how.alias("how"), F.col("a._institution").alias("inst_id"), one("places", F.col("a._institution"), "name").alias("institution"))
