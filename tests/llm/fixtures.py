"""Small tables with awkward rows."""

LONG = "lorem ipsum dolor sit amet " * 20_000


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string{extra}")


def awkward(spark):
    """Null, empty, blank, very long and repeated rows, null ids and sources, a clashing extra column."""
    rows = [
        (1, "A plain sentence, nothing more.", "en", "a", 9.5),
        (1, "A plain sentence, nothing more.", "en", "a", 9.5),
        (2, None, None, None, None),
        (3, "", "en", "b", 0.0),
        (4, " \n\t ", "xx", "b", 0.0),
        (None, "No id here at all, is there?", "de", None, 1.0),
        (None, "No id here at all, is there?", "de", None, 1.0),
        (5, LONG, "en", "a", 1.0),
        (6, "Ünïcödé 😀 text with accents é and ß", "fr", "c", 1.0),
    ]
    return documents(spark, rows, ", score double")


def save(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
