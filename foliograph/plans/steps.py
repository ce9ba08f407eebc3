"""Steps over document frames with a status: what fails in one step skips the rest and goes through the error steps.

A step is a function from a frame to a frame that keeps the rows and may set ``status`` and
``message`` by ``failed`` and ``warned``. Steps are lazy: a whole chain is one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, WARNING, ABORT = "ok", "warning", "abort"
Step = Callable[[DataFrame], DataFrame]


def started(documents: DataFrame) -> DataFrame:
    """The documents with an ok status and no messages."""
    return documents.withColumn("status", F.lit(OK)).withColumn("messages", F.array().cast("array<string>"))


def _marked(documents: DataFrame, when: Column, status: str, message: str) -> DataFrame:
    hit = F.coalesce(when, F.lit(False))
    return documents.withColumn("messages", F.when(hit, F.concat("messages", F.array(F.lit(message)))).otherwise(F.col("messages"))).withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def failed(documents: DataFrame, when: Column, message: str) -> DataFrame:
    """Rows where the condition holds are given up, with a message."""
    return _marked(documents, when & (F.col("status") != ABORT), ABORT, message)


def warned(documents: DataFrame, when: Column, message: str) -> DataFrame:
    """Rows where the condition holds go on, with a message."""
    return _marked(documents, when & (F.col("status") == OK), WARNING, message)


def run(documents: DataFrame, standard: Iterable[Step], on_error: Iterable[Step] = (), epilogue: Iterable[Step] = ()) -> DataFrame:
    """Standard steps for what has not been given up, error steps for what has, then the epilogue for all; steps keep the columns but those they add everywhere."""
    rows, given_up = started(documents), None
    for step in standard:
        rows = step(rows)
    good, bad = rows.filter(F.col("status") != ABORT), rows.filter(F.col("status") == ABORT)
    for step in on_error:
        bad = step(bad)
        given_up = bad
    whole = good.unionByName(given_up if given_up is not None else bad, allowMissingColumns=True)
    for step in epilogue:
        whole = step(whole)
    return whole


#: Segmenters of journals with a layout of their own, by the journal's name.
JOURNALS: dict[str, Step] = {}


def journal(name: str):
    """Register the segmenter of a journal."""

    def add(step: Step) -> Step:
        JOURNALS[name] = step
        return step

    return add


def segmented(lines: DataFrame, name: str | None, default: Step) -> DataFrame:
    """The lines through the journal's segmenter, or the default for a journal without one."""
    return JOURNALS.get(name, default)(lines)
