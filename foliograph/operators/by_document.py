"""Passes over the lines of one document after the other, many documents to a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of text in a partition of lines that become words: a million words or so, which take about a hundred MB to sort.
TEXT_BYTES = 8 << 20


def dealt(rows: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Rows dealt by keys over as many partitions as spark.sql.shuffle.partitions says, or over ``least`` if that is more.

    Partitions of a join's own shuffle are merged by their size on disk, which for tokens is a tenth of what sorting them takes; these are not.
    """
    return rows.repartition(max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def partitions_of(texts: DataFrame, text: str = "text") -> int:
    """How many partitions of ``TEXT_BYTES`` the texts fill. A pass over their lengths, which runs at once."""
    return -(-(texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) // TEXT_BYTES)


def passed(rows: DataFrame, told: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str, key: str = "doc_id", order: str = "line_idx") -> DataFrame:
    """What ``told`` makes of whole documents in order: it gets the rows of some and where each begins and ends among them.

    A frame for each document costs far more than its lines do, so documents share Arrow batches. One that
    goes beyond its batch waits for its last row. Rows without a key are left out.
    """

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if frame.empty:
                continue
            keys = frame[key].to_numpy()
            new = np.flatnonzero(keys[1:] != keys[:-1])
            first = int(new[-1]) + 1 if len(new) else 0  # of the last document, which may go on
            if first or held and held[0][key].iloc[-1] != keys[0]:
                yield cut([*held, frame.iloc[:first]])
                held = []
            held.append(frame.iloc[first:])
        if held:
            yield cut(held)

    def cut(frames: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)
        keys = frame[key].to_numpy()
        at = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        return told(frame, list(zip(at, at[1:])))

    return rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order)).mapInPandas(whole, schema)
