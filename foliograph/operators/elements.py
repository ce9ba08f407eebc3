"""Nested elements of label paths, in one pass over the tokens of documents in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOX = {"llx": np.minimum, "lly": np.minimum, "urx": np.maximum, "ury": np.maximum}


def _levels(labels: list[str]) -> list[tuple[np.ndarray, list[str | None]]]:
    """For each level whether a label begins there or above, and the path down to it; None for labels that do not reach it."""
    parts = [x.split(":") for x in labels]
    out = []
    for k in range(1, max(map(len, parts), default=0) + 1):
        begins = np.array([any(x.startswith("^") for x in p[:k]) for p in parts])
        out.append((begins, [":".join(x.removeprefix("^") for x in p[:k]) if len(p) >= k else None for p in parts]))
    return out


def _least(column: pa.ChunkedArray, starts: np.ndarray, function: np.ufunc) -> pa.Array:
    """The least or the largest value from each start to the next; null where all are null."""
    kind = column.type.to_pandas_dtype()
    info = np.iinfo(kind) if np.issubdtype(kind, np.integer) else np.finfo(kind)
    last = info.max if function is np.minimum else info.min
    held = np.add.reduceat(column.is_valid().to_numpy().astype(np.int64), starts)
    return pa.array(function.reduceat(column.fill_null(last).to_numpy(), starts), mask=held == 0)


def elements(labelled: DataFrame) -> DataFrame:
    """Nested elements of label paths: one row for each element with its level, path, tokens, text and box.

    ``labelled`` has doc_id, tok_idx, token, a box and ``label``, a path like ``authors:^name``;
    a caret marks the token at which an element of that level begins anew. An element goes on
    while the next token has the same path down to its level and no caret there or above.
    Tokens are sorted once; Arrow batches are cut where an element of the first level ends, so that
    what waits for the next batch is one such element.
    """
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    before = F.lag("tok_idx").over(order)
    kept = labelled.filter(F.col("label").isNotNull()).select("doc_id", "tok_idx", "token", "label", *BOX, before.isNull().alias("_first"), F.coalesce(before == F.col("tok_idx") - 1, F.lit(False)).alias("_follows"))
    of = dict(kept.dtypes)
    schema = f"doc_id {of['doc_id']}, level int, element long, path string, first_token {of['tok_idx']}, last_token {of['tok_idx']}, text string, " + ", ".join(f"{c} {of[c]}" for c in BOX)

    def found(table: pa.Table, counts: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """The elements of rows that begin with one of the first level; ``counts`` are those of the last document before, by level."""
        label = table["label"].combine_chunks().dictionary_encode()
        labels, code = label.dictionary.to_pylist(), label.indices.to_numpy()
        tokens, follows, first = table["token"].to_pylist(), table["_follows"].to_numpy(), table["_first"].to_numpy()
        document = np.cumsum(first)
        after = dict.fromkeys(counts, 0) if document[-1] else counts.copy()
        for level, (begins, paths) in enumerate(_levels(labels), 1):
            names = {x: k for k, x in enumerate(dict.fromkeys(paths))}
            path = np.array([names[x] for x in paths])[code]
            goes_on = follows & ~begins[code]
            goes_on[0] = False
            goes_on[1:] &= path[1:] == path[:-1]
            starts = np.flatnonzero(~goes_on)
            ends = np.append(starts[1:], len(code))
            box = [_least(table[c], starts, f) for c, f in BOX.items()]
            some = np.flatnonzero([paths[k] is not None for k in code[starts]])
            if not len(some):
                continue
            of_document = document[starts[some]]
            fresh = np.flatnonzero(np.append(True, of_document[1:] != of_document[:-1]))
            element = np.arange(len(some)) - np.repeat(fresh, np.diff(np.append(fresh, len(some)))) + 1
            element = element + np.where(of_document == 0, counts.get(level, 0), 0)
            if of_document[-1] == document[-1]:
                after[level] = int(element[-1])
            at, to = starts[some], ends[some]
            text = [" ".join([x for x in tokens[a:b] if x is not None]) for a, b in zip(at.tolist(), to.tolist())]
            of_label = np.array(paths, dtype=object)[code[at]]
            tok_idx = table["tok_idx"].combine_chunks()
            columns = [table["doc_id"].combine_chunks().take(pa.array(at)), pa.array(np.full(len(at), level, np.int32)), pa.array(element, pa.int64()), pa.array(of_label, pa.string()), tok_idx.take(pa.array(at)), tok_idx.take(pa.array(to - 1)), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [x.take(pa.array(some)) for x in box], ["doc_id", "level", "element", "path", "first_token", "last_token", "text", *BOX])
        counts.clear()
        counts.update(after)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        counts: dict[int, int] = {}
        last = None  # the label of the row before, down to the first level
        for batch in batches:
            if not batch.num_rows:
                continue
            top = pc.list_element(pc.split_pattern(batch.column("label"), ":", max_splits=1), 0)
            bare = pc.replace_substring_regex(top, r"^\^", "").to_pylist()
            anew = ~batch.column("_follows").to_numpy(zero_copy_only=False) | pc.starts_with(top, "^").to_numpy(zero_copy_only=False)
            cuts = anew | np.array([x != y for x, y in zip(bare, [last, *bare])])
            at = np.flatnonzero(cuts)
            if held and len(at):
                yield from found(pa.Table.from_batches([*held, batch.slice(0, at[0])]), counts)
                held, batch, at = [], batch.slice(at[0]), at - at[0]
            if len(at) > 1:
                yield from found(pa.Table.from_batches([batch.slice(0, at[-1])]), counts)
                batch = batch.slice(at[-1])
            held.append(batch)
            last = bare[-1]
        if held:
            yield from found(pa.Table.from_batches(held), counts)

    # the window has dealt and sorted them so already
    return kept.sortWithinPartitions("doc_id", "tok_idx").mapInArrow(passed, schema)
