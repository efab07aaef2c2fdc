"""Where the records of a JSON array lie, for files that are read in splits.

Rows are `(file_path, file_block_start, value)`: the text up to each closing brace, in
the order of the file. Outside strings valid JSON holds no backslash, so escapes can be
skipped before it is known whether a split starts inside a string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

OUTLINE = "file string, start long, quotes int, depth0 long, low0 long, depth1 long, low1 long"
PARTS = "file string, start long, origin long, text string"
_MARKS = re.compile(r'\\.|["{}\[\]]', re.S)
ROWS_PER_BATCH = 2_000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield (file, start), value + "}"


def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: the parity of its quotes and, if it starts outside (0) or inside (1) a string, its change of depth and lowest depth."""
    found: dict[tuple[str, int], list[int]] = {}
    for split, text in _rows(batches):
        state = found.setdefault(split, [0, 0, 0, 0, 0])
        for mark in _MARKS.finditer(text):
            c = mark.group()
            if c == '"':
                state[0] ^= 1
            elif len(c) == 1:
                at = 1 + 2 * state[0]
                state[at] += 1 if c in "{[" else -1
                state[at + 1] = min(state[at + 1], state[at])
    columns = list(zip(*[(*split, *state) for split, state in found.items()], strict=True)) or [[]] * 7
    kinds = [pa.string(), pa.int64(), pa.int32()] + [pa.int64()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "quotes", "depth0", "low0", "depth1", "low1"])


def states(outlines: list[tuple]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """`(quotes, depth, origin)` at the start of each split; `origin` is the split in which a record that is still open began."""
    found, file = {}, None
    for name, start, quotes, *moves in sorted(outlines):
        if name != file:
            file, inside, depth, origin = name, 0, 0, start
        found[name, start] = inside, depth, origin
        change, lowest = moves[2 * inside : 2 * inside + 2]
        if depth + lowest <= 1:
            origin = start
        inside, depth = inside ^ quotes, depth + change
    return found


def cut(states):
    """Whole records, with a null origin, and the parts of records that cross splits, with the split where they began."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        split, quotes, depth, origin, kept = None, 0, 0, 0, []
        for now, text in _rows(batches):
            if now != split:
                if split is not None and depth >= 2:
                    yield *split, origin, "".join(kept)
                if now not in states.value:
                    raise ValueError(f"the splits of {now[0]} have changed since its outline was read; read it again")
                split, kept = now, []
                quotes, depth, origin = states.value[now]
                crossing = depth >= 2
            begun = 0
            for mark in _MARKS.finditer(text):
                c = mark.group()
                if c == '"':
                    quotes ^= 1
                elif len(c) == 1 and not quotes:
                    if c in "{[":
                        depth += 1
                        if depth == 2:
                            begun, origin, record = mark.start(), split[1], c == "{"
                    else:
                        depth -= 1
                        if depth == 1:
                            kept.append(text[begun : mark.end()])
                            if crossing or record:
                                yield *split, origin if crossing else None, "".join(kept)
                            kept, crossing = [], False
            if depth >= 2:
                kept.append(text[begun:])
        if split is not None and depth >= 2:
            yield *split, origin, "".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in parts(batches):
            rows.append(row)
            if len(rows) == ROWS_PER_BATCH:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "origin", "text"])
