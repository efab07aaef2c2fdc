"""Fill-in-middle transformation: documents cut into prefix, middle and suffix, written in another order.

A map step cuts each text into chunks of whole lines where it can and gives every chunk
its place in the output. The chunks are dealt by document and sorted by output place
within the partitions (one exchange, one secondary sort), so that each task streams the
outputs of its documents, one chunk at a time, into incremental digests. The stream is cut
again at the sentinels found in it, sorted back to the order of the original within the
same partition, and streamed into the digests of the restored text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import give_back, slices, strings

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, MIDDLE, SUFFIX)  # in the order of the original
#: Output orders by form.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: A chunk holds about so many bytes; longer lines are cut.
CHUNK_BYTES = 64_000
#: Rows of an Arrow batch that a map step hands on.
BATCH_ROWS = 2_000

ABOUT = "doc long, form string, n long, prefix_chars long, middle_chars long"
PIECE = f"row long, place int, chunk binary, {ABOUT}"


@dataclass(frozen=True)
class Rates:
    """Hundredths of the documents that are transformed, and of those the ones written suffix first; `salt` stands before the id."""

    transformed: int = 50
    suffix_first: int = 50
    salt: str = "7:"


def numbers(key: int | None, salt: str) -> list[int]:
    """Four 32-bit numbers of a document: the start of the hex SHA-256 of salt and decimal id (a null id has none)."""
    digest = hashlib.sha256(f"{salt}{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def line_ends(raw: bytes) -> np.ndarray:
    """Where the lines of a text end; the last one may lack its line break."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if not raw or raw.endswith(b"\n") else np.append(ends, len(raw))


def characters(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) - int(((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80).sum()) if not raw.isascii() else len(raw)


def chunks(raw: bytes, ends: np.ndarray) -> Iterator[bytes]:
    """`raw` in pieces of about CHUNK_BYTES, cut at line ends where there is one in reach. Pieces are bytes, so a cut may fall into a character."""
    at = 0
    while at < len(raw):
        until = min(len(raw), at + CHUNK_BYTES)
        i = np.searchsorted(ends, until, side="right")
        if until < len(raw) and i and ends[i - 1] > at:
            until = int(ends[i - 1])
        yield raw[at:until]
        at = until


def cut(key: int | None, text: str, rates: Rates) -> tuple[tuple, list[bytes]]:
    """`(form, n, prefix_chars, middle_chars)` of a text and its output as chunks, in output order."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = line_ends(raw)
    n = len(ends)
    h = numbers(key, rates.salt)
    if not raw or any(s in raw for s in SENTINELS) or h[2] % 100 >= rates.transformed:
        return ("plain", n, None, None), list(chunks(raw, ends)) or [b""]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (low, high))
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(raw))}
    form = "spm" if h[3] % 100 < rates.suffix_first else "psm"
    out = []
    for sentinel in ORDERS[form]:
        x, y = spans[sentinel]
        parts = list(chunks(raw[x:y], ends[(ends > x) & (ends <= y)] - x)) or [b""]
        out += [sentinel + parts[0], *parts[1:]]
    return (form, n, characters(raw[:a]), characters(raw[a:b])), out


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


ABOUT_NAMES = ["doc", "form", "n", "prefix_chars", "middle_chars"]
ABOUT_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
NOTHING = (None,) * 5


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", rates: Rates = Rates()) -> DataFrame:
    """The output of every document as `(row, place, chunk)`; the first piece also says what it is made of.

    `row` numbers the rows of `docs`, so that rows with one id stay apart. Null and empty
    texts have one empty piece. Other columns of `docs` are not read.
    """
    names, types = ["row", "place", "chunk", *ABOUT_NAMES], [pa.int64(), pa.int32(), pa.binary(), *ABOUT_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for row, doc, value in zip(part.column("row").to_pylist(), part.column("doc").to_pylist(), strings(part, "text"), strict=True):
                    about, out = cut(doc, value, rates)
                    rows += [(row, i, c, *((doc, *about) if i == 0 else NOTHING)) for i, c in enumerate(out)]
                yield _batch(rows, names, types)
            give_back()

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, PIECE)


def in_output_order(found: DataFrame) -> DataFrame:
    """Pieces dealt by document and sorted by output place within each partition."""
    return found.repartition("row").sortWithinPartitions("row", "place")


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list]]:
    """Rows of a sorted partition one after the other, without the end of one document being lost at a batch's end; then `(None, [])`."""
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for part in slices(batch, "chunk"):
            yield from zip(part.column("row").to_pylist(), zip(*(part.column(i).to_pylist() for i in range(1, len(columns))), strict=True), strict=True)
        give_back()
    yield None, []


def outputs(ordered: DataFrame) -> DataFrame:
    """`(doc, form, n, prefix_chars, middle_chars, output)`: one row per document with its whole output text."""
    names, types = [*ABOUT_NAMES, "output"], [*ABOUT_TYPES, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, about, parts, rows, held = None, None, [], [], 0
        for row, values in _by_row(batches):
            if row != now and now is not None:
                rows.append((*about, b"".join(parts).decode("utf-8", "surrogatepass")))
                parts = []
                if held > CHUNK_BYTES * 16 or len(rows) >= BATCH_ROWS:
                    yield _batch(rows, names, types)
                    rows, held = [], 0
            if row is not None:
                if values[0] == 0:
                    about = values[2:]
                parts.append(values[1])
                held += len(values[1])
            now = row
        yield _batch(rows, names, types)

    return ordered.mapInArrow(run, f"{ABOUT}, output string")


class Reader:
    """Cuts a streamed output at its sentinels: `(part, number, bytes)`, parts numbered in the order of the original."""

    def __init__(self, form: str):
        self.plain, self.part, self.number, self.rest = form == "plain", 0, 0, b""

    def _give(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        if data:
            yield self.part, self.number, data
            self.number += 1

    def read(self, chunk: bytes) -> Iterator[tuple[int, int, bytes]]:
        if self.plain:
            yield from self._give(chunk)
            return
        data, self.rest = self.rest + chunk, b""
        while True:
            at = min((i for s in SENTINELS if (i := data.find(s)) >= 0), default=-1)
            if at < 0:
                break
            yield from self._give(data[:at])
            self.part, self.number = SENTINELS.index(data[at : at + 3]), 0
            data = data[at + 3 :]
        keep = 2 if data[-2:-1] == b"<" else 1 if data.endswith(b"<") else 0  # the start of a sentinel that the next chunk may end
        yield from self._give(data[: len(data) - keep])
        self.rest = data[len(data) - keep :]

    def end(self) -> Iterator[tuple[int, int, bytes]]:
        yield from self._give(self.rest)


BACK = f"row long, part int, number int, chunk binary, {ABOUT}, output_sha256 string"
#: Sorts behind all parts of a document: its description and the digest of its output.
LAST = 9


def digests(ordered: DataFrame) -> DataFrame:
    """`(doc, form, n, prefix_chars, middle_chars, output_sha256, restored_sha256)`: one row per document.

    The restored text is read from the streamed output and the form alone. Both digests
    are incremental; a task holds one chunk at a time, whatever the text's length.
    """
    names, types = ["row", "part", "number", "chunk", *ABOUT_NAMES, "output_sha256"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), *ABOUT_TYPES, pa.string()]
    done = [*ABOUT_NAMES, "output_sha256", "restored_sha256"]

    def restoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, about, digest, reader, rows, held = None, None, None, None, [], 0
        for row, values in _by_row(batches):
            if row != now and now is not None:
                rows += [(now, *x, *NOTHING, None) for x in reader.end()]
                rows.append((now, LAST, 0, b"", *about, digest.hexdigest()))
            if held > CHUNK_BYTES * 16 or len(rows) >= BATCH_ROWS:
                yield _batch(rows, names, types)
                rows, held = [], 0
            if row is not None:
                place, chunk = values[:2]
                if place == 0:
                    about, digest, reader = values[2:], hashlib.sha256(), Reader(values[3])
                digest.update(chunk)
                held += len(chunk)
                rows += [(row, *x, *NOTHING, None) for x in reader.read(chunk)]
            now = row
        yield _batch(rows, names, types)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, rows = hashlib.sha256(), []
        for row, values in _by_row(batches):
            if row is None:
                continue
            part, _, chunk, *about, output = values
            if part == LAST:
                rows.append((*about, output, digest.hexdigest()))
                digest = hashlib.sha256()
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows, done, [*ABOUT_TYPES, pa.string(), pa.string()])
                    rows = []
            else:
                digest.update(chunk)
        yield _batch(rows, done, [*ABOUT_TYPES, pa.string(), pa.string()])

    # A document's pieces already share a partition: the second sort needs no exchange.
    back = ordered.mapInArrow(restoring, BACK).sortWithinPartitions("row", "part", "number")
    return back.mapInArrow(restored, f"{ABOUT}, output_sha256 string, restored_sha256 string")


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rates: Rates = Rates()) -> DataFrame:
    """One row per row of `docs`: `(key, form, n, prefix_chars, middle_chars, output)`.

    Lines are the units. Prefix and middle end behind a number of lines that a hash of
    the id gives; the output writes the parts behind sentinels as prefix, suffix, middle
    (`psm`) or suffix, prefix, middle (`spm`). A text that is empty, null, holds a
    sentinel, or is not drawn by `rates` stays as it is (`plain`). Rows that repeat an id
    are cut alike and each give a row; a null id is cut by the hash of the salt alone.
    An empty table gives no rows; other columns are not read. `key` is a whole number.
    """
    return outputs(in_output_order(pieces(docs, key, text, rates))).withColumnRenamed("doc", key)
