"""Fill-in-the-middle: a document's middle is moved behind its prefix and suffix, so that a model learns to fill gaps.

A text is cut at two of its units (a word with the white space before it, or white space at the end). The matcher is streaming:
a first pass counts the units, a second advances a lazy match iterator to the two ranks and stops there. No list of units
is ever stored: beyond the text and the output a document takes constant memory, however long it is.

Ranks, the choice of form and of its order come from the SHA-256 of seed and id, so a document is treated alike in every run, on
every machine and at every place in the table.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50
SPM_RATE = 80
SLICE_CHARS = 1_000_000
NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


class Infill(NamedTuple):
    """A document's form and pieces; a plain one is all suffix."""

    n: int
    form: str
    prefix: str
    middle: str
    suffix: str

    def output(self) -> str:
        if self.form == "psm":
            return f"{PREFIX}{self.prefix}{SUFFIX}{self.suffix}{MIDDLE}{self.middle}"
        if self.form == "spm":
            return f"{SUFFIX}{self.suffix}{PREFIX}{self.prefix}{MIDDLE}{self.middle}"
        return self.suffix


def count_units(text: str) -> int:
    """First pass."""
    return sum(1 for _ in UNIT.finditer(text))


def unit_ends(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the ``first`` and the ``second`` unit end (0: before the first unit); first <= second."""
    found, ends, at = UNIT.finditer(text), [], 0
    for step in (first, second - first):
        last = deque(islice(found, step), 1)
        at = last[0].end() if last else at
        ends.append(at)
    return ends[0], ends[1]


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for an id; null counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(doc_id: object, text: str | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Infill:
    """``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of these with the suffix first. Empty texts stay plain, and
    so do texts with one of the marks in them, as their output could not be read back."""
    text = text or ""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Infill(n, "plain", "", "", text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, stop = unit_ends(text, a, b)
    return Infill(n, "spm" if h4 % 100 < spm_rate else "psm", text[:start], text[start:stop], text[stop:])


def restore(output: str, form: str) -> str:
    """The text, from output and form alone. No piece holds a mark, and no mark overlaps itself, so the first ones are the marks."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n, form, prefix_chars, middle_chars, output); lengths in code points, null if plain.

    A null text is an empty one and stays plain; a null id is drawn for like the empty id; rows that repeat an id share its draws,
    each with its own text; an empty table gives an empty one; other columns are not read. Rows are mapped one by one, so
    hot groups cost nothing, and a very long text costs its own length.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def emit(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(column, k) for column, k in zip(zip(*made, strict=True), kinds, strict=True)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars, kind = [], 0, batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                made = transform(doc.as_py(), text.as_py(), seed, rate, spm_rate)
                sizes = (None, None) if made.form == "plain" else (len(made.prefix), len(made.middle))
                held.append((doc.as_py(), made.n, made.form, *sizes, made.output()))
                chars += len(held[-1][-1])
                if chars >= SLICE_CHARS:
                    yield emit(held, kind)
                    held, chars = [], 0
            if held:
                yield emit(held, kind)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of rows with ``output`` and ``form``."""
    slim = made.select(F.col(id_col).alias("doc_id"), "form", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o.as_py(), f.as_py()) for f, o in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")


def infill_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256); the text is rebuilt from the output."""
    made = fill_in_middle(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            outputs, forms = batch.column(5), batch.column(2)
            digests = [(sha(o.as_py()), sha(restore(o.as_py(), f.as_py()))) for o, f in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([d[k] for d in digests], pa.string()) for k in (0, 1))], names=[*batch.schema.names[:5], "output_sha256", "restored_sha256"])

    kind = made.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
