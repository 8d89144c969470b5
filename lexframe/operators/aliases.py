"""Norms named in texts: aliases of one run of letters, digits, underscores and slashes by a table of hashes, all others by one pass of an
Aho-Corasick automaton.

Aliases are normalised, ordered by use (longer ones first) and sent to the executors once. A text is then read once by each, however
many aliases there are: of each the first place counts at which it stands free, that is neither after nor before a letter, digit,
underscore or slash. An alias of one such run stands free where it is a whole run of the text, so runs are looked up by hash and
compared; the table holds some 50 bytes an alias beside its letters in each Python worker, an automaton many times that. Catalogs of
more than ``BLOCK_CHARS`` characters are sent in blocks, each with a pass of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.catalog import aliases as alias_table

BLOCK_CHARS = 20_000_000
_INSIDE = re.compile(r"[A-Za-z0-9_/]")
_RUNS = re.compile(r"[A-Za-z0-9_/]+")
Place = tuple[int, int, str]


class Automaton:
    """Aliases and their norms in the order of use, ranked from ``start``, broadcast; the automaton is compiled once a worker."""

    _compiled: dict[int, ahocorasick.Automaton] = {}

    def __init__(self, spark: SparkSession, known: pa.Table, start: int):
        known = known.append_column("rank", pa.array(np.arange(start, start + len(known))))
        alone = pc.match_substring_regex(known["alias"], "^[A-Za-z0-9_/]+$")
        runs, others = known.filter(alone), known.filter(pc.invert(alone))
        hashes = np.fromiter((xxhash.xxh64_intdigest(a.as_py()) for a in runs["alias"]), np.uint64, len(runs))
        order = np.argsort(hashes, kind="stable")
        sent = {c: runs[c].take(pa.array(order)).combine_chunks() for c in ("norm_id", "alias")}
        sent |= {"hashes": hashes[order], "rank": runs["rank"].to_numpy()[order], "others": list(zip(*(others[c].to_pylist() for c in ("rank", "norm_id", "alias")), strict=True))}
        self.sent = spark.sparkContext.broadcast(sent)
        self.key = self.sent._jbroadcast.id()

    def __getstate__(self):
        return {"sent": self.sent, "key": self.key}

    def _built(self) -> ahocorasick.Automaton:
        if self.key not in self._compiled:
            by_alias: dict[str, list[tuple[int, str]]] = {}
            for rank, norm, alias in self.sent.value["others"]:
                by_alias.setdefault(alias, []).append((rank, norm))
            made = ahocorasick.Automaton()
            for alias, norms in by_alias.items():
                made.add_word(alias, (len(alias), norms))
            if by_alias:
                made.make_automaton()
            self._compiled[self.key] = made
        return self._compiled[self.key]

    def _runs(self, text: str) -> Iterator[Place]:
        held, places = self.sent.value, {}
        for run in _RUNS.finditer(text):
            places.setdefault(run[0], run.start() + 1)
        names = list(places)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        low, high = (np.searchsorted(held["hashes"], hashes, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = (held[c].take(pa.array(at)).to_pylist() for c in ("alias", "norm_id"))
        for name, rank, alias, norm in zip(np.repeat(np.arange(len(names)), n).tolist(), held["rank"][at].tolist(), *found, strict=True):
            if names[name] == alias:
                yield places[alias], rank, norm

    def places(self, text: str | None) -> list[Place]:
        """(place, rank, norm_id) of the first free occurrence of each alias, by rank."""
        made, first = self._built(), {}
        if text and len(self.sent.value["hashes"]):
            first = {p[1]: p for p in self._runs(text)}
        if text and len(made):
            free = lambda i: not 0 <= i < len(text) or not _INSIDE.match(text[i])
            for last, (size, norms) in made.iter(text):
                start = last - size + 1
                if norms[0][0] not in first and free(start - 1) and free(last + 1):
                    for rank, norm in norms:
                        first[rank] = (start + 1, rank, norm)
        return [first[rank] for rank in sorted(first)]


def automata(catalog: DataFrame, block_chars: int = BLOCK_CHARS) -> list[Automaton]:
    """The catalog's aliases in blocks, which together are in the order of use. The catalog passes through the driver."""
    known = alias_table(catalog).where("alias <> ''").orderBy(F.desc("length"), "ord", "norm_id").select("norm_id", "alias", "length").toArrow()
    starts, size = [0], 0
    for rank, length in enumerate(known["length"].to_pylist()):
        if size + length > block_chars and rank > starts[-1]:
            starts, size = [*starts, rank], 0
        size += length
    return [Automaton(catalog.sparkSession, known.slice(a, b - a), a) for a, b in zip(starts, [*starts[1:], len(known)], strict=True)]


def mapped(rows: DataFrame, known: list[Automaton], read: Callable[[pa.RecordBatch, Automaton], pa.Array], schema: str, name: str) -> DataFrame:
    """``rows`` with a column ``name`` of what ``read`` makes of a batch and each block of aliases, one column a block."""
    for k, automaton in enumerate(known):

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, read(batch, automaton)], names=[*batch.schema.names, f"{name}_{k}"])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows = rows.mapInArrow(run, f"{types}, {name}_{k} {schema}")
    return rows


def mentioned_norms(texts: DataFrame, catalog: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, norms): the norms that each text names, those with longer aliases first, then in the catalog's order. Null texts name none."""
    known = automata(catalog, block_chars)
    rows = texts.select(F.col(id_col).alias("id"), normalize(F.col(text_col)).alias("plain"))
    read = lambda batch, a: pa.array([[p[2] for p in a.places(t.as_py())] for t in batch.column("plain")], pa.list_(pa.string()))
    found = mapped(rows, known, read, "array<string>", "norms")
    return found.select(F.col("id").alias(id_col), F.array_distinct(F.concat(*[f"norms_{k}" for k in range(len(known))])).alias("norms"))
