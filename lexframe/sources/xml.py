"""Consolidated XML to blocks with parsed versions.

A norm is one document whose blocks hold ordered mixes of paragraphs, tables and quotes, so one Arrow pass per norm walks it
with the standard library's parser; declarations of types or entities are refused. Everything later is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime
from functools import lru_cache
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

SLICE = 1 << 16
BLOCKS_AT_ONCE = 32
BATCH_BLOCKS, BATCH_CHARS = 1024, 1 << 20

_PARAGRAPH = pa.struct([("kind", pa.string()), ("text", pa.string()), ("css_class", pa.string())])
_VERSION = pa.struct([("vord", pa.int32()), ("in_force_since", pa.date32()), ("label_line", pa.string()), ("heading_lines", pa.list_(pa.string())), ("paragraphs", pa.list_(_PARAGRAPH)), ("notes", pa.list_(pa.string()))])
#: schema.BLOCKS for Arrow.
_BLOCKS = pa.schema([("norm_id", pa.string()), ("ord", pa.int32()), ("block_id", pa.string()), ("block_type", pa.string()), ("title", pa.string()), ("expired_on", pa.date32()), ("versions", pa.list_(_VERSION))])

# Classes of paragraphs, and what makes a table too numeric to be shown.
NOTE_CLASSES = ("nota_pie", "nota_pie_2")
LABEL_CLASSES = ("articulo",)
SKIPPED_CLASSES = ("imagen", "firma_rey", "firma_ministro")
CENTRED_CLASSES = ("centro_negrita", "centro_cursiva", "centro_redonda")
HEADING_CLASSES = ("anexo_num", "anexo_tit", "anexo", "libro", "libro_num", "libro_tit", "titulo", "titulo_num", "titulo_tit", "capitulo", "capitulo_num", "capitulo_tit", "seccion", "subseccion")
NUMERIC_CELL = r"[\s\d.,%+\-–()/€*]*"
NUMERIC_RATIO, NUMERIC_CELLS, SHOWN_CAPTIONS = 0.8, 24, 8
TABLE_CODE = r"\btabla\s+(?:t[eé]cnica\s+)?.*?\(?(\d+(?:\.[0-9A-Za-z]+)+|TT\d+)\)?"
STUB = "[Tabla numérica. Títulos: {captions}. Columnas: {header}. {rows} filas. Los valores no se reproducen aquí; consúltense en la fuente oficial.]"
NO_CAPTION, NO_HEADER, MORE, CONTINUED = "sin título", "sin cabecera", "; …", "continuaci"


def _text(element) -> str:
    return " ".join("".join(element.itertext()).replace("\xa0", " ").split())


@lru_cache(1 << 14)
def _day(text: str | None) -> date | None:
    return datetime.strptime(text[:8], "%Y%m%d").date() if text else None


def _code(caption: str) -> str | None:
    found = re.search(TABLE_CODE, caption, re.IGNORECASE)
    return found[1].upper() if found else None


class _Items:
    """Paragraphs of a version in order. A numeric table stays open as captions, header and a number of rows until the
    paragraphs are asked for, so that continuations add to it."""

    def __init__(self):
        self.items: list[dict] = []
        self.waiting: list[str] = []

    def add(self, kind: str, text: str, css: str | None) -> None:
        self.release()
        self.items.append({"kind": kind, "text": text, "css_class": css})

    def release(self) -> None:
        """Centred lines that no table followed are headings."""
        self.items += [{"kind": "heading", "text": t, "css_class": "centro"} for t in self.waiting]
        self.waiting = []

    def table(self, element) -> None:
        captions = self.waiting + [t for c in element.findall("caption")[:1] if (t := _text(c))]
        self.waiting = []
        caption = " ".join(captions)
        rows = [[(c.tag, _text(c)) for c in tr if c.tag in ("td", "th")] for tr in element.iter("tr")]
        rows = [r for r in rows if any(t for _, t in r)]
        if not rows:
            return
        heads = next((i for i, r in enumerate(rows) if any(tag == "td" for tag, _ in r)), len(rows))
        cells = [[t for _, t in r] for r in rows]
        body = [t for r in cells[heads:] for t in r if t]
        ratio = sum(re.fullmatch(NUMERIC_CELL, t) is not None for t in body) / len(body) if body else 0.0
        stub = self.items[-1].get("stub") if self.items else None
        if stub is not None and ratio >= NUMERIC_RATIO and self._continues(stub, caption):
            if caption and CONTINUED not in caption.lower() and caption not in stub["captions"]:
                stub["captions"].append(caption)
            stub["rows"] += len(rows) - heads
        elif ratio >= NUMERIC_RATIO and len(body) >= NUMERIC_CELLS:
            header = " | ".join(t for t in cells[0] if t) if heads else ""
            self.items.append({"kind": "table", "css_class": "numeric_table", "stub": {"captions": [caption] if caption else [], "header": header, "rows": len(rows) - heads}})
        else:
            self.items.append({"kind": "table", "text": _markdown(cells, heads, caption), "css_class": "table"})

    @staticmethod
    def _continues(stub: dict, caption: str) -> bool:
        code = _code(caption)
        return code is None or code == _code("; ".join(stub["captions"][:SHOWN_CAPTIONS]))

    def paragraphs(self) -> list[dict]:
        self.release()
        return [{"kind": "table", "text": _stub(i["stub"]), "css_class": "numeric_table"} if "stub" in i else i for i in self.items]


def _stub(stub: dict) -> str:
    shown = "; ".join(stub["captions"][:SHOWN_CAPTIONS]) + (MORE if len(stub["captions"]) > SHOWN_CAPTIONS else "")
    return STUB.format(captions=shown or NO_CAPTION, header=stub["header"] or NO_HEADER, rows=stub["rows"])


def _markdown(cells: list[list[str]], heads: int, caption: str) -> str:
    width = max(map(len, cells))
    lines = ["| " + " | ".join([t.replace("|", "/") for t in row] + [""] * (width - len(row))) + " |" for row in cells]
    lines.insert(max(heads, 1), "|" + " --- |" * width)
    return "\n".join(([caption] if caption else []) + lines)


def parse_version(element) -> dict:
    """label_line, heading_lines (texts of all paragraphs), paragraphs and amendment notes of a version."""
    items, notes, label = _Items(), [], None
    for child in element:
        css = child.get("class")
        if child.tag == "table":
            items.table(child)
            continue
        text = _text(child)
        if not text or css in SKIPPED_CLASSES:
            continue
        if child.tag == "blockquote":
            items.add("note", text, css)
        elif css in NOTE_CLASSES:
            notes.append(text)
        elif css in LABEL_CLASSES and label is None and not items.items:
            label = text
        elif css in CENTRED_CLASSES:
            items.waiting.append(text)
        else:
            items.add("heading" if css in HEADING_CLASSES else "text", text, css)
    lines = [t for p in element if p.tag == "p" and (t := _text(p))]
    return {"label_line": label, "heading_lines": lines, "paragraphs": items.paragraphs(), "notes": notes}


def _block(norm_id: str, at: int, block) -> dict:
    versions = []
    for i, version in enumerate(block.findall("version")):
        since = _day(version.get("fecha_vigencia") or version.get("fecha_publicacion"))
        if since is None:
            raise ValueError(f"{norm_id}#{block.get('id')}: a version has no date")
        versions.append({"vord": i, "in_force_since": since, **parse_version(version)})
    title = " ".join(block.get("titulo", "").replace("\xa0", " ").split())
    return {"norm_id": norm_id, "ord": at, "block_id": block.get("id", ""), "block_type": block.get("tipo", ""), "title": title, "expired_on": _day(block.get("fecha_caducidad")), "versions": versions}


def parse_blocks(norm_id: str, payload: str) -> Iterator[dict]:
    """Blocks of one document in order. A version counts from its date of force, else of publication, else it is an error.

    The text is fed to a pull parser in slices and a block is let go when it has been given, so that beside the payload
    one block at a time is held. Errors that stand behind the first block come after it has been given.
    """
    if "<!DOCTYPE" in payload or "<!ENTITY" in payload:
        raise ValueError(f"{norm_id}: document types and entities are refused")
    parser, opened, at = ElementTree.XMLPullParser(("start", "end")), [], 0
    for start in range(0, len(payload), SLICE):
        parser.feed(payload[start : start + SLICE])
        for event, element in parser.read_events():
            if event == "start":
                opened.append(element)
                continue
            opened.pop()
            if element.tag == "code" and len(opened) == 2 and opened[-1].tag == "status" and element.text != "200":
                raise ValueError(f"{norm_id}: response has status {element.text}")
            if element.tag == "bloque":
                yield _block(norm_id, at, element)
                at += 1
                if opened:
                    opened[-1].remove(element)
    parser.close()


def change_days(payload: bytes) -> list[date]:
    """All days on which a block of the text changes or expires, in order. Blocks are let go as they have been read."""
    days = set()
    for _, element in ElementTree.iterparse(BytesIO(payload)):
        if element.tag == "version":
            days.add(_day(element.get("fecha_vigencia") or element.get("fecha_publicacion")))
        elif element.tag == "bloque":
            days.add(_day(element.get("fecha_caducidad")))
            element.clear()
    return sorted(days - {None})


def _some(norm_id: str, payload: str) -> Iterator[list[dict]]:
    """The blocks of a text, a few at a time; none of a null text."""
    found = parse_blocks(norm_id, payload) if payload is not None else iter(())
    while rows := list(islice(found, BLOCKS_AT_ONCE)):
        yield rows


def _chars(block: dict) -> int:
    """About the characters that a block holds."""
    return sum(len(p["text"]) for v in block["versions"] for p in v["paragraphs"]) + sum(len(t) for v in block["versions"] for t in (*v["heading_lines"], *v["notes"]))


def _batches(texts: Iterator[tuple[str, str | None]]) -> Iterator[pa.RecordBatch]:
    """The blocks of all texts, in batches of BATCH_BLOCKS or of about BATCH_CHARS characters."""
    rows, chars = [], 0
    for norm_id, payload in texts:
        for block in parse_blocks(norm_id, payload) if payload is not None else ():
            rows.append(block)
            chars += _chars(block)
            if len(rows) == BATCH_BLOCKS or chars >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(rows, _BLOCKS)
                rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _BLOCKS)


def blocks(raw: DataFrame) -> DataFrame:
    """(norm_id, payload) texts -> one row per block with its versions (schema.BLOCKS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((n.as_py(), p.as_py()) for batch in batches for n, p in zip(*batch.columns, strict=True))

    return raw.select("norm_id", "payload").mapInArrow(run, schema.BLOCKS)


class _NormBlocks:
    def eval(self, norm_id: str, payload: str) -> Iterator[tuple]:
        for rows in _some(norm_id, payload):
            yield from (tuple(r.values()) for r in rows)


def register(spark: SparkSession) -> None:
    """``norm_blocks(norm_id, payload)`` for SQL: ``SELECT b.* FROM texts t, LATERAL norm_blocks(t.norm_id, t.payload) b``. Spark
    takes no Arrow functions there, so rows are sent one by one; ``blocks`` sends them in frames."""
    spark.udtf.register("norm_blocks", F.udtf(_NormBlocks, returnType=schema.BLOCKS, useArrow=False))
