"""Markdown texts to addressable spans: one Arrow pass, no shuffle."""

from __future__ import annotations

import gc
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "span_id string, document_id string, kind string, text string, ordinal int, heading_path array<string>, parent_id string, "
    "previous_id string, next_id string, char_start int, char_end int"
)
KINDS = ("heading", "paragraph", "bullet", "table_row", "code", "sentence")
_CUT = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9`])")
_RULE = re.compile(r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$")
_MARKER = re.compile(r"[-*+]\s+")
_BADGE, _IMAGE, _LINK, _TAG = (re.compile(p) for p in (r"\[!\[([^\]]*)\]\([^)]+\)\]\([^)]+\)", r"!\[([^\]]*)\]\([^)]+\)", r"\[([^\]]+)\]\([^)]+\)", r"<[^>]+>"))


def inline_text(raw: str) -> str:
    """A heading's text without its inline markup; badges' alternative text only where nothing else is left."""
    for badge in ("", r"\1"):
        text = _TAG.sub(" ", _LINK.sub(r"\1", _IMAGE.sub(r"\1", _BADGE.sub(badge, raw))))
        text = " ".join(html.unescape(text).replace("·", " ").split()).strip(" -|")
        if text:
            return text
    return raw


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, without white space around it."""
    edges = [0, *(e for m in _CUT.finditer(text) for e in m.span()), len(text)]
    out = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        if piece.strip():
            out.append((a + lead, a + lead + len(piece.strip())))
    return out


def _level(line: str) -> int:
    """The heading's level, 0 for no heading."""
    n = len(line) - len(line.lstrip("#"))
    return n if 1 <= n <= 6 and line[n : n + 1] == " " else 0


def _blocks(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, value, start, end); a heading's value keeps its marks."""
    held: list[tuple[str, int, int]] = []
    kind, fenced, at = "paragraph", False, 0

    def close() -> Iterator[tuple[str, str, int, int]]:
        nonlocal held, kind
        if held:
            value = "\n".join(x.rstrip() for x, _, _ in held).strip() if kind == "code" else " ".join(x.strip() for x, _, _ in held).strip()
            if kind == "bullet":
                value = _MARKER.sub("", value, count=1).strip()
            elif kind == "table_row":
                value = " | ".join(c for c in (c.strip() for c in value.strip("|").split("|")) if c)
            if value:
                yield kind, value, held[0][1], held[-1][2]
        held, kind = [], "paragraph"

    for whole in text.splitlines(keepends=True):
        raw = whole.rstrip("\n")
        place = (raw, at, at + len(raw))
        at += len(whole)
        line = raw.strip()
        if line.startswith("```"):
            yield from close()
            fenced = not fenced
            kind = "code" if fenced else "paragraph"
        elif fenced:
            held.append(place)
        elif not line or _RULE.match(line):
            yield from close()
        elif _level(line):
            yield from close()
            yield "heading", line, place[1], place[2]
        elif line[0] == "|" and line[-1] == "|" and "|" in line[1:-1]:
            yield from close()
            held, kind = [place], "table_row"
            yield from close()
        elif _MARKER.match(line):
            yield from close()
            held, kind = [place], "bullet"
        else:
            held.append(place)
    yield from close()


def spans_of(document_id: str, text: str, with_sentences: bool = True) -> list[dict]:
    out: list[dict] = []
    path: list[str] = []

    def add(kind: str, value: str, start: int, end: int, headings: list[str], parent: str | None = None) -> str:
        n = len(out) + 1
        span = f"{document_id}:s{n:04d}"
        out.append({
            "span_id": span, "document_id": document_id, "kind": kind, "text": value, "ordinal": n, "heading_path": list(headings), "parent_id": parent,
            "previous_id": out[-1]["span_id"] if out else None, "next_id": None, "char_start": start, "char_end": end,
        })
        if n > 1:
            out[-2]["next_id"] = span
        return span

    for kind, value, start, end in _blocks(text):
        if kind == "heading":
            level = _level(value)
            path = [*path[: level - 1], inline_text(value[level:].strip())]
            add(kind, path[-1], start, end, path[:-1])
            continue
        parent = add(kind, value, start, end, path)
        if with_sentences and kind != "code" and len(parts := sentences(value)) > 1:
            for a, b in parts:
                add("sentence", value[a:b], start + a, start + b, path, parent)
    return out


TYPES = pa.schema([(n, pa.list_(pa.string()) if n == "heading_path" else pa.int32() if n in ("ordinal", "char_start", "char_end") else pa.string()) for n in (f.split()[0] for f in SCHEMA.split(", "))])


def columns(rows: list[dict], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(types.names, types.types, strict=True)], schema=types)


def parse(documents: DataFrame, with_sentences: bool = True) -> DataFrame:
    """Spans of documents (document_id string, text string); a document without any gives no row."""

    types = TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gc.disable()  # spans have no cycles, and looking for some costs more than making them
            rows: list[dict] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += spans_of(i, t or "", with_sentences) if i is not None else []
                if len(rows) > 20_000:
                    yield columns(rows, types)
                    rows = []
            gc.enable()
            yield columns(rows, types)

    return documents.select("document_id", "text").mapInArrow(run, SCHEMA)


def empty_documents(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents without spans: set aside rather than failing the job."""
    return documents.join(spans.select("document_id").distinct(), "document_id", "left_anti")
