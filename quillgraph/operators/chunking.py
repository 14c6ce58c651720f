"""Structure-aware chunks of documents.

A document is lines; ``#`` lines are headings that set the heading path; the
rest are pieces, and a line of over ``max_tokens`` words is several.  Neighbouring
pieces under one heading are merged greedily up to ``max_tokens``.  Where a cut
falls depends on the cuts before it, so a document's lines are folded in one pass
over Arrow batches: linear, without a shuffle, one document in memory at a time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id

MAX_TOKENS = 512


def line_chunks(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """One chunk a non-blank line: doc_id, idx, chunk_id, text."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = docs.select(doc_id.alias("doc_id"), F.posexplode(lines).alias("idx", "text"))
    return out.select("doc_id", "idx", chunk_id(F.col("doc_id"), F.col("idx")).alias("chunk_id"), "text")


def count_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


_HEADING = re.compile(r"(#{1,6})\s+")
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_CHUNK = "doc_id string, path string, idx int, text string, headings array<string>, page_start int, page_end int"


def fold_document(text: str, max_tokens: int, pages: str = "\f") -> list[tuple[str, list[str], int, int]]:
    """(text, headings, first page, last page) of each chunk."""
    out: list[tuple[str, list[str], int, int]] = []
    levels: list[tuple[int, str]] = []  # a heading ends those of its level and below
    headings: list[str] = []
    lines: list[str] = []
    used = first = last = 0

    def close() -> None:
        nonlocal lines, used
        if lines:
            out.append(("\n".join(lines), headings, first, last))
        lines, used = [], 0

    for number, page in enumerate(text.split(pages), 1):
        for line in page.split("\n"):
            line = line.strip(" ")
            if not line:
                continue
            mark = _HEADING.match(line)
            if mark:
                level = len(mark.group(1))
                levels = [x for x in levels if x[0] < level] + [(level, line[mark.end() :])]
                path = [title for _, title in levels]
                if path != headings:
                    close()
                headings = path
                continue
            words = [w for w in _SPACE.split(line) if w]
            pieces = [(line, len(words))] if len(words) <= max_tokens else [(" ".join(words[k : k + max_tokens]), len(words[k : k + max_tokens])) for k in range(0, len(words), max_tokens)]
            for piece, n in pieces:
                if lines and used + n > max_tokens:
                    close()
                if not lines:
                    first = number
                lines.append(piece)
                used, last = used + n, number
    close()
    return out


def chunk_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, pages: str = "\f") -> DataFrame:
    """doc_id, path, text in; the chunk table's columns out."""
    names = [x.split()[0] for x in _CHUNK.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for doc_id, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(doc_id, path, k, body, headings, first, last) for k, (body, headings, first, last) in enumerate(fold_document(text or "", max_tokens, pages))]
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    out = docs.select(F.col("doc_id").cast("string"), F.col("path").cast("string"), "text").mapInArrow(run, _CHUNK)
    context = F.array_join(F.array_append("headings", F.col("text")), "\n")
    return out.select(
        chunk_id(F.col("doc_id"), F.col("idx")).alias("chunk_id"), "doc_id", "idx", "text", context.alias("context_text"),
        "headings", "page_start", "page_end", count_tokens(context).alias("n_tokens"), F.lit("text").alias("modality"), "path",
    )
