"""Chunking of documents."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

SIZE, OVERLAP = 1500, 200
#: Documents whose chunks a task holds at once.
AT_ONCE = 128


def cut(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed into chunks of about ``size`` characters; long paragraphs are packed by lines, long lines cut with
    an overlap. Separators do not count towards the size."""

    def pack(parts, between):
        now, out = "", []
        for p in parts:
            if now and len(now) + len(p) > size:
                out.append(now)
                now = p
            else:
                now = f"{now}{between}{p}" if now else p
        return out + [now] * bool(now)

    blocks: list[str] = []
    for para in filter(None, (p.strip() for p in re.split(r"\n{2,}", text or ""))):
        if len(para) <= size:
            blocks.append(para)
            continue
        lines: list[str] = []
        for line in para.split("\n"):
            lines += [line] if len(line) <= size else [line[i : i + size] for i in range(0, len(line), size - overlap)]
        blocks += pack(lines, "\n")
    return [c.strip() for c in pack(blocks, "\n\n") if c.strip()]


def pieces(batch: pa.RecordBatch, size: int = SIZE, overlap: int = OVERLAP):
    """Chunks of a batch of documents (document_id, text), as batches for few documents each: chunks of all are never held together. Of
    documents with a third column, lists of chunk indexes, those chunks alone."""
    for at in range(0, batch.num_rows, AT_ONCE):
        ids, texts, *some = batch.slice(at, AT_ONCE).columns
        wanted = [set(x) for x in some[0].to_pylist()] if some else None
        rows = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(cut(t.as_py(), size, overlap)) if wanted is None or k in wanted[i]]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([hashlib.sha256(r[2].encode("utf-8", "replace")).hexdigest() for r in rows], pa.string())], ["document_id", "chunk_index", "text", "content_hash"])


def chunk(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, wanted: str | None = None) -> DataFrame:
    """document_id, chunk_index, text and content_hash of the chunks of documents (document_id, text), in Arrow batches;
    packing is a fold over lines, which column functions can only do by copying arrays. wanted: a column of the indexes of the chunks to be
    given, in place of all."""
    kind = documents.schema["document_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield from pieces(b, size, overlap)

    return documents.select("document_id", "text", *([wanted] if wanted else [])).mapInArrow(run, f"document_id {kind}, chunk_index int, text string, content_hash string")
