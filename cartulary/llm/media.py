"""Texts as media columns: payloads stored as FLAC streams, and features of what is read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import flac, textbuf
from cartulary.llm.workspace import Workspace, lean

UNIT = 64
#: Payload bytes that are coded together; a longer text is coded alone.
CHUNK_BYTES = 1 << 21


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, padded with zeros to a positive multiple of UNIT, as a FLAC stream."""

    @textbuf.frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(1), CHUNK_BYTES):
                texts = [chunk.text(i) for i in range(chunk.n)]
                media = flac.encode([t + bytes(-len(t) % UNIT if t else UNIT) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def feature(payload: bytes) -> str:
    """Mean, root mean square, crossings of the mean and range of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    above = x * len(x) > x.sum()
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"mean={int(x.sum()) / len(x):.4f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};crossings={crossings};low={int(x.min())};high={int(x.max())}"


def described(media: DataFrame) -> DataFrame:
    """Decodes the stored bytes, verifies all their checksums, and describes payload and stored form."""

    @textbuf.frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(2), CHUNK_BYTES):
                raw = [chunk.text(i) for i in range(chunk.n)]
                out = flac.decode(raw)
                part = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(map(len, out)), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in out]), pa.array([zlib.crc32(p[-UNIT:]) for p in out], pa.int64()), pa.array(list(map(len, raw)), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([feature(p) for p in out])], names
                )

    return media.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def blocks(media: DataFrame) -> DataFrame:
    """The PCM blocks of the stored bytes: doc_id, first_sample, n_samples, media_offset and block.

    A block holds the unsigned 8-bit samples of one frame, from first_sample on;
    the frame begins at byte media_offset of the stream.  All checksums are verified.
    """

    @textbuf.frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(2), CHUNK_BYTES):
                raw = [chunk.text(i) for i in range(chunk.n)]
                meta = [flac.Stream(r) for r in raw]
                first = [np.asarray(m.first, np.int64) for m in meta]
                n = [np.diff(np.append(f, m.samples)) for f, m in zip(first, meta)]
                pcm = [p[a : a + k] for p, f, own in zip(flac.decode(raw), first, n) for a, k in zip(f.tolist(), own.tolist())]
                rows = pa.array(np.repeat(np.arange(chunk.n), [len(f) for f in first]))
                offset = np.concatenate([np.asarray(m.offset, np.int64) for m in meta])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n).take(rows), pa.array(np.concatenate(first)), pa.array(np.concatenate(n)), pa.array(offset), pa.array(pcm, pa.binary())], ["doc_id", "first_sample", "n_samples", "media_offset", "block"])

    return media.mapInArrow(read, "doc_id long, first_sample long, n_samples long, media_offset long, block binary")


def _reread(docs: DataFrame) -> DataFrame:
    """stored(), written to the shared folder and read back."""
    return Workspace(docs.sparkSession, "media").table("stored", stored(lean(docs)))


def describe(docs: DataFrame) -> DataFrame:
    """A row per document: see described().

    Null counts as an empty text, whose payload is UNIT zeros.  Equal texts have
    equal values; repeated rows are returned as often as they occur; texts of any
    length are stored whole; an empty table gives no rows.  The streams are written
    to the shared folder, and what is read back is described; nothing of the text
    goes with them.
    """
    return described(_reread(docs))


def pcm_blocks(docs: DataFrame) -> DataFrame:
    """A row per PCM block of each document's stored stream: see blocks(); edge cases as in describe()."""
    return blocks(_reread(docs))
