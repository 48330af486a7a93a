"""Mixture-controlled packing of token streams into fixed windows.

Each source has a queue of its documents' tokens.  A window is one round of a
deficit round-robin: every queue's deficit counter grows by its quantum, the
window size times the queue's target share, the queue sends as many tokens as the
counter has whole ones, and the remainder is carried into the next window.  The
target share of a source is its share of all tokens, so all queues end together
and only the last window of the whole corpus is padded.

The counter after any number of rounds has a closed form.  With the queues in a
fixed order, T the tokens of all queues and P(s) those of queues up to s, the
first w rounds serve D(s, w) = floor(min(w * window, T) * P(s) / T) tokens of the
queues up to s.  Hence queue s has served D(s, w) - D(s - 1, w), each window is
exactly full, and no deficit reaches one token.  So every document finds its own
windows, pieces and offsets from where it begins in its queue; deficits cross
windows and tasks without any task waiting for another.

A queue whose quantum is under one token shares a last queue with others like it, in
which the input's tasks follow each other, each with all its small sources: windows
get whole stretches of small documents, not a token of each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm import subword, textbuf
from cartulary.llm.workspace import Workspace, lean

WINDOW = 2048
END_ID = 1
#: Rows of queue offsets (24 bytes or so each) that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000

_TOKENS = "doc_id long, source string, task int, at long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """A row per document: its ids with the end id as little-endian integers, and where its tokens begin among those of its source in its task."""

    @textbuf.frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        words = subword.Subwords.of(tokenizer_path)
        kind = np.dtype("<u2") if words.size <= 65536 and end_id < 65536 else np.dtype("<u4")
        ahead: dict[str, int] = {}
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for chunk in textbuf.chunks(batch.column(1), subword.CHUNK_BYTES):
                ids, offsets = words.encode(chunk)
                own, at, raw = sources[chunk.first : chunk.first + chunk.n], [], []
                tail = np.array([end_id], kind).tobytes()
                ids = ids.astype(kind, copy=False)
                for i, source in enumerate(own):
                    at.append(ahead.get(source, 0))
                    ahead[source] = at[-1] + int(offsets[i + 1] - offsets[i]) + 1
                    raw.append(ids[offsets[i] : offsets[i + 1]].tobytes() + tail)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n), pa.array(own, pa.string()), pa.array(np.full(chunk.n, task, np.int32)), pa.array(at, pa.int64()), pa.array(np.diff(offsets) + 1), pa.array(raw, pa.binary())],
                    ["doc_id", "source", "task", "at", "n_tokens", "ids"],
                )

    return docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")).mapInArrow(encode, _TOKENS)


def queues(tokens: DataFrame, window: int) -> DataFrame:
    """A row per source and task: its base in the queue, and the tokens of the queues up to (low) and through (high) its own, of all (total)."""
    sums = tokens.groupBy("source", "task").agg(F.sum("n_tokens").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n").alias("total"))
    shares = by_source.crossJoin(F.broadcast(total))  # one row
    shares = shares.select("source", "total", "n", (F.col("n").cast("decimal(38,0)") * window < F.col("total").cast("decimal(38,0)")).alias("rest"))
    ends = shares.select("source", "total", "rest", F.when(F.col("rest"), F.lit("")).otherwise(F.col("source")).alias("queue"), "n")
    totals = ends.groupBy("rest", "queue").agg(F.sum("n").alias("own"))
    totals = totals.withColumn("high", F.sum("own").over(Window.orderBy("rest", "queue").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.drop("n").join(totals, ["rest", "queue"])
    # In the shared queue small sources follow each other task by task, so each stretch of it has their mixture.
    before = Window.partitionBy("rest", "queue").orderBy("task", "source").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(ends, "source").select("source", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), (F.col("high") - F.col("own")).alias("low"), "high", "total")


def served(w: np.ndarray, up_to: np.ndarray, total: np.ndarray, window: int) -> np.ndarray:
    """D of the module's text: tokens that queues holding up_to tokens together have sent after w rounds."""
    total = np.maximum(total, 1)
    sent = np.minimum(w * window, total)
    # sent * up_to // total, one digit of up_to after another, so that no product leaves 63 bits.
    bits = int(total.max(initial=1)).bit_length()
    digit = 62 - bits
    whole, rest = np.zeros_like(sent), np.zeros_like(sent)
    for k in reversed(range(-(-bits // digit))):
        part = (rest << digit) + sent * (up_to >> k * digit & (1 << digit) - 1)
        whole, rest = (whole << digit) + part // total, part % total
    return whole


def _window_of(token: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, window: int) -> np.ndarray:
    """The window that sends a queue's token of this number."""
    sent = lambda w: served(w, high, total, window) - served(w, low, total, window)
    w = np.maximum((token / (high - low) * (total / window)).astype(np.int64) - 1, 0)
    while (early := sent(w + 1) <= token).any():
        w = w + early
    while (late := sent(w) > token).any():
        w = w - late
    return w


def cut(placed: DataFrame, window: int) -> DataFrame:
    """Pieces of documents whose queue offsets are known."""

    @textbuf.frugal
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, o, low, high, total = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "o", "low", "high", "total"))
                raw = part.column("ids").to_pylist()
                wide = [np.frombuffer(x, "<u4" if len(x) == 4 * k else "<u2").astype("<u4").tobytes() for x, k in zip(raw, n)]
                first, last = _window_of(o, low, high, total, window), _window_of(o + n - 1, low, high, total, window)
                count = last - first + 1
                row = np.repeat(np.arange(len(n)), count)
                w = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                low, high, total = low[row], high[row], total[row]
                low0, low1 = served(w, low, total, window), served(w + 1, low, total, window)
                begin, end = served(w, high, total, window) - low0, served(w + 1, high, total, window) - low1
                start, stop = np.maximum(begin, o[row]), np.minimum(end, o[row] + n[row])
                keep = stop > start
                row, w, start, stop = row[keep], w[keep], start[keep], stop[keep]
                offset = (low1 - low0)[keep] + start - begin[keep]
                start, stop = start - o[row], stop - o[row]
                crc = [zlib.crc32(memoryview(wide[i])[4 * a : 4 * b]) for i, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(w), pa.array(offset), part.column("source").take(pa.array(row))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
                )

    return placed.mapInArrow(pieces, _PIECES)


def pack(docs: DataFrame, *, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Packs every document into sequences of at most window tokens; returns a row per piece.

    docs needs doc_id, text and source; other columns are ignored.  Null text is
    an empty text, whose only token is the end id.  Null source is the queue '', a
    null doc_id stays null.
    Repeated rows are packed as often as they occur.  An empty table gives no rows.
    Documents of any length are cut where windows end, never dropped.

    The ids are written once to the shared folder; each later step reads that
    table, so a lost executor repeats only its own reads.
    """
    work = Workspace(docs.sparkSession, "pack")
    tokens = work.table("tokens", tokenised(lean(docs), tokenizer_path, end_id))
    offsets = work.table("queues", queues(tokens, window))
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, ["source", "task"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("at")).alias("o"), "low", "high", "total", "ids")
    return cut(placed, window)
