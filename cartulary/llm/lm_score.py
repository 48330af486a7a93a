"""Scores of texts: a unigram base over words, and a causal self-attention model over subwords."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cartulary.llm import attention, subword, textbuf
from cartulary.llm.workspace import Workspace, lean

#: Text bytes of a part; a part's words are numbered, counted and looked up together.
PART_BYTES = 32 << 20
#: Windows, by hash, of the first training, which one task does, and its passes over them; trainers that start from there then go through all windows of all training texts.
FIRST, PASSES = 40_000, 3
#: Windows of a trainer in expectation, and those it holds and puts in another order at a time.
SHARE, HELD_WINDOWS = 1 << 19, 1 << 14
RATE, LATER_RATE = 0.3, 0.15
FOLDS, HELD = 7, 2
#: Bytes of a row group of encoded texts, looked at after so many rows: tasks that read them can share them evenly.
BLOCK_BYTES, BLOCK_CHECK = 8 << 20, 500
#: Bytes of a word's number in its part.
WORD_BYTES = 4
_DOCUMENT, _WORD, _SUBWORD, _TEXTS, _WINDOW = range(5)
_ENCODED = "kind int, part long, key long, n long, doc_id long, held_out boolean, place int, words binary, ids binary"


def _rows(kind: int, n_rows: int, **columns: pa.Array) -> pa.RecordBatch:
    schema = [("part", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("place", pa.int32()), ("words", pa.binary()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n_rows, kind, np.int32)), *(columns.get(c, pa.nulls(n_rows, t)) for c, t in schema)], ["kind", *(c for c, _ in schema)])


def _binary(raw: bytes, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def _planes(flat: np.ndarray, offsets: np.ndarray, width: int) -> pa.Array:
    """A binary value for each stretch of flat: the lowest bytes of its numbers, then the next ones, which pack better so."""
    n = np.diff(offsets)
    out = np.empty(len(flat) * width, np.uint8)
    at = np.arange(len(flat)) + np.repeat((width - 1) * offsets[:-1], n)
    step = np.repeat(n, n)
    for k in range(width):
        out[at + k * step] = (flat >> 8 * k).astype(np.uint8)
    return _binary(out.tobytes(), offsets * width)


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that _planes packed strung together, and where each value's begin (one more at the end)."""
    raw = column.to_pylist()
    n = np.array([len(x) // width for x in raw], np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.arange(int(offsets[-1])) + np.repeat((width - 1) * offsets[:-1], n)
    step, out = np.repeat(n, n), np.zeros(int(offsets[-1]), np.int64)
    for k in range(width):
        out |= data[at + k * step].astype(np.int64) << 8 * k
    return out, offsets


def _encoded(docs: DataFrame, tokenizer_path: str, part_bytes: int, chosen: int) -> DataFrame:
    """Everything that is read from texts, in one pass.

    _DOCUMENT: its number in its part as key, its words as numbers within the part,
    the most frequent first, and its subword ids; _WORD: in that order, how often
    the part's training texts have each of its words; _SUBWORD: how often the
    training texts have an id; _TEXTS: how many there are; _WINDOW: windows of
    the first training, those whose hash, of 20 bits, is under chosen.
    """

    @textbuf.frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        encoder = subword.Subwords.of(tokenizer_path)
        total, texts, part, size = np.zeros(encoder.size, np.int64), 0, task, 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, number, copies = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
            order = np.lexsort([keys, -copies])
            rank = np.empty(len(keys), np.int32)
            rank[order] = np.arange(len(keys))
            keys, number = keys[order], rank[number]
            used = np.concatenate([np.repeat(~h[3], np.diff(h[1])) for h in held])
            counts = np.bincount(number[used], minlength=len(keys))
            for at in range(0, len(keys), 100_000):
                some = slice(at, at + 100_000)
                n = len(keys[some])
                yield _rows(_WORD, n, part=pa.array(np.full(n, part)), key=pa.array(keys[some].view(np.int64)), n=pa.array(counts[some]), place=pa.array(np.arange(at, at + n, dtype=np.int32)))
            at, row = 0, 0
            for hashed, first, doc_id, held_out, ids in held:
                n = len(doc_id)
                yield _rows(_DOCUMENT, n, part=pa.array(np.full(n, part)), key=pa.array(np.arange(row, row + n)), doc_id=doc_id, held_out=pa.array(held_out), words=_planes(number[at : at + len(hashed)], first, WORD_BYTES), ids=ids)
                at, row = at + len(hashed), row + n

        for batch in batches:
            doc_ids, out = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in textbuf.chunks(batch.column(2), subword.CHUNK_BYTES):
                own = slice(chunk.first, chunk.first + chunk.n)
                hashed, first = textbuf.word_hashes(chunk)
                ids, at = encoder.encode(chunk)
                used = ~out[own]
                texts += int(used.sum())
                total += np.bincount(ids[np.repeat(used, np.diff(at))], minlength=encoder.size)
                held.append((hashed, first, doc_ids.slice(chunk.first, chunk.n), out[own], _planes(ids, at, ids.itemsize)))
                picked, marks = [], []
                sums = np.concatenate([[0], np.cumsum(hashed, dtype=np.uint64)]).astype(np.uint64)
                for i in np.flatnonzero(used).tolist():
                    # A text's windows are chosen by the text alone, wherever it is.
                    n = -(-int(at[i + 1] - at[i] + 1) // attention.CONTEXT)
                    mark = textbuf.mix64(np.arange(n, dtype=np.uint64) * textbuf._MULT + (sums[first[i + 1]] - sums[first[i]]))
                    mine = np.flatnonzero(mark >> np.uint64(44) < np.uint64(chosen))
                    if len(mine):
                        picked.append(attention.windows(np.append(ids[at[i] : at[i + 1]].astype(np.int64), encoder.size - 1), encoder.size)[mine])
                        marks.append(mark[mine])
                if picked:
                    flat = np.concatenate(picked).astype("<i4")
                    yield _rows(_WINDOW, len(flat), key=pa.array(np.concatenate(marks).view(np.int64)), ids=_binary(flat.tobytes(), np.arange(len(flat) + 1) * 4 * flat.shape[1]))
                size += len(chunk.data)
                if size >= part_bytes:
                    yield from flush()
                    held, size, part = [], 0, part + 1
        if held:
            yield from flush()
        seen = np.flatnonzero(total)
        yield _rows(_SUBWORD, len(seen), key=pa.array(seen), n=pa.array(total[seen]))
        yield _rows(_TEXTS, 1, n=pa.array([texts]))

    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, _ENCODED)


def _windows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, attention.CONTEXT + 1)


def _changed(model: attention.Model, before: dict[str, np.ndarray]) -> pa.Table:
    """(name, row, n, vector): the rows of the parameters that training changed."""
    names, rows, vectors = [], [], []
    for name, value in model.p.items():
        value, old = (x.reshape(len(x), -1) for x in (value, before[name]))
        at = np.flatnonzero((value != old).any(axis=1))
        names += [name] * len(at)
        rows += at.tolist()
        vectors += [v.tobytes() for v in value[at].astype("<f4")]
    return pa.table({"name": pa.array(names, pa.string()), "row": pa.array(rows, pa.int64()), "vector": pa.array(vectors, pa.binary())})


def _averaged(rows: pa.Table) -> pa.Table:
    """The mean vector of each (name, row) among trainers that changed it."""
    sums: dict[tuple[str, int], list] = {}
    for name, row, vector in zip(*(rows[c].to_pylist() for c in ("name", "row", "vector"))):
        held = sums.setdefault((name, row), [0, 0.0])
        held[0] += 1
        held[1] = held[1] + np.frombuffer(vector, "<f4").astype(np.float64)
    keys = sorted(sums)
    return pa.table({"name": pa.array([k[0] for k in keys], pa.string()), "row": pa.array([k[1] for k in keys], pa.int64()), "vector": pa.array([(sums[k][1] / sums[k][0]).astype("<f4").tobytes() for k in keys], pa.binary())})


def _learn(model: attention.Model, trained: DataFrame) -> None:
    """Takes over rows (name, row, vector): at most one for each row of the parameters, so bounded by the vocabulary."""
    table = trained.toArrow()
    for name, row, vector in zip(*(table.column(c).to_pylist() for c in ("name", "row", "vector"))):
        model.p[name].reshape(len(model.p[name]), -1)[row] = np.frombuffer(vector, "<f4")


def _trained(chosen: DataFrame, texts: DataFrame, counts: np.ndarray, id_bytes: int) -> attention.Model:
    """The model of all training texts (ids), that begins with the chosen windows (key, ids).

    One task trains on the first of the chosen windows; then trainers that start from
    there go through all windows of all texts once, each through those of its part of
    the table, and what they learned is averaged row by row.  The work of a trainer
    is bounded, their number grows with the corpus.
    """
    model = attention.Model(attention.Tree(counts))
    schema = "name string, row long, vector binary"
    size = len(counts)
    n = texts.agg(F.coalesce(F.sum(F.ceil((F.octet_length("ids") / id_bytes + 1) / attention.CONTEXT)), F.lit(0))).first()[0]
    if not n:
        return model

    def run(rows: pa.Table) -> pa.Table:
        own = attention.Model(attention.Tree(counts))
        order = np.lexsort([np.array(rows["ids"].to_pylist(), object), rows["key"].to_numpy()])
        own.fit(_windows_of(rows["ids"].take(pa.array(order))), PASSES, RATE)
        textbuf.release()
        return _changed(own, start)

    start = {k: v.copy() for k, v in model.p.items()}
    some = chosen.orderBy("key", "ids").limit(FIRST).withColumn("trainer", F.lit(0))
    _learn(model, some.groupBy("trainer").applyInArrow(run, schema))
    if n <= FIRST:
        return model
    start = {k: v.copy() for k, v in model.p.items()}
    trainers = -(-n // SHARE)

    @textbuf.frugal
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = attention.Model(attention.Tree(counts))
        own.p = {k: v.copy() for k, v in start.items()}
        rng, done = np.random.default_rng(7), 0

        def held() -> Iterator[np.ndarray]:
            some, n_some = [], 0
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    ids, at = _numbers(batch.column(0).slice(k, 256), id_bytes)
                    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                        some.append(attention.windows(np.append(ids[i:j], size - 1), size))
                        n_some += len(some[-1])
                        if n_some >= HELD_WINDOWS:
                            yield np.concatenate(some)
                            some, n_some = [], 0
            if some:
                yield np.concatenate(some)

        for part in held():
            part = part[rng.permutation(len(part))]
            for at in range(0, len(part), attention.STEP):
                x = part[at : at + attention.STEP].astype(np.int64)
                own.step(np.where(x[:, :-1] < 0, size + 1, x[:, :-1]), x[:, 1:], LATER_RATE * (1 - 0.9 * min(1.0, done * trainers / n)))
                done += len(x)
        if done:
            yield from _changed(own, start).to_batches(max_chunksize=2000)

    learned = texts.select("ids").coalesce(trainers).mapInArrow(later, schema)
    _learn(model, learned.withColumn("bucket", F.pmod(F.xxhash64("name", "row"), F.lit(max(8, trainers // 8)))).groupBy("bucket").applyInArrow(_averaged, schema))
    return model


def score(docs: DataFrame, *, tokenizer_path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32 of doc_id as text has a remainder other
    than 2 by 7; a null doc_id counts as an empty text there.  Null texts are
    empty: their only token is the end.  Repeated rows count and are returned as
    often as they occur; an empty table gives no rows; texts of any length are
    scored whole, those shorter than a window too; other columns are ignored.  Word
    counts never leave the executors: each part of the documents gets the counts of
    its own words.
    """
    work = Workspace(docs.sparkSession, "lm-score")
    own = lean(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD).alias("held_out"))
    n_bytes = own.where("not held_out").agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    # A subword has some four bytes at most in most texts.
    chosen = min(1 << 20, (4 * FIRST * attention.CONTEXT << 20) // max(1, n_bytes))
    table = work.table("encoded", _encoded(own, tokenizer_path, part_bytes, chosen), **{"parquet.block.size": BLOCK_BYTES, "parquet.page.size.row.check.max": BLOCK_CHECK})
    n_texts = table.where(f"kind = {_TEXTS}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    encoder = subword.Subwords.of(tokenizer_path)
    end_id = encoder.size - 1
    counts = np.zeros(encoder.size)
    for key, n in table.where(f"kind = {_SUBWORD}").groupBy("key").agg(F.sum("n")).collect():  # at most a row per subword
        counts[key] = n
    counts[end_id] += n_texts
    texts = table.where(f"kind = {_DOCUMENT} and not held_out").select("ids")
    # A word has a row for each part that has it: their number is bounded by the parts, so a window needs no join.
    same = Window.partitionBy("key")
    words = table.where(f"kind = {_WORD}").select("part", "place", F.sum("n").over(same).alias("c"), (F.col("part") == F.min("part").over(same)).alias("first"))
    shape = "part long, key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, own_words long, own_distinct long"

    def based(texts: pa.Table, lookup: pa.Table) -> pa.Table:
        order = np.argsort(lookup.column("place").to_numpy())
        c, first_here = lookup.column("c").to_numpy()[order], lookup.column("first").to_numpy()[order]
        distinct = int((first_here & (c > 0)).sum())
        out = []
        for batch in texts.to_batches(max_chunksize=1024):
            number, at = _numbers(batch.column("words"), WORD_BYTES)
            # The end of each text is a token after its words.
            n = np.insert(c[number] if len(c) else np.zeros(len(number), np.int64), at[1:], n_texts)
            words_of = np.diff(at)
            at = at + np.arange(len(at))
            logs, known = np.add.reduceat(np.log10(n + 1.0), at[:-1]), np.add.reduceat((n > 0).astype(np.int64), at[:-1])
            trained = np.where(batch.column("held_out").to_numpy(zero_copy_only=False), 0, words_of)
            # The part's distinct words that no part before it has are told by its first row.
            told = np.where(batch.column("key").to_numpy() == 0, distinct, 0)
            out.append(pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("part", "key", "doc_id", "held_out")), pa.array(np.diff(at)), pa.array(known), pa.array(logs), pa.array(trained), pa.array(told)], ["part", "key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "own_words", "own_distinct"]))
        textbuf.release()
        return pa.Table.from_batches(out, out[0].schema) if out else pa.table({"part": pa.array([], pa.int64())})

    rows = table.where(f"kind = {_DOCUMENT}")
    # The first training is one task: the other cores do the base meanwhile.
    with ThreadPoolExecutor(1) as beside:
        looked_up = rows.select("part", "key", "doc_id", "held_out", "words").groupBy("part").cogroup(words.groupBy("part")).applyInArrow(based, shape)
        base = beside.submit(inheritable_thread_target(docs.sparkSession)(work.table), "base", looked_up)
        scorer = attention.Scorer(_trained(table.where(f"kind = {_WINDOW}").select("key", "ids"), texts, counts, encoder.ids.itemsize))
        base = base.result()
    n_words, distinct = base.agg(F.coalesce(F.sum("own_words"), F.lit(0)), F.coalesce(F.sum("own_distinct"), F.lit(0))).first()
    train_tokens, size = n_words + n_texts, distinct + (n_texts > 0)

    id_bytes = encoder.ids.itemsize

    @textbuf.frugal
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                ids, at = _numbers(some.column(2), id_bytes)
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.add.reduceat(scorer.log10(ids, at), at[:-1]))], ["part", "key", "score"])

    scores = rows.select("part", "key", "ids").mapInArrow(scored, "part long, key long, score double")
    log_size = float(np.log10(train_tokens + size + 1))
    return base.join(scores, ["part", "key"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * log_size).alias("base_score"), "score")
