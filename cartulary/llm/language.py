"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of a language's most frequent n-grams of one to three
letters, words padded with a blank.  A document's own list is compared with each
profile by the out-of-place distance: the sum of the rank differences, and the
greatest difference for n-grams that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm import textbuf
from cartulary.llm.workspace import lean

PROFILE = 300
UNKNOWN = "und"
#: Code points that are counted together.
COUNT_POINTS = 1 << 22

#: Code points that there are.
POINTS = 0x110000
_BLANK = 0x20
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """The small letter of each code point, a blank for what is no letter."""
    if not _TABLE:
        table = np.full(POINTS, _BLANK, np.uint32)
        for point in range(POINTS):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _TABLE.append(table)
    return _TABLE[0]


def letters(chunk: textbuf.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Small letters with one blank before, between and after the words of each document, and the offsets of the documents."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    before = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.offsets]
    seq = _letters()[points]
    # A blank of its own after each document keeps words of two documents apart.
    seq = np.insert(seq, before[1:], _BLANK)
    ends = before + np.arange(len(before))
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != _BLANK) | (seq[:-1] != _BLANK)
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    return seq[keep], ends


def _grams(seq: np.ndarray, bits: int) -> np.ndarray:
    """Codes of all n-grams of numbered letters of so many bits.  0 marks a blank and has the highest number in codes, so n-grams of other lengths have other codes."""
    s = np.where(seq == 0, (1 << bits) - 1, seq).astype(np.int64 if 3 * bits > 31 else np.int32)
    word = seq != 0
    return np.concatenate([s[word], (s[:-1] << bits | s[1:])[word[:-1] | word[1:]], (s[:-2] << 2 * bits | s[1:-1] << bits | s[2:])[word[1:-1]]])


def _text(code: int, bits: int, alphabet: np.ndarray) -> str:
    """The n-gram of a code; alphabet: the letter of each number."""
    blank, out = (1 << bits) - 1, ""
    while code:
        number = code & blank
        out = (" " if number == blank else chr(int(alphabet[number]))) + out
        code >>= bits
    return out


def _counted(seq: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All n-grams of a sequence of letters and blanks, and their counts."""
    alphabet = np.flatnonzero(np.bincount(seq, minlength=1))
    alphabet = np.concatenate([[0], alphabet[alphabet != _BLANK]])
    bits = max(2, int(len(alphabet)).bit_length())
    numbers = np.zeros(int(alphabet.max()) + 1 if len(alphabet) > 1 else _BLANK + 1, np.int64)
    numbers[alphabet] = np.arange(len(alphabet))
    numbered = np.where(seq == _BLANK, 0, numbers[np.minimum(seq, len(numbers) - 1)])
    codes = _grams(numbered, bits)
    if 3 * bits <= 21:
        counts = np.bincount(codes, minlength=1)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        codes, counts = np.unique(codes, return_counts=True)
    return [_text(c, bits, alphabet) for c in codes.tolist()], counts


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): partial counts of all n-grams of the texts of each language."""

    @textbuf.frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            grams, counts = _counted(np.concatenate(held.pop(lang)))
            size.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for chunk in textbuf.chunks(batch.column(0)):
                seq, ends = letters(chunk)
                for i in range(chunk.n):
                    lang = langs[chunk.first + i]
                    held.setdefault(lang, [np.array([_BLANK], np.uint32)]).append(seq[ends[i] : ends[i + 1]])
                    size[lang] = size.get(lang, 0) + int(ends[i + 1] - ends[i])
                    if size[lang] >= COUNT_POINTS:
                        yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    return labelled.select("text", "lang").mapInArrow(count, "lang string, gram string, n long")


def profiles(labelled: DataFrame, length: int = PROFILE) -> dict[str, list[str]]:
    """The most frequent n-grams of each language, over all labelled texts; ties by code point."""
    sums = gram_counts(labelled.where("lang is not null and text is not null")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length).select("lang", "rank", "gram").collect()
    found: dict[str, list[str]] = {}
    for lang, _, gram in sorted(rows):
        found.setdefault(lang, []).append(gram)
    return found


class Ranker:
    """Compares documents with profiles."""

    def __init__(self, profiles: dict[str, list[str]], length: int = PROFILE):
        self.langs, self.length = sorted(profiles), length
        known = sorted({c for p in profiles.values() for g in p for c in g if c != " "})
        # Letters that no profile has count as one letter.
        self.bits = max(2, (len(known) + 2).bit_length())
        self.numbers = np.full(POINTS, len(known) + 1, np.int32)
        self.numbers[_BLANK] = 0
        number = {" ": (1 << self.bits) - 1} | {c: i + 1 for i, c in enumerate(known)}
        for c in known:
            self.numbers[ord(c)] = number[c]
        ranks: dict[int, np.ndarray] = {}
        for k, lang in enumerate(self.langs):
            for rank, gram in enumerate(profiles[lang]):
                code = 0
                for c in gram:
                    code = code << self.bits | number[c]
                ranks.setdefault(code, np.full(len(self.langs), -1, np.int64))[k] = rank
        self.codes = np.array(sorted(ranks), np.int64)
        self.ranks = np.array([ranks[c] for c in self.codes.tolist()], np.int64).reshape(len(ranks), len(self.langs))

    def rank(self, seq: np.ndarray) -> tuple[str, float]:
        """The nearest language and a score; seq as letters() makes it."""
        if not self.langs or not (seq != _BLANK).any():
            return UNKNOWN, 0.0
        padded = np.concatenate([[0], self.numbers[seq]])
        codes = np.sort(_grams(padded, self.bits))
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.diff(np.append(first, len(codes)))
        top = np.argsort(-counts, kind="stable")[: self.length]
        own = codes[first[top]]
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        ranks = np.where((self.codes[at] == own)[:, None], self.ranks[at], -1)
        away = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.length * len(own))


def identify(docs: DataFrame, *, length: int = PROFILE) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score.

    Profiles are learned from the text and lang of the rows whose crc32 of doc_id
    as text has a remainder other than 1 by 3, and whose lang is not null.  A text
    that is null or has no letter is "und" with score 0, as is every text if
    nothing could be learned.  Equal distances go to the first language by name.
    A null doc_id counts as an empty text for the remainder.  Whole texts count;
    an empty table gives no rows; other columns are never used.
    """
    marked = lean(docs).select("doc_id", "text", "lang", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out"))
    learned = profiles(marked.where("not held_out"), length)

    @textbuf.frugal
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(learned, length)
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(2)):
                seq, ends = letters(chunk)
                found = [ranker.rank(seq[ends[i] : ends[i + 1]]) for i in range(chunk.n)]
                part = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return marked.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
