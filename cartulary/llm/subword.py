"""Subword ids of whole texts, by a public tokenizer, at numpy speed.

The pre-tokeniser of a GPT-2 style byte-level BPE never joins a character with
white space that follows it.  A text therefore falls into pieces (a run of white
space and the run of other characters after it) whose ids can be found apart and
strung together.  Each distinct piece is encoded once and remembered.
"""

from __future__ import annotations

import os

import numpy as np

from cartulary.llm import textbuf

#: Pieces that a worker remembers; then the memory starts anew.
MEMO_PIECES = 1_500_000
#: Text bytes that are encoded together.
CHUNK_BYTES = 1 << 19


def _after_other_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space outside ASCII, or one of 0x1C-0x1F."""
    one = data[at - 1]
    two = np.where(at > 1, data[at - 2], 0)
    three = np.where(at > 2, data[at - 3], 0)
    found = (one >= 0x1C) & (one <= 0x1F)
    found |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    found |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    found |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) & (one >= 0x80) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    found |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    return found | (three == 0xE3) & (two == 0x80) & (one == 0x80)


def pieces(chunk: textbuf.Chunk) -> np.ndarray:
    """Sorted starts of the pieces of all documents of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    gap = textbuf._SEPARATOR[data]
    start = gap.copy()
    start[1:] &= ~gap[:-1]
    at = np.flatnonzero(start)
    at = at[at > 0]
    at = at[~_after_other_space(data, at)]
    mark = np.zeros(len(data), bool)
    mark[at] = True
    mark[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(mark)


class Subwords:
    """Encodes chunks of documents; one per worker."""

    _workers: dict[str, "Subwords"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        # Each character of a byte-level token stands for one byte.
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
        self._forget()

    @classmethod
    def of(cls, path: str) -> "Subwords":
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def _forget(self) -> None:
        self.keys, self.where = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.begin, self.count, self.ids, self.used = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint16 if self.size <= 65536 else np.uint32), 0

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece and their number.  Pieces that begin with white space and end without it are encoded as one text; the bytes of each id tell where a piece ends."""
        apart = ~textbuf._SEPARATOR[data[starts]] | textbuf._SEPARATOR[data[ends - 1]] | _after_other_space(data, ends)
        raw = data.tobytes()
        count = np.zeros(len(starts), np.int64)
        alone = [np.array(x.ids, self.ids.dtype) for x in self.tokenizer.encode_batch_fast([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[apart], ends[apart])], add_special_tokens=False)]
        count[apart] = [len(x) for x in alone]
        text = b"".join(raw[s:e] for s, e in zip(starts[~apart], ends[~apart])).decode("utf-8", "replace")
        joined = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], self.ids.dtype)
        stops = np.searchsorted(np.cumsum(self.lengths[joined]), np.cumsum((ends - starts)[~apart])) + 1
        count[~apart] = np.diff(stops, prepend=0)
        flat = np.empty(int(count.sum()), self.ids.dtype)
        mine = np.repeat(~apart, count)
        flat[mine] = joined
        flat[~mine] = np.concatenate(alone) if alone else []
        return flat, count

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        flat, count = self._encoded(data, starts, ends)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(self.used, len(flat), 1 << 16), self.ids.dtype)])
        self.ids[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(count) - count
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.where = np.insert(self.where, at, (len(self.begin) + np.arange(len(keys))).astype(np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count.astype(np.int32)])

    def _entries(self, chunk: textbuf.Chunk, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memory entries of the distinct pieces that begin at starts, and which of them each piece is."""
        ends = np.append(starts[1:], len(chunk.data))
        keys, first, back = np.unique(textbuf.hashes(chunk.data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMO_PIECES:
            self._forget()
        slot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == keys[inside]
        if not known.all():
            self._learn(keys[~known], chunk.data, starts[first[~known]], ends[first[~known]])
            slot = np.searchsorted(self.keys, keys)
        return self.where[slot], back

    def _gathered(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[entry]
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(self.begin[entry] - total[:-1], count) + np.arange(total[-1])], total

    def encode(self, chunk: textbuf.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of the chunk, and the offset of each document's first (one more at the end)."""
        if not len(chunk.data):
            return np.empty(0, self.ids.dtype), np.zeros(chunk.n + 1, np.int64)
        starts = pieces(chunk)
        entry, back = self._entries(chunk, starts)
        ids, total = self._gathered(entry[back])
        return ids, total[np.searchsorted(starts, chunk.offsets)]

    def counts(self, chunk: textbuf.Chunk, used: np.ndarray) -> np.ndarray:
        """How often each id stands in the documents that are used."""
        if not len(chunk.data):
            return np.zeros(self.size, np.int64)
        starts = pieces(chunk)
        entry, back = self._entries(chunk, starts)
        times = np.bincount(back, np.repeat(used, np.diff(np.searchsorted(starts, chunk.offsets))), minlength=len(entry))
        ids, _ = self._gathered(entry)
        return np.bincount(ids, np.repeat(times, self.count[entry]), minlength=self.size).astype(np.int64)
