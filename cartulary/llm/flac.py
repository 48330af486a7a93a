"""FLAC for 8-bit mono samples: a codec whose work is done on many frames at once.

Streams have STREAMINFO, a seek table with a point for each frame, and frames of
one subframe: constant, verbatim, fixed or linear prediction with partitioned Rice
residuals.  Frame offsets come from the seek table, so the frames of all streams of
a batch are decoded in step, sample by sample, each in a lane of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 1024
#: Frames that are coded together.
FRAMES = 2048
RATE = 8000
#: Coefficients of the linear predictor that each frame may have, their bits and shift.
ORDER, PRECISION, SHIFT = 4, 10, 8
#: A fixed predictor is taken if its residuals are at most so much larger: streams of fixed ones pack better in a table.
EASE = 1.3

# Fixed values of the format: generator polynomials, coefficients of the fixed predictors.
_POLY8, _POLY16 = 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_rows(poly: int, bits: int, length: int) -> np.ndarray:
    """Row d: what each byte adds to the checksum when d bytes follow it."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    first = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        first = np.where(first & top, first << 1 ^ poly, first << 1) & mask
    rows = np.empty((length, 256), np.uint16)
    row = first
    for d in range(length):
        rows[d] = row
        row = (row << 8 & mask) ^ first[row >> (bits - 8)] if bits > 8 else first[row]
    return rows


_ROWS: dict[int, np.ndarray] = {}


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of spans of bytes, each not empty."""
    length = ends - starts
    most = int(length.max(initial=1))
    if bits not in _ROWS or len(_ROWS[bits]) < most:
        _ROWS[bits] = _crc_rows(_POLY16 if bits == 16 else _POLY8, bits, max(most, 1280 if bits == 16 else 16))
    at = np.cumsum(length) - length
    index = np.arange(int(length.sum())) - np.repeat(at, length)
    after = np.repeat(length, length) - 1 - index
    return np.bitwise_xor.reduceat(_ROWS[bits].ravel()[after << 8 | data[index + np.repeat(starts, length)]], at)


class _Bits:
    """Fields of up to 16 bits at known bit positions."""

    def __init__(self) -> None:
        self.ends: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def add(self, end: np.ndarray, value: np.ndarray, width) -> None:
        self.ends.append(end)
        self.values.append(value.astype(np.int32))
        self.widths.append(np.broadcast_to(np.asarray(width, np.int8), value.shape))

    def packed(self, n_bytes: int) -> np.ndarray:
        bits = np.zeros(8 * n_bytes, np.uint8)
        end, value, width = map(np.concatenate, (self.ends, self.values, self.widths))
        for k in range(int(width.max(initial=0))):
            if k and (more := width > k).sum() < len(width):
                end, value, width = end[more], value[more], width[more]
            bits[end - 1 - k] = value >> k & 1
        return np.packbits(bits)


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    out = []
    while True:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(out)):
            return bytes([(0xFF << (7 - len(out)) & 0xFF) | n, *reversed(out)])


def _header(number: int, size: int) -> bytes:
    """Of a frame of mono 8-bit samples, without its checksum."""
    code = 10 if size == 1024 else 7
    return bytes([0xFF, 0xF8, code << 4, 1 << 1]) + _number(number) + (b"" if code == 10 else (size - 1).to_bytes(2, "big"))


def _predicted(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """coefficients: of all rows of x, or a row for each."""
    out = np.zeros_like(x)
    for j in range(coefficients.shape[-1]):
        out[:, j + 1 :] += coefficients[..., j : j + 1] * x[:, : x.shape[1] - j - 1]
    return out >> shift


def _best_linear(x: np.ndarray) -> np.ndarray:
    """The quantised linear predictor of each row, by the Levinson recursion on its autocorrelation."""
    y = x.astype(np.float64)
    r = np.stack([(y[:, k:] * y[:, : y.shape[1] - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    c, error = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for k in range(ORDER):
        turn = (r[:, k + 1] - (c[:, :k] * r[:, k:0:-1]).sum(axis=1)) / error
        c[:, :k], c[:, k] = c[:, :k] - turn[:, None] * c[:, :k][:, ::-1], turn
        error *= 1 - turn * turn
    most = 1 << PRECISION - 1
    return np.clip(np.rint(c * (1 << SHIFT)), -most, most - 1).astype(np.int32)


def _encoded_frames(x: np.ndarray, size: np.ndarray, number: np.ndarray, lpc: tuple | None) -> list[bytes]:
    """Frames of one row of x each; size: samples in the row, the rest is padding.  lpc: (coefficients, precision, shift) to use in all frames."""
    f, width = x.shape
    inside = np.arange(width) < size[:, None]
    taps, precision, shift = (_best_linear(x), PRECISION, SHIFT) if lpc is None else (np.tile(np.array(lpc[0], np.int32), (f, 1)), lpc[1], lpc[2])
    options = [(taps, shift, True), *((np.array(c, np.int32), 0, False) for c in FIXED[:3] if lpc is None)]
    best = np.full(f, float(np.iinfo(np.int64).max))
    order, residual, linear = np.zeros(f, np.int64), np.zeros_like(x), np.zeros(f, bool)
    for coefficients, down, general in options:
        p = coefficients.shape[-1]
        r = x - _predicted(x, coefficients, down)
        own = np.abs(np.where(inside, r, 0))[:, p:].sum(axis=1, dtype=np.int64)
        better = own < best * (1 if general or lpc is not None else EASE)
        best[better], order[better], linear[better] = own[better], p, general
        residual[better] = r[better]
    zigzag = np.where(residual >= 0, residual << 1, (-residual << 1) - 1)
    coded = inside & (np.arange(width) >= order[:, None])
    split = 2 if width % 4 == 0 else 0
    # Full blocks have four partitions, shorter ones one.
    parts = np.where((size == width) & (width // 4 > order), 1 << split, 1)
    quarter = max(1, width // (1 << split))
    part_of = np.where(parts[:, None] > 1, np.minimum(np.arange(width) // quarter, (1 << split) - 1), 0)
    cell = (np.arange(f)[:, None] << split | part_of)[coded]
    z = zigzag[coded]
    cells = f << split
    count, total = np.bincount(cell, minlength=cells), np.bincount(cell, z, minlength=cells)
    guess = np.clip(np.floor(np.log2(np.maximum(total / np.maximum(count, 1), 1))), 0, 14).astype(np.int64)
    cost = np.stack([np.bincount(cell, z >> np.clip(guess + d, 0, 14)[cell], minlength=cells) + count * (np.clip(guess + d, 0, 14) + 1) for d in (-1, 0, 1)])
    k = np.clip(guess + cost.argmin(axis=0) - 1, 0, 14)
    quotient = z >> k[cell]
    extra = np.where(linear, 9 + precision * order, 0)
    rice = np.bincount(cell >> split, quotient + 1 + k[cell], minlength=f).astype(np.int64)
    body = 8 + 8 * order + extra + 6 + 4 * parts + rice
    constant = np.where(inside, x == x[:, :1], True).all(axis=1) & (lpc is None)
    verbatim = ~constant & (body >= 8 + 8 * size)
    rich = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * size, body))
    heads = [_header(int(n), int(s)) for n, s in zip(number, size)]
    head = np.array([len(h) + 1 for h in heads])
    length = head + (body + 7) // 8 + 2
    start = np.cumsum(length) - length
    bit = 8 * (start + head)
    out = _Bits()
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 31, 8) + order))
    out.add(bit + 8, kind << 1, 8)
    out.add(bit[constant] + 16, x[constant, 0] & 0xFF, 8)
    row, at = np.nonzero(inside & verbatim[:, None])
    out.add(bit[row] + 16 + 8 * at, x[row, at] & 0xFF, 8)
    row, at = np.nonzero((np.arange(width) < order[:, None]) & rich[:, None])
    out.add(bit[row] + 16 + 8 * at, x[row, at] & 0xFF, 8)
    bit = bit + 8 + 8 * order
    own = np.flatnonzero(rich & linear)
    out.add(bit[own] + 4, np.full(len(own), precision - 1), 4)
    out.add(bit[own] + 9, np.full(len(own), shift), 5)
    for j in range(taps.shape[1]):
        out.add(bit[own] + 9 + (j + 1) * precision, taps[own, j] & (1 << precision) - 1, precision)
    bit = bit + extra
    out.add(bit[rich] + 6, np.where(parts > 1, split, 0)[rich], 6)
    # Each residual takes quotient zeros, a one and k bits; a partition's first is preceded by its k.
    first = np.zeros(len(z), bool)
    first[np.unique(cell, return_index=True)[1]] = True
    width_of = quotient + 1 + k[cell] + 4 * first
    frame = cell >> split
    ahead = np.cumsum(width_of)
    opening = np.searchsorted(frame, np.arange(f))
    base = np.where(opening > 0, ahead[np.minimum(opening, len(ahead)) - 1], 0) if len(ahead) else np.zeros(f, np.int64)
    end = bit[frame] + 6 + ahead - base[frame]
    keep = rich[frame]
    out.add(end[keep], (1 << k[cell] | z & (1 << k[cell]) - 1)[keep], (k[cell] + 1)[keep])
    mark = first & keep
    out.add((end - width_of)[mark] + 4, k[cell][mark], 4)
    data = out.packed(int(length.sum()))
    flat = np.frombuffer(b"".join(heads), np.uint8)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(head - 1) - head + 1, head - 1)
    data[np.repeat(start, head - 1) + at] = flat
    data[start + head - 1] = checksums(data, start, start + head - 1, 8)
    crc = checksums(data, start, start + length - 2, 16)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 0xFF
    raw = data.tobytes()
    return [raw[s : s + n] for s, n in zip(start.tolist(), length.tolist())]


def encode(payloads: list[bytes], block: int = BLOCK, lpc: tuple | None = None) -> list[bytes]:
    """A FLAC stream for each payload, its bytes less 128 as samples; no payload is empty."""
    owner, size, number, where = [], [], [], []
    for i, p in enumerate(payloads):
        n = -(-len(p) // block)
        owner += [i] * n
        number += range(n)
        where += range(0, len(p), block)
        size += [min(block, len(p) - at) for at in range(0, len(p), block)]
    frames: list[bytes] = []
    for at in range(0, len(owner), FRAMES):
        part = range(at, min(at + FRAMES, len(owner)))
        x = np.zeros((len(part), max(size[j] for j in part)), np.int32)
        for row, j in enumerate(part):
            x[row, : size[j]] = np.frombuffer(payloads[owner[j]], np.uint8, size[j], where[j])
            x[row, : size[j]] -= 128
        frames += _encoded_frames(x, np.array(size[at : at + len(part)]), np.array(number[at : at + len(part)]), lpc)
    out, j = [], 0
    for p in payloads:
        n = -(-len(p) // block)
        own = frames[j : j + n]
        lengths = [len(f) for f in own]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = block.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros((n, 18), np.uint8)
        offsets = np.cumsum(lengths) - lengths
        points[:, 0:8] = (np.arange(n) * block).astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 8:16] = offsets.astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 16:18] = np.array(size[j : j + n]).astype(">u2").view(np.uint8).reshape(-1, 2)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * n).to_bytes(3, "big") + points.tobytes() + b"".join(own))
        j += n
    return out


class Stream:
    """The metadata of a stream: samples, block sizes, digest, and (sample, offset) of its frames."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points = 4, False, None
        while not last:
            last, kind, n = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + n]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.samples, self.md5 = int.from_bytes(body[2:4], "big"), packed & (1 << 36) - 1, body[18:34]
                if packed >> 36 & 0x1F != 7 or packed >> 41 & 7:
                    raise ValueError("only mono 8-bit streams are read")
            elif kind == 3:
                points = np.frombuffer(body, np.uint8).reshape(-1, 18)
            at += 4 + n
        if points is None:
            raise ValueError("the stream has no seek table")
        self.first = points[:, 0:8].copy().view(">u8").ravel().astype(np.int64)
        self.offset = at + points[:, 8:16].copy().view(">u8").ravel().astype(np.int64)


_CLZ16 = np.array([16] + [16 - int(i).bit_length() for i in range(1, 1 << 16)], np.uint8)


def _bits_at(words: np.ndarray, pos: np.ndarray, width) -> np.ndarray:
    """Unsigned fields of 1 to 32 bits."""
    v = words[pos >> 3] << (pos & 7).astype(np.uint64)
    return (v >> (np.uint64(64) - np.asarray(width).astype(np.uint64))).astype(np.int64)


def _residuals(words: np.ndarray, pos: np.ndarray, size: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of frames, in the columns from their order on, and the positions after them."""
    method, split = _bits_at(words, pos, 2), _bits_at(words, pos + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    pos = pos + 6
    part = size >> split
    bits = 4 + method
    out = np.zeros((width, len(pos)), np.int32)
    k, raw = np.zeros(len(pos), np.int64), np.full(len(pos), -1, np.int64)
    lanes = np.argsort(-size, kind="stable")
    pos, size, order, part, bits, k, raw = (v[lanes] for v in (pos, size, order, part, bits, k, raw))
    steps = np.unique(part).tolist()
    begun = np.unique(order).tolist()
    one, top = np.uint64(1), np.uint64(63)
    escaped = False
    for i in range(min(begun), width):
        m = int(np.searchsorted(-size, -i, "left"))  # lanes with more than i samples
        if i in begun or any(i % s == 0 for s in steps):
            here = np.flatnonzero(((i == order[:m]) | ((i % part[:m] == 0) & (i > order[:m]))))
            if len(here):
                k[here] = _bits_at(words, pos[here], bits[here])
                pos[here] += bits[here]
                flag = k[here] == (1 << bits[here]) - 1
                raw[here] = np.where(flag, 0, -1)
                if flag.any():
                    escaped = True
                    e = here[flag]
                    raw[e] = _bits_at(words, pos[e], 5)
                    pos[e] += 5
        if escaped or i < begun[-1]:
            active = np.flatnonzero(i >= order[:m])
            plain = active[raw[active] < 0]
            for e in active[raw[active] > 0]:
                v = int(_bits_at(words, pos[e : e + 1], raw[e])[0])
                out[i, e] = (v - (1 << int(raw[e]))) if v >> (int(raw[e]) - 1) else v
                pos[e] += raw[e]
            p, kk = pos[plain], k[plain]
        else:
            plain = slice(0, m)
            p, kk = pos[:m], k[:m]
        v = words[p >> 3] << (p & 7).astype(np.uint64)
        q = _CLZ16[v >> np.uint64(48)].astype(np.int64)
        far = np.flatnonzero(q == 16)
        while len(far):
            more = _CLZ16[_bits_at(words, p[far] + q[far], 16)].astype(np.int64)
            q[far] += more
            far = far[more == 16]
            if len(far) and int(q.max()) > 1 << 20:
                raise ValueError("a residual is out of range")
        if len(q) and int(q.max()) >= 16:
            z = p + q + 1
            v = words[z >> 3] << (z & 7).astype(np.uint64)
        else:
            v = v << (q.astype(np.uint64) + one)
        low = (v >> one >> (top - kk.astype(np.uint64))).astype(np.int64)
        u = q << kk | low
        out[i, plain] = (u >> 1) ^ -(u & 1)
        pos[plain] = p + q + 1 + kk
    back = np.empty_like(lanes)
    back[lanes] = np.arange(len(lanes))
    return out.T[back], pos[back]


def _samples(words: np.ndarray, bit: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of frames whose subframes begin at these bits, and the positions after them."""
    width = int(size.max())
    head = _bits_at(words, bit, 8)
    kind, wasted = head >> 1 & 63, head & 1
    if (head >> 7).any() or wasted.any():
        raise ValueError("subframes with wasted bits are not read")
    x = np.zeros((len(bit), width), np.int32)
    pos = bit + 8
    signed = lambda v, n=8: v - ((v >> (n - 1)) << n)
    for e in np.flatnonzero(kind == 0):
        x[e, : size[e]] = signed(_bits_at(words, pos[e : e + 1], 8))[0]
        pos[e] += 8
    if len(own := np.flatnonzero(kind == 1)):
        row = np.repeat(own, size[own])
        at = np.arange(len(row)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        x[row, at] = signed(_bits_at(words, pos[row] + 8 * at, 8))
        pos[own] += 8 * size[own]
    linear = kind >= 32
    order = np.where(linear, kind - 31, kind - 8)
    rich = np.flatnonzero(linear | (kind >= 8) & (kind <= 12))
    if len(rich) < len(bit) - (kind < 2).sum():
        raise ValueError("reserved subframe type")
    if not len(rich):
        return x, pos
    warm = order[rich]
    for j in range(int(warm.max())):
        e = rich[warm > j]
        x[e, j] = signed(_bits_at(words, pos[e] + 8 * j, 8))
    pos[rich] += 8 * warm
    # Rows of coefficients; the fixed predictors of orders over 2 are linear ones without a shift.
    taps, shift = np.zeros((len(bit), 32), np.int64), np.zeros(len(bit), np.int64)
    for p in (3, 4):
        taps[(kind == 8 + p), :p] = FIXED[p]
    own = np.flatnonzero(linear)
    precision = _bits_at(words, pos[own], 4) + 1
    shift[own] = _bits_at(words, pos[own] + 4, 5)
    if (precision == 16).any() or (shift[own] > 15).any():
        raise ValueError("reserved precision or negative shift of a linear predictor")
    for j in range(int(order[own].max(initial=0))):
        more = order[own] > j
        e = own[more]
        taps[e, j] = signed(_bits_at(words, pos[e] + 9 + j * precision[more], precision[more]), precision[more])
    pos[own] += 9 + precision * order[own]
    r, pos[rich] = _residuals(words, pos[rich], size[rich], warm, width)
    for p in (0, 1, 2):
        own = np.flatnonzero((warm == p) & ~linear[rich])
        e = rich[own]
        if not len(e):
            continue
        if p == 0:
            x[e] = r[own]
        elif p == 1:
            x[e, 1:] = x[e, :1] + np.cumsum(r[own, 1:], axis=1)
        else:
            d = r[own, 1:].copy()
            d[:, 0] = x[e, 1] - x[e, 0]
            x[e, 1:] = x[e, :1] + np.cumsum(np.cumsum(d, axis=1), axis=1)
    # All other frames in step, sample by sample, those of an order together.
    for p in np.unique(warm[linear[rich] | (warm > 2)]).tolist():
        own = np.flatnonzero((warm == p) & (linear[rich] | (p > 2)))
        e = rich[own]
        own = own[np.argsort(-size[e], kind="stable")]
        e = rich[own]
        line, c, down, rest = x[e].T.astype(np.int64), taps[e, :p].T, shift[e], r[own].T
        for i in range(p, int(size[e[0]])):
            m = int(np.searchsorted(-size[e], -i, "left"))  # frames with more than i samples
            guess = c[0, :m] * line[i - 1, :m]
            for j in range(1, p):
                guess += c[j, :m] * line[i - j - 1, :m]
            line[i, :m] = rest[i, :m] + (guess >> down[:m])
        x[e] = line.T
    return x, pos


def _frame_head(raw: bytes, at: int, block: int) -> tuple[int, int, int]:
    """Bytes of a frame's header with its checksum, its samples, and its number."""
    if raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where the seek table has one")
    code, first = raw[at + 2] >> 4, raw[at + 4]
    more = 0 if first < 0x80 else 7 - (first ^ 0xFF).bit_length()
    number = first if not more else first & (0x3F >> more)
    for j in range(more):
        number = number << 6 | raw[at + 5 + j] & 0x3F
    n = 5 + more
    if code == 7:
        size, n = int.from_bytes(raw[at + n : at + n + 2], "big") + 1, n + 2
    elif code == 6:
        size, n = raw[at + n] + 1, n + 1
    elif code == 1:
        size = 192
    elif 2 <= code <= 5:
        size = 576 << (code - 2)
    elif code >= 8:
        size = 256 << (code - 8)
    else:
        raise ValueError("reserved block size")
    return n + 1, size, number


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams.  Every checksum of headers, frames and streams must hold, else ValueError."""
    meta = [Stream(s) for s in streams]
    jobs = [(i, j) for i, m in enumerate(meta) for j in range(len(m.offset))]
    out = [np.empty(m.samples, np.uint8) for m in meta]
    for at in range(0, len(jobs), FRAMES):
        part = jobs[at : at + FRAMES]
        pieces, head, size, length = [], [], [], []
        for i, j in part:
            m, raw = meta[i], streams[i]
            a = int(m.offset[j])
            b = int(m.offset[j + 1]) if j + 1 < len(m.offset) else len(raw)
            h, s, number = _frame_head(raw, a, m.block)
            if number * m.block != m.first[j]:
                raise ValueError("a frame has another number than the seek table")
            pieces.append(raw[a:b])
            head.append(h)
            size.append(s)
            length.append(b - a)
        data = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        head, size, length = map(np.array, (head, size, length))
        start = np.cumsum(length) - length
        if (checksums(data, start, start + head - 1, 8) != data[start + head - 1]).any():
            raise ValueError("the checksum of a frame header does not hold")
        crc = checksums(data, start, start + length - 2, 16)
        if (crc != data[start + length - 2].astype(np.int64) << 8 | data[start + length - 1]).any():
            raise ValueError("the checksum of a frame does not hold")
        words = np.zeros(len(data) - 8, np.uint64)
        for k in range(8):
            words = words << np.uint64(8) | data[k : len(data) - 8 + k]
        x, pos = _samples(words, 8 * (start + head), size)
        if ((pos + 7) // 8 != start + length - 2).any():
            raise ValueError("a frame does not end at its checksum")
        unsigned = (x + 128).astype(np.uint8)
        for row, (i, j) in enumerate(part):
            first = int(meta[i].first[j])
            out[i][first : first + size[row]] = unsigned[row, : size[row]]
    raw = [o.tobytes() for o in out]
    for m, o in zip(meta, out):
        if hashlib.md5((o ^ 0x80).tobytes()).digest() != m.md5:
            raise ValueError("the digest of a stream does not hold")
    return raw


def seek(stream: bytes, sample: int, n: int) -> bytes:
    """n samples from this one on, of which only the frames that hold them are decoded."""
    m = Stream(stream)
    n = max(0, min(n, m.samples - sample))
    if not n:
        return b""
    a, b = int(np.searchsorted(m.first, sample, "right")) - 1, int(np.searchsorted(m.first, sample + n - 1, "right"))
    out = b""
    for j in range(a, b):
        start = int(m.offset[j])
        h, size, _ = _frame_head(stream, start, m.block)
        data = np.frombuffer(stream[start : int(m.offset[j + 1]) if j + 1 < len(m.offset) else len(stream)] + bytes(16), np.uint8)
        words = np.zeros(len(data) - 8, np.uint64)
        for k in range(8):
            words = words << np.uint64(8) | data[k : len(data) - 8 + k]
        x, _ = _samples(words, np.array([8 * h]), np.array([size]))
        out += (x[0] + 128).astype(np.uint8).tobytes()
    skip = sample - int(m.first[a])
    return out[skip : skip + n]
