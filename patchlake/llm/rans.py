"""Static range asymmetric numeral system over interleaved lanes, for blocks of token ids.

One frequency table serves all blocks. A block deals its tokens to LANES lanes in turn; every lane has a
64-bit state, all lanes of a row are coded at once, and the 32-bit words that the states shed are interleaved
in the order in which the decoder asks for them. Every CHECKPOINT rows the states and the place in the words
are kept, so that parts of a block can be decoded apart. Blocks and their tokens carry CRC-32 checksums.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LANES = 512
CHECKPOINT = 128  # rows of LANES tokens
LOW = np.uint64(1 << 31)
HEAD = "<IIII"  # tokens, lanes, words, checkpoints


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE_BITS; every token that occurs has one at least."""
    present = counts > 0
    if not present.any():
        return np.zeros(len(counts), dtype=np.int64)
    room = (1 << SCALE_BITS) - int(present.sum())
    if room < 0:
        raise ValueError("the vocabulary is larger than the scale")
    exact = counts * (room / counts.sum())
    out = np.floor(exact).astype(np.int64)
    left = room - int(out.sum())
    out[np.argsort(-(exact - out), kind="stable")[:left]] += 1
    return out + present


class Coder:
    def __init__(self, frequencies: np.ndarray) -> None:
        """frequencies: by token id, summing to 2^SCALE_BITS."""
        self.freq = frequencies.astype(np.uint64)
        ends = frequencies.cumsum()
        self.begin = (ends - frequencies).astype(np.uint64)
        self.token = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, tokens: np.ndarray) -> bytes:
        n = len(tokens)
        rows = -(-n // LANES)
        freq, begin = self.freq[tokens], self.begin[tokens]
        if n and not freq.all():
            raise ValueError("a token without frequency")
        limit, others = freq << np.uint64(63 - SCALE_BITS), np.uint64(1 << SCALE_BITS) - freq
        state = np.full(LANES, LOW, dtype=np.uint64)
        shed, marks, words = [], [], 0
        for row in reversed(range(rows)):
            part = slice(row * LANES, min(n, (row + 1) * LANES))
            x = state[: part.stop - part.start]
            over = np.flatnonzero(x >= limit[part])
            full = x[over]
            words += len(over)
            shed.append(full.astype(np.uint32))
            x[over] = full >> np.uint64(32)
            # quotient * 2^SCALE_BITS + rest + begin, as rest is x - quotient * freq.
            x += x // freq[part] * others[part] + begin[part]
            if row and row % CHECKPOINT == 0:
                marks.append((row, words, state.copy()))
        stream = np.concatenate([state.view("<u4"), *shed[::-1]]).astype("<u4") if rows else np.empty(0, dtype="<u4")
        body = [struct.pack(HEAD, n, LANES, len(stream), len(marks)), stream.tobytes()]
        for row, done, states in reversed(marks):  # done words were shed from this row on, so words - done come before
            body.append(struct.pack("<II", row, words - done) + states.astype("<u8").tobytes())
        raw = b"".join(body)
        return raw + struct.pack("<II", zlib.crc32(np.ascontiguousarray(tokens.astype("<u4"))), zlib.crc32(raw))

    def decode(self, raw: bytes, checkpoint: int | None = None) -> np.ndarray:
        """All tokens of a block; with checkpoint k only those of its part k (0 is the beginning)."""
        kept = struct.unpack_from("<II", raw, len(raw) - 8)
        if zlib.crc32(raw[:-8]) != kept[1]:
            raise ValueError("a damaged block")
        n, lanes, size, marks = struct.unpack_from(HEAD, raw)
        stream = np.frombuffer(raw, dtype="<u4", count=size, offset=struct.calcsize(HEAD))
        rows, first, at = -(-n // lanes), 0, 2 * lanes
        state = stream[: 2 * lanes].copy().view("<u8").astype(np.uint64) if n else np.empty(0, dtype=np.uint64)
        if checkpoint is not None:
            step = 8 + 8 * lanes
            offset = struct.calcsize(HEAD) + 4 * size
            if checkpoint:
                first, done = struct.unpack_from("<II", raw, offset + (checkpoint - 1) * step)
                state = np.frombuffer(raw, dtype="<u8", count=lanes, offset=offset + (checkpoint - 1) * step + 8).astype(np.uint64)
                at = 2 * lanes + done
            if checkpoint < marks:
                rows = struct.unpack_from("<I", raw, offset + checkpoint * step)[0]
        stop = min(n, rows * lanes)
        tokens = np.empty(max(0, stop - first * lanes), dtype=np.uint32)
        mask = np.uint64((1 << SCALE_BITS) - 1)
        for row in range(first, rows):
            width = min(n - row * lanes, lanes)
            x = state[:width]
            slot = x & mask
            token = self.token.take(slot)
            begin = (row - first) * lanes
            tokens[begin : begin + width] = token
            x >>= np.uint64(SCALE_BITS)
            x *= self.freq.take(token)
            x += slot
            x -= self.begin.take(token)
            under = np.flatnonzero(x < LOW)
            x[under] = (x[under] << np.uint64(32)) | stream[at : at + len(under)]
            at += len(under)
        if checkpoint is None and zlib.crc32(tokens.astype("<u4").tobytes()) != kept[0]:
            raise ValueError("wrong tokens")
        return tokens


def checkpoints(raw: bytes) -> int:
    """The number of parts that decode apart."""
    return struct.unpack_from(HEAD, raw)[3] + 1


# CRC-32 of a concatenation, from the polynomial's arithmetic (zlib's own, reflected).

POLYNOMIAL = 0xEDB88320  # fixed value


def _times(a: int, b: int) -> int:
    """a * b modulo the polynomial; bit 31 is x^0."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def crc32_of_both(first: int, second: int, length: int) -> int:
    """CRC-32 of a text whose beginning has the CRC first and whose rest, of length bytes, has second."""
    power, square, bits = 1 << 31, 1 << 30, 8 * length
    while bits:
        if bits & 1:
            power = _times(square, power)
        square = _times(square, square)
        bits >>= 1
    return _times(power, first) ^ second
