"""Static range asymmetric numeral system over token ids: one frequency table, independent interleaved blocks.

A segment holds the ids of consecutive documents. All its blocks share one table of frequencies scaled to 2**bits.
A block is BLOCK ids dealt out to LANES states (id i goes to lane i mod LANES). A state is an unsigned 64-bit number
of at least 2**31; it gives out or takes in 32 bits at a time. The words of a block stand in the order in which a
decoder needs them, so a block can be decoded from its entry in the directory alone: number of ids, place and number
of words, checksum, and the states to begin with. numpy works on the lanes of all blocks of a segment at once.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES = 1 << 16, 256
DENSE = 1 << 22  # ids below this are looked up in an array
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct ids, their frequencies scaled to a sum of 2**bits, each at least 1, and bits."""
    if len(ids) and int(ids.max()) < DENSE:
        all_counts = np.bincount(ids)
        symbols = np.flatnonzero(all_counts)
        counts = all_counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    bits = max(16, int(np.ceil(np.log2(max(2, len(symbols))))) + 4)
    total = 1 << bits
    freqs = np.maximum(1, counts.astype(np.float64) * total // max(1, counts.sum())).astype(np.int64)
    order = np.argsort(-freqs, kind="stable")
    over = int(freqs.sum()) - total
    if over < 0:
        freqs[order[0]] -= over
    for k in order:
        if over <= 0:
            break
        less = min(over, int(freqs[k]) - 1)
        freqs[k] -= less
        over -= less
    return symbols.astype("<u4"), freqs.astype("<u4"), bits


def _shape(n: int) -> tuple[np.ndarray, int]:
    """Ids in each block, and steps of the longest."""
    blocks = max(1, -(-n // BLOCK))
    per = np.full(blocks, BLOCK, dtype=np.int64)
    per[-1] = n - BLOCK * (blocks - 1)
    return per, -(-int(per.max(initial=0)) // LANES)


def encode(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(table, directory, words) of a segment's ids."""
    n = len(ids)
    if n == 0:
        return b"", b"", b""
    symbols, freqs, bits = table_of(ids)
    starts = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
    per, steps = _shape(n)
    # past the end of a block: a symbol that has the whole range changes no state
    f_of = np.append(freqs.astype(np.uint64), np.uint64(1 << bits))
    c_of = np.append(starts, np.uint64(0))
    grid = np.full(len(per) * steps * LANES, len(symbols), dtype=np.int64)
    if int(symbols[-1]) < DENSE:
        code_of = np.zeros(int(symbols[-1]) + 1, np.int64)
        code_of[symbols] = np.arange(len(symbols))
        codes = code_of[ids]
    else:
        codes = np.searchsorted(symbols, ids)
    if len(per) > 1 and steps * LANES == BLOCK:
        grid[:n] = codes
    else:
        for b, k in enumerate(per):
            grid[b * steps * LANES : b * steps * LANES + k] = codes[b * BLOCK : b * BLOCK + k]
    grid = grid.reshape(len(per), steps, LANES)
    x = np.full((len(per), LANES), LOW, dtype=np.uint64)
    shift, top = np.uint64(bits), np.uint64(63 - bits)
    words, owners = [], []
    block = np.broadcast_to(np.arange(len(per), dtype=np.uint16 if len(per) < 1 << 16 else np.int64)[:, None], x.shape)
    for t in range(steps - 1, -1, -1):
        code = grid[:, t, :]
        f, c = f_of[code], c_of[code]
        out = x >= np.minimum(f << top, np.uint64(1 << 63))
        if out.any():
            words.append(x[out].astype(np.uint32))
            owners.append(block[out])
            x[out] >>= _32
        q = x // f
        x = (q << shift) + (x - q * f) + c
    words, owners = words[::-1], owners[::-1]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.uint16)
    flat = flat[np.argsort(owner, kind="stable")].astype("<u4")
    sizes = np.bincount(owner, minlength=len(per))
    at = np.concatenate([[0], np.cumsum(sizes)])
    directory = b"".join(
        np.array([per[b], at[b], sizes[b], zlib.crc32(flat[at[b] : at[b + 1]].tobytes())], "<u8").tobytes() + x[b].astype("<u8").tobytes()
        for b in range(len(per))
    )
    table = zlib.compress(np.array([bits, len(symbols)], "<u4").tobytes() + np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freqs.tobytes(), 6)
    return table, directory, flat.tobytes()


def read_table(table: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    raw = np.frombuffer(zlib.decompress(table), "<u4")
    bits, k = int(raw[0]), int(raw[1])
    return np.cumsum(raw[2 : 2 + k], dtype=np.uint64).astype("<u4"), raw[2 + k :], bits


def decode(table: bytes, directory: bytes, words: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first to last (exclusive; all without it) of a segment. A wrong checksum is a ValueError."""
    if not directory:
        return np.zeros(0, "<u4")
    entry = 4 + LANES
    entries = np.frombuffer(directory, "<u8").reshape(-1, entry)[first:last]
    symbols, freqs, bits = read_table(table)
    flat = np.frombuffer(words, "<u4")
    per, at, sizes, sums = (entries[:, i].astype(np.int64) for i in range(4))
    for b in range(len(per)):
        if zlib.crc32(flat[at[b] : at[b] + sizes[b]].tobytes()) != sums[b]:
            raise ValueError(f"block {first + b}: its checksum is wrong")
    steps = -(-int(per.max(initial=0)) // LANES)
    slot_of = np.repeat(np.arange(len(symbols), dtype=np.int64), freqs)
    f_of = freqs.astype(np.uint64)
    c_of = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
    x = entries[:, 4:].astype(np.uint64)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    pos = at.copy()
    out = np.zeros((len(per), steps, LANES), dtype=np.int64)
    lane = np.arange(LANES)
    full = int(per.min()) // LANES if len(per) else 0
    for t in range(steps):
        slot = x & mask
        code = slot_of[slot]
        new = f_of[code] * (x >> shift) + slot - c_of[code]
        if t >= full:
            live = t * LANES + lane[None, :] < per[:, None]
            new = np.where(live, new, x)
        x = new
        out[:, t, :] = code
        need = x < LOW
        if need.any():
            rank = np.cumsum(need, axis=1)
            where = (pos[:, None] + rank - 1)[need]
            x[need] = (x[need] << _32) | flat[where]
            pos += rank[:, -1]
    ids = symbols[out.reshape(len(per), -1)]
    return np.concatenate([ids[b, : per[b]] for b in range(len(per))])
