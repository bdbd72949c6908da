"""Texts of an Arrow batch as numpy arrays of bytes, words and word hashes.

Everything here runs inside tasks. Work goes by chunks of about a megabyte, so the
memory of a task follows the chunk or, for one text longer than that, the text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
LONG_WORD = 48
# The 64-bit FNV-1a offset and prime, and the constants of the splitmix64 finaliser.
FNV_OFFSET = np.uint64(0xCBF29CE484222325)
FNV_PRIME = np.uint64(0x100000001B3)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)

# the white space that ends a word: space, tab to carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# everything in ASCII that is neither letter nor digit
NO_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column):
    """(bytes, offsets) of a string column; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(batch, name="text", limit=CHUNK_BYTES):
    """(rows of the batch, their bytes, their offsets), by about ``limit`` bytes."""
    data, offsets = buffers(batch.column(name))
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def words(data, offsets, outside=SPACE):
    """(start, end, text) of every word, ``text`` counting the texts of the chunk."""
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x):
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(data, starts, ends):
    """A 64-bit hash of the bytes of every word: mixed FNV-1a, XXH64 beyond ``LONG_WORD`` bytes."""
    length = np.minimum(ends - starts, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(length, kind="stable")[::-1]
    at, size = starts[order], length[order].astype(np.int64)
    n_long = int(np.searchsorted(-size, -LONG_WORD, "left"))
    h = np.full(len(starts), FNV_OFFSET, np.uint64)
    live = len(at) - np.searchsorted(size[::-1], np.arange(LONG_WORD), "right")
    for j in range(int(size[0]) if len(size) and n_long < len(size) else 0):
        if j >= LONG_WORD or live[j] == 0:
            break
        m = int(live[j])
        h[:m] = (h[:m] ^ data[at[:m] + j]) * FNV_PRIME
    out = np.empty(len(starts), np.uint64)
    out[order] = mix(h)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i]: ends[i]].tobytes())
    return out


def runs(text, n_texts):
    """First word of each text, and one past the last: ``bounds[i]:bounds[i + 1]``."""
    return np.searchsorted(text, np.arange(n_texts + 1), "left")


def rolling(hashes, k):
    """Hash of every ``k`` words in a row; the value at i covers words i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, block, size = np.full(n, np.uint64(k)), 0, hashes, 1
    while size <= k:
        if k & size:
            out = mix(out + FNV_PRIME) + block[at: at + n]
            at += size
        size *= 2
        if size <= k:
            block = mix(block[: -size // 2] * MIX1 + block[size // 2:])
    return mix(out)


def arrow_schema(df_schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df_schema)
