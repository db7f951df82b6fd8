"""64-bit hashes of many pieces of one byte buffer at once, without a Python loop.

`prefixes` and `pieces` hash by two polynomials modulo primes, at random points: two different pieces of n bytes agree
with a chance of (n / 2**31)**2 at most, whatever the bytes. `rough_prefixes` and `rough_pieces` work modulo 2**64, for
which texts that agree are known (Thue-Morse words); they are for choices that may be wrong at a cost in time only.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random odd base and a random value for each byte.
BASE = np.uint64(int(_RNG.integers(1 << 62)) * 2 + 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Two primes below 2**31, a random point and random values of the bytes for each.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
POINTS = tuple(int(_RNG.integers(1 << 20, p - 1)) for p in PRIMES)
VALUES = tuple(_RNG.integers(1, p, 256).astype(np.uint64) for p in PRIMES)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, modulus: int, n: int) -> np.ndarray:
    """base**k modulo `modulus` (0: modulo 2**64) for k below n, kept from call to call."""
    known = _powers.get((base, modulus))
    if known is None:
        known = np.ones(1, np.uint64)
    while len(known) < n:
        step = pow(base, len(known), modulus or 1 << 64)
        more = known * np.uint64(step)
        known = np.concatenate([known, modulo(more, modulus) if modulus else more])
    _powers[base, modulus] = known
    return known[:n]


def modulo(x: np.ndarray, p: int) -> np.ndarray:
    """x % p; a whole division by a constant is the quicker way in numpy."""
    return x - (x // np.uint64(p)) * np.uint64(p)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64; fixed constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(buf: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each prime the sums of value[byte] * point**place over buf[:i], for i from 0 to len(buf)."""
    out = []
    for p, point, value in zip(PRIMES, POINTS, VALUES):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(modulo(value[buf] * _power(point, p, len(buf)), p), out=sums[1:])
        out.append(sums)
    return tuple(out)


def pieces(sums: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of buf[start:end], lengths included."""
    out = mix64((end - start).astype(np.uint64))
    for k, (own, p, point) in enumerate(zip(sums, PRIMES, POINTS)):
        down = _power(pow(point, -1, p), p, len(own))
        out += modulo(modulo(own[end] - own[start], p) * down[start], p) << np.uint64(32 * k)
    return mix64(out)


def rough_prefixes(buf: np.ndarray) -> np.ndarray:
    """Sums of VALUE[byte] * BASE**place over buf[:i], for i from 0 to len(buf)."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(VALUE[buf] * _power(int(BASE), 0, len(buf)), out=out[1:])
    return out


def rough_pieces(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of buf[start:end], lengths included."""
    raw = (sums[end] - sums[start]) * _power(int(INVERSE), 0, len(sums))[start]
    return mix64(raw + mix64((end - start).astype(np.uint64)))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary array and its rows' offsets into them; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Runs of rows [a, b) with `most` bytes together at most, or a single longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
