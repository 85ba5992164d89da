"""Document ids: sortable new ones, and ids derived from a remote key."""

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a of 128 bits (the prime is 2 ** 88 + 315), and Crockford's digits.
BASIS, PRIME = 0x6C62272E07BB014262B821756295C58D, 0x0000000001000000000000000000013B
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_U = np.uint64


def in_digits(number: int, digits: int = 26) -> str:
    return "".join(DIGITS[number >> 5 * k & 31] for k in range(digits - 1, -1, -1))


def derived_ids(collection: str, keys: pa.Array) -> pa.Array:
    """The same id for the same key of a collection, always: byte by byte, for all keys at once, in two 64-bit halves."""
    keys = keys.cast(pa.large_string())
    raw = [b"" if k is None else k.encode() for k in keys.to_pylist()]
    lens = np.array([len(k) for k in raw])
    by_length = np.argsort(-lens, kind="stable")
    data, at = np.frombuffer(b"".join(raw[i] for i in by_length), np.uint8), None
    lens = lens[by_length]
    at = np.cumsum(lens) - lens
    h = BASIS
    for byte in collection.encode() + b"\0":
        h = (h ^ byte) * PRIME % (1 << 128)
    hi, lo = np.full(len(raw), h >> 64, _U), np.full(len(raw), h & (1 << 64) - 1, _U)
    for k in range(int(lens.max()) if len(raw) else 0):
        n = int(np.searchsorted(-lens, -k, side="left"))  # keys longer than k stand first
        x = lo[:n] ^ data[at[:n] + k]
        low, high = (x & _U(0xFFFFFFFF)) * _U(315), (x >> _U(32)) * _U(315)
        mid = (low >> _U(32)) + high  # bits 32 and up of x * 315
        lo[:n] = (mid << _U(32)) | (low & _U(0xFFFFFFFF))
        hi[:n] = hi[:n] * _U(315) + (mid >> _U(32)) + (x << _U(24))
    letters = np.frombuffer(DIGITS.encode(), np.uint8)
    out = np.empty((len(raw), 26), np.uint8)
    for k in range(26):
        shift = 5 * k
        part = lo >> _U(shift) if shift < 64 else hi >> _U(shift - 64)
        if 59 < shift < 64:
            part = part | hi << _U(64 - shift)
        out[:, 25 - k] = letters[(part & _U(31)).astype(np.int64)]
    names = np.empty(len(raw), object)
    names[by_length] = out.reshape(-1).view("S26") if len(raw) else []
    return pa.array([None if null else x.decode() for x, null in zip(names, keys.is_null().to_pylist())], pa.string())


def derived_id(collection: str, key: str) -> str:
    return derived_ids(collection, pa.array([key]))[0].as_py()


def derive(collection: str, key: Column) -> Column:
    @F.arrow_udf("string")
    def run(keys: pa.Array) -> pa.Array:
        return derived_ids(collection, keys)

    return run(key.cast("string"))


def new_id(counter: int = 0) -> str:
    """48 bits of milliseconds, 16 of a counter, 64 of chance."""
    return in_digits((int(time.time() * 1000) << 80) | ((counter & 0xFFFF) << 64) | int.from_bytes(os.urandom(8), "big"))


def new_ids(at_ms: int | None = None, seed: int | None = None) -> Column:
    """A new id for each row of one insert: its time, then 80 bits from a hash of the row's number and a seed.

    A row that is computed again, as after a lost executor, gets the same id.
    """
    at_ms = int(time.time() * 1000) if at_ms is None else at_ms
    seed = int.from_bytes(os.urandom(6), "big") if seed is None else seed
    row = F.monotonically_increasing_id()

    def digits(number: Column) -> list[Column]:
        return [F.substring(F.lit(DIGITS), F.shiftrightunsigned(number, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]

    return F.concat(F.lit(in_digits(at_ms, 10)), *digits(F.xxhash64(row, F.lit(seed))), *digits(F.xxhash64(F.lit(seed), row, F.lit(1))))
