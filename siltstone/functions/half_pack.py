"""Vectors as bytes of little-endian half-precision numbers, and back; a null entry is a NaN of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits that stand for a null entry; NaN is 0x7e00.
NULL = 0x7FFF


@F.arrow_udf(T.BinaryType())
def pack(v: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    flat = v.flatten()
    with np.errstate(over="ignore"):
        half = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype("<f2")
    half[np.isnan(half)] = np.nan
    bits = half.view("<u2")
    bits[flat.is_null().to_numpy(zero_copy_only=False)] = NULL
    packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.append(0, np.cumsum(2 * sizes)).astype(np.int32)), pa.py_buffer(bits.tobytes())])
    return pc.if_else(v.is_valid(), packed, None)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack(b: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False) // 2
    bits = np.frombuffer(b"".join(b.drop_null().to_pylist()), "<u2")
    flat = pa.array(bits.view("<f2").astype(np.float32), mask=bits == NULL)
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~b.is_valid().to_numpy(zero_copy_only=False), False)), flat)
