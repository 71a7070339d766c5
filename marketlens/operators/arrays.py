"""Arrays of fitted models as text, so that stage parameters can hold and save them."""

from __future__ import annotations

import base64
import io

import numpy as np
import pyarrow as pa


def pack(**arrays: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return base64.b64encode(out.getvalue()).decode("ascii")


def unpack(text: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(base64.b64decode(text)), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column, all of one length."""
    if not len(column):
        return np.empty((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)
