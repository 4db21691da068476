"""Dictionary codes of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def coded(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    out = flat.dictionary_encode()
    out = out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out
    return out.dictionary, out.indices.to_numpy().astype(np.int64)


def distinct(owner: np.ndarray, code: np.ndarray, n_codes: int) -> np.ndarray:
    """owner * n_codes + code without repeats, in order."""
    both = owner * n_codes + code
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(both)]):
        both[a:b].sort()
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
