"""Memory of the Python workers: they are kept from batch to batch and from stage to stage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: Bytes of a batch that are worked on at a time: what is made of them on the way may be many times as much.
PIECE_BYTES = 1 << 19


#: What a worker keeps from task to task, under the name of the work it is kept for.
_KEPT: dict[str, dict] = {}


def kept(work: str) -> dict:
    """What a worker keeps for ``work`` from task to task; ``turn_to`` other work lets it go."""
    return _KEPT.setdefault(work, {})


def turn_to(work: str | None = None) -> None:
    """Lets go of what a worker, which tasks of all stages use, keeps for other work than ``work``."""
    others = [name for name in _KEPT if name != work]
    for name in others:
        del _KEPT[name]
    if others:
        gc.collect()
        release()


def release() -> None:
    """Gives memory that a worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_pieces(made: Callable[[pa.Array], pa.Array], values: pa.Array) -> pa.Array:
    """``made`` of the values, piece by piece; the freed memory is given back after it."""
    rows = max(1, len(values) * PIECE_BYTES // max(1, values.nbytes))
    parts = [made(values.slice(at, rows)) for at in range(0, max(1, len(values)), rows)]
    out = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
    del parts
    release()
    return out
