"""Integer arrays as one binary cell: byte planes, compressed."""

from __future__ import annotations

import numpy as np


def put(*arrays: np.ndarray) -> bytes:
    import zstandard

    head, body = [len(arrays)], []
    for a in arrays:
        head += [len(a), ord(a.dtype.kind), a.dtype.itemsize]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.compress(np.array(head, "<i8").tobytes() + b"".join(body), 1)


def get(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 1 + 3 * n)[1:].reshape(n, 3), 8 * (1 + 3 * n), []
    for size, kind, width in head.tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<{chr(kind)}{width}"))
        at += size * width
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)
