"""Files of arrays in the shared folder: written whole by one task, memory-mapped by the workers that read them."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np

#: What a worker keeps of files that it can't map.
HELD_BYTES = 256 << 20


def _local(folder: str) -> str | None:
    """The path of a folder that is mounted here, or None for a store that only file systems libraries reach."""
    parsed = urlparse(folder)
    return parsed.path if parsed.scheme in ("", "file") else None


def write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after another behind their lengths in bytes. A second attempt at a task replaces the file whole."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    parts = [head.tobytes()]
    for a in arrays:
        parts += [a.tobytes(), bytes(-a.nbytes % 8)]
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        draft = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            out.writelines(parts)
        os.replace(draft, f"{path}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, f"{base}/{name}")


@lru_cache(65536)
def _mapped(path: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    if not os.path.exists(path):
        return tuple(np.zeros(0, k) for k in kinds)
    return _arrays(np.memmap(path, np.uint8, "r"), kinds)


def unmap() -> None:
    """Let go of the files that this worker has mapped: what it has read of them counts as its memory."""
    _mapped.cache_clear()


def _arrays(raw: np.ndarray, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    sizes = raw[8 : 8 + 8 * len(kinds)].view("<i8")
    at, out = 8 + 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return tuple(out)


#: Files of a store that isn't mounted, as they were read last, and their bytes.
_HELD: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def read(folder: str, name: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The arrays of a file; empty ones if there is no such file.

    Where the folder is mounted the file is mapped. From another store it is read
    into memory, and HELD_BYTES of such files are kept; nothing is written here.
    """
    path = _local(folder)
    if path is not None:
        return _mapped(f"{path}/{name}", kinds)
    key = (folder, name)
    if key not in _HELD:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        if store.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
            raw = np.array([len(kinds), *[0] * len(kinds)], "<i8").view(np.uint8)
        else:
            with store.open_input_stream(f"{base}/{name}") as source:
                raw = np.frombuffer(source.read(), np.uint8)
        _HELD[key] = raw
        while len(_HELD) > 1 and sum(len(x) for x in _HELD.values()) > HELD_BYTES:
            _HELD.popitem(last=False)
    _HELD.move_to_end(key)
    return _arrays(_HELD[key], kinds)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: differences by byte planes, compressed."""
    import zstandard

    steps = np.diff(values.astype("<u8"), prepend=np.zeros(1, "<u8")).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype="<u8")


def pack_planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_planes(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)
