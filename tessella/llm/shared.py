"""Arrays in the shared folder: written once by tasks, memory-mapped by workers."""

from __future__ import annotations

import json
import mmap
import os
import sys
import tempfile
from collections import OrderedDict

import numpy as np

from .common import local_path

#: Bytes of remote shards that one worker keeps copied.
COPIED_BYTES = 2 << 30
#: From Python 3.13 a map needs no open file; before, few shards are kept open.
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
OPEN_SHARDS = 4096 if _UNTRACKED else 64


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write some arrays to one file, whole, then name it; a task that runs twice writes the same file twice.

    The file is the length of a header, the header (each array's name, type, place and length) and the arrays."""
    at, parts, table = 0, [], {}
    for name, values in arrays.items():
        data = np.ascontiguousarray(values).tobytes()
        table[name] = (values.dtype.str, at, len(values))
        parts.append(data + bytes(-len(data) % 8))
        at += len(parts[-1])
    header = json.dumps(table).encode()
    header += b" " * (-len(header) % 8)
    whole = b"".join([len(header).to_bytes(8, "little"), header, *parts])
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            f.write(whole)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(whole)


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """Map a file that `save_arrays` wrote; from a store without local files by way of a nameless temporary copy."""
    if path := local_path(uri):
        with open(path, "rb") as f:
            return _mapped(f)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile() as copy:
        with store.open_input_stream(path) as f:
            while chunk := f.read(1 << 22):
                copy.write(chunk)
        copy.flush()
        return _mapped(copy)


def _mapped(f) -> dict[str, np.ndarray]:
    whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED)
    start = 8 + int.from_bytes(whole[:8], "little")
    table = json.loads(whole[8:start])
    return {name: np.frombuffer(whole, kind, n, start + at) for name, (kind, at, n) in table.items()}


class Shards:
    """Arrays in numbered shards, a file per shard. A worker keeps the shards it used last open: local files are mapped and take no memory of
    its own; from other stores it keeps copies of at most COPIED_BYTES."""

    def __init__(self, uri: str):
        self.uri = uri
        self._open: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"_open": OrderedDict()}

    def save(self, shard: int, **arrays: np.ndarray) -> None:
        save_arrays(f"{self.uri}/{shard:06d}", arrays)

    def shard(self, k: int) -> dict[str, np.ndarray]:
        """The arrays of a shard; none if nothing was saved in it."""
        if k not in self._open:
            try:
                self._open[k] = open_arrays(f"{self.uri}/{k:06d}")
            except FileNotFoundError:
                self._open[k] = {}
            while len(self._open) > (OPEN_SHARDS if local_path(self.uri) else 1) and (local_path(self.uri) or self._copied() > COPIED_BYTES):
                self._open.popitem(last=False)
        self._open.move_to_end(k)
        return self._open[k]

    def _copied(self) -> int:
        return sum(a.nbytes for arrays in self._open.values() for a in arrays.values())


class SortedShards(Shards):
    """Sorted 64-bit keys, dealt to 2**bits files by their first bits, with values beside them.

    A value column is either one number per key, or a ragged list: `<name>` with `begin` and `<name>_at`, the begin and end of each list."""

    def __init__(self, uri: str, bits: int, names: tuple[str, ...]):
        super().__init__(uri)
        self.bits, self.names = bits, names

    def spans(self, keys: np.ndarray):
        """For sorted unsigned keys: (shard, from, to, place of each key in the shard's arrays or -1)."""
        if not len(keys):
            return
        of = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            arrays = self.shard(int(of[lo]))
            if not arrays or not len(arrays["key"]):
                yield {}, lo, hi, np.full(hi - lo, -1)
                continue
            known = arrays["key"]
            at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
            yield arrays, lo, hi, np.where(known[at] == keys[lo:hi], at, -1)

    def numbers(self, keys: np.ndarray, name: str, missing=0) -> np.ndarray:
        """The number beside each of the sorted keys."""
        out = None
        for arrays, lo, hi, at in self.spans(keys):
            if not arrays:
                continue
            values = arrays[name]
            if out is None:
                out = np.full(len(keys), missing, values.dtype)
            out[lo:hi] = np.where(at >= 0, values[np.maximum(at, 0)], missing)
        return np.full(len(keys), missing) if out is None else out

    def lists(self, keys: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends and values of the lists beside each of the sorted keys; a key that isn't there is an error."""
        values, sizes = [np.empty(0, np.int32)], []
        for arrays, _, _, at in self.spans(keys):
            if not arrays or (at < 0).any():
                raise KeyError(f"{self.uri}: a key is missing")
            start = arrays["begin"][at]
            sizes.append(arrays[f"{name}_at"][at] - start)
            values.append(arrays[name][ragged(start, sizes[-1])])
        return np.cumsum(np.concatenate(sizes)) if sizes else np.empty(0, np.int64), np.concatenate(values)


class HashArrays(Shards):
    """Sets of hashed keys in shards of the caller's choice, with small numbers beside them.

    The first 48 bits of a shard's sorted keys are kept, as an array of 32 and one of 16 bits: of a shard of a million keys, about 4 in a thousand
    million keys that aren't there are taken for another that is. A column is stored in the narrowest type that most of its values fit;
    the others are in a list of exceptions."""

    def __init__(self, uri: str, columns: tuple[str, ...]):
        super().__init__(uri)
        self.columns = columns

    def put(self, shard: int, keys: np.ndarray, **values: np.ndarray) -> None:
        """Save a shard: sorted keys, and their numbers from 0."""
        arrays = {"key": (keys >> np.uint64(32)).astype(np.uint32), "more": (keys >> np.uint64(16)).astype(np.uint16)}
        for name in self.columns:
            arrays[name], arrays[f"{name}-at"], arrays[f"{name}-more"] = _narrow(values[name])
        self.save(shard, **arrays)

    def find(self, shard: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For keys in any order, and the shard of each: whether each is there, and its numbers (0 if not)."""
        found = np.zeros(len(keys), bool)
        out = {c: np.zeros(len(keys), np.int64) for c in self.columns}
        bits = np.uint64(int(shard.max(initial=0)).bit_length())
        order = np.argsort((shard.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits) if bits else keys)
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for some in np.split(order, cuts) if len(order) else []:
            arrays = self.shard(int(shard[some[0]]))
            if not arrays or not len(arrays["key"]):
                continue
            at, hit = _placed_in(arrays["key"], arrays["more"], keys[some])
            some, at = some[hit], at[hit]
            found[some] = True
            for c in self.columns:
                values = arrays[c][at].astype(np.int64)
                if len(places := arrays[f"{c}-at"]):
                    special = np.minimum(np.searchsorted(places, at), len(places) - 1)
                    values = np.where(places[special] == at, arrays[f"{c}-more"][special], values)
                out[c][some] = values
        return found, out


def _placed_in(first: np.ndarray, more: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key, and whether it is there: found by its first 32 bits, then by the others among the few that share these."""
    head, tail = (keys >> np.uint64(32)).astype(np.uint32), (keys >> np.uint64(16)).astype(np.uint16)
    at = np.searchsorted(first, head)
    hit = np.zeros(len(keys), bool)
    left = np.flatnonzero(at < len(first))
    left = left[first[at[left]] == head[left]]
    while len(left):
        same = more[at[left]] == tail[left]
        hit[left[same]] = True
        left = left[~same]
        at[left] += 1
        left = left[at[left] < len(first)]
        left = left[first[at[left]] == head[left]]
    return at, hit


def _narrow(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in the type that takes the least space, with the places and values of those that don't fit."""
    sizes = {t: len(values) * np.dtype(t).itemsize + 12 * int((values > np.iinfo(t).max).sum()) for t in (np.uint8, np.uint16, np.uint32, np.int64)}
    kind = min(sizes, key=sizes.get)
    at = np.flatnonzero(values > np.iinfo(kind).max)
    return np.minimum(values, np.iinfo(kind).max).astype(kind), at.astype(np.uint32), values[at].astype(np.int64)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start.astype(np.int64) - (ends - size), size)
