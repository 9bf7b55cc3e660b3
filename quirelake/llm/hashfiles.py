"""Sorted arrays of 64-bit hashes in files of the shared folder, mapped into memory by workers."""

from __future__ import annotations

import os
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np


#: Files that one worker maps at a time.
MAPS = 4096


def local_folder(path: str) -> str:
    """The shared folder as a path that workers can map; it has to be mounted."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"these files are mapped into memory, so spark.checkpoint.dir has to be a mounted folder, not {url.scheme}://")
    return url.path


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal entries start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def cuts(x: np.ndarray) -> list[tuple[int, int]]:
    at = [*runs(x).tolist(), len(x)]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if a < b]


def within(keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Numbers that sort by shard and then by the first bits of keys."""
    bits = np.uint64(max(1, int(shard.max(initial=0)).bit_length()))
    return shard.astype(np.uint64) << (np.uint64(64) - bits) | keys >> bits


def joined(column, kind) -> np.ndarray:
    """Blobs of a column as one array."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in column)])


def write(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Written aside and renamed, so a task that runs again or twice leaves whole files."""
    for field, x in arrays.items():
        path = f"{folder}/{name}-{field}"
        aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(aside, "wb") as out:
            out.write(np.ascontiguousarray(x).tobytes())
        os.replace(aside, path)


class Files:
    """Shards of sorted keys with fields; a shard is the first bits of a key.

    seal() writes down which shards there are once all have been written: another shard is empty,
    and one that is on the list but gone raises an error. With checks, a field `check` holds 64
    more bits of each key. At most MAPS files are mapped at a time.
    """

    def __init__(self, folder: str, prefix: str, bits: int, fields: dict[str, type]):
        self.folder, self.prefix, self.bits, self.fields, self.maps, self.there = folder, prefix, bits, fields, OrderedDict(), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": OrderedDict(), "there": None}

    def seal(self, shards: list[int]) -> None:
        write(self.folder, self.prefix, shards=np.unique(np.array(shards, np.int64)))

    def array(self, shard: int, field: str, kind) -> np.ndarray:
        if self.there is None:
            self.there = np.fromfile(f"{self.folder}/{self.prefix}-shards", np.int64)
        at = int(np.searchsorted(self.there, shard))
        if at == len(self.there) or self.there[at] != shard:
            return np.zeros(0, kind)
        found = self.maps.get((shard, field))
        if found is None:
            path = f"{self.folder}/{self.prefix}-{shard}-{field}"
            if kind is None and os.path.getsize(path):  # of four bytes where that is enough
                kind = np.int64 if os.path.getsize(path) == 8 * len(self.array(shard, "key", np.uint64)) else np.uint32
            found = self.maps[shard, field] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
            if len(self.maps) > MAPS:
                self.maps.popitem(last=False)
        else:
            self.maps.move_to_end((shard, field))
        return found

    def find(self, keys: np.ndarray, checks: np.ndarray | None = None, shard: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys there are, and their fields (0 where there is none); keys in any order. shard: where not the first bits tell it."""
        order = np.argsort(keys if shard is None else within(keys, shard))
        found, out = np.zeros(len(keys), bool), [np.zeros(len(keys), kind or np.int64) for kind in self.fields.values()]
        shard = (keys[order] >> np.uint64(64 - self.bits)).astype(np.int64) if shard is None else shard[order]
        for a, b in cuts(shard):
            held = self.array(int(shard[a]), "key", np.uint64)
            if len(held):
                mine = order[a:b]
                at = np.minimum(np.searchsorted(held, keys[mine]), len(held) - 1)
                hit = held[at] == keys[mine]
                if checks is not None:
                    sums, want = self.array(int(shard[a]), "check", np.uint64), checks[mine]
                    while True:  # keys that are equal by chance lie side by side
                        off = np.flatnonzero(hit & (sums[at] != want))
                        if not len(off):
                            break
                        after = np.minimum(at[off] + 1, len(held) - 1)
                        hit[off] = (after > at[off]) & (held[after] == keys[mine][off])
                        at[off] = after
                found[mine[hit]] = True
                for x, (name, kind) in zip(out, self.fields.items(), strict=True):
                    x[mine[hit]] = self.array(int(shard[a]), name, kind)[at[hit]]
        return found, out


def by_shard(bits: int, keys: np.ndarray, *others: np.ndarray) -> list[tuple[int, tuple[bytes, ...]]]:
    """(shard, blobs of keys and others) by the first bits of the keys."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    arrays = [x[order] for x in (keys, *others)]
    return [(int(shard[a]), tuple(x[a:b].tobytes() for x in arrays)) for a, b in cuts(shard)]
