"""Machines as state: what is large in one is kept apart, by content, so that a batch writes what it changed.

A pickled machine refers to each longer run of bytes in it (pieces that wait, bodies that fill, messages that wait for an answer) by a hash.  The runs
themselves are entries of a map; one that stays is neither pickled nor written again.  Arrays that grow are cut into blocks, of which
only the last one changes.
"""

from __future__ import annotations

import io
import pickle
from hashlib import blake2b

from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

#: Bytes from which a run is kept apart, and of a block of an array.
APART, BLOCK = 64, 4096


class _Pickler(pickle.Pickler):
    def __init__(self, out: io.BytesIO):
        super().__init__(out, protocol=5)
        self.parts: dict[str, bytes] = {}

    def _apart(self, data: bytes) -> str:
        name = blake2b(data, digest_size=16).hexdigest()
        self.parts[name] = data
        return name

    def persistent_id(self, obj):
        if type(obj) is bytes and len(obj) >= APART:
            return self._apart(obj)
        if type(obj) is bytearray and len(obj) >= APART:
            return tuple(self._apart(bytes(obj[at : at + BLOCK])) for at in range(0, len(obj), BLOCK))
        return None


class _Unpickler(pickle.Unpickler):
    def __init__(self, data: bytes, parts: dict[str, bytes]):
        super().__init__(io.BytesIO(data))
        self.parts = parts

    def persistent_load(self, name):
        return bytearray().join(self.parts[n] for n in name) if isinstance(name, tuple) else self.parts[name]


def taken_apart(machine) -> tuple[bytes, dict[str, bytes]]:
    """What remains of a machine, and its longer runs of bytes by their hashes."""
    out = io.BytesIO()
    pickler = _Pickler(out)
    pickler.dump(machine)
    return out.getvalue(), pickler.parts


def put_together(data: bytes, parts: dict[str, bytes]):
    return _Unpickler(data, parts).load()


class Kept:
    """A key's machine in two states of a processor; ``load`` comes before ``save``."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.core = handle.getValueState(name, "data binary")
        self.parts = handle.getMapState(f"{name}_parts", "name string", "data binary")

    def load(self):
        """The machine, None if there is none."""
        stored = self.core.get()
        self.there: dict[str, bytes] = {k[0]: bytes(v[0]) for k, v in self.parts.iterator()} if stored else {}
        return put_together(bytes(stored[0]), self.there) if stored else None

    def save(self, machine) -> None:
        core, parts = taken_apart(machine)
        for name in self.there.keys() - parts.keys():
            self.parts.removeKey((name,))
        for name in parts.keys() - self.there.keys():
            self.parts.updateValue((name,), (parts[name],))
        self.core.update((core,))

    def clear(self) -> None:
        self.core.clear()
        self.parts.clear()
