"""What the streaming modules share: the folder of driver and executors, and map states held for a batch."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tracelake-"))
    return _OWN[0]


class Held:
    """A map state during one call: an entry is asked for once and written once. Of a key that is new (``fresh``) nothing is asked."""

    def __init__(self, state, fresh: bool):
        self._state, self._fresh, self._got, self._changed = state, fresh, {}, {}

    def get(self, key: tuple):
        """The value of a key; None without one."""
        if key not in self._got:
            known = not self._fresh and self._state.containsKey(key)
            self._got[key] = tuple(self._state.getValue(key)) if known else None
        return self._got[key]

    def put(self, key: tuple, value: tuple) -> None:
        self._got[key] = self._changed[key] = value

    def clear(self) -> None:
        if not self._fresh:
            self._state.clear()
        self._fresh, self._got, self._changed = True, {}, {}

    def keys(self) -> list[tuple]:
        """The keys that the state had before the call."""
        return [] if self._fresh else [tuple(k) for k, _ in self._state.iterator()]

    def write(self) -> None:
        for key, value in self._changed.items():
            self._state.updateValue(key, value)
