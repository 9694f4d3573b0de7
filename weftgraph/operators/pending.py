"""Values that expire: parked payloads, used nonces and replies, shared by all processes of a store.

A value is a numbered file (see ``sources.numbered``) below its kind and key, with the time until which it holds. A key is claimed by
adding the next number, which one claimant gets, so a nonce is used once however many processes try, also after a restart. Time is the
caller's: ``clock`` returns seconds. ``sweep`` removes what has expired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import SparkSession

from weftgraph.sources.numbered import Conflict, Numbered


class Pending:
    """Expiring values below a root folder."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float]):
        self.root, self.clock = f"{root.rstrip('/')}/_pending", clock
        self._files = Numbered(spark, self.root)

    def _folder(self, kind: str, key: str) -> str:
        return f"{self.root}/{kind}/{hashlib.sha256(key.encode()).hexdigest()}"

    def get(self, kind: str, key: str) -> dict | None:
        """The value of a key, None if there is none or it has expired."""
        _, held = self._files.latest(self._folder(kind, key))
        return held["value"] if held and self.clock() <= held["until"] else None

    def claim(self, kind: str, key: str, value: dict, seconds: float) -> bool:
        """Sets a value unless the key holds one that has not expired; of several claimants at once one succeeds."""
        folder = self._folder(kind, key)
        at, held = self._files.latest(folder)
        if held and self.clock() <= held["until"]:
            return False
        try:
            self._files.add(folder, at, {"until": self.clock() + seconds, "value": value})
        except Conflict:
            return False
        return True

    def drop(self, kind: str, key: str) -> None:
        """Ends a value at once."""
        self._files.remove(self._folder(kind, key))

    def sweep(self) -> list[dict]:
        """Removes what has expired and returns the values, for what they name may go too."""
        gone = []
        for kind in self._files.folders(self.root):
            for folder in self._files.folders(kind):
                held = self._files.latest(folder)[1]
                if held is None or self.clock() > held["until"]:
                    self._files.remove(folder)
                    gone += [held["value"]] if held else []
        return gone
