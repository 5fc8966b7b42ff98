"""Leases on parts of a product: files that a store creates for one owner only, with heartbeats and a stale threshold.

This is driver-side coordination, not a Spark operation.
"""

from __future__ import annotations

import hashlib
import json
import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.storage import Store


class ClaimConflictError(RuntimeError):
    """Someone else holds the lease."""


@dataclass
class Claims:
    spark: SparkSession
    root: str
    threshold_s: float = 900.0

    @property
    def store(self) -> Store:
        return Store(self.spark)

    def path(self, product: str, category: str, name: str) -> str:
        return f"{self.root}/{hashlib.sha256(f'{product}:{category}:{name}'.encode()).hexdigest()}.json"

    def acquire(self, product: str, category: str, name: str, owner: str, now: float | None = None) -> str:
        """Creates the lease or raises; a lease is never taken over silently, stale or not."""
        path = self.path(product, category, name)
        body = {"product": product, "category": category, "name": name, "owner": owner, "heartbeat": time.time() if now is None else now}
        try:
            self.store.write(path, json.dumps(body).encode(), overwrite=False)
        except FileExistsError:
            raise ClaimConflictError(f"{category} {name} of {product} is claimed") from None
        return path

    def _body(self, path: str) -> dict:
        return json.loads(self.store.read(path))

    def beat(self, path: str, now: float | None = None) -> None:
        body = self._body(path) | {"heartbeat": time.time() if now is None else now}
        self.store.write(f"{path}.new", json.dumps(body).encode())
        self.store.replace(f"{path}.new", path)

    def release(self, path: str, owner: str) -> None:
        if self._body(path)["owner"] != owner:
            raise ClaimConflictError("the lease belongs to someone else")
        self.store.delete(path)

    @contextmanager
    def held(self, product: str, category: str, name: str, owner: str):
        """The lease for the time of a block."""
        path = self.acquire(product, category, name, owner)
        try:
            yield path
        finally:
            self.release(path, owner)

    def list(self, now: float | None = None) -> list[dict]:
        """All leases by (product, category, name), each with whether it is stale."""
        now, out = time.time() if now is None else now, []
        for name, _ in self.store.files(self.root, recursive=False):
            if name.endswith(".json"):
                body = self._body(f"{self.root}/{name}")
                out.append(body | {"stale": now - body["heartbeat"] > self.threshold_s, "path": f"{self.root}/{name}"})
        return sorted(out, key=lambda c: (c["product"], c["category"], c["name"]))

    def clear_stale(self, now: float | None = None, dry_run: bool = True) -> list[str]:
        """Leases that are stale, and with dry_run off are removed; each is looked at again first."""
        found = [c["path"] for c in self.list(now) if c["stale"]]
        if not dry_run:
            for path in found:
                if any(c["path"] == path and c["stale"] for c in self.list(now)):
                    self.store.delete(path)
        return found
