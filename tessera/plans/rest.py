"""The shapes of a REST surface over stored collections: each call returns a status and a body."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mutate
from .catalog import Catalog
from .graphql import QueryError


class Rest:
    """List, read, create, change and delete documents by id or by filter."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def _rows(self, name: str, doc_id: str | None = None, cond: dict | None = None):
        rows = mutate.matching(self.catalog[name], cond or {})
        return rows if doc_id is None else rows.where(F.col("_docID") == doc_id)

    def list(self, name: str, limit: int = 100, after: str | None = None) -> tuple[int, dict]:
        """A page of docIDs in ascending order, and where the next one begins."""
        ids = self._rows(name).select("_docID")
        ids = ids.where(F.col("_docID") > after) if after is not None else ids
        page = [r[0] for r in ids.orderBy("_docID").limit(limit + 1).collect()]
        return 200, {"docIDs": page[:limit], "next": page[limit - 1] if len(page) > limit else None}

    def get(self, name: str, doc_id: str) -> tuple[int, dict]:
        row = self._rows(name, doc_id).drop("_deleted").first()
        return (404, {"error": f"no document {doc_id}"}) if row is None else (200, row.asDict(True))

    def create(self, name: str, body: dict | list[dict]) -> tuple[int, dict]:
        return self._tried(201, lambda: mutate.insert(self.catalog[name], mutate.created(self.catalog[name], body if isinstance(body, list) else [body])))

    def update(self, name: str, body: dict, doc_id: str | None = None, cond: dict | None = None) -> tuple[int, dict]:
        return self._on(name, doc_id, cond, lambda c, hit: mutate.change(c, hit, body))

    def delete(self, name: str, doc_id: str | None = None, cond: dict | None = None) -> tuple[int, dict]:
        return self._on(name, doc_id, cond, mutate.delete)

    def _on(self, name: str, doc_id: str | None, cond: dict | None, run) -> tuple[int, dict]:
        if doc_id is None and cond is None:
            return 400, {"error": "a document or a filter is wanted"}
        hit = self._rows(name, doc_id, cond)
        if doc_id is not None and hit.isEmpty():
            return 404, {"error": f"no document {doc_id}"}
        return self._tried(200, lambda: run(self.catalog[name], hit))

    @staticmethod
    def _tried(status: int, run) -> tuple[int, dict]:
        try:
            return status, {"docIDs": sorted(r[0] for r in run().select("_docID").collect())}  # those that the call touched
        except QueryError as e:
            return 400, {"error": str(e)}
