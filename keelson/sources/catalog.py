"""Schemas as data, one small file per table outside all tables' folders."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import EngineError, quoted
from ..plans.schema import TableSchema
from .shared import Files
from .store import folder_name


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.folder = f"{root.rstrip('/')}/catalog"
        self.files = Files(spark, root)
        self._known: dict[str, TableSchema] = {}

    def _path(self, name: str) -> str:
        return f"{self.folder}/{folder_name(name)}.json"

    def forget(self) -> None:
        self._known.clear()

    def find(self, name: str) -> TableSchema | None:
        if name not in self._known and self.files.exists(self._path(name)):
            self._known[name] = TableSchema.from_json(self.files.read(self._path(name)))
        return self._known.get(name)

    def get(self, name: str) -> TableSchema:
        found = self.find(name)
        if found is None:
            raise EngineError(f"table {quoted(name)} is not found")
        return found

    def create(self, schema: TableSchema) -> None:
        if self.find(schema.name) or not self.files.create(self._path(schema.name), schema.to_json()):
            raise EngineError(f"table {quoted(schema.name)} already exists")
        self._known[schema.name] = schema
