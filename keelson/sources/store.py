"""A table's files: immutable parquet segments and a chain of manifests that says which of them are live.

A statement writes one segment and commits one manifest; the manifest's version is the segment's sequence number, so newer
rows of a key shadow older ones and a table can be read as of any manifest that is kept. Rows of the log (segments not yet
folded) come before the sorted runs, newest first. Readers take the newest manifest whose checksum holds.

    <root>/t-<name>/manifest/<version>.json
    <root>/t-<name>/segments/<version>-<unique>/*.parquet     user columns, @seq, @deleted
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError
from ..plans.schema import TableSchema
from .shared import Files

#: Columns beside the user's; no user column can have such a name.
SEQ, DELETED = "@seq", "@deleted"


@dataclass(frozen=True)
class Segment:
    path: str
    rows: int
    tombstones: int
    #: On disk.
    bytes: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    log: tuple[Segment, ...] = ()
    runs: tuple[Segment, ...] = ()

    @property
    def segments(self) -> tuple[Segment, ...]:
        """Newest first."""
        return self.log + self.runs

    def to_text(self) -> str:
        body = json.dumps({"version": self.version, "log": [asdict(s) for s in self.log], "runs": [asdict(s) for s in self.runs]})
        return f"{zlib.crc32(body.encode()):08x} {body}"

    @classmethod
    def from_text(cls, text: str) -> Manifest | None:
        """None if the checksum doesn't hold."""
        check, _, body = text.partition(" ")
        if check != f"{zlib.crc32(body.encode()):08x}":
            return None
        x = json.loads(body)
        return cls(x["version"], tuple(Segment(**s) for s in x["log"]), tuple(Segment(**s) for s in x["runs"]))


@dataclass
class Options:
    """flush_rows: compaction folds the log from so many keys on. growth: merges a run with the next if that has at most so
    many times its rows; 1 or less merges none. keep: manifests, and what they name, that stay readable."""

    flush_rows: int = 0
    growth: float = 0.0
    keep: int = 4
    #: Rows, and bytes on disk, of newer segments up to which a reader broadcasts their keys to the oldest run.
    broadcast_rows: int = 50_000
    broadcast_bytes: int = 16 << 20
    #: Rows of newer segments up to which it broadcasts a filter of their keys (10 bits each).
    bloom_rows: int = 1 << 26


def folder_name(name: str) -> str:
    """A name for a folder, different for every table even where case doesn't count."""
    return "t-" + "".join(f"-{c.lower()}" if c.isupper() else c for c in name)


@dataclass
class SegmentStore:
    spark: SparkSession
    root: str
    schema: TableSchema
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        self.folder = f"{self.root.rstrip('/')}/{folder_name(self.schema.name)}"
        self.files = Files(self.spark, self.root)

    # manifests

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.folder}/manifest") if n.endswith(".json") and n[:-5].isdigit()]

    def _manifest_path(self, version: int) -> str:
        return f"{self.folder}/manifest/{version:020d}.json"

    def read_manifest(self, version: int) -> Manifest | None:
        return Manifest.from_text(self.files.read(self._manifest_path(version)))

    def live(self) -> Manifest:
        for version in reversed(self.versions()):
            if found := self.read_manifest(version):
                return found
        return Manifest()

    def next_version(self) -> int:
        return max(self.versions(), default=0) + 1

    def commit(self, manifest: Manifest) -> Manifest:
        """Make the manifest the live one. Refused unless its version is newer than any there is."""
        if manifest.version <= max(self.versions(), default=0) or not self.files.create(self._manifest_path(manifest.version), manifest.to_text()):
            raise ConflictError(f"manifest version {manifest.version} must exceed the current one")
        self._forget()
        return manifest

    def _forget(self) -> None:
        """Remove manifests beyond those kept, and segments that no kept one names. Segments of statements under way have
        versions beyond the newest manifest's and stay."""
        versions = self.versions()
        kept = versions[-self.options.keep :]
        named = {s.path for v in kept if (m := self.read_manifest(v)) for s in m.segments}
        for version in versions[: -self.options.keep]:
            self.files.remove(self._manifest_path(version))
        if kept:
            for name in self.files.names(f"{self.folder}/segments"):
                if int(name.partition("-")[0]) <= kept[-1] and name not in named:
                    self.files.remove(f"{self.folder}/segments/{name}")

    # segments

    @property
    def stored(self) -> T.StructType:
        return self.schema.struct(nullable=True).add(SEQ, T.LongType()).add(DELETED, T.BooleanType())

    def write(self, rows: DataFrame, version: int, sort: bool = True) -> Segment | None:
        """Write rows (user columns and @deleted; @seq if they have one) as a segment; None if there are none.

        Sorted by range of the key, so that the statistics of row groups prune points and ranges.
        """
        if SEQ not in rows.columns:
            rows = rows.withColumn(SEQ, F.lit(version).cast("bigint"))
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.stored])
        key = [f"`{k}`" for k in self.schema.key]
        if sort:
            rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
        name = f"{version}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/segments/{name}")
        written = self.read_segments([Segment(name, 0, 0)])
        counts = written.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(f"`{DELETED}`").cast("bigint")).alias("dead")).first()
        if not counts["n"]:
            self.files.remove(f"{self.folder}/segments/{name}")
            return None
        return Segment(name, counts["n"], counts["dead"] or 0, self.files.size(f"{self.folder}/segments/{name}"))

    def read_segments(self, segments) -> DataFrame:
        paths = [f"{self.folder}/segments/{s.path}" for s in segments]
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*paths)

    def append(self, rows: DataFrame, sort: bool = False) -> int:
        """Commit rows as the newest segment of the log; how many there were. Nothing is committed for none."""
        before = self.live()
        version = self.next_version()
        segment = self.write(rows, version, sort)
        if segment is None:
            return 0
        if self.live().version != before.version:
            self.files.remove(f"{self.folder}/segments/{segment.path}")
            raise ConflictError("another statement committed first")
        self.commit(Manifest(version, (segment, *before.log), before.runs))
        return segment.rows
