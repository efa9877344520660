"""Compaction: the log is folded into a run, and runs of like size into one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.store import Manifest, Segment, SegmentStore
from .merge import alive, key_columns, newest


def _merged(store: SegmentStore, parts: tuple[Segment, ...], version: int, purge: bool) -> Segment | None:
    rows = newest(store.read_segments(parts), store.schema)
    return store.write(alive(rows) if purge else rows, version)


def log_keys(store: SegmentStore, manifest: Manifest) -> int:
    """Distinct keys in the log, the dead included. One segment has no key twice."""
    if len(manifest.log) == 1:
        return manifest.log[0].rows
    return store.read_segments(manifest.log).select(*key_columns(store.schema)).distinct().agg(F.count(F.lit(1))).first()[0]


def flush(store: SegmentStore) -> bool:
    """Fold the log into a new run on top, tombstones kept."""
    now = store.live()
    if not now.log:
        return False
    version = store.next_version()
    run = _merged(store, now.log, version, purge=False)
    store.commit(Manifest(version, (), (run, *now.runs) if run else now.runs))
    return True


def compact(store: SegmentStore) -> None:
    """Flush if the log has reached its size, then merge neighbours until every run is more than `growth` times the one above it.
    The merge into the last run drops tombstones, as nothing lies below that they could hide."""
    options = store.options
    now = store.live()
    if now.log and (options.flush_rows <= 1 or sum(s.rows for s in now.log) >= options.flush_rows and log_keys(store, now) >= options.flush_rows):
        flush(store)
    at = 0
    while at + 1 < len((now := store.live()).runs):
        upper, lower = now.runs[at : at + 2]
        if options.growth <= 1 or lower.rows > options.growth * upper.rows:
            at += 1
            continue
        version = store.next_version()
        run = _merged(store, (upper, lower), version, purge=at + 2 == len(now.runs))
        store.commit(Manifest(version, now.log, now.runs[:at] + ((run,) if run else ()) + now.runs[at + 2 :]))
