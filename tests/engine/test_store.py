"""Versioned storage, compaction and the key API, against a dictionary where it is random."""

import random

import pytest

from keelson.errors import ConflictError, EngineError
from keelson.operators.merge import view
from keelson.plans.access import KeyRange
from keelson.plans.schema import TableSchema
from keelson.sources.store import Manifest, Segment, SegmentStore

BOX = TableSchema.of("box", "shelf string, tag string", "shelf")


def live(table):
    return {r.shelf: r.tag for r in table.scan().collect()}


def test_write_modes(db):
    """Each mode over keys of which some are there: what it lets through, and how many it says."""
    t = db.create(BOX)
    t.upsert([(f"s{i}", "first") for i in range(0, 20, 2)])
    model = live(t)
    for mode, lets in ((t.insert, lambda k: k not in model), (t.update, lambda k: k in model), (t.upsert, lambda k: True)):
        some = {f"s{i}": mode.__name__ for i in range(5, 26, 5)}
        through = {k: v for k, v in some.items() if lets(k)}
        assert mode([*some.items()]) == len(through)
        model |= through
        assert live(t) == model
    gone = ["s10", "s11", "s24"]
    assert t.delete(gone) == sum(k in model for k in gone) and t.delete(gone) == 0
    assert live(t) == {k: v for k, v in model.items() if k not in gone}
    assert t.get("s0") == ("s0", "first") and t.get("s10") is None


def test_newer_levels_shadow_older_ones(make):
    """Versions of one key in the log and in three runs, and a deletion: the newest holds in every state, also when reopened."""
    t = make().create(BOX)
    for n in range(4):
        t.upsert([("moving", f"version {n}"), (f"still {n}", "here")])
        if n == 2:
            t.delete(["still 0"])
        if n < 3:
            t.compact()
        want = {"moving": f"version {n}"} | {f"still {k}": "here" for k in range(n + 1) if n < 2 or k}
        assert live(t) == want == live(make().table("box"))
    now = t.manifest()
    assert [(s.rows, s.tombstones) for s in now.runs] == [(3, 1), (2, 0), (2, 0)] and len(now.log) == 1


def test_purge_in_the_last_run(make):
    t = make(growth=8.0).create(BOX)
    t.upsert([(f"s{i}", "x") for i in range(7)])
    t.compact()
    t.delete(["s1", "s3", "s5"])
    t.compact()
    assert [(s.rows, s.tombstones) for s in t.manifest().runs] == [(4, 0)]
    assert sorted(r.shelf for r in t.versions().collect()) == ["s0", "s2", "s4", "s6"]
    t.delete([f"s{i}" for i in range(7)])
    t.compact()
    assert t.manifest().runs == () and live(t) == {}


def test_policy_bounds_the_levels(make):
    t = make(flush_rows=3, growth=2.0, keep=1).create(BOX)
    for i in range(5):
        t.upsert([(f"{c}{i}", "x") for c in "pqrs"])
        t.compact()
    now = t.manifest()
    assert len(now.runs) <= 3 and len(live(t)) == 20 and not now.log
    assert all(a.rows * 2 < b.rows for a, b in zip(now.runs, now.runs[1:], strict=False))
    assert set(t.store.files.names(f"{t.store.folder}/segments")) == {s.path for s in now.segments}
    for tag in ("x", "y", "z", "w"):  # four versions of one key are one key, below the size of a flush
        t.upsert([("p0", tag)])
        t.compact()
    assert len(t.manifest().log) == 4


def test_manifests(db):
    t = db.create(BOX)
    for tag in ("red", "blue"):
        t.upsert([("s1", tag)])
    store: SegmentStore = t.store
    for stale in (1, 2):
        with pytest.raises(ConflictError):
            store.commit(Manifest(stale))
    assert [r.tag for r in t.as_of(1).collect()] == ["red"]
    store.files.create(store._manifest_path(3), "torn")
    assert store.live().version == 2 and live(t) == {"s1": "blue"}
    t.upsert([("s1", "green")])
    assert store.live().version == 4 and live(t) == {"s1": "green"}
    with pytest.raises(EngineError):
        t.as_of(3)
    text = Manifest(9, (Segment("x", 1, 0),)).to_text()
    assert Manifest.from_text(text).log[0].rows == 1 and Manifest.from_text(text.replace("9", "8", 1)) is None


def test_two_writers_of_one_version(db):
    """The second of two that commit one version is refused, and the file is the first one's, whole."""
    t = db.create(BOX)
    t.upsert([("s1", "red")])
    path = t.store._manifest_path(2)
    assert t.store.files.create(path, "one") and not t.store.files.create(path, "two")
    assert t.store.files.read(path) == "one" and t.store.files.names(f"{t.store.folder}/manifest") == [f"{v:020d}.json" for v in (1, 2)]


def test_readers_keep_their_version(db):
    t = db.create(BOX)
    t.upsert([("s1", "red")])
    before = t.scan()
    t.upsert([("s1", "blue")])
    t.compact()
    assert [r.tag for r in before.collect()] == ["red"]


def test_loads(db, spark):
    shape = "shelf string, tag string"
    t = db.load(BOX, spark.createDataFrame([("s2", "x"), ("s1", "y")], shape))
    assert [r.shelf for r in t.scan().collect()] == ["s1", "s2"] and len(t.manifest().runs) == 1
    two = TableSchema.of("two", shape, "shelf")
    with pytest.raises(EngineError, match="duplicate primary key"):
        db.load(two, spark.createDataFrame([("s2", "x"), ("s2", "y")], shape))
    with pytest.raises(EngineError, match="null"):
        t.upsert(spark.createDataFrame([("s2", None)], shape))
    with pytest.raises(EngineError, match="no such column"):
        t.upsert(spark.createDataFrame([("s2",)], "shelf string"))
    empty = db.load(TableSchema.of("none", "shelf string", "shelf"), spark.createDataFrame([], "shelf string"))
    assert empty.scan().count() == 0 and empty.delete(["s1"]) == 0


def test_key_ranges(db):
    """Every request over a small table against Python: bounds of whole keys and of prefixes, upwards and downwards."""
    keys = [(a, b) for a in (-5, 0, 9) for b in ("", "m", "mm")]
    t = db.create(TableSchema.of("pair", "v int64, b string, a int64", "a, b"))
    t.upsert([(i, b, a) for i, (a, b) in enumerate(keys)])
    holds = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    for first in ("<", "<=", ">", ">="):
        for last in ("<", "<=") if first[0] == ">" else (">", ">="):
            for x in ((0,), (0, "m"), (-6, "z"), None):
                for y in ((9,), (9, "m"), None):
                    if first[0] == "<":
                        x, y = y, x
                    want = [k for k in keys if (x is None or holds[first](k[: len(x)], x)) and (y is None or holds[last](k[: len(y)], y))]
                    got = [(r.a, r.b) for r in t.range(KeyRange.request(first, x, last, y)).collect()]
                    assert got == (want if first[0] == ">" else want[::-1]), (first, x, last, y)
                    if first[0] == "<":
                        x, y = y, x
    assert [(r.a, r.b) for r in t.seek(0, "n").collect()] == [k for k in keys if k >= (0, "n")]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes(make, seed):
    rng = random.Random(seed)
    db = make(flush_rows=4, growth=2.0, broadcast_rows=rng.choice([0, 1000]), bloom_rows=(0, 1 << 20)[seed % 2])
    t = db.create(TableSchema.of("t", "a int64, b string, v int64", "b, a"))
    model = {}
    for step in range(14):
        keys = {(rng.randrange(4), rng.choice("xyz")) for _ in range(rng.randrange(1, 5))}
        rows = [(a, b, rng.randrange(100)) for a, b in keys]
        match rng.randrange(6):
            case 0:
                assert t.insert(rows) == sum((b, a) not in model for a, b, _ in rows)
                model = {(b, a): v for a, b, v in rows} | model
            case 1:
                assert t.update(rows) == sum((b, a) in model for a, b, _ in rows)
                model |= {(b, a): v for a, b, v in rows if (b, a) in model}
            case 2:
                assert t.delete([(b, a) for a, b in keys]) == sum((b, a) in model for a, b in keys)
                model = {k: v for k, v in model.items() if (k[1], k[0]) not in keys}
            case 3:
                n = rng.randrange(4)
                assert db.exec(f"update t set v = v + 1000 where b >= 'y' and (b, a) < ('z', {n})").updated == sum("y" <= k[0] and k < ("z", n) for k in model)
                model = {k: v + 1000 if "y" <= k[0] and k < ("z", n) else v for k, v in model.items()}
            case 4:
                t.compact()
            case 5:
                t.upsert(rows)
                model |= {(b, a): v for a, b, v in rows}
        assert [tuple(r) for r in t.scan().collect()] == [(k[1], k[0], model[k]) for k in sorted(model)], step


def shuffled_rows(frame):
    """Rows that the exchanges of an executed frame have written."""

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        own = node.plan() if "QueryStage" in node.nodeName() else None
        if own is not None:
            return walk(own)
        metrics, children, total = node.metrics(), node.children(), 0
        if "Exchange" in node.nodeName() and metrics.contains("shuffleRecordsWritten"):
            total += metrics.apply("shuffleRecordsWritten").value()
        return total + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize(("options", "most"), [({"broadcast_rows": 0}, 2600), ({"broadcast_rows": 0, "bloom_rows": 0}, None), ({}, 2600)])
def test_the_old_run_is_not_shuffled(make, spark, options, most):
    """30,000 rows below 800 newer ones: what of the run is shuffled is about as many as the newer ones (which are read twice)."""
    db = make(**options)
    t = db.load(TableSchema.of("t", "a int64, b string, v int64", "a, b"), spark.range(30_000).selectExpr("id as a", "concat('x', id % 7) as b", "0 as v"))
    t.upsert(spark.range(600).selectExpr("id * 50 as a", "concat('x', id * 50 % 7) as b", "1 as v"))
    t.delete(spark.range(200).selectExpr("id * 150 as a", "concat('x', id * 150 % 7) as b"))
    rows = view(t.store)
    got = rows.collect()
    moved = shuffled_rows(rows)
    assert sorted(tuple(r) for r in got) == sorted((a, f"x{a % 7}", int(a % 50 == 0)) for a in range(30_000) if a % 150)
    assert moved < most if most else moved > 30_000
    assert ("might_contain" in rows._jdf.queryExecution().toString()) == ("broadcast_rows" in options and "bloom_rows" not in options)


@pytest.mark.parametrize("page", [1, 3, 100])
def test_cursors_walk_both_ways(db, page):
    """Random steps over ranges in both directions, on three levels, against an index into a list."""
    rng = random.Random(page)
    t = db.create(TableSchema.of("pair", "v int64, b string, a int64", "a, b"))
    t.upsert([(0, b, a) for a in range(5) for b in "mxz"])
    t.compact()
    t.upsert([(1, "x", a) for a in range(1, 5, 2)])
    t.delete([(2, "m"), (4, "z")])
    rows = [tuple(r) for r in t.scan().collect()]
    assert list(t.cursor(page=page)) == rows
    for wanted in (KeyRange(), KeyRange.request(">", (1,), "<=", (3,)), KeyRange.request("<=", (3, "w"), ">", (0, "m")), KeyRange.request(">=", (2, "n"), "<", (2, "o"))):
        order = rows[::-1] if wanted.descending else rows
        inside = [(r.v, r.b, r.a) for r in t.range(wanted).collect()]
        cursor = t.cursor(wanted, page)
        t.upsert([(9, "late", 2)])  # a cursor sees what was there when it was opened
        if not inside:  # stands before a row beyond the stop
            assert not cursor.valid and cursor.row is None and cursor.prev() and cursor.row == (0, "x", 1) or cursor.row == (0, "z", 1)
            t.delete([(2, "late")])
            continue
        at, end = order.index(inside[0]), order.index(inside[-1])
        assert cursor.row == order[at]
        for _ in range(25):
            if rng.random() < 0.6:
                at = min(at + 1, end + 1)
                cursor.next()
            else:
                at = max(at - 1, -1)
                cursor.prev()
            assert cursor.valid == (0 <= at <= end)
            assert cursor.row == (order[at] if cursor.valid else None)
        t.delete([(2, "late")])
