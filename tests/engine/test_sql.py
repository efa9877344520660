"""Statements end to end, and what must be refused."""

import random

import pytest

from keelson.engine import Result
from keelson.errors import EngineError
from keelson.plans.schema import TableSchema
from keelson.plans.syntax import Binary, Literal, Name, Select, Unary


def filled(db, create, *rows):
    db.exec(create)
    name = create.split()[2]
    db.table(name).upsert(rows)
    return name


def rows(db, text):
    return db.exec(text).rows()


QUAY = "create table quay (tons int64, dock string, slot int64, ship string, primary key (dock, slot))"


def test_statements_against_a_dictionary(db):
    """Inserts, updates and deletes of single keys and ranges, drawn at random, on the engine and on a dictionary."""
    rng = random.Random(3)
    db.exec(QUAY)
    model = {}
    for _ in range(12):
        dock, slot, tons = rng.choice("nsw"), rng.randrange(3), rng.randrange(900)
        at, there = f"where slot = {slot} and dock = '{dock}'", (dock, slot) in model
        match rng.randrange(4):
            case 0 | 1 if there:
                with pytest.raises(EngineError, match="duplicate primary key"):
                    db.exec(f"insert into quay values ({tons}, '{dock}', {slot}, 'x')")
            case 0 | 1:
                assert db.exec(f"insert into quay values ({tons}, '{dock}', {slot}, 'Mole');").updated == 1
                model[dock, slot] = tons
            case 2:
                assert db.exec(f"update quay set tons = tons * 2 + {tons} {at}").updated == there
                model |= {(dock, slot): model[dock, slot] * 2 + tons} if there else {}
            case 3:
                assert db.exec(f"delete from quay {at}").updated == there
                model.pop((dock, slot), None)
    got = db.exec("select dock, slot, tons, tons + slot from quay")
    assert got.header == ["dock", "slot", "tons", "col4"] and got.rows() == [(*k, v, v + k[1]) for k, v in sorted(model.items())]
    assert Result().rows() == []


def wrapped(x):
    return (x + 2**63) % 2**64 - 2**63


class Refused(Exception):
    pass


def value_of(node, row):
    """A tree's value by the dialect's rules, in plain Python."""
    truth = lambda v: v not in (0, "")
    match node:
        case Name(name):
            return row[name]
        case Literal(value):
            return value
        case Unary("not", x):
            return int(not truth(value_of(x, row)))
        case Unary(_, x):
            if isinstance(v := value_of(x, row), str):
                raise Refused
            return wrapped(-v)
        case Binary("and" | "or" as op, a, b):
            if truth(value_of(a, row)) is (op == "or"):
                return int(op == "or")
            return int(truth(value_of(b, row)))
        case Binary(op, a, b):
            x, y = value_of(a, row), value_of(b, row)
            if op in ("=", "!=", "<", "<=", ">", ">="):
                if type(x) is not type(y):
                    raise Refused
                x, y = (x.encode(), y.encode()) if isinstance(x, str) else (x, y)
                return int({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
            if isinstance(x, str) or isinstance(y, str) or op == "/" and y == 0:
                raise Refused
            return wrapped({"+": x + y, "-": x - y, "*": x * y}[op] if op != "/" else abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1))


@pytest.mark.parametrize("seed", range(3))
def test_random_expressions(db, seed):
    rng = random.Random(100 + seed)
    row = {"tons": rng.choice([7, -(2**63), 2**62 + 5]), "dock": "é", "slot": rng.choice([0, 3]), "ship": ""}
    db.exec(QUAY)
    db.table("quay").upsert([tuple(row.values())])

    def drawn(depth):
        if not depth:
            return rng.choice([Name(rng.choice([*row])), Literal(rng.choice([0, 1, -0, 2**63 - 1, "é", "z", "\U0001f600"]))])
        if rng.random() < 0.2:
            return Unary(rng.choice(["not", "-"]), drawn(depth - 1))
        return Binary(rng.choice(["+", "-", "*", "/", "and", "or", "=", "!=", "<", "<=", ">", ">="]), drawn(depth - 1), drawn(rng.randrange(depth)))

    good, bad = [], []
    while len(good) < 40 or len(bad) < 4:
        node = drawn(rng.randrange(1, 4))
        try:
            good.append((node, value_of(node, row)))
        except Refused:
            bad.append(node)
    got = db.exec_statement(Select("quay", tuple(n for n, _ in good), None)).rows()
    assert got == [tuple(v for _, v in good)]
    for node in bad[:4]:
        with pytest.raises(EngineError):
            db.exec_statement(Select("quay", (node,), None)).rows()


def test_a_change_sees_the_old_row(db):
    db.exec(QUAY)
    db.table("quay").upsert([(650, "n", 4, "Mole"), (80, "n", 5, "Rat")])
    assert db.exec("update quay set tons = slot, tons = tons + 1, ship = 'at ' where dock >= 'a'").updated == 2  # the last change of a column holds
    assert rows(db, "select slot, tons, ship from quay") == [(4, 651, "at "), (5, 81, "at ")]


def test_errors_of_rows(db):
    filled(db, "create table t (id int64, s string, primary key (id))", (1, "x"))
    for text, message in (
        ("1 / 0", "division by zero"),
        ("1 / (id - 1)", "division by zero"),
        ("s + 1", "arithmetic requires integers"),
        ("-s", "unary minus requires an integer"),
        ("s = 1", "cannot compare values of different types"),
        ("(id, s)", "cannot evaluate a list of values"),
        ("0 or -s", "unary minus requires an integer"),
    ):
        with pytest.raises(EngineError, match=message):
            db.exec(f"select {text} from t").rows()
        assert db.exec(f"select {text} from t where id > 5").rows() == []
        assert db.exec(f"select 1 or {text} from t").rows() == [(1,)]
    with pytest.raises(EngineError, match='type mismatch assigning to "s"'):
        db.exec("update t set s = id")
    assert db.exec("update t set s = id where id > 5").updated == 0
    with pytest.raises(EngineError, match="no such column"):
        db.exec("update t set s = nope")
    assert db.exec("update t set s = nope where id > 5").updated == 0
    with pytest.raises(EngineError, match="division by zero"):
        db.exec("update t set s = 1 / 0")
    assert rows(db, "select s from t") == [("x",)]


def test_refused(db):
    filled(db, "create table quay (slot int64, ship string, primary key (slot))", (4, "Mole"))
    no_column = ("select crane from quay", "select crane from quay where slot > 900", "update quay set crane = 1", "select 1 + -crane from quay")
    no_access = (
        "ship = 'Mole'", "slot = 4 or slot = 5", "not slot = 4", "slot != 4", "4 < slot", "slot > -3", "slot = 2 + 2", "slot", "crane = 4", "(slot) = (ship)", "slot > 1 and slot < 9 and slot < 8", "slot = 4 and slot = 4",
    )
    other = ("select ship from pier", "insert into quay values (7)", "insert into quay values (4, 'Rat')", "update quay set slot = 7", "create table quay (slot int64, primary key (slot))", "create table pier (a int64, primary key (b))", "create table pier (a int64, a string, primary key (a))")
    for text in (*no_column, *other):
        with pytest.raises(EngineError, match="no such column" if text in no_column else None):
            db.exec(text)
    for where in no_access:
        for text in (f"select ship from quay where {where}", f"update quay set ship = 'x' where {where}", f"delete from quay where {where}"):
            with pytest.raises(EngineError, match="unimplemented WHERE"):
                db.exec(text)
    with pytest.raises(EngineError, match="unknown statement"):
        db.exec_statement("select")
    assert rows(db, "select slot, ship from quay") == [(4, "Mole")]
    filled(db, QUAY.replace("quay", "pier"), (1, "n", 2, ""))
    for where in ("dock = 'n'", "(dock, slot) = ('n', 2)", "dock = 'n' and slot > 1", "slot > 1", "(slot, dock) > (1, 'n')", "(dock, slot) > ('n', 2, 3)", "dock = 'n' and dock = 'n'", "(dock, slot) > ('n', tons)"):
        with pytest.raises(EngineError, match="unimplemented WHERE"):
            db.exec(f"select tons from pier where {where}")


def test_ranges(db):
    """Bounds on prefixes of the key, one or two of them, against Python's comparisons of tuples."""
    keys = [(d, s) for d in ("", "n", "no", "s") for s in (-8, 0, 41)]
    filled(db, QUAY, *[(0, d, s, "x") for d, s in keys])
    holds = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    bounds = [("dock", ("n",)), ("(dock, slot)", ("n", 0)), ("(dock)", ("no",)), ("(dock, slot)", ("p", 7))]
    spelt = lambda name, value: "(" + ", ".join(repr(v) for v in value) + ")" if name[0] == "(" else repr(value[0])
    for i, (name, value) in enumerate(bounds):
        for op, test in holds.items():
            inside = [k for k in keys if test(k[: len(value)], value)]
            assert rows(db, f"select dock, slot from quay where {name} {op} {spelt(name, value)}") == inside
            far, end = bounds[(i + 1) % 4]
            back = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
            both = [k for k in inside if holds[back](k[: len(end)], end)]
            assert rows(db, f"select dock, slot from quay where {name} {op} {spelt(name, value)} and {far} {back} {spelt(far, end)}") == both
    # of two bounds on one side the right one holds; literals take the column's kind
    assert rows(db, "select slot from quay where dock > 'x' and dock > 'n'") == [(s,) for d, s in keys if d > "n"]
    assert rows(db, "select slot from quay where (dock, slot) > ('s', 'text')") == [(41,)]
    assert rows(db, "select slot from quay where slot = +41 and dock = 's'") == [(41,)]


def test_many_rows_change(db):
    filled(db, "create table quay (slot int64, tons int64, primary key (slot))", *[(s, s % 3) for s in range(20, 31)])
    assert db.exec("update quay set tons = slot * slot where slot > 26").updated == 4
    assert db.exec("delete from quay where slot <= 24").updated == 5
    assert rows(db, "select slot, tons from quay") == [(25, 1), (26, 2), (27, 729), (28, 784), (29, 841), (30, 900)]
    assert db.exec("delete from quay").updated == 6 and rows(db, "select tons from quay") == []


def test_names_and_reopening(make):
    with make() as db:
        db.exec("create table Quay (select int64, Where string, primary key (select))")
        db.exec("create table quay (slot int64, primary key (slot))")
        db.exec("insert into Quay values ('text', 650)")
        db.exec("insert into quay values (41)")
    again = make()
    assert rows(again, "select select, Where from Quay") == [(0, "")]
    assert rows(again, "select slot, 3 from quay") == [(41, 3)]
    assert again.schema("Quay").key == ("select",)


def test_pushdown(db, spark):
    schema = TableSchema.of("e", "a int64, b int64, v string", "a, b")
    db.load(schema, spark.range(1000).selectExpr("id div 10 as a", "id % 10 as b", "'x' as v"))
    plan = db.exec("select a from e where (a, b) > (50, 5)").frame._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(a)" in plan and "GreaterThanOrEqual(a,50)" in plan and "Or(" in plan
    assert "ReadSchema: struct<a:bigint,b:bigint>" in plan and "Window" not in plan
    db.exec("update e set v = 'y' where a >= 3 and a <= 4")
    plan = db.exec("select v from e where a > 50").frame._jdf.queryExecution().toString()
    assert plan.count("GreaterThan(a,50)") >= 2 and "BroadcastHashJoin" in plan


def test_the_callers_session_stays(db, spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    db.exec("create table t (a int64, primary key (a))")
    assert spark.conf.get("spark.sql.ansi.enabled") == "true" and spark.conf.get("spark.sql.caseSensitive") == "false"
