"""The engine's queries over the harness tables, each with the SQL that must give the same rows.

Tables of the model hold 64-bit integers and strings only, so they are derived: integers widened, money in cents, times in
microseconds. Tables that are only read are loaded once per application and folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .engine import Engine, Table
from .errors import EngineError
from .functions.keycodec import encode_key
from .plans.access import KeyRange
from .plans.schema import TableSchema
from .sources.exchange import write_log
from .sources.shared import fresh_root
from .sources.store import DELETED, Options

_CENTS = "cast(round({0} * 100) as bigint)"
_WIDE = "cast({0} as bigint)"

#: Derived table: source, columns with kinds and expressions (those of Spark and DuckDB agree but for times), key.
DERIVED = {
    "orders_ref": ("orders", [("o_orderkey", "int64", _WIDE), ("o_custkey", "int64", _WIDE), ("o_orderstatus", "string", "{0}"), ("o_totalprice_c", "int64", _CENTS.format("o_totalprice")), ("o_orderdate_us", "int64", "@o_orderdate"), ("o_orderpriority", "string", "{0}")], "o_orderkey"),
    "customer_name": ("customer", [("c_name", "string", "{0}"), ("c_custkey", "int64", _WIDE), ("c_nationkey", "int64", _WIDE), ("c_acctbal_c", "int64", _CENTS.format("c_acctbal")), ("c_mktsegment", "string", "{0}")], "c_name"),
    "conv": ("conversations", [("conv_id", "int64", _WIDE), ("turn", "int64", _WIDE), ("role", "string", "{0}"), ("text", "string", "{0}")], "conv_id, turn"),
    "ev": ("events", [("user_id", "int64", _WIDE), ("event_id", "int64", _WIDE), ("ts_us", "int64", "@ts"), ("event_type", "string", "{0}"), ("value_c", "int64", _CENTS.format("value")), ("props", "string", "{0}")], "user_id, event_id"),
    "ev_type": ("events", [("event_type", "string", "{0}"), ("user_id", "int64", _WIDE), ("event_id", "int64", _WIDE), ("value_c", "int64", _CENTS.format("value"))], "event_type, user_id, event_id"),
    "ev_keys": ("events", [("user_id", "int64", _WIDE), ("event_id", "int64", _WIDE)], "user_id, event_id"),
    "part_ref": ("part", [("p_partkey", "int64", _WIDE), ("p_name", "string", "{0}"), ("p_brand", "string", "{0}"), ("p_type", "string", "{0}"), ("p_size", "int64", _WIDE), ("p_retailprice_c", "int64", _CENTS.format("p_retailprice"))], "p_partkey"),
    "nation_ref": ("nation", [("n_nationkey", "int64", _WIDE), ("n_name", "string", "{0}"), ("n_regionkey", "int64", _WIDE)], "n_nationkey"),
}
_LINE = TableSchema.of("line_versions", "l_orderkey int64, l_linenumber int64, l_quantity int64, l_extendedprice_c int64", "l_orderkey, l_linenumber")


def derived_schema(name: str) -> TableSchema:
    _, columns, key = DERIVED[name]
    return TableSchema.of(name, ", ".join(f"{n} {kind}" for n, kind, _ in columns), key)


def _expression(name: str, rule: str, time: str) -> str:
    return time.format(rule[1:]) if rule.startswith("@") else rule.format(name)


def derived_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, _ = DERIVED[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return rows.selectExpr(*[f"{_expression(n, r, 'unix_micros(cast({0} as timestamp))')} as {n}" for n, _, r in columns])


def derived_sql(name: str) -> str:
    source, columns, _ = DERIVED[name]
    return f"(select {', '.join(f'{_expression(n, r, "epoch_us({0})")} as {n}' for n, _, r in columns)} from {source})"


_LOADED: dict[tuple, Engine] = {}


def loaded(spark: SparkSession, sf_dir: str, name: str) -> Engine:
    """An engine with the derived table, for reading."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _LOADED:
        engine = Engine(spark, fresh_root(spark, "tables"))
        engine.load(derived_schema(name), derived_frame(engine.spark, sf_dir, name))
        _LOADED[at] = engine
    return _LOADED[at]


def fresh(spark: SparkSession, sf_dir: str, name: str, options: Options | None = None) -> Engine:
    """An engine of its own with the derived table, for changing."""
    engine = Engine(spark, fresh_root(spark, "tables"), options)
    engine.load(derived_schema(name), derived_frame(engine.spark, sf_dir, name))
    return engine


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _select(name: str, table: str, text: str, outputs: str, where: str = "true") -> None:
    """A SELECT, and its meaning in DuckDB."""
    _QUERIES[name] = lambda spark, sf_dir: loaded(spark, sf_dir, table).exec(text).frame
    _SQL[name] = f"select {outputs} from {derived_sql(table)} where {where}"


def _changes(name: str, table: str, statements: list[str], outputs: str, sql: str) -> None:
    """Statements, then a SELECT; sql gives the table's rows after them, as those of {0} changed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = fresh(spark, sf_dir, table)
        for statement in statements:
            engine.exec(statement)
        return engine.exec(f"select {outputs} from {table}").frame

    _QUERIES[name] = run
    _SQL[name] = sql.format(derived_sql(table))


def _bool(condition: str) -> str:
    return f"cast({condition} as bigint)"


def _wrapped(value: str) -> str:
    """A value of hugeint as the 64-bit integer it wraps to."""
    m, h = "18446744073709551616::hugeint", "9223372036854775808::hugeint"
    return f"(((({value}) + {h}) % {m} + {m}) % {m} - {h})::bigint"


_select("scan_full", "conv", "select conv_id, turn, role, text from conv", "conv_id, turn, role, text")
_select("scan_all_key", "ev_keys", "select user_id, event_id from ev_keys", "user_id, event_id")
_select("scan_constant", "nation_ref", "select 1 from nation_ref", "cast(1 as bigint) as col1")
_select("flagship_range", "orders_ref", "select o_orderkey, o_totalprice_c / 100, o_custkey = 899 from orders_ref where o_orderkey >= 10 and o_orderkey < 2000", f"o_orderkey, o_totalprice_c // 100 as col2, {_bool('o_custkey = 899')} as col3", "o_orderkey >= 10 and o_orderkey < 2000")
_select("project_arith", "part_ref", "select p_partkey, (2 + p_size) * 4 - p_retailprice_c / 7, p_size + 2 * 3 - 1 from part_ref", "p_partkey, (2 + p_size) * 4 - p_retailprice_c // 7 as col2, p_size + 5 as col3")
_select("project_div_trunc_neg", "customer_name", "select c_name, (c_acctbal_c - 500000) / 7, c_acctbal_c / -3 from customer_name", "c_name, (c_acctbal_c - 500000) // 7 as col2, c_acctbal_c // -3 as col3")
_select("project_cmp_int", "part_ref", "select p_partkey, p_size = 10, p_size != 10, p_size <> 3, p_size < 10, p_size <= 10, p_size > 10, p_size >= 10 from part_ref", "p_partkey, " + ", ".join(f"{_bool(f'p_size {op}')} as col{i}" for i, op in enumerate(["= 10", "!= 10", "!= 3", "< 10", "<= 10", "> 10", ">= 10"], 2)))
_select("project_cmp_str", "conv", "select conv_id, turn, role = 'user', role < 'b', text >= 'Z', text != 'x' from conv", f"""conv_id, turn, {_bool("role = 'user'")} as col3, {_bool("role < 'b'")} as col4, {_bool("text >= 'Z'")} as col5, {_bool("text != 'x'")} as col6""")
_select("project_logic", "part_ref", "select p_partkey, p_size > 10 and p_size < 30, p_size < 5 or p_size > 45, p_size and 0 or p_partkey from part_ref", f"p_partkey, {_bool('p_size > 10 and p_size < 30')} as col2, {_bool('p_size < 5 or p_size > 45')} as col3, {_bool('p_partkey != 0')} as col4")
_select("project_not_neg", "part_ref", "select p_partkey, not p_size, not not p_size > 3, - -p_size, -p_size + 10, not (p_size < 9) from part_ref", f"p_partkey, {_bool('p_size = 0')} as col2, {_bool('p_size > 3')} as col3, p_size as col4, 10 - p_size as col5, {_bool('p_size >= 9')} as col6")
_select("project_truthy_str", "conv", "select conv_id, turn, not text, role and 1 from conv", f"conv_id, turn, {_bool('length(text) = 0')} as col3, {_bool('length(role) > 0')} as col4")
_select("project_shortcircuit_div", "nation_ref", "select n_nationkey, n_regionkey = 0 or 10 / n_regionkey > 3, n_regionkey != 0 and 10 / n_regionkey > 3 from nation_ref", "n_nationkey, case when n_regionkey = 0 then 1 else cast(10 // n_regionkey > 3 as bigint) end as col2, case when n_regionkey = 0 then 0 else cast(10 // n_regionkey > 3 as bigint) end as col3")
_select("project_wrap_mul", "orders_ref", "select o_orderkey, o_totalprice_c * 9223372036854775807, o_orderdate_us * o_orderdate_us from orders_ref", f"o_orderkey, {_wrapped('o_totalprice_c::hugeint * 9223372036854775807')} as col2, {_wrapped('o_orderdate_us::hugeint * o_orderdate_us')} as col3")
_select("project_wrap_add", "orders_ref", "select o_orderkey, o_totalprice_c + 9223372036854775807, -9223372036854775807 - o_totalprice_c from orders_ref", f"o_orderkey, {_wrapped('o_totalprice_c::hugeint + 9223372036854775807')} as col2, {_wrapped('-9223372036854775807::hugeint - o_totalprice_c')} as col3")
_select("project_wrap_neg", "nation_ref", "select n_nationkey, -(-9223372036854775807 - 1), (-9223372036854775807 - 1) / (n_nationkey - n_nationkey - 1) from nation_ref", "n_nationkey, (-9223372036854775808)::bigint as col2, (-9223372036854775808)::bigint as col3")
_select("project_chain_cmp", "part_ref", "select p_partkey, p_size = 10 = 1, p_size > 10 < 1 = 1 from part_ref", f"p_partkey, {_bool('p_size = 10')} as col2, {_bool('p_size <= 10')} as col3")
_select("point_int", "orders_ref", "select o_orderkey, o_orderstatus from orders_ref where o_orderkey = 37", "o_orderkey, o_orderstatus", "o_orderkey = 37")
_select("point_str", "customer_name", "select c_custkey, c_mktsegment from customer_name where c_name = 'Customer#000000042'", "c_custkey, c_mktsegment", "c_name = 'Customer#000000042'")
_select("point_composite", "conv", "select conv_id, turn, text from conv where conv_id = 3 and turn = 1", "conv_id, turn, text", "conv_id = 3 and turn = 1")
_select("point_commuted", "conv", "select conv_id, turn, text from conv where turn = 1 and conv_id = 3", "conv_id, turn, text", "conv_id = 3 and turn = 1")
_select("point_miss", "orders_ref", "select o_custkey from orders_ref where o_orderkey = 9000000000", "o_custkey", "false")
for _op, _word in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le")):
    _select(f"range_{_word}", "orders_ref", f"select o_orderkey, o_custkey from orders_ref where o_orderkey {_op} 1000", "o_orderkey, o_custkey", f"o_orderkey {_op} 1000")
    _select(f"range_prefix_{_word}", "ev", f"select user_id, event_id, event_type from ev where user_id {_op} 12", "user_id, event_id, event_type", f"user_id {_op} 12")
    _select(f"range_tuple_{_word}", "ev", f"select user_id, event_id, value_c from ev where (user_id, event_id) {_op} (12, 500)", "user_id, event_id, value_c", f"(user_id, event_id) {_op} (12, 500)")
_select("range_two_sided", "orders_ref", "select o_orderkey from orders_ref where o_orderkey > 100 and o_orderkey <= 900", "o_orderkey", "o_orderkey > 100 and o_orderkey <= 900")
_select("range_empty", "orders_ref", "select o_orderkey from orders_ref where o_orderkey > 900 and o_orderkey < 100", "o_orderkey", "false")
_select("range_tuple_between", "ev", "select user_id, event_id from ev where (user_id, event_id) >= (3, 100) and (user_id, event_id) < (9, 400)", "user_id, event_id", "(user_id > 3 or user_id = 3 and event_id >= 100) and (user_id < 9 or user_id = 9 and event_id < 400)")
_select("range_mixed_prefix", "ev", "select user_id, event_id from ev where user_id >= 5 and (user_id, event_id) < (8, 300)", "user_id, event_id", "user_id >= 5 and (user_id < 8 or user_id = 8 and event_id < 300)")
_select("range_same_side_last_wins", "orders_ref", "select o_orderkey from orders_ref where o_orderkey > 800 and o_orderkey > 500", "o_orderkey", "o_orderkey > 500")
_select("range_retyped_literal", "orders_ref", "select o_orderkey from orders_ref where o_orderkey >= 'abc'", "o_orderkey", "o_orderkey >= 0")
_select("range_plus_literal", "orders_ref", "select o_orderkey from orders_ref where o_orderkey > +500", "o_orderkey", "o_orderkey > 500")
_select("range_str", "customer_name", "select c_name, c_custkey from customer_name where c_name >= 'Customer#000000010' and c_name < 'Customer#00000002'", "c_name, c_custkey", "c_name >= 'Customer#000000010' and c_name < 'Customer#00000002'")
_select("range_str_prefix", "ev_type", "select event_type, user_id, event_id from ev_type where event_type >= 'c' and event_type <= 'purchase'", "event_type, user_id, event_id", "event_type >= 'c' and event_type <= 'purchase'")
_select("range_mixed_types", "ev_type", "select event_type, user_id, event_id, value_c from ev_type where (event_type, user_id) > ('click', 10) and (event_type, user_id, event_id) <= ('view', 5, 700)", "event_type, user_id, event_id, value_c", "(event_type > 'click' or event_type = 'click' and user_id > 10) and (event_type < 'view' or event_type = 'view' and (user_id < 5 or user_id = 5 and event_id <= 700))")


def _api(name: str, table: str, run: Callable[[Table], DataFrame], where: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: run(loaded(spark, sf_dir, table).table(table))
    _SQL[name] = f"select * from {derived_sql(table)} where {where}"


_api("api_scan", "nation_ref", lambda t: t.scan(), "true")
_api("api_seek", "ev", lambda t: t.seek(12, 500), "(user_id, event_id) >= (12, 500)")
_api("api_range_desc", "ev", lambda t: t.range(KeyRange.request("<=", (12,), ">", (3, 100))), "user_id <= 12 and (user_id, event_id) > (3, 100)")
_api("api_range_desc_from_top", "orders_ref", lambda t: t.range(KeyRange.request("<=", (10**15,), ">=", (500,))), "o_orderkey >= 500")

_changes("dml_update_expr", "orders_ref", ["update orders_ref set o_totalprice_c = o_totalprice_c * 2 + 1, o_orderstatus = 'X' where o_orderkey >= 100 and o_orderkey < 900"], "o_orderkey, o_totalprice_c, o_orderstatus", "select o_orderkey, case when o_orderkey >= 100 and o_orderkey < 900 then o_totalprice_c * 2 + 1 else o_totalprice_c end as o_totalprice_c, case when o_orderkey >= 100 and o_orderkey < 900 then 'X' else o_orderstatus end as o_orderstatus from {0}")
_changes("dml_update_swap", "part_ref", ["update part_ref set p_size = p_retailprice_c, p_retailprice_c = p_size, p_name = p_brand, p_brand = p_name"], "p_partkey, p_name, p_brand, p_size, p_retailprice_c", "select p_partkey, p_brand as p_name, p_name as p_brand, p_retailprice_c as p_size, p_size as p_retailprice_c from {0}")
_changes("dml_update_all", "nation_ref", ["update nation_ref set n_regionkey = n_regionkey * 10", "update nation_ref set n_regionkey = n_regionkey + 1 where n_nationkey = 7"], "n_nationkey, n_name, n_regionkey", "select n_nationkey, n_name, n_regionkey * 10 + cast(n_nationkey = 7 as bigint) as n_regionkey from {0}")
_changes("dml_delete_range", "orders_ref", ["delete from orders_ref where o_orderkey >= 100 and o_orderkey < 900"], "o_orderkey, o_custkey", "select o_orderkey, o_custkey from {0} where not (o_orderkey >= 100 and o_orderkey < 900)")
_changes("dml_delete_all", "nation_ref", ["delete from nation_ref"], "n_nationkey, n_name", "select n_nationkey, n_name from {0} where false")
_changes("dml_delete_then_insert", "nation_ref", ["delete from nation_ref where n_nationkey <= 10", "insert into nation_ref values (3, 'again', 9)"], "n_nationkey, n_name, n_regionkey", "select * from {0} where n_nationkey > 10 union all select 3, 'again', 9")
_changes("dml_insert_visible", "nation_ref", ["insert into nation_ref values (100, 'new', -5)", "insert into nation_ref values (101, \"it's\", 'zero')"], "n_nationkey, n_name, n_regionkey", "select * from {0} union all select 100, 'new', -5 union all select 101, 'it''s', 0")


def _batch(name: str, source: str, key: str, changes: dict[str, tuple[str, str]], write: Callable[[Table, DataFrame], object], sql: str) -> None:
    """A write of rows made from the table's own: keys tripled, so that some are there and others not, and columns changed
    (as changes says, for Spark and for DuckDB)."""

    def made(dialect: int) -> list[str]:
        return [f"{key} * 3 as {n}" if n == key else f"{changes[n][dialect]} as {n}" if n in changes else n for n, _, _ in DERIVED[source][1]]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = fresh(spark, sf_dir, source)
        moved = derived_frame(engine.spark, sf_dir, source).selectExpr(*made(0))
        table = engine.table(source)
        write(table, moved)
        return table.scan()

    old, new = derived_sql(source), f"(select {', '.join(made(1))} from {derived_sql(source)})"
    _QUERIES[name] = run
    _SQL[name] = sql.format(old=old, new=new, key=key)


#: The same writes over a table of fixed size and over one that grows.
for _suffix, _source, _key, _made in (
    ("", "nation_ref", "n_nationkey", {"n_name": ("concat('new ', n_name)", "'new ' || n_name"), "n_regionkey": ("n_regionkey + 100",) * 2}),
    ("_orders", "orders_ref", "o_orderkey", {"o_orderpriority": ("concat('new ', o_orderpriority)", "'new ' || o_orderpriority"), "o_totalprice_c": ("o_totalprice_c + 100",) * 2}),
):
    _batch(f"dml_upsert{_suffix}", _source, _key, _made, lambda t, rows: t.upsert(rows), "select * from {new} union all select * from {old} where {key} not in (select {key} from {new})")
    _batch(f"dml_insert_if_absent{_suffix}", _source, _key, _made, lambda t, rows: t.insert(rows), "select * from {old} union all select * from {new} where {key} not in (select {key} from {old})")
    _batch(f"dml_update_if_present{_suffix}", _source, _key, _made, lambda t, rows: t.update(rows), "select * from {new} where {key} in (select {key} from {old}) union all select * from {old} where {key} not in (select {key} from {new})")
    _batch(f"dml_delete_keys{_suffix}", _source, _key, _made, lambda t, rows: t.delete(rows.select(*t.schema.key)), "select * from {old} where {key} not in (select {key} from {new})")


def _line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return rows.withColumn("v", F.row_number().over(order)).selectExpr("cast(l_orderkey as bigint) as l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "cast(l_quantity as bigint) as l_quantity", f"{_CENTS.format('l_extendedprice')} as l_extendedprice_c", "v")


_LINES_SQL = """(select *, row_number() over (partition by l_orderkey, l_linenumber order by v desc) as newest from (select cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber,
    cast(l_quantity as bigint) as l_quantity, cast(round(l_extendedprice * 100) as bigint) as l_extendedprice_c,
    row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) as v from lineitem))"""


def _versions(name: str, then: Callable[[Engine, Table], object], where: str = "true", more: str = "", options: Options | None = None) -> None:
    """The versions of every line as segments on one another; then, more; and a scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, fresh_root(spark, "tables"), options)
        staged = f"{engine.root}/staged"
        _line_versions(engine.spark, sf_dir).write.partitionBy("v").parquet(staged)
        rows = engine.spark.read.parquet(staged)
        table = engine.load(_LINE, rows.where("v = 1"))
        versions = rows.agg(F.max("v")).first()[0] or 1
        rows = rows.where("v > 1")
        for v in range(2, versions + 1):
            table.upsert(rows.where(F.col("v") == v))
        then(engine, table)
        return Engine(spark, engine.root, options).table("line_versions").scan()

    _QUERIES[name] = run
    _SQL[name] = f"select l_orderkey, l_linenumber, l_quantity, l_extendedprice_c from {_LINES_SQL} where newest = 1 and ({where}){more}"


def _bury(_: Engine, table: Table) -> None:
    table.delete(table.range(KeyRange(), ordered=False).where("l_orderkey % 5 = 0").select("l_orderkey", "l_linenumber"))


def _bury_and_return(engine: Engine, table: Table) -> None:
    _bury(engine, table)
    again = table.versions().where(f"`{DELETED}` and l_orderkey % 10 = 0").selectExpr("l_orderkey", "l_linenumber", "cast(-1 as bigint) as l_quantity", "l_orderkey * 7 as l_extendedprice_c")
    table.upsert(again)


_BURIED = "l_orderkey % 5 != 0"
_versions("lsm_newest_wins", lambda e, t: None)
_versions("lsm_tombstones", _bury, _BURIED)
_versions("lsm_reinsert", _bury_and_return, _BURIED, f" union all select l_orderkey, l_linenumber, -1, l_orderkey * 7 from {_LINES_SQL} where newest = 1 and l_orderkey % 10 = 0")
_versions("lsm_after_flush", lambda e, t: (_bury(e, t), t.flush()), _BURIED)
_versions("lsm_after_compact", lambda e, t: (_bury(e, t), t.compact()), _BURIED, options=Options(flush_rows=1, growth=1000.0))
_versions("lsm_after_reopen", lambda e, t: (t.flush(), _bury(e, t), e.close()), _BURIED)


def _catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = loaded(spark, sf_dir, "ev_type").schema("ev_type")
    rows = [(i + 1, c.name, c.kind.value, schema.key.index(c.name) + 1 if schema.is_key(c.name) else 0) for i, c in enumerate(schema.columns)]
    return spark.createDataFrame(rows, "ordinal int, name string, type string, key_place int")


_QUERIES["catalog_describe"] = _catalog_describe
_SQL["catalog_describe"] = "select * from (values (1, 'event_type', 'string', 1), (2, 'user_id', 'int64', 2), (3, 'event_id', 'int64', 3), (4, 'value_c', 'int64', 0)) as t(ordinal, name, type, key_place)"


def _sql_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made, filled, changed and described by statements alone."""
    engine = Engine(spark, fresh_root(spark, "tables"))
    engine.exec("CREATE TABLE place (primary key (name, id), id int64, name string, size int64);")
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect():  # five rows, each a statement
        engine.exec(f"insert into place values ({r.r_regionkey}, '{r.r_name}', {len(r.r_name)})")
    engine.exec("update place set size = size * 10 + id where name >= 'AS'")
    kinds = "".join(c.kind.value[0] for c in engine.schema("place").columns)
    return engine.exec(f"select name, id, size, '{kinds}' from place").frame


_QUERIES["sql_create_table"] = _sql_create
_SQL["sql_create_table"] = "select r_name as name, cast(r_regionkey as bigint) as id, case when r_name >= 'AS' then length(r_name) * 10 + r_regionkey else length(r_name) end as size, 'isi' as col4 from region"

#: Statements over nation_ref, and the errors that they end in, empty for none.
REFUSED = (
    ("select n_name, n_comment from nation_ref", 'no such column "n_comment"'),
    ("select -n_comment from nation_ref where n_nationkey > 900", 'no such column "n_comment"'),
    ("select n_name from nation_ref where n_name = 'PERU'", "unimplemented WHERE"),
    ("select n_name from nowhere", 'table "nowhere" is not found'),
    ("select n_regionkey / (n_nationkey - 3) from nation_ref", "division by zero"),
    ("select n_regionkey / (n_nationkey - 3) from nation_ref where n_nationkey > 3", ""),
    ("select n_name + 1 from nation_ref", "arithmetic requires integers"),
    ("insert into nation_ref values (3, 'again', 9)", "duplicate primary key"),
    ("update nation_ref set n_nationkey = 1", "UPDATE cannot change a primary key column"),
    ("create table nation_ref (a int64, primary key (a))", 'table "nation_ref" already exists'),
    ("create table fresh (a int64, primary key (b))", 'primary key column "b" is not a column'),
)


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = fresh(spark, sf_dir, "nation_ref"), []
    for n, (text, _) in enumerate(REFUSED):
        try:
            engine.exec(text).rows()
            rows.append((n, text, ""))
        except EngineError as error:
            rows.append((n, text, str(error)))
    return spark.createDataFrame(rows, "n int, statement string, error string")


_QUERIES["sql_errors"] = _refused
_SQL["sql_errors"] = "select * from (values " + ", ".join("({}, '{}', '{}')".format(n, *(x.replace("'", "''") for x in pair)) for n, pair in enumerate(REFUSED)) + ") as t(n, statement, error)"


def _torn_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest torn while it was written is passed over, and its version isn't used again."""
    engine = fresh(spark, sf_dir, "orders_ref")
    table = engine.table("orders_ref")
    store = table.store
    store.files.create(store._manifest_path(store.next_version()), "torn")
    engine.exec("delete from orders_ref where o_orderkey < 200")
    return Engine(spark, engine.root).table("orders_ref").scan().select("o_orderkey", "o_totalprice_c", F.lit(store.live().version).alias("version"))


_QUERIES["lsm_torn_manifest"] = _torn_manifest
_SQL["lsm_torn_manifest"] = f"select o_orderkey, o_totalprice_c, 3 as version from {derived_sql('orders_ref')} where o_orderkey >= 200"


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations' turns as a cursor meets them: up to the end, one step beyond, and back down to the first."""
    table = loaded(spark, sf_dir, "conv").table("conv")
    cursor, rows = table.cursor(KeyRange.request(">", (3,), "<=", (40,)), page=64), []
    while cursor.valid:
        rows.append((len(rows), *cursor.row[:2]))
        cursor.next()
    while cursor.prev():
        rows.append((len(rows), *cursor.row[:2]))
    return spark.createDataFrame(rows, "step int, conv_id long, turn long")


_QUERIES["api_cursor"] = _walked
_SQL["api_cursor"] = f"""with c as (select conv_id, turn from {derived_sql('conv')} where conv_id <= 40),
    up as (select row_number() over (order by conv_id, turn) - 1 as step, conv_id, turn from c where conv_id > 3),
    down as (select (select count(*) from up) + row_number() over (order by conv_id desc, turn desc) - 1 as step, conv_id, turn from c)
    select * from up union all select * from down"""


def _exchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a byte-ordered store's files, changes to them as its log, and both adopted by an engine of its own."""
    engine = fresh(spark, sf_dir, "orders_ref")
    schema, files = engine.schema("orders_ref"), fresh_root(spark, "files")
    engine.table("orders_ref").export(f"{files}/level", files=3)
    rows = derived_frame(engine.spark, sf_dir, "orders_ref")
    changed = rows.where("o_orderkey % 10 = 0").withColumn("o_totalprice_c", -F.col("o_totalprice_c")).withColumn(DELETED, F.lit(False))
    gone = rows.where("o_orderkey % 7 = 0").withColumn(DELETED, F.lit(True))
    write_log(changed.unionByName(gone), schema, f"{files}/log", [F.col(f"`{DELETED}`"), F.col("o_orderkey")])
    return Engine(spark, fresh_root(spark, "tables")).adopt(schema, [f"{files}/level"], [f"{files}/log"]).scan()


_QUERIES["exchange_files"] = _exchanged
_SQL["exchange_files"] = f"select * replace (case when o_orderkey % 10 = 0 then -o_totalprice_c else o_totalprice_c end as o_totalprice_c) from {derived_sql('orders_ref')} where o_orderkey % 7 != 0"


def _keycodec_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = loaded(spark, sf_dir, "ev_type").table("ev_type")
    return table.scan().select("event_type", "user_id", "event_id", F.hex(encode_key(table.schema)).alias("key_hex"))


_QUERIES["keycodec_order"] = _keycodec_order
_SQL["keycodec_order"] = f"select event_type, user_id, event_id, '02' || hex(event_type) || '00' || '018' || lpad(hex(user_id), 15, '0') || '018' || lpad(hex(event_id), 15, '0') || '00' as key_hex from {derived_sql('ev_type')}"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

