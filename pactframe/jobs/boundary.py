"""Queries at the edges of contracts: composite JSON, budgets of errors by level, boundary scalars, factories, declared outputs, limits that are hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactframe.contract import compiler as C
from pactframe.contract import model as M
from pactframe.contract.errors import Place, safe_text
from pactframe.contract.model import Contract, Field, Tagged, constrained, optional
from pactframe.functions.decode import depth_over
from pactframe.jobs.common import dealt, errors_sql, table
from pactframe.operators.output import output_errors, to_json
from pactframe.operators.patches import replace_fields
from pactframe.operators.validate import error_report, flat_errors, from_json, from_rows, from_text, validate_table

# JSON of composite types; each text is read back by its contract and written again.

_LINE = Contract("Line", (Field("key", M.INT), Field("pair", M.Fixed((M.INT, M.STR, optional(M.FLOAT)))), Field("rest", M.Many(M.Fixed((M.INT, M.BOOL))))))


def _again(rows, contract, keys):
    """keys and the text of each value, and of the value that the text is read back as."""
    first = rows.select(*keys, to_json(contract, F.col("value")).alias("text"))
    back = from_json(first, "text", contract, keep=[*keys, "text"])
    return back.select(*keys, "text", to_json(contract, F.col("value")).alias("again"))


def o_tuple_json(spark, sf_dir):
    k = F.col("c_custkey")
    pair = F.struct(F.col("c_nationkey").cast("bigint").alias("_0"), F.col("c_name").alias("_1"), F.when(k % 3 > 0, F.col("c_acctbal")).alias("_2"))
    rest = F.transform(F.sequence(F.lit(1).cast("bigint"), k % 4 + 1), lambda i: F.struct((i * k).alias("_0"), (i % 2 == 0).alias("_1")))
    rows = table(spark, sf_dir, "customer").select(k.alias("key"), F.struct(k.alias("key"), pair.alias("pair"), rest.alias("rest")).alias("value"))
    return _again(rows, _LINE, ["key"]).select("key", F.regexp_replace("text", r"(-?[0-9.]+(E-?[0-9]+)?)\],\"rest", "x],\"rest").alias("text"), (F.col("text") == F.col("again")).alias("same"))


_UNION = Contract("Either", (Field("key", M.INT), Field("v", M.Union((M.INT, M.STR, M.Many(M.INT), Contract("Point", (Field("x", M.INT), Field("y", M.INT)))))), Field("o", optional(M.Union((M.INT, M.BOOL))))))
_UNION_SQL = """case event_id % 4 when 0 then user_id::varchar when 1 then '"' || event_type || '"' when 2 then '[' || user_id || ',' || event_id || ']' else '{"x":' || event_id || ',"y":' || user_id || '}' end"""
_O_SQL = "case event_id % 3 when 0 then 'null' when 1 then 'true' else event_id::varchar end"


def o_union_json(spark, sf_dir):
    sql = f"""'{{"key":' || event_id || ',"v":' || {_UNION_SQL.replace("::varchar", "")} || ',"o":' || {_O_SQL.replace("::varchar", "")} || '}}'""".replace("then user_id when", "then cast(user_id as string) when").replace("else event_id end", "else cast(event_id as string) end")
    done = from_json(table(spark, sf_dir, "events").select("event_id", F.expr(sql).alias("text")), "text", _UNION, keep=["event_id"])
    return done.select("event_id", F.col("value.v.branch").alias("branch"), to_json(_UNION, F.col("value")).alias("text"))


_SHAPE = Tagged("kind", (("dot", Contract("Dot", (Field("id", M.INT), Field("at", M.Fixed((M.INT, M.INT)))))), ("box", Contract("Box", (Field("id", M.INT, alias="no"), Field("label", optional(M.STR), default=None))))))
_HOLDER = Contract("Holder", (Field("shapes", M.Many(_SHAPE)), Field("slot", Contract("Slot", (Field("a", M.INT), Field("b", M.STR, default="none")), shape="positional"))))


def o_tagged_json(spark, sf_dir):
    text = F.expr("""'{"shapes":[{"id":' || event_id || ',"kind":"dot","at":[' || user_id || ',2]},{"no":' || user_id || ',"kind":"box"' || case when event_id % 2 = 0 then ',"label":"' || event_type || '"' else '' end || '}],"slot":[' || event_id || case when event_id % 3 = 0 then ',"' || event_type || '"' else '' end || ']}'""")
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", _HOLDER, keep=["event_id"])
    return done.select("event_id", to_json(_HOLDER, F.col("value")).alias("text"))


def o_set_selection(spark, sf_dir):
    """A selection inside a set of records, in JSON."""
    c = Contract("Tags", (Field("key", M.INT), Field("tags", M.Many(Contract("Tag", (Field("n", M.INT), Field("w", M.STR))), "set"))))
    k = F.col("p_partkey")
    tags = F.array_distinct(F.array(*[F.struct((k % m).alias("n"), F.col("p_brand").alias("w")) for m in (2, 3, 5)]))
    value = F.struct(k.alias("key"), tags.alias("tags"))
    return table(spark, sf_dir, "part").select(k.alias("key"), to_json(c, value, include={"tags": {"n": True}}).alias("text"))


# Errors by level.

_INNER = Contract("Inner", (Field("a", constrained(M.FLOAT, le=10.0)), Field("b", constrained(M.FLOAT, le=0.02)), Field("c", constrained(M.FLOAT, le=0.02))))
_NESTED = Contract("Nested", (Field("n", _INNER), Field("p", constrained(M.FLOAT, le=20000.0)), Field("q", M.Literal(("A",))), Field("r", M.Literal(("O",)))))


def e_nested_budget(spark, sf_dir):
    """A nested record counts once, a truncated one ends the root with its own errors."""
    inner = F.struct(F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), F.col("l_discount").alias("c"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", inner.alias("n"), F.col("l_extendedprice").alias("p"), F.col("l_returnflag").alias("q"), F.col("l_linestatus").alias("r"))
    done = from_rows(rows, _NESTED, max_errors=3, keep=["l_orderkey", "l_linenumber"])
    return done.select("l_orderkey", "l_linenumber", F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("paths"), "truncated")


_PATHS_SQL = """with f as (select l_orderkey, l_linenumber, l_quantity > 10 as a, l_tax > 0.02::double as b, l_discount > 0.02::double as c, l_extendedprice > 20000 as p, l_returnflag <> 'A' as q, l_linestatus <> 'O' as r from lineitem),
  g as (select *, (a::int + b::int + c::int) as inner_, case when a or b or c then 1 else 0 end as n from f)
select l_orderkey, l_linenumber, case when inner_ = 3 then 'n.a,n.b,n.c'
    else concat_ws(',', case when a then 'n.a' end, case when b then 'n.b' end, case when c then 'n.c' end, case when p then 'p' end, case when q then 'q' end, case when r and n + p::int + q::int < 3 then 'r' end) end as paths,
  inner_ = 3 or n + p::int + q::int + r::int >= 3 as truncated from g"""


def e_report_repeats(spark, sf_dir):
    """Records that have one kind of error several times count once, and hooks are told apart."""
    c = Contract("Doc", (Field("doc_id", M.INT), Field("x", M.Union((constrained(M.INT, lt=3), M.STR))), *[Field(f"f{i}", M.STR) for i in range(2)], Field("n", M.INT, checks=(("small", lambda v: v < 400), ("even", lambda v: v % 2 == 0)))))
    text = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"x":1,"f0":"","f1":"","n":'), F.coalesce(F.col("n_chars"), F.lit(0)).cast("string"),
                    F.when(F.col("doc_id") % 3 == 0, ',"u":1').otherwise(""), F.when(F.col("doc_id") % 5 == 0, ',"w":1').otherwise(""), F.lit("}"))
    done = from_json(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text", c, keep=["doc_id"])
    twice = done.withColumn("errors", F.concat("errors", "errors"))
    return error_report(twice, by_hook=True).select("path", "code", F.coalesce("hook", F.lit("")).alias("hook"), "errors", "records")


def e_safe_text(spark, sf_dir):
    """Control and format characters as escapes."""
    marks = F.array(*[F.lit(x) for x in ("\n", "\r", "\t", "\x1b", "\x7f", "​", "\x85", "é")])
    return table(spark, sf_dir, "customer").select("c_custkey", safe_text(F.concat("c_name", F.get(marks, (F.col("c_custkey") % 8).cast("int")), F.lit("end"))).alias("text"))


# Boundary scalars through contracts, with values of the tables.

def _day(f="o_orderdate"):
    return F.col(f)


def c_iso_json(spark, sf_dir):
    """Dates, instants and times in several ISO forms."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey")
    week = F.concat(F.expr("extract(yearofweek from o_orderdate)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"), F.lit("-"), (F.weekday(d) + 1).cast("string"))
    date = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "yyyyMMdd")).when(k % 4 == 2, week).otherwise(F.date_format(d, "yyyy-M-d"))
    hour, minute = F.lpad((k % 26).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0")
    clock = F.when(k % 3 == 0, F.concat(hour, F.lit(":"), minute)).when(k % 3 == 1, F.concat(hour, minute)).otherwise(F.concat(hour, F.lit(":"), minute, F.lit(":30,5")))
    at = F.concat(F.date_format(d, "yyyyMMdd"), F.lit("T"), clock, F.when(k % 5 == 0, "Z").when(k % 5 == 1, "+02:00").when(k % 5 == 2, "-0130").otherwise(""))
    c = Contract("Iso", (Field("day", M.DATE), Field("at", M.DATETIME), Field("clock", M.TIME)))
    text = F.to_json(F.struct(date.alias("day"), at.alias("at"), clock.alias("clock")))
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    done = from_json(rows.select("o_orderkey", text.alias("text")), "text", c, keep=["o_orderkey"])
    return done.select("o_orderkey", F.col("value.day").cast("string").alias("day"), F.date_format("value.at", "yyyy-MM-dd HH:mm:ss.S").alias("at"), F.col("value.clock").alias("clock"), F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("bad"))


_ISO_SQL = """with x as (select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 26 as h, o_orderkey % 60 as m, o_orderkey % 3 = 2 as s, o_orderkey % 4 < 3 or (month(o_orderdate) > 9 and day(o_orderdate) > 9) as good from orders)
select o_orderkey, case when good and h < 24 then strftime(d, '%Y-%m-%d') end as day,
  case when good and h < 24 then strftime(cast(d as timestamp) + to_hours(h) + to_minutes(m) + to_seconds(case when s then 30 else 0 end) - case o_orderkey % 5 when 1 then to_hours(2) when 2 then -to_minutes(90) else to_hours(0) end, '%Y-%m-%d %H:%M:%S') || case when s then '.5' else '.0' end end as at,
  case when good and h < 24 then lpad(h::varchar, 2, '0') || ':' || lpad(m::varchar, 2, '0') || case when s then ':30.500000' else ':00' end end as clock,
  concat_ws(',', case when not good then 'day' end, case when h >= 24 then 'at' end, case when h >= 24 then 'clock' end) as bad from x"""


def c_decimal_json(spark, sf_dir):
    """Numbers, texts with exponents, and what is no finite number."""
    k = F.col("p_partkey")
    t = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit('"'), k.cast("string"), F.lit('E-2"'))).when(k % 5 == 2, F.concat(F.lit('"'), k.cast("string"), F.lit('e+1"'))).when(k % 5 == 3, F.lit('"-Infinity"')).otherwise(F.concat(k.cast("string"), F.lit(".125")))
    c = Contract("Price", (Field("v", constrained(M.decimal(12, 2), lt=1500)),))
    done = from_json(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"v":'), t, F.lit("}")).alias("text")), "text", c, keep=["p_partkey"])
    return done.select("p_partkey", F.col("value.v").cast("string").alias("v"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


def c_path_json(spark, sf_dir):
    """Paths and addresses in normal form."""
    k = F.col("s_suppkey")
    low = F.lower(F.hex(k))
    net = F.concat_ws(".", F.lit("10"), (k % 256).cast("string"), F.lit("0"), F.when(k % 4 == 0, "7").otherwise("0"))
    text = F.concat(F.lit('{"file":"/var//./'), F.col("s_name"), F.lit('/./x/","six":"2001:DB8:0:0:0::'), F.upper(low), F.lit('","net":"'), net, F.lit('/24"}'))
    c = Contract("Host", (Field("file", M.PATH), Field("six", M.Scalar("IPv6Address")), Field("net", M.Scalar("IPv4Network"))))
    done = from_json(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "text", c, keep=["s_suppkey"])
    return done.select("s_suppkey", F.col("value.file").alias("file"), F.col("value.six").alias("six"), F.col("value.net").alias("net"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("bad"))


def p_kinds_strict(spark, sf_dir):
    """Strict columns hold canonical texts only."""
    h = F.md5(F.col("c_custkey").cast("string"))
    k = F.col("c_custkey")
    uid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    groups = F.regexp_replace(F.regexp_replace(F.lower(F.hex(k)), "(?<=.)(?=(.{4})+$)", ":"), ":0{1,3}(?=.)", ":")  # four digits each, without zeros in front
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.upper(uid)).otherwise(uid).alias("uid"), F.concat(F.lit("2001:db8::"), F.when(k % 3 == 0, F.lit("0")).otherwise(F.lit("")), groups).alias("six"),
                                                   F.concat((k % 300).cast("string"), F.lit(".0.0.0/8")).alias("net"), F.concat(F.lit("a/"), F.when(k % 5 == 0, F.lit("/b")).otherwise(F.lit("b"))).alias("file"))
    c = Contract("Kinds", (Field("c_custkey", M.INT), Field("uid", M.UUID), Field("six", M.Scalar("IPv6Address")), Field("net", M.Scalar("IPv4Network")), Field("file", M.PATH)))
    return flat_errors(from_rows(rows, c, keep=["c_custkey"]), ["c_custkey"]).select("c_custkey", "position", "path", "code")


def p_map_keys(spark, sf_dir):
    """Keys have a contract of their own, which comes before the value's."""
    k = F.col("event_id")
    text = F.concat(F.lit('{"m":{"a'), F.repeat(F.lit("b"), (k % 5).cast("int")), F.lit('":'), (k % 7).cast("string"), F.lit("}}"))
    c = Contract("Keyed", (Field("m", M.Mapping(constrained(M.INT, lt=5), constrained(M.STR, max_length=3))),))
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", c, keep=["event_id"])
    return flat_errors(done, ["event_id"]).select("event_id", "path", "code")


def t_record(spark, sf_dir):
    """A record from text columns, containers and all."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(k.cast("string")).alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(k % 3 == 0, "null").otherwise(F.col("o_orderstatus")).alias("state"),
        F.concat(F.lit("["), (k % 9).cast("string"), F.lit(","), (k % 11).cast("string"), F.when(k % 10 == 0, "").otherwise("]")).alias("ports"), F.when(k % 2 == 0, F.lit("true")).alias("on"))
    c = Contract("Leaf", (Field("n", constrained(M.INT, ge=100)), Field("day", M.DATE), Field("state", optional(M.Literal(("F", "O")))), Field("ports", M.Many(constrained(M.INT, lt=8))), Field("on", M.BOOL, default=False)))
    done = from_text(rows, c, keep=["o_orderkey"])
    return done.select("o_orderkey", F.col("value.n").alias("n"), F.col("value.day").cast("string").alias("day"), F.array_join("value.ports", ",").alias("ports"), F.col("value.on").alias("on"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("bad"))


# Factories, transforms of JSON values, declared outputs, replacement.

def n_factory(spark, sf_dir):
    """A factory runs after all else passed; what it gives is checked as the field is."""
    k = F.col("event_id")
    text = F.concat(F.lit('{"id":'), F.when(k % 4 == 0, F.lit('"x"')).otherwise(k.cast("string")), F.when(k % 3 == 0, F.concat(F.lit(',"code":'), (k % 50).cast("string"))).otherwise(""), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("text"))
    made = lambda: F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 60)
    c = Contract("Made", (Field("id", M.INT), Field("code", constrained(M.INT, lt=40), factory=made)))
    done = from_json(rows, "text", c, keep=["event_id", "user_id"])
    return done.select("event_id", F.col("value.code").alias("code"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("bad"))


def h_transform_json(spark, sf_dir):
    """H1: a transform of texts leaves JSON values of other kinds as they are."""
    k = F.col("event_id")
    v = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit('" '), k.cast("string"), F.lit(' "'))).when(k % 4 == 2, F.lit('"none"')).otherwise(F.lit("true"))
    digits = ("digits", lambda t: F.when(F.trim(t).rlike("^[0-9]+$"), F.trim(t).cast("bigint")))
    c = Contract("N", (Field("v", constrained(M.INT, ge=20), transforms=(digits,)),))
    done = from_json(table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"v":'), v, F.lit("}")).alias("text")), "text", c, keep=["event_id"])
    return done.select("event_id", F.col("value.v").alias("v"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


def h_output(spark, sf_dir):
    """H4, C14: a serialiser whose result is declared is projected as declared; results outside it are errors."""
    label = Field("name", M.STR, dump=lambda v: F.struct(F.upper(v).alias("_0"), F.length(v).cast("bigint").alias("_1")), output=M.Fixed((M.STR, constrained(M.INT, le=15))))
    c = Contract("Out", (Field("key", M.INT), label))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")).alias("v"))
    errors = output_errors(c, F.col("v"))
    return rows.select("key", F.when(F.size(errors) == 0, to_json(c, F.col("v"))).alias("text"), F.array_join(F.transform(errors, lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("bad"))


def d_replace_transform(spark, sf_dir):
    """The transforms of replaced fields run, those of the others don't."""
    tidy = (("tidy", lambda t: F.nullif(F.trim(t), F.lit(""))),)
    c = Contract("Cust", (Field("key", M.INT), Field("name", constrained(M.STR, max_length=20), transforms=tidy), Field("segment", M.STR, transforms=(("never", lambda t: F.lit(None).cast("string")),))))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    done = replace_fields(rows, c, ["key"], name=F.when(F.col("key") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.col("name"), F.lit("  "))))
    return done.select("key", F.col("value.name").alias("name"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


# Limits that are hit.

def b_depth(spark, sf_dir):
    """How deep texts are that go over a limit, signs in texts not counting."""
    k = (F.col("event_id") % 12).cast("int")
    text = F.concat(F.repeat(F.lit('{"a":['), k), F.lit('"[[[{{"'), F.repeat(F.lit("]}"), k))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", depth_over(F.col("text"), 9).alias("depth"))


def p_recursive_depth(spark, sf_dir):
    """A recursive record deeper than its declaration fails by depth, not as unexpected."""
    tree = M.recursive(lambda node: Contract("Tree", (Field("v", M.INT), Field("below", optional(node), default=None))), 4)
    k = (F.col("event_id") % 7).cast("int")
    text = F.concat(F.repeat(F.lit('{"v":1,"below":'), k), F.lit('{"v":2}'), F.repeat(F.lit("}"), k))
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", tree, keep=["event_id"])
    return done.select("event_id", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("bad"))


def b_nodes_json(spark, sf_dir):
    """Visits of unions count each option that is tried, those of tagged unions the picked branch."""
    c = Contract("Mixed", (Field("u", M.Union((M.Many(M.INT), M.Many(M.STR)))), Field("t", _SHAPE)))
    k = F.col("event_id")
    items = F.array_join(F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.when(k % 2 == 0, i.cast("string")).otherwise(F.lit('"s"'))), ",")
    text = F.concat(F.lit('{"u":['), items, F.lit('],"t":{"kind":"'), F.when(k % 3 == 0, 'dot","id":1,"at":[1,2]').otherwise('box","no":1'), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", C.json_nodes(c, F.try_parse_json("text")).alias("nodes"))


QUERIES = {f.__name__: f for f in (
    o_tuple_json, o_union_json, o_tagged_json, o_set_selection, e_nested_budget, e_report_repeats, e_safe_text, c_iso_json, c_decimal_json, c_path_json, p_kinds_strict, p_map_keys, t_record, n_factory, h_transform_json, h_output,
    d_replace_transform, b_depth, p_recursive_depth, b_nodes_json)}

_PLUS = "coalesce(n_chars, 0)"
ORACLE_SQL = {
    "o_tuple_json": """select c_custkey as key, '{"key":' || c_custkey || ',"pair":[' || c_nationkey || ',"' || c_name || '",' || case when c_custkey % 3 > 0 then 'x' else 'null' end || '],"rest":['
        || array_to_string(list_transform(range(1, c_custkey % 4 + 2), lambda i: '[' || (i * c_custkey) || ',' || case when i % 2 = 0 then 'true' else 'false' end || ']'), ',') || ']}' as text, true as same from customer""",
    "o_union_json": f"""select event_id, case event_id % 4 when 0 then 'int' when 1 then 'str' when 2 then 'list[int]' else 'Point' end as branch, '{{"key":' || event_id || ',"v":' || {_UNION_SQL} || ',"o":' || {_O_SQL} || '}}' as text from events""",
    "o_tagged_json": """select event_id, '{"shapes":[{"kind":"dot","id":' || event_id || ',"at":[' || user_id || ',2]},{"kind":"box","no":' || user_id || ',"label":' || case when event_id % 2 = 0 then '"' || event_type || '"' else 'null' end
        || '}],"slot":[' || event_id || ',"' || case when event_id % 3 = 0 then event_type else 'none' end || '"]}' as text from events""",
    "o_set_selection": """with x as (select p_partkey as key, list_transform([2, 3, 5], lambda m: p_partkey % m) as v from part)
        select key, '{"tags":[' || array_to_string(list_transform(list_filter(v, lambda a, i: list_position(v, a) = i), lambda a: '{"n":' || a || '}'), ',') || ']}' as text from x""",
    "e_nested_budget": _PATHS_SQL,
    "e_report_repeats": f"""select 'u' as path, 'unexpected' as code, '' as hook, 2 * count(*) as errors, count(*) as records from documents where doc_id % 3 = 0 having count(*) > 0
        union all select 'w', 'unexpected', '', 2 * count(*), count(*) from documents where doc_id % 5 = 0 having count(*) > 0
        union all select 'n', 'field_check', 'small', 2 * count(*), count(*) from documents where {_PLUS} >= 400 having count(*) > 0
        union all select 'n', 'field_check', 'even', 2 * count(*), count(*) from documents where {_PLUS} < 400 and {_PLUS} % 2 = 1 having count(*) > 0""",
    "e_safe_text": r"""select c_custkey, c_name || case c_custkey % 8 when 0 then '\n' when 1 then '\r' when 2 then '\t' when 3 then '\x1b' when 4 then '\x7f' when 5 then '\u200b' when 6 then '\x85' else 'é' end || 'end' as text from customer""",
    "c_iso_json": _ISO_SQL,
    "c_decimal_json": """with x as (select p_partkey, case p_partkey % 5 when 0 then cast(p_partkey as decimal(12,2)) when 1 then cast(cast(p_partkey as decimal(12,2)) / 100 as decimal(12,2)) when 2 then cast(p_partkey * 10 as decimal(12,2)) end as v from part)
        select p_partkey, case when v < 1500 then v::varchar end as v, case when p_partkey % 5 = 3 then 'json_invalid' when p_partkey % 5 = 4 then 'type' when v >= 1500 then 'less_than' else '' end as codes from x""",
    "c_path_json": """select s_suppkey, case when s_suppkey % 4 > 0 then '/var/' || s_name || '/x' end as file, case when s_suppkey % 4 > 0 then '2001:db8::' || printf('%x', s_suppkey) end as six, case when s_suppkey % 4 > 0 then '10.' || (s_suppkey % 256) || '.0.0/24' end as net,
        case when s_suppkey % 4 = 0 then 'net:type' else '' end as bad from supplier""",
    "p_kinds_strict": errors_sql("customer", ["c_custkey"], [("uid", "case when c_custkey % 2 = 0 and regexp_matches(md5(c_custkey::varchar), '[a-f]') then 'type' end"), ("six", "case when c_custkey % 3 = 0 then 'type' end"), ("net", "case when c_custkey % 300 > 255 then 'type' end"), ("file", "case when c_custkey % 5 = 0 then 'type' end")]),
    "p_map_keys": "select event_id, 'm.a' || repeat('b', cast(event_id % 5 as int)) as path, case when event_id % 5 > 2 then 'max_length' else 'less_than' end as code from events where event_id % 5 > 2 or event_id % 7 >= 5",
    "t_record": """with x as (select *, concat_ws(',', case when o_orderkey % 4 = 0 then 'n:type' when o_orderkey < 100 then 'n:greater_than_or_equal' end, case when o_orderkey % 3 > 0 and o_orderstatus not in ('F', 'O') then 'state:literal' end,
          case when o_orderkey % 10 = 0 then 'ports:json_invalid' when o_orderkey % 9 >= 8 then 'ports[0]:less_than' when o_orderkey % 11 >= 8 then 'ports[1]:less_than' end) as bad from orders)
        select o_orderkey, case when bad = '' then o_orderkey end as n, case when bad = '' then strftime(o_orderdate, '%Y-%m-%d') end as day, case when bad = '' then (o_orderkey % 9) || ',' || (o_orderkey % 11) end as ports, case when bad = '' then o_orderkey % 2 = 0 end as "on", bad from x""",
    "n_factory": """with x as (select event_id, event_id % 4 = 0 as wrong, case when event_id % 3 = 0 then event_id % 50 when user_id % 5 > 0 then user_id % 60 end as code, event_id % 3 > 0 as made from events)
        select event_id, case when not wrong and code < 40 then code end as code, case when wrong then concat_ws(',', 'id:type', case when not made and code >= 40 then 'code:less_than' end) when code is null then 'code:factory' when code >= 40 then 'code:less_than' else '' end as bad from x""",
    "h_transform_json": """select event_id, case when event_id % 4 < 2 and event_id >= 20 then event_id end as v, case event_id % 4 when 2 then 'transform' when 3 then 'type' else case when event_id < 20 then 'greater_than_or_equal' else '' end end as codes from events""",
    "h_output": """select p_partkey as key, case when length(p_name) <= 15 then '{"key":' || p_partkey || ',"name":["' || upper(p_name) || '",' || length(p_name) || ']}' end as text, case when length(p_name) > 15 then 'name[1]:less_than_or_equal' else '' end as bad from part""",
    "d_replace_transform": "select c_custkey as key, case when c_custkey % 3 > 0 and length(c_name) <= 20 then c_name end as name, case when c_custkey % 3 = 0 then 'transform' when length(c_name) > 20 then 'max_length' else '' end as codes from customer",
    "b_depth": "select event_id, cast(case when 2 * (event_id % 12) > 9 then 2 * (event_id % 12) end as int) as depth from events",
    "p_recursive_depth": "select event_id, case when event_id % 7 > 4 then 'below.below.below.below.below:depth' else '' end as bad from events",
    "b_nodes_json": "select event_id, cast(1 + 1 + case when event_id % 2 = 0 then 1 + (event_id % 4 + 1) else 2 + 1 + (event_id % 4 + 1) end + 1 + 1 + 1 + case when event_id % 3 = 0 then 1 + 3 else 1 end as bigint) as nodes from events",
}
