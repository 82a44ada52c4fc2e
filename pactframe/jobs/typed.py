"""Queries over typed tables: types, bounds, literals, containers, records, budgets of errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactframe.contract import model as M
from pactframe.contract.model import Check, Contract, Field, constrained, optional
from pactframe.jobs.common import errors_sql, row_errors, strict_errors, table
from pactframe.operators.budgets import nodes
from pactframe.operators.validate import error_report, error_totals, error_tree, flat_errors, from_rows, located, render, split, validate_table

LINE = ["l_orderkey", "l_linenumber"]

LINE_ITEM = Contract("LineItem", (
    Field("l_orderkey", M.INT), Field("l_partkey", M.INT), Field("l_suppkey", M.INT), Field("l_linenumber", M.INT),
    Field("l_quantity", constrained(M.FLOAT, ge=1.0, le=45.0)), Field("l_extendedprice", constrained(M.FLOAT, gt=0.0)), Field("l_discount", constrained(M.FLOAT, le=0.08)),
    Field("l_tax", constrained(M.FLOAT, ge=0.0)), Field("l_returnflag", M.Literal(("A", "N"))), Field("l_linestatus", M.STR),
    Field("l_shipdate", M.NAIVE_DATETIME, checks=(("from_1993", lambda d: d >= F.to_timestamp_ntz(F.lit("1993-01-01 00:00:00"))),)),
), (Check("tax_near_discount", ("l_tax", "l_discount"), lambda tax, discount: tax <= discount + 0.05),))
LINE_RULES = [
    ("l_quantity", "case when not l_quantity >= 1 then 'greater_than_or_equal' when not l_quantity <= 45 then 'less_than_or_equal' end"),
    ("l_extendedprice", "case when not l_extendedprice > 0 then 'greater_than' end"),
    ("l_discount", "case when not l_discount <= 0.08::double then 'less_than_or_equal' end"),
    ("l_tax", "case when not l_tax >= 0 then 'greater_than_or_equal' end"),
    ("l_returnflag", "case when l_returnflag not in ('A', 'N') then 'literal' end"),
    ("l_shipdate", "case when l_shipdate < timestamp '1993-01-01' then 'field_check' end"),
]
_ANY = "(l_quantity < 1 or l_quantity > 45 or l_extendedprice <= 0 or l_discount > 0.08::double or l_tax < 0 or l_returnflag not in ('A','N') or l_shipdate < timestamp '1993-01-01')"
LINE_RULES_ALL = [*LINE_RULES, ("<root>", f"case when not {_ANY} and not l_tax <= l_discount + 0.05::double then 'spec_check' end")]
_LINE_ERRORS = errors_sql("lineitem", LINE, LINE_RULES_ALL)
_BY_ROW = errors_sql("lineitem", LINE, LINE_RULES_ALL, row=True)


def s_rows_aggregate(spark, sf_dir):
    return row_errors(table(spark, sf_dir, "lineitem"), LINE_ITEM, LINE)


def s_strict_fail_fast(spark, sf_dir):
    return strict_errors(table(spark, sf_dir, "lineitem"), LINE_ITEM, LINE)


def s_report(spark, sf_dir):
    return error_report(from_rows(table(spark, sf_dir, "lineitem"), LINE_ITEM, keep=LINE))


def s_split(spark, sf_dir):
    good, bad = split(from_rows(table(spark, sf_dir, "lineitem"), LINE_ITEM, keep=LINE), LINE)
    return (good.select(F.lit("good").alias("part"), F.col("value.l_quantity").alias("q")).union(bad.select(F.lit("quarantine"), F.size("errors").cast("double")))
            .groupBy("part").agg(F.count("*").alias("records"), F.sum("q").cast("bigint").alias("total")))


def e_totals(spark, sf_dir):
    return error_totals(from_rows(table(spark, sf_dir, "lineitem"), LINE_ITEM, keep=LINE)).select(F.coalesce("code", F.lit("(all)")).alias("code"), F.coalesce("path", F.lit("(all)")).alias("path"), "errors")


def e_truncate(spark, sf_dir):
    done = from_rows(table(spark, sf_dir, "lineitem"), LINE_ITEM, max_errors=2, keep=LINE)
    return done.where(F.size("errors") > 0).select(*LINE, F.size("errors").alias("n"), "truncated")


def e_messages(spark, sf_dir):
    done = from_rows(table(spark, sf_dir, "lineitem"), LINE_ITEM, keep=LINE)
    return flat_errors(done, LINE).groupBy("code", "path", "message").agg(F.count("*").alias("errors"))


def e_context(spark, sf_dir):
    done = from_rows(table(spark, sf_dir, "lineitem"), LINE_ITEM, keep=LINE)
    return flat_errors(done, LINE).where("context is not null").groupBy("code", "expected", "received", F.col("context")["limit"].alias("limit")).agg(F.count("*").alias("errors"))


def e_located(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("item", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    done = from_rows(items, LINE_ITEM, keep=["item"]).withColumn("errors", located(F.col("errors"), F.col("item")))
    return flat_errors(done, ["item"]).select("item", "position", "path", F.array_join("location", "/").alias("location"))


def e_render(spark, sf_dir):
    done = from_rows(table(spark, sf_dir, "lineitem"), LINE_ITEM, max_errors=2, keep=LINE).where(F.size("errors") > 0)
    return done.select(*LINE, render(F.transform("errors", lambda e: e.withField("input", F.lit(None).cast("string"))), "LineItem", F.col("truncated")).alias("text"))


def _orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "lines")


ORDER_LINE = Contract("OrderLine", (Field("number", M.INT), Field("quantity", constrained(M.FLOAT, le=48.0)), Field("flag", M.Literal(("A", "N")))))
ORDER = Contract("Order", (Field("o_orderkey", M.INT), Field("o_orderstatus", M.STR), Field("lines", constrained(M.Many(ORDER_LINE), max_length=6))))
_ORDER_SQL = """with l as (select l_orderkey, l_linenumber, l_quantity, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_returnflag) - 1 as i,
  count(*) over (partition by l_orderkey) as n from lineitem join orders on l_orderkey = o_orderkey),
bad as (select *, row_number() over (partition by l_orderkey order by i) as r from l where n <= 6 and (l_quantity > 48 or l_returnflag not in ('A','N'))),
first as (select * from bad where r = 1), e as (
  select distinct l_orderkey as o_orderkey, 'lines' as path, 'max_length' as code, 0 as k from l where n > 6
  union all select l_orderkey, 'lines[' || i || '].quantity', 'less_than_or_equal', 0 from first where l_quantity > 48
  union all select l_orderkey, 'lines[' || i || '].flag', 'literal', 1 from first where l_returnflag not in ('A','N'))
select o_orderkey, cast(row_number() over (partition by o_orderkey order by k) - 1 as int) as position, path, code from e"""


def p_nested(spark, sf_dir):
    return row_errors(_orders(spark, sf_dir), ORDER, ["o_orderkey"])


def e_tree(spark, sf_dir):
    flat = flat_errors(from_rows(_orders(spark, sf_dir), ORDER, keep=["o_orderkey"]), ["o_orderkey"])
    return error_tree(flat, ["o_orderkey"]).select("o_orderkey", F.regexp_replace("node", '"', "").alias("node"), "depth", F.array_join("own", ",").alias("own"), "below")


def b_nodes(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rows.select("o_orderkey", nodes(ORDER, rows).alias("nodes"))


EMBEDDING = Contract("Embedding", (Field("vec_id", M.INT), Field("embedding", constrained(M.Many(constrained(M.FLOAT, ge=-0.35, le=0.35)), min_length=64, max_length=64)), Field("label", M.INT)))


def p_list_items(spark, sf_dir):
    return row_errors(table(spark, sf_dir, "embeddings"), EMBEDDING, ["vec_id"])


def p_map(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    props = F.create_map(F.lit("a"), F.col("user_id") % 7, F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")), F.col("event_id") % 11)
    kind = Contract("Props", (Field("event_id", M.INT), Field("props", M.Mapping(constrained(M.INT, le=5)))))
    return row_errors(events.select("event_id", props.alias("props")), kind, ["event_id"])


def p_set(spark, sf_dir):
    c = Contract("Set", (Field("key", M.INT), Field("members", constrained(M.Many(M.INT, "set"), min_length=3))))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.array(F.col("c_nationkey").cast("bigint"), F.col("c_custkey") % 5, F.col("c_custkey") % 3).alias("members"))
    done = from_rows(rows, c, keep=["key"])
    return done.select("key", F.size("value.members").alias("members"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


def p_tuple(spark, sf_dir):
    c = Contract("Pair", (Field("key", M.INT), Field("pair", M.Fixed((M.INT, constrained(M.INT, lt=3)))), Field("rest", M.Many(constrained(M.INT, lt=4), "tuple"))))
    k = F.col("c_custkey")
    pair = F.when(k % 5 == 0, F.array(k)).otherwise(F.array(k, k % 4))
    rows = table(spark, sf_dir, "customer").select(k.alias("key"), pair.alias("pair"), F.array(k % 3, k % 6).alias("rest"))
    return row_errors(rows, c, ["key"])


def k_bounds_int(spark, sf_dir):
    c = Contract("Part", (Field("p_partkey", M.INT), Field("p_size", constrained(M.INT, gt=2, le=48, multiple_of=(2, 3)))))
    return row_errors(table(spark, sf_dir, "part").select("p_partkey", "p_size"), c, ["p_partkey"])


def k_bounds_float(spark, sf_dir):
    """NaN and the infinities, injected by key, keep to no bound or to some."""
    k = F.col("c_custkey")
    value = F.when(k % 10 == 0, float("nan")).when(k % 10 == 1, float("inf")).when(k % 10 == 2, float("-inf")).otherwise(F.col("c_acctbal"))
    c = Contract("Balance", (Field("c_custkey", M.INT), Field("low", constrained(M.FLOAT, ge=0.0)), Field("high", constrained(M.FLOAT, lt=5000.0)), Field("step", constrained(M.FLOAT, multiple_of=0.1))))
    rows = table(spark, sf_dir, "customer").select("c_custkey", value.alias("low"), value.alias("high"), F.when(k % 10 < 3, value).otherwise((k % 7) * 0.1 + (k % 2) * 0.01).alias("step"))
    return row_errors(rows, c, ["c_custkey"])


def k_multiple_decimal(spark, sf_dir):
    c = Contract("Price", (Field("p_partkey", M.INT), Field("price", constrained(M.decimal(12, 2), gt=0, multiple_of=3))))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1000 / 100).cast("decimal(12,2)").alias("price"))
    return row_errors(rows, c, ["p_partkey"])


def k_length(spark, sf_dir):
    c = Contract("Names", (Field("p_partkey", M.INT), Field("p_name", constrained(M.STR, min_length=10, max_length=16)), Field("raw", constrained(M.BYTES, max_length=12))))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.encode("p_type", "UTF-8").alias("raw"))
    return row_errors(rows, c, ["p_partkey"])


def k_pattern(spark, sf_dir):
    c = Contract("Brand", (Field("p_partkey", M.INT), Field("p_brand", constrained(M.STR, pattern="^Brand#[1-3]")), Field("p_type", constrained(M.STR, pattern="STEEL|brass", flags="i"))))
    return row_errors(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), c, ["p_partkey"])


def p_literal(spark, sf_dir):
    c = Contract("Status", (Field("o_orderkey", M.INT), Field("o_orderstatus", M.Literal(("F", "O"))), Field("o_orderpriority", M.Enum(("1-URGENT", "2-HIGH", "5-LOW"), "Priority"))))
    return row_errors(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), c, ["o_orderkey"])


def p_types(spark, sf_dir):
    """A contract that names other kinds than the columns have; the plan decides these."""
    c = Contract("Kinds", (Field("c_custkey", M.INT), Field("c_name", M.INT), Field("c_nationkey", M.FLOAT), Field("c_acctbal", M.FLOAT), Field("c_mktsegment", M.BOOL), Field("c_phone", M.STR)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return row_errors(rows, c, ["c_custkey"])


def p_optional(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 > 0, F.col("c_name")).alias("a"), F.when(k % 4 > 0, F.col("c_name")).alias("b"))
    c = Contract("Opt", (Field("c_custkey", M.INT), Field("a", optional(M.STR)), Field("b", M.STR)))
    return row_errors(rows, c, ["c_custkey"])


def h_field_check(spark, sf_dir):
    c = Contract("Seg", (Field("c_custkey", M.INT), Field("c_acctbal", constrained(M.FLOAT, ge=0.0), checks=(("under_9000", lambda v: v < 9000), ("even", lambda v: F.floor(v) % 2 == 0)))))
    return row_errors(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), c, ["c_custkey"])


def h_spec_check(spark, sf_dir):
    c = Contract("Line", (Field("l_orderkey", M.INT), Field("l_linenumber", M.INT), Field("l_tax", constrained(M.FLOAT, le=0.07)), Field("l_discount", M.FLOAT)),
                 (Check("tax_at_most_discount", ("l_tax", "l_discount"), lambda t, d: t <= d),))
    done = from_rows(table(spark, sf_dir, "lineitem").select(*LINE, "l_tax", "l_discount"), c, keep=LINE)
    return flat_errors(done, LINE).select(*LINE, "code", "hook", F.array_join(F.transform(F.coalesce("locations", F.array().cast("array<array<string>>")), lambda x: F.array_join(x, "/")), ",").alias("fields"))


def h_transform(spark, sf_dir):
    digits = Field("c_name", constrained(M.INT, ge=10), transforms=(("digits", lambda c: F.nullif(F.regexp_extract(c, "([1-9][0-9]*)$", 1), F.lit(""))), ("number", lambda c: F.when(c.cast("bigint") % 7 != 3, c.cast("bigint")))))
    c = Contract("Number", (Field("c_custkey", M.INT), digits))
    return row_errors(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), c, ["c_custkey"])


def h_representation(spark, sf_dir):
    cents = Field("money", constrained(M.INT, ge=500), load=(M.STR, lambda t: F.when(t.rlike(r"^[0-9]+ cents$"), F.regexp_extract(t, "^([0-9]+)", 1).cast("bigint"))))
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(" euro"))).otherwise(F.concat(k.cast("string"), F.lit(" cents")))
    return row_errors(table(spark, sf_dir, "customer").select("c_custkey", text.alias("money")), Contract("Money", (Field("c_custkey", M.INT), cents)), ["c_custkey"])


def p_wide(spark, sf_dir):
    """A hundred fields: the compiled plan stays within code generation's limits or falls back."""
    c = Contract("Wide", (Field("l_orderkey", M.INT), Field("l_linenumber", M.INT), *[Field(f"f{i}", constrained(M.FLOAT, le=float(i + 1))) for i in range(100)]))
    rows = table(spark, sf_dir, "lineitem").select(*LINE, *[(F.col("l_quantity") + i % 3).alias(f"f{i}") for i in range(100)])
    return from_rows(rows, c, keep=LINE).select(*LINE, F.size("errors").alias("errors"), "truncated")


QUERIES = {f.__name__: f for f in (
    s_rows_aggregate, s_strict_fail_fast, s_report, s_split, e_totals, e_truncate, e_messages, e_context, e_located, e_render, p_nested, e_tree, b_nodes, p_list_items, p_map, p_set, p_tuple,
    k_bounds_int, k_bounds_float, k_multiple_decimal, k_length, k_pattern, p_literal, p_types, p_optional, h_field_check, h_spec_check, h_transform, h_representation, p_wide)}

_STEP = "(case when c_custkey % 10 = 0 then 'nan'::double when c_custkey % 10 = 1 then 'inf'::double when c_custkey % 10 = 2 then '-inf'::double else (c_custkey % 7) * 0.1::double + (c_custkey % 2) * 0.01::double end)"
_MSG = "case code when 'greater_than_or_equal' then 'Expected value >= ' || case path when 'l_quantity' then '1.0' else '0.0' end when 'greater_than' then 'Expected value > 0.0' when 'less_than_or_equal' then 'Expected value <= ' || case path when 'l_quantity' then '45.0' else '0.08' end when 'literal' then 'Expected Literal[''A'', ''N'']' when 'field_check' then 'Field check ''from_1993'' rejected the value' else 'Spec check ''tax_near_discount'' rejected the values' end"
ORACLE_SQL = {
    "s_rows_aggregate": _LINE_ERRORS,
    "s_strict_fail_fast": errors_sql("lineitem", LINE, LINE_RULES_ALL, first=True),
    "s_report": f"select path, code, count(*) as errors, count(distinct rid) as records from ({_BY_ROW}) group by path, code",
    "s_split": f"""with good as (select l_quantity from lineitem where not {_ANY} and l_tax <= l_discount + 0.05::double)
        select 'good' as part, count(*) as records, cast(sum(l_quantity) as bigint) as total from good
        union all select 'quarantine', count(distinct rid), count(*) from ({_BY_ROW})""",
    "e_totals": f"select coalesce(code, '(all)') as code, coalesce(path, '(all)') as path, count(*) as errors from ({_LINE_ERRORS}) group by rollup (code, path)",
    "e_truncate": f"select l_orderkey, l_linenumber, cast(least(count(*), 2) as int) as n, count(*) >= 2 as truncated from ({_BY_ROW}) group by rid, l_orderkey, l_linenumber",
    "e_messages": f"select code, path, {_MSG} as message, count(*) as errors from ({_LINE_ERRORS}) group by all",
    "e_context": f"""select code, 'float satisfying ' || case when code = 'greater_than' then 'Gt(0.0)' when code = 'greater_than_or_equal' and path = 'l_tax' then 'Ge(0.0)' when code = 'greater_than_or_equal' then 'Ge(1.0)' when path = 'l_quantity' then 'Le(45.0)' else 'Le(0.08)' end as expected,
        'float' as received, case when code = 'greater_than' then '0.0' when code = 'greater_than_or_equal' and path = 'l_tax' then '0.0' when code = 'greater_than_or_equal' then '1.0' when path = 'l_quantity' then '45.0' else '0.08' end as "limit", count(*) as errors
        from ({_LINE_ERRORS}) where code in ('greater_than', 'greater_than_or_equal', 'less_than_or_equal') group by all""",
    "e_located": f"""select l_orderkey * 8 + l_linenumber as item, position, '[' || (l_orderkey * 8 + l_linenumber) || ']' || case when path = '<root>' then '' else '.' || path end as path,
        (l_orderkey * 8 + l_linenumber) || case when path = '<root>' then '' else '/"' || path || '"' end as location from ({_LINE_ERRORS})""",
    "e_render": f"""with e as (select *, {_MSG} as message from ({_BY_ROW}) where position < 2)
        select l_orderkey, l_linenumber, 'LineItem' || case when count(*) > 1 then ' (' || count(*) || ' errors)' else '' end || case when count(*) >= 2 then ' [truncated]' else '' end || chr(10)
          || string_agg('  ' || path || chr(10) || '    ' || message, chr(10) order by position) as text from e group by rid, l_orderkey, l_linenumber""",
    "p_nested": _ORDER_SQL,
    "e_tree": f"""with e as ({_ORDER_SQL}), p as (select *, string_split(replace(replace(path, '[', '/'), '].', '/'), '/') as parts from e),
        s as (select o_orderkey, position, code, len(parts) as size, unnest(range(0, len(parts) + 1)) as depth, parts from p)
        select o_orderkey, array_to_string(parts[1:depth], '/') as node, cast(depth as int) as depth, coalesce(string_agg(case when size = depth then code end, ',' order by position), '') as own, count(*) as below from s group by all""",
    "b_nodes": "select o_orderkey, cast(4 + 4 * count(*) as bigint) as nodes from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey",
    "p_list_items": """with x as (select vec_id, embedding, list_position(list_transform(embedding, lambda v: not (v >= -0.35::double and v <= 0.35::double)), true) as i from embeddings)
        select vec_id, 0 as position, 'embedding[' || (i - 1) || ']' as path, case when embedding[i] >= -0.35::double then 'less_than_or_equal' else 'greater_than_or_equal' end as code from x where i is not null and i > 0 and len(embedding) = 64""",
    "p_map": """select event_id, 0 as position, case when user_id % 7 > 5 then 'props.a' else 'props.k' || (event_id % 3) end as path, 'less_than_or_equal' as code from events where user_id % 7 > 5 or event_id % 11 > 5""",
    "p_set": """with x as (select c_custkey as key, len(list_distinct([c_nationkey, c_custkey % 5, c_custkey % 3])) as n from customer)
        select key, case when n >= 3 then cast(n as int) end as members, case when n >= 3 then '' else 'min_length' end as codes from x""",
    "p_tuple": errors_sql("(select c_custkey as key from customer)", ["key"], [
        ("pair", "case when key % 5 = 0 then 'type' end"), ("pair[1]", "case when key % 5 <> 0 and key % 4 >= 3 then 'less_than' end"), ("rest[1]", "case when key % 6 >= 4 then 'less_than' end")]),
    "k_bounds_int": errors_sql("part", ["p_partkey"], [("p_size", "case when p_size <= 2 then 'greater_than' when p_size > 48 then 'less_than_or_equal' when p_size % 2 <> 0 or p_size % 3 <> 0 then 'multiple_of' end")]),
    "k_bounds_float": errors_sql("customer", ["c_custkey"], [
        ("low", "case when c_custkey % 10 in (0, 2) or (c_custkey % 10 > 2 and c_acctbal < 0) then 'greater_than_or_equal' end"),
        ("high", "case when c_custkey % 10 in (0, 1) or (c_custkey % 10 > 2 and c_acctbal >= 5000) then 'less_than' end"),
        ("step", "case when c_custkey % 10 in (0, 1, 2) or c_custkey % 2 = 1 then 'multiple_of' end")]),
    "k_multiple_decimal": errors_sql("part", ["p_partkey"], [("price", "case when p_partkey % 1000 = 0 then 'greater_than' when p_partkey % 300 <> 0 and (p_partkey % 1000) % 300 <> 0 then 'multiple_of' when (p_partkey % 1000) % 300 <> 0 then 'multiple_of' end")]),
    "k_length": errors_sql("part", ["p_partkey"], [("p_name", "case when length(p_name) < 10 then 'min_length' when length(p_name) > 16 then 'max_length' end"), ("raw", "case when strlen(p_type) > 12 then 'max_length' end")]),
    "k_pattern": errors_sql("part", ["p_partkey"], [("p_brand", "case when not regexp_matches(p_brand, '^Brand#[1-3]') then 'pattern' end"), ("p_type", "case when not regexp_matches(p_type, '(?i)STEEL|brass') then 'pattern' end")]),
    "p_literal": errors_sql("orders", ["o_orderkey"], [("o_orderstatus", "case when o_orderstatus not in ('F', 'O') then 'literal' end"), ("o_orderpriority", "case when o_orderpriority not in ('1-URGENT', '2-HIGH', '5-LOW') then 'literal' end")]),
    "p_types": errors_sql("customer", ["c_custkey"], [("c_name", "'type'"), ("c_nationkey", "'type'"), ("c_mktsegment", "'type'"), ("c_phone", "'missing'")]),
    "p_optional": errors_sql("customer", ["c_custkey"], [("b", "case when c_custkey % 4 = 0 then 'type' end")]),
    "h_field_check": errors_sql("customer", ["c_custkey"], [("c_acctbal", "case when c_acctbal < 0 then 'greater_than_or_equal' when c_acctbal >= 9000 or floor(c_acctbal) % 2 <> 0 then 'field_check' end")]),
    "h_spec_check": """select l_orderkey, l_linenumber, case when l_tax > 0.07::double then 'less_than_or_equal' else 'spec_check' end as code, case when l_tax <= 0.07::double then 'tax_at_most_discount' end as hook,
        case when l_tax <= 0.07::double then '"l_tax","l_discount"' else '' end as fields from lineitem where l_tax > 0.07::double or l_tax > l_discount""",
    "h_transform": errors_sql("(select c_custkey, try_cast(regexp_extract(c_name, '([1-9][0-9]*)$', 1) as bigint) as n from customer)", ["c_custkey"], [("c_name", "case when n is null or n % 7 = 3 then 'transform' when n < 10 then 'greater_than_or_equal' end")]),
    "h_representation": errors_sql("customer", ["c_custkey"], [("money", "case when c_custkey % 5 = 0 then 'representation_load' when c_custkey < 500 then 'representation_result' end")]),
    "p_wide": """select l_orderkey, l_linenumber, cast(least(100, n) as int) as errors, n >= 100 as truncated from (
        select l_orderkey, l_linenumber, len(list_filter(range(0, 100), lambda i: l_quantity + i % 3 > i + 1)) as n from lineitem)""",
}
