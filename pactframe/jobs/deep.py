"""Registered queries over deeply nested records, files in order, stepwise patches and stream limits, and their SQL."""

from __future__ import annotations

import re

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.contract import model as M
from pactframe.contract.model import Contract, Field, constrained, derive
from pactframe.jobs.common import dealt, shared_folder, table
from pactframe.operators.hooks import python_hook
from pactframe.operators.levels import check_levels, from_json_levels
from pactframe.operators.output import to_json
from pactframe.operators.patches import apply_in_order
from pactframe.operators.routing import dispatch
from pactframe.operators.validate import error_patterns, from_json
from pactframe.sources import jsonl
from pactframe.streaming.stream import continued

_SAID = "errors, e -> e.path || ':' || e.code"
#: Levels of lists in the texts of `p_levels`: up to 6, one more than is allowed.
_DEEP = 5


def p_levels(spark, sf_dir):
    """Records that hold lists of themselves, to a depth that each row decides, by levels."""
    tree = Contract("Tree", (Field("v", M.INT), Field("c", M.Many(M.Ref("Tree")), default=None)))
    k = (F.col("event_id") % (_DEEP + 2)).cast("int")
    leaf = F.when(F.col("event_id") % 3 == 0, '{"v":"x"}').when(F.col("event_id") % 3 == 1, '{"v":1,"w":2}').otherwise('{"v":1,"c":[]}')
    top = F.when(F.col("event_id") % 5 == 0, '"y"').otherwise("1")
    text = F.when(k == 0, leaf).otherwise(F.concat(F.lit('{"v":'), top, F.lit(',"c":[{"v":1},'), F.repeat(F.lit('{"v":1,"c":[{"v":1},'), k - 1), leaf, F.repeat(F.lit(']}'), k)))
    rows = dealt(table(spark, sf_dir, "events").select("event_id")).select("event_id", text.alias("text"))
    done = check_levels(rows, "text", "Tree", {"Tree": tree}, ["event_id"], shared_folder(spark, "levels"), max_depth=_DEEP).verdicts
    return done.select("event_id", F.array_join(F.expr(f"transform({_SAID})"), ",").alias("bad"), "nodes", "depth")


def p_levels_alias(spark, sf_dir):
    """A whole number or a list of the like, by levels; what fails inside fails its union, and so on up."""
    kind = M.Union((M.INT, M.Many(M.Ref("Value"))))
    k = (F.col("event_id") % 4).cast("int")
    text = F.concat(F.repeat(F.lit("[1,"), k), F.when(F.col("event_id") % 3 == 1, '"x"').otherwise("2"), F.repeat(F.lit("]"), k))
    rows = dealt(table(spark, sf_dir, "events").select("event_id")).select("event_id", text.alias("text"))
    done = check_levels(rows, "text", "Value", {"Value": kind}, ["event_id"], shared_folder(spark, "levels")).verdicts
    inner = F.get(F.col("errors"), F.lit(0))
    return done.select("event_id", F.array_join(F.expr(f"transform({_SAID})"), ",").alias("bad"), F.array_join(F.transform(inner["branches"], lambda b: F.concat(b["label"], b["errors_json"])), ";").alias("branches"), "nodes", "depth")


def c_big_numbers(spark, sf_dir):
    """Integers and decimals of any size, digit for digit, from JSON to JSON; bounds beyond 38 digits."""
    k, sign = (F.col("o_orderkey") + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(F.lit(""))
    long = F.concat(F.lit("7"), F.repeat(F.lpad(k, 12, "0"), 5))
    case = F.col("o_orderkey") % 6
    n = F.when(case == 0, k).when(case == 1, F.concat(k, F.lit(".0"))).when(case == 2, F.concat(F.lit('"'), k, F.lit('"'))).when(case == 3, F.concat(F.lit("9"), long)).otherwise(F.concat(sign, long))
    exact = F.concat(F.lit("["), k, F.lit(".50,"), sign, k, F.lit("25e-1,"), k, F.lit(".5E+3,"), long, F.lit("."), long, F.lit(',"1_000.'), k, F.lit('"]'))
    c = Contract("Sums", (Field("n", constrained(M.BIG_INT, lt=10**61)), Field("by", M.Mapping(M.Many(M.EXACT)), alias="By")))
    text = F.concat(F.lit('{"n":'), n, F.lit(',"By":{"a/b~1.c":'), exact, F.lit("}}"))
    done = from_json(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", c, keep=["o_orderkey"])
    return done.select("o_orderkey", to_json(c, F.col("value")).alias("text"), F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(":"), e["code"])), ",").alias("bad"))


def p_levels_lists(spark, sf_dir):
    """An ordinary contract of five lists of records in one another, as a table a kind."""
    line = Contract("Line", (Field("quantity", constrained(M.FLOAT, lt=49.5)), Field("parts", M.Many(Contract("Part", (Field("marks", M.Many(Contract("Mark", (Field("n", M.INT),)))),))))))
    order = Contract("Order", (Field("key", M.INT), Field("lines", M.Many(line))))
    contract = Contract("Customer", (Field("orders", M.Many(order)), Field("name", M.STR)))
    mark = F.when(F.col("l_linenumber") == 7, '{"n":"7"}').otherwise('{"n":1}')
    one = F.concat(F.lit('{"quantity":'), F.col("l_quantity").cast("double").cast("string"), F.lit(',"parts":[{"marks":[{"n":0}]},{"marks":[{"n":1},'), mark, F.lit("]}]}"))
    own = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", one.alias("text"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["text"]), ",").alias("lines"))  # an order has seven lines at most
    text = F.concat(F.lit('{"orders":[{"key":'), F.col("l_orderkey").cast("string"), F.lit(',"lines":['), F.col("lines"), F.lit(']}],"name":"n"}'))
    found = from_json_levels(lines.select("l_orderkey", text.alias("text")), "text", contract, ["l_orderkey"], shared_folder(spark, "levels"))
    return found.verdicts.select("l_orderkey", F.array_join(F.expr(f"transform({_SAID})"), ",").alias("bad"), "nodes", "depth")


def s_read_files(spark, sf_dir):
    """Events as plain and gzip files, with and without byte order marks, read in the order of files and lines."""
    path = shared_folder(spark, "jsonl")
    text = F.expr("""case event_id % 6 when 0 then '' when 1 then '{"id":"x"}' else '{"id":' || event_id || '}' end""")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("g"), text.alias("text"))
    firsts = rows.groupBy("g").agg(F.min("event_id").alias("first"))  # four rows
    rows = rows.join(F.broadcast(firsts), "g")
    for g in range(4):
        value = F.when((F.col("event_id") == F.col("first")) & F.lit(g % 2 == 1), F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text"))
        own = rows.where(F.col("g") == g).repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
        own.select(value.alias("value")).write.option("compression", "gzip" if g > 1 else "none").text(f"{path}/g{g}")
    done = jsonl.read_jsonl(spark, f"{path}/*", Contract("R", (Field("id", M.INT),)))
    return done.select("item_index", "line", F.coalesce("framing", F.lit("ok")).alias("framing"), F.col("value.id").alias("id"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


def x_stream_budgets(spark, sf_dir):
    """Three streams, each over one of the limits: the rows before the one that goes over it, good and bad."""
    contract = Contract("Event", (Field("id", M.INT), Field("kind", M.Literal(("click", "view", "signup", "purchase")))))
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    text = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
    out = None
    for name, limits in (("items", {"max_items": 700}), ("invalid_items", {"max_invalid": 25}), ("total_bytes", {"max_total_bytes": 30_000})):
        source = spark.readStream.schema(schema).parquet(re.sub(r"/$", "", sf_dir) + "/event[s].parquet")
        rows = from_json(source.select("event_id", F.octet_length("props").alias("bytes"), text.alias("text")), "text", contract, keep=["event_id", "bytes"])
        root = shared_folder(spark, "budget")
        try:
            continued(rows, ["event_id"], f"{root}/good", f"{root}/bad", f"{root}/checkpoint", state_path=f"{root}/state", size="bytes", order="event_id", **limits).awaitTermination()
            ended = "in time"
        except StreamingQueryException as e:
            ended = re.search(r"(\w+): limit \d+, observed \d+", str(e))[0]
        for sound in ("good", "bad"):
            part = spark.read.parquet(f"{root}/{sound}").select(F.lit(name).alias("budget"), F.lit(ended).alias("ended"), "event_id", F.lit(sound == "good").alias("sound"))
            out = part if out is None else out.union(part)
    return out


def _number(text):
    """None for `none`; other texts that are no number are refused."""
    return None if text is None or text.strip() == "none" else int(text)


def _even(value):
    if value is not None and value % 2:
        raise ValueError("odd")


def h_python(spark, sf_dir):
    """H1, H2: a Python transform that gives None or refuses, then types and bounds, then a Python check."""
    field = Field("v", M.optional(constrained(M.INT, ge=20)), transforms=(("number", python_hook(_number, T.LongType())),), checks=(("even", python_hook(_even)),))
    k = F.col("event_id")
    v = F.when(k % 5 == 0, F.concat(F.lit('" '), k.cast("string"), F.lit('"'))).when(k % 5 == 1, '"none"').when(k % 5 == 2, '"x"').when(k % 5 == 3, k.cast("string")).otherwise("true")
    done = from_json(table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"v":'), v, F.lit("}")).alias("text")), "text", Contract("N", (field,)), keep=["event_id"])
    return done.select("event_id", F.col("value.v").alias("v"), F.col("value").isNotNull().alias("sound"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["code"], e["hook"])), ",").alias("codes"))


def d_steps(spark, sf_dir):
    """Orders as patches of their customers' limits, one by one: those that would put the lower limit above the upper one are refused."""
    limits = Contract("Limits", (Field("key", M.INT, read_only=True), Field("low", constrained(M.INT, ge=0)), Field("high", M.INT)), checks=(M.Check("order", ("low", "high"), lambda low, high: low <= high),))
    patch = derive(limits, mode="input", partial=True)
    k = F.col("o_orderkey")
    low, high = F.concat(F.lit('"low":'), (k % 53 - 3).cast("string")), F.concat(F.lit('"high":'), (k % 41).cast("string"))
    text = F.concat(F.lit("{"), F.when(k % 3 == 0, low).when(k % 3 == 1, high).otherwise(F.concat_ws(",", low, high)), F.lit("}"))
    patches = from_json(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("seq"), text.alias("text")), "text", patch, keep=["key", "seq"]).where("value is not null")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(5).cast("long").alias("low"), (F.col("c_nationkey") + 5).cast("long").alias("high"))
    done = apply_in_order(base, patches, "key", "seq", limits, patch, chunk=7)
    return done.select("key", "low", "high", "applied", F.array_join(F.col("refused").cast("array<string>"), ",").alias("refused"))


def e_patterns(spark, sf_dir):
    """Errors in lists and maps by the pattern of their location."""
    contract = Contract("Bag", (Field("items", M.Many(Contract("Item", (Field("x", constrained(M.INT, lt=9)),)))), Field("by", M.Mapping(M.Many(M.INT)))))
    k = F.col("event_id")
    items = F.array_join(F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.concat(F.lit('{"x":'), (i + k % 7).cast("string"), F.lit("}"))), ",")
    text = F.concat(F.lit('{"items":['), items, F.lit('],"by":{"k'), k.cast("string"), F.lit('":[1,'), F.when(k % 3 == 0, '"a"').otherwise("2"), F.lit("]}}"))
    return error_patterns(from_json(table(spark, sf_dir, "events").select(text.alias("text")), "text", contract, keep=[]), contract)


def u_branches(spark, sf_dir):
    """Twelve kinds of events, each checked by a plan of its own over its own rows."""
    kind = M.Tagged("type", tuple((f"t{n}", Contract(f"T{n}", (Field("id", M.INT), Field(f"f{n}", constrained(M.INT, lt=n + 20))))) for n in range(12)))
    k, n = F.col("event_id"), F.col("event_id") % 15
    text = F.concat(F.lit('{"type":'), F.when(n == 13, "7").otherwise(F.concat(F.lit('"t'), n.cast("string"), F.lit('"'))), F.lit(',"id":'), k.cast("string"), F.lit(',"f'), n.cast("string"), F.lit('":'), (k % 50).cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n == 14, F.lit("{")).otherwise(text).alias("text"))
    branches, rest = dispatch(rows, "text", kind, ["event_id"], shared_folder(spark, "branches"))
    out = rest.select("event_id", F.lit("").alias("branch"), "errors")
    for name, part in branches.items():
        out = out.union(part.select("event_id", F.lit(name).alias("branch"), "errors"))
    return out.select("event_id", "branch", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("bad"))


QUERIES = {f.__name__: f for f in (p_levels, p_levels_alias, p_levels_lists, s_read_files, x_stream_budgets, h_python, d_steps, e_patterns, u_branches, c_big_numbers)}

ORACLE_SQL = {
    "c_big_numbers": """with x as (select o_orderkey, (o_orderkey + 1)::varchar as k, case when o_orderkey % 2 = 0 then '-' else '' end as sign, '7' || repeat(lpad((o_orderkey + 1)::varchar, 12, '0'), 5) as long, o_orderkey % 6 as c from orders)
        select o_orderkey, case when c in (0, 4, 5) then '{"n":' || case when c = 0 then k else sign || long end || ',"By":{"a/b~1.c":["' || k || '.50","' || sign || k || '2.5","' || k || '500","' || long || '.' || long || '","1000.' || k || '"]}}' end as text,
          case when c in (1, 2) then 'n:type' when c = 3 then 'n:less_than' else '' end as bad from x""",
    "p_levels": f"""with x as (select event_id, cast(event_id % {_DEEP + 2} as int) as k from events)
        select event_id, concat_ws(',', case when k > 0 and event_id % 5 = 0 then 'v:type' end, case when k > {_DEEP} then repeat('c[1].', k - 1) || 'c[0]:depth'
            when event_id % 3 = 0 then repeat('c[1].', k) || 'v:type' when event_id % 3 = 1 then repeat('c[1].', k) || 'w:unexpected' end) as bad,
          cast(case when k > {_DEEP} then 2 * {_DEEP} + 1 else 2 * k + 1 end as bigint) as nodes, least(k, {_DEEP}) as depth from x""",
    "p_levels_alias": """with x as (select event_id, cast(event_id % 4 as int) as k, event_id % 3 = 1 as wrong from events)
        select event_id, case when wrong then '<root>:union' else '' end as bad,
          case when wrong then 'int[{"code":"type","path":"<root>"}];list[Value]' || case when k = 0 then '[{"code":"type","path":"<root>"}]' else '[{"code":"union","path":"[1]"}]' end end as branches,
          cast(2 * k + 1 as bigint) as nodes, k as depth from x""",
    "p_levels_lists": """with x as (select l_orderkey, l_linenumber as n, l_quantity >= 49.5 as much, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 as i from lineitem),
        f as (select l_orderkey, min(i) as i from x where much or n = 7 group by 1)
        select x.l_orderkey, coalesce(max(case when x.i = f.i then concat_ws(',', case when much then 'orders[0].lines[' || x.i || '].quantity:less_than' end, case when n = 7 then 'orders[0].lines[' || x.i || '].parts[1].marks[1].n:type' end) end), '') as bad,
          cast(2 + 6 * count(*) as bigint) as nodes, 4 as depth from x left join f on x.l_orderkey = f.l_orderkey group by 1""",
    "s_read_files": """with x as (select event_id, event_id = min(event_id) over (partition by event_id % 4) as first, row_number() over (order by event_id % 4, event_id) - 1 as i from events)
        select i as item_index, i + 1 as line, case when first and event_id % 2 = 1 then 'bom' when event_id % 6 = 0 then 'blank' else 'ok' end as framing,
          case when event_id % 6 > 1 and not (first and event_id % 2 = 1) then event_id end as id, case when event_id % 6 = 1 and not first then 'type' else '' end as codes from x""",
    "x_stream_budgets": """with x as (select event_id, event_type <> 'error' as sound, row_number() over (order by event_id) as n, sum((event_type = 'error')::int) over (order by event_id) as bad, sum(strlen(props)) over (order by event_id) as bytes from events)
        select 'items' as budget, case when (select max(n) from x) > 700 then 'items: limit 700, observed 701' else 'in time' end as ended, event_id, sound from x where n <= 700
        union all select 'invalid_items', case when (select max(bad) from x) > 25 then 'invalid_items: limit 25, observed 26' else 'in time' end, event_id, sound from x where bad <= 25
        union all select 'total_bytes', coalesce((select 'total_bytes: limit 30000, observed ' || min(bytes) from x where bytes > 30000), 'in time'), event_id, sound from x where bytes <= 30000""",
    "h_python": """select event_id, case when event_id % 5 in (0, 3) and event_id >= 20 and event_id % 2 = 0 and event_id % 5 = 0 then event_id when event_id % 5 = 3 and event_id >= 20 and event_id % 2 = 0 then event_id end as v,
        event_id % 5 = 1 or event_id % 5 in (0, 3) and event_id >= 20 and event_id % 2 = 0 as sound,
        case when event_id % 5 = 1 then '' when event_id % 5 = 2 then 'transform:number' when event_id % 5 = 4 then 'type' when event_id < 20 then 'greater_than_or_equal' when event_id % 2 = 1 then 'field_check:even' else '' end as codes from events""",
    "d_steps": """with recursive p as (
          select o_custkey as key, o_orderkey as seq, case when o_orderkey % 3 <> 1 then o_orderkey % 53 - 3 end as low, case when o_orderkey % 3 <> 0 then o_orderkey % 41 end as high, row_number() over (partition by o_custkey order by o_orderkey) as n
          from orders where o_orderkey % 3 = 1 or o_orderkey % 53 >= 3
        ), s as (
          select c_custkey as key, 0::bigint as n, 5::bigint as low, (c_nationkey + 5)::bigint as high, 0::bigint as applied, []::varchar[] as refused from customer
          union all
          select key, n, case when ok then a else low end, case when ok then b else high end, applied + ok::bigint, case when ok then refused else list_append(refused, seq::varchar) end
          from (select s.key, p.n, s.low, s.high, s.applied, s.refused, p.seq, coalesce(p.low, s.low) as a, coalesce(p.high, s.high) as b, coalesce(p.low, s.low) <= coalesce(p.high, s.high) as ok from s join p on p.key = s.key and p.n = s.n + 1)
        ) select key, low, high, applied, array_to_string(refused, ',') as refused from (select *, row_number() over (partition by key order by n desc) as last from s) where last = 1""",
    "e_patterns": """with x as (select event_id, len(list_filter(range(event_id % 5 + 1), lambda i: i + event_id % 7 >= 9)) > 0 as much, event_id % 3 = 0 as text from events)
        select 'items[*].x' as pattern, 'less_than' as code, count(*) as errors, count(*) as records from x where much having count(*) > 0
        union all select 'by.*[*]', 'type', count(*), count(*) from x where text having count(*) > 0""",
    "u_branches": """with x as (select event_id, event_id % 15 as n, event_id % 50 as v from events)
        select event_id, case when n < 12 then 'T' || n else '' end as branch, case when n = 12 then 'type:discriminator_unknown' when n = 13 then 'type:type' when n = 14 then '<root>:json_invalid'
            when v >= n + 20 then 'f' || n || ':less_than' else '' end as bad from x""",
}
