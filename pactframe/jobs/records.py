"""Queries over validated records: text scalars, derivation, patches, output, layers, hooks, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.contract import model as M
from pactframe.contract.compiler import json_value
from pactframe.contract.errors import Place
from pactframe.contract.model import Check, Contract, Field, constrained, derive, optional
from pactframe.functions import scalars
from pactframe.jobs.common import errors_sql, shared_folder, table
from pactframe.operators.hooks import validated_udf
from pactframe.operators.layers import name_conflicts, normalized_path, provenance, resolve_layers
from pactframe.operators.output import non_finite, partial_json, to_json, to_rows
from pactframe.operators.patches import apply_patch, fold_patches, replace_fields
from pactframe.operators.validate import flat_errors, from_json
from pactframe.streaming.stream import continued, validated_stream


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _k():
    return F.col("o_orderkey")


def t_int(spark, sf_dir):
    t = F.expr("case o_orderkey % 6 when 0 then '0' || o_orderkey when 1 then '-' || o_orderkey when 2 then o_orderkey || '.0' when 3 then ' ' || o_orderkey when 4 then '' else cast(o_orderkey as string) end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.text_int(t).alias("n"))


def t_float(spark, sf_dir):
    t = F.expr("case o_orderkey % 7 when 0 then '1e3' when 1 then '.5' when 2 then '5.' when 3 then 'NaN' when 4 then '1e999' when 5 then '-0.25' else '2.5E-1' end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.text_float(t).alias("x"))


def t_bool(spark, sf_dir):
    t = F.expr("case o_orderkey % 4 when 0 then 'true' when 1 then 'false' when 2 then 'True' else '1' end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.text_bool(t).alias("b"), scalars.text_null(F.when(_k() % 2 == 0, "null").otherwise("None")).alias("is_null"))


def c_date(spark, sf_dir):
    t = F.expr("case o_orderkey % 5 when 0 then '2026' when 1 then '2026-1-2' when 2 then '2026-02-30' when 3 then ' 2026-01-02' else date_format(o_orderdate, 'yyyy-MM-dd') end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.iso_date(t).cast("string").alias("d"))


def c_datetime(spark, sf_dir):
    t = F.expr("case o_orderkey % 5 when 0 then '2026-01-02T03:04:05Z' when 1 then '2026-01-02T03:04:05+02:00' when 2 then '2026-01-02 03:04' when 3 then '2026-01-02T25:00:00' else '2026-01-02T03:04:05.5' end")
    return _orders(spark, sf_dir).select("o_orderkey", F.date_format(scalars.iso_datetime(t), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), F.date_format(scalars.iso_datetime(t, aware=False), "yyyy-MM-dd HH:mm:ss.SSS").alias("wall"))


def c_time(spark, sf_dir):
    t = F.expr("case o_orderkey % 5 when 0 then '03:04' when 1 then '03:04:05.500' when 2 then '24:00:00' when 3 then '3:04' else '03:04:05.000000' end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.iso_time(t).alias("t"))


def c_duration(spark, sf_dir):
    t = F.expr("case o_orderkey % 6 when 0 then 'P' || o_orderkey || 'D' when 1 then '-PT' || o_orderkey || 'M1.5S' when 2 then 'P' when 3 then 'PT' when 4 then 'PT0.000001S' else 'P1DT25H' end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.duration_micros(t).alias("micros")).withColumn("text", scalars.format_duration(F.col("micros")))


def c_uuid(spark, sf_dir):
    h = F.md5(_k().cast("string"))
    t = F.when(_k() % 5 == 0, h).when(_k() % 5 == 1, F.concat(F.lit("{"), h, F.lit("}"))).when(_k() % 5 == 2, F.concat(F.lit("urn:uuid:"), F.upper(h))).when(_k() % 5 == 3, F.substring(h, 1, 31)).otherwise(
        F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return _orders(spark, sf_dir).select("o_orderkey", scalars.canonical_uuid(t).alias("u"))


def c_base64(spark, sf_dir):
    t = F.expr("case o_orderkey % 4 when 0 then 'YQ' when 1 then 'YQ==' when 2 then 'YWI=' else 'YW Jj' end")
    return _orders(spark, sf_dir).select("o_orderkey", F.decode(scalars.strict_base64(t), "UTF-8").alias("b"))


def c_decimal(spark, sf_dir):
    t = F.expr("case o_orderkey % 5 when 0 then '1.2345' when 1 then '10.50' when 2 then 'NaN' when 3 then '99999999999' else o_orderkey || '.25' end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.text_decimal(t, 12, 2).cast("string").alias("d"))


def c_float(spark, sf_dir):
    t = F.expr("case o_orderkey % 5 when 0 then '1' when 1 then '2.5' when 2 then '1e400' when 3 then '\"1\"' else '-1e2' end")
    return _orders(spark, sf_dir).select("o_orderkey", json_value(M.FLOAT, F.try_parse_json(t), Place()).value.alias("x"))


def c_ip(spark, sf_dir):
    t = F.when(_k() % 4 == 0, F.concat(F.lit("2001:0db8::"), F.hex(_k()))).when(_k() % 4 == 1, F.concat_ws(".", _k() % 300, _k() % 256, F.lit("0"), F.lit("1"))).when(_k() % 4 == 2, F.lit("::1")).otherwise(F.lit("10.0.0.0/8"))
    return _orders(spark, sf_dir).select("o_orderkey", scalars.canonical_ip("IPv6Address")(t).alias("v6"), scalars.canonical_ip("IPv4Address")(t).alias("v4"), scalars.canonical_ip("IPv4Network")(t).alias("net"))


def c_path(spark, sf_dir):
    t = F.concat(F.lit("a//b/./c"), (_k() % 3).cast("string"), F.when(_k() % 2 == 0, "/").otherwise(""))
    return _orders(spark, sf_dir).select("o_orderkey", scalars.path_text(t).alias("path"))


def c_iso_any(spark, sf_dir):
    t = F.expr("case o_orderkey % 4 when 0 then '2026-W01-1' when 1 then '20260102' when 2 then '2026-01-02' else 'x' end")
    return _orders(spark, sf_dir).select("o_orderkey", scalars.any_iso("date")(t).alias("d"))


def k_pattern_python(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.python_pattern(r"(?P<a>[A-Z])(?P=a)")(F.col("p_type")).alias("doubled"))


CUSTOMER = Contract("Customer", (
    Field("key", M.INT, read_only=True), Field("name", constrained(M.STR, min_length=1), alias="displayName"), Field("nation", M.INT), Field("segment", optional(M.STR)),
    Field("token", optional(M.STR), alias="apiToken", sensitive=True, write_only=True, default=None), Field("enabled", M.BOOL, default=True),
), (Check("active_has_name", ("name", "enabled"), lambda n, e: ~e | (F.trim(n) != "")),))
CUSTOMER_PATCH = derive(CUSTOMER, mode="input", partial=True)


def _base(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"),
                                                   F.concat(F.lit("t"), F.col("c_custkey")).alias("token"), (F.col("c_custkey") % 3 > 0).alias("enabled"))


_PATCH_SQL = """case o_orderkey % 6 when 0 then '{}' when 1 then '{"segment":null}' when 2 then '{"displayName":"N' || o_orderkey || '"}' when 3 then '{"displayName":" ","enabled":true}' when 4 then '{"nation":' || (o_orderkey % 25) || ',"segment":"S"}' else '{"displayName":""}' end"""


def _patches(spark, sf_dir):
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.expr(_PATCH_SQL).alias("text"))
    return from_json(rows, "text", CUSTOMER_PATCH, keep=["key", "seq"])


def d_patch_errors(spark, sf_dir):
    return flat_errors(_patches(spark, sf_dir), ["seq"]).select("seq", "position", "path", "code")


def d_patch_fold(spark, sf_dir):
    folded = fold_patches(_patches(spark, sf_dir).where("value is not null"), CUSTOMER_PATCH, "key", "seq")
    return folded.select("key", F.array_join("present", ",").alias("present"), F.col("value.name").alias("name"), F.col("value.nation").alias("nation"), F.col("value.segment").alias("segment"))


def d_patch(spark, sf_dir):
    folded = fold_patches(_patches(spark, sf_dir).where("value is not null"), CUSTOMER_PATCH, "key", "seq")
    done = apply_patch(_base(spark, sf_dir), folded, "key", CUSTOMER, CUSTOMER_PATCH)
    return done.select("key", F.col("value.name").alias("name"), F.col("value.segment").alias("segment"), F.col("value.token").alias("token"), "changed", F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


def d_pick(spark, sf_dir):
    return to_rows(_valid(spark, sf_dir), derive(CUSTOMER, include=("key", "segment")))


def _valid(spark, sf_dir):
    return replace_fields(_base(spark, sf_dir), CUSTOMER, ["key"]).where("value is not null")


def d_direction(spark, sf_dir):
    return to_rows(_valid(spark, sf_dir), derive(CUSTOMER, mode="output"))


def d_replace(spark, sf_dir):
    done = replace_fields(_base(spark, sf_dir), CUSTOMER, ["key"], name=F.when(F.col("key") % 4 == 0, F.lit(" ")).when(F.col("key") % 4 == 1, F.lit("")).otherwise(F.col("name")))
    return flat_errors(done, ["key"]).select("key", "path", "code")


def o_json(spark, sf_dir):
    return _valid(spark, sf_dir).select("key", to_json(CUSTOMER, F.col("value")).alias("text"))


def o_exclude_none(spark, sf_dir):
    rows = _base(spark, sf_dir).withColumn("segment", F.when(F.col("key") % 2 == 0, F.col("segment")))
    good = replace_fields(rows, CUSTOMER, ["key"]).where("value is not null")
    return good.select("key", to_json(CUSTOMER, F.col("value"), exclude_none=True, include=("key", "segment", "enabled")).alias("text"))


def o_partial_json(spark, sf_dir):
    good = _patches(spark, sf_dir).where("value is not null")
    return good.select("seq", partial_json(CUSTOMER_PATCH, F.col("value"), F.col("present")).alias("text"))


MEMBER = Contract("Member", (Field("number", M.INT, alias="no"), Field("quantity", M.FLOAT), Field("flag", M.STR)))
ACCOUNT = Contract("Account", (Field("o_orderkey", M.INT, alias="id"), Field("members", M.Many(MEMBER)), Field("by_flag", M.Mapping(MEMBER)), Field("note", optional(M.STR))))


def o_include_nested(spark, sf_dir):
    line = F.struct(F.col("l_linenumber").cast("bigint").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min(line).alias("m"))
    value = F.struct(F.col("l_orderkey").alias("o_orderkey"), F.array("m").alias("members"), F.create_map(F.col("m.flag"), F.col("m")).alias("by_flag"), F.lit(None).cast("string").alias("note"))
    text = to_json(ACCOUNT, F.col("value"), include={"o_orderkey": True, "members": {"number": True}, "by_flag": {"quantity": True, "flag": True}}, exclude={"by_flag": {"quantity": True}})
    return rows.select(F.col("l_orderkey").alias("id"), value.alias("value")).select("id", text.alias("text"))


def o_include_lists(spark, sf_dir):
    """As o_include_nested, over all lines: several members an order, and the least line of each flag."""
    line = F.struct(F.col("l_linenumber").cast("bigint").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("m"))
    flags = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["flag"])))
    by_flag = F.map_from_arrays(flags, F.transform(flags, lambda f: F.filter("m", lambda x: x["flag"] == f)[0]))
    value = F.struct(F.col("l_orderkey").alias("o_orderkey"), F.col("m").alias("members"), by_flag.alias("by_flag"), F.lit(None).cast("string").alias("note"))
    text = to_json(ACCOUNT, F.col("value"), include={"o_orderkey": True, "members": {"number": True}, "by_flag": {"quantity": True, "flag": True}}, exclude={"by_flag": {"quantity": True}})
    return rows.select(F.col("l_orderkey").alias("id"), value.alias("value")).select("id", text.alias("text"))


def o_scalars(spark, sf_dir):
    """Decimals exact, ISO times, base64, durations, as JSON writes them."""
    c = Contract("Out", (Field("amount", M.decimal(12, 2)), Field("at", M.NAIVE_DATETIME), Field("day", M.DATE), Field("raw", M.BYTES), Field("took", M.DURATION)))
    rows = _orders(spark, sf_dir).select("o_orderkey", F.struct(
        (_k() % 1000 / 10).cast("decimal(12,2)").alias("amount"), F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"), F.encode(F.substring("o_orderpriority", 1, 2), "UTF-8").alias("raw"),
        F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (_k() % 100000).cast("decimal(18,6)")).alias("took")).alias("v"))
    return rows.select("o_orderkey", to_json(c, F.col("v")).alias("text"))


def o_non_finite(spark, sf_dir):
    c = Contract("N", (Field("x", M.FLOAT), Field("xs", M.Many(M.FLOAT))))
    x = F.when(_k() % 3 == 0, float("nan")).otherwise(1.0)
    return _orders(spark, sf_dir).select("o_orderkey", non_finite(c, F.struct(x.alias("x"), F.array(F.lit(1.0), F.when(_k() % 5 == 0, float("inf")).otherwise(2.0)).alias("xs"))).alias("bad"))


def _layers(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), "p_size", "p_brand")
    make = lambda rank, layer, path, value, cond: part.where(cond).select("entity", F.lit(rank).alias("rank"), F.lit(layer).alias("layer"), F.lit(path).alias("path"), value.cast("string").alias("value"))
    e = F.col("entity")
    return (make(1, "toml", "store.region", F.col("p_brand"), F.lit(True)).union(make(1, "toml", "store.quota", F.lit(4410), e % 2 == 0)).union(make(2, "secret", "store.seal", F.lit("wax"), e % 3 == 0))
            .union(make(3, "environment", "store.quota", F.col("p_size"), e % 4 == 0)).union(make(4, "override", "store.region", F.lit("urgent"), e % 10 == 0)).union(make(4, "override", "store", F.lit("none"), e % 10 == 5)))


def l_layers(spark, sf_dir):
    return resolve_layers(_layers(spark, sf_dir))


def l_provenance(spark, sf_dir):
    leaves = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.explode(F.array(*[F.lit(p) for p in ("store.region", "store.quota", "store.seal")])).alias("path"))
    return provenance(resolve_layers(_layers(spark, sf_dir)), leaves).select("entity", "path", "source")


def l_conflict(spark, sf_dir):
    names = spark.createDataFrame([("shop_store__quota", "store.quota"), ("shop_st__quota", "store.quota"), ("shop_trace", "trace")], "name string, leaf string")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"))
    named = s.where("entity % 2 = 0").select("entity", F.lit("environment").alias("layer"), F.lit("SHOP_STORE__QUOTA").alias("name")).union(
        s.where("entity % 3 = 0").select("entity", F.lit("environment"), F.lit("shop_ST__quota"))).union(s.select("entity", F.lit("toml"), F.lit("SHOP_TRACE")))
    return name_conflicts(named, names).select("entity", "layer", "leaf", F.array_join("names", ",").alias("names"), "code")


def l_names(spark, sf_dir):
    t = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("SHOP_Store__"), F.col("s_name"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", normalized_path(t, "SHOP_").alias("path"))


def h_udf(spark, sf_dir):
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return a / b.where(b != 0)

    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    done = validated_udf(df, ratio, [("price", constrained(M.FLOAT, gt=0.0)), ("quantity", constrained(M.FLOAT, le=45.0))], constrained(M.FLOAT, le=1500.0), ["l_extendedprice", "l_quantity"])
    return done.select("l_orderkey", "l_linenumber", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("errors"))


TREE = M.recursive(lambda node: Contract("Node", (Field("value", M.INT), Field("children", M.Many(node), default=None))), 3)


def p_recursive(spark, sf_dir):
    """A recursive contract unrolled to a depth."""
    text = F.expr("""case event_id % 3 when 0 then '{"value":1,"children":[{"value":2,"children":[{"value":"x"}]}]}' when 1 then '{"value":1,"children":[{"value":2}]}' else '{"value":1}' end""")
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", TREE, max_depth=64, keep=["event_id"])
    return flat_errors(done, ["event_id"]).select("event_id", "position", "path", "code")


def x_stream(spark, sf_dir):
    """Events as a stream, good rows and quarantine by batch, counters per batch."""
    import re

    root = shared_folder(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(re.sub(r"/$", "", sf_dir) + "/event[s].parquet")
    rows = source.select("event_id", F.concat(F.lit('{"k":'), F.when(F.col("event_id") % 5 == 0, F.lit('"x"')).otherwise((F.col("event_id") % 9).cast("string")), F.lit("}")).alias("text"))
    done = validated_stream(rows, "text", Contract("K", (Field("k", constrained(M.INT, lt=8)),)), ["event_id"])
    continued(done, ["event_id"], f"{root}/good", f"{root}/bad", f"{root}/checkpoint", max_items=10**9, max_invalid=10**9, state_path=f"{root}/state").awaitTermination()
    good, bad = spark.read.parquet(f"{root}/good"), spark.read.parquet(f"{root}/bad")
    return good.select("event_id", F.lit("good").alias("part"), F.col("value.k").alias("k")).union(bad.select("event_id", F.lit("quarantine"), F.lit(None).cast("bigint")))


QUERIES = {f.__name__: f for f in (
    t_int, t_float, t_bool, c_date, c_datetime, c_time, c_duration, c_uuid, c_base64, c_decimal, c_float, c_ip, c_path, c_iso_any, k_pattern_python, d_patch_errors, d_patch_fold, d_patch, d_pick, d_direction, d_replace,
    o_json, o_exclude_none, o_partial_json, o_include_nested, o_include_lists, o_scalars, o_non_finite, l_layers, l_provenance, l_conflict, l_names, h_udf, p_recursive, x_stream)}

_PATCH_VALUES = """p as (select o_custkey as key, o_orderkey as seq, o_orderkey % 6 as r from orders where o_orderkey % 6 <> 5)"""
_FOLD = f"""with {_PATCH_VALUES}, f as (select key, max(case when r in (2, 3) then seq end) as n, max(case when r = 4 then seq end) as a, max(case when r in (1, 4) then seq end) as s, max(case when r = 3 then seq end) as e from p group by key)"""
_NAME = "case when n % 6 = 2 then 'N' || n when n % 6 = 3 then ' ' end"
ORACLE_SQL = {
    "t_int": "select o_orderkey, case o_orderkey % 6 when 1 then -o_orderkey when 5 then o_orderkey when 0 then case when o_orderkey = 0 then null end end as n from orders",
    "t_float": "select o_orderkey, case o_orderkey % 7 when 0 then 1000.0::double when 5 then -0.25::double when 6 then 0.25::double end as x from orders",
    "t_bool": "select o_orderkey, case o_orderkey % 4 when 0 then true when 1 then false end as b, o_orderkey % 2 = 0 as is_null from orders",
    "c_date": "select o_orderkey, case when o_orderkey % 5 = 4 then strftime(o_orderdate, '%Y-%m-%d') end as d from orders",
    "c_datetime": "select o_orderkey, case o_orderkey % 5 when 0 then '2026-01-02 03:04:05.000' when 1 then '2026-01-02 01:04:05.000' when 2 then '2026-01-02 03:04:00.000' when 4 then '2026-01-02 03:04:05.500' end as \"at\", case o_orderkey % 5 when 2 then '2026-01-02 03:04:00.000' when 4 then '2026-01-02 03:04:05.500' end as wall from orders",
    "c_time": "select o_orderkey, case o_orderkey % 5 when 0 then '03:04:00' when 1 then '03:04:05.500000' when 4 then '03:04:05' end as t from orders",
    "c_duration": """select o_orderkey, case o_orderkey % 6 when 0 then o_orderkey * 86400000000 when 1 then -(o_orderkey * 60000000 + 1500000) when 4 then 1 when 5 then 176400000000 end as micros,
        case o_orderkey % 6 when 0 then case when o_orderkey = 0 then 'PT0S' else 'P' || o_orderkey || 'D' end when 4 then 'PT0.000001S' when 5 then 'P2DT1H'
          when 1 then '-P' || case when o_orderkey >= 1440 then (o_orderkey // 1440) || 'D' else '' end || 'T' || case when o_orderkey % 1440 >= 60 then ((o_orderkey % 1440) // 60) || 'H' else '' end || case when o_orderkey % 60 > 0 then (o_orderkey % 60) || 'M' else '' end || '1.5S' end as text from orders""",
    "c_uuid": "select o_orderkey, case when o_orderkey % 5 <> 3 then regexp_replace(md5(o_orderkey::varchar), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') end as u from orders",
    "c_base64": "select o_orderkey, case o_orderkey % 4 when 1 then 'a' when 2 then 'ab' end as b from orders",
    "c_decimal": "select o_orderkey, case o_orderkey % 5 when 1 then '10.50' when 4 then o_orderkey || '.25' end as d from orders",
    "c_float": "select o_orderkey, case o_orderkey % 5 when 0 then 1.0::double when 1 then 2.5::double when 4 then -100.0::double end as x from orders",
    "c_ip": """select o_orderkey, case when o_orderkey % 4 = 0 and o_orderkey <= 65535 then case when o_orderkey = 0 then '2001:db8::' else '2001:db8::' || printf('%x', o_orderkey) end when o_orderkey % 4 = 2 then '::1' end as v6,
        case when o_orderkey % 4 = 1 and o_orderkey % 300 <= 255 then (o_orderkey % 300) || '.' || (o_orderkey % 256) || '.0.1' end as v4,
        case when o_orderkey % 4 = 1 and o_orderkey % 300 <= 255 then (o_orderkey % 300) || '.' || (o_orderkey % 256) || '.0.1/32' when o_orderkey % 4 = 3 then '10.0.0.0/8' end as net from orders""",
    "c_path": "select o_orderkey, 'a/b/c' || (o_orderkey % 3) as path from orders",
    "c_iso_any": "select o_orderkey, case o_orderkey % 4 when 0 then '2025-12-29' when 1 then '2026-01-02' when 2 then '2026-01-02' end as d from orders",
    "k_pattern_python": "select p_partkey, len(list_filter(range(1, length(p_type)), lambda i: p_type[i] = p_type[i + 1] and p_type[i] between 'A' and 'Z')) > 0 as doubled from part",
    "d_patch_errors": errors_sql("(select o_orderkey as seq from orders)", ["seq"], [("displayName", "case when seq % 6 = 5 then 'min_length' end")]),
    "d_patch_fold": f"""{_FOLD} select key, concat_ws(',', case when n is not null then 'name' end, case when a is not null then 'nation' end, case when s is not null then 'segment' end, case when e is not null then 'enabled' end) as present,
        {_NAME} as name, a % 25 as nation, case when s % 6 = 4 then 'S' end as segment from f""",
    "d_patch": f"""{_FOLD}, j as (select c_custkey as key, case when n is null then c_name else {_NAME} end as name, case when s is null then c_mktsegment when s % 6 = 4 then 'S' end as segment, 't' || c_custkey as token,
        case when e is not null then true else c_custkey % 3 > 0 end as enabled, n is not null or a is not null or s is not null or e is not null as changed from customer left join f on key = c_custkey)
        select key, case when not bad then name end as name, case when not bad then segment end as segment, case when not bad then token end as token, changed, case when bad then 'spec_check' else '' end as codes
        from (select *, enabled and trim(name) = '' as bad from j)""",
    "d_pick": "select c_custkey as key, c_mktsegment as segment from customer",
    "d_direction": "select c_custkey as key, c_name as \"displayName\", cast(c_nationkey as bigint) as nation, c_mktsegment as segment, c_custkey % 3 > 0 as enabled from customer",
    "d_replace": "select c_custkey as key, case when c_custkey % 4 = 1 then 'name' else '<root>' end as path, case when c_custkey % 4 = 1 then 'min_length' else 'spec_check' end as code from customer where c_custkey % 4 = 1 or (c_custkey % 4 = 0 and c_custkey % 3 > 0)",
    "o_json": """select c_custkey as key, '{"key":' || c_custkey || ',"displayName":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '","apiToken":"t' || c_custkey || '","enabled":' || (c_custkey % 3 > 0) || '}' as text from customer""",
    "o_exclude_none": """select c_custkey as key, '{"key":' || c_custkey || case when c_custkey % 2 = 0 then ',"segment":"' || c_mktsegment || '"' else '' end || ',"enabled":' || (c_custkey % 3 > 0) || '}' as text from customer""",
    "o_partial_json": """select o_orderkey as seq, case o_orderkey % 6 when 0 then '{}' when 1 then '{"segment":null}' when 2 then '{"displayName":"N' || o_orderkey || '"}' when 3 then '{"displayName":" ","enabled":true}'
        else '{"nation":' || (o_orderkey % 25) || ',"segment":"S"}' end as text from orders where o_orderkey % 6 <> 5""",
    "o_include_nested": """with x as (select l_orderkey as id, min((l_linenumber, l_quantity, l_returnflag)) as m from lineitem where l_linenumber = 1 group by 1)
        select id, '{"id":' || id || ',"members":[{"no":1}],"by_flag":{"' || m[3] || '":{"flag":"' || m[3] || '"}}}' as text from x""",
    "o_include_lists": """with f as (select distinct l_orderkey as k, l_returnflag as flag from lineitem), g as (select k, string_agg('"' || flag || '":{"flag":"' || flag || '"}', ',' order by flag) as by_flag from f group by 1),
        x as (select l_orderkey as id, string_agg('{"no":' || l_linenumber || '}', ',' order by l_linenumber) as members from lineitem group by 1)
        select id, '{"id":' || id || ',"members":[' || members || '],"by_flag":{' || by_flag || '}}' as text from x join g on k = id""",
    "o_scalars": """with x as (select o_orderkey, o_orderdate, o_orderkey % 100000 as s, o_orderpriority[1:2] as p from orders)
        select o_orderkey, '{"amount":"' || cast(cast(o_orderkey % 1000 as decimal(12,2)) / 10 as decimal(12,2)) || '","at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || case when microsecond(o_orderdate) % 1000000 > 0 then '.' || lpad((microsecond(o_orderdate) % 1000000)::varchar, 6, '0') else '' end
          || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","raw":"' || to_base64(encode(p)) || '","took":"' || case when s = 0 then 'PT0S' else 'P' || case when s >= 86400 then (s // 86400) || 'D' else '' end
          || case when s % 86400 > 0 then 'T' || case when s % 86400 >= 3600 then ((s % 86400) // 3600) || 'H' else '' end || case when s % 3600 >= 60 then ((s % 3600) // 60) || 'M' else '' end || case when s % 60 > 0 then (s % 60) || 'S' else '' end else '' end end || '"}' as text from x""",
    "o_non_finite": "select o_orderkey, o_orderkey % 3 = 0 or o_orderkey % 5 = 0 as bad from orders",
    "l_layers": """select p_partkey as entity, 'store' as path, 'none' as value, 'override' as source from part where p_partkey % 10 = 5
        union all select p_partkey, 'store.region', case when p_partkey % 10 = 0 then 'urgent' else p_brand end, case when p_partkey % 10 = 0 then 'override' else 'toml' end from part where p_partkey % 10 <> 5
        union all select p_partkey, 'store.quota', case when p_partkey % 4 = 0 then p_size::varchar else '4410' end, case when p_partkey % 4 = 0 then 'environment' else 'toml' end from part where p_partkey % 2 = 0
        union all select p_partkey, 'store.seal', 'wax', 'secret' from part where p_partkey % 3 = 0 and p_partkey % 10 <> 5""",
    "l_provenance": """select p_partkey as entity, 'store.region' as path, case when p_partkey % 10 = 5 then 'default' when p_partkey % 10 = 0 then 'override' else 'toml' end as source from part
        union all select p_partkey, 'store.quota', case when p_partkey % 4 = 0 then 'environment' when p_partkey % 2 = 0 then 'toml' else 'default' end from part
        union all select p_partkey, 'store.seal', case when p_partkey % 3 = 0 and p_partkey % 10 <> 5 then 'secret' else 'default' end from part""",
    "l_conflict": "select s_suppkey as entity, 'environment' as layer, 'store.quota' as leaf, 'shop_st__quota,shop_store__quota' as names, 'alias_conflict' as code from supplier where s_suppkey % 6 = 0",
    "l_names": "select s_suppkey, case when s_suppkey % 2 = 0 then 'store.' || lower(s_name) end as path from supplier",
    "h_udf": """select l_orderkey, l_linenumber, concat_ws(',', case when l_extendedprice <= 0 then 'price:greater_than' end, case when l_quantity > 45 then 'quantity:less_than_or_equal' end,
        case when l_extendedprice > 0 and l_quantity <= 45 and l_extendedprice / l_quantity > 1500 then 'return:less_than_or_equal' end) as errors from lineitem""",
    "p_recursive": "select event_id, 0 as position, 'children[0].children[0].value' as path, 'type' as code from events where event_id % 3 = 0",
    "x_stream": "select event_id, case when event_id % 5 = 0 or event_id % 9 = 8 then 'quarantine' else 'good' end as part, case when event_id % 5 = 0 or event_id % 9 = 8 then null else event_id % 9 end as k from events",
}
