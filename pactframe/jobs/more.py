"""Queries for the remaining operators: files of records, output names, serialisers, text decoders, patch streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pactframe.contract import model as M
from pactframe.contract.model import Contract, Field, constrained, derive, optional
from pactframe.functions import scalars
from pactframe.jobs.common import shared_folder, table
from pactframe.jobs.raw import TAGGED
from pactframe.operators.hooks import dump_checked
from pactframe.operators.output import to_json, to_rows
from pactframe.operators.validate import flat_errors, from_json, from_rows
from pactframe.sources import jsonl
from pactframe.streaming.stream import patch_stream, patched


def s_read_jsonl(spark, sf_dir):
    """Events written as JSON Lines files and read back strictly, each record by its own id."""
    path = shared_folder(spark, "jsonl")
    text = F.expr("""case event_id % 6 when 0 then '' when 1 then '{"id":' || event_id || ',"id":1}' when 2 then '{"id":"x"}' else '{"id":' || event_id || '}' end""")
    table(spark, sf_dir, "events").select(text.alias("value")).write.text(path)
    done = jsonl.read_jsonl(spark, path, Contract("R", (Field("id", M.INT),)))
    return done.select(F.coalesce("framing", F.lit("ok")).alias("framing"), F.col("value.id").alias("id"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


def f_input_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(jsonl.input_size(F.col("text"), 2000), F.lit("ok")).alias("code"))


def o_alias(spark, sf_dir):
    c = Contract("Nation", (Field("n_nationkey", M.INT, alias="key"), Field("n_name", constrained(M.STR, min_length=1), alias="label")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("label"))
    return to_rows(from_rows(rows, c), c, by_alias=True)


def t_optional(spark, sf_dir):
    t = F.expr("case o_orderkey % 4 when 0 then 'null' when 1 then cast(o_orderkey as string) when 2 then 'x' else '007' end")
    got = scalars.text_optional(t, scalars.text_int)
    return table(spark, sf_dir, "orders").select("o_orderkey", got["value"].alias("value"), got["ok"].alias("ok"))


def t_literal(spark, sf_dir):
    t = F.expr("case o_orderkey % 6 when 0 then '1' when 1 then '\"1\"' when 2 then 'true' when 3 then 'open' when 4 then '\"open\"' else '1.0' end")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.text_literal(t, (1, True, "open")).alias("value"))


def t_structured(spark, sf_dir):
    """A list in a text leaf."""
    c = Contract("Leaf", (Field("ports", M.Many(constrained(M.INT, lt=9))),))
    text = F.concat(F.lit('{"ports":['), (F.col("event_id") % 10).cast("string"), F.lit(","), (F.col("event_id") % 12).cast("string"), F.lit("]}"))
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", c, keep=["event_id"])
    return flat_errors(done, ["event_id"]).select("event_id", "path", "code")


def h_serialize(spark, sf_dir):
    """H4, C14: a field's own serialiser, and one whose result is checked."""
    c = Contract("Out", (Field("key", M.INT), Field("name", M.STR, dump=lambda v: F.upper(v))))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    value = F.struct("key", "name")
    checked = dump_checked(constrained(M.INT, lt=20), F.col("name"), lambda v: F.length(v) + (F.col("key") % 4).cast("int"), rows.select(F.length("name")).schema[0].dataType)
    return rows.select("key", to_json(c, value).alias("text"), F.array_join(F.transform(checked.errors, lambda e: e["code"]), ",").alias("codes"))


def u_optional_tagged(spark, sf_dir):
    """U8: None passes without dispatch."""
    text = F.expr("""case event_id % 4 when 0 then '{"e":null}' when 1 then '{"e":{"type":"click","user":1}}' when 2 then '{"e":{"type":"nope"}}' else '{}' end""")
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", Contract("E", (Field("e", optional(TAGGED)),)), keep=["event_id"])
    return done.select("event_id", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("errors"))


def x_patch(spark, sf_dir):
    """Patches of orders' customers as a stream onto the customer table."""
    c = Contract("Cust", (Field("key", M.INT, read_only=True), Field("name", M.STR), Field("nation", constrained(M.INT, lt=25))))
    patch = derive(c, mode="input", partial=True)
    root = shared_folder(spark, "patch")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nation")).write.parquet(f"{root}/base")
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    source = spark.readStream.schema(schema).parquet(re.sub(r"/$", "", sf_dir) + "/order[s].parquet")
    rows = source.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.concat(F.lit('{"nation":'), (F.col("o_orderkey") % 25).cast("string"), F.lit("}")).alias("text"))
    done = from_json(rows, "text", patch, keep=["key", "seq"])
    patch_stream(done, f"{root}/base", f"{root}/out", "key", "seq", c, patch, f"{root}/checkpoint").awaitTermination()
    return patched(spark, f"{root}/out").select("key", "name", "nation")


QUERIES = {f.__name__: f for f in (s_read_jsonl, f_input_size, o_alias, t_optional, t_literal, t_structured, h_serialize, u_optional_tagged, x_patch)}
ORACLE_SQL = {
    "s_read_jsonl": """select case event_id % 6 when 0 then 'blank' when 1 then 'duplicate_key' else 'ok' end as framing, case when event_id % 6 > 2 then event_id end as id, case when event_id % 6 = 2 then 'type' else '' end as codes from events""",
    "f_input_size": "select doc_id, case when strlen(text) > 2000 then 'input_size' else 'ok' end as code from documents",
    "o_alias": "select cast(n_nationkey as bigint) as key, n_name as label from nation",
    "t_optional": "select o_orderkey, case when o_orderkey % 4 = 1 then o_orderkey end as value, o_orderkey % 4 in (0, 1) as ok from orders",
    "t_literal": "select o_orderkey, case o_orderkey % 6 when 0 then '1' when 2 then 'true' when 3 then '\"open\"' when 4 then '\"open\"' end as value from orders",
    "t_structured": "select event_id, case when event_id % 10 >= 9 then 'ports[0]' else 'ports[1]' end as path, 'less_than' as code from events where event_id % 10 >= 9 or event_id % 12 >= 9",
    "h_serialize": """select c_custkey as key, '{"key":' || c_custkey || ',"name":"' || upper(c_name) || '"}' as text, case when length(c_name) + c_custkey % 4 >= 20 then 'less_than' else '' end as codes from customer""",
    "u_optional_tagged": "select event_id, case event_id % 4 when 2 then 'e.type:discriminator_unknown' when 3 then 'e:missing' else '' end as errors from events",
    "x_patch": """with f as (select o_custkey, max(o_orderkey) as seq from orders group by 1) select c_custkey as key, c_name as name, cast(coalesce(seq % 25, c_nationkey) as bigint) as nation from customer left join f on o_custkey = c_custkey""",
}
