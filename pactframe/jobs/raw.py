"""Queries over raw records: framing, decoding, names and presence, tagged unions, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactframe.contract import model as M
from pactframe.contract.model import Contract, Field, Tagged, constrained, optional
from pactframe.functions.decode import strict_json
from pactframe.jobs.common import errors_sql, shared_folder, table
from pactframe.operators import budgets
from pactframe.operators.output import projected, to_json
from pactframe.operators.routing import route
from pactframe.operators.validate import flat_errors, from_json
from pactframe.sources import jsonl

# Faults by event_id: the same in Spark and in SQL.
_TEXT_SQL = """case event_id % 10
  when 0 then '{"user":' || user_id || ',"kind":"' || event_type || '"}'
  when 1 then '{"id":' || event_id || ',"kind":"' || event_type || '"}'
  when 2 then '{"id":' || event_id || ',"user":' || user_id || ',"kind":"' || event_type || '","extra":1}'
  when 3 then '{"id":"x","user":null,"kind":"' || event_type || '"}'
  when 4 then '{"id":' || event_id || ',"uid":' || user_id || ',"kind":"' || event_type || '"}'
  when 5 then '{"id":' || event_id || ',"uid":1,"user":1,"kind":"' || event_type || '"}'
  when 6 then '{"id":' || event_id || ',"user":' || user_id || ',"kind":"' || event_type || '","note":null}'
  when 7 then '{"id":' || event_id || ',"user":' || user_id || ',"kind":"' || event_type || '","note":"n' || user_id || '","level":' || (event_id % 70) || '}'
  else '{"id":' || event_id || ',"user":' || user_id || ',"kind":"' || event_type || '"}' end"""
EVENT = Contract("Event", (
    Field("event", M.INT, alias="id"), Field("user", M.INT, legacy=("uid", "user_id")), Field("kind", M.Enum(("click", "view", "signup", "purchase"), "Kind")),
    Field("note", optional(M.STR), default="none"), Field("level", constrained(M.INT, lt=50), default=1), Field("state", M.STR, factory=lambda: F.lit("new"))))
_EVENT_RULES = [
    ("id", "case when event_id % 10 = 0 then 'missing' when event_id % 10 = 3 then 'type' end"),
    ("user", "case when event_id % 10 = 1 then 'missing' when event_id % 10 = 3 then 'type' when event_id % 10 = 5 then 'alias_conflict' end"),
    ("kind", "case when event_type = 'error' then 'type' end"),
    ("level", "case when event_id % 10 = 7 and event_id % 70 >= 50 then 'less_than' end"),
    ("extra", "case when event_id % 10 = 2 then 'unexpected' end"),
]


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_TEXT_SQL).alias("text"))


def _events(spark, sf_dir):
    return from_json(_texts(spark, sf_dir), "text", EVENT, keep=["event_id"])


def n_errors(spark, sf_dir):
    """Missing, unexpected, aliases, conflicts, kinds."""
    return flat_errors(_events(spark, sf_dir), ["event_id"]).select("event_id", "position", "path", "code")


def n_conflict_names(spark, sf_dir):
    return flat_errors(_events(spark, sf_dir), ["event_id"]).where("code = 'alias_conflict'").select("event_id", F.array_join("conflicting_names", ",").alias("names"))


def n_default(spark, sf_dir):
    """Defaults fill absent keys, never nulls."""
    return _events(spark, sf_dir).where("value is not null").select("event_id", F.coalesce("value.note", F.lit("(null)")).alias("note"), "value.level", "value.state")


def n_present(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.array_join("present", ",").alias("present"))


def n_legacy_value(spark, sf_dir):
    return _events(spark, sf_dir).where("value is not null").select("event_id", F.col("value.user").alias("user_id"))


def e_tree_table(spark, sf_dir):
    """Failures of the whole table by path and code, with the share of failing records."""
    done = _events(spark, sf_dir)
    return flat_errors(done, ["event_id"]).groupBy("path", "code").agg(F.countDistinct("event_id").alias("records"))


_LINE_SQL = """case event_id % 12 when 0 then '' when 1 then chr(65279) || '1' when 2 then '{"id":1,"id":2}' when 3 then '{"id":NaN}' when 4 then '{"id":' || event_id || '} x' when 5 then '{"id":'
  when 6 then '{"id":' || chr(10) || '1}' when 7 then '   ' when 8 then '{"id":' || event_id || '}' || chr(13) when 9 then '{"id":"' || event_type || '"}' when 10 then '{"deep":{"a":1,"a":2}}' else '{"id":' || event_id || '}' end"""
LINE = Contract("Line", (Field("id", M.INT),))


def _lines(spark, sf_dir):
    text = _LINE_SQL.replace("chr(65279)", "decode(unhex('EFBBBF'), 'UTF-8')")
    return table(spark, sf_dir, "events").select("event_id", F.expr(text).alias("value"))


def f_frame(spark, sf_dir):
    return _lines(spark, sf_dir).select("event_id", jsonl.frame(F.col("value")).alias("code"))


def f_decode(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("event_id", F.coalesce(jsonl.frame(F.col("value")), strict_json(jsonl.unterminated(F.col("value")))["code"]).alias("code"))
    return rows.select("event_id", F.coalesce("code", F.lit("ok")).alias("code"))


def f_read(spark, sf_dir):
    """Records in order against a contract, with framing and validation failures apart."""
    rows = _lines(spark, sf_dir).select(F.col("event_id").alias("item_index"), jsonl.frame(F.col("value")).alias("_framing"), jsonl.unterminated(F.col("value")).alias("_text"))
    done = jsonl.classified(from_json(rows, "_text", LINE))
    return done.select("item_index", "line", F.coalesce("framing", F.lit("ok")).alias("framing"), F.col("value.id").alias("id"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


def f_line_bytes(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return rows.select("event_id", jsonl.line_bytes(F.col("value")).alias("bytes"), F.coalesce(jsonl.line_size(F.col("value"), 12), F.lit("ok")).alias("code"))


def f_utf8(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, F.unhex(F.lit("22FF22"))).otherwise(F.encode("event_type", "UTF-8")).cast("string")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(jsonl.frame(raw), F.lit("ok")).alias("code"))


def b_index(spark, sf_dir):
    return budgets.item_index(table(spark, sf_dir, "events").select("event_id"), "event_id")


def b_total_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return budgets.total_bytes(rows, F.octet_length("props") + 1, 30_000, "event_id").select("event_id", F.col("total_bytes").cast("bigint").alias("total_bytes"), "within")


def _indexed(spark, sf_dir):
    return budgets.item_index(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


def b_max_items(spark, sf_dir):
    rows = _indexed(spark, sf_dir)
    return budgets.max_items(rows, 700).deliver(rows, raise_error=False).select("event_id", "item_index")


def b_max_invalid(spark, sf_dir):
    rows = _indexed(spark, sf_dir)
    bad = F.col("event_type") == "error"
    return budgets.max_invalid(rows, bad, 25).deliver(rows, raise_error=False).where(~bad).select("event_id", "item_index")


def b_fail_fast(spark, sf_dir):
    rows = _indexed(spark, sf_dir)
    return budgets.fail_fast(rows, (F.col("event_type") == "error") & (F.col("item_index") > 300)).deliver(rows, raise_error=False).select("event_id", "item_index")


_TAG_SQL = """case event_id % 9 when 0 then '{"user":1}' when 1 then '{"type":1,"user":1}' when 2 then '{"type":"refund","user":1}' when 3 then '{"type":"' || event_type || '","user":"u"}'
  else '{"type":"' || event_type || '","user":' || user_id || case when event_type in ('purchase', 'signup') then ',"amount":"' || (user_id % 90) || '.50"' else '' end || '}' end"""
_AMOUNT = Field("amount", constrained(M.decimal(12, 2), lt=80))
TAGGED = Tagged("type", (
    ("click", Contract("Click", (Field("user", M.INT),))), ("view", Contract("View", (Field("user", M.INT),))),
    ("signup", Contract("Signup", (Field("user", M.INT), _AMOUNT))), ("purchase", Contract("Purchase", (Field("user", M.INT), _AMOUNT)))))


def _tagged(spark, sf_dir):
    return from_json(table(spark, sf_dir, "events").select("event_id", F.expr(_TAG_SQL).alias("text")), "text", TAGGED, keep=["event_id"])


def u_dispatch(spark, sf_dir):
    return flat_errors(_tagged(spark, sf_dir), ["event_id"]).select("event_id", "position", "path", "code")


def u_unknown(spark, sf_dir):
    return flat_errors(_tagged(spark, sf_dir), ["event_id"]).where("code = 'discriminator_unknown'").select("event_id", "discriminator", F.array_join("expected_tags", ",").alias("tags"), "input")


def u_missing(spark, sf_dir):
    return flat_errors(_tagged(spark, sf_dir), ["event_id"]).where("code = 'discriminator_missing'").select("event_id", "path", "message")


def u_route(spark, sf_dir):
    path = shared_folder(spark, "routed")
    _tagged(spark, sf_dir).select("event_id", "value").write.parquet(path)
    branches = route(spark.read.parquet(path), TAGGED, ["event_id"])
    out = None
    for name, df in branches.items():
        part = df.select(F.lit(name).alias("branch"), "event_id", F.col("value.user").alias("user"))
        out = part if out is None else out.union(part)
    return out


def u_union(spark, sf_dir):
    text = F.expr("""case event_id % 5 when 0 then '{"v":' || user_id || '}' when 1 then '{"v":"' || event_type || '"}' when 2 then '{"v":true}' when 3 then '{"v":1.5}' else '{"v":[1]}' end""")
    c = Contract("Either", (Field("v", M.Union((M.STR, constrained(M.INT, lt=500), M.FLOAT))),))
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", c, keep=["event_id"])
    return done.select("event_id", F.col("value.v.branch").alias("branch"), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"),
                       F.coalesce(F.size(F.get(F.col("errors"), F.lit(0))["branches"]), F.lit(0)).alias("branches"))


def p_positional(spark, sf_dir):
    text = F.expr("""case event_id % 5 when 0 then '[' || event_id || ']' when 1 then '[]' when 2 then '[1,"a",3]' when 3 then '["x"]' else '[' || event_id || ',"' || event_type || '"]' end""")
    c = Contract("Pair", (Field("id", M.INT), Field("kind", M.STR, default="none")), shape="positional")
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", c, keep=["event_id"])
    return done.select("event_id", F.col("value.id").alias("id"), F.col("value.kind").alias("kind"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("errors"))


def p_typed_dict(spark, sf_dir):
    """A closed dict reports its first failure only."""
    text = F.expr("""case event_id % 4 when 0 then '{"d":{"b":1,"c":2}}' when 1 then '{"d":{"a":"x","b":"y"}}' when 2 then '{"d":{"a":1,"z":1}}' else '{"d":{"a":1}}' end""")
    inner = Contract("D", (Field("a", M.INT), Field("b", M.INT, omittable=True)), shape="typed_dict")
    done = from_json(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", Contract("Outer", (Field("d", inner),)), keep=["event_id"])
    return flat_errors(done, ["event_id"]).select("event_id", "position", "path", "code")


def s_json_sink(spark, sf_dir):
    """Valid events back to strict JSON text."""
    good = _events(spark, sf_dir).where("value is not null")
    return good.select("event_id", to_json(EVENT, F.col("value")).alias("text"))


def e_redact(spark, sf_dir):
    """E5: a sensitive value never reaches an error."""
    c = Contract("Turn", (Field("conv_id", M.INT), Field("turn", M.INT), Field("role", M.STR), Field("text", constrained(M.STR, max_length=60), sensitive=True)))
    from pactframe.operators.validate import from_rows

    done = from_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), c, keep=["conv_id", "turn"])
    return flat_errors(done, ["conv_id", "turn"]).select("conv_id", "turn", "path", "code", "input")


def e_bounded_input(spark, sf_dir):
    """A long text is cut in the error."""
    c = Contract("Doc", (Field("doc_id", M.INT), Field("text", constrained(M.STR, max_length=40))))
    from pactframe.operators.validate import from_rows

    done = from_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), c, keep=["doc_id"])
    return flat_errors(done, ["doc_id"]).select("doc_id", "code", "input")


def o_tagged(spark, sf_dir):
    """A selection that keeps the discriminator."""
    good = _tagged(spark, sf_dir).where("value is not null")
    out = projected(TAGGED, F.col("value"), include={"type": True, "user": True})
    return good.select("event_id", out["type"].alias("type"), out["user"].alias("user"))


QUERIES = {f.__name__: f for f in (
    n_errors, n_conflict_names, n_default, n_present, n_legacy_value, e_tree_table, f_frame, f_decode, f_read, f_line_bytes, f_utf8, b_index, b_total_bytes, b_max_items, b_max_invalid, b_fail_fast,
    u_dispatch, u_unknown, u_missing, u_route, u_union, p_positional, p_typed_dict, s_json_sink, e_redact, e_bounded_input, o_tagged)}

_GOOD = "event_type <> 'error' and event_id % 10 in (4, 6, 7, 8, 9) and not (event_id % 10 = 7 and event_id % 70 >= 50)"
_NOTE = "case when event_id % 10 = 6 then null when event_id % 10 = 7 then 'n' || user_id else 'none' end"
_LEVEL = "cast(case when event_id % 10 = 7 then event_id % 70 else 1 end as bigint)"
_FRAME = "case when event_id % 12 = 0 then 'blank' when event_id % 12 = 1 then 'bom' when event_id % 12 = 6 then 'invalid_json' end"
_DECODE = f"coalesce({_FRAME}, case when event_id % 12 in (2, 10) then 'duplicate_key' when event_id % 12 = 3 then 'non_finite_number' when event_id % 12 in (4, 5, 7) then 'invalid_json' else 'ok' end)"
_TAG_RULES = [("type", "case when event_id % 9 = 0 then 'discriminator_missing' when event_id % 9 = 1 then 'type' when event_id % 9 = 2 or event_type = 'error' then 'discriminator_unknown' end"),
              ("user", "case when event_id % 9 = 3 and event_type <> 'error' then 'type' end"),
              ("amount", "case when event_type in ('signup', 'purchase') then case when event_id % 9 = 3 then 'missing' when event_id % 9 > 3 and user_id % 90 + 0.5 >= 80 then 'less_than' end end")]
_TAG_GOOD = "event_id % 9 > 3 and event_type <> 'error' and not (event_type in ('signup', 'purchase') and user_id % 90 + 0.5 >= 80)"
ORACLE_SQL = {
    "n_errors": errors_sql("events", ["event_id"], _EVENT_RULES),
    "n_conflict_names": "select event_id, 'user,uid' as names from events where event_id % 10 = 5",
    "n_default": f"select event_id, coalesce({_NOTE}, '(null)') as note, {_LEVEL} as level, 'new' as state from events where {_GOOD}",
    "n_present": """select event_id, case event_id % 10 when 0 then 'user,kind' when 1 then 'event,kind' when 6 then 'event,user,kind,note' when 7 then 'event,user,kind,note,level' else 'event,user,kind' end as present from events""",
    "n_legacy_value": f"select event_id, user_id from events where {_GOOD}",
    "e_tree_table": f"select path, code, count(distinct event_id) as records from ({errors_sql('events', ['event_id'], _EVENT_RULES)}) group by all",
    "f_frame": f"select event_id, {_FRAME} as code from events",
    "f_decode": f"select event_id, {_DECODE} as code from events",
    "f_read": f"""select event_id as item_index, event_id + 1 as line, {_DECODE} as framing, case when event_id % 12 in (8, 11) then event_id end as id, case when event_id % 12 = 9 then 'type' else '' end as codes from events""",
    "f_line_bytes": f"select event_id, cast(strlen({_LINE_SQL}) + 1 as int) as bytes, case when strlen({_LINE_SQL}) + 1 > 12 then 'jsonl_line_size' else 'ok' end as code from events",
    "f_utf8": "select event_id, case when event_id % 4 = 0 then 'invalid_encoding' else 'ok' end as code from events",
    "b_index": "select event_id, row_number() over (order by event_id) - 1 as item_index from events",
    "b_total_bytes": "select event_id, cast(s as bigint) as total_bytes, s <= 30000 as within from (select event_id, sum(strlen(props) + 1) over (order by event_id) as s from events)",
    "b_max_items": "select event_id, item_index from (select event_id, row_number() over (order by event_id) - 1 as item_index from events) where item_index < 700",
    "b_max_invalid": """with x as (select event_id, event_type, row_number() over (order by event_id) - 1 as item_index, sum(case when event_type = 'error' then 1 else 0 end) over (order by event_id) as bad from events)
        select event_id, item_index from x where bad <= 25 and event_type <> 'error'""",
    "b_fail_fast": """with x as (select event_id, event_type, row_number() over (order by event_id) - 1 as item_index from events)
        select event_id, item_index from x where item_index < (select min(item_index) from x where event_type = 'error' and item_index > 300)""",
    "u_dispatch": errors_sql("events", ["event_id"], _TAG_RULES),
    "u_unknown": "select event_id, 'type' as discriminator, 'click,purchase,signup,view' as tags, case when event_id % 9 = 2 then 'refund' else 'error' end as input from events where event_id % 9 = 2 or (event_id % 9 >= 3 and event_type = 'error')",
    "u_missing": "select event_id, 'type' as path, 'Required discriminator ''type'' is missing' as message from events where event_id % 9 = 0",
    "u_route": f"select upper(event_type[1]) || event_type[2:] as branch, event_id, user_id as \"user\" from events where {_TAG_GOOD}",
    "u_union": """select event_id, case event_id % 5 when 0 then case when user_id < 500 then 'Annotated[int, Lt(500)]' else 'float' end when 1 then 'str' when 3 then 'float' end as branch,
        case when event_id % 5 in (2, 4) then 'union' else '' end as codes, cast(case when event_id % 5 in (2, 4) then 3 else 0 end as int) as branches from events""",
    "p_positional": """select event_id, case event_id % 5 when 0 then event_id when 4 then event_id end as id, case event_id % 5 when 0 then 'none' when 4 then event_type end as kind,
        case event_id % 5 when 1 then '[0]:missing' when 2 then '[2]:unexpected' when 3 then '[0]:type' else '' end as errors from events""",
    "p_typed_dict": errors_sql("events", ["event_id"], [("d.a", "case event_id % 4 when 0 then 'missing' when 1 then 'type' end"), ("d.z", "case event_id % 4 when 2 then 'unexpected' end")]),
    "s_json_sink": f"""select event_id, '{{"id":' || event_id || ',"user":' || user_id || ',"kind":"' || event_type || '","note":' || coalesce('"' || ({_NOTE}) || '"', 'null') || ',"level":' || ({_LEVEL}) || ',"state":"new"}}' as text from events where {_GOOD}""",
    "e_redact": "select conv_id, turn, 'text' as path, 'max_length' as code, '<redacted>' as input from conversations where length(text) > 60",
    "e_bounded_input": "select doc_id, 'max_length' as code, case when length(text) > 160 then substr(text, 1, 145) || '... <truncated>' else text end as input from documents where length(text) > 40",
    "o_tagged": f"select event_id, event_type as type, user_id as \"user\" from events where {_TAG_GOOD}",
}
