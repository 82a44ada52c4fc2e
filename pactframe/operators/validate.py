"""Validation and conversion of whole tables."""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactframe.contract import compiler as C
from pactframe.contract import model as M
from pactframe.contract.errors import Place, error, first_of, no_errors
from pactframe.contract.model import Contract, Tagged, has_exact
from pactframe.functions import scalars
from pactframe.functions.decode import decoded, depth_over, kept_tokens


def _staged(df: DataFrame, ctx: C.Ctx, compiled: C.Compiled, keep: list[str], errors: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """keep, value, errors, truncated and `more`: the last select after the compiler's stages.

    What is asked of value or errors later isn't pushed below this select (a
    partition id in it sees to that): it would be put into the scan's filter
    with all stages written out, and checked twice.  Filters on other columns
    belong before the validation.
    """
    ok, _ = ctx.stage(compiled.ok, compiled.level)
    ok = ok & (F.spark_partition_id() >= 0)
    found = compiled.errors if errors is None else errors
    truncated = F.lit(False) if compiled.truncated is None or errors is not None else ~ok & F.coalesce(compiled.truncated, F.lit(False))
    more = more or {}
    return ctx.stages.applied(df).select(*keep, F.when(ok, compiled.value).alias("value"), F.when(ok, no_errors()).otherwise(found).alias("errors"), truncated.alias("truncated"), *[c.alias(n) for n, c in more.items()])


def _columns(df: DataFrame, contract: Contract, keep: list[str] | None):
    """The table's columns that belong to the record."""
    own = {n for x in contract.fields for n in x.names}
    return type(df.schema)([f for f in df.schema if keep is None or f.name not in keep or f.name in own])


def validate_table(df: DataFrame, contract: Contract, keep: list[str] | None = None) -> DataFrame:
    """Strict validation of typed columns without conversion: the first failing field of a row only.

    Errors of the fields behind it aren't built.
    """
    ctx = C.Ctx(stages=C.Stages())
    c = C.rows_record(contract, _columns(df, contract, keep), lambda n: F.col(f"`{n}`"), Place(), ctx)
    first = C._chain([(~ok, first_of(errors)) for ok, errors in c.values], first_of(c.errors))
    return _staged(df, ctx, c, df.columns if keep is None else keep, first)


def from_rows(df: DataFrame, contract: Contract, max_errors: int = 100, keep: list[str] | None = None) -> DataFrame:
    """Conversion of typed columns: all independent errors of a row, in declaration order.

    `max_errors` counts the failing parts of each record, a nested one being
    one part; reaching it sets `truncated`.
    """
    ctx = C.Ctx(max_errors, C.Stages())
    return _staged(df, ctx, C.rows_record(contract, _columns(df, contract, keep), lambda n: F.col(f"`{n}`"), Place(), ctx), df.columns if keep is None else keep)


def decode_json_strict(df: DataFrame, column: str) -> DataFrame:
    """Adds `verdict` (code, line, col, position, key; code null for strict JSON) and the VARIANT `raw`."""
    return decoded(df, column)


def from_json(df: DataFrame, column: str, contract: Contract | Tagged, max_errors: int = 100, max_size: int | None = None, max_depth: int | None = None, keep: list[str] | None = None, max_nodes: int | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Strict JSON texts to records: adds value, errors, truncated and present (the fields that the text supplies).

    Texts that are not strict JSON have one error, json_invalid or
    json_duplicate, at the root; over `max_size` bytes, `max_depth` levels or
    `max_nodes` values that the contract visits they raise the budget's error
    when the action runs.  Keys in `ignored` may be there, and aren't read.
    """
    kept = df.columns if keep is None else keep
    text = F.col(column)
    refuse = lambda code, limit, seen: F.raise_error(F.concat(F.lit(f"{code} limit {limit} observed "), seen.cast("string")))
    if max_size is not None:
        df = df.withColumn(column, F.when(F.octet_length(text) > max_size, refuse("input_size", max_size, F.octet_length(text))).otherwise(text))
    if max_depth is not None:
        df = df.withColumn("_pf_depth", depth_over(text, max_depth)).withColumn(column, F.when(F.col("_pf_depth").isNotNull(), refuse("depth", max_depth, F.col("_pf_depth"))).otherwise(text)).drop("_pf_depth")
    df = decoded(df, column, "_pf_verdict", "_pf_raw")
    where = None
    if has_exact(contract):
        df, where = df.withColumn("_pf_tokens", kept_tokens(F.when(F.col("_pf_raw").isNotNull(), text))), (F.col("_pf_tokens"), F.lit(""))
    raw, code = F.col("_pf_raw"), F.col("_pf_verdict.code")
    if max_nodes is not None:
        df = df.withColumn("_pf_nodes", C.json_nodes(contract, raw)).withColumn("_pf_raw", F.when(F.col("_pf_nodes") > max_nodes, refuse("nodes", max_nodes, F.col("_pf_nodes")).cast("variant")).otherwise(raw)).drop("_pf_nodes")
    ctx = C.Ctx(max_errors, C.Stages())
    schema, level = ctx.stage(F.schema_of_variant(raw), 0)
    cell = C.Cell(raw, schema, level, where)
    members: dict = {}
    positional = isinstance(contract, Contract) and contract.shape == "positional"
    if positional:
        record = C.json_positional(contract, cell, Place(), ctx)
    else:
        keys, level = ctx.stage(F.when(code.isNull(), F.json_object_keys(text)), level)
        cell = C.Cell(raw, schema, level, where)
        record = C.json_tagged(contract, cell, Place(), ctx, keys) if isinstance(contract, Tagged) else C.json_record(contract, cell, Place(), ctx, keys, ignored, members)
    there = schema.startswith("ARRAY" if positional else "OBJECT")
    invalid = error("json_invalid", Place()).withField("context", F.create_map(F.lit("reason"), code))
    duplicate = error("json_duplicate", Place()).withField("context", F.create_map(F.lit("key"), F.col("_pf_verdict.key")))
    wrong = error("type", Place(), expected=contract.describe(), received=C.schema_kind(schema), value=C.shown_json(raw))
    errors = (F.when(code == "duplicate_key", F.array(duplicate)).when(code.isNotNull(), F.array(invalid)).when(~F.coalesce(there, F.lit(False)), F.array(wrong)).otherwise(record.errors))
    ok = F.coalesce(code.isNull() & there & record.ok, F.lit(False))
    present = F.array().cast("array<string>")
    if positional:
        present = F.slice(F.array(*[F.lit(f.name) for f in contract.fields]), F.lit(1), F.greatest(F.coalesce(F.size(F.try_variant_get(raw, "$", "array<variant>")), F.lit(0)), F.lit(0)))
    elif members:
        present = F.array_compact(F.array(*[F.when(C._any([members[n][1] for n in f.names]), F.lit(f.name)) for f in contract.fields]))
    truncated = None if record.truncated is None else there & record.truncated
    return _staged(df, ctx, C.Compiled(record.value, ok, errors, truncated, record.level), kept, more={"present": present})


def from_text(df: DataFrame, contract: Contract, max_errors: int = 100, keep: list[str] | None = None) -> DataFrame:
    """Records whose fields are texts, as CSV columns and settings have them: each is decoded by its kind.

    `null` is None where the type admits it; numbers, booleans, dates and the
    like have their strict forms; containers, records and unions are JSON
    texts.  A null column is an absent field.
    """
    kept = df.columns if keep is None else keep
    ctx = C.Ctx(max_errors, C.Stages())
    names = set(df.columns) - (set(kept) if keep is not None else set())
    own = [f for f in contract.fields for n in f.names if n in names]
    structured = [f for f in own if not _is_scalar(f.type)]
    for k, f in enumerate(structured):
        own_text = next(n for n in f.names if n in names)
        df = decoded(df, own_text, f"_pf_v{k}", f"_pf_r{k}")
        if has_exact(f.type):
            df = df.withColumn(f"_pf_t{k}", kept_tokens(F.when(F.col(f"_pf_r{k}").isNotNull(), F.col(own_text))))
    parts = []
    for f in contract.fields:
        at = C._at(f, Place())
        there = [F.col(f"`{n}`") for n in f.names if n in names]
        text = F.coalesce(*there) if there else F.lit(None).cast("string")
        missing = F.array(error("missing", at))
        if f in structured:
            k = structured.index(f)
            where = (F.col(f"_pf_t{k}"), F.lit("")) if has_exact(f.type) else None
            c = C.json_value(f.type, C.as_cell(F.col(f"_pf_r{k}"), ctx, where=where), at, ctx)
            bad = F.col(f"_pf_v{k}.code").isNotNull()
            c = C.Compiled(c.value, ~bad & c.ok, F.when(bad, F.array(error("json_invalid", at))).otherwise(c.errors), None if c.truncated is None else ~bad & c.truncated, c.level)
        else:
            c = _text_value(f.type, text, at, ctx)
        conflict = functools.reduce(lambda a, b: a + b, [t.isNotNull().cast("int") for t in there], F.lit(0)) > 1
        value = F.when(text.isNotNull(), c.value).otherwise(C._absent(f))
        sound = ~conflict & F.when(text.isNotNull(), c.ok).otherwise(F.lit(not f.required))
        clash = F.array(error("alias_conflict", at, names=F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), n) for n in f.names if n in names])))) if len(there) > 1 else no_errors()
        parts.append((f, C.Compiled(value, sound, C._chain([(conflict, clash), (text.isNull(), missing)], c.errors), c.truncated, c.level)))
    return _staged(df, ctx, C._record(contract, parts, [], [], None, Place(), ctx, 0), kept)


def _is_scalar(kind) -> bool:
    if isinstance(kind, M.Constrained):
        return _is_scalar(kind.base)
    if isinstance(kind, M.Union):
        return len(kind.options) == 2 and M.NONE in kind.options and all(map(_is_scalar, kind.options))
    return isinstance(kind, (M.Scalar, M.Literal))


def _text_value(kind, text: Column, place: Place, ctx: C.Ctx) -> C.Compiled:
    """A scalar from a text, by its kind."""
    if isinstance(kind, M.Union):
        inner = _text_value(next(o for o in kind.options if o != M.NONE), text, place, ctx)
        null = text == "null"
        return C.Compiled(F.when(~null, inner.value), null | inner.ok, inner.errors, None, inner.level)
    base = kind.base if isinstance(kind, M.Constrained) else kind
    if isinstance(base, M.Literal):
        known = scalars.text_literal(text, base.values)
        value = C._chain([(known == json.dumps(v), F.lit(v).cast(base.spark())) for v in base.values], F.lit(None).cast(base.spark()))
        return C.Compiled(value, known.isNotNull(), F.array(error("type" if isinstance(base, M.Enum) else "literal", place, expected=base.describe(), received="str", value=text)))
    own = {"int": scalars.text_int, "float": scalars.text_float, "bool": scalars.text_bool, "None": lambda t: F.lit(None).cast("void"), "Decimal": lambda t: scalars.json_decimal(t, base.precision, base.scale)}
    value, level = ctx.stage(C.text_number(base, text) if base.exact else own[base.kind](text) if base.kind in own else C.text_scalar(base, text), 0)
    inner = C.Compiled(value, text == "null" if base.kind == "None" else value.isNotNull(), C._type_error(base, place, "str", text), None, level)
    return C._bounded(kind, inner, place, base.describe(), ctx) if isinstance(kind, M.Constrained) else inner


def split(result: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): values of the good rows; keys, errors and truncated of the others, never their raw columns.

    Each reads `result` for itself: to check it only once, give what was written or read from a table.
    """
    return (result.where(F.col("value").isNotNull()).select(*keys, "value"), result.where(F.col("value").isNull()).select(*keys, "errors", "truncated"))


def split_written(result: DataFrame, keys: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """As `split`, by way of one table at `path` in a folder that driver and executors share: the result is checked once."""
    sound = F.col("value").isNotNull().alias("sound")
    result.select(*keys, "value", "errors", "truncated", sound).write.partitionBy("sound").parquet(path)
    done = result.sparkSession.read.schema(result.select(*keys, "value", "errors", "truncated", sound).schema).parquet(path)
    return (done.where("sound").select(*keys, "value"), done.where("not sound").select(*keys, "errors", "truncated"))


def located(errors: Column, index: Column) -> Column:
    """Errors with the record's index in front of each location."""
    return F.transform(errors, lambda e: e.withField("location", F.concat(F.array(index.cast("string")), e["location"])).withField(
        "path", F.concat(F.lit("["), index.cast("string"), F.lit("]"), F.when(F.size(e["location"]) == 0, "").when(e["path"].startswith("["), e["path"]).otherwise(F.concat(F.lit("."), e["path"])))))


def flat_errors(result: DataFrame, keys: list[str]) -> DataFrame:
    """One row per error: keys, position and the error's fields."""
    return result.select(*keys, F.posexplode("errors").alias("position", "error")).select(*keys, "position", "error.*")


def render(errors: Column, title: str, truncated: Column | None = None) -> Column:
    """A text of several lines, for logs."""
    n = F.size(errors)
    head = F.concat(F.lit(title), F.when(n != 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(" errors)"))).otherwise(F.lit("")),
                    F.when(truncated, F.lit(" [truncated]")).otherwise(F.lit("")) if truncated is not None else F.lit(""))
    one = lambda e: F.concat(F.lit("  "), e["path"], F.lit("\n    "), e["message"],
                             F.when(e["input"].isNotNull() & e["received"].isNotNull(), F.concat(F.lit("\n    received: "), e["input"], F.lit(" ("), e["received"], F.lit(")"))).otherwise(F.lit("")))
    return F.concat_ws("\n", head, F.transform(errors, one))


def error_report(result: DataFrame, by_hook: bool = False) -> DataFrame:
    """Failures by path and code, and by hook if asked for: errors, and the records that have them.

    What a record has of one kind is counted within its row, so that only
    partial sums are shuffled, as many as there are kinds.
    """
    kinds = ["path", "code", *(["hook"] if by_hook else [])]
    own = F.transform("errors", lambda e: F.struct(*[e[k].alias(k) for k in kinds]))
    each = F.transform(F.array_distinct("_own"), lambda d: F.struct(*[d[k].alias(k) for k in kinds], F.size(F.filter("_own", lambda e: e == d)).alias("n")))
    one = F.when(F.size("_own") == 1, F.transform("_own", lambda d: F.struct(*[d[k].alias(k) for k in kinds], F.lit(1).alias("n")))).otherwise(each)
    counted = result.where(F.col("value").isNull()).select(own.alias("_own")).select(F.explode(one).alias("e"))
    return counted.groupBy(*[F.col(f"e.{k}").alias(k) for k in kinds]).agg(F.sum("e.n").alias("errors"), F.count("*").alias("records"))


def _map_steps(kind, at: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Where a kind has maps: their places as steps of locations, outer ones first."""
    if isinstance(kind, M.Constrained):
        return _map_steps(kind.base, at)
    if isinstance(kind, M.Mapping):
        return [at, *_map_steps(kind.value, (*at, '"*"'))]
    if isinstance(kind, M.Many):
        return _map_steps(kind.item, (*at, "*"))
    if isinstance(kind, M.Fixed):
        return [x for i in kind.items for x in _map_steps(i, (*at, "*"))]
    if isinstance(kind, M.Union):
        return [x for o in kind.options for x in _map_steps(o, at)]
    if isinstance(kind, Tagged):
        return [x for _, c in kind.branches for x in _map_steps(c, at)]
    if isinstance(kind, Contract):
        return [x for f in kind.fields for n in f.names for x in _map_steps(f.type, (*at, json.dumps(n, ensure_ascii=False)))]
    return []


def location_pattern(location: Column, kind) -> Column:
    """A location without what the data decide: indexes are [*], keys of the kind's maps *; `items[*].by.*.x`.

    Sensitive names stay hidden, so keys below them do too.
    """
    steps = F.transform(location, lambda s: F.when(s.rlike(r"^\d+$"), "*").otherwise(s))
    text = F.array_join(F.concat(F.array(F.lit("")), steps), "\x1f")
    for at in sorted(dict.fromkeys(_map_steps(kind)), key=len):
        place = "".join(f"\x1f{re.escape(x)}" for x in at)
        text = F.regexp_replace(text, f'^({place})\x1f"[^\x1f]*"(?=\x1f|$)', '$1\x1f"*"')
    shown = F.transform(F.split(F.substr(text, F.lit(2)), "\x1f"), lambda s, i: F.when(s == "*", "[*]").when(i == 0, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(F.concat(F.lit("."), F.substr(s, F.lit(2), F.length(s) - 2))))
    return F.when(F.size(location) == 0, "<root>").otherwise(F.array_join(shown, ""))


def error_patterns(result: DataFrame, kind) -> DataFrame:
    """Failures by pattern of location and code: errors, and the records that have them.

    Groups are as many as the contract has places, however long lists are and
    whatever keys maps have, so a task sends no more than that.
    """
    own = F.transform("errors", lambda e: F.struct(location_pattern(e["location"], kind).alias("pattern"), e["code"].alias("code")))
    each = F.transform(F.array_distinct("_own"), lambda d: F.struct(d["pattern"].alias("pattern"), d["code"].alias("code"), F.size(F.filter("_own", lambda e: e == d)).alias("n")))
    counted = result.where(F.col("value").isNull()).select(own.alias("_own")).select(F.explode(each).alias("e"))
    return counted.groupBy("e.pattern", "e.code").agg(F.sum("e.n").alias("errors"), F.count("*").alias("records"))


def error_totals(result: DataFrame) -> DataFrame:
    """Failures by code and path with subtotals by code and in all."""
    flat = result.select(F.explode(F.transform("errors", lambda e: F.struct(e["path"].alias("path"), e["code"].alias("code")))).alias("e")).select("e.*")
    return flat.rollup("code", "path").agg(F.count("*").alias("errors"))


def error_tree(flat: DataFrame, keys: list[str]) -> DataFrame:
    """Errors grouped by location, ancestors included: keys, node, depth, own (codes there, in order) and below (errors at or under it)."""
    levels = F.transform(F.sequence(F.lit(0), F.size("location")), lambda k: F.struct(k.alias("depth"), F.concat_ws("/", F.slice("location", 1, k)).alias("node")))
    spread = flat.select(*keys, "position", "code", F.size("location").alias("_size"), F.explode(levels).alias("l"))
    own = F.when(F.col("_size") == F.col("l.depth"), F.struct("position", "code"))
    return (spread.groupBy(*keys, F.col("l.node").alias("node"), F.col("l.depth").alias("depth")).agg(F.sort_array(F.collect_list(own)).alias("_own"), F.count("*").alias("below"))
            .select(*keys, "node", "depth", F.transform("_own", lambda s: s["code"]).alias("own"), "below"))
