"""Contracts to columns: for each value what it is, whether it is sound, and, evaluated only where it isn't, its errors.

`rows` mode reads typed columns and structs; `json` mode reads VARIANT, where
an absent key is null and a JSON null is not.

What several expressions read becomes a column of its own first, in levels of
selects (`Stages`): members, converted values, one boolean a field.  So a sound
row costs its conversions and comparisons once, and error structs are built
only on rows that have some.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.contract import model as M
from pactframe.contract.errors import ERRORS, Place, error, no_errors, safe_text
from pactframe.functions import scalars
from pactframe.functions.decode import pointer_part

_ACCEPTED = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.DoubleType, T.FloatType), "str": (T.StringType,), "bool": (T.BooleanType,), "bytes": (T.BinaryType,),
    "None": (T.NullType,), "Decimal": (T.DecimalType,), "date": (T.DateType,), "datetime": (T.TimestampType, T.TimestampNTZType), "timedelta": (T.DayTimeIntervalType,),
}
_CODES = {"gt": "greater_than", "ge": "greater_than_or_equal", "lt": "less_than", "le": "less_than_or_equal", "multiple_of": "multiple_of", "min_length": "min_length", "max_length": "max_length", "pattern": "pattern"}
_CONTEXT = {"multiple_of": "multiple_of", "min_length": "minimum", "max_length": "maximum", "pattern": "pattern"}
#: Kinds of texts that strict validation takes in canonical form only.
_CANONICAL = {"UUID", "time", "Path", *scalars.IP_KINDS}


class Stages:
    """Columns that later expressions read by name, level by level."""

    def __init__(self):
        self.levels: dict[int, list[Column]] = {}
        self.made = 0

    def add(self, column: Column, level: int) -> Column:
        name = f"_pf_{self.made}"
        self.made += 1
        self.levels.setdefault(level, []).append(column.alias(name))
        return F.col(name)

    def applied(self, df: DataFrame) -> DataFrame:
        for level in sorted(self.levels):
            df = df.select("*", *self.levels[level])
        return df


@dataclass(frozen=True)
class Ctx:
    """How to compile: the budget of errors of each record, and the stages, of which lambdas have none."""

    max_errors: int = 100
    stages: Stages | None = None

    def stage(self, column: Column, level: int) -> tuple[Column, int]:
        return (column, level) if self.stages is None else (self.stages.add(column, level), level + 1)

    def inner(self) -> Ctx:
        return replace(self, stages=None)


@dataclass
class Compiled:
    """`value` where `ok`, `errors` elsewhere; `truncated`: whether a record in it stopped at the budget (None: never); `level`: the stages that these read are below it."""

    value: Column
    ok: Column
    errors: Column
    truncated: Column | None = None
    level: int = 0
    values: list = field(default_factory=list)
    packed: Column | None = None


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once; what stages are to a row, this is inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _pack(c: Compiled) -> Column:
    """A result as one struct; its errors are null where it is sound."""
    if c.packed is not None:
        return c.packed
    return F.struct(c.ok.alias("ok"), c.value.alias("value"), F.when(~c.ok, c.errors).alias("errors"), (F.lit(False) if c.truncated is None else ~c.ok & F.coalesce(c.truncated, F.lit(False))).alias("cut"))


def _unpack(p: Column, ctx: Ctx, level: int, packed: bool = True) -> Compiled:
    """The result that a struct holds, computed once: staged, or kept whole for the lambda around it to bind."""
    p, level = ctx.stage(p, level)
    return Compiled(p["value"], p["ok"], p["errors"], p["cut"], level, packed=p if packed and ctx.stages is None else None)


def _bound(c: Compiled, ctx: Ctx, then) -> Compiled:
    """`then` of a result; inside lambdas one that is a struct is bound first, so that it isn't written out again at each use."""
    if c.packed is None:
        return then(c)
    return _unpack(_let(c.packed, lambda p: _pack(then(_unpack(p, ctx, 0, False)))), ctx, c.level)


@dataclass
class Cell:
    """A VARIANT and the text of its schema; `where` are (numbers as written by JSON pointer, its pointer) if these are kept."""

    v: Column
    s: Column
    level: int = 0
    where: tuple[Column, Column] | None = None

    def below(self, part: Column | str) -> tuple[Column, Column] | None:
        """`where` of a member or an item."""
        if self.where is None:
            return None
        part = F.lit(pointer_part(part)) if isinstance(part, str) else F.replace(F.replace(part.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        return self.where[0], F.concat(self.where[1], F.lit("/"), part)


def python_kind(dtype: T.DataType) -> str:
    for kind, types in _ACCEPTED.items():
        if isinstance(dtype, types):
            return kind
    return {T.ArrayType: "list", T.MapType: "dict", T.StructType: "dict"}.get(type(dtype), dtype.simpleString())


#: First letters of a VARIANT's schema, and the kind as contracts name it.
_VARIANT_KINDS = (("BIGINT", "int"), ("STRING", "str"), ("OBJECT", "dict"), ("ARRAY", "list"), ("BOOLEAN", "bool"), ("VOID", "NoneType"), ("D", "float"), ("FLOAT", "float"))


def schema_kind(s: Column) -> Column:
    """The kind that a VARIANT's schema means, as a contract names it; null if it is absent."""
    out = None
    for lead, kind in _VARIANT_KINDS:
        out = F.when(s.startswith(lead), kind) if out is None else out.when(s.startswith(lead), kind)
    return out


def variant_kind(v: Column) -> Column:
    return schema_kind(F.schema_of_variant(v))


def as_cell(v: Column, ctx: Ctx, level: int = 0, where: tuple[Column, Column] | None = None) -> Cell:
    v, level = ctx.stage(v, level)
    s, level = ctx.stage(F.schema_of_variant(v), level)
    return Cell(v, s, level, where)


def shown_json(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True)) if not conditions else functools.reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def _chain(pairs: list[tuple[Column, Column]], last: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = no_errors() if last is None else last
    return last if out is None else out.otherwise(last)


def bound_holds(bound: M.Bound, kind: object, v: Column) -> Column:
    """Whether a typed value keeps to a bound; NaN keeps to none."""
    base = kind.kind if isinstance(kind, M.Scalar) else "container"
    if bound.rule in ("gt", "ge", "lt", "le"):
        if base != "container" and kind.exact:
            return {"gt": scalars.exact_over(v, bound.limit), "ge": ~scalars.exact_under(v, bound.limit), "lt": scalars.exact_under(v, bound.limit), "le": ~scalars.exact_over(v, bound.limit)}[bound.rule]
        limit = F.lit(bound.limit)
        held = {"gt": v > limit, "ge": v >= limit, "lt": v < limit, "le": v <= limit}[bound.rule]
        return held & ~F.isnan(v) if base == "float" else held
    if bound.rule == "multiple_of":
        step = abs(bound.limit)
        if base == "float":
            rest = F.abs(v) % F.lit(float(step))
            finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
            return finite & (F.least(rest, F.lit(float(step)) - rest) <= float(step) * 1e-12)
        return v % F.lit(step) == 0
    if bound.rule == "pattern":
        flags = "".join({"i": "iu", "m": "m", "s": "s", "x": "x"}[f] for f in bound.flags)
        return v.rlike(f"(?{flags}){bound.limit}" if flags else bound.limit)
    size = F.char_length(v) if base == "str" else F.octet_length(v) if base == "bytes" else F.size(v)
    return size >= bound.limit if bound.rule == "min_length" else size <= bound.limit


def bound_tests(kind: M.Constrained, v: Column, place: Place, received: str, raw: tuple[Column, Column, Column] | None = None) -> list[tuple[Column, Column]]:
    """(holds, errors) of each bound, in the fixed order; of a container that may hold unsound items, `raw` is (whether it is sound, it as it was given, its text)."""
    shown = F.to_json(v) if isinstance(kind.base, (M.Many, M.Mapping)) else v
    holds = lambda b: bound_holds(b, kind.base, v)
    if raw is not None:
        shown, holds = raw[2], lambda b: F.when(raw[0], bound_holds(b, kind.base, v)).otherwise(bound_holds(b, kind.base, raw[1]))
    return [(F.coalesce(holds(b), F.lit(False)), F.array(error(_CODES[b.rule], place, expected=f"{kind.base.describe()} satisfying {b.label()}", received=received, value=shown, context={_CONTEXT.get(b.rule, "limit"): b.limit})))
            for b in kind.ordered()]


def _bounded(kind: M.Constrained, inner: Compiled, place: Place, received: str, ctx: Ctx, shape: Column | None = None, given: tuple[Column, Column] | None = None) -> Compiled:
    """`inner` with the bounds of `kind`; lengths come before items, so that a container's `shape` decides when they are tested."""
    tests = bound_tests(kind, inner.value, place, received, None if given is None else (inner.ok, *given))
    held = [(h, e) for h, e in tests]
    ok = _all([inner.ok, *[h for h, _ in held]])
    failed = [(~h, e) for h, e in held]
    if shape is None:
        errors = _chain([(~inner.ok, inner.errors), *failed])
    else:
        errors = _chain([(~shape, inner.errors), *failed], inner.errors)
    truncated = None if inner.truncated is None else inner.truncated & _all([h for h, _ in held])
    return Compiled(inner.value, ok, errors, truncated, inner.level)


def _type_error(kind, place: Place, received, shown: Column) -> Column:
    return F.array(error("type", place, expected=kind.describe(), received=received, value=shown))


def _first_failing(items: Column, compiled) -> tuple[Column, Column | None]:
    """Errors, and whether they are truncated, of the first item (by item and place) that isn't sound."""
    probe = compiled(F.lit(None), F.lit(0))
    if probe.truncated is None:
        found = F.transform(items, lambda x, i: (lambda c: F.when(~c.ok, c.errors))(compiled(x, i)))
        return F.coalesce(F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0)), no_errors()), None
    found = F.transform(items, lambda x, i: (lambda c: F.when(~c.ok, F.struct(c.errors.alias("e"), F.coalesce(c.truncated, F.lit(False)).alias("t"))))(compiled(x, i)))
    first = F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))
    return F.coalesce(first["e"], no_errors()), F.coalesce(first["t"], F.lit(False))


# Typed columns and structs.

def rows(kind, raw: Column, dtype: T.DataType, place: Place, ctx: Ctx = Ctx(), level: int = 0) -> Compiled:
    """A value of a typed column; null stands for None."""
    if isinstance(kind, M.Constrained):
        inner = rows(kind.base, raw, dtype, place, ctx, level)
        container = isinstance(kind.base, (M.Many, M.Mapping))
        return _bounded(kind, inner, place, python_kind(dtype), ctx, raw.isNotNull() & F.lit(isinstance(dtype, (T.ArrayType, T.MapType))) if container else None)
    if isinstance(kind, M.Union):
        return _rows_union(kind, raw, dtype, place, ctx, level)
    shown = raw if not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(raw)
    none = _type_error(kind, place, "NoneType", F.lit("None"))
    if isinstance(kind, M.Deep):
        return Compiled(F.lit(None).cast(kind.spark()), F.lit(False), F.array(error("depth", place, context={"limit": kind.limit})), None, level)
    wrong = Compiled(F.lit(None).cast(kind.spark()), F.lit(False), F.when(raw.isNull(), none).otherwise(_type_error(kind, place, python_kind(dtype), shown)), None, level)
    if isinstance(kind, M.Literal):
        base = kind.base()
        if not isinstance(dtype, _ACCEPTED[base.kind]):
            return wrong
        bad = error("literal", place, expected=kind.describe(), received=python_kind(dtype), value=raw)
        absent = none if isinstance(kind, M.Enum) else F.array(error("literal", place, expected=kind.describe(), received="NoneType", value=F.lit("None")))
        return Compiled(raw.cast(base.spark()), F.coalesce(raw.isin(*kind.values), F.lit(False)), F.when(raw.isNull(), absent).otherwise(F.array(bad)), None, level)
    if isinstance(kind, M.Scalar):
        if not isinstance(dtype, _ACCEPTED.get(kind.kind, (T.StringType,))):
            return wrong
        good = raw.isNotNull()
        if kind.kind in _CANONICAL:
            good = F.coalesce(text_scalar(kind, raw) == raw, F.lit(False))
        value = text_number(kind, raw.cast("string")) if kind.exact else raw.cast(kind.spark())
        return Compiled(value, good, F.when(raw.isNull(), none).otherwise(_type_error(kind, place, python_kind(dtype), shown)), None, level)
    deep = ctx.inner()
    if isinstance(kind, M.Many) and isinstance(dtype, T.ArrayType):
        item = lambda x, at: rows(kind.item, x, dtype.elementType, at, deep)
        value = F.transform(raw, lambda x: item(x, place).value)
        errors, truncated = _first_failing(raw, lambda x, i: item(x, place.index(i)))
        ok = F.coalesce(F.forall(raw, lambda x: item(x, place).ok), F.lit(False))
        return Compiled(F.array_distinct(value) if kind.kind in ("set", "frozenset") else value, ok, F.when(raw.isNull(), none).otherwise(errors), truncated, level)
    if isinstance(kind, M.Mapping) and isinstance(dtype, T.MapType):
        entries = F.map_entries(raw)
        entry = lambda e: _entry(rows(kind.key, e["key"], dtype.keyType, place.key(e["key"]), deep), rows(kind.value, e["value"], dtype.valueType, place.key(e["key"]), deep))
        ok = F.coalesce(F.forall(entries, lambda e: entry(e).ok), F.lit(False))
        errors, truncated = _first_failing(entries, lambda e, i: entry(e))
        return Compiled(raw, ok, F.when(raw.isNull(), none).otherwise(errors), truncated, level)
    if isinstance(kind, M.Fixed) and isinstance(dtype, (T.ArrayType, T.StructType)):
        if isinstance(dtype, T.ArrayType):
            sized = F.coalesce(F.size(raw) == len(kind.items), F.lit(False))
            cells = [(F.get(raw, F.lit(k)), dtype.elementType) for k in range(len(kind.items))]
        else:
            sized = raw.isNotNull() & F.lit(len(dtype) == len(kind.items))
            cells = [(raw[f.name], f.dataType) for f in dtype][:len(kind.items)]
        items = [rows(t, v, d, place.index(F.lit(k)), ctx, level) for k, (t, (v, d)) in enumerate(zip(kind.items, cells, strict=False))]
        return _fixed(kind, items, sized, F.when(raw.isNull(), none).otherwise(_type_error(kind, place, "tuple", shown)), level)
    if isinstance(kind, M.Contract) and isinstance(dtype, T.StructType):
        inner = rows_record(kind, dtype, lambda n: raw[n], place, ctx, level)
        return Compiled(inner.value, raw.isNotNull() & inner.ok, F.when(raw.isNull(), none).otherwise(inner.errors), inner.truncated, inner.level)
    return wrong


def _entry(key: Compiled, value: Compiled) -> Compiled:
    """A map's entry: the key, then the value."""
    return Compiled(value.value, key.ok & value.ok, F.when(~key.ok, key.errors).otherwise(value.errors), None if value.truncated is None else key.ok & value.truncated)


def _fixed(kind: M.Fixed, items: list[Compiled], sized: Column, wrong: Column, level: int) -> Compiled:
    """A tuple: its first item that isn't sound."""
    errors = _chain([(~sized, wrong), *[(~i.ok, i.errors) for i in items]])
    cut = [i for i in items if i.truncated is not None]
    truncated = _chain([(~sized, F.lit(False)), *[(~i.ok, F.lit(False) if i.truncated is None else i.truncated) for i in items]], F.lit(False)) if cut else None
    return Compiled(F.struct(*[i.value.alias(f"_{k}") for k, i in enumerate(items)]), _all([sized, *[i.ok for i in items]]), errors, truncated, max([level, *[i.level for i in items]]))


def _rows_union(kind: M.Union, raw: Column, dtype: T.DataType, place: Place, ctx: Ctx, level: int) -> Compiled:
    nullable = M.NONE in kind.options
    real = [o for o in kind.ordered() if o != M.NONE]
    if len(real) == 1:
        inner = rows(real[0], raw, dtype, place, ctx, level)
        return Compiled(inner.value, raw.isNull() | inner.ok if nullable else inner.ok, inner.errors, inner.truncated, inner.level)
    tries = [(o, rows(o, raw, dtype, place, ctx, level)) for o in real]
    return _pick(kind, tries, place, F.when(raw.isNull(), "NoneType").otherwise(python_kind(dtype)), raw, raw.isNull() & F.lit(nullable), ctx)


def _pick(kind: M.Union, tries: list, place: Place, received: Column, shown: Column, empty: Column, ctx: Ctx) -> Compiled:
    """The first option without errors; else an outer error with one list per option."""
    level = max(c.level for _, c in tries)
    staged = [ctx.stage(c.ok, c.level) for _, c in tries]
    ok, level = [o for o, _ in staged], max([level, *[n for _, n in staged]])
    branch = F.coalesce(*[F.when(o, k.describe()) for o, (k, _) in zip(ok, tries, strict=True)])
    value = F.struct(branch.alias("branch"), *[F.when(branch == o.describe(), c.value).alias(f"o{k}") for k, o in enumerate(kind.ordered()) for t, c in tries if t is o])
    lists = F.array(*[F.struct(F.lit(k.describe()).alias("label"), F.to_json(F.transform(c.errors, lambda e: F.struct(e["code"].alias("code"), e["path"].alias("path")))).alias("errors_json")) for k, c in tries])
    err = error("union", place, expected=kind.describe(), received=received, value=shown.cast("string"), branches=lists)
    return Compiled(value, _any(ok) | empty, F.array(err), None, level)


def rows_record(contract: M.Contract, schema: T.StructType, get, place: Place, ctx: Ctx = Ctx(), level: int = 0) -> Compiled:
    """A record of typed columns: a column that is not there is an absent key, one that is not declared is unexpected."""
    names = set(schema.names)
    parts, later = [], []
    for f in contract.fields:
        at = _at(f, place)
        there = [n for n in f.names if n in names]
        if len(there) > 1:
            parts.append((f, Compiled(F.lit(None).cast(f.type.spark()), F.lit(False), F.array(error("alias_conflict", at, names=F.array(*[F.lit(n) for n in there[:2]]))))))
        elif there:
            parts.append((f, with_hooks(f, get(there[0]), lambda t, raw, lv, n=there[0], at=at: rows(t, raw, schema[n].dataType, at, ctx, lv), at, ctx, level)))
        elif f.factory is not None:
            later.append((f, F.lit(True), None))
            parts.append((f, None))
        else:
            parts.append((f, Compiled(_absent(f), F.lit(not f.required), F.array(error("missing", at)))))
    known = {n for f in contract.fields for n in f.names}
    extra = [error("unexpected", place.field(n)) for n in schema.names if n not in known]
    return _record(contract, parts, later, extra, None, place, ctx, level)


def _at(f: M.Field, place: Place) -> Place:
    at = place.field(f.external)
    return at.sensitive() if f.sensitive else at


def _absent(f: M.Field) -> Column:
    return F.lit(None if f.default is M.MISSING else f.default).cast(f.type.spark())


def _nullable(kind) -> bool:
    return isinstance(kind, M.Union) and M.NONE in kind.options or kind == M.NONE


def _called(hook: M.Hook, value: Column, wanted: Column, ctx: Ctx, level: int) -> tuple[Column, int]:
    """What a hook says of a value, on rows where it is still wanted."""
    if ctx.stages is None:
        raise ValueError("a hook of its own runs on rows, not inside lists or maps: see operators.levels")
    return ctx.stage(hook.call(value, F.coalesce(wanted, F.lit(False))), level)


def with_hooks(f: M.Field, raw: Column | Cell, convert, place: Place, ctx: Ctx, level: int) -> Compiled:
    """Representation, transforms, type and bounds, then checks: each only where all before it passed.

    `convert` (kind, raw, level) reads the raw value.  Transforms of a JSON
    value take those of the field's raw kind; others go on as they are.
    """
    shown = shown_json(raw.v) if isinstance(raw, Cell) else raw.cast("string")
    early: list[tuple[Column, Column]] = []
    kind = f.type
    if f.load is not None:
        external, loader = f.load
        before = convert(external, raw, level)
        level = before.level
        loaded, level = ctx.stage(loader(before.value), level)
        early = [(~before.ok, before.errors), (loaded.isNull(), F.array(error("representation_load", place, value=shown)))]
        base = kind.base if isinstance(kind, M.Constrained) else kind
        held = _all([h for h, _ in bound_tests(kind, loaded, place, base.describe())]) if isinstance(kind, M.Constrained) else F.lit(True)
        inner = Compiled(loaded.cast(base.spark()), held, F.array(error("representation_result", place, expected=kind.describe(), value=loaded.cast("string"))), None, level)
    elif f.transforms:
        given = raw
        if isinstance(raw, Cell):
            other = convert(kind, raw, level)
            given, level = ctx.stage(json_scalar(f.raw, raw), raw.level)
            level = max(level, other.level)
            fits = given.isNotNull()
        start = given
        for name, fn in f.transforms:
            if isinstance(fn, M.Hook):
                sound = [~c for c, _ in early] + ([fits] if isinstance(raw, Cell) else [])
                told, level = _called(fn, given, _all(sound), ctx, level)
                new, failed = told["value"], F.coalesce(told["failed"], F.lit(False))
            else:
                new, level = ctx.stage(fn(given), level)
                failed = given.isNotNull() & new.isNull()
            early.append((failed, F.array(error("transform", place, hook=name, stage="transform", value=given.cast("string")))))
            given = new
        inner = rows(kind, given, kind.spark(), place, ctx, level)
        if isinstance(raw, Cell):
            early = [(start.isNotNull() & c, e) for c, e in early]
            inner = Compiled(F.when(fits, inner.value).otherwise(other.value), F.when(fits, inner.ok).otherwise(other.ok), F.when(fits, inner.errors).otherwise(other.errors), other.truncated, max(inner.level, other.level))
    else:
        inner = convert(kind, raw, level)
    level = inner.level
    ok = _all([*[~c for c, _ in early], inner.ok])
    errors = _chain(early, inner.errors) if early else inner.errors
    if not f.checks:
        return Compiled(inner.value, ok, errors, inner.truncated, level)
    ok, level = ctx.stage(ok, level)
    failed = [(~ok, errors)]
    sound = [ok]
    for name, test in f.checks:
        if isinstance(test, M.Hook):
            told, level = _called(test, inner.value, _all(sound), ctx, level)
            passed = ~F.coalesce(told["failed"], F.lit(False))
        else:
            passed = F.coalesce(test(inner.value), F.lit(False))
        failed.append((~passed, F.array(error("field_check", place, hook=name, stage="field_check", value=inner.value.cast("string")))))
        sound.append(passed)
    return Compiled(inner.value, _all(sound), _chain(failed), None if inner.truncated is None else ~ok & inner.truncated, level)


def _entries(parts: list[Compiled], extra: list[Column], unknown: Column | None) -> Column:
    """What isn't sound in a record, in order: a list of (e: its errors, t: whether they end the record)."""
    entry = lambda c: F.struct(c.errors.alias("e"), (F.lit(False) if c.truncated is None else F.coalesce(c.truncated, F.lit(False))).alias("t"))
    out = F.array_compact(F.array(*[F.when(~c.ok, entry(c)) for c in parts], *[F.struct(F.array(e).alias("e"), F.lit(False).alias("t")) for e in extra])) if parts or extra else F.array().cast(f"array<struct<e:{ERRORS},t:boolean>>")
    return out if unknown is None else F.concat(out, F.transform(unknown, lambda e: F.struct(F.array(e).alias("e"), F.lit(False).alias("t"))))


def _budgeted(parts: list[Compiled], extra: list[Column], unknown: Column | None, limit: int) -> tuple[Column, bool]:
    """Errors of a record's parts, or, if they may stop early (then the second is true), a struct of them and of whether they do (errors, cut).

    Each part counts once, however many errors it has; a part that stopped
    early ends the record with its own errors; reaching the limit counts as
    stopping.
    """
    if unknown is None and len(parts) + len(extra) < limit and all(c.truncated is None for c in parts):
        return F.flatten(F.array(*[F.when(~c.ok, c.errors).otherwise(no_errors()) for c in parts], *([F.array(*extra)] if extra else []))), False
    def ended(found: Column) -> Column:
        cut = F.get(F.filter(found["l"], lambda y: y["t"]), F.lit(0))
        return F.struct(F.when(cut.isNotNull(), cut["e"]).otherwise(F.flatten(F.transform(found["l"], lambda y: y["e"]))).alias("errors"), (cut.isNotNull() | found["full"]).alias("cut"))

    return _let(_let(_entries(parts, extra, unknown), lambda all_: F.struct(F.slice(all_, 1, limit).alias("l"), (F.size(all_) >= limit).alias("full"))), ended), True


def _record(contract: M.Contract, parts: list[tuple[M.Field, Compiled | None]], later: list, extra: list[Column], unknown: tuple[Column, Column] | None, place: Place, ctx: Ctx, level: int) -> Compiled:
    """Fields, unexpected keys, then factories, then checks.

    `later` are (field, whether it is absent, what is there else) of fields
    with a factory; `unknown` is (whether there are no unexpected keys, their errors).
    """
    staged: list[Compiled] = []
    values: dict[str, Column] = {}
    for f, c in parts:
        if c is not None:
            ok, n = ctx.stage(c.ok, c.level)
            level = max(level, n)
            staged.append(replace(c, ok=ok))
            values[f.name] = c.value
    ok = _all([*[c.ok for c in staged], *([F.lit(False)] if extra else []), *([unknown[0]] if unknown else [])])
    if contract.shape == "typed_dict":
        first = _chain([(~c.ok, c.errors) for c in staged], F.array(extra[0]) if extra else None if unknown is None else F.slice(unknown[1], 1, 1))
        cut = [(~c.ok, F.lit(False) if c.truncated is None else F.coalesce(c.truncated, F.lit(False))) for c in staged]
        errors, truncated = first, _chain(cut, F.lit(False)) if any(c.truncated is not None for c in staged) else None
    else:
        found, counted = _budgeted(staged, extra, None if unknown is None else unknown[1], ctx.max_errors)
        if counted and ctx.stages is None and not later and not contract.checks:
            values_ = F.struct(*[values[f.name].alias(f.name) for f in contract.fields])
            return _unpack(_let(F.struct(ok.alias("ok"), F.when(~ok, found).alias("found")), lambda p: F.struct(p["ok"].alias("ok"), values_.alias("value"), p["found"]["errors"].alias("errors"), F.coalesce(p["found"]["cut"], F.lit(False)).alias("cut"))), ctx, level)
        errors, truncated = found, None
        if counted:
            found, level = ctx.stage(F.when(~ok, found), level)
            errors, truncated = found["errors"], F.coalesce(found["cut"], F.lit(False))
    if later:
        fields_ok, level = ctx.stage(ok, level)
        made: list[Compiled] = []
        for f, absent, held in later:
            at = _at(f, place)
            new, n = ctx.stage(F.when(absent & fields_ok, f.factory().cast(f.type.spark())), level)
            c = with_hooks(f, new, lambda t, raw, lv, at=at: rows(t, raw, t.spark(), at, ctx, lv), at, ctx, n)
            none = F.lit(False) if _nullable(f.type) else new.isNull()
            own = F.when(absent & fields_ok, ~none & c.ok).otherwise(F.lit(True))
            own, n = ctx.stage(own, c.level)
            level = max(level, n)
            made.append(Compiled(c.value, own, F.when(none, F.array(error("factory", at, context={"field": f.external}))).otherwise(c.errors), c.truncated, n))
            values[f.name] = c.value if held is None else F.when(absent, c.value).otherwise(held)
        late, counted = _budgeted(made, [], None, ctx.max_errors)
        stopped = late["cut"] if counted else None
        late = late["errors"] if counted else late
        ok = _all([fields_ok, *[c.ok for c in made]])
        errors = F.when(~fields_ok, errors).otherwise(late)
        if truncated is not None or stopped is not None:
            truncated = F.when(~fields_ok, F.lit(False) if truncated is None else truncated).otherwise(F.lit(False) if stopped is None else stopped)
    value = F.struct(*[values[f.name].alias(f.name) for f in contract.fields])
    if contract.checks:
        fields_ok, level = ctx.stage(ok, level)
        failed, sound = [(~fields_ok, errors)], [fields_ok]
        for check in contract.checks:
            hidden = any(contract[n].sensitive for n in check.fields)
            bad = error("spec_check", place.sensitive() if hidden else place, hook=check.name, stage="spec_check", related=[place.field(contract[n].external) for n in check.fields])
            passed = F.coalesce(check.test(*[values[n] for n in check.fields]), F.lit(False))
            failed.append((~passed, F.array(bad)))
            sound.append(passed)
        ok, errors = _all(sound), _chain(failed)
        truncated = None if truncated is None else ~fields_ok & truncated
    return Compiled(value, ok, errors, truncated, level, [(c.ok, c.errors) for c in staged])


# JSON values.

def json_scalar(kind: M.Scalar, cell: Cell | Column) -> Column:
    """The typed value of a VARIANT, null where it is not of the kind or does not convert."""
    v, s = (cell.v, cell.s) if isinstance(cell, Cell) else (cell, F.schema_of_variant(cell))
    if kind.exact:
        # A double has lost digits, so only its token counts.
        lost = s.startswith("DOUBLE") | s.startswith("FLOAT")
        token = F.when(~lost, shown_json(v))
        if isinstance(cell, Cell) and cell.where is not None:
            token = F.coalesce(F.try_element_at(*cell.where), token)
        number = (s == "BIGINT") | s.startswith("D") | s.startswith("FLOAT")
        return F.when(number, _let(token, scalars.whole_text)) if kind.kind == "int" else F.when(number | (s == "STRING"), scalars.exact_text(token))
    if kind.kind == "int":
        return F.when(s == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    if kind.kind == "float":
        d = F.try_variant_get(v, "$", "double")
        return F.when(((s == "BIGINT") | s.startswith("D")) & ~F.isnan(d) & (F.abs(d) < float("inf")), d)
    if kind.kind == "bool":
        return F.when(s == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    if kind.kind == "None":
        return F.lit(None).cast("void")
    if kind.kind == "Decimal":
        return F.when((s == "BIGINT") | s.startswith("D") | (s == "STRING"), scalars.json_decimal(shown_json(v), kind.precision, kind.scale))
    return F.when(s == "STRING", text_scalar(kind, shown_json(v)))


def text_number(kind: M.Scalar, text: Column) -> Column:
    """The value of an exact kind, null where the text isn't one."""
    return scalars.whole_text(text) if kind.kind == "int" else scalars.exact_text(text)


def text_scalar(kind: M.Scalar, text: Column) -> Column:
    """The value of a kind that JSON writes as text, null where the text does not convert."""
    if kind.kind in scalars.IP_KINDS:
        return scalars.canonical_ip(kind.kind)(text)
    return {
        "str": lambda t: t, "bytes": scalars.strict_base64, "date": scalars.iso_date, "datetime": lambda t: scalars.iso_datetime(t, kind.aware), "time": scalars.iso_time,
        "timedelta": scalars.iso_duration, "UUID": scalars.canonical_uuid, "Path": scalars.path_text,
    }[kind.kind](text)


def json_value(kind, cell: Cell | Column, place: Place, ctx: Ctx = Ctx()) -> Compiled:
    """A value of a VARIANT; a JSON null is None."""
    if not isinstance(cell, Cell):
        cell = as_cell(cell, ctx)
    v, s, level = cell.v, cell.s, cell.level
    if isinstance(kind, M.Constrained):
        inner = json_value(kind.base, cell, place, ctx)
        received = "list" if isinstance(kind.base, M.Many) else "dict" if isinstance(kind.base, M.Mapping) else kind.base.describe()
        shape = s.startswith("ARRAY" if isinstance(kind.base, M.Many) else "OBJECT") if isinstance(kind.base, (M.Many, M.Mapping)) else None
        given = None if shape is None else (F.try_variant_get(v, "$", "array<variant>" if isinstance(kind.base, M.Many) else "map<string,variant>"), shown_json(v))
        return _bound(inner, ctx, lambda c: _bounded(kind, c, place, received, ctx, shape, given))
    if isinstance(kind, M.Union):
        real = [o for o in kind.ordered() if o != M.NONE]
        null = (s == "VOID") & F.lit(M.NONE in kind.options)
        if len(real) == 1:
            return _bound(json_value(real[0], cell, place, ctx), ctx, lambda c: Compiled(c.value, null | c.ok, c.errors, c.truncated, c.level))
        return _pick(kind, [(o, json_value(o, cell, place, ctx)) for o in real], place, schema_kind(s), shown_json(v), null, ctx)
    if isinstance(kind, M.Deep):
        return Compiled(F.lit(None).cast(kind.spark()), F.lit(False), F.array(error("depth", place, context={"limit": kind.limit})), None, level)
    if isinstance(kind, M.Ref):
        return Compiled(v, F.lit(True), no_errors(), None, level)
    wrong = _type_error(kind, place, schema_kind(s), shown_json(v))
    if isinstance(kind, M.Literal):
        value, level = ctx.stage(json_scalar(kind.base(), cell), level)
        code = "type" if isinstance(kind, M.Enum) else "literal"
        return Compiled(value, F.coalesce(value.isin(*kind.values), F.lit(False)), F.array(error(code, place, expected=kind.describe(), received=schema_kind(s), value=shown_json(v))), None, level)
    if isinstance(kind, M.Scalar):
        value, level = ctx.stage(json_scalar(kind, cell), level)
        errors = wrong
        if kind.kind == "Decimal":
            endless = (s == "STRING") & scalars.non_finite_decimal(shown_json(v))
            errors = F.when(endless, F.array(error("json_invalid", place, context={"reason": "non_finite_number"}))).otherwise(wrong)
        if ctx.stages is None and (kind.exact or kind.kind not in ("int", "float", "bool", "None", "str")):
            return _unpack(_let(value, lambda x: _pack(Compiled(x, x.isNotNull(), errors))), ctx, level)
        return Compiled(value, s == "VOID" if kind.kind == "None" else value.isNotNull(), errors, None, level)
    deep = ctx.inner()
    if isinstance(kind, M.Many) and isinstance(kind.item, M.Ref) and kind.kind not in ("set", "frozenset"):
        items, level = ctx.stage(F.try_variant_get(v, "$", "array<variant>"), level)
        return Compiled(items, items.isNotNull(), wrong, None, level)
    if isinstance(kind, (M.Many, M.Mapping)):
        if isinstance(kind, M.Many):
            cells = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(x.alias("v"), F.schema_of_variant(x).alias("s")))
            items = F.transform(cells, lambda x, i: _pack(json_value(kind.item, Cell(x["v"], x["s"], where=cell.below(i)), place.index(i), deep)))
            collect = lambda rs: F.array_distinct(F.transform(rs, lambda r: r["value"])) if kind.kind in ("set", "frozenset") else F.transform(rs, lambda r: r["value"])
        else:
            key = lambda e: _json_key(kind.key, e["key"], place.key(e["key"]), deep)
            cells = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v"), F.schema_of_variant(e["value"]).alias("s")))
            inside = lambda e: json_value(kind.value, Cell(e["v"], e["s"], where=cell.below(e["key"])), place.key(e["key"]), deep)
            entry = lambda k, c: replace(_entry(k, c), value=F.struct(k.value.alias("key"), c.value.alias("value")))
            items = F.transform(cells, lambda e: _pack(_bound(inside(e), deep, lambda c: entry(key(e), c))))
            collect = lambda rs: F.map_from_entries(F.transform(rs, lambda r: r["value"]))

        def joined(rs: Column) -> Column:
            sound = F.coalesce(F.forall(rs, lambda r: r["ok"]), F.lit(False))
            first = F.get(F.filter(rs, lambda r: ~r["ok"]), F.lit(0))
            return F.struct(sound.alias("ok"), F.when(sound, collect(rs)).alias("value"), F.when(rs.isNull(), wrong).otherwise(first["errors"]).alias("errors"), F.coalesce(first["cut"], F.lit(False)).alias("cut"))

        return _unpack(_let(items, joined), ctx, level)
    if isinstance(kind, M.Fixed):
        items, level = ctx.stage(F.try_variant_get(v, "$", "array<variant>"), level)
        parts = [json_value(t, as_cell(F.get(items, F.lit(i)), ctx, level, cell.below(str(i))), place.index(F.lit(i)), ctx) for i, t in enumerate(kind.items)]
        return _fixed(kind, parts, F.coalesce(F.size(items) == len(kind.items), F.lit(False)), wrong, level)
    if isinstance(kind, M.Tagged):
        return json_tagged(kind, cell, place, ctx)
    if kind.shape == "positional":
        return json_positional(kind, cell, place, ctx)
    there = s.startswith("OBJECT")
    return _bound(json_record(kind, cell, place, ctx), ctx, lambda c: Compiled(c.value, there & c.ok, F.when(~there, wrong).otherwise(c.errors), None if c.truncated is None else there & c.truncated, c.level))


def _json_key(kind, key: Column, place: Place, ctx: Ctx) -> Compiled:
    """A key of a JSON object: a text, or one that converts to the kind."""
    base = kind.base if isinstance(kind, M.Constrained) else kind
    if not isinstance(base, M.Scalar) or base.kind == "str" or base.kind in _CANONICAL:
        return rows(kind, key, T.StringType(), place, ctx)
    value = text_number(base, key) if base.exact else {"int": scalars.text_int, "float": scalars.text_float, "bool": scalars.text_bool, "Decimal": lambda t: scalars.json_decimal(t, base.precision, base.scale)}.get(base.kind, lambda t: text_scalar(base, t))(key)
    inner = Compiled(value, value.isNotNull(), _type_error(base, place, "str", key))
    return _bounded(kind, inner, place, base.describe(), ctx) if isinstance(kind, M.Constrained) else inner


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def json_record(contract: M.Contract, cell: Cell, place: Place, ctx: Ctx, keys: Column | None = None, ignored: tuple[str, ...] = (), members: dict[str, tuple[Cell, Column]] | None = None, bound: dict[str, Column] | None = None) -> Compiled:
    """A JSON object; `keys` are its keys in text order where these are known, `members` the cells that are read already, `bound` the results of fields."""
    level = cell.level
    members = {} if members is None else members
    unread = [n for n in [*ignored, *(n for f in contract.fields for n in f.names)] if n not in members]
    if ctx.stages is None and (unread or keys is None):
        # Inside a lambda: members are read once, then each field's result is computed once.
        def with_members(m: Column) -> Column:
            own = members | {n: (Cell(m[f"v{k}"], m[f"s{k}"], where=cell.below(n)), m[f"v{k}"].isNotNull()) for k, n in enumerate(unread)}
            return _pack(json_record(contract, cell, place, ctx, m["keys"], ignored, own))

        reads = [c for k, n in enumerate(unread) for c in (member(cell.v, n).alias(f"v{k}"), F.schema_of_variant(member(cell.v, n)).alias(f"s{k}"))]
        every = F.map_keys(F.try_variant_get(cell.v, "$", "map<string,variant>")) if keys is None else keys
        return _unpack(_let(F.struct(*reads, every.alias("keys")), with_members), ctx, level)
    for n in unread:
        own = as_cell(member(cell.v, n), ctx, cell.level, cell.below(n))
        members[n] = (own, own.v.isNotNull())
    if keys is None:
        keys, level = ctx.stage(F.map_keys(F.try_variant_get(cell.v, "$", "map<string,variant>")), level)
    if ctx.stages is None and bound is None:
        slots = [f for f in contract.fields if len(f.names) == 1 and not isinstance(f.type.base if isinstance(f.type, M.Constrained) else f.type, (M.Scalar, M.Literal)) and f.load is None and not f.transforms]
        if slots:
            results = F.struct(*[_pack(json_value(f.type, members[f.names[0]][0], _at(f, place), ctx)).alias(f"r{k}") for k, f in enumerate(slots)])
            return _unpack(_let(results, lambda r: _pack(json_record(contract, cell, place, ctx, keys, ignored, members, {f.name: r[f"r{k}"] for k, f in enumerate(slots)}))), ctx, level)
    bound = bound or {}
    parts, later = [], []
    for f in contract.fields:
        at = _at(f, place)
        there = [members[n][1] for n in f.names]
        if len(there) == 1:
            own, present = members[f.names[0]]
        else:
            where = None if cell.where is None else (cell.where[0], F.coalesce(*[F.when(members[n][1], cell.below(n)[1]) for n in f.names]))
            own = as_cell(F.coalesce(*[members[n][0].v for n in f.names]), ctx, max(members[n][0].level for n in f.names), where)
            present = own.v.isNotNull()
        if f.name in bound:
            c = with_hooks(f, own, lambda t, x, lv, f=f: _unpack(bound[f.name], ctx, 0, False), at, ctx, own.level)
        else:
            c = with_hooks(f, own, lambda t, x, lv, at=at: json_value(t, replace(x, level=max(x.level, lv)), at, ctx), at, ctx, own.level)
        level = max(level, c.level)
        conflict = []
        if len(there) > 1:
            names = F.slice(F.array_compact(F.array(*[F.when(t, n) for t, n in zip(there, f.names, strict=True)])), 1, 2)
            several = functools.reduce(lambda a, b: a + b, [t.cast("int") for t in there]) > 1
            conflict = [(several, F.array(error("alias_conflict", at, names=names)))]
        missing = F.array(error("missing", at))
        sound = F.when(present, c.ok).otherwise(F.lit(not f.required))
        sound = _all([~k for k, _ in conflict] + [sound])
        value = c.value if f.factory is not None else F.when(present, c.value).otherwise(_absent(f))
        parts.append((f, Compiled(value, sound, _chain([*conflict, (~present, missing)], c.errors), None if c.truncated is None else present & c.truncated, c.level)))
        if f.factory is not None:
            later.append((f, ~present, c.value))
    known = [n for f in contract.fields for n in f.names] + list(ignored)
    found = functools.reduce(lambda a, b: a + b, [members[n][1].cast("int") for n in known], F.lit(0))
    extra = F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda n: ~n.isin(*known) if known else F.lit(True))
    hidden = place.redacted
    unknown = (F.coalesce(F.size(keys) <= found, F.lit(True)), F.transform(extra, lambda n: error("unexpected", Place((*place.parts, ("key", safe_text(n))), hidden))))
    return _record(contract, parts, later, [], unknown, place, ctx, level)


def json_positional(contract: M.Contract, cell: Cell, place: Place, ctx: Ctx) -> Compiled:
    """An array whose items are the fields; trailing defaults may be left out."""
    items, level = ctx.stage(F.try_variant_get(cell.v, "$", "array<variant>"), cell.level)
    size = F.size(items)
    need, n = sum(f.required for f in contract.fields), len(contract.fields)
    parts = [(f, json_value(f.type, as_cell(F.get(items, F.lit(i)), ctx, level, cell.below(str(i))), place.index(F.lit(i)), ctx)) for i, f in enumerate(contract.fields)]
    wrong = _type_error(contract, place, schema_kind(cell.s), shown_json(cell.v))
    bad = [(items.isNull(), wrong), (size < need, F.array(error("missing", place.index(size)))), (size > n, F.array(error("unexpected", place.index(F.lit(n)))))]
    bad += [((size > i) & ~c.ok, c.errors) for i, (_, c) in enumerate(parts)]
    values = [F.when(size > i, c.value).otherwise(_absent(f)).alias(f.name) for i, (f, c) in enumerate(parts)]
    cut = any(c.truncated is not None for _, c in parts)
    truncated = _any([(size > i) & ~c.ok & c.truncated for i, (_, c) in enumerate(parts) if c.truncated is not None]) if cut else None
    ok = items.isNotNull() & (size >= need) & (size <= n) & _all([(size <= i) | c.ok for i, (_, c) in enumerate(parts)])
    return Compiled(F.struct(*values), F.coalesce(ok, F.lit(False)), _chain(bad), truncated, max([level, *[c.level for _, c in parts]]))


def json_tagged(kind: M.Tagged, cell: Cell, place: Place, ctx: Ctx, keys: Column | None = None) -> Compiled:
    """Only the fields of the branch that the tag picks count; members that branches share are read once."""
    tag = as_cell(member(cell.v, kind.tag), ctx, cell.level)
    base = M.Literal(tuple(t for t, _ in kind.branches)).base()
    value, level = ctx.stage(json_scalar(base, tag), tag.level)
    hidden = place.sensitive() if any(f.sensitive for _, c in kind.branches for f in c.fields) else place
    at = hidden.field(kind.tag)
    tags = sorted(str(t) for t, _ in kind.branches)
    if keys is None:
        keys, n = ctx.stage(F.map_keys(F.try_variant_get(cell.v, "$", "map<string,variant>")), cell.level)
        level = max(level, n)
    errors = [(~cell.s.startswith("OBJECT"), _type_error(kind, hidden, schema_kind(cell.s), shown_json(cell.v))),
              (tag.v.isNull(), F.array(error("discriminator_missing", at, discriminator=kind.tag))),
              (value.isNull(), F.array(error("type", at, expected=base.describe(), received=schema_kind(tag.s), value=shown_json(tag.v), discriminator=kind.tag))),
              (~value.isin(*[t for t, _ in kind.branches]), F.array(error("discriminator_unknown", at, received=base.describe(), value=value.cast("string"), discriminator=kind.tag, tags=tags)))]
    members = {kind.tag: (tag, tag.v.isNotNull())}
    fields, sound, cut = [value.alias(kind.tag)], [], []
    for t, contract in kind.branches:
        own = json_record(contract, replace(cell, level=cell.level), place, ctx, keys, (kind.tag,), members)
        level = max(level, own.level)
        errors.append((value == t, own.errors))
        sound.append((value == t) & own.ok)
        if own.truncated is not None:
            cut.append((value == t) & own.truncated)
        fields.append(F.when(value == t, own.value).alias(contract.name))
    return Compiled(F.struct(*fields), F.coalesce(_any(sound), F.lit(False)), _chain(errors), F.coalesce(_any(cut), F.lit(False)) if cut else None, level)


# Schema visits, for budgets.

def row_nodes(kind, raw: Column, dtype: T.DataType, tried: bool = False) -> Column:
    """How many values a contract visits in a typed value: itself and all inside; of a union, itself and each option that is tried, up to its first unsound item."""
    one = F.lit(1).cast("bigint")
    if isinstance(kind, M.Constrained):
        return row_nodes(kind.base, raw, dtype, tried)
    if isinstance(kind, M.Union):
        return _tried(kind, lambda o: (row_nodes(o, raw, dtype, True), rows(o, raw, dtype, Place()).ok), raw.isNull())
    if isinstance(kind, M.Many) and isinstance(dtype, T.ArrayType):
        return one + _visited(raw, lambda x: row_nodes(kind.item, x, dtype.elementType, tried), lambda x: rows(kind.item, x, dtype.elementType, Place()).ok, tried)
    if isinstance(kind, M.Mapping) and isinstance(dtype, T.MapType):
        return one + _visited(F.map_entries(raw), lambda e: one + row_nodes(kind.value, e["value"], dtype.valueType, tried), lambda e: rows(kind.value, e["value"], dtype.valueType, Place()).ok, tried)
    if isinstance(kind, M.Contract) and isinstance(dtype, T.StructType):
        inside = [row_nodes(f.type, raw[n], dtype[n].dataType, tried) for f in kind.fields for n in f.names if n in dtype.names]
        return F.when(raw.isNull(), one).otherwise(functools.reduce(lambda a, b: a + b, inside, one))
    if isinstance(kind, M.Fixed) and isinstance(dtype, T.ArrayType):
        return functools.reduce(lambda a, b: a + b, [F.when(F.size(raw) == len(kind.items), row_nodes(t, F.get(raw, F.lit(k)), dtype.elementType)).otherwise(0) for k, t in enumerate(kind.items)], one)
    return one


def json_nodes(kind, v: Column, tried: bool = False) -> Column:
    """As `row_nodes`, of a VARIANT; of a tagged union only the branch that its tag picks."""
    one = F.lit(1).cast("bigint")
    add = lambda parts: functools.reduce(lambda a, b: a + b, parts, one)
    if isinstance(kind, M.Constrained):
        return json_nodes(kind.base, v, tried)
    if isinstance(kind, M.Union):
        return _tried(kind, lambda o: (json_nodes(o, v, True), json_value(o, v, Place()).ok), F.is_variant_null(v))
    if isinstance(kind, M.Many):
        return one + _visited(F.try_variant_get(v, "$", "array<variant>"), lambda x: json_nodes(kind.item, x, tried), lambda x: json_value(kind.item, x, Place()).ok, tried)
    if isinstance(kind, M.Mapping):
        return one + _visited(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: one + json_nodes(kind.value, e["value"], tried), lambda e: json_value(kind.value, e["value"], Place()).ok, tried)
    if isinstance(kind, M.Fixed) or isinstance(kind, M.Contract) and kind.shape == "positional":
        types = kind.items if isinstance(kind, M.Fixed) else [f.type for f in kind.fields]
        items = F.try_variant_get(v, "$", "array<variant>")
        return add([F.when(F.size(items) > k, json_nodes(t, F.get(items, F.lit(k)))).otherwise(0) for k, t in enumerate(types)])
    if isinstance(kind, M.Tagged):
        tag = json_scalar(M.Literal(tuple(t for t, _ in kind.branches)).base(), member(v, kind.tag))
        return one + F.coalesce(*[F.when(tag == t, json_nodes(c, v) + 1) for t, c in kind.branches], F.lit(0))
    if isinstance(kind, M.Contract):
        return add([F.when(member(v, n).isNotNull(), json_nodes(f.type, member(v, n), tried)).otherwise(0) for f in kind.fields for n in f.names])
    return one


def _visited(items: Column, nodes, ok, tried: bool) -> Column:
    """Visits of items; of an option that is `tried`, of those up to the first that isn't sound."""
    zero = F.lit(0).cast("bigint")
    if tried:
        seen = F.coalesce(F.nullif(F.array_position(F.transform(items, ok), F.lit(False)), F.lit(0)), F.size(items).cast("bigint"))
        items = F.slice(items, F.lit(1), F.greatest(seen, F.lit(0)).cast("int"))
    return F.coalesce(F.aggregate(items, zero, lambda acc, x: acc + nodes(x)), zero)


def _tried(kind: M.Union, option, null: Column) -> Column:
    """One for the union and the visits of each option up to the one that holds."""
    total, before = F.lit(1).cast("bigint"), F.lit(False)
    for o in kind.ordered():
        n, ok = (F.lit(1).cast("bigint"), null) if o == M.NONE else option(o)
        total, before = total + F.when(before, 0).otherwise(n), before | ok
    return total
