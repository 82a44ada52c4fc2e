"""Output of validated records: projection, nested selection, JSON text.

Records, lists and maps of scalars go through the engine's own JSON writer.
Tuples, positional records, unions and tagged records have other shapes in
JSON than in columns: their text is put together from the texts of their parts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.contract import compiler as C
from pactframe.contract import model as M
from pactframe.contract.errors import Place, no_errors
from pactframe.functions.scalars import format_duration


def _base(kind):
    return kind.base if isinstance(kind, M.Constrained) else kind


def check_selection(kind, tree: dict | None, excluding: bool = False, rows: bool = False) -> None:
    """Names must be canonical and lead to records; a tagged union keeps its tag.

    With `rows`, for output that is no JSON, nothing inside a set can be
    selected: its members would no longer be what made them distinct.
    """
    if tree is None or tree is True:
        return
    kind = _base(kind)
    if isinstance(kind, M.Union):
        real = [o for o in kind.options if o != M.NONE]
        for o in real:
            check_selection(o, tree, excluding, rows)
        return
    if isinstance(kind, M.Many):
        if rows and kind.kind in ("set", "frozenset"):
            raise ValueError(f"a selection inside a {kind.kind} is possible in JSON only")
        return check_selection(kind.item, tree, excluding, rows)
    if isinstance(kind, M.Mapping):
        return check_selection(kind.value, tree, excluding, rows)
    if isinstance(kind, M.Fixed):
        for item in kind.items:
            check_selection(item, tree, excluding, rows)
        return
    if isinstance(kind, M.Tagged):
        if (kind.tag in tree) == excluding:
            raise ValueError(f"the selection {'drops' if excluding else 'lacks'} the discriminator {kind.tag}")
        names = {f.name for _, c in kind.branches for f in c.fields} | {kind.tag}
        if not set(tree) <= names:
            raise ValueError(f"unknown field in {sorted(tree)}")
        return
    if not isinstance(kind, M.Contract) or kind.shape == "positional":
        raise ValueError(f"{kind.describe()} has no fields to select")
    if not tree:
        raise ValueError("an empty selection")
    for name, below in tree.items():
        if name not in {f.name for f in kind.fields}:
            raise ValueError(f"unknown field {name}")
        check_selection(kind[name].type, below, excluding, rows)


def _tree(names) -> dict | None:
    if names is None or isinstance(names, dict):
        return names
    return dict.fromkeys(names, True)


def _chosen(kind: M.Contract, include, exclude) -> list[tuple[M.Field, object, object]]:
    """The fields that a selection leaves, with what it selects inside them."""
    return [(f, (include or {}).get(f.name), (exclude or {}).get(f.name)) for f in kind.fields
            if (include is None or f.name in include) and (exclude is None or exclude.get(f.name) is not True)]


def _branch_part(contract: M.Contract, tree: dict | None) -> dict | None:
    return None if tree is None else {k: v for k, v in tree.items() if k in {f.name for f in contract.fields}}


def _dumped(f: M.Field, value: Column) -> Column:
    """What a field's serialiser gives; where its output is declared, a result that breaks the declaration ends the job."""
    out = f.dump(value)
    if f.output is None:
        return out
    sound = C.rows(f.output, out, f.output.spark(), Place().field(f.external)).ok
    return F.when(sound | value.isNull() & out.isNull(), out).otherwise(F.raise_error(F.lit(f"output: {f.external} is no {f.output.describe()}")).cast(f.output.spark()))


def output_errors(contract: M.Contract, value: Column) -> Column:
    """Errors of the serialised fields whose output is declared, located at their external names."""
    found = []
    for f in contract.fields:
        if f.dump is not None and f.output is not None:
            c = C.rows(f.output, f.dump(value[f.name]), f.output.spark(), Place().field(f.external))
            found.append(F.when(c.ok, no_errors()).otherwise(c.errors))
    return F.flatten(F.array(*found)) if found else no_errors()


def projected(kind, value: Column, by_alias: bool = True, include=None, exclude=None, text: bool = False) -> Column:
    """A value for output; `text` writes scalars as JSON does (exact decimals, base64, ISO forms).

    A tagged record becomes its tag and the fields of its branches: those that
    several branches have with one type are one column.
    """
    kind = _base(kind)
    include, exclude = _tree(None if include is True else include), _tree(None if exclude is True else exclude)
    if isinstance(kind, M.Contract):
        fields = []
        for f, inside, without in _chosen(kind, include, exclude):
            own = value[f.name]
            if f.dump is not None:
                own = _dumped(f, own) if f.output is None else projected(f.output, _dumped(f, own), by_alias, inside, without, text)
            else:
                own = projected(f.type, own, by_alias, inside, without, text)
            fields.append(own.alias(f.external if by_alias else f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, M.Tagged):
        by_name: dict[str, list[tuple[str, T.DataType, Column]]] = {}
        for _, c in kind.branches:
            own = projected(c, value[c.name], by_alias, _branch_part(c, include), exclude, text)
            for f, *_ in _chosen(c, _branch_part(c, include), exclude):
                name = f.external if by_alias else f.name
                by_name.setdefault(name, []).append((c.name, f.type.spark(), own[name]))
        fields = []
        for name, parts in by_name.items():
            if len({t.json() for _, t, _ in parts}) == 1:
                fields.append(F.coalesce(*[p for _, _, p in parts]).alias(name))
            else:
                fields += [p.alias(f"{name}_{branch}") for branch, _, p in parts]
        return F.when(value.isNotNull(), F.struct(value[kind.tag].alias(kind.tag), *fields))
    if isinstance(kind, M.Union):
        real = [o for o in kind.options if o != M.NONE]
        return projected(real[0], value, by_alias, include, exclude, text) if len(real) == 1 else value
    if isinstance(kind, M.Many):
        return F.transform(value, lambda x: projected(kind.item, x, by_alias, include, exclude, text))
    if isinstance(kind, M.Mapping):
        return F.transform_values(value, lambda k, x: projected(kind.value, x, by_alias, include, exclude, text))
    if isinstance(kind, M.Fixed):
        return F.when(value.isNotNull(), F.struct(*[projected(t, value[f"_{k}"], by_alias, include, exclude, text).alias(f"_{k}") for k, t in enumerate(kind.items)]))
    return json_text(kind, value) if text else value


def _composite(kind) -> bool:
    """Whether the JSON of a type has another shape than its columns."""
    kind = _base(kind)
    if isinstance(kind, (M.Fixed, M.Tagged)) or kind == M.BIG_INT:
        return True
    if isinstance(kind, M.Union):
        real = [o for o in kind.options if o != M.NONE]
        return len(real) > 1 or _composite(real[0])
    if isinstance(kind, M.Many):
        return _composite(kind.item)
    if isinstance(kind, M.Mapping):
        return _composite(kind.value) or _base(kind.key) != M.STR
    if isinstance(kind, M.Contract):
        return kind.shape == "positional" or any(_composite(f.output if f.dump is not None and f.output is not None else f.type) for f in kind.fields if f.dump is None or f.output is not None)
    return False


def _plain_text(value: Column, exclude_none: bool = False) -> Column:
    """JSON text of one value that the engine's writer takes; null is `null`."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": str(exclude_none).lower()})
    return F.when(value.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def encoded(kind, value: Column, by_alias: bool = True, include=None, exclude=None, exclude_none: bool = False) -> Column:
    """JSON text of a value of a type; `null` where it is null."""
    kind = _base(kind)
    include, exclude = _tree(None if include is True else include), _tree(None if exclude is True else exclude)
    below = lambda k, v, i=include, e=exclude: encoded(k, v, by_alias, i, e, exclude_none)
    if kind == M.BIG_INT:
        return F.coalesce(value, F.lit("null"))
    if not _composite(kind):
        return _plain_text(projected(kind, value, by_alias, include, exclude, True), exclude_none)
    none = value.isNull()
    join = lambda a, parts, b: F.concat(F.lit(a), F.array_join(parts, ","), F.lit(b))
    if isinstance(kind, M.Many):
        out = join("[", F.transform(value, lambda x: below(kind.item, x)), "]")
    elif isinstance(kind, M.Mapping):
        out = join("{", F.transform(F.map_entries(value), lambda e: F.concat(_plain_text(json_text(_base(kind.key), e["key"]).cast("string")), F.lit(":"), below(kind.value, e["value"]))), "}")
    elif isinstance(kind, M.Fixed):
        out = join("[", F.array(*[below(t, value[f"_{k}"]) for k, t in enumerate(kind.items)]), "]")
    elif isinstance(kind, M.Union):
        real = [o for o in kind.ordered() if o != M.NONE]
        if len(real) == 1:
            return below(real[0], value)
        out = F.coalesce(*[F.when(value["branch"] == o.describe(), encoded(o, value[f"o{k}"], by_alias, *([include, exclude] if _selects(o) else [None, None]), exclude_none)) for k, o in enumerate(kind.ordered()) if o != M.NONE])
        none = none | value["branch"].isNull()
    elif isinstance(kind, M.Tagged):
        tag = F.concat(F.lit(f"{json.dumps(kind.tag)}:"), _plain_text(value[kind.tag]))
        out = F.coalesce(*[F.when(value[kind.tag] == t, join("{", F.concat(F.array(tag), _members(c, value[c.name], by_alias, _branch_part(c, include), exclude, exclude_none)), "}")) for t, c in kind.branches])
    elif kind.shape == "positional":
        out = join("[", F.array(*[below(f.type, value[f.name], None, None) for f in kind.fields]), "]")
    else:
        out = join("{", _members(kind, value, by_alias, include, exclude, exclude_none), "}")
    return F.when(none, "null").otherwise(out)


def _selects(kind) -> bool:
    kind = _base(kind)
    return isinstance(kind, M.Tagged) or isinstance(kind, M.Contract) and kind.shape != "positional" or isinstance(kind, M.Many) and _selects(kind.item) or isinstance(kind, M.Mapping) and _selects(kind.value)


def _members(contract: M.Contract, value: Column, by_alias: bool, include, exclude, exclude_none: bool) -> Column:
    """`"name":text` of each selected field, in declaration order."""
    parts = []
    for f, inside, without in _chosen(contract, include, exclude):
        own, kind = value[f.name], f.type
        if f.dump is not None:
            own, kind = _dumped(f, own), f.output
        text = _plain_text(own, exclude_none) if kind is None else encoded(kind, own, by_alias, inside, without, exclude_none)
        shown = F.concat(F.lit(f"{json.dumps(f.external if by_alias else f.name, ensure_ascii=False)}:"), text)
        parts.append(F.when(text != "null", shown) if exclude_none else shown)
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def json_text(kind, value: Column) -> Column:
    """A scalar as JSON output writes it."""
    k = kind.base().kind if isinstance(kind, M.Literal) else kind.kind
    if k == "Decimal" or k in ("UUID", "Path", "time"):
        return value.cast("string")
    if k == "bytes":
        return F.regexp_replace(F.base64(value), "[\r\n]", "")
    if k == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if k == "datetime":
        part = F.date_format(value, "SSSSSS")
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(F.lit("")), F.lit("+00:00" if kind.aware else ""))
    if k == "timedelta":
        return format_duration(_micros(value))
    return value


def _micros(interval: Column) -> Column:
    days, hours, minutes, seconds = (F.extract(F.lit(p), interval) for p in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return (((days * 24 + hours) * 60 + minutes) * 60).cast("bigint") * 1_000_000 + (seconds * 1_000_000).cast("bigint")


def to_rows(df: DataFrame, contract: M.Contract, column: str = "value", keys: tuple[str, ...] = (), **options) -> DataFrame:
    """Output columns by external name, detached from the record."""
    check_selection(contract, _tree(options.get("include")), rows=True) if options.get("include") is not None else None
    check_selection(contract, _tree(options.get("exclude")), True, rows=True) if options.get("exclude") is not None else None
    return df.select(*keys, projected(contract, F.col(column), **options).alias("_out")).select(*keys, "_out.*")


def non_finite(kind, value: Column) -> Column:
    """Whether a number in a value can't be written as JSON."""
    kind = _base(kind)
    never = F.lit(False)
    if isinstance(kind, M.Scalar) and kind.kind == "float":
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), never)
    parts: list[Column] = []
    if isinstance(kind, M.Contract):
        parts = [non_finite(f.type, value[f.name]) for f in kind.fields if f.dump is None and _has_float(f.type)]
    elif isinstance(kind, M.Many) and _has_float(kind.item):
        parts = [F.coalesce(F.exists(value, lambda x: non_finite(kind.item, x)), never)]
    elif isinstance(kind, M.Mapping) and _has_float(kind.value):
        parts = [F.coalesce(F.exists(F.map_values(value), lambda x: non_finite(kind.value, x)), never)]
    elif isinstance(kind, M.Fixed):
        parts = [non_finite(t, value[f"_{k}"]) for k, t in enumerate(kind.items) if _has_float(t)]
    elif isinstance(kind, M.Tagged):
        parts = [F.coalesce((value[kind.tag] == t) & non_finite(c, value[c.name]), never) for t, c in kind.branches if _has_float(c)]
    elif isinstance(kind, M.Union):
        real = [(k, o) for k, o in enumerate(kind.ordered()) if o != M.NONE]
        parts = [non_finite(o, value if len(real) == 1 else value[f"o{k}"]) for k, o in real if _has_float(o)]
    return C._any(parts) if parts else never


def _has_float(kind) -> bool:
    kind = _base(kind)
    inside = {M.Contract: lambda: [f.type for f in kind.fields], M.Many: lambda: [kind.item], M.Mapping: lambda: [kind.value], M.Fixed: lambda: kind.items, M.Tagged: lambda: [c for _, c in kind.branches], M.Union: lambda: kind.options}
    return kind == M.FLOAT or any(map(_has_float, inside.get(type(kind), lambda: ())()))


def to_json(contract: M.Contract | M.Tagged, value: Column, exclude_none: bool = False, **options) -> Column:
    """Strict compact JSON text, keys in declaration order; numbers that JSON lacks end the job."""
    if _composite(contract):
        shown = encoded(contract, value, exclude_none=exclude_none, **options)
    else:
        shown = F.to_json(projected(contract, value, text=True, **options), {"ignoreNullFields": str(exclude_none).lower()})
    if not _has_float(contract):
        return F.when(value.isNotNull(), shown)
    return F.when(non_finite(contract, value), F.raise_error(F.lit("json_invalid: a number is not finite"))).when(value.isNotNull(), shown)


def partial_json(contract: M.Contract, value: Column, present: Column, exclude_none: bool = False) -> Column:
    """JSON of the present fields alone, in declaration order; each is encoded before they are joined."""
    parts = []
    for f in contract.fields:
        own = F.concat(F.lit(f"{json.dumps(f.external, ensure_ascii=False)}:"), encoded(f.type, value[f.name]))
        shown = F.array_contains(present, f.name)
        if exclude_none:
            shown = shown & value[f.name].isNotNull()
        parts.append(F.when(shown, own))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
