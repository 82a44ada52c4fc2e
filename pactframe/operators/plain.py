"""Contracts of plain records and lists: which values are surely sound, and how many nodes they hold, from two looks at a whole value.

A VARIANT's schema names all keys and shapes that are anywhere in it; the same
value read as a typed one shows what is null, absent or out of bounds.  What
both pass is sound.  What they don't may be sound yet: that is for levels to
say.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactframe.contract import compiler as C
from pactframe.contract import model as M

#: Nodes in one another, of lambdas within lambdas that the analyzer resolves.
DEPTH = 8
_TYPES = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}
#: Schemas of a VARIANT from JSON. A list's is that of all its items: numbers of several kinds have the widest, values of several shapes VARIANT.
_SCHEMAS = {"int": "BIGINT", "float": r"(?:BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))", "str": "STRING", "bool": "BOOLEAN"}
#: Keys that a schema names as they are.
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _scalar(kind) -> bool:
    kind = kind.base if isinstance(kind, M.Constrained) else kind
    return isinstance(kind, M.Literal) and kind.base().kind in ("int", "str", "bool") or isinstance(kind, M.Scalar) and kind.kind in _TYPES and not kind.exact


def plain(kind, named: dict[str, object], depth: int = DEPTH) -> bool:
    """Whether values of a kind can be judged here: records of fields of one name, lists, and scalars that JSON has, at most `depth` nodes in one another."""
    if isinstance(kind, M.Ref):
        return depth > 0 and isinstance(named[kind.name], M.Contract) and plain(named[kind.name], named, depth - 1)
    if isinstance(kind, M.Union):
        return len(kind.options) == 2 and M.NONE in kind.options and all(o == M.NONE or _scalar(o) for o in kind.options)
    if isinstance(kind, M.Constrained) and isinstance(kind.base, M.Many):
        return plain(kind.base, named, depth)
    if isinstance(kind, M.Many):
        return kind.kind in ("list", "tuple") and plain(kind.item, named, depth)
    if isinstance(kind, M.Contract):
        own = kind.shape == "record" and kind.fields and not kind.checks
        return bool(own) and all(len(f.names) == 1 and _NAME.fullmatch(f.external) and f.factory is None and f.load is None and not f.transforms and not f.checks and plain(f.type, named, depth) for f in kind.fields)
    return _scalar(kind)


def _unclear(f: M.Field) -> bool:
    """Whether of an absent member and a JSON null, which are both null as typed values, one is sound only."""
    return f.required == isinstance(f.type, M.Union)


def _member(f: M.Field, named: dict[str, object], x: Column, then) -> Column:
    """`then` of a member of a typed value."""
    own = x[f.external]
    return C._let(F.try_variant_get(own, "$", typed(f.type, named)), then) if _unclear(f) else then(own)


def typed(kind, named: dict[str, object]) -> str:
    """The type as which values are read; what doesn't fit is null where it is, and lists keep their lengths."""
    if isinstance(kind, M.Ref):
        return typed(named[kind.name], named)
    if isinstance(kind, M.Union):
        return typed(next(o for o in kind.options if o != M.NONE), named)
    if isinstance(kind, M.Constrained):
        return typed(kind.base, named)
    if isinstance(kind, M.Many):
        return f"array<{typed(kind.item, named)}>"
    if isinstance(kind, M.Contract):
        return f"struct<{','.join(f'`{f.external}`:{"variant" if _unclear(f) else typed(f.type, named)}' for f in kind.fields)}>"
    return _TYPES[(kind.base() if isinstance(kind, M.Literal) else kind).kind]


def _schema(kind, named: dict[str, object]) -> str:
    """What the schema of a sound value looks like; nulls hide in it."""
    if isinstance(kind, M.Ref):
        return _schema(named[kind.name], named)
    if isinstance(kind, M.Union):
        return f"(?:{_schema(next(o for o in kind.options if o != M.NONE), named)}|VOID)"
    if isinstance(kind, M.Constrained):
        return _schema(kind.base, named)
    if isinstance(kind, M.Many):
        return f"ARRAY<(?:{_schema(kind.item, named)}|VOID)>"
    if isinstance(kind, M.Contract):
        return f"OBJECT<{''.join(f'(?:{f.external}: {_schema(f.type, named)}(?:, |(?=>)))' + ('' if f.required else '?') for f in sorted(kind.fields, key=lambda f: f.external))}>"
    return _SCHEMAS[(kind.base() if isinstance(kind, M.Literal) else kind).kind]


def _complete(kind, named: dict[str, object], x: Column) -> Column:
    """Whether a typed value has all that its kind asks for."""
    if isinstance(kind, M.Ref):
        return _complete(named[kind.name], named, x)
    if isinstance(kind, M.Union):
        return x.isNull() | _complete(next(o for o in kind.options if o != M.NONE), named, x)
    if isinstance(kind, M.Constrained):
        return functools.reduce(lambda a, b: a & b, [F.coalesce(C.bound_holds(b, kind.base, x), F.lit(False)) for b in kind.ordered()], _complete(kind.base, named, x))
    if isinstance(kind, M.Many):
        return F.coalesce(F.forall(x, lambda e: _complete(kind.item, named, e)), F.lit(False))
    if isinstance(kind, M.Contract):
        def member(f: M.Field) -> Column:
            held = _member(f, named, x, lambda y: _complete(f.type, named, y))
            return held if not _unclear(f) else x[f.external].isNotNull() & held if f.required else x[f.external].isNull() | held

        return functools.reduce(lambda a, b: a & b, map(member, kind.fields), x.isNotNull())
    if isinstance(kind, M.Literal):
        return F.coalesce(x.isin(*kind.values), F.lit(False))
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)) if kind.kind == "float" else x.isNotNull()


def surely(kind, named: dict[str, object], v: Column, x: Column | None = None) -> Column:
    """Whether a VARIANT is surely sound; `x` is it as a typed value, where that is at hand."""
    fits = F.coalesce(F.schema_of_variant(v).rlike(rf"\A{_schema(kind, named)}\z"), F.lit(False))
    whole = lambda t: _complete(kind, named, t)
    return fits & (C._let(F.try_variant_get(v, "$", typed(kind, named)), whole) if x is None else whole(x))


def _holds(kind) -> bool:
    """Whether a plain kind holds nodes."""
    if isinstance(kind, M.Contract):
        return any(_holds(f.type) for f in kind.fields)
    return isinstance(kind, M.Ref) or isinstance(kind, (M.Many, M.Constrained)) and _holds(kind.item if isinstance(kind, M.Many) else kind.base)


def nodes(kind, named: dict[str, object], x: Column, levels: bool = False) -> Column:
    """How many nodes, or in how many levels, are below a typed value, sound or not."""
    zero = F.lit(0) if levels else F.lit(0).cast("bigint")
    if isinstance(kind, M.Constrained):
        return nodes(kind.base, named, x, levels)
    if isinstance(kind, M.Contract):
        held = lambda f: _member(f, named, x, lambda y: nodes(f.type, named, y, levels))
        parts = [held(f) for f in kind.fields if _holds(f.type)]
        return zero if not parts else functools.reduce(F.greatest if levels else lambda a, b: a + b, parts)
    if not _holds(kind):
        return zero
    own = isinstance(kind.item, M.Ref)
    item = named[kind.item.name] if own else kind.item
    size = F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0))
    here = F.lit(0) if not own else F.when(size > 0, F.lit(1)).otherwise(F.lit(0)) if levels else size
    if not _holds(item):
        return here.cast("int" if levels else "bigint")
    join = F.greatest if levels else lambda a, b: a + b
    inside = F.coalesce(F.aggregate(x, zero, lambda acc, e: join(acc, nodes(item, named, e, levels))), zero)
    return (here + inside).cast("int" if levels else "bigint")


def straight(kind, named: dict[str, object]) -> bool:
    """Whether the nodes of a plain contract are all in lists that are fields of nodes themselves."""
    def held(t) -> bool:
        t = t.base if isinstance(t, M.Constrained) else t
        return held(t.item) if isinstance(t, M.Many) else straight(named[t.name], named) if isinstance(t, M.Ref) else not _holds(t)

    return all(held(f.type) for f in kind.fields)


def surely_alone(kind: M.Contract, v: Column) -> Column:
    """Whether the own fields of a node of a straight contract are surely sound, whatever is in the lists of nodes, which isn't looked into."""
    alone = [f for f in kind.fields if not _holds(f.type)]

    def shape(t) -> str:
        return "variant" if isinstance(t, M.Ref) else shape(t.base) if isinstance(t, M.Constrained) else f"array<{shape(t.item)}>"

    def shaped(t, x: Column) -> Column:
        if isinstance(t, M.Constrained):
            return functools.reduce(lambda a, b: a & b, [F.coalesce(C.bound_holds(b, t.base, x), F.lit(False)) for b in t.ordered()], shaped(t.base, x))
        return x.isNotNull() if isinstance(t.item, M.Ref) else F.coalesce(F.forall(x, lambda e: shaped(t.item, e)), F.lit(False))

    members = f"struct<{','.join(f'`{f.external}`:' + ('variant' if f in alone else shape(f.type)) for f in kind.fields)}>"

    def fits(x: Column) -> Column:
        present = functools.reduce(lambda a, b: a + b, [x[f.external].isNotNull().cast("int") for f in kind.fields])
        tests = [x.isNotNull(), F.size(F.try_variant_get(v, "$", "map<string,variant>")) == present]
        for f in kind.fields:
            own = x[f.external]
            sound = surely(f.type, {}, own) if f in alone else shaped(f.type, own)
            tests.append(own.isNotNull() & sound if f.required else own.isNull() | sound)
        return functools.reduce(lambda a, b: a & b, tests)

    return F.coalesce(C._let(F.try_variant_get(v, "$", members), fits), F.lit(False))
