"""What a contract declares: types, constraints, fields, checks.

Everything here is plain data on the driver; `compiler` turns it into columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scalar:
    """One value of `kind`: int, float, str, bool, bytes, None, Decimal, date, datetime, time, timedelta, UUID, Path or an IP kind.

    An `exact` int or Decimal has any number of digits (4,300 at most) and is carried as plain text.
    """

    kind: str
    precision: int = 38
    scale: int = 18
    aware: bool = True
    exact: bool = False

    def describe(self) -> str:
        return self.kind

    def spark(self) -> T.DataType:
        return T.StringType() if self.exact else {
            "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "None": T.NullType(),
            "Decimal": T.DecimalType(self.precision, self.scale), "date": T.DateType(),
            "datetime": T.TimestampType() if self.aware else T.TimestampNTZType(), "timedelta": T.DayTimeIntervalType(),
        }.get(self.kind, T.StringType())


INT, FLOAT, STR, BOOL, BYTES, NONE = (Scalar(k) for k in ("int", "float", "str", "bool", "bytes", "None"))
DATE, DATETIME, TIME, DURATION, UUID, PATH = (Scalar(k) for k in ("date", "datetime", "time", "timedelta", "UUID", "Path"))
NAIVE_DATETIME = Scalar("datetime", aware=False)
BIG_INT, EXACT = Scalar("int", exact=True), Scalar("Decimal", exact=True)


def decimal(precision: int = 38, scale: int = 18) -> Scalar:
    return Scalar("Decimal", precision, scale)


@dataclass(frozen=True)
class Literal:
    """Constants, by type and value; all of one base type."""

    values: tuple[Any, ...]

    def base(self) -> Scalar:
        first = self.values[0]
        return BOOL if isinstance(first, bool) else INT if isinstance(first, int) else FLOAT if isinstance(first, float) else STR

    def describe(self) -> str:
        return f"Literal[{', '.join(sorted(map(repr, self.values)))}]"

    def spark(self) -> T.DataType:
        return self.base().spark()


@dataclass(frozen=True)
class Enum(Literal):
    """A named set of values."""

    name: str = "Enum"

    def describe(self) -> str:
        return self.name


@dataclass(frozen=True)
class Many:
    """Items of one type: a list, a set (duplicates collapse) or a tuple of any length."""

    item: Any
    kind: str = "list"

    def describe(self) -> str:
        return f"{self.kind}[{self.item.describe()}{', ...' if self.kind == 'tuple' else ''}]"

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark())


@dataclass(frozen=True)
class Mapping:
    """Values of one type by text keys."""

    value: Any
    key: Any = STR

    def describe(self) -> str:
        return f"dict[{self.key.describe()}, {self.value.describe()}]"

    def spark(self) -> T.DataType:
        return T.MapType(self.key.spark(), self.value.spark())


@dataclass(frozen=True)
class Fixed:
    """A tuple of exactly these items."""

    items: tuple[Any, ...]

    def describe(self) -> str:
        return f"tuple[{', '.join(i.describe() for i in self.items)}]"

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(f"_{k}", i.spark()) for k, i in enumerate(self.items)])


@dataclass(frozen=True)
class Union:
    """Options that are tried in a fixed order; the first that validates wins."""

    options: tuple[Any, ...]

    def ordered(self) -> list[Any]:
        first = ["int", "float", "str", "bool", "bytes", "None"]

        def rank(option: Any) -> tuple[int, str]:
            base = option.base if isinstance(option, Constrained) else option
            return (first.index(base.kind) if isinstance(base, Scalar) and base.kind in first else 6 if isinstance(base, (Scalar, Literal)) else 8 if isinstance(base, Tagged) else 10, option.describe())

        return sorted(self.options, key=rank)

    def describe(self) -> str:
        return " | ".join(o.describe() for o in self.ordered())

    def spark(self) -> T.DataType:
        real = [o for o in self.options if o != NONE]
        return real[0].spark() if len(real) == 1 else T.StructType(
            [T.StructField("branch", T.StringType()), *[T.StructField(f"o{k}", o.spark()) for k, o in enumerate(self.ordered()) if o != NONE]])


def optional(kind: Any) -> Union:
    return Union((kind, NONE))


@dataclass(frozen=True)
class Deep:
    """Where a recursive contract ends: every value is deeper than its `limit` levels."""

    limit: int
    name: str

    def describe(self) -> str:
        return self.name

    def spark(self) -> T.DataType:
        return T.StringType()


@dataclass(frozen=True)
class Ref:
    """A kind by its name, for records that are checked a level at a time (`operators.levels`); here its value is taken as it is."""

    name: str

    def describe(self) -> str:
        return self.name

    def spark(self) -> T.DataType:
        return T.VariantType()


def recursive(build: Callable[[Any], Contract], depth: int = 8) -> Contract:
    """A contract that contains itself, unrolled: `build` gets what stands for the contract inside its fields.

    A record may hold `depth` levels of records below the root; deeper ones
    fail with code `depth`, not as unexpected.  The expression grows with the
    depth, so that it is a bound of the declaration; see `max_depth` of
    `from_json` for that of the text.
    """
    out: Any = Deep(depth, build(STR).name)
    for _ in range(depth + 1):
        out = build(out)
    return out


@dataclass(frozen=True)
class Bound:
    """gt, ge, lt, le, multiple_of, min_length, max_length or pattern, with its limit."""

    rule: str
    limit: Any
    flags: str = ""

    def label(self) -> str:
        name = {"gt": "Gt", "ge": "Ge", "lt": "Lt", "le": "Le", "multiple_of": "MultipleOf", "min_length": "MinLength", "max_length": "MaxLength", "pattern": "Pattern"}[self.rule]
        return f"{name}({self.limit!r})"


_ORDER = ("gt", "ge", "lt", "le", "multiple_of", "min_length", "max_length", "pattern")


@dataclass(frozen=True)
class Constrained:
    """A type with bounds, which are tested in a fixed order: lower, upper, multiples, lengths, patterns."""

    base: Any
    bounds: tuple[Bound, ...]

    def __post_init__(self):
        kind = self.base.kind if isinstance(self.base, Scalar) else None
        for b in self.bounds:
            numeric = b.rule in ("gt", "ge", "lt", "le", "multiple_of")
            if b.rule == "multiple_of" and kind and self.base.exact:
                raise ValueError("multiple_of does not apply to numbers carried as text")
            if numeric and kind not in ("int", "float", "Decimal") or b.rule == "pattern" and kind != "str":
                raise ValueError(f"{b.label()} does not apply to {self.base.describe()}")
            if b.rule.endswith("length") and kind not in ("str", "bytes") and not isinstance(self.base, (Many, Mapping)):
                raise ValueError(f"{b.label()} does not apply to {self.base.describe()}")
        low = [b.limit for b in self.bounds if b.rule in ("gt", "ge")]
        high = [b.limit for b in self.bounds if b.rule in ("lt", "le")]
        if low and high and max(low) > min(high):
            raise ValueError("contradictory bounds")

    def ordered(self) -> list[Bound]:
        return sorted(self.bounds, key=lambda b: (_ORDER.index(b.rule), b.limit if b.rule == "multiple_of" else 0, str(b.limit), b.flags))

    def describe(self) -> str:
        return f"Annotated[{self.base.describe()}, {', '.join(b.label() for b in self.ordered())}]"

    def spark(self) -> T.DataType:
        return self.base.spark()


def constrained(base: Any, *, flags: str = "", **rules: Any) -> Constrained:
    return Constrained(base, tuple(Bound(r, v, flags if r == "pattern" else "") for r, vs in rules.items() for v in (vs if isinstance(vs, tuple) else (vs,))))


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"


MISSING = _Missing()


@dataclass(frozen=True)
class Check:
    """A predicate on typed columns; with one field a field check, with more a record check."""

    name: str
    fields: tuple[str, ...]
    test: Callable[..., Column]


@dataclass(frozen=True)
class Hook:
    """A hook that says for itself whether it failed: `call` makes of a value and of whether it is wanted a struct (value, failed).

    Null is a result like any other.  See `operators.hooks.python_hook`.
    """

    call: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Field:
    """A field of a record: its type, names, default and metadata.

    `transforms` are (name, column -> column) and give null where they reject,
    or (name, `Hook`); of JSON values they take those of kind `raw`, the others
    go on as they are.  `checks` are (name, column -> boolean column) or (name,
    `Hook`), whose value isn't looked at.  A `factory` gives a column; null, where the type has no null, is a
    failure.  `load` is a representation, (external type, column -> column),
    `dump` the way out, and `output` what its result is declared to be: it is
    checked and projected as such, and without it the result is a leaf.
    """

    name: str
    type: Any
    alias: str | None = None
    legacy: tuple[str, ...] = ()
    default: Any = MISSING
    factory: Callable[[], Column] | None = None
    omittable: bool = False
    transforms: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    checks: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    load: tuple[Any, Callable[[Column], Column]] | None = None
    dump: Callable[[Column], Column] | None = None
    output: Any = None
    raw: Scalar = Scalar("str")
    sensitive: bool = False
    read_only: bool = False
    write_only: bool = False

    @property
    def external(self) -> str:
        return self.alias or self.name

    @property
    def names(self) -> tuple[str, ...]:
        return (self.external, *self.legacy)

    @property
    def required(self) -> bool:
        return self.default is MISSING and self.factory is None and not self.omittable


@dataclass(frozen=True)
class Contract:
    """A closed record: its fields in order and its checks.

    `shape` is record (all independent errors), typed_dict (the first error
    only) or positional (an array whose items are the fields).
    """

    name: str
    fields: tuple[Field, ...]
    checks: tuple[Check, ...] = ()
    shape: str = "record"
    partial: bool = False
    origin: str = ""
    mode: str = ""

    def __post_init__(self):
        seen: set[str] = set()
        for f in self.fields:
            for n in f.names:
                if n in seen:
                    raise ValueError(f"{n} names two fields")
                seen.add(n)
        known = {f.name for f in self.fields}
        for c in self.checks:
            if not set(c.fields) <= known:
                raise ValueError(f"check {c.name} names an unknown field")

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def describe(self) -> str:
        return self.name

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark(), True, {"alias": f.external, "sensitive": f.sensitive}) for f in self.fields])


@dataclass(frozen=True)
class Tagged:
    """Exactly one branch, picked by the type and value of `tag`; branches don't declare the tag."""

    tag: str
    branches: tuple[tuple[Any, Contract], ...]

    def describe(self) -> str:
        return " | ".join(c.name for _, c in self.branches)

    def spark(self) -> T.StructType:
        tag = BOOL if isinstance(self.branches[0][0], bool) else INT if isinstance(self.branches[0][0], int) else STR
        return T.StructType([T.StructField(self.tag, tag.spark()), *[T.StructField(c.name, c.spark()) for _, c in self.branches]])


def derive(contract: Contract, include: tuple[str, ...] | None = None, exclude: tuple[str, ...] | None = None, mode: str = "", partial: bool = False) -> Contract:
    """Fewer fields, one direction, or all fields omittable; source order stays.

    Checks survive only if all their fields do, and a partial contract has
    none over several fields.  Input mode drops read-only fields, output mode
    write-only ones.
    """
    if include is not None and exclude is not None:
        raise ValueError("include and exclude exclude each other")
    for names in (include or ()), (exclude or ()):
        if len(set(names)) < len(names) or not set(names) <= {f.name for f in contract.fields}:
            raise ValueError(f"unknown or repeated field in {names}")
    kept = [f for f in contract.fields
            if (include is None or f.name in include) and (exclude is None or f.name not in exclude)
            and not (mode == "input" and f.read_only) and not (mode == "output" and f.write_only)]
    if partial:
        kept = [replace(f, default=MISSING, factory=None, omittable=True) for f in kept]
    names = {f.name for f in kept}
    checks = () if partial else tuple(c for c in contract.checks if set(c.fields) <= names)
    return replace(contract, fields=tuple(kept), checks=checks, partial=partial or contract.partial, origin=contract.origin or contract.name, mode=mode or contract.mode)


def has_exact(kind) -> bool:
    """Whether a type holds numbers that are carried as text."""
    if isinstance(kind, Scalar):
        return kind.exact
    if isinstance(kind, (Constrained, Many, Mapping)):
        return has_exact(kind.base if isinstance(kind, Constrained) else kind.item if isinstance(kind, Many) else kind.value)
    if isinstance(kind, Contract):
        return any(has_exact(t) for f in kind.fields for t in (f.type, f.raw) if t is not None)
    return any(map(has_exact, kind.items if isinstance(kind, Fixed) else kind.options if isinstance(kind, Union) else [c for _, c in kind.branches] if isinstance(kind, Tagged) else ()))
