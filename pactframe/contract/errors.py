"""Errors as data: one struct per failure, with a stable code, a location and a sentence."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = ("struct<code:string,location:array<string>,path:string,message:string,expected:string,received:string,input:string,"
         "context:map<string,string>,hook:string,stage:string,locations:array<array<string>>,branches:array<struct<label:string,errors_json:string>>,"
         "discriminator:string,expected_tags:array<string>,conflicting_names:array<string>>")
ERRORS = f"array<{ERROR}>"
REDACTED = "<redacted>"
#: Longest text of an input in an error, and what stands for the rest.
INPUT_LENGTH, TRUNCATION = 160, "... <truncated>"

# The sentence of each code; {x} is the context's value of that name.
MESSAGES = {
    "type": "Expected {expected}",
    "literal": "Expected {expected}",
    "union": "Expected one of: {expected}",
    "missing": "Required field is missing",
    "unexpected": "Unexpected field",
    "alias_conflict": "Multiple accepted names were supplied for one field",
    "greater_than": "Expected value > {limit}",
    "greater_than_or_equal": "Expected value >= {limit}",
    "less_than": "Expected value < {limit}",
    "less_than_or_equal": "Expected value <= {limit}",
    "multiple_of": "Expected a multiple of {multiple_of}",
    "min_length": "Expected length >= {minimum}",
    "max_length": "Expected length <= {maximum}",
    "pattern": "Expected a match for pattern {pattern}",
    "transform": "Transform {hook} rejected the input",
    "field_check": "Field check {hook} rejected the value",
    "spec_check": "Spec check {hook} rejected the values",
    "factory": "Default factory failed",
    "representation_load": "Representation loader rejected the input",
    "representation_result": "Representation loader returned a value outside {expected}",
    "json_invalid": "Invalid JSON input",
    "json_duplicate": "Duplicate JSON object key",
    "discriminator_missing": "Required discriminator {discriminator} is missing",
    "depth": "Input is nested deeper than {limit} levels",
    "discriminator_unknown": "Unknown discriminator {discriminator}; expected one of {tags}",
}


def message(code: str, **facts) -> str:
    quoted = {k: repr(v) if k in ("hook", "discriminator", "pattern") else v for k, v in facts.items()}
    return MESSAGES[code].format_map(quoted)


class Place:
    """A location under construction: static names and columns of indexes or keys."""

    def __init__(self, parts: tuple = (), redacted: bool = False):
        self.parts, self.redacted = parts, redacted

    def field(self, name: str) -> Place:
        return Place((*self.parts, ("name", name)), self.redacted)

    def index(self, at: Column) -> Place:
        return Place((*self.parts, ("index", at)), self.redacted)

    def key(self, key: Column) -> Place:
        return Place((*self.parts, ("key", key)), self.redacted)

    def sensitive(self) -> Place:
        return Place(self.parts, True)

    def static(self) -> tuple[list[str], str] | None:
        """Location and path, if no part of them is a column."""
        if any(not isinstance(at, str) for _, at in self.parts):
            return None
        shown = [REDACTED if self.redacted and k else at for k, (_, at) in enumerate(self.parts)]
        path = "".join(at if not k else f"[{at!r}]" if not at.isidentifier() else f".{at}" for k, at in enumerate(shown))
        return [json.dumps(at, ensure_ascii=False) for at in shown], path if shown else "<root>"

    def location(self) -> Column:
        if not self.parts:
            return F.array().cast("array<string>")
        out = []
        for k, (kind, at) in enumerate(self.parts):
            if kind == "index":
                out.append(at.cast("string"))
            elif self.redacted and k:
                out.append(F.lit(json.dumps(REDACTED)))
            else:
                out.append(F.lit(json.dumps(at, ensure_ascii=False)) if kind == "name" else F.concat(F.lit('"'), at, F.lit('"')))
        return F.array(*out)

    def path(self) -> Column:
        out: list[Column] = []
        text = ""
        for k, (kind, at) in enumerate(self.parts):
            if kind == "index":
                out += [F.lit(text + "["), at.cast("string")]
                text = "]"
            elif self.redacted and k:
                text += f"[{REDACTED!r}]"
            elif kind == "name":
                text += f".{at}" if k and at.isidentifier() else f"[{at!r}]" if k else at
            else:
                out += [F.lit(text + ("." if k else "")), at]
                text = ""
        out.append(F.lit(text))
        return F.concat(*out) if self.parts else F.lit("<root>")


def safe_text(text: Column) -> Column:
    """Line ends, tabs and all other control, format, private and unassigned characters as escapes."""
    code = lambda c: F.lower(F.hex(F.ascii(c)))
    escaped = lambda c: F.when(F.ascii(c) < 0x100, F.concat(F.lit("\\x"), F.lpad(code(c), 2, "0"))).when(F.ascii(c) < 0x10000, F.concat(F.lit("\\u"), F.lpad(code(c), 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(code(c), 8, "0")))
    shown = lambda c: F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c.rlike(r"^\p{C}"), escaped(c)).otherwise(c)
    return F.when(text.rlike(r"\p{C}"), F.array_join(F.transform(F.split(text, ""), shown), "")).otherwise(text)


def bounded_input(value: Column) -> Column:
    """A value's text, cut to INPUT_LENGTH characters."""
    text = value.cast("string")
    cut = F.concat(F.substring(text, 1, INPUT_LENGTH - len(TRUNCATION)), F.lit(TRUNCATION))
    return F.when(F.length(text) > INPUT_LENGTH, cut).otherwise(text)


def _quoted(value: object) -> str:
    """A SQL literal of a text, or null."""
    if value is None:
        return "cast(null as string)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: list | None, kind: str = "array<string>") -> str:
    return f"cast(null as {kind})" if values is None else f"cast(array({', '.join(map(_quoted, values))}) as {kind})"


def error(code: str, place: Place, *, expected: str | None = None, received: Column | str | None = None, value: Column | None = None, context: dict | None = None, hook: str | None = None,
          stage: str | None = None, related: list[Place] | None = None, branches: Column | None = None, discriminator: str | None = None, tags: list | None = None, names: Column | None = None) -> Column:
    """One error struct, of the type ERROR: what the contract settles is one literal, only the rest are columns."""
    facts = {str(k): str(v) for k, v in (context or {}).items()}
    text = message(code, expected=expected, hook=hook, discriminator=discriminator, tags=", ".join(map(repr, tags or [])), **(context or {}))
    mapped = f"map({', '.join(_quoted(x) for kv in facts.items() for x in kv)})" if facts else "cast(null as map<string,string>)"
    settled = all(p.static() is not None for p in related or [])
    where = f"array({', '.join(_list(p.static()[0]) for p in related)})" if related and settled else "cast(null as array<array<string>>)"
    fixed = place.static()
    out = F.expr(f"""named_struct('code', {_quoted(code)}, 'location', {_list(fixed[0] if fixed else [])}, 'path', {_quoted(fixed[1] if fixed else '')}, 'message', {_quoted(text)},
        'expected', {_quoted(expected)}, 'received', {_quoted(received if isinstance(received, str) else None)}, 'input', {_quoted(REDACTED if value is not None and place.redacted else None)},
        'context', {mapped}, 'hook', {_quoted(hook)}, 'stage', {_quoted(stage)}, 'locations', {where}, 'branches', cast(null as array<struct<label:string,errors_json:string>>),
        'discriminator', {_quoted(discriminator)}, 'expected_tags', {_list(tags)}, 'conflicting_names', cast(null as array<string>))""")
    if fixed is None:
        out = out.withField("location", place.location()).withField("path", place.path())
    if not settled:
        out = out.withField("locations", F.array(*[p.location() for p in related]))
    for field, column in (("received", received if isinstance(received, Column) else None), ("input", None if value is None or place.redacted else bounded_input(value)), ("branches", branches), ("conflicting_names", names)):
        if column is not None:
            out = out.withField(field, column)
    return out


def no_errors() -> Column:
    return F.array().cast(ERRORS)


def first_of(errors: Column) -> Column:
    return F.slice(errors, 1, 1)
