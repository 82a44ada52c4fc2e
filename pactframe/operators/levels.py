"""Records nested to any depth, checked a level at a time: nodes are rows, and verdicts are folded from the leaves up.

`from_json` writes a contract out into one expression, which grows with its
nesting.  Here a nested record is a row of a table of its own: a level is
exploded from the one above, all nodes of a name are checked by one plan
whatever their depth, and only nodes that fail travel back to their parents.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactframe.contract import compiler as C
from pactframe.contract import model as M
from pactframe.contract.errors import ERRORS, REDACTED, Place, bounded_input, error, no_errors
from pactframe.functions.decode import decoded
from pactframe.operators import plain as P

_ENTRY = f"struct<slot:int,e:{ERRORS},t:boolean>"
#: Where a node is: of each node from the first level down, its field and place in the parent, how many steps that takes, and of the parent its path, name and shown value, and its location if the node's own hides it.
_STEP = "struct<slot:int,order:array<int>,len:int,up:string,parent:string,kind:string,shown:string,at:array<string>>"
#: Records a partition that the first level is dealt into: nodes are often alike, so bytes don't tell how many a file holds.
RECORDS = 20_000
_KID = "struct<order:array<int>,steps:array<string>,shown:string,name:string,hidden:boolean,v:variant>"
_NODE = ("rid", "location", "path", "chain", "name", "hidden", "v")


class Nodes(dict):
    """A table a kind, planned when it is asked for: verdicts need no values."""

    def __init__(self, names, table):
        super().__init__()
        self.names, self.table = list(names), table

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        self[name] = self.table(name)
        return self[name]


@dataclass(frozen=True)
class Levels:
    """What `check_levels` finds: a verdict a record, and the nodes by kind, whose values are their own fields."""

    verdicts: DataFrame
    nodes: Nodes


def _kept(df: DataFrame) -> DataFrame:
    """`v` as a list of one: a VARIANT by itself is shredded into columns by each write and put together again by each read."""
    return df.withColumn("v", F.array("v"))


def _held(df: DataFrame) -> DataFrame:
    """What `_kept` was given."""
    return df.withColumn("v", F.get("v", F.lit(0)))


def _once(value: Column) -> Column:
    """`value`, which filters on it (`explode` makes one itself) don't compute again below: a partition id keeps them above."""
    return F.when(F.spark_partition_id() >= 0, value)


def cut(contract: M.Contract) -> tuple[str, dict[str, object]]:
    """(name of the root, kinds by name) of a contract whose records inside lists and maps become nodes.

    Names are paths, so that two records of one name stay apart.
    """
    named: dict[str, object] = {}

    def turned(kind, path: str, inside: bool):
        if isinstance(kind, M.Contract) and kind.shape == "record":
            fields = tuple(replace(f, type=turned(f.type, f"{path}.{f.name}", False)) if not (f.load or f.transforms or f.checks) else f for f in kind.fields)
            own = replace(kind, fields=fields)
            if not inside:
                return own
            named[path] = own
            return M.Ref(path)
        if isinstance(kind, M.Many):
            return replace(kind, item=turned(kind.item, path, True))
        if isinstance(kind, M.Mapping):
            return replace(kind, value=turned(kind.value, path, True))
        if isinstance(kind, M.Constrained):
            return replace(kind, base=turned(kind.base, path, inside))
        if isinstance(kind, M.Union) and len([o for o in kind.options if o != M.NONE]) == 1:
            return replace(kind, options=tuple(o if o == M.NONE else turned(o, path, inside) for o in kind.options))
        return kind

    named[contract.name] = turned(contract, contract.name, False)
    return contract.name, named


def _refs(kind) -> bool:
    """Whether a kind holds nodes; those within records of its own are theirs to find."""
    if isinstance(kind, M.Constrained):
        return _refs(kind.base)
    if isinstance(kind, M.Union):
        return any(map(_refs, kind.options))
    if isinstance(kind, (M.Many, M.Mapping)):
        return _refs(kind.item if isinstance(kind, M.Many) else kind.value)
    if isinstance(kind, M.Contract):
        return any(_refs(f.type) for f in kind.fields)
    return isinstance(kind, M.Ref)


def _kids(kind, v: Column, hidden: bool, root: bool = False, order: tuple = (), steps: tuple = (), shown: tuple = ()) -> Column:
    """The nodes in a value: a list of (order, steps, shown steps, name, hidden, v), in order; steps are as in locations of errors, where a root's own names are never hidden.

    `order`, `steps` and `shown` lead to the value: a node is made once, with all of them.
    """
    empty = F.array().cast(f"array<{_KID}>")

    def node(name: str, v: Column, order: tuple, steps: tuple, shown: tuple) -> Column:
        return F.struct(F.array(*order).cast("array<int>").alias("order"), F.array(*steps).cast("array<string>").alias("steps"), (F.concat(*shown) if shown else F.lit("")).alias("shown"), F.lit(name).alias("name"), F.lit(hidden).alias("hidden"), v.alias("v"))

    if isinstance(kind, M.Constrained):
        return _kids(kind.base, v, hidden, False, order, steps, shown)
    if isinstance(kind, M.Ref):
        return F.when(v.isNotNull(), F.array(node(kind.name, v, order, steps, shown))).otherwise(empty)
    if isinstance(kind, M.Union):
        parts = []  # values of other shapes have no nodes
        for o in kind.options:
            if _refs(o):
                base = o.base if isinstance(o, M.Constrained) else o
                own = _kids(o, v, hidden, False, order, steps, shown)
                parts.append(F.when(F.is_variant_null(v), empty).otherwise(own) if isinstance(base, M.Ref) else own)
        return F.coalesce(F.concat(*parts), empty)
    if isinstance(kind, M.Many):
        items = F.try_variant_get(v, "$", "array<variant>")

        def item(x: Column, i: Column) -> Column:
            n = i.cast("string")
            at = ((*order, i), (*steps, n), (*shown, F.lit("["), n, F.lit("]")))
            return node(kind.item.name, x, *at) if isinstance(kind.item, M.Ref) else _kids(kind.item, x, hidden, False, *at)

        found = F.transform(items, item)
        return F.coalesce(found if isinstance(kind.item, M.Ref) else F.flatten(found), empty)
    if isinstance(kind, M.Mapping):
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        key = lambda e: F.lit(f'"{REDACTED}"') if hidden else F.concat(F.lit('"'), e["key"], F.lit('"'))
        text = lambda e: F.lit(f"[{REDACTED!r}]") if hidden else F.concat(F.lit("."), e["key"])
        return F.coalesce(F.flatten(F.transform(entries, lambda e, i: _kids(kind.value, e["value"], hidden, False, (*order, i), (*steps, key(e)), (*shown, text(e))))), empty)
    if isinstance(kind, M.Contract):
        parts = []
        for slot, f in enumerate(kind.fields):
            if _refs(f.type):
                own = F.coalesce(*[C.member(v, n) for n in f.names])
                covered = hidden or f.sensitive
                names, text = Place(((("name", "x"),) if not root else ()) + (("name", f.external),), covered).static()
                parts.append(_kids(f.type, own, covered, False, (*order, F.lit(slot)), (*steps, F.lit(names[-1])), (*shown, F.lit(text if root else text[1:]))))
        return F.concat(*parts) if parts else empty
    return empty


def _reached(root: str, named: dict[str, object]) -> dict[tuple[str, bool], None]:
    """(name, whether its names are hidden) of all nodes that there can be below the root, in order."""
    found: dict[tuple[str, bool], None] = {}

    def walk(kind, hidden: bool) -> None:
        if isinstance(kind, M.Constrained):
            walk(kind.base, hidden)
        elif isinstance(kind, M.Union):
            for o in kind.options:
                walk(o, hidden)
        elif isinstance(kind, (M.Many, M.Mapping)):
            walk(kind.item if isinstance(kind, M.Many) else kind.value, hidden)
        elif isinstance(kind, M.Contract):
            for f in kind.fields:
                walk(f.type, hidden or f.sensitive)
        elif isinstance(kind, M.Ref) and (kind.name, hidden) not in found:
            found[kind.name, hidden] = None
            walk(named[kind.name], hidden)

    walk(named[root], False)
    return found


def _covered(location: Column) -> tuple[Column, Column]:
    """The location and path of a node whose names are hidden, all but the first."""
    covered = F.transform(location, lambda s, i: F.when((i > 0) & s.startswith('"'), F.lit(f'"{REDACTED}"')).otherwise(s))
    shown = lambda s, i: F.when(~s.startswith('"'), F.concat(F.lit("["), s, F.lit("]"))).when(i == 0, F.regexp_replace(s, '^"|"$', "")).otherwise(F.lit(f"[{REDACTED!r}]"))
    return covered, F.array_join(F.transform(covered, shown), "")


def _sure(kid: Column, named: dict[str, object], names: list[str]) -> Column:
    """Whether a node that `_kids` finds is surely sound."""
    return F.coalesce(*[F.when(kid["name"] == n, P.surely(named[n], named, kid["v"])) for n in names], F.lit(False))


def _in_doubt(kids: Column, named: dict[str, object], names: list[str]) -> Column:
    """Of the nodes that `_kids` finds those that aren't surely sound."""
    return F.filter(kids, lambda k: ~_sure(k, named, names))


def _first_in_doubt(kids: Column, named: dict[str, object], name: str) -> Column:
    """The first of these; those after it aren't looked into."""
    return F.aggregate(kids, F.lit(None).cast(_KID), lambda found, k: F.when(found.isNotNull(), found).when(~_sure(k, named, [name]), k))


def _held_by(kind) -> list[str]:
    """Names of the nodes that a plain record holds itself."""
    if isinstance(kind, M.Ref):
        return [kind.name]
    if isinstance(kind, M.Contract):
        return [n for f in kind.fields for n in _held_by(f.type)]
    return _held_by(kind.base if isinstance(kind, M.Constrained) else kind.item) if isinstance(kind, (M.Constrained, M.Many)) else []


def _below(nodes: DataFrame, named: dict[str, object], reached, root: bool, in_doubt: bool = False) -> DataFrame:
    """The nodes one level below; with `in_doubt` without those that are surely sound, which have nothing to tell their parents."""
    out = None
    for name, hidden in reached:
        kind = named[name]
        if _refs(kind):
            own = nodes.where((F.col("name") == name) & (F.col("hidden") == hidden))
            record = isinstance(kind, M.Contract)
            # Once a node, not once for each below it: a value's text or shape takes a look at all that is in it.
            shape = F.when(F.try_variant_get("v", "$", "array<variant>").isNotNull(), "list").otherwise("dict") if isinstance(kind, M.Union) else F.lit(None).cast("string")
            kids = _kids(kind, F.col("v"), hidden, root)
            text = bounded_input(C.shown_json(F.col("v"))) if isinstance(kind, M.Union) and not hidden else F.lit(None).cast("string")
            own = own.select("rid", "location", "path", "chain", shape.alias("kind"), text.alias("text"), _once(_in_doubt(kids, named, _held_by(kind)) if in_doubt else kids).alias("kids"))
            found = own.select("rid", "location", "path", "chain", "kind", "text", F.explode("kids").alias("kid"))
            k = F.col("kid")
            turned = k["hidden"] & F.lit(not hidden)
            covered, covered_path = _covered(F.col("location"))
            location = F.concat(F.when(turned, covered).otherwise(F.col("location")), k["steps"])
            path = F.concat(F.when(turned, covered_path).otherwise(F.col("path")), k["shown"])
            slot = F.get(k["order"], F.lit(0)) if record else F.lit(0)
            step = F.struct(slot.alias("slot"), (F.slice(k["order"], 2, F.greatest(F.size(k["order"]) - 1, F.lit(0))) if record else k["order"]).alias("order"), F.size(k["steps"]).alias("len"), F.col("path").alias("up"),
                            F.lit(name).alias("parent"), F.col("kind"), F.col("text").alias("shown"), F.when(turned, F.col("location")).alias("at"))
            rows = found.select("rid", location.alias("location"), path.alias("path"), F.concat("chain", F.array(step.cast(_STEP))).alias("chain"), k["name"].alias("name"), k["hidden"].alias("hidden"), k["v"].alias("v"))
            out = rows if out is None else out.union(rows)
    return nodes.where("false") if out is None else out


def _judged(v: Column, kind, place: Place, ctx: C.Ctx) -> tuple[Column, Column, Column, Column, int]:
    """(whether a node is sound, its failing fields, what counts only if nothing else fails, its own fields, the level of stages) of a value."""
    cell = C.as_cell(v, ctx)
    none = F.array().cast(f"array<{_ENTRY}>")
    entry = lambda slot, e, t=None: F.struct(F.lit(slot).alias("slot"), e.alias("e"), (F.lit(False) if t is None else t).alias("t"))
    if isinstance(kind, M.Contract) and kind.shape == "record":
        keys, level = ctx.stage(F.map_keys(F.try_variant_get(cell.v, "$", "map<string,variant>")), cell.level)
        c = C.json_record(kind, replace(cell, level=level), place, ctx, keys)
        there = keys.isNotNull()
        base = len(place.parts)
        extra = F.filter(c.errors, lambda e: (e["code"] == "unexpected") & (F.size(e["location"]) == base + 1))
        fields = F.concat(F.array_compact(F.array(*[F.when(~ok, entry(k, e)) for k, (ok, e) in enumerate(c.values)])) if c.values else none, F.transform(extra, lambda e: entry(len(c.values), F.array(e))))
        wrong = C._type_error(kind, place, C.schema_kind(cell.s), C.shown_json(cell.v))
        good = F.coalesce(there & c.ok, F.lit(False))
        entries = F.when(~there, F.array(entry(0, wrong))).when(~c.ok, fields)
        late = F.when(there & ~c.ok & (F.size(fields) == 0), c.errors)
        value, level = c.value, c.level
    else:
        c = C.json_value(kind, cell, place, ctx)
        good, entries, late, value, level = c.ok, F.when(~c.ok, F.array(entry(0, c.errors))), F.lit(None).cast(ERRORS), c.value, c.level
    good, level = ctx.stage(F.coalesce(good, F.lit(False)), level)
    return good & (F.spark_partition_id() >= 0), F.when(~good, F.coalesce(entries, none)), F.when(~good, late), value, level  # see validate._staged


def _moved(errors: Column, location: Column, path: Column) -> Column:
    """Errors of a value called x as those of the node that is at a location."""
    under = lambda at: F.concat(location, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))))
    return F.transform(errors, lambda e: e.withField("location", under(e["location"])).withField("path", F.concat(path, F.substr(e["path"], F.lit(2)))).withField("locations", F.transform(e["locations"], under)))


def _moved_entries(entries: Column, late: Column, kind, hidden: bool, location: Column, path: Column) -> tuple[Column, Column]:
    """What `_judged` says as said of the node at a location, whose names a sensitive field hides."""
    slots = [k for k, f in enumerate(kind.fields) if f.sensitive] if isinstance(kind, M.Contract) and not hidden else []

    def moved(x: Column) -> Column:
        own = _moved(x["e"], location, path)
        return x.withField("e", F.when(x["slot"].isin(*slots), _moved(x["e"], *_covered(location))).otherwise(own) if slots else own)

    return F.transform(entries, moved), _moved(late, location, path)


def _node_place(hidden: bool, root: bool) -> Place:
    return Place() if root else Place((("name", "x"),), hidden)


def _checked(nodes: DataFrame, name: str, kind, hidden: bool, root: bool, max_errors: int, unsound: bool = False) -> DataFrame:
    """rid, location, path, chain, value (own fields; null if these fail), entries (failing fields) and late (what counts only if nothing else fails) of the nodes of one kind.

    With `unsound` those nodes that fail, as they are: what errors say is left to a second look at these.
    """
    ctx = C.Ctx(max_errors, C.Stages())
    good, entries, late, value, _ = _judged(F.col("v"), kind, _node_place(hidden, root), ctx)
    staged = ctx.stages.applied(nodes.where((F.col("name") == name) & (F.col("hidden") == hidden) & ((F.size("location") == 0) == root)))
    if unsound:
        return staged.select(*_NODE, good.alias("_good")).where("not _good").select(*_NODE)
    out = staged.select("rid", "location", "path", "chain", "name", F.when(good, value).alias("value"), entries.alias("entries"), late.alias("late"))
    if root:
        return out
    entries, late = _moved_entries(F.col("entries"), F.col("late"), kind, hidden, F.col("location"), F.col("path"))
    return out.withColumn("entries", entries).withColumn("late", late)


def _ended(entries: Column, late: Column, limit: int) -> Column:
    """(errors, cut) of a record's failing parts: at most `limit` of them; one that stopped early ends the record with its own errors."""
    first = F.slice(entries, 1, limit)
    stop = F.get(F.filter(first, lambda x: x["t"]), F.lit(0))
    errors = F.when(F.size(entries) == 0, F.coalesce(late, no_errors())).when(stop.isNotNull(), stop["e"]).otherwise(F.flatten(F.transform(first, lambda x: x["e"])))
    return F.struct(errors.alias("errors"), (stop.isNotNull() | (F.size(entries) >= limit)).alias("cut"))


def _union_error(kind: M.Union, step: Column, errors: Column, path: Column, location: Column) -> Column:
    """What a union says if its only fitting option holds a node that fails."""
    shown = F.when(path == "", "<root>").otherwise(path)
    told = F.to_json(F.transform(errors, lambda e: F.struct(e["code"].alias("code"), e["path"].alias("path"))))
    branches = []
    for o in kind.ordered():
        if o == M.NONE:
            continue
        base = o.base if isinstance(o, M.Constrained) else o
        fits = {M.Many: "list", M.Mapping: "dict", M.Contract: "dict"}.get(type(base))
        code = "literal" if isinstance(base, M.Literal) and not isinstance(base, M.Enum) else "type"
        other = F.to_json(F.array(F.struct(F.lit(code).alias("code"), shown.alias("path"))))
        said = F.when(step["kind"] == fits, told).otherwise(other) if fits and _refs(o) else other
        branches.append(F.struct(F.lit(o.describe()).alias("label"), said.alias("errors_json")))
    bad = error("union", Place(), expected=kind.describe(), received=step["kind"], value=step["shown"], branches=F.array(*branches))
    return F.array(bad.withField("location", location).withField("path", shown))


def _by_paths(records: DataFrame, root: str, named: dict[str, object], limit: int) -> DataFrame:
    """Adds errors, cut and left to records of a plain contract (see `plain.straight`) that may be unsound.

    Of a list the first failing item counts, so that a record's failing nodes
    are one for each list that is a field of another: these are columns of
    its row.  If one of them that is in doubt doesn't fail, another item may
    or none: these records are left.
    """
    df, made, none = records, [], F.array().cast(f"array<{_ENTRY}>")

    def one_of(name: str, alone: Column):
        """The first in doubt; if a node's doubt can come from a single one only, that one."""
        return lambda kids: F.when(alone & (F.size(kids) == 1), F.get(kids, F.lit(0))).otherwise(_first_in_doubt(kids, named, name))

    def find(n: int, name: str, hidden: bool, location: Column, path: Column) -> tuple:
        nonlocal df
        kind, below = named[name], []
        held = [(k, f) for k, f in enumerate(kind.fields) if _refs(f.type)]
        df = df.withColumn(f"_alone{n}", P.surely_alone(kind, F.col(f"_v{n}")))
        for k, f in held:
            made.append(k)
            c, covered = len(made), hidden or f.sensitive
            at, shown = (location, path) if hidden or not covered else _covered(location)
            kid, own = F.col(f"_kid{c}"), replace(kind, fields=tuple(replace(x, type=M.STR) if x is not f else x for x in kind.fields))
            df = df.withColumn(f"_kid{c}", C._let(_kids(own, F.col(f"_v{n}"), hidden, n == 0), one_of(_held_by(f.type)[0], F.col(f"_alone{n}") & F.lit(len(held) == 1))))
            df = df.select(*[x for x in df.columns if x != f"_kid{c}"], kid["v"].alias(f"_v{c}"), F.concat(at, kid["steps"]).alias(f"_at{c}"), F.concat(shown, kid["shown"]).alias(f"_path{c}"))
            below.append((k, find(c, _held_by(f.type)[0], covered, F.col(f"_at{c}"), F.col(f"_path{c}"))))
        return n, kind, hidden, below

    df = df.withColumn("_v0", F.col("v"))
    tree = find(0, root, False, F.array().cast("array<string>"), F.lit(""))

    def judge(node: tuple) -> None:
        nonlocal df
        n, kind, hidden, below = node
        ctx, before = C.Ctx(limit, C.Stages()), [c for c in df.columns if c not in (f"_v{n}", f"_at{n}", f"_path{n}", f"_alone{n}")]
        df = df.withColumn(f"_there{n}", F.col(f"_v{n}").isNotNull()).withColumn(f"_v{n}", F.when(~F.col(f"_alone{n}"), F.col(f"_v{n}")))
        good, entries, late, _, _ = _judged(F.col(f"_v{n}"), kind, _node_place(hidden, n == 0), ctx)
        fails = F.col(f"_v{n}").isNotNull() & ~good
        if n:
            entries, late = _moved_entries(entries, late, kind, hidden, F.col(f"_at{n}"), F.col(f"_path{n}"))
        # A node after another: the stages of all at once are more than one method that is compiled.
        df = ctx.stages.applied(df)
        # What counts late is looked for only where no field fails.
        df = df.select("*", F.when(fails, entries).alias(f"_own{n}")).select(*before, f"_there{n}", f"_own{n}", F.when(F.size(f"_own{n}") == 0, late).alias(f"_late{n}"))
        for _, kid in below:
            judge(kid)

    judge(tree)

    def fold(node: tuple) -> None:
        nonlocal df
        n, _, _, below = node
        for _, kid in below:
            fold(kid)
        mine = F.coalesce(f"_own{n}", none)
        slots = F.transform(mine, lambda x: x["slot"])
        rest = F.array_compact(F.array(*[F.when(F.col(f"_f{kid[0]}").isNotNull() & ~F.array_contains(slots, k), F.struct(F.lit(k).alias("slot"), F.col(f"_f{kid[0]}.errors").alias("e"), F.col(f"_f{kid[0]}.cut").alias("t")).cast(_ENTRY)) for k, kid in below])) if below else none
        df = df.withColumn(f"_all{n}", F.array_sort(F.concat(mine, rest), lambda a, b: a["slot"] - b["slot"]) if below else mine)
        failing = F.col(f"_own{n}").isNotNull() | (F.size(f"_all{n}") > 0)
        df = df.withColumn(f"_f{n}", F.when(failing, _ended(F.col(f"_all{n}"), F.col(f"_late{n}"), limit)))

    fold(tree)
    left = functools.reduce(lambda a, b: a | b, [F.col(f"_there{n}") & F.col(f"_f{n}").isNull() for n in range(len(made) + 1)])
    return df.select(*records.columns, F.col("_f0.errors").alias("errors"), F.col("_f0.cut").alias("cut"), left.alias("left"))


def _wrapping(kind: M.Union, path: Column, location: Column):
    return lambda x: x.withField("e", _union_error(kind, F.col("_step"), x["e"], path, location))


def _up(failing: DataFrame, own: DataFrame, named: dict[str, object], limit: int) -> DataFrame:
    """Failing nodes of a level, from those below it and those that fail by themselves.

    Of a list the first node that fails counts.  Children of one parent and
    field are reduced where they are before they move.
    """
    last = F.element_at("chain", -1)
    parent = F.coalesce(last["at"], F.slice("location", F.lit(1), F.size("location") - last["len"]))
    below = failing.select("rid", parent.alias("_parent"), last["slot"].alias("slot"), last["order"].alias("order"),
                           F.struct("errors", "cut", F.slice("chain", F.lit(1), F.size("chain") - 1).alias("chain"), last.alias("step")).alias("f"))
    first = below.groupBy("rid", "_parent", "slot").agg(F.min_by("f", "order").alias("f"))
    child = first.groupBy("rid", "_parent").agg(F.collect_list(F.struct("slot", F.col("f.errors").alias("e"), F.col("f.cut").alias("t")).cast(_ENTRY)).alias("_below"), F.first("f.chain").alias("_chain"), F.first("f.step").alias("_step"))
    both = own.join(child.withColumnRenamed("rid", "_rid"), (F.col("rid") == F.col("_rid")) & (F.col("location") == F.col("_parent")), "full_outer")
    none = F.array().cast(f"array<{_ENTRY}>")
    mine = F.coalesce("entries", none)
    slots = F.transform(mine, lambda x: x["slot"])
    unions = {n: k for n, k in named.items() if isinstance(k, M.Union)}
    names = F.coalesce(F.col("name"), F.col("_step.parent"))
    given = F.coalesce("_below", none)
    rest = F.filter(given, lambda x: ~F.array_contains(slots, x["slot"]))
    where, path = F.coalesce("location", "_parent"), F.coalesce("path", F.col("_step.up"))
    for n, k in unions.items():
        rest = F.when(names == n, F.transform(rest, _wrapping(k, path, where))).otherwise(rest)
    entries = F.array_sort(F.concat(mine, rest), lambda a, b: a["slot"] - b["slot"])
    staged = both.select(F.coalesce("rid", "_rid").alias("rid"), where.alias("location"), path.alias("path"), F.coalesce("chain", "_chain").alias("chain"), names.alias("name"), entries.alias("entries"), "late")
    return staged.withColumn("f", _ended(F.col("entries"), F.col("late"), limit)).select("rid", "location", "path", "chain", "name", "f.errors", "f.cut")


def _spread(records: DataFrame) -> DataFrame:
    """Records dealt by their number: alike, they are few bytes."""
    rows = records.count()
    return records if records.rdd.getNumPartitions() * RECORDS >= rows else records.repartition(-(-rows // RECORDS))


def _levels(records: DataFrame, named: dict[str, object], root: str, reached, max_depth: int, path: str, in_doubt: bool) -> int:
    """Writes the nodes of records a level at a time; the last level that there is, `max_depth` + 1 if there is one that deep."""
    spark = records.sparkSession
    start = records.select("rid", F.array().cast("array<string>").alias("location"), F.lit("").alias("path"), F.array().cast(f"array<{_STEP}>").alias("chain"), F.lit(root).alias("name"), F.lit(False).alias("hidden"), "v")
    _kept(start.select(*_NODE)).write.parquet(f"{path}/level=0")
    depth = 0
    while depth <= max_depth:
        _kept(_below(_held(spark.read.parquet(f"{path}/level={depth}")), named, {(root, False): None} if not depth else reached, not depth, in_doubt).select(*_NODE)).write.parquet(f"{path}/level={depth + 1}")
        if spark.read.parquet(f"{path}/level={depth + 1}").isEmpty():
            break
        depth += 1
    return depth


def _failing(records: DataFrame, named: dict[str, object], root: str, reached, kinds: list, max_errors: int, max_depth: int, path: str, in_doubt: bool) -> DataFrame:
    """_rid, errors and cut of the records that fail, by levels."""
    spark = records.sparkSession
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    depth = _levels(records, named, root, reached, max_depth, f"{path}/nodes", in_doubt)
    nodes = _held(read("nodes")).where(F.col("level") <= max_depth)
    for name, hidden, top in kinds:
        own = nodes.where(F.col("level") == 0 if top else F.col("level") > 0).drop("level")
        _kept(_checked(own, name, named[name], hidden, top, max_errors, unsound=True)).write.mode("append").parquet(f"{path}/unsound")
    unsound, bad = _held(read("unsound")), None
    for name, hidden, top in kinds:
        own = _checked(unsound, name, named[name], hidden, top, max_errors).where("entries is not null").select("rid", "location", "path", "chain", "name", "entries", "late", F.size("chain").alias("level"))
        bad = own if bad is None else bad.unionByName(own)
    bad.write.parquet(f"{path}/bad")
    bad = read("bad")
    if depth > max_depth:
        deep = error("depth", Place(), context={"limit": max_depth})
        failing = read(f"nodes/level={depth}").select("rid", "location", "path", "chain", "name", F.array(deep.withField("location", F.col("location")).withField("path", F.col("path"))).alias("errors"), F.lit(False).alias("cut"))
    else:
        ended = bad.where(F.col("level") == depth).withColumn("f", _ended(F.col("entries"), F.col("late"), max_errors))
        failing = ended.select("rid", "location", "path", "chain", "name", "f.errors", "f.cut")
    failing.write.parquet(f"{path}/failing/level={depth}")
    for level in range(depth - 1, -1, -1):
        _up(spark.read.parquet(f"{path}/failing/level={level + 1}"), bad.where(F.col("level") == level).drop("level"), named, max_errors).write.parquet(f"{path}/failing/level={level}")
    return spark.read.parquet(f"{path}/failing/level=0").select(F.col("rid").alias("_rid"), "errors", "cut")


def check_levels(df: DataFrame, column: str, root: str, named: dict[str, object], keys: list[str], path: str, max_errors: int = 100, max_depth: int = 64) -> Levels:
    """Strict JSON texts against kinds that name one another by `M.Ref`, to `max_depth` levels of nodes below the root.

    `named` has records and unions by name; records may hold nodes in fields,
    options, lists and maps.  Verdicts have keys, errors, truncated, nodes and
    depth, one row a row of `df`, in the order of errors of `from_json`: all
    failing fields of a record, of a list the first failing item, and of a
    union one error with its options'.  A record's own checks count only if
    nothing inside it fails.  Deeper nodes fail with code `depth`.  Levels are
    written below `path`, in a folder that driver and executors share, so
    that lost executors cost a level; a list of millions of records is that
    many rows.  Of plain contracts (see `plain`) only what isn't surely sound
    goes by levels, until nodes are asked for.  Null texts are no JSON; `keys` needn't be unique; an empty
    table has no verdicts.
    """
    for name, kind in named.items():
        if M.has_exact(kind):
            raise ValueError(f"{name}: numbers carried as text aren't kept by levels")
        if isinstance(kind, M.Contract) and any(isinstance(f.type, M.Union) and _refs(f.type) and len([o for o in f.type.options if o != M.NONE]) > 1 for f in kind.fields):
            raise ValueError(f"{name}: give a union with nodes a name of its own")
        if isinstance(kind, M.Union) and any(isinstance(o, M.Ref) for o in kind.options):
            raise ValueError(f"{name}: an option that is a node itself needs a list, a map or a record around it")
    spark = df.sparkSession
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    found = decoded(df.select(*keys, F.col(column).alias("_pf_text")), "_pf_text", "_verdict", "v").select(*keys, F.monotonically_increasing_id().alias("rid"), F.struct("_verdict.code", "_verdict.key").alias("_verdict"), "v")
    plain = P.plain(M.Ref(root), named, min(P.DEPTH, max_depth))
    if plain:
        below, deepest = (P.nodes(named[root], named, F.col("_typed"), levels) for levels in (False, True))
        found = found.withColumn("_typed", F.try_variant_get("v", "$", P.typed(named[root], named)))
        found = found.select(*keys, "rid", "_verdict", "v", P.surely(named[root], named, F.col("v"), F.col("_typed")).alias("_sure"), *[F.when(F.col("v").isNotNull(), n).alias(c) for n, c in ((below + 1, "nodes"), (deepest, "depth"))])
    _kept(found).write.parquet(f"{path}/records")
    records, reached = _held(read("records")), _reached(root, named)
    parsed = records.where("_verdict.code is null")
    open_ = parsed.where("not _sure") if plain else parsed
    straight = plain and P.straight(named[root], named)
    if straight:
        _by_paths(_spread(open_), root, named, max_errors).withColumn("v", F.when(F.col("left"), F.array("v"))).write.parquet(f"{path}/paths")
        open_ = _held(read("paths")).where("left").drop("errors", "cut", "left")
    kinds = [*[(n, h, False) for n, h in reached], (root, False, True)]
    failing = None if straight and open_.isEmpty() else _failing(_spread(open_) if plain else _spread(records).where("_verdict.code is null"), named, root, reached, kinds, max_errors, max_depth, path, plain)
    code = F.col("_verdict.code")
    invalid = error("json_invalid", Place()).withField("context", F.create_map(F.lit("reason"), code))
    duplicate = error("json_duplicate", Place()).withField("context", F.create_map(F.lit("key"), F.col("_verdict.key")))
    errors = F.when(code == "duplicate_key", F.array(duplicate)).when(code.isNotNull(), F.array(invalid)).otherwise(F.coalesce("errors", no_errors()))
    known, nodes = records.drop("v"), None if straight else _held(read("nodes")).where(F.col("level") <= max_depth)
    # Errors are alike, so that their files are a small part of what they take in memory: never to be broadcast.
    if plain:
        doubt = code.isNull() & ~F.col("_sure")
        found = [known.where(~doubt), *([read("paths").where("not left").drop("v", "left")] if straight else [])]
        if failing is not None:
            found.append((read("paths").where("left").drop("v", "errors", "cut", "left") if straight else known.where(doubt)).join(failing.hint("merge"), F.col("rid") == F.col("_rid"), "left"))
        known = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    else:
        counts = nodes.groupBy(F.col("rid").alias("_node")).agg(F.count("*").alias("nodes"), F.max("level").alias("depth"))
        known = known.join(failing.hint("merge"), F.col("rid") == F.col("_rid"), "left").join(counts.hint("merge"), F.col("rid") == F.col("_node"), "left")
    verdicts = known.select(*keys, errors.alias("errors"), F.coalesce("cut", F.lit(False)).alias("truncated"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
    own = records.select("rid", *keys)

    @functools.cache
    def every() -> DataFrame:
        if not plain:
            return nodes.drop("level")
        _levels(_spread(parsed), named, root, reached, max_depth, f"{path}/every", False)
        return _held(read("every")).drop("level")

    def shown(name: str) -> DataFrame:
        parts = [_checked(every(), n, named[n], h, top, max_errors).where("entries is null").select(F.col("rid").alias("_rid"), "location", "path", F.size("chain").alias("level"), "value") for n, h, top in kinds if n == name]
        return own.join(functools.reduce(DataFrame.union, parts), F.col("rid") == F.col("_rid")).select(*keys, "location", "path", "level", "value")

    return Levels(verdicts, Nodes([n for n, _, _ in kinds], shown))


def from_json_levels(df: DataFrame, column: str, contract: M.Contract, keys: list[str], path: str, max_errors: int = 100, max_depth: int = 64) -> Levels:
    """`check_levels` of an ordinary contract: each record in a list or map is a node, however deep they are nested."""
    root, named = cut(contract)
    return check_levels(df, column, root, named, keys, path, max_errors, max_depth)
