"""Nested records by levels, files in order, prefix sums, streams at their limits, hooks in Python, patches one by one."""

import gzip
import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.contract import model as M
from pactframe.contract.model import Check, Contract, Field, constrained, derive, optional
from pactframe.operators import budgets, levels
from pactframe.operators.hooks import python_hook
from pactframe.operators.levels import check_levels, from_json_levels
from pactframe.operators.patches import apply_in_order
from pactframe.operators.routing import dispatch
from pactframe.operators.validate import error_patterns, from_json
from pactframe.sources import jsonl
from pactframe.streaming.stream import continued, patch_stream, patched, versions

TEXTS = "id int, t string"
LEAF = Contract("Leaf", (Field("n", constrained(M.INT, ge=0)), Field("s", M.STR, default="x")), checks=(Check("small", ("n", "s"), lambda n, s: n < 90),))
MIDDLE = Contract("Middle", (Field("a", M.INT, alias="A"), Field("leaves", constrained(M.Many(LEAF), max_length=3)), Field("by", M.Mapping(LEAF), default=None)))
TOP = Contract("Top", (Field("name", M.STR), Field("secret", M.Many(MIDDLE), sensitive=True, default=None), Field("rows", M.Many(M.Many(MIDDLE)), default=None), Field("one", optional(LEAF), default=None)),
               checks=(Check("named", ("name",), lambda n: n != "bad"),))


def random_value(rng, kind):
    """A value that mostly fits."""
    if rng.random() < 0.04:
        return rng.choice([None, 1, "x", [], {}, [1], {"q": 1}])
    if kind is LEAF:
        out = {"n": rng.choice([1, 2, 50, 95, -1, "x"] if rng.random() < 0.3 else [1, 2])}
        if rng.random() < 0.1:
            out["zz"] = 1
        return out
    if kind is MIDDLE:
        out = {"A": 1, "leaves": [random_value(rng, LEAF) for _ in range(rng.randrange(4 if rng.random() < 0.9 else 6))]}
        if rng.random() < 0.4:
            out["by"] = {k: random_value(rng, LEAF) for k in rng.sample(["k", "l", "m m"], 2)}
        return out
    out = {"name": rng.choice(["a", "b", "bad"])}
    if rng.random() < 0.5:
        out["secret"] = [random_value(rng, MIDDLE) for _ in range(rng.randrange(3))]
    if rng.random() < 0.6:
        out["rows"] = [[random_value(rng, MIDDLE) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(3))]
    if rng.random() < 0.4:
        out["one"] = random_value(rng, LEAF)
    return out


def told(rows):
    return {r["id"]: ([(e["path"], e["code"], list(e["location"]), e["input"], e["hook"]) for e in r["errors"]], r["truncated"]) for r in rows}


@pytest.mark.parametrize("max_errors", [100, 2])
def test_levels_say_what_one_expression_says(spark, tmp_path, max_errors):
    """Lists in lists, maps, hidden names, aliases, lengths, checks and early ends, on random texts."""
    rng = random.Random(7)
    texts = [json.dumps(random_value(rng, TOP)) for _ in range(250)] + ["nope", None, '{"name":"a","name":"b"}', "[]", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    want = told(from_json(df, "t", TOP, max_errors, keep=["id"]).collect())
    got = told(from_json_levels(df, "t", TOP, ["id"], str(tmp_path / "levels"), max_errors).verdicts.collect())
    wrong = [(texts[k], got[k], want[k]) for k in want if got[k] != want[k]]
    assert not wrong, wrong[:2]
    assert sum(bool(e) for e, _ in want.values()) > 50


def test_sixty_four_levels_and_one_more(spark, tmp_path):
    tree = Contract("Tree", (Field("v", M.INT), Field("c", M.Many(M.Ref("Tree")), default=None)))
    deep = lambda n, leaf: '{"v":1,"c":[' * n + leaf + "]}" * n
    rows = [(0, deep(64, '{"v":1}')), (1, deep(64, '{"v":"x"}')), (2, deep(65, '{"v":1}')), (3, '{"v":1,"c":[' + ",".join(['{"v":2}'] * 3000) + "]}")]
    done = check_levels(spark.createDataFrame(rows, TEXTS), "t", "Tree", {"Tree": tree}, ["id"], str(tmp_path / "levels"))
    got = {r["id"]: ([(e["path"], e["code"]) for e in r["errors"]], r["nodes"], r["depth"]) for r in done.verdicts.collect()}
    path = ".".join(["c[0]"] * 64)
    assert got == {0: ([], 65, 64), 1: ([(path + ".v", "type")], 65, 64), 2: ([(path + ".c[0]", "depth")], 65, 64), 3: ([], 3001, 1)}
    assert done.nodes["Tree"].where("id = 3 and value.v = 2").count() == 3000
    with pytest.raises(ValueError):
        check_levels(spark.createDataFrame(rows, TEXTS), "t", "R", {"R": M.Union((M.INT, M.Ref("R")))}, ["id"], str(tmp_path / "no"))


def test_levels_of_an_empty_table(spark, tmp_path):
    assert from_json_levels(spark.createDataFrame([], TEXTS), "t", TOP, ["id"], str(tmp_path / "levels")).verdicts.count() == 0


@pytest.mark.parametrize("split", ["64m", "4k"])
def test_files_in_order_with_marks_plain_or_packed(spark, tmp_path, split):
    """Small and incompressible packed files, names with spaces, files without a last line end, more splits than files."""
    mark, made = b"\xef\xbb\xbf", []
    lines = lambda f, n: b"".join(b'{"f":%d,"i":%d}\n' % (f, k) for k in range(n))
    files = {"a.jsonl": mark + lines(0, 3000), "b.jsonl.gz": mark + lines(1, 2), "c.jsonl.gz": lines(2, 2), "d e.jsonl": lines(3, 2)[:-1], "f.jsonl.gz": lines(4, 3000), "g h.jsonl.gz": mark + lines(5, 3000), "i.jsonl.bz2": mark + lines(6, 3)}
    for name, body in files.items():
        packed = gzip.compress(body) if name.endswith("gz") else __import__("bz2").compress(body) if name.endswith("bz2") else body
        (tmp_path / name).write_bytes(packed)
        made += [(body.startswith(mark) and k == 0, t.decode()) for k, t in enumerate(body.removeprefix(mark).removesuffix(b"\n").split(b"\n"))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        done = jsonl.indexed(jsonl.read_lines(spark, str(tmp_path)))
        plan = done._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["item_index"], r["headed"], r["value"]) for r in done.select("item_index", "headed", "value").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, *m) for k, m in enumerate(made)]
    assert "BroadcastHashJoin" in plan and not any("Exchange" in x and "value#" in x for x in plan.split("\n"))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_sums_with_ties_nulls_and_any_number_of_parts(spark, parts):
    rows = [(k % 3 if k % 2 else 7, k, None if k % 5 == 0 else k) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, id int, v long").repartition(6)
    got = budgets.running_sums(df, ["k", "id"], {"s": F.col("v"), "n": F.lit(1)}, parts).collect()
    want, total = {}, 0
    for n, (_, i, v) in enumerate(sorted(rows), 1):
        total += v or 0
        want[i] = (total, n)
    assert {r["id"]: (r["s"], r["n"]) for r in got} == want
    index = budgets.item_index(df, "k", parts).collect()
    assert sorted(r["item_index"] for r in index) == list(range(2000))
    assert [r["k"] for r in sorted(index, key=lambda r: r["item_index"])] == sorted(k for k, *_ in rows)


def test_a_stream_delivers_what_comes_before_its_limit(spark, tmp_path):
    """Two batches; the limit falls into the second; a rerun writes and fails alike."""
    source = tmp_path / "in"
    contract = Contract("K", (Field("k", M.INT),))

    def write(batch, ids):
        spark.createDataFrame([(i, '{"k":"x"}' if i % 4 == 0 else '{"k":1}') for i in ids], "i long, t string").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        lines = spark.readStream.schema("i long, t string").parquet(str(source))
        done = from_json(lines, "t", contract, keep=["i"])
        return continued(done, ["i"], str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check"), max_invalid=4, max_items=100, state_path=str(tmp_path / "state"), order="i")

    write(0, range(1, 10))
    run().awaitTermination()
    write(1, range(10, 30))
    for _ in range(2):
        with pytest.raises(StreamingQueryException, match="invalid_items: limit 4, observed 5"):
            run().awaitTermination()
        read = lambda p: sorted(r["i"] for r in spark.read.parquet(str(tmp_path / p)).collect())
        assert read("good") == [i for i in range(1, 20) if i % 4] and read("bad") == [4, 8, 12, 16]


def test_a_patched_table_drops_dead_versions(spark, tmp_path):
    c = Contract("C", (Field("key", M.INT, read_only=True), Field("v", M.INT)))
    patch = derive(c, mode="input", partial=True)
    base, out = str(tmp_path / "base"), str(tmp_path / "out")
    spark.createDataFrame([(k, 0) for k in range(40)], "key long, v long").write.parquet(base)
    for n in range(6):
        spark.createDataFrame([(k, n, json.dumps({"v": n * 100 + k})) for k in range(n, 40, 3)], "key long, seq long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema("key long, seq long, t string").parquet(str(tmp_path / "in"))
        patch_stream(from_json(lines, "t", patch, keep=["key", "seq"]), base, out, "key", "seq", c, patch, str(tmp_path / "check"), parts=4).awaitTermination()
        assert len(versions(spark, out)) <= 2 * 4
    want = {k: max([n * 100 + k for n in range(6) if k in range(n, 40, 3)], default=0) for k in range(40)}
    assert {r["key"]: r["v"] for r in patched(spark, out).collect()} == want


def test_python_hooks_fail_pass_on_none_or_end_the_job(spark):
    calls = "a1 none x 7".split()

    def parse(v):
        if v is None or v == "none":
            return None
        return int(v)

    def broken(v):
        return 1 // 0

    hook = Field("v", optional(M.INT), transforms=(("strip", lambda t: F.trim(t)), ("parse", python_hook(parse, T.LongType()))))
    df = spark.createDataFrame([(k, json.dumps({"v": v})) for k, v in enumerate([*calls, 10**18, None, " 5 "])], TEXTS)
    got = {r["id"]: (r["value"] and r["value"]["v"], [(e["code"], e["hook"]) for e in r["errors"]]) for r in from_json(df, "t", Contract("C", (hook,)), keep=["id"]).collect()}
    assert got == {0: (None, [("transform", "parse")]), 1: (None, []), 2: (None, [("transform", "parse")]), 3: (7, []), 4: (10**18, []), 5: (None, []), 6: (5, [])}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        from_json(df, "t", Contract("C", (Field("v", optional(M.INT), transforms=(("broken", python_hook(broken, T.LongType())),)),))).collect()
    with pytest.raises(ValueError, match="inside lists"):
        from_json(df, "t", Contract("C", (Field("v", M.Many(Contract("D", (hook,)))),)))


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_patches_one_by_one(spark, chunk):
    c = Contract("C", (Field("key", M.INT, read_only=True), Field("low", M.INT), Field("high", constrained(M.INT, le=50))), checks=(Check("order", ("low", "high"), lambda a, b: a <= b),))
    patch = derive(c, mode="input", partial=True)
    rng = random.Random(3)
    given = [(rng.randrange(4), s, {f: rng.randrange(60) for f in rng.sample(["low", "high"], rng.randrange(3))}) for s in range(40)]
    state = {k: [0, 10, 0, []] for k in range(5)}
    for key, s, p in given:
        low, high = p.get("low", state[key][0]), p.get("high", state[key][1])
        if low <= high <= 50:
            state[key][:3] = [low, high, state[key][2] + 1]
        elif p.get("high", 0) <= 50:  # beyond 50 the patch itself is unsound and isn't given
            state[key][3].append(s)
    rows = from_json(spark.createDataFrame([(k, s, json.dumps(p)) for k, s, p in given] + [(77, 100, '{"low":1}'), (None, 101, '{"low":1}')], "key long, seq long, t string"), "t", patch, keep=["key", "seq"]).where("value is not null")
    base = spark.createDataFrame([(k, 0, 10) for k in range(5)], "key long, low long, high long")
    got = {r["key"]: [r["low"], r["high"], r["applied"], list(r["refused"])] for r in apply_in_order(base, rows, "key", "seq", c, patch, chunk).collect()}
    assert got == state


def test_dispatch_says_what_the_whole_union_says(spark, tmp_path):
    """Known tags, unknown ones, tags of other kinds, none, no JSON, repeated keys; branches share names of fields."""
    one = Contract("One", (Field("id", constrained(M.INT, lt=50)), Field("x", M.STR, default="d")))
    two = Contract("Two", (Field("id", M.STR), Field("items", M.Many(M.INT))))
    kind = M.Tagged("kind", (("one", one), ("two", two)))
    rng = random.Random(9)
    made = [json.dumps({k: v for k, v in (("kind", rng.choice(["one", "two", "three", 7, None])), ("id", rng.choice([1, 99, "a"])), ("items", rng.choice([[1], ["x"], 5])), ("x", rng.choice(["y", 1]))) if rng.random() < 0.8}) for _ in range(150)]
    made += [f'{{"kind":"one","id":{k}}}' for k in range(20)] + ["[]", "nope", None, '{"kind":"one","kind":"two"}', '{"kind":"one","id":1,"id":2}']
    df = spark.createDataFrame(list(enumerate(made)), TEXTS)
    want = told(from_json(df, "t", kind, keep=["id"]).collect())
    branches, rest = dispatch(df, "t", kind, ["id"], str(tmp_path / "branches"))
    got = told(rest.withColumn("truncated", F.lit(False)).collect())
    sound = 0
    for name, part in branches.items():
        rows = part.collect()
        got |= told(rows)
        sound += sum(r["value"] is not None for r in rows)
    assert got == want and sound == sum(not e for e, _ in want.values()) > 10


def test_patterns_of_locations(spark):
    inner = Contract("Inner", (Field("n", M.INT), Field("by", M.Mapping(M.Many(M.INT)), default=None)))
    contract = Contract("Outer", (Field("rows", M.Many(M.Many(inner)), default=None), Field("maps", M.Mapping(M.Mapping(inner)), default=None), Field("a b", M.INT, default=1)))
    texts = ['{"rows":[[],[{"n":1},{"n":"x"}]]}', '{"rows":[[{"n":1,"by":{"7":[1,"x"]}}]]}', '{"maps":{"a":{"b":{"n":"x"}}}}', '{"maps":{"n":{"by":{"n":1,"by":{"q.r":["x"]}}}}}', '{"a b":"x"}', "[]", '{"rows":[[{"n":"x"}]]}']
    done = from_json(spark.createDataFrame(list(enumerate(texts)), TEXTS), "t", contract)
    got = {(r["pattern"], r["code"]): (r["errors"], r["records"]) for r in error_patterns(done, contract).collect()}
    assert got == {("rows[*][*].n", "type"): (2, 2), ("rows[*][*].by.*[*]", "type"): (1, 1), ("maps.*.*.n", "type"): (1, 1), ("maps.*.*.by.*[*]", "type"): (1, 1), ("a b", "type"): (1, 1), ("<root>", "type"): (1, 1)}


def test_numbers_of_any_size(spark):
    """Against Python's own integers and decimals, at random."""
    from decimal import Decimal

    from pactframe.functions import scalars
    from pactframe.operators.output import to_json
    from pactframe.operators.validate import from_text

    rng = random.Random(5)
    def digits(n):
        return str(rng.randrange(1, 10)) + "".join(rng.choice("0123456789") for _ in range(n - 1))

    whole = ["0", "-0", "9007199254740993", "9223372036854775808", "-" + digits(60), digits(400)] + [rng.choice(["", "-"]) + digits(rng.randrange(1, 70)) for _ in range(60)]
    exact = ["1.50", "0.0", "1e2", "1E-7", "-0.10", "12.5e+3", "0.00e-2", digits(50) + "." + digits(50)] + [rng.choice(["", "-"]) + digits(rng.randrange(1, 50)) + rng.choice(["", "." + digits(rng.randrange(1, 50))]) + rng.choice(["", "e5", "E-60", "e+40"]) for _ in range(58)]
    limit = 10**30
    inner = Contract("Inner", (Field("n", constrained(M.BIG_INT, ge=-limit), alias="a/b"), Field("x", constrained(M.EXACT, lt=limit)), Field("f", M.FLOAT), Field("s", M.STR)))
    contract = Contract("Outer", (Field("rows", M.Many(inner)), Field("pair", M.Fixed((M.BIG_INT, M.EXACT))), Field("old", M.BIG_INT, alias="new", legacy=("was~",))))
    other = contract.fields[2].names[-1]
    texts = [(k, '{"rows":[{"a/b":1,"x":2,"f":1e2,"s":"9"},{"a/b":%s,"x":%s,"f":1.50,"s":"12345678901234567890"}],"pair":[%s,%s],"%s":%s}' % (n, x, n, x, other, n)) for k, (n, x) in enumerate(zip(whole, exact, strict=True))]
    out = {r["id"]: r for r in from_json(spark.createDataFrame(texts, TEXTS), "t", contract).select("id", "value", "errors", to_json(contract, F.col("value")).alias("j")).collect()}
    for k, (n, x) in enumerate(zip(whole, exact, strict=True)):
        codes = {e["code"] for e in out[k]["errors"]}
        assert codes == {c for c, failed in (("greater_than_or_equal", int(n) < -limit), ("less_than", Decimal(x) >= limit)) if failed}, (n, x, out[k]["errors"])
        if not codes:
            v = out[k]["value"]
            assert v["pair"]["_0"] == v["rows"][1]["n"] == v["old"] == str(int(n)) and v["rows"][1]["f"] == 1.5
            assert v["pair"]["_1"] == v["rows"][1]["x"] and Decimal(v["pair"]["_1"]) == Decimal(x) and "e" not in v["pair"]["_1"].lower()
            assert json.loads(out[k]["j"], parse_int=str)["pair"] == [str(int(n)), v["pair"]["_1"]]
    pairs = [(k, a) for k, a in enumerate(["0", "-0.0", "5", "50", "4.999", "5.0", "5.01", "-5", "-5.1", "-4.9", "-50", digits(40)])]
    df = spark.createDataFrame(pairs, TEXTS)
    for bound in ("5", "-5", "0", "4.9990", "1" + "0" * 39):
        for r in df.select("t", scalars.exact_over(F.col("t"), Decimal(bound)).alias("over"), scalars.exact_under(F.col("t"), Decimal(bound)).alias("under")).collect():
            assert (r["over"], r["under"]) == (Decimal(r["t"]) > Decimal(bound), Decimal(r["t"]) < Decimal(bound)), (r, bound)
    flat = Contract("Flat", (Field("n", M.BIG_INT), Field("xs", M.Many(M.EXACT))))
    row = from_text(spark.createDataFrame([(digits(60), "[1.50," + "1" * 50 + "]")], "n string, xs string"), flat, keep=[]).first()
    assert len(row["value"]["n"]) == 60 and row["value"]["xs"] == ["1.50", "1" * 50]
    small = Contract("Small", (Field("n", M.INT), Field("d", M.decimal(38, 2))))
    assert [e["code"] for e in from_json(spark.createDataFrame([(1, '{"n":12345678901234567890,"d":1.50}')], TEXTS), "t", small).first()["errors"]] == ["type"]
    with pytest.raises(ValueError):
        constrained(M.BIG_INT, multiple_of=3)
    with pytest.raises(ValueError):
        from_json_levels(df, "t", flat, ["id"], "/nowhere")


def test_items_of_lists_and_maps_are_converted_once(spark):
    c = Contract("S", (Field("by", M.Mapping(M.Many(M.EXACT))), Field("on", M.Mapping(M.Many(M.DATE)))))
    rows = spark.createDataFrame([('{"by":{"a":["1_000.5",2],"b":[]},"on":{"x":["2031-08-09","20310810"]}}',), ('{"by":{"a":[1,"x"]},"on":{"x":[null]}}',)], "text string")
    done = from_json(rows, "text", c).select("value", "errors")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("regexp_") < 60
    good, bad = done.collect()
    assert good.value.by == {"a": ["1000.5", "2"], "b": []} and [str(d) for d in good.value.on["x"]] == ["2031-08-09", "2031-08-10"]
    assert [(e.path, e.code) for e in bad.errors] == [("by.a[1]", "type"), ("on.x[0]", "type")]


def test_verdicts_of_levels_are_never_broadcast(spark, tmp_path):
    tree = Contract("Tree", (Field("v", M.INT), Field("c", M.Many(M.Ref("Tree")), default=None)))
    rows = spark.range(20).selectExpr("id", """'{"v":1,"c":[{"v":"x"}]}' as text""")
    done = check_levels(rows, "text", "Tree", {"Tree": tree}, ["id"], str(tmp_path / "levels")).verdicts
    assert "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString()
    assert {(r.errors[0].path, r.nodes, r.depth) for r in done.collect()} == {("c[0].v", 2, 1)}


def test_nodes_below_a_record_or_union_are_not_looked_into_once_each(spark, tmp_path):
    """Written levels hold values as lists, which Parquet doesn't shred; few alike records are dealt over partitions by rows; sound nodes' values are planned when they are asked for."""
    tree = Contract("Tree", (Field("v", M.INT), Field("c", M.Many(M.Ref("Tree")), default=None)))
    rows = spark.range(0, 50_000, 1, 1).select(F.col("id").cast("int").alias("id"), F.lit('{"v":1,"c":[{"v":1},{"v":2}]}').alias("t"))
    done = check_levels(rows, "t", "Tree", {"Tree": tree}, ["id"], str(tmp_path / "levels"))
    level = spark.read.parquet(str(tmp_path / "levels/nodes/level=1"))
    assert level.schema["v"].dataType == T.ArrayType(T.VariantType()) and level.rdd.getNumPartitions() > 1
    assert level.where("chain[0].kind is not null").isEmpty()
    assert not (tmp_path / "levels/checked").exists() and list(done.nodes) == []
    assert done.nodes["Tree"].count() == 150_000 and done.verdicts.agg(F.sum("nodes"), F.sum(F.size("errors"))).first() == (150_000, 0)


@pytest.mark.parametrize("items, invalid", [(700, 90), (1500, 3), (0, 0), (1999, 10**6)])
def test_limits_sort_keys_only_and_ties_like_all_rows(spark, monkeypatch, items, invalid):
    """Two keys with nulls and many ties; what is delivered is what running sums over all whole rows allow, but no whole row is sorted save for ties."""
    rows = [(None if k % 7 == 0 else k % 3, f"s{k % 2}", k, k % 5 == 0) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, s string, id int, bad boolean").repartition(5)
    values, room = {"items": F.lit(1), "invalid": F.col("bad").cast("int")}, {"items": items, "invalid": invalid}
    placed = budgets.running_sums(df, ["k", "s"], values)
    want = {r["id"] for r in placed.where((F.col("items") <= items) & (F.col("invalid") <= invalid)).collect()}
    sorted_rows, real = [], budgets.in_order
    monkeypatch.setattr(budgets, "in_order", lambda d, *a, **k: sorted_rows.append(("id" in d.columns, d.count())) or real(d, *a, **k))
    within, seen = budgets.within_limits(df, ["k", "s"], values, room)
    assert {r["id"] for r in within.collect()} == want and within.columns == df.columns
    assert seen["items"] == len(want) + 1 and (seen["items"] > items or seen["invalid"] > invalid)
    assert all(n < 500 for whole, n in sorted_rows if whole)


def test_nodes_are_found_and_checked_once(spark, tmp_path):
    tree = Contract("Tree", (Field("v", M.INT), Field("c", M.Many(M.Ref("Tree")), default=None)))
    named = {"Tree": tree}
    rows = spark.createDataFrame([(1, '{"v":1,"c":[{"v":"x"},{"v":1,"c":[]}]}')], "id long, text string")
    check_levels(rows, "text", "Tree", named, ["id"], f"{tmp_path}/l")
    nodes = levels._held(spark.read.parquet(f"{tmp_path}/l/nodes"))
    below = levels._below(nodes, named, levels._reached("Tree", named), False)
    unsound = levels._checked(nodes.drop("level"), "Tree", tree, False, False, 100, unsound=True)
    for found, read in ((below, "ArrayType"), (unsound, "MapType")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f"$, {read}") == 1  # not once more in a filter below
    assert below.count() == 2 and [list(r.location) for r in unsound.collect()] == [['"c"', "0"]]


def test_short_rows_of_one_file_are_dealt(spark, tmp_path):
    from pactframe.jobs.boundary import c_iso_json
    from pactframe.jobs.common import dealt

    own = spark.range(100_001).select(F.col("id").alias("o_orderkey"), F.lit("1995-11-12").cast("date").alias("o_orderdate"))
    own.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = dealt(spark.read.parquet(f"{tmp_path}/orders.parquet"))
    assert rows.rdd.getNumPartitions() == 3 and rows.distinct().count() == 100_001
    assert "RoundRobin" in c_iso_json(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


MARK = Contract("Mark", (Field("q", optional(M.INT)), Field("on", M.BOOL, default=True)))
PART = Contract("Part", (Field("n", M.INT), Field("sub", Contract("Sub", (Field("marks", M.Many(MARK)),))), Field("secret", M.Many(MARK), sensitive=True, default=None)))
ROW = Contract("Row", (Field("x", constrained(M.FLOAT, lt=9.5)), Field("tags", M.Many(optional(M.STR))), Field("parts", M.Many(M.Many(PART)))))
FLAT_PART = Contract("Part", (Field("n", M.INT), Field("at", Contract("At", (Field("q", M.INT),))), Field("marks", constrained(M.Many(MARK), min_length=0, max_length=1)), Field("secret", M.Many(MARK), sensitive=True, default=None)))
PLAIN = Contract("Plain", (Field("name", constrained(M.STR, min_length=1)), Field("kind", optional(M.Literal(("a", "b"))), default=None), Field("rows", constrained(M.Many(ROW), max_length=3))))
STRAIGHT = Contract("Plain", (*PLAIN.fields[:2], Field("rows", constrained(M.Many(Contract("Row", (*ROW.fields[:2], Field("parts", M.Many(M.Many(FLAT_PART)))))), max_length=3))))


def random_plain(rng, kind, odd):
    """A value of a plain contract; with `odd` the chance that any part of it is something else."""
    if rng.random() < odd:
        return rng.choice([None, 1, -0.0, 1.0, 2.5, 1e300, 12345678901234567890, "x", "", "7", True, [], {}, [1], [None], {"q": 1}, {"q: BIGINT": None}])
    if isinstance(kind, Contract):
        out = {f.external: random_plain(rng, f.type, odd) for f in kind.fields if rng.random() > (0.5 if not f.required else odd / 2)}
        if rng.random() < odd / 2:
            out[rng.choice(["zz", "a b", "on: BOOLEAN, q", "`"])] = rng.choice([None, 1])
        return dict(rng.sample(list(out.items()), len(out)))
    if isinstance(kind, M.Constrained):
        return random_plain(rng, kind.base, odd)
    if isinstance(kind, M.Union):
        return None if rng.random() < 0.3 else random_plain(rng, next(o for o in kind.options if o != M.NONE), odd)
    if isinstance(kind, M.Literal):
        return rng.choice(kind.values)
    if isinstance(kind, M.Many):
        return [random_plain(rng, kind.item, odd) for _ in range(rng.randrange(3))]
    return {"int": rng.choice([0, -5, 2**63 - 1]), "float": rng.choice([1, -2.5, 1e-7, 9.0]), "str": "s", "bool": True}[kind.kind]


@pytest.mark.parametrize("contract, max_errors", [(PLAIN, 100), (STRAIGHT, 2)])
def test_plain_records_are_judged_whole(spark, tmp_path, monkeypatch, contract, max_errors):
    """The verdicts of one expression and the counts of all levels, though only what is in doubt goes by levels; nodes are all there when asked for."""
    rng = random.Random(11)
    texts = [json.dumps(random_plain(rng, contract, odd)) for odd in (0, 0.01, 0.05) for _ in range(130)] + ["nope", None, "[]", "{}", "7", '{"name":"a","kind":null,"rows":[{"x":1e400,"tags":[],"parts":[]}]}', '{"name":"a","name":"b","rows":[]}']
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    want = told(from_json(df, "t", contract, max_errors, keep=["id"]).collect())
    done = from_json_levels(df, "t", contract, ["id"], str(tmp_path / "levels"), max_errors)
    verdicts = done.verdicts.collect()
    got = told(verdicts)
    wrong = [(texts[k], got[k], want[k]) for k in want if got[k] != want[k]]
    assert not wrong, wrong[:2]  # also of hidden fields deep inside, whose nodes find parents that aren't hidden
    assert 50 < sum(bool(e) for e, _ in want.values()) < 300
    monkeypatch.setattr(levels.P, "plain", lambda *a, **k: False)
    whole = from_json_levels(df, "t", contract, ["id"], str(tmp_path / "whole"), max_errors)
    assert {(r["id"], r["nodes"], r["depth"]) for r in verdicts} == {(r["id"], r["nodes"], r["depth"]) for r in whole.verdicts.collect()}
    if contract is STRAIGHT:  # none of these goes by levels at all
        assert spark.read.parquet(str(tmp_path / "levels/paths")).where("left").isEmpty() and not (tmp_path / "levels/nodes").exists()
    else:
        few, all_ = (spark.read.parquet(str(tmp_path / f / "nodes")) for f in ("levels", "whole"))
        assert few.count() * 2 < all_.count()
    shown = lambda n: sorted(map(str, n.select("id", "location", "path", "level", F.to_json("value")).collect()))
    name = "Plain.rows.parts"
    assert name in done.nodes.names and shown(done.nodes[name]) == shown(whole.nodes[name])


def test_straight_records_of_an_empty_table(spark, tmp_path):
    assert from_json_levels(spark.createDataFrame([], TEXTS), "t", STRAIGHT, ["id"], str(tmp_path / "levels")).verdicts.count() == 0
