import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pactframe.contract import model as M
from pactframe.contract.model import Check, Contract, Field, Tagged, constrained, derive, optional
from pactframe.functions.decode import verdict
from pactframe.operators import budgets
from pactframe.operators.output import check_selection, to_json
from pactframe.operators.patches import apply_patch
from pactframe.operators.validate import flat_errors, from_json, from_rows, split, validate_table
from pactframe.sources import jsonl


def codes(spark, texts, contract, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = from_json(df, "text", contract, keep=["i"], **options).orderBy("i").collect()
    return [[(e["path"], e["code"]) for e in r["errors"]] for r in rows], rows


@pytest.mark.parametrize(("text", "code"), [
    ("1", None), ('{"a":{"b":1,"b":2}}', "duplicate_key"), ("NaN", "non_finite_number"), ("[-Infinity]", "non_finite_number"), ('{"a":', "invalid_json"), ("1 2", "invalid_json"),
    ('"open', "invalid_json"), ("", "invalid_json"), ("9" * 5000, "invalid_json"), ("[1,", "invalid_json")])
def test_strict_json(text, code):
    assert verdict(text)[0] == code


@pytest.mark.parametrize(("raw", "code"), [("", "blank"), ("\n", "blank"), ("\r\n", "blank"), ("﻿1", "bom"), ('{"a":\n1}\n', "invalid_json"), ("   \n", None), ("1\r\n", None)])
def test_framing(spark, raw, code):
    assert spark.createDataFrame([(raw,)], "v string").select(jsonl.frame(F.col("v"))).first()[0] == code


def test_jsonl_files_keep_order_and_lone_returns(spark, tmp_path):
    for name, lines in (("a", [b'{"id":1}\n', b'{"id":2}\r\n', b"\n", b'{"id":"x"}']), ("b", [b'{"id":5}\n', b'{"id":6,"id":7}\n'])):
        (tmp_path / f"{name}.jsonl").write_bytes(b"".join(lines))
    rows = jsonl.read_jsonl(spark, str(tmp_path), Contract("R", (Field("id", M.INT),))).orderBy("item_index").collect()
    assert [(r["line"], r["framing"], r["value"]["id"] if r["value"] else None, [e["code"] for e in r["errors"]]) for r in rows] == [
        (1, None, 1, []), (2, None, 2, []), (3, "blank", None, []), (4, None, None, ["type"]), (5, None, 5, []), (6, "duplicate_key", None, [])]


def test_names_presence_and_order_of_errors(spark):
    c = Contract("User", (Field("user_id", M.INT, alias="userId", legacy=("id", "uid")), Field("age", constrained(M.INT, ge=18)), Field("nick", optional(M.STR), default="n")))
    got, rows = codes(spark, ['{"userId":1,"id":1,"age":20}', '{"user_id":1,"age":3,"b":1,"a":2}', '{"uid":4,"age":18,"nick":null}', '{"id":1,"age":null}', "[]", '{"age":18,"age":1}', "{"], c)
    assert got == [[("userId", "alias_conflict")], [("userId", "missing"), ("age", "greater_than_or_equal"), ("user_id", "unexpected"), ("b", "unexpected"), ("a", "unexpected")], [],
                   [("age", "type")], [("<root>", "type")], [("<root>", "json_duplicate")], [("<root>", "json_invalid")]]
    assert rows[2]["value"].asDict() == {"user_id": 4, "age": 18, "nick": None}
    assert rows[0]["errors"][0]["conflicting_names"] == ["userId", "id"]


def test_error_budget_counts_and_truncates(spark):
    text = json.dumps({"weight": None, "colour": 5} | {f"zz{k * k}": [] for k in range(9)})
    contract = Contract("Parcel", (Field("weight", M.FLOAT), Field("colour", M.STR), Field("depot", M.STR)))
    got, rows = codes(spark, [text, text], contract, max_errors=5)
    assert [p for p, _ in got[0]] == ["weight", "colour", "depot", "zz0", "zz1"] and got[0] == got[1]
    assert rows[0]["truncated"] and not codes(spark, [text], contract, max_errors=13)[1][0]["truncated"]


def test_scalars_of_json(spark):
    c = Contract("S", (Field("u", M.UUID), Field("f", M.FLOAT), Field("d", M.decimal(38, 20)), Field("b", M.BYTES), Field("t", M.DURATION), Field("s", M.Many(M.INT, "set"))))
    good = '{"u":"{9F1c00aa40b04ed288d1f0e5c7a6b301}","f":1,"d":"8040201.55500000000000000077","b":"YQ==","t":"PT8.25S","s":[1,1,2]}'
    got, rows = codes(spark, [good, good.replace('"f":1', '"f":1e400').replace("YQ==", "YQ").replace("PT8.25S", "PT")], c)
    v = rows[0]["value"]
    assert got[0] == [] and v["u"] == "9f1c00aa-40b0-4ed2-88d1-f0e5c7a6b301" and v["f"] == 1.0 and v["d"] == Decimal("8040201.55500000000000000077") and v["b"] == b"a" and v["s"] == [1, 2]
    assert got[1] == [("f", "type"), ("b", "type"), ("t", "type")]


def test_tagged_and_redacted(spark):
    kind = Tagged("type", (("card", Contract("Card", (Field("number", M.STR, sensitive=True),))), ("bank", Contract("Bank", (Field("iban", M.STR),)))))
    got, rows = codes(spark, ['{"number":"1"}', '{"type":"cash"}', '{"type":1}', '{"type":"card","number":1}', '{"type":"bank","iban":"x"}'], kind)
    assert got == [[("type", "discriminator_missing")], [("type", "discriminator_unknown")], [("type", "type")], [("number", "type")], []]
    assert rows[1]["errors"][0]["expected_tags"] == ["bank", "card"] and rows[3]["errors"][0]["input"] == "<redacted>"
    assert rows[4]["value"]["Bank"]["iban"] == "x" and rows[4]["value"]["Card"] is None


def test_union_branches(spark):
    c = Contract("U", (Field("v", M.Union((M.Many(M.INT), M.Many(M.STR, "tuple")))),))
    got, rows = codes(spark, ['{"v":["a","b"]}', '{"v":[1]}', '{"v":[true]}'], c)
    assert [r["value"] and r["value"]["v"]["branch"] for r in rows] == ["tuple[str, ...]", "list[int]", None]
    assert [b["label"] for b in rows[2]["errors"][0]["branches"]] == ["list[int]", "tuple[str, ...]"]


@pytest.mark.parametrize(("value", "rules", "code"), [
    (35, {"ge": 14, "lt": 70, "multiple_of": 7}, None), (13, {"ge": 14, "lt": 70}, "greater_than_or_equal"), (71, {"ge": 14, "lt": 70, "multiple_of": 7}, "less_than"), (36, {"ge": 14, "multiple_of": 7}, "multiple_of"), (-21, {"multiple_of": 7}, None)])
def test_int_bounds(spark, value, rules, code):
    df = spark.createDataFrame([(value,)], "v long")
    errors = from_rows(df, Contract("I", (Field("v", constrained(M.INT, **rules)),))).first()["errors"]
    assert [e["code"] for e in errors] == ([code] if code else [])


@pytest.mark.parametrize(("value", "rules", "code"), [
    (float("nan"), {"ge": 0.0}, "greater_than_or_equal"), (float("inf"), {"ge": 0.0}, None), (float("nan"), {"le": 0.0}, "less_than_or_equal"), (0.3, {"multiple_of": 0.1}, None),
    (0.31, {"multiple_of": 0.1}, "multiple_of"), (float("inf"), {"multiple_of": 0.1}, "multiple_of")])
def test_float_bounds(spark, value, rules, code):
    errors = from_rows(spark.createDataFrame([(value,)], "v double"), Contract("F", (Field("v", constrained(M.FLOAT, **rules)),))).first()["errors"]
    assert [e["code"] for e in errors] == ([code] if code else [])


def test_length_before_items_and_pattern_flags(spark):
    df = spark.createDataFrame([(["x"], "GRÖSSE-XL"), ([], "breite-s")], "tags array<string>, name string")
    c = Contract("P", (Field("tags", constrained(M.Many(constrained(M.STR, min_length=2)), min_length=1)), Field("name", constrained(M.STR, min_length=4, pattern="^größe|^grösse-[smlx]+$", flags="i"))))
    rows = from_rows(df, c).collect()
    assert [[(e["path"], e["code"]) for e in r["errors"]] for r in rows] == [[("tags[0]", "min_length")], [("tags", "min_length"), ("name", "pattern")]]
    assert rows[0]["errors"][0]["location"] == ['"tags"', "0"]


def test_declaration_errors():
    for bad in (lambda: constrained(M.STR, gt=1), lambda: constrained(M.INT, pattern="a"), lambda: constrained(M.INT, gt=3, lt=1), lambda: Contract("C", (Field("a", M.INT), Field("b", M.INT, alias="a"))),
                lambda: derive(Contract("C", (Field("a", M.INT),)), include=("b",)), lambda: derive(Contract("C", (Field("a", M.INT),)), include=("a",), exclude=("a",))):
        with pytest.raises(ValueError):
            bad()


def test_strict_reports_the_first_failure_only(spark):
    df = spark.createDataFrame([(None, 5, 1)], "a long, b long, c long")
    contract = Contract("C", (Field("a", M.INT), Field("b", constrained(M.INT, lt=3))))
    assert [e["code"] for e in validate_table(df, contract).first()["errors"]] == ["type"]
    assert [e["code"] for e in from_rows(df, contract).first()["errors"]] == ["type", "less_than", "unexpected"]


def test_partial_and_patch(spark):
    c = Contract("U", (Field("key", M.INT, read_only=True), Field("name", constrained(M.STR, min_length=1)), Field("mail", optional(M.STR))), (Check("named", ("name", "mail"), lambda n, m: F.trim(n) != ""),))
    patch = derive(c, mode="input", partial=True)
    got, rows = codes(spark, ["{}", '{"mail":null}', '{"name":null}', '{"name":""}', '{"name":" "}'], patch)
    assert got == [[], [], [("name", "type")], [("name", "min_length")], []]
    base = spark.createDataFrame([(k, f"n{k}", f"m{k}") for k in range(5)], "key long, name string, mail string")
    side = from_json(spark.createDataFrame([(0, "{}"), (1, '{"mail":null}'), (4, '{"name":" "}')], "key long, text string"), "text", patch, keep=["key"])
    done = {r["key"]: r for r in apply_patch(base, side, "key", c, patch).collect()}
    assert done[0]["value"]["mail"] == "m0" and not done[0]["changed"] and done[1]["value"]["mail"] is None and done[2]["value"]["name"] == "n2"
    assert [e["code"] for e in done[4]["errors"]] == ["spec_check"]
    with pytest.raises(ValueError):
        apply_patch(base, side, "key", c, derive(c, mode="output", partial=True))


def test_selection_errors():
    kind = Contract("A", (Field("a", M.INT, alias="x"), Field("t", Tagged("k", (("b", Contract("B", (Field("c", M.INT),))),)))))
    for tree, excluding in (({"x": True}, False), ({"a": {"b": True}}, False), ({"t": {"c": True}}, False), ({"t": {"k": True}}, True), ({}, False)):
        with pytest.raises(ValueError):
            check_selection(kind, tree, excluding)
    check_selection(kind, {"t": {"k": True, "c": True}})


def test_json_output_refuses_what_json_lacks(spark):
    c = Contract("N", (Field("x", M.FLOAT),))
    df = spark.createDataFrame([(float("nan"),)], "x double").select(F.struct("x").alias("v"))
    with pytest.raises(Exception, match="not finite"):
        df.select(to_json(c, F.col("v"))).collect()


def test_split_never_keeps_raw_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, secret string")
    good, bad = split(from_rows(df, Contract("S", (Field("id", M.INT), Field("secret", M.STR, sensitive=True)))), ["id"])
    assert [r["id"] for r in good.collect()] == [1] and bad.columns == ["id", "errors", "truncated"] and bad.count() == 1


def test_budgets_against_a_loop(spark):
    rng = random.Random(3)
    for limit in (1, 3, 8):
        kinds = [rng.choice("gggb") for _ in range(60)]
        df = budgets.item_index(spark.createDataFrame([(k * 3, v) for k, v in enumerate(kinds)], "key long, kind string").repartition(5), "key")
        delivered, bad = [], 0
        for k, v in enumerate(kinds):
            bad += v == "b"
            if bad > limit:
                break
            delivered.append(k)
        cut = budgets.max_invalid(df, F.col("kind") == "b", limit)
        assert sorted(r["item_index"] for r in cut.deliver(df, raise_error=False).collect()) == delivered
        if cut.exceeded:
            with pytest.raises(budgets.BudgetError):
                cut.deliver(df)


def test_partitions_do_not_change_results(spark):
    rows = [(k, float(k % 50)) for k in range(500)]
    c = Contract("R", (Field("k", M.INT), Field("q", constrained(M.FLOAT, ge=5.0, le=40.0))))
    results = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "k long, q double").repartition(n)
        results.append(sorted(map(tuple, flat_errors(from_rows(df, c, keep=["k"]), ["k"]).select("k", "path", "code").collect())))
    assert results[0] == results[1] and results[0]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, q double")
    c = Contract("R", (Field("k", M.INT), Field("q", M.FLOAT)))
    assert from_rows(df, c).count() == 0 and budgets.item_index(df, "k").count() == 0
