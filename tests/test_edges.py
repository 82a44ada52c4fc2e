import datetime as dt
import decimal
import ipaddress
import json
import pathlib
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pactframe.contract import model as M
from pactframe.contract.model import Contract, Field, Tagged, constrained, derive, optional
from pactframe.functions import scalars
from pactframe.functions.decode import decoded, verdict
from pactframe.operators import budgets
from pactframe.operators.hooks import validated_udf
from pactframe.operators.output import check_selection, to_json, to_rows
from pactframe.operators.validate import from_json, from_rows
from pactframe.sources import jsonl
from pactframe.streaming.stream import continued, patch_stream, patched, validated_stream


def _same(spark, convert, texts, reference):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(convert(F.col("t"))).collect()]
    for text, value in zip(texts, got, strict=True):
        try:
            want = reference(text)
        except (ValueError, decimal.InvalidOperation):
            want = None
        assert value == want, (text, value, want)


def test_times_and_dates_as_the_standard_library_reads_them(spark):
    times = ["07:15", "07:15:09.250", "24:00:00", "7:15", "07:15:09.000000", "T071509", "0715", "07", "07:15:09.7654321", "07:15:09,5", "07:15+02:00", "07:15:09-0130", "07:15Z", "071509.25+05", "07:60", "23:59:59.999999", "12:30+05:30:15"]
    _same(spark, scalars.iso_time, times, lambda t: dt.time.fromisoformat(t).isoformat())
    dates = ["2031-08-09", "20310809", "2031-W08-3", "2031W083", "2031-W08", "2026W53", "2020-W53-7", "2031-02-30", "0000-01-01", "2031-W01-8", "2031-W00-1", "2031-8-9", "2031", " 2031-08-09", "9999-12-31", "2021-W53-1"]
    _same(spark, lambda c: scalars.iso_date(c).cast("string"), dates, lambda t: dt.date.fromisoformat(t).isoformat())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_do_not_depend_on_the_session(spark, zone):
    texts = ["2031-08-09T07:15:09Z", "2031-08-09T07:15:09+02:00", "2031-08-09 07:15", "2031-08-09T25:00:00", "2031-03-09T02:30:00.5", "20310809T071509", "2031-W08-3T10:00:00-0330", "2031-08-09", "2031-08-09x07", "2031-08-09T07:15:09.123456789+01:00"]

    def micros(text):
        at = dt.datetime.fromisoformat(text)
        at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
        return (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _same(spark, lambda c: F.unix_micros(scalars.iso_datetime(c)), texts, micros)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_decimals_with_exponents(spark):
    def exact(text):
        value = decimal.Decimal(text)
        if not value.is_finite() or value != value.quantize(decimal.Decimal("0.01")) or abs(value) >= 10**10:
            raise ValueError
        return value.quantize(decimal.Decimal("0.01"))

    _same(spark, lambda c: scalars.json_decimal(c, 12, 2), ["3E+2", "3.20", "3.217", "300E-2", "321E-4", "3_000.5", " 7 ", "NaN", "Infinity", "-0", "+.5", "5.", "e5", "", "1e", "98765432109", "1E-400", "9876543210.1", "9999999999.99"], exact)


@pytest.mark.parametrize("kind", scalars.IP_KINDS)
def test_addresses_as_the_standard_library_reads_them(spark, kind):
    texts = ["9.8.7.6", "09.8.7.6", "256.1.1.1", "20.0.0.0/8", "20.0.0.1/8", "20.0.0.0/255.0.0.0", "20.0.0.0/0.255.255.255", "20.0.0.0/33", "2001:DB8::A", "::", "::1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "1::2::3", "::ffff:9.8.7.6", "64:ff9b::9.8.7.6",
             "2001:db8::/32", "2001:db8::1/32", "fe80::1%eth0", "1:2:3:4:5:6:7", "12345::", "0:0:1::", "::/0", "::1/128", "1:0:0:0:1:0:0:1", "x/y", "0.0.0.0/0", "20.0.0.0/08"]
    _same(spark, scalars.canonical_ip(kind), texts, lambda t: str(getattr(ipaddress, kind)(t)))


def test_paths_as_the_standard_library_writes_them(spark):
    _same(spark, scalars.path_text, ["u//v/./w", "/", "//", "//u", "///u", "", "./x", "u/..", "u/v/", "."], lambda t: str(pathlib.PurePosixPath(t)))


def test_native_verdict_equals_the_strict_parser(spark):
    rng = random.Random(3)
    texts = ["1 2", "1]", "1}", "1],[2", '1},"b":{', "1,2", '1,"b":2', "[1]]", '{"k":1}}', '{"k":1} {"k":2}', "", " ", "nul", "NaN", '{"k":[1,{"k":1,"k":2}]}', '"a]b"', '["]"]', "[1,]", "01", "-", '"\t"', '"\\u00e9"', "1e5", "[[[[]]]]", "null", " true ", "﻿1", "// 1", "'x'"]
    texts += ["".join(rng.choice('[]{},:1"a \\') for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in decoded(df, "t").select("i", "verdict.code", F.col("raw").isNotNull().alias("read")).collect():
        want = verdict(texts[r["i"]])[0]
        assert r["code"] == want and r["read"] == (want is None), texts[r["i"]]


def _paths(df):
    return [([e["path"] for e in r["errors"]], r["truncated"]) for r in df.orderBy("i").collect()]


def test_budget_counts_by_level(spark):
    inner = Contract("In", (Field("x", M.INT), Field("y", M.INT), Field("z", M.INT)))
    c = Contract("Out", (Field("u", M.INT), Field("n", inner), Field("v", M.INT), Field("w", M.INT)))
    texts = ['{"u":1,"n":{"x":"","y":"","z":""},"v":"","w":""}', '{"u":"","n":{"x":"","y":"","z":"","q":1},"v":"","w":""}', '{"u":1,"n":{"x":1,"y":1,"z":1},"v":"","w":"","k":1,"l":2,"m":3}']
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert _paths(from_json(df, "t", c, max_errors=4, keep=["i"])) == [(["n.x", "n.y", "n.z", "v", "w"], False), (["n.x", "n.y", "n.z", "n.q"], True), (["v", "w", "k", "l"], True)]
    many = Contract("Many", (Field("s", M.Many(c)), Field("t", M.INT)))
    wrapped = spark.createDataFrame([(k, json.dumps({"s": [json.loads(t)], "t": ""})) for k, t in enumerate(texts)], "i long, t string")
    assert _paths(from_json(wrapped, "t", many, max_errors=4, keep=["i"])) == [(["s[0].n.x", "s[0].n.y", "s[0].n.z", "s[0].v", "s[0].w", "t"], False), (["s[0].n.x", "s[0].n.y", "s[0].n.z", "s[0].n.q"], True), (["s[0].v", "s[0].w", "s[0].k", "s[0].l"], True)]


def test_composite_json_reads_back(spark):
    tag = Tagged("t", (("a", Contract("A", (Field("x", M.INT),))), ("b", Contract("B", (Field("y", optional(M.STR)),)))))
    c = Contract("All", (Field("p", M.Fixed((M.INT, M.STR))), Field("u", M.Union((M.INT, M.STR))), Field("t", tag), Field("m", M.Mapping(M.Fixed((M.INT,)))), Field("o", optional(M.Many(tag)))))
    texts = ['{"p":[1,"z\\"q"],"u":"s","t":{"t":"a","x":3},"m":{"k\\"":[4]},"o":null}', '{"p":[2,""],"u":5,"t":{"t":"b","y":null},"m":{},"o":[{"t":"a","x":1},{"t":"b","y":"w"}]}']
    rows = from_json(spark.createDataFrame(list(enumerate(texts)), "i long, s string"), "s", c, keep=["i"]).select("i", "errors", to_json(c, F.col("value")).alias("text")).orderBy("i").collect()
    assert [r["text"] for r in rows] == texts and not any(r["errors"] for r in rows)


def test_selection_inside_a_set_is_for_json_only(spark):
    c = Contract("S", (Field("k", M.INT), Field("s", M.Many(Contract("I", (Field("a", M.INT), Field("b", M.INT))), "frozenset"))))
    check_selection(c, {"s": {"a": True}})
    with pytest.raises(ValueError, match="JSON only"):
        to_rows(spark.createDataFrame([], "value struct<k:long,s:array<struct<a:long,b:long>>>"), c, include={"s": {"a": True}})


@pytest.mark.parametrize(("option", "text"), [({"max_depth": 3}, '{"a":[[[1]]]}'), ({"max_nodes": 4}, '{"a":[[[1]]]}'), ({"max_size": 5}, '{"a":[]}')])
def test_budgets_that_are_hit_end_the_job(spark, option, text):
    c = Contract("D", (Field("a", M.Many(M.Many(M.Many(M.INT)))),))
    df = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(Exception, match="limit"):
        from_json(df, "t", c, **option).select("value", "errors").collect()
    assert from_json(df, "t", c, max_depth=4, max_nodes=5, max_size=40).where("value is not null").count() in (0, 1)


def test_defaults_and_rest_of_a_checked_function(spark):
    df = spark.createDataFrame([(1, 2, 30), (5, 6, 7), (50, 1, 1)], "a long, b long, c long")
    add = lambda a, *rest: sum(rest, a)
    done = validated_udf(df, add, [("a", constrained(M.INT, lt=40))], constrained(M.INT, lt=30), ["a", "b", "c"], rest=("more", constrained(M.INT, lt=20)))
    assert [(r["value"], [(e["path"], e["code"]) for e in r["errors"]]) for r in done.orderBy("a").collect()] == [(None, [("more[1]", "less_than")]), (18, []), (None, [("a", "less_than")])]
    one = validated_udf(df, add, [("a", M.INT), ("b", M.INT, 100)], M.INT, ["a"])
    assert sorted(r["value"] for r in one.collect()) == [101, 105, 150]


def test_outlying_keys_share_the_blocks(spark):
    keys = [*range(500), 10**15]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    got = {r["k"]: r["item_index"] for r in budgets.running(df, "k", F.lit(1).cast("bigint"), "n", parts=7).withColumn("item_index", F.col("n") - 1).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_byte_order_marks_of_files_are_seen(spark, tmp_path):
    for name, head in (("a", b"\xef\xbb\xbf"), ("b", b""), ("c", b"\xef\xbb\xbf")):
        (tmp_path / f"{name}.jsonl").write_bytes(head + b'{"id":1}\n{"id":2}' + (b"\n" if name != "c" else b""))
    rows = jsonl.read_jsonl(spark, str(tmp_path), Contract("R", (Field("id", M.INT),))).orderBy("item_index").collect()
    assert [r["framing"] for r in rows] == ["bom", None, None, None, "bom", None]


@pytest.mark.parametrize("limits", [{"max_items": 25}, {"max_invalid": 2}, {"max_total_bytes": 200}])
def test_stream_budgets_end_the_query_before_the_batch_is_delivered(spark, tmp_path, limits):
    for part in range(3):
        spark.createDataFrame([(10 * part + k, '{"k":"x"}' if k == 0 else f'{{"k":{k}}}') for k in range(10)], "i long, t string").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    lines = spark.readStream.schema("i long, t string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    done = validated_stream(lines, "t", Contract("K", (Field("k", M.INT),)), ["i"]).withColumn("bytes", F.lit(9))
    query = continued(done, ["i"], f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/check", state_path=f"{tmp_path}/state", size="bytes", **limits)
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 18 and spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_patch_stream_rewrites_touched_parts_only(spark, tmp_path):
    c = Contract("C", (Field("key", M.INT, read_only=True), Field("v", constrained(M.INT, lt=100)), Field("w", M.STR)))
    patch = derive(c, mode="input", partial=True)
    spark.createDataFrame([(k, k, f"w{k}") for k in range(40)], "key long, v long, w string").write.parquet(f"{tmp_path}/base")
    for part, rows in enumerate(([(1, 1, '{"v":7}'), (1, 2, '{"v":8}')], [(2, 3, '{"w":"new"}'), (1, 4, '{"v":9}')])):
        spark.createDataFrame(rows, "key long, seq long, t string").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    lines = spark.readStream.schema("key long, seq long, t string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    patch_stream(from_json(lines, "t", patch, keep=["key", "seq"]), f"{tmp_path}/base", f"{tmp_path}/out", "key", "seq", c, patch, f"{tmp_path}/check", parts=8).awaitTermination()
    got = {r["key"]: (r["v"], r["w"]) for r in patched(spark, f"{tmp_path}/out").collect()}
    assert got == {k: (9 if k == 1 else k, "new" if k == 2 else f"w{k}") for k in range(40)}
    touched = spark.read.parquet(f"{tmp_path}/out").where("batch >= 0").select("batch", "part").distinct().count()
    assert touched <= 3


def test_nested_records_of_columns_count_once(spark):
    inner = Contract("In", (Field("x", constrained(M.INT, lt=1)), Field("y", constrained(M.INT, lt=1))))
    df = spark.createDataFrame([(1, (2, 3), 4)], "i long, n struct<x:long,y:long>, z long")
    c = Contract("Out", (Field("i", M.INT), Field("n", inner), Field("z", constrained(M.INT, lt=1))))
    assert [(len(r["errors"]), r["truncated"]) for r in from_rows(df, c, max_errors=3, keep=["i"]).collect()] == [(3, False)]


def test_zeros_keep_their_sign(spark):
    c = Contract("Z", (Field("a", M.FLOAT), Field("b", M.STR), Field("c", M.Many(M.FLOAT)), Field("d", M.decimal(6, 2))))
    text = '{"a":-0.0,"b":"[-0.0, \\"-0.0","c":[-0.00,-0.05,1e-0,-0.0e1,-0,0.0],"d":-0.0}'
    rows = spark.createDataFrame([(text,), ("[-0.0.0]",)], "text string")
    good, bad = from_json(rows, "text", c).select("value", "errors").collect()
    assert str(good.value.a) == "-0.0" and good.value.b == '[-0.0, "-0.0' and good.value.d == 0
    assert list(map(str, good.value.c)) == ["-0.0", "-0.05", "1.0", "-0.0", "0.0", "0.0"]
    assert [e.code for e in bad.errors] == ["json_invalid"]


def test_durations_and_times_are_matched_once(spark):
    rows = spark.createDataFrame([("P1DT25H",)], "t string")
    for convert in (lambda c: scalars.format_duration(scalars.duration_micros(c)), scalars.iso_datetime, scalars.iso_time):
        plan = rows.select(convert(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_") < 40
    assert rows.select(scalars.format_duration(F.lit(2**63 - 1))).first()[0] == "P106751991DT4H54.775807S"


def test_strict_kinds_of_large_keys(spark, tmp_path):
    from pactframe.jobs.boundary import p_kinds_strict

    spark.createDataFrame([(k,) for k in (65_537, 65_551, 1_048_576, 2**32 + 1)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    six = [r.c_custkey for r in p_kinds_strict(spark, str(tmp_path)).where("path = 'six'").collect()]
    assert six == [k for k in (65_537, 65_551, 1_048_576, 2**32 + 1) if k % 3 == 0]
