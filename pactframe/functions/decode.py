"""The verdict on a JSON text: where the engine's own parser is too lenient."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT = T.StructType([T.StructField("code", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("line", "col", "position")], T.StructField("key", T.StringType())])


class _Refused(ValueError):
    def __init__(self, code: str, key: str | None = None):
        super().__init__(code)
        self.code, self.key = code, key


def _unique(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise _Refused("duplicate_key", k)
        out[k] = v
    return out


def _constant(name: str):
    raise _Refused("non_finite_number")


def _depth(value, level: int = 0) -> int:
    """Containers around the deepest value; a scalar root has 0."""
    deepest, stack = 0, [(value, level)]
    while stack:
        v, at = stack.pop()
        deepest = max(deepest, at)
        if isinstance(v, (dict, list)):
            stack += [(x, at + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def verdict(text: str) -> tuple:
    """(code, line, column, position, key); code is null for strict JSON."""
    try:
        json.loads(text, object_pairs_hook=_unique, parse_constant=_constant, parse_float=Decimal)
    except _Refused as e:
        return e.code, None, None, None, e.key
    except json.JSONDecodeError as e:
        return "invalid_json", e.lineno, e.colno, e.pos, None
    except (ValueError, RecursionError):
        return "invalid_json", None, None, None, None
    return None, None, None, None, None


def _verdicts(texts: pd.Series, absent: tuple) -> pd.DataFrame:
    rows = [verdict(t) if isinstance(t, str) else absent for t in texts]
    return pd.DataFrame(rows, columns=["code", "line", "col", "position", "key"]).astype({"line": "Int32", "col": "Int32", "position": "Int32"})


@F.pandas_udf(VERDICT)
def strict_json(texts: pd.Series) -> pd.DataFrame:
    """`verdict` of each text; null texts are invalid."""
    return _verdicts(texts, ("invalid_json", None, None, None, None))


@F.pandas_udf(VERDICT)
def verdict_of_rest(texts: pd.Series) -> pd.DataFrame:
    """As `strict_json`, but nulls are texts that were found sound before."""
    return _verdicts(texts, (None,) * 5)


class _Token(str):
    """A number as it is written."""


def number_tokens(text: str) -> dict[str, str] | None:
    """JSON pointers of a strict text's numbers that VARIANT doesn't hold digit for digit, and how they are written."""
    try:
        stack, found = [("", json.loads(text, parse_int=_Token, parse_float=_Token))], {}
    except (ValueError, RecursionError):
        return None
    while stack:
        at, value = stack.pop()
        if isinstance(value, _Token):
            if len(value) > 16 or "e" in value.lower() or "." in value and value[-1] == "0":
                found[at] = str(value)
        elif isinstance(value, list):
            stack += [(f"{at}/{k}", x) for k, x in enumerate(value) if not type(x) is str]
        elif isinstance(value, dict):
            stack += [(f"{at}/{pointer_part(k)}", x) for k, x in value.items() if not type(x) is str]
    return found


def pointer_part(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _kept_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: number_tokens(t) if isinstance(t, str) else None)


#: Texts that may hold a number of which VARIANT loses digits: long ones, exponents, zeros at the end of a fraction.
_LOSSY = r"[0-9][0-9.]{16}|[0-9][eE][0-9+-]|\.[0-9]{0,16}0(?![0-9])"


def kept_tokens(text: Column) -> Column:
    """`number_tokens` of the texts that may have some; only these leave the JVM.  Null for others."""
    return _kept_tokens(F.when(text.rlike(_LOSSY), text))


@F.pandas_udf(T.IntegerType())
def json_depth(texts: pd.Series) -> pd.Series:
    """Depth of strict JSON texts; null for others."""
    def one(t):
        try:
            return _depth(json.loads(t))
        except (ValueError, RecursionError, TypeError):
            return None

    return texts.map(one).astype("Int32")


def depth_over(text: Column, limit: int) -> Column:
    """The depth of a JSON text that is nested deeper than `limit`, else null; only texts with more opening signs than that are looked into."""
    opened = F.length(text) - F.length(F.translate(text, "[{", ""))
    depth = json_depth(F.when(opened > limit, text))
    return F.when(depth > limit, depth)


#: A zero with a sign and a fraction outside of strings, from the end of the one before; repeats are possessive, so that texts may be of any length.
_SIGNED_ZERO = r'(?s)\G((?:[^"-]++|"(?:[^"\\]++|\\.)*+"|(?<=[eE])-|-(?!0\.0++(?![0-9.eE])))*+)(-0\.0++)'


def _signed_zeros(text: Column) -> Column:
    """`-0.0` as `-0.0e0`, which VARIANT holds as a double; a decimal would lose the sign."""
    return F.when(text.contains("-0.0"), F.regexp_replace(text, _SIGNED_ZERO, "$1$2e0")).otherwise(text)


def decoded(df: DataFrame, column: str, verdict: str = "verdict", raw: str = "raw") -> DataFrame:
    """Adds `verdict` (code, line, col, position, key; code null for strict JSON) and the VARIANT `raw`.

    The engine's parser refuses what strict JSON does, but reads on no further
    than the first value.  A text is that value alone if it still parses as
    the only item of an array and, where a `]` of its own could end that
    array, as the member of an object: what follows a value would have to
    satisfy both.  Only texts that fail go to the Arrow helper, for their
    place and reason.
    """
    text = F.col(column)
    staged = df.withColumn("_pf_list", F.try_parse_json(F.concat(F.lit("["), _signed_zeros(text), F.lit("\n]"))))
    staged = staged.withColumn("_pf_first", F.try_variant_get("_pf_list", "$[0]", "variant"))
    again = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("\n}")))
    alone = F.col("_pf_first").isNotNull() & F.try_variant_get("_pf_list", "$[1]", "variant").isNull() & (~text.contains("]") | again.isNotNull())
    staged = staged.withColumn("_pf_sound", F.coalesce(alone, F.lit(False)))
    staged = staged.withColumn(verdict, verdict_of_rest(F.when(~F.col("_pf_sound"), F.coalesce(text, F.lit("")))))
    unread = F.when(~F.col("_pf_sound"), F.coalesce(F.col(verdict)["code"], F.lit("invalid_json")))
    return staged.withColumn(verdict, F.col(verdict).withField("code", unread)).withColumn(raw, F.when(F.col("_pf_sound"), F.col("_pf_first"))).drop("_pf_list", "_pf_first", "_pf_sound")
