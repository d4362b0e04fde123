"""Functions that built-in expressions can't state: Arrow-batched, never row by row through the JVM boundary."""

from __future__ import annotations

import ast
import json
import operator
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import least_from

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Pow: operator.pow}
_ALLOWED = frozenset("0123456789+-*/(). ")
INVALID = "Error: invalid characters in expression"
#: Bits of the largest whole number that a power may make; a float holds 1,024.
POWER_BITS = 1 << 17


def calculate(text: str | None) -> str | None:
    """The value of an arithmetic expression, to two places, by its syntax tree; else `Error: ` and Python's message. A power of
    more than POWER_BITS bits counts as too large for a float, whatever comes after it."""
    if text is None:
        return None
    if not set(text) <= _ALLOWED:
        return INVALID

    def value(n: ast.AST) -> object:
        if isinstance(n, ast.Expression):
            return value(n.body)
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.UnaryOp):
            return operator.neg(value(n.operand)) if isinstance(n.op, ast.USub) else operator.pos(value(n.operand))
        if isinstance(n, ast.BinOp):
            x, y = value(n.left), value(n.right)
            if isinstance(n.op, ast.Pow) and isinstance(x, int) and isinstance(y, int) and y > 0 and (x.bit_length() - 1) * y > POWER_BITS:
                raise OverflowError("int too large to convert to float")
            return _BINARY[type(n.op)](x, y)
        if isinstance(n, ast.Call):  # two brackets in a row
            raise TypeError(f"{type(value(n.func)).__name__!r} object is not callable")
        return ()  # empty brackets

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            tree = compile(text.lstrip(" "), "<string>", "eval", ast.PyCF_ONLY_AST)
        return str(round(float(value(tree)), 2))
    except Exception as e:
        return f"Error: {e}"


def python_round(x: float | None, digits: int = 2) -> float | None:
    """Rounds the exact binary value, so 2.675 is 2.67."""
    return None if x is None or pd.isna(x) else round(float(x), digits)


def clean_escapes(text: str | None) -> str | None:
    """A text whose UTF-8 bytes were written as escapes; left as it is if they don't decode."""
    if text is None:
        return None
    try:
        return text.encode("latin-1", "backslashreplace").decode("unicode-escape").encode("latin1").decode("utf-8")
    except UnicodeError:
        return text


def lenient_json(text: str | None) -> str | None:
    """The first JSON value in a text: the whole, a fence, or the first stretch of lines from one with { to one with } that
    is JSON; null without one. A stretch ends where the value that begins its first line ends, so each first line is read once."""
    if text is None:
        return None
    import re
    for t in (text, *re.findall(r"```json\s*(.*?)```", text, re.S), *re.findall(r"```\w*\s*(.*?)```", text, re.S)):
        try:
            return json.dumps(json.loads(t), sort_keys=True)
        except (ValueError, RecursionError):
            pass
    decode, at = json.JSONDecoder().raw_decode, 0
    for line in text.split("\n"):
        if "{" in line:
            try:
                value, end = decode(text, at + len(line) - len(line.lstrip(" \t\r")))
            except (ValueError, RecursionError):
                pass
            else:
                stop = text.find("\n", end)
                rest = text[end : len(text) if stop < 0 else stop]
                if not rest.strip(" \t\r") and "}" in text[max(at, text.rfind("\n", 0, end) + 1) : end]:
                    return json.dumps(value, sort_keys=True)
        at += len(line) + 1
    return None


def canonical(text: str | None) -> str | None:
    """Nested JSON with sorted keys; null if malformed. 1 and "1" stay different."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


def loose_key(value: object) -> object:
    """Equal for values that are equal up to order in sets, and up to case and punctuation in strings."""
    if isinstance(value, dict):
        return tuple(sorted((str(k), repr(loose_key(v))) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(loose_key, value))
    if isinstance(value, (set, frozenset)):
        return tuple(sorted(repr(loose_key(v)) for v in value))
    return "".join(c for c in value if c.isalnum()).lower() if isinstance(value, str) else value


def batched(f: Callable, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in xs], dtype=object)

    return run


def parallel_map(df: DataFrame, f: Callable[[dict], object], column: str, kind: str, keep: list[str]) -> DataFrame:
    """f on every row, a partition at a time; rows keep their keys, so no order is needed."""
    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in keep], f"{column} {kind}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = b[keep].copy()
            got[column] = [f(r) for r in b.to_dict("records")]
            yield got

    return df.mapInPandas(run, schema)


def parallel_filter(df: DataFrame, f: Callable[[object], bool], column: str) -> DataFrame:
    return df.where(batched(lambda x: bool(f(x)), "boolean")(F.col(column)))


def without_errors(df: DataFrame, error: str, order: str) -> DataFrame:
    """Rows without an error; if all failed, the first error is raised."""
    first = df.agg(F.count_if(F.col(error).isNull()).alias("ok"), F.min(F.struct(order, error)).alias("x")).select("ok", F.col(f"x.{error}").alias("__first"))
    j = df.crossJoin(F.broadcast(first))  # one row
    return j.where(F.col(error).isNull() | (F.when((F.col("ok") == 0), F.raise_error(F.col("__first")).cast("boolean")))).select(df.columns)


def memoized(df: DataFrame, keys: list[str], call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each distinct input is called once; its answer is joined back."""
    return df.join(call(df.select(*keys).distinct()), keys, "left")


def recorded(requests: DataFrame, responses: DataFrame, keys: list[str], default: str | None = None) -> DataFrame:
    """A model call by its recorded response: requests with `response`, or the default."""
    got = requests.join(responses.select(*keys, "response"), keys, "left")
    return got.withColumn("response", F.coalesce("response", F.lit(default))) if default is not None else got


def routed(models: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(id, need) with the least able model(model, capability, seq) that is able enough, of equally able ones the first; null
    without one, or without a need."""
    able = models.groupBy("capability").agg(F.min(F.struct("seq", "model")).alias("m")).select(F.col("capability").alias("need"), "m.model")
    met = least_from(able, requests.select("need").where("need IS NOT NULL").distinct(), "need", "model")
    return requests.join(met, "need", "left").select("id", "model")


def evaluated(df: DataFrame, response: str, label: str, error: str) -> DataFrame:
    return df.select("*", F.col(error).isNotNull().alias("is_error"), (F.col(error).isNull() & F.coalesce(F.col(response) == F.col(label), F.lit(False))).alias("is_correct"))


def kind_of_record(keys: Column) -> Column:
    """The kind of a labelled record by the keys it has."""
    has = lambda k: F.array_contains(keys, k)
    return F.when(has("options") & has("instruction"), "classify").when(has("estimate") | has("min"), "score").when(has("type_definition") | has("typ"), "parse").when(has("text") & has("instruction"), "generate").when(has("instruction"), "binary_classify").otherwise("unknown")


class Registry:
    """Names with versions: make(name) gives a frame through its wrappers, `-raw` without."""

    def __init__(self):
        self.made: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, source: Callable[..., DataFrame], wrappers: dict[str, list[Callable[[DataFrame], DataFrame]]] | None = None) -> None:
        self.made[f"{name}-raw"] = source
        for version, chain in ({"": []} | (wrappers or {})).items():
            def make(*a, _chain=tuple(chain), **k):
                df = source(*a, **k)
                for w in _chain:
                    df = df.transform(w)
                return df
            self.made[f"{name}-{version}" if version else name] = make

    def make(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self.made:
            raise KeyError(name)
        return self.made[name](*args, **kwargs)
