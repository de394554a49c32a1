"""Compile expression documents into columns.

Every operator is a plan-time function of static types; what reaches the
executors is built-in Spark expressions, except for regular-expression captures.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import paths
from tarn.functions.types import (
    BOOL, DATE, DOUBLE, INT, LONG, NULL, STRING, PipelineError, Typed, as_type, compare, equal, is_date, is_integer, is_null, is_number,
    is_string, less, null_of, truthy, type_name, widest,
)


class Remove:
    """The value of ``$$REMOVE``: the field is left out."""


REMOVE = Remove()
#: results of $redact, told apart as texts
REDACT = {"$$DESCEND": "descend", "$$PRUNE": "prune", "$$KEEP": "keep"}


@dataclass(frozen=True)
class Scope:
    """What names mean: the row's schema and the variables in force."""

    schema: T.StructType
    variables: dict[str, Typed] = field(default_factory=dict)
    base: Column | None = None  #: the document fields belong to, when it is not the row itself

    def bind(self, **values: Typed) -> Scope:
        return replace(self, variables=self.variables | values)

    def field(self, path: str) -> Typed:
        if self.base is None:
            return paths.resolve(self.schema, path)
        found = paths.walk(Typed(self.base, self.schema), path.split("."))
        return found if found is not None else null_of()


Operator = Callable[["Compiler", Any], Typed]
OPERATORS: dict[str, Operator] = {}


def operator(*names: str) -> Callable[[Operator], Operator]:
    def register(f: Operator) -> Operator:
        for n in names:
            OPERATORS[n] = f
        return f

    return register


def literal(value: Any) -> Typed:
    """A typed constant; documents become structs and lists arrays of one common type."""
    if isinstance(value, Typed):
        return value
    if value is None:
        return Typed(F.lit(None), NULL, None)
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOL, value)
    if isinstance(value, int):
        t = INT if -(2**31) <= value < 2**31 else LONG
        return Typed(F.lit(value).cast(t), t, value)
    if isinstance(value, float):
        return Typed(F.lit(value), DOUBLE, value)
    if isinstance(value, str):
        return Typed(F.lit(value), STRING, value)
    if isinstance(value, (bytes, bytearray)):
        return Typed(F.lit(bytes(value)), T.BinaryType(), bytes(value))
    if isinstance(value, dt.datetime):
        utc = value if value.tzinfo is None else value.astimezone(dt.UTC).replace(tzinfo=None)
        return Typed(F.lit(utc.isoformat(sep=" ")).cast(DATE), DATE, value)
    if isinstance(value, dt.date):
        return Typed(F.lit(value.isoformat()).cast(DATE), DATE, value)
    if isinstance(value, re.Pattern):
        return Typed(F.lit(value.pattern), STRING, value)
    if isinstance(value, dict):
        return replace(struct({k: literal(v) for k, v in value.items()}), value=value)
    if isinstance(value, (list, tuple)):
        return replace(array([literal(v) for v in value]), value=list(value))
    raise PipelineError(f"no column type for a constant of {type(value).__name__}")


def struct(fields: dict[str, Typed]) -> Typed:
    if not fields:
        return Typed(F.from_json(F.lit("{}"), T.StructType([])), T.StructType([]))
    return Typed(F.struct(*[v.col.alias(k) for k, v in fields.items()]), T.StructType([T.StructField(k, v.type) for k, v in fields.items()]))


def array(items: Sequence[Typed]) -> Typed:
    if not items:
        return Typed(F.array(), T.ArrayType(NULL))
    t = widest([i.type for i in items])
    return Typed(F.array(*[as_type(i, t) for i in items]), T.ArrayType(t, True))


class Compiler:
    """Compiles expressions in a scope."""

    def __init__(self, scope: Scope) -> None:
        self.scope = scope

    def within(self, **values: Typed) -> Compiler:
        return Compiler(self.scope.bind(**values))

    def root(self) -> Typed:
        if self.scope.base is not None:
            return Typed(self.scope.base, self.scope.schema)
        names = self.scope.schema.names
        return Typed(F.struct(*[F.col(paths.quoted(n)) for n in names]), self.scope.schema)

    def __call__(self, e: Any) -> Typed:
        if isinstance(e, str) and e.startswith("$$"):
            return self.variable(e)
        if isinstance(e, str) and e.startswith("$") and len(e) > 1:
            return self.scope.field(e[1:])
        if isinstance(e, dict):
            keys = list(e)
            if keys and keys[0].startswith("$"):
                op = OPERATORS.get(keys[0])
                if op is None:
                    raise PipelineError(f"unknown expression {keys[0]}")
                return op(self, e[keys[0]])
            fields = {k: self(v) for k, v in e.items() if v != "$$REMOVE"}
            return struct(fields)
        if isinstance(e, (list, tuple)):
            return array([self(x) for x in e])
        return literal(e)

    def variable(self, name: str) -> Typed:
        head, *rest = name[2:].split(".")
        if head in ("ROOT", "CURRENT"):
            if not rest:
                return self.root()
            return self.scope.field(".".join(rest))
        if head == "NOW":
            return Typed(F.current_timestamp(), DATE)
        if name in REDACT:
            return Typed(F.lit(REDACT[name]), STRING)
        if name == "$$REMOVE":
            return null_of()
        bound = self.scope.variables.get(head)
        if bound is None:
            raise PipelineError(f"undefined variable $${head}")
        found = paths.walk(bound, rest)
        return found if found is not None else null_of()

    def many(self, arg: Any, least: int = 0, most: int | None = None, name: str = "operator") -> list[Typed]:
        items = list(arg) if isinstance(arg, (list, tuple)) else [arg]
        if len(items) < least or (most is not None and len(items) > most):
            raise PipelineError(f"{name} takes {least}{'' if most == least else ' or more'} arguments, not {len(items)}")
        return [self(i) for i in items]

    def one(self, arg: Any) -> Typed:
        return self(arg[0]) if isinstance(arg, (list, tuple)) and len(arg) == 1 else self(arg)

    def options(self, arg: Any, name: str, *required: str) -> dict[str, Any]:
        if not isinstance(arg, dict) or any(k not in arg for k in required):
            raise PipelineError(f"{name} requires a document with {', '.join(required)}")
        return arg


def compile_expression(e: Any, schema: T.StructType) -> Typed:
    return Compiler(Scope(schema))(e)


# ---- arithmetic ----------------------------------------------------------------------------------------------------


def _double(v: Typed) -> Column:
    return v.col.cast("double")


def _sum_type(types: Sequence[T.DataType]) -> T.DataType:
    t = widest(types)
    return INT if is_integer(t) and not isinstance(t, T.LongType) else DOUBLE if isinstance(t, T.FloatType) else t


def _millis(v: Typed) -> Column:
    return F.unix_millis(v.col.cast("timestamp"))


@operator("$add")
def _add(c: Compiler, arg: Any) -> Typed:
    vs = c.many(arg)
    dates = [v for v in vs if is_date(v.type)]
    if dates:
        if len(dates) > 1 or any(not is_number(v.type) and not is_date(v.type) for v in vs):
            return null_of(DATE)
        total = _millis(dates[0])
        for v in vs:
            if v is not dates[0]:
                total = total + v.col.cast("long")
        return Typed(F.timestamp_millis(total), DATE)
    if any(not is_number(v.type) for v in vs):
        return null_of(DOUBLE)
    if not vs:
        return literal(0)
    t = _sum_type([v.type for v in vs])
    out = as_type(vs[0], t)
    for v in vs[1:]:
        out = out + as_type(v, t)
    return Typed(out, t)


@operator("$subtract")
def _subtract(c: Compiler, arg: Any) -> Typed:
    a, b = c.many(arg, 2, 2, "$subtract")
    if is_date(a.type) and is_date(b.type):
        return Typed(_millis(a) - _millis(b), LONG)
    if is_date(a.type) and is_number(b.type):
        return Typed(F.timestamp_millis(_millis(a) - b.col.cast("long")), DATE)
    if not (is_number(a.type) and is_number(b.type)):
        return null_of(DOUBLE)
    t = _sum_type([a.type, b.type])
    return Typed(as_type(a, t) - as_type(b, t), t)


@operator("$multiply")
def _multiply(c: Compiler, arg: Any) -> Typed:
    vs = c.many(arg)
    if any(not is_number(v.type) for v in vs):
        return null_of(DOUBLE)
    if not vs:
        return literal(1)
    t = _sum_type([v.type for v in vs])
    if isinstance(t, T.DecimalType):
        t = DOUBLE
    out = as_type(vs[0], t)
    for v in vs[1:]:
        out = out * as_type(v, t)
    return Typed(out, t)


def _pair(c: Compiler, arg: Any, name: str) -> tuple[Column, Column] | None:
    a, b = c.many(arg, 2, 2, name)
    if not (is_number(a.type) and is_number(b.type)):
        return None
    return _double(a), _double(b)


@operator("$divide")
def _divide(c: Compiler, arg: Any) -> Typed:
    p = _pair(c, arg, "$divide")
    return null_of(DOUBLE) if p is None else Typed(p[0] / p[1], DOUBLE)


@operator("$mod")
def _mod(c: Compiler, arg: Any) -> Typed:
    p = _pair(c, arg, "$mod")
    return null_of(DOUBLE) if p is None else Typed(p[0] % p[1], DOUBLE)


@operator("$pow")
def _pow(c: Compiler, arg: Any) -> Typed:
    p = _pair(c, arg, "$pow")
    return null_of(DOUBLE) if p is None else Typed(F.pow(*p), DOUBLE)


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


@operator("$log")
def _log(c: Compiler, arg: Any) -> Typed:
    p = _pair(c, arg, "$log")
    return null_of(DOUBLE) if p is None else Typed(_ln(p[0]) / _ln(p[1]), DOUBLE)


def _unary(name: str, f: Callable[[Column], Column]) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        v = c.one(arg)
        return Typed(f(_double(v)).cast("double"), DOUBLE) if is_number(v.type) else null_of(DOUBLE)

    OPERATORS[name] = compile_


for _name, _f in {
    "$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor, "$sqrt": F.sqrt, "$exp": F.exp, "$ln": _ln,
    "$log10": lambda x: F.when(x > 0, F.log10(x)).otherwise(_ln(x)),
}.items():
    _unary(_name, _f)


def _toward_zero(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def _half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("double")


def _placed(name: str, f: Callable[[Column], Column]) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        vs = c.many(arg, 1, 2, name)
        if not is_number(vs[0].type):
            return null_of(DOUBLE)
        x = _double(vs[0])
        if len(vs) == 1:
            return Typed(f(x), DOUBLE)
        scale = F.pow(F.lit(10.0), _double(vs[1]))
        return Typed(f(x * scale) / scale, DOUBLE)

    OPERATORS[name] = compile_


_placed("$trunc", _toward_zero)
_placed("$round", _half_away)

# ---- comparison, logic, conditions ---------------------------------------------------------------------------------

COMPARE: dict[str, Callable[[Typed, Typed], Column]] = {
    "$eq": equal,
    "$ne": lambda a, b: ~equal(a, b),
    "$lt": less,
    "$lte": lambda a, b: less(a, b, True),
    "$gt": lambda a, b: less(b, a),
    "$gte": lambda a, b: less(b, a, True),
}


def _comparison(name: str) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        a, b = c.many(arg, 2, 2, name)
        return Typed(COMPARE[name](a, b), BOOL)

    OPERATORS[name] = compile_


for _name in COMPARE:
    _comparison(_name)


@operator("$cmp")
def _cmp(c: Compiler, arg: Any) -> Typed:
    return Typed(compare(*c.many(arg, 2, 2, "$cmp")), INT)


def _fold(vs: Sequence[Column], both: Callable[[Column, Column], Column], empty: bool) -> Column:
    out = None
    for v in vs:
        out = v if out is None else both(out, v)
    return F.lit(empty) if out is None else out


@operator("$and")
def _and(c: Compiler, arg: Any) -> Typed:
    return Typed(_fold([truthy(v) for v in c.many(arg)], lambda a, b: a & b, True), BOOL)


@operator("$or")
def _or(c: Compiler, arg: Any) -> Typed:
    return Typed(_fold([truthy(v) for v in c.many(arg)], lambda a, b: a | b, False), BOOL)


@operator("$not")
def _not(c: Compiler, arg: Any) -> Typed:
    return Typed(~truthy(c.one(arg)), BOOL)


@operator("$cond", "$cond_ternary")
def _cond(c: Compiler, arg: Any) -> Typed:
    if isinstance(arg, dict):
        c.options(arg, "$cond", "if", "then", "else")
        arg = [arg["if"], arg["then"], arg["else"]]
    test, a, b = c.many(arg, 3, 3, "$cond")
    t = widest([a.type, b.type])
    return Typed(F.when(truthy(test), as_type(a, t)).otherwise(as_type(b, t)), t)


@operator("$ifNull")
def _if_null(c: Compiler, arg: Any) -> Typed:
    vs = c.many(arg, 2, None, "$ifNull")
    t = widest([v.type for v in vs])
    return Typed(F.coalesce(*[as_type(v, t) for v in vs]), t)


@operator("$switch")
def _switch(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$switch", "branches")
    cases = [(c(b["case"]), c(b["then"])) for b in arg["branches"]]
    if not cases:
        raise PipelineError("$switch requires at least one branch")
    default = c(arg["default"]) if "default" in arg else None
    t = widest([v.type for _, v in cases] + ([default.type] if default else []))
    out = None
    for test, v in cases:
        out = F.when(truthy(test), as_type(v, t)) if out is None else out.when(truthy(test), as_type(v, t))
    other = as_type(default, t) if default is not None else F.raise_error(F.lit("$switch: no branch matched and no default")).cast(t)
    return Typed(out.otherwise(other), t)


# ---- types ---------------------------------------------------------------------------------------------------------


@operator("$type")
def _type(c: Compiler, arg: Any) -> Typed:
    v = c.one(arg)
    if is_null(v.type):
        return literal("null")
    return Typed(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(type_name(v.type))), STRING)


def _text(v: Typed) -> Column:
    if is_date(v.type):
        t = v.col.cast("timestamp")
        fraction = F.rtrim(F.date_format(t, ".SSSSSS"), F.lit("0"))
        return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".", F.lit("")).otherwise(fraction), F.lit("Z"))
    if isinstance(v.type, (T.DoubleType, T.FloatType)):
        x = v.col.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))
    if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(v.col)
    return v.col.cast("string")


def _bad(v: Typed, what: str, t: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"cannot convert to {what}: "), v.col.cast("string"))).cast(t)


def convert(v: Typed, to: str, lenient: bool = False) -> Typed:
    """Cast to a document type; values that cannot be converted raise, or are null when ``lenient``."""
    if is_null(v.type):
        return null_of({"string": STRING, "double": DOUBLE, "int": INT, "long": LONG, "bool": BOOL, "date": DATE, "decimal": T.DecimalType(38, 10), "objectId": STRING}[to])
    c = v.col
    if to == "string":
        return Typed(_text(v), STRING)
    if to == "bool":
        return Typed(F.when(c.isNotNull(), truthy(v)), BOOL)
    if to in ("double", "int", "long"):
        t = {"double": DOUBLE, "int": INT, "long": LONG}[to]
        if is_date(v.type):
            return Typed(_millis(v).cast(t), t)
        if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
            return null_of(t) if lenient else Typed(F.when(c.isNotNull(), F.raise_error(F.lit(f"cannot convert {type_name(v.type)} to {to}")).cast(t)), t)
        return Typed(c.try_cast(t) if lenient else c.cast(t), t)
    if to == "decimal":
        t = T.DecimalType(38, 10)
        return Typed(c.try_cast(t) if lenient else c.cast(t), t)
    if to == "date":
        if is_date(v.type):
            return Typed(c.cast("timestamp"), DATE)
        if is_number(v.type):
            return Typed(F.timestamp_millis(c.cast("long")), DATE)
        if is_string(v.type):
            found = _parse_date(c)
            return Typed(found if lenient else F.when(c.isNotNull(), F.coalesce(found, _bad(v, "date", "timestamp"))), DATE)
        return null_of(DATE) if lenient else Typed(F.raise_error(F.lit(f"cannot convert {type_name(v.type)} to date")).cast("timestamp"), DATE)
    if to == "objectId":
        s = c.cast("string")
        found = F.when(s.rlike("^[0-9a-fA-F]{24}$"), F.lower(s))
        return Typed(found if lenient else F.when(s.isNotNull(), F.coalesce(found, _bad(v, "objectId", "string"))), STRING)
    raise PipelineError(f"$convert: unknown type {to}")


def _parse_date(s: Column) -> Column:
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"
    return F.when(s.rlike(iso), s.try_cast("timestamp"))


_CONVERT_NAMES = {1: "double", 2: "string", 7: "objectId", 8: "bool", 9: "date", 16: "int", 18: "long", 19: "decimal"}


@operator("$convert")
def _convert(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$convert", "input", "to")
    to = _CONVERT_NAMES.get(arg["to"], arg["to"])
    v = c(arg["input"])
    lenient = "onError" in arg
    out = convert(v, to, lenient)
    if lenient:
        e = c(arg["onError"])
        t = widest([out.type, e.type])
        out = Typed(F.when(v.col.isNotNull() & out.col.isNull(), as_type(e, t)).otherwise(as_type(out, t)), t)
    if "onNull" in arg:
        n = c(arg["onNull"])
        t = widest([out.type, n.type])
        out = Typed(F.when(v.col.isNull(), as_type(n, t)).otherwise(as_type(out, t)), t)
    return out


def _to(name: str, to: str) -> None:
    OPERATORS[name] = lambda c, arg: convert(c.one(arg), to)


for _name, _to_type in {
    "$toString": "string", "$toDouble": "double", "$toInt": "int", "$toLong": "long", "$toDecimal": "decimal",
    "$toBool": "bool", "$toDate": "date", "$toObjectId": "objectId",
}.items():
    _to(_name, _to_type)

# ---- strings -------------------------------------------------------------------------------------------------------


def _string(v: Typed, name: str) -> Column:
    if is_null(v.type):
        return F.lit(None).cast("string")
    if not is_string(v.type):
        raise PipelineError(f"{name} requires a string, not {type_name(v.type)}")
    return v.col


@operator("$concat")
def _concat(c: Compiler, arg: Any) -> Typed:
    return Typed(F.concat(*[_string(v, "$concat") for v in c.many(arg)]), STRING)


def _case(name: str, f: Callable[[Column], Column]) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        v = c.one(arg)
        return Typed(F.coalesce(f(v.col), F.lit("")), STRING) if is_string(v.type) else literal("")

    OPERATORS[name] = compile_


_case("$toLower", F.lower)
_case("$toUpper", F.upper)

#: default cutsets (fixed values): all white space for $trim, the four usual characters for the one-sided forms
_SPACE, _FOUR = "\t\n\x0b\x0c\r \x85\xa0      　", " \t\n\r"


def _trimmer(name: str, sql: str, default: str) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        chars = literal(default)
        if isinstance(arg, dict) and "input" in arg:
            v = c(arg["input"])
            chars = c(arg["chars"]) if "chars" in arg else chars
        else:
            v = c.one(arg)
        return Typed(getattr(F, sql)(_string(v, name), chars.col), STRING)

    OPERATORS[name] = compile_


_trimmer("$trim", "btrim", _SPACE)
_trimmer("$ltrim", "ltrim", _FOUR)
_trimmer("$rtrim", "rtrim", _FOUR)


def _plain(v: Typed, name: str) -> str:
    if not v.constant or not isinstance(v.value, str):
        raise PipelineError(f"{name} requires a constant text here")
    return v.value


@operator("$split")
def _split(c: Compiler, arg: Any) -> Typed:
    s, sep = c.many(arg, 2, 2, "$split")
    pattern = re.escape(sep.value) if sep.constant and sep.value is not None else None
    regex = F.lit(pattern) if pattern is not None else F.concat(F.lit(r"\Q"), _string(sep, "$split"), F.lit(r"\E"))
    return Typed(F.split(_string(s, "$split"), regex), T.ArrayType(STRING, True))


@operator("$strLenBytes")
def _len_bytes(c: Compiler, arg: Any) -> Typed:
    return Typed(F.octet_length(_string(c.one(arg), "$strLenBytes")), INT)


@operator("$strLenCP")
def _len_cp(c: Compiler, arg: Any) -> Typed:
    return Typed(F.char_length(_string(c.one(arg), "$strLenCP")), INT)


def _bounds(start: Typed, n: Typed) -> tuple[Column, Column]:
    i = F.greatest(start.col.cast("int"), F.lit(0)) + 1
    length = n.col.cast("int")
    return i, F.when(length < 0, F.lit(2**31 - 1)).otherwise(length)


@operator("$substr", "$substrBytes")
def _substr(c: Compiler, arg: Any) -> Typed:
    s, start, n = c.many(arg, 3, 3, "$substr")
    i, length = _bounds(start, n)
    return Typed(F.substring(_string(s, "$substr").cast("binary"), i, length).cast("string"), STRING)


@operator("$substrCP")
def _substr_cp(c: Compiler, arg: Any) -> Typed:
    s, start, n = c.many(arg, 3, 3, "$substrCP")
    i, length = _bounds(start, n)
    return Typed(F.substring(_string(s, "$substrCP"), i, length), STRING)


@operator("$strcasecmp")
def _strcasecmp(c: Compiler, arg: Any) -> Typed:
    a, b = (F.lower(_string(v, "$strcasecmp")) for v in c.many(arg, 2, 2, "$strcasecmp"))
    return Typed(F.when(a < b, -1).when(a > b, 1).when(a == b, 0), INT)


def java_flags(options: str) -> str:
    kept = "".join(o for o in "ims" if o in options)
    return f"(?{kept})" if kept else ""


def _regex_args(c: Compiler, arg: Any, name: str) -> tuple[Column, str, str]:
    c.options(arg, name, "input", "regex")
    pattern, options = arg["regex"], arg.get("options", "")
    if isinstance(pattern, re.Pattern):
        options += "".join(f for f, b in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & b)
        pattern = pattern.pattern
    if not isinstance(pattern, str) or pattern.startswith("$$"):
        raise PipelineError(f"{name} requires a constant pattern")
    return _string(c(arg["input"]), name), pattern, options


_MATCH = T.StructType([T.StructField("match", STRING), T.StructField("idx", INT), T.StructField("captures", T.ArrayType(STRING, True))])


def _groups(rx: str) -> int:
    """Number of capturing groups of a Java pattern; a bad pattern raises here, not on an executor."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if not rx:
        raise PipelineError("an empty pattern")
    try:
        return int(spark._jvm.java.util.regex.Pattern.compile(rx).matcher("").groupCount())
    except Exception as e:
        raise PipelineError(f"bad pattern {rx}: {str(e).splitlines()[0]}") from None


@operator("$regexFind")
def _regex_find(c: Compiler, arg: Any) -> Typed:
    s, pattern, options = _regex_args(c, arg, "$regexFind")
    rx = java_flags(options) + pattern
    part = lambda i: F.regexp_extract(s, rx, i)
    captures = F.array(*[F.nullif(part(i), F.lit("")) for i in range(1, _groups(rx) + 1)]).cast("array<string>")
    # what lies before the first match, in characters; a split never has an empty first part before an empty match
    at = F.when(F.regexp_instr(s, F.lit(rx)) == 1, F.lit(0)).otherwise(F.char_length(F.split(s, rx, 2).getItem(0)))
    return Typed(F.when(s.rlike(rx), F.struct(part(0).alias("match"), at.cast("int").alias("idx"), captures.alias("captures"))), _MATCH)


@operator("$regexFindAll")
def _regex_find_all(c: Compiler, arg: Any) -> Typed:
    s, pattern, options = _regex_args(c, arg, "$regexFindAll")
    rx = java_flags(options) + pattern
    groups = _groups(rx)
    part = lambda i: F.regexp_extract_all(s, F.lit(rx), F.lit(i))
    between = F.split(s, rx, -1)
    between = F.when(F.size(between) == F.size(part(0)), F.concat(F.array(F.lit("")), between)).otherwise(between)
    lengths = F.arrays_zip(F.transform(between, F.char_length).alias("b"), F.transform(part(0), F.char_length).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))

    def step(acc: Column, x: Column) -> Column:
        here = acc.getField("at") + x.getField("b")
        return F.struct((here + F.coalesce(x.getField("m"), F.lit(0))).alias("at"), F.concat(acc.getField("places"), F.array(here)).alias("places"))

    places = F.aggregate(lengths, start, step, lambda acc: acc.getField("places"))
    zipped = F.arrays_zip(part(0).alias("m"), F.slice(places, F.lit(1), F.size(part(0))).alias("p"), *[part(i).alias(f"g{i}") for i in range(1, groups + 1)])

    def hit(x: Column) -> Column:
        captures = F.array(*[F.nullif(x.getField(f"g{i}"), F.lit("")) for i in range(1, groups + 1)]).cast("array<string>")
        return F.struct(x.getField("m").alias("match"), x.getField("p").alias("idx"), captures.alias("captures"))

    return Typed(F.coalesce(F.transform(zipped, hit), F.array().cast(T.ArrayType(_MATCH))), T.ArrayType(_MATCH))


@operator("$regexMatch")
def _regex_match(c: Compiler, arg: Any) -> Typed:
    s, pattern, options = _regex_args(c, arg, "$regexMatch")
    return Typed(F.coalesce(s.rlike(java_flags(options) + pattern), F.lit(False)), BOOL)


def _locate(text: Column, wanted: Column) -> Column:
    """Position (from 1) of ``wanted`` in ``text``, 0 when absent; both may be columns."""
    return F.call_function("locate", wanted, text)


@operator("$replaceOne")
def _replace_one(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$replaceOne", "input", "find", "replacement")
    s, find, new = (_string(c(arg[k]), "$replaceOne") for k in ("input", "find", "replacement"))
    at = _locate(s, find)
    replaced = F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.char_length(find), F.lit(2**31 - 1)))
    return Typed(F.when(at > 0, replaced).otherwise(F.when(find.isNotNull() & new.isNotNull(), s)), STRING)


@operator("$replaceAll")
def _replace_all(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$replaceAll", "input", "find", "replacement")
    s, find, new = (_string(c(arg[k]), "$replaceAll") for k in ("input", "find", "replacement"))
    return Typed(F.replace(s, find, new), STRING)


def _index(name: str, as_bytes: bool) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        s, sub, *ends = c.many(arg, 2, 4, name)
        text, wanted = _string(s, name), _string(sub, name)
        start = F.greatest(ends[0].col.cast("int"), F.lit(0)) if ends else F.lit(0)
        rest = F.lit(2**31 - 1)
        if as_bytes:
            raw = text.cast("binary")
            raw = F.substring(raw, F.lit(1), ends[1].col.cast("int")) if len(ends) > 1 else raw
            tail = F.substring(raw, start + 1, rest).cast("string")
            at = _locate(tail, wanted)
            ahead = F.octet_length(F.substring(tail, F.lit(1), at - 1))
        else:
            text = F.substring(text, F.lit(1), ends[1].col.cast("int")) if len(ends) > 1 else text
            tail = F.substring(text, start + 1, rest)
            at = _locate(tail, wanted)
            ahead = at - 1
        return Typed(F.coalesce(F.when(at > 0, start + ahead), F.lit(-1)).cast("int"), INT)

    OPERATORS[name] = compile_


_index("$indexOfBytes", True)
_index("$indexOfCP", False)

# ---- arrays and sets -----------------------------------------------------------------------------------------------


def _array(v: Typed, name: str) -> Typed:
    if is_null(v.type):
        return Typed(v.col.cast(T.ArrayType(NULL)), T.ArrayType(NULL))
    if not isinstance(v.type, T.ArrayType):
        raise PipelineError(f"{name} requires an array, not {type_name(v.type)}")
    return v


def _arrays(vs: Sequence[Typed], name: str) -> tuple[list[Column], T.ArrayType]:
    vs = [_array(v, name) for v in vs]
    t = T.ArrayType(widest([v.type.elementType for v in vs]), True)
    return [as_type(v, t) for v in vs], t


@operator("$arrayElemAt")
def _elem_at(c: Compiler, arg: Any) -> Typed:
    a, i = c.many(arg, 2, 2, "$arrayElemAt")
    a, at = _array(a, "$arrayElemAt"), i.col.cast("int")
    return Typed(F.try_element_at(a.col, F.when(at < 0, at).otherwise(at + 1)), a.type.elementType)


@operator("$concatArrays")
def _concat_arrays(c: Compiler, arg: Any) -> Typed:
    cols, t = _arrays(c.many(arg), "$concatArrays")
    return Typed(F.concat(*cols), t) if cols else array([])


def _lambda(c: Compiler, a: Typed, name: str, body: Any) -> tuple[Callable[[Column], Column], T.DataType]:
    """The body as a function of one element, and its type."""
    kind = c.within(**{name: Typed(F.lit(None), a.type.elementType)})(body).type
    return lambda x: c.within(**{name: Typed(x, a.type.elementType)})(body).col, kind


@operator("$filter")
def _filter(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$filter", "input", "cond")
    a, name = _array(c(arg["input"]), "$filter"), arg.get("as", "this")
    out = F.filter(a.col, lambda x: truthy(c.within(**{name: Typed(x, a.type.elementType)})(arg["cond"])))
    if "limit" in arg:
        out = F.slice(out, F.lit(1), c(arg["limit"]).col.cast("int"))
    return Typed(out, a.type)


@operator("$map")
def _map(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$map", "input", "in")
    a = _array(c(arg["input"]), "$map")
    f, kind = _lambda(c, a, arg.get("as", "this"), arg["in"])
    return Typed(F.transform(a.col, f), T.ArrayType(kind, True))


@operator("$reduce")
def _reduce(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$reduce", "input", "initialValue", "in")
    a, zero = _array(c(arg["input"]), "$reduce"), c(arg["initialValue"])
    item = Typed(F.lit(None), a.type.elementType)
    t = zero.type
    for _ in range(4):  # the type of the running value settles after a step or two
        grown = widest([t, c.within(value=Typed(F.lit(None), t), this=item)(arg["in"]).type])
        if grown == t:
            break
        t = grown

    def merge(acc: Column, x: Column) -> Column:
        return as_type(c.within(value=Typed(acc, t), this=Typed(x, a.type.elementType))(arg["in"]), t)

    return Typed(F.aggregate(a.col, zero.col.cast(t), merge), t)


@operator("$first")
def _first(c: Compiler, arg: Any) -> Typed:
    a = _array(c.one(arg), "$first")
    return Typed(F.get(a.col, F.lit(0)), a.type.elementType)


@operator("$last")
def _last(c: Compiler, arg: Any) -> Typed:
    a = _array(c.one(arg), "$last")
    return Typed(F.try_element_at(a.col, F.lit(-1)), a.type.elementType)


@operator("$in")
def _in(c: Compiler, arg: Any) -> Typed:
    v, a = c.many(arg, 2, 2, "$in")
    if not isinstance(a.type, T.ArrayType):
        raise PipelineError("$in requires an array as its second argument")
    return Typed(F.coalesce(F.exists(a.col, lambda x: equal(Typed(x, a.type.elementType), v)), F.lit(False)), BOOL)


@operator("$indexOfArray")
def _index_of_array(c: Compiler, arg: Any) -> Typed:
    a, v, *ends = c.many(arg, 2, 4, "$indexOfArray")
    a = _array(a, "$indexOfArray")
    start = F.greatest(ends[0].col.cast("int"), F.lit(0)) if ends else F.lit(0)
    stop = ends[1].col.cast("int") if len(ends) > 1 else F.size(a.col)
    marked = F.transform(a.col, lambda x, i: F.when(equal(Typed(x, a.type.elementType), v) & (i >= start) & (i < stop), i))
    return Typed(F.when(a.col.isNotNull(), F.coalesce(F.array_min(marked), F.lit(-1))).cast("int"), INT)


@operator("$isArray")
def _is_array(c: Compiler, arg: Any) -> Typed:
    v = c.one(arg)
    return Typed(v.col.isNotNull() if isinstance(v.type, T.ArrayType) else F.lit(False), BOOL)


@operator("$reverseArray")
def _reverse(c: Compiler, arg: Any) -> Typed:
    a = _array(c.one(arg), "$reverseArray")
    return Typed(F.reverse(a.col), a.type)


@operator("$size")
def _size(c: Compiler, arg: Any) -> Typed:
    a = _array(c.one(arg), "$size")
    return Typed(F.when(a.col.isNotNull(), F.size(a.col)), INT)


def slice_of(a: Column, n: Column, skip: Column | None = None) -> Column:
    """``n`` elements from ``skip``; a negative ``n`` alone takes the last ones, a negative skip counts from the end."""
    size = F.size(a)
    if skip is None:
        start = F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(F.lit(0))
        n = F.abs(n)
    else:
        start = F.when(skip < 0, F.greatest(size + skip, F.lit(0))).otherwise(F.least(skip, size))
    return F.slice(a, start + 1, F.greatest(n, F.lit(0)))


@operator("$slice")
def _slice(c: Compiler, arg: Any) -> Typed:
    a, *rest = c.many(arg, 2, 3, "$slice")
    a = _array(a, "$slice")
    ns = [r.col.cast("int") for r in rest]
    return Typed(slice_of(a.col, ns[-1], ns[0] if len(ns) == 2 else None), a.type)


@operator("$zip")
def _zip(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$zip", "inputs")
    vs = [_array(c(i), "$zip") for i in arg["inputs"]]
    longest = bool(arg.get("useLongestLength", False))
    defaults = [c(d) for d in arg.get("defaults", [])]
    t = widest([v.type.elementType for v in vs] + [d.type for d in defaults])
    sizes = [F.size(v.col) for v in vs]
    n = sizes[0] if len(sizes) == 1 else (F.greatest if longest else F.least)(*sizes)

    def pick(i: int, at: Column) -> Column:
        e = Typed(F.get(vs[i].col, at), vs[i].type.elementType)
        if longest and i < len(defaults):
            return F.when(at >= sizes[i], as_type(defaults[i], t)).otherwise(as_type(e, t))
        return as_type(e, t)

    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda at: F.array(*[pick(i, at) for i in range(len(vs))]))
    out_t = T.ArrayType(T.ArrayType(t, True), True)
    return Typed(F.when(n > 0, rows).when(n == 0, F.array().cast(out_t)), out_t)


@operator("$range")
def _range(c: Compiler, arg: Any) -> Typed:
    start, stop, *by = c.many(arg, 2, 3, "$range")
    a, b = start.col.cast("int"), stop.col.cast("int")
    step = by[0].col.cast("int") if by else F.lit(1)
    step = F.when(step == 0, F.lit(1)).otherwise(step)
    last = b - F.signum(step).cast("int")
    runs = ((step > 0) & (a < b)) | ((step < 0) & (a > b))
    t = T.ArrayType(INT, True)
    # the bounds are guarded too: branches of a condition may be evaluated early
    safe = F.sequence(a, F.when(runs, last).otherwise(a), F.when(runs, step).otherwise(F.lit(1)))
    return Typed(F.when(runs, safe).when(a.isNotNull() & b.isNotNull(), F.array().cast(t)), t)


@operator("$objectToArray")
def _object_to_array(c: Compiler, arg: Any) -> Typed:
    v = c.one(arg)
    if isinstance(v.type, T.MapType):
        t = T.ArrayType(T.StructType([T.StructField("k", v.type.keyType), T.StructField("v", v.type.valueType)]), True)
        return Typed(F.transform(F.map_entries(v.col), lambda e: F.struct(e.getField("key").alias("k"), e.getField("value").alias("v"))), t)
    if not isinstance(v.type, T.StructType):
        raise PipelineError("$objectToArray requires a document")
    kind = widest([f.dataType for f in v.type.fields])
    t = T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", kind)]), True)
    items = [F.struct(F.lit(f.name).alias("k"), as_type(Typed(v.col.getField(f.name), f.dataType), kind).alias("v")) for f in v.type.fields]
    return Typed(F.when(v.col.isNotNull(), F.array(*items)), t)


@operator("$arrayToObject")
def _array_to_object(c: Compiler, arg: Any) -> Typed:
    a = _array(c.one(arg), "$arrayToObject")
    e = a.type.elementType
    if isinstance(e, T.StructType):
        entries, kind = F.transform(a.col, lambda x: F.struct(x.getField("k").cast("string"), x.getField("v"))), e["v"].dataType
    elif isinstance(e, T.ArrayType):
        entries, kind = F.transform(a.col, lambda x: F.struct(F.get(x, F.lit(0)).cast("string"), F.get(x, F.lit(1)))), e.elementType
    else:
        raise PipelineError("$arrayToObject requires pairs")
    return Typed(F.map_from_entries(entries), T.MapType(STRING, kind))


@operator("$mergeObjects")
def _merge_objects(c: Compiler, arg: Any) -> Typed:
    vs = [v for v in c.many(arg) if not is_null(v.type)]
    if any(isinstance(v.type, T.MapType) for v in vs):
        return Typed(F.map_concat(*[F.coalesce(v.col, F.map_from_arrays(F.array(), F.array()).cast(v.type)) for v in vs]), vs[0].type)
    out: dict[str, Typed] = {}
    for v in vs:
        if not isinstance(v.type, T.StructType):
            raise PipelineError("$mergeObjects requires documents")
        for f in v.type.fields:
            new = Typed(v.col.getField(f.name), f.dataType)
            if f.name in out and len(vs) > 1:
                old = out[f.name]
                t = widest([old.type, new.type])
                # a document that is null contributes nothing; a field that is null in it does
                new = Typed(F.when(v.col.isNull(), as_type(old, t)).otherwise(as_type(new, t)), t)
            out[f.name] = new
    return struct(out)


def _sets(name: str, f: Callable[..., Column], least: int, most: int | None, kind: T.DataType | None) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        vs = c.many(arg, least, most, name)
        if kind is None and name == "$setUnion":
            vs = [v for v in vs if not is_null(v.type)]
        cols, t = _arrays(vs, name)
        if name == "$setUnion":
            cols = [F.coalesce(x, F.array().cast(t)) for x in cols]  # null is ignored
        return Typed(f(*cols), kind or t)

    OPERATORS[name] = compile_


def _left(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def run(*cols: Column) -> Column:
        out = F.array_distinct(cols[0]) if len(cols) == 1 else cols[0]
        for x in cols[1:]:
            out = f(out, x)
        return out

    return run


def _empty_difference(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


_sets("$setEquals", lambda a, b: F.coalesce(_empty_difference(a, b) & _empty_difference(b, a), F.lit(False)), 2, 2, BOOL)
_sets("$setIntersection", _left(F.array_intersect), 1, None, None)
_sets("$setUnion", _left(F.array_union), 1, None, None)
_sets("$setDifference", F.array_except, 2, 2, None)
_sets("$setIsSubset", lambda a, b: F.coalesce(_empty_difference(a, b), F.lit(False)), 2, 2, BOOL)


def _elements(name: str, f: Callable, empty: bool) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        a = c.one(arg)
        if not isinstance(a.type, T.ArrayType):
            a = array(c.many(arg))
        return Typed(F.coalesce(f(a.col, lambda x: truthy(Typed(x, a.type.elementType))), F.lit(empty)), BOOL)

    OPERATORS[name] = compile_


_elements("$anyElementTrue", F.exists, False)
_elements("$allElementsTrue", F.forall, True)


@operator("$let")
def _let(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$let", "vars", "in")
    return c.within(**{k: c(v) for k, v in arg["vars"].items()})(arg["in"])


@operator("$literal")
def _literal(_: Compiler, arg: Any) -> Typed:
    return literal(arg)


@operator("$now")
def _now(_c: Compiler, _: Any) -> Typed:
    return Typed(F.current_timestamp(), DATE)


@operator("$toHashedIndexKey")
def _hashed(c: Compiler, arg: Any) -> Typed:
    return Typed(F.xxhash64(c.one(arg).col), LONG)


# ---- dates ---------------------------------------------------------------------------------------------------------


def _date(c: Compiler, arg: Any) -> Column | None:
    """The timestamp of ``date`` or {date, timezone}, shifted to the named zone; None when it is no date."""
    zone = None
    if isinstance(arg, dict) and "date" in arg:
        zone = c(arg["timezone"]) if "timezone" in arg else None
        v = c(arg["date"])
    else:
        v = c.one(arg)
    if not is_date(v.type):
        return None
    t = v.col.cast("timestamp")
    return t if zone is None else F.from_utc_timestamp(t, zone.col)


def _date_part(name: str, f: Callable[[Column], Column]) -> None:
    def compile_(c: Compiler, arg: Any) -> Typed:
        t = _date(c, arg)
        return null_of(INT) if t is None else Typed(f(t).cast("int"), INT)

    OPERATORS[name] = compile_


def _extract(what: str) -> Callable[[Column], Column]:
    return lambda t: F.extract(F.lit(what), t)


for _name, _f in {
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second,
    "$millisecond": lambda t: F.pmod(F.unix_millis(t), F.lit(1000)), "$dayOfYear": F.dayofyear, "$dayOfWeek": F.dayofweek,
    "$week": F.weekofyear, "$isoWeek": F.weekofyear, "$isoDayOfWeek": _extract("DAYOFWEEK_ISO"), "$isoWeekYear": _extract("YEAROFWEEK"),
}.items():
    _date_part(_name, _f)

_DATE_FORMAT: dict[str, Callable[[Column], Column]] = {
    "Y": lambda t: F.date_format(t, "yyyy"),
    "m": lambda t: F.date_format(t, "MM"),
    "d": lambda t: F.date_format(t, "dd"),
    "H": lambda t: F.date_format(t, "HH"),
    "M": lambda t: F.date_format(t, "mm"),
    "S": lambda t: F.date_format(t, "ss"),
    "L": lambda t: F.date_format(t, "SSS"),
    "j": lambda t: F.lpad(F.dayofyear(t).cast("string"), 3, "0"),
    "u": lambda t: (F.dayofweek(t) - 1).cast("string"),
    "V": lambda t: F.lpad(F.weekofyear(t).cast("string"), 2, "0"),
    "G": lambda t: F.extract(F.lit("YEAROFWEEK"), t).cast("string"),
    "Z": lambda t: F.lit("UTC"),
    "%": lambda t: F.lit("%"),
}


def format_date(t: Column, pattern: str) -> Column:
    parts: list[Column] = []
    for text, spec in re.findall(r"([^%]+)|%(.)", pattern):
        if text:
            parts.append(F.lit(text))
        elif spec in _DATE_FORMAT:
            parts.append(_DATE_FORMAT[spec](t))
        else:
            parts.append(F.lit(f"%{spec}"))
    return F.when(t.isNotNull(), F.concat(*parts))


@operator("$dateToString")
def _date_to_string(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$dateToString", "date")
    t = _date(c, {k: arg[k] for k in ("date", "timezone") if k in arg})
    out = null_of(STRING) if t is None else Typed(format_date(t, arg.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")), STRING)
    if "onNull" in arg:
        out = Typed(F.coalesce(out.col, c(arg["onNull"]).col.cast("string")), STRING)
    return out


#: date pattern letters in Spark's notation (fixed values)
_PARSE_FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%z": "XX", "%%": "%"}


@operator("$dateFromString")
def _date_from_string(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$dateFromString", "dateString")
    v = c(arg["dateString"])
    if not is_string(v.type):
        return null_of(DATE)
    if "format" in arg:
        pattern = re.sub(r"%.|[A-Za-z]+", lambda m: _PARSE_FORMAT.get(m[0], f"'{m[0]}'"), arg["format"])
        found = F.try_to_timestamp(v.col, F.lit(pattern))
    else:
        found = _parse_date(v.col)
    if "onError" in arg:
        e = c(arg["onError"])
        out = F.when(v.col.isNotNull(), F.coalesce(found, e.col.cast("timestamp")))
    else:
        out = F.when(v.col.isNotNull(), F.coalesce(found, _bad(v, "date", "timestamp")))
    if "onNull" in arg:
        out = F.when(v.col.isNull(), c(arg["onNull"]).col.cast("timestamp")).otherwise(out)
    return Typed(out, DATE)


#: milliseconds of the units of fixed length, months of the others (fixed values)
UNIT_MILLIS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
UNIT_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _unit(arg: dict, name: str) -> str:
    unit = arg["unit"]
    if unit not in UNIT_MILLIS and unit not in UNIT_MONTHS:
        raise PipelineError(f"{name}: unknown unit {unit}")
    return unit


@operator("$dateAdd")
def _date_add(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$dateAdd", "startDate", "unit", "amount")
    v, n, unit = c(arg["startDate"]), c(arg["amount"]), _unit(arg, "$dateAdd")
    if not is_date(v.type):
        return null_of(DATE)
    t = v.col.cast("timestamp")
    if unit in UNIT_MILLIS:
        return Typed(F.timestamp_micros(F.unix_micros(t) + n.col.cast("long") * F.lit(UNIT_MILLIS[unit] * 1000).cast("long")), DATE)
    return Typed(t + F.make_ym_interval(F.lit(0), n.col.cast("int") * UNIT_MONTHS[unit]), DATE)


@operator("$dateDiff")
def _date_diff(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$dateDiff", "startDate", "endDate", "unit")
    a, b, unit = c(arg["startDate"]), c(arg["endDate"]), _unit(arg, "$dateDiff")
    if not (is_date(a.type) and is_date(b.type)):
        return null_of(LONG)
    x, y = a.col.cast("timestamp"), b.col.cast("timestamp")
    if unit in UNIT_MILLIS:
        d = F.unix_millis(y) - F.unix_millis(x)
        return Typed((F.signum(d).cast("long") * F.floor(F.abs(d) / UNIT_MILLIS[unit])).cast("long"), LONG)
    if unit == "quarter":
        return Typed(((F.year(y) - F.year(x)) * 4 + F.quarter(y) - F.quarter(x)).cast("long"), LONG)
    years = F.year(y) - F.year(x)
    return Typed((years if unit == "year" else years * 12 + F.month(y) - F.month(x)).cast("long"), LONG)


@operator("$dateTrunc")
def _date_trunc(c: Compiler, arg: Any) -> Typed:
    c.options(arg, "$dateTrunc", "date", "unit")
    v, unit = c(arg["date"]), _unit(arg, "$dateTrunc")
    if not is_date(v.type):
        return null_of(DATE)
    t = v.col.cast("timestamp")
    if unit == "week":  # weeks start on Sunday
        day = F.date_trunc("DAY", t)
        return Typed(F.timestamp_micros(F.unix_micros(day) - (F.dayofweek(day) - 1).cast("long") * F.lit(86_400_000_000)), DATE)
    return Typed(F.date_trunc(unit.upper(), t), DATE)
