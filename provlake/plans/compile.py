"""CEL predicates to Spark Columns.

An error in CEL is NULL here: comparison, AND, OR, NOT, exists and forall are three-valued in Spark, which gives CEL's
absorption of errors (false && error is false, true || error is true). Nothing that is generated raises on a row.

Arguments are a VARIANT, so a member of it has a type for each row: where an operator needs a type, a value of another
type is NULL (an error), never a converted value. Two such members are compared by the types they have in the row:
numbers of any kind as numbers, texts as texts, truths as truths; lists, objects and nulls only for equality. What they
add up to is again a VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.errors import CelError
from provlake.plans.cel import MACROS, Node, bare, parse, uses_any
from provlake.runtime import session


@dataclass(frozen=True)
class Typed:
    """A Column and what is known of its type: bool, string, int, double, bytes, null, variant, list, struct, timestamp,
    duration (microseconds) or type (the name of one)."""

    col: Column
    kind: str
    item: "Typed | None" = None  # of a list: its element's kind and fields, with no Column of its own
    fields: dict[str, "Typed"] = field(default_factory=dict)  # of a struct

    def at(self, col: Column) -> "Typed":
        """The same type over another Column."""
        return Typed(col, self.kind, self.item, {k: v.at(col[k]) for k, v in self.fields.items()})


def text_list(col: Column | None) -> Typed:
    return Typed(col, "list", Typed(col, "string"))


def context(col: Callable[[str], Column] = F.col) -> dict[str, Typed]:
    """The names that a rule can use, over the columns that operators.decide prepares."""
    session()
    empty = F.lit(None)
    label = Typed(
        empty,
        "struct",
        fields={k: Typed(empty, "string") for k in ("source", "trust")} | {
            k: text_list(empty) for k in ("lineage", "ingested_by", "endorsements")
        },
    )
    return {
        "tool": Typed(col("tool"), "string"),
        "args": Typed(col("args"), "variant"),
        "taint": Typed(col("taint"), "list", label),
        "sources": text_list(col("sources")),
        "max_trust": Typed(col("max_trust"), "string"),
        "trifecta": text_list(col("trifecta")),
        "run": Typed(empty, "struct", fields={"tainted": Typed(col("run_tainted"), "bool"), "sources": text_list(col("run_sources")), "untrusted_sources": text_list(col("run_untrusted_sources")), "ingested_by": text_list(col("run_ingested_by")), "trifecta": text_list(col("run_trifecta"))}),
        "agent": Typed(empty, "struct", fields={"id": Typed(col("agent_id"), "string"), "groups": text_list(col("agent_groups"))}),
    }


_VARIANT_AS = {
    "string": ("string", ("STRING",)),
    "int": ("bigint", ("BIGINT",)),
    "double": ("double", ("BIGINT", "DOUBLE", "FLOAT")),
    "bool": ("boolean", ("BOOLEAN",)),
}
_CAST = {"string": "string", "int": "bigint", "uint": "bigint", "double": "double", "bool": "boolean"}
_NUMBERS = ("int", "double")
_ORDER: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda x, y: x == y,
    "!=": lambda x, y: x != y,
    "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y,
    ">": lambda x, y: x > y,
    ">=": lambda x, y: x >= y,
}
# The names of CEL's types, by what schema_of_variant says first.
_TYPE_NAMES = {
    "STRING": "string",
    "BIGINT": "int",
    "DOUBLE": "double",
    "FLOAT": "double",
    "DECIMAL": "double",
    "BOOLEAN": "bool",
    "VOID": "null_type",
    "ARRAY": "list",
    "OBJECT": "map",
}
_TYPES = frozenset({*_TYPE_NAMES.values(), "bytes", "uint", "type", "google"} - {"google"})
_KIND_TYPES = {
    "bool": "bool",
    "string": "string",
    "int": "int",
    "double": "double",
    "bytes": "bytes",
    "null": "null_type",
    "list": "list",
    "struct": "map",
}
_GETTERS = {
    "getFullYear": (F.year, 0),
    "getMonth": (F.month, -1),
    "getDayOfMonth": (F.dayofmonth, -1),
    "getDate": (F.dayofmonth, 0),
    "getDayOfYear": (F.dayofyear, -1),
    "getDayOfWeek": (F.dayofweek, -1),
    "getHours": (F.hour, 0),
    "getMinutes": (F.minute, 0),
    "getSeconds": (F.second, 0),
}
_UNITS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}


def _as(x: Typed, kind: str) -> Column:
    """The value as the kind that an operator needs; NULL for a row of another type."""
    if x.kind == "variant" and kind in _VARIANT_AS:
        to, names = _VARIANT_AS[kind]
        stated = F.schema_of_variant(x.col)
        fits = stated.isin(*names) | stated.startswith("DECIMAL") if kind == "double" else stated.isin(*names)
        return F.when(fits, F.try_variant_get(x.col, "$", to))
    if x.kind == "variant" and kind == "list":
        return F.when(F.schema_of_variant(x.col).startswith("ARRAY"), F.try_variant_get(x.col, "$", "array<variant>"))
    if x.kind == kind:
        return x.col
    if kind == "double" and x.kind == "int":
        return x.col.cast("double")
    raise CelError(f"a {kind} is needed where the expression has a {x.kind}")


def _numeric(x: Typed) -> Column:
    """A number of any kind as a double; NULL for anything else."""
    return _as(x, "double")


def _whole(x: Typed) -> Column:
    return _as(x, "int") if x.kind in ("variant", "int") else F.lit(None).cast("bigint")


def _text_of(x: Typed) -> Column:
    return _as(x, "string") if x.kind in ("variant", "string") else F.lit(None).cast("string")


def _type_of(x: Typed) -> Column:
    """The name of the value's type in CEL."""
    if x.kind != "variant":
        return F.lit(_KIND_TYPES.get(x.kind, x.kind))
    stated, out = F.schema_of_variant(x.col), F.lit(None).cast("string")
    for start, name in _TYPE_NAMES.items():
        out = F.when(stated.startswith(start), F.lit(name)).otherwise(out)
    return out


def _variant(col: Column) -> Column:
    return col.cast("variant")


def _keys(x: Typed) -> Column:
    """The keys of an object, sorted; NULL for anything else."""
    return F.when(F.schema_of_variant(x.col).startswith("OBJECT"), F.json_object_keys(F.to_json(x.col)))


def _compared(name: str, a: Typed, b: Typed) -> Column:
    """a and b, one of them a VARIANT, by the types they have in the row; NULL where these cannot be compared."""
    op = _ORDER[name]
    wholes = op(_whole(a), _whole(b)) if {a.kind, b.kind} <= {"variant", "int"} else F.lit(None).cast("boolean")
    numbers = op(_numeric(a), _numeric(b)) if {a.kind, b.kind} <= {"variant", *_NUMBERS} else F.lit(None).cast("boolean")
    texts = op(_text_of(a), _text_of(b)) if {a.kind, b.kind} <= {"variant", "string"} else F.lit(None).cast("boolean")
    out = [wholes, numbers, texts]
    if name in ("==", "!="):
        if {a.kind, b.kind} <= {"variant", "bool"}:
            out.append(op(_as(a, "bool"), _as(b, "bool")))
        if a.kind == b.kind == "variant":
            same = [F.schema_of_variant(x.col).startswith(k) for k in ("ARRAY", "OBJECT", "VOID") for x in (a, b)]
            alike = (same[0] & same[1]) | (same[2] & same[3]) | (same[4] & same[5])
            out.append(F.when(alike, op(F.to_json(a.col), F.to_json(b.col))))
    return F.coalesce(*out)


_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}


def _divided(x: Column, y: Column) -> Column:
    """Whole numbers are cut towards zero; a zero divisor and the one overflow are errors."""
    return F.try_divide(x.cast("decimal(19,0)") - F.try_mod(x, y).cast("decimal(19,0)"), y.cast("decimal(19,0)")).try_cast("bigint")


def _computed(name: str, a: Typed, b: Typed) -> Typed:
    """a and b, one of them a VARIANT, as the types they have in the row ask for: a VARIANT."""
    for x in (a, b):
        if x.kind not in ("variant", "string", "list", *_NUMBERS) or (x.kind in ("string", "list") and name != "+"):
            raise CelError(f"no operator {name} for a {x.kind}")
    out = []
    if {a.kind, b.kind} <= {"variant", "int"}:
        out.append(_variant((_divided if name == "/" else _ARITHMETIC[name])(_whole(a), _whole(b))))
    if {a.kind, b.kind} <= {"variant", *_NUMBERS} and name != "%":
        # Whole numbers have been dealt with: what overflowed there is an error, not a double.
        whole = _whole(a).isNotNull() & _whole(b).isNotNull()
        out.append(F.when(~whole, _variant((F.try_divide if name == "/" else _ARITHMETIC[name])(_numeric(a), _numeric(b)))))
    if name == "+" and a.kind == b.kind == "variant":
        out.append(_variant(F.concat(_text_of(a), _text_of(b))))
        out.append(_variant(F.concat(_as(a, "list"), _as(b, "list"))))
    if not out:
        raise CelError(f"no operator {name} for a {a.kind} and a {b.kind}")
    return Typed(F.coalesce(*out), "variant")


def _path(key: str) -> str:
    if key.isidentifier() and key.isascii():
        return f"$.{key}"
    if '"' in key and "'" in key:
        raise CelError(f"the key {key!r} holds quotes of both kinds")
    return f"$['{key}']" if '"' in key else f'$["{key}"]'


def _duration(text: Column) -> Column:
    """The microseconds of a text such as 1h30m or -2.5s; NULL if it is none."""
    total = F.lit(0.0)
    for unit, micros in _UNITS.items():
        found = F.regexp_extract_all(text, F.lit(rf"([0-9]+(?:\.[0-9]+)?){unit}(?![a-z])"), F.lit(1))
        total = total + F.coalesce(F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.lit(0.0)) * micros
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(text.rlike(r"\A[+-]?(?:[0-9]+(?:\.[0-9]+)?(?:h|ms|us|m|s))+\z"), (F.round(total) * sign).cast("bigint"))


class Compiler:
    def __init__(self, names: dict[str, Typed]):
        self.names = names

    def bool_(self, node: Node, names: dict[str, Typed]) -> Column:
        return _as(self.visit(node, names), "bool")

    def visit(self, node: Node, names: dict[str, Typed]) -> Typed:
        return getattr(self, f"_{node.kind}")(node, names)

    def _paren(self, node: Node, names: dict[str, Typed]) -> Typed:
        return self.visit(node.args[0], names)

    def _lit(self, node: Node, names: dict[str, Typed]) -> Typed:
        kinds = {bool: "bool", int: "int", float: "double", str: "string", bytes: "bytes", type(None): "null"}
        kind = kinds[type(node.value)]
        return Typed(F.lit(node.value).cast("bigint") if kind == "int" else F.lit(node.value), kind)

    def _ident(self, node: Node, names: dict[str, Typed]) -> Typed:
        if node.name not in names and node.name in _TYPES:
            return Typed(F.lit(node.name), "type")
        if node.name not in names:
            raise CelError(f"undeclared name {node.name!r}")
        return names[node.name]

    def _member(self, node: Node, names: dict[str, Typed]) -> Typed:
        owner = self.visit(node.target, names)
        if owner.kind == "variant":
            return Typed(F.try_variant_get(owner.col, _path(node.name), "variant"), "variant")
        if owner.kind != "struct" or node.name not in owner.fields:
            raise CelError(f"no field {node.name!r} in a {owner.kind}")
        return owner.fields[node.name]

    def _index(self, node: Node, names: dict[str, Typed]) -> Typed:
        owner, key = self.visit(node.target, names), bare(node.args[0])
        if owner.kind == "variant" and key.kind == "lit" and isinstance(key.value, str):
            return Typed(F.try_variant_get(owner.col, _path(key.value), "variant"), "variant")
        if owner.kind == "struct" and key.kind == "lit" and isinstance(key.value, str):
            if key.value not in owner.fields:
                raise CelError(f"no key {key.value!r} in a map")
            return owner.fields[key.value]
        position = _as(self.visit(key, names), "int").cast("int")
        if owner.kind == "variant":
            return Typed(F.when(position >= 0, F.get(_as(owner, "list"), position)), "variant")
        if owner.kind == "list":
            return owner.item.at(F.when(position >= 0, F.get(owner.col, position)))
        raise CelError(f"a {owner.kind} has no elements")

    def _list(self, node: Node, names: dict[str, Typed]) -> Typed:
        items = [self.visit(a, names) for a in node.args]
        kinds = {i.kind for i in items}
        if len(kinds) > 1 and kinds <= {"variant", "string", "bool", *_NUMBERS}:
            items = [i if i.kind == "variant" else Typed(_variant(i.col), "variant") for i in items]
        elif len(kinds) > 1 or kinds & {"struct"}:
            raise CelError("a list literal holds values of one type, or plain values and arguments")
        if not items:
            return text_list(F.array().cast("array<string>"))
        return Typed(F.array(*[i.col for i in items]), "list", Typed(F.lit(None), items[0].kind, items[0].item, items[0].fields))

    def _map(self, node: Node, names: dict[str, Typed]) -> Typed:
        keys, values = [bare(k) for k in node.args[::2]], [self.visit(v, names) for v in node.args[1::2]]
        if not all(k.kind == "lit" and isinstance(k.value, str) for k in keys) or len({k.value for k in keys}) < len(keys):
            raise CelError("a map literal has literal texts as keys, each once")
        fields = {k.value: v for k, v in zip(keys, values)}
        made = F.struct(*[v.col.alias(k) for k, v in fields.items()]) if fields else F.struct(F.lit(None).alias("none"))
        return Typed(made, "struct", fields=fields)

    def _not(self, node: Node, names: dict[str, Typed]) -> Typed:
        return Typed(~self.bool_(node.args[0], names), "bool")

    def _neg(self, node: Node, names: dict[str, Typed]) -> Typed:
        x = self.visit(node.args[0], names)
        x = Typed(_as(x, "double"), "double") if x.kind == "variant" else x
        if x.kind not in _NUMBERS:
            raise CelError(f"cannot negate a {x.kind}")
        return Typed(F.try_subtract(F.lit(0).cast("bigint" if x.kind == "int" else "double"), x.col), x.kind)

    def _cond(self, node: Node, names: dict[str, Typed]) -> Typed:
        test = self.bool_(node.args[0], names)
        yes, no = (self.visit(a, names) for a in node.args[1:])
        if yes.kind != no.kind:
            raise CelError("both branches of ? : need one type")
        return yes.at(F.when(test, yes.col).when(~test, no.col))

    def _pair(self, a: Typed, b: Typed) -> tuple[Column, Column, str]:
        """Both operands, neither a VARIANT, as one type."""
        if a.kind != b.kind and {a.kind, b.kind} <= set(_NUMBERS):
            return _as(a, "double"), _as(b, "double"), "double"
        if a.kind != b.kind:
            raise CelError(f"cannot compare a {a.kind} with a {b.kind}")
        return a.col, b.col, a.kind

    def _null_test(self, name: str, x: Typed) -> Typed:
        """x == null: whether an argument is there and null. What has a type of its own is never null."""
        if name not in ("==", "!="):
            raise CelError(f"cannot compare with null by {name}")
        if x.kind == "variant":
            is_null = F.when(x.col.isNotNull(), F.is_variant_null(x.col))
        else:
            is_null = F.lit(x.kind == "null") if x.kind == "null" else F.when(x.col.isNotNull(), F.lit(False))
        return Typed(is_null if name == "==" else ~is_null, "bool")

    def _compare(self, name: str, a: Typed, b: Typed) -> Typed:
        if "null" in (a.kind, b.kind):
            return self._null_test(name, b if a.kind == "null" else a)
        if "variant" in (a.kind, b.kind):
            if {a.kind, b.kind} == {"variant", "list"} and name in ("==", "!="):
                a, b = (x if x.kind == "variant" else Typed(_variant(x.col), "variant") for x in (a, b))
            if not {a.kind, b.kind} <= {"variant", "string", "bool", *_NUMBERS} or (
                "bool" in (a.kind, b.kind) and name not in ("==", "!=")
            ):
                raise CelError(f"cannot compare a {a.kind} with a {b.kind} by {name}")
            return Typed(_compared(name, a, b), "bool")
        x, y, kind = self._pair(a, b)
        plain = kind == "list" and a.item.kind == b.item.kind and a.item.kind not in ("struct", "variant")
        if (kind in ("struct", "list") and not (plain and name in ("==", "!="))) or (kind in ("bool", "type") and name not in ("==", "!=")):
            raise CelError(f"cannot compare a {kind} by {name}")
        return Typed(_ORDER[name](x, y), "bool")

    def _binary(self, node: Node, names: dict[str, Typed]) -> Typed:
        left, right = node.args
        if node.name in ("&&", "||"):
            a, b = self.bool_(left, names), self.bool_(right, names)
            return Typed(a & b if node.name == "&&" else a | b, "bool")
        if node.name == "in":
            return self._in(left, right, names)
        a, b = self.visit(left, names), self.visit(right, names)
        if node.name in _ORDER:
            return self._compare(node.name, a, b)
        if node.name == "+" and a.kind == b.kind == "list":
            return Typed(F.concat(a.col, b.col), "list", a.item)
        if node.name == "+" and "string" in (a.kind, b.kind):
            return Typed(F.concat(_as(a, "string"), _as(b, "string")), "string")
        if "variant" in (a.kind, b.kind):
            return _computed(node.name, a, b)
        if {"timestamp", "duration"} & {a.kind, b.kind}:
            return self._time(node.name, a, b)
        x, y, kind = self._pair(a, b)
        if kind not in _NUMBERS:
            raise CelError(f"no operator {node.name} for a {kind}")
        if node.name in "+-*":
            return Typed(_ARITHMETIC[node.name](x, y), kind)
        if node.name == "/":
            return Typed(F.try_divide(x, y) if kind == "double" else _divided(x, y), kind)
        return Typed(F.try_mod(x, y), kind)

    def _time(self, name: str, a: Typed, b: Typed) -> Typed:
        x, y = (F.unix_micros(v.col) if v.kind == "timestamp" else v.col for v in (a, b))
        apply = F.try_add if name == "+" else F.try_subtract
        kinds = (a.kind, name, b.kind)
        if kinds in (("timestamp", "+", "duration"), ("duration", "+", "timestamp"), ("timestamp", "-", "duration")):
            return Typed(F.timestamp_micros(apply(x, y)), "timestamp")
        if kinds in (("timestamp", "-", "timestamp"), ("duration", "-", "duration"), ("duration", "+", "duration")):
            return Typed(apply(x, y), "duration")
        raise CelError(f"no operator {name} for a {a.kind} and a {b.kind}")

    def _in(self, left: Node, right: Node, names: dict[str, Typed]) -> Typed:
        owner, key = self.visit(right, names), bare(left)
        if owner.kind == "variant":
            if key.kind == "lit" and isinstance(key.value, str):
                return Typed(F.try_variant_get(owner.col, _path(key.value), "variant").isNotNull(), "bool")
            raise CelError("only a literal key can be looked up in arguments")
        if owner.kind == "struct" and owner.fields and key.kind == "lit" and isinstance(key.value, str):
            return Typed(F.lit(key.value in owner.fields), "bool")
        if owner.kind != "list":
            raise CelError(f"'in' needs a list, not a {owner.kind}")
        wanted = self.visit(left, names)
        if owner.item.kind == "variant":
            return Typed(F.exists(owner.col, lambda x: self._compare("==", Typed(x, "variant"), wanted).col), "bool")
        return Typed(F.array_contains(owner.col, _as(wanted, owner.item.kind)), "bool")

    def _call(self, node: Node, names: dict[str, Typed]) -> Typed:
        if node.target is None:
            return self._function(node, names)
        if node.name in MACROS and node.args and bare(node.args[0]).kind == "ident":
            return self._macro(node, names)
        return self._method(node, names)

    def _size(self, x: Typed) -> Typed:
        if x.kind == "variant":
            return Typed(F.coalesce(F.length(_as(x, "string")), F.size(_as(x, "list")), F.size(_keys(x))).cast("bigint"), "int")
        if x.kind == "struct":
            return Typed(F.lit(len(x.fields)).cast("bigint"), "int")
        if x.kind not in ("string", "list", "bytes"):
            raise CelError(f"a {x.kind} has no size")
        return Typed((F.size(x.col) if x.kind == "list" else F.length(x.col)).cast("bigint"), "int")

    def _function(self, node: Node, names: dict[str, Typed]) -> Typed:
        if node.name == "has" and len(node.args) == 1 and bare(node.args[0]).kind == "member":
            x = self.visit(node.args[0], names)
            return Typed(x.col.isNotNull() if x.kind == "variant" else F.lit(True), "bool")
        if len(node.args) != 1:
            raise CelError(f"unknown function {node.name!r} of {len(node.args)} arguments")
        x = self.visit(node.args[0], names)
        if node.name == "size":
            return self._size(x)
        if node.name == "dyn":
            return x
        if node.name == "type":
            return Typed(_type_of(x), "type")
        if node.name == "timestamp" and x.kind in ("string", "variant", "timestamp"):
            return x if x.kind == "timestamp" else Typed(
                F.try_to_timestamp(
                    F.when(_as(x, "string").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T.*(?:Z|[+-][0-9]{2}:[0-9]{2})\z"), _as(x, "string"))
                ),
                "timestamp",
            )
        if node.name == "duration" and x.kind in ("string", "variant", "duration"):
            return x if x.kind == "duration" else Typed(_duration(_as(x, "string")), "duration")
        if node.name == "bytes" and x.kind == "string":
            return Typed(F.encode(x.col, "UTF-8"), "bytes")
        if node.name in _CAST:
            to = _CAST[node.name]
            kind = "int" if node.name == "uint" else node.name
            if x.kind == "variant":
                return Typed(F.try_variant_get(x.col, "$", to), kind)
            if x.kind == "double" and kind == "int":
                return Typed(F.when(F.abs(x.col) < float(1 << 63), x.col.try_cast("bigint")), kind)
            if x.kind in ("string", "int", "double", "bool"):
                return Typed(x.col.try_cast(to), kind)
        raise CelError(f"unknown function {node.name!r} of a {x.kind}")

    def _method(self, node: Node, names: dict[str, Typed]) -> Typed:
        owner = self.visit(node.target, names)
        args = [self.visit(a, names) for a in node.args]
        if node.name == "size" and not args:
            return self._size(owner)
        if node.name == "contains" and len(args) == 1 and owner.kind == "list":
            return Typed(F.array_contains(owner.col, _as(args[0], owner.item.kind)), "bool")
        texts = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}
        if node.name in texts and len(args) == 1:
            return Typed(texts[node.name](_as(owner, "string"), _as(args[0], "string")), "bool")
        if node.name in _GETTERS and not args and owner.kind == "timestamp":
            get, shift = _GETTERS[node.name]
            return Typed((get(F.to_utc_timestamp(owner.col, F.current_timezone())) + shift).cast("bigint"), "int")
        if node.name in ("getHours", "getMinutes", "getSeconds") and not args and owner.kind == "duration":
            unit = _UNITS[node.name[3].lower()]
            return Typed(F.floor(F.abs(owner.col) / unit).cast("bigint") * F.signum(owner.col).cast("bigint"), "int")
        if node.name == "matches" and len(args) == 1:
            if bare(node.args[0]).kind != "lit":
                raise CelError("matches needs a literal pattern")
            return Typed(_as(owner, "string").rlike(bare(node.args[0]).value), "bool")
        raise CelError(f"unknown method {node.name!r} of a {owner.kind}")

    def _macro(self, node: Node, names: dict[str, Typed]) -> Typed:
        owner, var = self.visit(node.target, names), bare(node.args[0]).name
        if owner.kind == "variant":
            # Over an object, its keys.
            keys = F.transform(_keys(owner), _variant)
            owner = Typed(F.coalesce(_as(owner, "list"), keys), "list", Typed(F.lit(None), "variant"))
        if owner.kind == "struct" and owner.fields:
            owner = text_list(F.array(*[F.lit(k) for k in owner.fields]))
        if owner.kind != "list":
            raise CelError(f"{node.name} needs a list, not a {owner.kind}")
        wanted = {"exists": (2,), "all": (2,), "exists_one": (2,), "filter": (2,), "map": (2, 3), "reduce": (4,)}[node.name]
        if len(node.args) not in wanted:
            raise CelError(f"{node.name} takes {wanted[0]} arguments")
        if node.name == "reduce":
            total, var = var, bare(node.args[1]).name
            start = self.visit(node.args[2], names)
            step = lambda acc, x: self.visit(node.args[3], names | {total: start.at(acc), var: owner.item.at(x)}).col
            return start.at(F.aggregate(owner.col, start.col, step))

        def test(which: Node) -> Callable[[Column], Column]:
            return lambda x: self.bool_(which, names | {var: owner.item.at(x)})

        if node.name == "exists":
            return Typed(F.exists(owner.col, test(node.args[1])), "bool")
        if node.name == "all":
            return Typed(F.forall(owner.col, test(node.args[1])), "bool")
        truths = F.transform(owner.col, test(node.args[1])) if node.name in ("exists_one", "filter") or len(node.args) == 3 else None
        sure = ~F.exists(truths, lambda b: b.isNull()) if truths is not None else None
        if node.name == "exists_one":
            return Typed(F.when(sure, F.size(F.filter(truths, lambda b: b)) == 1), "bool")
        kept = F.when(sure, F.filter(owner.col, test(node.args[1]))) if sure is not None else owner.col
        if node.name == "filter":
            return Typed(kept, "list", owner.item)
        made = self.visit(node.args[-1], names | {var: owner.item})
        mapped = F.transform(kept, lambda x: self.visit(node.args[-1], names | {var: owner.item.at(x)}).col)
        return Typed(F.when(~F.exists(mapped, lambda v: v.isNull()), mapped), "list", made)


def to_column(source: str | Node, names: dict[str, Typed] | None = None) -> Column:
    """The predicate as a boolean Column: true, false, or NULL where CEL would fail. Any other value counts by its truth."""
    session()
    tree = parse(source) if isinstance(source, str) else source
    if uses_any(tree):
        raise CelError("uses .any(, which is no CEL macro: use .exists(")
    names = names if names is not None else context()
    got = Compiler(names).visit(tree, names)
    if got.kind == "bool":
        return got.col
    if got.kind in _NUMBERS:
        return got.col != 0
    if got.kind == "string":
        return F.length(got.col) > 0
    if got.kind == "list":
        return F.when(got.col.isNotNull(), F.size(got.col) > 0)
    if got.kind == "variant":
        return F.coalesce(_as(got, "bool"), _as(got, "double") != 0, F.length(_as(got, "string")) > 0, F.size(_as(got, "list")) > 0)
    raise CelError(f"a {got.kind} has no truth value")
