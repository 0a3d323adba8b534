"""Text and bytes functions that carry the label of what they are applied to.

Each takes and gives a Labeled pair. The result keeps the receiver's label; another operand's label merges only where
the description says so. Values follow Python's string methods: where Spark's own function differs (white space,
padding that cuts, splitting that keeps empties), the difference is made good here.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import replace as replace_field
from functools import wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.errors import UsageError
from provlake.functions.labels import merge, none

_BLANK = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


_BYTES_BLANK = "\\t-\\r\\x20"
_LOWER, _UPPER = string.ascii_lowercase, string.ascii_uppercase
_CHARSET = "ISO-8859-1"
#: Letters whose title case is not their upper case, by the rule of Unicode as Python has it.
_TITLES = {c: c.title() for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.title() != c.upper()}


@dataclass(frozen=True)
class Labeled:
    """A text or, if is_bytes, a BINARY column and its label."""

    value: Column
    label: Column
    is_bytes: bool = False

    def with_value(self, value: Column) -> "Labeled":
        return replace_field(self, value=value)


def plain(value: Column | str | bytes) -> Labeled:
    if isinstance(value, (str, bytes)):
        return Labeled(F.lit(value), none(), isinstance(value, bytes))
    return Labeled(value, none())


def _lit(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _as_text(x):
    """Bytes as a text of one character for each byte; anything else as it is."""
    if isinstance(x, Labeled) and x.is_bytes:
        return x.with_value(F.decode(x.value, _CHARSET))
    return x.decode("latin-1") if isinstance(x, bytes) else x


def _as_bytes(value: Column) -> Column:
    return F.encode(value, _CHARSET)


def _three_bytes(value: Column) -> Column:
    return F.struct(*[_as_bytes(value[k]).alias(k) for k in ("head", "sep", "tail")])


def on_bytes(back: Callable[[Column], Column] = _as_bytes):
    """For functions of texts: bytes go through them as texts of one character for each byte, and come back as bytes.
    The function sees from is_bytes that letters and white space are those of ASCII only."""

    def wrapped(fn):
        @wraps(fn)
        def run(a: Labeled, *args, **named) -> Labeled:
            if not a.is_bytes:
                return fn(a, *args, **named)
            out = fn(_as_text(a), *map(_as_text, args), **{k: _as_text(v) for k, v in named.items()})
            return Labeled(back(out.value), out.label, True)

        return run

    return wrapped


def _many(value: Column) -> Column:
    return F.transform(value, _as_bytes)


def concat(a: Labeled, b: Labeled) -> Labeled:
    """a + b: both labels. A plain operand on either side adds none."""
    return Labeled(F.concat(a.value, b.value), merge(a.label, b.label), a.is_bytes)


@on_bytes()
def percent(a: Labeled, *args: Labeled) -> Labeled:
    """a % args for %s, %d and %f: a's label and the arguments'."""
    return replace_field(
        a,
        value=F.call_function("format_string", a.value, *[x.value for x in args]),
        label=merge(a.label, *[x.label for x in args]),
    )


def percent_named(template: str, label: Column, **named: Labeled) -> Labeled:
    """A literal template % a mapping, for %(name)s: the template's label and those of the values named in it."""
    parts, used, at = [], [], 0
    for m in re.finditer(r"%\((\w+)\)s|%%", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit("%") if m[0] == "%%" else named[m[1]].value.cast("string"))
        used += [named[m[1]].label] if m[1] and not any(u is named[m[1]].label for u in used) else []
        at = m.end()
    if "%" in template[at:]:
        raise UsageError("only %(name)s and %% can be formatted from a mapping")
    return Labeled(F.concat(*parts, F.lit(template[at:])), merge(label, *used))


def percent_plain(template: str, *args: Labeled) -> Labeled:
    """A plain template % labeled values: one value alone hands on its label; a tuple of several loses all of them."""
    made = percent(plain(template), *args)
    return Labeled(made.value, args[0].label if len(args) == 1 else none())


@on_bytes()
def repeat(a: Labeled, n: Column | int) -> Labeled:
    return a.with_value(F.repeat(a.value, F.greatest(_lit(n), F.lit(0))))


def _clamped(k: int | None, default: Column, n: Column, low: int, high: Column) -> Column:
    """A position of a slice, counted from the end if negative, within low and high."""
    return default if k is None else F.least(F.lit(k), high) if k >= 0 else F.greatest(n + k, F.lit(low))


@on_bytes()
def slice_(a: Labeled, start: int | None = None, stop: int | None = None, step: int = 1) -> Labeled:
    """a[start:stop:step] with Python's negative positions and steps."""
    n = F.length(a.value)
    if step == 0:
        raise UsageError("a slice needs a step other than 0")
    if step > 0:
        low, high = _clamped(start, F.lit(0), n, 0, n), _clamped(stop, n, n, 0, n)
        part = F.substring(a.value, low + 1, F.greatest(high - low, F.lit(0)))
    else:
        low, high = _clamped(start, n - 1, n, -1, n - 1), _clamped(stop, F.lit(-1), n, -1, n - 1)
        part = F.reverse(F.substring(a.value, high + 2, F.greatest(low - high, F.lit(0))))
    if abs(step) > 1:
        # By the position alone, so that the text is taken apart once.
        letters = F.regexp_extract_all(part, F.lit("(?s)."), F.lit(0))
        part = F.array_join(F.filter(letters, lambda x, k: k % abs(step) == 0), "")
    return a.with_value(part)


def item(a: Labeled, k: int) -> Labeled:
    """a[k]; NULL outside. An element of bytes is its number."""
    n = F.length(a.value)
    at = F.lit(k) if k >= 0 else n + k
    one = F.when((at >= 0) & (at < n), F.substring(a.value, at + 1, F.lit(1)))
    return Labeled(F.conv(F.hex(one), 16, 10).cast("int"), a.label) if a.is_bytes else a.with_value(one)


def format_spec(a: Labeled, spec: str = "") -> Labeled:
    """format(a, spec): an empty spec is a itself; any other loses the label."""
    return a if not spec else Labeled(
        F.call_function("format_string", F.lit("%" + spec + ("" if spec[-1] == "s" else "s")), a.value),
        none(),
    )


@on_bytes()
def upper(a: Labeled) -> Labeled:
    return a.with_value(F.translate(a.value, _LOWER, _UPPER) if a.is_bytes else F.upper(a.value))


@on_bytes()
def lower(a: Labeled) -> Labeled:
    return a.with_value(F.translate(a.value, _UPPER, _LOWER) if a.is_bytes else F.lower(a.value))


def _class(chars: str | None, is_bytes: bool) -> str:
    if chars is None:
        return _BYTES_BLANK if is_bytes else _BLANK
    return "".join("\\x{%x}" % ord(c) for c in chars)


def _lstripped(value: Column, chars: str) -> Column:
    return F.regexp_replace(value, f"\\A[{chars}]+", "")


def _rstripped(value: Column, chars: str) -> Column:
    # The look-behind keeps the search from starting anew inside a run.
    return F.regexp_replace(value, f"(?<![{chars}])[{chars}]+\\z", "")


@on_bytes()
def lstrip(a: Labeled, chars: str | None = None) -> Labeled:
    return a if chars == "" else a.with_value(_lstripped(a.value, _class(chars, a.is_bytes)))


@on_bytes()
def rstrip(a: Labeled, chars: str | None = None) -> Labeled:
    return a if chars == "" else a.with_value(_rstripped(a.value, _class(chars, a.is_bytes)))


@on_bytes()
def strip(a: Labeled, chars: str | None = None) -> Labeled:
    which = _class(chars, a.is_bytes)
    return a if chars == "" else a.with_value(_rstripped(_lstripped(a.value, which), which))


@on_bytes()
def replace(a: Labeled, old: str, new: Labeled, count: int = -1) -> Labeled:
    """a.replace(old, new, count): a's label and new's, not old's. An empty old stands before each character and at the end."""
    label = merge(a.label, new.label)
    if old == "":
        n = F.length(a.value)
        k = n + 1 if count < 0 else F.least(F.lit(count), n + 1)
        put = F.concat(F.lit("$0"), F.replace(F.replace(new.value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))
        led = F.regexp_replace(F.substring(a.value, F.lit(1), k - 1), F.lit("(?s)."), put)
        return replace_field(a, value=F.when(k > 0, F.concat(new.value, led, F.substring(a.value, k, n))).otherwise(a.value), label=label)
    if count < 0:
        return replace_field(a, value=F.replace(a.value, F.lit(old), new.value), label=label)
    parts = F.split(a.value, _quoted(old), count + 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return replace_field(a, value=F.aggregate(rest, F.get(parts, F.lit(0)), lambda acc, x: F.concat(acc, new.value, x)), label=label)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def format_text(template: str, label: Column, *args: Labeled, **named: Labeled) -> Labeled:
    """A literal template with {0}, {} and {name} fields filled in: the template's label and all arguments'."""
    parts, n = [], 0
    for text, name, spec, conversion in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if spec or conversion or re.search(r"[.\[]", name):
                raise UsageError("only plain positions and names can be formatted")
            if name == "":
                name, n = str(n), n + 1
            parts.append((args[int(name)] if name.isdigit() else named[name]).value.cast("string"))
    return Labeled(F.concat(*parts) if parts else F.lit(""), merge(label, *[x.label for x in (*args, *named.values())]))


def format_map(template: str, label: Column, mapping: dict[str, Labeled]) -> Labeled:
    """As format_text with names; only the labels of the values that the template names are added."""
    used = {name for _, name, _, _ in string.Formatter().parse(template) if name is not None}
    return format_text(template, label, **{k: v for k, v in mapping.items() if k in used})


def _split_blank(value: Column, blank: str, maxsplit: int) -> Column:
    body = _lstripped(value, blank) if maxsplit >= 0 else _rstripped(_lstripped(value, blank), blank)
    return F.filter(F.split(body, f"[{blank}]+", maxsplit + 1 if maxsplit >= 0 else -1), lambda x: x != "")


@on_bytes(_many)
def split(a: Labeled, sep: str | None = None, maxsplit: int = -1) -> Labeled:
    """The parts as an array; each has a's label."""
    if sep == "":
        raise UsageError("an empty separator")
    if sep is not None:
        return a.with_value(F.split(a.value, _quoted(sep), maxsplit + 1 if maxsplit >= 0 else -1))
    return a.with_value(_split_blank(a.value, _class(None, a.is_bytes), maxsplit))


def rsplit(a: Labeled, sep: str | bytes | None = None, maxsplit: int = -1) -> Labeled:
    """As split, from the right: it differs only with maxsplit."""
    if maxsplit < 0:
        return split(a, sep)
    return a.with_value(_by(lambda s: s.rsplit(sep, maxsplit), "array<binary>" if a.is_bytes else "array<string>")(a.value))


@on_bytes(_many)
def splitlines(a: Labeled, keepends: bool = False) -> Labeled:
    breaks = "\\r\\n|[\\n\\r]" if a.is_bytes else _BREAK
    if keepends:
        within = "[^\\n\\r]" if a.is_bytes else "[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
        return a.with_value(F.regexp_extract_all(a.value, F.lit(f"{within}*+(?:{breaks})|{within}++"), F.lit(0)))
    lines = F.split(a.value, breaks)
    last = F.size(lines)
    return a.with_value(F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, last - 1)).otherwise(lines))


def _three(a: Labeled, head: Column, sep: Column, tail: Column) -> Labeled:
    return a.with_value(F.struct(head.alias("head"), sep.alias("sep"), tail.alias("tail")))


@on_bytes(_three_bytes)
def partition(a: Labeled, sep: str) -> Labeled:
    if sep == "":
        raise UsageError("an empty separator")
    at = F.instr(a.value, sep)
    found = at > 0
    head = F.when(found, F.substring(a.value, F.lit(1), at - 1)).otherwise(a.value)
    tail = F.when(found, F.substring(a.value, at + len(sep), F.length(a.value))).otherwise(F.lit(""))
    return _three(a, head, F.when(found, F.lit(sep)).otherwise(F.lit("")), tail)


@on_bytes(_three_bytes)
def rpartition(a: Labeled, sep: str) -> Labeled:
    if sep == "":
        raise UsageError("an empty separator")
    tail = F.substring_index(a.value, sep, -1)
    found = F.instr(a.value, sep) > 0
    head = F.when(found, F.substring(a.value, F.lit(1), F.length(a.value) - F.length(tail) - len(sep))).otherwise(F.lit(""))
    return _three(a, head, F.when(found, F.lit(sep)).otherwise(F.lit("")), F.when(found, tail).otherwise(a.value))


def join(sep: Labeled, *items: Labeled) -> Labeled:
    """sep.join(items): the separator's label first, then each item's. A plain separator loses the items' labels only in
    the plain method: see join_plain."""
    parts = [c for k, x in enumerate(items) for c in ([sep.value, x.value] if k else [x.value])]
    empty = F.lit(b"" if sep.is_bytes else "")
    return Labeled(F.concat(*parts) if parts else empty, merge(sep.label, *[x.label for x in items]), sep.is_bytes)


def join_plain(sep: str | bytes, *items: Labeled) -> Labeled:
    """A plain separator joining labeled items: the labels are lost."""
    made = join(plain(sep), *items)
    return replace_field(made, label=none())


def encode(a: Labeled, charset: str = "UTF-8") -> Labeled:
    return Labeled(F.encode(a.value, charset), a.label, True)


def decode(a: Labeled, charset: str = "UTF-8") -> Labeled:
    return Labeled(F.decode(a.value, charset), a.label)


@on_bytes()
def capitalize(a: Labeled) -> Labeled:
    first = F.substring(a.value, 1, 1)
    if a.is_bytes:
        rest = F.translate(F.substring(a.value, F.lit(2), F.length(a.value)), _UPPER, _LOWER)
        return a.with_value(F.concat(F.translate(first, _LOWER, _UPPER), rest))
    titled = F.element_at(F.create_map(*[F.lit(x) for pair in _TITLES.items() for x in pair]), first)
    # The whole text is lowered, as a last letter can depend on those before it.
    low = F.lower(a.value)
    return a.with_value(F.concat(F.coalesce(titled, F.upper(first)), F.substring(low, F.length(F.lower(first)) + 1, F.length(low))))


@on_bytes()
def removeprefix(a: Labeled, prefix: str) -> Labeled:
    rest = F.substring(a.value, F.lit(len(prefix) + 1), F.length(a.value))
    return a.with_value(F.when(a.value.startswith(prefix), rest).otherwise(a.value))


@on_bytes()
def removesuffix(a: Labeled, suffix: str) -> Labeled:
    rest = F.substring(a.value, F.lit(1), F.length(a.value) - len(suffix))
    return a.with_value(F.when(a.value.endswith(suffix), rest).otherwise(a.value))


def _padding(a: Labeled, width: int) -> Column:
    return F.greatest(F.lit(width) - F.length(a.value), F.lit(0))


@on_bytes()
def ljust(a: Labeled, width: int, fill: str = " ") -> Labeled:
    return a.with_value(F.concat(a.value, F.repeat(F.lit(fill), _padding(a, width))))


@on_bytes()
def rjust(a: Labeled, width: int, fill: str = " ") -> Labeled:
    return a.with_value(F.concat(F.repeat(F.lit(fill), _padding(a, width)), a.value))


@on_bytes()
def center(a: Labeled, width: int, fill: str = " ") -> Labeled:
    pad = _padding(a, width)
    left = F.floor(pad / 2).cast("int") + F.when((pad % 2 == 1) & (F.lit(width % 2) == 1), 1).otherwise(0)
    return a.with_value(F.concat(F.repeat(F.lit(fill), left), a.value, F.repeat(F.lit(fill), pad - left)))


@on_bytes()
def zfill(a: Labeled, width: int) -> Labeled:
    signed = a.value.rlike("\\A[+-]")
    zeros = F.repeat(F.lit("0"), _padding(a, width))
    led = F.concat(F.substring(a.value, 1, 1), zeros, F.substring(a.value, F.lit(2), F.length(a.value)))
    return a.with_value(F.when(signed, led).otherwise(F.concat(zeros, a.value)))


def _by(method, returns: str = "string"):
    """A Python method of texts or bytes by Arrow batches, for the few whose semantics Spark has no function for."""

    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda x: method(bytes(x) if isinstance(x, (bytearray, memoryview)) else x), na_action="ignore")

    return apply


def casefold(a: Labeled) -> Labeled:
    if a.is_bytes:
        raise UsageError("bytes have no casefold")
    return a.with_value(_by(str.casefold)(a.value))


def title(a: Labeled) -> Labeled:
    return a.with_value((_by(bytes.title, "binary") if a.is_bytes else _by(str.title))(a.value))


def swapcase(a: Labeled) -> Labeled:
    if a.is_bytes:
        turned = F.translate(_as_text(a).value, _LOWER + _UPPER, _UPPER + _LOWER)
        return a.with_value(_as_bytes(turned))
    return a.with_value(_by(str.swapcase)(a.value))


def expandtabs(a: Labeled, size: int = 8) -> Labeled:
    return a.with_value(_by(lambda s: s.expandtabs(size), "binary" if a.is_bytes else "string")(a.value))


def strip_label(a: Labeled) -> Column:
    """The value alone: what leaves by a plain write, by pickling, or by comparison."""
    return a.value


def leaf_text(value: Column, is_bytes: bool = False) -> Column:
    """Text as it is; bytes as UTF-8, leaving out what is none."""
    if not is_bytes:
        return value

    @F.pandas_udf("string")
    def ignoring(values: pd.Series) -> pd.Series:
        return values.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")

    return ignoring(value)
