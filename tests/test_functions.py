"""Labels and label-carrying string functions against Python's own string methods."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.errors import ConfigError, UsageError
from provlake.functions import labels, nested, strings
from provlake.functions.strings import Labeled, plain
from provlake.runtime import ship
from provlake.schema import LABEL

TEXTS = ["", " ", "abc", "  The quick\tbrown  fox\n", "o'neil ab-cd", "ÄÖÜ straße", "a,b,,c", "x" * 30, " em ", "-42", "+7", "line1\r\nline2\x0bline3\n", "tab\there", "aXbXc", "Ǆ"]

CASES = {
    "strip": (lambda a: strings.strip(a), lambda s: s.strip()),
    "lstrip": (lambda a: strings.lstrip(a, "ax "), lambda s: s.lstrip("ax ")),
    "rstrip": (lambda a: strings.rstrip(a, "c\n]"), lambda s: s.rstrip("c\n]")),
    "split": (lambda a: strings.split(a), lambda s: s.split()),
    "split_sep": (lambda a: strings.split(a, ","), lambda s: s.split(",")),
    "split_max": (lambda a: strings.split(a, "X", 1), lambda s: s.split("X", 1)),
    "rsplit": (lambda a: strings.rsplit(a, "X", 1), lambda s: s.rsplit("X", 1)),
    "splitlines": (lambda a: strings.splitlines(a), lambda s: s.splitlines()),
    "splitlines_keep": (lambda a: strings.splitlines(a, True), lambda s: s.splitlines(True)),
    "replace": (lambda a: strings.replace(a, "X", plain("__")), lambda s: s.replace("X", "__")),
    "replace_1": (lambda a: strings.replace(a, "X", plain("__"), 1), lambda s: s.replace("X", "__", 1)),
    "center": (lambda a: strings.center(a, 9, "*"), lambda s: s.center(9, "*")),
    "center_even": (lambda a: strings.center(a, 10, "*"), lambda s: s.center(10, "*")),
    "ljust": (lambda a: strings.ljust(a, 7), lambda s: s.ljust(7)),
    "rjust": (lambda a: strings.rjust(a, 7, "."), lambda s: s.rjust(7, ".")),
    "zfill": (lambda a: strings.zfill(a, 6), lambda s: s.zfill(6)),
    "slice": (lambda a: strings.slice_(a, 1, -1), lambda s: s[1:-1]),
    "slice_far": (lambda a: strings.slice_(a, -3, 100), lambda s: s[-3:100]),
    "title": (lambda a: strings.title(a), str.title),
    "swapcase": (lambda a: strings.swapcase(a), str.swapcase),
    "casefold": (lambda a: strings.casefold(a), str.casefold),
    "expandtabs": (lambda a: strings.expandtabs(a, 4), lambda s: s.expandtabs(4)),
    "removeprefix": (lambda a: strings.removeprefix(a, "a"), lambda s: s.removeprefix("a")),
    "removesuffix": (lambda a: strings.removesuffix(a, "c"), lambda s: s.removesuffix("c")),
    "partition": (lambda a: strings.partition(a, "X"), lambda s: s.partition("X")),
    "rpartition": (lambda a: strings.rpartition(a, "X"), lambda s: s.rpartition("X")),
    "repeat": (lambda a: strings.repeat(a, 2), lambda s: s * 2),
    "repeat_none": (lambda a: strings.repeat(a, -1), lambda s: s * -1),
    "encode": (lambda a: strings.encode(a), lambda s: s.encode()),
    "round": (lambda a: strings.decode(strings.encode(a)), lambda s: s),
    "format": (lambda a: strings.format_text("<{}|{0}>{{}}".replace("{0}", "{}"), labels.none(), a, a), lambda s: f"<{s}|{s}>{{}}"),
    "join": (lambda a: strings.join(plain(", "), a, a), lambda s: ", ".join([s, s])),
}


def test_values_equal_python(spark):
    ship(spark)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    a = Labeled(F.col("t"), labels.fresh("s", F.col("k")))
    got = {r["k"]: r for r in df.select("k", *[f(a).value.alias(n) for n, (f, _) in CASES.items()]).collect()}
    for k, text in enumerate(TEXTS):
        for name, (_, python) in CASES.items():
            value, want = got[k][name], python(text)
            value = tuple(value) if isinstance(want, tuple) else bytes(value) if isinstance(want, bytes) else value
            assert value == want, (name, text)


def test_items(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    a = Labeled(F.col("t"), labels.none())
    assert list(df.select(strings.item(a, 0).value, strings.item(a, -1).value, strings.item(a, 3).value).first()) == ["a", "c", None]
    with pytest.raises(UsageError):
        strings.split(a, "")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_merge_rules(spark):
    a = labels.endorse(labels.endorse(labels.fresh("s1", F.lit(1), F.lit("x")), "k1"), "k2")
    b = labels.endorse(labels.fresh("s2", F.lit(2), F.lit("y")), "k2")
    m = one(spark, labels.merge(a, labels.none(), b))
    assert (m["source"], m["lineage"], m["ingested_by"], m["endorsements"]) == ("s1", ["s1", "s2"], ["x", "y"], ["k2"])
    assert one(spark, labels.merge(labels.none(), b)["value_id"] == b["value_id"])
    assert one(spark, labels.merge(labels.none(), labels.none())) is None
    assert one(spark, labels.merge(a, a)["lineage"]) == ["s1"]


def test_derive_endorse_collect(spark):
    a = labels.endorse(labels.fresh("s1", F.lit(1)), "k")
    d = one(spark, labels.track_model_call([a, labels.none()], F.lit(0), F.lit("z")))
    assert (d["source"], d["lineage"], d["ingested_by"], d["endorsements"]) == ("model", ["s1"], ["default", "z"], [])
    assert one(spark, labels.derive("m", labels.present(labels.none()), F.lit(0))) is None
    again = one(spark, F.struct(labels.endorse(a, "k").alias("e"), a.alias("a")))
    assert again["e"]["endorsements"] == ["k"] and again["e"]["value_id"] != again["a"]["value_id"]
    assert one(spark, labels.endorse(labels.none(), "k")) is None and one(spark, labels.endorsement_record(labels.none(), "k")) is None
    assert one(spark, F.size(labels.collect(a, labels.none(), a, labels.fresh("s2", F.lit(2))))) == 2
    with pytest.raises(ConfigError):
        labels.endorse(a, "not valid")


def test_ids_are_the_same_on_a_retry(spark):
    ids = [one(spark, labels.fresh("s", F.lit(7))["value_id"]) for _ in range(2)]
    assert ids[0] == ids[1] != one(spark, labels.fresh("s", F.lit(8))["value_id"])


def test_nested(spark):
    df = spark.createDataFrame([({"k": ["a", None]}, (("b", 1), b"c"))], "m map<string,array<string>>, s struct<p:struct<q:string,n:int>,r:binary>")
    kind = df.schema["m"].dataType
    assert df.select(nested.collect_leaves(F.col("m"), kind).alias("x")).first()["x"] == ["k", "a"]
    assert df.select(nested.collect_leaves(F.col("m"), kind, 1).alias("x")).first()["x"] == ["k"]
    assert df.select(nested.collect_leaves(F.col("s"), df.schema["s"].dataType).alias("x")).first()["x"] == ["b", "c"]
    up = df.select(nested.map_leaves(F.col("m"), kind, F.upper).alias("x")).first()["x"]
    assert up == {"K": ["A", None]}
    assert list(nested.leaf_paths(df.schema["s"].dataType)) == [("p", "q"), ("r",)] and list(nested.leaf_paths(df.schema["s"].dataType, 0)) == []
    assert nested.depth_of(None) == 4 and nested.depth_of("10") == 10 and nested.is_container(T.ArrayType(T.StringType()))
    with pytest.raises(ConfigError):
        nested.depth_of("11")


def test_wide_array_of_labels(spark):
    wide = F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda k: F.when(k < 0, F.lit(None).cast(LABEL)))
    assert one(spark, F.size(F.filter(wide, lambda x: x.isNotNull()))) == 0


def test_bytes_that_are_no_text(spark):
    ship(spark)
    df = spark.createDataFrame([(bytearray(b"a\xffb"),), (None,)], "b binary")
    assert [r["x"] for r in df.select(strings.leaf_text(F.col("b"), True).alias("x")).collect()] == ["ab", None]


BYTES = [b"", b"abc", b" \t a b  c\n", b"x\xffy\xc3\xa9 Z", b"+12", b"-7", b"one,two,,three", b"l1\nl2\r\nl3\rl4\x0bl5\n", b"\xa0a\x85", b"aB cD'eF 1g", b"\x00\x00", b"a\tb\tc", b"\xe9\xc9"]
ON_BYTES = {
    "upper": (strings.upper, lambda b: b.upper()),
    "lower": (strings.lower, lambda b: b.lower()),
    "strip": (strings.strip, lambda b: b.strip()),
    "lstrip_chars": (lambda a: strings.lstrip(a, b" a"), lambda b: b.lstrip(b" a")),
    "rstrip_chars": (lambda a: strings.rstrip(a, b"\nc"), lambda b: b.rstrip(b"\nc")),
    "replace": (lambda a: strings.replace(a, b"a", strings.plain(b"\xff$1")), lambda b: b.replace(b"a", b"\xff$1")),
    "replace_two": (lambda a: strings.replace(a, b",", strings.plain(b";"), 2), lambda b: b.replace(b",", b";", 2)),
    "replace_nothing": (lambda a: strings.replace(a, b"", strings.plain(b"$-")), lambda b: b.replace(b"", b"$-")),
    "replace_nothing_two": (lambda a: strings.replace(a, b"", strings.plain(b"-"), 2), lambda b: b.replace(b"", b"-", 2)),
    "split": (strings.split, lambda b: b.split()),
    "split_sep": (lambda a: strings.split(a, b",", 2), lambda b: b.split(b",", 2)),
    "rsplit": (lambda a: strings.rsplit(a, b",", 1), lambda b: b.rsplit(b",", 1)),
    "splitlines": (strings.splitlines, lambda b: b.splitlines()),
    "splitlines_ends": (lambda a: strings.splitlines(a, True), lambda b: b.splitlines(True)),
    "partition": (lambda a: strings.partition(a, b","), lambda b: b.partition(b",")),
    "rpartition": (lambda a: strings.rpartition(a, b","), lambda b: b.rpartition(b",")),
    "capitalize": (strings.capitalize, lambda b: b.capitalize()),
    "title": (strings.title, lambda b: b.title()),
    "swapcase": (strings.swapcase, lambda b: b.swapcase()),
    "expandtabs": (lambda a: strings.expandtabs(a, 4), lambda b: b.expandtabs(4)),
    "removeprefix": (lambda a: strings.removeprefix(a, b"ab"), lambda b: b.removeprefix(b"ab")),
    "removesuffix": (lambda a: strings.removesuffix(a, b"c"), lambda b: b.removesuffix(b"c")),
    "ljust": (lambda a: strings.ljust(a, 6, b"*"), lambda b: b.ljust(6, b"*")),
    "rjust": (lambda a: strings.rjust(a, 6), lambda b: b.rjust(6)),
    "center": (lambda a: strings.center(a, 7, b"-"), lambda b: b.center(7, b"-")),
    "zfill": (lambda a: strings.zfill(a, 6), lambda b: b.zfill(6)),
    "repeat": (lambda a: strings.repeat(a, 2), lambda b: b * 2),
    "slice": (lambda a: strings.slice_(a, 1, -1), lambda b: b[1:-1]),
    "slice_step": (lambda a: strings.slice_(a, None, None, -2), lambda b: b[::-2]),
    "slice_to": (lambda a: strings.slice_(a, -2, 0, -1), lambda b: b[-2:0:-1]),
    "item": (lambda a: strings.item(a, 0), lambda b: b[0] if b else None),
    "concat": (lambda a: strings.concat(a, strings.plain(b"\xff")), lambda b: b + b"\xff"),
    "join": (lambda a: strings.join(strings.plain(b", "), a, a), lambda b: b", ".join([b, b])),
    "percent": (lambda a: strings.percent(strings.plain(b"<%s>"), a), None),
    "decode": (lambda a: strings.decode(a, "ISO-8859-1"), lambda b: b.decode("latin-1")),
}


@pytest.mark.parametrize("name", ON_BYTES)
def test_bytes(spark, name):
    """Each function on bytes against Python's method; the label is kept."""
    ship(spark)
    fn, method = ON_BYTES[name]
    label = labels.fresh("s", F.lit(1))
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(BYTES)] + [(99, None)], "k long, b binary")
    if name == "percent":
        got = fn(Labeled(strings._as_text(Labeled(F.col("b"), label, True)).value, label))
        rows = {r["k"]: r["v"] for r in df.select("k", got.value.alias("v")).collect()}
        assert all(bytes(rows[k]) == b"<" + b + b">" for k, b in enumerate(BYTES))
        return
    got = fn(Labeled(F.col("b"), label, True))

    def plain(v):
        return bytes(v) if isinstance(v, bytearray) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    rows = {r["k"]: (plain(r["v"]), r["s"]) for r in df.select("k", got.value.alias("v"), got.label["source"].alias("s")).collect()}
    for k, b in enumerate(BYTES):
        assert rows[k] == (plain(method(b)), "s"), (name, b)


def test_texts_like_python(spark):
    texts = ["", "ßtraße", "ǆabc", "ΑΣ ΣΑΣ", "ﬁx", "İstanbul", "a\tb", "Mixed CASE text", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    a = Labeled(F.col("t"), labels.none())
    cases = {
        "capitalize": (strings.capitalize(a), str.capitalize),
        "replace": (strings.replace(a, "", strings.plain("-")), lambda t: t.replace("", "-")),
        "replace_one": (strings.replace(a, "", strings.plain("-"), 1), lambda t: t.replace("", "-", 1)),
        "replace_none": (strings.replace(a, "", strings.plain("-"), 0), lambda t: t.replace("", "-", 0)),
        "reversed": (strings.slice_(a, step=-1), lambda t: t[::-1]),
        "third": (strings.slice_(a, 1, None, 3), lambda t: t[1::3]),
        "named": (strings.percent_named("%(x)s is 100%% %(x)s", labels.none(), x=a), lambda t: "%(x)s is 100%% %(x)s" % {"x": t}),
        "map": (strings.format_map("<{x}>", labels.none(), {"x": a, "y": a}), lambda t: f"<{t}>"),
        "ends": (strings.splitlines(a, True), lambda t: t.splitlines(True)),
    }
    for name, (got, method) in cases.items():
        for r in df.select("t", got.value.alias("v")).collect():
            assert r["v"] == method(r["t"]), (name, r["t"])


def test_labels_of_percent(spark):
    a, b = (Labeled(F.lit(x), labels.fresh(x, F.lit(1))) for x in "ab")
    assert one(spark, strings.percent_plain("%s", a).label["source"]) == "a" and one(spark, strings.percent_plain("%s %s", a, b).label) is None
    assert one(spark, strings.percent_named("%(x)s", labels.none(), x=a, y=b).label["lineage"]) == ["a"]
