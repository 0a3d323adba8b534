import pytest
from pyspark.sql import functions as F

from provlake.errors import CelError
from provlake.plans.cel import bare, parse, uses_any
from provlake.plans.compile import Typed, to_column

ARGS = '{"to":"a@b.com","n":7,"x":2.5,"ok":true,"no":null,"l":["p","q"],"m":{"k":"v"},"y":1.25,"x2":2.50,"ten":10,"to2":"b","big":9223372036854775807,"big2":9223372036854775806,"at":"2024-03-01T01:30:00Z"}'


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1).select(F.parse_json(F.lit(ARGS)).alias("args"), F.lit("default.t").alias("tool"), F.array(F.lit("u"), F.lit("v")).alias("ls"))


def value(row, text):
    names = {"args": Typed(F.col("args"), "variant"), "tool": Typed(F.col("tool"), "string"), "ls": Typed(F.col("ls"), "list", Typed(F.lit(None), "string"))}
    return row.select(to_column(text, names).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('args.to.endsWith("b.com")', True),
        ('args.to == "a@b.com" && args.n == 7', True),
        ("args.n < 8.5", True),
        ("args.x > 2", True),
        ("args.ok", True),
        ("!args.ok", False),
        ('args.missing == "x"', None),
        ('args.no == "x"', None),
        ('args.n == "7"', None),  # another type is an error, never a conversion
        ('args.n.endsWith("7")', None),
        ('args.missing == "x" || args.ok', True),
        ('args.missing == "x" && !args.ok', False),
        ('args.missing == "x" && args.ok', None),
        ("has(args.no)", True),
        ("has(args.missing)", False),
        ("size(args.l) == 2", True),
        ("size(args.to) == 7", True),
        ('args.l[1] == "q"', True),
        ('args.l[5] == "q"', None),
        ('args.m.k == "v"', True),
        ('args["m"].k == "v"', True),
        ('args.l.exists(x, x == "p")', True),
        ('args.l.all(x, x == "p")', False),
        ('ls.exists_one(x, x == "u")', True),
        ('ls.map(x, x + "!").contains("u!")', True),
        ('ls.filter(x, x != "u").size() == 1', True),
        ("ls.reduce(n, x, 0, n + size(x)) == 2", True),
        ('"u" in ls', True),
        ('"m" in args', True),
        ("1 / 0 == 1", None),
        ("7 / 2 == 3", True),
        ("-7 / 2 == -3", True),
        ("7 % 0 == 1", None),
        ("9223372036854775807 + 1 > 0", None),
        ("1.0 / 0.0 > 1.0", None),
        ("size(ls)", True),  # any result counts by its truth
        ('tool.matches("^def.*t$") ? args.n == 7 : false', True),
        ('int("12") == 12', True),
        ('int("q") == 1', None),
        (r'"a\"\x41" == "a\"A"', True),
        (r"r'\d' == '\\d'", True),
        ("(1 + 2) * 3 == 9 // a note", True),
        ("args.n == args.n && args.x != args.n", True),
        ("args.n > args.x", True),
        ("args.x > args.y", True),  # decimals of unlike scale
        ("args.x == args.x2", True),
        ("args.ten > args.n && !(args.ten < args.n)", True),  # as numbers, not as texts
        ("args.n + args.x > 9", True),
        ("args.n + args.n == 14", True),
        ("args.n / 2 == 3", True),
        ("args.ten / args.n == 1", True),
        ("args.x * 2 == 5", True),
        ("args.n % args.ten == 7", True),
        ("args.big + args.big > 0", None),
        ("args.big == args.big2", False),  # whole numbers are not rounded
        ('args.to + args.to == "a@b.coma@b.com"', True),
        ('args.to < args.to2', True),
        ("args.n < args.to", None),
        ("args.ok == args.ok", True),
        ("args.ok < args.ok", None),
        ("args.n - args.to == 1", None),
        ("args.no == null", True),
        ("args.n != null", True),
        ("args.missing == null", None),
        ("tool == null", False),
        ("args.l == args.l && args.m == args.m", True),
        ('args.l == ["p", "q"]', True),
        ("args.l == args.m", None),
        ('["a", "b"] == ["a", "b"]', True),
        ('[[1, 2], [3]][0] == [1, 2]', True),
        ('args.n in [1, 7]', True),
        ('args.n in [args.ten, 7]', True),
        ('{"a": 1, "b": 2}["b"] == 2', True),
        ('"a" in {"a": 1} && size({"a": 1}) == 1', True),
        ("size(args.m) == 1 && size(args) > 5", True),
        ('args.m.exists(k, k == "k")', True),
        ('args.exists(k, k.startsWith("t"))', True),
        ("type(args.n) == int && type(args.x) == double && type(tool) == string", True),
        ("type(args.l) == list && type(args.m) == map && type(args.no) == null_type", True),
        ("dyn(args.n) == 7", True),
        ('timestamp("2024-03-01T00:00:00Z") < timestamp(args.at)', True),
        ('timestamp(args.at) - timestamp("2024-03-01T00:00:00Z") == duration("1h30m")', True),
        ('timestamp(args.at) + duration("30m") == timestamp("2024-03-01T02:00:00Z")', True),
        ('timestamp(args.at).getHours() == 1 && timestamp(args.at).getMonth() == 2', True),
        ('timestamp(args.to) < timestamp(args.at)', None),
        ('duration("90s").getMinutes() == 1', True),
    ],
)
def test_value(row, text, expected):
    assert value(row, text) is expected


@pytest.mark.parametrize("text", ["", "a ==", "(a", "a b", "'open", "a.b(", "1 +", "@", "a.1"])
def test_does_not_parse(text):
    with pytest.raises(CelError):
        parse(text)


@pytest.mark.parametrize("text", ["nothing", "tool.nothing", "tool + 1 == 2", "args.any(x, true)", "ls.exists(x, x)", 'tool == 1', "unknown(tool)", "{1: 2} == {1: 2}", "tool < null", "args.ok < true", "ls - ls == ls", 'timestamp("x") * 2 == 1'])
def test_does_not_compile(row, text):
    with pytest.raises(CelError):
        value(row, text)


def test_any_in_a_literal_is_no_macro():
    assert uses_any(parse("a.any(x, true)")) and not uses_any(parse('a == ".any("'))


def test_offsets_and_precedence():
    tree = parse("a || b && !c == d")
    assert (tree.name, tree.args[1].name, tree.args[1].args[1].name) == ("||", "&&", "==")
    assert parse(" a.b ").start == 1 and bare(parse("((a))")).name == "a"
