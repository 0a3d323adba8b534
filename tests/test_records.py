import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake import cli
from provlake.errors import ConfigError, UsageError
from provlake.functions import labels, nested
from provlake.operators import audit, decide, envelope
from provlake.plans.policy import default_policy, from_text
from provlake.schema import LABEL
from provlake.sources import records

KEY = b"0123456789abcdef"


def events(spark, run="r1", agent="a1"):
    calls = spark.createDataFrame([(run, 1, agent, "x"), (run, 2, agent, "y")], "run_id string, seq long, agent_id string, tool string")
    return decide.events(decide.check(calls, default_policy()))


def test_lines_round_trip_and_bad_lines(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    records.write(events(spark), path)
    found = spark.createDataFrame([("r1", "web", "x", "body", 1, "a1")], "run_id string, source string, tool string, argument string, seq long, agent_id string")
    records.write(audit.records(found), path)
    (tmp_path / "log" / "more.txt").write_text('\n{"record_type":"odd"}\nnot json\n[1]\n7\n{"record_type":"event","outcome":"allow"}\n{"record_type":"endorsement","kind":"k","value_id":"v","lineage":["s"],"run_id":"r1","agent_id":"a1"}\n')
    good, bad = records.read(spark, path)
    assert sorted(r["record_type"] for r in good.collect()) == ["endorsement", "event", "event", "finding"] and bad.count() == 5
    n = {(r["run_id"], r["level"]): (r["n_events"], r["n_findings"], r["n_endorsements"]) for r in records.counts(good).collect()}
    assert n == {("r1", "run"): (2, 1, 1), ("r1", "agent"): (2, 1, 1)}
    assert records.counts(good, "none").count() == 0
    assert all(json.loads(r["value"])["record_type"] and r["value"].startswith('{"record_type"') for r in records.as_lines(good).collect())
    assert cli.main(["inspect", path]) == 0
    assert "run r1  (2 events, 1 findings, 1 endorsements)" in capsys.readouterr().out


def test_fan_out_survives_a_failing_sink(spark):
    memory = records.InMemory()

    def broken(df):
        raise OSError("full")

    out = records.FanOut(broken, memory)
    out.add(records.to_null)
    out(events(spark))
    assert len(memory.rows["event"]) == 2
    memory.clear()
    assert not memory.rows["event"]


def packed(spark, body='{"b":[1,"x"],"a":"é"}', key=KEY, **kw):
    leaf = F.struct(F.lit("$.a").alias("path"), labels.fresh("web", F.lit(1)).alias("label"), F.lit("str").alias("carrier"))
    leaf2 = F.struct(F.lit("$.b[1]").alias("path"), labels.fresh("web", F.lit(1)).alias("label"), F.lit("str").alias("carrier"))
    run = F.array(F.struct(F.lit("web").alias("source"), F.lit("untrusted").alias("trust"), F.array(F.lit("z"), F.lit("y")).alias("ingested_by")))
    return spark.range(1).select(envelope.pack(F.lit(body), F.array(leaf, leaf2), run, F.array(F.lit("reads_private")), key, **kw).alias("wire"))


def test_envelope(spark):
    df = packed(spark)
    got = envelope.unpack(df, "wire", KEY).select("reject_reason", "envelope", envelope.value_at(F.col("envelope"), "$.b[1]").alias("v"), envelope.label_at(F.col("envelope"), "$.a")["source"].alias("s")).first()
    assert got["reject_reason"] is None and (got["v"], got["s"]) == ("x", "web")
    assert len(got["envelope"]["label_pool"]) == 1 and len(got["envelope"]["labels"]) == 2
    rows = envelope.replay(envelope.unpack(df, "wire", KEY).withColumns({"run_id": F.lit("r"), "seq": F.lit(1)})).collect()
    assert [(r["source"], r["agent_id"]) for r in rows] == [("web", "y"), ("web", "z")]


def test_code_equals_hmac(spark):
    got = spark.range(1).select(envelope.mac(F.lit("grüße"), KEY).alias("m"), envelope.mac(F.lit("x"), b"k" * 100).alias("n")).first()
    assert got["m"] == "sha256:" + hmac.new(KEY, "grüße".encode(), hashlib.sha256).hexdigest()
    assert got["n"] == "sha256:" + hmac.new(b"k" * 100, b"x", hashlib.sha256).hexdigest()


def broken(change):
    def apply(wire):
        data = json.loads(wire)
        change(data)
        return json.dumps(data)

    return apply


@pytest.mark.parametrize(
    "change, why",
    [
        (lambda d: d.update(version=2), "version"),
        (lambda d: d.pop("version"), "version"),
        (lambda d: d.update(extra=1), "schema"),
        (lambda d: d["labels"][0].update(label=5), "schema"),
        (lambda d: d["labels"][0].update(label=-1), "schema"),
        (lambda d: d["labels"].append(d["labels"][0]), "schema"),
        (lambda d: d["label_pool"].append(d["label_pool"][0]), "schema"),
        (lambda d: d["labels"][0].update(carrier="other"), "schema"),
        (lambda d: d["label_pool"][0].update(source="s" * 300), "schema"),
        (lambda d: d["label_pool"][0].update(ingested_by=["bad name"]), "schema"),
        (lambda d: d["label_pool"][0].update(lineage=[str(k) for k in range(65)]), "schema"),
        (lambda d: d.update(payload="{"), "schema"),
        (lambda d: d["run"].update(capabilities=["flies"]), "schema"),
        (lambda d: d.update(mac="sha256:00"), "schema"),
        (lambda d: d.update(mac=None), "not signed"),
        (lambda d: d.update(payload="{}"), "wrong code"),
        (lambda d: d.update(key_id="other"), "wrong code"),
        (lambda d: d["label_pool"][0].update(source="kb"), "wrong code"),
    ],
)
def test_envelope_rejects(spark, change, why):
    wire = broken(change)(packed(spark, key_id="k1").first()["wire"])
    got = envelope.unpack(spark.createDataFrame([(wire,)], "wire string"), "wire", KEY).first()
    assert got["reject_reason"] == why and got["envelope"] is None


def test_envelope_keys(spark):
    with pytest.raises(UsageError):
        envelope.pack(F.lit("{}"), F.array(), key_id="k")
    assert envelope.unpack(packed(spark), "wire", b"another key 1234").first()["reject_reason"] == "wrong code"
    assert envelope.unpack(packed(spark), "wire").first()["reject_reason"] == "signed, but no key is given"
    assert envelope.unpack(packed(spark, key=None), "wire").first()["reject_reason"] is None
    assert envelope.unpack(spark.createDataFrame([("nonsense",), (None,)], "wire string"), "wire").where("reject_reason = 'version'").count() == 2


def test_sidecar(spark):
    row = packed(spark).select(envelope.pack_into(F.lit('{"z":1}'), F.col("wire")).alias("d"), envelope.pack_into(F.lit("{}"), F.col("wire")).alias("e"), "wire").first()
    assert json.loads(row["d"])["z"] == 1
    back = spark.createDataFrame([(row["d"],), (row["e"],)], "d string").select(envelope.unpack_from(F.col("d")).alias("w"))
    assert envelope.unpack(back, "w", KEY).where("reject_reason IS NULL").count() == 2
    assert spark.range(1).select(envelope.unpack_from(F.lit('{"z":1}')).alias("w")).first()["w"] is None


def test_changed_siblings_are_found(spark):
    df = packed(spark).select(envelope.pack_into(F.lit('{"amount":1,"to":"x"}'), F.col("wire"), KEY).alias("d"))
    cases = {"same": F.col("d"), "spaced": F.replace("d", F.lit('"amount":1,'), F.lit(' "amount" : 1 ,')), "changed": F.replace("d", F.lit('"amount":1'), F.lit('"amount":999')), "added": F.replace("d", F.lit('"to"'), F.lit('"more":1,"to"')), "gone": F.replace("d", F.lit('"amount":1,'), F.lit("")), "bare": F.regexp_replace("d", ',"around":"[^"]*"', "")}
    rows = df.select(F.explode(F.create_map(*[x for k, v in cases.items() for x in (F.lit(k), v)])).alias("case", "d")).withColumn("w", envelope.unpack_from(F.col("d")))
    got = {r["case"]: r["reject_reason"] for r in envelope.unpack(rows, "w", KEY, "d").collect()}
    assert got == {"same": None, "spaced": None, "changed": "wrong code", "added": "wrong code", "gone": "wrong code", "bare": "siblings not signed"}
    assert envelope.unpack(rows, "w", KEY).where("reject_reason IS NOT NULL").count() == 0


def test_keys_beside_the_format_are_refused_at_any_depth(spark):
    df = packed(spark)
    places = ['"label_pool":[{', '"labels":[{', '"run":{', '"sources":[{']
    for place in places:
        wrong = df.select(F.replace("wire", F.lit(place), F.lit(place + '"more":1,')).alias("wire"))
        assert wrong.where(F.contains("wire", F.lit('"more"'))).count() == 1
        assert envelope.unpack(wrong, "wire", KEY).first()["reject_reason"] == "schema", place
    agent = df.select(F.regexp_replace("wire", r'("run":\{"sources":\[\{"name":"[^"]*","ingested_by":\[")[^"]*"', '$1not valid"').alias("wire"))
    assert envelope.unpack(agent, "wire", KEY).first()["reject_reason"] == "schema"


def test_keys_and_warnings(spark):
    for key in (b"short", "a text of many characters"):
        with pytest.raises(ConfigError):
            envelope.pack(F.lit("{}"), F.array().cast(f"array<struct<path:string,label:{LABEL},carrier:string>>"), key=key)
    with pytest.warns(UserWarning, match="without a key"):
        envelope.unpack(packed(spark), "wire")


def test_replay_into_the_readers_run(spark):
    """Capabilities and untrusted texts of an envelope count for the calls after it."""
    label = labels.fresh("web", F.lit(1))
    leaves = F.array(F.struct(F.lit("$.a").alias("path"), label.alias("label"), F.lit("str").alias("carrier")))
    run = F.array(F.struct(F.lit("web").alias("source"), F.lit("untrusted").alias("trust"), F.array(F.lit("b")).alias("ingested_by")))
    wire = envelope.pack(F.lit('{"a":"words that came from the web","b":["plain"]}'), leaves, run, F.array(F.lit("reads_private")), KEY)
    read = envelope.unpack(spark.range(1).select(wire.alias("wire"), F.lit("r").alias("run_id"), F.lit(5).cast("long").alias("seq")), "wire", KEY)
    p = from_text('version: "2.0"\nsinks: {default.send: {capabilities: [reaches_external]}, default.read: {capabilities: [reads_private]}}')
    calls = spark.createDataFrame([("r", 4, "x", "send", "{}"), ("r", 6, "x", "send", '{"to":"so: words that came from the web!"}')], "run_id string, seq long, agent_id string, tool string, args string")
    got = {r["seq"]: r for r in decide.check(calls, p, envelope.replay(read), replayed=envelope.replay_capabilities(read)).collect()}
    assert got[4]["run_trifecta"] == ["reaches_external"] and len(got[6]["run_trifecta"]) == 3
    found = audit.findings(audit.argument_leaves(calls), p, replayed=envelope.replay_texts(read)).collect()
    assert [(r["source"], r["tool"], r["argument"], r["seq"]) for r in found] == [("web", "send", "to", 6)]


def test_rebuild_and_strip(spark):
    kind = T._parse_datatype_string("a string, n int, l array<struct<q:string>>, m map<string,string>")
    body = '{"a":"x","n":3,"l":[{"q":"y"},{"q":null}],"m":{"k.1":"z"}}'
    entry = lambda path, source: F.struct(F.lit(path).alias("path"), labels.fresh(source, F.lit(path)).alias("label"), F.lit("str").alias("carrier"))
    df = spark.range(1).select(envelope.pack(F.lit(body), F.array(entry("$.l[0].q", "s1"), entry('$.m["k.1"]', "s2")), key=KEY).alias("wire"))
    typed = envelope.unpack(df, "wire", KEY).select(envelope.rebuild(F.col("envelope"), kind).alias("v"))
    v = typed.first()["v"]
    assert (v["a"]["value"], v["a"]["label"], v["n"], v["l"][0]["q"]["value"], v["l"][0]["q"]["label"]["source"]) == ("x", None, 3, "y", "s1")
    assert v["m"]["k.1"]["label"]["source"] == "s2" and v["l"][1]["q"]["value"] is None
    payload, found = envelope.strip(F.col("v"), typed.schema["v"].dataType)
    back = typed.select(payload.alias("p"), F.transform(found, lambda x: F.struct(x["path"], x["label"]["source"])).alias("l")).first()
    assert json.loads(back["p"]) == {"a": "x", "n": 3, "l": [{"q": "y"}, {}], "m": {"k.1": "z"}} and [tuple(x) for x in back["l"]] == [("$.l[0].q", "s1"), ('$.m["k.1"]', "s2")]


def test_audit_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["alpha", "beta", "γάμμα", "delta 🙂", "x"])
    contents = [" ".join(word() for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    texts = [" ".join(word() for _ in range(rnd.randint(1, 12))) + rnd.choice(["", " " + rnd.choice(contents)]) for _ in range(200)]
    ingress = [(str(k % 3), k, "ok" if k % 7 == 0 else f"s{k % 2}", t) for k, t in enumerate(contents)] + [("0", 0, "s0", "x" * 400), (None, 1, "s0", "alpha alpha alpha")]
    leaves = [(str(k % 3), k % 50 + 10, "a", f"t{k % 2}", "arg", t) for k, t in enumerate(texts)] + [("0", 3, "a", "t0", "arg", "y" + "x" * 5_000)]
    p = from_text('version: "2.0"\nsources: [{name: ok, trust: trusted}]')
    df = spark.createDataFrame(leaves, "run_id string, seq long, agent_id string, tool string, argument string, text string").withColumn("label", labels.none())
    got = {(r["run_id"], r["source"], r["tool"], r["argument"]): r["seq"] for r in audit.findings(df, p, spark.createDataFrame(ingress, "run_id string, seq long, source string, text string")).collect()}
    want = {}
    for run, seq, _, tool, argument, text in leaves:
        for r, at, source, content in ingress:
            if r == run and at < seq and source != "ok" and len(content) >= 12 and content in text:
                want[run, source, tool, argument] = min(seq, want.get((run, source, tool, argument), seq))
    assert got == want and len(want) > 5


def test_paths_tell_places_apart(spark):
    body = '{"a.b":"one","a":{"b":"two","c \\"d":["three"]},"":"four"}'
    df = spark.range(1).select("id", F.parse_json(F.lit(body)).alias("v"))
    got = {r["path"]: r["text"] for r in nested.explode_variant(df, "v", ["id"]).collect()}
    assert got == {'$["a.b"]': "one", "$.a.b": "two", '''$.a['c "d'][0]''': "three", '$[""]': "four"}
    for path, text in got.items():
        if path != '$[""]':
            assert df.select(F.try_variant_get("v", path, "string").alias("t")).first()["t"] == text, path
    put = lambda path, value: df.select(nested.replace_at(F.lit(body), path, F.lit(value)).alias("x")).first()["x"]
    assert json.loads(put(["a", 'c "d', 0], '{"n":1}'))["a"]['c "d'] == [{"n": 1}] and put(["a", "z"], "1") is None and put(["a", 'c "d', 3], "1") is None
    calls = spark.createDataFrame([("r", 1, "x", "t", body)], "run_id string, seq long, agent_id string, tool string, args string")
    assert {(r["argument"], r["path"]) for r in audit.argument_leaves(calls).collect()} == {("a.b", '$["a.b"]'), ("a", "$.a.b"), ("a", '''$.a['c "d'][0]'''), ("", '$[""]')}
