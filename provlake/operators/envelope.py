"""Envelopes: a payload with its labels and its run's provenance, as one verifiable JSON text.

The canonical form is this engine's own (keys sorted, compact, UTF-8); no other implementation's codes are matched.
The key becomes a literal of the plan: keep plans and event logs of such jobs as safe as the key.

An envelope beside the keys of a document (pack_into) carries a second code over those, so that a change of any of them is
found by who reads it with the document. What unpacking replays into the reader's run: ingress, capabilities and the
labeled texts that the audit registers.
"""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.errors import ConfigError, UsageError
from provlake.functions import nested
from provlake.functions.labels import collect_all
from provlake.schema import LABEL, MOST_DEPTH, MOST_ENTRIES, MOST_LIST, MOST_NAME, SIDECAR, WIRE_VERSION

PATHS = "array<struct<path:string,label:int,carrier:string>>"
RUN = "struct<sources:array<struct<name:string,ingested_by:array<string>>>,capabilities:array<string>>"
BODY = f"version int, payload string, label_pool array<{LABEL}>, labels {PATHS}, run {RUN}, key_id string, mac string, around string"
_FIELDS = ("version", "payload", "label_pool", "labels", "run", "key_id", "mac", "around")
# The keys of what an envelope holds within its fields.
_WITHIN = {
    "label_pool": ("source", "value_id", "lineage", "ingested_by", "endorsements"),
    "labels": ("path", "label", "carrier"),
    "run.sources": ("name", "ingested_by"),
}
LEAST_KEY = 16


def check_key(key: bytes) -> bytes:
    if not isinstance(key, bytes) or len(key) < LEAST_KEY:
        raise ConfigError(f"a key of at least {LEAST_KEY} bytes is needed")
    return key


def canonical(text: Column) -> Column:
    """The same JSON value with sorted keys and no spaces; NULL if it is none."""
    return F.to_json(F.try_parse_json(text))


def mac(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text, as sha256:<hex>, in SQL functions."""
    check_key(key)
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(outer), first), 256))


def _signed(version: Column, payload: Column, pool: Column, labels: Column, run: Column, key_id: Column) -> Column:
    """What the code covers: every field but the code, in one canonical text."""
    return canonical(
        F.to_json(
            F.struct(
                version.alias("version"),
                payload.alias("payload"),
                pool.alias("label_pool"),
                labels.alias("labels"),
                run.alias("run"),
                key_id.alias("key_id"),
            )
        )
    )


def pack(
    payload: Column,
    labels: Column,
    run_ingress: Column | None = None,
    run_capabilities: Column | None = None,
    key: bytes | None = None,
    key_id: str | None = None,
) -> Column:
    """The envelope of a payload (JSON text) and of its leaves' labels, ARRAY<STRUCT<path, label, carrier>>. Labels are
    pooled by id; the run's sources and agents are sorted."""
    if key_id is not None and key is None:
        raise UsageError("a key_id needs a key")
    pool = collect_all(F.transform(labels, lambda x: x["label"]))
    ids = F.transform(pool, lambda x: x["value_id"])
    entries = F.transform(
        labels,
        lambda x: F.struct(
            x["path"].alias("path"),
            (F.array_position(ids, x["label"]["value_id"]) - 1).cast("int").alias("label"),
            x["carrier"].alias("carrier"),
        ),
    )
    entries = F.filter(entries, lambda e: e["label"] >= 0)
    run = F.lit(None).cast(RUN)
    if run_ingress is not None:
        sources = F.array_sort(
            F.transform(run_ingress, lambda e: F.struct(e["source"].alias("name"), F.array_sort(e["ingested_by"]).alias("ingested_by")))
        )
        run = F.struct(
            sources.alias("sources"),
            F.array_sort(run_capabilities if run_capabilities is not None else F.array().cast("array<string>")).alias("capabilities"),
        ).cast(RUN)
    version, body, kid = F.lit(WIRE_VERSION), canonical(payload), F.lit(key_id).cast("string")
    code = mac(_signed(version, body, pool, entries, run, kid), key) if key is not None else F.lit(None).cast("string")
    return F.to_json(
        F.struct(
            version.alias("version"),
            body.alias("payload"),
            pool.alias("label_pool"),
            entries.alias("labels"),
            run.alias("run"),
            kid.alias("key_id"),
            code.alias("mac"),
        )
    )


def _name_ok(x: Column) -> Column:
    return x.isNotNull() & (F.length(x) > 0) & (F.length(x) <= MOST_NAME)


def _agents_ok(values: Column) -> Column:
    named = F.forall(values, lambda a: _name_ok(a) & a.rlike(r"\A[A-Za-z0-9_.-]+\z"))
    return values.isNotNull() & (F.size(values) <= MOST_LIST) & named


def _label_ok(x: Column) -> Column:
    ok = _name_ok(x["source"]) & _name_ok(x["value_id"]) & _agents_ok(x["ingested_by"])
    for values in (x["lineage"], x["endorsements"]):
        ok = ok & values.isNotNull() & (F.size(values) <= MOST_LIST) & F.forall(values, _name_ok)
    return ok


def _only(keys: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) == 0


def _keys_ok(wire: Column) -> Column:
    """No key beside those of the format, at any depth."""
    top = F.try_variant_get(wire, "$", "map<string,variant>")
    ok = _only(F.map_keys(top), _FIELDS)
    ok = ok & F.coalesce(
        _only(F.map_keys(F.try_variant_get(wire, "$.run", "map<string,variant>")), ("sources", "capabilities")),
        F.lit(True),
    )
    for place, allowed in _WITHIN.items():
        names = F.flatten(F.transform(F.try_variant_get(wire, f"$.{place}", "array<map<string,variant>>"), F.map_keys))
        ok = ok & F.coalesce(_only(names, allowed), F.lit(True))
    return ok


def unpack(df: DataFrame, column: str, key: bytes | None = None, document: str | None = None) -> DataFrame:
    """df with `envelope` (the parsed fields) and `reject_reason`, the first check that fails: version, schema, key, code.
    A rejected envelope is NULL, so nothing of it can be replayed.

    document: the column of the JSON text that the envelope was put into; its other keys are then covered, too."""
    if key is None:
        warnings.warn("envelopes are read without a key: whoever wrote them can have made up their labels", stacklevel=2)
    loose = F.from_json(column, "version int")
    e = F.col("__e")
    df = df.withColumn("__e", F.from_json(column, BODY, {"mode": "PERMISSIVE"})).withColumn("__wire", F.try_parse_json(column))
    ids = F.transform(e["label_pool"], lambda x: x["value_id"])
    paths = F.transform(e["labels"], lambda x: F.concat_ws("\x1f", x["carrier"], x["path"]))
    pool_ok = e["label_pool"].isNotNull() & (F.size(e["label_pool"]) <= MOST_ENTRIES) & F.forall(e["label_pool"], _label_ok)
    pool_ok = pool_ok & (F.size(F.array_distinct(ids)) == F.size(ids))
    entry_ok = F.forall(
        e["labels"],
        lambda x: x["path"].isNotNull() & x["carrier"].isin("str", "bytes", "scalar") & (x["label"] >= 0) & (x["label"] < F.size(e["label_pool"])),
    )
    entries_ok = e["labels"].isNotNull() & (F.size(e["labels"]) <= MOST_ENTRIES) & entry_ok & (
        F.size(F.array_distinct(paths)) == F.size(paths)
    )
    sources_ok = (F.size(e["run"]["sources"]) <= MOST_LIST) & F.forall(
        e["run"]["sources"],
        lambda s: _name_ok(s["name"]) & _agents_ok(s["ingested_by"]),
    )
    run_ok = e["run"].isNull() | (sources_ok & F.forall(e["run"]["capabilities"], lambda c: c.isin("reads_private", "reaches_external")))
    code_ok = e["mac"].isNull() | e["mac"].rlike(r"\Asha256:[0-9a-f]{64}\z")
    payload_ok = e["payload"].isNotNull() & F.try_parse_json(e["payload"]).isNotNull()
    shape_ok = _keys_ok(F.col("__wire")) & payload_ok & pool_ok & entries_ok & run_ok & code_ok
    no = F.lit(False)
    if key is None:
        keyed, verified = F.when(e["mac"].isNotNull(), F.lit("signed, but no key is given")), F.lit(True)
    else:
        keyed = F.when(e["mac"].isNull(), F.lit("not signed"))
        verified = e["mac"] == mac(_signed(e["version"], e["payload"], e["label_pool"], e["labels"], e["run"], e["key_id"]), key)
        if document is not None:
            keyed = F.coalesce(keyed, F.when(e["around"].isNull(), F.lit("siblings not signed")))
            verified = verified & (e["around"] == _around(_siblings(F.col(document)), e["mac"], key))
    why = F.when(loose["version"].isNull() | (loose["version"] != WIRE_VERSION), F.lit("version"))
    why = why.when(~F.coalesce(shape_ok, no), F.lit("schema")).when(keyed.isNotNull(), keyed).when(
        ~F.coalesce(verified, no),
        F.lit("wrong code"),
    )
    df = df.withColumn("reject_reason", why)
    return df.withColumn("envelope", F.when(F.col("reject_reason").isNull(), e)).drop("__e", "__wire")


def label_at(envelope: Column, path: str, carrier: str = "str") -> Column:
    """The label of one leaf of an unpacked envelope."""
    hit = F.get(F.filter(envelope["labels"], lambda x: (x["path"] == path) & (x["carrier"] == carrier)), F.lit(0))
    return F.get(envelope["label_pool"], hit["label"])


def labels_of(envelope: Column) -> Column:
    """Every labeled leaf: ARRAY<STRUCT<path, carrier, label>>."""
    return F.transform(
        envelope["labels"],
        lambda x: F.struct(
            x["path"].alias("path"),
            x["carrier"].alias("carrier"),
            F.get(envelope["label_pool"], x["label"]).alias("label"),
        ),
    )


def value_at(envelope: Column, path: str) -> Column:
    """The payload's value at a path such as $.a[0], as text; NULL where there is none."""
    return F.try_variant_get(F.try_parse_json(envelope["payload"]), path, "string")


def _each(unpacked: DataFrame, run_id: str, seq: str, items: Column) -> DataFrame:
    """(run_id, seq, item) of what unpacked envelopes of a run hold. A rejected envelope is NULL and holds nothing.

    Nothing is filtered before the items are apart: a filter on the envelope would be pushed below the steps that read it
    and would repeat them all."""
    rows = unpacked.where(F.col(run_id).isNotNull())
    rows = rows.select(F.col(run_id).alias("run_id"), F.col(seq).alias("seq"), F.explode_outer(items).alias("item"))
    return rows.where("item IS NOT NULL")


def replay(unpacked: DataFrame, run_id: str = "run_id", seq: str = "seq") -> DataFrame:
    """The ingress rows that unpacking adds to the reader's run: one for each source and agent. Rejected envelopes and
    readers outside a run add none."""
    rows = _each(unpacked, run_id, seq, F.col("envelope.run.sources"))
    rows = rows.select("run_id", "seq", F.col("item.name").alias("source"), F.explode_outer("item.ingested_by").alias("agent_id"))
    return rows.where("agent_id IS NOT NULL")


def replay_capabilities(unpacked: DataFrame, run_id: str = "run_id", seq: str = "seq") -> DataFrame:
    """(run_id, seq, capability): what the sender's run could do, for operators.runs. Rejected envelopes add none."""
    return _each(unpacked, run_id, seq, F.col("envelope.run.capabilities")).withColumnRenamed("item", "capability")


def replay_texts(unpacked: DataFrame, run_id: str = "run_id", seq: str = "seq", depth: int = MOST_DEPTH) -> DataFrame:
    """(run_id, seq, text, label) of every labeled text of the payload: what the reader's audit has to know of."""
    rows = unpacked.withColumn("__v", F.try_parse_json("envelope.payload"))
    rows = nested.with_leaves(rows, "__v", "__texts", depth)
    named = F.transform(
        labels_of(F.col("envelope")),
        lambda x: F.struct(x["path"].alias("path"), x["label"].alias("label"), x["carrier"].alias("carrier")),
    )
    texts = F.transform("__texts", lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text")))
    found = _each(rows, run_id, seq, F.arrays_zip(F.array(F.struct(named.alias("named"), texts.alias("texts"))).alias("both")))
    found = found.select("run_id", "seq", F.explode_outer("item.both.named").alias("named"), F.col("item.both.texts").alias("texts"))
    at = F.get(F.filter("texts", lambda x: x["path"] == F.col("named.path")), F.lit(0))
    found = found.where("named.carrier = 'str'").select("run_id", "seq", at["text"].alias("text"), F.col("named.label").alias("label"))
    return found.where("text IS NOT NULL")


def rebuild(envelope: Column, kind: T.DataType) -> Column:
    """The payload as a typed value in which every text is a STRUCT<value, label>, with NULL labels where it has none."""

    def label(path: Column) -> Column:
        hit = F.get(F.filter(envelope["labels"], lambda x: (x["path"] == path) & (x["carrier"] == "str")), F.lit(0))
        return F.get(envelope["label_pool"], hit["label"])

    def made(value: Column, of: T.DataType, path: Column) -> Column:
        if isinstance(of, T.StructType):
            fields = [made(value[f.name], f.dataType, F.concat(path, nested.path_step(F.lit(f.name)))).alias(f.name) for f in of.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(of, T.ArrayType):
            return F.transform(value, lambda x, k: made(x, of.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        if isinstance(of, T.MapType):
            return F.transform_values(value, lambda k, x: made(x, of.valueType, F.concat(path, nested.path_step(k))))
        return F.struct(value.alias("value"), label(path).alias("label")) if isinstance(of, T.StringType) else value

    return made(F.from_json(envelope["payload"], kind), kind, F.lit("$"))


def strip(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The inverse of rebuild: the payload (JSON text) of a typed value whose texts are STRUCT<value, label>, and its
    labels, ARRAY<STRUCT<path, label, carrier>>, for pack."""
    entry = f"array<struct<path:string,label:{LABEL},carrier:string>>"
    none = F.array().cast(entry)

    def is_leaf(of: T.DataType) -> bool:
        return isinstance(of, T.StructType) and [f.name for f in of.fields] == ["value", "label"]

    def plain(v: Column, of: T.DataType) -> Column:
        if is_leaf(of):
            return v["value"]
        if isinstance(of, T.StructType):
            return F.when(v.isNotNull(), F.struct(*[plain(v[f.name], f.dataType).alias(f.name) for f in of.fields]))
        if isinstance(of, T.ArrayType):
            return F.transform(v, lambda x: plain(x, of.elementType))
        return F.transform_values(v, lambda k, x: plain(x, of.valueType)) if isinstance(of, T.MapType) else v

    def found(v: Column, of: T.DataType, path: Column) -> Column:
        if is_leaf(of):
            one = F.array(F.struct(path.alias("path"), v["label"].alias("label"), F.lit("str").alias("carrier"))).cast(entry)
            return F.when(v["label"].isNotNull(), one).otherwise(none)
        if isinstance(of, T.StructType):
            return F.concat(
                none,
                *[F.coalesce(found(v[f.name], f.dataType, F.concat(path, nested.path_step(F.lit(f.name)))), none) for f in of.fields],
            )
        if isinstance(of, T.ArrayType):
            each = F.transform(v, lambda x, k: found(x, of.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
            return F.coalesce(F.flatten(each), none)
        if isinstance(of, T.MapType):
            each = F.transform(F.map_entries(v), lambda x: found(x["value"], of.valueType, F.concat(path, nested.path_step(x["key"]))))
            return F.coalesce(F.flatten(each), none)
        return none

    return F.to_json(plain(value, kind)), found(value, kind, F.lit("$"))


def _siblings(document: Column) -> Column:
    """The document's own keys, in canonical form."""
    members = F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")
    return F.to_json(F.to_variant_object(F.map_filter(members, lambda k, v: k != SIDECAR)))


def _around(siblings: Column, code: Column, key: bytes) -> Column:
    return mac(F.concat(siblings, F.lit("\n"), code), key)


def pack_into(document: Column, envelope: Column, key: bytes | None = None) -> Column:
    """A JSON object with the envelope beside its own keys; with the key, a code over these goes into the envelope. NULL
    for an object that holds the reserved key, and for what is no object. Give the envelope as a column of its own where
    the plan is not to make it several times."""
    if key is not None:
        code = _around(_siblings(document), F.get_json_object(envelope, "$.mac"), key)
        # An envelope without a code of its own has none over its siblings either.
        more = F.coalesce(F.concat(F.lit(',"around":"'), code, F.lit('"}')), F.lit("}"))
        envelope = F.concat(F.regexp_replace(envelope, r"\}\z", ""), more)
    whole = canonical(document)
    free = F.try_variant_get(F.try_parse_json(document), f"$.{SIDECAR}", "variant").isNull()
    comma = F.when(whole == "{}", F.lit("")).otherwise(F.lit(","))
    return F.when(
        free & whole.startswith("{"),
        F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), comma, F.lit(f'"{SIDECAR}":'), envelope, F.lit("}")),
    )


def unpack_from(document: Column) -> Column:
    """The envelope that pack_into put there; NULL if there is none."""
    return F.to_json(F.try_variant_get(F.try_parse_json(document), f"$.{SIDECAR}", "variant"))
