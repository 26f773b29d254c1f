"""The record codec: byte vectors worked out by hand, round trips, and frames that do not fit."""

from __future__ import annotations

import json
import struct as binary

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tickloom.schemas import KLINE, TICKER, TRADE
from tickloom.sources import avro

HEAD = b"\0\0\0\0\x07"


def fields(**kinds):
    return avro.fields_of({"fields": [{"name": n, "type": k} for n, k in kinds.items()]})


def coded(field_list, **columns):
    arrays = {n: pa.array(v, avro._ARROW[next(f.kind for f in field_list if f.name == n)]) for n, v in columns.items()}
    return avro.encode_batch(arrays, field_list, 7).to_pylist()


def test_hand_made_bytes():
    assert coded(fields(a="long"), a=[0, -1, 1, -64, 64, 8192, (1 << 63) - 1, -(1 << 63)]) == [HEAD + x for x in (
        b"\0", b"\1", b"\2", b"\x7f", b"\x80\1", b"\x80\x80\1", b"\xfe" + b"\xff" * 8 + b"\1", b"\xff" * 9 + b"\1")]
    assert coded(fields(s="string"), s=["", "foo", "é" * 64]) == [HEAD + b"\0", HEAD + b"\6foo", HEAD + b"\x80\2" + "é".encode() * 64]
    assert coded(fields(d="double", f="float", b="boolean"), d=[1.5], f=[-2.0], b=[True]) == [HEAD + binary.pack("<d", 1.5) + binary.pack("<f", -2.0) + b"\1"]
    assert coded(fields(x=["null", "string"], y=["long", "null"]), x=[None, "a"], y=[3, None]) == [HEAD + b"\0" + b"\0\6", HEAD + b"\2\2a" + b"\2"]
    # The value of a nullable text may hide bytes in Arrow; they are not sent.
    assert coded(fields(x=["null", "bytes"]), x=[b"ab", None, b"c"]) == [HEAD + b"\2\4ab", HEAD + b"\0", HEAD + b"\2\2c"]


def test_unknown_types_and_nulls_in_required_fields():
    for kind in ({"type": "array", "items": "long"}, ["null", "long", "string"], ["long", "string"]):
        with pytest.raises(ValueError):
            fields(a=kind)
    assert fields(a={"type": "long", "logicalType": "timestamp-millis"})[0].kind == "long"
    with pytest.raises(ValueError, match="required and null in 1 rows"):
        coded(fields(a="long"), a=[1, None])


_VALUES = {"long": st.integers(-(1 << 63), (1 << 63) - 1), "int": st.integers(-(1 << 31), (1 << 31) - 1), "double": st.floats(allow_nan=False),
           "string": st.text(st.characters(exclude_categories=["Cs"])), "bytes": st.binary(), "boolean": st.booleans()}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_round_trip_of_any_batch(data):
    kinds = data.draw(st.lists(st.sampled_from(sorted(_VALUES)), min_size=1, max_size=5))
    null_at = [data.draw(st.sampled_from([None, 0, 1])) for _ in kinds]
    known = [avro.Field(f"c{k}", kind, n) for k, (kind, n) in enumerate(zip(kinds, null_at))]
    rows = data.draw(st.integers(1, 6))
    columns = {f.name: pa.array([data.draw(_VALUES[f.kind] if f.null_at is None else st.none() | _VALUES[f.kind]) for _ in range(rows)],
                                avro._ARROW[f.kind]) for f in known}
    out, ok = avro.decode_batch(avro.encode_batch(columns, known, 1), known)
    assert ok.all() and {n: c.to_pylist() for n, c in out.items()} == {n: c.to_pylist() for n, c in columns.items()}


def test_frames_that_do_not_fit():
    known = fields(a="long", s="string", b="boolean")
    good = coded(known, a=[300], s=["xyz"], b=[True])[0]
    assert good == HEAD + b"\xd8\4\6xyz\1"
    cut = [good[:k] for k in range(5, len(good))]
    bad = [*cut, good + b"\0", good[:-1] + b"\2", HEAD + b"\xd8\4\x05xyz\1", HEAD + b"\xd8\4\6\xff\xfe\xfd\1", HEAD + b"\x80" * 11 + b"\6xyz\1",
           HEAD + b"\xd8\4" + b"\xfe" + b"\xff" * 8 + b"\1" + b"xyz\1"]
    columns, ok = avro.decode_batch(pa.array([bad[0], good, *bad[1:], good]), known)
    assert ok.tolist() == [False, True, *[False] * (len(bad) - 1), True]
    assert [r for r in zip(*(columns[c].to_pylist() for c in "asb")) if r[0] is not None] == [(300, "xyz", True)] * 2
    none, ok = avro.decode_batch(pa.array([], pa.binary()), known)
    assert len(ok) == 0 and all(len(c) == 0 for c in none.values())


def test_frames_split_off_in_a_table(spark):
    old, new = {"fields": [{"name": "a", "type": "long"}]}, {"fields": [{"name": "note", "type": ["null", "string"]}, {"name": "a", "type": "long"}]}
    frame = lambda number, body: b"\0" + number.to_bytes(4, "big") + body
    rows = [(1, frame(1, b"\2")), (2, frame(2, b"\2\4hi\4")), (3, frame(2, b"\0\6")), (4, frame(9, b"\2")), (5, b"\1" + frame(1, b"\2")[1:]),
            (6, None), (7, b"\0\0\0"), (8, b""), (9, frame(1, b"\2\2"))]
    struct = T.StructType([T.StructField("a", T.LongType()), T.StructField("note", T.StringType()), T.StructField("extra", T.DoubleType())])
    df = spark.createDataFrame(rows, "n long, value binary")
    out = {r["n"]: r for r in avro.decode_records(df, {1: old, 2: new}, struct, keep=("n",)).collect()}
    assert [(out[n]["schema_id"], out[n]["a"], out[n]["note"], out[n]["extra"]) for n in (1, 2, 3)] == [(1, 1, None, None), (2, 2, "hi", None), (2, 3, None, None)]
    assert all(out[n]["malformed"] is None for n in (1, 2, 3))
    assert [bytes(out[n]["malformed"]) for n in range(4, 10)] == [v or b"" for n, v in rows if n > 3]
    assert all(out[n]["a"] is None and out[n]["schema_id"] is None for n in range(4, 10))
    assert avro.decode_records(df.limit(0), {1: old}, struct).count() == 0


@pytest.mark.parametrize("struct", [TICKER, TRADE, KLINE, T.StructType([T.StructField(n, T.LongType() if n in ("event_time", "last_update_id") else T.StringType())
                                                                        for n in ("event_time", "symbol", "last_update_id", "bids", "asks")])])
def test_round_trip_of_the_record_kinds(spark, struct):
    value = {T.LongType: lambda i: F.col("id") * (1 << 40) * (-1) ** i, T.DoubleType: lambda i: F.col("id") / (i + 3), T.StringType: lambda i: F.concat(F.lit("sé"), F.col("id")),
             T.BooleanType: lambda i: F.col("id") % 2 == 0}
    df = spark.range(500).select(*(value[type(f.dataType)](i).cast(f.dataType).alias(f.name) for i, f in enumerate(struct)))
    schema = avro.avro_schema(struct, "Record")
    assert avro.spark_schema(json.loads(json.dumps(schema))) == struct
    out = avro.decode_records(avro.encode_records(df, schema, 3), {3: schema}, struct)
    assert out.filter("malformed IS NOT NULL").count() == 0
    assert sorted(map(tuple, out.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
