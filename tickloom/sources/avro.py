"""Binary Avro records in framed messages, coded by whole Arrow batches.

A record is its fields one after the other: zigzag varints, length-prefixed text, little-endian floats, one-byte booleans, and the
branch number before an optional value. Encoding computes the lengths of all rows of a field at once, places rows by a
running sum and scatters the bytes; decoding walks all rows of a batch through one field at a time. Frames carry the
schema id, so one topic may hold records of several schemas.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

HEADER = 5
_AVRO = {T.LongType: "long", T.IntegerType: "int", T.DoubleType: "double", T.FloatType: "float", T.StringType: "string",
         T.BinaryType: "bytes", T.BooleanType: "boolean"}
_SPARK = {name: kind() for kind, name in _AVRO.items()}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
          "bytes": pa.binary(), "boolean": pa.bool_()}
_STEPS = [np.uint64(1 << 7 * k) for k in range(1, 10)]


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    #: Place of null in the union: 0 or 1, none for a required field.
    null_at: int | None = None


def avro_schema(struct: T.StructType, name: str, optional: bool = False) -> dict:
    """The record schema of a Spark schema; all fields required, or all optional with null first."""
    kinds = [_AVRO[type(f.dataType)] for f in struct]
    return {"type": "record", "name": name,
            "fields": [{"name": f.name, "type": ["null", k] if optional else k} for f, k in zip(struct, kinds)]}


def fields_of(schema: Mapping) -> list[Field]:
    """The fields of a flat record schema of primitive types and unions of null with one."""
    out = []
    for f in schema["fields"]:
        kind, null_at = f["type"], None
        if isinstance(kind, list):
            if len(kind) != 2 or kind.count("null") != 1:
                raise ValueError(f"field {f['name']}: only a union of null and one type is known")
            null_at = kind.index("null")
            kind = kind[1 - null_at]
        if isinstance(kind, Mapping):  # a logical type is coded as its base type
            kind = kind["type"]
        if kind not in _ARROW:
            raise ValueError(f"field {f['name']}: type {kind} is not known")
        out.append(Field(f["name"], kind, null_at))
    return out


def spark_schema(schema: Mapping) -> T.StructType:
    return T.StructType([T.StructField(f.name, _SPARK[f.kind]) for f in fields_of(schema)])


# ------------------------------------------------------------------------------------------- encoding

def _zigzag(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zigzag codes and their lengths as varints."""
    v = values.astype(np.int64)
    code = ((v << 1) ^ (v >> 63)).view(np.uint64)
    return code, 1 + sum((code >= s).astype(np.int64) for s in _STEPS)


def _put_varint(out: np.ndarray, at: np.ndarray, code: np.ndarray, size: np.ndarray) -> None:
    for k in range(int(size.max()) if len(size) else 0):
        rows = np.flatnonzero(size > k)
        byte = (code[rows] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[at[rows] + k] = byte | np.where(size[rows] > k + 1, np.uint64(0x80), np.uint64(0))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the values of a text or binary column, and the bytes they point into."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    return offsets[:-1], size, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of some stretches, one stretch after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _present(column: pa.Array, kind: str) -> np.ndarray:
    """Values as numpy, zero in the place of null."""
    zero = pa.scalar(False if kind == "boolean" else 0, _ARROW[kind])
    return column.fill_null(zero).to_numpy(zero_copy_only=False)


def encode_batch(columns: Mapping[str, pa.Array], fields: list[Field], schema_id: int) -> pa.Array:
    """Framed records of the rows of some columns."""
    rows = len(next(iter(columns.values())))
    total, plan = np.full(rows, HEADER, np.int64), []
    for f in fields:
        column = columns[f.name].cast(_ARROW[f.kind])
        there = ~column.is_null().to_numpy(zero_copy_only=False)
        if f.null_at is None and not there.all():
            raise ValueError(f"field {f.name} is required and null in {int((~there).sum())} rows")
        if f.null_at is not None:
            branch = _zigzag(np.where(there, 1 - f.null_at, f.null_at))
            plan.append((f, "branch", total.copy(), branch, None))
            total += 1
        if f.kind in ("long", "int"):
            code, size = _zigzag(_present(column, f.kind))
            plan.append((f, "varint", total.copy(), (code, np.where(there, size, 0)), None))
            total += np.where(there, size, 0)
        elif f.kind in ("string", "bytes"):
            start, size, data = _bytes_of(column)
            code, head = _zigzag(size)
            head = np.where(there, head, 0)
            plan.append((f, "text", total.copy(), (code, head), (start, size, data)))
            total += head + size
        else:
            values = _present(column, f.kind)
            raw = values.astype({"double": "<f8", "float": "<f4", "boolean": np.uint8}[f.kind])
            width = np.where(there, raw.itemsize, 0)
            plan.append((f, "fixed", total.copy(), (raw.view(np.uint8).reshape(rows, -1), there), None))
            total += width
    offsets = np.concatenate(([0], np.cumsum(total)))
    out, base = np.zeros(int(offsets[-1]), np.uint8), offsets[:-1]
    for k, byte in enumerate(b"\0" + int(schema_id).to_bytes(4, "big")):
        out[base + k] = byte
    for f, how, at, code, text in plan:
        at = base + at
        if how in ("branch", "varint", "text"):
            _put_varint(out, at, *code)
        if how == "text":
            start, size, data = text
            out[_stretches(at + code[1], size)] = data[_stretches(start, size)]
        if how == "fixed":
            raw, there = code
            for k in range(raw.shape[1]):
                out[at[there] + k] = raw[there, k]
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def encode_records(df: DataFrame, schema: Mapping, schema_id: int, key: str = "symbol") -> DataFrame:
    """(key, value) rows for a topic. A null in a required field is an error."""
    fields = fields_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {f.name: batch.column(f"f{k}") for k, f in enumerate(fields)}
            value = encode_batch(columns, fields, schema_id) if batch.num_rows else pa.array([], pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), value.cast(pa.binary())], ["key", "value"])

    sent = df.select(F.col(key).cast("string").alias("key"), *(F.col(f.name).alias(f"f{k}") for k, f in enumerate(fields)))
    return sent.mapInArrow(run, "key string, value binary")


# ------------------------------------------------------------------------------------------- decoding

class _Rows:
    """All rows of a batch, each with a place in the bytes; rows that do not fit their schema are struck out."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        # Bytes behind the last row, so that struck-out rows may be read without a check.
        self.data, self.at, self.end = np.concatenate((data, np.zeros(16, np.uint8))), start.copy(), end
        self.ok = np.ones(len(start), bool)

    def need(self, size) -> None:
        fits = self.at + size <= self.end
        self.ok &= fits
        self.at = np.where(fits, self.at, self.end)

    def varint(self, rows: np.ndarray) -> np.ndarray:
        code, going = np.zeros(len(self.at), np.uint64), rows & self.ok
        for k in range(10):
            short = going & (self.at >= self.end)
            self.ok &= ~short
            going &= ~short
            live = np.flatnonzero(going)
            if not len(live):
                break
            byte = self.data[self.at[live]].astype(np.uint64)
            if k == 9:
                self.ok[live[byte > 1]] = False
            code[live] |= (byte & np.uint64(0x7F)) << np.uint64(7 * k)
            self.at[live] += 1
            going[live] = byte >= 0x80
        self.ok &= ~going
        return (code >> np.uint64(1)).view(np.int64) ^ -(code & np.uint64(1)).view(np.int64)

    def fixed(self, rows: np.ndarray, kind: str) -> np.ndarray:
        dtype = np.dtype({"double": "<f8", "float": "<f4", "boolean": "u1"}[kind])
        self.need(np.where(rows, dtype.itemsize, 0))
        at = np.where(rows & self.ok, self.at, len(self.data) - 16)
        values = np.ascontiguousarray(self.data[at[:, None] + np.arange(dtype.itemsize)]).view(dtype).ravel()
        self.at += np.where(rows & self.ok, dtype.itemsize, 0)
        if kind == "boolean":
            self.ok &= ~(rows & (values > 1))
            return values == 1
        return values

    def text(self, rows: np.ndarray, kind: str) -> pa.Array:
        size = self.varint(rows)
        self.ok &= ~(rows & (size < 0))
        size = np.where(rows & self.ok, size, 0)
        # A length near the top of 64 bits must not wrap.
        size = np.minimum(size, len(self.data) + 1)
        self.need(size)
        size = np.where(self.ok, size, 0)
        body = self.data[_stretches(self.at, size)]
        self.at += size
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        if kind == "bytes":
            return found.cast(pa.binary())
        try:
            return found.cast(pa.string())
        except pa.ArrowInvalid:
            texts = []
            for k, value in enumerate(found.to_pylist()):
                try:
                    texts.append(value.decode("utf-8"))
                except UnicodeDecodeError:
                    self.ok[k] = False
                    texts.append(None)
            return pa.array(texts, pa.string())


def decode_batch(values: pa.Array, fields: list[Field]) -> tuple[dict[str, pa.Array], np.ndarray]:
    """Columns of framed records of one schema, and which rows are well formed (columns of the others are null)."""
    start, size, data = _bytes_of(values)
    rows = _Rows(data, start + HEADER, start + size)
    rows.need(0)
    found, n = {}, len(start)
    for f in fields:
        there = np.ones(n, bool)
        if f.null_at is not None:
            branch = rows.varint(there)
            rows.ok &= (branch == 0) | (branch == 1)
            there = branch != f.null_at
        if f.kind in ("long", "int"):
            value = rows.varint(there)
            if f.kind == "int":
                rows.ok &= ~there | ((value >= -(1 << 31)) & (value < 1 << 31))
                value = np.where(rows.ok, value, 0)
        elif f.kind in ("string", "bytes"):
            value = rows.text(there, f.kind)
        else:
            value = rows.fixed(there, f.kind)
        found[f.name] = (value, there)
    ok = rows.ok & (rows.at == rows.end)
    columns = {}
    for f in fields:
        value, there = found[f.name]
        hidden = pa.array(~(ok & there))
        value = value if isinstance(value, pa.Array) else pa.array(value)
        columns[f.name] = pa.compute.if_else(hidden, pa.scalar(None, value.type), value).cast(_ARROW[f.kind])
    return columns, ok


def decode_records(messages: DataFrame, schemas: Mapping[int, Mapping], struct: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of framed messages under the fields of ``struct``, by name; fields that a record's schema lacks are null.

    ``schemas`` are the known record schemas by id. ``malformed`` holds the value of a frame that is null, too short, of another magic
    byte or an unknown schema, or does not fit its schema exactly; its fields are null. ``keep`` columns pass.
    """
    import pyarrow.compute  # noqa: F401
    known = {number: fields_of(s) for number, s in schemas.items()}
    wanted = [(f.name, _ARROW[_AVRO[type(f.dataType)]]) for f in struct]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        for batch in batches:
            values, n = batch.column("value"), batch.num_rows
            start, size, data = _bytes_of(values)
            data = np.concatenate((data, np.zeros(HEADER, np.uint8)))
            framed = np.where(size >= HEADER, start, len(data) - HEADER)
            head = data[framed[:, None] + np.arange(HEADER)].astype(np.int64)
            number = np.where((size >= HEADER) & (head[:, 0] == 0), head[:, 1:] @ (1 << np.arange(24, -1, -8)), -1)
            parts, places = [], []
            for schema_id in np.unique(number):
                at = np.flatnonzero(number == schema_id)
                some = values.take(pa.array(at))
                columns, ok = decode_batch(some, known[schema_id]) if schema_id in known else ({}, np.zeros(len(at), bool))
                arrays = [columns[c].cast(kind) if c in columns else pa.nulls(len(at), kind) for c, kind in wanted]
                bad = pc.if_else(pa.array(ok), pa.scalar(None, pa.binary()), pc.coalesce(some.cast(pa.binary()), pa.scalar(b"", pa.binary())))
                ids = pc.if_else(pa.array(ok), pa.array(np.full(len(at), schema_id)), pa.scalar(None, pa.int64()))
                parts.append(pa.RecordBatch.from_arrays([ids, bad, *arrays], names=["schema_id", "malformed", *(c for c, _ in wanted)]))
                places.append(at)
            if n:
                back = pa.array(np.argsort(np.concatenate(places), kind="stable"))
                table = pa.Table.from_batches(parts).take(back).combine_chunks()
                kept = [batch.column(f"k{j}") for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(c.chunk(0) for c in table.columns)],
                                                 names=[*(f"k{j}" for j in range(len(keep))), *table.column_names])

    sent = messages.select("value", *(F.col(c).alias(f"k{j}") for j, c in enumerate(keep)))
    schema = T.StructType([*(T.StructField(f"k{j}", messages.schema[c].dataType) for j, c in enumerate(keep)),
                           T.StructField("schema_id", T.LongType()), T.StructField("malformed", T.BinaryType()),
                           *(T.StructField(f.name, f.dataType) for f in struct)])
    return sent.mapInArrow(run, schema).withColumnsRenamed({f"k{j}": c for j, c in enumerate(keep)})
