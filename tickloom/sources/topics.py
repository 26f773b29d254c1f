"""Topic sources and the framed message encoding.

A message is one magic byte 0, a big-endian 4-byte schema id and the encoded record. Avro payloads
need the spark-avro package on the class path; JSON payloads always work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MAGIC = "00"
HEADER_BYTES = 5
MAX_OFFSETS_PER_TRIGGER = 500_000


def read_topic(spark: SparkSession, topic: str, servers: str) -> DataFrame:
    """Streaming topic source: from the latest offset, bounded per trigger, tolerant of data loss."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", "latest").option("failOnDataLoss", "false")
            .option("maxOffsetsPerTrigger", MAX_OFFSETS_PER_TRIGGER).load())


def read_files_as_topic(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                        files_per_trigger: int = 1, file_name: str | None = None) -> DataFrame:
    """A directory of files as a stream, bounded per trigger like the topic source."""
    reader = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", files_per_trigger))
    if file_name:
        reader = reader.option("pathGlobFilter", file_name)
    return reader.load(path)


def _schema_id_bytes(schema_id: int) -> Column:
    return F.unhex(F.lit(f"{MAGIC}{schema_id:08x}"))


def encode_framed(df: DataFrame, schema_id: int, key: str = "symbol", payload: str = "json",
                  avro_schema: str | None = None) -> DataFrame:
    """(key, value) rows for a topic; the key is the symbol, so a symbol stays ordered."""
    record = F.struct(*df.columns)
    if payload == "avro":
        from pyspark.sql.avro.functions import to_avro
        body = to_avro(record, avro_schema) if avro_schema else to_avro(record)
    else:
        body = F.to_json(record).cast("binary")
    return df.select(F.col(key).alias("key"), F.concat(_schema_id_bytes(schema_id), body).alias("value"))


def decode_framed(messages: DataFrame, schema: T.StructType, payload: str = "json",
                  avro_schema: str | None = None) -> DataFrame:
    """Records with their schema id; frames without the magic byte are dropped."""
    framed = messages.filter(F.hex(F.substring("value", 1, 1)) == MAGIC)
    body = F.substring(F.col("value"), F.lit(HEADER_BYTES + 1), F.length("value") - HEADER_BYTES)
    schema_id = F.conv(F.hex(F.substring("value", 2, 4)), 16, 10).cast("bigint")
    if payload == "avro":
        from pyspark.sql.avro.functions import from_avro
        record = from_avro(body, avro_schema)
    else:
        record = F.from_json(body.cast("string"), schema)
    return framed.select(schema_id.alias("schema_id"), record.alias("r")).select("schema_id", "r.*")


def write_topic(encoded: DataFrame, topic: str, servers: str, checkpoint: str):
    """Streaming write of framed rows to a topic."""
    return (encoded.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())
