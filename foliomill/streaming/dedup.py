"""Exactly one copy of each message of an at-least-once queue.

`keep_one` is the batch form. `verdicts` is the streaming form: a keyed state store (RocksDB) of the identifiers seen,
expired by event-time watermark and checkpointed by Structured Streaming together with the output of each
micro-batch; identifiers that expire are put out too, and what comes later is looked up among them.

Identifiers are grouped by hash, and a group's live identifiers are one value of the state store, so that Python runs once a group and
batch and a batch reads and writes only the groups its identifiers fall into. An entry of its own for each identifier was tried twice (a
group state each, and map state within a group): it costs round trips between Python and the store that grow with the messages. So the number
of groups is the parameter that scales: with some thousand identifiers a group, a group costs a few ms whatever the corpus. Expired
identifiers are kept in a table by key hash, of which a batch reads the parts its new identifiers fall into.

Defined cases. The key is (job_id without outer blanks and in lower case, attempt with null as 0). Rows whose job_id is
null or blank have no key: they are always kept. Rows without delivery_id are kept only if no row of the key has
one. The same delivery_id listed twice for a key is one delivery. An empty table gives an empty result. Clashing extra
columns can't occur in the streaming form, which reads four columns only; `keep_one` uses names that are not in the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.text import WS
from ..session import work_dir

#: Groups that pass rows found to be repeats before the shuffle; they hold no state.
PASS_GROUPS = 64
#: Groups of identifiers, by hash. Fixed for the life of a checkpoint; choose it so that a group has some thousand live identifiers.
BUCKETS = 256
#: Parts of the table of expired identifiers, by key hash; a small batch reads few of them.
PARTS = 16
VERDICT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("delivery_id", T.LongType()),
        T.StructField("event_ms", T.LongType()),
        T.StructField("verdict", T.StringType()),
    ]
)

STATE = T.StructType([T.StructField("seen", T.BinaryType())])


def message_key(job_id: Column, attempt: Column) -> Column:
    """Null where job_id is null or blank."""
    name = F.lower(F.regexp_replace(job_id, rf"\A[{WS}]+|[{WS}]+\z", ""))
    return F.when(name != "", F.concat_ws("|", name, F.coalesce(attempt, F.lit(0)).cast("string")))


def keep_one(df: DataFrame) -> DataFrame:
    """The row of the smallest delivery_id of each message, with all columns of the input; batch form.

    The per-key minimum is an aggregate with partial aggregation before the shuffle, so a key that holds a third of all
    rows sends one row per input partition. Rows without a key bypass it.
    """
    key, ids = _free("key", df.columns), _free("first", df.columns)
    keyed = df.withColumn(key, message_key(F.col("job_id"), F.col("attempt")))
    some = keyed.where(F.col(key).isNotNull())
    row = F.struct(F.col("delivery_id").isNull().alias("none"), F.col("delivery_id"), F.struct(*map(_quoted, df.columns)).alias("row"))
    first = some.groupBy(key).agg(F.min_by(row["row"], F.struct(row["none"], row["delivery_id"])).alias(ids))
    return first.select(*(F.col(ids)[c].alias(c) for c in df.columns)).unionByName(
        keyed.where(F.col(key).isNull()).select(*map(_quoted, df.columns))
    )


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    low = {c.lower() for c in taken}
    while name in low:
        name = "_" + name
    return name


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def repeats(df: DataFrame) -> DataFrame:
    """delivery_id of each row for which the key has a smaller one; batch form, the check of the streaming form."""
    keyed = df.select(message_key(F.col("job_id"), F.col("attempt")).alias("key"), "delivery_id").where(
        F.col("key").isNotNull() & F.col("delivery_id").isNotNull()
    )
    rank = F.rank().over(Window.partitionBy("key").orderBy("delivery_id"))
    return keyed.withColumn("r", rank).where("r > 1").select("delivery_id").distinct()


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: of each key in an Arrow batch only the smallest delivery goes to the state store; the others
    are repeats already and pass by other groups, so a hot key sends one row per batch to its task."""
    for pdf in batches:
        pdf = pdf.drop_duplicates(["key", "delivery_id"]).sort_values(["key", "delivery_id"], kind="stable")
        pdf["shard"] = pdf["shard"].where(~pdf["key"].duplicated(), -1 - pdf["delivery_id"] % PASS_GROUPS)
        yield pdf[["shard", "key", "delivery_id", "event_time"]]


def _with_ms(pdf: pd.DataFrame) -> pd.DataFrame:
    ms = pdf["event_time"].astype("datetime64[ms]").astype("int64").where(pdf["event_time"].notna(), 0)
    return pd.DataFrame({"key": pdf["key"], "delivery_id": pdf["delivery_id"], "event_ms": ms})


def _pack(seen: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(seen, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _judge(sweep_ms: int, keep_ms: int):
    """Verdicts of the rows of one group of identifiers: the smallest delivery is kept, the others are repeats. A smaller delivery
    that comes later displaces the one kept so far, which then becomes a repeat: the result doesn't depend on the order of arrival."""
    columns = ["key", "delivery_id", "event_ms"]

    def judge(shard: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if shard[0] < 0:
            for pdf in pdfs:
                yield _with_ms(pdf).assign(verdict="repeat")
            return
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame({c: [] for c in columns})
        new = [] if state.hasTimedOut else [_with_ms(pdf) for pdf in pdfs]
        rows = pd.concat([x.assign(old=is_old) for x, is_old in [(old, True), *((n, False) for n in new)] if len(x)] or [old.assign(old=True)])
        # of equal deliveries the one already in the state comes first and the other goes: it has its verdict
        rows = rows.sort_values(["key", "delivery_id", "old"], ascending=[True, True, False], kind="stable").drop_duplicates(["key", "delivery_id"])
        again = rows["key"].duplicated()
        last = rows.groupby("key", sort=False)["event_ms"].max()
        seen = rows[~again][columns].assign(event_ms=last.to_numpy())
        expired = seen["event_ms"] + keep_ms < state.getCurrentWatermarkMs()
        live = seen[~expired]
        if len(live):
            state.update((_pack(live),))
            state.setTimeoutDuration(sweep_ms)
        elif state.exists:
            state.remove()
        yield pd.concat([rows[~again & ~rows["old"]][columns].assign(verdict="first"), rows[again][columns].assign(verdict="repeat"), seen[expired].assign(verdict="expired")])

    return judge


def verdicts(messages: DataFrame, watermark: str = "2 hours", keep_ms: int = 30 * 86_400_000, sweep_ms: int = 60_000, buckets: int = BUCKETS) -> DataFrame:
    """The stateful operator over a streaming table of messages with job_id, attempt, delivery_id, received_at.

    State of a key expires once the watermark has passed its last event by keep_ms, which gives a verdict 'expired' for the later
    lookup; sweeps run every sweep_ms of processing time. (With an event-time timeout Spark would drop late rows unseen.)
    """
    keyed = messages.select(
        message_key(F.col("job_id"), F.col("attempt")).alias("key"),
        F.col("delivery_id").cast("long").alias("delivery_id"),
        F.col("received_at").cast("timestamp").alias("event_time"),
    ).where(F.col("key").isNotNull() & F.col("delivery_id").isNotNull())
    keyed = keyed.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("shard"), "*")
    combined = keyed.mapInPandas(_combine, "shard long, key string, delivery_id long, event_time timestamp")
    return (
        combined.withWatermark("event_time", watermark)
        .groupBy("shard")
        .applyInPandasWithState(_judge(sweep_ms, keep_ms), VERDICT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    )


def _part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(PARTS)).cast("int")


_LOOKED_UP = T.StructType([*VERDICT.fields, T.StructField("part", T.IntegerType()), T.StructField("batch", T.LongType())])


def _sink(spark: SparkSession, root: str):
    """Writes a micro-batch to folders named by its number: a batch that is run again after a failure replaces its own output, so
    state checkpoint and output agree. Keys new to the state store are then looked up among those that expired in earlier batches, of
    which only the parts are read that the new keys fall into."""

    def write(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        df.write.mode("overwrite").partitionBy("verdict").parquet(f"{root}/raw/batch={batch}")
        mine = session.read.schema(VERDICT).parquet(f"{root}/raw/batch={batch}")
        if _exists(session, f"{root}/raw/batch={batch}/verdict=expired"):
            placed = mine.where("verdict = 'expired'").select("*", _part_of(F.col("key")).alias("part")).repartition("part")
            placed.write.mode("overwrite").partitionBy("part").parquet(f"{root}/expired/batch={batch}")
        if not _exists(session, f"{root}/expired"):
            return
        new = mine.where("verdict = 'first'").select("key", "delivery_id", "event_ms", _part_of(F.col("key")).alias("part"))
        parts = [r[0] for r in new.select("part").distinct().collect()]  # at most PARTS numbers
        known = session.read.schema(_LOOKED_UP).parquet(f"{root}/expired").where(F.col("part").isin(parts) & (F.col("batch") < batch))
        old = known.groupBy("key").agg(F.min_by(F.struct("delivery_id", "event_ms"), "delivery_id").alias("old"))
        loser = F.when(F.col("old.delivery_id") > F.col("delivery_id"), F.col("old")).otherwise(F.struct("delivery_id", "event_ms"))
        again = new.join(old, "key").where(F.col("old.delivery_id") != F.col("delivery_id"))
        again.select("key", loser.alias("r")).select("key", "r.*", F.lit("repeat").alias("verdict")).write.mode("overwrite").parquet(f"{root}/late/batch={batch}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_verdicts(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000, root: str | None = None, **options) -> DataFrame:
    """Runs the stream over all files now at path (a glob) and returns the verdicts put out: key, delivery_id, event_ms, verdict
    ('first' or 'repeat'; a delivery that was first at its time may be a repeat later). Called again with the same root it goes on where it stopped."""
    root = root or work_dir(spark, "dedup")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    wanted = {
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # sweeps by processing time would make batches without data for ever
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = (
            verdicts(source, **options)
            .writeStream.foreachBatch(_sink(spark, root))
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    query.awaitTermination()
    out = spark.createDataFrame([], VERDICT)
    if _exists(spark, f"{root}/raw"):
        out = spark.read.schema(_LOOKED_UP).parquet(f"{root}/raw").where("verdict <> 'expired'").select(*VERDICT.names)
    if _exists(spark, f"{root}/late"):
        out = out.unionByName(spark.read.schema(VERDICT).parquet(f"{root}/late/batch=*"))
    return out


def in_batches(df: DataFrame, files: int, root: str) -> str:
    """Writes a table of messages as a queue would have left it: files in the order of delivery, whose times rise. Returns the folder."""
    spark, path = df.sparkSession, f"{root}/queue"
    df.repartitionByRange(files, F.col("delivery_id").asc_nulls_first()).write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = sorted((f.getPath() for f in fs.listStatus(hadoop.Path(path)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    now = fs.getFileStatus(hadoop.Path(path)).getModificationTime()
    for i, file in enumerate(written):
        fs.setTimes(file, now + 1000 * i, -1)
    return path


def found(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """delivery_id of every repeat, by the streaming operator."""
    return run_verdicts(spark, path, schema, **options).where("verdict = 'repeat'").select("delivery_id").distinct()
