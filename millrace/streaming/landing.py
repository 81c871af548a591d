"""Landing of a source's files as they arrive, with the batch operators.

The stream is one of files, not of rows: a micro-batch is a list of new files, and each is read by its own header, validated,
quarantined and entered in the ledger as a batch's files are. No watermark stands before the raw table: it would drop valid rows that come
late, which the lookback of the models handles. Keys meet across micro-batches in the raw table, a log that folds each key's versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import at, count_where, record_checksum
from ..operators.contracts import CONTRACTS
from ..operators.ledger import file_status, ledger_decision
from ..operators.tables import latest
from ..operators.validation import ROW, Validated, drift_frame, drift_of, typed, validate, with_parents
from ..operators.versions import Staged, Store
from ..sources.csv_batch import BatchError, by_header, read_files

FILE = "path string, modificationTime timestamp, length long, content binary"
EPOCHS = "stream string, epoch long, files long, accepted long, quarantined long, at timestamp_ntz"
#: Files of a micro-batch.
FILES_AT_ONCE = 100


def _readable(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[list[str], list[str]]], list[str]]:
    """Files by their headers, and those without a proper one."""
    good, bad = [], []
    for p in paths:
        try:
            by_header(spark, [p])
            good.append(p)
        except BatchError:
            bad.append(p)
    return by_header(spark, good), bad


def stage_files(store: Store, source: str, paths: list[str], stream: str, epoch: int, as_of: str) -> Staged:
    """What a micro-batch of files changes, staged: accepted rows in raw_<source>, rejected ones in quarantine, drifts, the file ledger, and the
    epoch itself, so that one that is repeated after it was published stages nothing.

    A file whose bytes are known and done is skipped. A key that repeats in a file is rejected there; in a later file it is a new
    version, which replaces the stored one by checksum and clock. Parents are looked for in the store, where it has their table. A
    file without a proper header, or with rows of too many fields, fails as a whole, and the others go on."""
    spark, contract = store.spark, CONTRACTS[source]
    epochs = store.read("stream_epochs")
    if epochs is not None and not epochs.filter((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty():
        return {}
    batch, now = f"stream-{epoch}", at(as_of)
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(paths).select(F.lit(source).alias("source_name"), F.concat(F.lit(f"{source}/stream/"), name).alias("logical_key"), F.sha2("content", 256).alias("checksum"), F.col("length").alias("size_bytes"), "path")
    files = files.dropDuplicates(["checksum"])
    ledger = store.read("source_files")
    if ledger is None:
        ledger = spark.createDataFrame([], "file_id string, source_name string, logical_key string, checksum string, status string, created_at timestamp_ntz")
    told = {r["path"]: r for r in ledger_decision(files, ledger).collect()}  # a row a file of the micro-batch
    new = sorted(p for p, r in told.items() if r["decision"] != "duplicate")
    groups, failed = _readable(spark, new)
    read, drifts = [], []
    for header, own in groups:
        try:
            read.append((header, own, read_files(spark, header, own)))
        except BatchError:  # of which file, only reading each tells
            for p in own:
                try:
                    read.append((header, [p], read_files(spark, header, [p])))
                except BatchError:
                    failed.append(p)
    parents = {p: df for p in contract.parents.values() if (df := store.read(f"raw_{p}")) is not None}
    checked = []
    for header, own, rows in read:
        for p in own:  # keys repeat within a file
            judged = validate(rows.filter(F.col("_file") == p).drop("_file"), contract, as_of, header)
            if len(parents) == len(contract.parents):
                judged = with_parents(judged, contract, parents)
            checked.append(judged.withColumn("_path", F.lit(p)).withColumn("_order", F.lit(new.index(p))))
            drifts.append(drift_of(contract, header))
    ids = {p: told[p]["known_file_id"] or f"{source}-{told[p]['checksum'][:16]}" for p in told}
    id_of = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    staged: Staged = {}
    counts: dict[str, tuple[int, int]] = {}
    if checked:
        rows = checked[0]
        for df in checked[1:]:
            rows = rows.unionByName(df)
        rows = rows.withColumn("_source_file_id", id_of[F.col("_path")]).persist()
        bad = F.size("reasons") > 0
        counts = {r["_path"]: (r["ok"], r["bad"]) for r in rows.groupBy("_path").agg(count_where(~bad).alias("ok"), count_where(bad).alias("bad")).collect()}
        good = rows.filter(~bad)
        values = typed(good, contract, "_source_file_id", "_order")
        incoming = values.select(*contract.columns, F.lit(batch).alias("_batch_id"), "_source_file_id", ROW, now.alias("_ingested_at"), record_checksum(list(contract.columns)).alias("_record_checksum"), "_order")
        incoming = latest(incoming, [contract.key], F.desc("updated_at"), F.desc("_order")).drop("_order")
        staged |= store.stage_rows(f"raw_{source}", incoming, [contract.key], "current")
        quarantine = Validated(rows, drifts[0]).quarantined_with("_source_file_id")
        staged |= store.stage_rows("quarantine", quarantine.select(F.col("_source_file_id").alias("file_id"), "source_name", ROW, "raw_payload", "reasons"), ["file_id", ROW])
        staged |= store.stage_rows("schema_changes", drift_frame(spark, drifts).select(F.lit(f"{stream}-{epoch}").alias("run_id"), "*"), [])
        rows.unpersist()
    entered = []
    for p in new:
        r, (ok, rejected) = told[p], counts.get(p, (0, 0))
        entered.append((ids[p], f"{stream}-{epoch}", batch, source, r["logical_key"], r["checksum"], p, r["size_bytes"], ok + rejected, ok, rejected, p in failed))
    if entered:
        columns = "file_id string, run_id string, batch_id string, source_name string, logical_key string, checksum string, object_key string, size_bytes long, row_count long, accepted_count long, quarantined_count long, failed boolean"
        breaking = F.lit(any(d.kind == "breaking" for d in drifts))
        status = F.when(F.col("failed"), "failed").otherwise(file_status(F.col("accepted_count"), F.col("quarantined_count"), breaking))
        frame = spark.createDataFrame(entered, columns).select("*", status.alias("status"), now.alias("created_at"), now.alias("processed_at")).drop("failed")
        staged |= store.stage_rows("source_files", frame, ["file_id"])
    sums = [sum(c[i] for c in counts.values()) for i in (0, 1)]
    done = spark.createDataFrame([(stream, epoch, len(paths), *sums)], EPOCHS.rsplit(", ", 1)[0]).select("*", now.alias("at"))
    return staged | store.stage_rows("stream_epochs", done, ["stream", "epoch"])


def land_stream(spark: SparkSession, source: str, folder: str, store: Store, checkpoint: str, as_of: str) -> StreamingQuery:
    """Lands the csv files that a folder has got since the last call (availableNow), FILES_AT_ONCE a micro-batch, each micro-batch in one commit.

    A micro-batch that is repeated after a failure changes nothing: its epoch is published with it. Another writer's commits don't
    disturb it, since all it does is add rows to logs."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", FILES_AT_ONCE).load(folder)

    def load(batch: DataFrame, epoch: int) -> None:
        paths = [r[0] for r in batch.select("path").collect()]  # FILES_AT_ONCE at most
        if paths:
            store.retried(lambda: stage_files(store, source, sorted(paths), f"{source}@{checkpoint}", epoch, as_of))

    return stream.select("path").writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
