"""Progress of index runs: streams, and the batch forms of the same folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEARTBEAT_SECONDS = 20


def frame(event: Column) -> Column:
    """A server-sent event frame of a struct."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def frames(text: Column) -> Column:
    """The payloads of the complete frames in a text; a frame that is cut off is left out."""
    parts = F.slice(F.split(text, "\n\n"), 1, F.greatest(F.size(F.split(text, "\n\n")) - 1, F.lit(0)))
    return F.transform(F.filter(parts, lambda p: p.startswith("data: ")), lambda p: F.substring(p, 7, 2**31 - 1))


def heartbeat_gaps(events: DataFrame, key: str, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """(key, ts, previous_ts, silent_seconds): events that follow a silence of more than so many seconds."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    rows = events.select(key, "event_id", "ts", F.lag("ts").over(w).alias("previous_ts"))
    silent = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))
    return rows.withColumn("silent_seconds", F.round(silent / 1e6, 6)).where(F.col("silent_seconds") > seconds)


def latest_stage(events: DataFrame, key: str, stage: str) -> DataFrame:
    """The last event of each stage of each run."""
    last = F.max_by(F.struct("event_id", "ts", "value"), "event_id").alias("e")
    return events.groupBy(key, stage).agg(last).select(key, stage, "e.event_id", "e.ts", "e.value")


def run_states(runs: DataFrame) -> DataFrame:
    """(url, state, n_runs, last_started): the state of each address by its latest run; loaded twice counts once."""
    once = runs.dropDuplicates(["id"])
    last = once.groupBy("url").agg(F.max_by("status", F.struct("started_at", "id")).alias("state"), F.count("*").alias("n_runs"), F.max("started_at").alias("last_started"))
    return last


def run_pending(runs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, status, pending, finished): each run with the chunks of its commit that lack a vector; one is finished when it is done and lacks none."""
    missing = chunks.join(vectors.where("embedding is not null").select("id"), "id", "left_anti").groupBy("repo_id", "sha").agg(F.count("*").alias("pending"))
    rows = runs.dropDuplicates(["id"]).join(missing, ["repo_id", "sha"], "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    return rows.select("id", "status", "pending", ((F.col("status") == "done") & (F.col("pending") == 0)).alias("finished"))


def steps(events: DataFrame, key: str) -> DataFrame:
    """(key, event_id, step): the events of each run numbered from 1 in their order."""
    return events.select(key, "event_id", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")).alias("step"))


def fold_exchange(events: DataFrame) -> DataFrame:
    """(run_id, answer, steps, citations, done, error) of the frames (run_id, event_id, type, step, tool, text, path, first, last) of each run.

    Tokens are put together in their order; a step has the summary of its result, null while it runs; ``done`` holds after a
    done or an error frame, ``error`` is the text of the last error. A run's frames are one exchange, which a reader holds whole.
    """
    of = lambda kind, *fields: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("event_id", *fields))))
    by = events.groupBy("run_id").agg(
        of("token", "text").alias("tokens"), of("step_start", "step", "tool").alias("started"), of("step_result", "step", "text").alias("results"), of("citation", "path", "first", "last").alias("cited"),
        F.max(F.col("type").isin("done", "error")).alias("done"), F.max_by(F.when(F.col("type") == "error", F.col("text")), F.when(F.col("type") == "error", F.col("event_id"))).alias("error"),
    )
    summary = lambda s: F.element_at(F.transform(F.filter("results", lambda r: r["step"] == s["step"]), lambda r: r["text"]), -1)
    steps_ = F.transform("started", lambda s: F.struct(s["step"].alias("step"), s["tool"].alias("tool"), F.when(F.exists("results", lambda r: r["step"] == s["step"]), summary(s)).alias("summary")))
    cited = F.transform("cited", lambda c: F.struct(c["path"].alias("path"), c["first"].alias("first"), c["last"].alias("last")))
    return by.select("run_id", F.array_join(F.transform("tokens", lambda t: t["text"]), "").alias("answer"), steps_.alias("steps"), cited.alias("citations"), "done", "error")


def usage(events: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, n, total): how many events each run has and what they add up to."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(amount), 6).alias("total"))


def stage_totals(runs: DataFrame) -> DataFrame:
    """(id, files, chunks, total_ms): what each run counted, from its JSON."""
    stats = F.from_json("stats", "files long, chunks long, ms map<string, long>")
    rows = runs.select("id", stats.alias("s"))
    total = F.aggregate(F.map_values("s.ms"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", F.col("s.files").alias("files"), F.col("s.chunks").alias("chunks"), total.alias("total_ms"))


def progress_stream(spark: SparkSession, path: str, schema, key: str = "user_id") -> DataFrame:
    """A stream of (key, window, n, last_value) over the event files that arrive in a folder; late by up to ten minutes."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    by = rows.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", "1 hour"), key)
    return by.agg(F.count("*").alias("n"), F.max_by("value", "event_id").alias("last_value"))


def drain(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a stream over all that is there into Parquet and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def backfill_stream(pending: DataFrame, embed, sink: str, checkpoint: str) -> None:
    """Embed texts (id, text) as they arrive; each micro-batch is written once, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    pending.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
