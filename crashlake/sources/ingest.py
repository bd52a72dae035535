"""Sources (A1–A7, A9): crash directories, fuzzer statistics, plot data, replay logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions.evidence import is_load_error, parse_log, replay_text
from crashlake.functions.patterns import PY_LINE_BREAK, jre, py_strip
from crashlake.operators.bloom import where_key_in

INSTANCE_FROM_PATH = r"([^/]+)/crashes/[^/]+$"


def signal_from_name(name: Column) -> Column:
    """A4: first `sig:NN` / `sig_NN` (any case) in the file name, as INT."""
    digits = F.regexp_extract(name, jre(R.SIGNAL_IN_NAME, i=True), 1)
    return F.when(digits == "", F.lit(None).cast("int")).otherwise(digits.try_cast("int"))


def instance_from_path(path: Column) -> Column:
    """A2: fuzzer instance = the directory holding `crashes/`."""
    return F.regexp_extract(path, INSTANCE_FROM_PATH, 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def escape_glob(path: str) -> str:
    """A path for readers that take globs."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def is_instance(spark: SparkSession, root: str) -> bool:
    """Whether `root` is one fuzzer's output (it has a `fuzzer_stats` file or a `crashes` folder) rather than a folder of such."""
    base = root.rstrip("/")
    for name in ("fuzzer_stats", "crashes"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return True
    return False


def instance_entries(spark: SparkSession, root: str, name: str, folders: bool = False) -> list[str]:
    """`root/name` if the root is an instance, else `root/*/name`, as far as such files (or folders) exist."""
    base = escape_glob(root.rstrip("/"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}" if is_instance(spark, root) else f"{base}/*/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(escape_glob(s.getPath().toString()) for s in fs.globStatus(path) or [] if s.isDirectory() == folders)


def crash_files(files: DataFrame, columns: list[str]) -> DataFrame:
    """A1: the crash inputs among `files` (path, size and `columns`): files right in a `crashes` folder whose name doesn't begin README."""
    name = file_name(F.col("path"))
    keep = F.col("path").rlike(r"/crashes/[^/]+$") & ~name.startswith(R.SKIP_NAME_PREFIX)
    out = files.where(keep).select("path", name.alias("name"), instance_from_path(F.col("path")).alias("fuzzer_instance"),
                                   signal_from_name(name).alias("signal"), "size", *columns)
    return out.withColumn("ord", F.struct("fuzzer_instance", "name"))


def scan_crash_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """A1/A3: crash files of `root` if it is an instance, else of its direct children, skipping names starting README.

    Only the `crashes` folders are listed and read; a file that can't be read
    fails the job.  `content` is only read when the hash is selected, and it is
    dropped right after hashing so the bytes never reach a shuffle.
    """
    folders = instance_entries(spark, root, "crashes", folders=True)
    reader = spark.read.format("binaryFile").schema(BINARY_FILE)
    df = reader.load(folders) if folders else spark.createDataFrame([], BINARY_FILE)
    hashed = [F.sha1(F.col("content")).alias("input_sha1")] if with_content else []
    return crash_files(df.select("path", F.col("length").alias("size"), *hashed), ["input_sha1"] if with_content else [])


def parse_fuzzer_stats(texts: DataFrame, body_col: str = "body") -> DataFrame:
    """`key : value` text -> one typed row per instance (last key wins).

    Each text is one file, so all parsing is array work inside the row.
    """
    lines = F.split(F.col(body_col), PY_LINE_BREAK)
    kv = F.transform(F.filter(lines, lambda l: l.contains(":")), lambda l: F.struct(
        py_strip(F.substring_index(l, ":", 1)).alias("k"),
        py_strip(F.substr(l, F.instr(l, ":") + 1)).alias("v")))
    df = texts.withColumn("_kv", kv)
    keys = F.array_distinct(F.transform(F.col("_kv"), lambda x: x["k"]))
    df = df.withColumn("raw", F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
        F.filter(F.col("_kv"), lambda x: x["k"] == k), -1)["v"])))

    def get(k: str) -> Column:
        return F.try_element_at(F.col("raw"), F.lit(k))

    def as_int(k: str) -> Column:
        return F.coalesce(get(k).try_cast("bigint"), F.lit(0).cast("bigint"))

    def with_fallback(a: str, b: str) -> Column:
        return F.when(as_int(a) != 0, as_int(a)).otherwise(as_int(b))

    def ts(k: str) -> Column:
        v = get(k)
        return F.when(v.isNull() | (v == ""), F.lit(None).cast("bigint")).otherwise(v.try_cast("bigint"))

    cmd = get("command_line")
    tokens = F.filter(F.split(F.coalesce(cmd, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    target = F.coalesce(F.nullif(get("target_mode"), F.lit("")),
                        F.nullif(F.try_element_at(tokens, F.lit(-1)), F.lit("")))
    ver_a, ver_b = R.STATS_FALLBACK_KEYS["afl_version"]
    return df.select(
        "fuzzer_instance",
        target.alias("target_binary"),
        cmd.alias("command_line"),
        ts("start_time").alias("start_time_epoch"),
        ts("last_update").alias("last_update_epoch"),
        as_int("execs_done").alias("execs_done"),
        F.coalesce(get("execs_per_sec").try_cast("double"), F.lit(0.0)).alias("execs_per_sec"),
        with_fallback(*R.STATS_FALLBACK_KEYS["paths_total"]).alias("paths_total"),
        with_fallback(*R.STATS_FALLBACK_KEYS["unique_crashes"]).alias("unique_crashes"),
        with_fallback(*R.STATS_FALLBACK_KEYS["unique_hangs"]).alias("unique_hangs"),
        F.coalesce(F.nullif(get(ver_a), F.lit("")), F.nullif(get(ver_b), F.lit(""))).alias("afl_version"),
        "raw",
    )


def with_timestamps(stats: DataFrame) -> DataFrame:
    """Epoch seconds as TIMESTAMP columns (session time zone decides the display)."""
    return (stats.withColumn("start_time", F.timestamp_seconds("start_time_epoch"))
                 .withColumn("last_update", F.timestamp_seconds("last_update_epoch")))


def read_instance_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(fuzzer_instance, body): whole text of each instance's file `name`; the instance is its folder.

    `input_file_name` is percent-encoded, crash paths are not: it is decoded so that both give the same instance.
    """
    files = instance_entries(spark, root, name)
    if not files:
        return spark.createDataFrame([], "fuzzer_instance string, body string")
    df = spark.read.text(files, wholetext=True).withColumn("path", F.input_file_name())
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return df.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("fuzzer_instance"), F.col("value").alias("body"))


def parse_plot_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """CSV-like plot rows; blank/'#' lines, short rows and bad integers are dropped."""
    s = py_strip(F.col(line_col))
    parts = F.transform(F.split(s, ","), py_strip)
    t = F.try_element_at(parts, F.lit(R.PLOT_TIME_COLUMN + 1)).try_cast("bigint")
    c_raw = F.try_element_at(parts, F.lit(R.PLOT_CRASHES_COLUMN + 1))
    c = F.when(c_raw == "", F.lit(0).cast("bigint")).otherwise(c_raw.try_cast("bigint"))
    keep = (s != "") & ~s.startswith("#") & (F.size(parts) >= R.PLOT_MIN_COLUMNS) & t.isNotNull() & c.isNotNull()
    return lines.where(keep).select(*[x for x in lines.columns if x != line_col],
                                    t.alias("unix_time"), c.alias("unique_crashes"))


def first_usable(attempts: DataFrame, columns: dict[str, Column], key: str = "ord", only: DataFrame | None = None) -> DataFrame:
    """(key, attempt, columns) of each crash's first attempt whose output is not a loader failure.

    `columns` are computed from `_text`, the text of a replay, and `stderr` before
    anything is moved, so the text meets no exchange unless it is asked for.  `only` (a
    frame with `key`) rules out other crashes' logs before they are parsed, by a
    Bloom filter of its keys: a log that gets past it is dropped by whatever
    joins on the key.  Repeated logs of an attempt count once.
    """
    if only is not None:
        attempts = where_key_in(attempts, only, key)
    text = replay_text(F.col("stdout"), F.col("stderr"))
    ok = attempts.select(key, "attempt", "stderr", text.alias("_text")).where(~is_load_error(F.col("_text")))
    ok = ok.select(key, "attempt", F.xxhash64("_text").alias("_hash"), *(c.alias(n) for n, c in columns.items()))
    first = F.row_number().over(Window.partitionBy(key).orderBy("attempt", "_hash"))
    return ok.withColumn("_nth", first).where(F.col("_nth") == 1).select(key, "attempt", *columns)


def choose_replay(attempts: DataFrame, key: str = "ord") -> DataFrame:
    """A9 with the chosen text.

    The log of a failed first attempt is replaced by the retry (if any); a
    crash whose attempts all fail to load has no usable result.
    """
    return first_usable(attempts, {"text": F.col("_text")}, key)


def replay_results(attempts: DataFrame, key: str = "ord", only: DataFrame | None = None) -> DataFrame:
    """A8 over A9: (key, attempt, dbg) for crashes with a usable replay result; `dbg` holds the text."""
    return first_usable(attempts, {"dbg": parse_log(F.col("_text"))}, key, only).where(F.col("dbg").isNotNull())


def replay_facts(attempts: DataFrame, key: str = "ord", only: DataFrame | None = None) -> DataFrame:
    """A8 over A9 without the text: (key, attempt) and what classification reads from the log (`classify.log_facts`)."""
    from crashlake.operators.classify import log_facts

    if only is not None:
        attempts = where_key_in(attempts, only, key)
    text = replay_text(F.col("stdout"), F.col("stderr"))
    ok = attempts.select(key, "attempt", text.alias("_text")).where(~is_load_error(F.col("_text")))
    found = log_facts(ok.select(key, "attempt", F.xxhash64("_text").alias("_hash"), parse_log(F.col("_text")).alias("dbg")))
    first = F.row_number().over(Window.partitionBy(key).orderBy("attempt", "_hash"))
    return found.withColumn("_nth", first).where((F.col("_nth") == 1) & F.col("has_log")).drop("_nth", "_hash", "attempt")
