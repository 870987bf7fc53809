"""File sources and sinks of the reference formats.

All readers are Spark data sources (text / json / csv / binaryFile); nothing is
read on the driver.  Keyed JSON objects (``{id: {...}}``) are parsed with
``from_json`` into a map and exploded; newline-delimited JSON is the path for
large catalogues.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import literal_list


def read_inter(spark: SparkSession, path: str, split: str, bad: bool = False) -> DataFrame:
    """A1: TSV ``user \\t space-separated history \\t target``; each file's header is skipped, lines
    without exactly 3 fields are dropped; ``line_no`` is the 0-based data line over all files.

    Ids that are no numbers become null; with ``bad`` a column ``_bad`` marks such rows,
    without it they are dropped.
    """
    from .ordinal import with_ordinal

    # Spark's own CSV reader drops the header of every file
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema="_u string, _h string, _t string",
                         enforceSchema=True, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    d = raw.withColumn("_f", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    d = with_ordinal(d, ["_f", "_id"], "line_no").filter(F.col("_t").isNotNull())
    hist = F.filter(F.split(F.trim(F.coalesce("_h", F.lit(""))), " "), lambda x: x != "")
    d = d.select(
        F.lit(split).alias("split"), "line_no", F.col("_u").alias("user_id"),
        F.transform(hist, lambda x: x.try_cast("bigint")).alias("history"), F.trim("_t").try_cast("bigint").alias("target"),
    ).withColumn("_bad", F.col("target").isNull() | F.exists("history", lambda x: x.isNull()))
    return d if bad else d.filter(~F.col("_bad")).drop("_bad")


def _read_keyed_json(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """``ord, key, value`` of keyed JSON objects, one per file; a file that does not parse is an error."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string,{value_type}>")
    broken = F.raise_error(F.concat(F.lit("not a keyed JSON object: "), F.input_file_name())).cast(f"map<string,{value_type}>")
    whole = whole.select(F.coalesce(m, broken).alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).select("ord", "e.key", "e.value")


def _is_lines(spark: SparkSession, path: str) -> bool:
    """JSON lines or one keyed object: lines are objects that hold ``item_id`` (first data line)."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return bool(first) and spark.range(1).select(F.get_json_object(F.lit(first[0]["value"]), "$.item_id").isNotNull()).first()[0]


ITEM_STRUCT = ("struct<title:string,description:string,item_type:string,final_value:double,"
               "category:string,brand:string,main_cat:string>")


def _item_columns(get) -> list:
    """The item fields in order; ``description_list`` has a list description as a list."""
    return [get("title").alias("title"), get("description").alias("description_raw"),
            F.from_json(get("description"), "array<string>").alias("description_list"),
            F.coalesce(get("item_type"), F.lit("O")).alias("item_type"),
            F.coalesce(get("final_value"), F.lit(0.0)).alias("final_value"),
            get("category").alias("category"), get("brand").alias("brand"), get("main_cat").alias("main_cat")]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A2: keyed item JSON -> rows in key order (``item_ord``) with all fields the feature presets
    name; ``item_type`` defaults to 'O' and ``final_value`` to 0.0."""
    r = _read_keyed_json(spark, path, ITEM_STRUCT)
    return r.select(F.col("key").alias("item_id"), F.col("ord").cast("bigint").alias("item_ord"), *_item_columns(lambda n: F.col(f"value.{n}")))


def read_sid_index(spark: SparkSession, path: str) -> DataFrame:
    """A3: SID index, keyed JSON ``{id: [tokens]}`` or JSON lines ``{item_id, tokens}`` (what
    ``write_sid_index`` writes, read by many tasks)."""
    if not _is_lines(spark, path):
        r = _read_keyed_json(spark, path, "array<string>")
        return r.select(F.col("key").alias("item_id"), F.col("ord").cast("bigint").alias("idx_ord"), F.col("value").alias("tokens"))
    from .ordinal import with_ordinal

    raw = spark.read.schema("item_id string, tokens array<string>").option("mode", "FAILFAST").json(path)
    raw = raw.withColumn("_f", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    return with_ordinal(raw, ["_f", "_id"], "idx_ord").select("item_id", "idx_ord", "tokens")


def parse_list_literal(col) -> F.Column:
    """Strict ``from_json`` first, then ``ast.literal_eval`` in Arrow batches
    for the rows JSON rejects (``\\x`` escapes, ``None``); never ``eval``."""
    c = F.col(col) if isinstance(col, str) else col
    js = F.from_json(c, "array<string>")
    return F.when(js.isNotNull(), js).otherwise(literal_list(F.when(js.isNull(), c)))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """A4: sequence CSV with list-literal columns; rows whose lists cannot be parsed
    keep NULL lists and are flagged in ``_bad`` (quarantine)."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    out = raw
    for c in ("history_item_title", "history_item_id", "history_item_sid"):
        if c in raw.columns:
            out = out.withColumn(c, parse_list_literal(c))
    if "history_item_id" in out.columns:
        out = out.withColumn("history_item_id", F.transform("history_item_id", lambda x: x.cast("bigint")))
    if "item_id" in out.columns:
        out = out.withColumn("item_id", F.col("item_id").cast("bigint"))
    lists = [c for c in ("history_item_title", "history_item_id", "history_item_sid") if c in out.columns]
    bad = F.lit(False)
    for c in lists:
        bad = bad | F.col(c).isNull()
    return out.withColumn("_bad", bad)


def npy_header(path: str):
    """Shape, dtype and data offset of a ``.npy`` file (reads only the header bytes)."""
    from numpy.lib import format as npf

    with open(path, "rb") as f:
        major, _ = npf.read_magic(f)
        if major == 1:
            shape, fortran, dtype = npf.read_array_header_1_0(f)
        else:
            shape, fortran, dtype = npf.read_array_header_2_0(f)
        if fortran:
            raise ValueError("Fortran-ordered .npy is not supported")
        return shape, dtype, f.tell()


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 65536) -> DataFrame:
    """A5: ``.npy`` matrix (N x d) -> ``(item_id, embedding)``, row position = item id.

    Only the header is read on the driver; the rows are split into ranges of
    ``rows_per_task`` and each task seeks to its range of the (shared) file and decodes
    it with numpy, so no task holds more than one range."""
    shape, dtype, offset = npy_header(path)
    n = int(shape[0])
    d = int(np.prod(shape[1:])) if len(shape) > 1 else 1
    row_bytes = d * dtype.itemsize
    n_tasks = max(1, -(-n // rows_per_task))
    starts = spark.range(0, n, rows_per_task, numPartitions=n_tasks).withColumnRenamed("id", "start")
    dt = dtype.str

    def decode(batches):
        for pdf in batches:
            for start in pdf["start"]:
                cnt = min(rows_per_task, n - int(start))
                with open(path, "rb") as f:
                    f.seek(offset + int(start) * row_bytes)
                    m = np.frombuffer(f.read(cnt * row_bytes), dtype=np.dtype(dt)).reshape(cnt, d)
                yield pd.DataFrame({"item_id": np.arange(int(start), int(start) + cnt, dtype=np.int64),
                                    "embedding": list(m.astype(np.float64))})

    return starts.mapInPandas(decode, "item_id long, embedding array<double>")


def read_items_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A2 for large catalogues: one JSON object per line ``{item_id, title, description, ...}``;
    splittable, so the catalogue is read by many tasks.  ``item_ord`` is the line ordinal."""
    from .ordinal import with_ordinal

    schema = ("item_id string, title string, description string, item_type string, final_value double, "
              "category string, brand string, main_cat string")
    raw = spark.read.schema(schema).json(path).withColumn("_f", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    o = with_ordinal(raw, ["_f", "_id"], "item_ord")
    return o.select("item_id", "item_ord", *_item_columns(F.col))


PREF_STRUCT = ("struct<user:string, user_preference:string, split:string, "
               "context:struct<history_items:array<bigint>, target_item:bigint>>")


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """Preference file as a JSON array; files that are not one JSON array are
    read as JSON lines (the reference's fallback)."""
    whole = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    # a single object parses as a one-element array, so the array form is told by its bracket
    is_arr = F.regexp_replace("value", r"^\s+", "").startswith("[")
    arr = whole.select("_f", F.when(is_arr, F.from_json("value", f"array<{PREF_STRUCT}>")).alias("_a"))
    from_arr = arr.filter(F.col("_a").isNotNull()).select(F.explode("_a").alias("r"))
    arr_files = arr.filter(F.col("_a").isNotNull()).select("_f")
    lines = spark.read.text(path).withColumn("_f", F.input_file_name()).join(arr_files, "_f", "left_anti")
    from_lines = lines.select(F.from_json("value", PREF_STRUCT).alias("r")).filter(F.col("r.user").isNotNull())
    return from_arr.unionByName(from_lines).select("r.*")


def read_predictions(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Prediction JSON array; ``output`` may be a string or a list (its first element), also mixed in one file."""
    from .ordinal import with_ordinal

    # mixed kinds are read as text, a list then as its JSON
    df = spark.read.schema("output string, predict array<string>").json(path, multiLine=True)
    as_list = F.when(F.ltrim("output").startswith("["), F.from_json("output", "array<string>"))
    d = df.withColumn("_f", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    d = with_ordinal(d, ["_f", "_id"], "row_id")
    out = F.when(F.size(as_list) > 0, F.try_element_at(as_list, F.lit(1))).otherwise(F.col("output"))
    return d.select(F.lit(run).alias("run"), "row_id", out.alias("output"), "predict")


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """Info lines ``sid \\t title \\t item_id``."""
    raw = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    from .ordinal import with_ordinal

    o = with_ordinal(raw, ["_id"], "info_ord")
    p = F.split("value", "\t")
    return o.select("info_ord", F.trim(p[0]).alias("sid"), p[1].alias("title"), F.trim(p[2]).alias("item_id"))


def read_user_features(spark: SparkSession, path: str | None) -> DataFrame:
    """``{user_id: token}`` map; a missing file gives an empty frame, a broken one is an error."""
    schema = "user_id string, u_token string"
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], schema)
    r = _read_keyed_json(spark, path, "string")
    return r.select(F.col("key").alias("user_id"), F.col("value").alias("u_token"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)  # resolves the path on whatever file system it names; reads nothing
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric JSON ``[{name, step?, ndcg: {k: v}, recall: {k: v}}, ...]`` -> long rows."""
    df = spark.read.json(path, multiLine=True)
    cols = df.columns
    step = F.col("step").cast("bigint") if "step" in cols else F.lit(None).cast("bigint")
    name = F.col("name") if "name" in cols else F.lit(None).cast("string")
    parts = []
    for metric, src in (("ndcg", "ndcg"), ("hr", "recall"), ("hr", "hr")):
        if src in cols:
            m = F.from_json(F.to_json(F.col(src)), "map<string,double>")
            parts.append(df.select(name.alias("run"), step.alias("step"), F.explode(m).alias("k", "value")).select(
                "run", "step", F.lit(metric).alias("metric"), F.col("k").cast("int").alias("k"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_split(paths: DataFrame, name: str, ext: str, path_col: str = "path", splits=("train", "valid", "test"),
                  fail: bool = False) -> DataFrame:
    """Exactly one file per split whose name holds the dataset name.

    A row for each of ``splits``; none or several files are reported in ``problem``, and with
    ``fail`` they are an error.
    """
    f = paths.filter(F.col(path_col).contains(name) & F.col(path_col).endswith(ext))
    split = F.regexp_extract(path_col, r"(train|valid|test)", 1)
    g = f.withColumn("split", split).groupBy("split").agg(F.count(F.lit(1)).alias("n_files"), F.min(path_col).alias("path"))
    wanted = paths.sparkSession.createDataFrame([(x,) for x in splits], "split string")
    out = wanted.join(g, "split", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    out = out.withColumn("problem", F.when(F.col("n_files") != 1, F.lit("expected exactly one file")))
    if fail and (wrong := [r["split"] for r in out.filter("problem is not null").collect()]):
        raise FileNotFoundError(f"expected exactly one file for: {', '.join(sorted(wrong))}")
    return out


def write_sequences(df: DataFrame, path: str) -> None:
    """Sequences as parquet partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_sid_index(df: DataFrame, path: str) -> None:
    """SID index as JSON lines (one ``{item_id, tokens}`` per line)."""
    df.select("item_id", "tokens").write.mode("overwrite").json(path)


def write_codes(df: DataFrame, path: str) -> None:
    """Raw codes."""
    df.select("item_id", "codes").write.mode("overwrite").parquet(path)


def write_codebook(df: DataFrame, path: str) -> None:
    """Codebooks (level, code, vector)."""
    df.select("level", "code", "vector").write.mode("overwrite").parquet(path)


def write_info(df: DataFrame, path: str) -> None:
    """Info lines as text."""
    df.select("line").write.mode("overwrite").text(path)


def write_metric_log(df: DataFrame, path: str) -> None:
    """Append metric-log rows ``(stage, tag, step, value)`` partitioned by stage;
    non-numeric values are dropped first (``operators.reports.metric_log_rows``)."""
    df.select("stage", "tag", "step", "value").write.mode("append").partitionBy("stage").parquet(path)


def write_sequences_csv(df: DataFrame, path: str) -> None:
    """A14, CSV form: list columns written as JSON text (readable back by ``read_sequences``)."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_sid_index_object(df: DataFrame, path: str, max_items: int = 1_000_000) -> None:
    """A15, single-object form ``{item_id: [tokens]}`` for small catalogues only: the
    whole index becomes one row, so its size is checked first (use ``write_sid_index``
    for large catalogues)."""
    n = df.count()
    if n > max_items:
        raise ValueError(f"{n} items: too many for a single JSON object; write JSON lines instead")
    obj = df.select(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("item_id").cast("string"), "tokens")))).alias("m"))
    obj.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)
