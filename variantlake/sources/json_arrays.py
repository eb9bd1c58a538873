"""Large JSON files, one array of records each, read by many tasks.

A file is split like any text, with ``}`` as the line separator, so a *piece* is what lies
before a closing brace.  Whether a brace closes anything depends on all that stands before
it: an odd number of quotes puts it into a string, and the brackets give its depth.  Both
are prefix sums, taken in parallel:

1. within each block of a file a window sums quotes and brackets, the brackets twice: as if
   the block began outside and as if it began inside a string;
2. one row a block is summed up over the file, which settles how each block begins;
3. a piece that closes a brace at the depth of the records ends a record, and the pieces
   between two ends are put together again.

Native expressions only.  A block (``spark.sql.files.maxPartitionBytes``) is a task's work;
a record is one row.  The pieces are written once in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variantlake.session import scratch_path

_BLANK = r"[\x20\x09\x0A\x0D]*"


def _times(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _net(text: Column, inside) -> Column:
    """Brackets opened minus closed in ``text``, which begins inside a string or not."""
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), text), r'"[^"]*("|$)', "")
    return _times(outside, "{[") - _times(outside, "]")


def _pieces(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "}").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    bare = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    marks = raw.withColumn("bare", bare).withColumn("quotes", _times(F.col("bare"), '"'))
    so_far = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    odd = marks.withColumn("after", F.sum("quotes").over(so_far) % 2 == 1).withColumn("before", (F.col("quotes") % 2 == 1) != F.col("after"))
    # the state before and after each piece if the block begins outside a string; the other way round if inside
    net = odd.withColumns({"net_out": _net(F.col("bare"), F.col("before")) - F.when(F.col("after"), 0).otherwise(1),
                           "net_in": _net(F.col("bare"), ~F.col("before")) - F.when(F.col("after"), 1).otherwise(0)})
    return net.select("file", "file_size", "block", "at", "value", "quotes", "after", "net_out", "net_in",
                      F.sum("net_out").over(so_far).alias("sum_out"), F.sum("net_in").over(so_far).alias("sum_in"))


def _block_starts(pieces: DataFrame) -> DataFrame:
    """One row a block: the state it begins in, and what the whole file says."""
    blocks = pieces.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.sum("net_out").alias("net_out"), F.sum("net_in").alias("net_in"), F.max("at").alias("last_at"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("file_size").alias("file_size"),
        F.min_by(F.substring(F.regexp_replace("value", rf"^\x{{FEFF}}?{_BLANK}", ""), 1, 1), "at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begun = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    net = F.when(F.col("inside"), F.col("net_in")).otherwise(F.col("net_out"))
    # every piece but the last is known to end in a brace; the bytes tell for the last (3: a byte order mark)
    closed = (F.max("file_size").over(whole) - F.sum("bytes").over(whole)) % 3 == 0
    return begun.select(
        F.col("file").alias("b_file"), F.col("block").alias("b_block"), "inside", F.coalesce(F.sum(net).over(earlier), F.lit(0)).alias("depth"),
        (F.first("first").over(whole) == "[").alias("array"), F.when(F.col("block") == F.max("block").over(whole), F.col("last_at")).alias("last_at"), closed.alias("closed"))


def json_array_records(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, broken files) of files that hold an array of JSON objects, or objects one
    after another: ``file, record, value`` with the position and the text of each object, and
    ``file, value`` with the text where a file's structure is broken.

    A file is broken when brackets or quotes do not close, or when anything but objects
    stands between its records; it then has no records.  Empty files and ``[]`` have none
    either and are not broken.  What is wrong inside an object shows when it is parsed.
    """
    target = scratch_path(spark, "json_pieces")
    found = _pieces(spark, path, glob)
    found.write.parquet(target)
    pieces = spark.read.schema(found.schema).parquet(target)
    starts = _block_starts(pieces)
    state = pieces.join(starts, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    braced = (F.col("at") != F.coalesce(F.col("last_at"), F.lit(-1))) | F.col("closed")
    outside = F.col("after") == F.col("inside")
    depth = F.col("depth") + F.when(F.col("inside"), F.col("sum_in")).otherwise(F.col("sum_out"))
    state = state.select("file", "block", "at", "array", (braced & outside & (depth == F.col("array").cast("int"))).alias("ends"),
                         F.when(braced, F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("value"))
    # the records that ended before: in earlier blocks, and before in this one
    ended = state.groupBy("file", "block").agg(F.count_if("ends").alias("n")).select(
        F.col("file").alias("e_file"), F.col("block").alias("e_block"),
        F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    here = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = state.withColumn("here", F.coalesce(F.sum(F.col("ends").cast("long")).over(here), F.lit(0))).join(
        ended, (F.col("file") == F.col("e_file")) & (F.col("block") == F.col("e_block")))
    parts = numbered.groupBy("file", (F.col("earlier") + F.col("here")).alias("record")).agg(
        F.max("ends").alias("ends"), F.first("array").alias("array"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"]), "").alias("text"))
    first = F.col("record") == 0
    lead = F.when(F.col("array") & first, r"\[").when(F.col("array"), ",").otherwise("")
    tail = F.when(F.col("array") & first, rf"\[{_BLANK}\]").when(F.col("array"), r"\]").otherwise("")
    text = F.regexp_replace("text", r"^\x{FEFF}", "")
    # the lead is tested on the text before the first brace, which alone can be wrong
    sound = F.when(F.col("ends"), F.regexp_like(F.concat(F.substring_index(text, "{", 1), F.lit("{")), F.concat(F.lit(rf"^{_BLANK}"), lead, F.lit(rf"{_BLANK}\{{$")))).otherwise(
        F.regexp_like(text, F.concat(F.lit(rf"^{_BLANK}"), tail, F.lit(rf"{_BLANK}$"))))
    parts = parts.select("file", "record", "ends", "array", sound.alias("sound"), F.when(F.col("ends"), F.substr(text, F.locate("{", text))).otherwise(text).alias("value"))
    unclosed = parts.groupBy("file").agg(F.bool_and("sound").alias("sound"), F.bool_and("ends").alias("no_tail"), F.first("array").alias("array"),
                                         F.min_by("value", "record").alias("value"))
    broken = unclosed.where(~F.col("sound") | (F.col("array") & F.col("no_tail"))).select("file", "value")
    names = broken.select(F.col("file").alias("x_file"))
    records = parts.where("ends").join(names, F.col("file") == F.col("x_file"), "left_anti").select("file", "record", "value")
    return records, broken
