"""Filter interaction audit: what each of five filters removes, alone and after others, kept up to date by a stream with retractions.

Filters, as bits of a document's mask, over whole texts (null: empty; words are maximal runs without white space, case-sensitive):

    A  under `min_words` words                          D  holds any of `#$%&*|`
    B  distinct words under 80 % of the words           E  equal to the text of any document of smaller id
    C  capitals A-Z over 10 % of the code points

All files are read as micro-batches of a stream that ends when none is left. A to D are built-in expressions. For E, a state holds for each text
(by SHA-256) the smallest id seen, with the parts and counts of the rows that bear it; texts are dealt to states by hash, a bounded number to each. A row of larger id counts at once with E set. When a
smaller id arrives, the rows counted so far for the old one are retracted, counted again with E set, and the new id takes the state. Every
micro-batch adds its signed counts per (part, mask, labels) to a folder named by the batch, so a repeated batch replaces itself. The counts
sum to the exact result in whatever order the files come.

Rows of one text are combined within a task before they are shuffled, so a text that a third of all rows share sends a few rows per task.
Orders and steps are worked out on the summed counts, at most 32 masks by four label classes per part.

Defined results: rows of equal id and text are no copies of each other; a null id is neither smaller nor larger than another, so such rows
never fail E nor make others fail; a null part is the empty string; repeated labels of an id count as one, set if any of them is; an empty
table gives no rows. Only the named columns are read."""

from __future__ import annotations

import itertools

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.llm.folders import new_folder, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COPY = 16  # the bit of E
GOOD, TOXIC = 32, 64  # label bits beside the mask
MIN_WORDS = 100
BATCHES = 6  # micro-batches that a stored table is read in, where it has as many files
GROUP_TEXTS = 5_000  # texts whose smallest ids share one state
COUNTED = "part string, code int, n long"
ROWS = pa.schema([("text", pa.binary()), ("doc", pa.int64()), ("part", pa.string()), ("code", pa.int32()), ("n", pa.int64())])


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = MIN_WORDS) -> DataFrame:
    """(text, doc, part, code): the digest of each text, and its failures of A to D with the label bits. Built-in functions only."""
    given = labels.groupBy(F.col(id_col).cast("long").alias("doc")).agg(
        (F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("given"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    n = F.size("w")
    capitals = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < min_words, 100 * F.size(F.array_distinct("w")) < 80 * n, 100 * capitals > 10 * F.length("t"), F.col("t").rlike(r"[#$%&*|]")]
    code = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = rows.select("doc", "part", F.unhex(F.sha2("t", 256)).alias("text"), code.alias("code"))
    return rows.join(given, "doc", "left").select("text", "doc", "part", (F.col("code") + F.coalesce("given", F.lit(0))).cast("int").alias("code"))


def _low(table: pa.Table) -> pa.ChunkedArray:
    """The smallest id of each row's text."""
    low = table.group_by("text").aggregate([("doc", "min")])
    return low["doc_min"].take(pc.index_in(table["text"], low["text"]))


def _summed(table: pa.Table, keys: list[str]) -> pa.Table:
    return table.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _as_copies(code) -> pa.ChunkedArray:
    return pc.bit_wise_or(code, pa.scalar(COPY, pa.int32()))


def _combine(batches):
    """Counts the rows of a batch by (text, doc, part, code). Rows that a smaller id of their text outdoes within the batch are copies for
    certain; they lose their id, as rows without an id do, and need no state."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        copy = pc.fill_null(pc.greater(table["doc"], _low(table)), False)
        table = pa.table({"text": table["text"], "doc": pc.if_else(copy, pa.scalar(None, pa.int64()), table["doc"]), "part": table["part"],
                          "code": pc.if_else(copy, _as_copies(table["code"]), table["code"]), "n": pa.repeat(pa.scalar(1, pa.int64()), len(table))})
        yield from _summed(table, ["text", "doc", "part", "code"]).combine_chunks().to_batches()


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def merge(held: pa.Table, new: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(held rows, signed counts) after new rows: of each text, the rows of the smallest id are held; held rows that a smaller id outdoes are
    retracted and counted again as copies."""
    final = new.filter(pc.is_null(new["doc"]))
    new = new.filter(pc.is_valid(new["doc"]))
    both = pa.concat_tables([held, new])
    first = pc.equal(both["doc"], _low(both))
    was, now = first.slice(0, len(held)), first.slice(len(held))
    lost = held.filter(pc.invert(was))
    late = new.filter(pc.invert(now))
    parts = [final, new.filter(now), lost.set_column(4, "n", pc.negate(lost["n"]))]
    parts += [x.set_column(3, "code", _as_copies(x["code"])) for x in (lost, late)]
    keep = _summed(pa.concat_tables([held.filter(was), new.filter(now)]), ["text", "doc", "part", "code"])
    return keep, _summed(pa.concat_tables(parts), ["part", "code"])


def _follow(key, frames, state: GroupState):
    """Signed counts for the new rows of one group of texts."""
    new = pa.Table.from_pandas(pd.concat(list(frames))[["text", "doc", "part", "code", "n", "known"]], preserve_index=False)
    doc = pc.if_else(new["known"], new["doc"].cast(pa.int64()), pa.scalar(None, pa.int64()))
    new = new.set_column(1, "doc", doc).drop_columns("known").cast(ROWS)
    held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else ROWS.empty_table()
    keep, signed = merge(held, new)
    if not keep.equals(held):
        state.update((_packed(keep),))
    yield signed.to_pandas()


def counts(rows: DataFrame, groups: int, folder: str) -> DataFrame:
    """(part, code, n): runs the stream of `masks` rows to its end and sums its signed counts. Texts are dealt to `groups` states by hash.
    `folder` keeps the checkpoint and the counts; a query started again with it goes on behind the last finished micro-batch."""
    spark = rows.sparkSession
    spark.createDataFrame([], COUNTED).write.mode("overwrite").parquet(f"{folder}/counts/batch=-1")
    few = rows.mapInArrow(_combine, "text binary, doc long, part string, code int, n long")
    # a column with nulls would reach pandas as floating point
    few = few.select(F.expr(f"pmod(xxhash64(text), {groups})").alias("group"), "text", F.coalesce("doc", F.lit(0)).alias("doc"), "part", "code", "n", F.isnotnull("doc").alias("known"))
    signed = few.groupBy("group").applyInPandasWithState(_follow, COUNTED, "held binary", "append", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "code").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    run = signed.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(COUNTED).parquet(f"{folder}/counts").groupBy("part", "code").agg(F.sum("n").alias("n")).filter("n <> 0")


def report(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from summed counts."""
    rows = counted.select("part", F.col("code").bitwiseAND(31).alias("m"), "n", (F.col("code").bitwiseAND(GOOD) != 0).alias("good"), (F.col("code").bitwiseAND(TOXIC) != 0).alias("toxic"))
    rows = rows.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)")).withColumn(
        "before", F.expr("aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (a, c) -> a | shiftleft(1, ascii(c) - 65))"))
    fails, earlier = F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("m").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier

    def total(when, n=F.col("n")):
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(here).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("m") == F.col("bit")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
        # among the orders, each failing filter of a document comes first equally often
        total(fails, F.expr("n * (120 div bit_count(m))")).alias("shapley"))


def read_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """A stored Parquet table as a stream of about `batches` micro-batches of whole files. A stream reads folders, so a table of one file is
    the only match in its folder."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].rpartition("/")[2] == name:
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def audit(stream: DataFrame, labels: DataFrame, groups: int = 200, folder: str | None = None, **columns) -> DataFrame:
    """The report over a whole stream of documents."""
    folder = folder or new_folder(stream.sparkSession, "filter-audit")
    return report(stored(counts(masks(stream, labels, **columns), groups, folder), "filter-counts"))


def audit_table(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, **columns) -> DataFrame:
    """The report over a stored table, with as many states as keep each below about GROUP_TEXTS texts."""
    texts = spark.read.parquet(path).count()
    return audit(read_stream(spark, path, batches), labels, max(1, -(-texts // GROUP_TEXTS)), **columns)
