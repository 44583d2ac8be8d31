"""What the operators share: the shared folder, written tables, distinct contents and digests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import drop, new_path, shared_dir, written

__all__ = ["drop", "new_path", "shared_dir", "written"]

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Place of a public tokenizer's file; a parameter of every operator that uses one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let Spark hand texts and sets to Python in batches of at most `rows`, and of not much more than `size` bytes: they lie outside
    the heap, several at a time, and a thousand long ones are up to 64 MB by Spark's own setting."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column's name that df does not have yet."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def distinct_contents(df: DataFrame, key: str, seen: DataFrame | None) -> DataFrame:
    """One row (key, text) for each distinct `key` of df(id, key, text) that is not in seen(key).

    The digests alone are pre-aggregated and shuffled to choose one carrier a key, however many copies a key
    has; then the text of each row meets its carrier by (key, id), which no group of copies makes hot.
    """
    carriers = df.groupBy(key).agg(F.min("id").alias("id"))
    if seen is not None:
        carriers = carriers.join(seen.select(key), key, "left_anti")
    rows, carriers = df.select("id", key, "text").alias("r"), carriers.alias("c")
    return rows.join(carriers, F.col("r.id").eqNullSafe(F.col("c.id")) & (F.col(f"r.{key}") == F.col(f"c.{key}"))).select(f"r.{key}", "r.text")


#: Words of 64 marks in a table of marks: what is sent to all tasks, whatever the number of ids.
MARK_WORDS = 1 << 20


def marked(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be in ids(key), and those whose key certainly is not (null keys too).

    Each id sets one of 64 MARK_WORDS marks, which a hash names. The words that have a mark, MARK_WORDS of two numbers at
    most, go to the rows, and are the only thing that does. The more ids there are, the more other rows may be in them.
    """
    word, bit = free_name(df, "__word"), free_name(df, "__bit")
    place = lambda c: F.xxhash64(c.cast("long"))
    number, mark = (lambda c: F.pmod(place(c), F.lit(MARK_WORDS))), (lambda c: F.shiftright(place(c), 58).bitwiseAND(63).cast("int"))
    words = ids.where(F.col(key).isNotNull()).select(number(F.col(key)).alias(word), mark(F.col(key)).alias(bit)).groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))).alias(bit))
    rows = df.withColumn(word, number(F.col(key))).join(F.broadcast(words), word, "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col(bit), mark(F.col(key))).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & F.col(key).isNotNull()
    return rows.where(maybe).select(df.columns), rows.where(~maybe).select(df.columns)


def of_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ids(key), a written table of distinct ids. Only rows whose marks say that they may be are shuffled,
    and they are at every size: Spark would send few ids to them, so that what is measured on little would not hold for much."""
    return marked(df, ids, key)[0].join(ids.hint("merge"), key, "left_semi").select(df.columns)


def not_of_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is null or not in ids(key), a written table of distinct ids; shuffled as in of_ids()."""
    maybe, others = marked(df, ids, key)
    return others.unionByName(maybe.join(ids.hint("merge"), key, "left_anti").select(df.columns))


def joined_back(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows(key, ...) with the columns of found(key, ...), nulls where it has none; one row a row.

    Each batch's rows of one key travel together, as one row with lists, and are taken apart after the join: a key
    that a third of all rows hold comes to its task as a row a batch, not as a row a row.
    """
    others = [f for f in rows.schema if f.name != key]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = pa.Table.from_batches([batch]).group_by(key, use_threads=False).aggregate([(f.name, "list") for f in others])
                yield from own.select([key, *(f"{f.name}_list" for f in others)]).rename_columns([key, *(f.name for f in others)]).combine_chunks().to_batches()

    schema = ", ".join([f"`{key}` {rows.schema[key].dataType.simpleString()}", *(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in others)])
    joined = rows.mapInArrow(gathered, schema).join(found, key, "left")
    rest = [c for c in joined.columns if c not in [f.name for f in others]]
    return joined.select(*rest, F.explode(F.arrays_zip(*[F.col(f.name) for f in others])).alias("__row")).select(*[F.col(f"__row.{f.name}").alias(f.name) for f in others], *rest)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, which bound what a worker holds as Python objects; an empty batch as it is."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def crc_fold(doc_id: int, folds: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
