"""Token ids of documents as fixed-stride records in training order.

A keyed permutation of 0 .. N-1 gives every sequence its slot, so the order of training is fixed by (corpus, key) and
needs no sort of random numbers; shards hold consecutive slots, and record k of a shard starts at byte k * stride.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailspark.llm.tables import read, removed, shared_path, shuffles_removed
from mailspark.llm.words import mixed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary wants texts split before pairs are merged (a fixed value of that vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
LENGTH = 1024
SHARD = 8192
#: Shards are written in portions, of so many shards at least and so many portions at most: what is shuffled at a time
#: is a portion, and a portion's stored runs go as its shards are there.
PORTION_SHARDS, PORTIONS = 8, 8
KEY = 0x5EED
#: Documents of one bucket are numbered in one task.
BUCKET_DOCS = 1 << 18
#: Texts are encoded in pieces of about this many characters, cut before a blank that a non-blank follows.
PIECE = 1 << 20
BLANKS = 1 << 14
#: What stands behind the ids of a record: the document it is of, which of its runs it is, and its ids before padding
#: (NO_ID more if the document has no id).
OF = np.dtype([("doc_id", ">i8"), ("seq", ">u4"), ("n_tokens", ">u4")])
NO_ID = 1 << 31
_LONG_BLANKS = re.compile(rf"(\s{{{BLANKS + 1},}})")


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("records", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    """Parts of a long text that encode as the whole does: cuts lie before a blank with letters on both sides. A run
    of white space that is too long for the split pattern is cut every BLANKS characters."""
    if _LONG_BLANKS.search(text):
        for part in _LONG_BLANKS.split(text):
            for k in range(0, len(part), BLANKS) if part.isspace() else ():
                yield part[k:k + BLANKS]
            if part and not part.isspace():
                yield from _pieces(part)
        return
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while cut > 0 and not (text[cut - 1].isalnum() and text[cut + 1:cut + 2].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def encode(text: str, encoder) -> np.ndarray:
    parts = [encoder.encode_to_numpy(p, disallowed_special=()).astype(np.uint16) for p in _pieces(text)]
    return np.append(np.concatenate(parts), np.uint16(END_OF_TEXT))


class Permutation:
    """A keyed bijection of 0 .. n-1: a Feistel network over the next even number of bits; values at n or above walk
    on along their cycle until they are below n (fewer than four steps are expected)."""

    ROUNDS = 6

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mixed(np.arange(1, self.ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mixed(right ^ key) & self.mask)
        return left << self.half | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self._once(x.astype(np.uint64))
        far = np.flatnonzero(out >= self.n)
        while len(far):
            out[far] = self._once(out[far])
            far = far[out[far] >= self.n]
        return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """bucket, pos, doc_id, seq, n_tokens, tokens: the texts of ``docs`` (doc_id, text) in runs of ``length`` ids.

    Ids are little-endian 16-bit numbers. A text's last run holds the end-of-text id and may be shorter. Buckets are
    hash classes of ids, in the order of (doc_id, text) inside; pos counts a bucket's runs. Null and empty texts
    have no runs; rows that repeat a doc_id have their own, as has a null doc_id.
    """
    buckets = max(256, docs.count() // BUCKET_DOCS)
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bucket, pos = _encoder(shared.value), None, 0
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                out: list[list] = [[], [], [], [], [], []]
                for b, doc_id, text in zip(*(part[c].to_pylist() for c in ("bucket", "doc_id", "text"))):
                    if b != bucket:
                        bucket, pos = b, 0
                    ids = encode(text, encoder)
                    for seq, k in enumerate(range(0, len(ids), length)):
                        piece = ids[k:k + length]
                        for column, value in zip(out, (bucket, pos, doc_id, seq, len(piece), piece.astype("<u2").tobytes())):
                            column.append(value)
                        pos += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    names = ["bucket", "pos", "doc_id", "seq", "n_tokens", "tokens"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    texts = docs.where("text IS NOT NULL AND text <> ''").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long"), "text")
    ordered = texts.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text")
    return ordered.mapInArrow(run, "bucket int, pos long, doc_id long, seq int, n_tokens int, tokens binary")


def placed(docs: DataFrame, key: int = KEY, vocabulary: str = VOCABULARY, length: int = LENGTH,
           shard: int = SHARD) -> DataFrame:
    """slot, shard, byte_offset, doc_id, seq, n_tokens, tokens of every sequence in no order.

    A sequence's number is its bucket's start plus its place there, so it does not depend on how Spark cuts the
    table; its slot is the keyed permutation of that number. The starts are one number per bucket, and a bucket is
    256th of the corpus or BUCKET_DOCS documents.
    """
    return _numbered(docs, key, vocabulary, length, shard)[0]


def _numbered(docs: DataFrame, key: int, vocabulary: str, length: int, shard: int) -> tuple[DataFrame, str, int]:
    """The rows of placed(), the path of the stored runs they are read from, and how many there are."""
    spark = docs.sparkSession
    path = shared_path(spark, "sequences")
    with shuffles_removed(spark):
        sequences(docs, vocabulary, length).write.option("compression", "zstd").parquet(path)
    runs = spark.read.schema("bucket int, pos long, doc_id long, seq int, n_tokens int, tokens binary").parquet(path)
    sizes = dict(runs.groupBy("bucket").count().collect())
    starts = np.zeros(max(sizes, default=0) + 1, np.int64)
    for bucket, n in sizes.items():
        starts[bucket] = n
    total = int(starts.sum())
    starts = spark.sparkContext.broadcast(np.cumsum(starts) - starts)

    carried = ["doc_id", "seq", "n_tokens", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(total, key)
        for batch in batches:
            slot = permute(starts.value[batch["bucket"].to_numpy()] + batch["pos"].to_numpy())
            yield pa.record_batch([
                pa.array(slot), pa.array(slot // shard), pa.array(slot % shard * stride(length)),
                *(batch[c] for c in carried)], names=["slot", "shard", "byte_offset", *carried])

    return runs.mapInArrow(
        run, "slot long, shard long, byte_offset long, doc_id long, seq int, n_tokens int, tokens binary"), path, total


def in_training_order(docs: DataFrame, key: int = KEY, vocabulary: str = VOCABULARY, length: int = LENGTH,
                      shard: int = SHARD) -> DataFrame:
    """The sequences of placed(); a shard lies in one partition, in the order of slots."""
    return placed(docs, key, vocabulary, length, shard).repartition("shard").sortWithinPartitions("shard", "slot")


def written(docs: DataFrame, path: str | None = None, key: int = KEY, vocabulary: str = VOCABULARY, length: int = LENGTH,
            shard: int = SHARD) -> DataFrame:
    """Writes the shards of ``docs`` to ``path`` (a fresh one below the shared folder if not given) and returns slot,
    shard, byte_offset, doc_id, seq, n_tokens, tokens of all records as read back from them.

    Everything comes from the shards alone: a record says whose it is, and where it lies is told by its slot. tokens
    are the record's ids without its padding.

    Slots are known when all texts are encoded. The runs are then dealt out by portions of the shards, and each
    portion is shuffled, written and removed before the next one.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    runs, encoded, total = _numbered(docs, key, vocabulary, length, shard)
    shards = -(-total // shard)
    portions = max(1, min(PORTIONS, shards // PORTION_SHARDS))
    if portions == 1:
        write_shards(runs, path, length)
        removed(spark, encoded)
    else:
        dealt = shared_path(spark, "portions")
        runs.drop("byte_offset").withColumn("portion", F.expr(f"cast(shard * {portions} div {shards} as int)")).write.option(
            "compression", "zstd").partitionBy("portion").parquet(dealt)
        removed(spark, encoded)
        for k in range(portions):
            rows = spark.read.schema(runs.drop("byte_offset").schema).parquet(f"{dealt}/portion={k}")
            write_shards(rows, path, length, "append" if k else "errorifexists")
            removed(spark, f"{dealt}/portion={k}")
    slot = F.col("slot")
    return _records(spark, path, 0, length, shard).select(
        "slot", F.expr(f"slot div {shard}").alias("shard"), (slot % shard * stride(length)).alias("byte_offset"),
        "doc_id", "seq", "n_tokens", F.expr("substring(record, 1, 2 * n_tokens)").alias("tokens"))


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: ``length`` ids of two bytes, padded with the end-of-text id, what it is of, and a line feed."""
    return 2 * length + OF.itemsize + 1


def write_shards(records: DataFrame, path: str, length: int = LENGTH, mode: str = "errorifexists") -> None:
    """One folder shard=k for each shard, with one file of records in slot order, through Spark's own committer.

    ``records`` (slot, shard, doc_id, seq, n_tokens, tokens) may come in any order and partitioning: a range of shards
    goes to one task, which sorts them by slot and writes each to one file; whole shards may be appended. Behind its ids a record holds OF.
    """
    ordered = records.select("slot", "shard", "doc_id", "seq", "n_tokens", "tokens").repartitionByRange(
        "shard").sortWithinPartitions("shard", "slot")
    numbers = [(F.coalesce("doc_id", F.lit(0)), 16), (F.col("seq"), 8),
               (F.when(F.col("doc_id").isNull(), F.lit(NO_ID)).otherwise(F.lit(0)) + F.col("n_tokens"), 8)]
    filled = F.concat(F.rpad("tokens", 2 * length, F.lit(END_OF_TEXT.to_bytes(2, "little"))),
                      *(F.unhex(F.lpad(F.hex(number), digits, "0")) for number, digits in numbers))
    lines = ordered.select("shard", filled.cast("string").alias("value"))
    with shuffles_removed(records.sparkSession):
        lines.write.mode(mode).partitionBy("shard").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)


def _records(spark: SparkSession, path: str, slot: int, length: int, shard: int) -> DataFrame:
    """slot, doc_id, seq, n_tokens, record (bytes of all its ids) from ``slot`` on. A shard in more than one file is an
    error, as its slots could not be told, and so is a file that ends inside a record.

    Spark cuts the records out of a file's bytes itself, so that a shard is never handed to Python as one value.
    """
    size = stride(length)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        path).withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("long"))
    files = files.where((F.col("shard") >= slot // shard) & F.col("path").rlike(r"/part-[^/]*$"))
    cut = files.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("length") % size).alias("rest"))
    cut = cut.where("n > 1 OR rest > 0").agg(F.min("shard")).first()[0]
    if cut is not None:
        raise ValueError(f"shard {cut} below {path} lies in more than one file or ends inside a record")

    def number(at: int, digits: int) -> Column:
        part = F.substring("content", F.col("at") * size + (at + 1), F.lit(digits))
        return F.conv(F.hex(part), 16, -10).cast("long")

    found = files.where("length > 0").select("shard", "content", F.explode(F.sequence(F.lit(0), (F.col("length") / size).cast("int") - 1)).alias("at"))
    found = found.where(F.col("shard") * shard + F.col("at") >= slot)
    given = number(2 * length + 12, 4)
    return found.select(
        (F.col("shard") * shard + F.col("at")).alias("slot"),
        F.when(given < NO_ID, number(2 * length, 8)).alias("doc_id"), number(2 * length + 8, 4).cast("int").alias("seq"),
        (given % NO_ID).cast("int").alias("n_tokens"),
        F.substring("content", F.col("at") * size + 1, F.lit(2 * length)).alias("record"))


def read_shards(spark: SparkSession, path: str, slot: int = 0, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """slot, ids of all records from ``slot`` on; shards before it are not opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["record"].to_pylist()), "<u2").astype(np.int32)
            at = np.arange(0, len(batch) * length + 1, length, dtype=np.int32)
            yield pa.record_batch([batch["slot"], pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=["slot", "ids"])

    return _records(spark, path, slot, length, shard).mapInArrow(run, "slot long, ids array<int>")


def op2_training_records(spark: SparkSession, folder: str) -> DataFrame:
    return written(read(spark, folder, "documents").select("doc_id", "text"))
