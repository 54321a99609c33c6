"""Payloads as media in content-defined chunks.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, are the payload: 8-bit samples in rows of
576. A rolling gear hash cuts the payload into chunks; a chunk is kept as a zstandard frame. The stored form of a
medium is its ordered chunk list, each entry the chunk's 16-byte digest, its length and its frame; media_bytes and
media_sha256 are of that form.

Store, all Parquet, below one folder:
  lists     one row per document: doc_id, n_bytes, media_key (16-byte BLAKE2b of the payload), digests and lens in order
  staged    kind=solo: media used by one document that share no chunk, frames inline: final as written in one pass, not
            shuffled. kind=shared: the rest, input of the next step
  media     of the rest, one row per distinct payload, frames inline but for the chunks that are used more than once
  pool      those chunks, once per digest
Which chunks are used more than once comes from joins of digests, never of payloads. A fixed-size bitmap of the keys
concerned lets the second pass over the texts tell the two kinds apart: a false hit only takes the longer way, so a
full bitmap costs a shuffle and no result. Copies are made distinct in each task before they are shuffled.

Defined results: a null or empty text is one row of 576 bytes 255; rows that repeat a doc_id are separate; equal texts
have equal values; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, gear_candidates, mix64, prepare, scratch, texts

ROW = 576
SHORTEST, MASK_BITS, LONGEST = 2048, 12, 16384
LEVEL = 6
#: Bits of the key bitmap: 2 MB, whatever the input; a key sets one bit.
BITMAP_BITS = 1 << 24
_WORD = 32768

_GEARS = (mix64(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % ROW if raw else ROW), len(raw)


def chunk_lists(texts_: list[str]) -> Iterator[tuple[bytes, int, bytes, list[tuple[int, int]], list[bytes]]]:
    """(payload, unpadded bytes, media key, chunk bounds, digests) of each text; the hash runs over the batch at once."""
    pays = [payload(t) for t in texts_]
    whole = np.frombuffer(b"".join(p for p, _ in pays), np.uint8)
    cuts = gear_candidates(_GEARS[whole], MASK_BITS) if len(whole) else np.array([], dtype=np.int64)
    start = 0
    for pay, n in pays:
        a, bounds = start, []
        for b in cut(cuts, start, start + len(pay), SHORTEST, LONGEST):
            bounds.append((a - start, b - start))
            a = b
        start += len(pay)
        yield pay, n, hashlib.blake2b(pay, digest_size=16).digest(), bounds, [hashlib.blake2b(pay[x:y], digest_size=16).digest() for x, y in bounds]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, key, digests, [y - x for x, y in bounds]) for _, n, key, bounds, digests in chunk_lists(batch.column(1).to_pylist())]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "media_key", "digests", "lens"])


def bit_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "big") & (BITMAP_BITS - 1)


def _stage(bitmap: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, seen = zstandard.ZstdCompressor(level=LEVEL), set()
        for batch in batches:
            out: list[tuple] = []
            for pay, _, key, bounds, digests in chunk_lists(batch.column(0).to_pylist()):
                bit = bit_of(key)
                kind = "shared" if bitmap[bit >> 3] >> (bit & 7) & 1 else "solo"
                if kind == "shared":
                    if key in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(key)
                out.append((kind, key, digests, [y - x for x, y in bounds], [comp.compress(pay[x:y]) for x, y in bounds]))
            cols = list(zip(*out, strict=True)) or [(), (), (), (), ()]
            types = (pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "media_key", "digests", "lens", "frames"])

    return run


def _bitmap(keys: DataFrame) -> bytes:
    """The fixed-size bitmap of keys, built by Spark's bitmap aggregates in words of 4 KB."""
    bit = F.conv(F.hex(F.substring("media_key", 1, 8)), 16, 10).cast("decimal(20,0)") % BITMAP_BITS
    words = keys.select(bit.cast("long").alias("bit")).groupBy(F.floor(F.col("bit") / _WORD).alias("word")).agg(F.bitmap_construct_agg(F.col("bit") % _WORD).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for row in words.collect():  # BITMAP_BITS / 32768 rows at most
        out[row["word"] * _WORD // 8 : (row["word"] + 1) * _WORD // 8] = row["bits"]
    return bytes(out)


_MEDIA = "media_key binary, digests array<binary>, lens array<int>, frames array<binary>"


def write_media(docs: DataFrame, root: str) -> str:
    """Store the payloads of every whole text of docs below root."""
    spark = prepare(docs.sparkSession)
    rows = texts(docs)
    rows.mapInArrow(_list, "doc_id long, n_bytes long, media_key binary, digests array<binary>, lens array<int>").write.parquet(f"{root}/lists")
    lists = spark.read.parquet(f"{root}/lists")
    media = lists.groupBy("media_key").agg(F.count("*").alias("copies"), F.first("digests").alias("digests"))
    refs = media.select("media_key", F.posexplode("digests").alias("seq", "digest"))
    uses = refs.groupBy("digest").agg(F.count("*").alias("uses"), F.min(F.struct("media_key", "seq")).alias("owner")).filter("uses > 1").drop("uses")
    owned = refs.join(uses, "digest").select("media_key", "seq", (F.struct("media_key", "seq") == F.col("owner")).alias("owns"))
    plan = owned.groupBy("media_key").agg(
        F.collect_list("seq").alias("dropped"), F.collect_list(F.when(F.col("owns"), F.col("seq"))).alias("exported")
    )  # bounded by one payload's chunks
    plan.write.parquet(f"{root}/plan")
    plan = spark.read.parquet(f"{root}/plan")
    keys = plan.select("media_key").union(lists.groupBy("media_key").count().filter("count > 1").select("media_key"))
    staged = rows.select("text").mapInArrow(_stage(_bitmap(keys)), f"kind string, {_MEDIA}")
    staged.write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{root}/staged")
    rest = spark.read.schema(f"{_MEDIA}, kind string").parquet(f"{root}/staged").filter("kind = 'shared'").drop("kind")
    one = Window.partitionBy("media_key").orderBy(F.lit(0))
    rest = rest.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n").join(plan, "media_key", "left")
    none = F.array().cast("array<int>")
    inline = F.transform("frames", lambda f, i: F.when(~F.array_contains(F.coalesce("dropped", none), i), f))
    first = F.struct(F.lit("media").alias("part"), F.col("media_key").alias("key"), "digests", "lens", inline.alias("frames"))
    no_list, no_lens = F.lit(None).cast("array<binary>"), F.lit(None).cast("array<int>")
    pooled = F.transform(
        F.coalesce("exported", none),
        lambda i: F.struct(F.lit("pool").alias("part"), F.get("digests", i).alias("key"), no_list.alias("digests"), no_lens.alias("lens"), F.array(F.get("frames", i)).alias("frames")),
    )
    rest.select(F.explode(F.concat(F.array(first), pooled)).alias("r")).select("r.*").write.partitionBy("part").option("compression", "uncompressed").parquet(f"{root}/rest")
    return root


def container(digests: list[bytes], lens: list[int], frames: list[bytes]) -> bytes:
    """The stored form: the ordered chunk list with its frames."""
    return b"".join(d + n.to_bytes(4, "little") + len(f).to_bytes(4, "little") + f for d, n, f in zip(digests, lens, frames, strict=True))


def restore(digests: list[bytes], lens: list[int], frames: list[bytes], decomp: zstandard.ZstdDecompressor) -> bytes:
    """The payload, each chunk verified against its digest."""
    parts = []
    for d, n, f in zip(digests, lens, frames, strict=True):
        if f is None:
            raise ValueError(f"there is no chunk {d.hex()}")
        part = decomp.decompress(f)
        if len(part) != n or hashlib.blake2b(part, digest_size=16).digest() != d:
            raise ValueError(f"chunk {d.hex()} doesn't match its digest")
        parts.append(part)
    return b"".join(parts)


def feature(pay: bytes) -> str:
    """Rows of samples, mean, spread and entropy of the 8-bit samples."""
    x = np.frombuffer(pay, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    return f"{len(x) // ROW}x{ROW} mean={x.mean():.3f} std={x.std():.3f} entropy={-(p * np.log2(p)).sum():.4f} distinct={len(p)}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decomp = zstandard.ZstdDecompressor()
    for batch in batches:
        keys, rows = batch.column(0).to_pylist(), []
        for key, digests, lens, frames in zip(keys, *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            pay = restore(digests, lens, frames, decomp)
            if hashlib.blake2b(pay, digest_size=16).digest() != key:
                raise ValueError(f"payload {key.hex()} doesn't match its key")
            form = container(digests, lens, frames)
            rows.append((len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature(pay)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["media_key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """One row per distinct payload with its ordered chunk list and all frames (null where the pool has lost one): media_key,
    digests, lens, frames."""
    solo = spark.read.schema(f"{_MEDIA}, kind string").parquet(f"{root}/staged").filter("kind = 'solo'").drop("kind")
    rest = spark.read.schema("key binary, digests array<binary>, lens array<int>, frames array<binary>, part string").parquet(f"{root}/rest")
    media = rest.filter("part = 'media'").withColumnRenamed("key", "media_key").drop("part")
    pool = rest.filter("part = 'pool'").select(F.col("key").alias("digest"), F.get("frames", F.lit(0)).alias("frame"))
    whole = ~F.exists("frames", lambda f: f.isNull())
    gaps = media.filter(~whole)
    refs = gaps.select("media_key", F.posexplode(F.arrays_zip("digests", "frames")).alias("seq", "c")).filter("c.frames is null")
    found = refs.select("media_key", "seq", F.col("c.digests").alias("digest")).join(pool, "digest")
    found = found.groupBy("media_key").agg(F.map_from_entries(F.collect_list(F.struct("seq", "frame"))).alias("found"))
    filled = gaps.join(found, "media_key", "left").withColumn("frames", F.transform("frames", lambda f, i: F.coalesce(f, F.try_element_at(F.col("found"), i)))).drop("found")
    return solo.unionByName(media.filter(whole)).unionByName(filled)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every payload, read the stored bytes back, and return each document's values."""
    spark = prepare(docs.sparkSession)
    return read_features(spark, write_media(docs, scratch(spark, "media")))


def read_features(spark: SparkSession, root: str) -> DataFrame:
    """Each document's values from the stored bytes; a lost chunk or payload is an error."""
    schema = "media_key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    values = read_media(spark, root).mapInArrow(_features, schema)
    lists = spark.read.parquet(f"{root}/lists").select("doc_id", "n_bytes", "media_key")
    found = lists.join(values, "media_key", "left")
    lost = F.raise_error(F.concat(F.lit("there is no payload "), F.hex("media_key"))).cast("long")
    size = F.when(F.col("payload_bytes").isNull(), lost).otherwise(F.col("payload_bytes"))
    return found.withColumn("payload_bytes", size).drop("media_key")
