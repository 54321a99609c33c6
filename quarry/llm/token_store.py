"""Token ids in a content-addressed store.

Format, all Parquet, below one folder:
  objects/kind=0   key (16-byte BLAKE2b of a chunk's ids as little-endian uint32), payload (one byte 0 or 1, then a
                   zstandard frame of the ids as uint16 or uint32); each distinct chunk once
  recipes          one row per document in ascending doc_id order over segments (files): segment, local_start (ids
                   before it in its segment), position (in its segment), doc_id, n_tokens, leaf (16-byte BLAKE2b of
                   the recipe with its doc_id), digests and lens of its chunks in order
  manifest         Merkle tree over the leaves: level, node, hash (SHA-256 of up to FANOUT children); one root

Chunks end where a rolling gear hash over the ids has zero high bits, so equal passages give equal chunks wherever
they stand. Plans: one pass encodes; one exchange, keyed by chunk (or by document for recipes), carries compressed
chunks that each task has already made distinct; ids are never gathered per document. Reading back verifies every
stored chunk against its key and every recipe against its leaf, and combines the chunks' checksums, so that payloads aren't shuffled again.
A level of the manifest is built, and verified, from the written level below it. A chunk that isn't there, or a segment that has lost a
recipe, ends the read with an error; a segment lost as a whole, like any other change of the leaves, fails the manifest.

Defined results: a null text is empty and gives the end id alone; rows that repeat a doc_id stay separate rows, in
order of their leaves; a null doc_id comes first; an empty table gives an empty store whose manifest has no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, gear_candidates, mix64, prepare, scratch, texts
from .encoder import MEMO, ROWS, encoder

SHORTEST, MASK_BITS, LONGEST = 512, 11, 8192
FANOUT = 1024
END_ID = 0

_OBJECT = "kind int, route long, key binary, payload binary, doc_id long, digests array<binary>, lens array<int>"
_RECIPE = "doc_id long, leaf binary, digests array<binary>, lens array<int>, segment int, local_start long, position long, n_tokens long"


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def leaf(digests: list[bytes], lens: list[int], doc_id: int | None) -> bytes:
    return _digest(b"".join(digests) + np.array(lens, dtype="<u4").tobytes() + f"{doc_id}".encode())


def pack(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> bytes:
    narrow = int(ids.max(initial=0)) < 65536
    return (b"\0" if narrow else b"\1") + compressor.compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack(payload: bytes, decompressor: zstandard.ZstdDecompressor) -> bytes:
    """The ids as little-endian uint32."""
    raw = decompressor.decompress(payload[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if payload[:1] == b"\0" else raw


def _encode(path: str, end_id: int, memo: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, comp, seen = encoder(path, memo), zstandard.ZstdCompressor(level=1), set()
        gears = (mix64(np.arange(max(enc.vocabulary, end_id + 1), dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            raws = [r + end for r in enc.encode(batch.column(1))]
            ends = np.cumsum([len(r) // 4 for r in raws]).tolist() if raws else []
            ids = np.frombuffer(b"".join(raws), "<u4")
            del raws
            cuts = gear_candidates(gears[ids], MASK_BITS)
            out: dict[str, list] = {n: [] for n in ("kind", "route", "key", "payload", "doc_id", "digests", "lens")}

            def add(*row, out=out):
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)

            start = 0
            for doc_id, end_at in zip(doc_ids, ends, strict=True):
                digests, lens, a = [], [], start
                for b in cut(cuts, start, end_at, SHORTEST, LONGEST):
                    chunk = ids[a:b]
                    key = _digest(chunk.tobytes())
                    digests.append(key)
                    lens.append(b - a)
                    if key not in seen:  # each task sends a chunk once
                        seen.add(key)
                        add(0, int.from_bytes(key[:8], "little", signed=True), key, pack(chunk, comp), None, None, None)
                    a = b
                key = leaf(digests, lens, doc_id)
                route = int.from_bytes(hashlib.blake2b(f"{doc_id}".encode() + key, digest_size=8).digest(), "little", signed=True)
                add(1, route, key, None, doc_id, digests, lens)
                start = end_at
            if len(seen) > 200_000:
                seen.clear()  # only costs sending a chunk again
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running totals along a sorted segment."""
    total = position = 0
    for batch in batches:
        n = np.array([sum(x) for x in batch.column("lens").to_pylist()], dtype=np.int64)
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        columns = [pa.array(before), pa.array(np.arange(position, position + len(n), dtype=np.int64)), pa.array(n)]
        position += len(n)
        names = ["local_start", "position", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def write_store(docs: DataFrame, tokenizer_path: str, root: str, end_id: int = END_ID, memo: int = MEMO) -> str:
    """Encode every whole text of docs (doc_id, text) into a store below root. memo: words whose ids a worker keeps."""
    spark = prepare(docs.sparkSession, ROWS)
    rows = texts(docs).mapInArrow(_encode(tokenizer_path, end_id, memo), _OBJECT)
    first = Window.partitionBy("route", "kind", "key").orderBy(F.lit(0))
    (
        rows.repartition("route")
        .withColumn("n", F.row_number().over(first))
        .filter((F.col("kind") == 1) | (F.col("n") == 1))
        .drop("n", "route")
        .write.partitionBy("kind")
        .option("compression", "uncompressed")
        .parquet(f"{root}/objects")
    )
    recipes = spark.read.schema(_OBJECT.replace("route long, ", "")).parquet(f"{root}/objects").filter("kind = 1")
    recipes = (
        recipes.select("doc_id", F.col("key").alias("leaf"), "digests", "lens")
        .repartitionByRange("doc_id", "leaf")
        .sortWithinPartitions("doc_id", "leaf")
        .withColumn("segment", F.spark_partition_id())
    )
    recipes.mapInArrow(_place, _RECIPE).write.parquet(f"{root}/recipes")
    leaves = read_recipes(spark, root, verify=False)
    count, level, nodes = leaves.count(), 0, _leaves(leaves)
    while count > 0:
        _above(nodes).write.parquet(f"{root}/manifest/level={level}")
        nodes, level, count = _level(spark, root, level), level + 1, -(-count // FANOUT) if count > FANOUT else 0
    return root


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("leaf", "digests", "lens", "doc_id", "n_tokens"))
        for key, digests, lens, doc_id, n in zip(*columns, strict=True):
            if leaf(digests, lens, doc_id) != key or sum(lens) != n:
                raise ValueError(f"recipe {key.hex()} doesn't match its leaf")
        ends = pa.array([np.cumsum(x) for x in batch.column("lens").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, ends], names=[*batch.schema.names, "ends"])


def read_recipes(spark: SparkSession, root: str, verify: bool = True) -> DataFrame:
    """Recipes with start, the ids of all documents before; with verify each is checked against its leaf, and ends, the
    ids up to the end of each chunk, are added.

    Segments are as many as partitions, so their totals are broadcast.
    """
    stored = spark.read.schema(_RECIPE).parquet(f"{root}/recipes")
    recipes = stored.mapInArrow(_sound, f"{_RECIPE}, ends array<long>") if verify else stored
    found = stored.groupBy("segment").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("c"), F.max("position").alias("p"), F.max(F.col("local_start") + F.col("n_tokens")).alias("e"))
    lost = (F.col("c") != F.col("p") + 1) | (F.col("s") != F.col("e"))
    failed = F.raise_error(F.lit("a segment has lost recipes")).cast("long")
    totals = found.select("segment", *[F.when(lost, failed).otherwise(F.col(n)).alias(n) for n in ("s", "c")])
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "segment", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("docs_before")
    )
    return recipes.join(F.broadcast(totals), "segment").select(
        "doc_id", (F.col("ids_before") + F.col("local_start")).alias("start"), "n_tokens", "leaf", "digests", "lens", (F.col("docs_before") + F.col("position")).alias("place"), *(["ends"] if verify else [])
    )


def _leaves(recipes: DataFrame) -> DataFrame:
    return recipes.select(F.col("place").alias("node"), F.hex("leaf").alias("hash"))


def _above(nodes: DataFrame) -> DataFrame:
    """The level of the tree above nodes (node, hash); a group has FANOUT members at most."""
    members = F.array_sort(F.collect_list(F.struct("node", "hash")))
    up = nodes.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(members.alias("m"))
    return up.select(F.col("up").alias("node"), F.sha2(F.concat_ws("", F.transform("m", lambda x: x["hash"])), 256).alias("hash"))


def _level(spark: SparkSession, root: str, level: int) -> DataFrame:
    return spark.read.schema("node long, hash string").parquet(f"{root}/manifest/level={level}")


def verify_manifest(spark: SparkSession, root: str) -> str | None:
    """Compare the stored recipes with the lowest level of the manifest, and each level with the next; the root hash if all agree."""
    leaves = read_recipes(spark, root)
    count, level, nodes = leaves.count(), 0, _leaves(leaves)
    if not count:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise ValueError("the manifest has leaves, but there are no recipes")
        return None
    while True:
        kept = _level(spark, root, level)
        bad = _above(nodes).join(kept.withColumnRenamed("hash", "kept"), "node", "full").filter(~F.col("hash").eqNullSafe(F.col("kept"))).limit(1).count()
        if bad:
            raise ValueError(f"the manifest and the recipes differ at level {level}")
        if count <= FANOUT:
            return kept.first()["hash"]
        nodes, level, count = kept, level + 1, -(-count // FANOUT)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decomp = zstandard.ZstdDecompressor()
    for batch in batches:
        keys, crcs, sizes = batch.column(0).to_pylist(), [], []
        for key, payload in zip(keys, batch.column(1).to_pylist(), strict=True):
            raw = unpack(payload, decomp)
            if _digest(raw) != key:
                raise ValueError(f"chunk {key.hex()} doesn't match its key")
            crcs.append(zlib.crc32(raw))
            sizes.append(len(raw) // 4)
        yield pa.record_batch([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["digest", "crc", "size"])


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(digest, crc, size) of every stored chunk, verified against its key."""
    chunks = spark.read.schema("key binary, payload binary, kind int").parquet(f"{root}/objects").filter("kind = 0")
    return chunks.select("key", "payload").mapInArrow(_checked, "digest binary, crc long, size long")


_POLY = np.uint64(0xEDB88320)


def _multmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, reflected."""
    p = np.zeros_like(b)
    b = b.copy()
    for k in range(31, -1, -1):
        p ^= np.where(a >> np.uint64(k) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ _POLY, b >> np.uint64(1))
    return p


def crc_shift(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a block's CRC-32 adds, by XOR, to the CRC-32 of a text that goes on for so many bytes after the block."""
    out, power = crcs.astype(np.uint64), np.array([1 << 30], dtype=np.uint64)  # x^1, reflected
    for _ in range(3):
        power = _multmod(power, power)  # x^8
    left = after.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _multmod(np.broadcast_to(power, int(odd.sum())).copy(), out[odd])
        power = _multmod(power, power)
        left >>= np.uint64(1)
    return out


def _shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(crc_shift(crc.to_numpy(), after.to_numpy()).astype(np.int64))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    Chunks are read and verified once each; a document's checksum is the XOR of its chunks' shifted checksums, which
    Spark sums before and after the shuffle. A chunk that many documents share is one small row, joined where adaptive
    execution can split it.
    """
    prepare(spark)
    recipes = read_recipes(spark, root)
    refs = recipes.select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip(F.col("digests").alias("digest"), F.col("ends").alias("end"))).alias("c"))
    refs = refs.select("doc_id", "start", "n_tokens", F.col("c.digest").alias("digest"), ((F.col("n_tokens") - F.col("c.end")) * 4).alias("after"))
    found = refs.join(read_chunks(spark, root), "digest", "left")
    crc = F.when(F.col("crc").isNull(), F.raise_error(F.concat(F.lit("there is no chunk "), F.hex("digest"))).cast("long")).otherwise(F.col("crc"))
    parts = found.select("doc_id", "start", "n_tokens", "size", pandas_udf(_shifted, "long")(crc, "after").alias("part"))
    docs = parts.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("size").alias("read"))
    whole = F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is incomplete")).cast("long"))
    return docs.select("doc_id", "start", whole.alias("n_tokens"), "ids_crc32")


def reconstruct(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, ids binary): whole documents as little-endian uint32, chunks joined and ordered per document."""
    prepare(spark)
    refs = read_recipes(spark, root).select("doc_id", "start", F.posexplode("digests").alias("seq", "key"))
    chunks = spark.read.schema("key binary, payload binary, kind int").parquet(f"{root}/objects").filter("kind = 0").select("key", "payload")
    whole = refs.join(chunks, "key", "left").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"))

    @pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        decomp = zstandard.ZstdDecompressor()

        def one(p: list) -> bytes:
            if any(x["payload"] is None for x in p):
                raise ValueError("there is no chunk for a part of a document")
            return b"".join(unpack(x["payload"], decomp) for x in p)

        return parts.map(one)

    return whole.select("doc_id", "start", joined(F.col("parts")).alias("ids"))


def store_and_read(docs: DataFrame, tokenizer_path: str, memo: int = MEMO) -> DataFrame:
    """Write a store to the shared folder, verify its manifest, and read the documents back."""
    spark = docs.sparkSession
    root = write_store(docs, tokenizer_path, scratch(spark, "tokens"), memo=memo)
    verify_manifest(spark, root)
    return read_store(spark, root)
