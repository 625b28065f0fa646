"""Token-id files: encoded documents with Elias-Fano boundaries, and flat files without an index.

Both kinds are written by executors into a shared folder under names that depend on the data
alone, first under a name of the attempt and then renamed, so a repeated or a lost task leaves
the same files. Ids take 16 bits where the vocabulary allows, else 32.

NULL texts count as empty: such a document has its end id alone. Documents with equal ids are all
kept, ordered by text. NULL doc_ids come first. An empty table gives no file and no row. Only the
columns named here are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.batches import bounded
from gaugeworks.llm.bpe import split_pattern
from gaugeworks.llm.elias_fano import EliasFano
from gaugeworks.llm.order import id_range
from gaugeworks.llm.words import Pieces, WordIds, slices, spaced_chunks
from gaugeworks.session import checkpointed, scratch_path, shuffle_partitions

# fixed value: the splitting pattern of the byte-level vocabularies that this module reads
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MAGIC = b"EFTOKEN1"
_HEAD = "<8sIQ"  # magic, bytes of an id, leading documents without doc_id


@lru_cache(maxsize=2)
def _byte_words(path: str) -> tuple[WordIds, np.dtype]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    split = split_pattern(PATTERN)
    return WordIds(Pieces(tokenizer.model, split), spaced_chunks, split), kind


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


def _store(folder: str, name: str, content: list[bytes]) -> None:
    system, at = _file_system(folder)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    system.create_dir(at, recursive=True)
    with system.open_output_stream(own) as out:
        for part in content:
            out.write(part)
    system.move(own, f"{at}/{name}")


def _with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each document, and the lengths then."""
    return np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1


def write_encoded(
    docs: DataFrame, folder: str, path: str, end_id: int = 0, docs_per_file: int = 4096, ids_per_file: int = 1 << 24
) -> DataFrame:
    """Write documents in ascending doc_id order; one row (file, id_range, part, n_docs, n_tokens) a file.

    Files take one range of ids each, no more than ``docs_per_file`` documents and no more than
    ``ids_per_file`` ids, but for a document that is longer alone: a range that holds more goes on
    in further files, so memory stays bounded wherever ids cluster and however long texts are. The
    rows come when the result is read, and with them the files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, kind = _byte_words(path)
        state = {"range": None, "part": 0}
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            keys = [k for h in held for k in h[2]]
            unkeyed = sum(k is None for k in keys)
            content = [
                struct.pack(_HEAD, _MAGIC, kind.itemsize, unkeyed),
                EliasFano.of(np.array(keys[unkeyed:], np.int64)).to_bytes(),
                EliasFano.of(np.concatenate(([0], np.cumsum(sizes)))).to_bytes(),
                ids.astype(kind).tobytes(),
            ]
            name = f"tokens-{state['range'] + 1:019d}-{state['part']:06d}"
            _store(folder, name, content)
            row = [name, state["range"], state["part"], len(keys), len(ids)]
            held.clear()
            state["part"] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in row], ["file", "id_range", "part", "n_docs", "n_tokens"]
            )

        for batch in batches:
            ranges, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            at = 0
            for part in slices(texts):
                ids, ends = codec.encode(part)
                ids, sizes = _with_ends(ids, ends, end_id)
                stops, begin = np.cumsum(sizes), 0
                while begin < len(part):
                    now = ranges[at + begin]
                    if now != state["range"]:
                        yield from flush()
                        state.update(range=int(now), part=0)
                    low = int(stops[begin - 1]) if begin else 0
                    room = docs_per_file - sum(len(h[2]) for h in held)
                    same = int(np.searchsorted(ranges[at : at + len(part)], now, side="right"))
                    fitting = int(np.searchsorted(stops, low + ids_per_file - sum(len(h[0]) for h in held), side="right"))
                    if fitting <= begin and held:
                        yield from flush()
                        continue
                    stop = min(same, begin + room, max(fitting, begin + 1))
                    held.append(
                        (ids[low : stops[stop - 1]], sizes[begin:stop], keys[at + begin : at + stop])
                    )
                    begin = stop
                    if sum(len(h[2]) for h in held) >= docs_per_file:
                        yield from flush()
                at += len(part)
        yield from flush()

    ranged = bounded(docs).select(id_range(docs, docs_per_file).alias("id_range"), F.col("doc_id").cast("long"), "text")
    ordered = ranged.repartition("id_range").sortWithinPartitions("id_range", "doc_id", "text")
    return ordered.mapInArrow(write, "file string, id_range long, part long, n_docs long, n_tokens long")


class TokenFile:
    """One written file: documents by number, without reading the others."""

    def __init__(self, content: bytes | memoryview) -> None:
        magic, width, self.unkeyed = struct.unpack_from(_HEAD, content, 0)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        self.keys, at = EliasFano.read(content, struct.calcsize(_HEAD))
        self.bounds, at = EliasFano.read(content, at)
        self.ids = np.frombuffer(content, f"<u{width}", (len(content) - at) // width, at)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def document(self, number: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of a document, by two selects on the boundaries."""
        key = None if number < self.unkeyed else self.keys.select(number - self.unkeyed)
        return key, self.ids[self.bounds.select(number) : self.bounds.select(number + 1)]


def read_encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files of a folder: file, doc_id, start in the file, n_tokens, ids_crc32.

    ids_crc32 is the unsigned checksum of the ids as little-endian 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                file = TokenFile(memoryview(content.as_buffer()))
                bounds = file.bounds.all()
                keys = [None] * file.unkeyed + file.keys.all().tolist()
                wide = file.ids.astype("<u4")
                pairs = zip(bounds[:-1].tolist(), bounds[1:].tolist())
                sums = [zlib.crc32(wide[a:b]) for a, b in pairs]
                name = path.as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(keys)),
                        pa.array(keys, pa.int64()),
                        pa.array(bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["file", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*").load(folder)
    schema = "file string, doc_id long, start long, n_tokens long, ids_crc32 long"
    return files.select("path", "content").mapInArrow(read, schema)


def global_starts(files: DataFrame) -> DataFrame:
    """Ids in all files before each one: (file, before), from one row a file."""
    order = Window.orderBy("id_range", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))


def encode_and_read(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and describe each document from them.

    Columns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    files = checkpointed(write_encoded(docs, folder, path, end_id), "token-files")
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_encoded(spark, folder).join(global_starts(files), "file")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_flat(docs: DataFrame, folder: str, path: str, end_id: int, docs_per_file: int = 8192) -> DataFrame:
    """Write bare ids with ``end_id`` after each document; (file, place, doc_id) a document.

    Files hold ids and nothing else. Each input partition writes its own, so no text is shuffled.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, kind = _byte_words(path)
        partition, part = TaskContext.get().partitionId(), 0
        held, keys = [], []

        def flush() -> pa.RecordBatch:
            name = f"flat-{partition:08d}-{part:06d}"
            _store(folder, name, held)
            row = [pa.array([name] * len(keys)), pa.array(range(len(keys)), pa.int64()), pa.array(keys, pa.int64())]
            return pa.RecordBatch.from_arrays(row, ["file", "place", "doc_id"])

        for batch in batches:
            own, at = batch.column(0).to_pylist(), 0
            for texts in slices([t or "" for t in batch.column(1).to_pylist()]):
                ids, _ = _with_ends(*codec.encode(texts), end_id)
                held.append(ids.astype(kind).tobytes())
                keys += own[at : at + len(texts)]
                at += len(texts)
                if len(keys) >= docs_per_file:
                    yield flush()
                    held, keys, part = [], [], part + 1
        if keys:
            yield flush()

    rows = bounded(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(write, "file string, place long, doc_id long")


def scan_flat(
    spark: SparkSession, folder: str, end_id: int, id_bytes: int = 2, block_ids: int = 1 << 20
) -> DataFrame:
    """Lengths of the documents of flat files: (file, place, start, n_tokens), the end id not counted.

    Files are cut into blocks of ``block_ids`` ids that are searched independently. A block's
    summary (its ids, its end ids, the last of them) goes through a prefix scan over the file,
    which gives each block the number of documents before it and where the open one began. Ids
    after a file's last end id are a document of their own, as an interrupted writer leaves.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = _file_system(path)
                with system.open_input_file(at) as file:
                    data = file.read_at(size * id_bytes, begin * id_bytes)
                ids = np.frombuffer(data, f"<u{id_bytes}")
                ends = np.flatnonzero(ids == end_id) + begin
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.rpartition("/")[2]]),
                        pa.array([begin + len(ids)]),
                        pa.array([len(ends)]),
                        pa.array([int(ends[-1]) if len(ends) else None], pa.int64()),
                        pa.array([ends], pa.list_(pa.int64())),
                    ],
                    ["file", "stop", "n_ends", "last_end", "ends"],
                )

    ids = F.floor(F.col("length") / id_bytes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "flat-*").load(folder)
    blocks = (
        files.select("path", ids.cast("long").alias("n"))
        .where("n > 0")
        .select("path", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(block_ids))).alias("begin"))
        .select("path", "begin", F.least(F.lit(block_ids), F.col("n") - F.col("begin")).alias("size"))
        # a count of its own, here and below: blocks are few bytes and much work, so sizes say little
        .repartition(shuffle_partitions(spark), "path", "begin")
    )
    found = blocks.mapInArrow(scan, "file string, stop long, n_ends long, last_end long, ends array<long>")
    found = found.repartition(shuffle_partitions(spark), "file")
    before = Window.partitionBy("file").orderBy("stop").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    stitched = found.select(
        "file",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("place"),
        F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)).alias("open"),
        F.when(
            (F.col("stop") == F.max("stop").over(whole)) & (F.coalesce(F.max("last_end").over(whole), F.lit(-1)) < F.col("stop") - 1),
            F.array_append("ends", F.col("stop")),
        )
        .otherwise(F.col("ends"))
        .alias("ends"),
    )
    starts = F.expr("concat(array(open), transform(slice(ends, 1, greatest(size(ends) - 1, 0)), e -> e + 1))")
    one = stitched.where(F.size("ends") > 0).select(
        "file", "place", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("stop"))).alias("i", "at")
    )
    return one.select(
        "file",
        (F.col("place") + F.col("i")).alias("place"),
        F.col("at.start").alias("start"),
        (F.col("at.stop") - F.col("at.start")).alias("n_tokens"),
    )


def count_tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write ``docs`` to flat files and count each document's ids by a scan of them.

    Columns doc_id, file, start (ids of the file before the document), n_tokens (without the end id).
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "flat-tokens")
    order = checkpointed(write_flat(docs, folder, path, end_id), "flat-order")
    if order.isEmpty():
        return spark.createDataFrame([], "doc_id long, file string, start long, n_tokens long")
    width = _byte_words(path)[1].itemsize
    counted = scan_flat(spark, folder, end_id, width)
    # one row a document on either side; the stored one looks small because its columns compress well
    found = order.join(counted.hint("merge"), ["file", "place"])
    return found.select("doc_id", "file", "start", "n_tokens")
