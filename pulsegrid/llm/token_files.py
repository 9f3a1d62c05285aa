"""Operator 4: token-id files.

Format of a folder: for each range of documents ``<name>.ids`` (the ids of its documents one after
the other, flat little-endian unsigned integers of 2 or 4 bytes), ``<name>.offsets`` (little-endian
signed 64-bit: where each document starts in ``.ids``, and the end) and ``<name>.docs``
(little-endian signed 64-bit document ids); and the Parquet table ``manifest`` with a row for each
range: file name, width, documents, tokens, first id, and the number of tokens in all ranges before
it (a prefix sum), so the folder reads as one flat array with 64-bit document offsets.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import new_path
from pulsegrid.llm.word_tokens import encoder

#: Stands for a null document id in `.docs`.
NO_ID = -(1 << 63)
#: Bytes of text of a range; more than ``spark.sql.shuffle.partitions`` ranges are made where these would be larger.
RANGE_BYTES = 64 << 20
FILES = "name string, width int, n_docs long, n_tokens long, first_doc long"


def open_folder(uri: str):
    """(file system, path) of a URI, for use within tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` in ascending order of ``id_col`` and returns the manifest, read from the folder.

    Null texts are empty; an empty text is the end id alone. Rows with a null id come first; rows with
    equal ids follow each other in order of their texts. Other columns are left out. An empty table
    gives an empty manifest. Each try of a task writes files of its own name and only those of the
    successful one enter the manifest, so a lost executor leaves nothing that a reader sees.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        tokens, name = encoder(tokenizer_path), uuid.uuid4().hex
        end = np.array([end_id], tokens.dtype).tobytes()
        at, n_docs, first = 0, 0, None
        with (
            files.open_output_stream(f"{root}/{name}.ids") as ids,
            files.open_output_stream(f"{root}/{name}.offsets") as offsets,
            files.open_output_stream(f"{root}/{name}.docs") as names,
        ):
            for batch in batches:
                own = [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
                starts = []
                for k in range(0, len(own), 256):
                    for packed in tokens.encode(batch.column(1).slice(k, 256).to_pylist()):
                        ids.write(packed)
                        ids.write(end)
                        starts.append(at)
                        at += len(packed) // tokens.width + 1
                offsets.write(np.array(starts, "<i8").tobytes())
                names.write(np.array(own, "<i8").tobytes())
                if own and not n_docs:
                    first = own[0]
                n_docs += len(own)
            offsets.write(np.array([at], "<i8").tobytes())
        if n_docs:
            yield pa.RecordBatch.from_pydict({"name": [name], "width": pa.array([tokens.width], pa.int32()), "n_docs": [n_docs], "n_tokens": [at], "first_doc": [first]})

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = rows.repartitionByRange(ranges, "id").sortWithinPartitions("id", "text")
    written = f"{folder}/written"
    ordered.mapInArrow(write, FILES).write.parquet(written)
    # a row for each file, so one task is enough for the prefix sum
    before = Window.orderBy("first_doc", "name").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(FILES).parquet(written)
    files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILES + ", base long").parquet(f"{folder}/manifest")


def mapped(files, path: str, dtype: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """Places ``first`` to ``last`` of a file as an array: memory-mapped where the file system is local, else only these are read."""
    from pyarrow import fs

    width = np.dtype(dtype).itemsize
    if isinstance(files, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return np.frombuffer(source.read_buffer(), dtype)[first:last]
    with files.open_input_file(path) as source:
        stop = source.size() // width if last is None else last
        return np.frombuffer(source.read_at((stop - first) * width, first * width), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before it), n_tokens

    (with the end id) and ids_crc32 (of its ids as little-endian unsigned 32-bit integers).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                offsets = mapped(files, f"{root}/{row['name']}.offsets", "<i8")
                names = mapped(files, f"{root}/{row['name']}.docs", "<i8")
                for k in range(0, len(names), 4096):
                    spans = list(zip(offsets[k : k + 4096].tolist(), offsets[k + 1 : k + 4097].tolist()))[: len(names) - k]
                    base = spans[0][0]
                    ids = mapped(files, f"{root}/{row['name']}.ids", f"<u{row['width']}", base, spans[-1][1])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if x == NO_ID else x for x in names[k : k + 4096].tolist()], pa.int64()),
                            "start": pa.array([row["base"] + a for a, _ in spans], pa.int64()),
                            "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(ids[a - base : b - base].astype("<u4").tobytes()) for a, b in spans], pa.int64()),
                        }
                    )

    manifest = read_manifest(spark, folder)
    # a file to a task, as near as a round robin of the short manifest comes to it
    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes ``docs`` to a new folder in the shared place and returns what the files hold."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id)
    return read_token_files(spark, folder)
