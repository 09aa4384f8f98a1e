"""Files of token ids: one zstandard frame per document and a table to seek by.

Layout: a frame for every document, each with its own content checksum; a skippable
frame with the doc_ids; the seek table of the zstandard seekable format (a skippable
frame with compressed size, size and checksum of every frame). Any zstandard tool
reads the ids in order; this reader decompresses only the documents asked for.
Ids are little-endian unsigned numbers of 2 bytes, or 4 for vocabularies over 65,536.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commercium.llm.text import mix
from commercium.llm.tokens import encoder
from commercium.sources.staging import scratch_path, stage

DOCS_PER_FILE = 4096
END_ID = 2
# Fixed values of the published formats.
_SKIPPABLE, _SEEK_FRAME, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80
_FOOTER, _ENTRY, _HEAD = struct.Struct("<IBI"), struct.Struct("<III"), struct.Struct("<II")
_INDEX = struct.Struct("<B")
#: Stands for a NULL doc_id where rows are dealt to files.
_NO_ID = -(2**63)


def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)


def frame_checksum(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body) & 0xFFFFFFFF


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or absolute path that all executors share."""
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, frames: Iterable[tuple[int | None, bytes, int, int]], width: int) -> tuple[int, int]:
    """Write frames (doc_id, compressed, size, checksum) to ``uri``; gives documents and ids.

    The file appears under its name only when complete, so that a task run twice
    leaves one whole file.
    """
    store, path = open_store(uri)
    made, entries, ids, missing, total = f"{path}.{uuid.uuid4().hex}.part", bytearray(), [], [], 0
    with store.open_output_stream(made) as out:
        for doc_id, body, size, checksum in frames:
            out.write(body)
            entries += _ENTRY.pack(len(body), size, checksum)
            ids.append(doc_id or 0)
            missing.append(doc_id is None)
            total += size // width
        index = _INDEX.pack(width) + np.array(ids, "<i8").tobytes() + np.array(missing, "u1").tobytes()
        out.write(_HEAD.pack(_SKIPPABLE, len(index)) + index)
        entries += _ENTRY.pack(_HEAD.size + len(index), 0, frame_checksum(b""))
        footer = _FOOTER.pack(len(entries) // _ENTRY.size, _CHECKSUMS, _SEEK_END)
        out.write(_HEAD.pack(_SEEK_FRAME, len(entries) + len(footer)) + entries + footer)
    store.move(made, path)
    return len(ids), total


class TokenFile:
    """Reader of one file. Only the tail is read at first; documents are read when asked for."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.source = store.open_input_file(path)
        end = self.source.size()
        frames, flags, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != _SEEK_END or not flags & _CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        size = frames * _ENTRY.size
        table = np.frombuffer(self._at(end - _FOOTER.size - size, size), "<u4").reshape(-1, 3).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(table[:, 0])])
        index = self._at(int(places[-2]) + _HEAD.size, int(table[-1, 0]) - _HEAD.size)
        self.width = index[0]
        n = frames - 1
        self.doc_ids = np.frombuffer(index, "<i8", n, 1)
        self.missing = np.frombuffer(index, "u1", n, 1 + 8 * n).astype(bool)
        self.places, self.sizes, self.checksums = places[:-1], table[:n, 1], table[:n, 2]
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, number: int) -> np.ndarray:
        """Ids of the document at a place in the file; a damaged frame raises."""
        body = self.decompressor.decompress(self._at(int(self.places[number]), int(self.places[number + 1] - self.places[number])))
        if len(body) != self.sizes[number] or frame_checksum(body) != self.checksums[number]:
            raise ValueError(f"frame {number} does not match its checksum")
        return np.frombuffer(body, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray:
        """Ids of a document by doc_id (the first if it repeats); KeyError if absent."""
        hits = np.flatnonzero((self.doc_ids == doc_id) & ~self.missing)
        if not len(hits):
            raise KeyError(doc_id)
        return self.ids(int(hits[0]))


def encode_frames(docs: DataFrame, tokenizer: str, bounds: list[int], end_id: int = END_ID) -> DataFrame:
    """file, doc_id, frame, size, checksum: each text's ids with the end id, compressed by itself.

    A doc_id that is the edge of several files has its rows dealt over them by their place
    in the task's input, so that no file grows with a repeated doc_id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pack, edges = encoder(tokenizer), compressor(), np.array(bounds, np.int64)
        end = np.array([end_id], model.type).tobytes()
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            own = keys.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            file = np.searchsorted(edges, own, "left")
            draw = mix(np.arange(seen + 1, seen + 1 + len(own), dtype=np.uint64)) >> np.uint64(32)
            many = (np.searchsorted(edges, own, "right") - file + 1).astype(np.uint64)
            # A doc_id that is one edge ends its file.
            file = file + np.where(many > 2, (draw * many) >> np.uint64(32), np.uint64(0)).astype(np.int64)
            seen += len(own)
            for first, ids, places in model.encode(batch.column(1)):
                bodies = [ids[a:b].tobytes() + end for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file[first : first + len(bodies)].astype(np.int32)),
                        keys.slice(first, len(bodies)),
                        pa.array([pack.compress(b) for b in bodies], pa.binary()),
                        pa.array([len(b) for b in bodies], pa.int32()),
                        pa.array([frame_checksum(b) for b in bodies], pa.int64()),
                    ],
                    names=["file", "doc_id", "frame", "size", "checksum"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, "file int, doc_id long, frame binary, size int, checksum long")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) under ``folder`` in ascending doc_id order; one row per file.

    Gives file, path, n_docs, n_ids, in a written table. File k holds the doc_ids after
    those of file k - 1; edges are quantiles of doc_id, for about DOCS_PER_FILE
    documents a file. Rows that repeat a doc_id share a file, in order of size and
    checksum; a NULL doc_id comes first. NULL text is empty. An empty table writes no file.
    """
    files = max(1, docs.count() // DOCS_PER_FILE)
    edges = []
    if files > 1:
        shares = [k / files for k in range(1, files)]
        edges = docs.select(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), shares, max(10_000, 20 * files))).first()[0] or []
    width = encoder(tokenizer).type.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []

        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        source = rows()
        row = next(source, None)
        while row is not None:
            file = row[0]

            def of_file():
                nonlocal row
                while row is not None and row[0] == file:
                    yield row[1:]
                    row = next(source, None)

            path = f"{folder}/part-{file:07d}.zst"
            done.append((file, path, *write_file(path, of_file(), width)))
        names = ["file", "path", "n_docs", "n_ids"]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    open_store(folder)[0].create_dir(open_store(folder)[1], recursive=True)
    frames = encode_frames(docs, tokenizer, sorted(edges), end_id)
    dealt = frames.repartition(files, "file").sortWithinPartitions("file", "doc_id", "size", "checksum")
    written = dealt.mapInArrow(write, "file int, path string, n_docs long, n_ids long")
    return stage(written, "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32; every checksum is verified.

    ``start`` counts the ids of all documents before, in file order.
    """
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("file", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                sizes = file.sizes // file.width
                crcs = [zlib.crc32(file.ids(k)) for k in range(len(file))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, mask=file.missing),
                        pa.array(start + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # A row is a whole file, so a task for each file is wanted.
    spread = placed.repartition(max(1, manifest.count()), "file").select("path", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to the shared folder and read every document back from the files."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
