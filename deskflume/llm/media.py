"""Operator 5: media columns - a Spark data source over archives, planned by byte ranges.

``media_archive`` is written and read with ``spark.read/write.format``. Each task of a write packs
its rows (member, payload) into ZIP archives of about ``ARCHIVE_BYTES``, a payload as an 8-bit
grey-scale PNG of 64 samples a line; the commit writes a manifest of the archives of successful
tasks, so what a lost or repeated task left is never read. A read plans byte ranges of about
``RANGE_BYTES`` over the archives; the task of a range reads its archive's directory, takes the
members whose headers begin in its range, and streams their payloads in Arrow batches of about
``BATCH_BYTES``. Each member is read on its own by its offset and tried again ``tries`` times; one
that stays unreadable gives a row with an error and no payload, and the others are not affected.

Scale: the driver sees names and sizes of archives, never members; a task holds one archive's
directory and one batch. Files are reached by pyarrow's file systems, so the folder may be in any
store they open; it is the shared one. Payloads are compressed by PNG itself, without loss.

Defined results: null text is the empty payload, padded to 64 zero bytes; rows of one doc_id are
members of their own; a null doc_id stays null; equal payloads are equal media with equal features;
other columns are ignored; an empty table gives an archive folder without archives and no rows; a second write to a folder adds
to the first (one writer at a time).
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import documents, shared_folder

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
MANIFEST = "archives.json"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LENGTH = b"Length\0"
SCHEMA = "member long, n_bytes long, media binary, payload binary, error string"


def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def to_png(data: bytes) -> bytes:
    """8-bit grey-scale PNG of the padded bytes, WIDTH samples a line, every line unfiltered; a text
    chunk has the length without padding."""
    samples = pad(data)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"tEXt", LENGTH + str(len(data)).encode()) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, bytes]:
    """The length without padding, and the samples, of a PNG as ``to_png`` writes it; checksums and sizes are verified."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, size, data, length = len(SIGNATURE), None, b"", None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(LENGTH):
            length = int(body[len(LENGTH) :])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if size is None or length is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey-scale samples in lines of 64")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return length, lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and shares of eight levels of all samples, and an 8 x 8 grid of mean-above bits."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 5, minlength=8) / len(x)
    grid = np.array([part.reshape(-1, 8, 8).mean(axis=(0, 2)) if len(part) else np.zeros(8) for part in np.array_split(x.reshape(-1, WIDTH), 8)])
    bits = np.packbits(grid > x.mean()).tobytes().hex()
    return f"{x.mean():.4f};{x.std():.4f};{','.join(f'{v:.4f}' for v in levels)};{bits}"


#: Columns of ``described``.
NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


class _Part(InputPartition):
    def __init__(self, archive: str, size: int, begin: int, end: int):
        self.archive, self.size, self.begin, self.end = archive, size, begin, end


class _Message(WriterCommitMessage):
    def __init__(self, archives: list[list]):
        self.archives = archives


class MediaArchive(DataSource):
    """Options: path (a folder's URI), tries."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("tries", TRIES)))

    def writer(self, schema, overwrite):
        if [f.name for f in schema.fields] != ["member", "payload"]:
            raise ValueError("expected the columns member and payload")
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = fs.FileSystem.from_uri(self.uri)
        done, name, out, archive, n = [], None, None, None, 0
        for b in iterator:
            for member, payload in zip(b.column(0), b.column(1), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                    archive, n = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
                m = member.as_py()
                info = zipfile.ZipInfo(f"{'none' if m is None else m}.{n}.png")
                archive.writestr(info, to_png(payload.as_py() or b""))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    archive = _close(archive, out)
                    done.append([name, store.get_file_info(f"{folder}/{name}").size])
        if archive is not None:
            _close(archive, out)
            done.append([name, store.get_file_info(f"{folder}/{name}").size])
        return _Message(done)

    def commit(self, messages):
        store, folder = fs.FileSystem.from_uri(self.uri)
        store.create_dir(folder, recursive=True)
        archives = sorted(a for m in messages if m is not None for a in m.archives)
        if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:  # appended to what is there
            with store.open_input_stream(f"{folder}/{MANIFEST}") as source:
                archives = sorted(archives + json.loads(source.read()))
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(archives).encode())

    def abort(self, messages):
        store, folder = fs.FileSystem.from_uri(self.uri)
        for m in messages:
            for name, _ in m.archives if m is not None else ():
                store.delete_file(f"{folder}/{name}")


def _close(archive, out) -> None:
    archive.close()
    out.close()


class _Reader(DataSourceReader):
    def __init__(self, uri: str, tries: int):
        self.uri, self.tries = uri, tries

    def partitions(self):
        store, folder = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as source:
            archives = json.loads(source.read())
        parts = [_Part(name, size, lo, min(lo + RANGE_BYTES, size)) for name, size in archives for lo in range(0, size, RANGE_BYTES)]
        return parts or [_Part("", 0, 0, 0)]

    def _again(self, action):
        for k in range(self.tries):
            try:
                return action()
            except (OSError, ValueError, zlib.error, struct.error, zipfile.BadZipFile):
                if k + 1 == self.tries:
                    raise
                time.sleep(0.05 * 2**k)

    def read(self, partition):
        if not partition.archive:
            return
        store, folder = fs.FileSystem.from_uri(self.uri)
        path = f"{folder}/{partition.archive}"
        members = self._again(lambda: directory(store, path, partition.size))
        rows, held = [], 0
        for name, offset in members:
            if partition.begin <= offset < partition.end:
                member = name.split(".")[0]
                member = None if member == "none" else int(member)
                try:
                    media = self._again(lambda o=offset: member_at(store, path, o))
                    (n_bytes, payload), error = from_png(media), None
                except (OSError, ValueError, zlib.error, struct.error, zipfile.BadZipFile) as e:
                    n_bytes = media = payload = None
                    error = f"{name} at {offset}: {e}"
                rows.append((member, n_bytes, media, payload, error))
                held += len(payload or b"") + len(media or b"")
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def directory(store, path: str, size: int) -> list[tuple[str, int]]:
    """(name, offset) of an archive's members from the directory at its end."""
    with store.open_input_file(path) as source:
        return [(i.filename, i.header_offset) for i in zipfile.ZipFile(io.BufferedReader(_Raw(source, size))).infolist()]


class _Raw(io.RawIOBase):
    """A random-access file for zipfile."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at = source, size, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self):
        return self.at

    def readinto(self, buffer):
        got = self.source.read_at(min(len(buffer), max(0, self.size - self.at)), self.at)
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)


def member_at(store, path: str, offset: int) -> bytes:
    """The stored member whose local header is at ``offset``; its checksum is verified."""
    with store.open_input_file(path) as source:
        head = source.read_at(30, offset)
        magic, _, flags, how, _, _, crc, size, _, n_name, n_extra = struct.unpack("<IHHHHHIIIHH", head)
        if magic != 0x04034B50 or how != 0:
            raise ValueError("no stored member here")
        begin = offset + 30 + n_name + n_extra
        if flags & 8:  # written to a stream: size and checksum follow the data, which is a PNG file
            return _whole_png(source, begin)
        body = source.read_at(size, begin)
        if len(body) < size or zlib.crc32(body) != crc:
            raise ValueError("checksum differs")
        return body


def _whole_png(source, begin: int) -> bytes:
    end, kind = begin + len(SIGNATURE), b""
    while kind != b"IEND":
        head = source.read_at(8, end)
        n, kind = struct.unpack(">I4s", head)
        end += 12 + n
    body = source.read_at(end - begin, begin)
    tail = source.read_at(8, end)
    if struct.unpack("<II", tail) != (0x08074B50, zlib.crc32(body)):
        raise ValueError("checksum differs")
    return body


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["member", "n_bytes", "media", "payload", "error"])


def media_table(docs: DataFrame, folder: str, doc_id="doc_id", text="text", **options) -> DataFrame:
    """Store the texts of ``docs`` as media in ``folder``; the rows of the archives read back."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    rows = docs.select(F.col(doc_id).cast("long").alias("member"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("payload"))
    rows.write.format("media_archive").mode("append").save(folder)
    return spark.read.format("media_archive").options(**options).load(folder)


def described(media: DataFrame) -> DataFrame:
    """Digests and features of media rows; a member that could not be read raises its error."""

    def run(batches):
        for b in batches:
            out = []
            for member, n_bytes, stored, payload, error in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if error:
                    raise OSError(error)
                out.append((member, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(NAMES))

    return media.select("member", "n_bytes", "media", "payload", "error").mapInArrow(run, ", ".join(f"{n} {'string' if n in ("payload_sha256", "media_sha256", "feature") else 'long'}" for n in NAMES))




def op5(spark, sf_dir):
    return described(media_table(documents(spark, sf_dir), shared_folder(spark)))
