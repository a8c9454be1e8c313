"""Writing named files: rows of (name, chunk) become files, each the chunks of its name in the order of the rows.

Spark's own writers name their files after tasks and put separators between rows. Here the rows name the file, and bytes
are written as they are. All rows of a name must stand in one partition; up to OPEN_FILES names may take turns. A task writes
into a folder of its attempt, and the commit moves the files of the attempts that count to their names, so a task that is
lost, repeated or run twice leaves nothing behind. The folder may be in any store that ``pyarrow.fs`` can write to.
"""

from __future__ import annotations

import contextlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

OPEN_FILES = 4
MOVERS = 16
ATTEMPTS = "_attempts"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path inside it."""
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, str(uuid.uuid4())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        folder = f"{ATTEMPTS}/{self.job}/{uuid.uuid4()}"
        streams: OrderedDict[str, pa.NativeFile] = OrderedDict()
        done: set[str] = set()

        def stream(name: str) -> pa.NativeFile:
            if name in streams:
                streams.move_to_end(name)
                return streams[name]
            if name in done:
                raise ValueError(f"the rows of {name} do not stand together")
            if name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"{name} is no file name inside the folder")
            if len(streams) == OPEN_FILES:
                streams.popitem(last=False)[1].close()
            done.add(name)
            store.create_dir(f"{root}/{folder}/{name}".rpartition("/")[0], recursive=True)
            streams[name] = store.open_output_stream(f"{root}/{folder}/{name}", compression=None)
            return streams[name]

        for batch in iterator:
            names = batch.column("name").dictionary_encode()
            chunks = batch.column("chunk").fill_null(b"").cast(pa.large_binary())
            if not len(chunks):
                continue
            code = names.indices.to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
            ends = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                # the bytes of neighbouring rows lie side by side
                held = chunks.buffers()[2]
                out = stream(names.dictionary[int(code[low])].as_py())
                if held is not None and ends[high] > ends[low]:
                    out.write(held.slice(int(ends[low]), int(ends[high] - ends[low])))
        for out in streams.values():
            out.close()
        return Written(folder, sorted(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        moves = [(f"{root}/{m.folder}/{name}", f"{root}/{name}") for m in messages if m for name in m.names]
        if len({to for _, to in moves}) != len(moves):
            self.abort(messages)
            raise ValueError("the rows of one file stand in several partitions")
        for parent in {root, *(to.rpartition("/")[0] for _, to in moves)}:
            store.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda move: store.move(*move), moves))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        with contextlib.suppress(FileNotFoundError, OSError):
            store.delete_dir(f"{root}/{ATTEMPTS}/{self.job}")
        with contextlib.suppress(FileNotFoundError, OSError):
            if not store.get_file_info(fs.FileSelector(f"{root}/{ATTEMPTS}")):
                store.delete_dir(f"{root}/{ATTEMPTS}")


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("path", folder)``; see ``write_files``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_files(chunks: DataFrame, folder: str) -> None:
    """Writes ``chunks(name string, chunk binary)``; the rows of a name stand in one partition, in order."""
    chunks.sparkSession.dataSource.register(NamedFiles)
    chunks.select("name", "chunk").write.format("named_files").option("path", folder).mode("append").save()
