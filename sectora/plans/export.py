"""Packs and site pages as files below a folder that all executors reach."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _opened(root: str):
    """The file system and the path of a folder: a local or mounted path, or a URI that Arrow knows (hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write (path, content) rows below ``root`` and return (path, bytes); a rerun of a task writes the same bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(root)
        for b in batches:
            sizes = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = posixpath.join(top, path)
                store.create_dir(posixpath.dirname(target), recursive=True)
                data = content.encode("utf-8")
                with store.open_output_stream(target) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def remove_folders(folders: DataFrame, root: str) -> int:
    """Delete the folders (one column) below ``root`` that exist; returns how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = _opened(root)
        for b in batches:
            paths = [posixpath.join(top, p) for p in b.column(0).to_pylist()]
            there = [p for p in paths if store.get_file_info(p).type == fs.FileType.Directory]
            for p in there:
                store.delete_dir(p)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], names=["path"])

    return folders.mapInArrow(run, "path string").agg(F.count("*")).first()[0]
