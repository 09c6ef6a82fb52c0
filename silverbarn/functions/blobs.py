"""Compressed payloads and the export of attachments."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from silverbarn.functions.text import is_attachment


@F.pandas_udf(BinaryType())
def _pack(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))


@F.pandas_udf(BinaryType())
def _unpack(payloads: pd.Series) -> pd.Series:
    def one(b):
        try:
            return None if b is None else gzip.decompress(bytes(b))
        except (OSError, EOFError):
            return None

    return payloads.map(one)


def compressed(payload: Column) -> Column:
    """Gzip bytes, the same on every run; null for null."""
    return _pack(payload)


def decompressed(payload: Column) -> Column:
    """Bytes of a gzip payload; null for null and for damaged bytes."""
    return _unpack(payload)


def export_attachments(files: DataFrame, folder: str, accession: str = "accession", name: str = "file_name", payload: str = "payload") -> DataFrame:
    """Writes attachments to ``folder``, which all executors share; (accession, file_name, path, size) of what was written.

    Path separators in names become '_'; a second run overwrites with the same bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for acc, file, content in pdf.itertuples(index=False):
                target = os.path.join(folder, acc.replace("/", "_"), file.replace("/", "_").replace("\\", "_"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write(bytes(content))
                rows.append((acc, file, target, len(content)))
            yield pd.DataFrame(rows, columns=["accession", "file_name", "path", "size"])

    wanted = files.where(is_attachment(F.col(name)) & F.col(payload).isNotNull()).select(accession, name, payload)
    return wanted.mapInPandas(run, "accession string, file_name string, path string, size bigint")
