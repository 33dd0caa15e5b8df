"""Separate records that do not parse, with the reason, from the valid ones.

Each record is parsed by Python's own strict ``csv`` reader, in Arrow batches
within the partition that read it: no shuffle, one pass, and only one batch of
rows in memory at a time. Structural exceptions of the reader are captured as
reasons before any typed field is built.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinfold.session import ship

FIELDS = ("repository_id", "commit_author_name", "commit_author_email", "commit_hash", "commit_author_when")
MAX_CHARS = 50

_PRIVATE_USE = range(0xE000, 0xF900)
_BARE_QUOTE = re.compile(r'(?:\A|,)[^",][^",]*"')
_QUOTED = re.compile(r'(\A|,)"(?:[^"]|"")*"')
_UNUSABLE = re.compile("[\x00-\x1f\x7f\ufffd]")
_EMAIL = re.compile(r"[^@\s]+@[^@\s]+")
_HASH = re.compile(r"[0-9a-f]{40}")
_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(\.\d+)?(?:Z|([+-])(\d\d):(\d\d))", re.ASCII)


class BadRecord(Exception):
    """Carries the reason for which a record is set apart."""


def split_record(line: str | None) -> list[str]:
    """The fields of one record; :class:`BadRecord` ``quoting`` or ``columns`` if it has no proper structure."""
    if line is None or line == "":
        raise BadRecord("columns")
    # line ends inside a record are ordinary characters of a field; the reader would take them for the end of the record
    ends = [c for c in "\r\n" if c in line]
    hide = dict(zip(ends, _absent(line))) if ends else {}
    try:
        fields = next(csv.reader([line.translate(str.maketrans(hide)) if hide else line], strict=True))
    except (csv.Error, StopIteration):
        raise BadRecord("quoting") from None
    # the reader accepts a quote inside a field that does not start with one
    if '"' in line and _BARE_QUOTE.search(_QUOTED.sub(r"\1", line)):
        raise BadRecord("quoting")
    if hide:
        show = str.maketrans({v: k for k, v in hide.items()})
        fields = [f.translate(show) for f in fields]
    if len(fields) != len(FIELDS):
        raise BadRecord("columns")
    return fields


def _absent(line: str) -> Iterator[str]:
    """Characters that the record does not hold, private ones first."""
    return (c for c in map(chr, chain(_PRIVATE_USE, range(0xF0000, 0x110000))) if c not in line)


def parse_time(text: str) -> datetime:
    """A real date and time written as RFC 3339 with ``T``, seconds and ``Z`` or an offset, as UTC."""
    m = _TIME.fullmatch(text)
    if not m:
        raise BadRecord("value")
    year, month, day, hour, minute, second = (int(m[i]) for i in range(1, 7))
    try:
        base = datetime(year, month, day, hour, minute, second, int((m[7] or ".0")[1:7].ljust(6, "0")), timezone.utc)
        if m[8]:
            if int(m[9]) > 23 or int(m[10]) > 59:
                raise BadRecord("value")
            shift = (int(m[9]) * 60 + int(m[10])) * (1 if m[8] == "+" else -1)
            base = datetime.fromtimestamp(base.timestamp() - shift * 60, timezone.utc).replace(microsecond=base.microsecond)
    except (ValueError, OverflowError):
        raise BadRecord("value") from None
    return base


def typed_record(fields: list[str]) -> tuple[str, str, str, str, datetime]:
    """The typed fields, or :class:`BadRecord` ``value``. Blanks around a field do not count for validity."""
    repository, name, email, commit_hash, when = (f.strip(" ") for f in fields)
    for text in (repository, name, email):
        if not text or len(text) > MAX_CHARS or _UNUSABLE.search(text):
            raise BadRecord("value")
    if not _EMAIL.fullmatch(email) or not _HASH.fullmatch(commit_hash):
        raise BadRecord("value")
    return fields[0], fields[1], fields[2], commit_hash, parse_time(when)


_PARSED = T.StructType(
    [T.StructField("reason", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in FIELDS[:4]]
    + [T.StructField(FIELDS[4], T.TimestampType())]
)


def parse_records(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line") -> DataFrame:
    """Every record with ``reason`` (null for a valid one) and the fields of ``commits`` (null for a failed one).

    ``reason`` is the first that applies of ``quoting``, ``columns``, ``value``.
    A null or empty record fails with ``columns``; records of any length are
    parsed whole; repeated records each give their row; columns other than the
    two named are ignored. Name and e-mail are kept as written between the
    commas, quotes resolved, blanks around them included.
    """
    ship(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *_PARSED.fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for line in batch.column(1).to_pylist():
                try:
                    row = (None, *typed_record(split_record(line)))
                except BadRecord as e:
                    row = (str(e), None, None, None, None, None)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.string()] * 5 + [pa.timestamp("us", tz="UTC")]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[f.name for f in schema])

    return df.select(F.col(id_col), F.col(line_col)).mapInArrow(parse, schema)


def failed_records(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line") -> DataFrame:
    """(``id_col``, ``reason``) of each record that fails."""
    return parse_records(df, id_col, line_col).where(F.col("reason").isNotNull()).select(id_col, "reason")


def valid_records(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line") -> DataFrame:
    """The valid records as rows of ``commits``' columns."""
    return parse_records(df, id_col, line_col).where(F.col("reason").isNull()).select(id_col, *FIELDS)
