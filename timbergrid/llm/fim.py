"""Fill-in-middle transformation on run-length encoded character classes.

A character's class is the number of bytes that it takes in UTF-8. A text is stored as its maximal runs of one class: the
class, the run's first byte and the units before it, both cumulative. A unit is a code point. A cut after u units is found
by binary search of the run that holds unit u; the byte there is the run's first byte plus (u - units before) * class. So
neither cut scans the text, and prefix, middle and suffix are slices of its bytes.

The cuts and the form come from the hex SHA-256 of ``seed:doc_id``: its first two groups of 8 digits, modulo n + 1, are
the cuts; the third says plain at or above the rate; the fourth says suffix-prefix-middle. Texts that are empty or hold
a mark stay plain, so that an output can be read back: the first mark of each kind is the transformation's own.

Defined results: a null text is empty; a null doc_id is hashed as no digits; ties (both cuts alike) give an empty middle;
repeated rows give equal rows; an empty table gives no rows; texts of any length are cut whole, one at a time; other
columns ride along in ``transformed``, whatever their names, and ``report`` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .workers import prepare


@dataclass(frozen=True)
class Settings:
    seed: int = 1
    percent: int = 90
    spm_percent: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"


@dataclass(frozen=True)
class Runs:
    """Maximal runs of one class: bytes a character, first byte, units before; a last entry holds the totals."""

    width: np.ndarray
    first_byte: np.ndarray
    units_before: np.ndarray

    @property
    def units(self) -> int:
        return int(self.units_before[-1])

    def byte_of(self, unit: int) -> int:
        """Where ``unit`` begins; for the number of units, where the text ends."""
        at = min(int(np.searchsorted(self.units_before, unit, side="right")) - 1, len(self.width) - 1)
        return 0 if at < 0 else int(self.first_byte[at]) + (unit - int(self.units_before[at])) * int(self.width[at])


def encode_runs(data: bytes) -> Runs:
    raw = np.frombuffer(data, dtype=np.uint8)
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(leads):
        return Runs(np.zeros(0, np.int8), np.zeros(1, np.int64), np.zeros(1, np.int64))
    width = np.diff(leads, append=len(raw)).astype(np.int8)
    change = np.flatnonzero(np.concatenate(([True], width[1:] != width[:-1])))
    return Runs(width[change], np.append(leads[change], len(raw)), np.append(change, len(leads)))


def cut_bytes(data: bytes, a: int, b: int) -> tuple[int, bytes, bytes, bytes, int, int]:
    """(units, prefix, middle, suffix, units of the first two); a and b are reduced to cuts by the number of units."""
    runs = encode_runs(data)
    low, high = sorted((a % (runs.units + 1), b % (runs.units + 1)))
    p, m = runs.byte_of(low), runs.byte_of(high)
    return runs.units, data[:p], data[p:m], data[m:], low, high - low


def transformed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The columns of ``docs`` but the text, in a struct ``row``; n, form, prefix_chars, middle_chars, output."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = [settings.prefix_mark, settings.suffix_mark, settings.middle_mark]
    held = text == ""
    for mark in marks:
        held = held | F.contains(text, F.lit(mark))
    plain = held | (number(2) % 100 >= settings.percent)
    form = F.when(plain, "plain").when(number(3) % 100 < settings.spm_percent, "spm").otherwise("psm")
    row = F.struct(F.lit(0).alias("-"), *[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"])
    dealt = docs.select(row.alias("row"), number(0).alias("a"), number(1).alias("b"), form.alias("form"), F.encode(text, "UTF-8").alias("data"))
    p, s, m = (mark.encode() for mark in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_prefix, n_middle, told = [], [], [], []
            for form, a, b, data in zip(*(batch.column(c) for c in ("form", "a", "b", "data")), strict=True):
                units, prefix, middle, suffix, before, within = cut_bytes(data.as_py(), a.as_py(), b.as_py())
                kind = form.as_py()
                n.append(units)
                n_prefix.append(None if kind == "plain" else before)
                n_middle.append(None if kind == "plain" else within)
                told.append(b"".join({"plain": (prefix, middle, suffix), "psm": (p, prefix, s, suffix, m, middle), "spm": (s, suffix, p, prefix, m, middle)}[kind]))
            counts = [pa.array(x, pa.int64()) for x in (n, n_prefix, n_middle)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), counts[0], batch.column("form"), *counts[1:], pa.array(told, pa.binary())], ["row", "n", "form", "prefix_chars", "middle_chars", "data"])

    prepare(docs.sparkSession)
    schema = StructType([StructField("row", dealt.schema["row"].dataType), *[StructField(c, t) for c, t in (("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("data", BinaryType()))]])
    found = dealt.mapInArrow(run, schema)
    return found.select("row", "n", "form", "prefix_chars", "middle_chars", F.decode("data", "UTF-8").alias("output"))


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output was made of. No mark begins with what another ends in, so the first of each kind counts."""
    p, s, m = settings.prefix_mark, settings.suffix_mark, settings.middle_mark
    after = lambda x, mark: F.substring(x, F.locate(mark, x) + len(mark), F.length(x))
    upto = lambda x, mark: F.substring(x, F.lit(1), F.locate(mark, x) - 1)
    psm = F.concat(upto(after(output, p), s), after(output, m), upto(after(output, s), m))
    spm = F.concat(upto(after(output, p), m), after(output, m), upto(after(output, s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    found = transformed(docs.select("doc_id", "text"), settings)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), settings), 256).alias("restored_sha256"),
    )
