"""Fill-in-middle transformation: texts cut at two units and put together as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

A text is kept as its maximal runs of one character class, each with its start and the number of units that end up to its end (``Runs``). A cut after k units
is found by binary search for the run in which unit k ends; the place within that run follows by arithmetic, as every character of a run of line breaks
ends a line and a run of other characters ends at most one unit, at its end. Runs are arrays over the UTF-8 bytes, so no unit is ever made as a string.

The work is one scan without a shuffle; a task holds one Arrow batch, the outputs of a slice of it and the runs of one text.

Defined results: a null text counts as empty and is plain with no units; so is any text that holds a marker. A null doc_id hashes as the empty string. Cuts that fall
together give an empty middle, and rows with the same doc_id and text the same output. Columns that the result adds replace columns of the same names;
other columns stay.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .textbatch import IS_SPACE, flat, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "word", "char")
ADDED = {"fim_units": LongType(), "fim_form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "fim_text": StringType()}


@dataclass(frozen=True)
class Runs:
    """Maximal runs of a class: where each starts, where the last ends, how many units end up to each run's end, and whether every character of it ends one."""

    start: np.ndarray
    end: int
    units: np.ndarray
    each: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def place(self, k: int) -> int:
        """Where unit k ends, from 0 units at the text's start."""
        if k <= 0:
            return 0
        r = int(np.searchsorted(self.units, k))
        if self.each[r]:
            return int(self.start[r]) + k - (int(self.units[r - 1]) if r else 0)
        return int(self.start[r + 1]) if r + 1 < len(self.start) else self.end


def runs(data: np.ndarray, unit: str = "line") -> Runs:
    """The runs of a text's bytes.

    line: lines with their line break, and what follows the last one. word: stretches of white space and of other characters. char: code points, each a run.
    """
    n = len(data)
    if unit == "char":
        start = np.flatnonzero((data & 0xC0) != 0x80)
        return Runs(start, n, np.arange(1, len(start) + 1), np.zeros(len(start), bool))
    kind = data == 10 if unit == "line" else IS_SPACE[data]
    start = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if n else np.zeros(0, np.int64)
    if unit == "word":
        return Runs(start, n, np.arange(1, len(start) + 1), np.zeros(len(start), bool))
    each = kind[start] if n else np.zeros(0, bool)
    ended = np.where(each, np.diff(np.r_[start, n]), 0)
    if n and not each[-1]:
        ended[-1] = 1
    return Runs(start, n, np.cumsum(ended), each)


def draws(seed: int, doc_id) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of "seed:doc_id", as integers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with fim_units, fim_form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and fim_text.

    rate is the share of texts, in percent, that are cut, and spm_rate that of spm among them; both draws come from the document's id alone.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ADDED))
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def chars(raw: np.ndarray) -> int:
        return int(((raw & 0xC0) != 0x80).sum())

    def one(doc_id, data: np.ndarray) -> tuple:
        raw, found = data.tobytes(), runs(data, unit)
        n, (h1, h2, h3, h4) = found.n, draws(seed, doc_id)
        if not raw or any(m in raw for m in markers) or h3 % 100 >= rate:
            return n, "plain", None, None, raw.decode()
        a, b = sorted((found.place(h1 % (n + 1)), found.place(h2 % (n + 1))))
        prefix, middle, suffix = (p.decode() for p in (raw[:a], raw[a:b], raw[b:]))
        spm = h4 % 100 < spm_rate
        out = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        return n, "spm" if spm else "psm", chars(data[:a]), chars(data[a:b]), out

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in slices(off):
                made = zip(*(one(ids[k], data[off[k] : off[k + 1]]) for k in range(i, j)), strict=True)
                own = batch.slice(i, j - i)
                columns = [pa.array(list(c), t) for c, t in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*own.schema.names, *ADDED])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, t) for c, t in ADDED.items())]))


def restore(text: Column, form: Column) -> Column:
    """The exact text from an output and its form. Texts with markers are plain, so each marker stands once, where it was put."""

    def between(after: str, before: str | None) -> Column:
        rest = F.substring_index(text, after, -1)
        return F.substring_index(rest, before, 1) if before else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = transform(docs).select("doc_id", "fim_units", "fim_form", "prefix_chars", "middle_chars", "fim_text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars",
        digest(F.col("fim_text")).alias("output_sha256"), digest(restore(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"),
    )


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

ORACLE_SQL = {
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS lines,
  list_transform([1, 9, 17, 25], lambda p: CAST('0x' || substr(h, p, 8) AS BIGINT)) AS d FROM t),
c AS (SELECT *, len(lines) AS n, least(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS a, greatest(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
}
