"""Operator 12, fill-in-middle.

A text becomes an array of code points (UTF-32); where the classes of neighbours differ lies a boundary between two
units (characters, words and gaps, or lines). Two ranks drawn from the document's id choose boundaries, which cut the
text into prefix, middle and suffix; these are put out in one of two orders with marks before them. One pass, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import lean, map_batches, prepare, table

SEED = 1
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many begin with the suffix.
RATE, SPM = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; neighbours with different ones belong to different units."""
    if unit == "char":
        return np.arange(len(points))
    if unit == "word":
        return (points == 32) | ((points >= 9) & (points <= 13))
    if unit == "line":
        return np.cumsum(points == 10) - (points == 10)
    raise ValueError(f"unit must be char, word or line, not {unit}")


def boundaries(points: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where units begin, and the end: one more than there are units."""
    if not len(points):
        return np.zeros(1, np.int64)
    c = classes(points, unit)
    return np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(points)]))


def draws(doc_id: object, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned numbers of 32 bits from the seed and the id (null: no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def rearranged(text: str, doc_id: object, unit: str = "char", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[str, str, int, int | None, int | None]:
    """(form, output, code points, those of the prefix, those of the middle); the last two are None for a plain text."""
    points, (h1, h2, h3, h4) = code_points(text), draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", text, len(points), None, None
    at = boundaries(points, unit)
    a, b = sorted((int(at[h1 % len(at)]), int(at[h2 % len(at)])))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:a], points[a:b], points[b:]))
    if h4 % 100 < spm:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", len(points), a, b - a
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", len(points), a, b - a


def restored(output: str, form: str) -> str:
    """The text that an output was made of: no piece holds a mark, and none can begin in one piece and end in the next."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(row, form, output, n, prefix_chars, middle_chars) of every row of docs(doc_id, text); row has its columns.

    n counts code points. A text goes out plain if it is null or empty, holds a mark, or by its draw; the rest as psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle). Draws follow doc_id alone, so repeated rows are treated
    alike and rows without a doc_id share one draw; the result does not depend on order or partitions. Texts of any
    length are cut whole; an empty table gives no rows; other columns may have any names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["form", "output", "n", "prefix_chars", "middle_chars"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rearranged(t, i, unit, seed, rate, spm) for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], ["row", *names])

    return rows.mapInArrow(lean(run), f"row {rows.schema['row'].dataType.simpleString()}, form string, output string, n long, prefix_chars long, middle_chars long")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output, and of the text restored from it; edge cases as in fill_in_middle."""
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "form", "output", "n", "prefix_chars", "middle_chars")
    sha = lambda texts: [hashlib.sha256(t.encode()).hexdigest() for t in texts]

    def fn(cols: dict[str, list]) -> dict[str, list]:
        outputs = cols.pop("output")
        return {**cols, "output_sha256": sha(outputs), "restored_sha256": sha(map(restored, outputs, cols["form"]))}

    return map_batches(docs, fn, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
