"""Fill-in-middle transformation over arrays of code points (operator 11).

A text is decoded to a numpy array of UTF-32 code points. Its units are words with the white space before them, and white
space at the end: a unit starts where a white-space point follows another kind, so neighbouring classes are compared and
`flatnonzero` gives the bounds. Two of the bounds, drawn from the sha256 of seed and doc_id, cut the text in prefix, middle
and suffix, which are put in another order between marks. `restore` rebuilds the text from output and form alone.

Null text is empty. Empty texts, and those that hold a mark, stay plain. A null doc_id draws as the empty string does.
Repeated rows give equal rows; columns of the input that aren't asked for don't matter. Rows are worked on one by one, so
memory is that of an Arrow batch and of four bytes a code point of one text; there is no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80  # share of texts transformed, and of these in suffix-prefix-middle order


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def decoded(cp: np.ndarray) -> str:
    return cp.tobytes().decode("utf-32-le", "surrogatepass")


def bounds(cp: np.ndarray) -> np.ndarray:
    """Starts of the units, and the length at the end."""
    if not len(cp):
        return np.zeros(1, np.int64)
    blank = (cp == 0x20) | ((cp >= 0x09) & (cp <= 0x0D))
    return np.concatenate([[0], np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, [len(cp)]])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(text: str, doc_id: int | None, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle (None if plain), output."""
    cp = points(text)
    b = bounds(cp)
    n = len(b) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= fim_percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = (decoded(x) for x in np.split(cp, [b[low], b[high]]))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    out = f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}" if form == "spm" else f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"
    return n, form, int(b[low]), int(b[high] - b[low]), out


def restore(output: str, form: str) -> str:
    """The text of a form's output. A mark occurs once in it, as the text held none."""
    if form == "plain":
        return output
    head, tail = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(head) :].split(tail, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs."""
    byte_batches(docs.sparkSession, 1 << 22)

    def run(batches):
        for b in batches:
            got = [transform(t, i, seed, fim_percent, spm_percent) for i, t in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True)]
            n, form, p, m, out = zip(*got, strict=True) if got else ((),) * 5
            cols = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(transformed: DataFrame) -> DataFrame:
    """transformed and a column restored, from its output and form."""
    byte_batches(transformed.sparkSession, 1 << 22)
    at, form = transformed.columns.index("output"), transformed.columns.index("form")

    def run(batches):
        for b in batches:
            texts = [restore(o, f) for o, f in zip(b.column(at).to_pylist(), b.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "restored"])

    return transformed.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*transformed.dtypes, ("restored", "string")]))


def report(docs: DataFrame) -> DataFrame:
    """The transformation with digests in place of texts."""
    out = restored(fill_in_middle(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
