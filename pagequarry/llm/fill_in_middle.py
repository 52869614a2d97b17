"""Fill-in-middle training texts: documents cut in three at word borders, their pieces in another order.

A text is decoded to an array of code points.  Comparing the class (blank or not) of
neighbouring code points gives the borders: a unit, which is a word with the blanks
before it, ends where a blank follows a word, or with the text.  Two borders are
drawn by a hash of the document's id, so a document is cut alike wherever and
whenever it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The code points that count as blank.
_BLANK = np.zeros(1 << 8, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def unit_ends(points: np.ndarray) -> np.ndarray:
    """0, and where each unit of a text ends."""
    if not len(points):
        return np.zeros(1, dtype=np.int64)
    blank = _BLANK[np.minimum(points, 0xFF)]
    inner = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.concatenate(([0], inner, [len(points)]))


def _check(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be found where they were written, so none may begin inside another or overlap one."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"sentinels overlap: {a} {b}")
    if any(a in b for a, b in permutations(sentinels, 2)):
        raise ValueError("a sentinel holds another")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2 ** 32, from the hash of the seed and an id (nothing for a null one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``n, form, prefix_chars, middle_chars, output``.

    ``n`` counts a text's units.  ``form`` is ``plain`` for empty texts, those that
    hold a sentinel, and ``100 - rate`` in 100 of the others, whose ``output`` is the
    text; ``spm`` of 100 of the rest put suffix and prefix before the middle, the
    others (``psm``) prefix and suffix.  Lengths are code points, null if plain.

    Null texts are empty ones; null ids are drawn for by the seed alone; rows that
    repeat an id are cut by the same draws, each in its own text; columns of ``docs``
    named as the new ones give way to them.  Texts of any length are cut in one
    pass, in memory a few times their size.  Rows stay where they are: no shuffle.
    """
    _check(sentinels)
    before, between, last = (_points(s) for s in sentinels)
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c not in made]
    own = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own")
    source = docs.select(own, F.coalesce("text", F.lit("")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))))

    def one(text: str, h: tuple[int, int, int, int]) -> tuple:
        points = _points(text)
        ends = unit_ends(points)
        n = len(ends) - 1
        if n == 0 or h[2] % 100 >= rate or any(s in text for s in sentinels):
            return n, "plain", None, None, text
        a, b = sorted((int(ends[h[0] % (n + 1)]), int(ends[h[1] % (n + 1)])))
        prefix, middle, suffix = points[:a], points[a:b], points[b:]
        if h[3] % 100 < spm:
            return n, "spm", a, b - a, _text(np.concatenate((between, suffix, before, prefix, last, middle)))
        return n, "psm", a, b - a, _text(np.concatenate((before, prefix, between, suffix, last, middle)))

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts one by one, results in groups of some 16 million characters.
            h = list(zip(*(batch.column(k).to_pylist() for k in range(2, 6))))
            first, size, out = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                out.append(one(text.as_py(), h[k]))
                size += len(out[-1][-1])
                if size >= 1 << 24 or k == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), *columns], names=["own", *made])
                    first, size, out = k + 1, 0, []

    schema = f"own {source.schema['own'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return source.mapInArrow(run, schema).select("own.*", *made)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text behind an output of :func:`transform`, from the output and its form alone."""
    p, s, m = (rf"\Q{x}\E" for x in sentinels)
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every row of ``docs``."""
    made = transform(docs.select("doc_id", "text"), seed, rate, spm)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
