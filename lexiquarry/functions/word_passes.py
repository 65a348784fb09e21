"""Replacements inside words, done once for each distinct word.

Texts of an Arrow batch are cut at spaces, and only the distinct words in which something can
match are searched, together, by patterns that hold no white space themselves. So the cost of
many patterns in many rounds is that of a vocabulary, and a text is cut and joined once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text cut at a time (a longer text alone), which bounds memory.
AT_ONCE = 1 << 24


def python_step(pattern: str, new: str) -> tuple[re.Pattern, str]:
    """A replacement as Spark takes it (``$1``), for Python."""
    return re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", new)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in runs of about ``AT_ONCE`` bytes."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        if i > start and total + n > AT_ONCE:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    yield texts.slice(start)


def in_words(texts: pa.Array, where: str, change: Callable[[str], str]) -> pa.Array:
    """``change`` within the words of texts without nulls. It gets some words with two spaces
    between them; where it adds spaces, they are single ones inside a word, and it must not
    look beyond a word. Words without a match of ``where`` (RE2) stay."""
    cut = pc.split_pattern(texts, " ")
    words = cut.flatten().dictionary_encode()
    known = words.dictionary
    open_ = pc.match_substring_regex(known, where)
    if not pc.any(open_).as_py():
        return texts
    done = change("  ".join(known.filter(open_).to_pylist())).split("  ")
    known = pc.replace_with_mask(known, open_, pa.array(done, known.type))
    starts = pc.subtract(cut.offsets, cut.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(starts, known.take(words.indices)), " ")


def in_texts(texts: pa.Array, where: str, change: Callable[[str], str]) -> pa.Array:
    """``change`` of the texts that have a match of ``where`` (RE2)."""
    open_ = pc.match_substring_regex(texts, where)
    if not pc.any(open_).as_py():
        return texts
    return pc.replace_with_mask(texts, open_, pa.array([change(t) for t in texts.filter(open_).to_pylist()], texts.type))


def apply(column: Column, *passes: Callable[[pa.Array], pa.Array]) -> Column:
    """The passes over arrays of texts one after the other; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for part in slices(texts.cast(pa.string())):
            filled = pc.fill_null(part, "")
            for f in passes:
                filled = f(filled)
            parts.append(pc.if_else(part.is_valid(), filled, pa.scalar(None, pa.string())))
        return pa.concat_arrays(parts)

    return F.arrow_udf(run, T.StringType())(column)
