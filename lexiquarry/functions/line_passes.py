"""Passes over the lines of a text that need to remember what came before.

Plain functions of one string, and ``apply`` to run some of them in order over a column
with Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LETTERS = re.compile(r"[^\W\d_]+\Z")
_BLOCK = re.compile(r"\s*(?:[-+*]\s|[IVX]+\.\s|#{1,4}\s|\||>|\d+(?:\.\d+)*[.)]\s|[a-zđ]\)\s|Điều\s+\d+|Chương\s|Mục\s|Phần\s)")
_ROW = re.compile(r"\s*\|.*\|.*\|\s*\Z")
_SEPARATOR = re.compile(r"\s*\|[\s\-:|]+\|\s*\Z")
_HEADER = re.compile(r"(?i)\s*(?:độc\s+lập\s*[-–—]|cộng hòa xã hội|số\s*:\s*\d|v/v\s*:|kính gửi\s*:|nơi nhận\s*:|(?:hà nội|đà nẵng|tp\.?\s*hồ chí minh),?\s*ngày|chính phủ\s*\Z|quốc hội\s*\Z|người ký\s*:|thời gian ký\s*:|cơ quan\s*:)")
_HEADER_CHARS = 600


def join_spaced_letters(text: str) -> str:
    """Runs of one- to three-letter tokens become one where such tokens are over a fifth
    of a line's."""

    def line(s: str) -> str:
        tokens = s.split()
        small = [len(t) <= 3 and _LETTERS.match(t) is not None for t in tokens]
        if len(tokens) < 3 or sum(small) <= 0.2 * len(tokens):
            return s
        out: list[str] = []
        open_run = False
        for t, ok in zip(tokens, small, strict=True):
            if ok and open_run:
                out[-1] += t
            else:
                out.append(t)
                open_run = ok and len(t) <= 2
            open_run = open_run and ok
        return " ".join(out)

    return "\n".join(line(s) for s in re.sub("  +", " ", text).split("\n"))


def strip_header(text: str) -> str:
    """Header lines and blank lines within the first characters go; never all of a text."""
    if len(text) < 20:
        return text
    kept, seen = [], 0
    for s in text.split("\n"):
        seen += len(s) + 1
        bare = s.strip()
        shouted = 0 < len(bare) < 60 and bare == bare.upper() and not any(c.isdigit() for c in bare) and bare != bare.lower()
        if seen > _HEADER_CHARS or (bare and not _HEADER.match(bare) and not shouted):
            kept.append(s)
    return "\n".join(kept).strip() or text


def strip_recipients(text: str) -> str:
    """The list after a recipients line goes: dashed or short lines that end in ``;``."""
    out, inside = [], False
    for s in text.split("\n"):
        bare = s.strip()
        if re.match(r"(?i)nơi nhận\s*:", bare):
            inside = True
            continue
        inside = inside and ((bare.startswith("- ") and (len(bare) < 80 or bare[-1] in ";,." or "Lưu" in bare)) or (len(bare) < 80 and bare.endswith(";")))
        if not inside:
            out.append(s)
    return "\n".join(out)


def rejoin_paragraphs(text: str) -> str:
    """A line goes on with the next, unless that one is blank or starts a block, where
    it ends openly or the next one starts in lower case."""
    out: list[str] = []
    last = ""
    for s in text.split("\n"):
        bare = s.strip()
        if not bare:
            out.append("")
            last = ""
            continue
        goes_on = last and not _BLOCK.match(s) and (last[-1].islower() or last[-1].isdigit() or last[-1] in ",;:-–²³" or bare[0].islower())
        if goes_on:
            out[-1] += " " + bare
            last = bare
        else:
            out.append(s.rstrip())
            last = out[-1]
    return "\n".join(out)


def repair_pipe_tables(text: str) -> str:
    """Blocks of two or more pipe rows without a separator get one after the first row."""
    out: list[str] = []
    for is_row, lines in groupby(text.split("\n"), key=lambda s: _ROW.match(s) is not None):
        block = list(lines)
        if is_row and len(block) > 1 and not any(_SEPARATOR.match(s) for s in block):
            columns = block[0].strip().count("|") - 1
            block.insert(1, "|" + " --- |" * columns)
        out += block
    return "\n".join(out)


def drop_orphan_numbers(text: str) -> str:
    """Lines of digits beside a blank line or an end of the text go."""
    lines = text.split("\n")
    blank = [True, *(not s.strip() for s in lines), True]
    return "\n".join(s for i, s in enumerate(lines) if not (re.fullmatch(r"\s*\d{1,4}\s*", s) and (blank[i] or blank[i + 2])))


def section_span(text: str, anchor: str) -> tuple[int, int] | None:
    """From the anchor to the next anchor or heading."""
    mark = "{#" + anchor + "}"
    at = text.find(mark)
    if at < 0:
        return None
    start = text.rfind("\n", 0, at) + 1
    nxt = re.compile(r"\n(?=[^\n]*\{#|#{1,6} )").search(text, at + len(mark))
    return start, nxt.start() + 1 if nxt else len(text)


def patched(text: str, patches: list[dict]) -> str:
    """Patches in order: REPLACE, INSERT_AFTER, APPEND, REPEAL; unknown anchors do nothing."""
    for p in patches:
        new = p.get("content", "")
        if p["action"] == "APPEND":
            text = text.rstrip("\n") + "\n" + new + "\n"
            continue
        span = section_span(text, p.get("anchor", ""))
        if span is None:
            continue
        a, b = span
        middle = {"REPLACE": new + "\n", "INSERT_AFTER": text[a:b].rstrip("\n") + "\n" + new + "\n", "REPEAL": "[repealed]\n"}.get(p["action"], text[a:b])
        text = text[:a] + middle + text[b:]
    return text


def joined_pages(pages: list[str]) -> list[str]:
    """Where a page ends within a sentence and the next starts in lower case, the next
    one's first line moves back."""
    out = list(pages)
    for i in range(len(out) - 1):
        here, there = out[i].rstrip(), out[i + 1].lstrip()
        if here and there and here[-1] not in ".!?:;" and there[0].islower():
            head, _, rest = there.partition("\n")
            out[i], out[i + 1] = here + " " + head, rest
    return out


def apply(column: Column, *passes: Callable[[str], str]) -> Column:
    """The passes one after the other; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        for f in passes:
            s = s.map(f, na_action="ignore")
        return s

    return F.pandas_udf(run, T.StringType())(column)


CLEANER = (join_spaced_letters, strip_header, strip_recipients, rejoin_paragraphs, repair_pipe_tables, drop_orphan_numbers)
