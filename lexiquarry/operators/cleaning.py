"""Cleaning of model output and of tables in texts, as column expressions and line plans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import word_passes

# Marks and words that results must equal.
REASONING = (r"<think>.*?</think>", r"<thought>.*?</thought>", r"</think>|</thought>")
#: How lines start in which a model talks to itself. A parameter; these are the usual ones.
ASIDES = ("Let's", "Wait,", "Actually,", "Looking at", "The user", "I need to", "I will", "Here is", "Here's", "Based on the image", "Thinking Process", "Final Polish", "Revised Draft", "Self-Correction", "Check Constraints", "Exclusion Rule", "The text looks complete", "Image check:")
ANCHOR = r"(?:Điều|Khoản|Chương|Mục|Phần)\s+[0-9]+|[0-9]+\.[0-9]+[\s.]|QCVN|TCVN|Nghị định|Thông tư|Quyết định|ban hành|quy định|hướng dẫn"
STUCK = (
    ("cóthể", "có thể"), ("làmột", "là một"), ("vàchỉ", "và chỉ"), ("củaquy", "của quy"), ("vàmáy", "và máy"), ("đểđáp", "để đáp"),
    ("cóđầy", "có đầy"), ("vàcấu", "và cấu"), ("vàkhả", "và khả"), ("vàsau", "và sau"), ("cómột", "có một"), ("làcần", "là cần"),
    ("đượcáp", "được áp"), ("camáy", "ca máy"), ("nhucầu", "nhu cầu"), ("kýkết", "ký kết"), ("sốnội", "số nội"), ("đầutư", "đầu tư"),
    ("cơcấu", "cơ cấu"), ("kỹthuật", "kỹ thuật"), ("đảmbảo", "đảm bảo"),
)
MIRRORED = ("cớưht", "tấhn", "ias", "ộĐ", "nớL", "ỏhN", "gnuD", "hcíK")
SIGNER = r"(?:^|\n)\s*(?:KT\.|TM\.|Ký thay\.?|Q\.)\s*(?:THỦ TƯỚNG|CHỦ TỊCH|BỘ TRƯỞNG|CHÍNH PHỦ).*"
CHECK_MARKS = ("X", "x", "✓", "✗", "O", "Χ", "Х", "●", "○", "√")
MARKED_VOWELS = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"
SYLLABLE_START = r"(?:gh|gi|kh|ph|th|tr|qu|[bdđghlqrsvxy])"
SYLLABLE_END = r"(?:ng|nh|ch|[ckmntp])"
REFERENCE_WORDS = "Bảng|bảng|BẢNG|Phụ lục|phụ lục|PHỤ LỤC|Hình|hình|HÌNH|mục|Mục|MỤC|điều|Điều|ĐIỀU|Điểm|điểm|khoản|Khoản|trang|Trang|TRANG|Biểu|biểu|BIỂU"
UNIT_WORDS = "m|mm|cm|km|m2|m3|kg|tấn|ha|lít|giờ|phút|giây|ngày|tháng|năm|lần|%"
PREAMBLES = ("Based on", "I'll extract", "I will extract", "Here's the", "Here is the", "Looking at the", "The image shows", "Following the rules", "The user wants", "I need to", "OCR", "Extracting", "Transcribing", "Dựa vào ảnh", "Nhìn vào ảnh", "Nội dung ảnh", "Theo yêu cầu")
LEGAL_START = r"(?i)^(?:Điều|Khoản|Điểm|Chương|Mục|Phần|Phụ lục|[0-9])"
GARBAGE = "ŧĖΧŲġşŷįďŕŝ"

_VOWELS = f"[aăâeêioôơuưy{MARKED_VOWELS}]"
_SYLLABLES = (
    (rf"([{MARKED_VOWELS}])({SYLLABLE_START})(?={_VOWELS})", "$1 $2"),
    (rf"([{MARKED_VOWELS}]{SYLLABLE_END})({SYLLABLE_START})(?={_VOWELS})", "$1 $2"),
    (rf"([aeio]|u(?!y)|(?<!u)y)({SYLLABLE_START})(?=[{MARKED_VOWELS}])", "$1 $2"),
    (rf"([aeio]|u(?!y)|(?<!u)y)({SYLLABLE_END})({SYLLABLE_START})(?={_VOWELS})", "$1 $2$3"),
)
_UY = (
    (r"(?iu)\b(thu|ngu|chu|tu|khu|hu|xu|bu|lu|phu|tru|du|su|vu|mu|cu|nu|ru)\s+(yền|yên|yến|yện|yệt|yết|yể|yễ|yệ|yếu|yểu|yều)\b", "$1$2"),
    (r"(?iu)\b(quy|huy|tuy|chuy|nguy|khuy|xuy|buy|luy|duy|suy|ruy|muy|truy|phuy)\s+(ền|ên|ến|ện|ệt|ết|ể|ễ|ệ|ếu|ểu|ều|ếp)\b", "$1$2"),
)

#: What a word holds if any step of _SYLLABLES matches (RE2, which cannot look around).
_MAY_SPLIT = f"[{MARKED_VOWELS}]{SYLLABLE_END}?{SYLLABLE_START}{_VOWELS}|[aeiouy]{SYLLABLE_START}[{MARKED_VOWELS}]|[aeiouy]{SYLLABLE_END}{SYLLABLE_START}{_VOWELS}"
#: What a text holds if _UY matches: the second parts begin with such a vowel or y and one.
_UY_VOWELS = "ềêếệểễỀÊẾỆỂỄ"
_MAY_JOIN = rf"[uU][^\pL\pN]+[yY][{_UY_VOWELS}]|[uU][yY][^\pL\pN]+[{_UY_VOWELS}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def monologue_patterns(asides: tuple[str, ...] = ASIDES) -> list[str]:
    """What strip_monologue replaces by a line feed, in order."""
    return [f"(?is){p}" for p in REASONING] + [rf"(?i)(?:^|\n)[ \t]*[-*]*[ \t]*(?:{'|'.join(a.replace('.', '[.]') for a in asides)})[^\n]*"]


def strip_monologue(c: Column, asides: tuple[str, ...] = ASIDES) -> Column:
    """Reasoning blocks and lines in which a model talks to itself go; of three or more
    line feeds two stay."""
    out = reduce(lambda x, p: F.regexp_replace(x, p, "\n"), monologue_patterns(asides), c)
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_model_text(c: Column, summary: bool = False) -> Column:
    """strip_monologue, taken back where it removed much of a text and no mark of a legal
    text is left. Of a summary, an open end goes back to its last sentence."""
    cleaned = strip_monologue(c)
    n = F.length(c)
    much = (n > 100) & ((n - F.length(cleaned)) / F.greatest(n, F.lit(1)) > (0.5 if summary else 0.3))
    if summary:
        whole = F.regexp_extract(cleaned, r"(?s)^(.*\.)[^.]*$", 1)
        return F.when(cleaned.rlike(r"[(,;:–-]$") & (F.length(whole) > F.length(cleaned) * 0.5), whole).otherwise(cleaned)
    return F.when(much & ~cleaned.rlike(f"(?iu){ANCHOR}"), trimmed(c)).otherwise(cleaned)


def split_stuck_words(c: Column, words: tuple[tuple[str, str], ...] = STUCK) -> Column:
    """A dictionary of words that lost their space, longer ones first."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), sorted(words, key=lambda p: -len(p[0])), c)


def split_syllables(c: Column, rounds: int = 5) -> Column:
    """Spaces where one syllable must end and another start, in so many rounds at most; then
    compounds with uy that were split are joined again."""
    steps = [word_passes.python_step(*p) for p in _SYLLABLES]
    joins = [word_passes.python_step(*p) for p in _UY]

    def split(words: str) -> str:
        for _ in range(rounds):
            before = words
            for p, new in steps:
                words = p.sub(new, words)
            if words == before:
                break
        return words

    def rejoin(text: str) -> str:
        # From the words before the first vowel of the compounds to the end of the last one's word.
        first, last = min(i for i in map(text.find, _UY_VOWELS) if i >= 0), max(map(text.rfind, _UY_VOWELS))
        before = text[:first].rsplit(None, 2)
        start = len(before[0]) if len(before) == 3 else 0
        end = next((m.start() for m in re.compile(r"\s").finditer(text, last)), len(text))
        part = text[start:end]
        for p, new in joins:
            part = p.sub(new, part)
        return text[:start] + part + text[end:]

    return word_passes.apply(c, lambda a: word_passes.in_words(a, _MAY_SPLIT, split), lambda a: word_passes.in_texts(a, _MAY_JOIN, rejoin))


def strip_signer(c: Column) -> Column:
    """From a signer's line in about the last 500 characters to the end; texts under 100
    characters stay."""
    n = F.length(c)
    back = F.instr(F.reverse(F.substring(c, n - 499, F.lit(300))), F.lit("\n"))
    cut = F.when(n <= 500, F.lit(0)).when(back > 0, n - 200 - back).otherwise(n - 500)
    tail = F.regexp_replace(F.substring(c, cut + 1, n), f"(?isu){SIGNER}", "")
    return F.when(n < 100, c).otherwise(trimmed(F.concat(F.substring(c, F.lit(1), cut), tail)))


def unmirrored(cell: Column) -> Column:
    """A cell with a known mirrored token is read from its end."""
    tokens = F.split(cell, r"\s+")
    return F.when(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in MIRRORED])), trimmed(F.reverse(cell))).otherwise(cell)


def cells_markdown(df: DataFrame, rows: str, out: str) -> DataFrame:
    """Rows of cells as a Markdown table: padded, without empty rows; empty without two
    rows of two columns."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda x: unmirrored(F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit(" ")))))
    x = df.withColumn(out, F.struct(clean.alias("rows"), F.array_max(F.transform(rows, lambda r: F.size(r))).alias("width")))
    width = F.col(f"{out}.width")
    full = F.filter(f"{out}.rows", lambda r: F.exists(r, lambda x: F.trim(x) != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    x = x.withColumn(out, F.struct(F.transform(full, line).alias("lines"), width.alias("width"), F.size(rows).alias("n")))
    lines, width = F.col(f"{out}.lines"), F.col(f"{out}.width")
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n")
    return x.withColumn(out, F.when((F.col(f"{out}.n") >= 2) & (width >= 2) & (F.size(lines) >= 2), table).otherwise(""))


def with_table_validity(df: DataFrame, md: str, out: str) -> DataFrame:
    """Whether the Markdown table in ``md`` has enough in its cells: not over half of them
    tiny (unless many of those are check marks), not over 60% of the words fragments."""
    lines = F.filter(F.split(md, "\n"), lambda s: F.trim(s) != "")
    data = F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1)))
    cells = F.flatten(F.transform(data, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))))
    x = df.withColumn(out, F.struct(F.size(lines).alias("lines"), cells.alias("cells")))
    cells = F.col(f"{out}.cells")
    words = F.filter(F.split(F.array_join(cells, " "), r"\s+"), lambda w: w != "")
    tiny, marks = F.size(F.filter(cells, lambda x: F.length(x) <= 2)), F.size(F.filter(cells, lambda x: x.isin(*CHECK_MARKS)))
    counts = {"lines": F.col(f"{out}.lines"), "cells": F.size(cells), "tiny": tiny, "marks": marks, "words": F.size(words), "short": F.size(F.filter(words, lambda w: F.length(w) <= 3))}
    x = x.withColumn(out, F.struct(*[c.alias(n) for n, c in counts.items()]))
    n = {k: F.col(f"{out}.{k}") for k in counts}
    checked = (n["marks"] > 0) & (n["marks"] / F.greatest(n["tiny"], F.lit(1)) > 0.15)
    broken = (n["words"] > 5) & (n["short"] / F.greatest(n["words"], F.lit(1)) > 0.6)
    return x.withColumn(out, F.when((n["lines"] < 3) | (n["cells"] == 0), False).when(n["tiny"] / F.greatest(n["cells"], F.lit(1)) > 0.5, checked).otherwise(~broken))


def is_inline_table(c: Column) -> Column:
    """Heads of a table in running text."""
    return (F.length(c) >= 50) & c.rlike(r"(?:Stt|STT)\s+.+?\s+(?:Đơn\s*vị|ĐVT|Khối\s*lượng|Tỷ\s*lệ|Diện\s*tích)")


def is_garbled_chunk(c: Column, garbled_table: Column) -> Column:
    """A garbled table, or over five odd letters, two or more tags, or a text that starts
    three times."""
    odd = F.length(c) - F.length(F.translate(c, GARBAGE, ""))
    tags = F.regexp_count(c, F.lit("<math>|<br>|<sup>"))
    head = F.substring(c, 1, 200)
    again = (F.length(c) - F.length(F.replace(c, head, F.lit("")))) / F.greatest(F.length(head), F.lit(1)) >= 3
    return F.when(F.coalesce(F.length(c), F.lit(0)) < 30, False).otherwise(garbled_table | (odd > 5) | (tags >= 2) | ((F.length(c) > 500) & again))


def is_valid_question_text(c: Column) -> Column:
    """Long enough, without marks of a leaked prompt or of English questions, with letters
    that carry marks."""
    t = trimmed(c)
    leak = r"(?i)input text|source: \[|likely a regulation|general market|content segment|content:|is no longer available|Please switch to|Thinking Process|Analyze the Request|Tư duy suy luận"
    outside = F.regexp_replace(t, "\"[^\"]*\"|'[^']*'|`[^`]*`", "")
    english = t.rlike(r"(?i)^(?:What|Who|When|Where|Why|How|Which|Is|Are|Can|Could|Do|Does|Did|Will|Would|Should|Shall)\b") & ~outside.rlike(f"(?iu)[{MARKED_VOWELS}đ]")
    return F.coalesce((F.length(t) >= 20) & ~t.rlike(leak) & ~english & t.rlike(f"(?iu)[{MARKED_VOWELS}đ]"), F.lit(False))


def sanitised(c: Column) -> Column:
    """Without quotes, backslashes and control characters."""
    return F.regexp_replace(c, r"[\"'\\\x00-\x1F\x7F]", "")


def separator_added(c: Column) -> Column:
    """A text with pipe rows but no separator gets one after its first pipe row."""
    lines = F.split(c, "\n")
    row, rule = r"^\s*\|.*\|.*\|\s*$", r"^\s*\|[\s:|-]+\|\s*$"
    at = F.array_position(F.transform(lines, lambda s: s.rlike(row)), True).cast("int")
    first = F.get(lines, at - 1)
    new = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1), " | "), F.lit(" |"))
    fixed = F.array_join(F.concat(F.slice(lines, F.lit(1), at), F.array(new), F.slice(lines, at + 1, F.size(lines))), "\n")
    return F.when((at > 0) & ~F.exists(lines, lambda s: s.rlike(rule)), fixed).otherwise(c)


def split_sections(c: Column) -> Column:
    """A line break before inline section numbers, unless a unit follows or a word that
    refers to a section stands before."""
    number = r"([0-9]{1,2}(?:\.[0-9]{1,2}){1,4}\.?)"
    held = F.regexp_replace(c, rf"({REFERENCE_WORDS})[ \t]+{number}", "$1\u0001$2")
    held = F.regexp_replace(held, rf"[ \t]{number}[ \t]+({UNIT_WORDS})(\s|[.,;:]|$)", "\u0001$1\u0001$2$3")
    return F.translate(F.regexp_replace(held, rf"[ \t]+{number}[ \t]+([^\s])", "\n$1 $2"), "\u0001", " ")


def heading_levels(c: Column) -> Column:
    """Lines that name chapters, articles and numbered sections as Markdown headings by
    depth; a chapter's title in capitals on the next line joins it."""
    chapter = "(?:Chương|CHƯƠNG|Mục|MỤC|Phần|PHẦN)[ \t]+[IVX0-9]+"
    out = F.regexp_replace(c, rf"(^|\n)({chapter}[^\n]*)\n+([^\na-z0-9#à-ỹđ]{{3,}})(\n|$)", "$1$2 $3$4")
    out = F.regexp_replace(out, rf"(^|\n)({chapter})", "$1\n## $2")
    out = F.regexp_replace(out, r"(^|\n)(Điều[ \t]+[0-9]+[.:])", "$1\n### $2")
    return F.regexp_replace(out, r"(^|\n)([0-9]{1,2}\.[0-9]{1,2}\.?[ \t])", "$1#### $2")


def without_preamble(c: Column, starts: tuple[str, ...] = PREAMBLES) -> Column:
    """Without known first phrases, then without the lines before the first (of 100) that
    has a letter with marks or starts like a legal text."""
    out = trimmed(F.regexp_replace(c, rf"(?i)(?:^|\n)(?:{'|'.join(starts)})[^\n]*(?:\n+|$)", "\n"))
    lines = F.split(out, "\n")
    head = F.slice(lines, 1, 100)
    good = F.transform(head, lambda s: F.trim(s).rlike(f"(?iu)[{MARKED_VOWELS}đ]") | F.trim(s).rlike(LEGAL_START))
    at = F.array_position(good, True).cast("int")
    start = F.when(at > 0, at).otherwise(F.size(head) + 1)
    return trimmed(F.array_join(F.slice(lines, start, F.size(lines)), "\n"))


def lines_with_blocks(docs: DataFrame, key: str, text: str, row: str) -> DataFrame:
    """Lines (key, n, line) of texts with whether they match ``row`` and, in ``block``, what
    their run of rows shares."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("row", F.trim("line").rlike(row))
    return lines.withColumn("block", F.col("n") - F.row_number().over(Window.partitionBy(key, "row").orderBy("n")))


def joined_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, n, line) back to one text for each key."""
    each = F.array_sort(F.collect_list(F.struct("n", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("text"))


INVENTED = r"(?i)\|\s*STT\s*\|\s*Nội dung\s*\||\|\s*[0-9]\s*\|\s*[a-z]\s*\||\|\s*TT\s*\|\s*Nội dung\s*\|"


def without_invented_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts without the tables that a model made up: of a known head, or of at most four
    rows whose cells have three characters or fewer on average."""
    lines = lines_with_blocks(docs, key, text, r"^\|.*\|$")
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    lines = lines.withColumns({"cells": F.size(cells), "chars": F.length(F.array_join(cells, "")), "rule": F.trim("line").rlike(r"^\|[\s:-]+(?:\|[\s:-]+)*\|$")})
    over = Window.partitionBy(key, "row", "block")
    real = lambda c: F.sum(F.when(~F.col("rule"), F.col(c)).otherwise(0)).over(over)
    trivial = (real("cells") > 0) & (real("chars") <= 3 * real("cells")) & (F.count_if(~F.col("rule")).over(over) <= 4)
    bad = F.max(F.col("line").rlike(INVENTED)).over(over) | trivial
    kept = lines.withColumn("bad", F.col("row") & bad).filter(~F.col("bad"))
    return docs.select(key).join(joined_lines(kept, key), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def repaired_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of pipe rows, also such without pipes at their ends: each row gets these, and a
    run of two or more without a separator gets one after its first row."""
    lines = lines_with_blocks(docs, key, text, r"^\|.*\|.*\|$|^[^\s|].*\|.*\|.*[^\s|]$")
    bare = F.trim("line")
    closed = F.concat(F.when(bare.startswith("|"), "").otherwise("| "), bare, F.when(bare.endswith("|"), "").otherwise(" |"))
    over = Window.partitionBy(key, "row", "block")
    ruled = F.max(bare.rlike(r"^\|[\s:|-]+\|$")).over(over)
    first = (F.col("n") == F.min("n").over(over)) & (F.count(F.lit(1)).over(over) > 1) & ~ruled
    pipes = F.length("closed") - F.length(F.replace(F.col("closed"), F.lit("|"), F.lit("")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), pipes - 1))
    lines = lines.withColumns({"closed": closed, "first": first})
    line = F.when(~F.col("row"), F.col("line")).when(F.col("first"), F.concat("closed", F.lit("\n"), rule)).otherwise(F.col("closed"))
    return joined_lines(lines.select(key, "n", line.alias("line")), key)


def replaced_fragments(docs: DataFrame, tables: DataFrame, key: str, text: str, is_fragment: Column) -> DataFrame:
    """The run of fragments (a condition on ``line``) after a document's label line becomes
    its table. tables: key, label, table; documents without one stay."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).join(tables, key, "left")
    order = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("at", F.min(F.when(F.trim("line") == F.col("label"), F.col("n"))).over(Window.partitionBy(key)))
    lines = lines.withColumn("stop", F.max(((F.col("n") > F.col("at")) & ~is_fragment).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.coalesce((F.col("n") > F.col("at")) & (F.col("stop") == 0), F.lit(False))
    kept = lines.withColumn("inside", inside).filter(~F.col("inside") | (F.col("n") == F.col("at") + 1))
    return joined_lines(kept.select(key, "n", F.when(F.col("inside"), F.col("table")).otherwise(F.col("line")).alias("line")), key)


def resolved_baseline(sources: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """The first source (key, tier, text) whose hash is the expected one; without a
    match the last tier, unverified. expected: key, sha (null: any)."""
    s = sources.join(expected, key, "left").withColumn("good", F.col("sha").isNull() | (F.sha2("text", 256) == F.col("sha")))
    best = F.min_by(F.struct("tier", "text", "good"), F.struct(~F.col("good"), F.when(F.col("good"), F.col("tier")).otherwise(-F.col("tier"))))
    return s.filter("text is not null").groupBy(key).agg(best.alias("x")).select(key, "x.tier", "x.text", F.col("x.good").alias("verified"))


QUESTION_WORDS = "là gì|như thế nào|ở đâu|khi nào|bao nhiêu|tại sao|hay không|nào|ra sao"


def clean_questions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that are questions in the corpus's language: bullets, numbers and labels go,
    of English and its translation the latter stays; distinct, in order, each with one ``?``."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    x = F.regexp_replace(F.trim("line"), r"^(?:[-*•]|[0-9]+[.)])\s*", "")
    x = F.regexp_replace(x, r"(?i)^(?:Question|Câu hỏi|Câu|Q)\s*[0-9]+\s*[:.)]\s*", "")
    x = F.when(x.contains("->"), F.trim(F.regexp_extract(x, r"^.*->(.*)$", 1))).otherwise(x)
    x = F.when(x.rlike(r"\s/\s"), F.trim(F.regexp_extract(x, r"^.*\s/\s(.*)$", 1))).otherwise(x)
    x = F.regexp_replace(x, "^[\"'*`# ]+|[\"'*`# ]+$", "")
    lines = lines.select(key, "n", x.alias("line"))
    good = F.col("line").rlike(f"(?iu)[{MARKED_VOWELS}đ]") & (F.length("line") >= 15) & (F.col("line").endswith("?") | F.col("line").rlike(f"(?iu){QUESTION_WORDS}"))
    good = good & ~F.col("line").rlike(r"(?i)\b(?:what|who|where|how|which)\b|source:|topic:|input text|thinking process")
    line = F.concat(F.regexp_replace("line", r"[ :,;.?]+$", ""), F.lit("?"))
    kept = lines.filter(good).select(key, "n", line.alias("line")).groupBy(key, "line").agg(F.min("n").alias("n"))
    return docs.select(key).join(joined_lines(kept, key), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
