"""Cleaning of model output and tables over all documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import line_passes as lp
from lexiquarry.functions import segment
from lexiquarry.functions import text as t
from lexiquarry.operators import cleaning as c
from lexiquarry.operators import documents as o
from lexiquarry.plans.documents import _LINES
from lexiquarry.plans.planted import planted, planted_sql, quoted, replaced_sql, strip_sql
from lexiquarry.plans.registry import Registry
from lexiquarry.session import table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

TALK = ["<think>first\nsecond</think>Điều 1. Phạm vi", "Let's look at the page.\n- Wait, the header\ncontent stays", "Thinking Process: a\n\n\n\n\nrest", "plain start", "Here is the text</think>\nI need to copy it\n"]
_TALK = planted_sql(TALK)


def digest(text="text"):
    return F.md5(F.col(text) if isinstance(text, str) else text).alias("h")


_MONOLOGUE = strip_sql(replaced_sql("text", [*[(p, "\n") for p in c.monologue_patterns()], ("\n{3,}", "\n\n")]))


@reg("tx3_monologue_strip", f"SELECT doc_id, md5({_MONOLOGUE}) AS h FROM {_TALK}")
def tx3(spark, d):
    return planted(spark, d, TALK).select("doc_id", digest(c.strip_monologue(F.col("text"))))


_VN = f"(?i){c.ANCHOR}"
_LONG = ["<think>" + "inner talk " * 200 + "</think>Điều 3", "<think>" + "inner talk " * 200 + "</think>short", "as it is"]


@reg("tx4_clean_with_rollback", f"WITH x AS (SELECT doc_id, text, {_MONOLOGUE} AS k FROM {planted_sql(_LONG)}) SELECT doc_id, md5(CASE WHEN length(text) > 100 AND (length(text) - length(k)) / greatest(length(text), 1) > 0.3 AND NOT regexp_matches(k, {quoted(_VN)}) THEN {strip_sql('text')} ELSE k END) AS h FROM x")
def tx4(spark, d):
    return planted(spark, d, _LONG).select("doc_id", digest(c.clean_model_text(F.col("text"))))


@reg("tx5_ocr_spacing")
def tx5(spark, d):
    return planted(spark, d, ["c ộ n g hòa xã hội", "to wn of a b c", "one line"]).select("doc_id", digest(lp.apply(F.col("text"), lp.join_spaced_letters)))


STUCK = ["cóthể làmột nhucầu", "đầutư kỹthuật đảmbảo cơcấu", "nothing stuck"]


def _stuck_sql() -> str:
    x = "text"
    for a, b in sorted(c.STUCK, key=lambda p: -len(p[0])):
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


@reg("tx7_stuck_words", f"SELECT doc_id, md5({_stuck_sql()}) AS h FROM {planted_sql(STUCK)}")
def tx7(spark, d):
    return planted(spark, d, STUCK).select("doc_id", digest(c.split_stuck_words(F.col("text"))))


@reg("tx7_learned_splits")
def tx7_learned(spark, d):
    """Stuck words by a model of the documents' own words, over all of them; two words of every
    document's are stuck together first."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    stuck = docs.withColumn("text", F.regexp_replace("text", r"(\p{Ll}{4,}) (\p{Ll}{4,}) ", "$1$2 "))
    counts = segment.word_counts(docs, "text")
    return segment.with_words_apart(stuck, "doc_id", "text", counts).select("doc_id", digest(F.col("text")), "n_split")


@reg("tx9_syllable_boundaries")
def tx9(spark, d):
    return planted(spark, d, ["tựtrảvềvịtrí", "cácthiếtbị phảiđược", "thu yền ngu yên"]).select("doc_id", digest(c.split_syllables(F.col("text"))))


SIGNED = ["\nKT. BỘ TRƯỞNG\nTHỨ TRƯỞNG\nNguyễn Văn A", "\n  TM. CHÍNH PHỦ\nTHỦ TƯỚNG", "no signer here", "Q. CHỦ TỊCH " + "x" * 700]
_CUT = "CASE WHEN n <= 500 THEN 0 WHEN strpos(reverse(substr(text, n - 499, 300)), chr(10)) > 0 THEN n - 200 - strpos(reverse(substr(text, n - 499, 300)), chr(10)) ELSE n - 500 END"


@reg("tx14_signer_block", f"WITH x AS (SELECT doc_id, text, length(text) AS n FROM {planted_sql(SIGNED, after=True)}), y AS (SELECT *, {_CUT} AS cut FROM x) SELECT doc_id, md5(CASE WHEN n < 100 THEN text ELSE {strip_sql(f'substr(text, 1, cut) || regexp_replace(substr(text, cut + 1, n), {quoted("(?is)" + c.SIGNER)}, {quoted("")})')} END) AS h FROM y")
def tx14(spark, d):
    return planted(spark, d, SIGNED, after=True).select("doc_id", digest(c.strip_signer(F.col("text"))))


TABLES = ["| a | b |\n| 1 | 2 |", "| STT | Nội dung |\n| --- | --- |\n| 1 | some long cell of words |", "name of thing | amount | place\nstone and sand | 12 | north side", "| length | width |\n| --- | --- |\n| twelve metres | four metres |", "no table"]
_TABLES = planted_sql(TABLES)
_BLOCKS = "SELECT *, n - row_number() OVER (PARTITION BY doc_id, is_row ORDER BY n) AS block FROM (SELECT *, regexp_matches(trim(line), {row}) AS is_row FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {source}))"


_GFM = _BLOCKS.format(row=quoted(r"^\|.*\|.*\|$|^[^\s|].*\|.*\|.*[^\s|]$"), source=_TABLES)


@reg("tx18_gfm_repair", f"""WITH b AS ({_GFM}), c AS (SELECT *, CASE WHEN starts_with(trim(line), '|') THEN '' ELSE '| ' END || trim(line) || CASE WHEN ends_with(trim(line), '|') THEN '' ELSE ' |' END AS closed,
 n = min(n) OVER w AND count(*) OVER w > 1 AND NOT bool_or(regexp_matches(trim(line), '^\\|[\\s:|-]+\\|$')) OVER w AS is_first FROM b WINDOW w AS (PARTITION BY doc_id, is_row, block))
 SELECT doc_id, md5(string_agg(CASE WHEN NOT is_row THEN line WHEN is_first THEN closed || chr(10) || '|' || repeat(' --- |', CAST(length(closed) - length(replace(closed, '|', '')) - 1 AS INTEGER)) ELSE closed END, chr(10) ORDER BY n)) AS h FROM c GROUP BY doc_id""")
def tx18(spark, d):
    return c.repaired_tables(planted(spark, d, TABLES), "doc_id", "text").select("doc_id", digest())


HEADS = ["Chương 2\nQUY HOẠCH\nĐiều 3. Phạm vi", "Mục 4\n1.2 Phần sau", "no heads"]
_CH = "(?:Chương|CHƯƠNG|Mục|MỤC|Phần|PHẦN)[ \t]+[IVX0-9]+"
_HEADS = [(rf"(^|\n)({_CH}[^\n]*)\n+([^\na-z0-9#à-ỹđ]{{3,}})(\n|$)", "$1$2 $3$4"), (rf"(^|\n)({_CH})", "$1\n## $2"), (r"(^|\n)(Điều[ \t]+[0-9]+[.:])", "$1\n### $2"), (r"(^|\n)([0-9]{1,2}\.[0-9]{1,2}\.?[ \t])", "$1#### $2")]


@reg("tx19_heading_levels", f"SELECT doc_id, md5({replaced_sql('text', _HEADS)}) AS h FROM {planted_sql(HEADS)}")
def tx19(spark, d):
    return planted(spark, d, HEADS).select("doc_id", digest(c.heading_levels(F.col("text"))))


_INV = _BLOCKS.format(row=quoted(r"^\|.*\|$"), source=_TABLES)


@reg("tx20_invented_tables", f"""WITH b AS ({_INV}), c AS (SELECT *, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells, regexp_matches(trim(line), '^\\|[\\s:-]+(?:\\|[\\s:-]+)*\\|$') AS is_rule FROM b),
 e AS (SELECT *, bool_or(regexp_matches(line, {quoted(c.INVENTED)})) OVER w AS known, coalesce(sum(len(cells)) FILTER (NOT is_rule) OVER w, 0) AS k, coalesce(sum(length(array_to_string(cells, ''))) FILTER (NOT is_rule) OVER w, 0) AS chars, count(*) FILTER (NOT is_rule) OVER w AS rows_ FROM c WINDOW w AS (PARTITION BY doc_id, is_row, block)),
 f AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM e WHERE NOT (is_row AND (known OR (k > 0 AND chars <= 3 * k AND rows_ <= 4))) GROUP BY doc_id)
 SELECT d.doc_id, md5(coalesce(f.text, '')) AS h FROM documents d LEFT JOIN f USING (doc_id)""")
def tx20(spark, d):
    return c.without_invented_tables(planted(spark, d, TABLES), "doc_id", "text").select("doc_id", digest())


ASKED = ["1. Question 1: Chiều cao tối đa của nhà là gì?\n- Where is it -> Nhà ở đâu trong khu vực này?\nChiều cao tối đa của nhà là gì", "What is the height? / Chiều cao của công trình là bao nhiêu??\nsource: page", "no question"]
_ASK = f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {planted_sql(ASKED, "conversations", ("conv_id", "turn"))}),
 a AS (SELECT conv_id, turn, n, regexp_replace(regexp_replace(trim(line), '^(?:[-*•]|[0-9]+[.)])\\s*', ''), '(?i)^(?:Question|Câu hỏi|Câu|Q)\\s*[0-9]+\\s*[:.)]\\s*', '') AS x FROM l),
 b AS (SELECT conv_id, turn, n, CASE WHEN contains(x, '->') THEN trim(regexp_extract(x, '^.*->(.*)$', 1)) ELSE x END AS x FROM a),
 e AS (SELECT conv_id, turn, n, {replaced_sql("CASE WHEN regexp_matches(x, '\\s/\\s') THEN trim(regexp_extract(x, '^.*\\s/\\s(.*)$', 1)) ELSE x END", [("^[\"'*`# ]+|[\"'*`# ]+$", "")])} AS x FROM b),
 f AS (SELECT conv_id, turn, min(n) AS n, regexp_replace(x, '[ :,;.?]+$', '') || '?' AS line FROM e WHERE regexp_matches(x, '(?i)[{c.MARKED_VOWELS}đ]') AND length(x) >= 15 AND (ends_with(x, '?') OR regexp_matches(x, '(?i){c.QUESTION_WORDS}')) AND NOT regexp_matches(x, '(?i)\\b(?:what|who|where|how|which)\\b|source:|topic:|input text|thinking process') GROUP BY conv_id, turn, line),
 g AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY n) AS text FROM f GROUP BY 1, 2)
 SELECT CAST(v.conv_id AS VARCHAR) || ':' || v.turn AS k, md5(coalesce(g.text, '')) AS h FROM conversations v LEFT JOIN g USING (conv_id, turn)"""


@reg("tx22_question_clean", _ASK)
def tx22(spark, d):
    x = planted(spark, d, ASKED, "conversations", ("conv_id", "turn")).select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    return c.clean_questions(x, "k", "text").select("k", digest())


CELLS = ["thước tấhn", "gnuD 12", "plain cell", " ộĐ  x "]
_TOKENS = "[" + ", ".join(map(quoted, c.MIRRORED)) + "]"


def _unmirrored_sql(x: str) -> str:
    return f"CASE WHEN list_has_any(regexp_split_to_array({x}, '\\s+'), {_TOKENS}) THEN {strip_sql(f'reverse({x})')} ELSE {x} END"


@reg("tx23_mirrored_text", f"SELECT doc_id, md5({_unmirrored_sql('text')}) AS h FROM {planted_sql(CELLS)}")
def tx23(spark, d):
    return planted(spark, d, CELLS).select("doc_id", digest(c.unmirrored(F.col("text"))))


_PART = "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 10000 + ascii(l_returnflag) * 100 + ascii(l_linestatus) AS n, CASE WHEN l_linenumber % 5 = 0 THEN ['', ' '] WHEN l_linenumber % 3 = 0 THEN [CAST(l_partkey AS VARCHAR), NULL, l_returnflag] ELSE [CAST(l_partkey AS VARCHAR), l_linestatus] END AS cells FROM lineitem"


def _grid(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    part = F.col("l_partkey").cast("string")
    cells = F.when(F.col("l_linenumber") % 5 == 0, F.array(F.lit(""), F.lit(" "))).when(F.col("l_linenumber") % 3 == 0, F.array(part, F.lit(None).cast("string"), F.col("l_returnflag"))).otherwise(F.array(part, F.col("l_linestatus")))
    rows = l.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 10000 + F.ascii("l_returnflag") * 100 + F.ascii("l_linestatus")).alias("n"), cells.alias("cells"))
    return rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "cells"))).alias("r")).select("k", F.transform("r", lambda x: x["cells"]).alias("r"))


_GRID = f"""WITH g AS (SELECT k, max(len(cells)) AS w, count(*) AS k_rows FROM ({_PART}) GROUP BY 1), t AS (SELECT p.k, n, w, k_rows, list_transform(range(w), lambda i: coalesce(trim(cells[i + 1]), '')) AS cells FROM ({_PART}) p JOIN g USING (k)),
 f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS pos, count(*) OVER (PARTITION BY k) AS full_rows FROM t WHERE array_to_string(cells, '') <> ''),
 m AS (SELECT k, string_agg('| ' || array_to_string(cells, ' | ') || ' |' || CASE WHEN pos = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY n) AS md FROM f WHERE full_rows >= 2 AND w >= 2 AND k_rows >= 2 GROUP BY k), o AS (SELECT g.k, coalesce(md, '') AS md FROM g LEFT JOIN m USING (k))"""


@reg("tx24_cells_markdown", _GRID + " SELECT k, md5(md) AS h FROM o")
def tx24(spark, d):
    return c.cells_markdown(_grid(spark, d), "r", "md").select("k", digest("md"))


@reg("pf10_table_validity", _GRID + """, l AS (SELECT k, list_filter(string_split(md, chr(10)), lambda s: trim(s) <> '') AS l FROM o), c AS (SELECT k, len(l) AS rows_, flatten(list_transform(l[3:], lambda s: list_transform(string_split(regexp_replace(trim(s), '^\\|+|\\|+$', '', 'g'), '|'), lambda x: trim(x)))) AS cells FROM l),
 e AS (SELECT k, rows_, cells, len(list_filter(cells, lambda x: length(x) <= 2)) AS tiny, len(list_filter(cells, lambda x: list_contains(['X','x','✓','✗','O','Χ','Х','●','○','√'], x))) AS marks, list_filter(regexp_split_to_array(array_to_string(cells, ' '), '\\s+'), lambda w: w <> '') AS words FROM c)
 SELECT k, CASE WHEN rows_ < 3 OR len(cells) = 0 THEN false WHEN tiny / greatest(len(cells), 1) > 0.5 THEN marks > 0 AND marks / greatest(tiny, 1) > 0.15 ELSE NOT (len(words) > 5 AND len(list_filter(words, lambda w: length(w) <= 3)) / greatest(len(words), 1) > 0.6) END AS valid FROM e""")
def pf10(spark, d):
    return c.with_table_validity(c.cells_markdown(_grid(spark, d), "r", "md"), "md", "valid").select("k", "valid")


FRAGMENTS = ["Bảng 1\na b\nc\nd e f\nThe text goes on from here with words", "Bảng 1\nlong line that is no fragment", "other start"]


@reg("tx25_fragmented_tables", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {planted_sql(FRAGMENTS)}), a AS (SELECT *, min(CASE WHEN trim(line) = 'Bảng 1' THEN n END) OVER (PARTITION BY doc_id) AS pos FROM l),
 s AS (SELECT *, bool_or(n > pos AND length(trim(line)) > 8) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM a), i AS (SELECT *, coalesce(n > pos AND NOT stop, false) AS inside FROM s)
 SELECT doc_id, md5(string_agg(CASE WHEN inside THEN '| table of ' || doc_id || ' |' ELSE line END, chr(10) ORDER BY n)) AS h FROM i WHERE NOT inside OR n = pos + 1 GROUP BY doc_id""")
def tx25(spark, d):
    docs = planted(spark, d, FRAGMENTS)
    tables = docs.select("doc_id", F.lit("Bảng 1").alias("label"), F.concat(F.lit("| table of "), F.col("doc_id").cast("string"), F.lit(" |")).alias("table"))
    return c.replaced_fragments(docs, tables, "doc_id", "text", F.length(F.trim("line")) <= 8).select("doc_id", digest())


ANCHORED = ["## One {#a1}\nbody of one\n## Two {#a2}\nbody of two\n# End", "no anchor", "## One {#a1}\nalone\n# End"]


@reg("tx26_manifest_patches", f"WITH x AS (SELECT doc_id, regexp_replace(text, '^## One \\{{#a1\\}}\\n(?:body of one|alone)\\n', '## New {{#a1}}' || chr(10)) AS text FROM {planted_sql(ANCHORED)}) SELECT doc_id, md5(regexp_replace(text, '\\n+$', '') || chr(10) || 'tail' || chr(10)) AS h FROM x")
def tx26(spark, d):
    patches = [{"action": "REPLACE", "anchor": "a1", "content": "## New {#a1}"}, {"action": "REPEAL", "anchor": "unknown"}, {"action": "APPEND", "content": "tail"}]
    return planted(spark, d, ANCHORED).select("doc_id", digest(lp.apply(F.col("text"), lambda s: lp.patched(s, patches))))


@reg("tx27_section_span", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '## Two {{#a2}}' || chr(10) || 'body of two' || chr(10) END AS span FROM {planted_sql(ANCHORED)}")
def tx27(spark, d):
    return planted(spark, d, ANCHORED).select("doc_id", lp.apply(F.col("text"), lambda s: (lambda at: s[at[0] : at[1]] if at else None)(lp.section_span(s, "a2"))).alias("span"))


@reg("tx28_baseline_resolution", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 4 = 1 THEN 2 WHEN doc_id % 4 = 2 THEN 3 ELSE 3 END AS tier, md5(CASE WHEN doc_id % 4 = 3 THEN text || '!' ELSE text END) AS h, doc_id % 4 < 3 AS verified FROM documents")
def tx28(spark, d):
    docs = table(spark, d, "documents")
    at = F.col("doc_id") % 4
    tiers = F.array(*[F.struct(F.lit(k + 1).alias("tier"), F.when(at == k, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text")) for k in range(3)])
    sources = docs.select("doc_id", F.explode(tiers).alias("s")).select("doc_id", "s.tier", "s.text")
    expected = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    return c.resolved_baseline(sources, expected, "doc_id").select("doc_id", "tier", digest(), "verified")


_UNSAFE = "[\"'" + r"\\\x00-\x1F\x7F]"
SANE = ['a "quoted" \\ word', "it's\tfine\x7f", "plain"]


@reg("pf2_value_sanitiser", f"SELECT doc_id, md5({replaced_sql('text', [(_UNSAFE, '')])}) AS h FROM {planted_sql(SANE)}")
def pf2(spark, d):
    return planted(spark, d, SANE).select("doc_id", digest(c.sanitised(F.col("text"))))


ODD = ["ŧĖΧŲġşŷį", "<math>x<br>y<sup>", "a\nX\nX\n-\nb", "fine text"]
_ODD = planted_sql(ODD)


@reg("pf6_garbled_chunk", f"""WITH x AS (SELECT doc_id, text, {_LINES} AS l FROM {_ODD}), y AS (SELECT *, len(list_filter(l, lambda s: length(s) < 25)) / greatest(len(l), 1) AS sr, len(list_filter(l, lambda s: list_contains(['X','Χ','Х','x','.','-','_','*'], s))) / greatest(len(l), 1) AS mr, trim(substr(text, 1, 200)) AS sample, substr(text, 1, 200) AS head FROM x)
 SELECT doc_id, length(text) >= 30 AND ((length(text) >= 50 AND len(l) >= 3 AND ((sr > 0.5 AND mr > 0.1) OR (sr > 0.7 AND mr > 0.05) OR (length(text) > 500 AND sample <> '' AND (length(text) - length(replace(text, sample, ''))) / greatest(length(sample), 1) >= 3)))
 OR length(text) - length(translate(text, '{c.GARBAGE}', '')) > 5 OR len(regexp_extract_all(text, '<math>|<br>|<sup>')) >= 2 OR (length(text) > 500 AND (length(text) - length(replace(text, head, ''))) / greatest(length(head), 1) >= 3)) AS garbled FROM y""")
def pf6(spark, d):
    return planted(spark, d, ODD).select("doc_id", c.is_garbled_chunk(F.col("text"), o.is_garbled_table(F.col("text"))).alias("garbled"))


INLINE = ["STT   tên vật liệu   Đơn vị tính", "Stt x Khối lượng", "no head of a table"]


@reg("pf8_inline_table", f"SELECT doc_id, length(text) >= 50 AND regexp_matches(text, '(?:Stt|STT)\\s+.+?\\s+(?:Đơn\\s*vị|ĐVT|Khối\\s*lượng|Tỷ\\s*lệ|Diện\\s*tích)') AS is_table FROM {planted_sql(INLINE)}")
def pf8(spark, d):
    return planted(spark, d, INLINE).select("doc_id", c.is_inline_table(F.col("text")).alias("is_table"))


VALID = ["What is this", "Chiều cao là gì?", "source: [root", "Is “nhà” here"]


@reg("pf15_question_validity", f"""WITH x AS (SELECT doc_id, {strip_sql('text')} AS t FROM {planted_sql(VALID)}), y AS (SELECT *, {replaced_sql('t', [(chr(34) + '[^' + chr(34) + ']*' + chr(34) + "|'[^']*'|`[^`]*`", '')])} AS outside FROM x)
 SELECT doc_id, length(t) >= 20 AND NOT regexp_matches(t, '(?i)input text|source: \\[|likely a regulation|general market|content segment|content:|is no longer available|Please switch to|Thinking Process|Analyze the Request|Tư duy suy luận')
 AND NOT (regexp_matches(t, '(?i)^(?:What|Who|When|Where|Why|How|Which|Is|Are|Can|Could|Do|Does|Did|Will|Would|Should|Shall)\\b') AND NOT regexp_matches(outside, '(?i)[{c.MARKED_VOWELS}đ]')) AND regexp_matches(t, '(?i)[{c.MARKED_VOWELS}đ]') AS valid FROM y""")
def pf15(spark, d):
    return planted(spark, d, VALID).select("doc_id", c.is_valid_question_text(F.col("text")).alias("valid"))


BARE = ["| a | b |\n| 1 | 2 |", "| a | b |\n| --- | --- |\n| 1 | 2 |", "no | table"]


@reg("mx24_simple_table_repair", f"""WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {planted_sql(BARE)}), y AS (SELECT *, coalesce(list_position(list_transform(l, lambda s: regexp_matches(s, '^\\s*\\|.*\\|.*\\|\\s*$')), true), 0) AS pos, len(list_filter(l, lambda s: regexp_matches(s, '^\\s*\\|[\\s:|-]+\\|\\s*$'))) AS rules FROM x)
 SELECT doc_id, md5(CASE WHEN pos > 0 AND rules = 0 THEN array_to_string(list_concat(list_concat(l[1:pos], ['| ' || array_to_string(list_transform(range(length(l[pos]) - length(replace(l[pos], '|', '')) - 1), lambda i: '---'), ' | ') || ' |']), l[pos + 1:]), chr(10)) ELSE text END) AS h FROM y""")
def mx24(spark, d):
    return planted(spark, d, BARE).select("doc_id", digest(c.separator_added(F.col("text"))))


INNER = ["khu vực 3.1 Phạm vi và 3.2. Đối tượng", "theo Bảng 2.1 và 4.5 m chiều cao", "1.1 đầu dòng"]
_NUM = r"([0-9]{1,2}(?:\.[0-9]{1,2}){1,4}\.?)"
_SECTIONS = [(rf"({c.REFERENCE_WORDS})[ \t]+{_NUM}", "$1\u0001$2"), (rf"[ \t]{_NUM}[ \t]+({c.UNIT_WORDS})(\s|[.,;:]|$)", "\u0001$1\u0001$2$3"), (rf"[ \t]+{_NUM}[ \t]+([^\s])", "\n$1 $2")]


@reg("mx26_section_splitting", f"SELECT doc_id, md5(translate({replaced_sql('text', _SECTIONS)}, chr(1), ' ')) AS h FROM {planted_sql(INNER)}")
def mx26(spark, d):
    return planted(spark, d, INNER).select("doc_id", digest(c.split_sections(F.col("text"))))


CHATTY = ["Here is the text:\nĐiều 1. Phạm vi", "The image shows a page\n\nplain words only", "I need to copy\nmục một"]
_PRE = strip_sql(replaced_sql("text", [(rf"(?i)(?:^|\n)(?:{'|'.join(c.PREAMBLES)})[^\n]*(?:\n+|$)", "\n")]))


@reg("mx44_preamble_strip", f"""WITH x AS (SELECT doc_id, string_split({_PRE}, chr(10)) AS l FROM {planted_sql(CHATTY)}), y AS (SELECT *, coalesce(list_position(list_transform(l[1:100], lambda s: regexp_matches(trim(s), '(?i)[{c.MARKED_VOWELS}đ]') OR regexp_matches(trim(s), {quoted(c.LEGAL_START)})), true), 0) AS pos FROM x)
 SELECT doc_id, md5({strip_sql("array_to_string(l[CASE WHEN pos > 0 THEN pos ELSE least(len(l), 100) + 1 END:], chr(10))")}) AS h FROM y""")
def mx44(spark, d):
    return planted(spark, d, CHATTY).select("doc_id", digest(c.without_preamble(F.col("text"))))


def _typos_sql() -> str:
    x = "text"
    for a, b in t.TYPOS:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


PICTURES = ["🚀go🔥", "a ⭐b", "none"]


@reg("tx2_emoji_strip", f"SELECT doc_id, md5({replaced_sql('text', [('[' + t.EMOJI + ']', '')])}) AS h FROM {planted_sql(PICTURES)}")
def tx2(spark, d):
    return planted(spark, d, PICTURES).select("doc_id", digest(t.strip_emoji(F.col("text"))))


TYPED = ["hổ sơ bố sung", "họp đồng nghè", "Tỳ lệ trưởng họp"]


@reg("tx6_typo_map", f"SELECT doc_id, md5({_typos_sql()}) AS h FROM {planted_sql(TYPED)}")
def tx6(spark, d):
    return planted(spark, d, TYPED).select("doc_id", digest(t.fix_typos(F.col("text"))))


JOINED = ["NghịĐịnh", "abC", "điềuKhoản"]
_ACCENTED = "[àáảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịòóỏõọốồổỗộớờởỡợúùủũụứừửữựỳýỷỹỵ]"


@reg("tx8_generic_stuck_words", f"SELECT doc_id, md5({replaced_sql('text', [(f'({_ACCENTED})(' + chr(92) + 'p{Lu})', '$1 $2')])}) AS h FROM {planted_sql(JOINED)}")
def tx8(spark, d):
    """A space between an accented lower-case letter and an upper-case one."""
    return planted(spark, d, JOINED).select("doc_id", digest(F.regexp_replace("text", rf"({_ACCENTED})(\p{{Lu}})", "$1 $2")))


DATED = ["\n 01 02 03 2020 1200 ", "a\n12\nb", "\n 01 02 03"]
_DATED = [(r"\n\s*\d{2}\s+\d{2}\s+\d{2}\s+\d{4}\s+\d{4}\s*$", ""), (r"\n\s*\d{2}\s+\d{2}\s+\d{2}\s*$", ""), (r"(?m)^\s*\d{1,3}\s*$", ""), (r"^\s+|\s+$", "")]


@reg("tx10_date_noise", f"SELECT doc_id, md5({replaced_sql('text', _DATED)}) AS h FROM {planted_sql(DATED, after=True)}")
def tx10(spark, d):
    return planted(spark, d, DATED, after=True).select("doc_id", digest(t.strip_date_noise(F.col("text"))))


SEALED = ["Nội dung Ký bởi: A 01.02.2020 10:00:00 +07:00", "Người ký: B 01.02.2020 10:00:00+07:00", "no seal"]


@reg("tx15_digital_signature", f"SELECT doc_id, md5(coalesce(nullif(trim({replaced_sql('text', [(r'(?is)(?:Ký bởi|Người ký)' + chr(92) + r's*:.+?[0-9]{2}[.][0-9]{2}[.][0-9]{4}' + chr(92) + r's+[0-9]{2}:[0-9]{2}:[0-9]{2}' + chr(92) + r's*[+-][0-9]{2}:[0-9]{2}', ''), (chr(92) + 'n{3,}', '$n$n')]).replace(chr(92) + 'n' + chr(92) + 'n' + chr(39), chr(10) + chr(10) + chr(39))}), ''), text)) AS h FROM {planted_sql(SEALED)}")
def tx15(spark, d):
    return planted(spark, d, SEALED).select("doc_id", digest(t.strip_signature(F.col("text"))))


_PIPES = _BLOCKS.format(row=quoted(r"^\s*\|.*\|.*\|\s*$"), source=planted_sql(BARE)).replace("regexp_matches(trim(line)", "regexp_matches(line")


@reg("tx17_pipe_table_repair", f"""WITH b AS ({_PIPES}), c AS (SELECT *, n = min(n) OVER w AND count(*) OVER w > 1 AND NOT bool_or(regexp_matches(line, '^\\s*\\|[\\s:|-]+\\|\\s*$')) OVER w AS is_first FROM b WINDOW w AS (PARTITION BY doc_id, is_row, block))
 SELECT doc_id, md5(string_agg(CASE WHEN is_row AND is_first THEN line || chr(10) || '|' || repeat(' --- |', CAST(length(line) - length(replace(line, '|', '')) - 1 AS INTEGER)) ELSE line END, chr(10) ORDER BY n)) AS h FROM c GROUP BY doc_id""")
def tx17(spark, d):
    return planted(spark, d, BARE).select("doc_id", digest(lp.apply(F.col("text"), lp.repair_pipe_tables)))


NUMBERED = ["a\n\n7\nb", "12\nwords", "x\n12\ny"]


@reg("tx21_orphan_page_numbers", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {planted_sql(NUMBERED)}), a AS (SELECT *, coalesce(regexp_matches(lag(line) OVER w, '^\\s*$'), true) OR coalesce(regexp_matches(lead(line) OVER w, '^\\s*$'), true) AS alone FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
 SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS h FROM a WHERE NOT (regexp_matches(line, '^\\s*[0-9]{{1,4}}\\s*$') AND alone) GROUP BY doc_id""")
def tx21(spark, d):
    return planted(spark, d, NUMBERED).select("doc_id", digest(lp.apply(F.col("text"), lp.drop_orphan_numbers)))
