"""Single identifiers, dates, claims and rules over every order.

No table has columns of these kinds, so each row's inputs are composed from the order's key
and date, in one of several shapes by its key. What comes out is stated in SQL from the same
parts, not by the patterns under test. The inputs are SQL that Spark and DuckDB read alike.

Parts of a row: n (1 to 97), p (n + 1), nn (n with two digits), m (3 to 91), y (the year).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import line_passes as lp
from lexiquarry.functions import text as t
from lexiquarry.operators import documents as o
from lexiquarry.operators import legal as g
from lexiquarry.operators import rules as r
from lexiquarry.operators import upkeep as u
from lexiquarry.plans.registry import Registry
from lexiquarry.session import table
from lexiquarry.sources import readers as rd

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

_PARTS = {
    "n": "CAST(o_orderkey % 97 + 1 AS STRING)",
    "p": "CAST(o_orderkey % 97 + 2 AS STRING)",
    "nn": "lpad(CAST(o_orderkey % 97 + 1 AS STRING), 2, '0')",
    "m": "CAST(o_orderkey % 89 + 3 AS STRING)",
    "y": "CAST(year(o_orderdate) AS STRING)",
}


def _cases(values: list[str | None]) -> str:
    """One expression for each shape, by k."""
    return "CASE k " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values)) + " END"


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


def bound(name: str, inputs: dict[str, list[str | None]], wanted: dict[str, list[str | None]], make: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query: ``inputs`` and ``wanted`` name columns, an expression for each shape of
    row; ``make`` gives the wanted columns, as text, beside the key ``i``."""
    shapes = len(next(iter(inputs.values())))
    fields = [f"{sql} AS {x}" for x, sql in _PARTS.items()]
    rows = f"(SELECT o_orderkey AS i, CAST(o_orderkey % {shapes} AS INT) AS k, {', '.join(fields)} FROM orders)"

    def query(spark, d: str) -> DataFrame:
        x = table(spark, d, "orders").selectExpr("o_orderkey AS i", f"CAST(o_orderkey % {shapes} AS INT) AS k", *fields)
        given = x.selectExpr("i", *[f"CAST({_cases(v)} AS STRING) AS {c}" for c, v in inputs.items()])
        return make(given).select("i", *wanted)

    reg(name, f"SELECT i, {', '.join(f'CAST({_cases(v)} AS VARCHAR) AS {c}' for c, v in wanted.items())} FROM {rows}")(query)


def value(column: str, f: Callable[[Column], Column], of: str = "s") -> Callable[[DataFrame], DataFrame]:
    return lambda x: x.withColumn(column, f(F.col(of)).cast("string"))


# Identifiers and file names.
_KIND = {
    "number": ["n || '/' || y || '/NĐ-CP'", "''", "''", "'TB' || nn || y", "''", "''", "''", "nn || '/' || y || '/TT-BXD'"],
    "file": ["''", "'QCVN ' || nn || '.pdf'", "'TT' || nn || '-' || y || '-BTP.pdf'", "''", "'a/QD' || nn || '.docx'", "'x.pdf'", "'readme.md'", "'y' || n || '.pdf'"],
    "head": ["''", "''", "''", "''", "''", "'theo ' || nn || '/' || y || '/QH14'", "''", "''"],
    "authority": ["''", "'BXD'", "'BTP'", "''", "'UBND Hà Nội'", "'BTC'", "''", "'hđnd tỉnh'"],
}
_TYPES = ["'NGHI_DINH'", "'QCVN'", "'THONG_TU'", "'THONG_BAO'", "'QUYET_DINH'", "'NGHI_QUYET'", "'VAN_BAN'", "'THONG_TU'"]
_LEVELS = ["'NGHI_DINH'", "'KY_THUAT'", "'THONG_TU'", "'THONG_TU'", "'DIA_PHUONG'", "'NGHI_QUYET'", "'UNKNOWN'", "'DIA_PHUONG'"]
_FIELDS = ["'TONG_HOP'", "'XAY_DUNG'", "'TU_PHAP'", "'TONG_HOP'", "'TONG_HOP'", "'TAI_CHINH'", "'TONG_HOP'", "'XAY_DUNG'"]


def _classified(x: DataFrame) -> DataFrame:
    x = x.withColumn("doc_type", o.document_type(F.col("number"), F.col("file"), F.col("head")))
    x = x.withColumns({"legal_level": o.legal_level(F.col("doc_type"), F.col("authority")), "discipline": o.discipline(F.col("authority"), F.col("number"), F.col("file"))})
    return x.withColumn("labels", F.concat_ws(" ", "doc_type", "legal_level", "discipline"))


bound("cl1_document_type", _KIND, {"doc_type": _TYPES}, _classified)
bound("cl2_legal_level", _KIND, {"legal_level": _LEVELS}, _classified)
bound("cl3_discipline", _KIND, {"discipline": _FIELDS}, _classified)
bound("mx34_taxonomy_bundle", _KIND, {"labels": [f"{a} || ' ' || {b} || ' ' || {c}" for a, b, c in zip(_TYPES, _LEVELS, _FIELDS, strict=True)]}, _classified)

bound(
    "fn15_canonical_id",
    {"s": ["'QCVN ' || n || ':' || y || '/BXD'", "'qcvn-' || n || '-' || y || '-bxd'", "'TCVN ' || m || ':' || y", "'TCVN ISO ' || m || '-' || n || ':' || y", "'TCXDVN ' || n || ':' || y", "n || '/' || y || '/NĐ-CP'", "n || '_' || y || '_nd_cp'", "'VBPL/a b' || n", "'free text ' || n", "''"]},
    {"canonical": ["'VBPL/QCVN_' || nn || '_' || y || '/BXD'", "'VBPL/QCVN_' || nn || '_' || y || '/BXD'", "'VBPL/TCVN_' || m || '_' || y", "'VBPL/TCVN_ISO_' || m || '-' || n || '_' || y", "'VBPL/TCXDVN_' || n || '_' || y", "'VBPL/' || n || '/' || y || '/NĐ-CP'", "'VBPL/' || n || '/' || y || '/NĐ-CP'", "'VBPL/a_b' || n", "'VBPL/free_text_' || n", "''"]},
    value("canonical", t.canonical_id),
)
bound(
    "mx4_canonical_by_prefix",
    {"number": ["n || '/' || y || '/QH15'", "'QCVN ' || nn || ':' || y || '/BXD'", "'draft'", "''"], "slug": ["'s'", "'s'", "'my slug' || n", "'my slug' || m"]},
    {"id": ["'VBPL/' || n || '/' || y || '/QH15'", "'VBPL/QCVN_' || nn || '_' || y || '/BXD'", "'VBPL/my_slug' || n", "'VBPL/my_slug' || m"]},
    lambda x: x.withColumn("id", u.canonical_by_prefix(F.col("number"), F.col("slug"))),
)
bound(
    "fn14_document_id",
    {"number": ["n || '/' || y || '/NĐ-CP'", "''", "'draft'", "n || '/' || m", "'QCVN ' || nn || ':' || y"], "file": ["'a.pdf'", "'my file ' || n || '.pdf'", "'my file ' || n || '.pdf'", "'a'", "'a.pdf'"], "other": [None, None, "''", "'fixed' || n", None]},
    {"doc_id": ["'vb/' || n || '/' || y || '/NĐ-CP'", "'vb/my_file_' || n", "'vb/draft_my_file_' || n", "'fixed' || n", "'vb/QCVN_' || nn || '_' || y"]},
    lambda x: x.withColumn("doc_id", t.document_id(F.lit("vb"), F.col("number"), F.col("file"), F.col("other"))),
)
bound(
    "fn17_file_metadata",
    {"s": ["y || '0501_TT' || nn || '-' || y || '-BTP.pdf'", "'QD' || nn || '-TTg.docx'", "'notes' || n || '.txt'", "y || '0102-ND' || n || '-CP.pdf'"]},
    {"date": ["y || '-05-01'", "'unknown'", "'unknown'", "y || '-01-02'"], "type": ["'TT'", "'QD'", "'unknown'", "'ND'"], "authority": ["'BTP'", "'TTg'", "'unknown'", "'CP'"], "doc_number": ["nn || '/' || y || '/TT-BTP'", "nn || '/QD-TTg'", "''", "n || '/' || y || '/ND-CP'"]},
    lambda x: x.withColumn("m", t.file_metadata(F.col("s"))).select("i", "m.*"),
)
bound(
    "fn18_number_from_path",
    {"s": ["'a/QCVN' || nn || '-' || y || '-BXD.json'", "'Luat_' || n || '-' || y || '-QH13_x.md'", "'x/QD' || nn || '-' || y || '-TTg.md'", "'QD' || nn || '-TTg.json.bak'", "'notes' || '.md'"]},
    {"number": ["'QCVN ' || nn || ':' || y || '/BXD'", "n || '/' || y || '/QH13'", "nn || '/' || y || '/QĐ-TTg'", "nn || '/QĐ-TTg'", None]},
    value("number", u.number_from_path),
)
bound("sc1_reader_dispatch", {"path": ["'a' || n || '.pdf'", "'b' || n || '.DOCX'", "'c.d' || n || '/e.md'", "'d' || n || '.zip'", "'noext' || n"]}, {"route": ["'pdf'", "'word'", "'markdown'", "'failed'", "'failed'"], "error": [None, None, None, "'unsupported format: zip'", "'unsupported format: '"]}, rd.routed)

# Words, numbers and measures.
bound("fn2_diacritic_fold", {"s": ["'Điều ' || n || ' KHOẢN'", "'Thông tư ' || m", "'Nghị định ' || y || ' Ưỡng'"]}, {"folded": ["'dieu ' || n || ' khoan'", "'thong tu ' || m", "'nghi dinh ' || y || ' uong'"]}, value("folded", t.fold))
bound("fn3_integer_token", {"s": ["'00' || n", "' ' || n || ' '", "'000'", "'0' || n || '0'"]}, {"n_": ["n", "n", "'0'", "n || '0'"]}, value("n_", t.integer_token))
bound("fn7_polarity", {"s": ["'Nghiêm cấm hút thuốc ở tầng ' || n", "'Được phép xây dựng ' || n || ' tầng'", "'Chiều cao không quá ' || n || ' m'", "'Không được xây ' || n", "''"]}, {"polarity": ["'-1'", "'1'", "'0'", "'-1'", "'0'"]}, value("polarity", t.polarity))
bound("fn5_measures", {"s": ["'cao 5' || n || ' m và ' || m || ',50 mét, 5' || n || ' met'", "'1.5 m² nặng ' || n || ' kg'", "'không có ' || n"]}, {"found": ["list_aggregate(list_sort(['m=5' || n, 'm=' || m || '.5']), 'string_agg', ',')", "'kg=' || n || ',m2=1.5'", "''"]}, value("found", lambda c: F.array_join(F.array_sort(t.measures(c)), ",")))
bound("fn6_measure_relation", {"a": ["'cao ' || n || ' m'", "'cao ' || n || ' m'", "'cao ' || n || ' m, ' || p || ' m'"], "b": ["'cao ' || p || ' m'", "'nặng ' || n || ' kg'", "'cao ' || p || ' m'"]}, {"relation": ["'conflict'", "'unsupported'", "'ok'"]}, lambda x: x.withColumn("relation", t.measure_relation(F.col("a"), F.col("b"))))
bound("fn33_hop_coercion", {"s": ["n", "'true'", "n || '.0'", "n || '.5'", "' ' || n"]}, {"hop": ["n", None, "n", None, "n"]}, value("hop", t.coerced_hop))

# Questions, references and claims.
_ASKED = ["''", "'so sánh ' || n || '/' || y || '/NĐ-CP và ' || p || '/' || y || '/NĐ-CP'", "'QCVN ' || nn || ':2022 và QCVN ' || lpad(p, 2, '0') || ':2023'", "'Điều ' || n || ' nói gì'", "'1' || nn || '/QĐ-TTg'", "'sửa đổi nghị định'", "'trước ngày ban hành'", "'\"phòng cháy ' || n || ' chữa cháy\"'", "'giấy phép xây dựng'", "'khác nhau giữa hai loại'"]
_INTENTS = ["semantic", "complex", "complex", "exact", "exact", "complex", "complex", "exact", "semantic", "complex"]
_RULES = ["empty_query", "multiple_doc_refs", "multiple_doc_refs", "article_reference", "doc_number_no_year", "amendment_keyword", "timeline_keyword", "quoted_exact_term", "default_semantic", "comparison_keyword"]
bound("cl5_query_intent", {"s": _ASKED}, {"intent": [f"'{x}'" for x in _INTENTS], "rule": [f"'{x}'" for x in _RULES]}, lambda x: x.withColumn("c", o.query_intent(F.col("s"))).select("i", "c.intent", "c.rule"))
bound("cl6_fusion_weights", {"s": _ASKED}, {"weights": [{"semantic": "'0.6,0.4'", "complex": "'0.7,0.3'", "exact": "'0.3,0.7'"}[x] for x in _INTENTS]}, value("weights", lambda c: F.array_join(o.fusion_weights(o.query_intent(c)["intent"]).cast("array<string>"), ",")))
bound(
    "fn4_reference_extraction",
    {"s": ["'theo QCVN ' || nn || ':2022/BXD và QCVN ' || n || ':2022'", "'Nghị định 1' || nn || '/2021/NĐ-CP, ' || nn || '/2024/TT-BXD'", "'không ' || n"]},
    {"refs": ["'qcvn ' || n || ':2022'", "'nd 1' || nn || ':2021,tt ' || n || ':2024'", "''"]},
    value("refs", lambda c: F.array_join(F.array_sort(g.references(c)), ",")),
)
_CITED = {
    "claim": ["'Theo Điều ' || n || ' QCVN 06:2022'", "'Điều ' || n || ' QCVN 06:2022'", "'TCVN 7336:2021'", "'Chiều cao nhà theo Điều ' || n || ' là 50 m'", "'Điều ' || n || ' khoản 2'"],
    "doc_number": ["'QCVN 06:2022/BXD'", "'QCVN 06:2022/BXD'", "'QCVN 06:2022/BXD'", "''", "''"],
    "hierarchy_path": ["'Chương 1 -> Điều ' || p", "'Điều ' || n", "''", "'Điều ' || n", "'Điều ' || n"],
}
bound("cv1_identifier_check", _CITED, {"tier0": ["'rejected_mismatch'", "'verified_pointer'", "'rejected_mismatch'", None, "'unverified'"]}, g.identifier_check)
bound("mx42_pointer_gaps", _CITED, {"incomplete": ["'false'", "'false'", "'false'", "'false'", "'true'"]}, lambda x: g.identifier_check(x).withColumn("incomplete", F.coalesce(F.col("tier0") == "unverified", F.lit(False)).cast("string")))
bound("cv2_proposition", {"s": ["'Theo Điều ' || n || ' QCVN 06:2022, chiều cao không quá ' || m || ' m.'", "'cửa số ' || n || ' mở ra ngoài (khoản 3 Điều ' || m || ')'", "'plain ' || n"]}, {"prop": ["'chiều cao không quá ' || m || ' m'", "'cửa số ' || n || ' mở ra ngoài'", "'plain ' || n"]}, value("prop", g.proposition))
_SAID = {
    "premise": ["'Chiều cao nhà không quá ' || n || ' m'", "'Được phép xây tường gạch bao quanh nhà số ' || n", "'Hành lang rộng ' || n || ' m dùng chung cho tầng'", "'Cửa thoát nạn mở ra ngoài'", "'Cửa thoát nạn mở ra ngoài'"],
    "hypothesis": ["'Chiều cao nhà không quá ' || p || ' m'", "'Cấm xây tường gạch bao quanh nhà số ' || n", "'Hành lang rộng ' || n || ' m dùng chung cho tầng'", "''", "'Máy bơm dự phòng đặt riêng biệt'"],
}
bound("cv3_entailment_decision", _SAID, {"status": ["'rejected_contradiction'", "'rejected_contradiction'", "'verified_entailment'", "'unverified'", "'unverified'"]}, o.heuristic_entailment)
bound("cv4_heuristic_entailment", _SAID, {"told": ["'0.040,0.080,0.880'", "'0.040,0.080,0.880'", "'0.950,0.020,0.030'", "'0.050,0.900,0.050'", "'0.120,0.800,0.080'"]}, lambda x: o.heuristic_entailment(x).withColumn("told", F.array_join(F.transform("probs", lambda v: F.format_string("%.3f", v)), ",")))
bound("ru8_repealed_citation", {"c": ["'Thông tư 06/2021/tt-bxd, Điều ' || n", "'06/2021/TT-BXD'", "nn || '/2025/TT-BXD'"], "a": ["'2026-08-' || lpad(CAST(CAST(n AS INT) % 28 + 1 AS STRING), 2, '0')", "y || '-01-01'", "'2026-08-01'"]}, {"flag": ["'true'", "'false'", "'false'"]}, lambda x: x.withColumn("flag", r.repealed_citation(F.col("c"), F.col("a").cast("date")).cast("string")))
bound(
    "ru2_normative_force",
    {"id": ["'QCVN ' || nn || ':' || y || '/BXD'", "'Luật số ' || n", "n || '/' || y || '/nđ-cp'", "'TCVN 7336:' || y", "'TCVN 9' || nn || 'x'", "'TCVN 9' || nn || 'x'", "'TCCS ' || n", "'TCCS ' || n"], "cited": ["'n'", "'n'", "'n'", "'n'", "'y'", "'n'", "'y'", "'n'"], "contract": ["'n'", "'n'", "'n'", "'n'", "'n'", "'n'", "'n'", "'y'"]},
    {"force": ["'mandatory'", "'mandatory'", "'mandatory'", "'mandatory_by_reference'", "'mandatory_by_reference'", "'voluntary'", "'voluntary'", "'contract_adopted'"]},
    lambda x: x.withColumn("force", r.normative_force(F.col("id"), F.col("cited") == "y", F.col("contract") == "y")),
)

# Structure of pages and chunks.
bound("pf7_table_predicate", {"s": [_lines("'| a | ' || n || ' |'", "'|---|---|'", "'| 1 | 2 |'"), "'plain text of page ' || n", "'flagged'"], "f": ["'n'", "'n'", "'y'"]}, {"is_table": ["'true'", "'false'", "'true'"]}, lambda x: x.withColumn("is_table", g.is_table(F.col("s"), F.col("f") == "y").cast("string")))
bound("pf12_contents_page", {"s": [_lines("'One .... ' || n", "'Two .... ' || p", "'Three ..... ' || y", "'text'"), _lines("'One .... ' || n", "'prose'", "'prose'", "'prose'")]}, {"toc": ["'true'", "'false'"]}, value("toc", g.is_contents_page))
bound("pf4_noise_chunks", {"s": ["'short ' || n", "'[d1] KT. BỘ TRƯỞNG Nguyễn Văn A và ' || n || ' thành viên khác'", "'Điều ' || n || '. Phạm vi điều chỉnh của nghị định này là các công trình dân dụng'", "'Kính gửi: Các đơn vị trực thuộc trong toàn thành phố ' || y"]}, {"noise": ["'true'", "'true'", "'false'", "'true'"]}, value("noise", o.is_noise))
bound("fn20_heading", {"s": ["'A -> ' || n || '.2 Scope'", "'Preamble'", "'A -> B -> ' || n || '.2.3 Deep'"]}, {"h": ["'### ' || n || '.2 Scope'", "'## Preamble'", "'#### ' || n || '.2.3 Deep'"]}, value("h", g.heading_of))
bound("fn19_parent_clause", {"s": ["'d' || n || '-p2'", "n || '-2-3'", "'x' || n"]}, {"parent": ["'d' || n", "n || '-2'", None]}, value("parent", g.parent_clause))
bound("fn22_json_extraction", {"s": ["'text ```json' || chr(10) || '{\"a\": ' || n || '}' || chr(10) || '``` {\"z\": 9}'", "'{bad} then {\"b\": ' || n || '}'", "'none ' || n"]}, {"j": ["'{\"a\": ' || n || '}'", "'{\"b\": ' || n || '}'", None]}, value("j", g.json_in_text))
bound("fn21_front_matter_strip", {"s": [_lines("'---'", "'title: ' || n", "'---'", "'body ' || m"), "'no matter ' || n", _lines("'\ufeff---'", "'a: ' || n", "'---'", "'x' || m")]}, {"body": ["'body ' || m", "'no matter ' || n", "'x' || m"]}, value("body", t.front_matter_stripped))
bound("fn23_safe_json", {"s": ["'[' || n || ',2,' || m || ',4]'", "'oops ' || n"]}, {"bbox": ["'[' || n || ',2,' || m || ',4]'", "'[0,0,1000,1000]'"]}, value("bbox", lambda c: F.to_json(F.coalesce(F.from_json(c, "array<int>"), F.array(*[F.lit(v) for v in (0, 0, 1000, 1000)])))))
bound("mx32_table_signals", {"s": ["'tải ≤ ' || n || ' kN/m'", "'STT, Đơn vị ' || n", "'văn bản STT'"]}, {"signals": ["'true'", "'true'", "'false'"]}, value("signals", u.table_signals))
bound("mx33_fragmented_line", {"s": ["n || ',5 / ' || m", "'D' || n || ' x'", "'một câu dài ' || n || ' chữ'", "' '"]}, {"fragment": ["'true'", "'true'", "'false'", "'false'"]}, value("fragment", u.fragmented_line))
bound("mx25_xml_fence", {"s": ["'a' || n || ' <?xml v?><b/>'", "'plain ' || n"]}, {"fenced": ["'a' || n || ' ```xml' || chr(10) || '<?xml v?><b/>' || chr(10) || '```'", "'plain ' || n"]}, value("fenced", u.fenced_xml))
bound("mx9_table_text_clean", {"s": [_lines("'a' || n", "m", "''", "''", "'b' || n"), _lines("'  x' || n || ' '", "' ' || m")]}, {"clean": [_lines("'a' || n", "''", "'b' || n"), "'x' || n"]}, value("clean", lambda c: F.regexp_replace(u.table_text_clean(c), r"\s+$", "")))
bound("mx35_report_scores", {"s": [_lines("'# Report'", "'- Markdown: **' || n || '/100**'", "'- JSON: ' || m || '/100'", "'text'")]}, {"scores": ["'json=' || m || ',markdown=' || n"]}, value("scores", lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(u.report_scores(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")))
bound("tx12_header_boilerplate", {"s": [_lines("'CHÍNH PHỦ'", "'Số: ' || nn || '/NĐ-CP'", "''", "'Điều ' || n || '. Nội dung chính của văn bản'"), "'Không có gì để bỏ ở đây ' || n"]}, {"s_": ["'Điều ' || n || '. Nội dung chính của văn bản'", "'Không có gì để bỏ ở đây ' || n"]}, value("s_", lambda c: lp.apply(c, lp.strip_header)))
bound("tx13_recipient_list", {"s": [_lines("'a' || n", "'Nơi nhận:'", "'- Bộ A;'", "'- Lưu VT.'", "'b' || n"), "'no list ' || n"]}, {"s_": [_lines("'a' || n", "'b' || n"), "'no list ' || n"]}, value("s_", lambda c: lp.apply(c, lp.strip_recipients)))
bound("wn16_cross_page_join", {"s": ["'ends within' || n || '|the sentence.' || chr(10) || 'New'", "'Ends.|Starts' || n"]}, {"pages": ["'ends within' || n || ' the sentence.|New'", "'Ends.|Starts' || n"]}, value("pages", lambda c: F.array_join(F.udf(lp.joined_pages, "array<string>", useArrow=True)(F.split(c, r"\|")), "|")))


def _counted(chunks: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """How many chunks each row gives, none counted as well."""
    return lambda x: x.select("i").join(chunks(x).groupBy("i").agg(F.count("*").alias("c")), "i", "left").select("i", F.coalesce("c", F.lit(0)).cast("string").alias("count"))


bound("ch5_numbered_sections", {"s": [_lines("'Head ' || n", "'1. Scope'", "'text'", "'2. Terms'", "'text ' || m"), "'1. Only one ' || n", _lines("'Điều ' || n", "'1. A'", "'2. B'")]}, {"count": ["'3'", "'0'", "'0'"]}, _counted(lambda x: u.numbered_sections(x, "i", "s")))
bound("ch6_form_fields", {"s": [_lines("'Kính gửi'", "'1. Họ và tên: Nguyễn Văn A sinh năm ' || y", "'2. Nơi ở: số 12 đường Láng, Hà Nội, Việt Nam ' || n"), _lines("'1. a' || n", "'2. b'")]}, {"count": ["'2'", "'0'"]}, _counted(lambda x: u.form_fields(x, "i", "s", "Kính gửi|Họ và tên|Nơi ở")))
bound("pf11_broken_blocks", {"s": [_lines("'a' || n", "'| 1 | ' || n || ' |'", "'| 3 | 4 |'", "'b'", "'| h | i |'", "'| --- | --- |'", "'| 1 | 2 |'"), _lines("'| one |'", "'text ' || n")]}, {"count": ["'1'", "'0'"]}, lambda x: x.select("i").join(g.broken_blocks(x, "i", "s"), "i", "left").select("i", F.coalesce("broken", F.lit(0)).cast("string").alias("count")))
bound("ch4_forward_merge", {"s": ["'short' || n || '|' || repeat('a', 90) || '|' || repeat('b', 100)", "'s1|s' || n || '|' || repeat('c', 80)"]}, {"count": ["'2'", "'1'"]}, value("count", lambda c: F.size(u.forward_merged(F.split(c, r"\|")))))
bound("wn17_segment_merge", {"s": ["repeat('a', 200) || '|' || repeat('b', 150) || '|' || repeat('c', 310) || n", "repeat('a', 320) || '|short' || n", "' | '"]}, {"count": ["'2'", "'1'", "'0'"]}, value("count", lambda c: F.size(o.merged_segments(F.split(c, r"\|")))))
