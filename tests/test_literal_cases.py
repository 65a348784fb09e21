"""Operators on single identifiers, texts and claims, with answers written out by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import line_passes as lp
from lexiquarry.functions import text as t
from lexiquarry.operators import documents as o
from lexiquarry.operators import legal as g
from lexiquarry.operators import rules as r
from lexiquarry.operators import upkeep as u
from lexiquarry.plans.registry import Registry
from lexiquarry.sources import readers as rd

reg = Registry()


def inline(spark, values: list[tuple], names: str):
    """Rows with their number ``i``."""
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"{n} string" for n in names.split()))


def q(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def answers(values: list[tuple], names: str) -> str:
    """SQL of expected rows: i and columns, all text."""
    rows = ", ".join(f"({i}, " + ", ".join(q(x) for x in v) + ")" for i, v in enumerate(values))
    return f"SELECT * FROM (VALUES {rows}) AS t(i, {names.replace(' ', ', ')})"


_QUERIES = ["", "so sánh 87/2023/NĐ-CP và 88/2023/NĐ-CP", "QCVN 06:2022 và QCVN 07:2023", "Điều 15 nói gì", "1417/QĐ-TTg", "sửa đổi nghị định", "trước ngày ban hành", "\"phòng cháy chữa cháy\"", "giấy phép xây dựng", "khác nhau giữa hai loại"]
_INTENT = [("semantic", "0.5", "empty_query"), ("complex", "0.85", "multiple_doc_refs"), ("complex", "0.85", "multiple_doc_refs"), ("exact", "0.9", "article_reference"), ("exact", "0.9", "doc_number_no_year"), ("complex", "0.85", "amendment_keyword"), ("complex", "0.85", "timeline_keyword"), ("exact", "0.9", "quoted_exact_term"), ("semantic", "0.75", "default_semantic"), ("complex", "0.85", "comparison_keyword")]


_IDS = ["QCVN 06:2020/BXD", "qcvn-1-2019-bxd", "TCVN 7336:2021", "TCVN ISO 19650-1:2021", "TCXDVN 33:2006", "15/2021/NĐ-CP", "10_2021_nd_cp", "VBPL/a b", "free text", ""]


_CLAIMS = [("Chiều cao nhà không quá 50 m", "Chiều cao nhà không quá 75 m"), ("Được phép xây tường gạch bao quanh nhà", "Cấm xây tường gạch bao quanh nhà"), ("Hành lang rộng 2 m dùng chung cho tầng", "Hành lang rộng 2 m dùng chung cho tầng"), ("Cửa thoát nạn mở ra ngoài", ""), ("Cửa thoát nạn mở ra ngoài", "Máy bơm dự phòng đặt riêng biệt")]


_CITE = [("Theo Điều 5 QCVN 06:2022", "QCVN 06:2022/BXD", "Chương 1 -> Điều 7"), ("Điều 5 QCVN 06:2022", "QCVN 06:2022/BXD", "Điều 5"), ("TCVN 7336:2021", "QCVN 06:2022/BXD", ""), ("Chiều cao nhà theo Điều 5 là 50 m", "", "Điều 5"), ("Điều 5 khoản 2", "", "Điều 5")]


_KINDS = [("16/2025/NĐ-CP", "", "", ""), ("", "QCVN 06.pdf", "", "BXD"), ("", "TT01-2023-BTP.pdf", "", "BTP"), ("TB340", "", "", ""), ("", "a/QD08.docx", "", "UBND Hà Nội"), ("", "x.pdf", "theo 12/2020/QH14", "BTC"), ("", "readme.md", "", ""), ("01/2024/TT-BXD", "y.pdf", "", "hđnd tỉnh")]


@reg("cl1_document_type", answers([("NGHI_DINH",), ("QCVN",), ("THONG_TU",), ("THONG_BAO",), ("QUYET_DINH",), ("NGHI_QUYET",), ("VAN_BAN",), ("THONG_TU",)], "doc_type"))
def cl1(spark, d):
    k = inline(spark, _KINDS, "number file head authority")
    return k.select("i", o.document_type(F.col("number"), F.col("file"), F.col("head")).alias("doc_type"))


@reg("cl2_legal_level", answers([("NGHI_DINH",), ("KY_THUAT",), ("THONG_TU",), ("THONG_TU",), ("DIA_PHUONG",), ("NGHI_QUYET",), ("UNKNOWN",), ("DIA_PHUONG",)], "legal_level"))
def cl2(spark, d):
    k = inline(spark, _KINDS, "number file head authority")
    return k.select("i", o.legal_level(o.document_type(F.col("number"), F.col("file"), F.col("head")), F.col("authority")).alias("legal_level"))


@reg("cl3_discipline", answers([("TONG_HOP",), ("XAY_DUNG",), ("TU_PHAP",), ("TONG_HOP",), ("TONG_HOP",), ("TAI_CHINH",), ("TONG_HOP",), ("XAY_DUNG",)], "discipline"))
def cl3(spark, d):
    k = inline(spark, _KINDS, "number file head authority")
    return k.select("i", o.discipline(F.col("authority"), F.col("number"), F.col("file")).alias("discipline"))


@reg("mx34_taxonomy_bundle", answers([("NGHI_DINH NGHI_DINH TONG_HOP",), ("QCVN KY_THUAT XAY_DUNG",), ("THONG_TU THONG_TU TU_PHAP",), ("THONG_BAO THONG_TU TONG_HOP",), ("QUYET_DINH DIA_PHUONG TONG_HOP",), ("NGHI_QUYET NGHI_QUYET TAI_CHINH",), ("VAN_BAN UNKNOWN TONG_HOP",), ("THONG_TU DIA_PHUONG XAY_DUNG",)], "labels"))
def mx34(spark, d):
    k = inline(spark, _KINDS, "number file head authority").withColumn("kind", o.document_type(F.col("number"), F.col("file"), F.col("head")))
    return k.select("i", F.concat_ws(" ", "kind", o.legal_level(F.col("kind"), F.col("authority")), o.discipline(F.col("authority"), F.col("number"), F.col("file"))).alias("labels"))


@reg("cl5_query_intent", answers(_INTENT, "intent confidence rule"))
def cl5(spark, d):
    x = inline(spark, [(s,) for s in _QUERIES], "query").select("i", o.query_intent(F.col("query")).alias("c"))
    return x.select("i", "c.intent", F.col("c.confidence").cast("string").alias("confidence"), "c.rule")


@reg("cl6_fusion_weights", answers([("0.6,0.4",), ("0.7,0.3",), ("0.7,0.3",), ("0.3,0.7",), ("0.3,0.7",), ("0.7,0.3",), ("0.7,0.3",), ("0.3,0.7",), ("0.6,0.4",), ("0.7,0.3",)], "weights"))
def cl6(spark, d):
    x = inline(spark, [(s,) for s in _QUERIES], "query")
    return x.select("i", F.array_join(o.fusion_weights(o.query_intent(F.col("query"))["intent"]).cast("array<string>"), ",").alias("weights"))


@reg("fn15_canonical_id", answers([("VBPL/QCVN_06_2020/BXD",), ("VBPL/QCVN_01_2019/BXD",), ("VBPL/TCVN_7336_2021",), ("VBPL/TCVN_ISO_19650-1_2021",), ("VBPL/TCXDVN_33_2006",), ("VBPL/15/2021/NĐ-CP",), ("VBPL/10/2021/NĐ-CP",), ("VBPL/a_b",), ("VBPL/free_text",), ("",)], "canonical"))
def fn15(spark, d):
    return inline(spark, [(x,) for x in _IDS], "id").select("i", t.canonical_id(F.col("id")).alias("canonical"))


@reg("fn14_document_id", answers([("vb/16/2025/NĐ-CP",), ("vb/my_file",), ("vb/draft_my_file",), ("fixed",), ("vb/QCVN_06_2022",)], "doc_id"))
def fn14(spark, d):
    x = inline(spark, [("vb", "16/2025/NĐ-CP", "a.pdf", None), ("vb", "", "my file.pdf", None), ("vb", "draft", "my file.pdf", ""), ("vb", "1/2", "a", "fixed"), ("vb", "QCVN 06:2022", "a.pdf", None)], "ns number file override")
    return x.select("i", t.document_id(F.col("ns"), F.col("number"), F.col("file"), F.col("override")).alias("doc_id"))


@reg("fn17_file_metadata", answers([("2023-05-01", "TT", "BTP", "01/2023/TT-BTP"), ("unknown", "QD", "TTg", "08/QD-TTg"), ("unknown", "unknown", "unknown", ""), ("2020-01-02", "ND", "CP", "15/2020/ND-CP")], "date type authority doc_number"))
def fn17(spark, d):
    x = inline(spark, [("20230501_TT01-2023-BTP.pdf",), ("QD08-TTg.docx",), ("notes.txt",), ("20200102-ND15-CP.pdf",)], "file").select("i", t.file_metadata(F.col("file")).alias("m"))
    return x.select("i", "m.*")


@reg("fn2_diacritic_fold", answers([("dieu 15 khoan",), ("thong tu",), ("nghi dinh",)], "folded"))
def fn2(spark, d):
    return inline(spark, [("Điều 15 KHOẢN",), ("Thông tư",), ("Nghị định",)], "s").select("i", t.fold(F.col("s")).alias("folded"))


@reg("fn3_integer_token", answers([("7",), ("0",), ("12",)], "n"))
def fn3(spark, d):
    return inline(spark, [("007",), ("000",), (" 12",)], "s").select("i", t.integer_token(F.col("s")).alias("n"))


@reg("fn7_polarity", answers([("-1",), ("1",), ("0",), ("0",)], "polarity"))
def fn7(spark, d):
    x = inline(spark, [("Nghiêm cấm hút thuốc",), ("Được phép xây dựng",), ("Chiều cao không quá 50 m",), ("",)], "s")
    return x.select("i", t.polarity(F.col("s")).cast("string").alias("polarity"))


@reg("fn5_measures", answers([("m=50,m=7.5",), ("kg=3,m2=1.5",), ("",)], "found"))
def fn5(spark, d):
    x = inline(spark, [("cao 50 m và 7,50 mét, 50 met",), ("1.5 m² nặng 3 kg",), ("không có",)], "s")
    return x.select("i", F.array_join(F.array_sort(t.measures(F.col("s"))), ",").alias("found"))


@reg("fn6_measure_relation", answers([("conflict",), ("unsupported",), ("ok",)], "relation"))
def fn6(spark, d):
    x = inline(spark, [("cao 50 m", "cao 75 m"), ("cao 50 m", "nặng 3 kg"), ("cao 50 m, 75 m", "cao 75 m")], "p h")
    return x.select("i", t.measure_relation(F.col("p"), F.col("h")).alias("relation"))


@reg("cv3_entailment_decision", answers([("rejected_contradiction",), ("rejected_contradiction",), ("verified_entailment",), ("unverified",), ("unverified",)], "status"))
def cv3(spark, d):
    return o.heuristic_entailment(inline(spark, _CLAIMS, "premise hypothesis")).select("i", "status")


@reg("cv4_heuristic_entailment", answers([("0.040,0.080,0.880",), ("0.040,0.080,0.880",), ("0.950,0.020,0.030",), ("0.050,0.900,0.050",), ("0.120,0.800,0.080",)], "probs"))
def cv4(spark, d):
    p = F.array_join(F.transform("probs", lambda x: F.format_string("%.3f", x)), ",")
    return o.heuristic_entailment(inline(spark, _CLAIMS, "premise hypothesis")).select("i", p.alias("probs"))


@reg("fn21_front_matter_strip", answers([("body\n",), ("no matter",), ("x",)], "body"))
def fn21(spark, d):
    return inline(spark, [("---\ntitle: a\n---\nbody\n",), ("no matter",), ("﻿---\na: 1\n---\nx",)], "s").select("i", t.front_matter_stripped(F.col("s")).alias("body"))


@reg("fn23_safe_json", answers([("[1,2,3,4]",), ("[0,0,1000,1000]",)], "bbox"))
def fn23(spark, d):
    x = inline(spark, [("[1,2,3,4]",), ("oops",)], "s")
    return x.select("i", F.to_json(F.coalesce(F.from_json("s", "array<int>"), F.array(*[F.lit(v) for v in (0, 0, 1000, 1000)]))).alias("bbox"))


@reg("fn33_hop_coercion", answers([("2",), (None,), ("3",), (None,)], "hop"))
def fn33(spark, d):
    return inline(spark, [("2",), ("true",), ("3.0",), ("2.5",)], "s").select("i", t.coerced_hop(F.col("s")).cast("string").alias("hop"))


@reg("pf4_noise_chunks", answers([("true",), ("true",), ("false",), ("true",)], "noise"))
def pf4(spark, d):
    x = inline(spark, [("short",), ("[d1] KT. BỘ TRƯỞNG Nguyễn Văn A và các thành viên khác",), ("Điều 1. Phạm vi điều chỉnh của nghị định này là các công trình dân dụng",), ("Kính gửi: Các đơn vị trực thuộc trong toàn thành phố",)], "s")
    return x.select("i", o.is_noise(F.col("s")).cast("string").alias("noise"))


@reg("wn17_segment_merge", answers([("2",), ("1",), ("0",)], "n"))
def wn17(spark, d):
    x = inline(spark, [("a" * 200 + "|" + "b" * 150 + "|" + "c" * 310,), ("a" * 320 + "|short",), (" | ",)], "s")
    return x.select("i", F.size(o.merged_segments(F.split("s", r"\|"))).cast("string").alias("n"))


@reg("fn4_reference_extraction", answers([("qcvn 6:2022",), ("nd 15:2021,tt 1:2024",), ("",)], "refs"))
def fn4(spark, d):
    x = inline(spark, [("theo QCVN 06:2022/BXD và QCVN 6:2022",), ("Nghị định 15/2021/NĐ-CP, 01/2024/TT-BXD",), ("không",)], "s")
    return x.select("i", F.array_join(F.array_sort(g.references(F.col("s"))), ",").alias("refs"))


@reg("cv1_identifier_check", answers([("rejected_mismatch",), ("verified_pointer",), ("rejected_mismatch",), (None,), ("unverified",)], "tier0"))
def cv1(spark, d):
    return g.identifier_check(inline(spark, _CITE, "claim doc_number hierarchy_path")).select("i", "tier0")


@reg("mx42_pointer_gaps", answers([("false",), ("false",), ("false",), ("false",), ("true",)], "incomplete"))
def mx42(spark, d):
    x = g.identifier_check(inline(spark, _CITE, "claim doc_number hierarchy_path"))
    return x.select("i", F.coalesce(F.col("tier0") == "unverified", F.lit(False)).cast("string").alias("incomplete"))


@reg("cv2_proposition", answers([("chiều cao không quá 50 m",), ("cửa mở ra ngoài",), ("plain",)], "prop"))
def cv2(spark, d):
    x = inline(spark, [("Theo Điều 5 QCVN 06:2022, chiều cao không quá 50 m.",), ("cửa mở ra ngoài (khoản 3 Điều 2)",), ("plain",)], "s")
    return x.select("i", g.proposition(F.col("s")).alias("prop"))


@reg("pf7_table_predicate", answers([("true",), ("false",), ("true",)], "is_table"))
def pf7(spark, d):
    x = inline(spark, [("| a | b |\n|---|---|\n| 1 | 2 |", "n"), ("plain text of a page", "n"), ("flagged", "y")], "s f")
    return x.select("i", g.is_table(F.col("s"), F.col("f") == "y").cast("string").alias("is_table"))


@reg("pf12_contents_page", answers([("true",), ("false",)], "toc"))
def pf12(spark, d):
    x = inline(spark, [("One .... 1\nTwo .... 12\nThree ..... 30\ntext",), ("One .... 1\nprose\nprose\nprose",)], "s")
    return x.select("i", g.is_contents_page(F.col("s")).cast("string").alias("toc"))


@reg("pf11_broken_blocks", answers([("1",), ("0",)], "broken"))
def pf11(spark, d):
    x = inline(spark, [("a\n| 1 | 2 |\n| 3 | 4 |\nb\n| h | i |\n| --- | --- |\n| 1 | 2 |",), ("| one |\ntext",)], "s")
    return x.select("i").join(g.broken_blocks(x, "i", "s"), "i", "left").select("i", F.coalesce("broken", F.lit(0)).cast("string").alias("broken"))


@reg("fn20_heading", answers([("### 1.2 Scope",), ("## Preamble",), ("#### 1.2.3 Deep",)], "h"))
def fn20(spark, d):
    return inline(spark, [("A -> 1.2 Scope",), ("Preamble",), ("A -> B -> 1.2.3 Deep",)], "p").select("i", g.heading_of(F.col("p")).alias("h"))


@reg("fn19_parent_clause", answers([("d5",), ("1-2",), (None,)], "parent"))
def fn19(spark, d):
    return inline(spark, [("d5-p2",), ("1-2-3",), ("x",)], "c").select("i", g.parent_clause(F.col("c")).alias("parent"))


@reg("fn22_json_extraction", answers([('{"a": 1}',), ('{"b": 2}',), (None,)], "j"))
def fn22(spark, d):
    return inline(spark, [('text ```json\n{"a": 1}\n``` {"z": 9}',), ('{bad} then {"b": 2}',), ("none",)], "s").select("i", g.json_in_text(F.col("s")).alias("j"))


@reg("mx9_table_text_clean", answers([("a\n\nb",), ("x",)], "s"))
def mx9(spark, d):
    return inline(spark, [("a\n12\n\n\nb",), ("  x \n 7",)], "s").select("i", F.regexp_replace(u.table_text_clean(F.col("s")), r"\s+$", "").alias("s"))


@reg("mx32_table_signals", answers([("true",), ("true",), ("false",)], "signals"))
def mx32(spark, d):
    return inline(spark, [("tải ≤ 5 kN/m",), ("STT, Đơn vị",), ("văn bản STT",)], "s").select("i", u.table_signals(F.col("s")).cast("string").alias("signals"))


@reg("mx33_fragmented_line", answers([("true",), ("true",), ("false",), ("false",)], "fragment"))
def mx33(spark, d):
    return inline(spark, [("12,5 / 7",), ("D12 x",), ("một câu dài 12 chữ",), (" ",)], "s").select("i", u.fragmented_line(F.col("s")).cast("string").alias("fragment"))


@reg("fn18_number_from_path", answers([("QCVN 06:2022/BXD",), ("50/2014/QH13",), ("08/2023/QĐ-TTg",), ("08/QĐ-TTg",), (None,)], "number"))
def fn18(spark, d):
    return inline(spark, [("a/QCVN06-2022-BXD.json",), ("Luat_50-2014-QH13_x.md",), ("x/QD08-2023-TTg.md",), ("QD08-TTg.json.bak",), ("notes.md",)], "p").select("i", u.number_from_path(F.col("p")).alias("number"))


@reg("mx4_canonical_by_prefix", answers([("VBPL/55/2024/QH15",), ("VBPL/QCVN_06_2022/BXD",), ("VBPL/my_slug",), ("VBPL/my_slug",)], "id"))
def mx4(spark, d):
    return inline(spark, [("55/2024/QH15", "s"), ("QCVN 06:2022/BXD", "s"), ("draft", "my slug"), ("", "my slug")], "number slug").select("i", u.canonical_by_prefix(F.col("number"), F.col("slug")).alias("id"))


@reg("mx25_xml_fence", answers([("a ```xml\n<?xml v?><b/>\n```",), ("plain",)], "s"))
def mx25(spark, d):
    return inline(spark, [("a <?xml v?><b/>",), ("plain",)], "s").select("i", u.fenced_xml(F.col("s")).alias("s"))


@reg("ch5_numbered_sections", answers([("3",), ("0",), ("0",)], "n"))
def ch5(spark, d):
    x = inline(spark, [("Head\n1. Scope\ntext\n2. Terms\ntext",), ("1. Only one",), ("Điều 1\n1. A\n2. B",)], "s")
    n = u.numbered_sections(x, "i", "s").groupBy("i").agg(F.count("*").alias("n"))
    return x.select("i").join(n, "i", "left").select("i", F.coalesce("n", F.lit(0)).cast("string").alias("n"))


@reg("ch6_form_fields", answers([("2",), ("0",)], "n"))
def ch6(spark, d):
    x = inline(spark, [("Kính gửi\n1. Họ và tên: Nguyễn Văn A sinh năm 1990\n2. Nơi ở: số 12 đường Láng, Hà Nội, Việt Nam",), ("1. a\n2. b",)], "s")
    n = u.form_fields(x, "i", "s", "Kính gửi|Họ và tên|Nơi ở").groupBy("i").agg(F.count("*").alias("n"))
    return x.select("i").join(n, "i", "left").select("i", F.coalesce("n", F.lit(0)).cast("string").alias("n"))


@reg("ch4_forward_merge", answers([("2",), ("1",)], "n"))
def ch4(spark, d):
    x = inline(spark, [("short|" + "a" * 90 + "|" + "b" * 100,), ("s1|s2|" + "c" * 80,)], "s")
    return x.select("i", F.size(u.forward_merged(F.split("s", r"\|"))).cast("string").alias("n"))


@reg("mx35_report_scores", answers([("json=100,markdown=90",)], "scores"))
def mx35(spark, d):
    m = u.report_scores(F.col("s"))
    x = inline(spark, [("# Report\n- Markdown: **90/100**\n- JSON: 100/100\ntext",)], "s")
    return x.select("i", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("scores"))


@reg("tx12_header_boilerplate", answers([("Điều 1. Nội dung chính của văn bản",), ("Không có gì để bỏ ở đây",)], "s"))
def tx12(spark, d):
    return inline(spark, [("CHÍNH PHỦ\nSố: 12/NĐ-CP\n\nĐiều 1. Nội dung chính của văn bản",), ("Không có gì để bỏ ở đây",)], "s").select("i", lp.apply(F.col("s"), lp.strip_header).alias("s"))


@reg("tx13_recipient_list", answers([("a\nb",), ("no list",)], "s"))
def tx13(spark, d):
    return inline(spark, [("a\nNơi nhận:\n- Bộ A;\n- Lưu VT.\nb",), ("no list",)], "s").select("i", lp.apply(F.col("s"), lp.strip_recipients).alias("s"))


@reg("wn16_cross_page_join", answers([("ends within the sentence.|New",), ("Ends.|Starts",)], "pages"))
def wn16(spark, d):
    join = F.udf(lp.joined_pages, "array<string>", useArrow=True)
    return inline(spark, [("ends within|the sentence.\nNew",), ("Ends.|Starts",)], "s").select("i", F.array_join(join(F.split("s", r"\|")), "|").alias("pages"))


_FORCE = [("QCVN 06:2022/BXD", False, False), ("TCVN 7336:2021", False, False), ("TCVN 1234:2020", True, False), ("TCVN 1234:2020", False, False), ("ISO 9001", False, False), ("ISO 9001", False, True), ("16/2025/tt-bxd", False, False), (None, False, False)]


@reg("ru2_normative_force", answers([("mandatory",), ("mandatory_by_reference",), ("mandatory_by_reference",), ("voluntary",), ("voluntary",), ("contract_adopted",), ("mandatory",), ("voluntary",)], "force"))
def ru2(spark, d):
    v = spark.createDataFrame([(i, *x) for i, x in enumerate(_FORCE)], "i int, id string, cited boolean, contract boolean")
    return v.select("i", r.normative_force(F.col("id"), F.col("cited"), F.col("contract")).alias("force"))


@reg("ru8_repealed_citation", answers([("true",), ("false",), ("false",)], "flag"))
def ru8(spark, d):
    x = inline(spark, [("Thông tư 06/2021/tt-bxd", "2026-08-01"), ("06/2021/TT-BXD", "2025-01-01"), ("16/2025/TT-BXD", "2026-08-01")], "c a")
    return x.select("i", r.repealed_citation(F.col("c"), F.col("a").cast("date")).cast("string").alias("flag"))


@reg("sc1_reader_dispatch", answers([("pdf", None), ("word", None), ("markdown", None), ("failed", "unsupported format: zip"), ("failed", "unsupported format: ")], "route error"))
def sc1(spark, d):
    return rd.routed(inline(spark, [("a.pdf",), ("b.DOCX",), ("c.md",), ("d.zip",), ("noext",)], "path")).select("i", "route", "error")


@pytest.mark.parametrize("name", sorted(reg.queries))
def test_answers(spark, name):
    df = reg.queries[name](spark, "")
    columns = sorted(df.columns)
    want = duckdb.sql(reg.oracles[name])
    assert sorted(want.columns) == columns
    rows = want.select(*columns).fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, rows))
