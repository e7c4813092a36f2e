import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import expressions as X
from tallymark.operators import docindex, extraction


def one(spark, text):
    return extraction.fields(spark.createDataFrame([(text,)], "text string")).first()


def test_fields(spark):
    assert one(spark, "Invoice No: AB-12/7").invoice_number == "AB-12/7"
    r = one(spark, "Subtotal: $100.00\nTotal: $110.00")
    assert (r.total_amount, r.subtotal) == (100.0, 100.0)
    strict = extraction.fields(spark.createDataFrame([("Subtotal: $100.00\nTotal: $110.00",)], "text string"), strict=True).first()
    assert strict.total_amount == 110.0
    r = one(spark, "Rechnungsnummer: R-9\nGesamtbetrag: €1,234.50")
    assert (r.invoice_number, r.total_amount, r.currency) == ("R-9", 1234.5, "EUR")
    assert one(spark, "Total: 1.234,56").total_amount == 1.23
    empty = one(spark, "")
    assert all(empty[c] is None for c in extraction.PATTERNS)


@pytest.mark.parametrize(("text", "want"), [("03/04/2024", (2024, 3, 4)), ("13/02/2024", (2024, 2, 13)), ("1/2/70", (1970, 1, 2)), ("1/2/68", (2068, 1, 2)), ("5 March 2024", (2024, 3, 5)), ("nothing", None)])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.parse_date("t").alias("d")).first().d
    assert got == (dt.datetime(*want) if want else None)


def items(spark, text):
    return [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(extraction.line_items(F.col("t")).alias("x")).first().x]


def test_line_items(spark):
    assert items(spark, "2 Blue widget 3.00 6.00") == [(2, "Blue widget", 3.0, 6.0)]
    assert items(spark, "Blue widget 2 3.00 6.00") == [(2, "Blue widget", 3.0, 6.0)]
    assert items(spark, "Blue widget 2 3.00 6.00\nRed ring 1 4.00 4.00") == [(0, "Red ring", 1.0, 4.0)]
    assert items(spark, "") == []


def test_contents_equal_a_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for doc in range(40):
        stack = []
        for i in range(rng.randint(1, 30)):
            level = rng.randint(1, 3)
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[doc, i] = stack[-1][0] if stack else None
            stack.append((i, level))
            rows.append((doc, i, level))
    got = docindex.contents(spark.createDataFrame(rows, "document_id long, ord int, level int")).collect()
    assert {(r.document_id, r.ord): r.parent for r in got} == want


def test_sections_and_offsets(spark):
    def sections(text):
        return [(r.section_heading, r.level, r.text) for r in docindex.segment(spark.createDataFrame([(1, 1, text)], "document_id long, page_number int, text string")).orderBy("section_ord").collect()]

    assert sections("") == sections(None) == sections(" \n ") == [(None, 0, "")]
    assert sections("before\nPAYMENT TERMS\nNet 30\n2.1 Scope\nmore") == [(None, 0, "before"), ("PAYMENT TERMS", 1, "PAYMENT TERMS\nNet 30"), ("2.1 Scope", 2, "2.1 Scope\nmore")]
    assert sections("Total due: 5\n\nFirst Second Third\nInvoices\n 2 Indented\n3..1 No\nABCD\nTAX") == [("Total due: 5", 2, "Total due: 5"), ("First Second Third", 3, "First Second Third\nInvoices\n 2 Indented\n3..1 No\nABCD"), ("TAX", 2, "TAX")]
    parts = spark.createDataFrame([(1, 1, 0, None, "é"), (1, 1, 1, None, "ab")], "document_id long, page_number int, section_ord int, section_heading string, text string")
    assert [(r.byte_offset_start, r.byte_offset_end) for r in docindex.index(parts).orderBy("section_ord").collect()] == [(0, 2), (2, 4)]


def test_retrieval_score(spark):
    parts = spark.createDataFrame([(1, 1, 0, "PAYMENT TERMS", "PAYMENT TERMS\nNet 30")], "document_id long, page_number int, section_ord int, section_heading string, text string")
    idx = docindex.index(parts)
    assert docindex.retrieve(idx, "payment terms").first().relevance_score == 13
    assert docindex.retrieve(idx, "the of a").count() == 0


def test_content_type(spark):
    df = spark.createDataFrame([("1\n2\ntext",), ("a | b | c",), ("plain words",)], "t string")
    assert [r.k for r in df.select(docindex.content_type(F.col("t")).alias("k")).collect()] == ["table", "table", "text"]


def test_cross_reference(spark):
    inv = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0), (4, 5.0), (5, None)], "invoice_id long, total_amount double")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (3, 1), (3, 5)], "source_id long, target_id long")
    got = {(r.source_id, r.target_id): r.match_status for r in docindex.cross_reference(inv, pairs, "total_amount").collect()}
    assert got == {(1, 2): "mismatch", (3, 4): "match", (3, 1): "mismatch", (3, 5): "incomplete"}
    assert {r.match_status for r in docindex.cross_reference(inv, pairs, "payment_terms").collect()} == {"incomplete"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("INVOICE\nInvoice Date: 01/02/2024\nInvoice No: A-77", {"invoice_number": "A-77", "invoice_date": dt.datetime(2024, 1, 2)}),
        ("Invoice Date: 01/02/2024\nInvoice No: A-77", {"invoice_number": "A-77"}),
        ("inv no 55/B", {"invoice_number": "55/B"}),
        ("Numero de factura: 9-X\nTotal general 12.50", {"invoice_number": "9-X", "total_amount": 12.5}),
        ("Facture No. F-1\nDate d'echeance: 1/2/24", {"invoice_number": "F-1", "due_date": dt.datetime(2024, 1, 2)}),
        ("Fälligkeitsdatum 3.4.2024\nSous total: 5", {"due_date": dt.datetime(2024, 3, 4), "subtotal": 5.0}),
        ("# 123456\n3 Mar 2024", {"invoice_number": "123456", "invoice_date": dt.datetime(2024, 3, 3)}),
        ("tax (19%): 4.10", {"tax_amount": 4.1}),
        ("Sold by: Big & Co., Ltd.\nBill to: Jane Roe\nnet 15", {"vendor_name": "Big & Co., Ltd.", "buyer_name": "Jane Roe", "payment_terms": "net 15"}),
        ("Conditions de paiement: 30 jours\nmoneda: chf", {"payment_terms": "30 jours", "currency": "CHF"}),
        ("costs 5 € or $6", {"currency": "USD"}),
    ],
)
def test_labels_of_every_language(spark, text, want):
    got = one(spark, text)
    assert {k: got[k] for k in want} == want


def test_sections_of_a_field_on_both_sides(spark):
    inv = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "invoice_id long, vendor_name string")
    parts = docindex.index(spark.createDataFrame([(1, 1, k, "Vendor" if k % 2 else None, f"from supplier {k}") for k in range(8)] + [(2, 1, 0, None, "nothing")], "document_id long, page_number int, section_ord int, section_heading string, text string"))
    got = {(r.source_id, r.target_id): r for r in docindex.cross_reference(inv, spark.createDataFrame([(1, 2), (2, 3)], "source_id long, target_id long"), "vendor_name", parts).collect()}
    assert [x.relevance_score for x in got[1, 2].source_sections] == [5, 5, 5, 5, 2] and got[1, 2].target_sections == [] and got[1, 2].match_status == "match"
    assert got[2, 3].source_sections == got[2, 3].target_sections == []


def test_item_pairs(spark):
    inv = spark.createDataFrame([(1, ["a", " ", None]), (2, ["x", "y"]), (3, [])], "invoice_id long, line_items array<string>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert sorted(tuple(r) for r in extraction.item_pairs(inv, pairs).collect()) == [(1, 2, "a", "x"), (1, 2, "a", "y")]


def test_contents_of_long_documents_only(spark):
    rows = [(1, p, 0, f"H{p}", p % 3 + 1) for p in range(1, 6)] + [(2, p, 0, "H", 1) for p in range(1, 4)] + [(1, 5, 1, None, 0)]
    parts = spark.createDataFrame(rows, "document_id long, page_number int, section_ord int, section_heading string, level int")
    got = docindex.table_of_contents(parts).orderBy("position").collect()
    assert [(r.document_id, r.entry_title, r.parent) for r in got] == [(1, "H1", None), (1, "H2", 1), (1, "H3", None), (1, "H4", 3), (1, "H5", 4)]
    old = parts.where("document_id = 1")
    assert docindex.replace_index(parts, old.limit(1)).where("document_id = 1").count() == 1


def test_ages_and_iso_dates(spark):
    now = dt.datetime(2024, 1, 10, 12)
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s),) for s in (5, 120, 7200, 200_000)], "t timestamp_ntz")
    assert sorted(r.a for r in df.select(X.relative_time("t", F.lit(now)).alias("a")).collect()) == ["2d ago", "2h ago", "2m ago", "just now"]
    texts = [("2024-02-03",), ("2024-02-03T04:05:06",), ("03/02/2024",), ("2024-13-01",), (None,)]
    got = [r.d for r in spark.createDataFrame(texts, "t string").select(X.iso_timestamp("t").alias("d")).collect()]
    assert got == [dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 3, 4, 5, 6), None, None, None]
