"""Page and section index of documents: segmentation, byte ranges, contents, keyword retrieval, cross references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.expressions import query_tokens

# Headings of business documents, in upper case.
BUSINESS_HEADINGS = ("INVOICE", "BILL TO", "SHIP TO", "PAYMENT TERMS", "TERMS AND CONDITIONS", "DESCRIPTION", "ITEM", "QTY", "QUANTITY", "UNIT PRICE", "AMOUNT", "SUBTOTAL", "TOTAL", "TAX", "NOTES", "REMITTANCE", "PURCHASE ORDER", "SUMMARY", "APPENDIX", "ANNEX", "SCHEDULE", "EXHIBIT")

# Words that stand for a field of an invoice.
FIELD_KEYWORDS = {
    "invoice_number": ("invoice", "number", "inv", "#"),
    "vendor_name": ("vendor", "supplier", "from", "bill from", "sold by"),
    "buyer_name": ("buyer", "customer", "bill to", "sold to", "client"),
    "total_amount": ("total", "amount", "due", "grand total", "balance"),
    "subtotal": ("subtotal", "sub total", "net"),
    "tax_amount": ("tax", "vat", "gst", "sales tax"),
    "invoice_date": ("date", "invoice date"),
    "due_date": ("due date", "payment due", "pay by"),
    "payment_terms": ("payment terms", "terms", "net 30", "net 60"),
}

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _made_of(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "") == ""


def heading_level(line: Column) -> Column:
    """Level of a line as a heading; 0 if it is none.

    1: nothing but capitals, digits and signs of titles, five characters or more.  2: a section number and a title, or a
    line that begins with a business heading.  3: two to seven words, each a capital and small letters.
    """
    text = F.rtrim(line, F.lit(" \t\r"))
    words = F.filter(F.split(text, "[ \t]+"), lambda w: w != "")
    begins = lambda t: F.substring(t, 1, 1).between("A", "Z")
    number, rest = F.get(words, F.lit(0)), F.array_join(F.slice(words, 2, 999), " ")
    numbered = _made_of(number, _DIGITS + ".") & ~F.contains(F.concat(F.lit("."), number, F.lit(".")), F.lit("..")) & begins(rest) & (F.length(rest) > 1) & _made_of(rest, _UPPER + _LOWER + _DIGITS + " ,-/&")
    upper = F.upper(text)
    after = lambda b: F.substring(text, len(b) + 1, 1)
    business = F.greatest(*[F.startswith(upper, F.lit(b)) & ~F.coalesce(after(b).rlike(r"\w"), F.lit(False)) for b in BUSINESS_HEADINGS])
    titled = F.size(words).between(2, 7) & F.forall(words, lambda w: begins(w) & (F.length(w) > 1) & _made_of(F.substring(w, 2, 1_000_000), _LOWER))
    level = F.when(begins(text) & (F.length(text) >= 5) & _made_of(text, _UPPER + _DIGITS + " \t/&-"), 1).when(numbered | business, 2).when(titled, 3).otherwise(0)
    return F.when(F.ltrim(text, F.lit(" \t")) == text, level).otherwise(0)


def segment(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, section_ord, section_heading, level, text) of pages (document_id, page_number, text).

    A section is a heading and the lines up to the next; what precedes the first heading is a section without one.  A page
    without text is one empty section.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    held = pages.select(F.col("document_id").cast("long").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), lines.alias("lines"))
    held = held.withColumn("levels", F.transform("lines", heading_level))
    marks = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("levels", i - 1) > 0)
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), marks))
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+\z", "")

    def part(start: Column, k: Column) -> Column:
        level = F.get("levels", start - 1)
        end = F.coalesce(F.get("starts", k + 1), F.size("lines") + 1)
        own = strip(F.get("lines", start - 1))
        body = strip(F.array_join(F.slice("lines", start + 1, end - start - 1), "\n"))
        headed = F.when(F.length(body) > 0, F.concat(own, F.lit("\n"), body)).otherwise(own)
        return F.struct(F.when(level > 0, own).alias("section_heading"), level.alias("level"), F.when(level > 0, headed).otherwise(strip(F.array_join(F.slice("lines", start, end - start), "\n"))).alias("text"))

    found = held.withColumn("starts", starts).withColumn("parts", F.transform("starts", part))
    full = F.filter("parts", lambda x: (x["level"] > 0) | (x["text"] != "") | (F.size("parts") == 1))
    return found.select("document_id", "page_number", F.posexplode(full).alias("section_ord", "part")).select("document_id", "page_number", "section_ord", "part.*")


def content_type(text: Column, heading: Column | None = None) -> Column:
    """table: ruled, tabbed (three tabs in a line) or more than two in five lines numbers; heading: nothing but one; else text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    numeric = F.filter(lines, lambda x: x.rlike(r"^\s*[\d,]+\.?\d*\s*$"))
    ruled = text.rlike(r"\|.*\|") | text.rlike(r"\+[-+]+\+") | text.rlike(r"\t.*\t.*\t")
    is_table = ruled | ((F.size(lines) > 0) & (F.size(numeric) / F.size(lines) > 0.4))
    alone = F.lit(False) if heading is None else F.coalesce(F.trim(text) == F.trim(heading), F.lit(False))
    return F.when(alone, "heading").when(is_table, "table").otherwise("text")


def index(parts: DataFrame) -> DataFrame:
    """Byte ranges over each document's sections in order, content type and preview."""
    w = Window.partitionBy("document_id").orderBy("page_number", "section_ord")
    size = F.octet_length("text").cast("long")
    start = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return parts.withColumns({"byte_offset_start": start, "content_type": content_type(F.col("text"), F.col("section_heading")), "content_preview": F.substring("text", 1, 500)}).withColumn("byte_offset_end", F.col("byte_offset_start") + size).drop("text")


def contents(headed: DataFrame) -> DataFrame:
    """Parent of each heading (document_id, ord, level 1 to 3): the nearest earlier heading of a smaller level."""
    w = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(w)
    rows = headed.withColumns({"__1": last(1), "__2": last(2)})
    parent = F.when(F.col("level") == 2, F.col("__1")).when(F.col("level") == 3, F.greatest("__1", "__2"))
    return rows.withColumn("parent", parent).drop("__1", "__2")


def table_of_contents(parts: DataFrame, least_pages: int = 4) -> DataFrame:
    """Entries (document_id, entry_title, page_number, level, parent, position) of documents of ``least_pages`` or more, ordered by page and level.

    ``parts`` are sections (document_id, page_number, section_ord, section_heading, level); sections without a heading
    make no entry.  ``parent`` is the position of the nearest earlier heading of a smaller level.
    """
    pages = parts.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages")).where(F.col("pages") >= least_pages).select("document_id")
    w = Window.partitionBy("document_id").orderBy("page_number", "section_ord")
    headed = parts.join(pages, "document_id", "left_semi").where("section_heading IS NOT NULL").withColumn("ord", F.row_number().over(w))
    rows = contents(headed.select("document_id", "ord", "level", F.col("section_heading").alias("entry_title"), "page_number"))
    order = Window.partitionBy("document_id").orderBy("page_number", "level", "ord")
    return rows.withColumn("position", F.row_number().over(order)).select("document_id", "entry_title", "page_number", "level", "ord", "parent", "position")


def replace_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index after documents were indexed again: their old rows are gone."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def _hits(words: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.aggregate(words, F.lit(0), lambda s, t: s + F.contains(low, t).cast("int"))


def retrieve(parts: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Sections of each document by keyword score: 3 a token in the heading, 1 in the preview, 5 for the phrase in the heading."""
    words = query_tokens(F.lit(query))
    phrase = F.contains(F.lower(F.coalesce("section_heading", F.lit(""))), F.array_join(words, " ")) & (F.size(words) > 0)
    score = 3 * _hits(words, F.col("section_heading")) + _hits(words, F.col("content_preview")) + F.when(phrase, 5).otherwise(0)
    return _ranked(parts.withColumn("relevance_score", score), k)


def retrieve_field(parts: DataFrame, field: str, k: int = 5) -> DataFrame:
    """Sections by the words that stand for a field; an unknown field stands for itself."""
    words = F.array(*map(F.lit, FIELD_KEYWORDS.get(field, (field,))))
    return _ranked(parts.withColumn("relevance_score", 3 * _hits(words, F.col("section_heading")) + _hits(words, F.col("content_preview"))), k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("document_id")
    order = w.orderBy(F.desc("relevance_score"), "page_number", "section_ord")
    return rows.where("relevance_score > 0").withColumns({"rank": F.row_number().over(order), "total_matches": F.count("*").over(w)}).where(F.col("rank") <= k)


def field_sections(parts: DataFrame, field: str, k: int = 5) -> DataFrame:
    """(document_id, sections): the ``k`` sections of each document that speak of a field, best first."""
    found = retrieve_field(parts, field, k)
    item = F.struct("rank", "page_number", "section_heading", "relevance_score", "content_preview")
    return found.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("sections"))


def cross_reference(inv: DataFrame, pairs: DataFrame, field: str, parts: DataFrame | None = None) -> DataFrame:
    """Compare one field of two invoices: match (equal and not empty or zero), mismatch, incomplete (one is missing).

    With the index ``parts``, source_sections and target_sections are the five best sections of either side, empty without any.
    """
    value = F.col(field) if field in inv.columns else F.lit(None).cast("string")
    v = inv.select("invoice_id", value.alias("v"))
    out = pairs.join(v.select(F.col("invoice_id").alias("source_id"), F.col("v").alias("source_value")), "source_id", "left").join(v.select(F.col("invoice_id").alias("target_id"), F.col("v").alias("target_value")), "target_id", "left")
    empty = F.col("source_value").cast("string").isin("", "0", "0.0")
    st = F.when(F.col("source_value").isNull() | F.col("target_value").isNull(), "incomplete").when((F.col("source_value") == F.col("target_value")) & ~empty, "match").otherwise("mismatch")
    out = out.withColumn("match_status", st)
    if parts is None:
        return out
    found = field_sections(parts, field)
    for side in ("source", "target"):
        own = found.select(F.col("document_id").alias(f"{side}_id"), F.col("sections").alias(f"{side}_sections"))
        out = out.join(own, f"{side}_id", "left").withColumn(f"{side}_sections", F.coalesce(f"{side}_sections", F.array().cast(own.schema[f"{side}_sections"].dataType)))
    return out
