"""Fields and line items from the text of an invoice: a small grammar of labels and typed values, in four languages.

A field has steps.  A step is a set of labels and the kind of value that follows one of them; without labels, the value
alone.  The first step that matches anywhere in the text gives the field.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.expressions import currency, parse_amount, parse_date

#: Case folds, lines end at \n alone, classes are Unicode's.
_FLAGS = "(?imdU)"
_SIGN = "[$€£₹]?"
_MONEY = r"([\d,]+\.?\d{0,2})"

# What each kind of value looks like; one group is the value.
VALUES = {
    "code": r"([A-Z0-9/-]+)",
    "long number": r"(\d{4,})",
    "numeric date": r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
    "named month": r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})",
    "iso date": r"(\d{4}-\d{2}-\d{2})",
    "amount": rf"{_SIGN}\s*{_MONEY}",
    "name": r"([A-Z][A-Za-z\s&.,]+?)(?:\n|$)",
    "three letters": r"([A-Z]{3})",
    "rest of line": r"(.+?)(?:\n|$)",
    "days": r"(net\s*\d+|due\s*(?:on|upon)\s*receipt|payable\s*within\s*\d+\s*days?)",
}

# Labels of the fields.  A blank stands for any number of them, "(s)" for an s that may be missing, "-" for a
# hyphen or a blank that may be missing, "(rate)" for a percentage in brackets that may be missing.
LABELS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "invoice_number": [
        ("code", ("invoice #", "invoice no.", "invoice number")),
        ("code", ("inv #", "inv no.")),
        ("code", ("Rechnungsnummer", "Facture No.", "Facture N°.", "Número de factura")),
        ("long number", ("#",)),
    ],
    "invoice_date": [
        ("numeric date", ("invoice date", "date of invoice", "date", "Rechnungsdatum", "Date de facture", "Fecha")),
        ("named month", ()),
        ("iso date", ()),
    ],
    "due_date": [
        ("numeric date", ("due date", "payment due", "pay by", "Fälligkeitsdatum", "Date d'échéance", "Fecha de vencimiento")),
        ("named month", ("due date", "payment due")),
    ],
    "total_amount": [
        ("amount", ("total amount", "total due", "total payable", "total")),
        ("amount", ("grand total", "amount due", "balance due", "Gesamtbetrag", "Montant total", "Total general")),
    ],
    "subtotal": [("amount", ("sub total", "Zwischensumme", "Sous-total"))],
    "tax_amount": [
        ("amount", ("tax", "vat", "gst", "sales tax", "MwSt", "TVA", "IVA", "USt")),
        ("amount", ("tax (rate)",)),
    ],
    "vendor_name": [("name", ("from", "vendor", "supplier", "bill from", "sold by", "Lieferant", "Fournisseur", "Proveedor"))],
    "buyer_name": [("name", ("to", "bill to", "sold to", "customer", "client", "Kunde", "Cliente"))],
    "currency": [("three letters", ("currency", "curr.", "währung", "devise", "moneda"))],
    "payment_terms": [
        ("rest of line", ("payment term(s)", "term(s) of payment", "Zahlungsbedingungen", "Condition(s) de paiement", "Condiciones de pago")),
        ("days", ()),
    ],
}

# Currency marks in the order in which a text is searched for them.
MARKS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₹", "INR"), ("CHF",))

_PLAIN = dict(zip("äéúìó", "aeuio", strict=True))


def phrase(label: str) -> str:
    """The expression of a label: an accent may be missing, and so may a full stop."""
    out = ""
    for part in re.split(r"(\(s\)|\(rate\)|[ .-])", label):
        if part == "(s)":
            out += "s?"
        elif part == "(rate)":
            out += r"\(?\d*\.?\d*%?\)?"
        elif part in (" ", ".", "-"):
            out += {" ": r"\s*", ".": r"\.?", "-": r"[\s-]?"}[part]
        else:
            out += "".join(f"[{c}{_PLAIN[c]}]" if c in _PLAIN else re.escape(c) for c in part)
    return out


def step(kind: str, labels: tuple[str, ...]) -> str:
    """The expression of a step: a label, then blanks with a colon or full stop among them, then the value."""
    if not labels:
        return VALUES[kind]
    between = r"\s*" if labels == ("#",) else r"\s*[:.]?\s*"
    return "(?:" + "|".join(map(phrase, labels)) + ")" + between + VALUES[kind]


#: The steps of each field as expressions, in order.
PATTERNS: dict[str, tuple[str, ...]] = {name: tuple(step(*s) for s in steps) for name, steps in LABELS.items()}
PATTERNS["currency"] += tuple("(" + "|".join(map(re.escape, marks)) + ")" for marks in MARKS)


def field(text: Column, name: str, strict: bool = False) -> Column:
    """The field's raw text, trimmed; null if no step matches.

    Labels match inside words ("total" in "Subtotal"), as in the literal rules; ``strict`` wants a word's beginning.
    """
    tries = [F.nullif(F.trim(F.regexp_extract(text, _FLAGS + (r"(?<![A-Za-z])" if strict else "") + p, 1)), F.lit("")) for p in PATTERNS[name]]
    return F.coalesce(*tries)


def fields(docs: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Adds all ten fields, parsed."""
    raw = {name: field(F.col(text), name, strict) for name in PATTERNS}
    out = docs.withColumns({f"__{k}": v for k, v in raw.items()})
    parsed = {k: F.col(f"__{k}") for k in ("invoice_number", "vendor_name", "buyer_name", "payment_terms")}
    parsed |= {k: parse_amount(f"__{k}") for k in ("total_amount", "subtotal", "tax_amount")}
    parsed |= {k: parse_date(f"__{k}") for k in ("invoice_date", "due_date")} | {"currency": currency("__currency")}
    return out.withColumns({k: parsed[k] for k in PATTERNS}).drop(*[f"__{k}" for k in PATTERNS])


_CELLS = {"quantity": r"(\d+)", "anything": "(.+?)", "words": r"([A-Za-z][\w\s]{2,40}?)", "money": _SIGN + _MONEY}
_QTY_FIRST = r"\s+".join(_CELLS[c] for c in ("quantity", "anything", "money", "money"))
_NAME_FIRST = r"\s+".join(_CELLS[c] for c in ("words", "quantity", "money", "money"))


def line_items(text: Column) -> Column:
    """Array of (quantity, description, unit_price, total): rows that begin with a quantity, or with a name if there are none."""
    take = lambda p, g: F.regexp_extract_all(text, F.lit("(?dU)" + p), g)

    def rows(p: str, qty: int, name: int) -> Column:
        z = F.arrays_zip(take(p, qty).alias("q"), take(p, name).alias("d"), take(p, 3).alias("u"), take(p, 4).alias("t"))
        found = F.transform(z, lambda x: F.struct(x["q"].try_cast("int").alias("quantity"), F.trim(x["d"]).alias("description"), parse_amount(x["u"]).alias("unit_price"), parse_amount(x["t"]).alias("total")))
        return F.filter(found, lambda x: x["quantity"].isNotNull() & x["unit_price"].isNotNull() & x["total"].isNotNull())

    first = rows(_QTY_FIRST, 1, 2)
    return F.when(F.size(first) > 0, first).otherwise(rows(_NAME_FIRST, 2, 1))


def item_pairs(inv: DataFrame, pairs: DataFrame, items: str = "line_items") -> DataFrame:
    """(a, b, item_a, item_b): every item of one invoice with every item of the other, for given pairs (a, b); empty items are left out.

    ``inv`` is (invoice_id, ``items`` array of strings).  The product stays within a pair, whose lists are short.
    """
    of = inv.select("invoice_id", F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")).alias("items"))
    met = pairs.join(of.select(F.col("invoice_id").alias("a"), F.col("items").alias("x")), "a").join(of.select(F.col("invoice_id").alias("b"), F.col("items").alias("y")), "b")
    return met.select("a", "b", F.explode("x").alias("item_a"), "y").select("a", "b", "item_a", F.explode("y").alias("item_b"))


def merge_confidence(a: Column, b: Column) -> Column:
    """Confidence of two recognisers together: each weighs by itself."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return F.when((a <= 0) & (b <= 0), 0.0).otherwise((a * a + b * b) / (a + b))


def prefer_second(a: Column, b: Column) -> Column:
    return (F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))) > 15


def confidence(words: Column) -> Column:
    """Mean of the positive confidences; 0 without any."""
    ok = F.filter(words, lambda x: x > 0)
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda s, x: s + x) / F.size(ok)).otherwise(0.0)
