"""Validation of field values by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import NUMBER, let, stripped, without

DATE_SHAPE = r"\A([0-9]{1,2}-[A-Za-z]{3}-([0-9]{2}|[0-9]{4})|[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})|[0-9]{1,2}-[0-9]{1,2}-([0-9]{2}|[0-9]{4})|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})\z"
#: Of each of its shapes the one format that can read it. Of two numbers before a year the first is the day where the second may be a month.
DATES = {
    r"\A[0-9]{1,2}/(0?[0-9]|1[0-2])/[0-9]{4}\z": "d/M/yyyy",
    r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z": "M/d/yyyy",
    r"\A[0-9]{1,2}/(0?[0-9]|1[0-2])/[0-9]{2}\z": "d/M/yy",
    r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}\z": "M/d/yy",
    r"\A[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}\z": "d-MMM-yy",
    r"\A[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}\z": "d-MMM-yyyy",
    r"\A[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z": "d-M-yyyy",
    r"\A[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}\z": "d-M-yy",
    r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z": "yyyy-M-d",
}

# fixed values: the patterns, and what is said of a value that keeps the rule and of one that does not
PATTERNS = {
    "GSTIN": r"\A[0-9]{2}[A-Z0-9]{13}\z",
    "Invoice Number": r"\A[A-Za-z0-9][A-Za-z0-9./_-]*\z",
    "Vehicle Number": r"\A[A-Z]{2}[0-9]{1,2}[A-Z]{1,3}[0-9]{3,4}\z",
    "IFSC": r"\A[A-Z]{4}0[A-Z0-9]{6}\z",
    "Account Number": r"\A[0-9]{6,20}\z",
}
REASONS = {
    "GSTIN": ("Valid GSTIN format", "Invalid GSTIN format"),
    "Invoice Number": ("Valid invoice number format", "Invalid invoice number format"),
    "Invoice Date": ("Valid date", "Invalid date format"),
    "Vehicle Number": ("Valid vehicle number format", "Invalid vehicle number format"),
    "IFSC": ("Valid IFSC format", "Invalid IFSC format"),
    "Account Number": ("Valid account number format", "Invalid account number format"),
    "Total Amount": ("Valid monetary value", "Invalid monetary value"),
    "Company Name": ("Readable company name", "Company name appears incomplete"),
    "Bank": ("Readable bank name", "Bank name appears incomplete"),
    "Bank Name": ("Readable bank name", "Bank name appears incomplete"),
}
OTHER_REASONS = ("Readable extracted value", "Value appears too short")
NAMES = ["Company Name", "Bank", "Bank Name"]


def is_date(value: Column) -> Column:
    """A text that a format cannot read costs an exception, so no other format is tried."""
    tried = F.coalesce(*[F.when(value.rlike(shape), F.struct(F.try_to_date(value, f).alias("date"))) for shape, f in DATES.items()])
    return tried["date"].isNotNull()


def is_valid(field: Column, value: Column) -> Column:
    """Whether a value that is not blank keeps its field's rule."""
    v = stripped(value)
    upper = F.upper(v)
    squeezed = F.regexp_replace(upper, r"\s", "")
    amount = without(v, ",", "₹")
    number = F.when(amount.rlike(NUMBER), amount.try_cast("double"))
    return (
        F.when(field == "GSTIN", upper.rlike(PATTERNS["GSTIN"]))
        .when(field == "Invoice Number", v.rlike(PATTERNS["Invoice Number"]))
        .when(field == "Invoice Date", is_date(v))
        .when(field == "Vehicle Number", squeezed.rlike(PATTERNS["Vehicle Number"]))
        .when(field == "IFSC", upper.rlike(PATTERNS["IFSC"]))
        .when(field == "Account Number", squeezed.rlike(PATTERNS["Account Number"]))
        .when(field == "Total Amount", F.coalesce(number >= 0, F.lit(False)))
        .when(field.isin(NAMES), (F.length(v) >= 3) & v.rlike(r"\p{L}"))
        .otherwise(F.length(v) >= 2)
    )


def validate_field(field: Column, value: Column) -> Column:
    """struct(valid, reason). The rule is worked out once, and in no compiled expression: copies of it make methods too long for the JVM to compile."""
    said = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for name, both in REASONS.items() for x in (name, both[k])]), field), F.lit(OTHER_REASONS[k]))
    kept = F.struct(F.coalesce(is_valid(field, value), F.lit(False)).alias("valid"), (stripped(value) == "").alias("empty"))
    return let(
        kept,
        lambda x: F.struct((x["valid"] & ~x["empty"]).alias("valid"), F.when(x["empty"], "Field is empty").when(x["valid"], said(0)).otherwise(said(1)).alias("reason")),
    )


def validate_invoice(fields: Column) -> Column:
    """A map of field to value becomes a map of field to struct(value, valid, reason); null is an empty map."""
    fields = F.coalesce(fields, F.expr("cast(map() as map<string,string>)"))

    def one(k: Column, v: Column) -> Column:
        r = validate_field(k, v)
        return F.struct(v.alias("value"), r["valid"].alias("valid"), r["reason"].alias("reason"))

    return F.transform_values(fields, one)


def validation_reason(field: Column, value: Column, reason: Column) -> Column:
    """What to tell a user: the rule's reason, or a sentence by field."""
    low = F.lower(field)
    # fixed values: the sentences
    text = (
        F.when(low == "invoice date", "Invalid invoice date format. Please check the extracted invoice date.")
        .when(low == "invoice number", "Invalid invoice number format. Please check the extracted invoice number.")
        .when(low.isin("seller tax id", "client tax id"), "Invalid Tax ID format. Please check the extracted Tax ID.")
        .when(low == "seller iban", "Invalid IBAN format. Please check the extracted Seller IBAN.")
        .when(low.isin("net worth", "vat", "gross worth"), "A numeric monetary value is expected. Please check the extracted amount.")
        .otherwise(F.concat(F.lit("The extracted value '"), stripped(value), F.lit("' does not match the expected format for "), field, F.lit(".")))
    )
    return F.coalesce(F.nullif(reason, F.lit("")), text)
