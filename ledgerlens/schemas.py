"""Constants and schemas that all modules share."""

from pyspark.sql import types as T

# fixed values: the benchmark's fields, in report order, and the preprocessing methods
FIELDS = ["Invoice Number", "Invoice Date", "Seller Tax ID", "Client Tax ID", "Seller IBAN", "Net Worth", "VAT", "Gross Worth"]
EXTRACTED_FIELDS = ["Invoice Number", "Invoice Date", "Seller", "Client", *FIELDS[2:]]
IDENTIFIERS = ["Invoice Number", "Seller Tax ID", "Client Tax ID", "Seller IBAN"]
AMOUNTS = ["Net Worth", "VAT", "Gross Worth"]
DATE = "Invoice Date"
METHODS = ["Original", "Gray", "Threshold", "Adaptive", "Denoise", "Resize", "Sharpen"]
BASELINE, DEFAULT_METHOD = "Original", "Threshold"

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]

TRUTH = T.StructType(_text("image", *FIELDS))
DETAILED = T.StructType([
    *_text("image", "method"), T.StructField("ocr_confidence", T.DoubleType()), *_text("field", "actual", "predicted"),
    T.StructField("exact_match", T.BooleanType()), T.StructField("character_accuracy", T.DoubleType()),
])
BATCH_COLUMNS = ["Invoice", "Processing Method", *FIELDS, "OCR Confidence", "Validation Status", "Manual Review", "Review Reason", "Processing Time (seconds)"]
BATCH = T.StructType([T.StructField(c, T.DoubleType() if c in ("OCR Confidence", "Processing Time (seconds)") else T.StringType()) for c in BATCH_COLUMNS])
OCR_WORDS = "array<struct<text:string,confidence:double>>"
OCR_BOXES = "array<struct<text:string,left:int,top:int,width:int,height:int,conf:double>>"
IMAGE = "struct<height:int,width:int,channels:int,data:binary>"
CONFIDENCE = "struct<confidence:int,status:string,review:boolean,confidence_available:boolean,confidence_source:string>"
