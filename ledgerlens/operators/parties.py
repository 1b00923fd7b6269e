"""Names of seller and client from OCR words with boxes: a label, and the words below it in its column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import party_label

LABEL_ROWS, BELOW, REACH, LINES, MARGIN = 1200, 3, 190, 65, 2
# fixed values: words that are no part of a name
STOP_WORDS = ["seller", "client", "invoice", "no", "date", "of", "issue", "tax", "id", "iban", "total", "net", "vat", "gross", "worth", "amount", "description", "quantity", "price"]


def party_names(words: DataFrame) -> DataFrame:
    """(image, seller, client) from words (image, pos, text, left, top, width, height); blank where not found.

    Images without both labels give blanks. Each word is compared with its image's two labels only, so the work
    grows with the words; an image's words come together once.
    """
    w = words.withColumns({"center": F.col("left") + F.col("width") / 2, "label": F.when(F.col("top") <= LABEL_ROWS, party_label(F.rtrim(F.col("text"), F.lit(":")))).otherwise("")})
    box = F.struct("pos", "left", "top", "width", "height", "center")
    anchors = w.groupBy("image").agg(F.min(F.when(F.col("label") == "seller", box)).alias("s"), F.min(F.when(F.col("label") == "client", box)).alias("c"))
    both = w.join(anchors.filter("s is not null and c is not null"), "image")
    middle = (F.col("s.center") + F.col("c.center")) / 2
    seller_left = F.col("s.center") < F.col("c.center")
    left = F.col("center") <= middle - MARGIN
    right = F.col("center") >= middle + MARGIN
    side = F.when(left, F.when(seller_left, "seller").otherwise("client")).when(right, F.when(seller_left, "client").otherwise("seller"))
    both = both.withColumn("party", side).withColumn("a", F.when(F.col("party") == "seller", F.col("s")).otherwise(F.col("c")))
    clean = F.regexp_replace("text", "[^A-Za-z0-9&.'-]", "")
    named = both.filter(
        F.col("party").isNotNull() & (F.col("pos") != F.col("a.pos")) & (F.col("top") >= F.col("a.top") + F.col("a.height") - BELOW) & (F.col("top") <= F.col("a.top") + REACH)
        & (clean != "") & ~F.lower(clean).isin(STOP_WORDS) & ~clean.rlike(r"\A([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9.]+)\z")
    )
    first = F.min("top").over(Window.partitionBy("image", "party"))
    block = named.withColumn("first", first).filter(F.col("top") <= F.col("first") + LINES)
    ordered = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("party") == p, F.struct("top", "left", "pos", "text")))), lambda x: x["text"])
    names = block.groupBy("image").agg(*[F.trim(F.array_join(ordered(p), " ")).alias(p) for p in ("seller", "client")])
    return anchors.select("image").join(names, "image", "left").select("image", F.coalesce("seller", F.lit("")).alias("seller"), F.coalesce("client", F.lit("")).alias("client"))
