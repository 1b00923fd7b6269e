"""Secret scans: a random forest that removes false positives among secret-like strings.

Candidates are runs of at least LEAST characters of the alphabets that keys are written in, and whatever of LEAST_BESIDE
characters or more is assigned to a word that announces secrets, or stands behind one. The forest looks at a candidate's
length, how often its characters change class, how much of it dictionary words cover, whether it is part of a path, and
at the words on both sides. It is trained by Spark ML on labelled findings: a bounded table made here by rules, of secrets
as they are issued or chosen and of what is usually mistaken for them, in their usual surroundings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, forgotten, whole, written

LEAST, LEAST_BESIDE = 16, 6
RUN = "[A-Za-z0-9_+/=~.-]{16,}"
FINDINGS = 5000
TREES, DEPTH = 24, 7
RULES_AT_ONCE = 5

# fixed values: words that stand beside secrets, words that stand beside harmless strings, and a small dictionary
SECRET_WORDS = "token|secret|passw|pwd|apikey|api_key|api-key|access_key|accesskey|private|credential|auth|bearer"
PLAIN_WORDS = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|hash|revision|etag|build|version|isbn|order|invoice"
DICTIONARY = (
    "account address after again all and any are back because before been best between book build can change city class code come company could country data day "
    "dist document down each end even example example every eye fact file find first form from get give good government great group hand has have head help here "
    "high home house how http image index information instance int into its just key know large last lib library life like line list local long look made make "
    "man many may message might more most much must name national need never new next node not now number off old one only open option order other our out "
    "over own package page part people person place placeholder point problem program public put python right same say school see sample service should show "
    "small some state still string student such system take test text than that the their them then there these they thing think this those time tion ment ing "
    "type under until use user value version very want was water way week well were what when where which while who will with word work world would www year your"
).split()

FEATURES = ["n", "digits", "upper", "changes", "distinct", "hexes", "vowels", "covered", "runs", "slashes", "dots", "in_path", "beside_secret", "beside_plain", "assigned", "symbols", "announced_after"]


def features(core: Column, before: Column, word: Column, after: Column) -> dict[str, Column]:
    """FEATURES of the candidate core, which stands in word between the words before and after."""
    n = F.length(core).cast("double")
    share = lambda pattern: F.regexp_count(core, F.lit(pattern)) / n
    low = F.lower(core)
    near = F.lower(F.concat_ws(" ", before, F.substr(word, F.lit(1), F.position(core, word) - 1)))
    dictionary = "(" + "|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w))) + ")"
    # the places where lower, upper and digit change to one another
    turn = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    return {
        "n": F.least(n, F.lit(200.0)),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "changes": share(turn),
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / F.least(n, F.lit(64.0)),
        "hexes": F.greatest(share("[0-9a-f]"), share("[0-9A-F]")),
        "vowels": F.regexp_count(low, F.lit("[aeiouy]")) / n,
        "covered": 1 - F.length(F.regexp_replace(low, dictionary, "")) / n,
        "runs": share(r"(.)\1\1"),
        "slashes": share("/"),
        "dots": share("[.]"),
        "in_path": (F.lower(word).rlike("https?:|www[.]|[.](com|org|net|html?|py|js|txt)|^[~./]+[a-z]")).cast("double"),
        "beside_secret": near.rlike(SECRET_WORDS).cast("double"),
        "beside_plain": near.rlike(PLAIN_WORDS).cast("double"),
        "assigned": near.rlike("[=:]\\s*[\"']?$").cast("double"),
        "symbols": share("[^A-Za-z0-9]"),
        "announced_after": F.lower(after).rlike(SECRET_WORDS).cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(core, before, word, after, label): n findings by rule, the same in every session."""
    i = F.col("id").cast("string")
    draw = lambda salt: F.sha2(F.concat(i, F.lit(salt)).cast("binary"), 256)
    b64 = lambda salt: F.base64(F.unhex(F.concat(draw(salt), draw(salt + "'"))))
    alnum = lambda salt: F.regexp_replace(b64(salt), "[+/=]", "")
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    words = lambda k, sep: F.concat_ws(sep, *[pick(f"w{j}", DICTIONARY) for j in range(k)])
    syllables = ["an", "er", "th", "on", "in", "re", "st", "ou", "ly", "ti", "tion", "ing", "ung", "keit", "lich", "sch", "ver", "eau", "ment", "que", "asta", "cion", "aos"]
    spoken = lambda k: F.concat_ws("", *[pick(f"s{k}-{j}", syllables) for j in range(k)])
    keyed = pick("k", ["token", "TOKEN", "secret", "api_key", "password", "auth_token", "client_secret", "access_key", "Authorization:", "private"])
    plain = pick("p", ["commit", "sha256", "md5", "checksum", "uuid", "digest", "build", "revision"])
    text = spoken(3)
    digit = lambda salt, k: F.substring(F.regexp_replace(F.concat(draw(salt), draw(salt + "2")), "[a-f]", ""), 1, k)
    mark = lambda salt: pick(salt, ["!", "@", "#", "$", "%", "&", "*", "?"])
    chosen = pick("c1", [w for w in DICTIONARY if len(w) > 4])
    sign = pick("=", ["=", ":", "=", ""])
    makers = [
        (1, F.substring(draw("a"), 1, 40), keyed, sign),
        (1, F.substring(draw("b"), 1, 32), keyed, sign),
        (1, F.upper(F.substring(draw("c"), 1, 40)), keyed, sign),
        (1, F.substring(b64("d"), 1, 40), keyed, sign),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(alnum("e"), 1, 16))), pick("a", ["key", "aws", "id", "use"]), sign),
        (1, F.concat(pick("g", ["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-"]), F.substring(alnum("f"), 1, 36)), pick("b", ["with", "use", "token", "is"]), sign),
        (1, F.substring(alnum("h"), 1, 24), keyed, sign),
        (1, F.concat(F.initcap(chosen), digit("u", 3), mark("m1")), keyed, sign),
        (1, F.concat(F.substring(alnum("v"), 1, 9)), keyed, sign),
        (1, F.concat(chosen, digit("x", 2), F.substring(alnum("x2"), 1, 3), mark("m2"), pick("x3", ["x", "q", "Z", "7"])), pick("k2", ["pwd", "passwd", "password", "secret"]), sign),
        (1, F.concat(F.substring(alnum("y"), 1, 5), mark("m3"), F.substring(alnum("y2"), 1, 6), mark("m4"), digit("y3", 2)), keyed, sign),
        (0, spoken(3), keyed, F.lit("")),
        (0, F.concat(spoken(3), pick("q", [".", ",", ";", "", ":"])), keyed, sign),
        (0, chosen, keyed, sign),
        (0, F.concat(pick("b1", ["<", "${", "{{", "["]), chosen, pick("b2", [">", "}", "}}", "]"])), keyed, sign),
        (0, F.repeat(pick("s*", ["*", "x", ".", "-"]), 8), keyed, sign),
        (0, F.concat(chosen, F.lit("_"), pick("c2", DICTIONARY)), keyed, sign),
        (0, spoken(7), text, F.lit("")),
        (0, F.upper(spoken(6)), text, F.lit("")),
        (0, F.initcap(spoken(6)), text, F.lit("")),
        (0, F.initcap(spoken(8)), spoken(2), F.lit("")),
        (0, F.concat(pick("h", ["mail", "www", "ftp", "api", "user"]), F.substring(F.regexp_replace(draw("t"), "[a-f]", ""), 1, 1), F.lit("."), words(1, "."), pick("i", [".com", ".example.com", ".org", ".net"])), text, F.lit("")),
        (0, F.concat_ws(".", spoken(3), spoken(4)), text, F.lit("")),
        (0, F.concat(words(4, "_")), text, sign),
        (0, F.concat_ws("/", words(3, "/"), words(2, "-")), text, F.lit("")),
        (0, F.concat(words(3, "."), F.lit(".com/"), words(2, "/")), F.lit("http://"), F.lit("")),
        (0, F.substring(draw("i"), 1, 40), plain, pick("=2", ["", ":", "="])),
        (0, F.regexp_replace(F.substring(draw("j"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), plain, pick("=3", ["", ":", "="])),
        (0, F.regexp_replace(F.substring(draw("j"), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), text, F.lit("")),
        (0, F.repeat(pick("x", ["x", "X", "0", "=", "-", "_", "."]), 24), keyed, sign),
        (0, F.concat(pick("y", ["your", "change", "example", "insert", "placeholder"]), F.lit("_"), words(3, "_")), keyed, sign),
        (0, F.substring(F.regexp_replace(F.concat(draw("l"), draw("m"), draw("n")), "[a-f]", ""), 1, 18), pick("z", ["order", "invoice", "number", "phone", "id"]), sign),
        (0, F.concat(words(3, "-"), F.lit("-"), F.substring(F.regexp_replace(draw("o"), "[a-f]", ""), 1, 4)), text, F.lit("")),
        (0, F.concat_ws("+", spoken(4), spoken(3)), text, F.lit("")),
        (0, F.concat_ws(".", F.substring(F.regexp_replace(draw("q"), "[a-f]", ""), 1, 3), F.lit("168"), F.lit("100"), F.substring(F.regexp_replace(draw("r"), "[a-f]", ""), 1, 3), words(2, ".")), text, F.lit("")),
    ]
    kind = F.col("id") % len(makers)

    def made(some: dict[int, tuple]) -> DataFrame:
        column = lambda k: F.coalesce(*[F.when(kind == i, m[k] if k else F.lit(m[k])) for i, m in some.items()])
        return spark.range(0, n, 1, 1).filter(kind.isin(list(some))).select(column(0).cast("double").alias("label"), column(1).alias("core"), column(2).alias("name"), column(3).alias("sign"), "id")

    numbered = list(enumerate(makers))
    rows = made(dict(numbered[:RULES_AT_ONCE]))
    for a in range(RULES_AT_ONCE, len(makers), RULES_AT_ONCE):  # all rules in one expression are too much code to compile
        rows = rows.unionByName(made(dict(numbered[a : a + RULES_AT_ONCE])))
    quote = F.when(F.col("id") % 3 == 0, F.lit('"')).otherwise(F.lit(""))
    apart = F.col("id") % 2 == 0  # name = core in words of their own, or name=core in one
    # of findings that are announced at all some are so behind them
    behind = (F.col("id") % 7 == 0) & (F.col("sign") == "")
    before = F.when(behind, text).when(apart, F.concat_ws(" ", "name", "sign")).otherwise(F.lit(""))
    word = F.when(apart | behind, F.concat(quote, "core", quote)).otherwise(F.concat("name", "sign", quote, "core", quote))
    return rows.select("label", "core", before.alias("before"), word.alias("word"), F.when(behind, F.concat(F.lit("is the "), "name")).otherwise(spoken(2)).alias("after"))


def _vectors(df: DataFrame) -> DataFrame:
    given = features(F.col("core"), F.col("before"), F.col("word"), F.col("after"))
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(df.withColumns({f"f_{k}": v for k, v in given.items()}))


def train(spark: SparkSession, n: int = FINDINGS) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt")
    # written first, so that rules and features are not one expression
    findings = written(labelled_findings(spark, n), "secret-findings")
    rows = written(_vectors(findings).select("label", vector_to_array("features").alias("v")), "secret-vectors")
    model = forest.fit(rows.select("label", array_to_vector("v").alias("features")))
    for table in (findings, rows):
        forgotten(table)
    return model


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, core, before, word, after): every candidate of every text, with the two words on either side.

    What is announced is a candidate as a whole; else each run of a word is one.
    """
    text = whole(F.col("text"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).rlike(SECRET_WORDS).alias("announces"), words.alias("words"))
    # outer, lest Catalyst infers a filter on the array and so finds the words twice
    at = lambda k: F.when((F.col("i") + k >= 0) & (F.col("i") + k < F.size("words")), F.col("words")[F.greatest(F.least(F.col("i") + k, F.size("words") - 1), F.lit(0))])
    rows = rows.select("doc_id", "announces", "words", F.posexplode_outer("words").alias("i", "word")).filter(F.length("word") >= LEAST_BESIDE)
    run = (F.length("word") >= LEAST) & F.col("word").rlike(RUN)
    own = F.regexp_extract("word", f"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_.-]*[\"']?[=:]+>?[\"']?(.{{{LEAST_BESIDE},}})$", 1)
    behind = F.concat_ws(" ", at(-2), at(-1)).rlike(f"(?i)({SECRET_WORDS})[^ ]*( [=:]+>?| is)?$") & ~F.col("word").rlike("^[=:]+>?$")
    value = F.when(own != "", own).when(behind, F.col("word"))
    rows = rows.withColumn("value", F.when(F.col("announces"), value)).filter(run | F.col("value").isNotNull())
    rows = rows.select("doc_id", F.col("i").cast("long").alias("word_no"), F.concat_ws(" ", at(-2), at(-1)).alias("before"), "word", F.concat_ws(" ", at(1), at(2)).alias("after"), "value")
    # what a quote closes, or all but closing marks; an assignment inside a run belongs to the words beside it
    quoted = F.regexp_extract("value", "^[\"'`]([^\"'`]+)[\"'`]", 1)
    bare = F.regexp_extract("value", "^[\"'`(]*(.*?)[\"'`,;.)]*$", 1)
    announced = F.when(quoted != "", quoted).otherwise(bare)
    rows = rows.withColumn("core", F.explode(F.when(F.col("value").isNotNull(), F.array(announced)).otherwise(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)))))
    core = F.when(F.col("value").isNotNull(), F.col("core")).otherwise(F.regexp_extract("core", r"([^=].*[^=.]|[^=.])[=.]*$", 1))
    rows = rows.withColumn("core", core)
    inner = F.when(F.col("value").isNull(), F.regexp_extract("core", r"^.*[A-Za-z_-]=([^=]{16,})$", 1)).otherwise(F.lit(""))
    rows = rows.withColumn("core", F.when(inner != "", inner).otherwise(F.col("core")))
    return rows.filter(F.length("core") >= F.when(F.col("value").isNotNull(), LEAST_BESIDE).otherwise(LEAST)).drop("value")


def secret_scan(docs: DataFrame, model: RandomForestClassificationModel, least_score: float = 0.5) -> DataFrame:
    """(doc_id, word_no, secret, score): the candidates that the forest takes for secrets; word_no counts words from 0.

    Null and empty texts hold none; texts of any length are read whole. Null ids are returned as such; repeated rows
    repeat. Other columns, whatever their names, are not read.
    """
    scored = model.transform(_vectors(candidates(docs)))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "word_no", F.col("core").alias("secret"), score.alias("score")).filter(F.col("score") >= least_score)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir), train(spark))
    return found.select("doc_id", "word_no", F.length("secret").cast("long").alias("n_chars"), F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score")
