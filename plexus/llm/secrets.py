"""Secret scan with a random forest that removes false positives, in DataFrame operations alone.

Candidates are runs of at least ``SHORTEST`` characters out of ``[A-Za-z0-9+/_-]`` wherever they
stand in a text, and shorter runs that begin like an issued key or stand behind a keyword and an
assignment sign.  Each gets features of its length, the transitions between
its characters' classes, how much of it dictionary words cover, the path it was found under and
the words beside it; a random forest trained on labelled findings gives the probability that it
is a secret, and findings below ``THRESHOLD`` are false positives.

``labelled_findings`` makes the default training set by rule: secrets of common formats in the
places they occur, and look-alikes (commit hashes, checksums, identifiers, card and order numbers,
placeholders, encoded images, compound words).  Any table of ``(value, before, after, path, label)``
serves instead.  The set and so the training is bounded; the scan reads every text whole.

Null and empty texts have no candidates and give no rows; a null path is the empty one; repeated
rows report repeatedly.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORTEST = 16
THRESHOLD = 0.5
TREES, DEPTH, SEED = 32, 8, 11
FINDINGS = 6_000

# Words that mark what stands beside a candidate, or a candidate that is no secret.
_KEYWORDS = r"password|passwd|pwd|secret|token|api_?key|apikey|auth|credential|private|access|bearer"
_INNOCENT = r"commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|card|order|phone|tracking|revision|image|isbn|etag|ref"
_DICTIONARY = (
    "password secret token example sample test dummy your insert change here placeholder changeme key user admin "
    "value string default config access account number version release update image data base file name path "
    "the and for with that this from have abc xxx lorem ipsum foo bar"
)
_PATHS = r"(?i)test|example|sample|mock|fixture|doc|vendor|lock"
_PREFIXES = r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk-|sk_live_|AIza|glpat-)"
_ISSUED = "^" + _PREFIXES
# The nearer lookbehinds rule out most places before the one with the keywords is tried.
_NAMED = rf"""(?<=[=:\s"'`])(?<=[=:]\s{{0,4}}["'`]?)(?<=(?i:{_KEYWORDS})[A-Za-z0-9_\-]{{0,24}}["'`\]]{{0,2}}\s{{0,4}}[=:]\s{{0,4}}["'`]?)"""
_LONG = rf"[A-Za-z0-9+/_\-]{{{SHORTEST},}}={{0,2}}"
_RUN = rf"(?:[A-Za-z0-9+/_\-]{{{SHORTEST},}}|{_NAMED}[A-Za-z0-9+/_\-]+|(?<![A-Za-z0-9+/_\-]){_PREFIXES}[A-Za-z0-9+/_\-]+)={{0,2}}"

FEATURES = [
    "length", "digits", "uppers", "lowers", "marks", "transitions", "distinct", "vowels", "hexadecimal", "digits_only", "coverage",
    "issued", "keyword_before", "innocent_before", "assigned", "quoted", "keyword_after", "path_test", "path_depth",
]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def features(found: DataFrame) -> DataFrame:
    """``found(value, before, after, path, ...)`` with the feature columns."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    before, after, path = (F.lower(F.coalesce(c, F.lit(""))) for c in ("before", "after", "path"))
    words = "|".join(sorted(_DICTIONARY.split(), key=lambda w: (-len(w), w)))
    left = F.length(F.regexp_replace(F.lower(v), words, ""))
    made = {
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "marks": share(r"[+/_\-=]"),
        "transitions": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(62.0)), "vowels": share("[aeiouAEIOU]"),
        "hexadecimal": _flag(v.rlike("^[0-9a-f]+$")), "digits_only": _flag(v.rlike("^[0-9_-]+$")), "coverage": 1 - left / n,
        "issued": _flag(v.rlike(_ISSUED)), "keyword_before": _flag(before.rlike(_KEYWORDS)), "innocent_before": _flag(before.rlike(_INNOCENT)),
        "assigned": _flag(before.rlike(r"[=:]\s*[\"']?$")), "quoted": _flag(before.rlike(r"[\"'`]$")), "keyword_after": _flag(after.rlike(_KEYWORDS)),
        "path_test": _flag(path.rlike(_PATHS)), "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
    }
    return found.withColumns(made)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Findings with a label, made by rule from a row's number: as many secrets as look-alikes."""
    salt = lambda k: F.sha2(F.concat_ws(":", "id", F.lit(k)), 256)
    pick = lambda k, options: F.get(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(options))).cast("int"))
    hexes = lambda k, size: F.substring(salt(k), 1, size)
    base64 = lambda k: F.regexp_replace(F.base64(F.unhex(salt(k))), "=", "")
    letters = lambda k, size, up=False: F.substring(F.translate(F.upper(salt(k)) if up else F.regexp_replace(base64(k), "[+/]", "q"), "0123456789", "GKMPRTVXYZ" if up else "gKmPrTvXyZ"), 1, size)
    upper = F.translate(F.upper(hexes("u", 32)), "01289", "QWXYZ")
    word = lambda k: pick(k, ["the", "value", "in", "erble", "set", "thand", "de", "schen", "config", "of", "une", "que", "with", "line"])
    key = lambda k: pick(k, ["token", "password", "secret", "api_key", "auth_token", "client_secret", "passwd", "access_key", "credential"])
    sign = lambda k: pick(k, ["=", " = ", ": ", " = \"", "=\"", ": '", ":"])
    plain = F.concat(word("w1"), F.lit(" "))
    kinds = [
        # secrets
        (1, hexes("a", 40), F.concat(word("w"), F.lit(" "), key("k"), sign("s"))),
        (1, hexes("b", 18), F.concat(word("w"), F.lit(" "), key("k"), sign("s"))),
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain),
        (1, F.substring(base64("c"), 1, 40), F.concat(key("k"), sign("s"))),
        (1, F.concat(pick("p", ["ghp_", "xoxb-", "sk_live_", "glpat-"]), F.substring(F.regexp_replace(base64("d"), "[+/]", "x"), 1, 36)), plain),
        (1, F.substring(F.regexp_replace(base64("e"), "[+/]", "7"), 1, 24), F.concat(word("w"), F.lit(" "), key("k"), sign("s"))),
        # look-alikes
        (0, hexes("f", 40), F.concat(pick("q", ["commit", "revision", "sha1", "ref"]), F.lit(" "))),
        (0, hexes("g", 32), F.concat(pick("q", ["md5", "checksum", "etag", "uuid", "hash"]), pick("s", [": ", " = ", " "]))),
        (0, F.substring(F.regexp_replace(salt("h"), "[a-f]", "4"), 1, 16), F.concat(pick("q", ["card", "phone", "order", "", "the"]), F.lit(" "))),
        (0, F.concat(pick("q", ["your_", "example_", "sample-", "insert_", "change_"]), key("k"), F.lit("_here_"), F.substring(salt("i"), 1, 2)),
         F.concat(key("k2"), sign("s"))),
        (0, F.concat(word("w"), word("w2"), F.lit("ation"), word("w3"), F.lit("ment"), F.substring(F.translate(salt("j"), "abcdef", "123456"), 1, 1)), plain),
        (0, F.concat(F.lit("docs/release-"), word("w"), F.lit("/version-"), F.substring(F.translate(salt("l"), "abcdef", "123456"), 1, 4)), plain),
        # without digits, and short: secrets, then look-alikes
        (1, F.concat(F.lit("AKIA"), letters("m", 16, True)), plain),
        (1, letters("n", 24), F.concat(word("w"), F.lit(" "), key("k"), sign("s"))),
        (1, F.substring(F.regexp_replace(base64("o"), "[+/]", "7"), 1, 10), F.concat(word("w"), F.lit(" "), key("k"), sign("s"))),
        (1, F.substring(F.translate(salt("r"), "abcdef", "123456"), 1, 6), F.concat(word("w"), F.lit(" "), key("k"), sign("s"))),
        (0, F.concat(word("w"), word("w2"), F.lit("ation"), word("w3"), F.lit("ment"), word("w4")), plain),
        (0, F.concat(pick("p", ["docs/", "src/", "lib/"]), word("w"), F.lit("/"), word("w2"), F.lit("/version-"), word("w3")), plain),
        (0, pick("v", ["string", "none", "required", "null", "true", "false", "value", "example", "optional", "changeme", "your-password", "default"]),
         F.concat(word("w"), F.lit(" "), key("k"), sign("s"))),
        (0, F.concat(pick("v", ["the", "your", "user", "config"]), F.lit("_"), key("k2")), F.concat(key("k"), sign("s"))),
    ]
    of = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda at: F.coalesce(*[F.when(of == k, F.lit(x[at]) if at == 0 else x[at]) for k, x in enumerate(kinds)])
    path = F.when(choose(0) == 1, pick("y", ["src0", "src1", "app/main.py", "conf/settings.env", ""])).otherwise(
        pick("y", ["src0", "src1", "docs/readme.md", "test/fixtures/a.json", ""])
    )
    return spark.range(n).select(
        choose(1).alias("value"), choose(2).alias("before"), F.concat(F.lit(" "), word("w9")).alias("after"), path.alias("path"),
        choose(0).cast("double").alias("label"),
    )


def fit(findings: DataFrame) -> PipelineModel:
    """A random forest over the features of labelled findings."""
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(features(findings))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", every: bool = False) -> DataFrame:
    """``(doc_id, nth, value, before, after, path)``: candidates with the text beside them.

    All of them with ``every``, as the scan takes them; else the long ones that hold a digit.

    The text is split at the candidates; what stands beside one is the piece up to the next and that one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    run = _RUN if every else _LONG
    holds = text.rlike(run)
    runs = docs.filter(holds).select(
        F.col(id_col).alias("doc_id"), (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"),
        F.regexp_extract_all(text, F.lit(f"({run})")).alias("runs"), F.split(text, run).alias("between"),
    )
    piece = lambda name, i: F.coalesce(F.get(name, i), F.lit(""))
    found = F.transform("runs", lambda v, i: F.struct(
        i.alias("nth"), v.alias("value"), F.substring(F.concat(piece("runs", i - 1), piece("between", i)), -40, 40).alias("before"),
        F.substring(F.concat(piece("between", i + 1), piece("runs", i + 1)), 1, 40).alias("after"),
    ))
    each = F.explode(found if every else F.filter(found, lambda c: c["value"].rlike("[0-9]")))
    return runs.select("doc_id", "path", each.alias("c")).select("doc_id", "path", "c.*")


def scan(docs: DataFrame, model: PipelineModel | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate with ``probability`` and ``is_secret``; rows as of ``candidates``."""
    model = model or fit(labelled_findings(docs.sparkSession))
    scored = model.transform(features(candidates(docs, id_col, text_col, path_col, every=True)))
    chance = F.round(vector_to_array("probability")[1], 9)
    return scored.select("doc_id", "nth", "value", "before", "after", "path", chance.alias("probability"), (chance >= THRESHOLD).alias("is_secret"))


def report(docs: DataFrame) -> DataFrame:
    """Findings with the value as a hash: ``doc_id, nth, length, value_sha256, probability, is_secret``."""
    return scan(docs).select(
        "doc_id", F.col("nth").cast("long").alias("nth"), F.length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret",
    )
