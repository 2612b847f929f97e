"""Secret scans: a random forest removes the false positives of a wide candidate search.

Candidates are all long runs of token characters with digits or mixed letters, however many stand in one
word (minified JSON, settings, URLs), and shorter ones behind a hint such as ``password=``. Their features are length, character
transitions, character shares, dictionary coverage, path marks and the neighbouring words; the
forest is trained from labelled findings. Everything runs as DataFrame functions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = 10_000  # rows of the built-in labelled findings
LEAST = 16  # characters of a candidate
SHORT = 8  # of one behind a hint

# Words that names and prose are made of (own choice).
DICTIONARY = (
    "the and for with that this from value string number index object array function class return import export "
    "config default test sample example placeholder name user file path data list table key public private static "
    "version build release module package service client server handler manager factory controller request response "
    "error message update create delete select insert where order group filter document license copyright "
    "tion ing heit keit ung lich schaft mente ción ment elle"
).split()
HINTS = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|auth|credential|private)"
PLAIN = r"(?i)(example|sample|placeholder|changeme|dummy|xxxx|your[_-]|commit|revision|checksum|sha1|md5|uuid|id)"


# A name that a secret is given to, up to the value; the user part of a URL is one as well.
_GIVEN = (r"(?i)(?:(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key)"
          r"[a-z0-9_-]{0,20}[\"'`]{0,2}[=:]{1,2}[\"'`(]{0,2}|://[^\s/:@]{0,64}:)")
_RUN = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
# Behind a hint any characters but quotes and separators belong to the value.
_SHORT_RUN = r"(?<=[=:\"'`(])[^\s\"'`<>(),;:&@{}\[\]=]{8,}"
_MIXED = r"[0-9]|[A-Z][^A-Z]*[A-Z]"


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, word_at, nth, key_part, value, before, after)`` for the runs of each text that may be secrets.

    A word ends at ASCII white space; a word of any length is read whole. Runs of ``LEAST`` token
    characters are candidates wherever they stand, ``nth`` counts them in their word; ``key_part`` is what stands before a run,
    from the run before it on. In a word that gives a name or the user of a URL a value (or follows
    such a name), runs of ``SHORT`` characters are candidates too. Null and empty texts have none.
    """
    words = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))

    def last(i: Column) -> Column:
        """The word before; a lone sign of assignment together with its name."""
        one = F.coalesce(F.get("w", i - 1), F.lit(""))
        return F.when(one.isin("=", ":"), F.concat(F.coalesce(F.get("w", i - 2), F.lit("")), one)).otherwise(one)

    def follows(i: Column) -> Column:
        return F.substring(last(i), -1, 1).isin("=", ":") & last(i).rlike(_GIVEN + "$")

    def given(i: Column) -> Column:
        return F.get("w", i).rlike(_GIVEN + ".") | follows(i)

    at = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: (F.length(F.get("w", i)) >= SHORT) & F.get("w", i).rlike(_MIXED)
        & (((F.length(F.get("w", i)) >= LEAST) & F.get("w", i).rlike(_RUN)) | given(i)))
    found = rows.filter(F.size("w") > 0).select("doc_id", F.explode(F.transform(at, lambda i: F.struct(
        i.alias("word_at"), F.get("w", i).alias("word"), given(i).alias("given"), follows(i).alias("follows"), last(i).alias("last"),
        F.concat_ws(" ", F.get("w", i - 3), F.get("w", i - 2), F.get("w", i - 1)).alias("before"),
        F.coalesce(F.get("w", i + 1), F.lit("")).alias("after")))).alias("c")).select("doc_id", "c.*")
    # A mark before a word that follows a name lets its beginning count as behind the hint.
    marked = F.when(F.col("follows"), F.concat(F.lit("="), "word")).otherwise(F.col("word"))
    runs = F.when(F.col("given"), F.regexp_extract_all(marked, F.lit(_SHORT_RUN + "|" + _RUN), F.lit(0))).otherwise(
        F.regexp_extract_all("word", F.lit(_RUN), F.lit(0)))
    listed = found.withColumn("runs", runs).select("*", F.posexplode("runs").alias("nth", "value"))
    # The text before a run, from the end of the run before it: cut at the runs, in their order.
    rest = F.aggregate(F.slice("runs", 1, F.col("nth")), F.col("word"), lambda text, run: F.substring(
        text, F.instr(text, run) + F.length(run), F.length(text)))
    earlier = F.when(F.col("nth") > 0, F.element_at("runs", F.greatest(F.col("nth"), F.lit(1)))).otherwise("")
    key_part = F.concat(earlier, F.substring(rest, F.lit(1), F.greatest(F.instr(rest, F.col("value")) - 1, F.lit(0))))
    behind = F.concat("last", key_part)
    return listed.withColumn("key_part", key_part).filter(
        F.col("value").rlike(_MIXED) & ((F.length("value") >= LEAST) | behind.rlike(_GIVEN + r"[\"'`(]*$"))).select(
        "doc_id", F.col("word_at").cast("int").alias("word_at"), F.col("nth").cast("int").alias("nth"),
        "key_part", "value", "before", "after")


def _share(pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def features(found: DataFrame) -> DataFrame:
    """``found`` with the array column ``x``."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "value", "[0-9]", "\u0001"), "[A-Z]", "\u0002"), "[a-z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "x"))
    chars = F.split("value", "")
    near = F.concat_ws(" ", "before", "key_part")
    columns = [
        F.length("value").cast("double"), (runs / F.length("value")), _share("[0-9]"), _share("[A-Z]"),
        _share("[a-z]"), _share("[aeiouAEIOU]"), F.size(F.array_distinct(chars)) / F.length("value"),
        _share("(?i)" + "|".join(DICTIONARY)),
        F.length(F.regexp_replace("value", "[^/]", "")).cast("double"),
        F.length(F.regexp_replace("value", "[^_-]", "")).cast("double"),
        F.col("value").rlike("^[0-9a-fA-F]+$").cast("double"), F.col("value").rlike("^[0-9-]+$").cast("double"),
        F.col("value").rlike("^(AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-|AIza)").cast("double"),
        near.rlike(HINTS).cast("double"), near.rlike(PLAIN).cast("double"), F.col("value").rlike(PLAIN).cast("double"),
        F.col("key_part").rlike("[=:]").cast("double"), F.col("key_part").rlike("(://|/|\\\\)").cast("double"),
        F.concat("key_part", "before").rlike("[\"'`]").cast("double"),
    ]
    return found.withColumn("x", F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns]))


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Labelled findings in the form of ``candidates`` with ``label``: shapes of credentials as they are
    leaked, and shapes that only look like them. Random parts come from hashes of the row number."""
    n = F.col("id")
    hexes = F.sha2(n.cast("string"), 256)
    base = F.regexp_replace(F.base64(F.unhex(hexes)), "[=+/]", "")
    upper = F.upper(F.translate(hexes, "0189", "WXYZ"))
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    prose = F.concat_ws(" ", word(1), word(2), word(3))
    empty = F.lit("")
    shapes = [  # label, before, key part, value
        (1, prose, F.lit("password="), F.substring(hexes, 1, 18)),
        (1, F.concat_ws(" ", word(1), F.lit("token =")), F.lit('"'), F.substring(hexes, 1, 40)),
        (1, prose, empty, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16))),
        (1, F.concat_ws(" ", word(1), F.lit("secret:")), empty, F.substring(base, 1, 32)),
        (1, prose, F.lit("api_key="), F.substring(base, 1, 28)),
        (1, prose, empty, F.concat(F.lit("ghp_"), F.substring(base, 1, 36))),
        (0, prose, empty, F.concat(word(4), word(5), word(6), word(7), word(8))),
        (0, prose, empty, F.concat(F.initcap(word(4)), F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(7)), (n % 10).cast("string"))),
        (0, prose, empty, F.substring(F.translate(hexes, "abcdef", "123456"), 1, 16)),
        (0, F.concat_ws(" ", word(1), F.lit("commit")), empty, F.substring(hexes, 1, 40)),
        (0, F.concat_ws(" ", word(1), F.lit("sha1 checksum")), empty, F.substring(hexes, 1, 40)),
        (0, prose, F.lit("https://"), F.concat(word(4), F.lit("/"), word(5), F.lit("/"), word(6), F.lit("-"), (n % 1000).cast("string"), F.lit("/"), word(7))),
        (0, prose, F.lit("src/"), F.concat(word(4), F.lit("/"), word(5), F.lit("_"), word(6), F.lit("/"), word(7), (n % 100).cast("string"))),
        (0, prose, empty, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))),
        (0, prose, F.lit("api_key="), F.concat(F.lit("your_"), word(4), F.lit("_key_here_"), (n % 100).cast("string"))),
        (0, prose, F.lit("password="), F.concat(F.lit("xxxxxxxxxxxx"), (n % 10_000).cast("string"), F.lit("xxxx"))),
        (1, prose, F.lit("password="), F.concat(F.substring(base, 1, 5), (n % 10).cast("string"), F.substring(base, 6, 5))),
        (1, prose, F.concat(word(4), F.lit('","token":"')), F.concat(F.lit("ghp_"), F.substring(base, 1, 36))),
        (1, prose, F.concat(F.lit("postgres://"), word(4), F.lit(":")), F.concat(F.substring(base, 1, 6), (n % 100).cast("string"), F.substring(base, 9, 4))),
        (1, prose, F.concat(F.lit("https://"), word(4), F.lit(".net/?key=")), F.concat(F.lit("AIza"), F.substring(base, 1, 35))),
        (1, F.concat_ws(" ", word(1), F.lit("secret =")), F.lit('"'), F.concat(F.substring(base, 1, 10), (n % 10).cast("string"))),
        (0, prose, F.lit("password="), F.concat(F.lit("your-pass-"), (n % 10).cast("string"))),
        (0, prose, F.lit("password:"), F.concat(word(4), (n % 10).cast("string"), word(5))),
        (0, prose, F.concat(F.lit("https://"), word(4), F.lit(":")), F.concat((n % 9000 + 1000).cast("string"), F.lit("/"), word(5), F.lit("/"), word(6))),
        (0, prose, F.lit("token="), F.concat(F.lit("example"), (n % 100).cast("string"))),
        (1, prose, F.lit("secret_key='"), F.concat((n % 10).cast("string"), F.substring(base, 1, 13))),
    ]
    which = (n % len(shapes)).cast("int")
    pick = lambda k: F.element_at(F.array(*[s[k] if isinstance(s[k], Column) else F.lit(float(s[k])) for s in shapes]), which + 1)
    return spark.range(rows).select(
        n.alias("doc_id"), F.lit(0).alias("word_at"), pick(2).alias("key_part"), pick(3).alias("value"),
        pick(1).alias("before"), word(9).alias("after"), pick(0).alias("label")).filter(F.length("value") >= SHORT)


def fit(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    """The forest from labelled findings (``candidates`` columns and ``label``)."""
    return RandomForestClassifier(
        featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=4
    ).fit(_vectors(features(labelled)))


def _vectors(rows: DataFrame) -> DataFrame:
    width = _WIDTH
    flat = rows.select("*", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)])
    return VectorAssembler(inputCols=[f"x{i}" for i in range(width)], outputCol="v").transform(flat)


_WIDTH = 19


def findings(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """``(doc_id, word_at, nth, key_part, value, score, secret)`` for each candidate of ``docs (doc_id, text, ...)``.

    ``secret`` is true from a score of 0.5 on. Rows are independent: repeated rows repeat their
    findings. Null and empty texts have none, further columns are ignored, no rows give no rows.
    """
    model = model or fit(labelled_findings(docs.sparkSession))
    scored = model.transform(_vectors(features(candidates(docs))))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "word_at", "nth", "key_part", "value", score.alias("score"), (score >= 0.5).alias("secret"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the values of all accepted findings replaced in ``text``; columns stay as they are.

    Only rows with a finding change. Longer values are replaced first, so that a value that holds
    another one goes as a whole. Findings go by ``doc_id``: rows that share one, or have none, share
    their list of values, and a value that is a secret in one of them is replaced in all."""
    found = findings(docs).filter("secret").groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    found = found.select(F.col("doc_id").alias("found_id"), F.array_sort(
        "values", lambda a, b: F.length(b) - F.length(a)).alias("found_values"))
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["found_id"]), "left")
    values = found["found_values"]
    clean = F.when(values.isNull(), docs["text"]).otherwise(F.aggregate(
        values, docs["text"], lambda text, value: F.replace(text, value, F.lit(mark))))
    return joined.select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of ``documents`` with their scores; values as SHA-256 only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return findings(docs).select(
        "doc_id", "word_at", "nth", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("value_length"),
        "score", "secret")
