"""Secret scans: candidates by pattern, false positives removed by a random forest.

Native: only DataFrame and SQL functions and the JVM's random forest.

Candidates are all runs of at least ``LEAST`` characters of ``[A-Za-z0-9+/_-]``
in the white-space tokens of which one such run holds a digit, except those that
only name what follows, and key blocks from BEGIN to END (lines of a block are
candidates of their own too).  The name of a run is the ``name=`` or ``name:``
before it in the token.

Features of a candidate: its length; shares of digits, upper and lower case, hex
digits and different characters; how often each class of characters (digit, upper
case, lower case, other) gives way to each other class, and the share of common
letter pairs; the share of its characters in dictionary words; path marks
(slashes, dots, a scheme) in its field of the token; and its neighbours: whether
its name, a word between it and the run before, one of three words before or three
words behind it speaks of credentials, or of what usually carries harmless
numbers, and whether something is assigned to it.  The dictionary is the corpus' own: words of
``WORD`` letters or more that at least ``LEAST_SHARE`` of all documents (and three)
hold, with a few fixed ones.

Labelled findings train the forest.  A caller may give them (columns of
``candidates`` plus ``label``).  By default they are the candidates whose nature
their form or an assignment tells: issued key formats, key blocks and values
assigned to a credential name are secrets; decimal numbers, UUIDs, links, names
all of whose letters are dictionary words, and values assigned to a harmless name
are not.  Where both or neither hold a
candidate has no label, and only the forest judges it.  At most ``SAMPLE``
findings of each label are used, in the order of a hash.  The forest judges every
candidate, labelled or not.  If one of the labels is missing, the label decides.

Defined cases: null or empty texts have no candidates; runs without a digit in
their token are none; very long texts are scanned whole; repeated rows give
repeated findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, table, text_col, written

LEAST, SAMPLE, TREES, DEPTH, SEED = 16, 5000, 30, 6, 7
WORD, LEAST_SHARE = 4, 1e-5
RUN = r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % LEAST
CANDIDATE = r"(?:^|[^A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{%d}" % LEAST
LONG_RUN = r"[A-Za-z0-9+/_\-]{%d}" % LEAST
#: Runs joined by dots, as in signed web tokens: one field, every long run of it a candidate.
DOTTED = RUN + r"(?:\.[A-Za-z0-9+/_\-]++={0,2})*+"
NAME_ONLY = r"^[A-Za-z_.\-]+=?$"
#: What separates the fields of a token; characters of the text before a run that may name it.
BETWEEN, NEAR = r"\"'`,;&|{}()<>\[\]?#=", 200
SPACE = r"[ \t\n\x0B\f\r]+"
HEADER = "-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?(?:-----)?"
#: A key block to its end; without an end, the header and the lines of long runs behind it.
BLOCK = HEADER + r"(?:[^\-]*+(?:-(?!----(?:BEGIN|END))[^\-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?(?:-----)?|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{%d,}+)*+)" % LEAST
#: Issued key formats (fixed values).
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|xox[abp]-[A-Za-z0-9\-]{20,}|AIza[A-Za-z0-9_\-]{35})$"
CREDENTIAL = r"(?i)passw|passwd|pwd|secret|token|api[_\-]?key|apikey|access[_\-]?key|auth|credential|bearer|private"
HARMLESS = r"(?i)^(?:card|phone|tel|mail|version|commit|sha|sha1|sha256|md5|hash|id|uuid|isbn|number|no|order|page|ref|build|revision)[:=]?$"
DICTIONARY = "the and for with that this from have version license example sample test demo dummy placeholder change your name user page index image media static content article blog news http https www html com org net file path data list view item value string number default public".split()

#: Frequent letter pairs of the languages of the corpus (fixed values).
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt se ha ou le de hi ri ro ic ne ea ra ce li ch ll me ma si us ue qu ei ie ge un".split()
CLASSES = {"digit": "[0-9]", "upper": "[A-Z]", "lower": "[a-z]", "other": "[^A-Za-z0-9]"}
MOVES = [(a, b) for a in CLASSES for b in CLASSES if a != b]
#: Words of a value: parts between digits, marks and changes of case.
WORDS = "[A-Z]?[a-z]+|[A-Z]+"
UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"

FEATURES = ("length", "digits", "upper", "lower", "hex", *(f"{a}_{b}" for a, b in MOVES), "pairs", "different", "words", "path", "credential", "credential_behind", "harmless", "assigned")


def candidates(docs: DataFrame) -> DataFrame:
    """Every candidate: key (SHA-256 of the text), doc_id, token_no, name, value, before and behind (neighbour words), token (its field)."""
    text = text_col()
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # cheap tests first: a digit and a long run somewhere in the text, or a block header
    held = held.where(F.col("text").rlike("[0-9]") & F.col("text").rlike(LONG_RUN) | F.col("text").contains("-----BEGIN"))
    none = F.array().cast("array<string>")
    headed = F.col("text").contains("-----BEGIN")
    numbered = held.select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("key"), F.split("text", SPACE).alias("w"),
        F.when(headed, F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0))).otherwise(none).alias("b"),
        F.when(headed, F.split("text", BLOCK, -1)).otherwise(none).alias("g"),
    )
    tokens = F.filter(F.transform("w", lambda t, i: F.struct(i.cast("int").alias("token_no"), t.alias("token"))), lambda x: (F.length(x.token) >= LEAST) & x.token.rlike(CANDIDATE))
    # a block starts in the token after as many gaps of white space as the text before it holds
    gaps = numbered.withColumn("sg", F.transform("g", lambda t: F.regexp_count(t, F.lit(SPACE)))).withColumn("sb", F.transform("b", lambda t: F.regexp_count(t, F.lit(SPACE))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda x, y: x + y)
    blocks = F.transform("b", lambda t, k: F.struct((total(F.slice("sg", 1, k + 1)) + total(F.slice("sb", 1, k))).alias("token_no"), F.lit("-----BEGIN").alias("token"), t.alias("block")))
    both = F.concat(F.transform(tokens, lambda x: F.struct(x.token_no, x.token, F.lit(None).cast("string").alias("block"))), blocks)
    words_before = lambda n: F.when(n > 0, F.slice("w", F.greatest(n - 2, F.lit(1)), F.least(n, F.lit(3)))).otherwise(none)
    found = F.transform(both, lambda x: F.struct(x.token_no.cast("long").alias("token_no"), x.token.alias("token"), x.block.alias("block"), words_before(x.token_no).alias("before"), F.when(x.block.isNull(), F.slice("w", x.token_no + 2, 3)).otherwise(none).alias("behind")))
    out = gaps.select("doc_id", "key", F.explode(found).alias("c")).select("doc_id", "key", "c.*")

    # every dotted part of a token, with the text before and behind it
    out = out.withColumn("parts", F.when(F.col("block").isNull(), F.regexp_extract_all("token", F.lit(DOTTED), F.lit(0))).otherwise(F.array("block"))).withColumn("gaps", F.when(F.col("block").isNull(), F.split("token", DOTTED, -1)).otherwise(F.array(F.lit(""), F.lit(""))))
    part = F.transform("parts", lambda p, i: F.struct(i.alias("i"), p.alias("part"), F.coalesce(F.get("parts", i - 1), F.lit("")).alias("prev"), F.get("gaps", i).alias("gap"), F.get("gaps", i + 1).alias("after"), F.coalesce(F.get("parts", i + 1), F.lit("")).alias("next")))
    first = F.regexp_extract("token", r"^[\"'(\[{<]*([A-Za-z_.\-]+)\"?'?[=:]", 1)
    header = F.regexp_extract("block", HEADER, 0)
    out = out.select("doc_id", "key", "token_no", "before", "behind", F.when(F.col("block").isNull(), first).otherwise(header).alias("first"), F.col("block").isNotNull().alias("is_block"), F.explode(part).alias("p")).select("*", "p.*").drop("p")
    names_next = F.col("part").rlike(NAME_ONLY) & (F.col("after").rlike(r"^[\"'\\]*[=:]") | F.col("part").endswith("=") & F.concat("after", "next").rlike(r"^[\"'\\(\[{<]*[A-Za-z0-9+/_.$%@!~\-]"))
    out = out.where(F.col("is_block") | ~names_next)
    pre = F.right(F.concat("prev", "gap"), F.lit(NEAR))
    pre = F.when(F.col("part").startswith("//"), F.regexp_replace(pre, r"[A-Za-z0-9+.\-]+:$", "")).otherwise(pre)  # a scheme is no name
    own = F.regexp_extract(pre, r"([A-Za-z_.\-]+)[\"'\\]*[=:]+[\"'\\(\[{<]*$", 1)
    name = F.when(F.col("is_block") | (own == "") & (F.col("i") == 0), F.col("first")).otherwise(own)
    said = F.filter(F.split(F.right(F.concat(F.when(F.col("prev").rlike(NAME_ONLY), F.col("prev")).otherwise(""), "gap"), F.lit(NEAR)), r"[^A-Za-z0-9_\-]+"), lambda w: w != "")
    said = F.reverse(F.slice(F.reverse(said), 1, 3))
    before = F.when(F.col("i") == 0, F.concat("before", said)).when(F.size(said) > 0, said).otherwise(F.col("before"))
    field = F.concat(F.regexp_replace("gap", f"(?s)^.*[{BETWEEN}]", ""), "part", F.regexp_extract("after", f"^[^{BETWEEN}]*", 0))
    runs = F.when(F.col("is_block"), F.array("part")).otherwise(F.regexp_extract_all("part", F.lit(RUN), F.lit(0)))
    token = F.when(F.col("is_block"), F.lit("-----BEGIN")).otherwise(field)
    return out.select("doc_id", "key", "token_no", token.alias("token"), name.alias("name"), before.alias("before"), "behind", F.explode(runs).alias("value"))


def value_words(found: DataFrame) -> DataFrame:
    """(value, word, times) of the words of every different value."""
    parts = F.transform(F.regexp_extract_all("value", F.lit(WORDS), F.lit(0)), F.lower)
    return found.select("value").distinct().select("value", F.explode(F.filter(parts, lambda w: F.length(w) >= WORD)).alias("word")).groupBy("value", "word").agg(F.count("*").alias("times"))


def dictionary(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Those of the given words (word) that enough of all documents hold, and the fixed ones."""
    wanted = small_side(written(words.select("word").distinct(), "words"))
    held = docs.select(F.array_distinct(F.split(F.lower(text_col()), "[^a-z]+")).alias("w"))
    total = held.agg(F.count("*").alias("total"))
    counts = held.select(F.explode("w").alias("word")).where(F.length("word") >= WORD).join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    often = counts.crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(3.0), F.col("total") * LEAST_SHARE)).select("word")
    return often.unionByName(wanted.where(F.col("word").isin(DICTIONARY))).distinct()


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates with a double column per feature; known: dictionary words (word)."""
    v, n = F.col("value"), F.length("value").cast("double")

    def share(pattern: str, of: Column = v) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    covered = value_words(found).join(small_side(known), "word").groupBy(F.col("value").alias("_value")).agg(F.sum(F.length("word") * F.col("times")).alias("_covered"))
    covered = small_side(written(covered, "covered"), F.octet_length("_value"))
    near = F.concat(F.array("name"), "before")
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hex": share("[0-9a-f]"),
        **{f"{a}_{b}": share(f"(?<={CLASSES[a]})(?={CLASSES[b]})") for a, b in MOVES},
        "pairs": share("(?=" + "|".join(PAIRS) + ")", F.lower(v)),
        "different": F.size(F.array_distinct(F.split(v, ""))) / n,
        "words": F.col("_covered") / n,
        "path": F.regexp_count(F.col("token"), F.lit(r"[/.@]|://")).cast("double"),
        "credential": F.exists(near, lambda w: w.rlike(CREDENTIAL)).cast("double"),
        "credential_behind": F.exists("behind", lambda w: w.rlike(CREDENTIAL)).cast("double"),
        "harmless": F.exists(F.concat(near, "behind"), lambda w: w.rlike(HARMLESS)).cast("double"),
        "assigned": (owner() != "").cast("double"),
    }
    both = found.join(covered, found["value"] == covered["_value"], "left")
    return reduce(lambda df, c: df.withColumn(f"f_{c[0]}", F.coalesce(c[1], F.lit(0.0))), columns.items(), both).drop("_value", "_covered")


def owner() -> Column:
    """What a candidate is assigned to: its name, or the word before a mark of assignment."""
    last, second = F.coalesce(F.get(F.reverse("before"), F.lit(0)), F.lit("")), F.coalesce(F.get(F.reverse("before"), F.lit(1)), F.lit(""))
    return F.when(F.col("name") != "", F.col("name")).when(last.rlike("^[=:]{1,2}$"), second).when(last.rlike("[=:]$"), last).otherwise(F.lit(""))


def labelled(found: DataFrame) -> DataFrame:
    """Candidates with the label that their form or an assignment gives them (null: none)."""
    v = F.col("value")
    secret = v.rlike(FORMATS) | v.startswith("-----BEGIN") | owner().rlike(CREDENTIAL)
    harmless = v.rlike("^[0-9]+$") | v.rlike(UUID) | F.col("token").rlike("://") | owner().rlike(HARMLESS) | (F.round(F.col("f_words") * F.length(v)) == F.regexp_count(v, F.lit("[A-Za-z]")))
    return found.withColumn("label", F.when(secret & ~harmless, 1.0).when(harmless & ~secret, 0.0))


def bounded(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` different findings of each label, in the order of a hash of the value."""
    columns = ["label", *(f"f_{f}" for f in FEATURES)]
    parts = [rows.where(F.col("label") == x).select("value", *columns).dropDuplicates(["value"]).orderBy(F.xxhash64("value"), "value").limit(sample) for x in (0.0, 1.0)]
    return parts[0].unionByName(parts[1]).select(*columns)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Every candidate with its probability of being a secret: doc_id, key, token_no, value, probability, secret."""
    found = written(candidates(docs), "candidates")  # the candidates are searched once
    values = found.select("value") if findings is None else found.select("value").unionByName(findings.select("value"))
    known_words = written(dictionary(docs, value_words(values)), "dictionary")
    found = written(labelled(features(found, known_words)), "features")
    known = found if findings is None else features(findings.withColumn("label", F.col("label").cast("double")), known_words)
    train = bounded(known, sample)
    there = {r.label for r in train.select("label").distinct().collect()}
    if len(there) < 2:
        probability = F.coalesce("label", F.lit(0.5))
        return found.select("doc_id", "key", "token_no", "value", probability.alias("probability"), (probability > 0.5).alias("secret"))
    inputs = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="x")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(inputs.transform(train))
    judged = forest.transform(inputs.transform(found)).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("doc_id", "key", "token_no", "value", "probability", (F.col("probability") >= 0.5).alias("secret"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret's value replaced by a mark; all columns stay, n_chars follows the text."""
    found = scan_secrets(docs).where("secret").groupBy("key").agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("found"))
    found = small_side(written(found, "secrets"), F.aggregate("found", F.lit(16), lambda n, v: n + F.octet_length(v)))
    # all columns go as one, so that no name of theirs can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.sha2(text_col(), 256)).alias("key"))
    joined, text = rows.join(found, "key", "left"), F.col("row.text")
    clean = F.aggregate("found", text, lambda t, v: F.replace(t, v, F.lit(mark)))
    new = {"text": clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(clean).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(F.when(F.col("found").isNotNull(), new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents, judged; values are given as SHA-256."""
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "token_no", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), F.round("probability", 6).alias("probability"), "secret")


SQL: dict[str, str] = {}
