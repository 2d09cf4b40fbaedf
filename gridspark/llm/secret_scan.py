"""Secret scans (operator 4, native): candidates, and a random forest that removes the false ones.

Every long run of RUN characters is a candidate, and every value assigned to a secret word, whatever its length and
characters. One pass of a pattern over the text marks them; what stands before and after each is cut out there. Its
features are its length, the transitions between kinds of characters and between vowels and others, how much of it a
dictionary covers, its shape, the path or source of its document and the words beside it. A random forest trained on
labelled findings gives the probability that it is a secret.
Candidates, features and forest run as DataFrame expressions and JVM model code; nothing is shuffled. Repetitions of
groups are possessive, so the pattern needs neither a deep stack nor a second try on texts of any length.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "A-Za-z0-9+/_.~-"
EDGE, OTHER = "\ufdd1", "\ufffd"  # marks the ends of a candidate; stands for it where a text has it itself
NEAR = 100  # characters before and after a candidate that its features look at
TREES, DEPTH, SEED = 24, 7, 11

#: Frequent words that names and identifiers are made of (fixed list).
DICTIONARY = "about account address after again before between build button cache class client code color config content count create data date default delete description document element error event example field file filter format function group handler header height image import index information input instance item label length license link list local login manager message method model module name network number object option order output package page param parent password path people person point position private process product project property public query record release report request resource response result return sample schema search section select server service session setting should source state status storage string style system table target template text there thing time title token type update user value version video view water where which width window with word work world would write year".split()
#: Words that announce a secret, and words that announce a harmless value of the same look (fixed lists).
SECRET_WORDS = "secret|token|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|authorization|bearer|credential|credentials|client[_-]?secret|signing[_-]?key|webhook"
HARMLESS_WORDS = "sha1|sha256|sha512|md5|commit|revision|checksum|digest|hash|uuid|guid|etag|integrity|build|version|id|isbn|card|phone|order|trace|span|request[_-]?id|fingerprint|example|sample|dummy|placeholder|test"
PATH_WORDS = "test|example|sample|mock|fixture|docs?/|vendor|node_modules|lock"
#: Beginnings that issuers give to their keys (fixed list).
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abps]-|sk_live_|rk_live_|sk-|AIza|eyJ|SG\\.|npm_|pypi-|hf_|ya29\\."

FEATURES = ["length", "digits", "uppers", "lowers", "others", "turns", "digit_turns", "vowel_turns", "distinct", "covered", "hex", "uuid", "dotted", "number", "prefix", "repeats", "assigned", "quoted", "secret_word", "harmless_word", "odd_path", "placeholder"]


def _pattern() -> str:
    """Group 1: the sign after a secret word, up to its value's quote; group 2: the value; group 3: a long run.

    The names are looked for behind a sign alone, so that words in prose cost nothing."""
    name = rf"(?i:{SECRET_WORDS})[\x22'\]]{{0,2}}"
    sign = rf"(?::=|=>|[:=])(?<={name}\x20?(?::=|=>|[:=]))\x20?(?:(?i:bearer|basic)\x20)?"
    quoted = r"(?:\x22(?=[^\x22\n]+\x22)|'(?=[^'\n]+')|[\x22']?)"
    bare = r"(?!=)[^\s\x22'<>&,;]++(?:[&,;](?![\w.\x22'-]+[=:])[^\s\x22'<>&,;]*+)*+"
    value = rf"(?<=\x22)[^\x22\n]+(?=\x22)|(?<=')[^'\n]+(?=')|{bare}"
    padding = rf"(?:={{1,2}}(?<!{name}={{1,2}})(?![=\x22'\x20{RUN}]))?"
    return rf"({sign}{quoted})({value})|((?<![{RUN}])[{RUN}]{{12,}}+{padding})"


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, path, place, before, candidate, after): each run of 12 RUN characters or more that has a digit, or 20 of mixed
    looks, and the whole value that is assigned to a secret word. place is its number among the marked runs of its text;
    before and after have NEAR characters at most. A text's own U+FDD1 is read as U+FFFD."""
    text = F.col(text_col)
    text = F.when(F.contains(text, F.lit(EDGE)), F.translate(text, EDGE, OTHER)).otherwise(text)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    marked = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.split(F.regexp_replace(text, _pattern(), f"$1{EDGE}$2$3{EDGE}"), EDGE).alias("parts"))
    # between, candidate, between, ...: each candidate with its neighbours
    part = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
    near = lambda i: F.concat(F.when(F.length(part(i - 1)) >= NEAR, F.lit("")).otherwise(F.concat(F.when(i >= 3, part(i - 3)).otherwise(""), F.when(i >= 2, part(i - 2)).otherwise(""))), part(i - 1))
    end = F.size("parts") - 2
    places = F.when(end >= 1, F.sequence(F.lit(1), end, F.lit(2))).otherwise(F.array().cast("array<int>"))
    each = F.transform(places, lambda i: F.struct(((i - 1) / 2).cast("int").alias("place"), F.right(near(i), F.lit(NEAR)).alias("before"), part(i).alias("found"), F.left(part(i + 1), F.lit(NEAR)).alias("after")))
    found = marked.select("id", "path", F.inline(each))
    name = rf"(?i:{SECRET_WORDS})[\x22'\]]{{0,2}}\x20?(?::=|=>|[:=])\x20?(?:(?i:bearer|basic)\x20)?[\x22']?$"
    found = found.select("*", F.col("before").rlike(name).alias("given"))
    c = F.when(F.col("given") & ~F.col("before").rlike("[\x22']$"), F.regexp_replace("found", r"[,;)}\]]+$", "")).otherwise(F.col("found"))
    found = found.select("id", "path", "place", "before", c.alias("candidate"), "after", "given")
    long = F.col("candidate").rlike("[0-9]") | (F.length("candidate") >= 20) & (F.col("candidate").rlike("[+/_=]") | F.col("candidate").rlike("[A-Z]") & F.col("candidate").rlike("[a-z]"))
    return found.where(F.when(F.col("given"), F.col("candidate").rlike("[^\x00-\x2F]")).otherwise(long)).drop("given")


def features(found: DataFrame) -> DataFrame:
    c, low, n = F.col("candidate"), F.lower("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    count = lambda p, x=c: F.regexp_count(x, F.lit(p)) / n
    is_ = lambda x: x.cast("double")
    before, path = F.lower(F.regexp_extract("before", r"(?:(?:^|(?<=\s))\S+\s+){0,2}\S*$", 0)), F.lower("path")
    of: dict[str, Column] = {
        "length": n, "digits": count("[0-9]"), "uppers": count("[A-Z]"), "lowers": count("[a-z]"), "others": count("[^A-Za-z0-9]"),
        "turns": count("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"), "digit_turns": count("(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]"),
        "vowel_turns": count("(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]", low), "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "hex": is_(c.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")), "uuid": is_(low.rlike("^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")), "dotted": is_(c.rlike(r"^[^.]++(?:\.[^.]++)++$")),
        "number": is_(c.rlike(r"^[0-9.+_/=~-]+$")), "prefix": is_(c.rlike(f"^(?:{PREFIXES})")), "repeats": count(r"(.)\1\1"),
        "assigned": is_(F.col("before").rlike(r"[=:]>?\s*['\x22]?\s*$")), "quoted": is_(F.col("before").rlike("['\x22]$") & F.col("after").rlike("^['\x22]")),
        "secret_word": is_(before.rlike(f"(?:^|[^a-z])(?:[a-z]+[_-])?(?:{SECRET_WORDS})(?:[^a-z]|$)")), "harmless_word": is_(before.rlike(f"(?:^|[^a-z])(?:{HARMLESS_WORDS})(?:[^a-z]|$)")),
        "odd_path": is_(path.rlike(PATH_WORDS)), "placeholder": is_(low.rlike("example|placeholder|your|changeme|dummy|xxxx|1234567|abcdef|redacted")),
    }
    return found.select("*", *(of[f].cast("double").alias(f"f_{f}") for f in FEATURES))


def made_up_findings(n: int = 3000, seed: int = SEED) -> list[tuple[str, str, int, str | None]]:
    """(path, line, label, value) of n labelled findings, made by rule: keys and passwords beside names that announce them,
    against digests, ids, numbers, addresses, paths, identifiers, placeholders and references to settings."""
    rng = random.Random(seed)
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = lambda: " ".join("".join(rng.choice(["th", "er", "on", "an", "in", "le", "de", "es", "st", "re", "ou", "ch"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
    ident = lambda: rng.choice(["_", "-", ".", "/", ""]).join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 5))) + rng.choice(["", "2", "_v3", "10"])
    syllables = lambda k: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(k))

    def password() -> str:
        word = "".join(rng.choice([c, c, c.upper(), {"a": "4", "e": "3", "i": "1", "o": "0"}.get(c, c)]) for c in syllables(rng.randint(2, 4)))
        return rng.choice([word + some("0123456789", rng.randint(1, 4)), word + rng.choice("!?&#$%*") + some("0123456789", rng.randint(1, 3)), some(alnum + "!?&#$%*", rng.randint(8, 14)), "-".join(syllables(2) for _ in range(4)), " ".join(syllables(rng.randint(2, 3)) for _ in range(4))])

    out = []
    for _ in range(n):
        label, value = int(rng.random() < 0.5), None
        if label and rng.random() < 0.25:
            value = password()
            name = rng.choice(["password", "passwd", "pwd", "db_password", "PASSWORD", "secret", "credential"])
            line = f"{prose()} {name}" + (' = "%s"' if " " in value else rng.choice([' = "%s"', ": '%s'", "=%s", ": %s", '":"%s"'])) % value + f" {prose()}"
        elif label:
            value = rng.choice([some(hexa, rng.choice([32, 40, 40, 64])), some(alnum, rng.randint(20, 44)), some(alnum + "+/", 40), "ghp_" + some(alnum, 36), "AKIA" + some(alnum[:26] + alnum[-10:], 16), "sk_live_" + some(alnum, 24), "xoxb-" + some("0123456789", 12) + "-" + some(alnum, 24)])
            name = rng.choice(["token", "token", "secret", "password", "api_key", "apikey", "access_key", "auth", "client_secret", "aws_secret_access_key", "bearer", "credential"])
            if value[:4] in ("ghp_", "AKIA", "sk_l", "xoxb") and rng.random() < 0.4:
                line = f"{prose()} {value} {prose()}"
            else:
                line = f"{prose()} {rng.choice([name, name.upper()])}" + rng.choice([' = "%s"', " = '%s'", ": %s", "=%s", ' : "%s"', " %s" if name == "bearer" else ' = "%s"']) % value + f" {prose()}"
        else:
            line = rng.choice([
                lambda: f"{prose()} {rng.choice(['commit', 'sha1', 'md5', 'checksum:', 'etag =', 'digest:', 'revision', 'sha256'])} {some(hexa, rng.choice([32, 40, 64]))} {prose()}",
                lambda: f"{prose()} {rng.choice(['uuid =', 'request_id:', 'trace', 'id ='])} {some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)} {prose()}",
                lambda: f"{prose()} {some('0123456789', rng.randint(13, 20))} {prose()}",
                lambda: f"{prose()} {rng.choice(DICTIONARY)}.{some('0123456789', 2)}@mail{some('0123456789', 1)}.example.com {prose()}",
                lambda: f"{prose()} {'.'.join(str(rng.randint(100, 255)) for _ in range(4))} {prose()}",
                lambda: f"{prose()} {rng.choice(['import', 'path =', 'file:', 'token_type =', 'see'])} {ident()} {prose()}",
                lambda: f"{prose()} https://www.{rng.choice(DICTIONARY)}.org/{ident()}?page={rng.randint(1, 99)} {prose()}",
                lambda: f"{rng.choice(['token', 'secret', 'password', 'api_key'])} = \"{rng.choice(['your_api_key_here_123', 'xxxxxxxxxxxxxxxx1', 'changeme123456789', 'EXAMPLE_TOKEN_1234567', 'placeholder-value-1', '<redacted-1234567>', '00000000000000000000'])}\" {prose()}",
                lambda: f"{prose()} token_count = {some('0123456789', 12)} {prose()}",
                lambda: f"{prose()} {rng.choice(['password', 'token', 'secret', 'auth', 'pwd', 'api_key', 'credentials'])}{rng.choice([': ', ' = ', '='])}{rng.choice(['string', 'str', 'None', 'null', 'true', 'required', 'optional', 'bool', 'getpass()', 'settings.' + rng.choice(DICTIONARY), 'os.environ[' + chr(34) + 'SECRET' + chr(34) + ']', '${' + rng.choice(DICTIONARY).upper() + '}', 'self.' + rng.choice(DICTIONARY), 'read_' + rng.choice(DICTIONARY) + '()', rng.choice(DICTIONARY), prose()])} {prose()}",
                lambda: f"{prose()} {rng.choice(['integrity =', 'hash:', 'etag:', 'fingerprint'])} {some(alnum, 43)}= {prose()}",
                lambda: f"{prose()} {rng.choice(['AbstractController', 'HttpClientFactory', 'DefaultSettingsLoader'])}{rng.choice(['Impl', 'Test', 'V2', 'Base64'])}{rng.choice(DICTIONARY).title()} {prose()}",
                lambda: f"{prose()} {''.join(rng.choice(['Ver', 'sch', 'keit', 'ung', 'ation', 'Ment', 'eur', 'lich']) for _ in range(rng.randint(4, 7)))} {prose()}",
            ])()
        out.append((rng.choice(["src/app/main.py", "conf/settings.yaml", "web", "crawl", "lib/util.go"] if label or rng.random() < 0.7 else ["tests/test_app.py", "docs/example.md", "yarn.lock", "fixtures/sample.json"]), line, label, value))
    return out


def train(spark: SparkSession, findings: DataFrame | None = None) -> RandomForestClassificationModel:
    """A forest from labelled findings (path, line, label and, if there is one, value: the secret in the line); without them,
    from made-up ones. A candidate has its line's label, but 0 where the line's value is another."""
    if findings is None:
        findings = spark.createDataFrame(made_up_findings(), "path string, line string, label int, value string")
    if "value" not in findings.columns:
        findings = findings.withColumn("value", F.lit(None).cast("string"))
    found = features(candidates(findings.select(F.struct("label", "value").alias("row"), "path", "line"), id_col="row", text_col="line", path_col="path"))
    own = F.coalesce(F.contains("candidate", "id.value") | F.contains("id.value", "candidate"), F.lit(True))
    data = _vector(found).select((F.col("id.label") * own.cast("int")).cast("double").alias("label"), "x")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(data)


def _vector(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="x").transform(found)


def scan(docs: DataFrame, model: RandomForestClassificationModel, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate of docs: id, place (its number among the marked runs of its text, from 0), candidate, score (0 to 1), is_secret.

    Null and empty texts have no candidates, a null path is an empty one, ids may be null or repeat (each row is scanned),
    an empty table gives no rows, other columns are not read."""
    found = _vector(features(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col)))
    scored = model.transform(found.select("id", "place", "candidate", "x")).select("id", "place", "candidate", vector_to_array("probability")[1].alias("score"))
    return scored.select(F.col("id").alias(id_col), "place", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark))
    return found.select("doc_id", "place", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
