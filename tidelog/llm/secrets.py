r"""Secret scans: candidate strings, judged by a random forest.

Candidates are long strings with a digit or the prefix of a known kind of key,
and values behind ``=`` or ``:``. A random forest, trained on labelled
findings, removes false positives from the candidate's length, its character
transitions, how much of it dictionary words cover, signs of a path, and the
neighbouring words. The trees become one expression, so that scanning stays a
single pass of built-in functions.

The labelled findings are made by rule with a fixed seed: secrets in common
formats, and the usual false alarms (paths, addresses, digests, identifiers,
versions, placeholders, plain words).

Cases with a defined result: a null or empty text has no candidates; a
candidate that occurs several times is judged at each place; repeated rows are
judged alike; other columns are kept, except those named like an output; a
candidate of any length is one candidate.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "ghp_|gho_|github_pat_|sk-|sk_live_|rk_live_|xox[abpr]-|AIza|eyJ|glpat-|npm_|SG\\."
KNOWN_PREFIX = f"AKIA|ASIA|{PREFIX}"
RUN = "[A-Za-z0-9+/_-]"
LONG = rf"(?<!{RUN})(?:SG\.{RUN}{{16,}}+(?:\.{RUN}{{16,}}+)?|(?:(?=[A-Za-z+/_-]*+[0-9])|(?=(?:AKIA|ASIA)[A-Z2-7]{{16}}|{PREFIX})){RUN}{{16,}}+)={{0,2}}"
VALUE = r"(?<=[=:][ \x22']{0,3})[^\s\x22'<>,;|]{8,}+"
CANDIDATE = f"{LONG}|{VALUE}"
MASK = "[SECRET]"
#: Characters of context on the left and on the right.
LEFT, RIGHT = 48, 24
TREES, DEPTH, SEED = 24, 6, 7
THRESHOLD = 0.5

# Words that show what a string is.
SECRET_WORDS = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
HARMLESS_WORDS = "example|sample|dummy|placeholder|commit|checksum|digest|sha1|sha256|md5|hash|uuid|version|revision|isbn|build|image|etag|id"
DICTIONARY = (
    "about|access|account|admin|after|again|amount|apple|april|article|august|auto|back|base|before|blog|body|book|build|button|cache|call|change|chapter|city|class|client|code|color|comment|common|config|connection|content|"
    "count|country|create|current|data|date|default|delete|demo|description|detail|develop|device|display|document|download|edit|element|email|engine|error|event|every|example|export|field|file|first|folder|format|"
    "from|function|general|global|group|header|hello|home|house|html|http|image|import|index|info|input|install|issue|item|january|july|june|kilo|language|large|latest|level|library|light|line|link|list|local|login|"
    "main|make|manager|march|master|media|member|menu|message|meter|method|model|module|month|name|network|news|node|note|number|object|office|online|open|order|other|output|package|page|parent|part|path|people|"
    "photo|place|player|point|post|price|print|private|process|product|profile|project|public|python|query|read|record|release|remove|report|request|require|resource|response|result|root|sample|screen|script|search|second|section|"
    "select|server|service|session|setting|share|simple|site|size|small|source|special|stack|standard|start|state|status|store|story|stream|string|style|summer|support|system|table|task|team|template|test|text|their|theme|"
    "there|these|thing|this|thread|time|title|today|tool|total|track|type|under|unit|update|upload|user|util|value|version|video|view|water|week|where|which|white|width|window|winter|with|word|work|world|write|year|your"
)

FEATURES = ("length", "transitions", "alternation", "distinct", "digits", "uppers", "hexes", "coverage", "slashes", "dashes", "in_path", "extension", "secret_word", "harmless_word", "assigned", "known_prefix", "longest_run")


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _features(left: Column, candidate: Column, right: Column) -> list[Column]:
    """The features, in the order of ``FEATURES``."""
    size = F.char_length(candidate).cast("double")
    lower = F.lower(candidate)
    kinds = F.translate(
        candidate,
        string.ascii_lowercase + string.ascii_uppercase + string.digits,
        "a" * 26 + "A" * 26 + "0" * 10,
    )
    sounds = F.translate(lower, "bcdfghjklmnpqrstvwxyzeiou", "b" * 21 + "a" * 4)
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / size
    near = F.lower(left)
    return [
        size,
        F.regexp_count(kinds, F.lit(r"(.)(?!\1)(?=.)")) / size,
        F.regexp_count(sounds, F.lit("a(?=b)|b(?=a)")) / size,
        F.size(F.array_distinct(F.split(candidate, ""))) / size,
        share("[0-9]"),
        share("[A-Z]"),
        share("[0-9a-f]"),
        (size - F.char_length(F.regexp_replace(lower, DICTIONARY, ""))) / size,
        share("/"),
        share("[-_.]"),
        _flag(left.rlike(r"(?:\w://|www\.|/|\\|\.\./)[^\s\x22']*$")),
        _flag(F.concat(candidate, right).rlike(r"^\S*\.(?:png|jpe?g|gif|html?|php|js|css|pdf|py|txt|zip|md|json|xml|com|org|net)\b")),
        _flag(near.rlike(f"(?:{SECRET_WORDS})[^a-z]*(?:is|was|of)?[^a-z]*$")),
        _flag(near.rlike(rf"\b(?:{HARMLESS_WORDS})\b[^a-z]{{0,8}}$") | lower.rlike("example|sample|placeholder|changeme|your[_-]|xxxx|dummy|redacted")),
        _flag(left.rlike(r"[=:][\s\x22']{0,3}$")),
        _flag(candidate.rlike(f"^(?:{KNOWN_PREFIX})")),
        F.array_max(F.transform(F.split(kinds, r"(?<=(.))(?!\1)"), lambda x: F.char_length(x))) / size,
    ]


def labelled_findings(seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(left context, candidate, right context, whether it is a secret), made by rule."""
    rng = random.Random(seed)
    some = lambda alphabet, low, high=0: "".join(rng.choices(alphabet, k=rng.randint(low, high or low)))
    hexes, base = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = ["an", "ti", "er", "on", "the", "ing", "re", "st", "ou", "la", "de", "gen", "schaft", "que", "mi", "so", "ed", "ly"]
    word = lambda n=3: "".join(rng.choices(syllables, k=rng.randint(1, n)))
    words = lambda n: " ".join(word() for _ in range(n))
    common = DICTIONARY.split("|")
    found = []

    def add(label: int, left: str, candidate: str, right: str = "") -> None:
        if len(candidate) >= 8:
            found.append((f"{words(6)} {left}"[-LEFT:], candidate, f"{right} {words(3)}"[:RIGHT], label))

    names = ["password", "passwd", "token", "secret", "api_key", "apikey", "API_KEY", "access_key", "client_secret", "auth_token", "Password", "private_key", "db_password"]
    for _ in range(160):
        equals = rng.choice(["=", " = ", ": ", ":", '="', ' = "', ': "', "='"])
        close = '"' if '"' in equals else ""
        name = rng.choice(names)
        add(1, name + equals, some(hexes, 16, 64), close)
        add(1, name + equals, some(hexes, 12, 24), close)
        add(1, name + equals, some(base, 16, 48), close)
        add(1, name + equals, some(base + "!@#%^*", 10, 20), close)
        add(1, rng.choice(["", "key ", "aws ", name + equals]), "AKIA" + some(string.ascii_uppercase + "234567", 16))
        add(1, rng.choice(["", "", name + equals]), rng.choice(["ghp_", "gho_", "npm_"]) + some(base, 36))
        add(1, rng.choice(["", name + equals]), rng.choice(["sk-", "sk_live_", "glpat-", "AIza"]) + some(base + "-_", 24, 40))
        add(1, rng.choice(["Bearer ", "Authorization: Bearer "]), "eyJ" + some(base + "-_", 40, 120))
        add(1, "", some(base, 32, 44) if rng.random() < 0.5 else some(base + "+/", 38, 40))
        a, b, c = (rng.choice(common) for _ in range(3))
        year = str(rng.randint(1990, 2030))
        add(0, rng.choice(["", "see ", "file "]) + "/" * rng.randint(0, 1), f"{a}/{b}/{c}{rng.randint(1, 99)}/{word()}", rng.choice([".html", ".py", "", ".png"]))
        add(0, "https://www." + word() + ".com/", f"{a}-{b}-{year}/{c}-{word()}", rng.choice(["", ".html", "/"]))
        add(0, "", f"{a}-{b}-{year}-{c}")
        add(0, "", f"{a}_{b}_{c}_{rng.randint(1, 999)}")
        add(0, rng.choice(["commit ", "sha1: ", "sha256:", "checksum ", "md5 ", "digest: ", "etag: ", "revision "]), some(hexes, 32, 64))
        add(0, rng.choice(["id: ", "uuid=", "", "uuid ", "id="]), "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)))
        add(0, rng.choice(["", "time: ", "date=", "phone: "]), f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}" if rng.random() < 0.7 else some(string.digits, 10, 18))
        add(0, rng.choice(["version: ", "version=", "build "]), f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}-{a}{rng.randint(1, 9)}")
        add(0, rng.choice([word(), a, "note", "and", name]) + ": ", rng.choice([word(6) + word(6) + word(6), a + b, a + c + word()]) + rng.choice(["", "", ".", "s"]))
        add(0, rng.choice(["=", a + "=", a + ": "]), word(5) + word(5) + word(5))
        add(0, name + equals, rng.choice(["changeme", "your_api_key_here", "YOUR-TOKEN-123456", "xxxxxxxxxxxxxxxx1", "placeholder123", "example_key_0001", "redacted00000000", "************", "required", "undefined", a + b, a + "_" + b]), close)
        add(0, rng.choice(["", "key "]), "AKIA" + some(string.ascii_uppercase, 9) + "EXAMPLE")
        add(0, "", word(4) + word(4) + word(4) + str(rng.randint(1, 99)))
        add(0, rng.choice(["", name + equals]), rng.choice("0123456789aAxX") * rng.randint(16, 40))
        add(0, "", "1234567890" * rng.randint(2, 3))
    return found


def _tree(lines: list[tuple[int, str]]) -> Callable[[Column], Column]:
    """A printed tree as a function from the features' array to its vote."""
    depth, line = lines.pop(0)
    if line.startswith("Predict"):
        vote = float(line.split(":")[1])
        return lambda f: F.lit(vote)
    test = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    index, bound = int(test[1]), float(test[2])
    low = _tree(lines)
    if not lines[0][1].startswith("Else"):
        raise ValueError(f"unknown tree format: {lines[0][1]}")
    lines.pop(0)
    high = _tree(lines)
    return lambda f: F.when(f[index] <= bound, low(f)).otherwise(high(f))


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> Callable[[Column], Column]:
    """The forest fitted to labelled findings, as a function from the features' array to a score of 0 to 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame(findings or labelled_findings(), "l string, c string, r string, label int").coalesce(1)
    table = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*_features(F.col("l"), F.col("c"), F.col("r")))).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=48, subsamplingRate=0.8, featureSubsetStrategy="sqrt", minInstancesPerNode=3, seed=SEED)
    model = forest.fit(table)
    trees = []
    for tree in model.trees:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        trees.append(_tree(lines))
    return lambda f: sum((t(f) for t in trees[1:]), trees[0](f)) / float(len(trees))


def scan(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``findings`` (candidate, kind of rule, score, verdict) and ``clean_text`` with the secrets masked."""
    score = train(df.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = df.drop("findings", "clean_text").withColumns({"_c": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), "_p": F.split(text, CANDIDATE, -1)})
    c, p = F.col("_c"), F.col("_p")
    placed = F.transform(c, lambda x, i: F.struct(x.alias("c"), F.right(p[i], F.lit(LEFT)).alias("l"), F.left(p[i + 1], F.lit(RIGHT)).alias("r")))
    featured = F.transform(placed, lambda x: F.struct(x["c"].alias("c"), F.array(*_features(x["l"], x["c"], x["r"])).alias("f")))
    scored = F.transform(featured, lambda x: F.struct(x["c"].alias("candidate"), F.when(x["c"].rlike(f"^(?:{LONG})$"), "string").otherwise("value").alias("rule"), F.round(score(x["f"]), 6).alias("score")))
    judged = F.transform(scored, lambda x: F.struct(x["candidate"], x["rule"], x["score"], (x["score"] >= threshold).alias("secret")))
    found = base.withColumn("findings", F.when(F.size(c) > 0, judged).otherwise(F.filter(judged, lambda x: F.lit(False))))
    f = F.col("findings")
    masked = F.array_join(F.transform(p, lambda x, i: F.when(i < F.size(f), F.concat(x, F.when(f[i]["secret"], F.lit(MASK)).otherwise(f[i]["candidate"]))).otherwise(x)), "")
    return found.withColumn("clean_text", F.when(F.exists(f, lambda x: x["secret"]), masked).otherwise(F.col("text"))).drop("_c", "_p")


def contract(df: DataFrame) -> DataFrame:
    """Per document: its numbers of candidates and secrets, the secrets in order, and a digest of the masked text."""
    done = scan(df.select("doc_id", "text"))
    secrets = F.filter("findings", lambda x: x["secret"])
    return done.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.transform(secrets, lambda x: F.struct(x["rule"].alias("rule"), F.char_length(x["candidate"]).alias("length"), x["score"].alias("score"), F.sha2(x["candidate"], 256).alias("sha256"))).alias("secrets"),
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"),
    )


def mask(df: DataFrame) -> DataFrame:
    """The documents with their secrets masked, in their own columns."""
    row = F.struct(*map(F.col, df.columns))
    done = scan(df.select(row.alias("_row"), "text"))
    return done.select(*[(F.col("clean_text") if c == "text" else F.col("_row")[c]).alias(c) for c in df.columns])
