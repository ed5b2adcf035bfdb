"""Secret scans in DataFrame operations only.

One regular expression finds candidates with their kind. A random forest, trained on labelled findings, tells secrets
from false positives by the candidate's length, its character transitions, how much of it dictionary words cover, the
document's path and the neighbouring words. The forest's trees become one nested CASE expression, so a whole text is
scanned, judged and, if wanted, redacted within its own row: no explode, join or shuffle of texts. A text is cut into
its candidates and the gaps between them, so the work grows with its length, however many candidates it has.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let

# A private key is its header, body and END line. Without an END line the body goes on over encryption headers and base64
# runs of 16 letters or more, up to the first shorter word, other dashes or a letter beyond ASCII; a short last line belongs to it.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
PEM_SHORT = r"(?<![A-Za-z0-9+/=\\])(?=[+/=]*[A-Za-z0-9])[A-Za-z0-9+/=]{1,15}(?![A-Za-z0-9+/=])"
PEM_LAST = r"(?:(?<=[A-Za-z0-9+/]{16}[\"']?(?:\r?\n|\\n)[\"' \t>#*]{0,8})[A-Za-z0-9+/]{1,15}={0,2}(?=\s*$|[\"' \t]*\r?\n|\\n|[\"'])|(?<=[A-Za-z0-9+/]{16} )[A-Za-z0-9+/]{1,15}={0,2}(?=\s*$)|(?<=[A-Za-z0-9+/=]))"
PEM_OPEN = r"(?:\s|\\[nr]){0,8}(?:Proc-Type: ?4,ENCRYPTED(?:\s|\\[nr]){0,8})?(?:DEK-Info: ?[0-9A-Za-z-]+(?:,[0-9A-Fa-f]+)?)?(?:(?!-----|" + PEM_SHORT + r")[\x00-\x7F])*" + PEM_LAST
# The shapes of candidates. Each names its kind; the value is the whole match, or what follows an assignment.
SHAPES = [
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[0-9A-Za-z]{30,}"),
    ("slack_token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    ("private_key", PEM + r"(?:(?s:(?:(?!-----).)*+)-----END [A-Z ]*PRIVATE KEY-----|" + PEM_OPEN + ")?"),
    ("url_password", r"(?<=://)[^\s:/@\"'<>]++:[^\s:/@\"'<>]{4,}+(?=@)"),
    ("assignment", r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?)[\"']?[ \t]{0,3}[:=]{1,2}>?[ \t]{0,3}[\"']?(?:(?!" + PEM + r")[^\s\"'<>,;#]){6,}"),
    ("hex", r"\b(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b"),
    ("random", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"),
]
PREFIX = r"^(?:[^\s:/@\"'<>]++:(?=[^\s:/@\"'<>]{4,}+$))|^(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?)[\"']?[ \t]{0,3}[:=]{1,2}>?[ \t]{0,3}[\"']?"
# Words for the dictionary coverage, and words around and paths of true and false findings.
DICTIONARY = "password passwd secret token example sample test demo dummy placeholder your here change changeme insert replace value string none null true false admin user root default letmein welcome hello world foo bar baz key api access auth login config env name data file path home local host server client public private number word text the and for with this that from not".split()
SECRET_WORDS = "password passwd pwd secret token key apikey credential credentials auth bearer private aws access login passphrase".split()
BENIGN_WORDS = "example sample test dummy placeholder commit sha sha1 sha256 md5 checksum digest hash uuid guid revision version build etag fingerprint docs tutorial fake template".split()
PATH_WORDS = "test example sample doc mock fixture demo tutorial readme".split()
FEATURES = ["length", "transitions", "chain", "distinct", "digits", "upper", "coverage", "longest_word", "path", "secret_near", "benign_near", "assigned", "known_shape", "hex_only", "same_run"]


#: Characters by class for the chain of transitions: letters, digits as one, anything else as one.
CLASSES = string.ascii_lowercase + "0-"


def running(lengths: Column, chunk: int = 256) -> Column:
    """The sums of the numbers before each place: over whole chunks first, then within the place's own."""
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)

    def summed(n: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(n) / chunk) - 1, F.lit(0))), lambda c: total(F.slice(n, (c * chunk + 1).cast("int"), F.lit(chunk))))
        starts = F.aggregate(chunks, empty, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
        return let(starts, lambda base: F.transform(n, lambda _, i: F.get(base, F.floor(i / chunk).cast("int")) + total(F.slice(n, (F.floor(i / chunk) * chunk + 1).cast("int"), i % chunk))))

    return let(lengths, summed)


def cut(text: Column) -> Column:
    """A text as struct: gaps (one more than candidates) and found, the candidates in order: (kind, value, lead, start from 1, before, after); lead is what comes before the value in the match."""
    pattern = F.lit("|".join(p for _, p in SHAPES))

    def kind_of(match: Column) -> Column:
        kind = F.when(F.contains(match, F.lit(":")), F.lit("url_password")).otherwise(F.lit(SHAPES[-1][0]))  # without what stands around it
        for name, shape in reversed(SHAPES[:-1]):
            kind = kind if name == "url_password" else F.when(match.rlike("^(?:" + shape + ")$"), F.lit(name)).otherwise(kind)
        return kind

    def located(x: Column) -> Column:
        gaps, matches = x["gaps"], x["matches"]
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

        def item(m: Column, i: Column, ends: Column) -> Column:
            value = F.regexp_replace(m, PREFIX, "")
            lead = F.length(m) - F.length(value)
            before = F.right(F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), F.get(gaps, i), F.left(m, lead)), F.lit(48))
            after = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(matches, i + 1), F.lit(""))), F.lit(32))
            return F.struct(kind_of(m).alias("kind"), value.alias("value"), F.left(m, lead).alias("lead"), (F.get(ends, i) + F.length(F.get(gaps, i)) + lead + 1).alias("start"), before.alias("before"), after.alias("after"))

        return F.struct(gaps.alias("gaps"), let(running(lengths), lambda ends: F.transform(matches, lambda m, i: item(m, i, ends))).alias("found"))

    def apart(matches: Column) -> Column:
        gaps = F.when(F.size(matches) == 0, F.array(text)).otherwise(F.split(text, pattern, -1))
        return let(F.struct(gaps.alias("gaps"), matches.alias("matches")), located)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), apart)


def classes_of(value: Column) -> Column:
    """The class of each character of a value, from 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", "-")
    return F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(CLASSES), c) - 1)


def pairs_of(value: Column) -> Column:
    """The numbers of the transitions between neighbouring characters' classes."""
    return let(classes_of(value), lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * len(CLASSES) + b))


def chain_ratios(findings: DataFrame) -> list[float]:
    """log P(b | a, secret) - log P(b | a, false positive) of each transition of character classes, from labelled findings; at most two counts a transition come to the driver."""
    k = len(CLASSES)
    pairs = findings.where("value IS NOT NULL AND label IS NOT NULL").select(F.explode(pairs_of(F.col("value"))).alias("pair"), F.col("label").cast("int").alias("label"))
    counts = [[1.0] * (k * k), [1.0] * (k * k)]
    for r in pairs.groupBy("pair", "label").count().collect():
        if 0 <= r["pair"] < k * k and r["label"] in (0, 1):
            counts[r["label"]][r["pair"]] += r["count"]
    rows = [[sum(c[a * k : (a + 1) * k]) for a in range(k)] for c in counts]
    return [math.log(counts[1][i] / rows[1][i // k]) - math.log(counts[0][i] / rows[0][i // k]) for i in range(k * k)]


def features(c: Column, path: Column, ratios: list[float]) -> dict[str, Column]:
    """The forest's features of a candidate (kind, value, before, after) of a document at `path`; ratios: of chain_ratios()."""
    value = c["value"]
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c")
    left = F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    near = F.lower(F.concat_ws(" ", c["before"], c["after"]))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one constant
    steps = F.aggregate(pairs_of(value), F.lit(0.0), lambda s, p: s + F.get(table, p))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, pattern, "")) / n

    def has(text: Column, words: list[str]) -> Column:
        return F.coalesce(text.rlike("(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])"), F.lit(False)).cast("double")

    return {
        "length": n,
        "transitions": F.length(F.regexp_replace(classes, "(.)\\1*", "x")) / n,
        "chain": F.coalesce(steps, F.lit(0.0)) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "coverage": 1 - F.length(left) / n,
        "longest_word": F.length(F.array_max(F.transform(F.split(F.lower(value), "[^a-z]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]) / n,
        "path": F.coalesce(F.lower(path).rlike("|".join(PATH_WORDS)), F.lit(False)).cast("double"),
        "secret_near": has(F.lower(c["before"]), SECRET_WORDS),
        "benign_near": has(near, BENIGN_WORDS),
        "assigned": F.coalesce(c["before"].rlike("[:=]>?[ \t]*[\"']?$"), F.lit(False)).cast("double"),
        "known_shape": (~c["kind"].isin("assignment", "hex", "random")).cast("double"),
        "hex_only": value.rlike("^[0-9a-f]+$").cast("double"),
        "same_run": (F.length(value) - F.length(F.regexp_replace(value, "(.)\\1+", "$1"))) / n,
    }


def labelled_findings(n: int = 1500, seed: int = 3) -> list[tuple]:
    """(kind, value, before, after, path, label) made by rule: random keys where secrets stand, and placeholders, digests, identifiers and words where they are mistaken for them."""
    r = random.Random(seed)
    hexes, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    pem = random.Random(seed + 1)  # draws of its own: the other findings stay as they are
    made = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    filler = lambda: " ".join(made(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(0, 4)))

    def block(name: str) -> str:
        """A private key of 2 to 50 lines, some with the line ends escaped or spaced, some cut off."""
        gap, body = pem.choice(["\n", "\n", "\r\n", "\\n", " "]), "".join(pem.choice(mixed + "+/") for _ in range(64 * pem.randint(2, 50) - pem.randint(0, 40)))
        lines = [body[i : i + 64] for i in range(0, len(body), 64)]
        return gap.join([f"-----BEGIN {name}PRIVATE KEY-----", *lines, *([f"-----END {name}PRIVATE KEY-----"] if pem.random() < 0.8 else [])])

    paths = ["src1", "src/main.py", "app/settings.yaml", "web7", "server/config.json"]
    rows = []
    for _ in range(n):
        name, eq, quote = r.choice(["password", "token", "secret", "api_key", "pwd", "access_key"]), r.choice(["=", " = ", ": "]), r.choice(["", '"'])
        path, before = r.choice(paths), f"{filler()} {name}{eq}{quote}"[-48:]
        kind, value = r.choice([
            ("assignment", made(hexes, r.choice([32, 40, 64]))), ("assignment", made(mixed, r.randint(8, 40))), ("assignment", made(hexes, r.randint(8, 31))),
            ("aws_key", "AKIA" + made(upper, 16)), ("github_token", "ghp_" + made(mixed, 36)), ("slack_token", "xoxb-" + made("0123456789", 12) + "-" + made(mixed, 24)),
            ("google_key", "AIza" + made(mixed + "_-", 35)), ("stripe_key", "sk_live_" + made(mixed, 24)), ("jwt", "eyJ" + made(mixed, 20) + "." + made(mixed, 40) + "." + made(mixed, 43)),
            ("private_key", block(r.choice(["RSA ", "EC ", ""]))), ("url_password", made(mixed + "!$%", r.randint(8, 24))), ("random", made(mixed + "+/", r.randint(24, 64)) + r.choice(["", "="])),
        ])
        if kind == "url_password":
            before = f"{filler()} {r.choice(['postgres', 'https', 'mysql', 'redis'])}://{r.choice(['admin', 'app', 'root', made(string.ascii_lowercase, 5)])}:"[-48:]
        elif kind == "random":
            before = f"{filler()} {r.choice(['Authorization: Bearer ', 'private key ', 'access token ', 'credential '])}"[-48:]
        elif kind != "assignment":
            before = r.choice([before, (filler() + " ")[-48:]])
        rows.append((kind, value, before, (quote + " " + filler())[:32], path, 1.0))
        kind, value, before, path = r.choice([
            ("assignment", r.choice(["your_token_here", "changeme", "placeholder", "example_password", "xxxxxxxxxxxx", "********", "password123", "your-api-key", "null_value", "replace_this_value", "${TOKEN}", "getenv('KEY')", "config.password", "string,", "required"]), before, path),
            ("assignment", " ".join(r.choice(DICTIONARY) for _ in range(r.randint(1, 3))).replace(" ", r.choice(["_", "-", "."])) + r.choice(["", "1", "_here"]), before, path),
            ("assignment", r.choice(["self.", "this.", "os.environ.", "get_", "request."]) + r.choice(DICTIONARY) + r.choice(["()", "_value", ""]), before, path),
            ("hex", made(hexes, r.choice([32, 40, 64])), f"{filler()} {r.choice(['commit', 'sha1', 'md5', 'sha256', 'checksum', 'digest', 'revision', 'etag'])}{r.choice([' ', ': ', '='])}"[-48:], path),
            ("hex", made(hexes, r.choice([32, 40, 64])), (filler() + " ")[-48:], path),
            ("assignment", made(mixed, r.randint(8, 30)), before, r.choice(["tests/fixtures.py", "docs/tutorial.md", "examples/demo.py"])),
            ("aws_key", "AKIA" + r.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "1234567890EXAMPL"]), f"{filler()} example key "[-48:], path),
            ("github_token", "ghp_" + "x" * 36, before, path),
            ("url_password", r.choice(["password", "changeme", "xxxx", "your_password", "${PASSWORD}", "<secret>"[1:-1], "example"]), f"{filler()} https://{r.choice(['user', 'username', 'admin'])}:"[-48:], path),
            ("random", made(mixed + "-_", r.randint(24, 64)), (filler() + r.choice([" ", " id=", " /watch/", " integrity ", " version "]))[-48:], path),
            ("random", "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(4, 7))) + str(r.randint(1, 99)), (filler() + " ")[-48:], path),
        ])
        rows.append((kind, value, before, filler()[:32], path, 0.0))
    return rows


def forest(findings: DataFrame, trees: int = 20, depth: int = 7, seed: int = 5) -> dict:
    """A model of labelled findings (kind, value, before, after, path, label): `ratios`, the chain of transitions, and `trees`, a random forest as nested dicts: feature and threshold, or the share of secrets.

    Findings with a null value or label are left out. The partitions of `findings` stay as they are."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    ratios = chain_ratios(findings)
    usable = findings.where("value IS NOT NULL AND label IS NOT NULL").withColumn("c", F.struct("kind", "value", "before", "after"))
    rows = usable.select("label", *[v.cast("double").alias(k) for k, v in features(F.col("c"), F.col("path"), ratios).items()])
    table = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(table)

    def node(n) -> dict:
        if n.subtreeDepth() == 0:
            counts = list(n.impurityStats().stats())
            return {"share": counts[1] / max(sum(counts), 1e-9)}
        return {"feature": FEATURES[n.split().featureIndex()], "at": n.split().threshold(), "low": node(n.leftChild()), "high": node(n.rightChild())}

    return {"ratios": ratios, "trees": [node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]}


def forest_score(trees: list[dict], of: Column) -> Column:
    """The mean of the trees' shares for a struct of features, as one expression."""

    def tree(t: dict) -> Column:
        return F.lit(t["share"]) if "share" in t else F.when(of[t["feature"]] <= t["at"], tree(t["low"])).otherwise(tree(t["high"]))

    total = tree(trees[0])
    for t in trees[1:]:
        total = total + tree(t)
    return total / len(trees)


def judged(text: Column, path: Column, model: dict) -> Column:
    """cut() of a text, with the score of each candidate."""

    def scored(c: Column) -> Column:
        values = F.struct(*[v.cast("double").alias(k) for k, v in features(c, path, model["ratios"]).items()])
        return F.struct(c["kind"].alias("kind"), c["value"].alias("value"), c["lead"].alias("lead"), c["start"].alias("start"), let(values, lambda v: forest_score(model["trees"], v)).alias("score"))

    return let(cut(text), lambda x: F.struct(x["gaps"].alias("gaps"), F.transform(x["found"], scored).alias("found")))


def trained(spark: SparkSession) -> dict:
    """The model of labelled_findings(), which fit one partition: the same on any cluster."""
    return forest(spark.createDataFrame(labelled_findings(), "kind string, value string, before string, after string, path string, label double").coalesce(1))


def scan_secrets(docs: DataFrame, model: dict, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row for each candidate: id, kind, value, start (character, from 1), score, is_secret (score >= least).

    Null and empty texts have no row; a null path counts as an ordinary one; null and repeated ids have their own rows
    each. Only the three columns are read; one pass without a shuffle. An empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    found = rows.select("id", F.explode(judged(F.col("text"), F.col("path"), model)["found"]).alias("f"))
    return found.select(F.col("id").alias(id_col), "f.kind", "f.value", "f.start", "f.score", (F.col("f.score") >= least).alias("is_secret"))


def redacted(docs: DataFrame, model: dict, least: float = 0.5, text_col: str = "text", path_col: str = "source", mark: str = "<SECRET>", count_col: str = "_secrets") -> DataFrame:
    """docs with every confirmed secret of the text replaced by `mark` where it stands, and count_col, how many it had. A null text stays null.

    What names the secret (`password = `) stays; equal strings elsewhere are judged for themselves. A column of docs
    with the name count_col is replaced; other columns pass through. Repeated rows are redacted alike."""
    text = F.col(text_col).cast("string")
    found = judged(F.coalesce(text, F.lit("")), F.coalesce(F.col(path_col).cast("string"), F.lit("")), model)

    def clean(x: Column) -> Column:
        parts = F.transform(x["found"], lambda f: F.when(f["score"] >= least, F.concat(f["lead"], F.lit(mark))).otherwise(F.concat(f["lead"], f["value"])))
        return F.struct(F.array_join(F.flatten(F.zip_with(x["gaps"], parts, lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "").alias("text"), F.size(F.filter(x["found"], lambda f: f["score"] >= least)).alias("n"))

    names = [c for c in docs.columns if c not in (text_col, count_col)]
    row = F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in names])
    marked = docs.select(row.alias("_row"), text.alias("_was"), let(found, clean).alias("_found"))
    out = {text_col: F.when(F.col("_was").isNotNull() & (F.col("_found.n") > 0), F.col("_found.text")).otherwise(F.col("_was")), count_col: F.col("_found.n")}
    return marked.select(*[(out[c] if c in out else F.col(f"_row.`{c}`")).alias(c) for c in dict.fromkeys([*docs.columns, count_col])])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir), trained(spark))
    return found.select("doc_id", "kind", F.md5("value").alias("value_md5"), F.length("value").cast("long").alias("length"), F.col("start").cast("long").alias("start"), F.round("score", 6).alias("score"), "is_secret")
