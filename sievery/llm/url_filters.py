"""URL filters in DataFrame operations only: rules by host and path, else a logistic regression on hashed character n-grams.

Host and path are cut into runs of three to five characters, which are hashed into one vector each and weighed by their
rarity among the labelled URLs; both vectors have length one, so that a long path doesn't outweigh the host. The regression learns from a small labelled table of URLs.
"""

from __future__ import annotations

import hashlib

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MOST_RULES = 2000
# Invented hosts and path words of the small labelled table.
BLOCKED = """casino-royal win-casino online-casino casino-bonus best-bets free-bets24 sport-bets free-spins jackpot-win poker-win slots-win cheap-pills24 buy-pills pills-online
cheap-meds cheap-viagra adult-cams adult-video xxx-adult adult-zone track-visitors spam-mail spam-links link-farm seo-farm spamfarm ads-click click-track ads-server track-ads payday-loan cheap-loans
free-money crypto-win cheap-replica free-download""".split()
ALLOWED = """news library university docs museum weather recipes history garden travel school music theatre cityhall science forum wiki maps mountain ocean river health bookshop
orchestra painting station parliament harbour bakery football teacher village archive language weaving insects railway statistics bridge castle physics theorem northern thinking
distance anthology station-inn green-hill old-town city-press""".split()
BLOCKED_PATHS, ALLOWED_PATHS = "casino viagra pills bets slots xxx adult spam backlinks".split(), "about guide catalog journal novel timetable research grammar debates".split()
PLAIN_PATHS = "/en/12 /de/305 /fr/8/ /es/77.html / /page/3 /en/941/".split()
SUBDOMAINS, DOMAINS = ("", "www.", "blog.", "m."), ("com", "net", "org")
SYLLABLES = "tha ren ion sto mel qui vor end ash lim tur sen oth ble nor wen".split()


def labelled_rows() -> list[tuple[str, float]]:
    """Each labelled host at three places, so that what the places share tells nothing; each path word at two plain hosts;
    hosts of invented syllables, so that unknown words tell nothing against a host."""
    unknown = [hashlib.md5(str(i).encode()).hexdigest() for i in range(150)]
    rows = [("https://" + SUBDOMAINS[i % 4] + "".join(SYLLABLES[int(c, 16)] for c in d[: 3 + i % 3]) + ".example." + DOMAINS[i % 3] + PLAIN_PATHS[i % 7], 0.0) for i, d in enumerate(unknown)]
    for label, hosts, words in ((1.0, BLOCKED, BLOCKED_PATHS), (0.0, ALLOWED, ALLOWED_PATHS)):
        for i, host in enumerate(hosts):
            rows += [(f"https://{SUBDOMAINS[(i + k) % 4]}{host}.example.{DOMAINS[k]}{PLAIN_PATHS[(i + 2 * k) % 7]}", label) for k in range(3)]
        for i, word in enumerate(words):
            rows += [(f"https://{SUBDOMAINS[(i + k) % 4]}{ALLOWED[2 * i + k]}.example.{DOMAINS[(i + k) % 3]}/en/{word}/{i}", label) for k in range(2)]
    return rows


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    return F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def grams(text: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """The runs of each of the sizes of `^text$`, as an array; as many steps as characters, however long the text is."""

    def runs(chars: Column) -> Column:
        def run(n: int) -> Column:
            return F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - n + 1, F.lit(0))), lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))

        return F.concat(*[run(n) for n in sizes])

    return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), runs)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Of equally long ones the first by code point, block before allow.

    A rule fits its host and the hosts below it, where the path begins with the rule's. The rules are one expression: at most MOST_RULES."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules fit one expression")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2] != "block"), reverse=True):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def trained(labelled: DataFrame, buckets: int = BUCKETS, regularised: float = 0.002) -> PipelineModel:
    """A model of labelled URLs (url, label; label 1: to be blocked), a bounded table; rows with a null label are left out.

    Both labels must occur. The result depends on the rows, not on their order or partitions."""
    rows = labelled.where("label IS NOT NULL").select(F.col("label").cast("double").alias("label"), grams(host_of(F.col("url"))).alias("_host_grams"), grams(path_of(F.col("url"))).alias("_path_grams"))
    stages = []
    for part in ("host", "path"):
        stages.append(HashingTF(inputCol=f"_{part}_grams", outputCol=f"_{part}_counts", numFeatures=buckets, binary=True))
        stages.append(IDF(inputCol=f"_{part}_counts", outputCol=f"_{part}_rare"))
        stages.append(Normalizer(inputCol=f"_{part}_rare", outputCol=f"_{part}_unit"))
    stages.append(VectorAssembler(inputCols=["_host_unit", "_path_unit"], outputCol="_features"))
    stages.append(LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted", regParam=regularised, standardization=False, maxIter=30, tol=1e-6))
    return Pipeline(stages=stages).fit(rows.orderBy("label", "_host_grams", "_path_grams").coalesce(1))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, label double")


def judged(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str, str]] = RULES, least: float = 0.5, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block: the rule's, else block where the score is `least` or more) and score.

    A null url or one without :// has an empty host and path, fits no rule and is judged by the model like any other. Rows
    are independent: repeated ones are judged alike. Columns of pages with the names above are replaced, others pass
    through, whatever their names. An empty table gives an empty result. No shuffle; a url is read whole."""
    made = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in pages.columns if c not in made]
    row = F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in kept])
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    rows = pages.select(row.alias("_row"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.transform(rows.withColumns({"_host_grams": grams(F.col("host")), "_path_grams": grams(F.col("path")), "_rule": rule_of(F.col("host"), F.col("path"), rules)}))
    score = vector_to_array("_probability")[1]
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= least, "block").otherwise("allow"))
    rest = scored.withColumn("score", score)
    return rest.select(*[F.col(f"_row.`{c}`") for c in kept], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages by the rules, else by the model of the labelled table above; only page_id and url are read."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = judged(pages, trained(labelled_urls(spark)))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))
