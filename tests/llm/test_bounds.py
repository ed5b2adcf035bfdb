"""What has no bound: lengths of secrets, names of extra columns, numbers of languages."""

import random
import string

from pyspark.sql import functions as F

from sievery.llm import language_id as li
from sievery.llm import mixing
from sievery.llm import near_dedup as nd
from sievery.llm import secrets_scan as ss


def test_long_values_are_candidates_as_a_whole(spark):
    r = random.Random(4)
    made = lambda n: "aB3" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n - 3))
    values = [made(n) for n in (120, 144, 10_000, 200_000)]
    texts = [f"see {v} there" for v in values] + [f"get https://{'user' * 30}:{made(300)}@host.example/x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("web"))
    found = {r["doc_id"]: r for r in ss.scan_secrets(docs, ss.trained(spark)).collect()}
    assert [found[i]["value"] for i in range(4)] == values and {found[i]["kind"] for i in range(4)} == {"random"}
    assert (found[4]["kind"], len(found[4]["value"])) == ("url_password", 300)


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, 'password = "hV9x2LqPz7Rt4WmK8sYb"', "s", 10, 20, 30, 40), (2, "nothing here", "s", 11, 21, 31, 41), (2, "nothing here", "s", 11, 21, 31, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _was int, _found int, _hash int, _row int")
    clean = ss.redacted(docs, ss.trained(spark))
    assert clean.columns == [*docs.columns, "_secrets"]
    assert sorted((r["doc_id"], r["_was"], r["_found"], r["_hash"], r["_row"], r["_secrets"]) for r in clean.collect()) == [(1, 10, 20, 30, 40, 1), (2, 11, 21, 31, 41, 0), (2, 11, 21, 31, 41, 0)]
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["_hash"]) for r in kept.collect()) == [(1, 30), (2, 31)]


def test_four_hundred_languages(spark):
    """Each language's passages are learned in full, however many languages there are."""
    r = random.Random(9)
    alphabet = [chr(0x4E00 + i) for i in range(2000)]
    own = {f"l{k:03}": [r.choice(alphabet) for _ in range(12)] for k in range(400)}
    rows = [(i, "".join(r.choice(letters) for _ in range(700)), lang) for i, (lang, letters) in enumerate(own.items())]
    model = li.learn(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert len(model) == 400 and {sum(map(len, passages)) for passages in model.values()} == {700}
    some = [(i, "".join(r.choice(own[lang]) for _ in range(40)), lang) for i, lang in enumerate(sorted(own)[::40])]
    got = {x["doc_id"]: x["lang_pred"] for x in li.identify(spark.createDataFrame(some, "doc_id long, text string, lang string"), model).collect()}
    assert got == {i: lang for i, _, lang in some}


def test_targets_of_equal_sources(spark):
    """Sources with equal sizes and weights tie in the order in which the ceilings are met: they get equal targets, which sum to the share."""
    sizes = spark.createDataFrame([(f"s{k}", 100) for k in range(9)] + [(None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, 1.5, 2.0).collect()}
    # ten sources weigh 5, 2, 1 in turn: four of weight 5 are full at 200, the other 700 go by weight to three of 2 and three of 1
    weights = dict(zip([*(f"s{k}" for k in range(9)), None], [5, 2, 1] * 3 + [5], strict=True))
    assert {s: round(t, 9) for s, t in got.items()} == {s: {5: 200.0, 2: round(1400 / 9, 9), 1: round(700 / 9, 9)}[w] for s, w in weights.items()}
    assert abs(sum(got.values()) - 1500) < 1e-9
