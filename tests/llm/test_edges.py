"""Every operator over nulls, empty and long texts, repeated rows, clashing columns, and empty tables."""

import pytest

from sievery.llm.registry import QUERIES

PER_ROW = ["op4_token_counts", "op5_media_columns", "op6_language_id", "op7_quality_rules", "op8_mixing", "op9_quality_classifier", "op10_minhash_near_dedup", "op11_fill_in_middle", "op13_target_resampling"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_dir, name):
    rows = QUERIES[name](spark, odd_dir).collect()
    if name in PER_ROW:
        assert len(rows) == 19
        assert sum(r["doc_id"] is None for r in rows) == 2
    else:
        assert rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_defined_results(spark, odd_dir):
    of = lambda name: [r for r in QUERIES[name](spark, odd_dir).collect() if r["doc_id"] is not None]
    counts = {r["doc_id"]: r for r in of("op4_token_counts")}
    assert (counts[0]["n_bytes"], counts[0]["n_tokens"], counts[1]["n_tokens"], counts[11]["over_limit"]) == (0, 0, 0, True)
    languages = {r["doc_id"]: r for r in of("op6_language_id")}
    assert languages[0]["lang_pred"] == languages[2]["lang_pred"] == languages[14]["lang_pred"] == "und"
    near = {r["doc_id"]: r for r in of("op10_minhash_near_dedup")}
    assert (near[0]["n_shingles"], near[0]["component_id"], near[0]["kept"]) == (0, 0, True)
    assert near[7]["component_id"] == near[8]["component_id"] == 6 and not near[7]["kept"] and near[6]["kept"]
    assert [r["license"] for r in of("op1_license_scans")] == ["MIT"]
    assert [r["is_secret"] for r in of("op3_secret_scans")] == [True]
    middle = {r["doc_id"]: r for r in of("op11_fill_in_middle")}
    assert [middle[i]["form"] for i in (0, 1)] == ["plain", "plain"] and middle[0]["middle_chars"] is None and middle[3]["n"] == 2 and middle[4]["prefix_chars"] is not None
    drawn = {r["doc_id"]: r for r in of("op13_target_resampling")}
    assert (drawn[0]["n_features"], drawn[0]["weight"], drawn[0]["rank"], drawn[5]["n_features"]) == (0, 0, None, 3)
    pages = QUERIES["op12_url_filters"](spark, odd_dir).collect()
    assert len(pages) == 19 and sum(r["rule"] == "example.net/en/" for r in pages) == 4 and sum(r["host"] == "" for r in pages) == 15
    media = {r["doc_id"]: r for r in of("op5_media_columns")}
    assert media[0]["payload_bytes"] == 64 and media[0]["payload_sha256"] == media[1]["payload_sha256"] and media[6]["media_sha256"] == media[7]["media_sha256"]
