import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.functions import vector


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("  (Kerala). ", "kerala"), ("India's", "india"), ("Ghats", "ghats"), ("rock-n-roll", "rock-n-roll"), ("boys'", "boys"), ("New   York", "new york")])
def test_entity_key_trims_ends_and_possessive_only(spark, name, want):
    assert one(spark, tx.normalised_entity(F.lit(name))) == want


@pytest.mark.parametrize(("name", "want"), [("Wayanad", True), ("123", False), ("---", False), (" ", False), ("a, b", False), ("x" * 65, False), ("one two three four five six seven", False), ("Western Ghats", True)])
def test_implausible_names_are_noise(spark, name, want):
    assert one(spark, tx.is_plausible_entity(F.lit(name))) is want


def test_similarity_is_the_jaccard_of_padded_trigrams(spark):
    assert one(spark, tx.similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, tx.similarity(F.lit(""), F.lit("!"))) == 0


def test_quick_rank_prefers_exact_then_prefix_and_takes_wildcards_literally(spark):
    rows = spark.createDataFrame([("Roadmap",), ("Roadmap 2026",), ("The roadmap",), ("100% done",), ("Other",)], "t string")
    got = {r.t: r.r for r in rows.select("t", tx.quick_rank(F.col("t"), "roadmap").alias("r")).collect()}
    assert got["Roadmap"] == 1.0 and got["Roadmap 2026"] == 0.9 and 0 < got["The roadmap"] < 0.9 and got["Other"] is None
    assert [r.t for r in rows.where(tx.quick_rank(F.col("t"), "%").isNotNull()).collect()] == ["100% done"]


@pytest.mark.parametrize(("text", "least", "most"), [("word " * 100, 130, 130), ("漢" * 200, 200, 200), ("x" * 2000, 500, 500), ("", 0, 0)])
def test_token_estimate_counts_words_dense_characters_and_a_floor(spark, text, least, most):
    assert least <= one(spark, tx.estimated_tokens(F.lit(text))) <= most


@pytest.mark.parametrize(("question", "summary", "want"), [("tuning postgres", "Postgres tuning notes", 1.0), ("tuning postgres", "baking bread", 0.0), ("tuning bread", "baking bread", 0.5), ("to of in", "to of in", 0.0)])
def test_relevance_is_the_share_of_long_terms(spark, question, summary, want):
    assert one(spark, tx.relevance(question, F.lit(summary))) == want


@pytest.mark.parametrize(("pattern", "want"), [("Hi {{ who }}!", "Hi Ann!"), ("{{who}}{{who}}", "AnnAnn"), ("{{ else }}", "{{ else }}"), ("open {{who", "open {{who"), ("none", "none"), ("", "")])
def test_template_fills_known_keys_alone(spark, pattern, want):
    assert one(spark, tx.substituted(F.lit(pattern), {"who": F.lit("Ann")})) == want


def test_template_values_are_not_filled_again(spark):
    assert one(spark, tx.substituted(F.lit("{{a}}"), {"a": F.lit("{{b}}"), "b": F.lit("no")})) == "{{b}}"


@pytest.mark.parametrize(("then", "want"), [("2026-01-01 00:00:30", "just now"), ("2025-12-31 23:59:00", "1 minute ago"), ("2025-12-31 22:00:00", "2 hours ago"), ("2025-12-01 00:00:00", "1 month ago"), ("2023-01-01 00:00:00", "3 years ago")])
def test_relative_time(spark, then, want):
    assert one(spark, tx.relative_time(F.lit(then).cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))) == want


def test_member_hash_ignores_order(spark):
    a, b = (one(spark, tx.member_set_hash(F.array(*map(F.lit, x)))) for x in ("ab", "ba"))
    assert a == b != one(spark, tx.member_set_hash(F.array(F.lit("ab"))))


def test_cosine_distance_runs_from_same_to_opposite(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert [round(one(spark, vector.cosine_distance(v(1.0, 0.0), y)), 9) for y in (v(2.0, 0.0), v(0.0, 3.0), v(-1.0, 0.0))] == [0, 1, 2]
