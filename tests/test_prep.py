import pytest
from pyspark.sql import functions as F

from grovelight.functions import text as tx
from grovelight.operators import prep


def test_drop_all_copies(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "b", "a", None, None, "c"])], "k string, n long")
    assert sorted(r["k"] for r in prep.drop_all_duplicates(df, "k").collect()) == ["b", "c"]


def test_flatten_hierarchy(spark):
    df = spark.createDataFrame([('{"A":{"B":{},"C":{"D":{}}}}',)], "json string")
    nodes = prep.flatten_hierarchy(df, "json")
    assert {r["topic"]: r["path"] for r in nodes.collect()} == {"A": ["A"], "B": ["A", "B"], "C": ["A", "C"], "D": ["A", "C", "D"]}
    wide = {r["topic"]: (r["category_0"], r["category_1"], r["category_2"]) for r in prep.path_columns(nodes).collect()}
    assert wide == {"A": ("A", None, None), "B": ("A", "B", None), "C": ("A", "C", None), "D": ("A", "C", "D")}


def test_no_depth_is_too_deep(spark):
    df = spark.createDataFrame([('{"A":{"B":{"C":{"D":{"E":{}}}}}}',), ("{}",), (None,)], "json string")
    assert sorted(len(r["path"]) for r in prep.flatten_hierarchy(df, "json").collect()) == [1, 2, 3, 4, 5]
    assert prep.flatten_hierarchy(df.where("json = '{}'"), "json").count() == 0


def test_terms_are_taken_literally(spark):
    df = spark.createDataFrame([("axb a.b A.b a.B c",)], "t string")
    assert df.select(tx.remove_terms(F.col("t"), ["a.b", "c"])).first()[0] == "axb   a.B "


@pytest.mark.parametrize("n", [0, 1, 7, 400, 1000, 5000])
def test_samples_have_their_size(spark, n):
    got = [r["id"] for r in prep.sample_n(spark.range(1000), n, 3).collect()]
    assert len(got) == len(set(got)) == min(n, 1000)


def test_list_replies(spark):
    replies = ['["x","y"]', "text [“a”] [\"p\"]", "1. x\n2. y", "* s\n* t", "nothing"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = {r["i"]: r["l"] for r in df.select("i", tx.parse_topic_reply(F.col("r")).alias("l")).collect()}
    assert got == {0: ["x", "y"], 1: [], 2: ["x", "y"], 3: ["s", "t"], 4: []}


def test_noise_rows_join_distinct_topics(spark):
    df = spark.createDataFrame([(i, f"t{i}", "c") for i in range(40)], "id long, topic string, category_0 string")
    noise = [r for r in prep.add_noise_rows(df, 0.25, 10, 67).collect() if r["category_0"] is None]
    assert len(noise) == 10
    for row in noise:
        parts = row["topic"].split(", ")
        assert len(parts) == len(set(parts)) == 10


def test_positions_are_dense_and_repeatable(spark):
    df = spark.range(0, 3000, 7)
    first = prep.seeded_permutation(df, 5).collect()
    assert sorted(r["new_id"] for r in first) == list(range(len(first)))
    assert {r["id"]: r["new_id"] for r in first} == {r["id"]: r["new_id"] for r in prep.seeded_permutation(df.repartition(5), 5).collect()}
