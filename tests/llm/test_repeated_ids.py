"""SimHash representatives where ids repeat."""

from accountgraph.llm import simhash


def test_an_id_that_repeats_with_different_texts(spark):
    a, b = ("the first of two texts that have nothing in common at all", "quite other words fill this one here for sure today")
    docs = spark.createDataFrame([(5, a), (3, a), (5, b), (9, b), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.representatives(docs).collect()) == [(3, a), (5, b)]
    both = docs.where("doc_id = 5")
    assert sorted((r.doc_id, r.text) for r in simhash.representatives(both).collect()) == sorted([(5, a), (5, b)])
