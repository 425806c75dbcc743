"""Passages of fewer words than a seed spans."""

from folioform.llm import leaks


def test_short_passages_are_found_whole(spark):
    long = "a b c d e f g h i j k l m n"
    texts = {1: "x one Two, three y", 2: "one two", 3: "one two four three", 4: long, 5: "three", 6: None, 7: "one two three one two three"}
    items = {1: "One two three!", 2: "three", 3: long, 4: "", 5: None, 6: "one two three", 7: "k l m n o"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = leaks.leaked_passages(docs, "id", "text", spark.createDataFrame(list(items.items()), "item long, passage string"), "item", "passage")
    words = {k: (t or "").lower().replace(",", "").replace("!", "").split() for k, t in [*texts.items()]}
    want = set()
    for i, p in items.items():
        q = (p or "").lower().replace("!", "").split()
        want |= {(i, d, *[len(q)] * 4) for d, w in words.items() if q and any(w[k : k + len(q)] == q for k in range(len(w)))}
    assert {tuple(r) for r in found.collect()} == want and len(want) == 9
    assert {tuple(r) for r in leaks.exact_leaks(found).collect()} == {(3, 4)}
