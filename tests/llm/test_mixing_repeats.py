"""Rows that repeat one another in id and text: a source of them gets its budget to within a document."""

from collections import Counter

from limnos.llm import mixing


def test_a_source_of_repeated_rows_meets_its_budget(spark):
    rows = [(i, f"one two three {i % 7}", "A", i) for i in range(1000)] + [(5000, "same words in here", "B", k) for k in range(300)] + [(7000, "x y", "C", k) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    for budget in (2600, 900, 5300):
        out = mixing.mix(df, budget=budget).collect()
        got, weight = Counter(), {}
        for r in out:
            got[r["source"]] += r["tokens"]
            weight[r["source"]] = r["weight"]
        for s in ("A", "B"):
            due = int(weight[s] * budget)
            assert due - 4 < got[s] <= due, (budget, s, got[s], due)
        draws = Counter(r["extra"] for r in out if r["source"] == "B")
        assert max(draws.values()) - min(draws.get(k, 0) for k in range(300)) <= 1
    plain = mixing.mix(df, budget=2600, plain=True)
    assert plain.columns == df.columns and plain.count() == len(mixing.mix(df, budget=2600).collect())
