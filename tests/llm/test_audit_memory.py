"""Shards are many MB a row: a task of the audit holds one of them at a time."""

import pyarrow.parquet as pq

from limnos.llm import filter_audit


def test_each_shard_is_a_row_group_and_none_are_collected(spark, monkeypatch):
    write, groups, plans = filter_audit.materialize, [], []

    def told(df, name, **options):
        out = write(df, name, **options)
        if name == "csr-shards":
            groups.extend(pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in out.inputFiles())
        else:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(filter_audit, "materialize", told)
    docs = spark.range(0, 3, 1, 1).selectExpr("id as doc_id", "'s' as source", "array_join(transform(sequence(1, 2000000), x -> cast(x + id * 2000000 + 10000000 as string)), ' ') as text")
    rows = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("step = 1 and filter_order = 'ABCDE'").collect()
    assert [(r["kept"], r["removed"]) for r in rows] == [(3, 0)]
    assert [m.num_rows for m in groups] == [m.num_row_groups for m in groups] and sum(m.num_rows for m in groups) == 3
    assert plans and "collect_list" not in plans[0]
