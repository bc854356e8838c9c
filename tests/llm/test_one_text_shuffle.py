"""op3 shuffles the texts by id once."""

from shelfmark.llm import fingerprints

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def test_texts_are_shuffled_once(spark, edge_docs, tmp_path, monkeypatch):
    edge_docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = [], fingerprints.materialize

    def noted(df, purpose):
        if purpose == "fingerprints":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, purpose)

    monkeypatch.setattr(fingerprints, "materialize", noted)
    before = {k: spark.conf.get(k, None) for k in PLAIN}
    try:
        for k, v in PLAIN.items():
            spark.conf.set(k, v)
        fingerprints.fingerprints(spark.read.parquet(f"{tmp_path}/documents.parquet")).count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum("FileScan parquet" in line and "text" in line.split("]")[0] for line in plans[0].splitlines()) == 1
