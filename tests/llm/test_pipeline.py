import corpus_pipeline as P
from marlspark.llm import packing, quality_classifier, quality_rules, secret_scan, simhash
from marlspark.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, docs):
    """Each stage against its operator's own verdicts on what it was given."""
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "quality rules", "near duplicates", "secret scans", "best-fit packing"]
    now = docs
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        before = {r.doc_id: r for r in now.collect()}
        out = materialize(stage(spark, now, sf), f"test-{i}")
        assert out.columns == COLUMNS
        after = {r.doc_id: r for r in out.collect()}
        if i == 0:
            keep = {r.doc_id for r in quality_classifier.score(now, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
        elif i == 1:
            keep = {r.doc_id for r in quality_rules.judge(now).collect() if r.kept}
        elif i == 2:
            keep = {r.doc_id for r in simhash.near_duplicates(now).collect() if r.doc_id == r.component_id}
        else:
            keep = set(before)
        assert set(after) == keep
        for k, r in after.items():
            text = secret_scan.redact(before[k].text, secret_scan.scan(before[k].text)) if i == 3 else before[k].text
            assert r.text == text and r.n_chars == (len(text) if i == 3 else before[k].n_chars)
        now = out
    pieces = P.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in pieces} == set(after) and max(r.length for r in pieces) <= packing.LENGTH
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in P.run(spark, sf).collect())


def test_odd_rows(spark, sf, odd):
    now = odd
    for _, stage in P.STAGES:
        now = materialize(stage(spark, now, sf), "odd")
    assert now.columns[:4] == ["doc_id", "piece", "start", "length"]


def test_empty_table(spark, sf, empty):
    now = empty
    for _, stage in P.STAGES:
        now = materialize(stage(spark, now, sf), "empty")
        assert now.count() == 0
    assert {"doc_id", "sequence_id", "offset"} <= set(now.columns)


def test_one_row_of_a_repeated_id_stays(spark, sf):
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a", 1), (1, "alpha beta gamma delta epsilon", "en", "a", 1), (2, "alpha beta gamma delta epsilon", "en", "a", 1), (3, "quite another text is written here", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, df, sf).collect()) == [1, 3]


def verdicts_by_text(df, labels):
    """Rows whose text score() keeps; equal texts have equal verdicts."""
    texts = {r.n_chars: r.text for r in df.collect()}
    rows = df.withColumn("doc_id", df.n_chars)
    model = quality_classifier.train(quality_classifier.features(quality_classifier.statistics(df)), quality_classifier.marks(labels))
    feats = quality_classifier.features(quality_classifier.statistics(rows))
    kept = {r.doc_id for r in feats.filter(model.column() >= quality_classifier.THRESHOLD).collect()}
    return df.sparkSession.createDataFrame([(i, texts[i]) for i in kept], "n_chars bigint, text string")


def test_verdicts_are_each_rows_own(spark, sf, docs):
    """Null and repeated doc_ids: every stage keeps just the rows that it keeps where ids are distinct."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [tuple(r) for r in docs.select(*COLUMNS).orderBy("doc_id").collect()]
    # n_chars tells the rows apart
    plain = [(i, *r[1:4], i) for i, r in enumerate(rows)]
    odd = [(None if i % 3 == 0 else 7, *r[1:]) for i, r in enumerate(plain)]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for stage, verdict in ((P.quality, lambda d: verdicts_by_text(d, labels)), (P.rules, lambda d: quality_rules.judge(d.drop("doc_id").withColumnRenamed("n_chars", "doc_id")).filter("kept").withColumnRenamed("doc_id", "n_chars"))):
        df = materialize(spark.createDataFrame(odd, schema), "odd")
        kept = sorted(r.n_chars for r in stage(spark, df, sf).collect())
        assert kept == sorted(r.n_chars for r in verdict(df).collect())
    assert 0 < len(kept) < len(rows)


def test_one_row_of_each_group_stays(spark, sf):
    a, b, c = "alpha beta gamma delta epsilon", "quite another text is written here", "a third text that stands alone"
    rows = [(None, a, "en", "a", 0), (1, a, "en", "a", 1), (1, b, "en", "a", 2), (None, b, "en", "a", 3), (1, c, "en", "a", 4), (None, "none has an id", "en", "a", 5), (None, "none has an id", "en", "a", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    assert sorted(r.n_chars for r in P.near_duplicates(spark, df, sf).collect()) == [1, 2, 4, 5]
