import pytest

from lexweft.llm.queries import ORACLES, QUERIES

from ..oracle import check

EXPECTED = {
    "op4_neardup": {"doc_id", "n_shingles", "component_id", "kept"}, "op6_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op9_html": {"page_id", "url", "text", "n_chars"}, "op10_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in ORACLES:
        check(spark, small, QUERIES[name], ORACLES[name])
    else:
        df = QUERIES[name](spark, small)
        assert df.count() > 0 and EXPECTED.get(name, set()) <= set(df.columns)


def test_pages_give_back_their_documents(spark, small):
    """The pages of the test tables hold documents: the lines of the article are the lines of the text."""
    import re

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op9_html"](spark, small).collect():
        found = [int(x) for x in re.findall(r"/(\d+)(?=[./?#]|$)", r["url"])]
        lines = r["text"].split("\n")[1:]
        assert any("\n".join(lines) == "\n".join(x for x in (" ".join(y.split()) for y in docs[i].split("\n")) if x) for i in found if i in docs)


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = p.run(spark, small)
    rows = out.collect()
    ids = {r["doc_id"] for r in docs.collect()}
    assert rows and {r["doc_id"] for r in rows} <= ids and set(docs.columns) <= set(out.columns)
    n = {}
    for r in rows:
        n[r["shard"]] = n.get(r["shard"], 0) + 1
    assert max(n.values()) - min(n.values()) <= 1
    assert p.ORACLE_SQL is None and [name for name, _ in p.STAGES][0] == "quality classifier"


def test_clean_documents_survive_mixing(spark, small):
    """Mixing after the real stages before it."""
    import corpus_pipeline as p

    small = small.replace("sf0.001", "sf0.01")  # with documents of every domain left
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in p.STAGES[:3]:
        docs = stage(spark, docs, small).checkpoint()
    clean = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()}
    before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} & clean for x in (docs, p.mix_to_targets(spark, docs, small)))
    assert len(after) >= 0.95 * len(before) > 0


def test_pipeline_stages_take_odd_documents(spark, small):
    import corpus_pipeline as p

    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (None, "no id", "de", None, None), (None, None, None, None, None), (4, "word " * 2000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() <= docs.count() * 2
        assert stage(spark, docs.limit(0), small).count() == 0
    assert p.STAGES[-1][1](spark, docs, small).count() == len(rows)
