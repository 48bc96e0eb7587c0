"""The pipeline stage by stage on a small table, each held against what its input demands."""

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from threadloom.llm import queries, toxicity

from ..conftest import DATA
from .test_dedup import brute_components, brute_lines

BASE = f"{DATA}/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, sets = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        sets[name] = docs
        stage(spark, docs, BASE).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentencepiece":
            assert docs.columns == columns and docs.dtypes == sets[name].dtypes
        sets[name, "out"] = docs
    rows = lambda x: [(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()]

    model = toxicity.train(sets["toxicity"], spark.read.parquet(f"{BASE}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(sets["toxicity"], model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert {i for i, _ in rows(sets["toxicity", "out"])} == clean

    assert {i: t for i, t in rows(sets["line_dedup", "out"])} == {i: t for i, (_, _, t) in brute_lines(rows(sets["line_dedup"])).items()}
    assert sets["line_dedup", "out"].where("n_chars <> length(text)").count() == 0

    groups = brute_components(rows(sets["minhash_dedup"]), 80)
    assert sorted(i for i, _ in rows(sets["minhash_dedup", "out"])) == sorted(i for i, (_, c) in groups.items() if i == c)

    mixed = rows(sets["mixing", "out"])
    assert set(mixed) <= set(rows(sets["mixing"])) and max(map(mixed.count, set(mixed))) <= 3

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = sorted((r.doc_id, r.n_tokens, r.ids) for r in sets["sentencepiece", "out"].collect())
    assert out == sorted((i, len(x), x) for i, t in mixed for x in [lib.encode(t, add_eos=True)])


ODD_ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, "a line that stands here\nand another one", "en", None, 40), (4, "x" * 200_000, "de", "b", 200_000),
    (5, "word " * 30_000, "en", "b", 150_000), (6, "the same row twice, word by word", "en", "c", 32), (6, "the same row twice, word by word", "en", "c", 32), (7, "the same row twice,\nword by word", "fr", "c", None),
    (8, "é 日本 \U0001f600\r\nline with marks !!! ???", None, "é", 30),
]
CLASH = ["1 as id_", "2 as of", "3 as copies", "4 as size", "5 as drop", "6 as bucket", "7 as component", "8 as score", "9 as n_terms", "10 as line_id", "11 as toxic", "'z' as ids_", "12 as sig"]


def test_stages_on_odd_tables(spark, tmp_path):
    whole = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASH)
    want = {"toxicity": len(ODD_ROWS), "line_dedup": len(ODD_ROWS), "minhash_dedup": len(ODD_ROWS) - 1}
    for docs, name_of in ((whole, "odd"), (whole.limit(0), "none")):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            stage(spark, docs, BASE).write.parquet(f"{tmp_path}/{name_of}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name_of}/{name}")
            if name != "sentencepiece":
                assert docs.columns == whole.columns and docs.dtypes == whole.dtypes
                assert docs.where("copies <> 3 or size <> 4 or drop <> 5 or of <> 2 or id_ <> 1").isEmpty()
            if name_of == "odd" and name in want:
                assert docs.count() == want[name], name
            if name == "line_dedup":
                assert docs.where("text is null").count() == before.where("text is null").count()
        assert name_of == "odd" or docs.isEmpty()
    assert docs.columns == ["doc_id", "ids", "n_tokens"]


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
