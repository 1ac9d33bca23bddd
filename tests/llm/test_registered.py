"""Registration, SQL of the queries that have it, and the pipeline against a brute-force version."""

from __future__ import annotations

import math
from collections import Counter

import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline
from quarryline.llm import language_id, piece_tokenizer, queries
from quarryline.session import table
from tests.compare import duck, sparks
from tests.llm import test_exact_dedup, test_mixing, test_near_dedup, test_similar_texts
from tests.llm.helpers import SF, by_id, documents


def test_all_are_registered():
    named = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in named) for i in range(1, 14)] == [1] * 13 and "pipeline" in named
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_matches_sql(spark, name, sf):
    assert sparks(queries.QUERIES[name](spark, sf)) == duck(queries.ORACLE_SQL[name], sf)


def test_near_dedup_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(d.doc_id, d.text) for d in table(spark, sf, "documents").collect()]
    assert test_near_dedup.shown(queries.op3_simhash(spark, sf)) == test_near_dedup.brute(rows)


def test_pipeline_matches_brute_force(spark):
    table_docs = table(spark, SF, "documents")
    docs = {d.doc_id: d for d in table_docs.collect()}
    told = by_id(language_id.identify(table_docs, language_id.train(table_docs)))
    kept = {i for i in docs if told[i].lang_pred != language_id.UNKNOWN and told[i].score >= 0.5}
    kept = {i for i, _, _, first, _ in test_exact_dedup.brute([(i, docs[i].text) for i in kept]) if first}
    kept = set(test_similar_texts.brute_kept([(i, docs[i].text) for i in kept]))
    times = Counter()
    for i, n, _, _, taken in test_mixing.brute([(i, docs[i].text, docs[i].source) for i in kept]):
        times[int(i)] += math.ceil(taken / n) if taken else 0
    other = sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer.MODEL_PATH)
    expected = Counter({(i, tuple(other.encode(docs[i].text))): n for i, n in times.items() if n})
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids", "round_trip", "parity"]
    rows = found.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == expected and all(r.round_trip and r.parity for r in rows)
    assert len(expected) > 100


def test_stages_keep_awkward_rows_and_columns(spark):
    text = " ".join(f"river stone {i} bridge water night" for i in range(40))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + " more", "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, "x " * 50_000, "de", "b"), (None, "river of night", "en", None)]
    docs = documents(spark, [(i, t, lang, source) for i, t, lang, source in rows], "whole root node key place q_id mix_words a.b w`x")
    for given in (docs, documents(spark, [], "whole root")):
        kept = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, kept, SF)
            assert found.columns == given.columns
            kept = spark.createDataFrame(found.collect(), given.schema)
        assert corpus_pipeline.tokenize(spark, kept, SF).count() == kept.count()
        assert not {2, 3, 4} & {r.doc_id for r in kept.collect()}


def test_what_lies_between_stages_goes(spark):
    corpus_pipeline.run(spark, SF).count()
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in store.listStatus(path) if s.getPath().getName().startswith("pipeline-")]
    assert folders and all([x.getPath().getName() for x in store.listStatus(f)] == ["mixing"] for f in folders)
