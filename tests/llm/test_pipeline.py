"""The pipeline against a plain version of its stages."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import jaccard, lines, toxicity
from plumbline.llm.common import table
from tests.llm.conftest import CLASH, SCHEMA, rows_of
from tests.llm.test_operators import ALNUM, SF, plain_components, probed, words

NAMES = ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES


def test_run_equals_plain_stages(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    ordinary = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    kept = lines.dedup_lines(docs.where(F.col("doc_id").isin(list(ordinary))))
    texts = {r.doc_id: r.text for r in kept.collect()}
    texts = {i: texts[i] for i, (_, least) in plain_components(texts).items() if i == least}
    items = [words(r.text, ALNUM) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    for i, text in list(texts.items()):
        w = words(text, ALNUM)
        if any(tuple(w[k : k + m]) in windows for m in sizes for k in range(len(w) - m + 1)):
            del texts[i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == texts and 0 < len(texts) < docs.count()
    for i, r in got.items():
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.n_chars == len(texts[i])
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("rows", ["docs", "nothing"])
def test_stages_on_odd_rows(spark, rows, request):
    found = request.getfixturevalue(rows)
    for name, stage in corpus_pipeline.STAGES:
        before = found
        found = corpus_pipeline.written(stage(spark, found, SF), name)
        if name != "bpe":
            assert found.columns == before.columns
    left = found.collect()
    assert found.columns == [*before.columns, "n_tokens", "_ids", "decoded"] and "ids" in CLASH
    if rows == "nothing":
        assert not left
    else:
        assert sum(not (r.text or "").strip() for r in left) == 3
        assert sum((r.text or "").lower().startswith("the quick") for r in left) == 1 and {r.doc_id for r in left} >= {0, 1, 2, 3, 8, 9, 11}  # text 10 is near 5


def test_near_duplicates_tries_no_chance_meetings(spark, monkeypatch):
    """Documents that share one very common shingle all stay, and their sets are not moved."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", 0)
    moved = probed(monkeypatch)
    texts = ["all of them begin so " + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(100)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows_of(texts), SCHEMA), SF)
    assert {r.doc_id for r in kept.collect()} == {*range(100)} and not moved
