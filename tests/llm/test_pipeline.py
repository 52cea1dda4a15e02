"""The pipeline's stages against brute force, each on its own input."""

import public_tokenizers
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import odd_documents
from tests.llm.test_containment import brute as holding
from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_setsketch import brute as groups
from tests.llm.test_tokens import check_pieces, plain
from tidewatch.llm.common import written


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(written(stage(spark, states[-1], sf_dir), name))
    assert all(s.columns == docs.columns for s in states[:-1])
    raw, good, lines, near, clean, packed = states

    labels = pd.read_parquet(f"{sf_dir}/labels.parquet").set_index("doc_id").quality
    gone = {i for i, _ in pairs(raw)} - {i for i, _ in pairs(good)}
    assert gone and set(pairs(good)) <= set(pairs(raw)) and not [i for i in gone if labels.get(i) == 1]

    before = pairs(good)
    assert set(pairs(lines)) == {(i, x[0]) for (i, _), x in zip(before, without_lines(before, 40, 5), strict=True)}
    assert lines.where("n_chars != length(text)").count() == 0

    before = pairs(lines)
    kept = {i for i, (_, least) in groups(before, 80).items() if i == least}
    assert set(pairs(near)) == {(i, t) for i, t in before if i in kept}

    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    found = {x[0] for x in holding(pairs(near), list(zip(items.item_id, items.text, strict=True)))}
    assert found and set(pairs(clean)) == {(i, t) for i, t in pairs(near) if i not in found}

    last = pairs(clean)
    ids = plain(public_tokenizers.path("byte_bpe_50k.json"), [t for _, t in last], 1)
    check_pieces(packed.toPandas(), dict(zip((i for i, _ in last), ids, strict=True)))


def test_odd_rows_pass_every_stage(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), "odd")
        assert out.columns == docs.columns
        once = docs.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()
        assert once <= out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
