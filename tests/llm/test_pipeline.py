"""The pipeline's stages on small data, each on what the one before kept."""

import corpus_pipeline
from quillstone.llm import decontaminate, recompress, tensor_minhash
from quillstone.llm.common import table

DATA = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], DATA).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    for a, b in zip(kept, kept[1:]):
        assert b.count() <= a.count()
    for d in kept[:-1]:
        assert set(d.columns) == set(corpus_pipeline.COLUMNS)
    toxic = {r[0] for r in table(spark, DATA, "labels").where("quality = 0").select("doc_id").collect()}
    left = {r[0] for r in kept[1].select("doc_id").collect()}
    assert len(toxic & left) <= 0.2 * len(toxic) and len(left) >= 0.5 * docs.count()
    assert tensor_minhash.near_duplicates(kept[2], 5, 80).where("not kept").count() == 0
    assert recompress.substring_dedup(kept[2]).where("n_removed > 0").count() > 0
    bench = table(spark, DATA, "benchmark")
    assert decontaminate.decontaminate(kept[4], bench).where("contaminated").count() == 0
    assert kept[5].count() == kept[4].count()
