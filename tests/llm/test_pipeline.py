"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import collections
import zlib

import corpus_pipeline
import numpy as np
from test_ops import near_classes

from texelflow.llm import quality, secret_scan

SF = "/root/testdata/sf0.01"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, tmp_path, tiktoken_encoding):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    source = rows(spark.read.parquet(f"{SF}/documents.parquet"))
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {d for d, r in source.items() if quality.scores([r["text"] or ""], *model)[0] >= 0.3}
    first = rows(kept[0])
    assert set(first) == good and all(first[d] == source[d] for d in good)
    groups = collections.defaultdict(list)
    for d, r in first.items():
        groups[r["text"]].append(d)
    second = rows(kept[1])
    assert set(second) == {max(v) for v in groups.values()}
    third = rows(kept[2])
    classes = near_classes([(d, r["text"]) for d, r in second.items()])
    assert sorted(map(str, third)) == sorted(str(max(map(int, c))) for c in classes)
    fourth = rows(kept[3])
    assert set(fourth) == set(third)
    spans = {r["id"]: r["found"] for r in secret_scan.scan(kept[2]).withColumnRenamed("doc_id", "id").collect()}
    assert any(spans.values())
    for d, r in fourth.items():
        assert (r["text"] == third[d]["text"]) == (not spans[d]) and ("[SECRET]" in r["text"]) == bool(spans[d])
    for r in kept[4].collect():
        x = [*tiktoken_encoding.encode_ordinary(fourth[r["doc_id"]]["text"]), 0]
        assert r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert kept[4].groupBy().sum("length").first()[0] == sum(len(tiktoken_encoding.encode_ordinary(r["text"])) + 1 for r in fourth.values())
