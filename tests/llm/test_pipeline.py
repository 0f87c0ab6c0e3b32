"""The stages by themselves and one after the other."""

from collections import Counter

import edge
import corpus_pipeline
from promolith.llm import common, quality, secrets, simhash, toxicity


def test_stages(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    labels = quality.labels_of(spark, sf_dir)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "toxicity", "simhash near-dedup", "secret scans", "packing"]
    before = common.stored(docs)
    kept = common.stored(stages["quality rules"](spark, before, sf_dir))
    good = {r.doc_id for r in quality.judge_quality(before, labels).filter("kept").collect()}
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == good
    clean = common.stored(stages["toxicity"](spark, kept, sf_dir))
    calm = {r.doc_id for r in toxicity.score_toxicity(kept, labels).filter("predicted = 0").collect()}
    assert clean.schema == docs.schema and {r.doc_id for r in clean.collect()} == calm
    unlike = common.stored(stages["simhash near-dedup"](spark, clean, sf_dir))
    classes = simhash.near_duplicates(clean).collect()
    assert sorted(r.doc_id for r in unlike.collect()) == sorted({r.component_id for r in classes}) and unlike.schema == docs.schema
    safe = common.stored(stages["secret scans"](spark, unlike, sf_dir))
    texts = {r.doc_id: r for r in safe.collect()}
    for r in unlike.collect():
        assert texts[r.doc_id].text == secrets.redact(r.text, secrets.find(r.text)) and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
    pieces = stages["packing"](spark, safe, sf_dir).collect()
    assert {r.doc_id for r in pieces} == texts.keys()
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_one_row_of_each_near_duplicate_class_stays(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta eta theta " * 4, "quick brown foxes jump over lazy dogs today " * 4, "rain falls mainly on the wide spanish plain " * 4)
    rows = [(1, one), (1, one), (2, one), (2, two), (None, two), (None, three), (None, three)]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[1]) == [(1, one), (2, two), (None, three)]


def test_stages_survive_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    long = [(100 + k, f"a plain sentence about number {k} and the sea, " * 30, "en", "s", 1, *["z"] * 12) for k in range(3)]
    odd = spark.createDataFrame(edge.rows() + long + long[:1] + [(None, long[1][1], None, None, None, *[None] * 12)], edge.SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    ids = Counter(r.doc_id for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, odd, sf_dir)
        assert got.schema.names == odd.schema.names, name
        assert Counter(r.doc_id for r in got.collect()) <= ids, name
        none = stage(spark, edge.empty(spark), sf_dir)
        assert none.count() == 0 and none.schema.names == odd.schema.names, name
    assert Counter(r.doc_id for r in stages["secret scans"](spark, odd, sf_dir).collect()) == ids
    unlike = stages["simhash near-dedup"](spark, odd, sf_dir).collect()
    assert len(unlike) == len({r.component_id for r in simhash.near_duplicates(odd.filter("doc_id is not null")).collect()})
    pieces = stages["packing"](spark, odd, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == set(ids)
    assert stages["packing"](spark, edge.empty(spark), sf_dir).count() == 0
