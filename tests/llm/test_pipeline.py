import zlib

import corpus_pipeline
from skyquilt.llm import toxicity
from skyquilt.llm.queries import may_learn

from .test_mixing_sharding_ann import check_mix
from .test_text_operators import lined, slow_components, slow_fingerprint
from .test_tokens_packing_pfor import truth

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_each_stage_against_brute_force(spark, tmp_path, sf, docs):
    steps, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, sf).write.parquet(str(tmp_path / name))
        steps[name] = (current, current := spark.read.parquet(str(tmp_path / name)))
    assert list(steps) == ["toxicity", "line dedup", "simhash", "mixing", "packing"]
    assert all(after.columns == COLUMNS for n, (_, after) in steps.items() if n != "packing")

    before, after = steps["toxicity"]
    model = toxicity.Toxicity().fit(before, spark.read.parquet(f"{sf}/labels.parquet"), train=may_learn())
    want = {r.doc_id for r in model.score(before).where("score < 0.7").collect()}
    assert {r.doc_id for r in after.collect()} == want

    before, after = steps["line dedup"]
    texts = {d: (t, gone) for d, _, gone, t in lined([(r.doc_id, r.source, r.text) for r in before.collect()])}
    kept = {r.doc_id: r.text for r in after.collect()}
    assert all(kept[d] == texts[d][0] for d in kept)
    assert all(texts[d][1] > 0 and not texts[d][0].strip() for d in texts if d not in kept)

    before, after = steps["simhash"]
    rows = before.collect()
    groups = slow_components([slow_fingerprint(r.text, 5) for r in rows], [r.doc_id for r in rows], 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r, c in zip(rows, groups) if r.doc_id == c)

    before, after = steps["mixing"]
    from skyquilt.llm.mixing import mix

    mixed = mix(before).collect()
    check_mix(mixed, [(r.doc_id, r.source, r.text) for r in before.collect()], slack=128)
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert got == {r.doc_id: r.taken for r in mixed if r.taken}

    before, after = steps["packing"]
    want, got = [], []
    for r in before.collect():
        ids = truth(r.text, 1)
        want += [(r.doc_id, len(ids), i) for i in range(len(ids))]
    texts = {}
    for r in before.collect():
        texts[r.doc_id, len(truth(r.text, 1))] = truth(r.text, 1)
    for p in after.collect():
        assert p.ids_crc32 == zlib.crc32(texts[p.doc_id, p.doc_tokens][p.start : p.start + p.length].tobytes())
        got += [(p.doc_id, p.doc_tokens, i) for i in range(p.start, p.start + p.length)]
    assert sorted(got) == sorted(want)


def test_run_and_odd_rows(spark, tmp_path, odd, clashing, empty, sf):
    for k, table in enumerate((odd, clashing, empty)):
        at = tmp_path / str(k)
        table.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(1, 0), (7, 1), (8, 0), (None, None)], "doc_id long, toxic int").write.parquet(str(at / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(at))
        assert out.columns[0] == "doc_id"
        assert (out.count() == 0) == (table is empty)
    assert corpus_pipeline.ORACLE_SQL is None
