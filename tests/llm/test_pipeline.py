"""The pipeline's rows against the brute-force versions of its stages, one after the other."""

import sentencepiece

import corpus_pipeline
from creditloom.llm import sentencepiece_fst
from tests.llm.common import EXTRA, corpus, documents, odd_rows, words
from tests.llm.test_models import check_mix
from tests.llm.test_passages import classes
from tests.llm.test_rules import brute_rules, gone_lines, rule_rows
from creditloom.llm import mixing


def test_stages_and_run(spark, tmp_path):
    rows = corpus(11) + [(100 + r[0], *r[1:]) for r in rule_rows()]
    docs = documents(spark, rows, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    as_rows = lambda df: sorted((r.doc_id, r.text, r.source) for r in df.collect())

    kept = {x[0] for x in brute_rules(rows) if x[7]}
    want = sorted(r for r in rows if str(r[0]) in kept)
    out = steps["quality_rules"](spark, docs, str(tmp_path))
    assert as_rows(out) == want and out.columns == columns

    gone, left = gone_lines(want), []
    for r, (d, t, s) in enumerate(want):
        drop = {n for q, n, _ in gone if q == r}
        text = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop)
        left += [(d, text, s)] if words(text) or not drop else []
    out = steps["line_dedup"](spark, documents(spark, want, extra=False), str(tmp_path))
    assert as_rows(out) == sorted(left) and out.columns == columns

    names = classes(left)
    single = sorted(r for r, c in zip(left, names) if r[0] == c)
    out = steps["minhash_dedup"](spark, documents(spark, left, extra=False), str(tmp_path))
    assert as_rows(out) == single and out.columns == columns

    base = documents(spark, single, extra=False)
    plan = mixing.mixed(base).collect()
    check_mix(single, plan)
    mixed = []
    for r in plan:
        text, source = next((t, s) for d, t, s in single if d == r.doc_id)
        mixed += [(r.doc_id, text, source)] * (r.taken // r.size)
        mixed += [(r.doc_id, " ".join(words(text)[:r.taken % r.size]), source)] if r.taken % r.size else []
    out = steps["source_mixing"](spark, base, str(tmp_path))
    assert as_rows(out) == sorted(mixed) and out.columns == columns

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    tokens = sorted((d, model.encode(t)) for d, t, _ in mixed)
    assert sorted((r.doc_id, list(r.token_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == tokens


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, one id with two texts, clashing columns."""
    prose = " ".join(f"q{i}" for i in range(200))
    rows = odd_rows() + [(20, prose, None), (20, prose, None), (21, prose + " more", "b"), (22, prose, "b"), (None, "z " + prose[::-1], "c"),
                         (23, " ".join(f"v{i}" for i in range(60000)), None)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, before = docs, {(r.doc_id, r.text): r.source for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        assert kept.columns == docs.columns and kept.count() > 0, name
        for r in kept.collect():
            assert all(r[c] == c for c in EXTRA) and r.n_chars == len(r.text) and words(r.text)
        if name == "quality_rules":
            want = {(d, t) for d, t, _ in rows if len(words(t)) >= 20 and d not in (10, 12)}
            assert {(r.doc_id, r.text) for r in kept.collect()} == want
            assert kept.where("doc_id = 20").count() == 2 and all(before[r.doc_id, r.text] == r.source for r in kept.collect())
        if name == "minhash_dedup":
            # 4, 5, 6 and the row without id hold one text nearly; 20, 21 and 22 another.
            assert sorted(str(r.doc_id) for r in kept.collect()) == ["20", "23", "4", "7", "None"]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in kept.collect()) and all(r.round_trip for r in found)
    assert {r.doc_id for r in found} == {7, 23, None}  # the null source is passed over a quarter of once
    whole = {d: model.encode(t) for d, t, _ in rows if d in (7, 23)}
    assert all(list(r.token_ids) == whole[r.doc_id][:r.n_tokens] for r in found if r.doc_id in whole)


def test_empty_table(spark, tmp_path):
    docs = documents(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
