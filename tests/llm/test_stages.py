"""Pipeline stages on repeated ids, nulls, empty and very long texts, and columns named like those inside."""

import pytest

import corpus_pipeline as pipeline

NAMES = "score double, label int, _kept long, _nth int, doc_key long, _id long, _domain string, c0 string, row int, nth int, copies int, n_tokens long, kept_text string, shard int, rep long"


@pytest.fixture(scope="module")
def docs(spark):
    text = "An ordinary sentence about the town, with a name and some other words in it. "
    rows = [(i, f"{text}Number {i} of them is {'x' * i} here and ends so.", "en", "src1") for i in range(12)]
    rows += [(3, rows[3][1], "en", "src1"), (4, "Another text under the same id, which is as good as any other.", "de", "src2"), (None, text, None, None), (50, None, "en", "src1"), (51, "", None, "src1"), (52, text * 20_000, "en", None)]
    n = NAMES.count(",") + 1
    return spark.createDataFrame([(*r, 1, *([None] * n)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}")


def test_stages_carry_all_columns(spark, sf_dir, docs):
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        added = ["n_tokens", "copies"] if name == "mixing" else []
        assert sorted(set(out.columns) - set(added)) == sorted(set(docs.columns) - set(added)), name
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}, name
        assert all(r.n_chars == 1 for r in rows) or name == "repeated passages"
        if name == "near duplicates":
            ids = [r.doc_id for r in rows]
            assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and None in ids
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
