"""The pipeline against a plain version, and each stage on hard rows and an empty table."""

import corpus_pipeline
import plain
import pytest
from conftest_rows import rows_of_documents

from textwarden.llm import toxicity
from textwarden.llm.common import read


@pytest.fixture(scope="module")
def tables(spark, small):
    return {t: read(spark, small, t) for t in ("documents", "labels", "benchmark")}


def test_pipeline(spark, small, tables):
    docs = {d: t for d, t in rows_of_documents(tables["documents"])}
    toxic = {r["doc_id"] for r in toxicity.judge(tables["documents"], tables["labels"]).where("predicted = 1").collect()}
    left = {d: t for d, t in docs.items() if d not in toxic}
    counts = {d: plain.quality(t) for d, t in left.items()}
    surely = {d for d, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 20 * c[0] and 10 * c[2] <= c[0] and c[3] == 0 and 3 * c[0] <= c[1] <= 12 * c[0]}
    good = {r["doc_id"] for r in corpus_pipeline.good(spark, tables["documents"].where(tables["documents"].doc_id.isin(list(left))), small).collect()}
    assert surely <= good and all(counts[d][0] >= 50 and 2 * counts[d][4] <= counts[d][0] for d in good)
    groups = plain.components([(d, left[d]) for d in sorted(good)], 5, 4, 5)
    single = {d: left[d] for d, (_, c) in groups.items() if c == d}
    items = [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()]
    dirty = {d for d, *_ in plain.leaks(single.items(), items)}
    want = {d: len(plain.ids_of(t)) for d, t in single.items() if d not in dirty}
    got = {}
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and dirty and toxic


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_hard_rows(spark, small, hard, nothing, name, stage):
    out = stage(spark, hard, small)
    assert out.count() > 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == hard.columns
    assert stage(spark, nothing, small).count() == 0
