"""Each stage of the pipeline on what the stage before kept, against plain versions."""

import brute
import corpus_pipeline
import pytest

from gridloom.llm.common import settle
from gridloom.llm.quality import score_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (input, output) rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, SF), name)
        out[name] = docs, after
        docs = after
    return out


def _texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert len(corpus_pipeline.STAGES) == 5
    assert all(after.columns == columns for _, after in list(stages.values())[:-1])


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    scores = score_quality(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r["doc_id"] for r in scores if r["predicted"] == 1}
    assert _texts(after) == [x for x in _texts(before) if x[0] in good]


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    rows = _texts(before)
    gone = brute.lines_gone([t for _, t in rows])
    expected = []
    for d, (i, text) in enumerate(rows):
        lines = text.split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if (d, n) not in gone)
        if kept == text or kept.strip():
            expected.append((i, kept))
    assert _texts(after) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_stage(spark, stages):
    """On the original documents, which have more copies: what goes has a similar document that comes earlier."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    rows, kept = _texts(docs), {r["doc_id"] for r in stage(spark, docs, SF).collect()}
    pairs = brute.jaccard_pairs([t for _, t in rows])
    group = brute.components([i for i, _ in rows], pairs)
    gone = [(i, c) for (i, _), c in zip(rows, group, strict=True) if i not in kept]
    assert all(c < i for i, c in gone)  # nothing goes without a similar one
    exact = {}
    for i, text in rows:
        exact.setdefault(text, i)
    assert all(i not in kept for i, text in rows if exact[text] != i)  # every later exact copy goes
    # a group keeps a document
    assert {c for c in group} <= {c for (i, _), c in zip(rows, group, strict=True) if i in kept}


def test_near_stage_loses_no_similar_pair(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    rows, kept = _texts(docs), sorted(r["doc_id"] for r in stage(spark, docs, sf).collect())
    pairs = brute.jaccard_pairs([t for _, t in rows])
    assert kept == sorted(set(brute.components([i for i, _ in rows], pairs)))


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _, _ in brute.contained(_texts(before), items)}
    assert _texts(after) == [x for x in _texts(before) if x[0] not in bad]


def test_packing_stage(stages):
    before, after = stages["packing"]
    rows = _texts(before)
    found = after.collect()
    expected = brute.pieces([i for i, _ in rows], brute.token_ids([t for _, t in rows], "byte_bpe_50k.json", 0))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(expected)
    assert len({r["sequence_id"] for r in found}) <= brute.best_fit_decreasing([e[2] for e in expected])


def test_run_is_its_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(found) == key(stages["packing"][1])


def test_empty_and_null_rows(spark):
    odd = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0), (2**60 + 7, "a b c d e f g", None, "s", 13), (2**60 + 7, "a b c d e f g", None, "s", 13)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = settle(stage(spark, docs, SF), name)
            assert name == "packing" or after.columns == df.columns
            assert after.count() <= docs.count()


def test_near_stage_goes_by_row(spark):
    """Repeated rows, two texts under one id, and rows without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a), (5, a), (9, a), (5, b), (3, c), (5, c), (None, d), (None, d), (None, a), (None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, SF)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(5, a), (5, b), (3, c), (None, d), (1, "")]))


def test_decontamination_stage_goes_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, item), (None, "clean text"), (4, f"before {item} after"), (4, "clean text"), (4, "clean text"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = dict(corpus_pipeline.STAGES)["decontamination"](spark, df, SF)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(None, "clean text"), (4, "clean text"), (4, "clean text"), (5, None)]))
