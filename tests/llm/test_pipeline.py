import hashlib

import test_decontaminate
import test_neardup
import test_suffixdedup

import corpus_pipeline as cp
from loomgrid.llm.common import materialize, table
from loomgrid.llm.langid import language_id

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    stages = dict(cp.STAGES)
    first = materialize(stages["language_id"](spark, docs, SF), "t")
    judged = {r.doc_id: r for r in language_id(docs).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [r for i, r in rows.items() if judged[i].lang_pred != "und" and not judged[i].ambiguous]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, kept)) and first.columns == list(cp.COLUMNS)

    second = materialize(stages["minhash_near_dedup"](spark, first, SF), "t")
    ids = {d for d, _, c, k in test_neardup.brute([(r.doc_id, r.text) for r in kept]) if k}
    kept = [r for r in kept if r.doc_id in ids]
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, kept)) and second.columns == list(cp.COLUMNS)

    third = materialize(stages["suffix_array_dedup"](spark, second, SF), "t")
    want = {r[0]: r for r in test_suffixdedup.brute([(r.doc_id, r.text) for r in kept], 100)}
    got = third.collect()
    assert len(got) == len(want) and third.columns == list(cp.COLUMNS)
    for r in got:
        source = rows[r.doc_id]
        assert (r.lang, r.source, r.n_chars) == (source.lang, source.source, len(r.text))
        if want[r.doc_id][2] == 0:
            assert r.text == source.text
        elif "�" not in source.text and source.text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][4]

    fourth = materialize(stages["benchmark_decontamination"](spark, third, SF), "t")
    bench = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in got], bench) if r[5]}
    assert dirty and sorted(map(tuple, fourth.collect())) == sorted(tuple(r) for r in got if r.doc_id not in dirty)

    last = stages["best_fit_packing"](spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth.collect()}


def test_odd_rows(spark):
    rows = [(1, "the and of " * 40, "en", "s", 1), (1, "the and of " * 40, "en", "s", 1), (2, None, None, None, None), (None, "der die das und " * 30, "de", "s", 4), (3, "", "en", "s", 0), (4, "12", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "t")
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, None]
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_jobs_of_near_duplicates(spark, monkeypatch):
    """What the driver keeps of each job adds up over the stages, so the links of a chain don't take a round of jobs for each of its halvings."""
    from loomgrid.llm import components

    words = [f"w{k * 7919 % 5003}" for k in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 12 : k * 12 + 160]), "en", "s", 1) for k in range(200)], "doc_id long, text string, lang string, source string, n_chars long")

    def jobs(group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert [r.doc_id for r in dict(cp.STAGES)["minhash_near_dedup"](spark, docs, SF).collect()] == [0]
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    few = jobs("near-dup of a chain")
    monkeypatch.setattr(components, "SLICE_LINKS", 0)
    rounds = jobs("the same by rounds")
    assert few < 130 and few < 0.7 * rounds, (few, rounds)
