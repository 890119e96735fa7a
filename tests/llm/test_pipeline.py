"""The pipeline's stages against plain versions, on tables with nulls, empty and long texts, copies and clashing columns."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tidemark.llm import op6_mixing, op7_quality, op10_decontaminate
from tests.llm.test_operators import WORDS, _least_edits, grams, in_order, removals, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ranges string, doc long, tie long, cut string, matches string, score double"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rng = random.Random(3)
    items = [" ".join(rng.choices(WORDS, k=20)) for _ in range(4)]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), items


@pytest.fixture(scope="module")
def docs(spark, folder):
    bodies = texts(9)
    bodies += [f"before {folder[1][1]} after", bodies[4], None]
    rows = [(i if i != 7 else None, t, "en", f"site-{i % 3}", len(t or ""), "r", 1, 2, "c", "m", 0.5) for i, t in enumerate(bodies)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect())


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources to target weights"]


@pytest.mark.parametrize("name", STAGES)
def test_columns_and_empty_tables(spark, docs, folder, name):
    out = STAGES[name](spark, docs.limit(0), folder[0])
    assert out.count() == 0
    more = {"mix_epochs", "mix_tokens"} if name.startswith("mixing") else set()
    assert set(out.columns) == set(docs.columns) | more


def test_quality_keeps_what_scores_well(spark, docs, folder):
    labels = spark.read.parquet(f"{folder[0]}/labels.parquet")
    kept = rows_of(STAGES["quality classifier"](spark, docs, folder[0]))
    scored = {(-1 if r.doc_id is None else r.doc_id, r.text or ""): r.score for r in docs.select("doc_id", "text").withColumn("score", op7_quality.score_column(op7_quality.train(docs, labels))).collect()}
    assert kept == sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect() if scored[(-1 if r.doc_id is None else r.doc_id, r.text or "")] >= op7_quality.THRESHOLD)


def test_near_duplicates(spark, docs, folder):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and len(a & b) >= 0.8 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    first = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            first[k] = min(i, first.get(k, i))
    wanted = {(i, t or "") for (i, t), k in zip(rows, label, strict=True) if i is None or i == first[k]}
    assert rows_of(STAGES["n-gram Jaccard join"](spark, docs, folder[0])) == sorted((-1 if i is None else i, t) for i, t in wanted)


def test_repeated_strings(spark, docs, folder):
    wanted = []
    for (i, _), (raw, gone) in zip(ordered := in_order(docs), removals(ordered), strict=True):
        left = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
        if left or not raw:
            wanted.append((-1 if i is None else i, left))
    assert rows_of(STAGES["suffix-array dedup"](spark, docs, folder[0])) == sorted(wanted)


def test_decontamination(spark, docs, folder):
    short = docs.where("text is null or length(text) < 900")
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    rate, q = op10_decontaminate.RATE, op10_decontaminate.Q

    def clean(text):
        own = plain(text or "")
        return not any(_least_edits(plain(x), own) <= min(int(len(plain(x).encode()) * rate), (len(plain(x).encode()) - q) // q) for x in folder[1])

    got = rows_of(STAGES["benchmark decontamination"](spark, short, folder[0]))
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in short.collect() if clean(r.text))
    assert len(got) < short.count()


def test_mixing_takes_what_the_plan_takes(spark, docs, folder):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r for r in op6_mixing.mix(own).collect()}
    texts_ = {r.doc_id: r.text for r in own.collect()}
    got = STAGES["mixing sources to target weights"](spark, own, folder[0]).collect()
    assert {r.doc_id for r in got} == set(plan)
    total, cut = 0, 0
    for r in got:
        p, whole = plan[r.doc_id], texts_[r.doc_id]
        words = whole.split()
        assert (r.mix_epochs, r.mix_tokens) == (p.epochs, p.tokens_taken)
        if p.epochs or p.tokens_taken == p.n_tokens:
            assert r.text == whole
        else:
            assert whole.startswith(r.text) and r.text.split() == words[: p.tokens_taken] and r.n_chars == len(r.text)
            cut += 1
        total += len(r.text.split()) * max(1, p.epochs)
    assert cut and total <= sum(p.tokens_taken for p in plan.values()) <= op6_mixing.SHARE * sum(len((t or "").split()) for t in texts_.values())


def test_mixing_with_copies_and_clashing_columns(spark):
    rows = [(i // 2, f"\t a{i}  b\n" * 30, "en", f"s{i % 4}", 7, 1, "x") for i in range(40)] + [(None, "null id " * 9, None, None, 1, 1, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_tokens int, mix_epochs int, cut string")
    got = op6_mixing.mixed_documents(docs).collect()
    taken = op6_mixing.mix(docs).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in taken} and all(r.cut == "x" for r in got)
    assert all(len(r.text.split()) == r.mix_tokens for r in got if not r.mix_epochs)  # rows of one id share what is taken of them


def test_run_on_the_smallest_tables(spark):
    where = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{where}/documents.parquet")
    after = corpus_pipeline.run(spark, where)
    assert set(before.columns) < set(after.columns)
    assert 0 < after.count() < before.count()
    assert after.join(before, "doc_id", "left_anti").isEmpty()
