import random
import re

import corpus_pipeline
from inboxlake.llm import factorisation, quality_rules, simhash, suffix_dedup

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, folder):
    """Every stage against its operator's own verdicts on the same input, and the whole against its stages."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "SimHash near-dedup", "suffix-array dedup", "packing"]
    kept = docs
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, FOLDER)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        ids.append({r.doc_id for r in out.select("doc_id").collect()})
        if k == 0:
            verdicts = quality_rules.quality_rules(kept, labels).where("kept")
            assert ids[1] == {r.doc_id for r in verdicts.collect()}
        if k == 1:
            assert ids[2] == {r.doc_id for r in factorisation.quality_scores(kept, labels).where("predicted = 1").collect()}
        if k == 2:
            groups = simhash.near_duplicates(kept, f"{folder}/again", **simhash.WIDE).collect()
            assert ids[3] == {r.component for r in groups}
        if k == 3:
            cut = {r.rest.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffix_dedup.cut_repeats(kept, f"{folder}/cut").collect()}
            assert {r.doc_id: r.text for r in out.collect()} == cut and ids[4] == ids[3]
        kept = out
    assert ids[0] > ids[1] >= ids[2] > ids[3] == ids[4] == ids[5]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sum(r.length for r in whole.select("length").collect()) == sum(r.length for r in kept.select("length").collect())


def test_clean_documents_stay(spark):
    """Of the labelled good documents that the base rule passes, all but a few survive the filters."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    base = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("not base_failed").collect()}
    left = corpus_pipeline.classifier(spark, corpus_pipeline.rules(spark, docs, FOLDER), FOLDER)
    assert len(good & base & {r.doc_id for r in left.collect()}) >= 0.98 * len(good & base)


def test_groups_against_all_pairs(spark, folder):
    """The documents that stay are the smallest ids of the groups by exact Jaccard of five-word shingles, all pairs compared, planted ones too."""
    draw = random.Random(50)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    first, planted = max(i for i, _ in rows) + 1, []
    for jaccard in (0.75, 0.82, 0.85, 0.9) * 10:
        words = ["".join(draw.choices("abcdefghij", k=8)) for _ in range(draw.randint(200, 600))]
        same = round((len(words) - 4) * 2 * jaccard / (1 + jaccard)) + 4
        other = words[:same] + ["".join(draw.choices("klmnopqrst", k=8)) for _ in range(len(words) - same)]
        planted.append((first, first + 1, jaccard))
        rows += [(first, " ".join(words)), (first + 1, " ".join(other))]
        first += 2

    sets, holders = {}, {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        shared = {}
        for x in sets[i]:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert all((top(a) == top(b)) == (jaccard > 0.8) for a, b, jaccard in planted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.keep_one(docs, folder).select("doc_id").collect()} == {top(i) for i in sets}
