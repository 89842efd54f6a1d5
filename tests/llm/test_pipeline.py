import corpus_pipeline
from cedarlog.llm import decontaminate, line_dedup, mixing, near_dedup, registry, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in registry.QUERIES}
    assert numbers == set(range(1, 14))
    assert {n.split("_")[0] for n in registry.ORACLE} == {"op1", "op2", "op4", "op9", "op10", "op11", "op12", "op13"}


def test_stages_equal_brute_force(spark):
    """Each stage is compared on what its predecessor kept, and ``run`` with all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    assert all(s.columns == columns for s in steps[:-1])
    rows = [sorted(((r["doc_id"], r["text"]) for r in s.collect()), key=lambda r: r[0]) for s in steps]

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.scorer(docs, model)("text").alias("s")).collect()}
    assert rows[1] == [r for r in rows[0] if scores[r[0]] < toxicity.THRESHOLD]

    lines = brute.dedup_lines(rows[1], line_dedup.MIN_LINES, line_dedup.MIN_CHARS)
    assert rows[2] == [(r[0], w[2]) for r, w in zip(rows[1], lines, strict=True) if not w[0] or w[1] < w[0]]

    classes = brute.near_classes(rows[2], near_dedup.SIMILARITY)
    assert rows[3] == [r for i, r in enumerate(rows[2]) if classes[i] == i]

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows[4] == [r for r in rows[3] if not brute.leaks(r[1], items, decontaminate.WINDOW)[1]]
    assert len(rows[4]) < len(rows[3]) < len(rows[2]) <= len(rows[1]) < len(rows[0])

    last = steps[4].collect()
    size = {(r["doc_id"]): len(brute.SPACE.findall(r["text"] or "")) for r in last}
    source = {r["doc_id"]: r["source"] for r in last}
    sizes = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    target = brute.fill(sizes, weights)
    taken = brute.group((source[d], (d, size[d])) for d, _ in rows[5])
    for s in sizes:
        largest = max(size[d] for d in size if source[d] == s)
        assert abs(sum(n for _, n in taken[s]) - target[s]) <= largest

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5].collect()))
