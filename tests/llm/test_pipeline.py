"""The pipeline's stages, each on its own input, against brute force; and the whole run against the stages in a row."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from inodelake.llm import bpe, mixing, toxicity
from inodelake.llm.spark_io import materialize, table

from .test_operators import SF, bag, cleaned_by_hand


def one_of_each(rows):
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in bags if bags[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = (bags[a] & bags[b]).total() if bags[a].keys() & bags[b].keys() else 0
            if both and both >= 0.8 * (bags[a].total() + bags[b].total() - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i for i in bags if not bags[i] or find(i) == i}


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    outs = []
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, SF))
        outs.append(at)
    civil, lined, near, mixed, coded = outs
    assert all(x.columns == columns for x in outs[:-1])
    pairs = lambda df: [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    flagged = {r["doc_id"] for r in toxicity.apply(docs, toxicity.fit(docs, table(spark, SF, "labels"))).filter("toxic = 1").collect()}
    assert {i for i, _ in pairs(civil)} == {i for i, _ in pairs(docs)} - flagged
    assert dict(pairs(lined)) == cleaned_by_hand(pairs(civil))
    assert {i for i, _ in pairs(near)} == one_of_each(pairs(lined))
    want = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixing.apply(near).collect() if r["taken"]})
    assert Counter(i for i, _ in pairs(mixed)) == want
    codec = bpe.codec(bpe.default_path())
    shown = lambda i, t: (i, hashlib.sha256(" ".join(map(str, codec.encode([t])[0])).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in coded.collect())
    assert got == sorted(shown(i, t) for i, t in pairs(mixed))
    again = sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == got and all(re.fullmatch("[0-9a-f]{64}", r[1]) for r in got)
