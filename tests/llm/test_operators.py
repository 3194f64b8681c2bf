"""Operators on edge cases and against brute force; queries with SQL against SQL."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inodelake.llm import bag_minhash, bpe, html_extract, line_dedup, media, mixing, near_graph, quality_classifier, quality_rules, queries, toxicity, url_filter
from inodelake.llm.spark_io import table

SF = "/root/testdata/sf0.001"
LONG = "word " * 30000
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "no id at all here, my friend, none", "b"), (5, LONG, "b"),
    (6, "same text again and again for everyone here", "a"), (7, "same text again and again for everyone here", "a"), (7, "same text again and again for everyone here", "a"),
    (8, "ünï çödé 日本語 😀 <|endoftext|>\nline two of it is here\nline two of it is here", "c"),
]
CLASHES = "doc_id long, text string, source string, n_chars int, size long, h long, id long, comp long, line string, key long, d_own string, toxic int, digest string, bucket int, target double"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, s, len(t or ""), 1, 2, 3, 4, "l", 5, "x", 1, "d", 6, 0.5) for i, t, s in EDGE], CLASHES)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


def run_all(docs, labels):
    return {
        "rules": quality_rules.apply(docs), "toxicity": toxicity.apply(docs, toxicity.fit(docs, labels)), "mixing": mixing.apply(docs), "media": media.apply(docs),
        "bpe": bpe.apply(docs), "classifier": quality_classifier.apply(docs, quality_classifier.fit(docs, labels)), "lines": line_dedup.apply(docs), "minhash": bag_minhash.apply(docs),
    }


def test_edge_rows(spark, edge, labels):
    for name, df in run_all(edge, labels).items():
        assert df.count() == len(EDGE), name
    assert mixing.mix(edge).columns == edge.columns
    kept = bag_minhash.deduplicate(edge)
    assert kept.columns == edge.columns and kept.filter("text LIKE 'same%'").count() == 1 and kept.filter("text IS NULL OR trim(text) = ''").count() >= 2
    cleaned = line_dedup.deduplicate(edge)
    assert cleaned.columns == edge.columns and cleaned.count() == len(EDGE)
    assert {r["text"] for r in cleaned.filter("doc_id = 8").collect()} == {"ünï çödé 日本語 😀 <|endoftext|>\nline two of it is here"}


def test_clashing_columns_keep_their_values(spark):
    """Columns named as the operators name theirs come out of every operator on whole rows as they went in."""
    names = "row own_doc own_hash own_digest d_doc d_hash kept near lines worded drop new_text k_doc k_digest k_n digest bands mix_source whole threshold copies h size source_size target toxic comp id bucket place first key".split()
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) + f"\nline {i % 3} of the text" for i in range(12)]
    rows = [(i, t, f"s{i % 2}", *[f"{n}{i}" for n in names]) for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in ["doc_id", "text", "source", *names]))
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for out in (line_dedup.deduplicate(docs), bag_minhash.deduplicate(docs), mixing.mix(docs), toxicity.keep_civil(docs, model)):
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) >= 10 and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    assert [r["doc_id"] for r in bag_minhash.deduplicate(docs).orderBy("doc_id").collect()] == list(range(12))


def test_empty_tables(spark, edge, labels):
    for name, df in run_all(edge.limit(0), labels.limit(0)).items():
        assert df.count() == 0, name
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.apply(pages, html_extract.fit(pages)).count() == 0 and url_filter.apply(pages, url_filter.listed_hosts(pages)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    text = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert text(df.select(*columns).collect()) == text(c.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_mixing_meets_targets(spark):
    rows = mixing.apply(table(spark, SF, "documents")).join(table(spark, SF, "documents").select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    total = sum(r["size"] for r in rows)
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(1.5 * total)


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def test_classes_against_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    bags = [bag(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for n, b in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(n)
    for x, y in {(a, b) for own in where.values() for k, b in enumerate(own) for a in own[:k]}:
        both = sum((bags[x] & bags[y]).values())
        if both >= 0.8 * (bags[x].total() + bags[y].total() - both):
            parent[find(x)] = find(y)
    groups = {}
    for n in range(len(docs)):
        groups.setdefault(find(n), []).append(docs[n][0])
    want = {i: min(own) for own in groups.values() for i in own}
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.apply(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    assert got == want


def test_near_copies_around_a_failing_hub(spark):
    """Two near copies whose popular leader is similar to neither: no leader is left to try after the first turn."""
    hub = [f"h{k}" for k in range(100)]
    one = hub[:83] + [f"x{k}" for k in range(17)]
    other = one[:92] + [f"y{k}" for k in range(8)]
    crowd = [hub[:at] + [f"z{at}n{k}" for k in range(13)] + hub[at + 13 :] for at in range(6, 66, 3)]
    texts = [" ".join(x) for x in [hub, one, other, *crowd]]
    similar = lambda a, b: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    assert similar(texts[1], texts[2]) > 0.8 > max(similar(texts[0], x) for x in texts[1:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in bag_minhash.apply(docs).collect()}
    assert got[1] == got[2] == 1 and got[0] == 0


def test_prefix_filter_loses_no_link(spark):
    """Texts around one passage, some with repeated parts, all in one bucket: every link between classes is sent."""
    r = random.Random(11)
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for i in range(90):
        own = [f"w{i}x{k}" for k in range(r.randint(0, 45))]
        at = r.randint(0, 60)
        body = passage[: 120 - r.randint(0, 12)] + (passage[at : at + 15] if i % 3 == 0 else [])
        texts.append(" ".join(own + body if i % 2 else body + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    nodes = docs.select("doc_id", bag_minhash.digest().alias("digest"), F.col("doc_id").alias("id"))
    rows, labels = nodes.select(F.lit(7).cast("long").alias("bucket"), "id"), nodes.select("id", (F.col("id") % 40).alias("comp"))
    bags = [bag(t) for t in texts]
    links = {
        (i, j) for i in range(90) for j in range(i)
        if (i - j) % 40 and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())
    }
    sent = {(max(a, b), min(a, b)) for a, b in bag_minhash._across(rows, labels, nodes, docs, 0.8).collect()}
    assert len(links) > 50 and links <= sent and len(sent) < 3 * len(links)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1100)] + [(2000 + k, 2001 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for a, b in edges for x in (a, b) if a != b}
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    assert {x["id"]: x["comp"] for x in near_graph.components(frame(edges)).collect()} == want
    in_parts = near_graph.merged(near_graph.merged(None, frame(edges[::2])), frame(edges[1::2]))
    assert {x["id"]: x["comp"] for x in in_parts.collect()} == want
    assert near_graph.components(frame([])).count() == 0


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(3)
    items = r.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = r.integers(1, 6, 400), r.integers(1, 6, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rows = np.repeat([0, 1], 400)
    s = bag_minhash.signatures(rows, np.concatenate([items, items]), np.concatenate([a, b]), 2, 2048)
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.05)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        k, i = r.randint(0, 2), r.randint(0, len(out))
        if k == 0:
            out.insert(i, r.choice("abcd"))
        elif i < len(out):
            out[i : i + 1] = [] if k == 1 else [r.choice("abcd")]
    return "".join(out)


def test_edit_distance_band():
    r = random.Random(3)
    for _ in range(4000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        b, t = edited(r, a, r.randint(0, 5)), r.randint(1, 4)
        assert line_dedup.within(a, b, t) == (distance(a, b) <= t)


def lines_that_stay(rows):
    """Places (document, line) of the first line of every class, by comparing all pairs of different lines."""
    first = {}
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if s := line.strip(" \t\r\v\f"):
                first.setdefault(s, (i, k))
    own = [(re.findall(r"[^\x20\x09-\x0D]+", s), place) for s, place in first.items()]
    bags = [Counter(w) for w, _ in own]
    parent = list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(own):
        for j in range(i):
            b = own[j][0]
            n = max(len(a), len(b))
            k = 3 if n >= 100 else 2 if n >= 30 else 1 if n >= 10 else 0
            if k and n - min(len(a), len(b)) <= k and (bags[i] & bags[j]).total() >= n - k and distance(a, b) <= k:
                parent[find(i)] = find(j)
    groups = {}
    for i, (_, place) in enumerate(own):
        groups.setdefault(find(i), []).append(place)
    return {min(g) for g in groups.values()}


def cleaned_by_hand(rows):
    keep = lines_that_stay(rows)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if not x.strip(" \t\r\v\f") or (i, k) in keep) for i, t in rows}


@pytest.mark.parametrize("split", [4096, 2])
def test_near_lines_against_all_pairs(spark, monkeypatch, split):
    """Lines of 1 to 130 words with up to 5 words put in, left out, replaced or moved, a crowd around one line, lines that
    share a passage only, and lines that differ in white space; with keys of more than ``split`` lines cut by sketches."""
    monkeypatch.setattr(line_dedup, "SPLIT", split)
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 8))) for _ in range(300)]

    def changed(words, n):
        out = list(words)
        for _ in range(n):
            i, kind = r.randrange(len(out) + 1), r.randint(0, 3)
            if kind == 0:
                out.insert(i, r.choice(vocabulary))
            elif i < len(out):
                out[i : i + 1] = [] if kind == 1 else [r.choice(vocabulary)]
        return out

    lines = []
    for n in [*range(1, 14), *range(26, 34), *range(96, 104), 130]:
        words = [r.choice(vocabulary) for _ in range(n)]
        lines += [words, *[changed(words, r.randint(1, 5)) for _ in range(4)]]
    crowd, passage = [r.choice(vocabulary) for _ in range(40)], [r.choice(vocabulary) for _ in range(30)]
    lines += [changed(crowd, r.randint(1, 3)) for _ in range(40)] + [crowd] + [changed(crowd, 3) for _ in range(20)]
    lines += [passage + [r.choice(vocabulary) for _ in range(r.randint(3, 10))] for _ in range(30)]
    texts = [" ".join(w) for w in lines]
    r.shuffle(texts)
    texts += [texts[0].replace(" ", "  "), "\u00e9\u00e8 \u65e5\u672c " * 8, "\u00e9\u00e8 \u65e5\u672c " * 7 + "\u00e9\u00e8 \u65e5", ""]
    rows = [(i, "\n".join(texts[k : k + 3])) for i, k in enumerate(range(0, len(texts), 3))]
    got = {x["doc_id"]: x for x in line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {i: x["text"] for i, x in got.items()} == cleaned_by_hand(rows)
    assert sum(x["n_near"] for x in got.values()) > 50
    stays = lines_that_stay(rows)
    assert all((x["of_doc_id"], x["of_line_no"]) in stays for row in got.values() for x in row["near"])


def test_first_pass_has_few_keys_for_long_lines():
    """A long line sends 2k + 1 keys, 12 with those for a longer class, where its segments made 12 to 26; lines within k edits
    share one of the pass, also at the lengths where the keys change."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 8))) for _ in range(300)]
    for n in [*range(9, 14), *range(27, 33), *range(37, 45), 60, *range(96, 104), 150]:
        for _ in range(40):
            a = b = [r.choice(vocabulary) for _ in range(n)]
            for _ in range(r.randint(1, 3)):
                i, kind = r.randrange(len(b)), r.randint(0, 2)
                b = b[:i] + [r.choice(vocabulary)] * (kind < 2) + b[i + (kind > 0) :]
            if not line_dedup.near(" ".join(a), " ".join(b)) or a == b:
                continue
            texts = pa.array([" ".join(a), " ".join(b), "x y z"])
            whole = pa.Table.from_batches(line_dedup._probes([pa.RecordBatch.from_arrays([texts], names=["text"])])).to_pylist()
            assert sum(x["state"] == 2 for x in whole) == 2
            apart = [pa.Table.from_batches(line_dedup._probes([pa.RecordBatch.from_arrays([texts[k : k + 1]], names=["text"])])).to_pylist() for k in (0, 1)]
            assert {x["key"] for x in apart[0]} & {x["key"] for x in apart[1]}
            assert n < 43 or max(map(len, apart)) <= 12


@pytest.mark.parametrize("line", ["", " ", "a", " a", "a ", "\t a b \r", "\va\f", "\u00e9 \u65e5\r", "\u00a0a\u2003", " \t\r\f\v"])
def test_trimmed_as_btrim(spark, line):
    own = spark.createDataFrame([(line,)], "line string")
    row = own.select(line_dedup._trimmed(F.col("line")).alias("got"), line_dedup._worded(F.col("line")).alias("worded"), F.btrim("line", F.lit(" \t\n\r\v\f")).alias("want")).first()
    assert row["got"] == row["want"] and row["worded"] == (row["want"] != "")


def test_lines_of_documents(spark):
    rows = [(x["doc_id"], x["text"]) for x in table(spark, SF, "documents").collect()]
    got = {x["doc_id"]: x["text"] or "" for x in line_dedup.apply(table(spark, SF, "documents")).collect()}
    assert got == cleaned_by_hand(rows)


def test_bpe_as_the_other_library(spark, edge, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(enumerate([*[t or "" for _, t, _ in EDGE], *[r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]]))
    texts[len(texts)] = "it's  we'll\r\n\t x\u00a0\u2003y  \n\n 12345 \u0663\u0664 don't'S \U0001f469\u200d\U0001f52c\u0301 ...!?  "
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in bpe.apply(docs).collect():
        ids, raw = other.encode_ordinary(texts[row["doc_id"]]), texts[row["doc_id"]].encode()
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(raw).hexdigest() and row["n_bytes"] == len(raw)
        at, inside = 0, 0
        for i in ids:
            inside += at < len(raw) and raw[at] & 0xC0 == 0x80
            at += len(other.decode_single_token_bytes(i))
        assert row["n_split"] == inside
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    forgetful = bpe.Codec(bpe.default_path())
    assert [forgetful.encode([t])[0].tolist() for t in list(texts.values())[:60]] == [other.encode_ordinary(t) for t in list(texts.values())[:60]]


def test_media_of_a_table(spark, edge):
    """Every column of every row, computed text by text."""
    docs = table(spark, SF, "documents").select("doc_id", "text").union(edge.filter("doc_id <> 5").selectExpr("doc_id + 100000", "text"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for row in media.apply(docs).collect():
        raw = texts[row["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        means = [sum(payload[i : i + len(payload) // 64]) / (len(payload) // 64) for i in range(0, len(payload), len(payload) // 64)]
        mean = sum(payload) / len(payload)
        bits = "".join("1" if m > mean + 1e-9 else "0" for m in means)
        stored = media.store(payload)
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (row["media_bytes"], row["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and stored[:4] == b"RIFF"
        assert row["feature"] == f"{int(bits, 2):016x}"


def test_held_out_quality_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = quality_classifier.apply(docs, quality_classifier.fit(docs, labels)).join(labels, "doc_id").filter("held_out")
    assert scored.filter("predicted = quality").count() >= 0.95 * scored.count()
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    judged = toxicity.apply(docs, toxicity.fit(docs, labels.filter(~fold))).join(labels.filter(fold).withColumnRenamed("toxic", "truth"), "doc_id")
    assert judged.filter("truth = 0 AND toxic = 1").count() <= 5 and judged.filter("truth = 1 AND toxic = 1").count() >= 0.9 * judged.filter("truth = 1").count()
    assert judged.filter("abs(severity) > 3 OR grade < 0 OR grade > 3").count() == 0


def test_one_labelled_id_in_many_rows(spark):
    """Rows of one id count once in what is learned."""
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    first = labels.filter("toxic = 1").orderBy("doc_id").first()["doc_id"]
    many = docs.union(docs.filter(F.col("doc_id") == first).crossJoin(spark.range(300)).select("doc_id", "text"))
    assert toxicity._sample(many, labels).count() == toxicity._sample(docs, labels).count()
    a, b = (quality_classifier.fit(x, labels) for x in (docs, many))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.calibration, b.calibration)


def test_chain_marginals_against_enumeration():
    import itertools

    r = np.random.default_rng(1)
    score, move = r.normal(size=5), r.normal(size=(2, 2))
    row = np.array([0, 0, 0, 1, 1])
    good, _ = quality_classifier.marginals(score, row, move)
    for chain in (slice(0, 3), slice(3, 5)):
        s = score[chain]
        paths = list(itertools.product((0, 1), repeat=len(s)))
        weight = [np.exp(sum(x * v for x, v in zip(p, s)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in paths]
        want = [sum(w for p, w in zip(paths, weight) if p[i]) / sum(weight) for i in range(len(s))]
        assert np.allclose(good[chain], want)


def test_html_article_only(spark):
    pages = table(spark, SF, "pages")
    rows = {r["page_id"]: r for r in html_extract.apply(pages, html_extract.fit(pages)).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(re.sub(r"</?b>|<br>", " ", b).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        import html

        assert rows[p["page_id"]]["text"] == "\n\n".join(html.unescape(b) for b in blocks if b)


def test_html_repairs():
    nodes = html_extract.parse("<div><p>one<p>two &amp; three<br>four<ul><li>a<li>b</ul><script>x</p></script>")
    assert html_extract.text_of(nodes, np.zeros(len(nodes), int)) == "one\n\ntwo & three four\n\na\n\nb"
    assert html_extract.extract([None, "", "plain"], None) == ["", "", "plain"]
    nodes = html_extract.parse("<p>The sum <math><mi>x</mi>+1</math> holds <noscript>here</noscript></p>")
    assert html_extract.text_of(nodes, np.zeros(len(nodes), int)) == "The sum x+1 holds here"


def test_html_without_marks(spark):
    """A table whose pages mark no article: all but menus, headers, footers, side bars and forms; and null pages."""
    html = "<html><head><title>t</title></head><body><nav>menu</nav><header>top</header><div><p>one</p><p>two</p></div><aside>side</aside><form>f</form><footer>end</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", html, "x"), (2, None, None, "y"), (3, "u", "", None)], "page_id long, url string, html string, text string")
    assert html_extract.fit(pages) is None
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.apply(pages, None).collect()} == {1: ("one\n\ntwo", 8), 2: ("", 0), 3: ("", 0)}


def test_html_of_another_template(spark):
    """Pages of a template that no page of the fitted table has: other containers, class names and parts; a long one."""
    pages = table(spark, SF, "pages")
    sentences = [" ".join(t.split()[:25]) for t in (r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()) if t and len(t.split()) > 25]
    r = random.Random(2)
    rows, want = [], {}
    for i in range(30):
        own = [r.choice(sentences) for _ in range(r.randint(2, 9) if i else 3000)]
        links = "".join(f'<li><a href="/{k}">{r.choice(sentences).split()[0]}</a></li>' for k in range(8))
        body = "".join(f"<p>{s}</p>" for s in own)
        rows.append((i, "u", f'<html><body><div class="topbar"><ul>{links}</ul></div><div class="layout"><section class="post-content">{body}</section><div class="sidebar widget"><h3>more</h3><ul>{links}</ul></div></div><div class="footer"><p>all rights <a href="/x">kept</a></p></div></body></html>'))
        want[i] = "\n\n".join(own)
    got = {x["page_id"]: x["text"] for x in html_extract.apply(spark.createDataFrame(rows, "page_id long, url string, html string"), html_extract.fit(pages)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 28 and got[0] == want[0]


@pytest.mark.parametrize("shard_bytes", [url_filter.SHARD_BYTES, 200])
def test_cascade_is_exact(spark, shard_bytes):
    """A list without a rule behind it, with keys that the table lacks, in one part and in several."""
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.createDataFrame([(f"k{i}",) for i in random.Random(5).sample(range(4000), 400)], "key string")
    cascade = url_filter.Cascade(keys, listed, rate=0.2, shard_bytes=shard_bytes)
    assert (cascade.parts > 3) == (shard_bytes == 200) and max(map(len, cascade.shards)) > 1
    want = {r["key"] for r in listed.collect()}
    rows = cascade.mark(keys.withColumn("h1", F.lit(1)).withColumn("listed_key", F.lit("x")), "key", "listed").collect()
    assert len(rows) == 3000 and all(r["listed"] == (r["key"] in want) and r["h1"] == 1 for r in rows)
    none = url_filter.Cascade(keys, listed.limit(0))
    assert none.mark(keys, "key", "listed").filter("listed").count() == 0


def test_url_parts(spark):
    urls = [None, "no scheme", "http://A.Example.ORG/es/x?q", "https://example.org#x", "x://y://z/p", "http://org/", "ftp://notexample.org/es/1", "http://spam.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.apply(pages, url_filter.listed_hosts(pages)).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[3] == ("example.org", "", None, "allow") and got[4] == ("y:", "//z/p", None, "allow") and got[5][2:] == ("org/", "allow")
    assert got[6][2] == "org/" and got[7][3] == "block"


def test_words_and_shingles():
    from inodelake.llm.arrow_text import Hasher, shingles, utf8, words

    texts = ["a b c d e f", None, "", "x y", "a b c d e"]
    data, offsets = utf8(pa.array(texts))
    s, e, r = words(data, offsets)
    assert [bytes(data[i:j]).decode() for i, j in zip(s, e)] == [w for t in texts if t for w in t.split()]
    h, rows = shingles(Hasher(data)(s, e), r, len(texts))
    assert sorted(rows.tolist()) == [0, 0, 3, 4] and h[rows == 4][0] in h[rows == 0]
