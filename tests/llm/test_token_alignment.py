"""Cross-tokenizer alignment: runs against all common ends, ids against the libraries on whole texts, counts by brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inodelake.llm import bpe
from inodelake.llm import token_alignment as A

SCHEMA = "doc_id long, text string, pair int, n_a string"
TEXTS = [
    None, "", " ", "a", "plain words in a row, and more of them", "  two  spaces \n\n  lines\t tabs \r\n end  ", "<|endoftext|> and <s> x </s> <unk>", "a▁b ▁", "é漢字 字 😀😀 ﬁ ½ ＡＢ", "nul\x00 \x1c \x85 \xa0x",
    "don't won't it's 's 'S 12345 1,234.5", "antidisestablishmentarianism " * 30, "x" * 500, "\n \n x", "x \n y\n\n  z", "  lead", "word　wide    spaces", "plain words in a row, and more of them",
]


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(*A.default_paths())


class Plain:
    """Whole texts by the libraries themselves, groups as sets of common ends."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path(A.FIRST))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.SECOND))
        self.table = bpe.byte_characters()

    def tokens(self, text):
        if not text:
            return [], []
        want = b" " + text.encode()
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.table[c] for c in self.a.id_to_token(i))) for i in ids]
        b = []
        for i in self.b.encode(text):
            name = self.b.id_to_piece(i)
            b.append((i, bytes([int(name[3:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()))
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, piece in side:
                at += len(piece)
                own.append(at)
            ends.append(own)
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            out.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
            i, j = x, y
        return a, b, out


def brute(rows):
    plain, every = Plain(), []
    for i, text in rows:
        every.append((i, *plain.groups(text)))
    counts = Counter((a[-1], b[-1]) for *_, groups in every for a, b in groups)
    highest: dict = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for i, a, b, groups in every:
        own = [counts[x[-1], y[-1]] for x, y in groups]
        best = sum(counts[x[-1], y[-1]] == highest[y[-1]] for x, y in groups)
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(groups), best, sum(own), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out)


def test_apply_equals_brute_force(spark):
    rows = [(n, t) for n, t in enumerate([*TEXTS, *TEXTS[4:9]])]
    got = A.apply(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted(map(tuple, got.collect()))
    assert found == brute(rows)
    assert {r[0] for r in found if r[1] == 0} == {0, 1, 7, 21}


def test_whole_table_equals_brute_force(spark, sf_small="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert sorted(map(tuple, A.apply(docs).collect())) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_ids_equal_those_of_whole_texts(aligner):
    rng, plain = random.Random(5), Plain()
    parts = ["a", "the", "Zürich", " ", "  ", "\n", "\t", ".", "'s", "12", "▂", "漢", " ", " ", "\x1c", "-", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        a, b, *_ = aligner.encode([text])
        assert (a.tolist(), b.tolist()) == (plain.a.encode(" " + text, add_special_tokens=False).ids, plain.b.encode(text)), repr(text)


def test_runs_are_all_common_ends():
    rng = random.Random(1)
    for _ in range(300):
        end = rng.randint(1, 300)
        often = rng.choice([0.02, 0.3, 0.8, 1.0])
        a, b = ([*[x for x in range(1, end) if rng.random() < often], end] for _ in range(2))
        if rng.random() < 0.3:
            b = a[:]
        found = A.runs(a, b)
        x, y = A.last_tokens(found)
        assert [a[i] for i in x] == [b[j] for j in y] == sorted(set(a) & set(b))
    assert A.runs([], []) == [] and A.runs(list(range(1, 1001)), list(range(1, 1001))) == [(0, 0, 1000)]


def test_pairs_are_bounded_by_the_vocabularies(aligner):
    assert A.most_pairs([b"ab", b"b"], [b"b", b"ab", b"cab"]) == 6
    assert A.most_pairs(*aligner.pieces) < 300_000


def test_alignments_keep_ids_and_groups(spark):
    got = A.alignments(spark.createDataFrame([(1, "hello there", 0, ""), (2, None, 0, "")], SCHEMA)).orderBy("doc_id").collect()
    assert got[0]["a_last"][-1] == len(got[0]["a_ids"]) - 1 and got[0]["b_last"][-1] == len(got[0]["b_ids"]) - 1 and got[1]["a_ids"] == []


def test_empty_table_and_very_long_texts(spark, aligner):
    assert A.apply(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "many words, one after another. " * 60_000
    x = aligner.align([None, long, "ab" * 100_000, "▁", "end"])
    assert x.a_starts[2] == len(aligner.encode.first.encode(" " + long)) and x.a_starts[1] == 0 and x.a_starts[3] == x.a_starts[4] < x.a_starts[5]
    assert [x.a_last[x.starts[k] - 1] for k in (2, 3, 5)] == [x.a_starts[k] - 1 for k in (2, 3, 5)]


def test_beginning_anew_changes_nothing(monkeypatch, aligner):
    texts = [t for t in TEXTS if t] * 3
    want = [v.tolist() for v in aligner.encode(texts)]
    monkeypatch.setattr(A, "REMEMBERED", 2)
    monkeypatch.setattr(A, "SHORT", 3)
    fresh = A.Encoder(*A.default_paths())
    assert all([v.tolist() for v in fresh(texts)] == want for _ in range(3))
