"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugeloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a int, pairs string"


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    token_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    found = []
    for i, t in rows:
        groups = []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            ends = []
            for ids, shown in ((x, lambda k: token_a[k]), (y, lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
                out, at = {}, 0
                for n, k in enumerate(ids):
                    at += len(shown(k))
                    out[at] = n
                ends.append((out, b"".join(map(shown, ids))))
            if ends[0][1] == ends[1][1] == (" " + t).encode():
                p = q = 0
                for cut in sorted(set(ends[0][0]) & set(ends[1][0])):
                    m, n = ends[0][0][cut] + 1, ends[1][0][cut] + 1
                    groups.append((x[p:m], y[q:n]))
                    p, q = m, n
        found.append((i, groups))
    count = Counter((g[0][-1], g[1][-1]) for _, groups in found for g in groups)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for i, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, count, best


def odd_texts():
    r = random.Random(4)
    words = ["the", "don't", "stop", "Grüße", "naïve", "12,345.67", "🙂🙃", "日本語の文章", "<|endoftext|>", "<s>", "</s>", "<0x41>", "x" * 70, "...", "'s", " ", "á", "\t", "\n", "  ", "\r\n", "e f", "　"]
    texts = [None, "", " ", "\n", "   lead", "trail   ", "one", "a▁b", "\x00nul", "ends with 'll ", "\x1cfs gs\x1d x", "日本語" * 300, "z" * 5_000, "no-space-" * 200, "a  b   c", " a", "﻿bom", "’s quoted’ d"]
    texts += [r.choice(["", " ", "\n"]).join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    return texts + ["the the the and " * 50] * 9


@pytest.fixture(scope="module")
def rows():
    return [(i if i % 50 else None, t) for i, t in enumerate(odd_texts())] + [(3, "one"), (3, "one")]


def test_matches_whole_texts(spark, rows):
    want, count, best = brute(rows)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in alignment.align(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    assert got == sorted(want, key=str)
    pairs = {(r["id_a"], r["id_b"]): (r["count"], r["best"]) for r in alignment.dictionary(docs, A, B).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in count.items()}


def test_many_chunks_parts_and_blocks(spark, rows, monkeypatch):
    for name, value in {"TEXTS": 5, "FAN_IN": 3, "SCORE_CHUNKS": 2, "COUNT_SHARE": 1 << 30, "GROUP_BYTES": 500, "BLOCK": 40, "TOGETHER": 150, "CACHE_PARTS": 30}.items():
        monkeypatch.setattr(alignment, name, value)
    alignment.aligner.cache_clear()
    model = alignment.Aligner(A, B)
    want, _, _ = brute(rows)
    assert [x[:4] for x in model.texts([t for _, t in rows])] == [(w[1], w[2], w[3], w[7]) for w in want]
    monkeypatch.setattr(alignment, "BLOCK", 1 << 20)
    monkeypatch.setattr(alignment, "TOGETHER", 1 << 18)
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_ranks_give_the_tokenizers_ids():
    """Every character below U+0250 beside letters, digits, signs and blanks."""
    model, a = alignment.Aligner(A, B), Tokenizer.from_file(A)
    a.encode_special_tokens = True
    assert model.ranks is not None
    texts = [f" {x}{chr(c)}{y}{chr(c)}{chr(c)} {chr(c)}{x}" for c in range(0x250) for x, y in (("a", "1"), ("é", " "), ("'", "s"), ("\n", "."), ("", "\t"))]
    texts += [t for t in map(lambda t: " " + (t or ""), odd_texts()) if max(t) < "\u0250"]
    assert [model._ids(t, True) for t in texts] == [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]


def test_empty_table_and_query(spark, tmp_path):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    spark.createDataFrame([(1, None, "a"), (2, "▁", "b"), (5, "two words", None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_alignment(spark, str(tmp_path)).collect()}
    assert got[1]["n_a"] == got[2]["n_b"] == 0 and got[1]["groups_sha256"] == got[2]["groups_sha256"] == "" and got[5]["n_links"] == got[5]["n_groups"] == got[5]["n_best"] == got[5]["count_sum"] == 2
