"""The pipeline against a plain version of its stages on a small corpus."""

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from gaugeloom.llm import lines, store

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = ["stone", "river", "lantern", "meadow", "garden", "letter", "winter", "paper", "minute", "theory", "harbour", "window"] + [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(160):
        bad = r.random() < 0.2
        text = ".\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(r.randint(2, 5)))
        if bad:
            text += " what an idiot and moron " + r.choice(vocab)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bad)))
    base = next(rows[i][1] for i, _, y in labels if not y)
    rows += [(200, base, "en", "s", len(base)), (201, base + " tail", "en", "s", 0), (202, None, "en", "s", 0), (203, "12 34", None, "s", 5), (204, "", "en", "s", 0)]
    long = " ".join(r.choice(vocab) for _ in range(200))
    rows += [(210, long, "en", "s", 0), (211, long + " one more", "en", "s", 0), (212, "so " + long, "en", "s", 0)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, rows, {i for i, _, y in labels if y}


def test_stages_take_effect(spark, corpus):
    root, rows, bad = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    texts = {i: t for i, t, *_ in rows}
    got = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != "packing":
            assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), SCHEMA)
        got.append({r["doc_id"]: r for r in out.collect()})
    language, toxic, deduped, single, packed = got
    assert set(texts) - set(language) == {202, 203, 204}
    assert set(language) - set(toxic) == bad & set(language)
    first = {}
    for i in sorted(toxic):
        for line in texts[i].split("\n"):
            k = line.strip(lines.BLANKS).translate(LOWER)
            if len(k) >= 10:
                first.setdefault(k, i)
    for i in toxic:
        kept = "\n".join(x for x in texts[i].split("\n") if first.get(x.strip(lines.BLANKS).translate(LOWER), i) == i)
        assert (i in deduped) == bool(kept.strip(lines.BLANKS)) and (i not in deduped or (deduped[i]["text"], deduped[i]["n_chars"]) == (kept, len(kept)))
    assert 200 not in deduped
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})(re.findall(r"[^\x20\x09-\x0d]+", r["text"].translate(LOWER))) for i, r in deduped.items()}
    gone = {j for i in sorted(sets) for j in sets if j > i and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert set(deduped) - set(single) == gone and {211, 212} <= gone and set(packed) == set(single)


def test_run_packs_what_is_left(spark, corpus):
    from tokenizers import Tokenizer

    root, rows, _ = corpus
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, root).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {i: t for i, t, *_ in rows}
    assert 210 in pieces and not {200, 202, 203, 204, 211, 212} & set(pieces)
    assert sorted(pieces[210])[0][2] == len(model.encode(texts[210], add_special_tokens=False).ids) + 1
    for parts in pieces.values():
        assert np.cumsum([0, *(n for _, n, _ in sorted(parts))]).tolist() == [*(s for s, _, _ in sorted(parts)), parts[0][2]]


def test_near_copies_keep_rows_without_id(spark):
    text = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (None, other), (None, "short one"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, text), (None, other), (None, "short one"), (3, None)], key=str)


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_drops_only_texts_without_letters(spark, lang):
    docs = spark.createDataFrame([(1, "a plain text", lang), (None, "\u0434\u0430", lang), (3, "12 34", lang), (4, "", lang), (5, None, lang)], "doc_id long, text string, lang string")
    assert sorted((r["text"] for r in corpus_pipeline.language(spark, docs, "").collect())) == ["a plain text", "\u0434\u0430"]


def test_run_keeps_documents_without_id_and_language(spark, tmp_path):
    texts = [" ".join(f"{w}{k}" for k in range(30)) for w in ("stone", "river", "paper")]
    spark.createDataFrame([(None, texts[0], None, "s", 0), (7, texts[1], None, "s", 0), (8, texts[2], None, "s", 0)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 7, 8}


def test_language_drops_what_it_cant_tell(spark):
    plain = [(k, "aaa bbb aaa", "en") for k in range(8)] + [(10 + k, "ccc bbb ccc", "de") for k in range(8)]
    odd = [(30, "bbb", None), (31, "aaa", None), (32, "bbb", "en"), (33, "ccc bbb", "de"), (34, "\u0436 bbb", None)]  # both languages have bbb
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(plain + odd, "doc_id long, text string, lang string"), "").collect()}
    assert got == {r[0] for r in plain} | {31, 33}


def test_run_on_an_empty_table_and_repeated_rows(spark, tmp_path):
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("same", [(7, " ".join(f"stone{k}" for k in range(30)), "en", "s", 0)] * 3 + [(7, "another text of one id", "en", "s", 0)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        before = store.made()
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len({r["doc_id"] for r in got}) == bool(rows) and store.made() <= before + 3
