"""Packing, pieces, language, toxicity, audio, shards and chats on small tables, against the libraries and brute force."""

import hashlib
import io
import os
import random
import time
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import chat, langid, media, packing, pieces, queries, shards, toxicity

os.environ["TOKENIZERS_PARALLELISM"] = "false"
DOCS = "doc_id long, text string"
ODD = ["", None, " ", "\n\n", "Hello, world.", "don't 's 'S", "é É İ ſ", "é क़", "a  b   c" + " " * 40 + "d", "日本語 text", "🎉🎉 ok", "<|endoftext|> x", "<s></s>", "x▁y ▁▁ z", "aaa nnnn lllll", "\x00\x1c\x85 ", "word." * 700, "tab\tand nbsp"]
ODD += [" " * k + "in" + " " * k for k in range(1, 40)]


def random_texts(n, seed=1):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "é", "\n", "▁", "the", "ing", "中", "e", "t", "'s", ".", ",", "1", "İ", "ss", "ll", "́"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return ODD + random_texts(300)


def frame(spark, texts, extra=False):
    rows = list(enumerate(texts))
    return spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS + ", ids string, score int") if extra else spark.createDataFrame(rows, DOCS)


def test_pieces_are_those_of_the_library(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_decode(frame(spark, texts, extra=True), path).collect():
        want = sp.encode(texts[r["doc_id"]] or "")
        assert (r["ids"], r["decoded"]) == (want, sp.decode(want)), texts[r["doc_id"]]
    assert pieces.encode_decode(spark.createDataFrame([], DOCS), path).count() == 0


def test_pieces_with_a_small_cache(monkeypatch, texts):
    import sentencepiece

    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 7)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, chunks = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Chunks(pieces.encoder(path))
    for t in texts:
        assert pieces.encode(t or "", chunks).tolist() == sp.encode(t or "")


@pytest.mark.parametrize("cache", [packing.CACHE_WORDS, 5])
def test_tokens_are_those_of_the_library(monkeypatch, texts, cache):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", cache)
    path = public_tokenizers.path("word_bpe_49k.json")
    model, want = packing.Tokens(path), Tokenizer.from_file(path)
    for i in range(0, len(texts), 9):
        part = pa.array(texts[i : i + 9], pa.string())
        for t, got in zip(texts[i : i + 9], model.encode(part).to_pylist()):
            assert np.frombuffer(got, np.uint16).tolist() == want.encode(t or "", add_special_tokens=False).ids, t


def test_packing_lays_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    rows = packing.pack(frame(spark, texts + [texts[16]] * 30, extra=True).repartition(3), path, longest=64).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts + [texts[16]] * 30):
        ids, at = want.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(of_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for held in of_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_hilbert_visits_neighbours():
    side = 1 << packing.BITS
    cells = np.array([(a, b, c, d) for a in range(4) for b in range(4) for c in range(4) for d in range(4)], np.uint32) * (side // 4)
    keys = packing.hilbert(cells)
    assert len(set(keys.tolist())) == 256
    walk = cells[np.argsort(keys)].astype(int) // (side // 4)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_audio_is_lossless_and_fixed_in_shape(spark, texts):
    got = media.audio_features(frame(spark, [*texts, "long text " * 9000, texts[4]], extra=True)).collect()
    seen = {}
    for r in got:
        text = [*texts, "long text " * 9000, texts[4]][r["doc_id"]]
        raw = (text or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert r["payload"] == padded and r["n_bytes"] == len(raw)
        with wave.open(io.BytesIO(r["media"])) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, padded)
        table = pa.ipc.open_stream(r["tensors"]).read_all()
        assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float16(), [16, 40])
        assert sum(table["frames"].to_pylist()) == r["n_frames"] and table["start_ms"][0].as_py() == 0
        assert seen.setdefault(text or "", (bytes(r["media"]), bytes(r["tensors"]))) == (r["media"], r["tensors"])


def test_resampling_keeps_a_tone_and_drops_what_aliases():
    a = media.Audio()
    t = np.arange(24_000) / a.rate
    low = media.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32), a)
    high = media.resample(np.sin(2 * np.pi * 11_000 * t).astype(np.float32), a)
    assert len(low) == 16_000 and np.argmax(np.abs(np.fft.rfft(low))) == 1000
    assert np.abs(low[200:-200]).max() > 0.9 and np.abs(high[200:-200]).max() < 0.1


def test_segments_open_high_and_close_low():
    e = np.array([0, 0, 5, 4, 2.2, 2.2, 5, 0, 0, 2.2, 0], np.float32)
    assert media.segments(e, media.Audio()).tolist() == [[2, 7]]


LANGS = {"en": ["the", "and", "with", "thing", "over"], "de": ["und", "der", "ich", "schön", "nicht"], "fr": ["le", "est", "été", "que", "où"]}


def corpus(n, seed=2):
    r = random.Random(seed)
    return [(i, lang := r.choice(list(LANGS)), " ".join(r.choice(LANGS[lang]) for _ in range(r.randint(5, 60)))) for i in range(n)]


def test_languages_are_told_on_held_out_rows(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, lang string, text string, score double")
    model = langid.train(docs.where("doc_id < 300"), limit=200)
    odd = spark.createDataFrame([(1000, None, None, 0.1), (1001, "en", "", 0.1), (1002, "en", "12 34 !", 0.1), (1003, None, "ü", 0.1), (1004, "x", "der und " * 40_000, 0.1)], docs.schema)
    got = {r["doc_id"]: r for r in langid.identify(docs.unionByName(odd), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, lang, _ in rows if i >= 300]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004]["lang_pred"] == "de" and got[1003]["lang_pred"] in LANGS
    assert all(0 <= r["score"] <= 1 for r in got.values()) and set(got[0].asDict()) == {"doc_id", "lang", "text", "lang_pred", "score"}
    assert langid.identify(docs.limit(3), langid.train(docs.limit(0))).where("lang_pred = 'und' AND score = 0").count() == 3


def test_language_scores_match_single_texts():
    model = langid.Model(("a", "b"), np.log(np.random.default_rng(1).random((langid.BUCKETS, 2))).astype(np.float32), np.log([0.2, 0.8]))
    texts = ["x", "yz", "longer text here", "é" * 50, "z" * 300_000, "end", "ab" * langid.BLOCK_POINTS]
    for t, s, n in zip(texts, *langid.scores(texts, model)):
        every = np.concatenate([g for _, g in langid.grams(langid.code_points(t))])
        assert n == len(every) and np.allclose(s, model.prior + model.log_prob[every].astype(float).sum(axis=0), rtol=1e-6)


def test_language_model_counts_are_those_of_brute_force(spark):
    rows = [(0, "a", "abc"), (1, "a", "ab"), (2, "b", "xyz xyz"), (3, None, "zz"), (4, "b", None), (5, "b", ""), (None, "a", "qq"), (1, "a", "ab")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), smoothing=0.5)
    assert model.languages == ("a", "b")
    for k, texts in enumerate((["abc", "ab", "ab"], ["xyz xyz", ""])):
        n = np.full(langid.BUCKETS, 0.5)
        for t in texts:
            for _, g in langid.grams(langid.code_points(t)):
                np.add.at(n, g, 1)
        assert np.allclose(model.log_prob[:, k], np.log(n / n.sum()), rtol=1e-5)
    assert np.allclose(np.exp(model.prior), [3.5 / 6, 2.5 / 6])


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "doc_id long, lang string, text string"))


def toxic_corpus(n, seed=3):
    r = random.Random(seed)
    clean = ["meadow", "river", "theory", "paper", "minute", "lantern", "garden", "stone", "letter", "winter"] + [f"{a}{b}" for a in ("con", "per", "tra") for b in ("dit", "lum", "ner", "sol")]
    rows = []
    for i in range(n):
        bad = r.random() < 0.25
        words = [r.choice(clean) for _ in range(r.randint(8, 40))]
        if bad:
            words[1:1] = r.sample(["idiot", "moron", "stupid", "worthless"], 2)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_reads_through_obfuscation(spark):
    rows = toxic_corpus(600)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    hidden = ["you 1d1ot there", "what a m0r0n", "so stuuupid", "w0rthle$$ paper", "i d i o t letter", "m-o-r-o-n", "st.u.p.i.d"]
    plain = ["THE!! garden OF!! stone", "a$$$ river", "96d17ded865a61704b5b8dc5", "a a a a a a a a", "meadow 2024 12:30", "x@y.example.com"]
    odd = spark.createDataFrame([(10_000 + k, t, 0.0) for k, t in enumerate([*hidden, *plain, None, "", "river " * 30_000])], docs.schema)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs.unionByName(odd), model).collect()}
    held = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert np.mean(held) > 0.99
    assert sum(got[10_000 + k] >= 0.7 for k in range(len(hidden))) >= len(hidden) - 1
    assert all(got[10_000 + len(hidden) + k] < 0.7 for k in range(len(plain) + 3))
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(5), none).where("toxicity BETWEEN 0 AND 0.5").count() == 5


LONG = ["".join(chr(0x4E00 + i % 3000) for i in range(100_000)), "😀" * 100_000, "1@" * 50_000, "a" * 100_000, "a1" * 50_000, "a." * 50_000, "a " * 50_000, "_ " * 50_000]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_texts_without_words(text):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, chunks = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Chunks(pieces.encoder(path))
    ids = pieces.encode(text, chunks).tolist()
    assert ids == sp.encode(text) and chunks.model.decode(ids) == sp.decode(ids)
    model = toxicity.Model({0: {"idiot": 9.0}, 4: {}, 5: {}}, -2.0, np.log(np.full((toxicity.LETTERS,) * 3, 1 / toxicity.LETTERS)))
    began = time.process_time()
    assert toxicity.Scorer(model).score(text) < 0.5 < toxicity.Scorer(model).score(text + " idiot")
    assert time.process_time() - began < 10  # about a second; what is quadratic takes minutes
    assert len(langid.scores([text], langid.Model(("a", "b"), np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2)))[0]) == 1


def test_letter_counts_match_plain_counting():
    texts = ["The cat, the CAT", "", "a1b  c", "éa ² _x_", "\n\nend"]
    want = Counter()
    for w in toxicity.WORD.findall("\n".join(texts).lower()):
        at = [0, 0, *map(toxicity._index, w), 0]
        want.update(zip(at, at[1:], at[2:]))
    got = toxicity.letter_counts(texts).reshape((toxicity.LETTERS,) * 3)
    assert {tuple(map(int, g)): int(got[tuple(g)]) for g in np.argwhere(got)} == dict(want)


def test_toxicity_trains_on_all_unlike_rows(spark):
    rows = [(1, "you idiot"), (1, "you fool"), (1, "idiot"), (0, "idiot"), (1, "idiot"), (1, "a b c d"), (1, "a b c d"), (1, None)]
    got = toxicity.one_of_copies(spark.createDataFrame(rows, "toxic int, text string")).collect()
    assert len(got) == 6  # texts of one length are not one row
    docs = spark.createDataFrame([(k, t, 1) for k, (_, t) in enumerate(rows)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, y, 2) for k, (y, _) in enumerate(rows)] + [(None, 1, 2), (99, 1, 2), (0, None, 2)], "doc_id long, toxic int, text int")
    plain = toxicity.labelled(docs, labels).orderBy("text").collect()
    assert [tuple(r) for r in plain] == sorted(((y, t or "") for y, t in rows), key=lambda r: r[1])


def test_separators_are_edges_of_the_lattice():
    letters = np.full((toxicity.LETTERS,) * 3, 0.01)
    for w in ("you", "idiot", "are", "an"):
        at = [0, 0, *map(toxicity._index, w), 0]
        for g in zip(at, at[1:], at[2:]):
            letters[g] += 1
    letters = np.log(letters / letters.sum(axis=2, keepdims=True)).tolist()
    assert toxicity.restore("i d i o t", letters, spaced=True).split() == ["idiot"]
    assert toxicity.restore("y.o.u i-d-1-o-t", letters, spaced=True).split() == ["you", "idiot"]
    assert toxicity.restore("y o u a r e", letters, spaced=True).split() == ["you", "are"]


def test_viterbi_finds_the_best_path():
    letters = np.full((toxicity.LETTERS,) * 3, 0.01)
    for w in ("idiot", "idle", "lion", "toil"):
        at = [0, 0, *map(toxicity._index, w), 0]
        for g in zip(at, at[1:], at[2:]):
            letters[g] += 1
    letters = np.log(letters / letters.sum(axis=2, keepdims=True))

    def score(word):
        at = [0, 0, *map(toxicity._index, word), 0]
        return sum(letters[g] for g in zip(at, at[1:], at[2:]))

    for noisy in ("1d10t", "!d1e", "l10n", "7011"):
        paths = [("", 0.0)]
        for c in noisy:
            options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LEET[c]] + [("", toxicity.LOSE)]
            paths = [(t + x, s + cost) for t, s in paths for x, cost in options]
        best = max(s + score(t) for t, s in paths)
        assert any(t == toxicity.restore(noisy, letters.tolist()) and s + score(t) > best - 1e-9 for t, s in paths)


def test_shards_are_even_and_slots_gapless(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 300), r.choice(["hot", "hot", "s1", "s2", None]), r.choice(["en", "de", None])) for i in range(3000)] + [(None, None, None, None), (5000, "", "hot", "en"), (5000, "", "hot", "en")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, lang string, node int")
    got = shards.shard_documents(docs, 12).collect()
    assert len(got) == len(rows)
    size, slots = defaultdict(int), defaultdict(list)
    for x in got:
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert len(size) == 12 and max(size.values()) - min(size.values()) <= 2 * 316
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {i: t or "" for i, t, _, _ in rows}
    assert all(x["text_crc32"] == zlib.crc32(texts[x["doc_id"]].encode()) and x["size"] == 16 + len(texts[x["doc_id"]]) for x in got)
    assert shards.shard_documents(docs.limit(0), 12).count() == 0 and shards.shard_documents(docs.limit(3), 1).count() == 3


def test_shards_are_those_of_a_plain_tree(spark):
    r = random.Random(9)
    rows = [(i, "x" * r.randint(0, 400), r.choice(["hot", "hot", "s1", None]), r.choice(["en", None])) for i in range(400)] + [(1000 + i, "copy " * 20, "hot", "en") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    todo, at = [(x, 7) for x in [shards.metadata(docs).collect()]], {}
    while todo:  # depth first, the left side first: shards in order of the leaves
        node, k = todo.pop(0)
        if k == 1:
            at |= {x["doc_id"]: len(set(at.values())) for x in node} if node else {}
            continue
        wide = lambda d: max(x[f"u_{d}"] for x in node) - min(x[f"u_{d}"] for x in node)
        d = max(shards.DIMENSIONS, key=wide)
        wanted, key = sum(x["size"] for x in node) * (k // 2) / k, lambda x: x[f"k_{d}"]
        upto = lambda v, key=key, node=node: sum(x["size"] for x in node if key(x) <= v)
        mid = min(v for v in {key(x) for x in node} if upto(v) >= wanted)
        low, high = sum(x["size"] for x in node if key(x) < mid), upto(mid)
        if min(high - wanted, wanted - low) <= shards.TOLERANCE * wanted:
            left = [x for x in node if key(x) < mid or (key(x) == mid and high - wanted <= wanted - low)]
        else:
            inside = sorted((x for x in node if key(x) == mid), key=lambda x: x["tie"])
            tie = min(t for t in {x["tie"] for x in inside} if low + sum(x["size"] for x in inside if x["tie"] <= t) >= wanted)
            below, with_ = (low + sum(x["size"] for x in inside if x["tie"] < t) for t in (tie, tie + 1))
            left = [x for x in node if key(x) < mid or (key(x) == mid and x["tie"] < tie + (with_ - wanted <= wanted - below))]
        todo[:0] = [(left, k // 2), ([x for x in node if x not in left], k - k // 2)]
    got = {x["doc_id"]: x["shard"] for x in shards.shard_documents(docs, 7).collect()}
    assert got == at
    weight = Counter()
    for x in shards.metadata(docs).collect():
        weight[got[x["doc_id"]]] += x["size"]
    assert max(weight.values()) - min(weight.values()) < 0.1 * sum(weight.values()) / 7


def test_chats_keep_maximal_conversations(spark):
    turns = lambda c, *t: [(c, k, "user" if k % 2 == 0 else "assistant", x, c) for k, x in enumerate(t)]
    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "a", "x") + turns(5, "b") + turns(6, "a") + turns(7, None, "") + turns(8, None)
    rows += [(9, 0, None, "q", 1), (9, 0, None, "q", 1), (10, 0, None, "q", 1), (None, 0, "user", "lost", 1), (11, None, "user", "z", 1), (11, 0, "user", "y", 1)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos long")).collect()}
    assert set(got) == {2, 4, 5, 7, 9, None, 11}
    assert (got[2]["n_turns"], got[2]["n_copies"]) == (3, 2)
    assert got[2]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[9]["n_turns"] == 2 and got[9]["rendered"].startswith("<|im_start|>unknown\nq")
    assert got[11]["rendered"].index("z") < got[11]["rendered"].index("y")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_digests_follow_from_the_outputs(spark, tmp_path):
    texts = ["Hello there, world", None, "Hello there, world"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op9_sentencepiece(spark, str(tmp_path)).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    tails = {r["doc_id"]: r["tail_crc32"] for r in queries.op3_audio_features(spark, str(tmp_path)).collect()}
    assert tails == dict.fromkeys(range(3), zlib.crc32(b" " * 16))


def test_labels_never_reach_the_score_of_held_out_rows(spark):
    rows = toxic_corpus(90)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    used = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    flipped = labels.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    assert toxicity.train(docs, used).weights == toxicity.train(docs, flipped).weights


def test_written_tables_can_be_discarded(spark, tmp_path):
    from gaugeloom.llm import store

    kept = store.written(spark.range(5), "kept")
    assert kept.count() == 5 and store.discard(spark) >= 1
    assert sorted(r["id"] for r in store.some(spark.range(50_000), "id", 10, seed=1).collect()) == sorted(r["id"] for r in spark.range(50_000).orderBy(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 40))).limit(10).collect())
    assert store.some(spark.range(3), "id", 10, seed=1).count() == 3


def test_long_readings_are_the_likeliest(monkeypatch):
    """Settling what all paths share changes no reading."""
    r = random.Random(8)
    letters = np.log(np.array([r.random() + 0.01 for _ in range(28**3)]).reshape(28, 28, 28)).tolist()
    texts = ["".join(r.choice("abcde1340@$*xx..-") for _ in range(n)) for n in (5, 60, 400, 900)]
    for spaced in (False, True):
        monkeypatch.setattr(toxicity, "STRETCH", 1 << 30)
        whole = [toxicity.restore(t, letters, spaced) for t in texts]
        monkeypatch.setattr(toxicity, "STRETCH", 7)
        assert [toxicity.restore(t, letters, spaced) for t in texts] == whole
