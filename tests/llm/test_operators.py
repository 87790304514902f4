"""Training-data operators against brute force, the tokenizers library and round trips, with the odd rows each must bear."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, chunks, embed_dedup, language_id, ngram_join, packing, pii, substring_dedup, token_store, topk_search, toxicity

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SYLLABLES = "an ber con dis el fer gra hol in jor kam lin".split()


def word(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3)))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, a shared passage, texts of 0 to 9 words, white space of all kinds, one long text."""
    rng = random.Random(7)
    out = [None, "", " \t\n", "a b", "a b", "A B c d", "a b c d", "a b c d e", "é \x1c x y　z", "tail ", "x<|endoftext|> y"]
    base = [word(rng) for _ in range(120)]
    passage = " ".join(word(rng) for _ in range(35))
    for i in range(40):
        own = list(base)
        for _ in range(i % 7):
            own[rng.randrange(len(own))] = word(rng)
        out.append(" ".join(own))
    for _ in range(25):
        out.append(" ".join(word(rng) for _ in range(rng.randint(5, 90))) + "\n" + passage + ".\n" + " ".join(word(rng) for _ in range(30)))
    out.append(" ".join(word(rng) for _ in range(9000)))
    return out + out[11:14]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, key string").repartition(3)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("false")


def groups_of(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, texts, no_docs, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(spark, docs, k, percent).collect()}
    want = groups_of(links, range(len(texts)))
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    if k == 4:
        assert ngram_join.similar_groups(spark, no_docs, k, percent).count() == 0


def test_signatures_meet_whenever_sets_link():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(6, 200))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n * 15 // 100 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)])
        x, y = np.unique(a), np.unique(b)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            owner, key = ngram_join.signatures([x, y], 85)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def removed(texts, window):
    seen, out = set(), []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            own = tuple(w[p : p + window])
            if own in seen:
                gone[p : p + window] = [True] * window
            seen.add(own)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(spark, docs, texts, no_docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_report(spark, docs, 20).collect()}
    assert got == dict(enumerate(removed(texts, 20)))
    assert substring_dedup.substring_report(spark, no_docs, 20).count() == 0


def test_bpe_equals_the_library(spark, docs, texts, no_docs):
    blob = open(BYTE, encoding="utf-8").read()
    library = Tokenizer.from_str(blob)
    codec, encoder = bpe.codec(blob)
    rng = random.Random(1)
    signs = list("abcdeéß  \n\t\r's'tre,.!?123٣中文   \x1c\x85é İς😀") + ["<|endoftext|>", "the", "ing", " the", "  ", "aaaa"]
    odd = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.texts(odd)] == want
    assert [codec.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in bpe.encode_decode(spark, docs, BYTE).collect()}
    assert got == {i: (e.ids, t or "") for i, (t, e) in enumerate(zip(texts, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True))}
    assert bpe.encode_decode_digests(spark, no_docs, BYTE).count() == 0


def test_library_chunks_equal_whole_texts(texts):
    rng = random.Random(2)
    signs = list("abcÉß  \n\t's'm,.12中é İς") + ["<|endoftext|>", "ing", "  "]
    odd = [t or "" for t in texts] + ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)]
    for path in (BYTE, WORD):
        blob = open(path, encoding="utf-8").read()
        want = [e.ids for e in Tokenizer.from_str(blob).encode_batch(odd, add_special_tokens=False)]
        assert [x.tolist() for x in chunks.library_encoder(blob, path).texts(odd)] == want


def test_token_store(spark, docs, texts, no_docs):
    library = Tokenizer.from_file(BYTE)
    ids = [np.array(e.ids + [0], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    starts = np.cumsum([0] + [len(x) for x in ids])
    got = {r["doc_id"]: tuple(r)[1:] for r in token_store.stored_tokens(spark, docs, BYTE).collect()}
    assert got == {i: (int(starts[i]), len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}
    assert token_store.stored_tokens(spark, no_docs, BYTE).count() == 0
    segment = bytearray(token_store.pack_segment([1], [ids[-1]]))
    segment[-9] ^= 1
    with pytest.raises(ValueError):
        token_store.unpack_segment(bytes(segment))


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 6000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for top in (2, 300, 1 << 16):
        ids = rng.integers(0, top, n).astype("<u4")
        blocks, sums = token_store.encode_blocks(ids)
        assert (token_store.decode_blocks(blocks, n, sums) == ids).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[50:80] = x[0] + rng.normal(size=(30, 16)) * 0.08
    x[80:90] = x[1]
    x[90:95] = x[2] * 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, [1.0] * 3), (305, [float("inf")] + [1.0] * 15)]
    return x, spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, links string")


def test_embedding_dedup(spark, vectors):
    x, df = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95 - 1e-15) & ~np.eye(len(x), dtype=bool)
    want = groups_of([(int(a), int(b)) for a, b in np.argwhere(near)], range(306))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(spark, df, 0.95).collect()}
    assert got == {i: (int(near[i].sum()) if i < 300 else 0, want[i], want[i] == i) for i in range(306)}
    assert embed_dedup.near_vectors(spark, df.where("false"), 0.95).count() == 0


def test_top_k(spark, vectors):
    x, df = vectors
    whole = np.floor(256 * x).astype(np.int64)
    got = {}
    for r in topk_search.top_vectors(spark, df, every=50, k=5, shard=64, block=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 300, 50):
        order = [i for i in np.lexsort((np.arange(300), -(whole @ whole[q]))) if i != q][:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, int(whole[i] @ whole[q])) for i in order]
    assert len(got) == 6 and topk_search.top_vectors(spark, df.where("false")).count() == 0


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii_base_spans(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(9)
    signs = list("ab@@..--  ++0123456789()é😀") + ["a@b.co", "1.2.3.4", "+1 (652) 555-5229", "4111 1111 1111 1111"]
    rows = ["a@b.c_d@e.f x", "a@b@c.d", "1.2.3.4.5 256.1.1.1 000.1.2.3", None, "", "x" * 40000 + "@", "1" * 20000, "1 " * 3000, "a@b.co " * 300]
    rows += ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(600)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in pii.pii_report(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, t in enumerate(rows):
        found = []
        for kind, pattern in kinds.items():
            for m in re.finditer(pattern, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                fine = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
                found += [f"{kind}:{m.start()}:{m.end()}"] * fine
        assert got[i][:5] == (*(sum(f.startswith(k) for f in found) for k in kinds), hashlib.sha256(",".join(found).encode()).hexdigest()), t
        assert set(found) <= set(got[i][5].split(",")) | {""}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, spans string")
    assert {r["doc_id"]: (r["text"], r["spans"]) for r in pii.redact(spark, df).collect()} == {1: ("mail [EMAIL] now", "x"), 2: (None, "y"), 3: ("clean", "z")}


def test_toxicity(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        own = [word(rng) for _ in range(rng.randint(3, 60))]
        if i % 5 == 0:
            own[rng.randrange(len(own))] = rng.choice(["zorgus", "blarf", "quexx" + word(rng)])
        rows.append((i, " ".join(own), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id % 3 <> 1"))
    assert {"zorgus ", "blarf ", "quexx"} <= set(lexicon.weights)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(spark, df, lexicon).collect()}
    assert all((scores[i] >= 0.7) == bool(t) for i, _, t in rows if i % 3 == 1)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "an Z0RGU$ el"), (4, "an zоrgus!!! el"), (5, "trash can")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] >= 0.7 for r in toxicity.score_texts(spark, odd, lexicon).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}
    assert toxicity.Lexicon({"trash ": 5.0}).evidence("a trash can") == 0 < toxicity.Lexicon({"trash ": 5.0}).evidence("a trash heap")
    assert toxicity.learn(spark, df.where("false"), df.select("doc_id", "toxic")).weights == {}


def test_language_id(spark):
    rng = random.Random(6)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "mnopqr"}
    rows = [(i, " ".join("".join(rng.choices(letters[l], k=rng.randint(2, 7))) for _ in range(30)), l) for i in range(300) for l in [("aa", "bb", "cc")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(spark, df.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark, df, filters).collect()}
    held = [(got[i], l) for i, _, l in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, "mnopqr")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark, odd, filters).collect()} == {1: "und", 2: "und", 3: "cc"}
    assert language_id.learn(spark, df.where("false")) is None


def test_packing(spark, docs, texts, no_docs):
    library = Tokenizer.from_file(WORD)
    ids = [np.array(e.ids + [2], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces = packing.pack(spark, docs, WORD, lot=20_000).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        own = np.array(p["ids"], "<u4")
        assert len(own) == p["length"] and zlib.crc32(own.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], own))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all((np.concatenate([x for _, x in sorted(by_doc[i], key=lambda y: y[0])]) == own).all() for i, own in enumerate(ids))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= packing.CAPACITY
    assert packing.pack(spark, no_docs, WORD).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 2048, 400)
    loads = np.bincount(packing.difference(sizes, 90), sizes, 90)
    assert loads.sum() == sizes.sum() and loads.max() < 1.1 * loads.mean()


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (5, text), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.similar_groups(spark, df, 4, 85).where("n_shingles > 0").collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3)]
    cut = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.substring_report(spark, df).collect())
    assert cut == [(-1, 0), (-1, 0), (3, 0), (3, 0), (5, 40)]
    assert packing.pack(spark, df, WORD).select(F.sum("length")).first()[0] == token_store.stored_tokens(spark, df.withColumn("text", F.col("text")), WORD, 2).select(F.sum("n_tokens")).first()[0]


def test_pipeline_stages(spark, tmp_path):
    """Decisions of each stage against brute force on its own input, with columns whose names clash."""
    import corpus_pipeline

    rng = random.Random(12)
    own = [" ".join(word(rng) for _ in range(60)) for _ in range(40)]
    passage = " ".join(word(rng) for _ in range(25))
    rows = [(i, t + " tail", "en", "s", 0, "x") for i, t in enumerate(own)]
    rows += [(100 + i, own[i], "en", "s", 0, "x") for i in range(5)]
    rows += [(200 + i, " ".join(word(rng) for _ in range(60)) + " " + passage, "en", "s", 0, "x") for i in range(3)]
    rows += [(300, "reach me a@b.co", "en", "s", 0, "x"), (301, None, None, None, None, "x"), (302, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    near = ngram_join.drop_similar(spark, docs, 5, 80)
    assert near.columns == docs.columns
    assert {r["doc_id"] for r in near.collect()} == {r[0] for r in rows} - {100 + i for i in range(5)}
    cut = substring_dedup.cut_documents(spark, near, 20)
    held = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and held[200].endswith(passage) and not any(passage in held[i] for i in (201, 202)) and held[301] is None
    clean = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in pii.redact(spark, cut).collect()}
    assert clean[300] == ("reach me [EMAIL]", 16, "x") and clean[0][0] == held[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "pii", "packing"]


def test_plain_words_equal_the_library():
    with open(WORD, encoding="utf-8") as f:
        blob = f.read()
    tokenizer = Tokenizer.from_str(blob)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    texts = ["it's They'LL ÀÉß's 12a3!?..  \n\n ab", "", "zzz<|endoftext|>q", "x×y Ÿ é ö a\tb", "'S'sé--'' 'd", "\x7f a\x85b  c", "a" * 300 + " aaaa", "ab" * 70]
    encoder = chunks.library_encoder(blob, WORD)
    assert encoder.plain is not None
    assert [ids.tolist() for ids in encoder.texts([*texts, None])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] + [[]]
