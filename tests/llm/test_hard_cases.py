"""Odd rows that each operator must bear: long texts, hot groups, odd characters, repeated and missing ids, clashing columns, empty tables."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, chunks, common, embed_dedup, language_id, ngram_join, packing, pii, substring_dedup, token_store, topk_search, toxicity

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def words(rng, n, of=3000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "doc_id long, text string, h string, n string, twin string")


def test_words_are_cut_and_hashed_as_bytes(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 257)  # so that texts and words lie across pieces
    rng = random.Random(1)
    texts = [None, "", " ", "a", "x" * 600, *("".join(rng.choices("ab \t\n\x0b\x0c\rAé\x1c　z", k=rng.randint(0, 60))) for _ in range(800))]
    for lower in (False, True):
        for column in (pa.array(texts), pa.array(texts).slice(3, 500), pa.array([None], pa.string()), pa.array([], pa.string()), pa.array(texts, pa.large_string())):
            got, seen = common.Words(column, lower), {}
            for i, t in enumerate(column.to_pylist()):
                own, a, b = common.split_words(t, lower), got.bounds[i], got.bounds[i + 1]
                assert len(own) == b - a and all(seen.setdefault(w, h) == h for w, h in zip(own, got.hashes[a:b].tolist(), strict=True))
                assert b == a or lower or got.text(a, b).encode().split() == own
            assert len(set(seen.values())) == len(seen)
    whole = np.arange(1, 2000, dtype=np.uint64)
    long = common.rolling(whole, 5)
    assert len(long) == 1995 and (long[700:705] == common.rolling(whole[700:709], 5)).all() and len(set(long.tolist())) == 1995


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2050)] + [(2050, 2000), (7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 100 for i in range(100, 401)}, **{i: 1000 for i in range(1000, 1400)}, **{i: 2000 for i in range(2000, 2051)}}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_of_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    got = common.join_hot(rows, table, ["k"], "n", 3000)
    assert sorted(map(tuple, got.select("k", "v", "low").collect())) == sorted(map(tuple, rows.join(table, "k").select("k", "v", "low").collect()))


def test_near_copies_without_an_id_link(spark):
    rng = random.Random(4)
    base = words(rng, 120)
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in (3, 60, 110)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(spark, frame(spark, [(3, near[0]), (None, near[1]), (7, near[2])]), 5, 80).collect()}
    assert got == {3: 3, None: 3, 7: 3}
    bridge = [" ".join(base[: 120 - 12 * i] + words(rng, 12 * i)) for i in range(3)]
    only_none = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(spark, frame(spark, [(None, bridge[0]), (None, bridge[0] + " tail")]), 5, 80).collect()}
    assert only_none == {None: None}


def test_one_row_of_a_group_stays(spark):
    rng = random.Random(5)
    a, b = " ".join(words(rng, 60)), " ".join(words(rng, 60))
    rows = [(1, a), (2, a), (3, b), (3, a), (None, a), (4, None), (5, ""), (6, None)]
    got = sorted(((r["doc_id"] or -1, r["text"], r["h"]) for r in ngram_join.drop_similar(spark, frame(spark, rows)).collect()), key=str)
    assert [x[0] for x in got] == [-1, 1, 3, 4, 5, 6] and all(x[2] == "c" for x in got)
    assert ngram_join.drop_similar(spark, frame(spark, rows).where("false")).count() == 0


def test_a_long_document_and_many_copies(spark):
    rng = random.Random(6)
    long = " ".join(words(rng, 60_000, 10**6))
    rows = [(0, long), (1, long + " end"), *((i, "same words here " * 3) for i in range(2, 400))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(spark, frame(spark, rows), 5, 80).collect()}
    assert got == {0: 0, 1: 0, **{i: 2 for i in range(2, 400)}}
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_report(spark, frame(spark, rows[:2])).collect()}
    assert cut == {0: (60_000, 0), 1: (60_001, 60_000)}


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(7)
    for n in (1, 5, 33, 64, 500):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 12, dtype=np.uint64)]))
        x, y = ngram_join.sketch_of(a), ngram_join.sketch_of(b)
        while len(x) != len(y):
            x, y = (ngram_join._folded(x[None])[0], y) if len(x) > len(y) else (x, ngram_join._folded(y[None])[0])
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
    assert ngram_join.name_of(a) != ngram_join.name_of(b) and ngram_join.name_of(a[:0]) == (0, 0)


def test_rows_that_repeat_an_id_lose_their_words(spark):
    own = " ".join(f"w{i}" for i in range(40))
    rows = [(0, own), (1, "a a a"), (1, own), (1, own), (None, own)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_report(spark, frame(spark, rows)).collect())
    assert got == [(-1, 40, 0), (0, 40, 0), (1, 3, 0), (1, 40, 40), (1, 40, 40)]
    cut = sorted(((r["doc_id"] or -1, r["text"], r["h"]) for r in substring_dedup.cut_documents(spark, frame(spark, rows)).collect()), key=str)
    assert [x[1] for x in cut] == [own, own, "", "", "a a a"] and {x[2] for x in cut} == {"c"}
    odd = [(1, None), (2, ""), (3, " \t "), (4, "few words")]
    assert all(r["n_removed"] == 0 for r in substring_dedup.substring_report(spark, frame(spark, odd)).collect())


def test_more_words_than_letters(monkeypatch):
    passage = [b"%d" % i for i in range(1_200_000)]
    automaton = substring_dedup.PhraseAutomaton([((1, 0), 0, passage[:40]), ((1, 0), 100, passage)], 20)
    assert automaton.size == 2 and automaton.occurrences([b"x", *passage[1_100_000:1_100_030], b"y"], (2, 0), 0) == [(1, 30)]
    assert automaton.occurrences(passage[:40], (1, 0), 0) == []
    monkeypatch.setattr(substring_dedup.PhraseAutomaton, "LETTERS", 10)
    small = substring_dedup.PhraseAutomaton([((1, 0), 0, passage[:40])], 20)
    assert small.occurrences(passage[5:30], (2, 0), 0) == [(0, 25)] and small.occurrences(passage[30:50], (2, 0), 0) == []


def test_characters_of_private_use(spark):
    texts = ["".join(map(chr, range(0xE000, 0xE400))) + " a", "\ue000x\uf8ff", "plain"]
    library = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_decode(spark, frame(spark, list(enumerate(texts))), BYTE).collect()}
    assert got == {i: (library.encode(t, add_special_tokens=False).ids, t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_plain_texts_have_the_library_s_ids(path):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab cdE\n.,'s0129 éÀß-  ", k=rng.randint(0, 200))) for _ in range(1500)] + ["it's I'LL we've 12 34", " \n \n  x", "x" * 3000, "a  b   c    \n"]
    library = Tokenizer.from_file(path)
    encoder = chunks.library_encoder(open(path, encoding="utf-8").read(), path)
    assert encoder.plain is not None
    assert [x.tolist() for x in encoder.texts(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_more_than_sixteen_bits():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 1 << 20, n).astype("<u4") for n in (3, 0, 5000)] + [np.tile(np.arange(70_000, 70_050, dtype="<u4"), 200)]
    ids, got = token_store.unpack_segment(token_store.pack_segment([4, None, 6, 9], docs))
    assert ids == [4, None, 6, 9] and all((a == b).all() for a, b in zip(docs, got, strict=True))
    assert len(token_store.pack_segment([9], docs[3:])) < 4 * len(docs[3]) / 6  # what repeats is told by order 2
    with pytest.raises(ValueError, match="bits"):
        token_store.pack_segment([1], [np.array([1 << 20], "<u4")])
    assert token_store.unpack_segment(token_store.pack_segment([1], [np.empty(0, "<u4")]))[1][0].tolist() == []


def test_repeated_and_missing_ids_are_stored_one_by_one(spark):
    rows = [(2, "b"), (None, "n"), (1, "a"), (2, "b"), (2, "c c"), (3, None)]
    got = [tuple(r) for r in token_store.stored_tokens(spark, frame(spark, rows), BYTE).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, 1, 2, 2, 2, 3] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()


def test_two_hundred_thousand_addresses_in_one_text(spark):
    began = time.time()
    text = "a@b.co " * 200_000
    got = pii.pii_report(spark, frame(spark, [(1, text), (None, None), (1, "")])).collect()
    assert sorted((r["n_email"], len(r["spans"].split(","))) for r in got) == [(0, 1), (0, 1), (200_000, 200_000)]
    cut = {r["n_chars"] if "n_chars" in r else len(r["text"] or "") for r in pii.redact(spark, frame(spark, [(1, text)])).collect()}
    assert cut == {8 * 200_000} and time.time() - began < 240


def test_redaction_against_python(spark):
    rng = random.Random(10)
    signs = ["a@b.co", "1.2.3.4", "+1 (652) 555-5229", "4111 1111 1111 1111", " ", "é", "😀", "\n", "x" * 700, 'token = "' + "0af3" * 10 + '"']
    rows = [(i, "".join(rng.choices(signs, k=rng.randint(0, 12)))) for i in range(200)]
    df = frame(spark, rows)
    weights = pii.fit(df)
    spans = {r["doc_id"]: sorted((s["start"], -s["end"], s["kind"]) for s in r["spans"]) for r in pii.spans(df.select("doc_id", "text"), weights).collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark, df).collect()}
    for i, text in rows:
        out, at = [], 0
        for start, end, kind in spans[i]:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
                at = -end
        assert got[i] == "".join(out) + text[at:]


def test_scores_beyond_doubles(spark):
    big = [(0, [1e8, -1e8]), (50, [2e7, 1.0]), (3, [1e7, 2e7])]
    df = spark.createDataFrame([(i, v, "c") for i, v in big], "vec_id long, embedding array<double>, query string")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in big}
    exact = {(i, j): sum(a * b for a, b in zip(whole[i], whole[j], strict=True)) for i in whole for j in whole}
    assert max(map(abs, exact.values())) >= 2**63
    with pytest.raises(Exception, match="fit in a long"):
        topk_search.top_vectors(spark, df, 50, 1).collect()
    fits = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 0.996]), (2, [3e6, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk_search.top_vectors(spark, fits, 50, 2).orderBy("rank").collect()] == [(2, (768 * 10**6) ** 2 + 256 * 512), (1, (768 * 10**6) ** 2 + 256 * 254)]
    with pytest.raises(Exception, match="2\\*\\*53"):
        topk_search.top_vectors(spark, spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_repeated_vectors_are_candidates_of_each_other(spark):
    df = spark.createDataFrame([(50, [1.0, 2.0]), (50, [2.0, 1.0]), (1, [0.5, 0.5]), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_vectors(spark, df, 50, 5).collect())
    assert got == [(50, 1, 50, 4 * 65536), (50, 1, 50, 4 * 65536), (50, 2, 1, 98304), (50, 2, 1, 98304)]


def test_essential_segments_hold_all_that_can_win():
    rng = np.random.default_rng(11)
    x = np.floor(256 * rng.normal(size=(400, 6)) ** 3)
    x[:5] = 4000
    postings = topk_search.Postings(x)
    some = 0
    for q in x[:40]:
        scores = x @ q
        for threshold in np.sort(scores)[-8:]:
            found = postings.essential(q, float(threshold))
            if found is not None:
                some += len(found) < len(x)
                assert set(np.flatnonzero(scores >= threshold)) <= set(found.tolist())
    assert some > 0


def test_vectors_that_repeat_an_id_keep_their_rows(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], "c"), (5, None, "c"), (5, [1.0, 0.0], "c"), (6, [0.0, 1.0], "c"), (None, [1.0, 0.0], "c")], "vec_id long, embedding array<double>, block string")
    got = sorted(((r["vec_id"] or -1), r["n_links"]) for r in embed_dedup.near_vectors(spark, df).collect())
    assert got == [(-1, 0), (5, 0), (5, 1), (5, 1), (6, 0)]


@pytest.mark.parametrize("leaves", [1, 4, 16])
def test_every_block_finds_its_pairs_whatever_the_leaves(leaves):
    rng = np.random.default_rng(12)
    x = embed_dedup.units(rng.normal(size=(600, 16)))
    space = embed_dedup.Space(x, len(x), 0.8, 4, leaves)
    turned = x @ space.rotation
    for block, (a, b) in enumerate(space.sides()):
        part = turned[:, a:b]
        row, leaf, home = space.visits(block, part)
        where = {(r, f) for r, f in zip(row.tolist(), leaf.tolist(), strict=True)}
        own = dict(zip(row[home].tolist(), leaf[home].tolist(), strict=True))
        near = ((part[:, None] - part[None]) ** 2).sum(2) <= space.budgets[block]
        assert all((i, own[j]) in where or (j, own[i]) in where for i, j in np.argwhere(near))
        assert len(own) == len(x) and all(f >= own[r] for r, f in where)


def test_seventy_languages():
    names = [f"l{i:02}" for i in range(70)]
    codes = [np.arange(1000 * i, 1000 * i + 50, dtype=np.uint64) for i in range(70)]
    filters = language_id.Filters(names, codes)
    assert len(filters.masks) == 2
    for i in (0, 63, 64, 69):
        masks = [m[filters.slots(codes[i])[0]] & m[filters.slots(codes[i])[1]] for m in filters.masks]
        assert filters._bit(masks, i).all()
    assert filters.decide([None, "", "123"])[0] == ["und"] * 3


def test_a_lot_of_tiny_texts_is_packed_at_once():
    began = time.time()
    pieces = packing.pack_lot(np.ones(200_000, np.int64))
    used = np.bincount([p[3] for p in pieces], [p[2] for p in pieces])
    assert len(pieces) == 200_000 and used.max() <= 4096 and len(used) <= 51 and time.time() - began < 60


def test_odd_rows_of_scores_languages_and_packing(spark):
    rows = [(None, "x"), (1, None), (1, ""), (2, "ein wort " * 30_000)]
    df = frame(spark, rows)
    assert toxicity.score_texts(spark, df, toxicity.Lexicon({"wort ": 3.0})).count() == 4 and toxicity.drop_toxic(spark, df, toxicity.Lexicon({})).count() == 4
    assert language_id.predict(spark, df, None).select("lang_pred").distinct().first()[0] == "und"
    got = packing.pack(spark, df, WORD, keep_ids=False).groupBy("doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert len(got) == 3 and packing.pack(spark, df.where("false"), WORD).count() == 0
    empty = df.where("false")
    for out in (toxicity.score_texts(spark, empty, toxicity.Lexicon({})), language_id.predict(spark, empty, None), pii.pii_report(spark, empty), pii.redact(spark, empty), bpe.encode_decode(spark, empty, BYTE)):
        assert out.count() == 0
    assert zlib.crc32(b"") == 0


def test_plain_texts_are_cut_in_arrays_as_by_the_pattern():
    rng = random.Random(11)
    texts = ["".join(rng.choices(["a", "Z", "é", "×", "'", "'s", "'ll", "'re", "'v", " ", "  ", "\n", "1", ".", "ß"], k=rng.randint(1, 40))) for _ in range(20_000)] + ["'s", "x'", " 's", "\n't", "a''s", "'lle 'vé", " ", "\n \n"]
    joined = "\0".join(texts).encode("latin-1") + b"\0"
    at = np.flatnonzero(chunks.spaced_starts(joined)).tolist()
    got = [joined[a:b].decode("latin-1") for a, b in zip(at, [*at[1:], len(joined)])]
    assert got == [p for t in texts for p in [*chunks.SPACED_PIECES(t), "\0"]]


def test_a_full_table_of_words_changes_no_ids(monkeypatch):
    blob = open(BYTE, encoding="utf-8").read()
    monkeypatch.setattr(chunks, "SLOT_BITS", 6)  # 32 words
    monkeypatch.setattr(chunks, "_encoders", {})
    encoder, library, rng = chunks.library_encoder(blob, "small"), Tokenizer.from_file(BYTE), random.Random(12)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 12))) for _ in range(90)] + ["y" * 24, "y" * 23, "z" * 70, "ä" * 30]
    for _ in range(20):
        texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        assert [x.tolist() for x in encoder.texts(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < encoder.plain.spaced.count <= 32


def test_an_id_takes_little_of_a_cpu():
    """Tokenizing, coding and decoding, in seconds as the check tool counts them: 400 a GB are about 0.6 us an id."""
    blob, texts = open(BYTE, encoding="utf-8").read(), pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()
    encoder, best = chunks.library_encoder(blob, BYTE), 9.0
    for _ in range(3):
        began = time.thread_time()
        sum(range(500_000))
        slow, began = (time.thread_time() - began) * 100, time.thread_time()
        ids = np.concatenate([x for i in range(0, len(texts), 500) for x in encoder.texts(texts[i : i + 500])])[: token_store.SEGMENT]
        blocks, sums = token_store.encode_blocks(ids)
        assert (token_store.decode_blocks(blocks, len(ids), sums) == ids).all()
        best = min(best, (time.thread_time() - began) / slow / len(ids) * 1e6)
    assert best < 0.6, best
