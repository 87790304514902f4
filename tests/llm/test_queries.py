"""The registered queries on the smallest tables, each against brute force, the library or SQL."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tessella.llm import language_id, queries, toxicity

DATA = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs():
    return sorted(pq.read_table(f"{DATA}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def vectors():
    return pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()


def components(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def similar(sets, percent):
    """Links by all pairs that share a shingle."""
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for own in by.values() for a in own for b in own if a < b}
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_op1(spark, docs):
    sets = {r["doc_id"]: shingles(r["text"], 4) for r in docs}
    want = components(similar(sets, 85), sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_jaccard_join(spark, DATA).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()} and len(set(want.values())) < len(want)


def test_op2(spark, docs):
    library = Tokenizer.from_file(BYTE)
    library.no_padding()
    library.no_truncation()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op2_bpe_round_trip(spark, DATA).collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}


def test_op3(spark, docs):
    library = Tokenizer.from_file(BYTE)
    want, start = {}, 0
    for r in docs:
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:4] for r in queries.op3_token_store(spark, DATA).collect()} == want


def test_op4(spark, vectors):
    x = np.array([r["embedding"] for r in vectors], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    ids = [r["vec_id"] for r in vectors]
    want = components([(ids[a], ids[b]) for a, b in np.argwhere(near) if a < b], ids)
    got = {r["vec_id"]: tuple(r)[1:4] for r in queries.op4_embedding_near_dedup(spark, DATA).collect()}
    assert got == {i: (int(n), want[i], want[i] == i) for i, n in zip(ids, near.sum(1), strict=True)}


def test_op5_adds_what_the_patterns_leave_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, sf).collect()}
    tokens = {r["doc_id"]: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"] or "")] for r in docs}
    assert sum(map(len, tokens.values())) > 0
    for i, spans in tokens.items():
        told = got[i]["spans"].split(",")
        assert all(f"secret:{a}:{b}" in told for a, b in spans) and got[i]["n_added"] >= len(spans)
    mails = {r["doc_id"]: len(re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r["text"] or "")) for r in docs}
    assert {i: r["n_email"] for i, r in got.items()} == mails
    plain = [r for r in docs if not tokens[r["doc_id"]]]
    assert sum(got[r["doc_id"]]["n_added"] for r in plain) <= 0.02 * len(plain)


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
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def test_op6(spark, docs):
    want = {r["doc_id"]: (n, k, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for r, (n, k, kept) in zip(docs, removed([r["text"] for r in docs], 20), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:4] for r in queries.op6_substring_dedup(spark, DATA).collect()} == want


def fold_of(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_op7_scores_by_the_lexicon_of_the_other_folds(spark, docs):
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, DATA).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {r["doc_id"]: fold_of(r["doc_id"], 3) == 1 for r in docs}
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("pmod(crc32(cast(doc_id AS string)), 3) <> 1")
    lexicon = toxicity.learn(spark, table, labels)

    def score(text):  # word by word, without an automaton
        words = toxicity.fold(text).split()
        single, twice = 0.0, {}
        for w in words:
            heads = [(w + " ")[:n] for n in range(1, len(w) + 2)]
            single += max((lexicon.weights[h] for h in heads if h in lexicon.weights), default=0.0)
            for h in heads:
                if toxicity.TWICE + h in lexicon.weights:
                    twice.setdefault(h, set()).add(w)
        total = single + sum(lexicon.weights[toxicity.TWICE + h] for h, w in twice.items() if len(w) > 1)
        return lexicon.score(total / (1 + np.log1p(len(words) / toxicity.LENGTH)) if total else 0.0)

    plain = [r for r in docs if not any(p in toxicity.fold(r["text"]) for p in toxicity.EXCEPTIONS)]
    assert all(got[r["doc_id"]]["score"] == pytest.approx(score(r["text"])) for r in plain)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_op7_finds_toxic_documents_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    told = [(labels[r["doc_id"]], r["predicted"]) for r in queries.op7_toxicity(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    clean = [p for y, p in told if not y]
    assert sum(p for y, p in told if y) >= 0.5 * sum(y for y, _ in told) and sum(clean) <= 0.02 * len(clean)


def test_op8(spark):
    duck = duckdb.connect()
    for f in Path(DATA).iterdir():
        duck.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = sorted(duck.sql(queries.oracle_sql()["op8_exact_top_k"]).fetchall())
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in queries.op8_exact_top_k(spark, DATA).collect()) == want


def test_op9_by_the_shares_of_known_ngrams(spark, docs):
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, DATA).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {r["doc_id"]: fold_of(r["doc_id"], 5) == 0 for r in docs}
    table = spark.read.parquet(f"{DATA}/documents.parquet").where("pmod(crc32(cast(doc_id AS string)), 5) <> 0")
    filters = language_id.learn(spark, table)
    for r in docs[:60]:  # n-gram by n-gram, each slot looked up by itself
        codes, _, has = language_id.ngrams([r["text"]])
        if not has[0]:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        shares = []
        for b in range(len(filters.languages)):
            hits = sum(all(int(filters.masks[b // 64][s[i]]) >> b % 64 & 1 for s in filters.slots(codes)) for i in range(len(codes)))
            shares.append((hits - len(codes) * filters.false[b]) / (1 - filters.false[b]) / max(1, len(codes)))
        assert got[r["doc_id"]]["lang_pred"] == filters.languages[int(np.argmax(shares))]
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in docs if r["lang"] and fold_of(r["doc_id"], 5) == 0 and got[r["doc_id"]]["lang_pred"] != "und"]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op10(spark, docs):
    library = Tokenizer.from_file(WORD)
    ids = {r["doc_id"]: np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in docs}
    rows = queries.op10_packing(spark, DATA).collect()
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own, told in ((pieces, lambda i: len(ids[i])), (sequences, lambda s: None)):
        for name, parts in own.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == told(name) if told(name) else at <= 4096
    assert len(pieces) == len(ids)
    total = sum(map(len, ids.values()))
    assert total / (4096 * len(sequences)) > 0.9
