"""op1, op3, op7, op9, op10 and the pipeline against brute force, and on odd input."""
import collections
import random
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from llm_helpers import base_spans, crc, near_groups, token_ids

from jobledger.llm import line_dedup, ngram_join, packing, pieces, pii, queries

SF = "/root/testdata/sf0.001"


# --- op1

def test_line_dedup_equals_sql(spark, tmp_path):
    rows = []
    for host, pages in (("a", 40), ("b", 4), (None, 30), ("", 10)):
        for k in range(pages):
            lines = [f"own line {host} {k}", " menu ", "", "footer" if k % 3 else "other", f"rare {k % 20}"]
            rows.append((len(rows), "\n".join(lines), host))
    rows += [(1000 + k, "menu\nonly copies\nfooter", "a") for k in range(30)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "menu\nfooter", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_line_dedup(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.OP1_SQL).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[2000] is None and text[2002] == "" and "own line b 0" in text[40] and " menu " in text[40]
    assert text[1000] == "only copies"  # copies of a page are no boilerplate of themselves


def test_line_dedup_odd_input(odd, empty):
    got = line_dedup.dedup(odd)
    assert got.columns == [*odd.columns, "n_dropped"]
    assert sorted(map(str, got.drop("n_dropped").collect())) == sorted(map(str, odd.collect()))
    assert line_dedup.dedup(empty).count() == 0


# --- op3

@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 100), (2, 50)])
def test_ngram_join_equals_brute_force(spark, words, percent, monkeypatch):
    rng = random.Random(percent)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 5, 12, 40, 150]))] for _ in range(25)]
    docs = []
    for k in range(220):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            x[rng.randrange(len(x))] = f"w{rng.randrange(400)}"
        docs.append((k, rng.choice([" ", "\n", "  "]).join(x).upper() if k % 7 == 0 else " ".join(x)))
    docs += [(300, None), (301, ""), (302, " \t")]
    # small packs, so that shards meet across tasks and hot runs are sent as rows
    monkeypatch.setattr(ngram_join, "PACK_KEYS", 300)
    monkeypatch.setattr(ngram_join, "HOT_RUN", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.join(df, words=words, percent=percent).collect()), key=str)
    assert got == near_groups(docs, words, percent)


def test_a_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """2,000 near copies of one text, linked through it, and 400 that almost link: pairs stay next to the documents."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(150)]
    docs = [(0, " ".join(base))]
    for k in range(1, 2401):
        x = list(base)
        for _ in range(1 if k <= 2000 else 9):
            x[rng.randrange(len(x))] = f"own{k}"
        docs.append((k, " ".join(x)))
    made, rest = [], ngram_join.rest
    monkeypatch.setattr(ngram_join, "rest", lambda *a: made.append(ngram_join.written(rest(*a), "pairs")) or made[-1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()}
    assert all(got[k] == 0 for k in range(2001))
    assert made[0].count() < len(docs)


def test_tree_join_keeps_every_pair_within_the_bounds():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(12)]
    sets += [np.unique(np.concatenate([s[: rng.integers(40, 61)], rng.integers(0, 2**63, 5).astype(np.uint64)])) for s in sets * 5]
    points = np.stack([ngram_join.widened(ngram_join.narrow(ngram_join.point(s, ngram_join.FINE))) for s in sets])
    n, label = np.array(list(map(len, sets))), np.arange(len(sets)) % 7
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        got = {tuple(sorted(p)) for p in ngram_join.tree_join(n, label, points, side, 80).tolist()}
        for a in range(len(sets)):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if 100 * shared >= 80 * (n[a] + n[b] - shared) and label[a] != label[b] and (side[a] != side[b] or not side.any()):
                    assert (b, a) in got


def test_ngram_join_on_documents(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(map(tuple, ngram_join.join(documents).collect()), key=str)
    assert got == near_groups(docs, 3, 90)
    assert any(i != c for i, _, c in got)


def test_ngram_join_odd_input(odd, empty):
    got = collections.Counter(map(tuple, ngram_join.join(odd).collect()))
    assert got[(None, 3, None)] == 1 and got[(1, 0, 1)] == 1 and got[(0, 3, 0)] == 2
    assert got[(8, 1, 7)] == 1 and got[(6, 1, 6)] == 1
    assert sum(n for (i, _, c), n in got.items() if i == 4 and c == 3) == 1
    assert ngram_join.join(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, ngram_join.components(links).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# --- op7

ODD_PII = ["a@b.c_d@e.f x@y.zz.", "1.2.3.4.5.6.7.8 256.1.1.1 010.020.030.040 1.2.3", "9" * 20_000 + " 1" + ".1" * 500,
           "4111 1111 1111 1111-4111-1111", "é +1 (578) 555-6437 ñ a.b@c.d", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
           "a" * 20_000 + "@", "a@b-.c.d-", "@@a@b.co", "", " ", None, "é漢😀 x@y.z", "x@y.z\n+49 (30) 1234567 8\n4111-1111-1111-1111"]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_pii_base_spans(spark, documents):
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD_PII)], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in pii.spans(both).collect():
        found = base_spans(texts[r["doc_id"]])
        kinds = collections.Counter(k for *_, k in found)
        assert r["base"] == listed(found)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))


def test_pii_disclosing_terms(spark):
    rows = [(i, f"intro {i}\nZorbia asks anna@x.org often {i}, says zorbia") for i in range(5)]
    rows += [(10 + i, f"often he asks, it says: line {i}") for i in range(200)]
    rows += [(None, "Zorbia asks anna@x.org often 77")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", pii.F.lit("clash"))
    found = {r["doc_id"]: r for r in pii.spans(df).collect()}
    assert found[3]["spans"] == "term:8:14,email:20:30,term:45:51"  # says/asks/often occur elsewhere, too
    assert found[None]["spans"] == "term:0:6,email:12:22"
    assert found[11]["spans"] == ""
    clean = {r["doc_id"]: r for r in pii.sanitize(df).collect()}
    assert clean[3]["text"] == "intro 3\n asks [EMAIL] often 3, says " and clean[3]["base"] == "clash"
    assert clean[11]["text"] == rows[6][1]


def test_pii_disclosing_terms_are_marked_on_lines_without_the_value(spark):
    rows = [(i, f"intro {i}\nZorbia asks anna@x.org often {i}") for i in range(8)]
    rows += [(10 + i, f"often he asks, it says: line {i}") for i in range(200)]
    rows += [(300, "no value\nbut ZORBIA, and zorbia@y.org"), (None, "Zorbia"), (None, "Zorbia"), (301, "zorbias")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["spans"]) for r in pii.spans(df).collect()}
    assert {(3, "term:8:14,email:20:30"), (300, "term:13:19,email:25:37"), (None, "term:0:6"), (301, ""), (11, "")} <= found
    clean = [r["text"] for r in pii.sanitize(df).collect() if r["doc_id"] in (None, 300, 301)]
    assert sorted(clean) == ["", "", "no value\nbut , and [EMAIL]", "zorbias"]


def test_pii_odd_input(odd, empty):
    got = pii.sanitize(odd)
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert pii.spans(empty).count() == 0


# --- op9

def check_packing(docs, got, seq_len=2048):
    want = collections.Counter()
    for i, text in docs:
        want[(i, tuple(token_ids(text)))] += 1
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for (i, ids), times in want.items():
        mine = [r for r in by_doc[i] if r["doc_tokens"] == len(ids)]
        pieces_ = collections.Counter((r["start"], r["length"], r["ids_crc32"]) for r in mine)
        cuts = [(s, min(seq_len, len(ids) - s), crc(ids[s: s + seq_len])) for s in range(0, len(ids), seq_len)]
        assert all(pieces_[c] >= times for c in cuts)
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(seqs)


def test_packing(documents, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = packing.pack(documents).collect()
    n = check_packing(docs, got)
    assert sum(r["length"] for r in got) / (2048 * n) > 0.97
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], packing.pack(odd).collect())
    assert packing.pack(empty).count() == 0


def test_shortest_pack_first():
    rng = random.Random(4)
    histogram = collections.Counter(rng.randint(1, 100) for _ in range(5000))
    patterns = packing.pack_histogram(histogram, 100)
    used = collections.Counter()
    for times, held in patterns:
        assert 0 < sum(length * n for length, n in held) <= 100
        for length, n in held:
            used[length] += times * n
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert total / (100 * sum(t for t, _ in patterns)) > 0.99


def test_chunked_encoding_equals_the_tokenizer():
    encoder = packing.Encoder(packing.byte_bpe(packing.default_ranks(), packing.default_tokenizer()))
    texts = ["a  b\t c \n", "  x", "x ", "a   b", "été 　x  y", "", " ", "\n\n a", "a \n b", "it's  'll x", "<|endoftext|> a", "a <|endoftext|> b",
             "<|endoftext|><|endoftext|>", "x<|endoftext|>", "<|endoftext", "a  <|endoftext|>\n b",
             " é", "a \x85b", "a \x1cb", "a b\n c", "a\n\n\nb c"]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert ids.tolist() == token_ids(text)[:-1]


# --- op10

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.default_model())


def brute_segment(v, word):
    @lru_cache(None)
    def best(j):
        if not j:
            return 0.0, ()
        top = (best(j - 1)[0] + v.unknown, 0)
        for a in range(j):
            if (piece := v.pieces.get(word[a:j])) is not None:
                top = max(top, (best(a)[0] + piece[1], j - a))
        if not top[1]:
            return top[0], best(j - 1)[1] + tuple(v.byte_ids[b] for b in word[j - 1].encode())
        return top[0], best(j - top[1])[1] + (v.pieces[word[j - top[1]: j]][0],)
    return list(best(len(word))[1])


def test_shared_prefix_viterbi_equals_brute_force(vocabulary):
    rng = random.Random(1)
    words = sorted({" " * rng.randint(0, 4) + "".join(rng.choice("abtheinr\né漢▁") for _ in range(rng.randint(1, 9))) for _ in range(1500)})
    assert list(vocabulary.segment(words)) == [brute_segment(vocabulary, w) for w in words]


def test_ids_equal_the_library_on_a_unigram_copy(vocabulary, documents):
    """The library's own Viterbi over the same pieces with the same scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    by_id = dict(vocabulary.pieces.values())
    for i, piece in enumerate(model.pieces):
        if i in by_id:
            piece.score = by_id[i]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder = pieces.Encoder(vocabulary)
    texts = [r["text"] for r in documents.collect() if r["text"] and len(r["text"]) < 5000]
    texts += ["Hello world", " two  blanks   three ", "tabs\tand\nlines\n\n", "漢字 \U0001F600\U0001F600 é", "a" * 300, "x=1;  y = 2"]
    assert len(texts) > 100
    for text in texts:
        assert encoder.encode([text])[1].tolist() == library.encode(text), text
    assert [library.id_to_piece(i) for i in encoder.encode(["Hello world"])[1].tolist()] == ["▁Hello", "▁world"]


def test_pieces_round_trip(documents, odd, empty, vocabulary):
    for df in (documents, odd):
        want = sorted(str((r["doc_id"], r["text"] or "")) for r in df.select("doc_id", "text").collect())
        got = pieces.decode(pieces.encode(df)).collect()
        assert sorted(str((r["doc_id"], r["text"])) for r in got) == want
    encoder = pieces.Encoder(vocabulary)
    for text in ["", " ", "  a", "a▁b", "x\x00y", "漢字 é ", "▁", "a ▁"]:
        assert vocabulary.decode(encoder.encode([text])[1].tolist()) == text
    assert pieces.encode(empty).count() == 0
