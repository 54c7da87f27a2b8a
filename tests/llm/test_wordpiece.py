import random

import public_tokenizers

from gatehouse.llm import queries, wordpiece

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, first, later):
    pieces, at = 0, 0
    while at < len(word):
        entries = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in entries), None)
        if end is None:
            return 1
        pieces, at = pieces + 1, end
    return pieces


def test_automaton_against_greedy():
    rng = random.Random(1)
    for _ in range(60):
        entry = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
        first, later = ({entry() for _ in range(rng.randint(1, 12))} for _ in range(2))
        c = wordpiece.Counter(first, later)
        for _ in range(100):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            assert c.length(word) == greedy(word, first, later), (first, later, word)


def test_table(spark):
    first, later = wordpiece.load_vocabulary(PATH)
    rng = random.Random(2)
    texts = [None, "", " \t", "hello world", "Größe über naïve 東京🙂", "x" * 20_000, "don't stop-me now!", "a\x1cb c\x85d"]
    texts += [" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 12))) for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, n_tokens int")
    got = wordpiece.count_tokens(docs, PATH)
    assert got.columns == ["doc_id", "text", "n_words", "n_tokens"]
    for r in got.collect():
        words = (r.text or "").encode().split()
        assert r.n_words == len(words)
        assert r.n_tokens == sum(greedy(w, first, later) if len(w) < 1000 else wordpiece.counter(PATH).length(w) for w in words)
    assert wordpiece.count_tokens(docs.limit(0), PATH).collect() == []


def test_query_against_greedy(spark):
    first, later = wordpiece.load_vocabulary(PATH)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_token_counts(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_tokens"] and got.count() == len(texts)
    for r in got.collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w, first, later) for w in words))
