import random
import re

import corpus_pipeline
from gatehouse.llm import line_dedup

FILLED = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows, run):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    seen, out = set(), {}
    for i, text in order:
        if text is None:
            out[i, text] = (None, 0, 0)
            continue
        lines = text.split("\n")
        places = [n for n, x in enumerate(lines) if FILLED.search(x)]
        gone = set()
        for k in range(len(places) - run + 1):
            name = tuple(lines[p] for p in places[k : k + run])
            if name in seen:
                gone |= set(places[k : k + run])
            seen.add(name)
        out[i, text] = ("\n".join(x for n, x in enumerate(lines) if n not in gone), len(places), len(gone))
    return out


def test_against_plain_version(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(25)] + ["", "  ", "\t"]
    rows = [(0, None), (1, ""), (2, "a\nb\nc"), (3, "a\nb\nc"), (4, "x\n\na\n \nb\nc\ny\n"), (5, "r\n" * 12), (6, "p\nq\n" * 9), (None, "a\nb\nc\nd")]
    for i in range(7, 90):
        rows.append((i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))))
    block = "\n".join(pool[3:12])
    rows += [(i, f"own {i}\n{block}\nend {i}") for i in range(100, 130)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, (3, "a\nb\nc")]], "doc_id long, text string, key string").repartition(3)
    for run in (1, 3):
        got = line_dedup.delete_repeated_runs(docs, run)
        assert got.columns == ["doc_id", "text", "key", "kept_text", "n_lines", "n_deleted"]
        want = plain(rows, run)
        found = got.collect()
        assert len(found) == len(rows) + 1
        for r in found:
            assert (r.kept_text, r.n_lines, r.n_deleted) == want[r.doc_id, r.text], (run, r)


def test_empty_table(spark):
    assert line_dedup.delete_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_passages(rows, run, passage_words):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    seen, out = set(), {}
    for i, text in order:
        lines = (text or "").split("\n")
        places = [n for n, x in enumerate(lines) if FILLED.search(x)]
        gone = set()
        for size in range(1, run + 1):
            for k in range(len(places) - size + 1):
                name = tuple(lines[p] for p in places[k : k + size])
                if size < run and sum(len(re.findall(FILLED.pattern + "+", x)) for x in name) <= passage_words:
                    continue
                if name in seen:
                    gone |= set(places[k : k + size])
                seen.add(name)
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        out[i, text] = (None if text is None else kept, 0 if text is None else len(places), len(gone))
    return out


def test_short_passages_against_plain_version(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    pool = [words(n) for n in (2, 5, 9, 10, 11, 14, 30)] + ["a b", "", " \t"]
    rows = [(0, None), (1, ""), (2, pool[6]), (3, pool[6])]
    rows += [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else words(rng.randrange(1, 14)) for _ in range(rng.randrange(9)))) for i in range(4, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_passages(rows, 3, 10)
    for r in line_dedup.delete_repeated_runs(docs, passage_words=10).collect():
        assert (r.kept_text, r.n_lines, r.n_deleted) == want[r.doc_id, r.text]


def test_pipeline_drops_a_passage_of_one_or_two_lines(spark):
    line = " ".join(f"w{i}" for i in range(51))
    pair = "\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    texts = [f"own 0\n{line}\nend 0", f"own 1\n{line}\nend 1", line, f"own 3\n{pair}\nend 3", pair, "own 5\nshort\nend 5", "own 6\nshort\nend 6"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    want = [texts[0], "own 1\nend 1", "", texts[3], "", texts[5], texts[6]]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_ids_that_continue_in_the_text_do_not_clash(spark):
    block = "\n".join(f"l{i}" for i in range(5))
    docs = spark.createDataFrame([("1", "h|" + "\n" + block), ("1|h", "\n" + block)], "doc_id string, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup.delete_repeated_runs(docs).collect()}
    assert got == {"1": "h|\n" + block, "1|h": ""}


def test_a_very_long_text_and_a_hot_passage(spark):
    rng = random.Random(5)
    block = "\n".join(f"common {i}" for i in range(4))
    long = "\n".join(f"line {rng.randrange(10**9)}" for _ in range(60_000))
    rows = [(0, long), (1, "head\n" + long + "\ntail")] + [(i, f"own {i}\n{block}") for i in range(2, 600)]
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_deleted) for r in line_dedup.delete_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[0] == (long, 60_000, 0) and got[1] == ("head\ntail", 60_002, 60_000)
    assert got[2] == (rows[2][1], 5, 0) and all(got[i] == (f"own {i}", 5, 4) for i in range(3, 600))
