import re
from collections import Counter

from tracequill.llm import hostrules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_measures_equal_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in hostrules.op8_host_rules(spark, sf_dir).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_edge_cases():
    for text in ("", " \n\t", "a\na\n\na", "#" * 9, "é\x0b\x1c x\xa0y", "w " * 50_000, "a b c d e f g h a b c d e f g h", "a b c d e f g h " * 2 + "x", "\n".join(["l m"] * 5)):
        got = hostrules.measure(text.encode())
        assert (*got[:3], *got[4:]) == plain(text), text[:20]


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(40))


def test_hosts_are_shrunk_and_joined_on_any_path(spark):
    rows = [(i, good(i), "fine", "x") for i in range(60)] + [(100 + i, "bad", "poor", "x") for i in range(40)] + [(200, good(1), "poor", "x"), (300, "bad", "single", "x"), (301, None, None, "x"), (302, good(2), None, "x"), (302, good(2), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host_ok string")
    for bound in (50_000, 0):
        kept = sorted(r.doc_id for r in hostrules.judged(docs, max_broadcast=bound).filter("kept").collect())
        assert kept == sorted([*range(60), 302, 302])
        assert sorted(r.doc_id for r in hostrules.filtered(docs, max_broadcast=bound).collect()) == kept
    rate = {r.host: r.base_rate for r in hostrules.host_verdicts(hostrules.document_measures(docs)).collect()}
    assert 0 < rate["fine"] < 0.2 and 0.6 < rate["poor"] < 40 / 41 and rate["single"] < 1
    assert hostrules.judged(docs.limit(0)).count() == 0 and hostrules.filtered(docs.limit(0)).columns == docs.columns


def test_flagged_hosts_lose_their_soft_failures(spark):
    loud = lambda i: good(i) + " ###### $$$$$$"
    rows = [(k * 100 + i, loud(i) if i < (30 if k == 0 else 1) else good(i), f"h{k}") for k in range(8) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in hostrules.judged(docs).collect()}
    assert {r.host for r in found.values() if r.host_flagged} == {"h0"}
    assert {i for i, r in found.items() if not r.kept} == set(range(30))
    assert {r.doc_id for r in hostrules.filtered(docs).collect()} == {i for i, r in found.items() if r.kept}


def test_the_verdict_decides_on_the_driver_table(spark):
    rows = hostrules.op8_host_rules(spark, "/root/testdata/sf0.01").collect()
    assert any(r.host_flagged for r in rows) and not all(r.host_flagged for r in rows)
    print(sum(not r.base_failed and not r.kept for r in rows))
