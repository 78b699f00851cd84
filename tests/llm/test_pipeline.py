import base64
import hashlib
import os
import re
import sys
from collections import Counter

import public_tokenizers as P
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))
from test_pii import plain_base  # noqa: E402

import corpus_pipeline  # noqa: E402
from tracequill.llm import hostrules, pii  # noqa: E402


def plain_rejected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(words) < 20 or 100 * len(hit) > 30 * len(words)


def plain_soft(text):
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return 100 * symbols > 10 * len(re.findall(r"[^\x20\x09-\x0D]+", text)) or len(lines) >= 5 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines)


def plain_masked(text):
    out, at = [], 0
    for s, k, e in plain_base(text):
        if s >= at:
            out += [text[at:s], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    hosts = {r.host: (r.host_ok, r.host_flagged) for r in hostrules.host_verdicts(hostrules.document_measures(docs)).collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = {i for i, r in rows.items() if not plain_rejected(r.text) and hosts[r.source][0] and not (hosts[r.source][1] and plain_soft(r.text))}
    assert any(flagged for _, flagged in hosts.values())
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == want and all(got[i] == rows[i] for i in got)

    unique = stages["simhash near-dedup"](spark, kept, sf_dir)
    got = {r.doc_id: r for r in unique.collect()}
    assert set(got) == plain_kept({i: rows[i].text for i in want}) and all(got[i] == rows[i] for i in got)

    masked = stages["pii"](spark, unique, sf_dir)
    after = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == docs.columns and set(after) == set(got)
    for i, r in after.items():
        plain = plain_masked(rows[i].text)
        assert r.n_chars == len(r.text)
        assert re.sub(r"\[(SECRET|NAME|IBAN|NATIONAL_ID)\]", "", r.text) == plain or "[SECRET]" in r.text or "[IP]" in r.text or "[CARD]" in r.text
        assert not plain_base(r.text)

    mixed = stages["mixing"](spark, masked, sf_dir)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) == set(after) and max(copies.values()) <= 3

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in tokens) == copies
    for r in tokens:
        ids = library.encode_ordinary(after[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def plain_kept(texts):
    """Smallest doc_ids of the classes of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in texts if find(i) == i}


def test_odd_rows_pass_through(spark, sf_dir):
    text = "one two three four five six seven eight nine ten " * 1 + " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, None, None, 5, "x"), (2, text, "en", "s", 5, "x"), (2, text, "en", "s", 5, "x"), (None, text + " q " * 9, "en", "s", None, "x"), (3, None, None, "s", None, None), (4, "", "en", "s", 0, "y")]
    rows += [(i, " ".join(f"{i}x{k}" for k in range(60)), "en", None, 5, "x") for i in (5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf_dir)
            if name != "bpe":
                assert at.columns == docs.columns
        found = at.collect()
        ids = Counter(r.doc_id for r in found)
        assert not found if empty else set(ids) == {1, 5, 6, 7}  # the null one shares exactly 4 of 5 shingles


def test_no_row_is_lost_or_doubled(spark, sf_dir):
    """Each stage on rows that share ids, texts or both: what stays is a multiset of whole input rows."""
    prose = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, prose("a"), "en", "s"), (1, prose("a"), "fr", "s"), (1, prose("b"), "en", "s"), (1, prose("b"), "en", "s"), (None, prose("c"), None, None), (2, prose("c"), "en", "t"), (3, "short", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stages = dict(corpus_pipeline.STAGES)
    kept = Counter(tuple(r) for r in stages["quality rules"](spark, docs, sf_dir).collect())
    assert kept == Counter(rows[:6])
    unique = Counter(tuple(r) for r in stages["simhash near-dedup"](spark, docs, sf_dir).collect())
    assert sum(unique.values()) == 4 and set(unique) <= set(rows) and rows[5] in unique and rows[6] in unique and rows[4] not in unique
    assert Counter(t for _, t, _, _ in unique) == Counter([prose("a"), prose("b"), prose("c"), "short"])
    mixed = Counter(tuple(r) for r in stages["mixing"](spark, docs, sf_dir).collect())
    assert set(mixed) == set(rows) and all(mixed[r] >= n for r, n in Counter(rows).items())
    assert stages["bpe"](spark, docs, sf_dir).count() == len(rows)
