"""Golden cases of parsers, text functions, segmentation and evidence operators."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from tracequill.functions import text as T
from tracequill.operators import evidence as E
from tracequill.operators import segments as S
from tracequill.sources import parse
from tracequill.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def units(spark, texts, **more):
    rows = [(1, i + 1, f"P{i + 1:06d}", t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "case_id long, pos int, id string, text string" + "".join(f", {k} {'long' if k.endswith('ms') else 'string'}" for k in more))


def test_timestamps(spark):
    for text in ("01:02:03,456", "62:03.456"):
        assert one(spark, T.parse_timestamp(F.lit(text))) == 3_723_456
    assert one(spark, T.format_timestamp(F.lit(3_723_456))) == "01:02:03.456"
    assert one(spark, T.format_timestamp(F.lit(360_000_000), False)) == "100:00:00"
    assert one(spark, T.parse_timestamp(F.lit("x:1"))) is None and one(spark, T.parse_timestamp(F.lit("7"))) is None


def test_normalize_decodes_in_order(spark):
    assert one(spark, T.normalize_text(F.lit(" <b>x</b>&nbsp; y &amp;lt; z　"))) == "x y < z"
    assert one(spark, T.normalized_claim(F.lit("A, b! “C”"))) == "abc"
    assert one(spark, T.bigrams(F.lit("a𐐨ba𐐨!"))) == ["a𐐨", "𐐨b", "ba"]
    assert one(spark, T.bigrams(F.lit(""))) == [] and one(spark, T.bigrams(F.lit("ab"))) == ["ab"]
    assert one(spark, T.jaccard(T.bigrams(F.lit("")), T.bigrams(F.lit("abc")))) == 0.0


def test_targets(spark):
    for density, chars, reader, brief in ((0, 40_000, 12_000, 3_000), (20, 100_000, 18_000, 8_000), (10, 5_000, 5_000, 5_500)):
        found = T.adaptive_targets(F.lit(density), F.lit(chars))
        assert (one(spark, found["reader_target"]), one(spark, found["brief_target"])) == (reader, brief)


def test_dates(spark):
    for text, full, month in (("2024-02-29", True, True), ("2023-02-29", False, False), ("2024-13", False, False), ("2024-12", False, True), (None, False, False)):
        assert one(spark, T.valid_date(F.lit(text))) is full and one(spark, T.valid_date(F.lit(text), True)) is month


def test_subtitles(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:03,000\r\n<b>x</b>   y\r\n\r\n2\r\n00:00:04,000 --> 00:00:05,000\r\nz\r\n\r\n3\r\n00:00:06,000 --> 00:00:07,000\r\n<i></i>"
    vtt = "WEBVTT kind\n\nNOTE a --> b\nskip\n\n01:00.000 --> 02:00.000 align:left\nhi"
    got = parse.parse_sources(spark.createDataFrame([("s", "srt", srt), ("v", "vtt", vtt)], "case_id string, format string, text string")).orderBy("case_id", "pos").collect()
    assert [(r.case_id, r.id, r.text, r.start_ms) for r in got] == [("s", "C000001", "x y", 1000), ("s", "C000002", "z", 4000), ("v", "C000001", "hi", 60_000)]
    with pytest.raises(Exception, match="unsupported source format"):
        parse.parse_sources(spark.createDataFrame([("x", "pdf", "t")], "case_id string, format string, text string")).collect()


def test_articles_and_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("lead\n\n# One\nfirst\n\n## Two\nsecond\nline\n\n \n# Three\n")
    rows = parse.read_sources(spark, str(tmp_path)).withColumn("case_id", F.lit("a"))
    got = parse.parse_sources(rows).orderBy("pos").collect()
    assert [(r.heading, r.text, r.id) for r in got] == [("Body", "lead", "P000001"), ("One", "first", "P000002"), ("Two", "second line", "P000003")]
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.width, r.height) for r in parse.png_size(files).collect()] == [(640, 480)]


def test_exclusions_and_promotions(spark):
    got = S.exclusions(units(spark, ["Hello!", "content", "content", "subscribe to the channel", "content", "[music]", "", "the subscribe button matters for business and " * 4])).orderBy("pos").collect()
    assert [r.kind for r in got] == ["greeting", None, "duplicate", "advertisement", "duplicate", "noise", "noise", None]


def test_segments_break_by_size_gap_and_heading(spark):
    assert [r.segment for r in S.segmented(units(spark, ["x"] * 100)).orderBy("pos").collect()] == [1] * 48 + [2] * 48 + [3] * 4
    long = "a" * 700
    assert [r.segment for r in S.segmented(units(spark, [long + "!", "b", long, "c", long, "d"])).orderBy("pos").collect()] == [1, 2, 2, 2, 2, 3]
    timed = units(spark, ["a", "b", "c"], start_ms=[0, 9000, 19_001], end_ms=[1000, 11_000, 20_000])
    assert [r.segment for r in S.segmented(timed).orderBy("pos").collect()] == [1, 1, 2]
    assert [r.segment for r in S.segmented(units(spark, ["a", "b", "c"], heading=["x", "x", "y"])).orderBy("pos").collect()] == [1, 1, 2]


def plain_segments(rows, maximum=1200, preferred=650, most=48, gap=8000):
    out, current, k = [], [], 1
    for row in rows:
        if current:
            size, last = sum(len("".join(x[0].split())) for x in current), current[-1]
            late = row[1] - last[2] > gap
            if len(current) >= most or size >= maximum or late or size >= preferred and last[0][-1:] in "。！？!?" and last[0] or last[3] and row[3] and last[3] != row[3]:
                current, k = [], k + 1
        current.append(row)
        out.append(k)
    return out


def test_segments_of_a_long_case_equal_the_greedy_loop(spark):
    """Sizes, sentence ends, headings and time gaps in one case of 20,000 units, and small ones."""
    rng = random.Random(3)
    for n, options in ((20_000, {}), (1, {}), (300, {"maximum": 40, "preferred": 15, "most_units": 4})):
        rows, at = [], 0
        for _ in range(n):
            at += rng.choice([0, 100, 7_999, 8_000, 8_001]) if rng.random() < 0.05 else 10
            text = rng.choice(["", "a b", "word " * 8, "long " * 60, "x" * 700]) + rng.choice(["", "!", "。", "."])
            rows.append((text, at, at + 5, rng.choice(["H", "H", "H", "J", ""]) if rng.random() < 0.02 else rows[-1][3] if rows else "H"))
            at += 5
        df = spark.createDataFrame([(1, i, *r, "kept") for i, r in enumerate(rows)], "case_id long, pos int, text string, start_ms long, end_ms long, heading string, other string")
        got = sorted((r.pos, r.segment, r.text, r.other) for r in S.segmented(df, **options).collect())
        names = {"maximum": "maximum", "preferred": "preferred", "most_units": "most"}
        want = plain_segments(rows, **{names[k]: v for k, v in options.items()})
        assert got == [(i, k, r[0], "kept") for i, (k, r) in enumerate(zip(want, rows, strict=True))]


def test_contiguity_and_ranges(spark):
    spans = spark.createDataFrame([(1, "a", 0, 3), (1, "a", 1, 4), (1, "b", 0, 3), (1, "b", 1, 5), (1, "c", 0, None), (1, "d", 0, 4), (1, "d", 1, 3)], "case_id long, span_id string, ord int, pos int")
    assert {r.span_id: r.contiguous for r in S.contiguous(spans).collect()} == {"a": True, "b": False, "c": False, "d": False}
    refs = spark.createDataFrame([(1, i, r) for i, r in enumerate(["E0001", "E0002", "E0003", "E0001", "X7", "E0009", "odd"])], "key long, ord int, ref string")
    assert S.compact_ranges(refs).first().ranges == ["E0001–E0003", "X7", "E0009", "odd"]


def test_near_duplicates_flag_the_later(spark):
    claims = spark.createDataFrame([(1, 1, "E1", "The model was trained on data."), (1, 2, "E2", "the model was trained on data!"), (1, 3, "E3", "Another thing"), (2, 4, "E4", "Another thing"), (1, 5, "E5", "")], "case_id long, pos long, id string, statement string")
    assert [r.id for r in E.near_duplicates(claims).collect()] == ["E2"]
    assert {r.id: r.kept_id for r in E.greedy_merge(claims).collect()} == {"E1": "E1", "E2": "E1", "E3": "E3", "E4": "E4", "E5": "E5"}


def test_profile_decisions(spark):
    rows = [(1, "a", 0.81), (1, "b", 0.60), (2, "a", 0.81), (2, "b", 0.70), (3, "a", 0.70), (3, "b", 0.40), (4, "b", 0.9)]
    got = {r.case_id: r for r in E.profile_decision(spark.createDataFrame(rows, "case_id long, profile string, score double")).collect()}
    assert [(got[i].primary, got[i].pending) for i in (1, 2, 3, 4)] == [("a", False), (None, True), (None, True), ("b", False)]


def test_consensus(spark):
    schema = "case_id long, evidence_ref string, importance string, theme_id string, role string, verdict string, confidence double, issue_type string, blocks array<string>"
    make = lambda ref, role, verdict, conf=0.9, blocks=("B1",): (1, ref, "high", "T1", role, verdict, conf, "none", list(blocks))
    rows = [make("a", "A", "covered"), make("a", "B", "covered"), make("b", "A", "missing", 0.1), make("b", "B", "missing"), make("c", "A", "covered"), make("c", "B", "partial"), make("d", "A", "covered"), make("d", "B", "covered", 0.5, ("B2",)), make("e", "A", "covered")]
    pairs = E.consensus_pairs(spark.createDataFrame(rows, schema))
    assert {r.evidence_ref: r.triggers for r in pairs.collect()} == {"a": [], "b": [], "c": ["verdict_conflict"], "d": ["block_conflict", "low_confidence"], "e": ["verdict_conflict", "low_confidence"]}
    rulings = spark.createDataFrame([(1, "c", "covered")], "case_id long, evidence_ref string, verdict string")
    assert {r.evidence_ref: r.verdict for r in E.coverage_consensus(pairs, rulings).collect()} == {"a": "covered", "b": "missing", "c": "covered", "d": "unresolved", "e": "unresolved"}


def test_page_breaks_stay_within_the_maximum(spark):
    pages = spark.createDataFrame([(1, 10_000, [900, 2100, 2900, 5200, 5300, 8900]), (2, 10, [5])], "page_id long, height int, breaks array<int>")
    got = {r.page_id: r.boundaries for r in E.page_breaks(pages, 2400, 3000).collect()}
    assert got == {1: [0, 2100, 2900, 5300, 8300, 10_000], 2: [0, 10]}


def test_quote_repair_is_stable(spark):
    spans = spark.createDataFrame([(1, "a", 0, 1, None), (1, "a", 1, 2, None), (1, "b", 0, 1, "kept"), (1, "c", 0, 1, None), (1, "c", 1, 3, None)], "case_id long, span_id string, ord int, pos int, quote string")
    got = {r.span_id: (r.action, r.quote) for r in E.quote_repair(spans, units(spark, ["one", "two", "three"])).collect()}
    assert got == {"a": ("filled", "one two"), "b": ("kept", "kept"), "c": ("refused", None)}


def test_sessions_stream_like_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:08"), (1, "2024-01-01 00:00:17"), (2, "2024-01-01 00:00:00"), (9, "2024-01-02 00:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = sorted((r.user_id, r.events) for r in sessions.sessionized(rows).collect())
    assert batch == [(1, 1), (1, 2), (2, 1), (9, 1)]
    stream = sessions.sessionized(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), watermark="1 minute")
    done = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted((r.user_id, r.events) for r in spark.table("closed").collect()) == batch[:3]


def test_white_space_and_entities_by_character(spark):
    """Every character of two bytes and some others between letters, and tags and entities that appear late: as the rules say, one by one."""
    marks = [chr(i) for i in (*range(1, 0x700), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x3000, 0xFEFF)]
    space = set("\t\n\x0b\x0c\r \xa0     　﻿") | {chr(i) for i in range(0x2000, 0x200B)}
    texts = {f"a{c}b": "a b" if c in space else f"a{c}b" for c in marks} | {"a  b": "a b", " a ": "a", "x<b>y</b>": "xy", "&AMP;lt;i&gt;": "<i>", "1 < 2": "1 < 2", "&amp;nbsp;": "&nbsp;", "a&nbsp;&nbsp;b": "a b", "": ""}
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.normalize_text(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == texts


def test_held_units_are_parsed_once(spark, sf_dir, monkeypatch):
    from tracequill.plans import fixtures, registry

    parsed = []
    parse = fixtures.parse.article_units
    monkeypatch.setattr(fixtures.parse, "article_units", lambda rows: parsed.append(1) or parse(rows))
    found = registry.queries()["g13_change_scope"](spark, sf_dir)
    assert len(parsed) == 1 and "documents.parquet" not in found._jdf.queryExecution().optimizedPlan().toString() and not found.isEmpty()
    assert all("documents.parquet" not in x for x in found.inputFiles()) and not fixtures._HELD


def test_bigrams_of_every_kind_of_text(spark):
    texts = ["", "a", "ab", "abab", "日本語日本", "a😀b😀", "é x", "x\ny"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.normalized_claim(F.col("x")).alias("p"), T.bigrams(F.col("x")).alias("g")).collect()
    for r in rows:
        assert r.g == ([r.p] if 0 < len(r.p) <= 2 else list(dict.fromkeys(r.p[i : i + 2] for i in range(len(r.p) - 1)))), r.x


def test_counting_characters_replaces_no_pattern_in_plain_texts(spark):
    """Plain spaces go by replacement of one letter; any other white space still goes by the pattern."""
    texts = ["a b  c", "é ñ\u00a0x", "\ta\u3000b\ufeff", "日 本\u2003", "", None, "\x1c \x85"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.compact_characters(F.col("x")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [3, 3, 2, 2, 0, 0, 2]
    assert "replace(" in rows._jdf.queryExecution().analyzed().toString().replace("regexp_replace(", "")


def test_articles_are_parsed_in_arrow_batches_as_by_the_rules(spark):
    """Line ends, titles and white space of every kind, against Spark's own patterns; no lambda over lines is left."""
    rng = random.Random(11)
    parts = ["# T", "## A  b\t", "#", "#x", "####### no", "# \r", "# a\x85", "# a b", "# c", "x y", "  　", "\ufeff", "a\rb", "<b>", "<b>x</b> &amp;lt;", "é  ñ ", "\x00", "日本", "\x1c", "&NBSP;"]
    texts = ["", None, "\ufeff# T\nx", "\ufeff\ufeffx", "\r\n\r\nx\r\r\ny\r", *("".join(rng.choice(parts) + rng.choice(["\n", "\r\n", "\n\n", "\r", ""]) for _ in range(rng.randrange(9))) for _ in range(400))]
    lines = spark.createDataFrame(list(enumerate(texts)), "case_id int, text string")
    split = lines.select("case_id", F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n")).alias("i", "line"))
    title, ink = F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1), F.col("line").rlike("[^" + T.SPACE[1:])
    want, above, open_lines = [], {}, {}
    seen = split.select("case_id", "i", "line", title.alias("title"), ink.alias("ink")).orderBy("case_id", "i").collect()
    raw = []
    for r in [*seen, *(type(seen[0])(case_id=i, i=-1, line="", title="", ink=False) for i in range(len(texts)))]:
        if r.ink and not r.title:
            open_lines.setdefault(r.case_id, []).append(r.line)
            continue
        if open_lines.get(r.case_id):
            raw.append((r.case_id, len(raw), " ".join(open_lines.pop(r.case_id)), above.get(r.case_id)))
        if r.title:
            above[r.case_id] = r.title
    plain = spark.createDataFrame(raw, "case_id int, n int, text string, title string").select("case_id", "n", T.normalize_text(F.col("text")).alias("text"), F.coalesce(T.normalize_text(F.col("title")), F.lit("Body")).alias("heading"))
    count = {}
    for r in plain.filter("text <> ''").orderBy("case_id", "n").collect():
        count[r.case_id] = count.get(r.case_id, 0) + 1
        want.append((r.case_id, count[r.case_id], r.text, r.heading))
    found = parse.article_units(lines)
    assert sorted((r.case_id, r.pos, r.text, r.heading) for r in found.collect()) == sorted(want) and len(want) > 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_consensus_pairs_reviewers_once_and_numbers_over_four_digits_as_shown(spark, tmp_path):
    """A case of over 9,999 claims shows numbers cut to four digits, so pairs repeat: as often as in the SQL, not again by a second join."""
    from tracequill.plans import evidence_queries, fixtures, registry

    spark.createDataFrame([(1, "src0", "\n".join("x" for _ in range(10_020)))], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["g06_coverage_consensus"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["case_id", "evidence_ref", "verdict", "disputed", "triggers", "shared"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({evidence_queries.ORACLE['g06_coverage_consensus']})").fetchall()
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want) and fixtures.CLAIMS


def test_independence_reads_stored_roles(spark, sf_dir):
    from tracequill.plans import registry

    plan = registry.queries()["g17_independence"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and "explode" not in plan and "pos" not in plan


def test_reviews_store_places_without_texts(spark, sf_dir, monkeypatch):
    from tracequill.plans import fixtures, registry

    stored, write = [], fixtures.written
    monkeypatch.setattr(fixtures, "written", lambda s, df, tag: stored.append(df.columns) or write(s, df, tag))
    for name in ("g06_coverage_consensus", "g07_policy_status", "g17_independence"):
        assert registry.queries()[name](spark, sf_dir).count() > 0
    assert stored == [["case_id", "pos"]] * 3


def test_quotes_of_cases_of_any_size(spark):
    """Rows, not names, are counted: names may repeat. Cases over the bound give the same by grams; others make no row a gram."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("ab", k=rng.randrange(3, 12)))
    rows = [(case, f"E{i % 9}", word()) for case in (1, 2) for i in range(60)] + [(1, "E3", "ab" * 300), (None, "E1", "aaaaaaa"), (3, None, "aaaaaaa"), (3, "E2", "aaaaaaaa"), (3, "E4", None)]
    df = spark.createDataFrame(rows, "case_id long, id string, plain string")
    want = {}
    for case, name, quote in rows:
        if case is not None and quote and len(quote) >= 6:
            hits = [i for c, i, plain in rows if c == case and plain and quote in plain]
            least, n = want.get((case, name), (None, 0))
            want[case, name] = (min([x for x in (least, *hits) if x is not None], default=None), n + len(hits))
    for most in (4_000_000, 500, 0):
        got = E.quoted_in(df, most=most)
        assert most < 4_000_000 or "sequence(" not in got._jdf.queryExecution().toString()
        found = got.collect()
        assert {(r.case_id, r.quote_id): (r.first_match, r.matches) for r in found} == want and len(found) == len(want)
