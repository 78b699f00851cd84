"""Queries of free-form documents: recursive visitors, canonical JSON, claim snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequill.functions import canonical as C
from tracequill.functions import text as T
from tracequill.operators import contracts, trees
from tracequill.session import table

from . import fixtures as X

_K = ["case_id"]


def _quoted(text):
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def tree_documents(spark, sf):
    """case_id and json: a document's lines as blocks of nested lists, as deep as its first line is long (modulo 13), and an event's properties."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "props"), "doc_id", "left")
    lines = F.filter(F.transform(F.split("text", "\n"), T.normalize_text), lambda x: x != "")

    def block(x, i):
        number = (i + 1).cast("string")
        parts = [
            '{"type":"paragraph","text":', _quoted(x), ',"evidenceRef":"E', number, '","items":[{"label":', _quoted(F.substring(x, 1, 9)), ',"evidenceRefs":["E', (i + F.length(x) % 5).cast("string"), '","E', number,
            '"]},[[{"readerBlockRefs":["B', (F.length(x) % 7).cast("string"), '"],"summary":[[', _quoted(F.substring(x, 3, 4)), ',null,[]],7]}]],{"matchedEvidenceRefs":["M', (F.length(x) % 3).cast("string"), '",["no"]],"readerBlockRef":"R',
            number, '","a/b~":{"note":{}}}]}',
        ]
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    depth = F.length(F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(""))) % 13
    rows = docs.withColumn("lines", lines).withColumn("depth", depth)
    json = F.concat(
        F.lit('{"title":'), _quoted(F.col("source")), F.lit(',"lead":["x",'), _quoted(F.col("lang")), F.lit('],"body":'), F.repeat(F.lit('{"child":['), F.col("depth")), F.lit("["),
        F.array_join(F.transform("lines", block), ","), F.lit("]"), F.repeat(F.lit("]}"), F.col("depth")), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit(',"evidenceRef":["not","a","name"]}'),
    )
    return rows.select(F.col("doc_id").alias("case_id"), json.alias("json"))


def p06_block_characters(spark, sf):
    return trees.block_characters(trees.leaves(tree_documents(spark, sf), _K), _K)


def p07_references(spark, sf):
    return trees.references(trees.leaves(tree_documents(spark, sf), _K), _K)


def f14_canonical_documents(spark, sf):
    """Hashes of documents whose keys stand in no order and whose numbers are written in many ways."""
    docs = table(spark, sf, "documents")
    n = F.col("n_chars").cast("string")
    parts = ['{"text": ', _quoted(F.col("text")), ', "size":{"chars":', n, '.0 , "eighth":', (F.col("n_chars") / 8).cast("decimal(20,6)").cast("string"), ', "Large":', n, 'e3,"tiny":', (F.col("n_chars") % 9 + 1).cast("string"), '.0E-9, "zero":-0.0},\n"list":[',
             n, ', null,true, "\\u00e9\\u001F", {"b":[],"a":{}}], "huge":1', F.repeat(F.lit("0"), (F.col("n_chars") % 30).cast("int")), ', "Lang":', _quoted(F.col("lang")), "}"]
    return docs.select(F.col("doc_id").alias("case_id"), C.canonical_hash(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).alias("digest"))


def _bodies(spark, sf):
    """Claims with all fields that carry meaning; spans as lists, in no order and with repeats."""
    pos, text = F.col("pos"), F.col("statement")
    name = lambda i: F.concat(F.lit("P"), F.lpad(i.cast("string"), 6, "0"))
    segment = lambda i: F.concat(F.lit("S"), F.floor(i / 10).cast("string"))
    spans = F.array(
        F.struct(segment(pos).alias("segmentId"), F.array(name(pos + 1), name(pos), name(pos)).alias("sourceIds"), F.substring(text, 1, 12).alias("quote")),
        F.struct(segment(pos + 2).alias("segmentId"), F.array(name(pos + 2)).alias("sourceIds"), F.lit("").alias("quote")),
    )
    return X.claims(spark, sf).select(
        "case_id", "id", "statement", "provenance", "importance", F.when(F.contains(text, F.lit(" ")), "claim").alias("claim_role"), T.speaker_prefix(text).alias("speaker"), (F.length(text) % 8 / 8).alias("speaker_confidence"), "theme_id",
        F.when(text.rlike("[?!]"), F.array(F.lit("open"))).alias("uncertainty"), spans.alias("support_spans"),
    )


def p01_snapshots(spark, sf):
    return contracts.snapshots(_bodies(spark, sf))


QUERIES = {n: f for n, f in list(globals().items()) if n[0] in "pf" and n[1:3].isdigit()}

_TREE = f"""ln AS (SELECT doc_id, lang, source, props, list_filter(list_transform(string_split(text, chr(10)), lambda x: {X.norm('x')}), lambda x: x <> '') AS lines FROM documents LEFT JOIN events ON event_id = doc_id),
docs AS (SELECT doc_id AS case_id, ('{{"title":' || to_json(source) || ',"lead":["x",' || to_json(lang) || '],"body":' || repeat('{{"child":[', depth) || '[' || array_to_string(list_transform(lines, lambda x, i:
  '{{"type":"paragraph","text":' || to_json(x) || ',"evidenceRef":"E' || i || '","items":[{{"label":' || to_json(substr(x, 1, 9)) || ',"evidenceRefs":["E' || (i - 1 + length(x) % 5) || '","E' || i || '"]}},[[{{"readerBlockRefs":["B' || (length(x) % 7) ||
  '"],"summary":[[' || to_json(substr(x, 3, 4)) || ',null,[]],7]}}]],{{"matchedEvidenceRefs":["M' || (length(x) % 3) || '",["no"]],"readerBlockRef":"R' || i || '","a/b~":{{"note":{{}}}}}}]}}'), ',') || ']' || repeat(']}}', depth) ||
  ',"props":' || coalesce(props, 'null') || ',"evidenceRef":["not","a","name"]}}')::JSON AS json FROM (SELECT *, (length(coalesce(lines[1], '')) % 13)::INT AS depth FROM ln)),
node AS (SELECT case_id, t.id, t.parent, t.key, t.type, t.atom FROM docs, json_tree(docs.json) t),
walk(case_id, id, type, atom, key, hops) AS (SELECT case_id, id, type, atom, '', 0 FROM node WHERE parent IS NULL UNION ALL
  SELECT n.case_id, n.id, n.type, n.atom, CASE WHEN w.type = 'ARRAY' THEN w.key ELSE n.key END, CASE WHEN w.type = 'ARRAY' THEN w.hops + 1 ELSE 0 END FROM node n JOIN walk w ON n.case_id = w.case_id AND n.parent = w.id)"""
_STRING = "type = 'VARCHAR'"
_FIELDS = "CASE WHEN contains(statement, ' ') THEN '\"claimRole\":\"claim\",' ELSE '' END"
_SPEAKER = "regexp_extract(statement, '^\\s*([\\p{L}\\p{N}·・]{1,24})\\s*[：:]', 1)"
_NUM = "CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::DOUBLE::VARCHAR END"
_SPANS = """list_transform([['S' || (pos // 10), '"' || u0 || '","' || u1 || '"', '{"segmentId":"S' || (pos // 10) || '","sourceIds":["' || u0 || '","' || u1 || '"]}'], ['S' || ((pos + 2) // 10), '"' || u2 || '"', '{"segmentId":"S' || ((pos + 2) // 10) || '","sourceIds":["' || u2 || '"]}']], lambda x: x[3])"""
ORACLE = {
    "p06_block_characters": f"""WITH RECURSIVE {_TREE} SELECT case_id, coalesce(sum({X.compact("(atom ->> '$')")}) FILTER ({_STRING} AND key IN {trees.TEXT_KEYS}), 0)::BIGINT AS characters FROM walk GROUP BY case_id""",
    "p07_references": f"""WITH RECURSIVE {_TREE}, r AS (SELECT case_id, CASE WHEN hops = 0 AND key = 'evidenceRef' OR hops = 1 AND key IN ('evidenceRefs', 'matchedEvidenceRefs') THEN 'evidence'
  WHEN hops = 0 AND key = 'readerBlockRef' OR hops = 1 AND key = 'readerBlockRefs' THEN 'block' END AS target, atom ->> '$' AS ref FROM walk WHERE {_STRING}) SELECT DISTINCT * FROM r WHERE target IS NOT NULL""",
    "f14_canonical_documents": """WITH d AS (SELECT doc_id, text, lang, n_chars AS n, 1 + n_chars % 9 AS t, (n_chars % 30)::INT AS z FROM documents)
SELECT doc_id AS case_id, sha256('{"Lang":' || to_json(lang) || ',"huge":' || CASE WHEN z < 21 THEN '1' || repeat('0', z) ELSE '1e+' || z END || ',"list":[' || n || ',null,true,"é' || chr(92) || 'u001f",{"a":{},"b":[]}],"size":{"Large":' || n * 1000 || ',"chars":' || n ||
  ',"eighth":' || CASE WHEN n % 8 = 0 THEN (n // 8)::VARCHAR ELSE (n / 8)::DOUBLE::VARCHAR END || ',"tiny":' || t || 'e-9,"zero":0},"text":' || to_json(text) || '}') AS digest FROM d""",
    "p01_snapshots": f"""WITH {X.CLAIMS}, b AS (SELECT *, 'P' || lpad(pos::VARCHAR, 6, '0') AS u0, 'P' || lpad((pos + 1)::VARCHAR, 6, '0') AS u1, 'P' || lpad((pos + 2)::VARCHAR, 6, '0') AS u2, {_SPEAKER} AS s, (length(statement) % 8) / 8 AS c FROM claims),
k AS (SELECT *, list_sort(list_transform({_SPANS}, lambda x: [sha256(x), x])) AS sup FROM b),
m AS (SELECT *, '{{' || {_FIELDS} || '"importance":"' || importance || '","provenance":"' || provenance || '",' || CASE WHEN s <> '' THEN '"speaker":' || to_json(s) || ',' ELSE '' END || '"speakerConfidence":' || {_NUM.format(x='c')} || ',"statement":' || to_json(statement) || ',"themeId":"' || theme_id || '"' ||
  CASE WHEN regexp_matches(statement, '[?!]') THEN ',"uncertainty":["open"]' ELSE '' END || '}}' AS mean, '[' || sup[1][2] || ',' || sup[2][2] || ']' AS sups,
  '{{' || {_FIELDS} || '"id":"' || id || '","importance":"' || importance || '","provenance":"' || provenance || '",' || CASE WHEN s <> '' THEN '"speaker":' || to_json(s) || ',' ELSE '' END || '"speakerConfidence":' || {_NUM.format(x='c')} || ',"statement":' || to_json(statement) ||
  ',"supportSpans":[{{"quote":' || to_json(substr(statement, 1, 12)) || ',"segmentId":"S' || (pos // 10) || '","sourceIds":["' || u1 || '","' || u0 || '","' || u0 || '"]}},{{"quote":"","segmentId":"S' || ((pos + 2) // 10) || '","sourceIds":["' || u2 || '"]}}],"themeId":"' || theme_id || '"' ||
  CASE WHEN regexp_matches(statement, '[?!]') THEN ',"uncertainty":["open"]' ELSE '' END || '}}' AS whole FROM k)
SELECT case_id, id, sha256(mean) AS semantic_hash, sha256(sups) AS support_hash, sha256(whole) AS full_hash FROM m""",
}
