"""Queries over the driver's tables, each with its DuckDB SQL.

There is no model output in the tables, so extractions are made from a
document's own match tokens w (lower-cased, without white space), for documents
with at least five: e3 takes w[3..5], f4 takes w[3], w[5], w[4] and a word that
no document has, m2 takes two such words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model_output import normalize, parse, strip_fences, strip_think
from ..functions.tokens import char_to_byte, match_tokens, token_texts
from ..operators import compare as cmp
from ..operators.align import align, align_prepared, prepare, span_text
from ..operators.infer import RuleProvider, new_client
from ..operators.prompt import Example, Extraction, Template, head, issues, prompt
from ..operators.text import chunks, sentences, tokens
from ..sources.corpora import strip_boilerplate, truncate_at_sentence
from ..sources.spans import parse_json_lines, to_json_lines
from .run import extract, run

FOREIGN = ("zzqx", "vvkj")
TEMPLATE = Template(
    "Extract all people and places. Use the exact text.",
    [Example("Ada met Sam in Oslo.", [Extraction("person", "Ada", {"order": 1}), Extraction("person", "Sam", {"order": 2}), Extraction("place", "Oslo", {"kind": "city"})])],
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- tokens ------------------------------------------------------------------


def tokens_per_doc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(token_texts(F.col("text"))).cast("long").alias("n_tokens"))


def token_type_counts(spark, sf_dir):
    return tokens(_docs(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("n_bytes"))


def token_offsets(spark, sf_dir):
    return _long(tokens(_docs(spark, sf_dir)), "token_idx", "byte_start", "byte_end")


def token_roundtrip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", (F.array_join(token_texts(F.col("text")), "") == F.col("text")).alias("lossless"))


def word_frequencies(spark, sf_dir):
    return tokens(_docs(spark, sf_dir)).where("type = 'word'").groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"))


def number_tokens(spark, sf_dir):
    return tokens(_docs(spark, sf_dir)).where("type = 'number'").groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def benchmark_tokens(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _long(tokens(items), "token_idx", "byte_start", "byte_end")


def conversation_tokens(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return tokens(turns).groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("type") == "word").alias("n_words"))


_TOK = r"'\p{L}[\p{L}\p{M}\x{2019}''\-]*|\d[\d.,]*|[^\s]|\s+'"
_TYPE = r"CASE WHEN left(tok, 1) IN (' ', chr(9), chr(10), chr(13)) THEN 'whitespace' WHEN left(tok, 1) BETWEEN '0' AND '9' THEN 'number' WHEN regexp_matches(tok, '^\p{L}') THEN 'word' ELSE 'punctuation' END"


def _tok(source: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """t: the tokens of a text; u: a row for each, with type and offsets."""
    return f"""t AS (SELECT {keys}, {text}, regexp_extract_all({text}, {_TOK}) AS toks FROM {source}),
u0 AS (SELECT {keys}, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM t),
u AS (SELECT {keys}, i, tok, {_TYPE} AS type, CAST(sum(strlen(tok)) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS e, strlen(tok) AS n FROM u0)"""


# --- sentences and chunks ----------------------------------------------------


def sentence_count(spark, sf_dir):
    return sentences(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.octet_length("sentence")).cast("long").alias("longest"))


def sentences_exploded(spark, sf_dir):
    return _long(sentences(_docs(spark, sf_dir)), "sent_idx", "byte_start")


def chunks_1000(spark, sf_dir):
    rows = chunks(_docs(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("chunk_byte_start").cast("long").alias("chunk_byte_start"), F.length("chunk_text").cast("long").alias("n_chars"), F.md5("chunk_text").alias("digest"))


def chunk_sizes(spark, sf_dir):
    size = (F.length("chunk_text") / 250).cast("long")
    return chunks(_docs(spark, sf_dir)).groupBy(size.alias("size_class")).agg(F.count("*").alias("n"))


def chunk_prev_context(spark, sf_dir):
    rows = chunks(_docs(spark, sf_dir)).where("chunk_idx > 0")
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("previous_chunk").alias("previous"))


_LETTER = r"""CASE WHEN tok IN ('.', '!', '?') THEN CASE WHEN lag(tok) OVER w IN ('Mr', 'Mrs', 'Ms', 'Dr', 'Prof', 'St') THEN 'x' ELSE 'E' END
  WHEN tok IN ('"', '''', ')', ']', '}', '»', '”', '’') THEN 'C' WHEN type = 'whitespace' AND contains(tok, chr(10)) THEN 'N'
  WHEN type = 'word' AND upper(left(tok, 1)) = left(tok, 1) AND lower(left(tok, 1)) <> left(tok, 1) THEN 'U' ELSE 'x' END"""
#: A token begins a sentence after an ender and its closers, and at a line break
#: before a capital.
_SENT = f"""l AS (SELECT *, {_LETTER} AS letter FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, max(CASE WHEN letter <> 'C' THEN i END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lead(letter) OVER w AS next, lag(letter) OVER w AS last FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT g.*, CASE WHEN g.i > 0 AND ((g.letter <> 'C' AND (p.letter = 'E')) OR (g.letter = 'N' AND g.next = 'U')) THEN 1 ELSE 0 END AS begins FROM g LEFT JOIN l p ON p.doc_id = g.doc_id AND p.i = g.before),
k AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h),
s AS (SELECT doc_id, CAST(s AS BIGINT) AS sent_idx, CAST(min(e - n) AS BIGINT) AS byte_start, CAST(sum(n) AS BIGINT) AS n_bytes, string_agg(tok, '' ORDER BY i) AS sentence FROM k GROUP BY doc_id, s)"""
_CHUNK = """p(doc_id, sent_idx, chunk_idx, size) AS (SELECT doc_id, sent_idx, CAST(0 AS BIGINT), length(sentence) FROM s WHERE sent_idx = 0
  UNION ALL SELECT s.doc_id, s.sent_idx, CASE WHEN p.size + length(s.sentence) <= 1000 THEN p.chunk_idx ELSE p.chunk_idx + 1 END,
    CASE WHEN p.size + length(s.sentence) <= 1000 THEN p.size + length(s.sentence) ELSE length(s.sentence) END FROM p JOIN s ON s.doc_id = p.doc_id AND s.sent_idx = p.sent_idx + 1),
c AS (SELECT doc_id, chunk_idx, CAST(min(byte_start) AS BIGINT) AS pos, string_agg(sentence, '' ORDER BY sent_idx) AS chunk FROM p JOIN s USING (doc_id, sent_idx) GROUP BY doc_id, chunk_idx)"""


def _chunk_sql() -> str:
    return f"WITH RECURSIVE {_tok()}, {_SENT}, {_CHUNK}"


# --- alignment ---------------------------------------------------------------


def _recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text, w, e3, f4, m2 of the documents with five match tokens."""
    first = F.slice(match_tokens(token_texts(F.col("text"))), 1, 5)
    rows = docs.select("doc_id", "text", F.explode(F.array(first)).alias("w")).where("size(w) = 5")
    at = lambda i: F.get("w", F.lit(i))
    return rows.select("doc_id", "text", F.concat_ws(" ", at(2), at(3), at(4)).alias("e3"), F.concat_ws(" ", at(2), at(4), at(3), F.lit(FOREIGN[0])).alias("f4"), F.lit(" ".join(FOREIGN)).alias("m2"))


def _spans(df: DataFrame, wanted: str, threshold: float = 0.75) -> DataFrame:
    return align(_recipes(df), "text", wanted, threshold)


def _result(df: DataFrame) -> DataFrame:
    return _long(df.select("doc_id", "byte_start", "byte_end", "status"), "byte_start", "byte_end")


def align_exact(spark, sf_dir):
    return _result(_spans(_docs(spark, sf_dir), "e3").where("status = 'exact'"))


def align_first_occurrence_rule(spark, sf_dir):
    """Phrases that occur, yet not where their first token first does."""
    return _long(_spans(_docs(spark, sf_dir), "e3").where("status <> 'exact'").select("doc_id", "e3", "byte_start", "status"), "byte_start")


def align_fuzzy(spark, sf_dir):
    return _result(_spans(_docs(spark, sf_dir), "f4"))


def align_not_found(spark, sf_dir):
    return _result(_spans(_docs(spark, sf_dir), "m2"))


def align_status_summary(spark, sf_dir):
    rows = prepare(_recipes(_docs(spark, sf_dir))).select("_source", F.explode(F.create_map(*[x for c in ("e3", "f4", "m2") for x in (F.lit(c), F.col(c))])).alias("recipe", "wanted"))
    return align_prepared(rows, "wanted").groupBy("recipe", "status").agg(F.count("*").alias("n"))


def align_threshold_sweep(spark, sf_dir):
    rows = prepare(_recipes(_docs(spark, sf_dir))).select("doc_id", "f4", "_source")
    out = [align_prepared(rows, "f4", x).groupBy("status").agg(F.count("*").alias("n")).withColumn("threshold", F.lit(x)) for x in (0.5, 0.75, 0.9)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def align_byte_roundtrip(spark, sf_dir):
    rows = _spans(_docs(spark, sf_dir), "e3").where("status = 'exact'")
    return rows.select("doc_id", span_text(F.col("text"), F.col("byte_start"), F.col("byte_end")).alias("span"))


def char_to_byte_offset(spark, sf_dir):
    half = (F.length("text") / 2).cast("int")
    return _docs(spark, sf_dir).select("doc_id", char_to_byte(F.col("text"), half).cast("long").alias("byte_offset"))


#: m: match tokens by number; d: those a recipe uses; x and f: places of e3, f4.
_ALIGN = f"""{_tok()},
m AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS k, lower(tok) AS w, e - n AS a, e AS b FROM u WHERE type <> 'whitespace'),
d AS (SELECT doc_id, max(CASE WHEN k = 3 THEN w END) AS w3, max(CASE WHEN k = 4 THEN w END) AS w4, max(CASE WHEN k = 5 THEN w END) AS w5 FROM m GROUP BY doc_id HAVING max(k) >= 5),
x AS (SELECT m.doc_id, min(k) AS k FROM m JOIN d ON d.doc_id = m.doc_id AND m.w = d.w3 GROUP BY m.doc_id),
e3 AS (SELECT x.doc_id, m1.a, m3.b FROM x JOIN d USING (doc_id) JOIN m m1 ON m1.doc_id = x.doc_id AND m1.k = x.k JOIN m m2 ON m2.doc_id = x.doc_id AND m2.k = x.k + 1 AND m2.w = d.w4 JOIN m m3 ON m3.doc_id = x.doc_id AND m3.k = x.k + 2 AND m3.w = d.w5)"""


def _windows(n: int, words: list[str]) -> str:
    """v: for each window of n tokens, how many of the words it holds."""
    out = []
    for i, w in enumerate(words):
        need = " + ".join(f"CAST({w} = {v} AS INT)" for v in words)
        first = " AND ".join([f"{w} <> {v}" for v in words[:i]] or ["true"])
        out.append(f"CASE WHEN {first} THEN least({need}, sum(CAST(w = {w} AS INT)) OVER o) ELSE 0 END")
    return f"""z AS (SELECT m.*, d.w3, d.w4, d.w5 FROM m JOIN d USING (doc_id)),
v AS (SELECT doc_id, k, a, lead(b, {n - 1}) OVER (PARTITION BY doc_id ORDER BY k) AS b, {' + '.join(out)} AS hit FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
best AS (SELECT doc_id, max(hit) AS hit, arg_min(struct_pack(a := a, b := b), (-hit, k)) AS s FROM v WHERE b IS NOT NULL GROUP BY doc_id)"""


_FUZZY3 = _windows(3, ["w3", "w4", "w5"])
_FUZZY4 = _windows(4, ["w3", "w5", "w4", f"'{FOREIGN[0]}'"])
_E3 = f"WITH {_ALIGN}, {_FUZZY3}, r AS (SELECT d.doc_id, w3 || ' ' || w4 || ' ' || w5 AS e3, CASE WHEN e3.a IS NOT NULL THEN 'exact' WHEN hit / 3.0 >= 0.75 THEN 'fuzzy' ELSE 'not_found' END AS status, coalesce(e3.a, CASE WHEN hit / 3.0 >= 0.75 THEN s.a END) AS byte_start, coalesce(e3.b, CASE WHEN hit / 3.0 >= 0.75 THEN s.b END) AS byte_end FROM d LEFT JOIN e3 USING (doc_id) LEFT JOIN best USING (doc_id))"
_F4 = f"WITH {_ALIGN}, {_FUZZY4}, r AS (SELECT d.doc_id, coalesce(hit, 0) / 4.0 AS ratio, s.a, s.b FROM d LEFT JOIN best USING (doc_id))"


# --- model output ------------------------------------------------------------

#: Entries in the dynamic and the canonical form, and invalid ones, by doc_id;
#: some outputs have thoughts or a fence around, some are no output at all.


def _raw(docs: DataFrame) -> DataFrame:
    json = lambda c: F.to_json(F.struct(c.alias("v")))
    quoted = lambda c: F.regexp_extract(json(c), r'(?s)\A\{"v":(.*)\}\z', 1)
    k = F.col("doc_id")
    dynamic = F.concat(F.lit('{"phrase":'), quoted(F.col("e3")), F.lit(',"phrase_attributes":{"n":3}}'))
    canonical = F.concat(F.lit('{"class":"phrase","text":'), quoted(F.col("f4")), F.lit("}"))
    invalid = F.lit('{"class":"phrase","text":42}')
    body = F.concat(F.lit('{"extractions":['), F.concat_ws(",", F.when(k % 13 != 0, dynamic), canonical, F.when(k % 3 == 0, invalid)), F.lit("]}"))
    body = F.when(k % 11 == 0, F.lit("just plain text")).otherwise(body)
    body = F.when(k % 7 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(body)
    body = F.when(k % 5 == 0, F.concat(F.lit("<think>a, then b</think>\n"), body)).otherwise(body)
    return _recipes(docs).select("doc_id", "text", "e3", "f4", body.alias("raw"))


def strip_think_query(spark, sf_dir):
    return _raw(_docs(spark, sf_dir)).select("doc_id", F.md5(strip_think(F.col("raw"))).alias("digest"))


def strip_fences_query(spark, sf_dir):
    return _raw(_docs(spark, sf_dir)).select("doc_id", F.md5(strip_fences(strip_think(F.col("raw")))).alias("digest"))


def normalize_output(spark, sf_dir):
    entries = F.from_json("j", "extractions array<struct<class string, text string>>")["extractions"]
    rows = _raw(_docs(spark, sf_dir)).select("doc_id", normalize(F.col("raw")).alias("j"))
    return rows.select("doc_id", F.col("j").isNull().alias("invalid"), F.coalesce(F.size(entries), F.lit(0)).cast("long").alias("n_entries"), F.get(entries, F.lit(0))["text"].alias("first_text"))


def parse_filter_invalid(spark, sf_dir):
    rows = _raw(_docs(spark, sf_dir)).select("doc_id", parse(F.col("raw")).alias("p"))
    return rows.select("doc_id", F.col("p.error").alias("error"), F.col("p.dropped").cast("long").alias("dropped"), F.size("p.entries").cast("long").alias("kept"))


def extract_end_to_end(spark, sf_dir):
    rows = extract(_raw(_docs(spark, sf_dir)).select("doc_id", "text", "raw")).where("ext_idx is not null")
    return _long(rows.select("doc_id", "ext_idx", "class", "ext_text", "attributes", "byte_start", "byte_end", "status"), "ext_idx", "byte_start", "byte_end")


def extract_error_kinds(spark, sf_dir):
    rows = extract(_raw(_docs(spark, sf_dir)).select("doc_id", "text", "raw"))
    return rows.groupBy(F.coalesce("error_kind", F.lit("none")).alias("kind")).agg(F.countDistinct("doc_id").alias("n_docs"))


_BAD = "doc_id % 11 = 0"
_QUOTE = lambda c: f"CAST(to_json({c}) AS VARCHAR)"
_RAW = f"""b0 AS (SELECT doc_id, CASE WHEN {_BAD} THEN 'just plain text' ELSE '{{"extractions":[' || concat_ws(',',
  CASE WHEN doc_id % 13 <> 0 THEN '{{"phrase":' || {_QUOTE("w3 || ' ' || w4 || ' ' || w5")} || ',"phrase_attributes":{{"n":3}}}}' END,
  '{{"class":"phrase","text":' || {_QUOTE(f"w3 || ' ' || w5 || ' ' || w4 || ' {FOREIGN[0]}'")} || '}}', CASE WHEN doc_id % 3 = 0 THEN '{{"class":"phrase","text":42}}' END) || ']}}' END AS body FROM d)"""
_EXTRACT = f"""WITH {_ALIGN}, {_FUZZY3}, best3 AS (SELECT * FROM best), {_FUZZY4.replace('z AS', 'z4 AS').replace('FROM z ', 'FROM z4 ').replace('v AS', 'v4 AS').replace('FROM v ', 'FROM v4 ').replace('best AS', 'best4 AS')},
y AS (SELECT doc_id, 0 AS o, w3 || ' ' || w4 || ' ' || w5 AS ext_text, '{{"n":3}}' AS attributes, e3.a, e3.b, hit / 3.0 AS ratio, s FROM d LEFT JOIN e3 USING (doc_id) LEFT JOIN best3 USING (doc_id) WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id, 1, w3 || ' ' || w5 || ' ' || w4 || ' {FOREIGN[0]}', '{{}}', NULL, NULL, hit / 4.0, s FROM d LEFT JOIN best4 USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS BIGINT) AS ext_idx, 'phrase' AS class, ext_text, attributes,
  coalesce(a, CASE WHEN ratio >= 0.75 THEN s.a END) AS byte_start, coalesce(b, CASE WHEN ratio >= 0.75 THEN s.b END) AS byte_end,
  CASE WHEN a IS NOT NULL THEN 'exact' WHEN ratio >= 0.75 THEN 'fuzzy' ELSE 'not_found' END AS status FROM y WHERE NOT {_BAD}"""


# --- runs --------------------------------------------------------------------


def last_capital(text: str) -> str:
    """A model without a network: the last capitalised word of the prompt. It
    fails where that word has the letter w."""
    found = re.findall(r"[A-Z][a-z]+", text)
    if found and "w" in found[-1]:
        return "no output"
    return '{"extractions":[' + (f'{{"word":"{found[-1]}"}}' if found else "") + "]}"


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return run(_docs(spark, sf_dir), new_client(RuleProvider(last_capital)), Template(""))


def run_chunked_offline(spark, sf_dir):
    return _long(_run(spark, sf_dir)[0].select("doc_id", "chunk_idx", "ext_text", "byte_start", "byte_end", "status"), "chunk_idx", "byte_start", "byte_end")


def run_error_first_chunk(spark, sf_dir):
    return _long(_run(spark, sf_dir)[1].select("doc_id", "chunk_idx", "error_kind"), "chunk_idx")


def rebase_offsets(spark, sf_dir):
    rows = _run(spark, sf_dir)[0].where("byte_start is not null").join(_docs(spark, sf_dir), "doc_id")
    same = span_text(F.col("text"), F.col("byte_start"), F.col("byte_end")) == F.col("ext_text")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(same).alias("n_verbatim"))


#: q: a prompt for each chunk; o: the word found in it; r: the chunk's match
#: tokens; y: the place of the word in its chunk.
_RUN = f"""{_chunk_sql()}, q AS (SELECT doc_id, chunk_idx, pos, chunk, concat_ws(chr(10) || chr(10), '[Previous text]: ...' || lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_idx), chunk) AS prompt FROM c),
o AS (SELECT *, regexp_extract_all(prompt, '[A-Z][a-z]+')[-1] AS word FROM q), bad AS (SELECT doc_id, min(chunk_idx) AS chunk_idx FROM o WHERE contains(word, 'w') GROUP BY doc_id),
good AS (SELECT * FROM o WHERE word IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM bad)),
r0 AS (SELECT doc_id, chunk_idx, pos, word, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM (SELECT *, regexp_extract_all(chunk, {_TOK}) AS toks FROM good)),
r AS (SELECT *, sum(strlen(tok)) OVER (PARTITION BY doc_id, chunk_idx ORDER BY i) - strlen(tok) + pos AS a FROM r0),
y AS (SELECT doc_id, chunk_idx, min(a) AS a FROM r WHERE lower(tok) = lower(word) GROUP BY doc_id, chunk_idx)"""


# --- prompts -----------------------------------------------------------------


def prompt_build(spark, sf_dir):
    rows = chunks(_docs(spark, sf_dir)).withColumn("p", prompt(TEMPLATE, F.col("chunk_text"), F.col("previous_chunk")))
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("digest"))


def prompt_context_window(spark, sf_dir):
    rows = chunks(_docs(spark, sf_dir)).withColumn("p", prompt(Template(""), F.lit("now"), F.col("previous_chunk"), 20))
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "p")


def validate_examples(spark, sf_dir):
    """Recipes as examples: what does not occur exactly is an issue."""
    rows = _recipes(_docs(spark, sf_dir))
    rows = rows.select(F.col("doc_id").alias("example_index"), F.col("text").alias("example_text"), F.posexplode(F.array("e3", "m2")).alias("extraction_index", "extraction_text"))
    return _long(issues(rows).drop("example_text"), "extraction_index")


# --- stored results and their comparison -------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    spans = _spans(docs, "e3").select("doc_id", F.lit(0).alias("ext_idx"), F.lit("phrase").alias("class"), F.col("e3").alias("ext_text"), F.lit('{"n":3}').alias("attributes"), "byte_start", "byte_end", "status")
    return to_json_lines(docs, spans)


def spans_to_jsonl(spark, sf_dir):
    return _stored(spark, sf_dir).select("doc_id", F.get_json_object("value", "$.extractions[0].text").alias("ext_text"), F.get_json_object("value", "$.extractions[0].byte_start").cast("long").alias("byte_start"), F.get_json_object("value", "$.extractions[0].status").alias("status"), (F.get_json_object("value", "$.text") == F.lit("")).isNotNull().alias("has_text"))


def jsonl_roundtrip_counts(spark, sf_dir):
    rows = parse_json_lines(_stored(spark, sf_dir).select("value"))
    return rows.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum("byte_start").alias("starts"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two result sets by source: all e3 spans, and those of two thirds, half of
    them moved by their source's last digit and with another class."""
    spans = _spans(_docs(spark, sf_dir), "e3")
    left = spans.select(F.col("doc_id").alias("source"), F.lit(0).alias("idx"), F.col("e3").alias("text"), F.lit("phrase").alias("class"), "status", "byte_start")
    odd = F.col("source") % 2 == 1
    right = left.where("source % 3 > 0").withColumns({"class": F.when(odd, "word").otherwise("phrase"), "byte_start": F.when(odd, F.col("byte_start") + F.col("source") % 10).otherwise(F.col("byte_start")).cast("int")})
    return left, right


def compare_match_exact(spark, sf_dir):
    return _long(cmp.match_equal(*_sides(spark, sf_dir)).select("source", "text", "left_start", "right_start"), "left_start", "right_start")


def compare_agreement(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    pairs = cmp.match_equal(left, right).withColumn("source", F.lit("all"))
    totals = left.agg(F.count("*").alias("left_total")).crossJoin(right.agg(F.count("*").alias("right_total"))).select(F.lit("all").alias("source"), "left_total", "right_total")
    return _long(cmp.summary(pairs, totals), "offset_max")


def compare_only_left(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return left.join(right, ["source", "text"], "left_anti").select("source", "text")


def compare_similarity(spark, sf_dir):
    """The similarity tier, text by text within a source: e3 against f4."""
    rows = _recipes(_docs(spark, sf_dir))
    side = lambda c: rows.select(F.col("doc_id").alias("source"), F.lit(0).alias("idx"), F.col(c).alias("text"), F.lit("phrase").alias("class"), F.lit("exact").alias("status"), F.lit(0).alias("byte_start"))
    return cmp.match(side("e3"), side("f4")).select("source", "left_text", "right_text", "ratio")


# --- corpora -----------------------------------------------------------------


def boilerplate_strip(spark, sf_dir):
    book = F.concat(F.lit("x\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\n"), "text", F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK A ***\ny"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(strip_boilerplate(book)).alias("digest"))


def truncate_500(spark, sf_dir):
    """Also held against brute force in the tests."""
    return _docs(spark, sf_dir).select("doc_id", truncate_at_sentence(F.col("text"), 500).alias("text"))


_HEAD = "'" + head(TEMPLATE).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_SIDES = f"""{_E3}, le AS (SELECT doc_id AS source, e3 AS text, 'phrase' AS class, status, byte_start FROM r),
ri AS (SELECT source, text, CASE WHEN source % 2 = 1 THEN 'word' ELSE 'phrase' END AS class, status, CASE WHEN source % 2 = 1 THEN byte_start + source % 10 ELSE byte_start END AS byte_start FROM le WHERE source % 3 > 0),
j AS (SELECT source, text, le.class = ri.class AS c, le.status = ri.status AS s, le.byte_start AS a, ri.byte_start AS b FROM le JOIN ri USING (source, text))"""
_TRIMMED = r"regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')"

ORACLE_SQL: dict[str, str] = {
    "truncate_500": """WITH c AS (SELECT doc_id, text, left(text, list_max(list_filter(range(least(length(text), 500) + 1), lambda k: strlen(left(text, k)) <= 500))) AS cut FROM documents),
p AS (SELECT *, regexp_extract(cut, '(?s)^(.*[.!?])(?:[ \n\r"'']|$)', 1) AS sentence, regexp_extract(cut, '(?s)^(.*) ', 1) AS word FROM c)
SELECT doc_id, CASE WHEN strlen(text) <= 500 THEN text WHEN sentence <> '' THEN sentence WHEN word <> '' THEN word ELSE cut END AS text FROM p""",
    "tokens_per_doc": f"WITH {_tok()} SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens FROM t",
    "token_type_counts": f"WITH {_tok()} SELECT type, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_bytes FROM u GROUP BY type",
    "token_offsets": f"WITH {_tok()} SELECT doc_id, i AS token_idx, tok AS token, type, e - n AS byte_start, e AS byte_end FROM u",
    "token_roundtrip": f"WITH {_tok()} SELECT doc_id, array_to_string(toks, '') = text AS lossless FROM t",
    "word_frequencies": f"WITH {_tok()} SELECT lower(tok) AS word, count(*) AS n FROM u WHERE type = 'word' GROUP BY 1",
    "number_tokens": f"WITH {_tok()} SELECT tok AS token, count(*) AS n, min(doc_id) AS first_doc FROM u WHERE type = 'number' GROUP BY 1",
    "benchmark_tokens": f"WITH {_tok('benchmark', 'item_id')} SELECT item_id, i AS token_idx, tok AS token, type, e - n AS byte_start, e AS byte_end FROM u",
    "conversation_tokens": f"WITH {_tok('conversations', 'conv_id, turn')} SELECT conv_id, turn, count(*) AS n_tokens, count(*) FILTER (type = 'word') AS n_words FROM u GROUP BY 1, 2",
    "sentence_count": f"WITH {_tok()}, {_SENT} SELECT doc_id, count(*) AS n_sentences, max(n_bytes) AS longest FROM s GROUP BY 1",
    "sentences_exploded": f"WITH {_tok()}, {_SENT} SELECT doc_id, sent_idx, sentence, byte_start FROM s",
    "chunks_1000": f"{_chunk_sql()} SELECT doc_id, chunk_idx, pos AS chunk_byte_start, length(chunk) AS n_chars, md5(chunk) AS digest FROM c",
    "chunk_sizes": f"{_chunk_sql()} SELECT CAST(floor(length(chunk) / 250) AS BIGINT) AS size_class, count(*) AS n FROM c GROUP BY 1",
    "chunk_prev_context": f"{_chunk_sql()} SELECT * FROM (SELECT doc_id, chunk_idx, md5(lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_idx)) AS previous FROM c) WHERE chunk_idx > 0",
    "align_exact": f"{_E3} SELECT doc_id, byte_start, byte_end, status FROM r WHERE status = 'exact'",
    "align_first_occurrence_rule": f"{_E3} SELECT doc_id, e3, byte_start, status FROM r WHERE status <> 'exact'",
    "align_fuzzy": f"{_F4} SELECT doc_id, CASE WHEN ratio >= 0.75 THEN a END AS byte_start, CASE WHEN ratio >= 0.75 THEN b END AS byte_end, CASE WHEN ratio >= 0.75 THEN 'fuzzy' ELSE 'not_found' END AS status FROM r",
    "align_not_found": f"WITH {_ALIGN} SELECT doc_id, CAST(NULL AS BIGINT) AS byte_start, CAST(NULL AS BIGINT) AS byte_end, 'not_found' AS status FROM d",
    "align_status_summary": f"SELECT 'e3' AS recipe, * FROM ({_E3} SELECT status, count(*) AS n FROM r GROUP BY 1) UNION ALL SELECT 'f4', * FROM ({_F4} SELECT CASE WHEN ratio >= 0.75 THEN 'fuzzy' ELSE 'not_found' END, count(*) FROM r GROUP BY 1) UNION ALL SELECT 'm2', 'not_found', * FROM (WITH {_ALIGN} SELECT count(*) FROM d)",
    "align_threshold_sweep": f"{_F4} SELECT CASE WHEN ratio >= threshold THEN 'fuzzy' ELSE 'not_found' END AS status, count(*) AS n, threshold FROM r, (SELECT unnest([CAST(0.5 AS DOUBLE), 0.75, 0.9]) AS threshold) GROUP BY 1, 3",
    "align_byte_roundtrip": f"{_E3} SELECT r.doc_id, (SELECT string_agg(tok, '' ORDER BY i) FROM u WHERE u.doc_id = r.doc_id AND e - n >= byte_start AND e <= byte_end) AS span FROM r WHERE status = 'exact'",
    "char_to_byte_offset": "SELECT doc_id, CAST(strlen(left(text, CAST(floor(length(text) / 2) AS BIGINT))) AS BIGINT) AS byte_offset FROM documents",
    "strip_think": f"WITH {_ALIGN}, {_RAW} SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.' ELSE body END) AS digest FROM b0",
    "strip_fences": f"WITH {_ALIGN}, {_RAW} SELECT doc_id, md5(body) AS digest FROM b0",
    "normalize_output": f"WITH {_ALIGN} SELECT doc_id, {_BAD} AS invalid, CAST(CASE WHEN {_BAD} THEN 0 ELSE 1 + CAST(doc_id % 13 <> 0 AS INT) + CAST(doc_id % 3 = 0 AS INT) END AS BIGINT) AS n_entries, CASE WHEN {_BAD} THEN NULL WHEN doc_id % 13 <> 0 THEN w3 || ' ' || w4 || ' ' || w5 ELSE w3 || ' ' || w5 || ' ' || w4 || ' {FOREIGN[0]}' END AS first_text FROM d",
    "parse_filter_invalid": f"WITH {_ALIGN} SELECT doc_id, CASE WHEN {_BAD} THEN 'invalid_format' END AS error, CAST(CASE WHEN NOT {_BAD} AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS dropped, CAST(CASE WHEN {_BAD} THEN 0 WHEN doc_id % 13 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS kept FROM d",
    "extract_end_to_end": _EXTRACT,
    "extract_error_kinds": f"WITH {_ALIGN} SELECT CASE WHEN {_BAD} THEN 'invalid_format' ELSE 'none' END AS kind, count(*) AS n_docs FROM d GROUP BY 1",
    "run_chunked_offline": f"{_RUN} SELECT good.doc_id, good.chunk_idx, word AS ext_text, CAST(a AS BIGINT) AS byte_start, CAST(a + strlen(word) AS BIGINT) AS byte_end, CASE WHEN a IS NULL THEN 'not_found' ELSE 'exact' END AS status FROM good LEFT JOIN y USING (doc_id, chunk_idx)",
    "run_error_first_chunk": f"{_RUN} SELECT doc_id, chunk_idx, 'invalid_format' AS error_kind FROM bad",
    "rebase_offsets": f"{_RUN} SELECT 'exact' AS status, count(*) AS n, count(*) FILTER (tok = word) AS n_verbatim FROM y JOIN r USING (doc_id, chunk_idx, a) WHERE lower(tok) = lower(word)",
    "prompt_build": f"{_chunk_sql()}, q AS (SELECT doc_id, chunk_idx, concat_ws(chr(10) || chr(10), {_HEAD}, '[Previous text]: ...' || lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_idx), chunk) AS p FROM c) SELECT doc_id, chunk_idx, length(p) AS n_chars, md5(p) AS digest FROM q",
    "prompt_context_window": f"{_chunk_sql()} SELECT doc_id, chunk_idx, concat_ws(chr(10) || chr(10), '[Previous text]: ...' || right(lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_idx), 20), 'now') AS p FROM c",
    "validate_examples": f"{_E3} SELECT doc_id AS example_index, CAST(0 AS BIGINT) AS extraction_index, e3 AS extraction_text, status FROM r WHERE status <> 'exact' UNION ALL SELECT doc_id, 1, '{' '.join(FOREIGN)}', 'not_found' FROM r",
    "spans_to_jsonl": f"{_E3} SELECT x.doc_id, e3 AS ext_text, byte_start, status, true AS has_text FROM documents x LEFT JOIN r USING (doc_id)",
    "jsonl_roundtrip_counts": f"{_E3} SELECT coalesce(status, 'none') AS status, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(byte_start) AS BIGINT) AS starts FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1",
    "compare_match_exact": f"{_SIDES} SELECT source, text, a AS left_start, b AS right_start FROM j",
    "compare_agreement": f"{_SIDES}, n AS (SELECT (SELECT count(*) FROM le) AS l, (SELECT count(*) FROM ri) AS r) SELECT 'all' AS source, l AS left_total, n.r AS right_total, count(*) AS matched, l - count(*) AS only_left, n.r - count(*) AS only_right, round(100 * avg(CAST(c AS INT)), 1) AS class_agreement, round(100 * avg(CAST(s AS INT)), 1) AS status_agreement, round(avg(abs(a - b)), 1) AS offset_mean, max(abs(a - b)) AS offset_max, round(100 * count(*) / greatest(l, n.r, 1), 1) AS match_rate FROM j, n GROUP BY l, n.r",
    "compare_only_left": f"{_SIDES} SELECT source, text FROM le ANTI JOIN ri USING (source, text)",
    "boilerplate_strip": f"SELECT doc_id, md5({_TRIMMED}) AS digest FROM (SELECT doc_id, text AS x FROM documents)",
}

QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        tokens_per_doc, token_type_counts, token_offsets, token_roundtrip, word_frequencies, number_tokens, benchmark_tokens, conversation_tokens,
        sentence_count, sentences_exploded, chunks_1000, chunk_sizes, chunk_prev_context,
        align_exact, align_first_occurrence_rule, align_fuzzy, align_not_found, align_status_summary, align_threshold_sweep, align_byte_roundtrip, char_to_byte_offset,
        strip_think_query, strip_fences_query, normalize_output, parse_filter_invalid, extract_end_to_end, extract_error_kinds,
        run_chunked_offline, run_error_first_chunk, rebase_offsets, prompt_build, prompt_context_window, validate_examples,
        spans_to_jsonl, jsonl_roundtrip_counts, compare_match_exact, compare_agreement, compare_only_left, compare_similarity, boilerplate_strip, truncate_500,
    )
}
FLAGSHIP = run_chunked_offline
