"""Queries of the core operators over the driver's tables, and the same in DuckDB's SQL.

Vocabularies, pieces and character maps that the real models ship aren't available; they are derived from the corpus by
rules that both engines follow. The hash backend stands in for a model.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import sq8, tokens, vector
from textloom.functions import text as T
from textloom.operators import catalog as C
from textloom.operators import charsmap, corpus, embed, ranking, unigram
from textloom.operators import wordpiece as sub_words
from textloom.operators.embed import HashBackend
from textloom.operators.vector_store import VectorStore
from textloom.sources import archive, tables
from textloom.sources.shared import BROADCAST_ROWS, scratch, small_batches
from textloom.sources.tables import dealt, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MAX_LENGTH, EMBED_DIMENSIONS, TOP_K = 512, 8, 10
WHOLE_WORDS, FIRST_CHARS, PIECES, PAIRS = 2000, 500, 4000, 500


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that takes longer than moving them."""
    return dealt(_documents(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# ---- text -----------------------------------------------------------------------------------------------------------

#: Documents with what they don't hold by themselves, marks and runs of spaces, and rows of odd texts besides.
_ODD = ((-1, ""), (-2, "a   b"), (-3, " Hello"), (-4, "\u0301"), (-5, "   "))
_MARKED = "(SELECT doc_id, concat('  ', text, ' E', chr(769), '   Z', chr(803), ' end') AS text FROM documents UNION ALL VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _ODD) + ")"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("  "), "text", F.lit(" E\u0301   Z\u0323 end")).alias("text"))
    return rows.unionByName(spark.createDataFrame(list(_ODD), "doc_id long, text string"))


@query("SELECT doc_id, lower(text) AS lowered FROM documents")
def bert_lower(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.bert_lower(F.col("text")).alias("lowered"))


_NORMAL = r"regexp_replace(lower({}), '[\x{{0300}}-\x{{036F}}]', '', 'g')"


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS normal FROM {_MARKED}")
def bert_normalize(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", T.bert_normalize(F.col("text")).alias("normal"))


@query(rf"SELECT doc_id, len(regexp_extract_all({_NORMAL.format('text')}, '[\p{{L}}\p{{N}}]+'))::INT AS n_words, array_to_string(regexp_extract_all({_NORMAL.format('text')}, '[\p{{L}}\p{{N}}]+'), ' ') AS words FROM documents")
def word_segment(spark, sf_dir):
    words = T.segment(T.bert_normalize(F.col("text")))
    return _dealt(spark, sf_dir).select("doc_id", F.size(words).alias("n_words"), F.array_join(words, " ").alias("words"))


@query(f"SELECT doc_id, regexp_replace(text, ' {{2,}}', ' ', 'g') AS collapsed FROM {_MARKED}")
def collapse_spaces(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", T.collapse_spaces(F.col("text")).alias("collapsed"))


_META = "CASE WHEN {0} = '' THEN '' ELSE replace(CASE WHEN starts_with({0}, ' ') THEN {0} ELSE ' ' || {0} END, ' ', '▁') END"


@query(f"SELECT doc_id, {_META.format('text')} AS escaped FROM {_MARKED}")
def metaspace(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", T.metaspace(F.col("text")).alias("escaped"))


def _prefixed(kind: str) -> tuple[str, Query]:
    prefix = C.Catalog().lookup("multilingual-e5-small").prefix(kind)

    def run(spark, sf_dir):
        return _documents(spark, sf_dir).select("doc_id", T.with_prefix(F.col("text"), prefix).alias("prefixed"))

    return f"SELECT doc_id, '{prefix}' || text AS prefixed FROM documents", run


for _kind in embed.KINDS:
    ORACLES[f"apply_prefix_{_kind}"], QUERIES[f"apply_prefix_{_kind}"] = _prefixed(_kind)


def derived_map() -> dict[str, str]:
    """Wide ASCII forms, odd spaces, an ellipsis and composed accents, by rule."""
    out = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)} | {"\u00a0": " ", "\u3000": " ", "…": "..."}
    return out | {c + "\u0301": a for c, a in zip("aeiou", "áéíóú", strict=True)}


_WIDE = "concat(text, ' Ｈｅｌｌｏ', chr(160), 'e', chr(769), '…')"


@query(f"SELECT doc_id, replace(replace(replace(translate({_WIDE}, (SELECT string_agg(chr(65248 + c::INT), '' ORDER BY c) FROM range(33, 127) r(c)), (SELECT string_agg(chr(c::INT), '' ORDER BY c) FROM range(33, 127) r(c))), chr(160), ' '), 'e' || chr(769), 'é'), '…', '...') AS normal FROM documents")
def charsmap_normalize(spark, sf_dir):
    run = charsmap.normalizer(spark, charsmap.build(derived_map()))
    return _dealt(spark, sf_dir).select("doc_id", run(F.concat("text", F.lit(" Ｈｅｌｌｏ\u00a0e\u0301…"))).alias("normal"))


@query(f"SELECT doc_id, '▁' || replace(regexp_replace(ltrim(replace(replace(replace(translate({_WIDE}, (SELECT string_agg(chr(65248 + c::INT), '' ORDER BY c) FROM range(33, 127) r(c)), (SELECT string_agg(chr(c::INT), '' ORDER BY c) FROM range(33, 127) r(c))), chr(160), ' '), 'e' || chr(769), 'é'), '…', '...'), ' '), ' {{2,}}', ' ', 'g'), ' ', '▁') AS normal FROM documents")
def xlmr_normalize(spark, sf_dir):
    run = charsmap.normalizer(spark, charsmap.build(derived_map()))
    return _dealt(spark, sf_dir).select("doc_id", charsmap.tokenization_form(run, F.concat("text", F.lit(" Ｈｅｌｌｏ\u00a0e\u0301…"))).alias("normal"))


# ---- sub-words ------------------------------------------------------------------------------------------------------


def _word_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(T.segment(T.bert_normalize(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def derived_vocabulary(docs: DataFrame) -> dict[str, int]:
    """Token to id: the most frequent words, first letters and inner pieces of docs(text), each up to a fixed number, so that
    the vocabulary has a bound. Words are counted once; their counts are kept while the three lists are drawn from them."""
    words = _word_counts(docs).persist()
    try:
        whole = words.orderBy(F.desc("n"), "word").limit(WHOLE_WORDS).select(F.col("word").alias("token"))
        first = words.where(F.length("word") < 8).groupBy(F.substring("word", 1, 1).alias("token")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(FIRST_CHARS).select("token")
        spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i in range(2, 8) for k in (1, 2, 3)])
        inner = words.where("n >= 3").withColumn("s", F.explode(spans)).where("s.i + s.k - 1 <= length(word)").select(F.concat(F.lit("##"), F.expr("substring(word, s.i, s.k)")).alias("token"))
        inner = inner.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(PIECES).select("token")
        every = whole.union(first).union(inner).distinct().orderBy("token").collect()  # WHOLE_WORDS + FIRST_CHARS + PIECES at most
    finally:
        words.unpersist()
    return {r[0]: 103 + i for i, r in enumerate(every)}


_made: dict[tuple, tuple] = {}


def _once(spark: SparkSession, sf_dir: str, derive: Callable[[DataFrame], object]):
    """What is derived from the documents, which stands for a model's file: made once an application, as a file is loaded once, and again if the
    table's files have changed."""
    files = table(spark, sf_dir, "documents").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_size").alias("size"))
    version = files.distinct().agg(F.count(F.lit(1)), F.max("at"), F.sum("size"), F.sum(F.xxhash64("path", "at", "size").cast("decimal(38,0)"))).first()
    key = spark.sparkContext.applicationId, sf_dir, derive.__name__
    if key not in _made or _made[key][0] != version:
        _made[key] = version, derive(_dealt(spark, sf_dir))
    return _made[key][1]


def _vocabulary(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return _once(spark, sf_dir, derived_vocabulary)


#: Words w(word, n), vocabulary v(tok, id, cont, body, len), and ids of every word: wp(word, ids).
_WP = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({_NORMAL.format('text')}, '[\p{{L}}\p{{N}}]+') AS ws FROM documents)
), w AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
toks AS (
  SELECT * FROM (SELECT word AS tok FROM w ORDER BY n DESC, word LIMIT {WHOLE_WORDS})
  UNION SELECT * FROM (SELECT substr(word, 1, 1) AS tok FROM w WHERE length(word) < 8 GROUP BY 1 ORDER BY count(*) DESC, tok LIMIT {FIRST_CHARS})
  UNION SELECT * FROM (SELECT '##' || substr(word, i::INT, k::INT) AS tok FROM w, range(2, 8) a(i), range(1, 4) b(k) WHERE n >= 3 AND i + k - 1 <= length(word) GROUP BY 1 ORDER BY count(*) DESC, tok LIMIT {PIECES})
), v AS (
  SELECT tok, id, starts_with(tok, '##') AS cont, CASE WHEN starts_with(tok, '##') THEN substr(tok, 3) ELSE tok END AS body, length(CASE WHEN starts_with(tok, '##') THEN substr(tok, 3) ELSE tok END) AS len
  FROM (SELECT tok, 102 + row_number() OVER (ORDER BY tok) AS id FROM toks)
), r(word, pos, ids) AS (
  SELECT word, 0::BIGINT, []::BIGINT[] FROM w
  UNION ALL
  SELECT r.word, r.pos + max(v.len), list_append(any_value(r.ids), arg_max(v.id, v.len))
  FROM r JOIN v ON v.cont = (r.pos > 0) AND v.len <= length(r.word) - r.pos AND v.body = substr(r.word, r.pos + 1, v.len)
  WHERE r.pos < length(r.word) GROUP BY r.word, r.pos
), wp AS (
  SELECT w.word, coalesce(any_value(r.ids), [100]) AS ids FROM w LEFT JOIN r ON r.word = w.word AND r.pos = length(w.word) GROUP BY w.word
), content AS (
  SELECT d.doc_id, coalesce(c.ids, []::BIGINT[]) AS ids FROM documents d LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM dw JOIN wp USING (word) GROUP BY doc_id) c USING (doc_id)
)"""


@query(_WP + "SELECT word, array_to_string(ids, ' ') AS ids FROM wp")
def wordpiece(spark, sf_dir):
    words = _word_counts(_dealt(spark, sf_dir))
    tokenizer = sub_words.BertTokenizer(spark, _vocabulary(spark, sf_dir))
    return words.select("word", F.array_join(tokenizer.word_ids(F.array("word")), " ").alias("ids"))


def _encoded(spark: SparkSession, sf_dir: str, max_length: int = MAX_LENGTH) -> DataFrame:
    tokenizer = sub_words.BertTokenizer(spark, _vocabulary(spark, sf_dir), max_length=max_length)
    return _dealt(spark, sf_dir).select("doc_id", tokenizer.encode(F.col("text")).alias("t"))


_FRAME = f"list_concat([101], ids[1:{MAX_LENGTH - 2}], [102])"


@query(_WP + f"SELECT doc_id, array_to_string(list_resize({_FRAME}, {MAX_LENGTH}, 0), ' ') AS input_ids, len(ids) > {MAX_LENGTH - 2} AS truncated FROM content")
def bert_encode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.array_join("t.input_ids", " ").alias("input_ids"), "t.truncated")


@query(_WP + f"SELECT doc_id, array_to_string(list_resize([1 FOR x IN {_FRAME}], {MAX_LENGTH}, 0), '') AS mask FROM content")
def attention_mask(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.array_join("t.attention_mask", "").alias("mask"))


@query(f"SELECT doc_id, repeat('0', {MAX_LENGTH}) AS types FROM documents")
def token_type_ids(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.array_join("t.token_type_ids", "").alias("types"))


@query(_WP + f"SELECT doc_id, least(len(ids) + 2, {MAX_LENGTH})::BIGINT AS n_tokens FROM content")
def token_counts(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", tokens.real_tokens(F.col("t.attention_mask")).alias("n_tokens"))


@query(_WP + f"SELECT (len(ids) > {MAX_LENGTH - 2}) AS truncated, count(*) AS n_texts, sum(len(ids))::BIGINT AS n_ids, max(len(ids))::BIGINT AS longest FROM content GROUP BY 1")
def truncation_report(spark, sf_dir):
    tokenizer = sub_words.BertTokenizer(spark, _vocabulary(spark, sf_dir), max_length=MAX_LENGTH)
    rows = _dealt(spark, sf_dir).select(tokenizer.content_ids(F.col("text")).alias("ids"))
    return rows.groupBy(tokens.truncated(F.col("ids"), MAX_LENGTH).alias("truncated")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("ids")).alias("n_ids"), F.max(F.size("ids")).cast("long").alias("longest"))


@query(_WP + f"SELECT doc_id, string_agg(coalesce(tok, '[UNK]'), ' ' ORDER BY pos) AS tokens FROM (SELECT doc_id, unnest({_FRAME}) AS id, generate_subscripts({_FRAME}, 1) AS pos FROM content) LEFT JOIN v USING (id) GROUP BY doc_id")
def bert_decode(spark, sf_dir):
    tokenizer = sub_words.BertTokenizer(spark, _vocabulary(spark, sf_dir), max_length=MAX_LENGTH)
    ids = tokens.framed(tokenizer.content_ids(F.col("text")), tokens.BERT, MAX_LENGTH)
    return _dealt(spark, sf_dir).select("doc_id", ids.alias("ids")).select("doc_id", F.array_join(tokenizer.decode(F.col("ids")), " ").alias("tokens"))


def _metaspace_words(text: str) -> Column:
    return F.regexp_extract_all(T.metaspace(T.collapse_spaces(F.col(text))), F.lit("▁[^▁]*"), 0)


def _metaspace_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(_metaspace_words("text")).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def _best_pieces(words: DataFrame) -> dict[str, tuple[int, float]]:
    """Of counted metaspace words and their single characters, the most frequent of each, scored by the logarithm of their share, to six places."""
    chars = words.select(F.explode(F.split("piece", "")).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n")).where("piece <> ''")
    top = words.where("length(piece) > 1").orderBy(F.desc("n"), "piece").limit(WHOLE_WORDS).collect() + chars.orderBy(F.desc("n"), "piece").limit(FIRST_CHARS).collect()
    total = sum(r["n"] for r in top)
    return {r["piece"]: (4 + i, round(log(r["n"] / total), 6)) for i, r in enumerate(sorted(top, key=lambda r: r["piece"]))}


def derived_pieces(docs: DataFrame) -> dict[str, tuple[int, float]]:
    words = _metaspace_counts(docs).persist()
    try:
        return _best_pieces(words)
    finally:
        words.unpersist()


def _xlmr(spark: SparkSession, sf_dir: str) -> unigram.XlmrTokenizer:
    return unigram.XlmrTokenizer(spark, _once(spark, sf_dir, derived_pieces), charsmap.build(derived_map()), max_length=MAX_LENGTH)


_MAPPED = "replace(replace(replace(translate(text, (SELECT string_agg(chr(65248 + c::INT), '' ORDER BY c) FROM range(33, 127) r(c)), (SELECT string_agg(chr(c::INT), '' ORDER BY c) FROM range(33, 127) r(c))), chr(160), ' '), chr(12288), ' '), '…', '...')"
for _plain, _accented in zip("aeiou", "áéíóú", strict=True):
    _MAPPED = f"replace({_MAPPED}, '{_plain}' || chr(769), '{_accented}')"
#: Pieces v(tok, id, len, score), and the best segmentation of every word, position by position: of equal sums the one whose last
#: piece is longest, an unknown character last. content(doc_id, ids).
_UNIGRAM = rf"""
WITH RECURSIVE raw AS (
  SELECT {_META.format("regexp_replace(text, ' {2,}', ' ', 'g')")} AS t FROM documents
), whole AS (SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '▁[^▁]*')) AS piece FROM raw) GROUP BY piece
), chars AS (SELECT piece, sum(n)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(piece, '(?s).')) AS piece, n FROM whole) GROUP BY piece
), tops AS (
  (SELECT * FROM whole WHERE length(piece) > 1 ORDER BY n DESC, piece LIMIT {WHOLE_WORDS}) UNION ALL (SELECT * FROM chars ORDER BY n DESC, piece LIMIT {FIRST_CHARS})
), v AS (
  SELECT piece AS tok, length(piece) AS len, 3 + row_number() OVER (ORDER BY piece) AS id, round(ln(n::DOUBLE / (SELECT sum(n) FROM tops)::DOUBLE), 6) AS score FROM tops
), unknown AS (SELECT min(score) - {unigram.UNKNOWN_PENALTY}::DOUBLE AS score, max(len) AS longest FROM v
), dw AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all({_META.format('c')}, '[^▁]+|▁[^▁]*') AS ws FROM (SELECT doc_id, regexp_replace({_MAPPED}, ' {{2,}}', ' ', 'g') AS c FROM documents))
), w AS (SELECT DISTINCT word FROM dw
), best(word, n, score, paths) AS (
  SELECT word, 0::BIGINT, [0.0::DOUBLE], [[]::BIGINT[]] FROM w
  UNION ALL
  SELECT word, n + 1, list_append(any_value(score), max(total)), list_append(any_value(paths), arg_max(path, [total, len::DOUBLE]))
  FROM (
    SELECT b.word, b.n, b.score, b.paths, b.score[b.n + 2 - v.len] + v.score AS total, list_append(b.paths[b.n + 2 - v.len], v.id) AS path, v.len
    FROM (SELECT b.*, unnest(range(1, least(b.n + 1, u.longest) + 1)) AS k FROM best b, unknown u WHERE b.n < length(b.word)) b JOIN v ON v.len = b.k AND v.tok = substr(b.word, b.n + 2 - b.k, b.k)
    UNION ALL
    SELECT b.word, b.n, b.score, b.paths, b.score[b.n + 1] + u.score, list_append(b.paths[b.n + 1], 3), 0 FROM best b, unknown u WHERE b.n < length(b.word)
  ) GROUP BY word, n
), solved AS (SELECT word, paths[n + 1] AS ids FROM best WHERE n = length(word)
), joined AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM dw JOIN solved USING (word) GROUP BY doc_id
), content AS (
  SELECT d.doc_id, coalesce(list_filter(j.ids, lambda x, i: NOT (x = 3 AND i > 1 AND j.ids[i - 1] = 3)), []::BIGINT[]) AS ids FROM documents d LEFT JOIN joined j USING (doc_id)
)"""


@query(_UNIGRAM + "SELECT doc_id, array_to_string(ids, ' ') AS ids FROM content")
def unigram_tokenize(spark, sf_dir):
    return _dealt(spark, sf_dir).select("doc_id", F.array_join(_xlmr(spark, sf_dir).content_ids(F.col("text")), " ").alias("ids"))


def _top_pairs(docs: DataFrame, words: DataFrame | None) -> list:
    """The PAIRS most frequent pairs p(a, b) of words that follow one another, and their number n; with words(piece), of pairs of these only."""
    pairs = docs.select(_metaspace_words("text").alias("w")).select(F.explode(F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    if words is not None:
        for side in ("a", "b"):
            pairs = pairs.join(F.broadcast(words.select(F.col("piece").alias("own"))), F.col(f"p.{side}") == F.col("own"), "left_semi")
    return pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(PAIRS).collect()


def frequent_pairs(docs: DataFrame, words: DataFrame, known: list[str]) -> list:
    """The PAIRS most frequent pairs of docs(text), whose words(piece, n) are counted. No word is rarer than a pair that it is in, so the last of the
    best pairs of known words says which other words can be in a better one: rare words, most of a corpus, aren't paired."""
    top = _top_pairs(docs, docs.sparkSession.createDataFrame([(w,) for w in known], "piece string")) if known else []
    if len(top) < PAIRS:
        return _top_pairs(docs, None)
    often = words.where(F.col("n") >= top[-1]["n"])
    number = often.count()
    if not often.join(docs.sparkSession.createDataFrame([(w,) for w in known], "piece string"), "piece", "left_anti").count():
        return top
    return _top_pairs(docs, often if number <= BROADCAST_ROWS else None)


def derived_spans(docs: DataFrame) -> dict[str, tuple[int, float]]:
    """The derived pieces and, besides them, the most frequent pairs of words as one piece each, which scores as its better word does."""
    words = _metaspace_counts(docs).persist()
    try:
        pieces = _best_pieces(words)
        top = frequent_pairs(docs, words, [p for p in pieces if len(p) > 1])
    finally:
        words.unpersist()
    for r in top:
        a, b = r["p"]
        if a in pieces and b in pieces and a + b not in pieces:
            pieces[a + b] = len(pieces) + 4, max(pieces[a][1], pieces[b][1])
    return pieces


@query()
def unigram_spanning(spark, sf_dir):
    """Pieces that reach over the start of a word: the lattice is that of the whole text. SQL would need a step for each character of the longest text."""
    tokenizer = unigram.XlmrTokenizer(spark, _once(spark, sf_dir, derived_spans), charsmap.build(derived_map()), max_length=MAX_LENGTH)
    return _dealt(spark, sf_dir).select("doc_id", F.array_join(tokenizer.content_ids(F.col("text")), " ").alias("ids"))


_XLMR_FRAME = f"list_concat([0], ids, [2])[1:{MAX_LENGTH}]"


@query(_UNIGRAM + f"SELECT doc_id, array_to_string(list_resize({_XLMR_FRAME}, {MAX_LENGTH}, 1), ' ') AS input_ids, array_to_string(list_resize([1 FOR x IN {_XLMR_FRAME}], {MAX_LENGTH}, 0), '') AS mask, len(ids) > {MAX_LENGTH - 2} AS truncated FROM content")
def xlmr_encode(spark, sf_dir):
    rows = _dealt(spark, sf_dir).select("doc_id", _xlmr(spark, sf_dir).encode(F.col("text")).alias("t"))
    return rows.select("doc_id", F.array_join("t.input_ids", " ").alias("input_ids"), F.array_join("t.attention_mask", "").alias("mask"), "t.truncated")


@query(_UNIGRAM + "SELECT doc_id, array_to_string(list_concat([0], ids, [2]), ' ') AS ids FROM content")
def xlmr_expected_ids(spark, sf_dir):
    """By a tokenizer file's text that holds the pieces, behind four sentinels, and the character map."""
    pieces = sorted(_once(spark, sf_dir, derived_pieces).items(), key=lambda x: x[1][0])
    vocab = [[t, 0.0] for t in ("<s>", "<pad>", "</s>", "<unk>")] + [[p, score] for p, (_, score) in pieces]
    blob = base64.b64encode(charsmap.build(derived_map())).decode()
    file = json.dumps({"normalizer": {"normalizers": [{"type": "Precompiled", "precompiled_charsmap": blob}]}, "model": {"vocab": vocab}})
    tokenizer = unigram.XlmrTokenizer(spark, *unigram.pieces_of_json(file), max_length=MAX_LENGTH)
    return _dealt(spark, sf_dir).select("doc_id", F.array_join(tokenizer.whole_ids(F.col("text")), " ").alias("ids"))


@query("SELECT regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS token, max(doc_id)::BIGINT AS id FROM documents GROUP BY 1")
def vocabulary_lines(spark, sf_dir):
    """The first line of every document as a line of a vocabulary."""
    lines = _documents(spark, sf_dir).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    return sub_words.vocabulary_table(lines, "doc_id", "line")


# ---- embedding and vectors ------------------------------------------------------------------------------------------

_EMBED = _WP + f"""
, framed AS (SELECT doc_id, list_concat([101], ids[1:{MAX_LENGTH - 2}], [102]) AS ids FROM content),
pooled AS (
  SELECT doc_id, list_transform(range(0, {EMBED_DIMENSIONS}), lambda d: (list_reduce(list_prepend(0.0::FLOAT, list_transform(ids, lambda i: ((((i * 31 + d * 17) % 2003) / 1001.0::DOUBLE) - 1.0::DOUBLE)::FLOAT)), lambda x, y: (x + y)::FLOAT) / len(ids)::FLOAT)::FLOAT) AS v FROM framed
), normed AS (SELECT doc_id, v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), lambda x, y: x + y)) AS n FROM pooled)
"""


@query(_EMBED + "SELECT doc_id, pos - 1 AS pos, (CASE WHEN n = 0 THEN x ELSE (x::DOUBLE / n)::FLOAT END) AS value FROM (SELECT doc_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM normed)")
def embed_documents(spark, sf_dir):
    tokenizer = sub_words.BertTokenizer(spark, _vocabulary(spark, sf_dir), max_length=MAX_LENGTH)
    made = embed.Embedder(tokenizer, HashBackend(EMBED_DIMENSIONS), model_id="hash").embed(_dealt(spark, sf_dir))
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


_POOLED = "list_transform(range(0, 8), lambda k: CASE WHEN vec_id % 9 = 0 THEN 0.0::FLOAT ELSE (list_reduce([0.0::FLOAT] || list_transform(range(0, vec_id % 9), lambda t: embedding[t * 8 + k + 1]), lambda x, y: (x + y)::FLOAT) / (vec_id % 9)::FLOAT)::FLOAT END)"


@query(f"SELECT vec_id, pos - 1 AS pos, value FROM (SELECT vec_id, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM (SELECT vec_id, {_POOLED} AS v FROM embeddings))")
def mean_pool(spark, sf_dir):
    """A vector of 64 as 8 tokens of 8 dimensions, of which vec_id % 9 count."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (t < F.col("vec_id") % 9).cast("int"))
    pooled = vector.mean_pool(F.col("embedding"), mask, 8)
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(pooled).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


_TRIPLED = "list_transform(embedding, lambda x: (x * 3)::FLOAT)"
_NORM = "sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform({}, lambda x: x::DOUBLE * x::DOUBLE)), lambda x, y: x + y))"


@query(f"SELECT vec_id, pos - 1 AS pos, (x::DOUBLE / n)::FLOAT AS value FROM (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT vec_id, {_TRIPLED} AS v, {_NORM.format(_TRIPLED)} AS n FROM embeddings))")
def l2_normalize(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: (x * 3).cast("float"))
    rows = _vectors(spark, sf_dir).select("vec_id", tripled.alias("v"))
    return rows.select("vec_id", F.posexplode(vector.l2_normalize(F.col("v"))).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT vec_id, {_NORM.format('embedding')} AS norm FROM embeddings")
def vector_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", vector.norm(F.col("embedding")).alias("norm"))


_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


@query(f"SELECT a.vec_id AS qid, b.vec_id AS did, {_DOT.format('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 5")
def cosine_pairs(spark, sf_dir):
    """Each vector with the five that follow it by id: an equality join on the shifted id."""
    v = _vectors(spark, sf_dir)
    left = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 5)).alias("did"))
    return left.join(v.select(F.col("vec_id").alias("did"), F.col("embedding").alias("d")), "did").select("qid", "did", vector.dot(F.col("q"), F.col("d")).alias("score"))


def _sides(v: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose id divides by 100; candidates are all."""
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col(column).alias("q")), v.select(F.col("vec_id").alias("did"), F.col(column).alias("d"))


_RANKED = """SELECT qid, did, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did)::INT AS rank
FROM (SELECT a.vec_id AS qid, b.vec_id AS did, round({}, 6) AS score FROM {} a, {} b WHERE a.vec_id % 100 = 0)"""
_RANK_SQL = _RANKED.format(_DOT.format("a.embedding", "b.embedding"), "embeddings", "embeddings")


@query(_RANK_SQL)
def rank_by_similarity(spark, sf_dir):
    ranks = ranking.rank_all(*_sides(_vectors(spark, sf_dir)))
    return ranks.withColumn("rank", F.col("rank").cast("int"))


@query(f"SELECT * FROM ({_RANK_SQL}) WHERE rank <= {TOP_K}")
def knn_topk(spark, sf_dir):
    return ranking.knn(*_sides(_vectors(spark, sf_dir)), TOP_K)


@query(f"SELECT * FROM ({_RANK_SQL.replace('WHERE a.vec_id % 100 = 0', '')}) WHERE rank <= {TOP_K}")
def knn_every_vector(spark, sf_dir):
    """Every vector as a query: where the queries are too large for a broadcast, over a grid of tiles."""
    v = _vectors(spark, sf_dir)
    return ranking.knn(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("did"), F.col("embedding").alias("d")), TOP_K)


@query(f"SELECT vec_id, round({_DOT.format('embedding', 'embedding')}, 6) AS score FROM embeddings")
def self_similarity(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", ranking.score(F.col("embedding"), F.col("embedding")).alias("score"))


# ---- quantisation ---------------------------------------------------------------------------------------------------

_CODES = "list_transform(embedding, lambda x: least(255, greatest(0, round((x::DOUBLE + 1) / 2 * 255.0::DOUBLE)::INT)))"
_BACK = f"list_transform({_CODES}, lambda u: (u::DOUBLE / 255.0::DOUBLE * 2 - 1)::FLOAT)"
_QUANTISED = f"(SELECT vec_id, embedding, {_CODES} AS codes, {_BACK} AS back FROM embeddings)"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    return v.withColumn("codes", sq8.quantise(F.col("embedding"))).withColumn("back", sq8.dequantise(F.col("codes")))


@query(f"SELECT vec_id, array_to_string(codes, ' ') AS codes FROM {_QUANTISED}")
def sq8_quantise(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", F.array_join("codes", " ").alias("codes"))


@query(f"SELECT vec_id, unnest(back) AS value, generate_subscripts(back, 1) - 1 AS pos FROM {_QUANTISED}")
def sq8_dequantise(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", F.posexplode("back").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


_ERRORS = "list_transform(list_zip(embedding, back), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))"


@query(f"SELECT vec_id, list_max({_ERRORS}) AS worst, round(list_sum({_ERRORS}) / len(back), 9) AS mean FROM {_QUANTISED}")
def sq8_roundtrip_error(spark, sf_dir):
    rows = _coded(spark, sf_dir).withColumn("e", sq8.errors(F.col("embedding"), F.col("back")))
    return rows.select("vec_id", F.array_max("e").alias("worst"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.size("e"), 9).alias("mean"))


@query(f"SELECT vec_id, (len(embedding) * 4)::INT AS float_bytes, len(codes)::INT AS sq8_bytes, round(100.0::DOUBLE * len(codes) / (len(embedding) * 4), 2) AS percent, (len(embedding) * 4) / len(codes)::DOUBLE AS ratio FROM {_QUANTISED}")
def sq8_storage(spark, sf_dir):
    full, small = F.size("embedding") * 4, F.length(sq8.to_binary(F.col("codes")))
    return _coded(spark, sf_dir).select("vec_id", full.alias("float_bytes"), small.alias("sq8_bytes"), F.round(F.lit(100.0) * small / full, 2).alias("percent"), (full / small).alias("ratio"))


@query(f"SELECT qid, did, round(exact, 6) AS exact, round(coded, 6) AS coded, round(abs(exact - coded), 6) AS delta FROM (SELECT a.vec_id AS qid, b.vec_id AS did, {_DOT.format('a.embedding', 'b.embedding')} AS exact, {_DOT.format('a.back', 'b.back')} AS coded FROM {_QUANTISED} a JOIN {_QUANTISED} b ON b.vec_id = a.vec_id + 1)")
def sq8_score_delta(spark, sf_dir):
    v = _coded(spark, sf_dir).drop("codes")
    other = v.select((F.col("vec_id") - 1).alias("qid"), F.col("vec_id").alias("did"), F.col("embedding").alias("d"), F.col("back").alias("d_back"))
    exact, coded = vector.dot(F.col("embedding"), F.col("d")), vector.dot(F.col("back"), F.col("d_back"))
    return v.withColumnRenamed("vec_id", "qid").join(other, "qid").select("qid", "did", F.round(exact, 6).alias("exact"), F.round(coded, 6).alias("coded"), F.round(F.abs(exact - coded), 6).alias("delta"))


_SQ8_RANK = _RANKED.format(_DOT.format("a.back", "b.back"), _QUANTISED, _QUANTISED)


@query(f"SELECT * FROM ({_SQ8_RANK}) WHERE rank <= {TOP_K}")
def sq8_knn_topk(spark, sf_dir):
    return ranking.knn(*_sides(_coded(spark, sf_dir).select("vec_id", "back"), "back"), TOP_K)


@query(f"SELECT * FROM ({_SQ8_RANK}) WHERE rank <= {TOP_K}")
def sq8_knn_stored(spark, sf_dir):
    """The same from the vector store, by its bytes."""
    store = scratch(spark, "vectors")
    tables.write_vectors(_vectors(spark, sf_dir).select("vec_id", F.lit(C.DEFAULT_MODEL).alias("model_id"), "embedding"), store, key="vec_id")
    stored = spark.read.parquet(store)
    return ranking.knn_stored(stored.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "sq8"), stored.select(F.col("vec_id").alias("did"), "sq8"), TOP_K)


@query(f"SELECT a.qid, count(b.did) AS overlap FROM (SELECT * FROM ({_RANK_SQL}) WHERE rank <= {TOP_K}) a LEFT JOIN (SELECT * FROM ({_SQ8_RANK}) WHERE rank <= {TOP_K}) b ON a.qid = b.qid AND a.did = b.did GROUP BY a.qid")
def sq8_rank_overlap(spark, sf_dir):
    """How many of the nearest by exact scores are so by quantised ones: the order is nearly, not quite, kept."""
    exact, coded = knn_topk(spark, sf_dir).select("qid", "did"), sq8_knn_topk(spark, sf_dir).select("qid", "did", F.lit(1).alias("hit"))
    return exact.join(coded, ["qid", "did"], "left").groupBy("qid").agg(F.count("hit").alias("overlap"))


# ---- catalog --------------------------------------------------------------------------------------------------------


def _sql(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


_MODELS = "(VALUES " + ", ".join(f"({i}, {', '.join(_sql(x) for x in (m.id, m.dimensions, m.tokenizer_family, m.query_prefix, m.document_prefix, m.validated))})" for i, m in enumerate(C.MODELS)) + ") m(position, id, dimensions, tokenizer_family, query_prefix, document_prefix, validated)"
#: Every document wants a model by its id's remainder; one of the four isn't registered.
_WANTED = "(SELECT doc_id, ['bge-small-en-v1.5', 'multilingual-e5-small', 'placeholder-model', 'no-such-model'][(doc_id % 4 + 1)::INT] AS model_id FROM documents)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(*[F.lit(m.id) for m in C.MODELS], F.lit("no-such-model"))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(ids, (F.col("doc_id") % 4 + 1).cast("int")).alias("model_id"))


@query(f"SELECT * FROM {_MODELS}")
def catalog_all(spark, sf_dir):
    return C.Catalog().rows(spark)


@query(f"SELECT id, dimensions, tokenizer_family FROM {_MODELS} WHERE validated")
def catalog_validated(spark, sf_dir):
    return C.Catalog().rows(spark).where(F.coalesce("validated", F.lit(False))).select("id", "dimensions", "tokenizer_family")


@query(f"SELECT doc_id, model_id, model_id IN (SELECT id FROM {_MODELS}) AS known FROM {_WANTED}")
def catalog_is_known(spark, sf_dir):
    known = C.Catalog().rows(spark).select(F.col("id").alias("model_id"), F.lit(True).alias("known"))
    return _wanted(spark, sf_dir).join(F.broadcast(known), "model_id", "left").select("doc_id", "model_id", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"SELECT doc_id, model_id FROM {_WANTED} WHERE model_id IN (SELECT id FROM {_MODELS})")
def allowlist_semi(spark, sf_dir):
    return C.Catalog().permitted(_wanted(spark, sf_dir)).select("doc_id", "model_id")


@query(f"SELECT doc_id, model_id FROM {_WANTED} WHERE model_id NOT IN (SELECT id FROM {_MODELS})")
def allowlist_anti(spark, sf_dir):
    return C.Catalog().refused(_wanted(spark, sf_dir)).select("doc_id", "model_id")


#: Documents as files, and besides them a damaged, a missing and an extra one.
_EXPECTED = "(SELECT doc_id::VARCHAR AS name, sha256(text) AS expected FROM documents UNION ALL VALUES ('damaged', sha256('whole')), ('missing', sha256('m')))"
_FOUND = "(SELECT doc_id::VARCHAR AS name, sha256(text) AS actual FROM documents UNION ALL VALUES ('damaged', sha256('part')), ('extra', sha256('e')))"


@query(f"SELECT coalesce(e.name, a.name) AS name, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' WHEN expected = actual THEN 'ok' ELSE 'mismatch' END AS status FROM {_EXPECTED} e FULL JOIN {_FOUND} a ON e.name = a.name")
def manifest_verify(spark, sf_dir):
    files = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "text")
    digests = lambda *more: files.unionByName(spark.createDataFrame(list(more), "name string, text string")).select("name", F.sha2("text", 256).alias("sha256"))
    return C.verified(digests(("damaged", "whole"), ("missing", "m")), digests(("damaged", "part"), ("extra", "e")))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def archive_members(spark, sf_dir):
    """All documents as members of zip archives, read back."""
    rows = _dealt(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    members = archive.unpacked(archive.packed(rows), "archive").where("error is null")
    return members.select(F.col("member").cast("long").alias("doc_id"), "size", F.sha2("content", 256).alias("sha256"))


@query("""SELECT line FROM (SELECT '  ' || to_json(doc_id::VARCHAR) || ': ' || to_json(text) || CASE WHEN row_number() OVER (ORDER BY doc_id::VARCHAR DESC) = 1 THEN '' ELSE ',' END AS line FROM documents)
UNION ALL VALUES ('{'), ('}')""")
def json_object(spark, sf_dir):
    """The lines of the documents' object, whose fragments were written in order."""
    path = scratch(spark, "object")
    tables.write_json_object(_documents(spark, sf_dir), path, "doc_id")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT vec_id, CASE WHEN label % 3 = 0 THEN NULL WHEN label % 3 = 1 THEN 'bge-small-en-v1.5' ELSE 'old-model' END AS model_id FROM embeddings WHERE label % 3 <> 1")
def stale_vectors(spark, sf_dir):
    made_by = F.when(F.col("label") % 3 == 0, F.lit(None).cast("string")).when(F.col("label") % 3 == 1, C.DEFAULT_MODEL).otherwise("old-model")
    return C.stale(_vectors(spark, sf_dir).select("vec_id", made_by.alias("model_id")), C.DEFAULT_MODEL)


@query(f"SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || ' (2)' ELSE text END) AS sha256, CASE WHEN lang = 'de' THEN 2 ELSE 1 END::BIGINT AS embedded_in, {EMBED_DIMENSIONS} AS dimensions FROM documents")
def vector_store_state(spark, sf_dir):
    """All documents; then those of one language go and those of another change; then the first ones come back, whose vectors are there."""
    docs = dealt(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang")
    tokenizer = sub_words.BertTokenizer(spark, _vocabulary(spark, sf_dir), max_length=MAX_LENGTH)
    made = embed.Embedder(tokenizer, HashBackend(EMBED_DIMENSIONS), model_id="hash")
    store = VectorStore(spark, scratch(spark, "store"), "doc_id long")
    gone, changed = F.col("lang") == "fr", F.col("lang") == "de"
    for batch in (docs, docs.where(gone | changed).withColumns({"deleted": gone, "text": F.concat("text", F.lit(" (2)"))}), docs.where(gone)):
        store.apply(batch, made.embed, "hash")
    return store.state("hash").select("doc_id", F.col("digest").alias("sha256"), "embedded_in", F.size("embedding").alias("dimensions"))


@query(f"SELECT w.model_id, CASE WHEN m.id IS NULL THEN 'unknown' WHEN m.validated THEN 'ok' ELSE 'not validated' END AS status, count(*) AS n FROM {_WANTED} w LEFT JOIN {_MODELS} ON m.id = w.model_id GROUP BY 1, 2")
def catalog_lookup(spark, sf_dir):
    """What the gated lookup says to each of the models that documents want; it is asked once a model, on the driver."""

    def said(model_id: str) -> str:
        try:
            C.Catalog().lookup(model_id)
        except C.UnvalidatedModelError:
            return "not validated"
        except ValueError:
            return "unknown"
        return "ok"

    status = spark.createDataFrame([(m, said(m)) for m in (*(x.id for x in C.MODELS), "no-such-model")], "model_id string, status string")
    return _wanted(spark, sf_dir).groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(status), "model_id").select("model_id", "status", "n")


# ---- corpus tools ---------------------------------------------------------------------------------------------------

#: The corpus has no blank lines: line ends become blank lines, and sentences lines.
_BLOCKY = r"replace(replace(text, '.' || chr(10), '.' || chr(10) || '  ' || chr(10)), '. ', '.' || chr(10))"
_BLOCKS = rf"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split({_BLOCKY}, chr(10)) AS ls FROM documents)
), marked AS (
  SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, sum((regexp_replace(raw, '\s+', '', 'g') = '')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS breaks FROM lines
), block AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY breaks) AS block, count(*) AS n_lines, string_agg(line, ' ' ORDER BY pos) AS body, string_agg(line, ' ' ORDER BY pos) FILTER (pos > first) AS rest
  FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, breaks) AS first FROM marked WHERE line <> '') GROUP BY doc_id, breaks
)"""


def _blocky(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(".\n"), F.lit(".\n  \n")), F.lit(". "), F.lit(".\n"))
    return _dealt(spark, sf_dir).select("doc_id", text.alias("text"))


@query(_BLOCKS + "SELECT doc_id, block, n_lines, body FROM block")
def block_split(spark, sf_dir):
    rows = _blocky(spark, sf_dir).select("doc_id", F.posexplode(corpus.blocks(F.col("text"))).alias("block", "lines"))
    return rows.select("doc_id", (F.col("block") + 1).cast("long").alias("block"), F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", " ").alias("body"))


@query(_BLOCKS + ", anchor AS (SELECT doc_id, arg_max(block, length(body) * 10 - block) AS at FROM block WHERE block <= 4 GROUP BY doc_id) SELECT d.doc_id, coalesce(b.rest, b.body) AS passage FROM documents d LEFT JOIN anchor a ON a.doc_id = d.doc_id LEFT JOIN block b ON b.doc_id = d.doc_id AND b.block = a.at + 1")
def block_after_longest(spark, sf_dir):
    rows = _blocky(spark, sf_dir).select("doc_id", corpus.blocks(F.col("text")).alias("blocks"))
    return rows.select("doc_id", corpus.block_after_longest(F.col("blocks")).alias("passage"))


@query(_BLOCKS + ", full_lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM marked WHERE line <> ''), heads AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM full_lines WHERE length(line) <= 20) SELECT d.doc_id, f.line FROM documents d LEFT JOIN heads h ON h.doc_id = d.doc_id AND h.k = 2 LEFT JOIN full_lines f ON f.doc_id = d.doc_id AND f.i = h.i + 1")
def line_after_second_heading(spark, sf_dir):
    rows = _blocky(spark, sf_dir).select("doc_id", corpus.lines(F.col("text")).alias("lines"))
    return rows.select("doc_id", corpus.line_after_second_heading(F.col("lines")).alias("line"))


@query("SELECT doc_id, NOT length(text) BETWEEN 20 AND 900 AS flagged FROM documents")
def length_plausibility(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", corpus.implausible(F.col("text")).alias("flagged"))


@query(_BLOCKS + r", counted AS (SELECT doc_id, block, body, len(regexp_split_to_array(body, '\s+')) AS n FROM block), run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY block) - n AS before FROM counted) SELECT d.doc_id, coalesce(string_agg(body, ' ' ORDER BY block), '') AS passage, coalesce(sum(n), 0)::INT AS n_words FROM documents d LEFT JOIN run r ON r.doc_id = d.doc_id AND before < 380 GROUP BY d.doc_id")
def accumulate_until_words(spark, sf_dir):
    made = corpus.accumulated(F.col("blocks"))
    return _blocky(spark, sf_dir).select("doc_id", corpus.blocks(F.col("text")).alias("blocks")).select("doc_id", made.alias("m")).select("doc_id", F.col("m.text").alias("passage"), F.col("m.n").alias("n_words"))


@query(_BLOCKS + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM block WHERE block = 2)")
def skip_list(spark, sf_dir):
    """Documents without a second block, which no passage can be taken from."""
    rows = _blocky(spark, sf_dir)
    made = rows.where(F.size(corpus.blocks(F.col("text"))) >= 2)
    return corpus.skipped(rows.select("doc_id"), made.select("doc_id"), "doc_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
