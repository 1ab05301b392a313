"""Quality rules whose thresholds adapt to each language and source.

Base figures come from whole texts. Ratios of them go into mergeable quantile sketches: counts by logarithmic bucket (a
relative error of at most ``GAMMA`` - 1), one sketch for each (language, source, ratio). Merging is adding counts, so
partial sketches combine in any order to the same result, and those of a language or of all documents are sums of
their parts. From a sketch's median and tenth percentile each ratio gets fences that up to half of junk on one side can't
move: median ± (SPREAD times their distance + the ratio's slack). Cells of fewer than ``MIN_DOCUMENTS`` documents use
their language's sketch, or, if that is small too, that of all. Verdicts join documents with their cell's fences.

Defined results: a null or blank text has no words and fails the base rules; null languages and sources are cells of
their own; an empty table gives an empty result; repeated rows are judged alike; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import hot_join, small_batches, text_or_empty, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
GAMMA, LEAST = 1.02, 1e-3
SPREAD, MIN_DOCUMENTS = 6.0, 200
#: Cells (with their fences) that may be broadcast.
CELLS = 20_000
#: ratio: (slack, whether there is a lower fence)
SLACK = {"symbols_per_word": (0.1, False), "word_length": (0.75, True), "duplicate_lines": (0.5, False), "stuttered_words": (0.2, False)}
#: Characters that one pass of the word arrays handles.
CHUNK_CHARS = 1_000_000

BASE = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_stuttered long"
_WHITE = b" \t\n\x0b\x0c\r"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>")


def _codes(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0].astype(np.int64)


def repeated_words(lengths: list[int], words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each text (its number of words; words of all texts one after another), the words that lie in windows which
    occur twice or more in their text, and the words equal to the one before them. Windows get exact codes by doubling:
    code pairs of 1, 2, 4 ... words."""
    n = np.asarray(lengths, np.int64)
    out, same = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    total = int(n.sum())
    if not total:
        return out, same
    text = np.repeat(np.arange(len(n)), n)
    code = _codes(np.array(words, dtype=object))
    np.add.at(same, text[1:][(code[1:] == code[:-1]) & (text[1:] == text[:-1])], 1)
    if total < window:
        return out, same
    width = 1
    while width < window:
        step = min(width, window - width)  # the last step may overlap
        code = _codes(code[: len(code) - step] * (code.max() + 1) + code[step:])
        width += step
    inside = text[: len(code)] == text[window - 1 :]
    at = np.nonzero(inside)[0]
    if not len(at):
        return out, same
    key = _codes(code[at] * len(n) + text[at])
    twice = at[np.bincount(key)[key] > 1]
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    covered = np.cumsum(edges)[:-1] > 0
    np.add.at(out, text[covered], 1)
    return out, same


def base_figures(texts: list[str | None]) -> pd.DataFrame:
    rows, lengths, words = [], [], []
    for t in texts:
        t = t or ""
        b = t.encode("utf-8", "surrogatepass")
        own = b.split()
        lines = [x for x in b.split(b"\n") if x.split()]
        white = len(b) - len(b.translate(None, _WHITE))
        rows.append((len(own), len(t) - white, len(b.translate(None, _NOT_SYMBOL)), len(lines), len(lines) - len(set(lines)), 0, 0))
        lengths.append(len(own))
        words += own
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in BASE.split(", ")], dtype="int64")
    out["n_repeat_words"], out["n_stuttered"] = repeated_words(lengths, words)
    return out


def _base_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        texts, parts, chunk, chars = list(texts), [], [], 0
        for t in texts:
            chunk.append(t)
            chars += len(t or "")
            if chars >= CHUNK_CHARS:
                parts.append(base_figures(chunk))
                chunk, chars = [], 0
        parts.append(base_figures(chunk))
        yield pd.concat(parts, ignore_index=True)


def _ratios(base: Column) -> dict[str, Column]:
    words = F.greatest(base["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(base["n_lines"], F.lit(1)).cast("double")
    return {"symbols_per_word": base["n_symbols"] / words, "word_length": base["word_chars"] / words, "duplicate_lines": base["n_dup_lines"] / lines, "stuttered_words": base["n_stuttered"] / words}


def _base_failed(base: Column) -> Column:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


def measured(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[Column]) -> DataFrame:
    small_batches(docs.sparkSession)
    # a function that must not be evaluated twice, for a filter and again for its figures, passes as not deterministic
    base = F.pandas_udf(_base_batches, BASE).asNondeterministic()
    return docs.select(*carry, F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"), base(text_or_empty(text_col)).alias("__base"))


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, ratio, bucket, n) of rows(__lang, __source, __base) that pass the base rules, merged upward:
    level 0 holds cells, 1 languages, 2 everything."""
    ratios = _ratios(F.col("__base"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("value")) for k, v in ratios.items()]))
    bucket = F.when(F.col("x.value") < LEAST, 0).otherwise(F.ceil(F.log(F.col("x.value") / LEAST) / float(np.log(GAMMA))) + 1).cast("int")
    cells = rows.where(~_base_failed(F.col("__base"))).select("__lang", "__source", each.alias("x"))
    cells = cells.groupBy(F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("x.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return cells


def _merged(cells: DataFrame, level: int) -> DataFrame:
    by = [["lang", "source"], ["lang"], []][level]
    return cells.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n")) if level else cells


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, and a map of ratio to (low, high), n documents."""
    w = Window.partitionBy(*by, "ratio")
    seen = F.sum("n").over(w.orderBy("bucket"))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), F.col("bucket") - 1))
    ranked = sketch.withColumn("seen", seen).withColumn("all", F.sum("n").over(w)).withColumn("value", value)
    at = lambda q: F.min(F.when(F.col("seen") >= F.lit(q) * F.col("all"), F.col("value")))
    q = ranked.groupBy(*by, "ratio").agg(at(0.1).alias("q10"), at(0.5).alias("q50"), F.max("all").alias("n"))
    slack = F.create_map(*[F.lit(x) for k, (s, _) in SLACK.items() for x in (k, s)])[F.col("ratio")]
    lower = F.create_map(*[F.lit(x) for k, (_, low) in SLACK.items() for x in (k, low)])[F.col("ratio")]
    reach = SPREAD * (F.col("q50") - F.col("q10")) + slack
    fence = F.struct(F.when(lower, F.col("q50") - reach).otherwise(F.lit(float("-inf"))).alias("low"), (F.col("q50") + reach).alias("high"))
    return q.withColumn("fence", fence).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ratio", "fence"))).alias("fences"), F.max("n").alias("n"))


def thresholds(rows: DataFrame, *, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per (lang, source): fences, and the level of the sketch that they come from."""
    cells = written(sketches(rows), "sketches")
    own = _fences(cells, ["lang", "source"])
    langs = _fences(_merged(cells, 1), ["lang"]).select(F.col("lang").alias("l"), F.col("fences").alias("of_lang"), F.col("n").alias("n_lang"))
    every = _fences(_merged(cells, 2).withColumn("k", F.lit(1)), ["k"]).select("k", F.col("fences").alias("of_all"))
    out = own.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("k", F.lit(1)).join(F.broadcast(every), "k", "left")
    level = F.when(F.col("n") >= min_documents, 0).when(F.col("n_lang") >= min_documents, 1).otherwise(2)
    fences = F.when(level == 0, F.col("fences")).when(level == 1, F.col("of_lang")).otherwise(F.col("of_all"))
    return out.select("lang", "source", fences.alias("fences"), level.alias("level"), "n")


def _keys(lang: str, source: str) -> list[Column]:
    """Of a cell, two strings that are never null."""
    return [F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")).alias(k) for c, k in ((lang, "__lk"), (source, "__sk"))]


def judged(rows: DataFrame, by_cell: DataFrame, spread: Column) -> DataFrame:
    """rows of `measured` with __base_failed, __kept and the failed ratios. Cells without a document that passes the base
    rules have no fences; none of their rows is kept anyway. Beyond ``CELLS`` cells the rows of large ones are dealt over tasks by
    ``spread``."""
    cells = by_cell.select(*_keys("lang", "source"), F.col("fences").alias("__fences"), F.col("level").alias("__level"), F.col("n").alias("__cell_n"))
    keyed = rows.select("*", *_keys("__lang", "__source"))
    if by_cell.count() <= CELLS:
        out = keyed.join(F.broadcast(cells), ["__lk", "__sk"], "left")
    else:
        out = hot_join(keyed, cells, ["__lk", "__sk"], "__cell_n", spread, how="left")
    out = out.withColumn("__base_failed", _base_failed(F.col("__base")))
    failed = F.array(*[F.when((v < F.col("__fences")[k]["low"]) | (v > F.col("__fences")[k]["high"]), F.lit(k)) for k, v in _ratios(F.col("__base")).items()])
    out = out.withColumn("__failed", F.array_compact(failed))
    return out.withColumn("__kept", ~F.col("__base_failed") & (F.size("__failed") == 0))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """One row per document: doc_id, base figures, base_failed, kept, the ratios that failed and the sketch's level."""
    rows = written(measured(docs, carry=[F.col(id_col).alias("doc_id")], **columns), "measured")
    by_cell = written(thresholds(rows), "fences")
    out = judged(rows, by_cell, F.xxhash64("doc_id"))
    return out.select("doc_id", "__base.*", F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.array_join("__failed", ",").alias("failed"), F.col("__level").alias("level"))


def kept_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents that pass, with their own columns. Documents are written once with their figures, which the thresholds and the
    verdicts read; no text is shuffled while the cells are few."""
    rows = written(measured(docs, carry=[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")], **columns), "measured")
    by_cell = written(thresholds(rows), "fences")
    return judged(rows, by_cell, F.xxhash64("__base.word_chars", "__base.n_words")).where("__kept").select("__doc.*")


def oracle_sql(min_documents: int = MIN_DOCUMENTS) -> str:
    """The same in DuckDB's SQL, over documents of different ids."""
    forms = {"symbols_per_word": "n_symbols / w", "word_length": "word_chars / w", "duplicate_lines": "n_dup_lines / l", "stuttered_words": "n_stuttered / w"}
    rules = ", ".join(f"({i}, '{k}', {slack}::DOUBLE, {str(low).lower()})" for i, (k, (slack, low)) in enumerate(SLACK.items()))
    values = " UNION ALL ".join(f"SELECT doc_id, lk, sk, base_failed, '{k}' AS ratio, {form} AS value FROM counted" for k, form in forms.items())
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce('+' || lang, '-') AS lk, coalesce('+' || source, '-') AS sk, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '{word}+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) t(j) GROUP BY doc_id
), base AS (
  SELECT doc_id, lk, sk, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stuttered
  FROM words LEFT JOIN covered c USING (doc_id)
), counted AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS w, greatest(n_lines, 1)::DOUBLE AS l FROM base
), ratios AS ({values}),
rules(place, ratio, slack, lower) AS (VALUES {rules}),
cells AS (
  SELECT lk, sk, ratio, CASE WHEN value < {LEAST}::DOUBLE THEN 0 ELSE ceil(ln(value / {LEAST}::DOUBLE) / {float(np.log(GAMMA))!r}::DOUBLE) + 1 END::INT AS bucket, count(*) AS n
  FROM ratios WHERE NOT base_failed GROUP BY ALL
), merged AS (
  SELECT 0 AS level, lk, sk, ratio, bucket, n FROM cells
  UNION ALL SELECT 1, lk, '', ratio, bucket, sum(n) FROM cells GROUP BY lk, ratio, bucket
  UNION ALL SELECT 2, '', '', ratio, bucket, sum(n) FROM cells GROUP BY ratio, bucket
), seen AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lk, sk, ratio ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY level, lk, sk, ratio) AS every,
         CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE {LEAST}::DOUBLE * pow({GAMMA}::DOUBLE, bucket - 1) END AS value FROM merged
), quantiles AS (
  SELECT level, lk, sk, ratio, min(value) FILTER (seen >= 0.1::DOUBLE * every) AS q10, min(value) FILTER (seen >= 0.5::DOUBLE * every) AS q50, max(every) AS n FROM seen GROUP BY level, lk, sk, ratio
), fences AS (
  SELECT level, lk, sk, ratio, place, n, CASE WHEN lower THEN q50 - ({SPREAD}::DOUBLE * (q50 - q10) + slack) ELSE '-infinity'::DOUBLE END AS low, q50 + ({SPREAD}::DOUBLE * (q50 - q10) + slack) AS high
  FROM quantiles JOIN rules USING (ratio)
), chosen AS (
  SELECT a.lk, a.sk, CASE WHEN max(a.n) >= {min_documents} THEN 0 WHEN max(b.n) >= {min_documents} THEN 1 ELSE 2 END AS level
  FROM fences a JOIN fences b ON b.level = 1 AND b.lk = a.lk WHERE a.level = 0 GROUP BY a.lk, a.sk
), broken AS (
  SELECT r.doc_id, string_agg(r.ratio, ',' ORDER BY f.place) AS failed
  FROM ratios r JOIN chosen c USING (lk, sk) JOIN fences f ON f.level = c.level AND f.ratio = r.ratio AND f.lk = CASE WHEN c.level < 2 THEN r.lk ELSE '' END AND f.sk = CASE WHEN c.level < 1 THEN r.sk ELSE '' END
  WHERE r.value < f.low OR r.value > f.high GROUP BY r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stuttered, base_failed, NOT base_failed AND b.failed IS NULL AS kept, coalesce(b.failed, '') AS failed, c.level::INT AS level
FROM counted LEFT JOIN broken b USING (doc_id) LEFT JOIN chosen c USING (lk, sk)
"""
