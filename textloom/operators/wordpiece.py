"""WordPiece: greedy longest match of sub-words, by an Arrow-batched function over a vocabulary of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.tokens import BERT, assembled, check_length
from textloom.sources.files import read_verified
from textloom.sources.shared import small_batches

UNKNOWN = "[UNK]"
#: Words that a task remembers.
MEMO = 50_000


class WordPiece:
    """Splits a word into the longest known pieces from left to right; pieces after the first have ``##``. A word with
    a part that isn't known is one unknown id as a whole, however long it is."""

    def __init__(self, vocabulary: dict[str, int], unknown: int = BERT.unknown):
        self.vocabulary, self.unknown = vocabulary, unknown
        self.longest = max((len(t) for t in vocabulary), default=0)
        self._memo: dict[str, list[int]] = {}

    def ids(self, word: str) -> list[int]:
        found = self._memo.get(word)
        if found is None:
            found = self._split(word)
            if len(self._memo) < MEMO:
                self._memo[word] = found
        return found

    def _split(self, word: str) -> list[int]:
        whole = self.vocabulary.get(word)
        if whole is not None:
            return [whole]
        out, at = [], 0
        while at < len(word):
            lead = "##" if at else ""
            for end in range(min(len(word), at + self.longest), at, -1):
                known = self.vocabulary.get(lead + word[at:end])
                if known is not None:
                    break
            else:
                return [self.unknown]
            out.append(known)
            at = end
        return out or [self.unknown]


def solved(words: pa.Array, ids_of: Callable[[str], list[int]]) -> pa.Array:
    """Ids of the words of each list, one after another; a null list stays null. Every distinct word of the batch is solved once."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    each = [ids_of(w) for w in coded.dictionary.to_pylist()]
    size = np.array([len(x) for x in each], np.int64)
    pool = np.array([i for x in each for i in x], np.int64)
    first, n = np.cumsum(size) - size, size[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    values = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
    lengths = np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    offsets = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=words.is_null())


def vocabulary_of_lines(lines: Iterable[str]) -> dict[str, int]:
    """Token to line number; of equal tokens the last counts."""
    return {line.strip(): i for i, line in enumerate(lines)}


def vocabulary_table(lines: DataFrame, position: str, line: str) -> DataFrame:
    """(token, id) of lines that are rows with a position: the same rule for vocabularies that are tables."""
    return lines.groupBy(F.regexp_replace(line, r"(?U)^\s+|\s+$", "").alias("token")).agg(F.max(F.col(position).cast("long")).alias("id"))


def load_vocabulary(path: str) -> dict[str, int]:
    """A vocabulary file: one token a line, its number the id. Read on the driver, where the order of lines is known."""
    return vocabulary_of_lines(read_verified(path).decode("utf-8").splitlines())


class BertTokenizer:
    """Columns of token ids and model input. segment: any function of a normalised text column to a column of words."""

    def __init__(self, spark: SparkSession, vocabulary: dict[str, int], *, max_length: int = 512, segment: T.Segmenter = T.segment):
        self.max_length, self.segment, self.vocabulary = check_length(max_length), segment, vocabulary
        small_batches(spark)  # a row holds the words of a whole text
        shared = spark.sparkContext.broadcast(vocabulary)

        def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = WordPiece(shared.value)
            for words in batches:
                yield solved(words, model.ids)

        self._split = split

    def words(self, text: Column) -> Column:
        return T.without_empty(self.segment(T.bert_normalize(text)))

    def word_ids(self, words: Column) -> Column:
        """Ids of the words of an array, one after another."""
        return F.arrow_udf(self._split, "array<long>")(words)

    def content_ids(self, text: Column) -> Column:
        return self.word_ids(self.words(text))

    def encode(self, text: Column) -> Column:
        return assembled(self.content_ids(text), BERT, self.max_length)

    def decode(self, ids: Column) -> Column:
        """Tokens of ids; an unknown id is ``[UNK]``. The vocabulary is a literal array of the plan, by id from the smallest on; a
        vocabulary whose ids leave wide gaps is better joined (`decode_joined`)."""
        names = {i: t for t, i in self.vocabulary.items()}
        least = min(names, default=0)
        table = F.lit([names.get(i) or UNKNOWN for i in range(least, max(names, default=-1) + 1)] or [UNKNOWN])
        # beyond the int range there are no ids
        place = lambda i: F.when(i.between(least, least + len(names) + (1 << 24)), (i - least).cast("int"))
        return F.transform(ids, lambda i: F.coalesce(F.get(table, place(i)), F.lit(UNKNOWN)))


def decode_joined(rows: DataFrame, vocabulary: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, pos, token) of rows(key, ids) by a join with vocabulary(token, id): for vocabularies that live in a table."""
    each = rows.select(key, F.posexplode(ids).alias("pos", "id"))
    return each.join(vocabulary, "id", "left").select(key, "pos", F.coalesce("token", F.lit(UNKNOWN)).alias("token"))
