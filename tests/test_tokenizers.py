from __future__ import annotations

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import charsmap, unigram, wordpiece
from textloom.operators.charsmap import Charsmap, CharsmapError

VOCABULARY = wordpiece.vocabulary_of_lines(["[PAD]", *[f"[unused{i}]" for i in range(1, 100)], "[UNK]", "[CLS]", "[SEP]", "hello", "world", "je", "##ky", "##ll", "test", "cafe", "hi"])


def encode(spark, text, **options):
    tokenizer = wordpiece.BertTokenizer(spark, VOCABULARY, **options)
    return spark.createDataFrame([(text,)], "t string").select(tokenizer.encode(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(("word", "expected"), [("jekyll", [105, 106, 107]), ("xyz", [100]), ("jekyllx", [100]), ("hello", [103]), ("hellohello", [100]), ("j" * 5000, [100])])
def test_wordpiece(word, expected):
    assert wordpiece.WordPiece(VOCABULARY).ids(word) == expected


@pytest.mark.parametrize(("text", "content"), [("hello world", [103, 104]), ("HELLO", [103]), ("cafe\u0301", [109]), ("caf\u00e9", [100]), ("", []), ("   \t\n   ", []), ("hello, world!", [103, 104])])
def test_encode(spark, text, content):
    got = encode(spark, text)
    assert got["input_ids"][: len(content) + 2] == [101, *content, 102]
    assert len(got["input_ids"]) == 512 and not any(got["input_ids"][len(content) + 2 :]) and not got["truncated"]


def test_encode_truncates(spark):
    got = encode(spark, "hello " * 600)
    assert got["truncated"] and got["input_ids"][-1] == 102 and got["attention_mask"] == [1] * 512
    assert not encode(spark, "hello " * 510)["truncated"]
    assert encode(spark, None) is None
    assert len(encode(spark, "hello", max_length=10)["input_ids"]) == 10


def test_own_segmenter_may_emit_empty_words(spark):
    own = lambda c: F.array(F.lit(""), F.lit("hello"), F.lit(""))
    assert encode(spark, "x", segment=own, max_length=4)["input_ids"] == [101, 103, 102, 0]


def test_decode(spark):
    tokenizer = wordpiece.BertTokenizer(spark, VOCABULARY)
    rows = spark.createDataFrame([(1, [101, 103, 104, 102, 99999])], "k int, ids array<long>")
    assert rows.select(tokenizer.decode(F.col("ids")).alias("v")).first()["v"] == ["[CLS]", "hello", "world", "[SEP]", "[UNK]"]
    table = spark.createDataFrame(list(VOCABULARY.items()), "token string, id long")
    got = {r["pos"]: r["token"] for r in wordpiece.decode_joined(rows, table, "k", "ids").collect()}
    assert [got[i] for i in range(5)] == ["[CLS]", "hello", "world", "[SEP]", "[UNK]"]


def test_vocabulary_file(tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("a \nb\na\n", encoding="utf-8")
    assert wordpiece.load_vocabulary(str(path)) == {"a": 2, "b": 1}


ACUTE, DOT, HAT = "\u0301", "\u0323", "\u0302"
MAP = charsmap.build({"ệ": "!", "e" + DOT: "ẹ", "e" + DOT + HAT: "ệ", "Ｈ": "H", "…": "...", "a" + ACUTE: "á", "\r": " ", "①": "1"})


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Ｈ", "H"),
        ("wait… really?", "wait... really?"),
        ("“Hello”", "“Hello”"),
        ("", ""),
        ("Vi" + "e" + DOT + HAT + "t", "Việt"),  # the longest entry, not the first
        ("a" + ACUTE, "á"),
        ("\r\n", " "),  # the rest of a cluster is lost with a prefix match
        ("e" + DOT, "ẹ"),
        ("a\0b", "a\0b"),
        ("①" + ACUTE, "1"),
        ("a " + ACUTE + "b …", "a " + ACUTE + "b ..."),
        ("\u0600 Ｈ Ｈ", "\u0600 H H"),  # a character that joins the space behind it
        ("  Ｈ  ", "  H  "),
    ],
)
def test_charsmap(given, expected):
    assert Charsmap(MAP).normalize(given) == expected


@pytest.fixture(scope="module")
def large_map():
    """Compatibility forms of every character of the basic plane, and every composed letter by its parts: as many units as a real map."""
    import unicodedata

    entries = {}
    for c in map(chr, range(0x80, 0x10000)):
        if "\ud800" <= c <= "\udfff":
            continue
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and "\0" not in plain:
            entries[c] = plain
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
            entries[parts] = c
    blob = charsmap.build(entries | {"\r": " ", "\n": " ", "\t": " "})
    return entries, Charsmap(blob)


def test_map_of_real_size(large_map):
    import random
    import unicodedata

    entries, made = large_map
    assert len(entries) > 14_000 and len(made.units) > 30_000
    assert {k: made.replacement(k) for k in entries} == entries
    assert made.normalize("Ｈｅｌｌｏ　ﬁne ①②③ … ™ ½") == "Hello fine 123 ... TM 1⁄2"
    assert made.normalize(unicodedata.normalize("NFD", "Tiếng Việt, où é ñ Ångström")) == "Tiếng Việt, où é ñ Ångström"
    assert made.normalize("a\r\nb") == "a b"  # one cluster, whose rest is lost
    assert made.normalize("①\u0301x") == "1x"  # likewise
    assert made.normalize("日本語 العربية हिन्दी ไทย 한국어") == unicodedata.normalize("NFKC", "日本語 العربية हिन्दी ไทย 한국어")
    r, chars = random.Random(2), [*entries, "a", "b", " ", "é", "語"]
    for _ in range(300):
        text = "".join(r.choices(chars, k=8))
        assert made.normalize(text) == made._clusters(text)


def test_pieces_and_whole_clusters_agree():
    import random

    r, charsmap_ = random.Random(1), Charsmap(MAP)
    for _ in range(500):
        text = "".join(r.choices(["a", "e", ACUTE, DOT, HAT, " ", "  ", "\r", "\n", "Ｈ", "…", "\u0600", "①", "\u200d", "x"], k=r.randrange(14)))
        assert charsmap_.normalize(text) == charsmap_._clusters(text), repr(text)


def test_long_clusters_go_by_code_point():
    tall = "a" + ACUTE + HAT + HAT  # 7 bytes
    assert Charsmap(MAP).normalize(tall) == tall


@pytest.mark.parametrize("blob", [bytes([1, 2, 3]), bytes([1, 0, 0, 0, 0]), bytes([64, 0, 0, 0])])
def test_damaged_blobs(blob):
    with pytest.raises(CharsmapError):
        Charsmap(blob)


def test_empty_trie_changes_nothing():
    assert Charsmap(bytes([4, 0, 0, 0, 0, 0, 0, 0])).normalize("abc") == "abc"


def test_lookup_survives_any_units():
    import random

    r = random.Random(3)
    for _ in range(50):
        units = b"".join(r.getrandbits(32).to_bytes(4, "little") for _ in range(64))
        Charsmap((256).to_bytes(4, "little") + units + b"x\0").leaves(bytes(r.randrange(256) for _ in range(20)))


def test_blob_of_tokenizer_json():
    whole = {"normalizer": {"type": "Sequence", "normalizers": [{"type": "Other"}, {"type": "Precompiled", "precompiled_charsmap": base64.b64encode(MAP).decode()}]}}
    assert charsmap.from_tokenizer_json(json.dumps(whole)) == MAP
    with pytest.raises(CharsmapError, match="no Precompiled"):
        charsmap.from_tokenizer_json(json.dumps({"normalizer": {"normalizers": [{"type": "Other"}]}}))
    with pytest.raises(CharsmapError, match="precompiled_charsmap"):
        charsmap.from_tokenizer_json(json.dumps({"normalizer": {"normalizers": [{"type": "Precompiled"}]}}))


def test_order_of_normalisation(spark):
    run = charsmap.normalizer(spark, charsmap.build({" ": " ", "…": "..."}))
    rows = spark.createDataFrame([(" a b…",), (None,)], "t string")
    assert [r["v"] for r in rows.select(charsmap.tokenization_form(run, F.col("t")).alias("v")).collect()] == ["▁a▁b...", None]


PIECES = {p: (4 + i, s) for i, (p, s) in enumerate({"▁": -3.0, "▁he": -2.0, "▁hello": -5.0, "llo": -2.5, "l": -4.0, "o": -4.0, "▁w": -3.0, "orld": -3.0}.items())}


@pytest.mark.parametrize("text", ["▁hello▁world", "▁hellollo", "▁hexlo", "▁xyz▁hello", "", "ooo", "▁"])
def test_unigram_agrees_with_an_independent_implementation(text):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    order = [("<s>", 0.0), ("<pad>", 0.0), ("</s>", 0.0), ("<unk>", 0.0), *[(p, s) for p, (_, s) in PIECES.items()]]
    other = Tokenizer(Unigram(order, unk_id=3))
    assert unigram.Unigram(PIECES).ids(text) == other.encode(text).ids


def test_xlmr_encode(spark, tmp_path):
    path = tmp_path / "tokenizer.json"
    blob = base64.b64encode(charsmap.build({"…": "..."})).decode()
    vocab = [["<s>", 0.0], ["<pad>", 0.0], ["</s>", 0.0], ["<unk>", 0.0], *[[p, s] for p, (_, s) in PIECES.items()]]
    path.write_text(json.dumps({"normalizer": {"normalizers": [{"type": "Precompiled", "precompiled_charsmap": blob}]}, "model": {"vocab": vocab}}), encoding="utf-8")
    tokenizer = unigram.XlmrTokenizer(spark, *unigram.load_pieces(str(path)), max_length=6)
    rows = spark.createDataFrame([(0, "hello  world"), (1, ""), (2, "hello world hello world"), (3, None)], "k int, t string")
    got = {r["k"]: r["v"] for r in rows.select("k", tokenizer.encode(F.col("t")).alias("v")).collect()}
    he, llo, w, orld = (PIECES[p][0] for p in ("▁he", "llo", "▁w", "orld"))
    assert got[0]["input_ids"] == [0, he, llo, w, orld, 2]
    assert got[1]["input_ids"] == [0, 2, 1, 1, 1, 1] and not got[1]["truncated"]
    assert got[2]["input_ids"] == [0, he, llo, w, orld, he] and got[2]["truncated"]
    assert got[3] is None


def _plain_lattice(pieces, text, unknown=3):
    """The best path over the whole text, by dictionary and every length."""
    longest = max(map(len, pieces), default=1)
    low = min((s for _, s in pieces.values()), default=0.0) - unigram.UNKNOWN_PENALTY
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        ways = []
        for n in range(min(longest, end), 0, -1):
            if text[end - n : end] in pieces:
                i, s = pieces[text[end - n : end]]
                ways.append((best[end - n][0] + s, n, best[end - n][1] + [i]))
        ways.append((best[end - 1][0] + low, 0, best[end - 1][1] + [unknown]))
        score, _, path = max(ways, key=lambda w: w[:2])
        best.append((score, path))
    path = best[-1][1]
    return [p for i, p in enumerate(path) if not (p == unknown and i and path[i - 1] == unknown)]


def test_pieces_may_span_words():
    pieces = {p: (4 + i, s) for i, (p, s) in enumerate({"▁new": -3.0, "▁york": -3.5, "▁new▁york": -4.0, "▁": -5.0, "k▁t": -0.5, "▁the": -2.0, "he": -3.0, "▁▁": -1.0, "▁yor": -3.0}.items())}
    model = unigram.Unigram(pieces)
    assert model.text_ids("▁new▁york") == [pieces["▁new▁york"][0]]
    assert model.text_ids("▁new▁york▁the") == _plain_lattice(pieces, "▁new▁york▁the")
    assert model.segments("▁new▁york▁the▁new") == ["▁new▁york▁the", "▁new"]
    assert model.segments("x▁the▁york") == ["x", "▁the", "▁york"]


def test_segments_give_the_whole_lattice():
    import random

    r = random.Random(9)
    for _ in range(300):
        pieces = {"".join(r.choices("ab▁", k=r.randrange(1, 6))): None for _ in range(r.randrange(12))}
        pieces = {p: (4 + i, -r.randrange(4, 48) / 8) for i, p in enumerate(pieces)}
        model = unigram.Unigram(pieces)
        for _ in range(5):
            text = "".join(r.choices("abx▁", k=r.randrange(25)))
            want = _plain_lattice(pieces, text)
            assert model.ids(text) == want and model.text_ids(text) == want == model.text_ids(text), (pieces, text)


def test_spanning_pieces_agree_with_an_independent_implementation():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    pieces = {p: (4 + i, s) for i, (p, s) in enumerate({"▁": -3.01, "▁of": -2.03, "▁the": -2.57, "▁of▁the": -3.11, "e▁s": -4.39, "▁sea": -3.77, "a": -5.13, "th": -4.91, "e": -4.07, "s": -5.23}.items())}
    order = [("<s>", 0.0), ("<pad>", 0.0), ("</s>", 0.0), ("<unk>", 0.0), *[(p, s) for p, (_, s) in pieces.items()]]
    other = Tokenizer(Unigram(order, unk_id=3))
    for text in ("▁of▁the▁sea", "▁the▁sea▁of▁the▁sea", "▁of▁these▁q", "▁se▁s", ""):
        assert unigram.Unigram(pieces).text_ids(text) == other.encode(text).ids


def test_a_vocabulary_of_real_size_is_made_once_a_worker(spark):
    """250,000 pieces, many of them over several words; the model outlives a task."""
    import os
    import random
    import time

    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrst", k=r.randrange(4, 9))) for _ in range(127_000)]
    pieces = {T.METASPACE + w: 0 for w in words} | {T.METASPACE + a + T.METASPACE + b: 0 for a, b in zip(words, words[1:], strict=False)} | dict.fromkeys("abcdefghijklmnopqrst", 0)
    pieces = {p: (4 + i, -8.0 - i % 97 / 50) for i, p in enumerate(pieces)}
    assert len(pieces) > 245_000
    began = time.perf_counter()
    model = unigram.Unigram(pieces)
    print("made in", round(time.perf_counter() - began, 1), "s")
    text = T.METASPACE + T.METASPACE.join(r.choices(words, k=300) + words[:40])
    assert model.text_ids(text) == model.ids(text)
    assert any(T.METASPACE in p[1:] for i in model.ids(text) for p in [next(k for k, v in pieces.items() if v[0] == i)])
    blob = charsmap.build({"…": "..."})
    tokenizer = unigram.XlmrTokenizer(spark, pieces, blob)
    rows = spark.range(64).repartition(16).select(F.lit(text.replace(T.METASPACE, " ")).alias("t"))
    assert {tuple(x["v"]) for x in rows.select(tokenizer.content_ids(F.col("t")).alias("v")).collect()} == {tuple(model.ids(text))}

    def loads(batches):
        import pyarrow as pa

        made = unigram.Unigram
        for b in batches:
            calls = []
            unigram.Unigram = lambda *a: calls.append(1) or made(*a)
            try:
                unigram._model(shared)
                unigram._model(shared)
            finally:
                unigram.Unigram = made
            yield pa.RecordBatch.from_arrays([pa.array([f"{os.getpid()}"] * b.num_rows), pa.array([len(calls)] + [0] * (b.num_rows - 1))], names=["worker", "loads"])

    shared = spark.sparkContext.broadcast((pieces, blob, "one"))
    seen = spark.range(64).repartition(16).mapInArrow(loads, "worker string, loads long").groupBy("worker").agg(F.sum("loads").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert sum(x["rows"] for x in seen) == 64 and all(x["n"] <= 1 for x in seen)


def test_registered_spanning_pieces_equal_the_plain_lattice(spark, sf_dir):
    from textloom.plans import queries as core

    pieces = core.derived_spans(core._documents(spark, sf_dir))
    assert sum(T.METASPACE in p[1:] for p in pieces) > 100
    normal = Charsmap(charsmap.build(core.derived_map()))
    texts = {r["doc_id"]: r["text"] for r in core._documents(spark, sf_dir).where("length(text) < 1500").collect()}
    got = {r["doc_id"]: r["ids"] for r in core.queries()["unigram_spanning"](spark, sf_dir).collect()}
    assert len(texts) > 50
    spans = {i for p, (i, _) in pieces.items() if T.METASPACE in p[1:]}
    used = 0
    for doc_id, text in texts.items():
        ids = _plain_lattice(pieces, T.escaped(normal.normalize(text)))
        assert got[doc_id] == " ".join(map(str, ids))
        used += bool(spans & set(ids))
    assert used > 10


def test_derived_vocabularies_follow_their_table(spark, tmp_path):
    from textloom.plans import queries as core

    for texts in (["aa bb"], ["aa bb cc dd"]):
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert set(core._vocabulary(spark, str(tmp_path))) >= set(texts[0].split())


def test_texts_are_solved_together_as_each_by_itself():
    import random

    r = random.Random(2)
    for spans in (False, True):
        for _ in range(150):
            pieces = {"".join(r.choices("ab▁" if spans else "abc", k=r.randrange(1, 6))): None for _ in range(r.randrange(12))}
            pieces = {p: (3 + i, -r.randrange(4, 48) / 8) for i, p in enumerate(pieces)}  # the first has the unknown id
            model = unigram.Unigram(pieces)
            texts = ["".join(r.choices("abx▁", k=r.choice((0, 3, 25, 90)))) for _ in range(12)]
            for _ in range(2):
                ids, size = model.texts_ids(texts)
                assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [_plain_lattice(pieces, t) for t in texts], (pieces, texts)


def test_what_a_worker_remembers_has_a_bound(monkeypatch):
    monkeypatch.setattr(unigram, "MEMO", 50)
    monkeypatch.setattr(unigram, "MEMO_CHARS", 400)
    model = unigram.Unigram(PIECES)
    for i in range(40):
        texts = [f"▁hello▁w{i}o{j}" for j in range(9)] + ["▁" + "l" * (i * 20)]
        ids, size = model.texts_ids(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [model.ids(t) for t in texts]
        assert len(model._memo) <= 50 and len(model._pool) < 2000


def test_texts_without_an_entry_are_not_looked_up():
    done = []
    for entries, odd in (({"…": "...", "é": "é", "ab": "c"}, " x…y é abc ؀ b"), ({" ": "_", "x": "y"}, " x…y é abc"), ({"؀ a": "!"}, "a؀ ab b")):
        m = Charsmap(charsmap.build(entries))
        assert sorted(m._keys()) == sorted(entries)
        want = m._clusters(odd)
        m._clusters = lambda piece, own=m._clusters: done.append(piece) or own(piece)
        assert m.normalize(odd) == want
        done.clear()
        assert m.normalize("nowt\nor" * 9) == "nowt\nor" * 9 and not done
    # no two nodes of a map have one base
    many = {chr(a) + chr(b): "x" for a in range(0x100, 0x180) for b in (0x301, 0x4E00 + a)} | {chr(a): "y" for a in range(0x80, 0x180)}
    assert sorted(Charsmap(charsmap.build(many))._keys()) == sorted(many)


def test_frequent_pairs_are_those_of_all_words(spark, sf_dir, monkeypatch):
    from textloom.plans import queries as core

    docs = core._documents(spark, sf_dir)
    words = core._metaspace_counts(docs).persist()
    every = core._top_pairs
    for pairs, known in ((20, 400), (60, 40), (500, 3)):
        monkeypatch.setattr(core, "PAIRS", pairs)
        best = [r["piece"] for r in words.orderBy(F.desc("n"), "piece").limit(known).collect()]
        want, whole = every(docs, None), []
        monkeypatch.setattr(core, "_top_pairs", lambda d, w: whole.append(w is None) or every(d, w))
        assert core.frequent_pairs(docs, words, best) == want
        assert any(whole) == (known == 3)  # rare words are paired only where too few pairs are known
        monkeypatch.setattr(core, "_top_pairs", every)
    words.unpersist()
