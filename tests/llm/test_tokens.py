"""Token counts, records and BPE against the libraries on whole texts."""

import array
import hashlib
import zlib

import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import bpe, token_counts, token_records
from tidemark.llm.encoders import WordEncoder

TEXTS = [None, "", " ", "Hello, world's  end\n\n", "the the The THE the", "naïve Ünïcödé ﬁ é ½ İstanbul ΣΑΣ 日本語 🙂", "tab\there\x1cthere\x85x", "<|endoftext|> a<|startoftext|>b </s> <s>", "▁odd ▁▁ x", "word " * 3000, "a" * 3000, "don't we'll 123 4a5 --- ###", "Hello, world's  end\n\n"]
WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (1, "", "x")], "doc_id long, text string, n_tokens string")


def test_counts_are_the_library_s(spark, tmp_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts.token_counts(documents(spark), PIECE, str(tmp_path / "cache")).collect()
    assert len(got) == len(TEXTS) + 2
    assert all(r.n_tokens == len(lib.encode(r.text or "")) for r in got)


def test_cache_is_appended_to_and_reused(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = documents(spark, ["a b", "c"])
    token_counts.token_counts(first, WORD, cache).count()
    again = token_counts.token_counts(documents(spark, ["a b", "d"]), WORD, cache)
    stored = spark.read.parquet(cache)
    assert again.count() == 4 and stored.count() == stored.select("digest").distinct().count() == 5


def test_counts_of_an_empty_table(spark, tmp_path):
    assert token_counts.token_counts(documents(spark).limit(0), WORD, str(tmp_path / "c")).count() == 0


def test_records_hold_every_document_in_order(spark, tmp_path, library):
    path = str(tmp_path / "r")
    token_records.write_records(documents(spark), WORD, path, end_id=2, files=3)
    got = sorted(token_records.read_records(spark, path).collect(), key=lambda r: r.start)
    want = sorted([(None, "no id"), (1, ""), *enumerate(TEXTS)], key=lambda x: (x[0] is not None, x[0], x[1] or ""))
    start = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = array.array("I", [*library.encode(text or "", add_special_tokens=False).ids, 2])
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    index = token_records.read_index(spark, path).collect()
    record = max(index, key=lambda r: r.size)
    with open(record.file.removeprefix("file:"), "rb") as f:
        f.seek(record.offset)
        assert len(list(token_records.frames(f.read(record.size)))) == 1


def test_broken_records_are_noticed():
    good = token_records.frame(b"some payload")
    assert [bytes(p) for _, p in token_records.frames(good + good)] == [b"some payload"] * 2
    for k in (0, 9, 15, len(good) - 3):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(token_records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_records.frames(good[:-1]))


def test_empty_table_of_records(spark, tmp_path):
    token_records.write_records(documents(spark).limit(0), WORD, str(tmp_path / "e"))
    assert token_records.read_records(spark, str(tmp_path / "e")).count() == 0


def test_bpe_and_back(spark, library):
    got = bpe.encode(documents(spark), WORD).collect()
    assert len(got) == len(TEXTS) + 2
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 1)}
    for i, text in enumerate(TEXTS):
        if i == 1:
            continue
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert by_id[i].n_tokens == len(ids)
        assert hashlib.sha256(by_id[i].ids).digest() == hashlib.sha256(array.array("I", ids).tobytes()).digest()
        assert by_id[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_decode_joins_pieces(spark, library):
    coded = bpe.encode(documents(spark), WORD, decode=False)
    assert coded.filter("decoded is not null").isEmpty()
    assert all(r.decoded == library.decode(list(array.array("I", r.ids)), skip_special_tokens=False) for r in bpe.decode(coded, WORD).collect())


def test_bpe_of_an_empty_table(spark):
    assert bpe.encode(documents(spark).limit(0), WORD).count() == 0


def test_records_are_read_in_another_order_through_the_index(spark, tmp_path, library):
    path = str(tmp_path / "r")
    token_records.write_records(documents(spark), WORD, path, files=3)
    ordered = {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_records.read_records(spark, path).collect()}
    shuffled = token_records.read_shuffled(spark, path, 7).orderBy("place").collect()
    assert len(shuffled) == len(TEXTS) + 2 and {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in shuffled} == ordered
    assert [r.place for r in shuffled] != [r.place for r in token_records.read_shuffled(spark, path, 8).orderBy("place").collect()]
    index = token_records.read_index(spark, path)
    twice = index.filter("doc_id = 9").selectExpr("1L AS place", "file", "offset", "size")
    got = token_records.read_at(spark, path, twice.union(twice)).collect()
    assert [(r.doc_id, bytes(r.ids)) for r in got] == [(9, array.array("I", library.encode(TEXTS[9], add_special_tokens=False).ids).tobytes())] * 2
    assert token_records.read_at(spark, path, twice.limit(0)).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_records, "FILE_BYTES", 2000)
    token_records.write_records(documents(spark), WORD, str(tmp_path / "r"))
    assert token_records.read_index(spark, str(tmp_path / "r")).select("file").distinct().count() > 4


def test_second_run_of_the_query_meets_stored_counts(spark, tmp_path, monkeypatch):
    import sentencepiece

    from tidemark.llm import queries

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "shared_base", lambda spark: str(tmp_path / "shared"))
    first = queries.op1_token_counts(spark, str(tmp_path)).collect()
    entries = spark.read.parquet(str(tmp_path / "shared/token-cache")).count()
    again = queries.op1_token_counts(spark, str(tmp_path)).collect()
    assert spark.read.parquet(str(tmp_path / "shared/token-cache")).count() == entries == len({t or "" for t in TEXTS} | {"no id"})
    want = sorted((i is None, i or 0, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in [(None, "no id"), (1, ""), *enumerate(TEXTS)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in first) == want and sorted(map(str, first)) == sorted(map(str, again))


def test_files_beyond_five_digits_stay_in_order(spark):
    names = [f"x/part-{n:05d}-a.txt" for n in (0, 7, 99999, 100000, 100001, 1000000)]
    found = spark.createDataFrame([(n,) for n in reversed(names)], "file string").orderBy(*token_records.file_order())
    assert [r.file for r in found.collect()] == names


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_decode_keeps_rows_and_columns(spark, name):
    """Null, empty, unknown and repeated ids, a column decoded, columns of several kinds, batches of few rows."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    lists = [None, [], [5], [5, 9, 5], [lib.get_vocab_size() + 7, 11], *[lib.encode(t or "", add_special_tokens=False).ids for t in TEXTS]] * 5
    pack = lambda x: None if x is None else bytearray(array.array("I", x).tobytes())
    rows = [(k, pack(x), "old", [k, None], {"a": k}) for k, x in enumerate(lists)]
    coded = spark.createDataFrame(rows, "k long, codes binary, decoded string, piece array<long>, ids map<string,long>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(bpe.decode(coded, path, ids="codes").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.k for r in got] == list(range(len(lists)))
    for r, x in zip(got, lists, strict=True):
        assert r.decoded == (None if x is None else lib.decode(x, skip_special_tokens=False))
        assert (r.codes, r.piece, r.ids) == (pack(x), [r.k, None], {"a": r.k})
    assert bpe.decode(coded.limit(0), path, ids="codes").columns == ["k", "codes", "piece", "ids", "decoded"]


def test_pieces_are_joined_without_a_shuffle(spark):
    coded = spark.createDataFrame([(1, bytearray(array.array("I", [5]).tobytes()))], "k long, ids binary")
    plan = bpe.decode(coded, WORD)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_bpe_query_against_the_library(spark, tmp_path, library):
    from tidemark.llm import queries

    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_bpe(spark, str(tmp_path)).collect()
    want = []
    for doc, text in [(None, "no id"), (1, ""), *enumerate(TEXTS)]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_words_of_a_column_go_to_the_library_together():
    with open(WORD, "rb") as f:
        encoder = WordEncoder(f.read())
    lib, calls = encoder.lib, []

    class Counting:
        def encode(self, *a, **k):
            calls.append(1)
            return lib.encode(*a, **k)

        def encode_batch_fast(self, *a, **k):
            calls.append(1)
            return lib.encode_batch_fast(*a, **k)

    encoder.lib = Counting()
    letters = "abcdefghijklmnopqrstuvwxyzäé"
    many = " ".join(f"{a}{b.upper()}{c}{m}" for a in letters[:20] for b in letters for c in letters for m in ("", ".", "!!"))
    odd = ["", None, " a b ", "\x0b\x0ca\r\n", "don't Stop</w> É ﬁ é e\u0301 x\u00a0y\u3000z", "<|endoftext|> a<|startoftext|>b", "a" * 70_000, "Ünï...,!! !! ..", "\x00 \x85 \x1c a\x1db", "ßẞ İ ŉ ſ", many]
    column = pa.array(odd * 2)
    want = [array.array(encoder.kind, lib.encode(x or "", add_special_tokens=False).ids).tobytes() for x in odd * 2]
    assert list(encoder.column_ids(column)) == want
    assert list(encoder.column_ids(column.slice(3, 9))) == want[3:12]
    assert list(encoder.column_ids(pa.array([], pa.string()))) == []
    assert len(calls) < 100  # of 47,000 different words
