"""Encoding, packing, token files and counts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD_TEXTS, SF_DIR, docs, odd_docs, table_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from airlattice.llm import bpe, encode, packing, queries, token_counts, token_files

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
PIECES = [
    " ", "  ", "\n", " \n", "\t", "a", "b", "The", "the.", "'", "'s", "'ll", "<|endoftext|>", "1", "23", "é", "É", "ß", "\x1c", "\x85",
    " ", "日本", "😀", "\x00", "!", "...", "́", "Σ", "İ", "word,\nNext", "²",
]


def library(path, text, end=()):
    return [*LIBRARY[path].encode(text or "", add_special_tokens=False).ids, *end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_encoder_is_exact(path, monkeypatch):
    monkeypatch.setattr(encode, "KEPT_WORDS", 50)
    with open(path, encoding="utf-8") as file:
        own = encode.WordEncoder(file.read())
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [t or "" for t in ODD_TEXTS] + [r[0] for r in table_rows(columns="text")]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(b, np.uint32).tolist() for b in own.encode(part)] == [library(path, t) for t in part]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_parts_are_kept_when_they_come_again(path):
    """Parts that never come again take no place from those that do."""
    with open(path, encoding="utf-8") as file:
        own = encode.WordEncoder(file.read())
    once = ["start " + " ".join(f"{a}{b}q" for a in "bcdfg" for b in "aeiou")]
    twice = ["start again and again"]
    for texts in (once, twice):
        assert [np.frombuffer(b, np.uint32).tolist() for b in own.encode(texts)] == [library(path, t) for t in texts]
    assert "again" in own.words and "baq" not in own.words


@pytest.fixture(scope="module")
def chunks():
    with open(BYTE, encoding="utf-8") as file:
        return bpe.ChunkEncoder(encode.WordEncoder(file.read()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=300).map("".join), max_size=4))
def test_chunks_are_exact(chunks, texts):
    assert [x.tolist() for x in chunks.encode([t.encode() for t in texts])] == [library(BYTE, t) for t in texts]


def test_chunks_follow_content(chunks):
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600))
    cut = [{t[a:b] for a, b in zip([0, *e], e)} for t in ((p + passage).encode() for p in ("", "A title. ", "x" * 700)) for e in [bpe.cut_places(np.frombuffer(t, np.uint8))]]
    assert len(cut[0] & cut[1] & cut[2]) >= len(cut[0]) - 2
    for t in ("é" * 5000, "😀" * 3000, "z" * 10_000):
        ends = bpe.cut_places(np.frombuffer(t.encode(), np.uint8))
        assert max(np.diff([0, *ends])) <= bpe.LONGEST + 3
        [t.encode()[a:b].decode() for a, b in zip([0, *ends], ends)]


def test_op4_whole_table(spark):
    sha = lambda data: hashlib.sha256(data.encode()).hexdigest()
    found = {r["doc_id"]: r for r in queries.op4_bpe(spark, SF_DIR).collect()}
    for doc_id, text in table_rows(columns="doc_id, text"):
        ids = library(BYTE, text)
        decoded = LIBRARY[BYTE].decode(ids, skip_special_tokens=False)
        row = found.pop(doc_id)
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))
    assert not found


def test_encode_and_decode_odd_rows(spark):
    rows = bpe.decode(bpe.encode(odd_docs(spark), BYTE), BYTE).collect()
    texts = sorted(t or "" for (t,) in odd_docs(spark).select("text").collect())
    assert sorted(r["text"] for r in rows) == texts
    assert sorted(r["ids"] for r in rows) == sorted(library(BYTE, t) for t in texts)
    assert bpe.decode(bpe.encode(docs(spark, []), BYTE), BYTE).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd_docs(spark), WORD)


def test_decode_of_broken_bytes(spark):
    ids = [[222, 222], [50256], [], None]
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["text"] for r in bpe.decode(rows, BYTE).collect()}
    assert found == {i: LIBRARY[BYTE].decode(x or [], skip_special_tokens=False) for i, x in enumerate(ids)}


# --- packing --------------------------------------------------------------------------------


def check_packing(rows, texts):
    """rows of op2; texts: doc_id to text, ids unique."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids, at = library(WORD, texts[doc_id], [1]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(ids), 0)
            assert r["length"] & (r["length"] - 1) == 0 and 0 < r["length"] <= 2048
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    ordered = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in ordered] == list(range(len(rows)))
    assert [r["length"] for r in ordered] == sorted((r["length"] for r in rows), reverse=True)


def test_op2_whole_table(spark):
    check_packing(queries.op2_packing(spark, SF_DIR).collect(), dict(table_rows(columns="doc_id, text")))


def test_packing_odd_rows(spark):
    check_packing(queries.packed(docs(spark, list(enumerate(ODD_TEXTS)))).collect(), dict(enumerate(ODD_TEXTS)))
    odd = odd_docs(spark)
    rows = queries.packed(odd).collect()
    assert sum(r["length"] for r in rows) == sum(len(library(WORD, t, [1])) for (t,) in odd.select("text").collect())
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert queries.packed(docs(spark, [])).count() == 0


@given(st.integers(0, 20_000), st.sampled_from([1, 8, 2048]))
def test_binary_lengths(n, longest):
    found = packing.binary_lengths(n, longest)
    assert sum(found) == n and found == sorted(found, reverse=True)
    assert all(x <= longest and x & (x - 1) == 0 for x in found)
    assert len([x for x in found if x < longest]) == len({x for x in found if x < longest})


# --- token files ----------------------------------------------------------------------------


def test_op5_whole_table(spark):
    found = {r["doc_id"]: r for r in queries.op5_token_files(spark, SF_DIR).collect()}
    start = 0
    for doc_id, text in sorted(table_rows(columns="doc_id, text")):
        ids = library(BYTE, text, [0])
        row = found.pop(doc_id)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not found


def test_files_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TEXT_BYTES", 20_000)
    path, odd = str(tmp_path / "tokens"), odd_docs(spark)
    token_files.write(odd, path, BYTE, end_id=0)
    rows = token_files.read_with_starts(spark, path).orderBy("start").collect()
    want = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [w[0] for w in want]
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(np.array(library(BYTE, w[1], [0]), "<u4").tobytes() for w in want)
    sizes = np.cumsum([0] + [r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == sizes[:-1].tolist()
    some = token_files.read(spark, path, wanted=[4, 7, 999]).collect()
    assert sorted(r["doc_id"] for r in some) == [4, 4, 7]
    token_files.write(docs(spark, []), str(tmp_path / "none"), BYTE)
    assert token_files.read_with_starts(spark, str(tmp_path / "none")).count() == 0


def sample_file(width=2):
    file = token_files.FileBuilder(3, width, frame_ids=10)
    texts = {5: range(4), 6: range(9), 7: (), 8: range(40), None: (1,)}
    for doc_id, ids in texts.items():
        file.add(doc_id, np.array(ids, "<u4").tobytes())
    return file.finish(), texts


@pytest.mark.parametrize("width", [2, 4])
def test_frames_table_and_checks(width):
    import io

    import zstandard

    content, texts = sample_file(width)
    number, own_width, frames, table = token_files.read_table(content)
    assert (number, own_width, len(frames), len(table)) == (3, width, 4, 5)
    got = {d: np.frombuffer(i, "<u4").tolist() for _, d, _, i in token_files.read_documents(content)}
    assert got == {d: list(i) for d, i in texts.items()}
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert np.frombuffer(whole, f"<u{width}").tolist() == [x for i in texts.values() for x in i]
    broken = bytearray(content)
    broken[int(frames["packed"][0]) + 6] ^= 255  # in the second frame
    assert [d for _, d, _, _ in token_files.read_documents(bytes(broken), {5})] == [5]
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.read_documents(bytes(broken), {6}))
    with pytest.raises(ValueError):
        token_files.read_table(content[:-3])


# --- counts ---------------------------------------------------------------------------------


def check_histogram(rows, lengths):
    total = sum(lengths)
    assert [r["n_tokens"] for r in rows] == sorted(set(lengths))
    for r in rows:
        n = r["n_tokens"]
        kept = sum(min(n, x) for x in lengths)
        assert r["n_docs"] == lengths.count(n) and r["docs_longer"] == sum(x > n for x in lengths)
        assert (r["total_tokens"], r["kept_tokens"], r["cut_tokens"]) == (total, kept, total - kept)
        assert r["share"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))


def test_op6_whole_table(spark):
    rows = queries.op6_token_counts(spark, SF_DIR).orderBy("n_tokens").collect()
    check_histogram(rows, [len(library(BYTE, t)) for (t,) in table_rows(columns="text")])


def test_counts_of_odd_rows(spark):
    odd = odd_docs(spark)
    hist = token_counts.histogram(token_counts.lengths(odd, BYTE, extra=1))
    lengths = [len(library(BYTE, t)) + 1 for (t,) in odd.select("text").collect()]
    check_histogram(hist.orderBy("n_tokens").collect(), lengths)
    limits = {r["max_tokens"]: (r["n_docs_cut"], r["kept_tokens"]) for r in token_counts.at_limits(hist, [1, 3, 10_000]).collect()}
    assert limits == {m: (sum(x > m for x in lengths), sum(min(x, m) for x in lengths)) for m in (1, 3, 10_000)}
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.histogram(token_counts.lengths(docs(spark, []), BYTE)).count() == 0
