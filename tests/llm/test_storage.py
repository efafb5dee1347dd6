"""Packing, WARC and media: exact round trips and constraints."""

import base64
import gzip
import hashlib
import io
import os
import subprocess
import sys
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import media, packing, queries, warc
from tidemark.llm.common import SLICE_ROWS


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_by_word_are_those_of_the_whole_text(text):
    p = queries.tokenizer_path()
    assert packing.WordTokenizer.of(p, True).ids(text) == packing.WordTokenizer.of(p, False).ids(text)


def check_packed(rows, max_tokens):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens
    return len(by)


def test_pieces_and_sequences_of_odd_rows(odd, path):
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(odd, path)).collect()
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    assert len(docs[7]) == 2 and {r.ids_crc32 for r in docs[7]} == {docs[7][0].ids_crc32}
    for r in odd.collect():
        if r.doc_id == 7:
            continue
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        cut = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        got = sorted(docs[r.doc_id], key=lambda x: x.piece)
        assert [(x.piece, x.start, x.length, x.ids_crc32) for x in got] == [(i, 4096 * i, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cut)]
    assert check_packed(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_query_fills_sequences(spark, sf):
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    assert check_packed(rows, 4096) <= 1.01 * -(-sum(r.length for r in rows) // 4096) + 1


def test_many_groups_leave_few_poor_sequences(spark):
    lengths = np.random.default_rng(2).integers(1, 3000, 6000)
    parts = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(parts, group_rows=500).collect()
    assert len(rows) == 6000 and check_packed(rows, 4096) <= 1.01 * -(-int(lengths.sum()) // 4096) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(1).integers(1, 60, 500))[::-1]
    bins, offsets, left = packing.best_fit(lengths, 100, 4, 4000.0, (1.0, 0.5, 0.5), rule)
    for b in range(len(left)):
        own = lengths[bins == b]
        assert own.sum() == 100 - left[b] and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 4000


def test_with_ids_gives_the_tokens(spark, path):
    docs = spark.createDataFrame([(1, "hello world " * 3000)], "doc_id long, text string")
    rows = packing.pieces(docs, path, with_ids=True).orderBy("piece").collect()
    ids = [x for r in rows for x in r.ids]
    assert ids == Tokenizer.from_file(path).encode("hello world " * 3000, add_special_tokens=False).ids + [1]


def test_empty_tables(none, spark, path):
    assert packing.pack(packing.pieces(none, path)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0
    root, manifest = media.write_archives(none)
    assert media.described(media.read_archives(spark, root, manifest)).count() == 0


PAGES = [(3, "u", "x" * 100), (1, "u", "x" * 100), (2, None, "x" * 99), (4, "a b\r\nc", "x" * 99), (5, "u", None), (6, "u", "é" * 50), (None, "u", "x" * 100), (7, "u", "é" * 50), (7, "u", "é" * 50), (8, "u", "y" * 300_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, archive_bytes=300)
    got = warc.read_archives(manifest).collect()
    size = lambda t: len((t or "").encode())
    first = {}
    for p, _, t in PAGES:
        if size(t) >= 100 and p is not None:
            first[t] = min(first.get(t, p), p)
    want = []
    for p, _, t in PAGES:
        refers = first.get(t) if p is not None and first.get(t) != p else None
        want.append((p, size(t), hashlib.sha256((t or "").encode()).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def archive(*payloads):
    return b"".join(warc.record(i, "u", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads))


def test_archives_are_plain_gzip_and_stream_payloads():
    data = archive(b"first", b"z" * 1_000_000)
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    got = []
    rows = [*warc.read_records(io.BytesIO(data), got.append)]
    assert b"".join(got) == b"first" + b"z" * 1_000_000 and max(map(len, got)) <= 2 * warc.CHUNK
    assert rows[0]["offset"] == 0 and data[rows[1]["offset"] :][:2] == b"\x1f\x8b"


@pytest.mark.parametrize("damage", ["cut", "digest", "short", "long", "noise"])
def test_damaged_archives_are_errors(damage):
    good = archive(b"payload of some length")
    text = gzip.decompress(good)
    bad = {"cut": good[:-12], "digest": gzip.compress(text.replace(b"payload of", b"PAYLOAD of")), "short": gzip.compress(text[:-8]), "long": gzip.compress(text + b"more"), "noise": good[:40] + b"\0\0\0\0" + good[44:]}[damage]
    with pytest.raises(warc.WarcError):
        [*warc.read_records(io.BytesIO(bad))]


def foreign(kind, block, *more, content="application/http; msgtype=response"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    body, http = b"<p>text</p>", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    records = [
        foreign("warcinfo", b"software: x\r\nformat: WARC", content="application/warc-fields"), foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content="application/http; msgtype=request"),
        foreign("response", http + body, f"WARC-Payload-Digest: {sha1(body)}", f"WARC-Block-Digest: {sha1(http + body)}", "WARC-Target-URI: http://a/"), foreign("response", http + body),
        foreign("response", http + body, "WARC-Payload-Digest: md5:" + hashlib.md5(body).hexdigest()), foreign("response", http + body, "WARC-Payload-Digest: blake3:00"), foreign("metadata", b"a: b", content="application/warc-fields"),
        foreign("resource", body, f"WARC-Payload-Digest: {sha1(body)}", content="text/html"), foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", f"WARC-Payload-Digest: {sha1(body)}"), foreign("revisit", b"", "WARC-Payload-Digest: sha1:X"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", None)], "archive string, n_records long")
    rows = warc.read_archives(manifest).orderBy("offset").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", *["response"] * 4, "metadata", "resource", "revisit", "revisit"]
    assert [r.payload_bytes for r in rows] == [25, 0, *[len(body)] * 4, 4, len(body), None, None] and {r.page_id for r in rows} == {None}
    assert {r.payload_digest for r in rows[2:6]} == {hashlib.sha256(body).hexdigest()} and rows[8].payload_digest == sha1(body) and rows[2].url == "http://a/"


@pytest.mark.parametrize("missing", ["WARC-Type", "WARC-Record-ID", "Content-Length"])
def test_records_without_what_all_have_are_errors(missing):
    text = gzip.decompress(foreign("response", b"HTTP/1.1 200 OK\r\n\r\nx")).replace(missing.encode(), b"X-Else")
    with pytest.raises(warc.WarcError):
        [*warc.read_records(io.BytesIO(gzip.compress(text)))]
    for wrong in (foreign("response", b"HTTP/1.1 200 OK\r\n\r\nx", "WARC-Payload-Digest: sha1:AAAA"), foreign("resource", b"x", "WARC-Block-Digest: md5:00", content="text/plain")):
        with pytest.raises(warc.WarcError):
            [*warc.read_records(io.BytesIO(wrong))]


def test_record_ids_tell_payloads_of_a_page_and_pages_without_id_apart(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (None, "u", "c"), (None, "u", "c"), (2, "u", "x" * 200), (3, "u", "x" * 200)], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    assert len({r.record_id for r in rows}) == 6 and {r.refers_to for r in rows if r.record_type == "revisit"} == {2}


@given(st.binary(max_size=500))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload.startswith(data) and len(payload) >= 64
    assert media.from_png(media.to_png(payload, len(data))) == (payload, len(data))


def test_media_of_odd_rows(odd, spark):
    root, manifest = media.write_archives(odd)
    got = media.described(media.read_archives(spark, root, manifest)).collect()
    want = []
    for r in odd.collect():
        data = (r.text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        png = media.to_png(payload, len(data))
        want.append((r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.feature(payload)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('text ', id, ' '), 1 + int(id % 40)) AS text")
    root, _ = media.write_archives(docs.repartition(2), archive_bytes=20_000)
    return root


def test_what_a_lost_writer_leaves_is_not_opened(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    root, manifest = media.write_archives(docs)
    with open(root.removeprefix("file://") + "/orphan.zip", "wb") as f:
        f.write(b"PK\x03\x04 half a member")
    assert sorted(r.doc_id for r in media.described(media.read_archives(spark, root, manifest)).collect()) == [1, 2]
    with pytest.raises(Exception, match="no directory"):
        media.read_archives(spark, root).collect()


def test_a_task_that_fails_once_gives_each_member_once(tmp_path):
    """A job of its own with retries: the first attempt of a task writes an archive and dies."""
    code = f"""
import os
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tidemark.llm import media
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
def once(batches):
    for b in batches:
        yield b
    if not os.path.exists("{tmp_path}/died"):
        open("{tmp_path}/died", "w").close()
        os._exit(1)
docs = spark.range(40).selectExpr("id AS doc_id", "repeat('text ', 50) AS text").repartition(2)
real = type(docs).mapInArrow
def wrapped(self, f, schema):
    return real(self, lambda batches: once(f(batches)), schema) if "n_members" in schema else real(self, f, schema)
type(docs).mapInArrow = wrapped
root, manifest = media.write_archives(docs, archive_bytes=500)
print("IDS", sorted(r.doc_id for r in media.described(media.read_archives(spark, root, manifest)).collect()) == list(range(40)), len(os.listdir(root.removeprefix("file://"))) > manifest.count())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, env=os.environ)
    assert "IDS True True" in out.stdout, out.stderr[-2000:]


def test_archives_are_plain_zip_with_png(folder):
    names = []
    for x in media.fs.LocalFileSystem().get_file_info(media.fs.FileSelector(folder.removeprefix("file://"))):
        with zipfile.ZipFile(x.path) as z:
            assert z.testzip() is None
            names += z.namelist()
    assert sorted(names) == sorted(f"{i}.png" for i in range(300))


@pytest.mark.parametrize("size", [1, 777, 1 << 20])
def test_byte_ranges_give_each_member_once(folder, size):
    reader = media.MediaArchiveReader({"path": folder, "rangebytes": size})
    names = [n for p in reader.partitions() for b in reader.read(p) for n in b["name"].to_pylist()]
    assert sorted(names) == sorted(f"{i}.png" for i in range(300))


class Flaky:
    """A file that damages the bytes at one place the first times they are read."""

    def __init__(self, file, place, times):
        self.file, self.place, self.times = file, place, times

    def read_at(self, n, at):
        data = bytearray(self.file.read_at(n, at))
        if self.times[0] and at <= self.place < at + n:
            self.times[0] -= 1
            data[self.place - at] ^= 255
        return bytes(data)

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.file.close()


@pytest.mark.parametrize(("times", "works"), [(1, True), (3, True), (9, False)])
def test_a_damaged_member_is_read_again_alone(folder, times, works):
    reader = media.MediaArchiveReader({"path": folder})
    part = reader.partitions()[0]
    store, path = media.fs.FileSystem.from_uri(part.archive)
    with store.open_input_file(path) as file:
        entries = [*media.directory_of(file)]
    left = [times]

    class Store:
        opened = 0

        def open_input_file(self, p):
            Store.opened += 1
            return Flaky(store.open_input_file(p), entries[2][1] + 60, left)

    group = entries[:5]
    read = lambda: [m for m in reader._members(Store(), path, Store().open_input_file(path), group)]
    if works:
        assert [n for n, _, _ in read()] == [e[0] for e in group] and Store.opened == 1 + times
    else:
        with pytest.raises(media.MediaError):
            read()


def test_slices_are_bounded():
    assert SLICE_ROWS <= 1024


def test_a_small_table_and_small_chunks_give_the_same_ids(path, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 50)
    small, whole = packing.WordTokenizer(path, True, 40), packing.WordTokenizer(path, False)
    texts = [" ".join(f"Wörter{i % 90},\t{i}th <|endoftext|> ÉTÉ!! a\x1cb x y" for i in range(k, k + 5)) for k in range(60)] + ["", " ", "x" * 300, "\n\n"]
    for _ in range(2):
        assert small.many(texts) == [whole.ids(t) for t in texts]
    assert len(small.keys) <= 40 and small.direct


def test_copies_of_a_row_spread_over_groups(spark):
    parts = spark.range(4000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "600L AS length", "1L AS ids_crc32")
    rows = packing.pack(parts, group_rows=500).collect()
    assert len({r.sequence_id >> 28 for r in rows}) > 4 and check_packed(rows, 4096) <= 4000 // 6 + 8


def thue_morse(n):
    """Two words of 2**n letters each that a polynomial modulo a power of two can't tell apart."""
    word = ""
    for i in range(1 << n):
        word += "ab"[i.bit_count() & 1]
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_any_length_have_their_own_ids(path):
    texts = [*thue_morse(10), *thue_morse(5), *thue_morse(6), "x" * 63, "x" * 64, "x" * 65, "é" * 50_000, "ab" * 50_000, "wörd" * 16]
    fast, whole = packing.WordTokenizer(path, True), packing.WordTokenizer(path, False)
    assert fast.many(texts) == [whole.ids(t) for t in texts]
    assert fast.many([" ".join(texts)]) == [whole.ids(" ".join(texts))]


def test_equal_hashes_of_different_words_are_found(path):
    """With a table that gives every word one key, the second hash tells, and texts are tokenized whole."""
    fast, whole = packing.WordTokenizer(path, True), packing.WordTokenizer(path, False)
    fast.tables[0] = fast.tables[0] * 0
    texts = ["one two three", "two", "one"]
    assert fast.many(texts) == [whole.ids(t) for t in texts] and fast.many(["three"]) == [whole.ids("three")]
    assert fast.many(["one", "one"]) == [whole.ids("one")] * 2


def test_every_id_of_documents(spark, sf, path):
    tokenizer = Tokenizer.from_file(path)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in queries.op1_best_fit_packing(spark, sf).collect()}
    want = {}
    for r in queries.documents(spark, sf).collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 4096):
            want[r.doc_id, i // 4096] = (i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes()))
    assert got == want
