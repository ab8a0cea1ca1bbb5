import base64
import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import packing, warc

PAGES = "page_id long, url string, html string"
INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_archives(spark):
    rows = [(1, "u", "x" * 1000), (2, "u", "a" + INNER + "b" + INNER * 2), (3, "u", None), (4, None, ""), (5, "u", "é" * 700), (6, "u", "a" + INNER + "b" + INNER * 2)]
    rows += [(None, "u", "zz"), (7, "u\r\nX: y", "WARC/1.0\r\n"), (8, "u", "WARC/1.0\r\n" * 3 + "\r\n\r\n"), (2, "u", rows[1][2]), (9, "u", "WAR"), (10, "u", INNER * 30), (11, "u", "zz")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "k": F.lit(2), "latest": F.lit(3)}).coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # splits that cut records
    try:
        got = sorted(map(str, (tuple(x) for x in warc.archived(df).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        latest = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        again = latest is not None and (i is None or i < latest)
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", latest if again else None))
    assert got == sorted(map(str, want))
    assert warc.archived(df.limit(0)).count() == 0


def test_header():
    assert warc.header_of(b"A: b\r\nContent-Length: 12\r\n\r\nx") == (28, {"a": "b", "content-length": "12"})
    for bad in (b"", b"A: b", b"A: b\r\n\r\n", b"Content-Length: -1\r\n\r\n", b"no colon\r\nContent-Length: 1\r\n\r\n"):
        assert warc.header_of(bad) is None


def test_plan_uses_every_piece():
    r = np.random.default_rng(0)
    counts = np.bincount(r.integers(1, 2049, 3000), minlength=2049)
    counts[17] += 100_000
    plan = packing.plan_bins(counts, 2048)
    used = np.zeros(2049, dtype=np.int64)
    for times, lengths in plan:
        assert sum(lengths) <= 2048
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    total = int((counts * np.arange(2049)).sum())
    assert sum(t for t, _ in plan) <= -(-total // 2048) * 1.01 + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    library.encode_special_tokens = True
    texts = [None, "", " ", "Hello, world! It's  fine.\n\n x", "word " * 5000, "é€𝄞 ß×", "a" * 3000, "same", "same", "\0 x", "x y 12", "it'll don't 'S"]
    df = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"length": F.lit(1), "piece": F.lit(9), "rank": F.lit(1)})
    got = packing.pack_documents(df, with_ids=True).collect()
    by_doc = {}
    for x in got:
        by_doc.setdefault(x.doc_id, []).append(x)
    for i, t in enumerate(texts):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by_doc[i if i != 7 else None], key=lambda x: x.piece)
        assert b"".join(bytes(x.ids) for x in pieces) == want.tobytes()
        assert [x.start for x in pieces] == list(np.cumsum([0, *(x.length for x in pieces[:-1])]))
        assert all(x.length == 2048 for x in pieces[1:]) and all(zlib.crc32(bytes(x.ids)) == x.ids_crc32 for x in pieces)
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_another_vocabulary_goes_whole():
    """The cuts hold for one kind of file; texts of another are encoded by the library alone."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    tokens, library = packing.TokenIds(path), Tokenizer.from_file(path)
    texts = [b"Hello, world! It's  fine.", b"", "é x 12".encode()]
    assert packing.fits(packing.tokenizer_path()) and tokens.piece is None
    assert [x.tolist() for x in tokens.encode(texts)] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]
