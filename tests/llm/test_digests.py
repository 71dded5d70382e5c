"""Digest columns of the registered queries, worked out again from the texts alone."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tests.llm.test_operators import SECRETS, brute_spans
from trustlake.llm import mpegts, queries

P = pytest.importorskip("public_tokenizers")
TEXTS = [*SECRETS, "x" * 191, "é" * 96, "日本 text " * 4000, "a  b\n<|endoftext|> 'll", "x" * 191]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("digests"))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


def test_secret_columns(spark, folder):
    kinds = ("assign", "access", "hex")
    rows = queries.QUERIES["op4_secret_ownership"](spark, folder).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = [f"{kinds[k]}:{s}:{e}" for s, k, e in brute_spans(TEXTS[r.doc_id] or "")]
        assert r.base_sha256 == sha(",".join(want).encode())
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in kinds)


def test_token_columns(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    from trustlake.llm import bpe

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in queries.QUERIES["op6_byte_bpe"](spark, folder).collect():
        text = TEXTS[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def test_media_columns(spark, folder):
    rows = queries.QUERIES["op9_mpeg_transport"](spark, folder).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = mpegts.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media)) and f"packets={len(media) // 188};" in r.feature and r.feature.endswith("errors=0")


def test_damaged_streams_never_fail():
    rng = random.Random(9)
    for n in range(400):
        media = bytearray(mpegts.mux(rng.randbytes(rng.choice([192, 3072, 3073, 30_000]))))
        for _ in range(rng.randint(1, 20)):
            at = rng.randrange(len(media) // 188) * 188
            kind = rng.randrange(4)
            if kind == 0:
                media[rng.randrange(len(media))] ^= 1 << rng.randrange(8)
            elif kind == 1 and len(media) > 188:
                del media[at : at + 188]
            elif kind == 2:
                media[at + 3] |= 0x30
                media[at + 4] = rng.choice([0, 175, 180, 183, 184, 255])
            else:
                media[at + 4 : at + 8] = rng.randbytes(4)
        mpegts.demux(bytes(media))
        mpegts.demux(bytes(media[: rng.randrange(len(media))]))


def test_short_first_packets_are_counted():
    for length in (175, 183):
        media = bytearray(mpegts.mux(b"q" * 400))
        media[2 * 188 + 4] = length
        found = mpegts.demux(bytes(media))
        assert found[4] == 1 and found[3] == 0


def test_packets_sent_twice_count_once():
    media = mpegts.mux(b"q" * 5000)
    twice = media[: 188 * 5] + media[188 * 4 : 188 * 5] + media[188 * 5 :]
    assert mpegts.demux(twice)[:5] == mpegts.demux(media)[:5]
    thrice = media[: 188 * 5] + media[188 * 4 : 188 * 5] * 2 + media[188 * 5 :]
    assert mpegts.demux(thrice)[3] == 1


def test_sections_reach_over_packets():
    programs = [(n, 0x1000 if n == 60 else 0x1500 + n) for n in range(60, 130)]
    body = b"".join(n.to_bytes(2) + (0xE000 | pid).to_bytes(2) for n, pid in programs)
    section = b"\x00" + (0xB000 | len(body) + 9).to_bytes(2) + b"\x00\x01\xc1\x00\x00" + body
    section += mpegts.crc32_mpeg(section).to_bytes(4)
    first = b"\x47\x40\x00\x10\x00" + section[:183]
    second = (b"\x47\x00\x00\x11" + section[183:]).ljust(188, b"\xff")
    media = first + second + mpegts.mux(b"q" * 1000)[188:]
    found = mpegts.demux(media)
    assert found[0] == b"q" * 1000 and found[2:8] == (0, 0, 0, 60, 0x1000, 0x100)
    assert mpegts.demux(first + media[376:])[6] is None
