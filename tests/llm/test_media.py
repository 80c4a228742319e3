import hashlib
import zlib

import numpy as np
import pytest

from pitlake.llm import media


def plain(img):
    """One image decoded bit by bit."""
    bits = np.unpackbits(img.data)
    codes = {}
    for key, spec in img.huffman.items():
        code, at, codes[key] = 0, 16, {}
        for length in range(1, 17):
            for s in spec[at : at + spec[length - 1]]:
                codes[key][(length, code)] = s
                code += 1
            at += spec[length - 1]
            code <<= 1
    h, v = (max(p[1] for p in img.parts), max(p[2] for p in img.parts)) if len(img.parts) > 1 else (1, 1)
    total = -(-img.width // (8 * h)) * -(-img.height // (8 * v))
    each, out = img.restart or total, []
    for seg, start in enumerate(img.starts):
        pos, last = int(start) * 8, [0] * len(img.parts)

        def take(n):
            nonlocal pos
            x = 0
            for _ in range(n):
                x = x * 2 + int(bits[pos])
                pos += 1
            return x

        def symbol(key):
            code = 0
            for length in range(1, 17):
                code = code * 2 + take(1)
                if (length, code) in codes[key]:
                    return codes[key][(length, code)]
            raise AssertionError

        def value(n):
            x = take(n)
            return x if not n or x >> (n - 1) else x - (1 << n) + 1

        for _ in range(min(each, total - seg * each)):
            for k, p in enumerate(img.parts):
                for _ in range(p[1] * p[2] if len(img.parts) > 1 else 1):
                    block = [0] * 64
                    last[k] += value(symbol(p[4]))
                    block[0], n = last[k], 1
                    while n < 64:
                        s = symbol(p[5])
                        if s == 0:
                            break
                        n += s >> 4
                        x = value(s & 15)
                        if n < 64:
                            block[n] = x
                        n += 1
                    out.append(block)
    return np.array(out)


def colour(seed, width, height, restart):
    """A three-component image with runs, ends of block and stuffed bytes, from made-up bits of fixed tables."""
    rng = np.random.default_rng(seed)
    dc = bytes([0, 2, 3, *[0] * 13, 0, 1, 2, 3, 4])
    ac = bytes([0, 2, 2, 4, *[0] * 12, 0x00, 0x01, 0x02, 0x11, 0x31, 0xF0, 0x23, 0x07])

    def codes(spec):
        out, code, at = {}, 0, 16
        for length in range(1, 17):
            for s in spec[at : at + spec[length - 1]]:
                out[s] = f"{code:0{length}b}"
                code += 1
            at += spec[length - 1]
            code <<= 1
        return out

    cd, ca = codes(dc), codes(ac)
    put = lambda x, n: "" if not n else f"{x if x > 0 else x + (1 << n) - 1:0{n}b}"
    across, down = -(-width // 16), -(-height // 16)
    segments, bits = [], ""
    for m in range(across * down):
        for _ in range(6):
            n = int(rng.integers(0, 5))
            bits += cd[n] + put(int(rng.choice([-1, 1])) * (1 << (n - 1)) if n else 0, n)
            k = 1
            while k < 64:
                s = int(rng.choice([0x00, 0x01, 0x02, 0x11, 0x31, 0xF0, 0x23, 0x07]))
                if k + (s >> 4) + (s != 0) > 64 or s == 0xF0 and k + 16 > 63:
                    s = 0
                size = s & 15
                bits += ca[s] + put(int(rng.choice([-1, 1])) * ((1 << size) - 1) if size else 0, size)
                if not s:
                    break
                k += (s >> 4) + 1
        if restart and (m + 1) % restart == 0 and m + 1 < across * down:
            segments.append(bits)
            bits = ""
    segments.append(bits)
    scan = b""
    for i, s in enumerate(segments):
        s += "1" * (-len(s) % 8)
        scan += bytes(int(s[j : j + 8], 2) for j in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")
        scan += bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(segments) else b"\xff\xd9"
    seg = media._segment
    return (
        b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([4] * 64))
        + seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + seg(0xC4, b"\x00" + dc + b"\x10" + ac) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"")
        + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan
    )


def test_general_decoder_against_bitwise():
    raw = [colour(s, w, h, r) for s, (w, h, r) in enumerate([(40, 33, 2), (16, 16, 0), (70, 20, 1), (40, 33, 2)])]
    images = [media.parse(x) for x in raw]
    for img, got in zip(images, media.coefficients(images)):
        assert np.array_equal(got, plain(img))
        thumb = media.thumbnail(img, got)
        assert thumb.shape == (-(-img.height // 8), -(-img.width // 8))
        assert thumb[0, 0] == np.clip(np.rint(got[0, 0] * 4 / 8 + 128), 0, 255)


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "ab\n" * 50, "äöü\u0000\U0001f600" * 40, "y" * 200_000])
def test_round_trip(text):
    n, p = media.payload(text)
    assert n == len((text or "").encode()) and len(p) % 64 == 0 and len(p) > 0
    raw = media.encode([p, bytes(range(256)) * 4])
    images = [media.parse(x) for x in raw]
    both = media.coefficients(images)
    assert [media.read_back(i, b) for i, b in zip(images, both)] == [p, bytes(range(256)) * 4]
    assert np.array_equal(both[0], plain(images[0])) or len(p) > 10_000


def test_bad_bytes():
    good = media.encode([media.payload("some text")[1]])[0]
    for bad in (b"", b"GIF89a", good[:40], good[:-2]):
        with pytest.raises(ValueError):
            media.coefficients([media.parse(bad)])


def test_zigzag():
    assert media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert sorted(media.zigzag()) == list(range(64))


def test_columns(spark):
    rows = [(1, "one\ntwo", "x"), (None, None, "y"), (3, "", None), (3, "", None), (4, "ö" * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.describe(media.store(docs)).collect()
    assert len(got) == 5
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        n, p = media.payload(text)
        assert (r.n_bytes, r.payload_bytes) == (n, len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
    assert len({(r.media_sha256, r.feature) for r in got if r.n_bytes == 0}) == 1
    assert media.describe(media.store(docs.limit(0))).count() == 0


def test_null_broken_and_clashing(spark):
    good = media.encode([media.payload("some text")[1]])[0]
    broken = [b"", b"no image", good[:40], good[:-30], good[:200] + bytes(20) + good[220:], colour(1, 16, 16, 0)[:-40], good.replace(b"\xff\xc4", b"\xff\xc2", 1), b"\xff\xd8\xff\xc0\x00\x02"]
    huge = good.replace((8).to_bytes(2, "big") + (8).to_bytes(2, "big"), b"\xff\xf8\xff\xf8", 1)
    rows = [(i, x, "kept", -1) for i, x in enumerate([None, good, *broken, huge, good])]
    got = media.describe(spark.createDataFrame(rows, "doc_id long, media binary, feature string, Width int").coalesce(1)).orderBy("doc_id").collect()
    assert len(got) == len(rows) and got[0].media_sha256 is None and got[0].error is None
    want = media.describe(media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))).collect()[0]
    for r in (got[1], got[-1]):
        assert r.error is None and (r.payload_sha256, r.feature, r.media_sha256) == (want.payload_sha256, want.feature, want.media_sha256)
    assert sum(r.error is not None for r in got[2:-1]) >= len(broken) - 1
    for r in got[2:-1]:
        assert r.media_bytes is not None and (r.error is None) == (r.feature is not None)
    assert got[-2].error == "the scan ends early"
