"""Lossless WebP round trips: every transform, back-references, colour cache and code groups."""

import numpy as np
import pytest

from inodelake.llm import media, webp

RNG = np.random.default_rng(7)


def picture(height, width, colours=None):
    if colours:
        return RNG.choice(RNG.integers(0, 1 << 32, colours, dtype=np.uint32), (height, width))
    return RNG.integers(0, 1 << 32, (height, width), dtype=np.uint32)


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    image = picture(9, 13)
    assert (webp.decode(webp.encode(image, webp.Tools((webp.PREDICTOR,), modes=(mode,)))) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colours):
    image = picture(7, 11, colours)
    assert (webp.decode(webp.encode(image, webp.Tools((webp.COLOUR_INDEXING,)))) == image).all()


@pytest.mark.parametrize("transforms", [(2,), (1,), (0, 1, 2), (1, 0), (3, 0), (2, 1, 0)])
@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("group_bits", [0, 2])
def test_tools_together(transforms, cache_bits, group_bits):
    image = picture(10, 17, 40)
    tools = webp.Tools(transforms, modes=(1, 5, 11, 12, 13), elements=(0xFF102030, 0xFFF0E0D0, 0xFF7F8001), cache_bits=cache_bits, group_bits=group_bits)
    assert (webp.decode(webp.encode(image, tools)) == image).all()


@pytest.mark.parametrize("cache_bits", [0, 4])
def test_back_references(cache_bits):
    width = 12
    image = picture(8, width, 30)
    flat = image.ravel()
    copies = []
    for at, length, code in ((20, 5, 1), (30, 12, 120 + 7), (50, 3, 2), (60, 36, 4)):
        distance = webp._distance(code, width)
        for k in range(at, at + length):
            flat[k] = flat[k - distance]
        copies.append((at, length, code))
    assert (webp.decode(webp.encode(image, webp.Tools(copies=copies, cache_bits=cache_bits))) == image).all()


def test_distances_and_prefixes():
    assert len(set(webp.DISTANCE_MAP)) == 120
    assert webp._distance(1, 10) == 10 and webp._distance(2, 10) == 1 and webp._distance(121, 10) == 1
    for value in [*range(1, 300), 4096]:
        symbol, extra, bits = webp._prefix(value)
        w = webp._Writer()
        w.put(extra, bits)
        w.put(1, 1)
        assert webp._unprefix(symbol, webp._Reader(w.done())) == value


@pytest.mark.parametrize("raw", [b"", b"a", b"the quick brown fox " * 50, bytes(range(256)) * 9, "æøå €😀".encode() * 40, b"x" * 64])
def test_payloads(raw):
    payload = media.pad(raw)
    assert len(payload) % 64 == 0 and payload.startswith(raw) and media.load(media.store(payload)) == payload


def test_payload_of_several_files(monkeypatch):
    monkeypatch.setattr(webp, "SIDE", 4)
    payload = media.pad(RNG.bytes(1000))
    stored = media.store(payload)
    assert stored.count(b"RIFF") == 4 and media.load(stored) == payload


def test_skewed_counts_stay_within_fifteen_bits():
    counts = np.array([1 << k for k in range(30)])
    lengths = webp.code_lengths(counts)
    assert lengths.max() <= 15 and (2.0 ** -lengths).sum() == 1


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxWEBPVP8 ")
    good = webp.encode(picture(8, 8))
    with pytest.raises(ValueError):
        webp.decode(good[:16] + (20).to_bytes(4, "little") + good[20:40])


def test_top_predictor_as_arrays():
    image = picture(11, 7)
    assert (webp._from_top(webp._from_top(image, True).reshape(image.shape), False) == image).all()
    modes = np.full(4, webp.TOP << 8, np.uint32)
    mixed = np.array([webp.TOP << 8, webp.TOP << 8, webp.TOP << 8, 11 << 8], np.uint32)
    plain = webp._guessed(image.ravel(), 7, 11, 3, mixed, True).reshape(image.shape)  # pixel by pixel
    assert (webp._guessed(image.ravel(), 7, 11, 3, modes, True).reshape(image.shape)[:8] == plain[:8]).all()


def test_tools_by_content():
    rows = np.arange(64 * 16, dtype=np.uint32).reshape(64, 16) * np.uint32(0x01030507)
    prose = np.frombuffer(media.pad(b"".join(RNG.choice([b"the ", b"cat ", b"sat on ", b"a mat, ", b"while it rained "], 400))), "<u4").reshape(-1, 16)
    cases = {
        "copies": np.tile(picture(1, 16), (40, 1)), "palette": picture(40, 16, 30), "cache": np.concatenate([picture(3, 16), picture(3, 16, 12)]), "top": rows, "any": picture(40, 16), "prose": prose,
    }
    tools = {name: webp.tools_for(image) for name, image in cases.items()}
    assert tools["copies"].copies and tools["palette"].transforms == (webp.COLOUR_INDEXING,) and tools["top"].transforms == (webp.PREDICTOR,)
    assert tools["cache"].cache_bits and not tools["cache"].copies and not tools["any"].transforms
    for name, image in cases.items():
        stored = webp.encode(image, tools[name])
        assert (webp.decode(stored) == image).all() and (name in ("any", "prose") or len(stored) < len(webp.encode(image)))


def bits(*parts):
    """Bytes of (value, bits) pairs, least bit first, as the format's description packs them."""
    number = at = 0
    for value, size in parts:
        number |= value << at
        at += size
    body = number.to_bytes((at + 7) // 8, "little")
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def head(width, height):
    return (0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)


def one(symbol):
    """A simple prefix code of one symbol of eight bits."""
    return (1, 1), (0, 1), (1, 1), (symbol, 8)


NO_DISTANCE = ((1, 1), (0, 1), (0, 1), (0, 1))


def test_hand_made_files():
    plain = bits(*head(3, 2), (0, 1), (0, 1), (0, 1), *one(0x22), *one(0x11), *one(0x33), *one(0xFF), *NO_DISTANCE)
    assert (webp.decode(plain) == np.full((2, 3), 0xFF112233, np.uint32)).all()
    # Two green values under a code of one bit each: pixels 5, 9, 9, 5.
    two = ((1, 1), (1, 1), (1, 1), (5, 8), (9, 8))
    green = bits(*head(2, 2), (0, 1), (0, 1), (0, 1), *two, *one(0), *one(0), *one(0xFF), *NO_DISTANCE, (0, 1), (1, 1), (1, 1), (0, 1))
    assert webp.decode(green).ravel().tolist() == [0xFF000500, 0xFF000900, 0xFF000900, 0xFF000500]
    # The same, with green taken from red and blue before: each gets it back.
    less = bits(*head(2, 2), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *two, *one(1), *one(2), *one(0xFF), *NO_DISTANCE, (0, 1), (1, 1), (1, 1), (0, 1))
    assert webp.decode(less).ravel().tolist() == [0xFF060507, 0xFF0A090B, 0xFF0A090B, 0xFF060507]
    # A predictor image of one block, mode 1 (left): residuals of 5 in green add up along the row, from black.
    left = bits(*head(4, 1), (1, 1), (0, 2), (0, 3), (0, 1), *one(1), *one(0), *one(0), *one(0xFF), *NO_DISTANCE, (0, 1), (0, 1), (0, 1), *one(5), *one(0), *one(0), *one(0), *NO_DISTANCE)
    assert webp.decode(left).ravel().tolist() == [0xFF000500, 0xFF000A00, 0xFF000F00, 0xFF001400]
