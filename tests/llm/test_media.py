import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tempograph.llm import media, webp
from tempograph.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def pictures(draw, kind):
    height, width = draw.integers(1, 30, 2)
    if kind == 0:
        return draw.integers(0, 2**32, (height, width), dtype="uint64").astype("uint32")
    if kind == 1:
        return draw.integers(0, draw.integers(1, 30), (height, width)).astype("uint32") * np.uint32(0x01020304) | np.uint32(0xFF000000)
    return np.add.outer(np.arange(height), np.arange(width)).astype("uint32") * np.uint32(0x010101) | np.uint32(0xFF000000)


@pytest.mark.parametrize("seed", range(40))
def test_every_part_of_the_format(seed):
    draw = np.random.default_rng(seed)
    for kind in range(3):
        x, grain = pictures(draw, kind), int(draw.integers(2, 5))
        blocks = tuple((s + (1 << grain) - 1) >> grain for s in x.shape)
        how = {"grain": grain, "cached": int(draw.integers(0, 12)), "references": bool(draw.integers(2)), "blocks": int(draw.choice([0, 2, 3]))}
        if draw.integers(3) == 0 and len(np.unique(x)) <= 256:
            how["palette"] = True
        else:
            how |= {"predictor": draw.integers(0, 14, blocks)} if draw.integers(2) else {}
            how |= {"cross": draw.integers(0, 2**24, blocks)} if draw.integers(2) else {}
            how |= {"green": True} if draw.integers(2) else {}
        assert (webp.decode(webp.encode(x, **how)) == x).all(), how


@pytest.mark.parametrize("mode", range(16))
def test_each_predictor(mode):
    x = np.random.default_rng(mode).integers(0, 2**32, (9, 11), dtype="uint64").astype("uint32")
    assert (webp.decode(webp.encode(x, predictor=np.full((3, 3), mode), grain=2)) == x).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes_of_each_depth(colours):
    draw = np.random.default_rng(colours)
    some = np.unique(draw.integers(0, 2**32, colours, dtype="uint64").astype("uint32"))
    x = some[draw.integers(0, len(some), (13, 21))]
    assert (webp.decode(webp.encode(x, palette=True, references=True)) == x).all()


def test_prediction_rules():
    left, top, right, corner = (np.array(v, "int32") for v in ([255, 10, 20, 30], [255, 40, 50, 60], [255, 7, 8, 9], [255, 25, 35, 45]))
    told = lambda m: webp.predicted(m, left, top, right, corner).tolist()
    assert told(5) == [255, 24, 32, 39] and told(7) == [255, 25, 35, 45] and told(10) == [255, 20, 28, 35]
    assert told(12) == [255, 25, 35, 45] and told(13) == [255, 25, 35, 45]
    assert told(11) == top.tolist()  # a tie goes to the top
    assert webp.predicted(11, left, top, right, top - 1).tolist() == left.tolist()
    assert webp.predicted(12, np.array([255, 250, 0, 5]), np.array([255, 250, 0, 5]), right, np.array([255, 0, 200, 5])).tolist() == [255, 255, 0, 5]
    assert webp.predicted(13, np.array([0, 0, 0, 0]), np.array([0, 0, 0, 0]), right, np.array([3, 3, 3, 3])).tolist() == [0, 0, 0, 0]


def test_a_file_written_by_hand():
    """One pixel, simple codes of one symbol each: green 2, red 1, blue 3, alpha 255; every bit as the format says."""
    bits, n = 0, 0
    fields = [(0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for symbol in (2, 1, 3, 255, 0):
        fields += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    for value, width in fields:
        bits |= value << n
        n += width
    body = b"\x2f" + bits.to_bytes((n + 7) // 8, "little")
    data = b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    assert webp.decode(data).tolist() == [[0xFF010203]]


def test_distance_codes():
    assert len(webp.NEAR) == len(set(webp.NEAR)) == 120 and all(0 <= y <= 8 and abs(x) <= 8 for x, y in webp.NEAR)
    far = [x * x + y * y for x, y in webp.NEAR]
    assert far == sorted(far)
    for x in (1, 2, 3, 4, 5, 100, 4096, 16_384):
        p, extra, width = webp.prefix(x)
        bits = webp.Bits(extra.to_bytes(8, "little"))
        assert bits.number(p) == x and bits.at == width


@pytest.mark.parametrize("data", [b"", b"RIFF" + b"\0" * 40, webp.encode(np.zeros((3, 3), "uint32"))[:21], webp.encode_samples(np.arange(576) .astype("uint8"), 192, 0)[:200]])
def test_broken_files(data):
    with pytest.raises(webp.WebPError):
        webp.decode(data)


@pytest.mark.parametrize("raw", [b"", b"\xff" * 576, b"a" * 100_000, bytes(range(256)) * 700, np.random.default_rng(0).bytes(50_000), "é的 text, ".encode() * 3000])
def test_payload_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 576 == 0 and payload and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
    assert b"".join(map(media.samples, media.load(media.store(payload)))) == payload


def test_long_payloads_are_runs_of_files(monkeypatch):
    monkeypatch.setattr(media, "MOST", 3)
    payload = media.padded(b"abc" * 2000)
    found = list(media.load(media.store(payload)))
    assert [len(x) for x in found] == [3, 3, 3, 2] and b"".join(map(media.samples, found)) == payload


def test_stretches_meet(monkeypatch):
    monkeypatch.setattr(webp, "STRETCH", 1 << 10)
    payload = media.padded(np.random.default_rng(1).bytes(9000) + b"text " * 900)
    assert b"".join(map(media.samples, media.load(media.store(payload)))) == payload
    x = np.random.default_rng(2).integers(0, 40, (40, 40)).astype("uint32")
    assert (webp.decode(webp.encode(x, cached=5, references=True)) == x).all()


@pytest.mark.parametrize("where", ["data", "awkward"])
def test_media_query(spark, tables, where):
    path = DATA if where == "data" else tables
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()), key=str)
    found = sorted(queries()["op9_lossless_webp"](spark, path).collect(), key=lambda r: str((r["doc_id"], None)))
    by_text = {}
    assert len(found) == len(texts)
    expected = {}
    for d, t in texts:
        raw = t.encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        expected.setdefault(d, []).append((len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    for r in found:
        own = (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])
        assert own in expected[r["doc_id"]]
        assert by_text.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def parts_of(data):
    """What a file makes use of, by its first bits: transforms, and whether there is a cache; references by decoding."""
    size, seen = struct.unpack_from("<I", data, 16)[0], set()
    bits = webp.Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    while bits.read(1):
        kind = bits.read(2)
        seen.add(("predictor", "cross", "green", "palette")[kind])
        if kind in (webp.PREDICTOR, webp.CROSS):
            grain = bits.read(3) + 2
            webp.picture(bits, (width + (1 << grain) - 1) >> grain, (height + (1 << grain) - 1) >> grain, False)
        elif kind == webp.PALETTE:
            n = bits.read(8) + 1
            webp.picture(bits, n, 1, False)
    if cached := (bits.read(4) if bits.read(1) else 0):
        seen.add("cache")
    bits.read(1)
    green = bits.code(280 + ((1 << cached) if cached else 0))
    if green.lengths[256:280].any():
        seen.add("references")
    return seen


def test_the_query_makes_use_of_every_part(spark, tmp_path):
    """Texts that each part makes smaller: all of them are in the query's own files, and come back."""
    draw = np.random.default_rng(3)
    ramp = "".join(chr(33 + k % 90) for k in range(4000))
    wave = "".join(chr(int(75 + 40 * np.sin(k / 90))) for k in range(9000))
    tied = "".join(3 * chr(c) for c in draw.integers(33, 120, 4000))
    few = "".join("".join(p) for p in draw.choice(["abc", "xyz", "123", "..,", "the"], 3000))
    prose = " ".join(draw.choice(["the", "of", "house", "river", "in", "and", "stone", "light"], 3000))
    letters = "".join(chr(c) for c in draw.integers(97, 123, 30_000))
    rows = list(enumerate([ramp, wave, tied, few, prose, letters, "short"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    files = {r["id"]: bytes(r["media"]) for r in media.stored(spark.createDataFrame(rows, "id long, text string")).collect()}
    used = {k: parts_of(m) for k, m in files.items()}
    assert {"predictor", "cross", "palette", "cache", "references"} <= set().union(*used.values()), used
    for r in queries()["op9_lossless_webp"](spark, f"file://{tmp_path}").collect():
        payload = media.padded(dict(rows)[r["doc_id"]].encode())
        assert (r["payload_sha256"], r["media_sha256"]) == (sha256(payload).hexdigest(), sha256(files[r["doc_id"]]).hexdigest())


def test_files_of_the_data_are_smaller_and_make_use_of_parts(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    payloads = [media.padded(t.encode()) for t in texts]
    files = [media.store(p) for p in payloads]
    used = [parts_of(m) for m in files]
    assert sum("references" in u for u in used) > 0.9 * len(used) and any("cache" in u for u in used) and any("palette" in u for u in used)
    assert sum(map(len, files)) < 0.75 * sum(len(webp.encode_samples(np.frombuffer(p, "uint8"), 192, 8192)) for p in payloads)


@pytest.mark.parametrize("seed", range(30))
def test_payloads_of_every_kind(seed):
    draw = np.random.default_rng(seed)
    n = int(draw.choice([1, 5, 192, 700, 3000])) * 3
    raw = [draw.bytes(n), bytes(n), bytes(draw.integers(0, 3, n).astype("uint8")), (np.arange(n) // 7 % 251).astype("uint8").tobytes(), b"ab" * n, np.repeat(draw.integers(0, 255, n // 3), 3).astype("uint8").tobytes()][seed % 6]
    payload = media.padded(raw)
    assert b"".join(map(media.samples, media.load(media.store(payload)))) == payload


@pytest.mark.parametrize("seed", range(12))
def test_references_and_cache_are_filled_as_pixel_by_pixel(seed):
    """Literals, cached pixels (also of empty places) and references (overlapping ones, and ones that repeat cached pixels), against a plain loop."""
    draw, shift = np.random.default_rng(seed), 30 - seed % 3
    x, slot, references = np.zeros(400, "uint32"), np.full(400, -1, "int16"), []
    plain, held = [], [0] * (1 << (32 - shift))
    while (n := len(plain)) < 400:
        kind = int(draw.integers(3))
        if kind == 0:
            x[n] = draw.integers(0, 9) * 0x01020305
            new = [int(x[n])]
        elif kind == 1:
            slot[n] = draw.integers(len(held))
            new = [held[slot[n]]]
        elif n:
            length, distance = int(min(draw.integers(1, 40), 400 - n)), int(draw.integers(1, min(n, 20) + 1))
            references.append((n, length, distance))
            new = [plain[n - distance + k % distance] for k in range(length)]
        else:
            continue
        plain += new
        for p in new:
            held[(p * webp.HASH & 0xFFFFFFFF) >> shift] = p
    assert webp.filled(x, slot, references, shift).tolist() == plain


def test_lengths_told_at_once_are_those_told_one_by_one():
    """The lengths of a code by stretches of 16 bits, which a file's own code-length code has too; before, there were none."""
    code = webp.code_of(webp.DESCRIBED_BY.tobytes())
    for lengths in ([0] * 280, [1, 1] + [0] * 278, [8] * 256 + [0] * 24, [0, 5, 5, 5, 5, 0, 0, 0, 7] * 31 + [0], list(np.random.default_rng(5).integers(0, 12, 280))):
        out = webp.Writer()
        out.put(*webp.sizes_told(webp.DESCRIBED_BY.tobytes()))
        for run in webp.runs_of(np.array(lengths, "uint8")):
            out.put(*webp.run_word(webp.DESCRIBED_BY.tobytes(), *run))
        bits, told = out.value >> webp.sizes_told(webp.DESCRIBED_BY.tobytes())[1], []
        while bits and len(told) < 280:
            found, width, _ = code.chunk(bits & 0xFFFF)
            if not width:  # a repeat of what came before, or more than 16 bits
                break
            told += found
            bits >>= width
        assert told[:280] == lengths[: len(told[:280])]
    assert code.chunks


def test_files_are_read_where_they_are_made(spark, documents):
    """The query's rows are those of the two steps, in one Python worker instead of two."""
    docs = documents.selectExpr("doc_id as id", "text")
    found, steps = media.stored_and_read_back(docs), media.read_back(media.stored(docs))
    assert found.dtypes == steps.dtypes and sorted(map(str, found.collect())) == sorted(map(str, steps.collect()))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
