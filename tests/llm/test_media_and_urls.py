"""Stored media as their headers say, features by plain loops, and some hundreds of url rules against all of them."""

import random
import re

import pytest

from gridloom.llm import media as M
from gridloom.llm import url_filter as U


def file_of(payload: bytes, rate: int, serials=(5, 9), length=None, channels=1) -> bytes:
    """Another writer: other serials, rate and packets."""
    import struct
    import zlib

    one, two = M._Stream(serials[0]), M._Stream(serials[1])
    out = [*two.pages([M.MARKS_HEAD.pack(M.MARKS_NAME, 1, 3)], 0, M.FIRST), *one.pages([M.SAMPLES_HEAD.pack(M.SAMPLES_NAME, channels, rate, len(payload) if length is None else length)], 0, M.FIRST)]
    half = len(payload) // 2
    out += [*one.pages([payload[:half]], half), *one.pages([payload[half:]], len(payload), M.LAST)]
    out += two.pages([struct.pack("<QI", half, zlib.crc32(payload[:half]))], half, M.LAST)
    return b"".join(out)


def test_files_of_another_writer():
    payload = bytes(range(256)) * 3
    back, n, samples, rate = M.decode_samples(file_of(payload, 100))
    assert (back, n, rate) == (payload, 3, 100) and samples.seconds(rate)[-1] == 7.68
    for wrong in (file_of(payload, 100, length=5), file_of(payload, 0), file_of(payload, 100, channels=2)):
        with pytest.raises(ValueError):
            M.decode_samples(wrong)


def test_feature_by_a_plain_loop():
    draw = random.Random(2)
    for n in (64, 128, 64 * 200):
        payload = bytes(draw.randrange(256) for _ in range(n))
        back, _, samples, rate = M.decode_samples(M.write_ogg(payload, n))
        wave = [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(wave, wave[1:], strict=False))
        packets = -(-n // M.PACKET)
        want = f"s={n / M.RATE:.6f};packets={packets};mean={sum(wave) / n:.6f};rms={(sum(w * w for w in wave) / n) ** 0.5:.6f};zcr={crossings / n:.6f}"
        assert back == payload and M.feature_of(back, samples, rate) == want


@pytest.mark.parametrize("inline", [10_000, 0])
def test_many_rules_against_all_of_them(spark, monkeypatch, inline):
    monkeypatch.setattr(U, "INLINE_RULES", inline)
    draw = random.Random(4)
    label = lambda: draw.choice(["a", "b", "shop", "x1", "news"])
    host = lambda: ".".join([*(label() for _ in range(draw.randint(0, 2))), draw.choice(["org", "com", "de"])])
    path = lambda: "/".join(draw.choice(["en", "fr", "page1", "page12", "A", ""]) for _ in range(draw.randint(1, 3)))
    rules = [U.path_rule(draw.choice(["allow", "block"]), name) for name in sorted({f"{host()}/{path()}" for _ in range(400)})] + [U.host_word_rule(w) for w in ("shop", "x1")]
    urls = [f"http://{draw.choice(['', 'www.', 'Shop-'])}{host()}/{path()}{draw.choice(['', '?q', '#t', '2'])}" for _ in range(400)] + ["http://a.org/" + "en/" * 30_000, None, "", "http://a.org"]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules=rules).collect()}
    for k, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        h, p = (m[1].lower(), m[2]) if m else ("", "")
        own = [r for r in rules if r.path_rule and ("." + h).endswith("." + r.name.split("/")[0]) and p.startswith("/" + r.name.split("/", 1)[1])]
        best = min(own, key=lambda r: (-len(r.name), r.name), default=None)
        word = any(re.search(rf"(^|[.-]){w}([.-]|$)", h) for w in ("shop", "x1"))
        assert found[k] == (h, p, best.name if best else None, best.verdict if best else "block" if word else "allow"), url
    assert len(found) == len(urls)
