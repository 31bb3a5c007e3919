from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from terrapanel.llm import preference_chat, warc

PAGES = "page_id long, url string, html string, path string, bytes long, sha string, first string, n string, id string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, "s", "f", "n", "i") for i, u, h in rows], PAGES)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [(5, "http://a/5", "<p>same</p>"), (3, "http://a/3 x%20\r\ny", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a/1", None), (2, "u", ""),
        (None, "n", "<p>same</p>"), (None, "m", "only null ids"), (7, "ü", "é\r\n\r\nWARC/1.1\r\n\r\n" * 5), (3, "again", "<p>same</p>"),
        (11, "long", "".join(random.Random(1).choices("abcdef<>é \n", k=400_000))), (12, "long", "x" * 3_000_000)]


@pytest.mark.parametrize("range_bytes", [97, 5000, 1 << 22])
def test_round_trip_by_ranges(spark, range_bytes):
    manifest = warc.write_archives(pages(spark, ROWS))
    got = warc.read_archives(spark, manifest, range_bytes=range_bytes).collect()
    assert sum(r.records for r in manifest.collect()) == len(ROWS) == len(got)
    assert len({(r.path, r.offset) for r in got}) == len(got)
    want = sorted(map(str, [
        (5, "http://a/5", "revisit", 3, 11, digest("<p>same</p>"), None), (3, "http://a/3 x%20\r\ny", "response", None, 11, digest("<p>same</p>"), "<p>same</p>"),
        (9, None, "revisit", 3, 11, digest("<p>same</p>"), None), (1, "http://a/1", "response", None, 0, digest(""), ""), (2, "u", "revisit", 1, 0, digest(""), None),
        (None, "n", "revisit", 3, 11, digest("<p>same</p>"), None), (None, "m", "response", None, 13, digest("only null ids"), "only null ids"),
        (3, "again", "response", None, 11, digest("<p>same</p>"), "<p>same</p>"),
        *[(i, u, "response", None, len(h.encode()), digest(h), h) for i, u, h in ROWS if i in (7, 11, 12)]]))
    assert sorted(str((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload).decode())) for r in got) == want


def test_small_payloads_are_all_responses(spark):
    manifest = warc.write_archives(pages(spark, ROWS), revisit_min_bytes=11)
    types = {(r.page_id, r.record_type) for r in warc.read_archives(spark, manifest, with_payload=False).collect()}
    assert (2, "response") in types and (5, "revisit") in types


def test_archives_are_ordinary_gzip(spark):
    for row in warc.write_archives(pages(spark, ROWS[:3])).collect():
        fs, name = warc.open_fs(row.path)
        data = gzip.decompress(fs.open_input_file(name).read())
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID") == row.records


def test_scan_skips_what_is_no_record():
    one = lambda b: gzip.compress(b)
    good = [one(warc.record(i, "u", b"x" * i, "D", None, False, warc.DATE)) for i in range(4)]
    junk = b"\x1f\x8b\x08 not gzip" + one(b"no record") + b"\x1f\x8b"
    data = good[0] + junk + good[1] + good[2] + junk + good[3] + good[1][:-9]

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    for step in (1, 7, 50, len(data)):
        got = [at for s in range(0, len(data), step) for at, _ in warc.records_in_range(File(data), s, min(len(data), s + step))]
        assert got == [data.index(g) for g in good]
    assert zlib.decompressobj(31).decompress(good[0]).startswith(b"WARC/1.1")


def test_no_pages(spark):
    manifest = warc.write_archives(pages(spark, []))
    assert manifest.collect() == [] and warc.read_archives(spark, manifest).collect() == []


TURNS = "conv_id long, turn long, role string, text string, row string, chosen string, opening string, n_prompt_turns int, t string"


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "a", "b", "c", 1, "d") for c, t, r, x in rows], TURNS)


def brute_render(ts):
    return "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in ts)


def test_prefix_and_masks(spark):
    a = [("user", "q"), ("assistant", "one"), ("user", None), (None, "x"), ("assistant", "two")]
    b = [("user", "q"), ("assistant", "one"), ("user", None), (None, "x"), ("assistant", "three"), ("user", "bye")]
    pairs = [(1, a, b, "r"), (2, a, a, "r"), (3, a, a[:2], "r"), (4, None, b, "r"), (5, [], [], "r"), (6, a, [("user", "Q")], "r"), (7, a + b * 200, b, "r")]
    df = spark.createDataFrame(pairs, f"pair_id long, chosen {preference_chat.TURNS}, rejected {preference_chat.TURNS}, row string")
    for r in preference_chat.format_preferences(df).collect():
        _, c, j, _ = pairs[r.row.pair_id - 1]
        c, j = c or [], j or []
        n = next((i for i, (x, y) in enumerate(zip(c, j, strict=False)) if x != y), min(len(c), len(j)))
        assert (r.n_prompt_turns, r.prompt) == (n, brute_render(c[:n]))
        for ts, done in ((c[n:], r.chosen_completion), (j[n:], r.rejected_completion)):
            assert "".join(s.text for s in done) == brute_render(ts)
            assert [s.text for s in done if s.loss] == [(x or "") + "<|end|>\n" for role, x in ts if role == "assistant"]


def test_pairs_cover_every_conversation_once(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (2, 0, "user", "hi"), (2, 1, "assistant", "B"), (2, 1, "assistant", "B"), (3, 0, "user", "hi"),
            (4, 0, "user", "other"), (4, 1, "assistant", "C"), (4, 2, "user", "more"), (4, 3, "assistant", "D"), (5, 0, None, None), (None, 0, "user", "hi"), (6, None, "user", "only")]
    got = {r.conv_id: r for r in preference_chat.preference_pairs(turns(spark, rows)).collect()}
    assert {c: (r.chosen_id, r.rejected_id) for c, r in got.items()} == {1: (1, None), 2: (1, 2), 3: (1, 3), 4: (4, None), 5: (5, None), 6: (6, None)}
    assert [tuple(t) for t in got[4].rejected] == [("user", "other"), ("assistant", "C"), ("user", "more"), ("assistant", "C")]
    assert [tuple(t) for t in got[1].rejected] == [("user", "hi"), ("assistant", "")] and got[5].rejected == [] and got[6].rejected == []
    assert preference_chat.format_preferences(preference_chat.preference_pairs(turns(spark, []))).collect() == []


