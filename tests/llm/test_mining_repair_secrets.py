from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import heapq
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import conversation_repair as cr
from terrapanel.llm import hard_negatives, secret_layers
from terrapanel.llm.queries import QUERIES

# ---- hard negatives -------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, score long, other long, rank int, asks string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, "x") for i, v, lab in rows], VECTORS)


def mined(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """Every score in plain integers."""
    own = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v):
            e = tuple(int(np.floor(scale * x)) for x in v)
            at = (lab, np.array(e, dtype=np.float64).tobytes())
            if i not in own or at < own[i][0]:
                own[i] = (at, lab, e)
    out = set()
    for a, (_, lab, e) in own.items():
        if not is_anchor(a):
            continue
        s = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), i, other == lab) for i, (_, other, f) in own.items() if i != a and len(f) == len(e))
        for p, i, _ in [x for x in s if x[2]][:positives]:
            found = [(n, j) for n, j, same in s if not same and low * -p <= 100 * -n <= high * -p][:negatives]
            out |= {(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(found)}
    return out


def rows_of(frame):
    return {tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def mixed_vectors(n=260, dim=24, seed=4):
    rng = np.random.default_rng(seed)
    hubs = rng.standard_normal((6, dim)) + 0.7
    rows = [(i, (hubs[i % 6 if i % 3 else 0] + 0.6 * rng.standard_normal(dim)).tolist(), 0 if i % 3 == 0 else int(rng.integers(0, 5))) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i + 1][2]) for i in range(8)]  # ties under another label
    rows += [rows[3], (5, rows[9][1], 4), (900, None, 1), (901, [], 1), (902, [float("nan")] * dim, 1), (903, [None] * dim, 1), (904, rows[0][1], None),
             (None, rows[0][1], 1), (905, [0.0] * dim, 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [1.0, 1.5], 2), (909, (-np.array(rows[0][1])).tolist(), 0)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives_match_all_scores(spark, monkeypatch, small):
    if small:  # many blocks and tiles, a third of the rows under one label
        for name, size in (("SIDE", 8), ("ROWS", 32), ("TILE_Q", 4), ("TILE_V", 16)):
            monkeypatch.setattr(hard_negatives, name, size)
    rows = mixed_vectors()
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 4 == 0)
    want = mined(rows, lambda i: i % 4 == 0)
    assert rows_of(got) == want and len(want) > 200


def test_negatives_of_empty_and_huge(spark):
    assert rows_of(hard_negatives.mine(vectors(spark, []), F.lit(True))) == set()
    assert rows_of(hard_negatives.mine(vectors(spark, [(1, [1.0], 1), (2, None, 2)]), F.col("vec_id") > 5)) == set()
    rows = [(i, [float(10 ** (3 * (i % 7))), 1.0 + i, 2.0, -1.0], i % 2) for i in range(24)]
    assert rows_of(hard_negatives.mine(vectors(spark, rows), F.lit(True), scale=1.0)) == {
        r for r in mined(rows, lambda i: True, scale=1) if abs(r[4]) < 2**62 and abs(r[5]) < 2**62}
    rows = [(0, [1e200, 1.0], 0), (1, [1e200, 2.0], 0), (2, [1e180, 2.0], 1)]  # beyond the long range: cut, not lost in NaN
    assert len(rows_of(hard_negatives.mine(vectors(spark, rows), F.lit(True), low=1, high=100))) == 2


def test_bounds_hold_and_skip_work():
    rng = np.random.default_rng(2)
    q, v = np.floor(256 * rng.standard_normal((20, 64))), np.floor(256 * (rng.standard_normal((300, 64)) + np.repeat([[1.0], [-1.0]], 150, axis=0)))
    exact = q @ v.T
    for level in range(len(hard_negatives.segments(64))):
        low, high = hard_negatives.bounds(hard_negatives.summarise(q), hard_negatives.summarise(v), 64, level)
        assert (low <= exact).all() and (exact <= high).all()
    # separated rows: coarse summaries alone rule most of them out
    base = np.repeat(np.repeat(rng.standard_normal((10, 4)) * 400, 16, axis=1), 30, axis=0)
    v = np.floor(base + rng.standard_normal(base.shape))
    search = hard_negatives.Searches(np.arange(10), np.full(10, -np.inf), np.full(10, np.inf), 5)
    side = lambda x, n: {"id": np.arange(len(x)) + n, "label": np.zeros(len(x)), "vec": x, "summary": hard_negatives.summarise(x)}
    which, ids, s = hard_negatives.run_block(search, side(v[::30], 1000), side(v, 0), True)
    assert search.scored < search.pairs / 5
    full = v[::30] @ v.T
    for i in range(10):
        assert ids[which == i].tolist() == np.lexsort((np.arange(len(v)), -full[i]))[:5].tolist()


# ---- conversation repair --------------------------------------------------

NAMES = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}


def best_repair(turns):
    """Uniform-cost search over (cost, audit): the first legal end is the best."""
    step = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    heap, seen = [(0, "", 0, "E", ())], set()
    while heap:
        cost, audit, i, state, roles = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(turns) and state in "EA":
            return cost, audit, list(roles)
        role, text, fault = turns[i] if i < len(turns) else (None, None, None)
        if i < len(turns):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, roles))
        for to in "su" + "a":
            nxt = step.get((state, to))
            if nxt and to in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", i, nxt, (*roles, (NAMES[to], ""))))
            if nxt and i < len(turns) and fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] == to:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, nxt, (*roles, (role, text))))
                if to in "ua":
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, nxt, (*roles, (NAMES[to], text))))


def repaired(rows):
    """[(conv, turn, role, text)] -> {conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}"""
    convs = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        convs.setdefault(c, []).append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), x, t))
    out = {}
    for c, own in convs.items():
        own.sort()
        seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, _, r, _, x, _ in own:
            body = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((r, x))
            count[fault] += 1
            turns.append((r, x, fault))
        numbers = [t for *_, t in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, roles = best_repair(turns)
        text = "\n".join(f"{r}:{x}" for r, x in roles)
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def check_repair(spark, rows, tables=None):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at int, c string, n int")
    done = cr.repair(df)
    report = {r.conv_id: tuple(r)[1:] for r in done.report.collect()}
    sha = {r.conv_id: r.repaired_sha256 for r in cr.digests(done).collect()}
    want = repaired(rows)
    assert {c: (*v, sha[c]) for c, v in report.items()} == want
    return done, want


def random_rows(seed, convs=40, longest=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "  ", "", None, "Why?\n", "tail! \t", " ", "end… ", "ünï.", "a" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "USER"]
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rng.randint(1, longest)):
            row = (c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"w{rng.random()}.")
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_match_uniform_cost_search(spark, seed):
    check_repair(spark, random_rows(seed))


def test_long_conversation_over_blocks_and_partitions(spark, monkeypatch):
    """One conversation holds a third of the rows: cut by partitions and blocks, equal to the search over the whole."""
    monkeypatch.setattr(cr, "ROWS", 25)
    monkeypatch.setattr(cr, "BLOCK", 7)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"t{t}.", f"t{t}", f"t{t}!", "again."])) for t in range(300)]
    rows += random_rows(9, convs=60)
    done, want = check_repair(spark, rows)
    turns = done.turns.filter("conv_id = 1").collect()
    kept = sorted((r.n, r.role, r.text) for r in turns if r.n is not None)
    assert [r[0] for r in kept] == list(range(1, len(kept) + 1))
    assert hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in kept).encode()).hexdigest() == want[1][-1]
    assert sorted(r.edit for r in turns) == sorted(want[1][-2])


def test_search_proves_the_optimum_in_any_state():
    rng = random.Random(11)
    for n in (0, 1, 5, 48):
        turns = [(rng.choice("suaat?"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        whole = {e: cr.search(turns, e, False) for e in range(4)}
        for cut in (0, n // 3, n):
            parts = cr.joined({e: cr.search(turns[:cut], e, False) for e in range(4)}, {e: cr.search(turns[cut:], e, False) for e in range(4)})
            assert parts == whole
        ends = cr.search(turns, cr.E, True)
        assert min(ends.values()) == min(whole[0][x] for x in (cr.E, cr.A) if x in whole[0])


def test_repair_of_empty_table_and_extremes(spark):
    assert check_repair(spark, [])[1] == {}
    check_repair(spark, [(1, None, None, None), (2, -2**63, "user", "Hi."), (2, -2**63 + 5, "assistant", "Yes."), (3, None, "user", "a."), (3, None, "user", "a.")])
    df = spark.createDataFrame([(1, -2**63, "user", "Hi."), (1, 2**63 - 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert cr.repair(df).report.first().gaps == 2**63 - 1


def test_damage_and_query(spark, tmp_dir):
    rows = [(c, t, ["user", "assistant"][t % 2], f"c{c} t{t}. ok?") for c in range(120) for t in range(6)] + [(None, 0, "user", "x."), (500, None, None, None)]
    cols = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_dir}/conversations.parquet")
    hurt = []
    for c, t, r, x in rows:
        c_, t_, r, x = " " if c is None else c, " " if t is None else t, r or " ", x or " "
        d = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
        hurt += [(c, t, "user" if d == 4 else r, x)] * (0 if d == 0 else 2 if d == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, tmp_dir).collect()}
    want = repaired(hurt)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}


# ---- secrets --------------------------------------------------------------

RULES = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
         ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)]


def base_spans(text):
    """[(start, kind number, end)] of the plain text, by the rules as they are stated."""
    return sorted((m.start(), k, m.end()) for k, (_, rule, least) in enumerate(RULES) for m in re.finditer(rule, text or "") if len(m[1]) >= least)


def listed(spans):
    return ",".join(f"{RULES[k][0]}:{a}:{e}" for a, k, e in spans)


SECRET = "password: hunter2000"


def b64(x, safe=False):
    return (base64.urlsafe_b64encode if safe else base64.b64encode)(x if isinstance(x, bytes) else x.encode()).decode()


def utf16(x):
    return "".join(f"\\u{int.from_bytes(c.encode('utf-16-be')[i:i + 2]):04x}" for c in x for i in range(0, len(c.encode("utf-16-be")), 2))


WRAPS = {
    "url": lambda x: "".join(f"%{b:02X}" for b in x.encode()),
    "url_some": lambda x: quote(x),
    "unicode": utf16,
    "braces": lambda x: "".join(f"\\u{{{ord(c):x}}}" for c in x),
    "wide": lambda x: "".join(f"\\U{ord(c):08x}" for c in x),
    "refs": lambda x: "".join(f"&#x{ord(c):x};" if i % 2 else f"&#{ord(c)};" for i, c in enumerate(x)),
    "base64": b64,
    "base64_safe": lambda x: b64(x, True),
    "base64_bare": lambda x: b64(x).rstrip("="),
    "gzip": lambda x: b64(gzip.compress(x.encode())),
    "zlib": lambda x: b64(zlib.compress(x.encode())),
    "bz2": lambda x: b64(bz2.compress(x.encode())),
    "twice": lambda x: b64(gzip.compress(zlib.compress(x.encode()))),
    "wrapped": lambda x: base64.encodebytes(("filler words here, " * 6 + x).encode()).decode().rstrip("\n"),
    "nested": lambda x: quote(b64(gzip.compress(utf16(b64(x)).encode()))),
}


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("lead", ["", "Some wörds 🙂 before "])
def test_encoded_secret_is_found_at_its_place(wrap, lead):
    inside = WRAPS[wrap](SECRET)
    base, found, unread = secret_layers.scan_text(f"{lead}{inside} and after")
    spans = {(a, e) for a, e, k in found if k == 0}
    assert any(len(lead) <= a and e <= len(lead) + len(inside) for a, e in spans) and unread == 0
    if wrap in ("url", "unicode", "braces", "wide", "refs"):  # one escape a character: the span is exact
        assert (len(lead), len(lead) + len(inside)) in spans
    if wrap == "base64":
        assert min(a for a, _ in spans) == len(lead)


def test_secret_across_the_edge_of_an_escape():
    text = "x token%3Dabc%64ef, y api\\u005fkey = 'zzzzzz'"
    _, found, _ = secret_layers.scan_text(text)
    assert {text[a:e] for a, e, k in found if k == 0} == {"token%3Dabc%64ef", "api\\u005fkey = 'zzzzzz"}


def test_cycles_and_bombs_end(monkeypatch):
    text = "%2525252541 \\\\u005cu0041 " + "%25" * 50 + "41"
    assert secret_layers.scan_text(text)[2] == 0
    monkeypatch.setattr(secret_layers, "LAYER_BYTES", 10_000)
    base, found, unread = secret_layers.scan_text(f"{b64(gzip.compress(b'a' * 100_000))} {SECRET}")
    assert unread == 1 and len(found) == 1
    deep = SECRET
    for _ in range(30):
        deep = b64(deep)
        if len(deep) > 9000:
            break
    assert any(k == 0 for _, _, k in secret_layers.scan_text(deep)[1])


def test_random_texts_keep_their_base_spans(spark, tmp_dir):
    rng = random.Random(3)
    alphabet = ["token", "SECRET", "api_key", "ApiKey", "=", ":", " ", "  ", "\"", "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f" * 24, "\n", "ſecret",
                "toKen", "é", "🙂", "-", "/", "%20", "\\u0041", "x" * 6, SECRET, b64(SECRET)]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(400, None), (401, ""), (None, SECRET), (402, SECRET), (402, SECRET), (403, "lorem ipsum " * 60_000 + SECRET)]
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, start int, spans string, kind int")
    df.write.parquet(f"{tmp_dir}/documents.parquet")
    got = QUERIES["op13_secret_layers"](spark, tmp_dir).collect()
    assert len(got) == len(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    by_id = {i: base_spans(t) for i, t in rows}
    for r in got:
        base = by_id[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert {x for x in listed(base).split(",") if x} <= set(r.spans.split(","))
    assert secret_layers.scan(df.limit(0)).collect() == []


def test_plain_prose_gains_no_spans():
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 24))) for _ in range(3000)]
    assert secret_layers.scan_text(" ".join(words))[1] == {}
