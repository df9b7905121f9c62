"""Archives, whitening and importance resampling against brute force, with awkward rows."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldnote.llm import ann, lm, near, packing, phrases, queries, ranges, resampling, warc, whitening
from fieldnote.session import scratch_path

# ---- archives

PAGES = "page_id long, url string, html string, digest string, at int, size int, key string, type string, payload string, volume int"
BIG = "é" * 800 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 50
PAGE_ROWS = [
    (5, "http://a.b/c d\r\nX: y", BIG), (7, None, BIG), (7, "u", BIG), (None, "u", BIG), (None, None, None), (8, "https://q", "short"),
    (9, "https://q?z", "short"), (10, "", ""), (11, "http://h/" + "p" * 5000, "y" * 3_000_000), (12, "u", "z" * 999), (13, "u", "z" * 999),
    (14, "u", "z" * 1000), (15, "u", "z" * 1000), (15, "u", "z" * 1000), *[(100 + i, f"http://h/{i}", "copy " * 300) for i in range(40)],
]


def _pages(spark, rows):
    return spark.createDataFrame([r + ("d", 1, 2, "k", "t", "p", 3) for r in rows], PAGES).repartition(3)


def _captures(spark, pages, **more):
    path = scratch_path(spark, "archives")
    warc.write(pages, path, **more)
    return warc.read(spark, path, payloads=True)


def _expected(rows):
    out, groups = [], {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((-1 if page is None else page, i))
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        top = max(groups[html or ""], key=lambda x: (x[0], -x[1]))
        again = len(data) >= 1000 and top[1] != i
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", (None if top[0] < 0 else top[0]) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_archives_come_back(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(warc, "small", lambda df: df)
    records = _captures(spark, _pages(spark, PAGE_ROWS), volume_bytes=20_000)
    found = warc.resolved(warc.captures(records))
    got = found.select(F.col("page").cast("long"), "payload_bytes", "payload_digest", "type", F.col("referred").cast("long"))
    assert sorted(map(tuple, got.collect()), key=repr) == _expected(PAGE_ROWS)
    rows = found.filter("type = 'response'").collect()
    assert Counter(bytes(r["payload"]) for r in rows) == Counter((h or "").encode() for (_, _, h), e in zip(*_paired()) if e == "response")
    assert all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 and r["status"] == 200 and r["part"] == 0 for r in rows)
    assert {r["target_uri"] for r in found.collect()} >= {"http://a.b/c%20d%0D%0AX:%20y", None}
    assert records.filter("payload_digest != claimed_digest").count() == 0 and warc.unplaced(records).count() == 0
    assert records.select("path").distinct().count() > 3


def _paired():
    """Rows with what becomes of them: of equal texts one is the response."""
    kinds, seen = [], Counter()
    for _, _, html in PAGE_ROWS:
        big = len((html or "").encode()) >= 1000
        kinds.append("revisit" if big and seen[html] else "response")
        seen[html] += 1
    return PAGE_ROWS, kinds


def test_no_pages(spark):
    records = _captures(spark, _pages(spark, []))
    assert warc.resolved(warc.captures(records)).count() == 0 and records.count() == 0


def _raw(kind, own, *links, block=b"", content="application/warc-fields"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", *[f"WARC-Concurrent-To: {x}" for x in links], f"Content-Type: {content}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """A member for every record, plain files, links from either side, records over several files, broken files."""
    http = b"HTTP/1.1 404 Not Found\r\n\r\nbody"
    one = [_raw("response", "<r1>", "<q1>", block=http, content="application/http"), _raw("metadata", "<m1>", "<r1>", block=b"via: x\r\nvia: y\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in one))
    (tmp_path / "b.warc").write_bytes(_raw("request", "<q1>", block=b"GET / HTTP/1.1\r\n\r\n", content="application/http") + _raw("metadata", "<m2>", "<none>"))
    (tmp_path / "c.warc").write_bytes(_raw("resource", "<s1>", block=b"123", content="text/plain") + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(_raw("resource", "<s2>", block=b"1"))[:-12])
    records = warc.read(spark, str(tmp_path), payloads=True)
    assert sorted(r["path"][-6:] for r in records.filter("error is not null").collect()) == ["arc.gz", "c.warc"]
    rows = {r["record_id"]: r for r in warc.captures(records).collect()}
    assert {r["record_id"] for r in rows["<r1>"]["requests"]} == {"<q1>"} and {r["record_id"] for r in rows["<r1>"]["metadata"]} == {"<m1>"}
    assert rows["<r1>"]["status"] == 404 and bytes(rows["<r1>"]["payload"]) == b"body" and bytes(rows["<s1>"]["payload"]) == b"123"
    assert [(f["name"], f["value"]) for f in rows["<r1>"]["metadata"][0]["fields"]] == [("via", "x"), ("via", "y")]
    assert [r["record_id"] for r in warc.unplaced(records).collect()] == ["<m2>"]


def test_a_capture_with_very_many_records_gets_further_rows(spark, tmp_path):
    many = [_raw("response", "<r>", block=b"HTTP/1.1 200 OK\r\n\r\n", content="application/http"), *[_raw("metadata", f"<m{i}>", "<r>") for i in range(3500)]]
    (tmp_path / "a.warc").write_bytes(b"".join(many))
    rows = warc.captures(warc.read(spark, str(tmp_path))).collect()
    assert len(rows) == 4 and max(len(r["metadata"]) for r in rows) < 1200
    assert {m["record_id"] for r in rows for m in r["metadata"]} == {f"<m{i}>" for i in range(3500)}


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, label int, id int, v string, w int, component int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "v", 3, 4) for i, v in rows], VECTORS).repartition(4)


def _white(rows):
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (x - s / n).astype(np.longdouble)
    values, vectors = np.linalg.eigh((c.T @ c / n).astype(np.float64))
    dev = [sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return kept, n, values[::-1], vectors[:, ::-1], c.astype(np.float64), dev


def test_whitening(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 12)) * np.r_[3, 2.9999, 2, np.ones(9) / 3] @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i % 390, list(v)) for i, v in enumerate(data)]
    rows += [(None, list(data[5])), (900, [0.0] * 12), (901, None), (902, [math.nan] * 12), (903, [1.0] * 11 + [None]), (904, [math.inf] + [0.0] * 11), (905, []), (905, list(data[5]))]
    kept, n, values, vectors, c, dev = _white(rows)
    got = whitening.whiten(_vectors(spark, rows)).collect()
    assert {r["n"] for r in got} == {n} and len(got) == 8 * n
    w = {k: {} for k in range(1, 9)}
    for (i, _), row, d in zip(kept, c, dev):
        for k in range(8):
            w[k + 1].setdefault((i, d), []).append(float(row @ vectors[:, k] / np.sqrt(values[k])))
    for k in range(1, 9):
        mine = [r for r in got if r["component"] == k]
        assert len(mine) == n
        flip = next(np.sign(r["whitened"] * w[k][(r["vec_id"], int(r["deviation"]))][0]) for r in mine if abs(r["whitened"]) > 0.5)
        for r in mine:
            assert min(abs(r["whitened"] - flip * x) for x in w[k][(r["vec_id"], int(r["deviation"]))]) < 1e-8
        assert all(abs(r["explained"] - values[k - 1] / values.sum()) < 1e-10 for r in mine)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(_vectors(spark, [])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(_vectors(spark, [(1, [1, 2, 3])])).collect()
    assert [(r["component"], r["whitened"], r["explained"], int(r["deviation"])) for r in sorted(one, key=lambda r: r["component"])] == [(k, None, 0.0, 0) for k in (1, 2, 3)]
    flat = whitening.whiten(_vectors(spark, [(i, [i, 2 * i, 5, 1e9]) for i in range(50)] + [(99, [1.0])])).collect()
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1} and len(flat) == 200
    assert max(r["identity_error"] for r in flat) < 1e-9


@pytest.mark.parametrize("kind", ["random", "clusters", "blocks", "diagonal", "rank"])
def test_eigen(kind):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    spread = {"random": rng.random(40), "clusters": np.r_[5, 5, 5 - 1e-9, 4, 4, np.ones(35)], "rank": np.r_[3, 2, np.zeros(38)]}.get(kind)
    a = (q * spread) @ q.T if spread is not None else np.diag(np.r_[np.ones(20), np.arange(20)])
    if kind == "blocks":
        a[:2, :2] = a[2:4, 2:4] = [[2, 1], [1, 2]]
    a = (a + a.T) / 2
    values, z = whitening.eigen(a, 8)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:8], atol=1e-12 * 20)
    assert np.abs(z.T @ z - np.eye(8)).max() < 1e-12 and np.abs(a @ z - z * values).max() < 1e-11


def test_large_entries_stay_exact():
    x = np.array([[1 << 50, 3], [5, -(1 << 51)]])
    sums = [int(v) for v in x.sum(0)]
    want = [[100_000 * int(a) - b for a, b in zip(r, sums)] for r in x]
    assert whitening._centred(x, 100_000, sums).tolist() == want


# ---- importance resampling

DOCS = "doc_id long, text string, n_words int, weight string, rank long, key int, at int, score int, part int, made int, made_ int"


def _features(text):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
    return len(words), [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _texts():
    rng = random.Random(8)
    words = "The of é naïve x1 Über 42 rain-coat river a_b stone's".split() + ["w" * 300, "ß" * 20, "q" * 33, "v" * 64]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "@", "[", "\x7f", ", "]) for _ in range(n))
    rows = [(i * 7 % 101, text(rng.randrange(1, 120))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, " \t@@ "), (None, text(50)), (203, "one"), (204, text(9000)), (205, "L" * 70_000 + " end"), rows[3], rows[3], (206, "a b " * 50)]
    return rows, [(i, text(40)) for i in range(5)] + [(9, None), (10, "")]


def _scores(rows, target):
    s, t = Counter(), Counter()
    for c, docs in ((s, rows), (t, target)):
        for _, text in docs:
            c.update(zlib.crc32(f) % 10_000 for f in _features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, fs = _features(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in (zlib.crc32(f) % 10_000 for f in fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, 4, 5, 6, 7, 8) for i, t in rows], DOCS).repartition(3)


def test_resampling(spark):
    rows, target = _texts()
    got = resampling.scored(_documents(spark, rows), _documents(spark, target))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = _scores(rows, target)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[5] is not None for r in want) >= 3
    unique = [r for r in rows if r[0] is None or r[0] >= 200 or r != rows[3]]
    drawn = resampling.draw(_documents(spark, unique), _documents(spark, target))
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r[0] for r in _scores(unique, target) if r[5])
    assert drawn.columns == _documents(spark, []).columns


def test_resampling_of_nothing(spark):
    none, some = _documents(spark, []), _documents(spark, [(1, "a b c")])
    assert resampling.scored(none, some).count() == 0 and resampling.draw(none, none).count() == 0
    assert resampling.scored(some, none).select("n_features", "rank").collect() == [(6, None)]


def test_ranks_over_many_ranges(spark):
    """A third of the rows are alike in score and key and still lie in several ranges."""
    rows = [(i, i % 50, i) for i in range(4000)] + [(7, 60, 5000 + i) for i in range(2000)]
    path = scratch_path(spark, "r")
    spark.createDataFrame(rows, "key long, score long, at long").write.parquet(path)
    got = resampling.ranked(spark.read.parquet(path), 2500).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0], r[2]))[:2500]
    assert sorted((r["rank"], r["at"]) for r in got) == [(k + 1, r[2]) for k, r in enumerate(want)]


def test_interned_ranges(monkeypatch):
    """Keys are XXH64; ranges whose keys collide stay apart by their bytes."""
    rng = random.Random(2)
    flat = np.frombuffer(bytes(rng.choice(b"ab ") for _ in range(5000)), np.uint8)
    start = np.array([rng.randrange(4000) for _ in range(3000)])
    size = np.array([rng.choice([1, 2, 3, 7, 8, 9, 31, 32, 33, 63, 64, 100, 300]) for _ in range(3000)])
    text, want = ranges.Bytes(flat), [flat.tobytes()[a : a + n] for a, n in zip(start, size)]
    assert text.hashes(start, size, 42).tolist() == [xxhash.xxh64_intdigest(w, 42) for w in want]
    for hashes in (text.hashes, lambda s, n, seed=0: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(text, "hashes", hashes)
        found = resampling.Interned(text, start, size)
        assert [want[i] for i in found.first[found.slot_of]] == want
        assert Counter(want) == dict(zip([want[i] for i in found.first], found.counts.tolist()))
        assert found.buckets.tolist() == [zlib.crc32(want[i]) % 10_000 for i in found.first]


@pytest.mark.parametrize("chunk,most", [(100, 7), (1 << 20, 50), (5000, 1 << 17)])
def test_long_texts_in_pieces(chunk, most):
    rows, _ = _texts()
    texts = [t for _, t in rows]
    words, features = Counter(), Counter()
    for kind, at, found in resampling.pieces(pa.array(texts), most=most, chunk=chunk):
        if kind == "words":
            for k, n in enumerate(found):
                words[at + k] += int(n)
        else:
            for r, b in zip(at.tolist(), found.buckets[found.slot_of].tolist()):
                features[r, b] += 1
    want = Counter((i, zlib.crc32(f) % 10_000) for i, t in enumerate(texts) for f in _features(t)[1])
    assert features == want and [words[i] for i in range(len(texts))] == [_features(t)[0] for t in texts]


def test_registered():
    assert {"op11_warc", "op12_embedding_whitening", "op13_importance_resampling"} <= set(queries.QUERIES) and "op11_warc" in queries.ORACLES
    assert list(warc.parse(io.BytesIO(b""))) == []


# ---- earlier operators: cases of the review


def _alike(n=10):
    """Two words of 2^n letters for which sums of powers of any odd number agree modulo 2^64."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_only_a_weak_hash_takes_for_one(spark):
    one, other = _alike()
    same = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(0, f"{same} {one}"), (1, f"{same} {other}"), (2, f"{same} {one}")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in phrases.dedup(docs).collect()) == [(0, 0), (1, 0), (2, 20)]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 and i != held)
    docs = spark.createDataFrame([(learned, one), (held, other)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_known"] for r in lm.score(docs).collect()} == {learned: 2, held: 1}


def test_neighbours_from_the_tree_alone(spark):
    """The sample is a twentieth of the table; ids are beyond what a double holds; rows without id take no part."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(5000, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 5000)]
    base = (1 << 60) + 1
    rows = [(base + i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist())] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.withColumns({"id": F.lit("x"), "v": F.lit(1), "leaf": F.lit(2)}).repartition(4)
    got = ann.search(table, k=20, sample=250).collect()
    near, hit, total = {}, 0, 0
    for r in got:
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [base + i for i in range(5000) if (base + i) % 20 == 0]
    assert set(near) == set(asked) and None not in set().union(*near.values())
    for q in asked:
        s = v @ v[q - base]
        s[q - base] = -np.inf
        best = {base + int(i) for i in np.argsort(-s)[:20]}
        assert len(near[q]) == 20
        hit, total = hit + len(best & near[q]), total + 20
    assert hit >= 0.9 * total


def test_cells_join_what_hubs_leave_apart(spark, monkeypatch):
    """Copies that resemble each other below and above 0.8, in cells of a few texts, against brute force; the rows of cells stay few."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 4, 5))):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cells, made = near._cells, []
    monkeypatch.setattr(near, "CELL_HASHES", 2_000)
    monkeypatch.setattr(near, "_cells", lambda labelled: made.append(cells(labelled)) or made[-1])
    got = {r.doc_id: r.component for r in near.similar_groups(docs, sketch_bits=near.MINIMA).collect()}
    assert 1 < len(set(group)) == len(set(got.values()))
    assert len({(group[i], got[i]) for i in got}) == len(set(group))
    assert made[0].groupBy("band", "main", "i", "j").count().count() > near.BANDS
    # Both sides of a cell are bounded, whatever the size of the band.
    assert made[0].groupBy("band", "main", "i", "j", "side").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0] < 3 * 2_000


def test_unlike_texts_move_little(spark):
    """Bands that one text alone holds cost their number and no sketch or list of bands: bytes shuffled for each text."""
    rng = random.Random(37)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(2000)], "doc_id long, text string").cache()
    docs.count()
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    assert near.similar_groups(docs).select("component").distinct().count() == 2000
    assert (moved() - before) / 2000 < 2000


def test_cell_links_leave_earlier_bands_alone(spark):
    """A pair is compared in the first of its bands only; equal components give no link."""
    bands = [[7, 8] + [i * 100 + j for j in range(near.BANDS - 2)] for i in range(3)]
    cell = lambda place, component: pa.table({
        "side": pa.array([0, 0, 0], pa.int8()), "node": [1, 2, 3], "n": [2, 2, 2], "component": component, "s0": [0, 0, 0], "s1": [0, 0, 0],
        "bands": bands, "place": [place] * 3, "shingles": [[5, 6], [5, 6], [5, 9]],
    })
    assert near._cell_links(cell(0, [1, 2, 3]), 0.8, 30) == [(1, 2)]
    assert near._cell_links(cell(0, [1, 1, 3]), 0.8, 30) == []
    assert near._cell_links(cell(1, [1, 2, 3]), 0.8, 30) == []


def test_packed_words_of_every_kind(spark):
    """Ids put together from parts equal the tokenizer's, whatever stands in a word; one text is of several MB."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    bits = ["Don't", "ABC", "été!", "ÀÖ÷", "a\n\nb", "x.\nY", "\n", "\t", "<|endoftext|>", "<b>", "...", "1234", "ß?", "it's\nIt'S", "日本", "é", "", "_", "a_b", "'", "\r\n", " "]
    texts = [None, "", " ", "\n"] + [" ".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(300)]
    texts.append(" ".join(f"Word{rng.randrange(50)}. plain{'abc'[i % 3]}, 'tis" for i in range(150_000)))
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    tokenizer, got = Tokenizer.from_file(path), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert got[i] == [(k * 2048, len(c), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))) for k, c in enumerate(cut)], i


def test_a_worker_keeps_no_words_after_packing(spark):
    """Workers wait for tasks of other steps, beside which kept words would take memory."""
    import public_tokenizers

    texts = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 20), x -> concat('w', char(97 + id % 26), char(97 + x)))) as text")
    packing.pieces(texts, public_tokenizers.path("word_bpe_49k.json")).count()

    def kept(batches):
        from fieldnote.llm import packing

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [max((len(x.parts) for x in packing._held.values()), default=0)]})

    assert max(r["n"] for r in spark.range(0, 16, 1, 4).mapInArrow(kept, "n long").collect()) <= 1
