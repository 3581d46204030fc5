"""The ten operators on small fixtures: brute force, and nulls, empties, repeats, ties and clashing columns."""

import collections
import hashlib
import io
import random
import re
import wave
import zlib

import numpy as np
import pytest

from kinfabric.llm import exact_dedup, media, minhash_dedup, mixing, packing, quality, secrets, substring_dedup, suffix_dedup, tokens
from kinfabric.llm.components import connected_components
from kinfabric.llm.suffix_array import common_prefixes, repeated_starts, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, rk string, component_id long"


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(160)]
    shared = [word() for _ in range(70)]
    texts = [None, "", "  \n\t ", "one", "two words", "One", " ".join(base), " ".join(base).upper(), " ".join(base)]
    for i in range(12):
        near = list(base)
        for _ in range(i):
            near[rng.randrange(160)] = word()
        texts.append(" ".join(near))
    texts += [" ".join([*(word() for _ in range(20)), *shared, *(word() for _ in range(20))]) for _ in range(4)]
    texts += ["ab " * 400, "a" * 900, "x\ny " * 60, "password = 'abcdefghijkl1' and https://h.example/x token: abcd1234", "AKIA" + "Z9" * 12 + " é deadbeefdeadbeef00"]
    texts.append(" ".join(word() for _ in range(4000)))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return fixture()


def frame(spark, rows):
    full = [(i, t, None if (i or 1) % 5 == 0 else "en", None if (i or 1) % 4 == 0 else f"s{(i or 0) % 3}", 1, 2, "x", 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


ODD = [(None, "same text here"), (None, None), (7, "same text here"), (7, "other words are here"), (7, "same text here")]


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_suffix_array_random():
    rng = random.Random(1)
    for trial in range(150):
        segs = [bytes(rng.choice(b"ab\x00\xff" if trial % 2 else b"a") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        order, text, stop = suffix_array(segs)
        sep = {e: k for k, e in enumerate(sorted(set(stop.tolist())))}
        key = lambda i: [(-1000 + sep[j] if text[j] == 0 else text[j]) for j in range(i, stop[i] + 1)]
        assert sorted(range(len(text)), key=key) == order.tolist()
        assert len(common_prefixes(order, text, stop, 16)) == len(order)
        n = rng.choice([1, 3, 7])
        counts, want, at = collections.Counter(s[i : i + n] for s in segs for i in range(len(s) - n + 1)), [False] * len(text), 0
        for s in segs:
            for i in range(len(s) - n + 1):
                want[at + i] = counts[s[i : i + n]] > 1
            at += len(s) + 1
        assert repeated_starts(segs, n).tolist() == want


@pytest.mark.parametrize("most", [1000, 1])
def test_op1(spark, rows, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "ARRAY_ROWS", most)
    data = [(i, (t or "").encode()) for i, t in [*rows, *ODD, (3, "a" * 900)]]
    counts = collections.Counter(b[s : s + 200] for _, b in data for s in range(len(b) - 199))
    want = []
    for i, b in data:
        hit = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if counts[b[s : s + 200]] > 1:
                hit[s : s + 200] = True
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = int((hit[1:] < hit[:-1]).sum())
        want.append((i, len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(frame(spark, [(i, b.decode()) for i, b in data])).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("keep,weak", [("min", False), ("max", True)])
def test_op2(spark, rows, keep, weak):
    data = [*rows, (99, "ONE"), (98, None)]
    hash_of = (lambda c: exact_dedup.F.substring(exact_dedup.F.md5(c.cast("binary")), 1, 1)) if weak else exact_dedup.content_hash
    groups = collections.defaultdict(list)
    for i, t in data:
        groups[lower(t)].append(i)
    best = {"min": min, "max": max}[keep]
    want = sorted((i, best(groups[lower(t)]), len(groups[lower(t)]), best(groups[lower(t)]) == i, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in data)
    assert sorted(map(tuple, exact_dedup.exact_classes(frame(spark, data), keep=keep, hash_of=hash_of).collect())) == want
    assert exact_dedup.drop_exact_copies(frame(spark, data)).count() == len(groups)
    assert exact_dedup.exact_classes(frame(spark, ODD)).count() == len(ODD)
    odd = frame(spark, [*ODD, (3, "other words are here")]).withColumn("_row", exact_dedup.F.lit(1))
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None, None), (7, "same text here"), (3, "other words are here")} and left.count() == 3


def test_op3(spark, rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r.doc_id: [(x["start"], x["kind"], x["end"]) for x in r.found if x["strong"]] for r in secrets.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got[i] == sorted(want, key=lambda x: (x[0], secrets.KINDS.index(x[1])))
    linked = [(1, "token: abcd1234 " + "x" * gap + " https://a.example/y") for gap in (3, 600)]
    found = [[x["kind"] for x in r.found] for r in secrets.scan(frame(spark, [(0, linked[0][1]), (1, linked[1][1])])).orderBy("doc_id").collect()]
    assert found == [["weak_assign", "endpoint"], []]
    assert secrets.scan(frame(spark, ODD)).count() == len(ODD)


def test_op4(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.score(docs, train).join(rest, "doc_id").selectExpr("avg(int(keep = (quality = 1))) a", "avg(if(quality = 1, int(keep), null)) k").first()
    assert got.a > 0.95 and got.k > 0.98
    few = quality.score(frame(spark, ODD), labels.limit(0)).collect()
    assert len(few) == len(ODD) and all(r.keep for r in few)
    none = quality.score(docs.limit(0), train)
    assert none.count() == 0


def test_op4_judges_rows(spark):
    """Rows that share a doc_id, or have none, go and stay by their own text; contradicting labels and clashing columns do no harm."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    verdicts = quality.score(docs, labels, rounds=1).join(docs, "doc_id").select("keep", "text", "lang", "source").collect()
    good, bad = next(r for r in verdicts if r.keep), next(r for r in verdicts if not r.keep)
    long = "plain words of a long text " * 60_000
    more = [(None, good.text, good.lang, good.source), (None, bad.text, bad.lang, bad.source), (-7, good.text, good.lang, good.source), (-7, bad.text, bad.lang, bad.source), (-8, None, None, None), (-9, long, "en", "s")]
    rows = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string")).withColumn("rk", quality.F.lit(1)).withColumn("y", quality.F.lit("x"))
    twice = labels.union(labels.where("doc_id % 50 = 0").selectExpr("doc_id", "1 - quality", "toxic"))
    left = quality.drop_rejected(rows, twice, rounds=1)
    assert left.columns == rows.columns
    kept = {(r.doc_id, r.text) for r in left.collect()}
    assert {(None, good.text), (-7, good.text)} <= kept and not {(None, bad.text), (-7, bad.text)} & kept


def test_op5(spark, rows):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(x).to_bytes(4) + n + x + zlib.crc32(n + x).to_bytes(4) for n, x in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    gz = zlib.compress(b"hello" * 50, wbits=31)
    assert media.find_media(b"BMzz" + png + b"GIF89a" + gz + b"\xff\xd8\xff") == [(4, len(png), "image/png"), (10 + len(png), len(gz), "application/gzip")]
    assert media.sniff(png, "image/jpeg")["type"] == "image/png" and media.sniff(None, None)["type"] == media.UNKNOWN
    got = {r.doc_id: r for r in media.stored_features(frame(spark, rows)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        pad = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        wav = io.BytesIO()
        with wave.open(wav, "wb") as f:
            f.setnchannels(1), f.setsampwidth(1), f.setframerate(media.RATE), f.writeframes(pad)
        assert (r.media_bytes, r.media_sha256) == (len(wav.getvalue()), hashlib.sha256(wav.getvalue()).hexdigest())
        assert r.feature.startswith(f"text/plain>audio/wav;n={len(pad)};sum={sum(pad)};min={min(pad)};max={max(pad)};")
    carved = media.sniff_media(spark.createDataFrame([(media.encode_wav(png + b"\xff" * 3), "x", "clash")], "media binary, declared string, type string")).first()
    assert carved.type == "clash" and carved.type_ == "audio/wav" and bytes(carved.carved[0]["bytes"]) == png


@pytest.mark.parametrize("block", [5, 7, 1 << 16])
def test_op6(spark, rows, block):
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    data = [*rows, *ODD, (-5, "a negative id"), ((1 << 63) - 1, "the largest id"), (-(1 << 63), "")]
    want = sorted(((i, len(encode(t or ""))) for i, t in data), key=str)
    assert sorted(map(tuple, tokens.count_tokens(frame(spark, data), block=block).collect()), key=str) == want


def test_op6_files_are_flat(spark, rows, tmp_path):
    tokens.write_flat_files(tokens.token_lists(frame(spark, rows)), str(tmp_path / "flat"))
    ids = np.concatenate([np.fromfile(f, "<u2") for f in sorted((tmp_path / "flat").glob("part-*"))])
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    assert len(ids) == sum(len(encode(t or "")) + tokens.LEAD + 1 for _, t in rows) and (ids == tokens.EOD).sum() == len(rows)


def test_op6_files(spark, tmp_path):
    flat = np.array([1, 2, tokens.EOD, tokens.EOD, 5, 6, 7, tokens.EOD, 9], np.uint16)
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    found = tokens.document_lengths(tokens.separators(tokens.read_flat_files(spark, str(tmp_path), block=2)))
    assert [r.n_tokens for r in found.orderBy("k").collect()] == [2, 0, 3]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_op7(spark, rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    want = sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())
    assert sorted(map(tuple, minhash_dedup.near_components(frame(spark, rows), n, percent).collect())) == want


def test_op7_odd_rows(spark):
    got = minhash_dedup.near_components(frame(spark, [*ODD, (3, "other words are here")]), 3, 85).collect()
    assert len(got) == len(ODD) + 1 and {r.component_id for r in got if r.doc_id == 7} == {3}
    assert all(r.kept for r in got if r.doc_id is None)


def test_op8(spark, rows):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = []
    for i, w in words:
        hit = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                hit[s : s + 50] = [True] * 50
        kept = " ".join(x for x, h in zip(w, hit) if not h)
        want.append((i, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.remove_repeats(frame(spark, rows)).drop("kept_text")
    assert sorted(map(tuple, got.collect())) == want
    assert substring_dedup.remove_repeats(frame(spark, ODD)).count() == len(ODD)


def test_op9(spark, rows):
    rng = random.Random(2)
    for _ in range(20):
        edges = np.array(sorted(rng.sample(range(1, 40), 7)))
        counts = np.array([rng.randint(1, 9) for _ in edges])
        import itertools

        cost = lambda bounds: sum(c * min(b for b in bounds if b >= e) for e, c in zip(edges, counts))
        best = min(cost([*x, edges[-1]]) for x in itertools.combinations(edges[:-1].tolist(), 2))
        assert cost(packing.best_boundaries(edges, counts, 3)) == best
    out = packing.pack_documents(frame(spark, [*rows, *ODD]), buckets=4, budget=300).collect()
    assert len(out) == len(rows) + len(ODD)
    held = collections.Counter((r.bucket, r.batch) for r in out)
    for r in out:
        assert r.length <= r.padded and r.padding == r.padded - r.length
        assert held[r.bucket, r.batch] == 1 or held[r.bucket, r.batch] * r.padded <= 300 or r.padded == 0


@pytest.mark.parametrize("bucket_rows", [2, 4096])
def test_op10(spark, bucket_rows):
    rng = random.Random(4)
    data = [(i, " ".join(["w"] * rng.randint(0, 30))) for i in range(150)] + ODD
    got = mixing.mix(mixing.sized(frame(spark, data)), bucket_rows=bucket_rows).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.size == 0 or r.taken % r.size == 0 and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, left, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set(names)
    want = {}
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= full
    want |= {s: weights[s] * level for s in open_}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 30 for s in names)
    clash = frame(spark, data).selectExpr("*", "1 AS _id", "2 AS _copies", "3 AS _again", "4 AS _size")
    mixed = mixing.mix_documents(clash)
    assert mixed.columns == clash.columns and 0 < mixed.count() <= 2 * len(data)
    again = mixing.mix(mixing.sized(frame(spark, data).repartition(7)), bucket_rows=3).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id > 1")
    for made in (
        suffix_dedup.remove_repeats(none), exact_dedup.exact_classes(none), secrets.scan(none), media.stored_features(none), tokens.count_tokens(none),
        minhash_dedup.near_components(none), substring_dedup.remove_repeats(none), packing.pack_documents(none), mixing.mix(mixing.sized(none)), mixing.mix_documents(none),
    ):
        assert made.count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (6, 3), *((20 + i, 21 + i) for i in range(30))]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 6, 7, 8)}, 4: 4, 5: 4, **{i: 20 for i in range(20, 51)}}


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
    out = corpus_pipeline.run(spark, d).collect()
    assert 0 < len(out) <= 2 * docs.count()
