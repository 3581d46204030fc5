"""Long texts, ties, shared and null ids, clashing columns and hot groups, each against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from kinfabric.llm import exact_dedup, media, minhash_dedup, mixing, packing, secrets, substring_dedup, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside, as columns of the input.
CLASH = ("rk", "text_view", "h", "s", "c", "id", "key", "k", "ids", "length", "size", "g", "copies", "component_id", "_n")
LONG = "the long text says " * 70_000


def frame(spark, rows):
    """doc_id, text and columns whose names clash; null sources come too."""
    made = spark.createDataFrame([(i, t, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 2}") for i, t in rows], "doc_id long, text string, source string")
    return made.selectExpr("*", "'en' AS lang", *[f"{n} AS {name}" for n, name in enumerate(CLASH)]).repartition(3)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def grams(t, n):
    w = WORD.findall(lower(t))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(sets, percent):
    """Smallest id that each id reaches over links of enough similarity."""
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for a, s in sets.items():
        common = collections.Counter(b for g in s for b in where[g] if b < a)
        for b, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    return {i: root(i) for i in sets}


def family(rng, n, changes, words=120):
    """Texts made from one by as many changed words each: similar, not always enough."""
    say = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [say() for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(words), changes):
            text[at] = say()
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("tile", [4, 2048])
def test_op7_families_that_stay_apart(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    rng = random.Random(3)
    texts = [t for changes in (1, 2, 3, 4) for t in family(rng, 14, changes)] + [LONG, LONG + " more", "", None, "one", "One"]
    rows = list(enumerate(texts))
    want = linked({i: grams(t, 3) for i, t in rows}, 85)
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in minhash_dedup.near_components(frame(spark, rows), 3, 85).collect()}
    assert got == {i: (want[i], len(grams(t, 3)), want[i] == i) for i, t in rows}
    assert 1 < len(set(list(want.values())[14:28])) < 14 or 1 < len(set(list(want.values())[28:42]))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_op7_recall_over_documents(spark, n, percent):
    """Every link between components of all documents of sf0.01, by exact pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = linked({r.doc_id: grams(r.text, n) for r in docs.collect()}, percent)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_components(docs, n, percent).collect()}
    assert got == want


def slow_windows(rows):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    for i, w in words:
        hit = [False] * len(w)
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                hit[s : s + 50] = [True] * 50
        kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
        yield i, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest()


def test_op8_shared_and_null_ids(spark):
    rng = random.Random(6)
    say = lambda n: [str(rng.randrange(500)) for _ in range(n)]
    passage = say(75)
    text = lambda: " ".join([*say(20), *passage, *say(20)])
    rows = [(i, text()) for i in (5, 5, 9, 2, None, None, 40)] + [(5, " ".join(passage)), (None, " ".join(passage)), (50, LONG[:40_000]), (51, LONG[:40_000] + " end"), (52, ""), (53, None)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_windows(rows), key=str)


def slow_spans(t):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12, 6, "secret"),
        ("access", re.compile("AKIA[A-Z0-9]{8,}"), 0, 18, 12, "id"),
        ("hex", re.compile("[0-9a-f]{12,}"), 0, 16, 12, "secret"),
        ("endpoint", re.compile(r"""https?://[^\x20\x09-\x0D"'<>]+"""), 0, None, 0, "endpoint"),
    )
    parts = []
    for name, pattern, group, strong, weak, role in kinds:
        for m in pattern.finditer(t or ""):
            size = len(m[group])
            if strong and size >= strong:
                parts.append((name, m.start(), m.end(), role, True))
            elif size >= weak and (name != "hex" or re.search("[0-9]", m[0])):
                parts.append((name if name == "endpoint" else f"weak_{name}", m.start(), m.end(), role, False))
    partners = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}
    near = lambda p: any(q[3] in partners[p[3]] and ((q[1] <= p[1] and q[2] >= p[1] - 256) or (q[1] >= p[1] and q[1] <= p[2] + 256)) for q in parts)
    return sorted(((p[0], p[1], p[2]) for p in parts if p[4] or near(p)), key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_op3_links_by_brute_force(spark):
    rng = random.Random(10)
    bits = ["token: abcdef1", "api_key=zzzz99", "password='abcdefghijkl1'", "AKIA" + "Q7" * 5, "AKIA" + "Q7" * 9, "0123456789abc", "abcdefabcdef", "deadbeefdeadbeef00", "https://h.example/x?token=abcdef12", "http://a.example"]
    rows = [(i, " ".join(rng.choice([rng.choice(bits), "é" * rng.randrange(120), "x" * rng.randrange(200)]) for _ in range(rng.randrange(12)))) for i in range(120)]
    # kinds that start at one place, a very long text, nulls and empties, rows that share an id
    rows += [(200, "secret=0123456789abcdef0 secret=" + "AKIA" + "Q7" * 9), (201, LONG + " token: abcd1234 https://h.example/z " + LONG), (202, None), (203, ""), (204, bits[0]), (204, bits[9])]
    got = collections.defaultdict(list)
    for r in secrets.scan(frame(spark, rows)).collect():
        got[r.doc_id].append([(x["kind"], x["start"], x["end"]) for x in r.found])
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(slow_spans(t))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert any(x[0].startswith("weak") for v in want.values() for f in v for x in f)


def test_op2_long_texts(spark):
    rows = [(3, LONG), (1, LONG.upper()), (2, LONG + "x"), (4, ""), (5, None)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_classes(frame(spark, rows), keep="max").collect()}
    assert got == {3: (3, 2, True), 1: (3, 2, False), 2: (2, 1, True), 4: (5, 2, False), 5: (5, 2, True)}


def test_op5_long_texts(spark):
    rows = [(1, LONG), (1, LONG), (2, None), (None, "%PDF-1." * 3000)]
    got = media.stored_features(frame(spark, rows)).collect()
    want = [(i, len((t or "").encode()), hashlib.sha256(media.payload_of(t)[0]).hexdigest()) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.payload_sha256) for r in got), key=str) == sorted(want, key=str)


def test_op6_and_op9_long_texts_and_ties(spark):
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    rng = random.Random(1)
    rows = [(i, " ".join(["tie"] * (20 * (i % 5)))) for i in range(40)] + [(i, " ".join(str(rng.randrange(9999)) for _ in range(rng.randrange(900)))) for i in range(40, 90)] + [(90, LONG), (None, None), (7, "tie tie"), (7, "tie tie")]
    lengths = sorted(len(encode(t or "")) for _, t in rows)
    counted = tokens.count_tokens(frame(spark, rows), block=1000)
    assert sorted(r.n_tokens for r in counted.collect()) == lengths
    out = packing.pack_documents(frame(spark, rows), buckets=4, budget=2000).collect()
    assert sorted(r.length for r in out) == lengths
    edges, counts = np.unique(lengths, return_counts=True)
    total, best = np.concatenate(([0], np.cumsum(counts))), [0] + [np.inf] * len(edges)
    for _ in range(4):
        best = [0] + [min(best[i] + edges[j - 1] * (total[j] - total[i]) for i in range(j)) for j in range(1, len(edges) + 1)]
    assert sum(r.padding for r in out) == best[-1] - sum(lengths)
    held = collections.Counter((r.bucket, r.batch) for r in out)
    full = collections.defaultdict(list)
    for (bucket, batch), n in sorted(held.items()):
        full[bucket].append(n)
    for bucket, sizes in full.items():  # batches are full but for the last
        padded = next(r.padded for r in out if r.bucket == bucket)
        fit = max(1, 2000 // max(1, padded))
        assert all(n == fit for n in sizes[:-1]) and 0 < sizes[-1] <= fit


def test_op10_ties_and_long_texts(spark):
    rows = [(i, "a b c") for i in range(30)] + [(30, LONG), (31, ""), (None, "x"), (7, "a b c")]
    got = mixing.mix(mixing.sized(frame(spark, rows)), bucket_rows=4).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    again = mixing.mix(mixing.sized(frame(spark, rows).repartition(5)), bucket_rows=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    mixed = mixing.mix_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
