"""The ten training-data operators against brute force, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from oddsmith.llm import decontaminate, disclosure, langid, lm, minhash, mixing, paragraphs, quality, repeats, suffixes, tokens
from oddsmith.llm.store import stored
from oddsmith.llm.text import blocks

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names the operators use inside
CLASH = "size long, h long, bands string, n string, rank string, stats string, start string, key string, label string, score string, bucket string, part string, row string, gone string, parts string, removed string, spans string, id string, before string, held_out string"
WORDS = "the house of a river and stone bridge under old light with many birds near green water by night".split()


def prose(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def edge_rows():
    """Null, empty, blank, short, very long, repeated and non-ASCII texts; a null id, a null source; ties."""
    rng = np.random.default_rng(3)
    base = prose(rng, 80)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "word", None, "b"), (5, prose(rng, 30_000), "en", "a"),
        (6, base, "en", "b"), (7, base, "en", "b"), (8, base + " end", "de", "c"), (8, base + " end", "de", "c"), (9, "Ünïcödé ☃ 😀 straße\n" * 20, "de", "c"),
        (10, "x" * 5000, "en", "a"), (None, "no id here but some words", "en", "a"), (11, "!!! 123 ???", "fr", "a"),
        (12, prose(rng, 40) + "\n" + base, "en", "a"), (13, "a b c d", "en", "a"), (14, "A B  C\nd", "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def edge(spark, edge_rows):
    extra = len(CLASH.split(","))
    frame = spark.createDataFrame([(*r, *([None] * extra)) for r in edge_rows], f"{SCHEMA}, {CLASH}")
    return stored(frame, "edge")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def docs_of(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# 1 near duplicates


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(ids, texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j), key=lambda k: ids[k])] = min(root(i), root(j), key=lambda k: ids[k])
    return [len(s) for s in sets], [ids[root(i)] for i in range(len(ids))]


def near_copies(rng, groups, copies, most):
    texts = []
    for _ in range(groups):
        base = prose(rng, int(rng.integers(30, 120))).split()
        base = [w + str(rng.integers(0, 50)) for w in base]
        for _ in range(copies):
            w = list(base)
            for _ in range(int(rng.integers(0, most))):
                w[int(rng.integers(0, len(w)))] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("bucket", [minhash.BUCKET, 8])
def test_near_duplicates_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    texts = near_copies(np.random.default_rng(1), 6, 25, 5)
    texts += [texts[0], texts[3], None, "", "a b c", "A b  c"]
    got = {r["doc_id"]: r for r in rows_of(minhash.near_duplicates(docs_of(spark, texts)))}
    sizes, components = brute_components(list(range(1, len(texts) + 1)), texts)
    assert [got[i + 1]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i + 1]["component_id"] for i in range(len(texts))] == components
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Buckets far past a block: one group of copies drifting apart, and texts that share half their words without being copies."""
    monkeypatch.setattr(minhash, "BUCKET", 8)
    monkeypatch.setattr(minhash, "CELL_SHINGLES", 500)
    rng = np.random.default_rng(31)
    own = lambda k: [f"own{x}" for x in rng.integers(0, 10**9, k)]
    common = [f"{w}{rng.integers(0, 50)}" for w in prose(rng, 90).split()]
    drift, texts = common + own(30), []
    for _ in range(60):
        drift = list(drift)
        drift[int(rng.integers(0, len(drift)))] = own(1)[0]
        texts.append(" ".join(drift))
    texts += [" ".join(common + own(int(rng.integers(20, 60)))) for _ in range(80)]
    texts += [x + " and one more" for x in texts[-20:]]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    docs = docs_of(spark, texts)
    sigs = minhash.signatures(docs).select("doc_id", "bands")
    kinds = {r["kind"]: r["count"] for r in minhash.buckets(sigs).groupBy("kind").count().collect()}
    assert kinds[minhash.SMALL] and kinds[minhash.BLOCK] > kinds[minhash.WHOLE] > 0
    sizes, components = brute_components(list(range(1, len(texts) + 1)), texts)
    got = {r["doc_id"]: r for r in rows_of(minhash.near_duplicates(docs))}
    assert [got[i + 1]["component_id"] for i in range(len(texts))] == components
    assert [got[i + 1]["n_shingles"] for i in range(len(texts))] == sizes


def test_cells_hold_every_pair_across_components(spark, monkeypatch):
    """Each two members of different components meet, and no cell has more than its bound of rows or so."""
    monkeypatch.setattr(minhash, "BUCKET", 16)
    component = [0] * 150 + [1] * 40 + list(range(2, 32))
    rows = [(7, i, 5, b"", c) for i, c in enumerate(component)] + [(8, i, 5, b"", 3) for i in range(9)]
    frame = spark.createDataFrame(rows, "bucket long, doc_id long, n long, sketch binary, component long")
    met, inside = set(), {}
    for r in minhash.cells(frame).collect():
        inside.setdefault(r["bucket"], []).append(r["doc_id"])
    for ids in inside.values():
        assert len(ids) == len(set(ids)) <= 64
        met |= {(i, j) for i in ids for j in ids}
    assert all((i, j) in met for i, c in enumerate(component) for j, e in enumerate(component) if c != e)


def test_near_duplicates_edges(edge, edge_rows, none):
    got = rows_of(minhash.near_duplicates(edge))
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == 6 and by[8]["component_id"] == 6 and by[14]["component_id"] == 13
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"]
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert rows_of(minhash.near_duplicates(none)) == []
    kept = minhash.kept_documents(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13]


def test_near_duplicates_of_repeated_ids(spark):
    """Each text of an id has its own sketch: a near copy of either is found, whichever row comes first."""
    rng = np.random.default_rng(21)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(5, a), (5, b), (8, a + " end"), (9, b + " end"), (7, c), (5, a)]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string")
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in rows_of(minhash.near_duplicates(docs))}
        assert got == {(5, 5, True), (8, 5, False), (9, 5, False), (7, 7, True)}
        assert {(r["doc_id"], r["text"]) for r in rows_of(minhash.kept_documents(docs))} == {(5, min(a, b)), (7, c)}


def test_odd_sketch_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    for share in (0.6, 0.8, 0.95):
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:keep], rng.integers(0, 1 << 63, len(a) - keep, dtype=np.uint64)]))
        m = minhash.samples(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        x, y = minhash.odd_sketches(m)
        z = int(np.bitwise_count(x ^ y).sum())
        estimate = 1 + minhash.SKETCH_BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * z / minhash.SKETCH_BITS)
        assert abs(estimate - share) < 0.12


# 2 language model


def brute_lm(texts, target, mu):
    tok = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] for t in texts]
    corpora = {"t": [tok[i] for i in target], "b": tok}
    c = {k: Counter(w for d in v for w in d) for k, v in corpora.items()}
    n = {k: sum(v.values()) for k, v in c.items()}
    size = len(set().union(*c.values())) + 1
    pairs = {k: Counter((b, w) for d in v for b, w in zip(["<", *d[:-1]], d, strict=bool(d))) for k, v in corpora.items()}
    contexts = {k: Counter() for k in corpora}
    for k, found in pairs.items():
        for (b, _), x in found.items():
            contexts[k][b] += x
    out = []
    for d in tok:
        loss = {k: sum(-np.log((pairs[k][b, w] + mu * (c[k][w] + 1) / (n[k] + size)) / (contexts[k][b] + mu)) for b, w in zip(["<", *d[:-1]], d, strict=bool(d))) for k in corpora}
        out.append(None if not d else (loss["t"] / len(d), loss["b"] / len(d)))
    return out


def test_chunk_round_trip(tmp_path):
    """A chunk read back from its file has the same arrays, without documents, words or ids as well."""
    for words, tokens, ids in (([5, 9, 5, 7, 2**63 + 1], [2, 0, 3], [4, None, -1]), ([], [0], [1]), ([], [], [])):
        chunk = lm.Chunk.of(np.array(words, np.uint64), np.array(tokens, np.int64), ids)
        chunk.write(fs.LocalFileSystem(), str(tmp_path / "c"))
        back = lm.Chunk.read(fs.LocalFileSystem(), str(tmp_path / "c"))
        assert all(np.array_equal(getattr(chunk, n), getattr(back, n)) for n, _ in lm.Chunk.PARTS)
    # documents 5 9 and 5 7 5: pairs (border 5), (5 7), (5 9), (7 5) in this order
    chunk = lm.Chunk.of(np.array([5, 9, 5, 7, 5], np.uint64), np.array([2, 3]), [1, 2])
    assert chunk.counts(None).tolist() == [2, 1, 1, 1] and chunk.counts(np.array([False, True])).tolist() == [1, 1, 0, 1]


@pytest.mark.parametrize("by_id", [False, True])
def test_cross_entropy_brute_force(spark, monkeypatch, by_id):
    """Many small chunks and ranges; the target as texts or as ids of the background."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    monkeypatch.setattr(lm, "RANGE_KEYS", 20)
    rng = np.random.default_rng(2)
    texts = [prose(rng, int(rng.integers(1, 60))) + " rare" + str(i) for i in range(20)] + [None, ""]
    docs = docs_of(spark, texts)
    target = docs.where("doc_id <= 7")
    got = {r["doc_id"]: r for r in rows_of(lm.cross_entropy_difference(docs, target.select("doc_id") if by_id else target, docs))}
    for i, want in enumerate(brute_lm(texts, range(7), lm.MU)):
        r = got[i + 1]
        if want is None:
            assert r["n_tokens"] == 0 and r["score"] is None
        else:
            assert np.allclose([r["loss_target"], r["loss_background"], r["score"]], [*want, want[0] - want[1]])


def test_cross_entropy_keeps_rare_words_and_pairs(spark):
    """120,000 tokens: a word or a pair that occurs once lies below 1e-5 of them, and counts all the same; also for documents of neither corpus."""
    texts = ["seldom met pair", *["a b c d e f g h i j k l " * 1000] * 10, "seldom met", "never seen pair"]
    docs = docs_of(spark, texts)
    known = docs.where("doc_id <= 12")
    want = brute_lm(texts[:12], [0], lm.MU)
    for frame in (known, docs):
        got = {r["doc_id"]: r for r in rows_of(lm.cross_entropy_difference(frame, docs.where("doc_id = 1"), known))}
        for i, w in enumerate(want):
            assert np.allclose([got[i + 1]["loss_target"], got[i + 1]["loss_background"]], w)
    n, v = 3, 15 + 1
    first = -np.log((1 / (n + v)) * lm.MU / (1 + lm.MU))
    second = -np.log(1 / (n + v))
    third = -np.log(2 / (n + v))
    assert np.isclose(got[13]["loss_target"], (first + second + third) / 3)


def test_cross_entropy_edges(edge, edge_rows, none):
    assert len(rows_of(lm.cross_entropy_difference(edge, edge.where("lang = 'en'"), edge))) == len(edge_rows)
    assert all(r["score"] is None or np.isfinite(r["score"]) for r in rows_of(lm.cross_entropy_difference(edge, none, edge)))
    assert rows_of(lm.cross_entropy_difference(none, none, none)) == []


# 3 personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data_brute_force(spark):
    texts = [
        "x 1.2.3.4.5 a@b.c%d@e.f +1 234 567 890 1234 4111 1111 1111 1111 999.1.1.1 é😀 me@x.org", None, "", "+12 3456-78 90 ( 00012.1.1.1 4111-1111-1111-1111 4111  1111 a@b 1-",
        "+49 (30) 1234-5678. call 5500005555555559 or 192.168.0.1:80, 192.168.0.256", "a.b+c@d-e.co.uk,f@g.h\n" * 3, "9" * 3000 + " " + "a" * 20_000, "12 34 56 78 90 12 34 56 +1(2)3.4-5 6 7 8 9",
    ]
    rng = np.random.default_rng(4)
    alphabet = list("0123456789.@+- ()ab\n") + ["1.2.3.4", "4111111111111111", "é"]
    texts += ["".join(rng.choice(alphabet, 80)) for _ in range(60)]
    got = {r["doc_id"]: r for r in rows_of(disclosure.personal_data(docs_of(spark, texts)))}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[i + 1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert got[i + 1]["n_card"] == want.count("card:") and got[i + 1]["n_ip"] == want.count("ip:")


def test_disclosing_terms(spark):
    texts = ["Contact Zorbax via ann@x.org for the report", "see Zorbax or write ann@x.org about the house\nplain line", "the report about the house", None] + ["some other words for the kind"] * 20
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in rows_of(disclosure.personal_data(docs))}
    assert got[1]["spans"] == "remove:8:14,email:19:28" and got[2]["spans"] == "remove:4:10,email:20:29" and got[3]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs).collect()}
    assert clean[1] == "Contact  via [EMAIL] for the report" and clean[3] == texts[2] and clean[4] is None
    # a term that also stands elsewhere tells less: it is generalised, then kept
    more = docs_of(spark, texts[:2] + ["Zorbax again"] * 1 + ["other line"] * 200)
    assert "general:8:14" in {r["doc_id"]: r for r in rows_of(disclosure.personal_data(more))}[1]["spans"]


def test_disclosing_terms_of_lines_and_documents(spark):
    far = "with many other words " * 10
    plain = ["some with many other words for the kind"] * 30
    # farther than a hundred characters away in one line; in the line above; and in a third document of the entity, apart from it
    for texts in ([f"Zorbax {far}ann@x.org", f"by Zorbax {far}to ann@x.org"], ["Zorbax\nann@x.org", "by Zorbax\nto ann@x.org for"], ["Zorbax ann@x.org", "by Zorbax or ann@x.org", f"to ann@x.org\n{far}\nZorbax"]):
        clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs_of(spark, texts + plain)).collect()}
        for i, t in enumerate(texts):
            assert clean[i + 1] == t.replace("Zorbax", "").replace("ann@x.org", "[EMAIL]")
        assert [clean[len(texts) + 1 + i] for i in range(len(plain))] == plain
    # two lines of one document are enough, as are two documents
    one = {r["doc_id"]: r["text"] for r in disclosure.sanitised(docs_of(spark, ["Zorbax ann@x.org\nby Zorbax ann@x.org", *plain])).collect()}
    assert one[1] == " [EMAIL]\nby  [EMAIL]"


def test_personal_data_edges(edge, edge_rows, none):
    assert len(rows_of(disclosure.personal_data(edge))) == len(edge_rows)
    assert rows_of(disclosure.personal_data(none)) == []
    assert disclosure.sanitised(edge).columns == edge.columns


# 4 quality


def labelled(spark, n=200):
    rng = np.random.default_rng(5)
    good = [prose(rng, int(rng.integers(5, 200))) for _ in range(n)]
    bad = [" ".join(w + "***" for w in prose(rng, int(rng.integers(5, 100))).split()) if i % 2 else prose(rng, 40).upper().replace(" ", "!! ") for i in range(n)]
    docs = docs_of(spark, good + bad)
    return docs, spark.createDataFrame([(i + 1, int(i < n), 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = rows_of(quality.classify(docs, labels))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    # labels of the held-out fold change nothing
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert {r["doc_id"]: round(r["score"], 9) for r in rows_of(quality.classify(docs, other))} == {r["doc_id"]: round(r["score"], 9) for r in got}


def test_quality_model_is_the_log_density_difference():
    rng = np.random.default_rng(6)
    x = [rng.normal(0, 1, (50, 3)), rng.normal(1, 2, (80, 3))]
    model = quality.fit_moments([50.0, 80.0], [a.sum(axis=0) for a in x], [a.T @ a for a in x])
    z = [(a - model.centre) / model.scale for a in x]
    cov = [np.cov(a.T, bias=True) for a in z]
    pooled = (50 * cov[0] + 80 * cov[1]) / 130
    shrunk = [(1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled for c in cov]
    shrunk = [(1 - quality.TO_IDENTITY) * s + quality.TO_IDENTITY * np.trace(s) / 3 * np.eye(3) for s in shrunk]
    point = rng.normal(0, 1, 3)
    p = (point - model.centre) / model.scale
    logs = [-0.5 * (p - a.mean(axis=0)) @ np.linalg.inv(s) @ (p - a.mean(axis=0)) - 0.5 * np.linalg.slogdet(s)[1] for a, s in zip(z, shrunk, strict=True)]
    assert np.isclose(model.score(point[None])[0], 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(80 / 50)))))


def test_quality_edges(spark, edge, edge_rows, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (5, None, 0), (7, 3, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(rows_of(quality.classify(edge, labels))) == len(edge_rows)
    empty = labels.where("false")
    assert all(r["score"] == 0.5 and r["predicted"] == 0 for r in rows_of(quality.classify(edge, empty)))
    assert rows_of(quality.classify(none, labels)) == []
    docs, good = labelled(spark, 60)
    kept = quality.accepted(docs.selectExpr("*", "'x' AS stats", "1 AS score"), good)
    assert kept.columns == ["doc_id", "text", "stats", "score"] and 40 < kept.count() < 80


# 5 fingerprints


def brute_near(a, b):
    x, y = ({p for p in t.split("\n") if p} for t in (a, b))
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def test_fingerprints_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = ["\n".join(prose(rng, 4) + str(rng.integers(0, 9)) for _ in range(int(n))) for n in rng.integers(0, 40, 25)] + [None, "", "one", "\n\nline\n\n", "😀é" * 7]
    texts += ["\n".join(f"line {i}" for i in range(600)), "\n".join(f"line {i}" for i in range(300, 900)), texts[0]]
    got = {r["doc_id"]: r for r in rows_of(paragraphs.fingerprints(docs_of(spark, texts)))}
    for i, t in enumerate(texts):
        t, after, r = t or "", texts[(i + 1) % len(texts)] or "", got[i + 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert np.isclose(r["near_edited"], brute_near(t, edited)) and np.isclose(r["near_next"], brute_near(t, after))
    assert got[1]["fingerprint"] == got[len(texts)]["fingerprint"] != got[2]["fingerprint"] and got[27]["fingerprint"] == ""


@pytest.mark.parametrize("step", [1, 37, "gaps"])
def test_next_documents_over_slices(spark, monkeypatch, step):
    monkeypatch.setattr(paragraphs, "SLICE", 4)
    rng = np.random.default_rng(21)
    ids = sorted({int(i) for i in (rng.integers(-500, 10**6, 60) if step == "gaps" else np.arange(-30, 30) * step)})
    if step == "gaps":
        ids = sorted({*ids, *range(100, 130), 1 << 40})
    texts = {i: f"head {i}\nshared\n{prose(rng, 5)}" for i in ids}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in rows_of(paragraphs.fingerprints(frame))}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(texts[i]) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((texts[i][: len(texts[i]) - half] + texts[after][:half]).encode()).hexdigest()
        assert np.isclose(got[i]["near_next"], brute_near(texts[i], texts[after]))


def test_fingerprints_edges(spark, edge, edge_rows, none):
    assert len(rows_of(paragraphs.fingerprints(edge))) == len(edge_rows)
    assert rows_of(paragraphs.fingerprints(none)) == []
    alone = rows_of(paragraphs.fingerprints(docs_of(spark, ["ab\ncd"])))[0]
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"ab\nab").hexdigest()


# 6 decontamination


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        before, row = row, [i + 1] + [0] * len(text)
        for j, c in enumerate(text):
            row[j + 1] = min(before[j] + (p != c), before[j + 1] + 1, row[j] + 1)
    return min(row)


def test_decontamination_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [prose(rng, 18) + f" item {i}" for i in range(6)] + [None, "", "tiny word", "Ärger ÜBER alles " + prose(rng, 12), prose(rng, 60)]
    texts = []
    for k in (0, 1, 3, 5, 9, 10):
        for edits in (0, 1, 3, 6, 8, 14):
            t = list(items[k])
            for _ in range(edits):
                at = int(rng.integers(0, len(t)))
                t[at : at + int(rng.integers(0, 2))] = rng.choice(list("abc xyz"), int(rng.integers(0, 2))).tolist()
            texts.append(prose(rng, 30) + " \n" + "".join(t).upper().replace(" ", "  \t") + " " + prose(rng, 10))
    texts += ["just a tiny  word here", None, "", prose(rng, 500)]
    bench = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows_of(decontaminate.contaminations(docs_of(spark, texts), bench))}

    def plain(t):
        b = np.frombuffer((t or "").encode(), np.uint8)
        return decontaminate.normalised(b, np.array([0, len(b)]))[0].tobytes()

    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            p = plain(item)
            if p:
                d = brute_distance(p, plain(t))
                most = 0 if len(p) < 16 else min(int(len(p) * decontaminate.EDIT_SHARE), len(p) // 8 - 1)
                if d <= most:
                    want[i + 1, 100 + k] = d
    assert got == want and len(set(want.values())) > 3


def test_decontamination_blocks_and_edges(spark, monkeypatch, edge, none):
    bench = spark.createDataFrame([(1, "under old light with many birds near green water by night"), (2, None), (3, "no id here but some words")], "item_id long, text string")
    one = sorted((r["doc_id"] or 0, r["item_id"]) for r in rows_of(decontaminate.contaminations(edge, bench)))
    assert (0, 3) in one
    monkeypatch.setattr(decontaminate, "ITEMS", 1)
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in rows_of(decontaminate.contaminations(edge, bench))) == one
    several = decontaminate.clean_documents(edge, bench)
    monkeypatch.undo()
    assert rows_of(decontaminate.contaminations(none, bench)) == [] == rows_of(decontaminate.contaminations(edge, bench.where("false")))
    clean = decontaminate.clean_documents(edge, bench)
    assert clean.columns == several.columns == edge.columns and clean.count() == edge.count() - len({d for d, _ in one})
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, several.collect()))
    assert decontaminate.clean_documents(edge, bench.where("false")).count() == edge.count()


def test_normalised_text():
    texts = ["  A  b\t", "", "ÀÉ\n\n x", " ", "Z"]
    raw = [t.encode() for t in texts]
    data, bounds = decontaminate.normalised(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == ["a b", "", "àé x", "", "z"]


# 7 repeated passages


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats_brute_force(spark, hot):
    rng = np.random.default_rng(9)
    passage = prose(rng, 60)
    texts = [prose(rng, 50) + passage + prose(rng, 20) for _ in range(6)] + [passage, passage, "z" * 300, "ab" * 200, "é" * 120, None, "", "x" * 99, "x" * 100]
    texts += [passage[: 40 + i] + "!" + passage[30 + i :] for i in range(12)] + [texts[0][:200] + "\n" + texts[1][100:]]
    got = {r["doc_id"]: r for r in rows_of(repeats.without_repeats(docs_of(spark, texts), hot))}
    assert [tuple(got[i + 1][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == brute_repeats(texts)


def test_hot_windows_meet_across_blocks(spark, monkeypatch):
    """A passage in many surroundings, over many blocks, tasks and Arrow batches: the first place keeps its windows."""
    rng = np.random.default_rng(33)
    passage = prose(rng, 25)
    texts = [f"{prose(rng, int(rng.integers(0, 4)))} {i} {passage[: 120 + i % 7]}{i * 7919 % 1000} {prose(rng, 12)}" for i in range(150)]
    texts[40] = texts[90] = passage * 3
    docs = docs_of(spark, texts).orderBy(F.desc("doc_id")).repartition(7)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1 << 12)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r["doc_id"]: r for r in rows_of(repeats.without_repeats(docs, 5))}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(got[i + 1][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_edges(spark, edge, edge_rows, none):
    got = rows_of(repeats.without_repeats(edge))
    assert len(got) == len(edge_rows)
    by = sorted((r["doc_id"] or 0, r["n_removed"]) for r in got)
    assert dict(by)[7] == len(next(r[1] for r in edge_rows if r[0] == 7))
    # of two equal rows of an id one is the earlier
    assert len({n for i, n in by if i == 8}) == 2 or all(n > 0 for i, n in by if i == 8)
    assert rows_of(repeats.without_repeats(none)) == []


def test_suffix_arrays():
    rng = np.random.default_rng(10)
    for _ in range(150):
        n, s = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        text = np.append(rng.integers(1, s + 1, n), 0).astype(np.int32)
        array = suffixes.suffix_array(text, s + 1)
        assert array.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        common = suffixes.common_prefixes(text, array, np.array([0]), 0, 1 << 10)
        for x, y in zip(array[1:], array[:-1], strict=True):
            m = min(n + 1 - x, n + 1 - y)
            assert common[x] == np.cumprod(text[x : x + m] == text[y : y + m]).sum()


def test_suffix_arrays_of_names():
    """Strings of names of few and many symbols, long runs, periods and repeated stretches, through all levels of the recursion."""
    rng = np.random.default_rng(31)
    strings = [rng.integers(1, int(rng.integers(2, 3000)), int(rng.integers(1, 400))) for _ in range(150)]
    strings += [np.tile(s[: int(rng.integers(1, 9))], 40) for s in strings[:40]] + [np.ones(3000, np.int64), np.arange(1, 2000), np.arange(2000, 0, -1), np.tile([1, 2], 1500), np.empty(0, np.int64)]
    for names in strings:
        names = np.append(names, 0)
        assert suffixes.sorted_names(names).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_suffix_arrays_of_long_texts():
    rng = np.random.default_rng(32)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    prose = " ".join(rng.choice(words, 6000))
    for data in (prose.encode(), (prose[:9000] + "=" + prose[:12000] + prose[3000:9000]).encode(), b"ab" * 5000):
        text = np.append(np.frombuffer(data, np.uint8).astype(np.int32) + 1, 0).astype(np.int32)
        assert suffixes.suffix_array(text, 257).tolist() == [len(data), *sorted(range(len(data)), key=lambda i: data[i:])]


# 8 token files


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    pieces = ["the", "House", "it's", "don't!!", "naïve.", "ÉTÉ,***", "áb", "≠x", ".́", "Σας.Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>y", "123.45", "  ", "\n", " ", "😀", "÷2", "×", "ß?", "(c)", "|", "İI", "é.", ".́e", "\x0b", "K", "ﬁ!", "'S.", "A'LL"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 30)))) for _ in range(150)] + [" ".join(rng.choice(pieces, 300)) for _ in range(5)] + [None, "", "y" * 4000]
    got = {r["doc_id"]: r for r in rows_of(tokens.tokenize(spark, docs_of(spark, texts), TOKENIZER))}
    tokenizer, at = Tokenizer.from_file(TOKENIZER), 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[i + 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)


def test_tokens_of_decomposed_capitals(spark):
    """Only the small letters of these compose with their mark: lower case must not come before composition, whatever the neighbours hold."""
    from tokenizers import Tokenizer

    marked = ["H\u0331amas", "J\u030cx", "T\u0308", "W\u030aa", "THE H\u0331AMAS.T\u0308 AND (W\u030aA)"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for texts in (marked, [*marked, "<|endoftext|> A<|ENDOFTEXT|>"]):
        got = {r["doc_id"]: r for r in rows_of(tokens.tokenize(spark, docs_of(spark, texts), TOKENIZER))}
        for i, t in enumerate(texts):
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
            assert (got[i + 1]["n_tokens"], got[i + 1]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t


def test_token_files_round_trip(spark, monkeypatch, edge, none):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 64)
    folder = tokens.shared_folder(spark, "tokens-test")
    manifest = tokens.write_tokens(edge, TOKENIZER, folder)
    whole = {(r["doc_id"], len(r["ids"])): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in tokens.read_ids(manifest, folder).collect()}
    back = rows_of(tokens.read_tokens(manifest, folder))
    assert len(back) == edge.count() and {(r["doc_id"], r["n_tokens"]): r["ids_crc32"] for r in back} == whole
    order = sorted(back, key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in order] == sorted(r["doc_id"] or -1 for r in back) and order[-1]["start"] + order[-1]["n_tokens"] == sum(r["n_tokens"] for r in back)
    assert rows_of(tokens.tokenize(spark, none, TOKENIZER)) == []


def test_bit_planes():
    rng = np.random.default_rng(12)
    for n, top in ((1, 1), (7, 3), (64, 50_000), (1000, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        mask, planes = tokens.to_planes(ids)
        assert (tokens.from_planes(mask, planes, n) == ids).all() and len(planes) <= int(ids.max()).bit_length()


# 9 mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, free = 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in free)
        over = {s for s in free if target[s] >= 2 * sizes[s]}
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= over
    return target


def test_mix_brute_force(spark):
    rng = np.random.default_rng(13)
    rows = [(i, prose(rng, int(rng.integers(0, 50))), str(rng.choice(["a", "b", "c", "d"], p=[0.7, 0.1, 0.1, 0.1])) if i % 9 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(mixing.mix(docs))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    for s, size in sizes.items():
        own = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {size} and np.isclose(own[0]["target"], target[s])
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in got if r["size"]}
    counted = {r["doc_id"]: r["n"] for r in mixing.mixed_documents(docs).where("text <> ''").groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert counted == {i: n for i, n in taken.items() if n}


def test_mix_edges(edge, edge_rows, none):
    got = rows_of(mixing.mix(edge))
    assert len(got) == len(edge_rows) and {r["taken"] for r in got if r["size"] == 0} == {0}
    assert mixing.mixed_documents(edge).columns == edge.columns
    assert rows_of(mixing.mix(none)) == [] == rows_of(mixing.mixed_documents(none))
    only = edge.where("doc_id in (1, 2)")
    assert all(r["target"] == 0 and r["taken"] == 0 for r in rows_of(mixing.mix(only)))


# 10 language


def test_language_held_out(spark):
    rng = np.random.default_rng(14)
    pools = {"aa": "lon mir tas ven dor kel".split(), "bb": "chu ßan öde gra wolt".split(), "cc": "тор мак лин дер".split()}
    rows = []
    for i in range(600):
        lang = list(pools)[i % 3]
        rows.append((i, " ".join(rng.choice(pools[lang], 2).tolist()[0] + w for w in rng.choice(pools[lang], int(rng.integers(3, 30)))), lang if i % 7 else None))
    rows += [(9001, None, "aa"), (9002, "123 !!", "aa"), (9003, "", None), (9004, "¿", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows_of(langid.identify(docs, per_language=150))}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == list(pools)[i % 3] for i in held]) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (9001, 9002, 9003, 9004))
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("n", [2, 5, 10, 11])
def test_every_language_is_learnt(spark, n):
    """Equal and unequal counts, as many languages as the held-back share divides, and one language of a single row."""
    rng = np.random.default_rng(n)
    letters = [chr(c) for c in (*range(97, 123), *range(0x430, 0x450), *range(0x3B1, 0x3CA))]
    rng.shuffle(letters)
    alphabets = [letters[4 * k : 4 * k + 4] for k in range(n)]
    word = lambda k: "".join(rng.choice(alphabets[k], 5))
    rows = [(i, " ".join(word(i % n) for _ in range(12)), f"l{i % n:02}") for i in range(60 * n)]
    rows += [(10_000 + i, " ".join(word(0) for _ in range(12)), "l00") for i in range(100)]
    single = next(i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows.append((single, "ßßß äää ööö", "lone"))
    got = {r["doc_id"]: r for r in rows_of(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))}
    for k in range(n):
        held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 10_000 and r["doc_id"] % n == k]
        assert held and np.mean([r["lang_pred"] == f"l{k:02}" for r in held]) > 0.98


def test_language_forward_pass():
    """The vectorised prediction against one document at a time, n-gram by n-gram."""
    rng = np.random.default_rng(4)
    texts = ["Ab cd éf", "xyz", "", "a", "hello world hello", "123 abc"]
    model = langid.Model(["p", "q", "r"], rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32), np.array([0.1, 0.2, -0.1]), 0.7, 0.0)
    block = next(blocks(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    best, score = model.predict(block)
    for i, text in enumerate(texts):
        one = next(blocks(iter([pa.RecordBatch.from_pydict({"text": [text]})])))
        found, _ = langid.buckets(one)
        data = bytes(langid._FOLD[list(text.encode())]) if text else b""
        grams = [data[k : k + size] for size in (3, 4) for k in range(len(data) - size + 1) if data[k : k + 2] != b"  "]
        assert len(grams) == len(found)
        logits = np.array([sum(float(model.table[b, c]) for b in found) / max(len(found), 1) + model.bias[c] for c in range(3)]) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert best[i] == p.argmax() and np.isclose(score[i], p.max())


def test_language_edges(edge, edge_rows, none):
    got = rows_of(langid.identify(edge))
    assert len(got) == len(edge_rows)
    assert {r["lang_pred"] for r in rows_of(langid.identify(edge.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")))} == {"und"}
    assert rows_of(langid.identify(none)) == []


def test_scan_in_pieces(spark, monkeypatch):
    """Running states over pieces of any size equal a plain loop, empty arrays included."""
    rng = np.random.default_rng(6)
    rows = [([int(v) for v in rng.integers(1, 9, k)],) for k in (0, 1, 2, 3, 4, 7, 50)]
    frame = spark.createDataFrame(rows, "a array<int>")
    for size in (1, 3, 128):
        monkeypatch.setattr(disclosure, "SCAN", size)
        got = frame.select("a", disclosure.scanned(F.col("a"), lambda at, x: at + x, lambda at, x: at * 10 + x).alias("out")).collect()
        for r in got:
            at, want = 0, []
            for x in r["a"]:
                want.append(at * 10 + x)
                at += x
            assert r["out"] == want


def test_personal_data_of_a_long_table_of_figures(spark):
    """160,000 numbers, then 20,000 addresses on as many lines: time in proportion to the text."""
    import time

    texts = [" ".join(f"{i:06}x" for i in range(160_000)), "\n".join(f"mail user{i}@host.org now" for i in range(20_000)), "4111111111111111 " * 3000]
    start = time.time()
    got = {r["doc_id"]: r for r in rows_of(disclosure.personal_data(docs_of(spark, texts)))}
    assert (got[1]["n_card"], got[2]["n_email"], got[3]["n_card"]) == (0, 20_000, 0)
    assert time.time() - start < 240
