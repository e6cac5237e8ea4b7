"""The text operators against brute force on small tables, and on rows that are easy to get wrong."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from lumisift.llm import embedding_forest, fingerprints, langid, licenses, line_dedup, mixing, ngram_join, packing, queries, substring_dedup, token_files, tokens
from pyspark.sql import functions as F
from support import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, count long"


def table(spark, texts, first=0):
    """Documents with clashing extra columns, a null id and null language and source last."""
    rows = [(first + k, t, "en" if k % 2 else "de", f"s{k % 3}", 0, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(seed, n, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=5)) for _ in range(n))


# --- embeddings


def links_by_force(vectors, threshold=0.93):
    n = len(vectors)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = vectors[i], vectors[j]
            if la is None or la != lb or not a or not b or len(a) != len(b) or not np.isfinite(a).all() or not np.isfinite(b).all() or not np.any(a) or not np.any(b):
                continue
            x, y = np.array(a, float), np.array(b, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return links, [find(k) for k in range(n)]


def test_embedding_forest(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 16))
    rows = [(k, (base[k % 60] + r.standard_normal(16) * 0.12).astype(np.float32).tolist(), k % 3) for k in range(300)]
    rows += [(300 + k, base[0].astype(np.float32).tolist(), 0) for k in range(40)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] + [1.0] * 15, 1), (404, base[0].tolist(), None), (405, base[0].tolist()[:5], 0), (406, [1e30] * 16, 2), (407, [1e-30] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links, roots = links_by_force(rows)
    for block in (1024, 8):  # small blocks: leaves compared in parts
        found = {x.vec_id: x for x in embedding_forest.forest_links(df, 0.93, leaf=16, block=block).collect()}
        assert len(found) == len(rows)
        assert [found[row[0]].n_links for row in rows] == links
        assert [found[row[0]].component_id for row in rows] == [rows[k][0] for k in roots]
    assert sum(links) > 500
    assert embedding_forest.forest_links(df.limit(0)).count() == 0


def test_forest_with_default_settings_finds_nearly_all_links(spark):
    r = np.random.default_rng(12)
    n, bases = 21_000, r.standard_normal((7000, 64))
    rows = (bases[np.arange(n) % 7000] + r.standard_normal((n, 64)) * 0.22).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    u = embedding_forest.unit(rows.astype(np.float64))
    want = sum(int((u[k : k + 3000] @ u.T >= 0.93).sum()) for k in range(0, n, 3000)) - n
    found = embedding_forest.forest_links(df).agg(F.sum("n_links")).first()[0]
    assert want > 4000 and 0.99 * want <= found <= want


def test_forest_leaves_stay_small_beyond_what_the_sample_fits():
    r = np.random.default_rng(13)
    u = embedding_forest.unit(r.standard_normal((20_000, 64)))
    forest = embedding_forest.fit_forest(u[:64], 9, 0.93)
    at, number = forest.leaves(u, np.full(len(u), 9), [""] * len(u))
    assert forest.splits.shape[1] == 15 and len(at) / len(u) < embedding_forest.TREES * 1.2**9
    per_leaf = np.unique(number, return_counts=True)[1]
    assert per_leaf.max() < 12 * len(at) / (embedding_forest.TREES * 2**9)
    shallow = forest.leaves(u[:5], np.array([0, 1, 0, 2, 9]), [""] * 5)  # of one leaf, but for the last
    assert [int((shallow[0] == k).sum()) for k in range(4)] == [1] * 4 and (shallow[0] == 4).sum() >= embedding_forest.TREES


@pytest.mark.parametrize("shape", ["isotropic", "common mean", "clustered", "clustered, short sample"])
def test_forest_on_vectors_as_they_are(shape):
    r, n = np.random.default_rng(5), 20_000
    base = r.standard_normal((n // 3, 64))
    if shape == "common mean":  # pairs have a cosine of about 0.89
        base += 2.85 * np.ones(64)
    elif shape != "isotropic":
        base = 1.2 * r.standard_normal((40, 64))[r.integers(0, 40, len(base))] + 0.8 * base
    u = embedding_forest.unit(base[np.arange(n) % len(base)] + 0.2 * r.standard_normal((n, 64)))
    forest = embedding_forest.fit_forest(u[r.permutation(n)[: 2000 if "short" in shape else n]], 6, 0.93)
    at, number = forest.leaves(u, np.full(n, 6), [""] * n)
    leaf, sizes = np.unique(number, return_inverse=True, return_counts=True)[1:]
    shipped = (sizes * -(-sizes // embedding_forest.BLOCK)).sum() / n
    assert shipped < 25 and (sizes.astype(float) ** 2).sum() <= n * n
    own = np.split(leaf, np.flatnonzero(np.diff(at)) + 1)
    sums = [(u[k : k + 1] @ u.T >= 0.93)[0] for k in range(0, n, 10)]
    pairs = [(k, j) for k, near in zip(range(0, n, 10), sums, strict=True) for j in np.flatnonzero(near)[:50] if j != k]
    met = sum(len(np.intersect1d(own[k], own[j], assume_unique=True)) > 0 for k, j in pairs)
    assert len(pairs) > 1000 and met >= 0.99 * len(pairs)


def test_forest_takes_labels_about_their_own_means(spark):
    r = np.random.default_rng(17)
    rows = []
    for label in range(3):  # far apart, each within a narrow cone, one of them too narrow to split
        own = 4 * r.standard_normal(32) + (0.3 if label == 2 else 1.5) * r.standard_normal((1500, 32))
        own[750:] = own[:750] + 0.1 * r.standard_normal((750, 32))
        rows += [(len(rows) + k, v.astype(np.float32).tolist(), label) for k, v in enumerate(own)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = 0
    for label in range(3):
        u = embedding_forest.unit(np.array([v for _, v, x in rows if x == label], np.float32).astype(np.float64))
        want += int((u @ u.T >= 0.93).sum()) - len(u)
    for leaf, block in ((16, 1024), (384, 256)):
        found = embedding_forest.forest_links(df, leaf=leaf, block=block).agg(F.sum("n_links")).first()[0]
        assert 0.995 * want <= found <= want and (leaf < 384 or found == want)


# --- n-gram join


def jaccard_by_force(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return links, [find(k) for k in range(len(sets))]


def near_copies():
    out = []
    for g in range(12):
        base = words(g, 120).split()
        for c in range(g):
            copy = list(base)
            for k in random.Random(100 * g + c).sample(range(120), c % 4):
                copy[k] = f"edit{c}"
            out.append(" ".join(copy))
    many = words(99, 150).split()
    for c in range(60):  # one large group, all different
        copy = list(many)
        copy[c] = f"one{c}"
        out.append(" ".join(copy))
    return out + ["", "   ", "a b", "A  b", "a b c d e", words(5, 3000), words(5, 3000)]


def test_ngram_join(spark, monkeypatch):
    texts = near_copies()
    links, roots = jaccard_by_force(texts)
    assert max(links) >= 50
    for block, broadcast in ((512, 1000), (16, 0)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        found = {r.doc_id: r for r in ngram_join.ngram_links(table(spark, texts), broadcast_rows=broadcast).collect()}
        assert [found[k].n_links for k in range(len(texts))] == links
        assert [found[k].class_id for k in range(len(texts))] == roots
        assert found[None].kept and found[None].n_links == 0
    left = ngram_join.drop_near_duplicates(table(spark, texts))
    assert left.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(set(roots))
    assert ngram_join.ngram_links(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_near_copies_go_row_by_row(spark, broadcast):
    base, other, third = (words(k, 60) for k in (31, 32, 33))
    near = base + " more"
    rows = [
        (1, base, "a"), (None, near, "b"), (None, other, "c"), (None, words(34, 60), "d"),  # a null id near to 1, two null ids of their own
        (2, near, "e"), (2, words(35, 60), "f"),  # two texts of one id, one of them a copy
        (7, third, "h"), (7, third, "g"), (7, third, "g"), (8, third + " more", "i"),  # repeated rows of one id
        (None, words(36, 60), "k"), (None, words(36, 60), "j"), (None, words(36, 60) + " more", "l"),  # all ids null
        (9, "", "m"), (9, "", "m"), (None, None, "n"), (None, None, "n"),  # without words
    ]
    left = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"), broadcast_rows=broadcast).collect()
    found = Counter(r.source for r in left)
    last = {x: found.pop(x, 0) for x in "jkl"}
    assert found == Counter("acdfgmmnn") and sum(last.values()) == 1 and not last["k"]


def test_op2_on_all_documents(spark, sf, texts):
    ids = sorted(texts)
    links, roots = jaccard_by_force([texts[i] for i in ids])
    found = {r.doc_id: r for r in queries.op2_ngram_join(spark, sf).collect()}
    assert [(found[i].n_links, found[i].class_id) for i in ids] == [(n, ids[k]) for n, k in zip(links, roots, strict=True)]


def test_sets_at_the_threshold_share_an_ngram_of_their_prefixes():
    r = np.random.default_rng(7)
    counts = r.integers(0, 50, 1 << ngram_join.COUNT_BITS).astype(np.uint32)  # any order will do
    met = 0
    for _ in range(3000):
        x = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 60)), dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.choice([0.85, 0.95, 1.0])], r.integers(0, 1 << 63, int(r.integers(0, 8)), dtype=np.uint64)]))
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        shared = len(np.intersect1d(x, y))
        if not shared or shared < 0.8 * (len(x) + len(y) - shared) - 1e-9:
            continue
        met += 1
        (looked, _), (other, found) = (ngram_join.prefixes(z, counts, 0.8) for z in (x, y))
        assert len(np.intersect1d(looked, other[:found]))
    assert met > 500
    empty, found = ngram_join.prefixes(np.zeros(0, np.uint64), counts, 0.8)
    assert not len(empty) and found == 0


def test_pages_of_one_template_meet_only_where_they_are_alike(spark):
    template = words(500, 90)
    texts = [f"{template} {words(600 + k, 45)}" for k in range(120)]
    texts += [f"{template} {words(600 + k, 45)} more{k}" for k in range(0, 120, 3)]  # near copies inside the template's bucket
    texts += [f"{template} {words(600, 45)} {words(800 + k, 2)}" for k in range(50)]  # a large group of them
    texts += [f"{template} tail{k}" for k in range(45)]  # alike by the template itself
    texts += [template, words(9, 40), None]
    links, roots = jaccard_by_force(texts)
    assert sum(n > 0 for n in links) > 120 > 20 < sum(n == 0 for n in links)
    for broadcast in (1000, 0):
        found = {r.doc_id: r for r in ngram_join.ngram_links(table(spark, texts), broadcast_rows=broadcast).collect()}
        assert [found[k].n_links for k in range(len(texts))] == links
        assert [found[k].class_id for k in range(len(texts))] == roots
    hashes = ngram_join.WordHashes()
    sets = [ngram_join.ngram_set(t.encode(), 5, hashes) for t in texts[:120]]
    stored = spark.createDataFrame([(bytes([k]), s.tobytes()) for k, s in enumerate(sets)], "set_key binary, grams binary")
    assert ngram_join.prefix_matches(stored, 0.8).count() == 0
    assert ngram_join.prefix_matches(stored.limit(0), 0.8).count() == 0


def test_bayesian_pruning_keeps_what_may_reach_the_threshold():
    needed = ngram_join.least_matches(0.8, 1e-9)
    assert needed[0][1] < needed[-1][1] < 0.8 * ngram_join.HASHES
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 32, (400, ngram_join.HASHES), dtype=np.uint32)
    like, unlike = a.copy(), a.copy()
    like[r.random(a.shape) > 0.8] = 1
    unlike[r.random(a.shape) > 0.3] = 1
    assert len(ngram_join.survivors(a, like, needed)) == 400
    assert len(ngram_join.survivors(a, unlike, needed)) == 0


# --- fingerprints


def test_fingerprints(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op3_fingerprints(spark, sf).collect()}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(order)
    for k, i in enumerate(order):
        a, b = texts[i], texts[order[(k + 1) % len(order)]]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        one, other, following = (fingerprints.signatures([x.encode()]) for x in (a, edited, b))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.as_text(one[0]) and r.edited_fingerprint == fingerprints.as_text(other[0])
        assert r.near_edited == fingerprints.likeness(one, other)[0] and r.near_next == fingerprints.likeness(one, following)[0]


FULL = (1 << 64) - 1


def scrambled(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def tossed(row):
    """A symbol's label by its left neighbour: twice the lowest bit in which they differ, and that bit's value."""
    out = [row[0] & 1]
    for left, own in zip(row, row[1:], strict=False):
        bit = next(k for k in range(64) if (left ^ own) >> k & 1)
        out.append(2 * bit + (own >> bit & 1))
    return out


def parsed(row):
    """One level of the parsing, symbol by symbol: runs, coin tossing, three colours, phrases from each local maximum."""
    runs = []
    for x in row:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    row = [x if n == 1 else scrambled((x + n * 0x9E3779B97F4A7C15) & FULL) for x, n in runs]
    label = row
    for _ in range(4):
        label = tossed(label)
    for colour in (5, 4, 3):
        for k in [k for k, c in enumerate(label) if c == colour]:
            beside = set(label[max(0, k - 1) : k] + label[k + 1 : k + 2])
            label[k] = min({0, 1, 2} - beside)
    assert set(label) <= {0, 1, 2} and all(a != b for a, b in zip(label, label[1:], strict=False))
    phrases = []
    for k, x in enumerate(row):
        if k == 0 or (k < len(row) - 1 and label[k - 1] < label[k] > label[k + 1]):
            phrases.append([])
        phrases[-1].append(x)
    return [scrambled(sum(scrambled((x + (k + 1) * 0xD6E8FEB86659FD93) & FULL) for k, x in enumerate(p)) & FULL) for p in phrases]


def least_names(data, bytes_named):
    """The least in each class of all phrase names that count for a fingerprint, level by level."""
    row, level, out = [bytes_named[b] for b in data], 0, set()
    while row:
        if level >= 3 or len(row) == 1:
            out |= set(row)
        row, level = (parsed(row) if len(row) > 1 else []), level + 1
    return [min((x for x in out if x % 64 == k), default=FULL) for k in range(64)]


def test_fingerprints_equal_a_parsing_symbol_by_symbol(spark, sf, texts):
    named = [int(x) for x in np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)]
    short = ["", "a", "aa", "ab", "aba", "aaaaab", "\x00\xff", "ab" * 50, "é" * 7 + "ü", words(5, 300), "x" * 3000 + words(6, 40) + "x" * 3000]
    found = fingerprints.signatures([x.encode() for x in short])
    for text, own in zip(short, found.tolist(), strict=True):
        assert own == least_names(text.encode(), named)
    ids = sorted(texts)
    rows = {r.doc_id: r for r in queries.op3_fingerprints(spark, sf).filter(F.col("doc_id").isin(ids[:6] + ids[-6:])).collect()}
    for i in ids[:6] + ids[-6:]:
        text, following = (texts[k] or "" for k in (i, ids[(ids.index(i) - 1) % len(ids)]))
        half = len(text) // 2
        own, edited, other = (least_names(x.encode(), named) for x in (text, text[: len(text) - half] + following[:half], following))
        assert rows[i].fingerprint == "".join("ffff" if x == FULL else f"{min(x >> 6 & 0xFFFF, 0xFFFE):04x}" for x in own)
        for got, b in ((rows[i].near_edited, edited), (rows[i].near_next, other)):
            filled = [(x, y) for x, y in zip(own, b, strict=True) if min(x, y) < FULL]
            assert got == pytest.approx(sum(x == y for x, y in filled) / len(filled) if filled else 1.0, abs=1e-12)


def test_fingerprints_do_not_depend_on_offset_or_neighbours():
    text = words(1, 2000).encode()
    alone = fingerprints.signatures([text])
    assert (fingerprints.signatures([b"zz", text, b"", text])[[1, 3]] == alone).all()
    for shift in (1, 3, 64, 777):
        assert fingerprints.likeness(alone, fingerprints.signatures([b"#" * shift + text]))[0] > 0.85
    assert fingerprints.likeness(alone, fingerprints.signatures([words(2, 2000).encode()]))[0] < 0.1


def test_colours_differ_from_neighbours():
    r = np.random.default_rng(2)
    names = r.integers(0, 1 << 62, 5000, dtype=np.uint64)
    first = r.random(5000) < 0.1
    first[0] = True
    c = fingerprints.colours(names, first)
    assert c.max() <= 2 and ((c[1:] != c[:-1]) | first[1:]).all()


def test_fingerprint_edges(spark):
    df = table(spark, ["", "a", "aaaa" * 50, "ab", "é" * 9, words(3, 9000)])
    found = fingerprints.edited_fingerprints(df.union(df))
    assert found.count() == 14
    assert {r.doc_id: r.n_chars for r in found.collect()}[None] == 0
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0
    assert fingerprints.fingerprint(df).columns[-1] == "fingerprint"


# --- mixing


def targets_by_force(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, docs, sf):
    rows = queries.op4_mixing(spark, sf).collect()
    again = {r.doc_id: r.taken for r in queries.op4_mixing(spark, sf).collect()}
    source = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    sizes = Counter()
    for s, n in source.values():
        sizes[s] += n
    want, taken = targets_by_force(dict(sizes)), Counter()
    for r in rows:
        s, n = source[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
        assert 0 <= r.taken <= 3 * n and again[r.doc_id] == r.taken
        taken[s] += r.taken
    assert len(rows) == len(source)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)


def test_mixing_edges(spark):
    df = table(spark, ["one two", "", None, "x " * 5000, "a b c", "a b c", " \t\n\x0b\x0c\r", "é à b"])
    rows = mixing.mix(df.union(df)).collect()
    assert len(rows) == 18
    assert {r.doc_id: r["size"] for r in rows} == {0: 2, 1: 0, 2: 0, 3: 5000, 4: 3, 5: 3, 6: 0, 7: 3, None: 0}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed(df).columns == df.columns
    copies = sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.mixed(df).count() == copies


def test_mixing_deals_copies_among_rows_alike(spark):
    rows = [("a", words(5, 90), "s", 1, 2, 3)] * 400 + [(f"b{k}", words(k, 20 + 7 * k), "s", 1, 2, 3) for k in range(10)] + [(f"c{k}", words(k, 30), None, 1, 2, 3) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, size int, row int, below int")
    found = mixing.mix(df).collect()
    assert len(found) == len(rows) and mixing.mix(df).columns[3:] == ["size", "row", "below", "_size", "source_size", "target", "copies", "taken"]
    for source in ("s", None):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target and all(0 <= r.copies <= 3 for r in own)
    assert len({r.copies for r in found if r.doc_id == "a"}) == 2


def test_small_sources_come_near_their_targets():
    r = np.random.default_rng(6)
    off = []
    for _ in range(40):
        size = np.sort(r.choice(np.arange(20, 3000), 10, replace=False))
        n, target = np.ones(10, int), float(size.sum()) * r.uniform(0.3, 2.7)
        copies = mixing.round_copies(size, n, mixing.balanced_rates(size, n, target, 3.0), target, 3)
        assert (copies >= 0).all() and (copies <= 3).all()
        off.append(abs(copies @ size - target) / target)
    assert max(off) < 0.02 and np.mean(off) < 0.003


def test_balanced_rates_meet_the_target():
    r = np.random.default_rng(8)
    for n_cells in (1, 5, 400):
        size, n = np.arange(1, n_cells + 1) * 7, r.integers(1, 50, n_cells)
        for share in (0.01, 0.5, 1.0, 2.0, 2.99):
            target = share * float(n @ size)
            rate = mixing.balanced_rates(size, n, target, 3.0)
            assert (rate > 0).all() and (rate < 3).all() and abs(float(rate @ (n * size)) - target) <= 1e-6 * target


def test_round_copies_meets_the_target():
    r = np.random.default_rng(4)
    for _ in range(50):
        size, n = np.unique(r.integers(1, 900, 60)), None
        n = r.integers(1, 9, len(size))
        rate = r.random(len(size)) * 3
        target = float(rate @ (n * size))
        copies = mixing.round_copies(size, n, rate, target, 3)
        assert (copies >= 0).all() and (copies <= 3 * n).all() and abs(copies @ size - target) <= 0.01 * target + 2


# --- substring dedup


def cut_by_force(texts, length):
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def repeats():
    shared = [words(k, 30) for k in range(6)]
    out = []
    for k in range(40):
        r = random.Random(k)
        out.append(" ".join([words(1000 + k, r.randrange(40)), r.choice(shared)[: r.randrange(181)], words(2000 + k, r.randrange(40)), r.choice(shared), words(3000 + k, r.randrange(9))]))
    return out + ["", "a" * 300, "ab" * 100, out[0], out[0], words(1, 20) + words(1, 20), "ü" * 100]


@pytest.mark.parametrize("large", [1000, 1])
def test_substring_dedup(spark, large):
    texts = repeats()
    want = cut_by_force([t.encode() for t in texts], 64)
    found = {r.doc_id: r for r in substring_dedup.drop_repeated_bytes(table(spark, texts), 64, large=large, broadcast_rows=1000 if large > 1 else 0).collect()}
    assert [(found[k].n_bytes, found[k].n_removed, found[k].n_spans, bytes(found[k].kept_bytes)) for k in range(len(texts))] == want
    assert found[None].n_bytes == 0 and found[None].n_spans == 0
    assert sum(w[1] for w in want) > 3000
    assert substring_dedup.drop_repeated_bytes(table(spark, []).limit(0), 64).count() == 0


def test_crowded_anchors_are_dealt_by_narrower_ranges(spark, monkeypatch):
    hot = words(50, 140)
    texts = [words(5000 + k, 15 + k % 11) + hot[k % 7 : 400 + 40 * (k % 9)] + words(6000 + k, 12) for k in range(120)] + [hot, hot, words(51, 300), words(51, 300)[:700]]
    calls, real = [], substring_dedup.narrower
    monkeypatch.setattr(substring_dedup, "narrower", lambda docs, rows, span, *more: calls.append(span) or real(docs, rows, span, *more))
    found = {r.doc_id: r for r in substring_dedup.drop_repeated_bytes(table(spark, texts), 400, large=1).collect()}
    assert calls == [16, 1]
    want = cut_by_force([t.encode() for t in texts], 400)
    assert [(found[k].n_bytes, found[k].n_removed, found[k].n_spans, bytes(found[k].kept_bytes)) for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 30_000


def test_long_texts_are_looked_at_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    texts = [b"", b"abc", bytes(range(256)) * 3]
    whole, begin, parts = substring_dedup.pieces_of(texts, 64)
    assert [texts[k][a : a + len(p)] == p for k, a, p in zip(whole, begin, parts, strict=True)] == [True] * 10
    assert sorted((k, a + s) for k, a, p in zip(whole, begin, parts, strict=True) for s in range(len(p) - 63)) == [(2, s) for s in range(768 - 63)]


def test_op5_on_all_documents(spark, sf, texts):
    ids = sorted(texts)
    want = cut_by_force([texts[i].encode() for i in ids], 400)
    found = {r.doc_id: r for r in queries.op5_substring_dedup(spark, sf).collect()}
    assert [(found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) for i in ids] == [(a, b, c, hashlib.sha256(d).hexdigest()) for a, b, c, d in want]


def test_merged_transforms_are_the_sorted_windows():
    r = random.Random(7)
    texts = [bytes(r.choices(b"ab", k=r.randrange(48, 90))) for _ in range(12)] + [b"abc" * 30, b"short"]
    size, rounds = 16, 3
    symbols, base = substring_dedup.symbols_of(texts, size)
    joined = b"".join(texts)
    starts = np.concatenate([b + np.arange(max(0, len(t) - 47)) for t, b in zip(texts, base, strict=True)]).astype(np.int64)
    built = [substring_dedup.shard_transform(symbols, starts[a:z], size, rounds) for a, z in ((0, 90), (90, 91), (91, len(starts)))]
    shard, block = substring_dedup.merge_transforms([layers for layers, _ in built], rounds)
    row = np.empty(len(shard), np.int64)
    row[np.argsort(shard, kind="stable")] = np.arange(len(shard))
    place = np.concatenate([p for _, p in built])[row]
    order = [joined[p : p + 48] for p in place]
    assert order == sorted(joined[s : s + 48] for s in starts)
    assert [a == b for a, b in zip(order, order[1:], strict=False)] == (block[1:] == block[:-1]).tolist()


# --- token files and packing


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer_path())
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["", None, "it's É é é a<|endoftext|>b\x85c\x1cd İstanbul ΑΣ ß", "don't, \"we'll\" x.y, I'M. ok.,", "a" * 5000 + " ∑∑", "ﬁ ½ 12a 3.14 ..., (x).", "<|ENDOFTEXT|>", "_a_ b_c", "日本語 text"]


def test_tokenizer_memory_equals_the_library(texts):
    every = [*texts.values(), *(x or "" for x in ODD)]
    want = library_ids(every)
    for kept in (None, 500):
        t = tokens.WordTokenizer(tokens.default_tokenizer_path(), kept)
        assert t.by_words and [x.tolist() for x in t.encode_many(every)] == want
        assert len(t.parts) <= t.kept // 2 + 1 and len(t.parts.older) <= t.kept // 2 + 1


def test_other_tokenizers_encode_whole_texts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, some = tokens.WordTokenizer(path), [*list(texts.values())[:20], "", "Two  Words\n", ODD[2]]
    assert not t.by_words
    assert [x.tolist() for x in t.encode_many(some)] == [x.ids for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_token_file_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.2, n), (1 << 32) - 1).astype(np.uint32)
    f = token_files.TokenFile(token_files.write_file([7, None], [n, 0], ids, 3))
    assert (f.read() == ids).all() and f.doc_ids == [7, None] and f.before == 3
    for a, z in ((0, 1), (200, 300), (n - 1, n)):
        if 0 <= a < z <= n:
            assert (f.read(a, z) == ids[a:z]).all()


def check_token_rows(rows, pairs):
    at = 0
    for r, (i, ids) in zip(rows, pairs, strict=True):
        ids = np.array([*ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op6(spark, sf, texts):
    rows = sorted(queries.op6_token_files(spark, sf).collect(), key=lambda r: r.start)
    ids = sorted(texts)
    check_token_rows(rows, list(zip(ids, library_ids([texts[i] for i in ids]), strict=True)))
    odd = sorted(token_files.token_files_round_trip(table(spark, ODD)).collect(), key=lambda r: r.start)
    check_token_rows(odd, [(None, []), *enumerate(library_ids(ODD))])
    assert token_files.token_files_round_trip(table(spark, []).limit(0)).count() == 0


def check_pieces(rows, ids_of, length):
    per_doc, per_sequence = {}, {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
        per_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(per_doc) == set(ids_of)
    for i, own in per_doc.items():
        ids, at = np.array([*ids_of[i], 2], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in per_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and at & (at - 1) == 0  # full, or a power of two


def test_op7(spark, sf, texts):
    ids = sorted(texts)
    check_pieces(queries.op7_packing(spark, sf).collect(), dict(zip(ids, library_ids([texts[i] for i in ids]), strict=True)), 4096)
    rows = packing.pack(table(spark, ODD), length=64).collect()
    check_pieces(rows, dict(enumerate(library_ids(ODD))) | {None: []}, 64)
    df = table(spark, ["same text"])
    assert packing.pack(df.union(df), length=64).count() >= 4
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3)])
def test_hilbert_neighbours_touch(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    order = np.argsort(packing.hilbert_key(points, bits))
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


# --- language


def test_op8(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op8_language_id(spark, sf).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r.held_out} == {r.doc_id for r in held}
    assert np.mean([rows[r.doc_id].lang_pred == r.lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert sum(r.rejected for r in rows.values()) <= 2


def predicted_by_force(model, text):
    """Language and cosine, n-gram by n-gram in plain Python."""
    kept = "".join(c if "a" <= c <= "z" or c >= "\x80" else " " for c in text.lower()).split(" ")
    raw, tf = (" " + " ".join(filter(None, kept)) + " ").encode(), Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(raw) - n + 1):
            key = 0
            for b in raw[i : i + n]:
                key = (key * 0x01000193 + b + 1) % 2**32
            tf[((key * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32) >> 20] += 1
    v = {d: np.log(1 + c) * model.idf[d] for d, c in tf.items()}
    length = sum(x * x for x in v.values()) ** 0.5
    near = [sum(x * float(c[d]) for d, x in v.items()) / length for c in model.centroids]
    best = max(range(len(near)), key=near.__getitem__)
    return model.languages[best], near[best]


def test_language_prediction_against_brute_force(docs):
    rows = [r for r in docs.collect() if r.text and r.lang]
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.fit(docs.filter(~langid.held_out(docs["doc_id"])))
    df = np.zeros(langid.DIMS)
    for r in learned:
        df += langid.counts(r.text) > 0
    assert np.allclose(model.idf, np.log((1 + len(learned)) / (1 + df)) + 1)
    some = [r.text for r in sorted(rows, key=lambda r: len(r.text))[::9]][:18] + ["Straße, ÜBER 12 e-mails!", "a"]
    labels, scores, _ = model.predict(some)
    for text, label, score in zip(some, labels, scores, strict=True):
        want, cosine = predicted_by_force(model, text)
        assert label == want and abs(score - cosine) < 1e-4


def test_language_edges(spark, docs):
    model = langid.fit(docs)
    df = table(spark, ["", "123 456", "the and of the", "☃☃", "x", "Ж" * 400])
    found = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [found[k].lang_pred == "und" for k in (0, 1, 2, 3, 4, None)] == [True, True, False, True, False, True]
    assert found[0].rejected and found[5].rejected and not found[2].rejected
    assert langid.identify(df, langid.fit(docs.limit(0))).filter("lang_pred = 'und'").count() == 7
    assert langid.fit(docs).languages == model.languages and (langid.fit(docs).centroids == model.centroids).all()


def test_language_rejects_what_is_in_no_learned_language(spark, docs):
    odd = spark.createDataFrame([(10**9, "Qwrtz " + words(1, 400, "qwxzjkvy"), "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("doc_id", "text", "lang").union(odd))
    polish = "Litwo, ojczyzno moja, ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie."
    finnish = "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saaani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat."
    r, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    noise = ["".join(r.choices(letters + " ", k=n)) for n in (200, 2000, 20_000)]
    base64 = ["".join(r.choices(letters + letters.upper() + "0123456789+/", k=n)) for n in (200, 2000, 20_000)]
    assert all(model.predict([polish, finnish, polish * 10, finnish * 10, *noise, *base64])[2])
    found = langid.identify(docs, model)
    assert found.filter("rejected").count() <= 2


def test_language_centroids_are_not_odd_rows():
    r = np.random.default_rng(5)
    rows = np.abs(np.vstack([r.normal(kind, 0.05, (60, 30)) for kind in np.eye(30)[:3]] + [np.eye(30)[20:22]])).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres = langid.clustered(rows, 3)
    assert len(centres) == 4 and (centres[:, 20:22] < 0.3).all()


def test_language_cutoffs():
    seen = np.zeros((langid.BANDS, langid.BINS + 1), np.int64)
    seen[16, 400], seen[16, 10], seen[20, 450] = 1000, 1, 1000
    found = langid.cutoffs(seen)
    assert abs(found[16] - 0.9 * 400 / 512) < 0.01 and abs(found[20] - 0.9 * 450 / 512) < 0.01
    assert (np.diff(found) >= 0).all() and found[12] < found[16] < found[18] < found[20] == found[24]
    assert not langid.cutoffs(0 * seen).any()


# --- lines


def test_op9_equals_sql(spark, sf):
    same(spark, sf, queries.op9_line_dedup, queries.ORACLE_SQL["op9_line_dedup"])


@pytest.mark.parametrize("broadcast", [400_000, 0])
def test_line_dedup(spark, broadcast):
    texts = [f"own {k}\n  Shared\tLINE \r\n\nÜber\nrest {k % 5}" for k in range(12)] + ["über", "shared\tline", "", None, "\n\n"]
    found = {r.doc_id: r for r in line_dedup.drop_common_lines(table(spark, texts), min_docs=10, broadcast_keys=broadcast).collect()}
    assert found[0].text == "own 0\n\nrest 0" and (found[0].n_lines, found[0].n_dropped) == (5, 2)
    assert found[12].text == "über" and found[13].text == "" and found[13].n_dropped == 1
    assert found[14].text == "" and found[15].text is None and found[15].n_lines == 1 and found[16].text == "\n\n"
    assert line_dedup.drop_common_lines(table(spark, []).limit(0)).count() == 0


# --- licences


def test_licence_scan_base(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op10_licenses(spark, sf).collect()}
    for i, text in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = "".join(c if c >= "\x80" or c.isalnum() else " " for c in low).split()
        places = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(found), len(places), min(starts, default=None), max(starts, default=None))
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licence_edges(spark):
    texts = [None, "", "MIT License; mit\nlicense", "The Apache-License", "GNU Lesser General Public License", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", "mit licenses", "É mit license " * 3, "SPDX license-identifier:ISC\nspdx-license identifier : MIT\r\nx"]
    found = [r for r in sorted(licenses.scan_licenses(table(spark, texts)).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)][1:]
    assert [r.labels for r in found] == ["", "", "mit", "apache", "gpl,lgpl", "apache,bsd,mit", "gpl", "", "mit", "isc,mit"]
    assert (found[8].n_base, found[8].first_word, found[8].last_word) == (3, 1, 7)
    assert (found[2].n_base, found[2].first_word, found[2].last_word) == (2, 0, 2)


def test_licence_expressions():
    choices = licenses.expression_choices
    assert licenses.to_postfix("MIT OR Apache-2.0 AND BSD-2-Clause") == ["MIT", "Apache-2.0", "BSD-2-Clause", "and", "or"]
    assert choices("MIT OR (Apache-2.0 AND BSD-2-Clause)") == {frozenset({"mit"}), frozenset({"apache", "bsd"})}
    assert choices("MIT */ more words") == {frozenset({"mit"})}
    for text in ("MIT OR (Apache-2.0 AND BSD-2-Clause)", "GPL-2.0 WITH MIT", "Unknown-1.0 OR MIT", "MIT */", ""):
        assert licenses.expression_labels(text) == {x for c in choices(text) for x in c}
    many = " AND ".join("(" + " OR ".join(["MIT", "Apache-2.0", "BSD-3-Clause", "ISC", "MPL-2.0"] * 40) + ")" for _ in range(20))
    assert licenses.expression_labels(many) == {"mit", "apache", "bsd", "isc", "mpl"}
    assert choices("") == choices("OR MIT") == choices("(MIT") == choices("unknown") == set()
