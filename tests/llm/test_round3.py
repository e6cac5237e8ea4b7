"""Conversation repair, the Merkle manifest and language-model scores against independent plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from lumisift.llm import conversations, language_model, merkle, queries, tokens
from pyspark.sql import functions as F

# --- conversation repair


def plan_by_force(rows):
    """Cheapest (cost, audit) over all edit scripts of rows (initial, must go, cut short): best first search over (cost, audit)."""
    queue, done = [(0, "", 0, "^")], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if at == len(rows) and state in "^u":
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        after = {"^": {"s": "s", "u": "a"}, "s": {"u": "a"}, "u": {"u": "a"}, "a": {"a": "u"}}[state]
        if len(audit) < 3 * len(rows) + 4:
            for role in "ua":
                if role in after:
                    heapq.heappush(queue, (cost + 2, audit + "I", at, after[role]))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state))
            if not gone:
                if initial in after:
                    heapq.heappush(queue, (cost + cut, audit + "K", at + 1, after[initial]))
                for role in "ua":
                    if role in after and role != initial:
                        heapq.heappush(queue, (cost + 2 + cut, audit + "R", at + 1, after[role]))
    raise AssertionError


def test_repairs_are_the_cheapest_with_the_least_audit():
    kinds = [("s", False, False), ("u", False, False), ("a", False, False), ("x", False, False), ("u", True, False), ("a", False, True), ("s", False, True)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert conversations.cheapest_repair("".join(conversations.symbol(*r) for r in rows)) == plan_by_force(rows), rows
    r = random.Random(4)
    for n in (7, 11):
        for _ in range(60):
            rows = r.choices(kinds, k=n)
            assert conversations.cheapest_repair("".join(conversations.symbol(*x) for x in rows)) == plan_by_force(rows), rows


def test_blocks_of_long_conversations_give_the_same_repairs(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choices("suaxSUA-", k=n)) for n in [*range(8, 24), 60]]
    whole = [conversations._short.__wrapped__(t) for t in texts]
    for size in (1, 3, 7):
        monkeypatch.setattr(conversations, "BLOCK", size)
        assert [conversations._short.__wrapped__(t) for t in texts] == whole
    monkeypatch.undo()
    assert conversations.cheapest_repair("s" + "ua" * 10_000) == (0, "K" * 20_001)


def plan_by_states(symbols):
    """The same by a pass over the turns with the best (cost, audit) of each state of the grammar; insertions are tried twice in a row."""
    after = {"^": {"s": "s", "u": "a"}, "s": {"u": "a"}, "u": {"u": "a"}, "a": {"a": "u"}}

    def with_insertions(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for role in set(after[state]) & set("ua"):
                    end = after[state][role]
                    best[end] = min(best.get(end, (1 << 60, "")), (cost + 2, audit + "I"))
        return best

    best = with_insertions({"^": (0, "")})
    for x in symbols:
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 3, "D")]
            if x != "-":
                ways += [(end, cost + x.isupper() + (0 if x.lower() == role else 2), "K" if x.lower() == role else "R") for role, end in after[state].items() if role != "s" or x.lower() == "s"]
            for end, c, edit in ways:
                new[end] = min(new.get(end, (1 << 60, "")), (c, audit + edit))
        best = with_insertions(new)
    return min(best[k] for k in "^u" if k in best)


def test_long_repairs_equal_a_pass_over_states():
    r = random.Random(8)
    for n in (5, 30, 120, 399):
        for _ in range(6):
            text = "".join(x if r.random() < 0.8 else r.choice("suaxUA-") for x in ("s" * r.randrange(2) + "ua" * n)[:n])
            assert conversations.cheapest_repair(text) == plan_by_states(text)


def repaired_by_force(rows):
    """conv_id -> the contract's columns, from rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            role = "user" if hit == 4 else role
            turns += [(turn, role, text)] * (2 if hit == 3 else 1)
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()))
        seen, counts, symbols, illegal = set(), Counter(), [], 0
        for k, (_, role, text) in enumerate(turns):
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            illegal += k > 0 and turns[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        numbers = {t for t, _, _ in turns if t is not None}
        cost, audit = plan_by_force(symbols)
        left, at = [], 0
        for edit in audit:
            pairs_from = 1 if left and left[0][0][:1] == "s" else 0
            due = ("user", "assistant")[(len(left) - pairs_from) % 2]
            if edit == "I":
                left.append((due, ""))
                continue
            if edit != "D":
                left.append((turns[at][1] if edit == "K" else due, turns[at][2]))
            at += 1
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversation_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert found == repaired_by_force(rows) and len(found) >= 20


def test_awkward_conversations(spark):
    r = random.Random(6)
    texts = ["Yes.", "No", None, "", " \x0b\n", "Why?", "Ü", "x\x1f", "Stop!\t"]
    rows = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, 4, 5, 6, None]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for _ in range(60)]
    rows += [(4, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(300)] + [(5, 7, "user", "Same.")] * 8 + [(k, 0, "user", "Alone.") for k in range(100, 140)]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, stage string, kind int")
    found = {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in conversations.repaired(conversations.damaged(df), df).collect()}
    want = repaired_by_force([x for x in rows])
    assert set(found) == set(want)
    for conv in want:
        if conv == 4:  # too long for the search over all scripts
            assert found[4][:5] == want[4][:5]
        else:
            assert found[conv] == want[conv], conv
    assert conversations.repaired(conversations.damaged(df.limit(0)), df.limit(0)).count() == 0


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_force(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree_by_force(leaves):
    """Root, and the siblings before and behind on the way of each leaf."""
    ways, level, places = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for way, p in zip(ways, places, strict=True):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            way.append((run[: p % 3], run[p % 3 + 1 :]))
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        places = [p // 3 for p in places]
    return level[0], ways


def manifest_by_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row.source, []).append((row.doc_id is not None, row.doc_id or 0, leaf_by_force(row, row.text), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees.append(tree_by_force([x[2] for x in groups[s]]))
    root, tops = tree_by_force([t[0] for t in trees])
    out = []
    for s, (subroot, ways), top in zip(order, trees, tops, strict=True):
        for (_, _, leaf, row), way in zip(groups[s], ways, strict=True):
            folded = leaf
            if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 2 == 0 and row.text is not None:
                folded = leaf_by_force(row, row.text.replace("\n", ""))
            for before, after in way + top:
                folded = h(*before, folded, *after)
            out.append((str(row.doc_id), leaf, subroot, root, h(*(x for a, z in way + top for x in a + z)), folded, folded == root))
    return sorted(out)


MANIFEST = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = manifest_by_force(docs.collect())
    found = sorted((str(r["doc_id"]), *(r[c] for c in MANIFEST)) for r in queries.op12_merkle_manifest(spark, sf).collect())
    assert found == want and {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("chunk", [1, 4, 2187])
def test_awkward_manifests(spark, monkeypatch, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    r = random.Random(7)
    rows = [(k, r.choice(["a\nb", "", None, "Ünï", "x"]), r.choice(["en", None]), "hot" if k % 2 else r.choice(["a", "é", "zz", "", None]), r.choice([1, None])) for k in range(150)]
    rows += [(None, "no id\n", "en", "hot", 5)] * 3 + [(7, "same", "en", "hot", 4)] * 5 + [(1000 + k, "t", "en", f"s{k}", 1) for k in range(30)]
    df = spark.createDataFrame([(*x, 0, "x") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, part int, tree string")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(df, names, changed=("text", F.translate("text", "\n", "")), changed_if=changed, proofs=True)
    assert sorted((str(x["item"]), *(x[c] for c in MANIFEST)) for x in found.collect()) == manifest_by_force(df.collect())
    step = found.filter("item = 9").first()
    assert step["proof_sha256"] == h(*(p["before"] + p["after"] for p in step["proof"]))
    assert merkle.manifest(df.limit(0), names).count() == 0
    one = merkle.manifest(df.filter("item = 9" if "item" in df.columns else "doc_id = 9"), names).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h() and one["verified"]


def test_missing_nodes_are_the_fewest():
    for total in (1, 2, 3, 4, 10, 28, 82):
        for low in range(total):
            for high in range(low + 1, total + 1):
                nodes = merkle.missing(low, high, total)
                assert len(nodes) == len(set(nodes)) <= 4 * 5
                if (low, high) == (0, total):
                    assert not nodes


# --- language model


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
            counts.update(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()))
            counts[None] += 1
    return counts


def check_base(found, rows):
    counts = plain_counts(rows)
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc_id, text in rows:
        own = [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]
        base = sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((str(doc_id), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == sorted(want)


def test_language_model_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op13_language_model(spark, sf).collect()
    check_base(found, rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in found)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_scores_beat_the_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = language_model.scored(docs, ~language_model.held_out(F.col("doc_id"))).filter(language_model.held_out(F.col("doc_id")))
    total = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert total["s"] / total["n"] > total["b"] / total["n"] + 0.05


def test_awkward_texts_and_unknown_words(spark):
    texts = ["a b c A\x0bB", "", None, " \t", "w" * 40 + " a", "new words only zzz", "été ÉTÉ a b"] * 3 + ["a b " * 3000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b"), (3, " \t"), (3, " \t")]
    df = spark.createDataFrame([(*x, 9, "x") for x in rows], "doc_id long, text string, n_tokens long, key string")
    small = {"known": 4, "vocabulary": 3, "trainer_words": 50}  # most words meet their counts in the join
    found = language_model.scored(df, ~language_model.held_out(F.col("doc_id")), **small)
    assert {"n_tokens", "_n_tokens", "key"} <= set(found.columns)
    check_base(found.drop("n_tokens").withColumnRenamed("_n_tokens", "n_tokens").collect(), rows)
    assert language_model.scored(df.limit(0), F.lit(True)).count() == 0
    nothing = language_model.scored(df, F.lit(False)).collect()
    assert {(r["base_score"], round(r["score"], 6)) for r in nothing} == {(0.0, 0.0)}


def test_probabilities_sum_to_one_and_follow_the_history():
    counts = np.array([50.0, 30, 20, 10, 5])
    network = language_model.Network(5, counts=counts, rare=7.0)
    ids = np.array([[4, 0, 1, 2, 3, 0]])
    states, last = network.run(ids, np.zeros((1, network.width), np.float32))
    for state in states[:, 0]:
        each = network.log_probabilities(np.repeat(state[None], 6, 0), np.arange(6))
        assert abs(np.exp(each).sum() - 1) < 1e-5
    halves = network.run(ids[:, 3:], network.run(ids[:, :3], np.zeros((1, network.width), np.float32))[1])[1]
    assert np.allclose(last, halves)


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    network = language_model.Network(40, 5)
    network.weights[:] = r.standard_normal(len(network.weights)) * 0.4
    ids, targets, begins = r.integers(0, 41, (3, 6)), r.integers(0, 41, (3, 6)), np.zeros((3, 6), bool)
    begins[1, 3] = True
    start = np.zeros((3, 5), np.float32)

    def loss():
        states, _ = network.run(ids, start, begins)
        return -float(network.log_probabilities(states.reshape(-1, 5).astype(np.float64), targets.T.ravel()).sum())

    kept, gradient = [], language_model.Network(40, 5, np.zeros_like(network.weights))
    states, _ = network.run(ids, start, begins, kept)
    _, back = network.log_probabilities(states.reshape(-1, 5), targets.T.ravel(), gradient)
    network.backward(ids, begins, kept, back.reshape(states.shape), gradient)
    for k in r.choice(len(network.weights), 60, replace=False):
        was = network.weights[k]
        network.weights[k] = was + 0.02
        up = loss()
        network.weights[k] = was - 0.02
        slope, network.weights[k] = (up - loss()) / 0.04, was
        assert abs(slope - gradient.weights[k]) < 0.02 + 0.02 * abs(slope)


def test_texts_are_read_to_their_ends_whatever_stands_beside_them():
    r = np.random.default_rng(2)
    network = language_model.Network(30, counts=r.integers(1, 50, 30).astype(float), rare=3.0)
    texts = [np.append(r.integers(0, 31, n), 0) for n in (0, 1, 31, 32, 33, 200, 5, 64)] * 3
    alone = [dict(language_model.scored_texts(network, [(0, t)], 0))[0] for t in texts]
    together = dict(language_model.scored_texts(network, enumerate(texts), 0))
    assert np.allclose([together[k] for k in range(len(texts))], alone, rtol=1e-4)


def moved(before, after):
    """Of the words that stand as inputs, whether their vectors are others than before."""
    return np.abs(after.vectors[: after.words] - before.vectors[: before.words]).max(1) > 1e-5


@pytest.mark.parametrize("trainer_words", [1000, 10**6])
def test_weights_are_fitted_on_every_training_text(spark, trainer_words):
    docs = spark.createDataFrame([(k, f"w{k} " * 30) for k in range(600)], "doc_id long, text string")  # each with a word of its own
    model, _ = language_model.counted(docs)
    before = model.network()
    codes = language_model.encoded(docs, model)
    language_model.fit(codes, model, F.xxhash64("doc_id"), trainer_words=trainer_words)
    assert model.words == 601 and moved(before, model.network()).all()


def test_a_trainer_reads_all_it_is_dealt():
    counts = np.full(41, 50.0)
    before, network = (language_model.Network(41, counts=counts) for _ in range(2))
    language_model.trained(network, (np.array([k] * 70 + [40]) for k in range(40)), at_once=200)
    assert moved(before, network).all()


# --- tokens


@pytest.mark.parametrize("pool", ["latin-1", "marks", "mixed", "controls"])
def test_remembered_words_give_the_librarys_ids(pool):
    latin = [chr(k) for k in range(256)]
    pool = {
        "latin-1": latin, "marks": [*".,!'\"-|<> \n\t\x1c\x1d\x1e\x1f\x85\xa0a1B", "the", "'s", "'S", "é"], "controls": [*map(chr, range(33)), *".,ab"],
        "mixed": [*latin, *"ıİſßẞ你\u2003\u3000\u200b\ufeffΣς\u0301", "<|endoftext|>", "<|", "don't", "A.b,c"],
    }[pool]
    r, words = random.Random(3), tokens.WordTokenizer(tokens.default_tokenizer_path())
    texts = ["".join(r.choices(pool, k=r.randint(1, 12))) for _ in range(26_000)]
    want = [x.ids for x in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, want, words.encode_many(texts), strict=True) if a != b.tolist()] == []


# --- evaluated licence expressions


def test_expressions_are_evaluated(spark):
    from lumisift.llm import licenses

    forms = {
        "MIT OR GPL-2.0-only": "gpl|mit", "MIT AND GPL-2.0-only": "gpl+mit", "(MIT OR GPL-2.0-only) AND Zlib": "gpl+zlib|mit+zlib", "MIT OR (MIT AND ISC)": "mit",
        "GPL-2.0-only WITH Classpath-exception-2.0": "gpl", "LicenseRef-Acme.1 OR MIT": "licenseref-acme.1|mit", "Foo-Bar-1.0+ */": "foo-bar-1.0+", "see file": "", "nothing AND MIT": "mit", "": "",
    }
    for text, form in forms.items():
        assert licenses.normal_form(text)[0] == form, text
    many = " AND ".join(f"(A{k}-1.0 OR B{k}-1.0)" for k in range(40))
    form, n = licenses.normal_form(many)
    assert n == licenses.MOST_CHOICES and form.count("and") == 39 and len(licenses.expression_labels(many)) == 80
    rows = spark.createDataFrame([(k, f"SPDX-License-Identifier: {t}\nSPDX-License-Identifier: ISC", "x") for k, t in enumerate(forms)], "doc_id long, text string, declared string")
    found = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    assert [found[k]["_declared"] for k in range(len(forms))] == [";".join(sorted({"isc", f} - {""})) for f in forms.values()]
    assert round(found[0].score, 9) == 0.95 and found[1].score == 1.0 and found[0].declared == "x"


def test_packing_of_one_hot_place_is_gapless(spark):
    from lumisift.llm import packing

    rows = [(k % 50, "the same text of a few words") for k in range(400)] + [(None, None)] * 3
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=64).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at in (64, 32, 16, 8, 4, 2, 1)
    assert sum(p.length for p in pieces) == 3 + sum(p.doc_tokens for p in pieces if p.start == 0 and p.doc_id is not None)
