"""Alignment of tokenizers, the hidden Markov language model and hard negatives, against brute force."""

import hashlib
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import align, markov, negatives
from vectorloom.llm import queries as q
from vectorloom.llm.common import bucket_of

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
FILES = "/opt/tokenizers"
ODD = [None, "", " ", "a", "  ", "a ", " a  b\n c\t d ", "naïve «quoted» text", "x y z　ideographic", "▁ mark", "<|endoftext|> <s> </s>", "日本語 テキスト ok", "🙂 emoji 👩‍👩‍👧 join", "a" * 5000, "tab\tsep\r\nline   sep", "x\x00y \x7f z", "don't we'll I'm 12345 67.8%", "long " * 3000 + "end", "repeat me", "repeat me"]


# --- alignment ---


def brute_alignment(texts):
    import sentencepiece
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(f"{FILES}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    letters = align._byte_letters()
    name = {i: bytes(letters[c] for c in t) for t, i in whole.get_vocab().items() if t != "<|endoftext|>"}
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{FILES}/piece_bpe_32k.model")
    piece = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    held, counts = [], Counter()
    for text in texts:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(map(name.get, a)) != raw or b"".join(map(piece, b)) != raw:
            held.append(([], [], [], []))
            continue
        ends = lambda ids, of: np.cumsum([len(of(i)) for i in ids]).tolist()
        x, y = ends(a, name.get), ends(b, piece)
        common = sorted(set(x) & set(y))
        groups = [([i for i, e in zip(a, x, strict=True) if lo < e <= hi], [i for i, e in zip(b, y, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *common], common)]
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        held.append((a, b, groups, links))
        counts.update(set(links))
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    for a, b, groups, links in held:
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield len(a), len(b), len(groups), len(links), sum(counts[k] == top[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(written.encode()).hexdigest() if a else ""


def files():
    return ("byte_level", align.read_file(f"{FILES}/byte_bpe_50k.json")), ("pieces", align.read_file(f"{FILES}/piece_bpe_32k.model"))


@pytest.mark.parametrize("most", [align.BROADCAST_PAIRS, 0])
def test_alignment_agrees_with_brute_force(spark, most):
    rows = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3).withColumn("_row", F.lit("clash")).withColumn("pair", F.lit(1))
    got = {r.doc_id: r for r in align.align(docs, *files(), broadcast_pairs=most).collect()}
    for i, want in enumerate(brute_alignment(rows)):
        r = got[i]
        sha = hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha) == want, rows[i] and rows[i][:40]


def test_alignment_query_on_whole_table(spark):
    rows = {r.doc_id: r for r in q.op11_cross_tokenizer_alignment(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    for d, want in zip(docs, brute_alignment([d.text for d in docs]), strict=True):
        r = rows[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want


def test_alignment_of_nothing(spark):
    assert align.align(spark.createDataFrame([], SCHEMA), *files()).count() == 0
    rows = align.align(spark.createDataFrame([(None, None), (1, "")], SCHEMA), *files()).collect()
    assert [(r.n_a, r.n_links, r.count_sum, r.groups) for r in rows] == [(0, 0, 0, "")] * 2


def test_sparse_product_in_blocks():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 3, (40, 30)) * (draw.random((40, 30)) < 0.3), draw.integers(1, 3, (30, 25)) * (draw.random((30, 25)) < 0.3)

    def rows(m):
        r, c = np.nonzero(m)
        return align.Rows(np.searchsorted(r, np.arange(len(m) + 1)), c, m[r, c], m.shape[1])

    for block in (1, 50, 1 << 20):
        out = np.zeros((40, 25), int)
        for r, c, v in align.product(rows(a), rows(b), block):
            out[r, c] += v
        assert (out == a @ b).all()


def test_tokenizer_that_is_not_plain_runs_whole_texts(spark):
    raw = json.loads(align.read_file(f"{FILES}/byte_bpe_50k.json"))
    raw["model"]["ignore_merges"] = True
    other = align.byte_level(json.dumps(raw).encode())
    assert not other.by_word
    docs = spark.createDataFrame([(1, "one two  three\n four"), (2, None)], SCHEMA)
    same = [[tuple(r) for r in align.align(docs, ("byte_level", f), files()[1]).orderBy("doc_id").collect()] for f in (json.dumps(raw).encode(), files()[0][1])]
    assert same[0] == same[1]


# --- hidden Markov language model ---


def small_model(states=3, symbols=5, seed=0):
    draw = np.random.default_rng(seed)
    moves, emits = draw.random((states, states)) + 0.1, draw.random((states, symbols)) + 0.1
    emits[:, 0] = 0
    emits[0] = np.eye(1, symbols)[0]
    return moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True)


def paths(sequence, moves, emits):
    """Every path of states with its probability, from state 0."""
    for path in itertools.product(range(len(moves)), repeat=len(sequence)):
        p, now = 1.0, 0
        for s, x in zip(path, sequence, strict=True):
            p, now = p * moves[now, s] * emits[s, x], s
        yield path, p


@pytest.mark.parametrize("long", [2, 3, 100])
def test_forward_sums_over_all_paths(long):
    moves, emits = small_model()
    sequences = [[1, 2, 0], [0], [4, 4, 4, 1, 2, 3, 0], [3, 0], [1, 1, 2, 2, 3, 0]]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    got = markov.forward(np.concatenate(sequences), first, moves, emits.T.copy(), long)
    assert np.allclose(got, [np.log(sum(p for _, p in paths(s, moves, emits))) for s in sequences])


def test_expected_counts_are_those_of_all_paths():
    moves, emits = small_model()
    texts = [[1, 2, 0], [0], [4, 1, 2, 0], [3, 3, 0]]
    want_moves, want_seen = np.zeros((3, 3)), np.zeros((5, 3))
    for text in texts:
        whole = sum(p for _, p in paths(text, moves, emits))
        for path, p in paths(text, moves, emits):
            for a, b, x in zip((0, *path), path, text, strict=False):
                want_moves[a, b] += p / whole
                want_seen[x, b] += p / whole
    moved, seen, likelihood = markov.expected_counts(np.concatenate(texts), moves, emits.T.copy(), np.ones(3) / 3)
    assert np.allclose(moved, want_moves) and np.allclose(seen, want_seen)
    assert np.isclose(likelihood, sum(np.log(sum(p for _, p in paths(t, moves, emits))) for t in texts))


def test_language_model_on_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.lit("x").alias("_row"), F.lit("x").alias("word"))
    extra = [(i, t, "x", "x") for i, t in ((-1, None), (-2, ""), (-3, "ABC " + "z" * 3000), (-4, "abc " + "Z" * 3000), (-5, "never-seen\x0bWORD"), (None, "the the"))]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(3)
    learn = rows.where(bucket_of(F.col("doc_id"), 5) != 1)
    model = markov.fit(learn, frequent=300, own=200)
    got = {(r.doc_id): r for r in markov.score(rows, model).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(w for r in learn.collect() for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    better = 0.0
    for r in rows.collect():
        own, g = words(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert g.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 1:
            better += g.score - g.base_score
    assert better > 0 and model.likelihoods == sorted(model.likelihoods)
    held = Counter()  # words of each shared symbol have probabilities that add up to 1 with that of a new word
    by = model.vocabulary
    for w, c in counts.items():
        key = w if w is None or len(w.encode()) <= markov.LONGEST else " " + hashlib.sha256(w.encode()).hexdigest()
        if key is not None and key not in by.words.words[:200].to_pylist():
            b = zlib.crc32(key.encode()[-3:]) % markov.SHARED
            held[b] += (c + 0.5) / (by.shared_total[b] + 0.5 * (by.shared_distinct[b] + 1))
    assert all(p + 0.5 / (by.shared_total[b] + 0.5 * (by.shared_distinct[b] + 1)) == pytest.approx(1) for b, p in held.items())
    assert np.allclose(model.symbols.sum(axis=1), 1) and np.allclose(model.moves.sum(axis=1), 1)


def test_every_text_trains_the_states(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120).repartition(3)
    taken, once = [], markov._round

    def counted(*args):
        moved, seen, likelihood = once(*args)
        taken.append(seen.sum())
        return moved, seen, likelihood

    monkeypatch.setattr(markov, "_round", counted)
    monkeypatch.setattr(markov, "WARM_WORDS", 50)
    model = markov.fit(docs, frequent=300, own=200)
    total = model.vocabulary.total
    first, last = taken[: markov.WARM_ROUNDS], taken[markov.WARM_ROUNDS :]
    assert markov.slices_of(total) == len(set(first)) == markov.WARM_ROUNDS  # a slice a round, none twice
    assert sum(first) == pytest.approx(total, rel=1e-3) and last == pytest.approx([total] * markov.ROUNDS, rel=1e-3)
    assert [markov.slices_of(n) for n in (0, 99, 100, 299, 300, 10_000)] == [1, 1, 2, 4, 6, 12]


def test_every_round_takes_every_text(spark, monkeypatch):
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in draw.integers(0, 300, 2_400_000)]
    docs = spark.createDataFrame([(i, " ".join(words[a : a + 2000])) for i, a in enumerate(range(0, len(words), 2000))], SCHEMA).repartition(4)
    taken, once = [], markov._round

    def counted(*args):
        moved, seen, likelihood = once(*args)
        taken.append(seen.sum())
        return moved, seen, likelihood

    monkeypatch.setattr(markov, "_round", counted)
    model = markov.fit(docs, frequent=300, own=200)  # more than two million words; no round may leave some out
    assert model.vocabulary.total == 2_401_200
    assert taken == pytest.approx([2_401_200] * (markov.WARM_ROUNDS + markov.ROUNDS), rel=1e-3)


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = markov.fit(empty)
    assert markov.score(empty, model).count() == 0
    r = markov.score(spark.createDataFrame([(1, "a b")], SCHEMA), model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


# --- hard negatives ---


def brute_negatives(rows, anchors, positives=5, negatives=10):
    """rows: (vec_id, label, whole numbers)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    width = max((len(r[2]) for r in rows), default=0)
    x = np.array([list(r[2]) + [0] * (width - len(r[2])) for r in rows], np.int64).reshape(len(rows), width)
    late = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    out = Counter()
    for a in [i for i, r in enumerate(rows) if anchors(r[0])]:
        s = (x @ x[a]).tolist()
        ranked = sorted(range(len(rows)), key=lambda i: (-s[i], *late(i)))
        for p in [i for i in ranked if i != a and rows[i][1] == rows[a][1]][:positives]:
            fits = [i for i in ranked if rows[i][1] != rows[a][1] and 30 * s[p] <= 100 * s[i] <= 90 * s[p]][:negatives]
            out.update((rows[a][0], rows[p][0], k + 1, rows[i][0], s[p], s[i]) for k, i in enumerate(fits))
    return out


FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
VECTORS = "vec_id bigint, label int, v array<bigint>"


@pytest.mark.parametrize("ways,leaf", [(3, 4), (16, 256)])
def test_hard_negatives_agree_with_brute_force(spark, ways, leaf):
    draw = np.random.default_rng(8)
    centres = draw.normal(0, 30, (6, 5))
    rows = [(i, int(draw.integers(0, 3)), (centres[draw.integers(0, 6)] + draw.normal(0, 8, 5)).astype(int).tolist()) for i in range(240)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(60)] + [(2000 + i, 1, [0] * 5) for i in range(4)]
    rows += [(3000, None, [1] * 5), (3010, 1, None), (3020, 1, [1, None, 1, 1, 1]), (3030, 1, [4, -2]), (3040, 2, []), (None, 1, rows[3][2]), (None, 0, rows[4][2]), rows[10], rows[20]]
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("key", F.lit("clash")), F.col("vec_id") % 10 == 0, ways=ways, leaf=leaf)
    assert Counter(tuple(r[f] for f in FIELDS) for r in got.collect()) == brute_negatives(rows, lambda i: i is not None and i % 10 == 0)


def test_hard_negatives_on_whole_table(spark):
    rows = []
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect():
        v = None if r.embedding is None or any(x is None or not math.isfinite(x) for x in r.embedding) else [math.floor(256 * x) for x in r.embedding]
        rows.append((r.vec_id, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10, v))
    got = Counter(tuple(r[f] for f in FIELDS) for r in q.op13_hard_negatives(spark, DATA).collect())
    assert got == brute_negatives(rows, lambda i: i % 100 == 0) and got


def test_hard_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [3])], VECTORS), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(1, 1, [1 << 40])], VECTORS), F.lit(True))


def test_ranges_eliminate_but_lose_nothing():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(c, 4, (150, 4)) for c in ([0, 0, 0, 0], [90, 0, 0, 0], [0, 90, 0, 0], [0, 0, 90, 0])]).round()
    tree = negatives.build(x[::3], 2, 4)
    leaf, away = negatives.place(tree, x)
    away = np.hstack([away, np.linalg.norm(x, axis=1, keepdims=True)])
    kinds = np.unique(leaf)
    held = negatives.ranges(tree, kinds, np.stack([away[leaf == n].min(axis=0) for n in kinds]), np.stack([away[leaf == n].max(axis=0) for n in kinds]))
    visited = 0
    for a in range(0, len(x), 10):
        scores = x @ x[a]
        for low, high in ((np.quantile(scores, 0.98), np.inf), (scores[a] * 0.3, scores[a] * 0.9), (-np.inf, np.inf)):
            _, got = negatives.survivors(tree, held, x[a : a + 1], np.array([low]), np.array([high]))
            assert set(leaf[(scores >= low) & (scores <= high)]) <= set(got.tolist())
            visited += len(got) if np.isfinite(low) and high == np.inf else 0
    assert visited < 0.6 * len(kinds) * len(range(0, len(x), 10))
